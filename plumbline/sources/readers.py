"""Sources and sinks (IO-1..8): delimited text, zipped CSVs, Parquet; tags as Parquet with zstd."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship

DELIMITERS = {"comma": ",", "pipe": "|", "tab": "\t", "semicolon": ";"}


def delimited(spark: SparkSession, path: str, delimiter: str = "comma", schema: str | None = None) -> DataFrame:
    """A delimited file or folder with a header; blank or repeated header names are refused (IO-1)."""
    reader = spark.read.option("header", True).option("sep", DELIMITERS.get(delimiter, delimiter)).option("multiLine", False)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    first = spark.read.text(path).limit(1).collect()
    names = next(csv.reader([first[0].value], delimiter=DELIMITERS.get(delimiter, delimiter))) if first else []
    if any(not n.strip() for n in names) or len({n.strip().lower() for n in names}) != len(names):
        raise ValueError(f"header names are blank or repeated: {names}")
    return df


def zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """Members of zip files as rows (archive, member, line, fields as a map); archives are read in parallel, each by one
    task (IO-2)."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(batches):
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                        with z.open(m) as f:
                            rows, at = [], 0
                            for r in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig")):
                                rows.append((p, m, at, {k: v for k, v in r.items() if k is not None and not isinstance(v, list)}))
                                at += 1
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "line", "fields"])
                                    rows = []
                            yield pd.DataFrame(rows, columns=["archive", "member", "line", "fields"])

    return files.mapInPandas(members, "archive string, member string, line bigint, fields map<string,string>")


def member(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One member of zipped_csv() as a table."""
    return rows.where(F.col("member") == name).select("line", *[F.col("fields")[c].alias(c) for c in columns])


def snapshot(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, or only some of its columns, which are all that is read; unknown names are refused (IO-3, IO-4)."""
    df = spark.read.parquet(path)
    unknown = sorted(set(columns or []) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return df.select(*columns) if columns else df


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet with zstd, split into folders by columns if given (IO-6)."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
