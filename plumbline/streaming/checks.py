"""The stateless checks on streams: frozen bins, rules and missing rates per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.drift import assign
from plumbline.functions.values import kinds
from plumbline.operators.rules import states


def windowed_bins(stream: DataFrame, spec: dict, at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window and frozen bin: what governed PSI compares with its baseline."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), assign(spec).alias("bin")).agg(F.count("*").alias("rows"))


def windowed_rules(stream: DataFrame, rules: list[dict], at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Evaluated and violating rows of each rule per window."""
    types = kinds(stream.schema)
    counts = [c for r in rules for c in (F.count_if(states(r, types)[0]).alias(f"{r['id']}_evaluated"), F.count_if(states(r, types)[2]).alias(f"{r['id']}_violations"))]
    return stream.withWatermark(at, late).groupBy(F.window(at, window)).agg(*counts)


def windowed_missing(stream: DataFrame, columns: list[str], at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Share of nulls of each column per window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count("*").alias("rows"), *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
