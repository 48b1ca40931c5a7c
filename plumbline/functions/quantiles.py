"""Exact percentiles without one task that holds a column: distinct values are counted first, their running counts come
from range partitions (functions/prefix.py), and each rank is looked up where its value lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.prefix import cumulative


def percentiles(df: DataFrame, columns: dict[str, Column], shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., column, q): for each named column the array of its values at `shares`, linearly interpolated between the two
    ranks around (n - 1) * share. Nulls take no part; a column without values has no row. Values are doubles."""
    by = by or []
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.cast("double").alias("v")) for n, c in columns.items()])).alias("r")
    per = df.select(*by, rows).select(*by, "r.*").where("v is not null").groupBy(*by, "column", "v").agg(F.count("*").alias("n"))
    c = cumulative(per, ["v"], {"upto": "n"}, [*by, "column"])

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))

    picked = []
    for i, s in enumerate(shares):
        place = (F.col("upto_total") - 1) * F.lit(float(s))
        picked += [value_at(F.floor(place)).alias(f"_lo{i}"), value_at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_at{i}")]
    out = c.groupBy(*by, "column").agg(*picked)
    return out.select(*by, "column", F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_at{i}") for i in range(len(shares))]).alias("q"))


def percentile_row(df: DataFrame, column: Column, shares: list[float]) -> list[float]:
    """The values at `shares` as numbers of the driver, for bounds of bins; empty without any value."""
    found = percentiles(df, {"x": column}, shares).first()
    return list(found.q) if found else []
