"""Running sums in a global order without a single task: range partitions, local windows and the partitions' totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise, shuffle_partitions

FEW_PARTS = 100_000


def cumulative(df: DataFrame, order: list[str], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """`df` with, for each new column -> summed column, the sum of the rows of its group up to and including its own in
    the order, and `<new>_total` for the whole group. The order must tell rows of a group apart.

    The table of totals has one row for each group in each range partition; it is broadcast if it has FEW_PARTS rows at most
    (counted, unless there is one group), and joined otherwise."""
    by = by or []
    n = shuffle_partitions(df.sparkSession)
    dealt = materialise(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "prefix")
    parts = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    columns = {f"_base_{new}": F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)) for new in sums} | {f"{new}_total": F.sum(f"_{new}").over(whole) for new in sums}
    bases = parts.withColumns(columns).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), *[f"_base_{new}" for new in sums], *[f"{new}_total" for new in sums])
    local = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({new: F.sum(c).over(local) for new, c in sums.items()})
    match = F.col("_part") == F.col("_at")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = rows.join(F.broadcast(bases) if not by or parts.count() <= FEW_PARTS else bases, match).withColumns({new: F.col(new) + F.col(f"_base_{new}") for new in sums})
    return joined.drop("_part", "_at", *[f"_by_{c}" for c in by], *[f"_base_{new}" for new in sums])
