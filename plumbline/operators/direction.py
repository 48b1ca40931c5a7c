"""Correlations, charts and candidate pairs of directional tests (DR-1, DR-2, DR-10 to DR-12); the analysis itself is in
directionality.py."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.prefix import cumulative
from plumbline.functions.tails import t_two_sided
from plumbline.functions.values import rounded
from plumbline.plans.registry import query
from plumbline.session import ship, table

#: Floor of a correlation, highest p.
MATERIAL, ALPHA = 0.20, 0.05


@F.pandas_udf(T.DoubleType())
def t_tail(r: pd.Series, n: pd.Series) -> pd.Series:
    def one(r, n):
        if r is None or n is None or n < 3 or r != r:
            return None
        return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


def average_ranks(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """value -> average rank (ties share it), from counts per distinct value (DR-2, WN-7)."""
    by = by or []
    per = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return cumulative(per, ["v"], {"c": "n"}, by).select(*by, "v", (F.col("c") - (F.col("n") - 1) / 2).alias("rank"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation, rows, two-sided p, and whether it is material (DR-1)."""
    ship(df.sparkSession)
    one = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"), F.count("*").alias("n"))
    return one.withColumn("p", t_tail("r", F.col("n").cast("double"))).withColumn("material", (F.abs("r") >= MATERIAL) & (F.col("p") <= ALPHA))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks; the p and gate of pearson() (DR-2)."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = rows.groupBy("a", "b").agg(F.count("*").alias("w"))  # distinct pairs carry their count
    ra, rb = (average_ranks(rows, c).select(F.col("v").alias(c), F.col("rank").alias(f"r{c}")) for c in "ab")
    j = pairs.join(ra, "a").join(rb, "b")
    w = F.sum("w")
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / w
    prod = F.sum(F.col("ra") * F.col("rb") * F.col("w")) / w - mean("ra") * mean("rb")
    var = lambda c: F.sum(F.col(c) * F.col(c) * F.col("w")) / w - mean(c) * mean(c)
    ship(df.sparkSession)
    one = j.agg((prod / F.nullif(F.sqrt(var("ra") * var("rb")), F.lit(0.0))).alias("r"), w.alias("n"))
    return one.withColumn("p", t_tail("r", F.col("n").cast("double"))).withColumn("material", (F.abs("r") >= MATERIAL) & (F.col("p") <= ALPHA))


def holds(rho: Column, kind: str, floor: float = 0.1) -> Column:
    """An expected monotone or inverse relation holds (DR-10)."""
    return rho >= floor if kind == "monotone" else rho <= -floor


def chart_sample(df: DataFrame, order: list[str], rows: int = 400) -> DataFrame:
    """About `rows` evenly spaced rows in the order: a report's sample (DR-11)."""
    from plumbline.operators.drift import indexed

    n = df.count()
    return indexed(df, order).where(F.col("_index") % max(1, n // rows) == 0).drop("_index")


#: What a part of a column's name adds to the score of its pairs, and the parts of outcomes and of drivers.
PAIR_WEIGHTS = {
    "target": 6, "default": 6, "bad": 6, "pd": 6, "rating": 5, "score": 4, "risk": 4,
    "leverage": 6, "coverage": 6, "debt": 5, "utilization": 5, "delinquency": 5, "exposure": 4, "ltv": 4,
    "income": 2, "balance": 2, "revenue": 1,
}
OUTCOMES = ("target", "default", "bad", "pd", "rating", "score", "risk")
DRIVERS = ("leverage", "coverage", "debt", "income", "utilization", "delinquency", "balance", "exposure", "ltv", "revenue")


def candidate_pairs(columns: DataFrame, excluded: list[str] | None = None, top: int = 50) -> DataFrame:
    """Pairs of numeric columns of a catalogue (column, dtype) for tests of two variables, at most `top` (DR-12). Identifiers
    and the columns `excluded` (dates, the target) take no part. A pair scores the weights of the parts in its names, and
    5 more where it joins an outcome and a driver; shorter names go first among equals."""
    name = F.lower("column")
    usable = F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)") & ~name.endswith("id") & ~F.col("column").isin(excluded or [])
    weight = reduce(Column.__add__, [F.when(F.contains(name, F.lit(part)), w).otherwise(0) for part, w in PAIR_WEIGHTS.items()])
    c = columns.where(usable).select("column", weight.alias("w"))
    pairs = c.alias("a").join(c.alias("b"), F.col("a.column") < F.col("b.column"))  # a table's columns
    both = F.lower(F.concat_ws(" ", "a.column", "b.column"))
    bonus = F.when(both.rlike("|".join(OUTCOMES)) & both.rlike("|".join(DRIVERS)), 5).otherwise(0)
    return pairs.select(F.col("a.column").alias("a"), F.col("b.column").alias("b"), (F.col("a.w") + F.col("b.w") + bonus).alias("score")).orderBy(F.desc("score"), F.length("a") + F.length("b"), "a", "b").limit(top)


_RANKS = """WITH r AS (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM {t}) SELECT round(corr(ra, rb), 6) AS r, count(*) AS n FROM r"""


@query("direction_pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n, abs(corr(l_quantity, l_extendedprice)) >= 0.2 AS material FROM lineitem")
def direction_pearson(spark, sf_dir):
    return pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(rounded(F.col("r")).alias("r"), "n", "material")


@query("direction_spearman", _RANKS.format(a="p_size", b="p_retailprice", t="part"))
def direction_spearman(spark, sf_dir):
    return spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(rounded(F.col("r")).alias("r"), "n")


@query("direction_segments", "SELECT l_linestatus AS segment, round(corr(l_quantity, l_extendedprice), 6) AS r, corr(l_quantity, l_extendedprice) >= 0.1 AS holds FROM lineitem GROUP BY 1")
def direction_segments(spark, sf_dir):
    """The relation within each segment (DR-9, DR-10)."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("segment")).agg(F.corr("l_quantity", "l_extendedprice").alias("r"))
    return per.select("segment", rounded(F.col("r")).alias("r"), holds(F.col("r"), "monotone").alias("holds"))


@query("direction_chart_sample", "WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, o_totalprice FROM r, n WHERE i % greatest(1, n.n // 400) = 0")
def direction_chart_sample(spark, sf_dir):
    return chart_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


_NAMED = {"l_quantity": "leverage_coverage", "l_extendedprice": "debt_balance", "l_discount": "default_rate", "l_tax": "tax_income", "l_linenumber": "line", "l_partkey": "part_id"}


@query("direction_candidate_pairs", f"""WITH w(part, w) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in PAIR_WEIGHTS.items())}), d AS ({' UNION ALL '.join(f"SELECT '{n}' AS c, count(DISTINCT {k}) AS k FROM lineitem" for k, n in _NAMED.items() if n != 'part_id')} UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem),
 c AS (SELECT c, coalesce(sum(w), 0) AS w FROM d LEFT JOIN w ON contains(c, part) WHERE k > 1 GROUP BY c)
 SELECT x.c AS a, y.c AS b, (x.w + y.w + CASE WHEN regexp_matches(x.c || ' ' || y.c, '{'|'.join(OUTCOMES)}') AND regexp_matches(x.c || ' ' || y.c, '{'|'.join(DRIVERS)}') THEN 5 ELSE 0 END)::INT AS score FROM c x JOIN c y ON x.c < y.c ORDER BY score DESC, length(a) + length(b), a, b LIMIT 12""")
def direction_candidate_pairs(spark, sf_dir):
    """Line items under names of credit data."""
    from plumbline.operators.profile import live_catalogue

    return candidate_pairs(live_catalogue(table(spark, sf_dir, "lineitem").withColumnsRenamed(_NAMED), "lineitem").where("distinct > 1"), top=12)
