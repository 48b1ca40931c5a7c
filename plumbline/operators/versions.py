"""Differences of two versions of a data set in three tiers: schema, shape and distribution (ST-20, JN-7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import rounded
from plumbline.operators.profile import catalogue, counts, histogram, numeric, top_values
from plumbline.plans.registry import query
from plumbline.session import table

BINS = 10


def schema_tier(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(table, column, old_type, new_type, change): added, removed, retyped or same."""
    a, b = (reduce(DataFrame.unionByName, [catalogue(df, n) for n, df in side.items()]).select("table", "column", F.col("dtype").alias(t)) for side, t in ((old, "old_type"), (new, "new_type")))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "retyped").otherwise("same")
    return a.join(b, ["table", "column"], "full_outer").withColumn("change", change)


def shape_tier(old: dict[str, DataFrame], new: dict[str, DataFrame], period: dict[str, str]) -> DataFrame:
    """Per table: rows, columns, first and last day and number of months covered in either version, and their changes."""

    def own(side, name):
        parts = []
        for t, df in side.items():
            d = F.to_date(period[t]) if period.get(t) in df.columns else F.lit(None).cast("date")
            parts.append(df.agg(F.count("*").alias("rows"), F.min(d).cast("string").alias("first"), F.max(d).cast("string").alias("last"), F.count_distinct(F.trunc(d, "month")).alias("months")).select(F.lit(t).alias("table"), F.lit(len(df.columns)).alias("columns"), "*"))
        return reduce(DataFrame.unionByName, parts).select("table", *[F.col(c).alias(f"{name}_{c}") for c in ("rows", "columns", "first", "last", "months")])

    both = own(old, "old").join(own(new, "new"), "table", "full_outer")
    return both.withColumns({f"{c}_change": F.col(f"new_{c}") - F.col(f"old_{c}") for c in ("rows", "columns", "months")})


def fingerprints(tables: dict[str, DataFrame], top: int = 5) -> DataFrame:
    """(table, column) profiles: type, null share, distinct values, range, moments, most frequent values, histogram."""
    parts = []
    for t, df in tables.items():
        numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
        own = counts(df, df.columns).select("column", "total", (F.col("nulls") / F.nullif(F.col("total"), F.lit(0))).alias("null_share"), F.col("distinct_raw").alias("distinct"))
        if numbers:
            own = own.join(numeric(df, numbers).select("column", "low", "high", "mean", "std"), "column", "left")
            bars = [histogram(df, c, BINS).groupBy(F.lit(c).alias("column")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("bars")) for c in numbers]
            own = own.join(reduce(DataFrame.unionByName, bars), "column", "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("double") for c in ("low", "high", "mean", "std")}).withColumn("bars", F.lit(None).cast("array<bigint>"))
        most = top_values(df, df.columns, top).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("top"))
        parts.append(own.join(most, "column", "left").join(catalogue(df, t).select("column", "dtype"), "column").select(F.lit(t).alias("table"), "*"))
    return reduce(DataFrame.unionByName, parts)


def distribution_tier(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join of two fingerprints by (table, column): changes of null share, distinct values, mean and deviation (only
    where the types agree), the share of top values kept and the L1 shift of the histograms' shares; `available` is false
    for a column that one version lacks."""
    key, rest = ["table", "column"], [c for c in old.columns if c not in ("table", "column")]
    a, b = (side.select(*key, *[F.col(c).alias(f"{n}_{c}") for c in rest], F.lit(True).alias(f"in_{n}")) for side, n in ((old, "old"), (new, "new")))
    both = a.join(b, key, "full_outer")
    alike = F.col("old_dtype") == F.col("new_dtype")
    change = lambda c: F.col(f"new_{c}") - F.col(f"old_{c}")
    all_of = lambda n: F.aggregate(f"{n}_bars", F.lit(0).cast("long"), lambda x, y: x + y)
    shift = F.aggregate(F.zip_with("old_bars", "new_bars", lambda x, y: F.abs(x / all_of("old") - y / all_of("new"))), F.lit(0.0), lambda x, y: x + y)
    kept = F.size(F.array_intersect("old_top", "new_top")) / F.nullif(F.size("old_top"), F.lit(0))
    return both.select(
        *key, F.coalesce(F.col("in_old") & F.col("in_new"), F.lit(False)).alias("available"), F.coalesce(alike, F.lit(False)).alias("comparable"), change("null_share").alias("null_change"), change("distinct").alias("distinct_change"),
        F.when(alike, change("mean")).alias("mean_change"), F.when(alike, change("std")).alias("std_change"), kept.alias("top_kept"), shift.alias("histogram_shift"),
    )


def _versions(spark, sf_dir):
    """Orders before and from July 1997; the new version lacks the priority, has a flag, and prices as text."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    cut = F.col("o_orderdate") < F.lit("1997-07-01").cast("timestamp")
    return df.where(cut), df.where(~cut).drop("o_orderpriority").withColumns({"flag": F.col("o_custkey") % 2, "o_orderkey": F.col("o_orderkey").cast("string")})


@query("versions_schema", """WITH t AS (SELECT column_name AS c, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS t FROM duckdb_columns() WHERE table_name = 'orders' AND column_name <> 'o_orderstatus'),
 o AS (SELECT c, t FROM t), w AS (SELECT c, CASE c WHEN 'o_orderkey' THEN 'string' ELSE t END AS t FROM t WHERE c <> 'o_orderpriority' UNION ALL SELECT 'flag', 'bigint')
 SELECT 'orders' AS "table", coalesce(o.c, w.c) AS "column", o.t AS old_type, w.t AS new_type, CASE WHEN o.t IS NULL THEN 'added' WHEN w.t IS NULL THEN 'removed' WHEN o.t <> w.t THEN 'retyped' ELSE 'same' END AS change FROM o FULL JOIN w ON o.c = w.c""")
def versions_schema(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return schema_tier({"orders": old}, {"orders": new})


@query("versions_shape", """WITH s AS (SELECT o_orderdate < TIMESTAMP '1997-07-01' AS old, count(*) AS n, min(o_orderdate::DATE)::VARCHAR AS a, max(o_orderdate::DATE)::VARCHAR AS b, count(DISTINCT date_trunc('month', o_orderdate)) AS m FROM orders GROUP BY 1)
 SELECT 'orders' AS "table", o.n AS old_rows, 5 AS old_columns, o.a AS old_first, o.b AS old_last, o.m AS old_months, w.n AS new_rows, 5 AS new_columns, w.a AS new_first, w.b AS new_last, w.m AS new_months, w.n - o.n AS rows_change, 0 AS columns_change, w.m - o.m AS months_change FROM s o, s w WHERE o.old AND NOT w.old""")
def versions_shape(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return shape_tier({"orders": old}, {"orders": new}, {"orders": "o_orderdate"})


@query("versions_distribution", """WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-07-01'), n AS (SELECT *, o_custkey % 2 AS flag FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01'),
 e AS (SELECT (SELECT min(o_totalprice) FROM o) AS ol, (SELECT max(o_totalprice) FROM o) AS oh, (SELECT min(o_totalprice) FROM n) AS nl, (SELECT max(o_totalprice) FROM n) AS nh, (SELECT count(*) FROM o) AS oc, (SELECT count(*) FROM n) AS nc),
 ho AS (SELECT least(floor((o_totalprice - ol) / (oh - ol) * 10), 9)::INT AS b, count(*) / any_value(oc) AS p FROM o, e GROUP BY 1), hn AS (SELECT least(floor((o_totalprice - nl) / (nh - nl) * 10), 9)::INT AS b, count(*) / any_value(nc) AS p FROM n, e GROUP BY 1)
 SELECT 'orders' AS "table", 'o_totalprice' AS "column", true AS available, true AS comparable, 0.0 AS null_change, (SELECT count(DISTINCT o_totalprice) FROM n) - (SELECT count(DISTINCT o_totalprice) FROM o) AS distinct_change, round((SELECT avg(o_totalprice) FROM n) - (SELECT avg(o_totalprice) FROM o), 3) AS mean_change, (SELECT round(sum(abs(coalesce(ho.p, 0) - coalesce(hn.p, 0))), 6) FROM ho FULL JOIN hn ON ho.b = hn.b) AS histogram_shift
 UNION ALL SELECT 'orders', 'o_orderkey', true, false, 0.0, (SELECT count(DISTINCT o_orderkey) FROM n) - (SELECT count(DISTINCT o_orderkey) FROM o), NULL, NULL
 UNION ALL SELECT 'orders', 'o_orderpriority', false, false, NULL, NULL, NULL, NULL UNION ALL SELECT 'orders', 'flag', false, false, NULL, NULL, NULL, NULL""")
def versions_distribution(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    out = distribution_tier(fingerprints({"orders": old}), fingerprints({"orders": new})).where(F.col("column").isin("o_totalprice", "o_orderkey", "o_orderpriority", "flag"))
    return out.select("table", "column", "available", "comparable", "null_change", "distinct_change", rounded(F.col("mean_change"), 3).alias("mean_change"), rounded(F.col("histogram_shift")).alias("histogram_shift"))
