"""Populations: predicates, baseline/current splits, guidance, and snapshots compared (PF-1..8, 12..15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.quantiles import percentiles
from plumbline.functions.values import rounded
from plumbline.operators.profile import distinct_counts, is_special, live_catalogue
from plumbline.plans.registry import query
from plumbline.session import table

SMALL_ROWS, SMALL_SHARE = 30, 0.1


def ordered(df: DataFrame, column: str, value) -> tuple[Column, Column]:
    """Both sides in the type in which they compare: dates, numbers, else text (PF-2)."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp"), F.lit(str(value)).cast("timestamp")
    if isinstance(kind, T.NumericType):
        return c.cast("double"), F.lit(float(value))
    return c.cast("string"), F.lit(str(value))


def predicate(df: DataFrame, column: str, spec: dict) -> Column:
    """in (as text), a comparison, or a range with inclusive flags (PF-1..3)."""
    op = spec["operator"]
    if op == "in":
        return F.col(column).cast("string").isin([str(v) for v in spec["values"]])
    if op == "range":
        a, lo = ordered(df, column, spec["low"])
        _, hi = ordered(df, column, spec["high"])
        if spec["low"] > spec["high"]:
            raise ValueError("range bounds are not in order")
        return (a >= lo if spec.get("include_low", True) else a > lo) & (a <= hi if spec.get("include_high", True) else a < hi)
    a, b = ordered(df, column, spec["value"])
    return {"<": a < b, "<=": a <= b, "=": a == b, ">=": a >= b, ">": a > b}[op]


def split(df: DataFrame, column: str, spec: dict, nulls: str = "exclude", specials: list | None = None, special_policy: str = "exclude") -> DataFrame:
    """`df` with population: baseline where the predicate holds, current elsewhere; nulls and special values go where
    their policy says (exclude, baseline or current), null for excluded rows (PF-4)."""
    policy = {"exclude": F.lit(None).cast("string"), "baseline": F.lit("baseline"), "current": F.lit("current")}
    hit = predicate(df, column, spec)
    side = F.when(F.col(column).isNull(), policy[nulls]).when(is_special(F.col(column), specials or []), policy[special_policy]).when(hit, "baseline").otherwise("current")
    return df.withColumn("population", side)


def pooled(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Two populations as one, with a column that names the side; a column of one side only is null on the other (SO-1)."""
    return baseline.withColumn("population", F.lit("baseline")).unionByName(current.withColumn("population", F.lit("current")), allowMissingColumns=True)


def preview(populated: DataFrame) -> DataFrame:
    """Rows and share of each side, with a warning below 30 rows or a tenth (PF-5)."""
    per = populated.where("population is not null").groupBy("population").agg(F.count("*").alias("rows"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy())  # two rows
    return per.withColumn("share", share).withColumn("warning", F.when(F.col("rows") < SMALL_ROWS, "few rows").when(F.col("share") < SMALL_SHARE, "small share"))


def guidance(df: DataFrame, column: str, options: int = 5) -> DataFrame:
    """Suggested splits: quartiles of a number, the median day of a date, the most frequent values of others (PF-6)."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        q = percentiles(df, {column: F.col(column)}, [0.25, 0.5, 0.75])
        return q.select(F.lit("numeric_cutoff").alias("strategy"), F.posexplode("q").alias("position", "at")).select("strategy", "position", F.col("at").cast("string").alias("suggestion"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        days = percentiles(df, {column: F.unix_date(F.to_date(column))}, [0.5]).select(F.col("q")[0].alias("d"))
        return days.select(F.lit("temporal_cutoff").alias("strategy"), F.lit(0).alias("position"), F.date_from_unix_date(F.floor("d").cast("int")).cast("string").alias("suggestion"))
    top = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("suggestion")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suggestion").limit(options)
    return top.select(F.lit("category_groups").alias("strategy"), (F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "suggestion")) - 1).alias("position"), "suggestion")  # at most `options` rows


def kind_of(dtype: Column) -> Column:
    return F.when(dtype.rlike("^(tinyint|smallint|int|bigint|float|double|decimal|boolean)"), "numeric").when(dtype.rlike("^(date|timestamp)"), "date").otherwise("categorical")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two catalogues by exact name: compatible, incompatible, baseline_only, current_only (PF-7)."""
    a = left.select("column", kind_of(F.col("dtype")).alias("baseline_kind"))
    b = right.select("column", kind_of(F.col("dtype")).alias("current_kind"))
    status = F.when(F.col("current_kind").isNull(), "baseline_only").when(F.col("baseline_kind").isNull(), "current_only").when(F.col("baseline_kind") == F.col("current_kind"), "compatible").otherwise("incompatible")
    return a.join(b, "column", "full_outer").withColumn("status", status)


def best_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each table of one catalogue the table of the other with most compatible columns, then the same name, then
    fewest incompatible ones (PF-8)."""
    a = left.select(F.col("table").alias("baseline"), "column", kind_of(F.col("dtype")).alias("x"))
    b = right.select(F.col("table").alias("current"), "column", kind_of(F.col("dtype")).alias("y"))
    per = a.join(b, "column").groupBy("baseline", "current").agg(F.count_if(F.col("x") == F.col("y")).alias("compatible"), F.count_if(F.col("x") != F.col("y")).alias("incompatible"))
    order = Window.partitionBy("baseline").orderBy(F.desc("compatible"), F.desc(F.col("baseline") == F.col("current")), "incompatible", "current")
    return per.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def months_window(df: DataFrame, segment: str, value, date: str, first: str, last: str) -> DataFrame:
    """Rows of one segment in a window of ISO months (PF-12)."""
    return df.where((F.col(segment) == value) & F.date_format(date, "yyyy-MM").between(first, last))


def eligible(columns: DataFrame, allowed: list[str]) -> DataFrame:
    """Columns (column, logical_type) with whether an analysis may use them, and why not (PF-13)."""
    good = F.col("logical_type").isin(allowed)
    return columns.select("column", good.alias("kept"), F.when(~good, F.concat(F.lit("type "), F.col("logical_type"))).alias("reason"))


def selection(df: DataFrame, columns: list[str], outcome: str | None = None) -> DataFrame:
    """Columns left out by rule: constant, discrete grade, name of an outcome's sibling (PF-14, PF-15)."""
    kinds = df.sparkSession.createDataFrame([(c, isinstance(df.schema[c].dataType, T.NumericType)) for c in columns], "column string, is_number boolean")
    found = distinct_counts(df, columns).select("column", F.col("distinct_raw").alias("levels"))  # one shuffle for all columns
    long = kinds.join(found, "column", "left").na.fill(0, ["levels"]).select("column", "levels", "is_number")
    sibling = F.lower("column").contains((outcome or "\0").lower()) & (F.col("column") != F.lit(outcome or ""))
    reason = F.when(F.col("levels") <= 1, "constant").when(sibling, "outcome sibling").when(F.col("is_number") & (F.col("levels") <= 10), "discrete grade")
    return long.select("column", "levels", reason.alias("reason"), reason.isNull().alias("recommended"))


@query("population_split", "SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'baseline' ELSE 'current' END AS population, count(*) AS rows FROM orders GROUP BY 1")
def population_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("when_", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")))
    return split(df, "when_", {"operator": "<", "value": "1997-01-01 00:00:00"}).groupBy("population").agg(F.count("*").alias("rows"))


@query("population_policies", "SELECT CASE WHEN l_quantity = 50 THEN 'current' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'baseline' ELSE 'current' END AS population, count(*) AS rows, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def population_policies(spark, sf_dir):
    spec = {"operator": "range", "low": 10, "high": 30, "include_low": False}
    return split(table(spark, sf_dir, "lineitem"), "l_quantity", spec, "exclude", [50], "current").groupBy("population").agg(F.count("*").alias("rows"), rounded(F.avg("l_extendedprice"), 4).alias("mean"))


@query("population_preview", """SELECT population, rows, round(rows / sum(rows) OVER (), 6) AS share, CASE WHEN rows < 30 THEN 'few rows' WHEN rows / sum(rows) OVER () < 0.1 THEN 'small share' END AS warning FROM
 (SELECT CASE WHEN event_type IN ('error') THEN 'baseline' ELSE 'current' END AS population, count(*) AS rows FROM events WHERE event_type IS NOT NULL GROUP BY 1)""")
def population_preview(spark, sf_dir):
    return preview(split(table(spark, sf_dir, "events"), "event_type", {"operator": "in", "values": ["error"]})).withColumn("share", rounded(F.col("share")))


@query("population_guidance", """SELECT 'numeric_cutoff' AS strategy, i::INT AS "position", round(q[i + 1], 2) AS suggestion FROM (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders), (SELECT unnest([0, 1, 2]) AS i)""")
def population_guidance(spark, sf_dir):
    return guidance(table(spark, sf_dir, "orders"), "o_totalprice").withColumn("suggestion", rounded(F.col("suggestion").cast("double"), 2))


@query("population_guidance_groups", """SELECT 'category_groups' AS strategy, (row_number() OVER (ORDER BY n DESC, v) - 1)::INT AS "position", v AS suggestion FROM (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, v LIMIT 5)""")
def population_guidance_groups(spark, sf_dir):
    return guidance(table(spark, sf_dir, "events"), "event_type")


@query("population_guidance_date", "SELECT 'temporal_cutoff' AS strategy, 0 AS position, (DATE '1970-01-01' + floor(quantile_cont(o_orderdate::DATE - DATE '1970-01-01', 0.5))::INT)::VARCHAR AS suggestion FROM orders")
def population_guidance_date(spark, sf_dir):
    return guidance(table(spark, sf_dir, "orders"), "o_orderdate")


@query("population_compare", """WITH c AS (SELECT table_name, column_name AS "column", CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN data_type LIKE 'TIMESTAMP%' THEN 'date' ELSE 'categorical' END AS k FROM information_schema.columns)
 SELECT coalesce(a."column", b."column") AS "column", a.k AS baseline_kind, b.k AS current_kind, CASE WHEN b.k IS NULL THEN 'baseline_only' WHEN a.k IS NULL THEN 'current_only' WHEN a.k = b.k THEN 'compatible' ELSE 'incompatible' END AS status
 FROM (SELECT * FROM c WHERE table_name = 'documents') a FULL JOIN (SELECT * FROM c WHERE table_name = 'labels') b ON a."column" = b."column" """)
def population_compare(spark, sf_dir):
    return compare(live_catalogue(table(spark, sf_dir, "documents"), "documents"), live_catalogue(table(spark, sf_dir, "labels"), "labels"))


@query("population_months_window", "SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m') BETWEEN '1996-03' AND '1997-02'")
def population_months_window(spark, sf_dir):
    return months_window(table(spark, sf_dir, "orders"), "o_orderstatus", "F", "o_orderdate", "1996-03", "1997-02").agg(F.count("*").alias("rows"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("population_selection", """SELECT c AS "column", n AS levels, CASE WHEN n <= 1 THEN 'constant' WHEN c LIKE '%l_tax%' AND c <> 'l_tax' THEN 'outcome sibling' WHEN c IN ('l_linenumber', 'l_quantity', 'l_tax') AND n <= 10 THEN 'discrete grade' END AS reason,
 NOT (n <= 1 OR (c <> 'l_returnflag' AND n <= 10)) AS recommended FROM (SELECT 'l_linenumber' AS c, count(DISTINCT l_linenumber) AS n FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem)""")
def population_selection(spark, sf_dir):
    return selection(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_quantity", "l_tax", "l_returnflag"], "l_tax")


@query("population_best_match", """SELECT 'documents' AS baseline, 'documents' AS "current", (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'documents') AS compatible, 0 AS incompatible UNION ALL SELECT 'labels', 'labels', (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'labels'), 0""")
def population_best_match(spark, sf_dir):
    both = live_catalogue(table(spark, sf_dir, "documents"), "documents").unionByName(live_catalogue(table(spark, sf_dir, "labels"), "labels"))
    return best_match(both, both)


@query("population_eligible", """WITH k AS (SELECT count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS states, count(TRY_CAST(l_returnflag AS DOUBLE)) AS numbers, count(DISTINCT l_tax) AS taxes FROM lineitem),
 t AS (SELECT 'l_tax' AS "column", CASE WHEN taxes > 2 THEN 'numerical' ELSE 'binary' END AS kind FROM k UNION ALL SELECT 'l_returnflag', CASE WHEN numbers = 0 AND flags <= 30 THEN 'categorical' ELSE 'text' END FROM k UNION ALL SELECT 'l_linestatus', CASE WHEN states <= 30 THEN 'categorical' ELSE 'text' END FROM k)
 SELECT "column", kind IN ('numerical', 'binary') AS kept, CASE WHEN kind NOT IN ('numerical', 'binary') THEN 'type ' || kind END AS reason FROM t""")
def population_eligible(spark, sf_dir):
    from plumbline.operators.profile import classify

    return eligible(classify(table(spark, sf_dir, "lineitem"), ["l_tax", "l_returnflag", "l_linestatus"]), ["numerical", "binary"])


@query("population_pooled", """SELECT population, count(*) AS rows, count(o_totalprice) AS priced, round(avg(o_totalprice), 2) AS mean FROM (SELECT 'baseline' AS population, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT 'current', NULL FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') GROUP BY 1""")
def population_pooled(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    both = pooled(o.where("o_orderdate < timestamp'1998-01-01'"), o.where("o_orderdate >= timestamp'1998-01-01'").drop("o_totalprice"))
    return both.groupBy("population").agg(F.count("*").alias("rows"), F.count("o_totalprice").alias("priced"), rounded(F.avg("o_totalprice"), 2).alias("mean"))
