"""Column shapes and what they say about roles: screens, profiles, predicted roles (AG-12, AG-13, AG-16, MT-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import rounded
from plumbline.operators.profile import distinct_counts, is_special, top_values
from plumbline.plans.registry import query
from plumbline.session import table

LIKE = 0.95
#: Points of a name match (less 2 for each earlier pattern of the role) and of the value shapes.
NAME, NAME_STEP, POINTS = 60, 2, {"date": 25, "no_date": -20, "period": 30, "no_nulls": 10, "repeats": 15, "forward": -50, "constant": -15, "few": 20, "many": -25, "numeric": 20, "no_numeric": -25, "categories": 20}
FORWARD = r"(_|^)(\d+m|\d+q|fwd|forward|next|pred)(_|$)"
DATE_LIKE, PERIOD_LIKE = r"^\d{4}-\d{2}-\d{2}", r"^(\d{4}[-/]?(0[1-9]|1[0-2])|\d{4}[- ]?[QH][1-4])$"


def shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: kind, rows, share of nulls, distinct values, and whether at least 95 % of its values look like dates
    or period labels (AG-16). All rows count, in one pass beside the distinct values."""
    aggregates, kinds = [F.count("*").alias("rows")], []
    for c in columns:
        t, s = df.schema[c].dataType, F.trim(F.col(c).cast("string"))
        kinds.append("numeric" if isinstance(t, T.NumericType) else "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text")
        aggregates += [F.count(c).alias(f"n__{c}"), F.count_if(s.rlike(DATE_LIKE)).alias(f"d__{c}"), F.count_if(s.rlike(PERIOD_LIKE)).alias(f"p__{c}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"n__{c}").alias("n"), F.col(f"d__{c}").alias("d"), F.col(f"p__{c}").alias("p")) for c, k in zip(columns, kinds)])
    long = df.agg(*aggregates).select("rows", F.explode(rows).alias("r")).select("rows", "r.*").join(distinct_counts(df, columns), "column", "left")
    share = lambda x: F.coalesce(F.col(x) / F.nullif(F.col("n"), F.lit(0)) >= LIKE, F.lit(False))
    return long.select("column", "kind", "rows", (1 - F.col("n") / F.nullif(F.col("rows"), F.lit(0))).alias("null_share"), F.coalesce("distinct_raw", F.lit(0)).alias("distinct"), share("d").alias("date_like"), share("p").alias("period_like"))


def predicted_roles(roles: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates (role, column, score) of roles (role, kind, patterns, most canonical first) by name and shape; a role whose
    name fits no column has none, but for period-like columns (MT-9). Both sides are catalogues."""
    name = F.regexp_replace(F.lower("column"), r"[^a-z0-9]+", "_")
    both = roles.select("role", F.col("kind").alias("wants"), "patterns", F.lit(1).alias("_one")).join(found.withColumns({"_name": name, "_one": F.lit(1)}), "_one")
    first = F.array_position(F.transform("patterns", lambda p: F.regexp_like("_name", p)), True)
    named, date, wants = F.col("_first") > 0, (F.col("kind") == "date") | F.col("date_like"), F.col("wants")
    both = both.withColumn("_first", first)
    give = lambda c, k: F.when(c, POINTS[k]).otherwise(0)
    score = F.when(named, NAME - NAME_STEP * (F.col("_first") - 1)).otherwise(0)
    score += F.when(wants == "date", F.when(date, POINTS["date"]).otherwise(POINTS["no_date"])).otherwise(0)
    score += F.when(wants == "period", F.when(F.col("period_like"), POINTS["period"]).when(F.col("kind") == "date", 20).otherwise(0)).otherwise(0)
    score += F.when(wants == "id", give(F.col("null_share") == 0, "no_nulls") + give((F.col("distinct") > 1) & (F.col("distinct") < F.col("rows")), "repeats")).otherwise(0)
    status = give(F.col("_name").rlike(FORWARD), "forward") + F.when(F.col("distinct") <= 1, POINTS["constant"]).when(F.col("distinct") <= 12, POINTS["few"]).when(F.col("distinct") > 30, POINTS["many"]).otherwise(0)
    score += F.when(wants == "status", status).otherwise(0)
    score += F.when(wants == "amount", F.when(F.col("kind") == "numeric", POINTS["numeric"]).otherwise(POINTS["no_numeric"])).otherwise(0)
    score += F.when(wants == "categorical", give((F.col("distinct") > 1) & (F.col("distinct") <= 60), "categories")).otherwise(0)
    possible = (named | ((wants == "period") & F.col("period_like"))) & ~((wants == "date") & (F.col("kind") == "numeric")) & ~((wants == "status") & (F.col("kind") == "date"))
    return both.where(possible).select("role", "column", score.cast("int").alias("score")).where("score > 0")


def resolved_roles(candidates: DataFrame) -> DataFrame:
    """One column a role, its best; a column claimed by several roles stays with the one that scores it highest (MT-9)."""
    best = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("score"), "column"))
    claims = candidates.withColumn("rn", best).where("rn = 1").drop("rn")
    winner = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("score"), "role"))
    return claims.withColumn("rn", winner).where("rn = 1").select("role", "column", "score")


def screen(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Light screen of columns: kind, null share, distinct values, range, mean, deviation and the k most frequent values (AG-12)."""
    wide = []
    for c in columns:
        x = F.col(c).cast("string").try_cast("double")
        wide += [F.min(x).alias(f"low__{c}"), F.max(x).alias(f"high__{c}"), F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}")]
    names = ["low", "high", "mean", "std"]
    stats = df.agg(*wide).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{n}__{c}").alias(n) for n in names]) for c in columns])).alias("r")).select("r.*")
    top = top_values(df, columns, k).groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "value", "n"))), lambda t: F.concat(t["value"], F.lit(":"), t["n"].cast("string"))), "|").alias("top"))
    return shapes(df, columns).select("column", "kind", "null_share", "distinct").join(stats, "column").join(top, "column", "left")


def rca_profile(df: DataFrame, column: str, codes: list) -> DataFrame:
    """Physical and effective missing share, distinct regular values and their mean (AG-13)."""
    x, special = F.col(column), is_special(F.col(column), codes)
    regular = F.when(x.isNotNull() & ~special, x)
    return df.agg(F.avg(x.isNull().cast("int")).alias("physical_share"), F.avg((x.isNull() | special).cast("int")).alias("effective_share"), F.count_distinct(regular).alias("distinct"), F.avg(regular.cast("string").try_cast("double")).alias("mean"))


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _shapes_sql(t: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS kind, count(*) AS rows, 1 - count({c}) / count(*) AS null_share, count(DISTINCT {c}) AS "distinct",
 coalesce(count(*) FILTER (WHERE regexp_matches({c}::VARCHAR, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) / nullif(count({c}), 0) >= 0.95, false) AS date_like,
 coalesce(count(*) FILTER (WHERE regexp_matches({c}::VARCHAR, '^(\\d{{4}}[-/]?(0[1-9]|1[0-2])|\\d{{4}}[- ]?[QH][1-4])$')) / nullif(count({c}), 0) >= 0.95, false) AS period_like FROM {t}""" for c, k in columns.items())


_SHAPES = _shapes_sql("orders", {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "text", "o_totalprice": "numeric", "o_orderdate": "date", "o_orderpriority": "text"})


@query("roles_shapes", _SHAPES)
def roles_shapes(spark, sf_dir):
    return shapes(table(spark, sf_dir, "orders"), _ORDERS)


@query("roles_predicted", f"""WITH s AS ({_SHAPES}),
 c AS (SELECT 'customer' AS role, "column", 60 + CASE WHEN null_share = 0 THEN 10 ELSE 0 END + CASE WHEN "distinct" > 1 AND "distinct" < rows THEN 15 ELSE 0 END AS score FROM s WHERE "column" = 'o_custkey'
  UNION ALL SELECT 'closed', "column", 60 + CASE WHEN "distinct" <= 1 THEN -15 WHEN "distinct" <= 12 THEN 20 WHEN "distinct" > 30 THEN -25 ELSE 0 END FROM s WHERE "column" = 'o_orderstatus'
  UNION ALL SELECT 'observed', "column", 58 + 25 FROM s WHERE "column" = 'o_orderdate'
  UNION ALL SELECT 'amount', "column", 60 + 20 FROM s WHERE "column" = 'o_totalprice'
  UNION ALL SELECT 'marker', "column", 60 + CASE WHEN "distinct" <= 1 THEN -15 WHEN "distinct" <= 12 THEN 20 WHEN "distinct" > 30 THEN -25 ELSE 0 END - 2 FROM s WHERE "column" = 'o_orderstatus')
 SELECT role, "column", score FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY score DESC, role) AS rn FROM c) WHERE rn = 1""")
def roles_predicted(spark, sf_dir):
    """Five roles, two of which claim the order's status; a sixth finds no column."""
    roles = [("customer", "id", ["cust(omer)?_?(id|key)"]), ("closed", "status", ["status"]), ("observed", "date", ["obs(ervation)?_?date", "date"]), ("amount", "amount", ["price|amount"]), ("marker", "status", ["flag", "status"]), ("loss", "amount", ["loss"])]
    return resolved_roles(predicted_roles(spark.createDataFrame(roles, "role string, kind string, patterns array<string>"), shapes(table(spark, sf_dir, "orders"), _ORDERS)))


@query("roles_screen", """WITH t AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 5), p AS (SELECT o_totalprice::VARCHAR AS v FROM orders)
 SELECT 'o_orderstatus' AS "column", 'text' AS kind, 1 - count(o_orderstatus) / count(*) AS null_share, count(DISTINCT o_orderstatus) AS "distinct", NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, (SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM t) AS top FROM orders
 UNION ALL SELECT 'o_custkey', 'numeric', 1 - count(o_custkey) / count(*), count(DISTINCT o_custkey), min(o_custkey), max(o_custkey), round(avg(o_custkey), 4), round(stddev_samp(o_custkey), 4), (SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM (SELECT o_custkey::VARCHAR AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) FROM orders""")
def roles_screen(spark, sf_dir):
    out = screen(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"])
    return out.withColumns({"mean": rounded(F.col("mean"), 4), "std": rounded(F.col("std"), 4)})


@query("roles_rca_profile", "SELECT avg((lang IS NULL)::INT) AS physical_share, avg((lang IS NULL OR lang = 'es')::INT) AS effective_share, count(DISTINCT lang) FILTER (WHERE lang <> 'es') AS \"distinct\", NULL::DOUBLE AS mean FROM documents")
def roles_rca_profile(spark, sf_dir):
    return rca_profile(table(spark, sf_dir, "documents"), "lang", ["es"])
