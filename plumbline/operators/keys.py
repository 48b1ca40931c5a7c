"""Keys, grain, cadence and relationships between tables (CM-26..34, 36..38, JN-4)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import rounded
from plumbline.plans.registry import query
from plumbline.session import shuffle_partitions, table

#: Rows a key, as estimated, below which equal keys are not counted before the shuffle; keys in a part then.
FEW_EQUAL, KEYS_A_PART = 8, 1_000_000


def interval_class(days: Column) -> Column:
    """day, week, month, quarter, year with its step, or irregular, of a gap in days."""
    return (
        F.when(days == 1, "day").when(days == 7, "week").when(days.between(28, 31), "month").when(days.between(89, 92), "quarter").when(days.between(365, 366), "year")
        .when((days < 28) & (days % 7 == 0), F.concat((days / 7).cast("int").cast("string"), F.lit("-week"))).when(days < 28, F.concat(days.cast("string"), F.lit("-day"))).otherwise("irregular")
    )


def cadence(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Class of the gaps between an entity's distinct dates: regular if one class has 95 % of them, mixed, irregular, or
    unknown where fewer than 90 % of the entities have three dates (CM-26)."""
    points = df.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).select(F.col(entity).alias("e"), F.to_date(date).alias("d")).distinct()
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("e").orderBy("d")))
    classes = points.select(gap.alias("gap")).where("gap is not null").groupBy(interval_class(F.col("gap")).alias("class")).agg(F.count("*").alias("n"))
    top = classes.agg(F.max_by("class", F.struct("n", "class")).alias("class"), F.max("n").alias("n"), F.sum("n").alias("gaps"))
    entities = points.groupBy("e").agg(F.count("*").alias("k")).agg(F.count("*").alias("entities"), F.avg((F.col("k") >= 3).cast("int")).alias("enough"))
    share = F.col("n") / F.col("gaps")
    state = F.when(F.col("enough") < 0.9, "unknown").when((share >= 0.95) & (F.col("class") != "irregular"), "regular").when(F.col("class") == "irregular", "irregular").otherwise("mixed")
    return entities.crossJoin(top).select("entities", "gaps", "class", share.alias("share"), state.alias("state"))  # two single rows


def cadences(df: DataFrame, entities: list[str], dates: list[str]) -> DataFrame:
    """Every grouping with every time axis (CM-27)."""
    return reduce(DataFrame.unionByName, [cadence(df, e, d).withColumns({"entity": F.lit(e), "axis": F.lit(d)}) for e, d in product(entities, dates)])


def grain(df: DataFrame, candidates: list[list[str]], codes: dict[str, list] | None = None, roles: dict[str, str] | None = None) -> DataFrame:
    """For every candidate key: usable rows (all parts there, none a declared code), distinct keys, excess rows, rows in duplicates,
    uniqueness, coverage, whether it is exact (no row without it, none twice), nearly unique (0.95) or insufficient, and, where it
    is nearly unique, its duplicate groups: of equal rows, or of rows that contradict each other (CM-28, 29, 34, 38). One shuffle of
    (candidate, digests of the key) with the least and greatest digest of the rows serves all candidates; equal keys are
    counted before it, but where an estimate finds few: those rows are dealt to parts of KEYS_A_PART keys uncounted, so that neither side
    of the shuffle fills its hash tables. `position` ranks them by quality, uniqueness, coverage, width, roles (an identifier, a period) and names."""
    codes, roles = codes or {}, roles or {}
    used = sorted({x for c in candidates for x in c})
    bad = {x: F.col(x).isNull() | (F.trim(F.col(x).cast("string")).isin([str(v).strip() for v in codes[x]]) if codes.get(x) else F.lit(False)) for x in used}
    # numbers as digests: two for a key, one for a row (with its nulls, which a hash passes over), so counts stay in hash tables
    key = lambda c, ok: [F.when(ok, F.xxhash64(*c)).alias("k"), F.when(ok, F.xxhash64(F.lit(1), *c)).alias("l")]
    each = [F.struct(F.lit(i).alias("i"), *key(c, ~reduce(lambda a, b: a | b, [bad[x] for x in c]))) for i, c in enumerate(candidates)]
    rows = df.select(F.xxhash64(*df.columns, F.array(*[F.col(c).isNull() for c in df.columns])).alias("row"), F.array(*each).alias("each")).select("row", F.inline("each"))
    ok = [~reduce(lambda a, b: a | b, [bad[x] for x in c]) for c in candidates]
    size = df.agg(F.count("*").alias("rows"), *[F.count_if(o).alias(f"u{i}") for i, o in enumerate(ok)], *[F.approx_count_distinct(key(c, o)[0]).alias(f"d{i}") for i, (c, o) in enumerate(zip(candidates, ok))]).first()
    many = [i for i in range(len(candidates)) if size[f"d{i}"] * FEW_EQUAL > size[f"u{i}"]]
    rows, parts = rows.where("k is not null"), max(shuffle_partitions(df.sparkSession), math.ceil(sum(size[f"u{i}"] for i in many) / KEYS_A_PART))
    sides = [rows.where(F.col("i").isin(many)).repartition(parts, "i", "k", "l")] if many else []
    sides += [rows.where(~F.col("i").isin(many))] if len(many) < len(candidates) else []
    groups = reduce(DataFrame.unionByName, [r.groupBy("i", "k", "l").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b")) for r in sides])
    n, twice, same = F.col("n"), F.col("n") > 1, F.col("a") == F.col("b")
    per = groups.groupBy("i").agg(
        F.count("*").alias("distinct"), F.coalesce(F.sum(F.when(twice, n)), F.lit(0)).alias("rows_in_duplicates"),
        F.count_if(twice).alias("groups"), F.count_if(twice & same).alias("equal"), F.count_if(twice & ~same).alias("differing"),
    )
    own = lambda c: {roles.get(x, "") for x in c}
    named = df.sparkSession.createDataFrame([(i, "+".join(c), len(c), int("identifier" not in own(c)), 0 if "period" in own(c) else 1 if "date" in own(c) else 2, size["rows"], size[f"u{i}"]) for i, c in enumerate(candidates)], "i int, key string, width int, no_identifier int, no_period int, rows bigint, usable bigint")
    uniqueness, coverage = F.coalesce(F.col("distinct") / F.nullif(F.col("usable"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("usable") / F.nullif(F.col("rows"), F.lit(0)), F.lit(0.0))
    exact, near = (F.col("rows") > 0) & (F.col("usable") == F.col("rows")) & (F.col("distinct") == F.col("rows")), F.col("uniqueness") >= 0.95
    out = named.join(per, "i", "left").na.fill(0).withColumns({"uniqueness": uniqueness, "coverage": coverage}).withColumn("verdict", F.when(exact, "exact").when(near, "near_unique").otherwise("insufficient"))
    grouped = lambda c: F.when(near, F.col(c)).otherwise(0)
    order = Window.partitionBy().orderBy(F.array_position(F.array(*map(F.lit, ("exact", "near_unique", "insufficient"))), F.col("verdict")), F.desc(F.round("uniqueness", 6)), F.desc(F.round("coverage", 6)), "width", "no_identifier", "no_period", "key")  # one row a candidate
    return out.select(
        "key", "width", "distinct", (F.col("usable") - F.col("distinct")).alias("excess"), (F.col("rows") - F.col("usable")).alias("null_keys"), "uniqueness", "coverage", "verdict", (F.col("verdict") == "exact").alias("is_unique"),
        "rows_in_duplicates", grouped("groups").alias("duplicate_groups"), grouped("equal").alias("exact_groups"), grouped("differing").alias("conflicting_groups"),
        ((F.col("verdict") == "near_unique") & (F.col("groups") > 0) & (F.col("differing") == 0)).alias("deduplicate"), F.row_number().over(order).alias("position"),
    )


def key_health(df: DataFrame, key: str) -> DataFrame:
    """Null rate, rate of rows in duplicated keys, distinct keys (CM-30, 32)."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    rows = F.sum("n")
    return per.agg(rows.alias("rows"), F.count(key).alias("distinct"), (F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)) / rows).alias("null_rate"), (F.coalesce(F.sum(F.when(F.col(key).isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)) / rows).alias("duplicate_rate"))


def duplicate_keys(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The most frequent of the duplicated key values, with how many there are (CM-31, 38)."""
    many = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    totals = many.agg(F.count("*").alias("values"), F.sum("n").alias("rows"))
    return many.orderBy(F.desc("n"), "key").limit(top).crossJoin(totals)  # one row beside ten


def containment(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Shared distinct values of two columns over the smaller number of them, with the kind of relationship and its band
    (JN-4, CM-33)."""
    x = left.where(F.col(a).isNotNull()).groupBy(F.col(a).alias("v")).agg(F.count("*").alias("x"))
    y = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("v")).agg(F.count("*").alias("y"))
    one = x.join(y, "v", "full_outer").agg(F.count("x").alias("left_distinct"), F.count("y").alias("right_distinct"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("matched"), F.max("x").alias("mx"), F.max("y").alias("my"), F.sum("x").alias("left_rows"), F.sum("y").alias("right_rows"))
    share = F.col("matched") / F.nullif(F.least("left_distinct", "right_distinct"), F.lit(0))
    kind = F.concat(F.when(F.col("mx") > 1, "n").otherwise("1"), F.lit(":"), F.when(F.col("my") > 1, "n").otherwise("1"))
    band = F.when(share >= 0.9, "high").when(share >= 0.5, "medium").otherwise("low")
    return one.select("left_distinct", "right_distinct", "matched", share.alias("containment"), kind.alias("kind"), band.alias("band"), (F.least("left_rows", "right_rows") < 30).alias("few_rows"))


def relationships(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """Evidence for each declared (table, column, table, column), the best of each table pair marked (CM-33, SL-4)."""
    found = [containment(tables[t], tables[u], a, b).withColumns({"left_key": F.lit(f"{t}.{a}"), "right_key": F.lit(f"{u}.{b}"), "pair": F.lit(f"{t}-{u}")}) for t, a, u, b in pairs]
    out = reduce(DataFrame.unionByName, found)
    best = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("containment"), F.desc("matched"), "left_key", "right_key")) == 1
    return out.withColumn("best", best).drop("pair")


def candidates_by_name(metrics: DataFrame) -> DataFrame:
    """Pairs of key-like columns of the same name on two tables, from discovery rows (table, column, distinct) (CM-37)."""
    m = metrics.where(F.lower("column").rlike("(id|key)$")).withColumn("name", F.lower("column"))
    a, b = m.select("name", F.col("table").alias("a"), F.col("distinct").alias("x")), m.select("name", F.col("table").alias("b"), F.col("distinct").alias("y"))
    ratio = F.least("x", "y") / F.greatest("x", "y")
    return a.join(b, "name").where("a < b").select("name", "a", "b", ratio.alias("ratio"), F.when(ratio >= 0.8, "high").when(ratio >= 0.4, "medium").otherwise("low").alias("band"))


def freshness(df: DataFrame, date: str, bound: str) -> DataFrame:
    """Latest date and whether it is within the bound (CM-36)."""
    return df.agg(F.max(date).cast("string").alias("latest"), (F.max(date) <= F.lit(bound).cast("timestamp")).alias("passed"))


@query("keys_cadence", """WITH p AS (SELECT DISTINCT user_id AS e, ts::DATE AS d FROM events), g AS (SELECT (d - lag(d) OVER (PARTITION BY e ORDER BY d))::INT AS gap FROM p),
 c AS (SELECT CASE WHEN gap = 1 THEN 'day' WHEN gap = 7 THEN 'week' WHEN gap BETWEEN 28 AND 31 THEN 'month' WHEN gap BETWEEN 89 AND 92 THEN 'quarter' WHEN gap BETWEEN 365 AND 366 THEN 'year' WHEN gap < 28 AND gap % 7 = 0 THEN (gap // 7) || '-week' WHEN gap < 28 THEN gap || '-day' ELSE 'irregular' END AS class, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1),
 t AS (SELECT arg_max(class, (n, class)) AS class, max(n) AS n, sum(n) AS gaps FROM c), k AS (SELECT count(*) AS entities, avg((k >= 3)::INT) AS enough FROM (SELECT e, count(*) AS k FROM p GROUP BY 1))
 SELECT entities, gaps::BIGINT AS gaps, class, round(n / gaps, 6) AS share, CASE WHEN enough < 0.9 THEN 'unknown' WHEN n / gaps >= 0.95 AND class <> 'irregular' THEN 'regular' WHEN class = 'irregular' THEN 'irregular' ELSE 'mixed' END AS state, 'user_id' AS entity, 'ts' AS axis FROM k, t""")
def keys_cadence(spark, sf_dir):
    return cadences(table(spark, sf_dir, "events"), ["user_id"], ["ts"]).withColumn("share", rounded(F.col("share")))


_KEYS = [["l_orderkey"], ["l_partkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_shipdate"]]


def _twice(spark, sf_dir) -> DataFrame:
    """Line items, a few of them twice, a few twice with another tax."""
    df = table(spark, sf_dir, "lineitem")
    again = df.where("l_orderkey % 97 = 0")
    return df.unionByName(again.where("l_linenumber = 1")).unionByName(again.where("l_linenumber = 2").withColumn("l_tax", F.col("l_tax") + 1)).withColumn("half", F.when(F.col("l_partkey") % 2 == 0, F.col("l_orderkey")))


_KEYS = [["l_orderkey"], ["l_partkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_shipdate"], ["half", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_tax"]]


@query("keys_grain", """WITH t AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN l_orderkey END AS half FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 97 = 0 AND l_linenumber = 1 UNION ALL SELECT * REPLACE (l_tax + 1 AS l_tax) FROM lineitem WHERE l_orderkey % 97 = 0 AND l_linenumber = 2)),
 g AS (""" + " UNION ALL ".join(f"""SELECT '{'+'.join(c)}' AS key, {len(c)} AS width, sum(n) AS rows, coalesce(sum(n) FILTER (WHERE u), 0) AS k, count(*) FILTER (WHERE u) AS d, coalesce(sum(n) FILTER (WHERE u AND n > 1), 0) AS rd, count(*) FILTER (WHERE u AND n > 1) AS dg, count(*) FILTER (WHERE u AND n > 1 AND v = 1) AS eg FROM (SELECT {' AND '.join(x + ' IS NOT NULL' for x in c)} AS u, count(*) AS n, count(DISTINCT t) AS v FROM t GROUP BY {', '.join(c)})""" for c in _KEYS) + """),
 r AS (SELECT *, d / k AS q, CASE WHEN k = rows AND d = rows THEN 'exact' WHEN d / k >= 0.95 THEN 'near_unique' ELSE 'insufficient' END AS verdict FROM g)
 SELECT key, width, d AS "distinct", (k - d)::BIGINT AS excess, (rows - k)::BIGINT AS null_keys, round(q, 6) AS uniqueness, round(k / rows, 6) AS coverage, verdict, verdict = 'exact' AS is_unique, rd::BIGINT AS rows_in_duplicates, CASE WHEN q >= 0.95 THEN dg ELSE 0 END AS duplicate_groups,
 CASE WHEN q >= 0.95 THEN eg ELSE 0 END AS exact_groups, CASE WHEN q >= 0.95 THEN dg - eg ELSE 0 END AS conflicting_groups, verdict = 'near_unique' AND dg > 0 AND dg = eg AS deduplicate, row_number() OVER (ORDER BY CASE verdict WHEN 'exact' THEN 1 WHEN 'near_unique' THEN 2 ELSE 3 END, round(q, 6) DESC, round(k / rows, 6) DESC, width, key)::INT AS position FROM r""")
def keys_grain(spark, sf_dir):
    return grain(_twice(spark, sf_dir), _KEYS).withColumns({"uniqueness": rounded(F.col("uniqueness")), "coverage": rounded(F.col("coverage"))})


@query("keys_health", "WITH p AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT sum(n)::BIGINT AS rows, count(k) AS \"distinct\", coalesce(sum(n) FILTER (WHERE k IS NULL), 0) / sum(n) AS null_rate, round(coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n), 6) AS duplicate_rate FROM p")
def keys_health(spark, sf_dir):
    return key_health(table(spark, sf_dir, "orders"), "o_custkey").withColumn("duplicate_rate", rounded(F.col("duplicate_rate")))


@query("keys_duplicates", "WITH m AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1) SELECT key, n, (SELECT count(*) FROM m) AS \"values\", (SELECT sum(n) FROM m)::BIGINT AS rows FROM m ORDER BY n DESC, key LIMIT 10")
def keys_duplicates(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "orders"), "o_custkey")


_PAIRS = [("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_orderkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]


@query("keys_relationships", "WITH r AS (" + " UNION ALL ".join(f"""SELECT count(x) AS left_distinct, count(y) AS right_distinct, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS matched, max(x) AS mx, max(y) AS my, least(sum(x), sum(y)) < 30 AS few_rows, '{t}.{a}' AS left_key, '{u}.{b}' AS right_key, '{t}-{u}' AS pair
 FROM (SELECT {a} AS v, count(*) AS x FROM {t} WHERE {a} IS NOT NULL GROUP BY 1) FULL JOIN (SELECT {b} AS v, count(*) AS y FROM {u} WHERE {b} IS NOT NULL GROUP BY 1) USING (v)""" for t, a, u, b in _PAIRS) + """),
 s AS (SELECT *, matched / least(left_distinct, right_distinct) AS c FROM r) SELECT left_distinct, right_distinct, matched, round(c, 6) AS containment, CASE WHEN mx > 1 THEN 'n' ELSE '1' END || ':' || CASE WHEN my > 1 THEN 'n' ELSE '1' END AS kind,
 CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS band, few_rows, left_key, right_key, row_number() OVER (PARTITION BY pair ORDER BY c DESC, matched DESC, left_key, right_key) = 1 AS best FROM s""")
def keys_relationships(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "part", "nation")}
    return relationships(tables, _PAIRS).withColumn("containment", rounded(F.col("containment")))


@query("keys_candidates_by_name", """SELECT 'doc_id' AS name, 'documents' AS a, 'labels' AS b, round(least(x, y) / greatest(x, y), 6) AS ratio, CASE WHEN least(x, y) / greatest(x, y) >= 0.8 THEN 'high' WHEN least(x, y) / greatest(x, y) >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM (SELECT count(DISTINCT doc_id) AS x FROM documents), (SELECT count(DISTINCT doc_id) AS y FROM labels)""")
def keys_candidates_by_name(spark, sf_dir):
    rows = [table(spark, sf_dir, t).agg(F.count_distinct("doc_id").alias("distinct")).withColumns({"table": F.lit(t), "column": F.lit("doc_id")}) for t in ("documents", "labels")]
    return candidates_by_name(reduce(DataFrame.unionByName, rows)).withColumn("ratio", rounded(F.col("ratio")))


@query("keys_freshness", "SELECT left(max(ts)::VARCHAR, 19) AS latest, max(ts) <= TIMESTAMP '2030-01-01' AS passed FROM events")
def keys_freshness(spark, sf_dir):
    return freshness(table(spark, sf_dir, "events"), "ts", "2030-01-01 00:00:00").withColumn("latest", F.substring("latest", 1, 19))
