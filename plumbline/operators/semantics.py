"""Value semantics: which cells are censored, stale or not applicable (VS-*, WN-1..6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import norm, rounded
from plumbline.plans.registry import query
from plumbline.session import table

PRECEDENCE = ("NOT_APPLICABLE", "CENSORED", "STALE_FROZEN")


def sentinel(c: Column, codes: list) -> Column:
    """Equal to a declared code after normalisation (VS-1, VS-2)."""
    return F.coalesce(norm(c).isin([str(v).strip().upper().removesuffix(".0") for v in codes]), F.lit(False))


def frequency_window(cycles: int, unit: str = "period") -> int:
    """k cycles need k + 1 observations; years and quarters count their months where the panel is monthly (WN-5)."""
    return cycles * {"period": 1, "month": 1, "quarter": 3, "year": 12}[unit] + 1


def unfinished(status: Column, open_: list[str], done: list[str]) -> Column:
    """CENSORED while open, UNCLASSIFIED outside the domain (VS-3)."""
    s = norm(status)
    return F.when(s.isin(open_), "CENSORED").when(~s.isin(done) | s.isNull(), "UNCLASSIFIED")


def forward_window(df: DataFrame, entity: str, period: str, horizon: int, exit_: Column) -> Column:
    """CENSORED where the forward window reaches beyond the panel's end or the entity's first exit (VS-4, WN-2)."""
    end = df.agg(F.max(period).alias("m")).first().m
    first_exit = F.min(F.when(exit_, F.col(period))).over(Window.partitionBy(entity))
    return F.when(F.col(period) + horizon > F.least(F.lit(end), F.coalesce(first_exit, F.lit(end))), "CENSORED")


def not_yet_observed(entity: str, period: str, event: Column) -> Column:
    """CENSORED until the entity's first event (VS-5, WN-1)."""
    seen = F.max(event.cast("int")).over(Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.coalesce(seen, F.lit(0)) == 0, "CENSORED")


def frozen_segments(df: DataFrame, segment: str, period: str, value: str, window: int) -> DataFrame:
    """(segment, period) inside some run of `window` available periods with one single value (WN-3, VS-6): the windows
    run over one row per segment and period."""
    per = df.where(F.col(value).isNotNull()).groupBy(segment, period).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    back, ahead = (Window.partitionBy(segment).orderBy(period).rowsBetween(*b) for b in ((-(window - 1), 0), (0, window - 1)))
    full = F.count("*").over(back) == window
    flat = per.withColumn("frozen", (full & (F.min("lo").over(back) == F.max("hi").over(back))).cast("int"))
    return flat.withColumn("inside", F.max("frozen").over(ahead)).where("inside = 1").select(segment, period)


def frozen_entities(df: DataFrame, entity: str, period: str, value: str, activity: str, window: int) -> DataFrame:
    """Rows of an entity inside a run of `window` rows with one value while there was activity (WN-4, VS-6)."""
    order = Window.partitionBy(entity).orderBy(period)
    back, ahead = order.rowsBetween(-(window - 1), 0), order.rowsBetween(0, window - 1)
    still = (F.count(value).over(back) == window) & (F.min(value).over(back) == F.max(value).over(back)) & (F.sum(F.abs(activity)).over(back) > 0)
    flat = df.withColumn("_end", still.cast("int")).withColumn("_in", F.max("_end").over(ahead))
    return flat.where("_in = 1").drop("_end", "_in")


def not_applicable(conditions: dict[str, Column]) -> Column:
    """The first reason that holds: a declared exclusion, a regime, a rate type, a maturity (VS-7)."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in conditions.items()])


def ledger(df: DataFrame, key: list[str], entries: dict[tuple[str, str, str], Column]) -> DataFrame:
    """One row per row and entry (variable, entry, tag): APPLIED_TAG, NO_TAG or UNCLASSIFIED (VS-9). The entry's column is
    true, false or null."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(e).alias("entry"), F.lit(t).alias("tag"), c.alias("hit")) for (v, e, t), c in entries.items()])).alias("r")
    status = F.when(F.col("hit").isNull(), "UNCLASSIFIED").when(F.col("hit"), "APPLIED_TAG").otherwise("NO_TAG")
    return df.select(*key, rows).select(*key, "r.*").select(*key, "variable", "entry", F.when(F.col("hit"), F.col("tag")).alias("tag"), status.alias("status"))


def resolve(assessments: DataFrame, key: list[str]) -> DataFrame:
    """One tag a cell by precedence, with the suppressed ones and the number of claims (WN-6)."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("tag"))
    claims = assessments.where("status = 'APPLIED_TAG'").groupBy(*key, "variable").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "entry", "tag"))).alias("c"))
    return claims.select(*key, "variable", F.col("c")[0]["tag"].alias("tag"), F.col("c")[0]["entry"].alias("entry"), F.array_join(F.transform(F.slice("c", F.lit(2), F.size("c")), lambda x: x["tag"]), ",").alias("suppressed"), F.size("c").alias("claims"))


def summary(tags: DataFrame, cells: int) -> DataFrame:
    """Cells per variable and tag with their share and overlaps (VS-10)."""
    return tags.groupBy("variable", "tag").agg(F.count("*").alias("cells"), F.count_if(F.col("claims") > 1).alias("overlaps")).withColumn("share", F.col("cells") / F.lit(cells))


def actions(tags: DataFrame, key: str, samples: int = 5) -> DataFrame:
    """Queue by priority, with decision and sample rows (VS-11, SL-5)."""
    decision = F.when(F.col("tag") == "CENSORED", "exclude from outcome").when(F.col("tag") == "STALE_FROZEN", "refresh source").otherwise("leave out of denominator")
    per = tags.groupBy("variable", "tag").agg(F.count("*").alias("cells"), F.count_distinct(key).alias("rows"))
    rn = F.row_number().over(Window.partitionBy("variable", "tag").orderBy(key))
    few = tags.withColumn("rn", rn).where(F.col("rn") <= samples).groupBy("variable", "tag").agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("samples"))
    priority = F.when(F.col("tag") == "STALE_FROZEN", 1).when(F.col("tag") == "CENSORED", 2).otherwise(3)
    return per.join(few, ["variable", "tag"]).select(priority.alias("priority"), decision.alias("decision"), "variable", "tag", "cells", "rows", "samples")


def validate(df: DataFrame, key: str, bound: list[str]) -> DataFrame:
    """Row references unique and populated, bound columns present (VS-8, VS-12)."""
    absent = [c for c in bound if c not in df.columns]
    return df.agg((F.count_distinct(key) == F.count("*")).alias("unique"), (F.count_if(F.col(key).isNull()) == 0).alias("populated")).withColumn("unscoped", F.lit(", ".join(absent)))


def scope_plan(entries: DataFrame, bindings: DataFrame, declared: DataFrame) -> DataFrame:
    """Routing of entries (entry, roles, declarations: arrays) before any row is read (VS-8): READY_FOR_EVALUATION if every
    role is bound (role, column) to exactly one column and every declaration (name) is made, else UNSCOPED with what is
    missing, in the order of names. A role bound to several columns counts as missing."""
    one = bindings.groupBy("role").agg(F.count_distinct("column").alias("k")).where("k = 1").select(F.col("role").alias("x"), F.lit("role").alias("kind"))
    have = one.unionByName(declared.select(F.col("name").alias("x"), F.lit("declaration").alias("kind")).distinct()).withColumn("have", F.lit(1))
    of_kind = lambda c, k: F.transform(c, lambda v: F.struct(F.lit(k).alias("kind"), v.alias("x")))
    needs = entries.select("entry", F.explode(F.concat(of_kind("roles", "role"), of_kind("declarations", "declaration"))).alias("r")).select("entry", "r.*")
    lost = needs.distinct().join(have, ["kind", "x"], "left").where("have IS NULL").groupBy("entry")
    listed = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("x")))), ";")
    found = entries.select("entry").join(lost.agg(listed("role").alias("roles"), listed("declaration").alias("declarations")), "entry", "left")
    status = F.when(F.col("roles").isNull(), "READY_FOR_EVALUATION").otherwise("UNSCOPED")
    return found.select("entry", status.alias("routing"), F.coalesce("roles", F.lit("")).alias("missing_roles"), F.coalesce("declarations", F.lit("")).alias("missing_declarations"))


def daily(spark, sf_dir) -> DataFrame:
    """Events by user and day: the panel of the examples."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("entity"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("period")).agg(F.count("*").alias("n"), F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"), F.floor(F.min("value") / 20).alias("level"))


_DAILY = "WITH d AS (SELECT user_id AS entity, (ts::DATE - DATE '2024-01-01')::INT AS period, count(*) AS n, max((event_type = 'error')::INT) AS errors, floor(min(value) / 20)::BIGINT AS level FROM events GROUP BY 1, 2)"


@query("semantics_forward_window", f"""{_DAILY}, e AS (SELECT *, min(CASE WHEN errors = 1 THEN period END) OVER (PARTITION BY entity) AS x, (SELECT max(period) FROM d) AS m FROM d) SELECT CASE WHEN period + 7 > least(m, coalesce(x, m)) THEN 'CENSORED' END AS tag, count(*) AS rows FROM e GROUP BY 1""")
def semantics_forward_window(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select(forward_window(d, "entity", "period", 7, F.col("errors") == 1).alias("tag")).groupBy("tag").agg(F.count("*").alias("rows"))


@query("semantics_not_yet_observed", f"""{_DAILY}, e AS (SELECT max(errors) OVER (PARTITION BY entity ORDER BY period) AS seen FROM d) SELECT CASE WHEN seen = 0 THEN 'CENSORED' END AS tag, count(*) AS rows FROM e GROUP BY 1""")
def semantics_not_yet_observed(spark, sf_dir):
    return daily(spark, sf_dir).select(not_yet_observed("entity", "period", F.col("errors") == 1).alias("tag")).groupBy("tag").agg(F.count("*").alias("rows"))


@query("semantics_frozen_segments", f"""{_DAILY}, p AS (SELECT errors AS segment, period, min(level) AS lo, max(level) AS hi FROM d GROUP BY 1, 2),
 f AS (SELECT *, count(*) OVER w = 2 AND min(lo) OVER w = max(hi) OVER w AS fr FROM p WINDOW w AS (PARTITION BY segment ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
 i AS (SELECT *, max(fr::INT) OVER (PARTITION BY segment ORDER BY period ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS ins FROM f) SELECT segment::INT AS segment, period FROM i WHERE ins = 1""")
def semantics_frozen_segments(spark, sf_dir):
    return frozen_segments(daily(spark, sf_dir).withColumn("segment", F.col("errors")), "segment", "period", "level", frequency_window(1))


@query("semantics_frozen_entities", f"""{_DAILY}, f AS (SELECT *, count(level) OVER w = 3 AND min(level) OVER w = max(level) OVER w AND sum(abs(n)) OVER w > 0 AS fr FROM d WINDOW w AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 i AS (SELECT *, max(fr::INT) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ins FROM f) SELECT entity, period, n, errors::INT AS errors, level FROM i WHERE ins = 1""")
def semantics_frozen_entities(spark, sf_dir):
    return frozen_entities(daily(spark, sf_dir), "entity", "period", "level", "n", frequency_window(2))


_ENTRIES = """l AS (SELECT o_orderkey, 'o_totalprice' AS variable, 'open' AS entry, 'CENSORED' AS tag, o_orderstatus = 'O' AS hit FROM orders
 UNION ALL SELECT o_orderkey, 'o_totalprice', 'low', 'NOT_APPLICABLE', o_orderpriority = '5-LOW' FROM orders UNION ALL SELECT o_orderkey, 'o_totalprice', 'flat', 'STALE_FROZEN', CASE WHEN o_totalprice < 10000 THEN NULL ELSE o_totalprice > 400000 END FROM orders)"""


def order_ledger(spark, sf_dir):
    entries = {("o_totalprice", "open", "CENSORED"): F.col("o_orderstatus") == "O", ("o_totalprice", "low", "NOT_APPLICABLE"): F.col("o_orderpriority") == "5-LOW", ("o_totalprice", "flat", "STALE_FROZEN"): F.when(F.col("o_totalprice") >= 10000, F.col("o_totalprice") > 400000)}
    return ledger(table(spark, sf_dir, "orders"), ["o_orderkey"], entries)


@query("semantics_ledger", f"WITH {_ENTRIES} SELECT entry, CASE WHEN hit IS NULL THEN 'UNCLASSIFIED' WHEN hit THEN 'APPLIED_TAG' ELSE 'NO_TAG' END AS status, count(*) AS cells FROM l GROUP BY 1, 2")
def semantics_ledger(spark, sf_dir):
    return order_ledger(spark, sf_dir).groupBy("entry", "status").agg(F.count("*").alias("cells"))


_RESOLVED = f"""WITH {_ENTRIES}, c AS (SELECT o_orderkey, variable, list({{'r': CASE tag WHEN 'NOT_APPLICABLE' THEN 1 WHEN 'CENSORED' THEN 2 ELSE 3 END, 'entry': entry, 'tag': tag}} ORDER BY CASE tag WHEN 'NOT_APPLICABLE' THEN 1 WHEN 'CENSORED' THEN 2 ELSE 3 END) AS c FROM l WHERE hit GROUP BY 1, 2),
 r AS (SELECT o_orderkey, variable, c[1].tag AS tag, c[1].entry AS entry, array_to_string(list_transform(c[2:], lambda x: x.tag), ',') AS suppressed, len(c)::INT AS claims FROM c)"""


@query("semantics_resolved", f"{_RESOLVED} SELECT * FROM r")
def semantics_resolved(spark, sf_dir):
    return resolve(order_ledger(spark, sf_dir), ["o_orderkey"])


@query("semantics_summary", f"{_RESOLVED} SELECT variable, tag, count(*) AS cells, count(*) FILTER (WHERE claims > 1) AS overlaps, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM r GROUP BY 1, 2")
def semantics_summary(spark, sf_dir):
    tags = resolve(order_ledger(spark, sf_dir), ["o_orderkey"])
    return summary(tags, table(spark, sf_dir, "orders").count()).withColumn("share", rounded(F.col("share")))


@query("semantics_actions", f"""{_RESOLVED}, n AS (SELECT *, row_number() OVER (PARTITION BY variable, tag ORDER BY o_orderkey) AS rn FROM r)
 SELECT CASE tag WHEN 'STALE_FROZEN' THEN 1 WHEN 'CENSORED' THEN 2 ELSE 3 END AS priority, CASE tag WHEN 'CENSORED' THEN 'exclude from outcome' WHEN 'STALE_FROZEN' THEN 'refresh source' ELSE 'leave out of denominator' END AS decision, variable, tag, count(*) AS cells, count(DISTINCT o_orderkey) AS rows, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) FILTER (WHERE rn <= 5) AS samples FROM n GROUP BY variable, tag""")
def semantics_actions(spark, sf_dir):
    return actions(resolve(order_ledger(spark, sf_dir), ["o_orderkey"]), "o_orderkey")


@query("semantics_not_applicable", """SELECT CASE WHEN l_linestatus = 'F' THEN 'finished' WHEN l_discount = 0 THEN 'no discount' END AS reason, count(*) AS rows FROM lineitem GROUP BY 1""")
def semantics_not_applicable(spark, sf_dir):
    reason = not_applicable({"finished": F.col("l_linestatus") == "F", "no discount": sentinel(F.col("l_discount"), [0])})
    return table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"))


@query("semantics_unfinished", """SELECT CASE WHEN o_orderstatus IN ('O') THEN 'CENSORED' WHEN o_orderstatus NOT IN ('F') THEN 'UNCLASSIFIED' END AS tag, count(*) AS rows FROM orders GROUP BY 1""")
def semantics_unfinished(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(unfinished(F.col("o_orderstatus"), ["O"], ["F"]).alias("tag")).agg(F.count("*").alias("rows"))


@query("semantics_validate", """SELECT count(DISTINCT o_orderkey) = count(*) AS "unique", count(*) FILTER (WHERE o_orderkey IS NULL) = 0 AS populated, 'maturity' AS unscoped FROM orders""")
def semantics_validate(spark, sf_dir):
    return validate(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus", "maturity"])


@query("semantics_scope_plan", """WITH b AS (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0 GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1),
 e AS (SELECT c_custkey AS entry, CASE WHEN c_nationkey NOT IN (SELECT s_nationkey FROM b) THEN 'nation ' || c_nationkey ELSE '' END AS missing_roles, CASE WHEN c_mktsegment NOT IN (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING avg(c_acctbal) > (SELECT avg(c_acctbal) FROM customer)) THEN c_mktsegment ELSE '' END AS missing_declarations FROM customer)
 SELECT entry, CASE WHEN missing_roles = '' AND missing_declarations = '' THEN 'READY_FOR_EVALUATION' ELSE 'UNSCOPED' END AS routing, missing_roles, missing_declarations FROM e""")
def semantics_scope_plan(spark, sf_dir):
    """An entry a customer, which needs one supplier in credit in its nation and a market segment of more than average balance."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nation = lambda c: F.concat(F.lit("nation "), F.col(c).cast("string"))
    entries = customer.select(F.col("c_custkey").alias("entry"), F.array(nation("c_nationkey")).alias("roles"), F.array("c_mktsegment").alias("declarations"))
    bound = supplier.where("s_acctbal > 0").select(nation("s_nationkey").alias("role"), F.col("s_suppkey").alias("column"))
    mean = customer.agg(F.avg("c_acctbal").alias("mean"))  # one row
    rich = customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.avg("c_acctbal").alias("own")).crossJoin(mean).where("own > mean")
    return scope_plan(entries, bound, rich.select("name"))
