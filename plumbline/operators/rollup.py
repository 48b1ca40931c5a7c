"""Results, scores, issues, usage and lineage (RS-*, WN-9..13, JN-7..9, SO-*)."""

from __future__ import annotations

from itertools import count

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import rounded
from plumbline.operators.drift import indexed
from plumbline.plans.registry import query
from plumbline.session import materialise, table

WEIGHTS = {"High": 5, "Medium": 3, "Low": 1}


def suite(df: DataFrame, name: str, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row a check (share of rows that satisfy it, against the least share); one aggregation for all (RS-1)."""
    one = df.agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, (c, _) in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(k).alias("check"), F.col(k).alias("actual"), F.lit(float(least)).alias("expected")) for k, (_, least) in checks.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("passed", F.col("actual") >= F.col("expected"))


def roll_up(results: DataFrame, by: list[str]) -> DataFrame:
    """Passed fraction of each plan unit (RS-2)."""
    return results.groupBy(*by).agg(F.avg(F.col("passed").cast("int")).alias("fraction"), F.count("*").alias("checks"))


def scores(units: DataFrame) -> DataFrame:
    """Weighted score of each category (category, criticality, fraction) and the final 0-100 over them (RS-3)."""
    weight = reduce(lambda a, kv: a.when(F.col("criticality") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0)).otherwise(1)
    per = units.groupBy("category").agg((F.sum(F.col("fraction") * weight) / F.sum(weight) * 100).alias("score"))
    return per.withColumn("final", F.avg("score").over(Window.partitionBy()))


def criticality(tests: DataFrame, order: list) -> DataFrame:
    """Half of the tests at most are critical; of those, the first half (rounded up) High, the others Medium (RS-4)."""
    n, rn = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.partitionBy().orderBy(*order))
    cap = F.floor(n / 2)
    return tests.withColumn("criticality", F.when(rn <= F.ceil(cap / 2), "High").when(rn <= cap, "Medium").otherwise("Low"))


def latest_failures(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Latest run of each (table, test) with its plan, failures only, most critical and frequent first (RS-5, WN-9, JN-8)."""
    last = runs.groupBy("table", "test").agg(F.max_by(F.struct("passed", "violations"), "run_at").alias("r"), F.max("violations").alias("worst"))
    out = last.join(plan, ["table", "test"], "left").where(~F.col("r.passed"))
    rank = F.array_position(F.array(*map(F.lit, WEIGHTS)), F.coalesce("criticality", F.lit("Low")))
    rows = out.select("table", "test", F.coalesce("criticality", F.lit("Low")).alias("criticality"), F.col("r.violations").alias("violations"), "worst", rank.alias("_rank"), (-F.col("r.violations")).alias("_less"))
    numbered = indexed(rows, ["_rank", "_less", "table", "test"])  # one row a failing test, numbered over range partitions
    return numbered.withColumn("position", (F.col("_index") + 1).cast("int")).drop("_index", "_rank", "_less")


def coverage(register: DataFrame, ran: DataFrame) -> DataFrame:
    """Executable, run and outstanding entries of a register (RS-7)."""
    both = register.join(ran.select("id").distinct().withColumn("ran", F.lit(True)), "id", "left")
    status = F.when(~F.col("executable"), "gap").when(F.col("ran"), "run").otherwise("not run")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("entries"))


def usage(events: DataFrame, by: list[str], unit: str | None = None) -> DataFrame:
    """Events by any columns, and by day, week or month (RS-8, RS-9)."""
    keys = [*by, *([F.date_trunc(unit, "at").cast("date").cast("string").alias("bucket")] if unit else [])]
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.count_distinct("actor").alias("actors"))


def usage_details(events: DataFrame, measures: dict[str, tuple[str, list[str] | None]]) -> DataFrame:
    """(measure, key, events) of events (type, detail as JSON, context): for each measure its event type and the fields of the detail
    of which the first that is there is the key, or None for the context (RS-9): preferred tests, use cases, points of
    abandonment, dispositions; cadence and restores by context. Events without the key are left out; all measures share one scan."""
    each = []
    for name, (kind, paths) in measures.items():
        key = F.coalesce(*[F.get_json_object("detail", f"$.{p}") for p in paths]) if paths else F.nullif(F.col("context"), F.lit(""))
        each.append(F.when((F.col("type") == kind) & key.isNotNull(), F.struct(F.lit(name).alias("measure"), key.alias("key"))))
    return events.select(F.explode(F.array_compact(F.array(*each))).alias("m")).groupBy("m.measure", "m.key").agg(F.count("*").alias("events"))


def rerun_rate(events: DataFrame, kind: str, field: str) -> DataFrame:
    """Runs, those whose detail marks them as made after a replacement, and their rate (RS-9)."""
    flag = F.coalesce(F.get_json_object("detail", f"$.{field}").isin("true", "1"), F.lit(False))
    runs = F.col("type") == kind
    return events.agg(F.count_if(runs).alias("runs"), F.count_if(runs & flag).alias("reruns")).withColumn("rate", F.coalesce(F.col("reruns") / F.nullif(F.col("runs"), F.lit(0)), F.lit(0.0)))


def durations(events: DataFrame, start: str, end: str) -> DataFrame:
    """Seconds from the last start of an object to each of its ends (RS-10, JN-9); objects without a start give no row."""
    s = events.where(F.col("event_type") == start).groupBy("object_id").agg(F.max("at").alias("started"))
    e = events.where(F.col("event_type") == end).select("object_id", F.col("at").alias("ended"))
    return e.join(s, "object_id").select("object_id", (F.unix_seconds(F.col("ended").cast("timestamp")) - F.unix_seconds(F.col("started").cast("timestamp"))).alias("seconds"))


def ratios(events: DataFrame, measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Named ratios of counts of events, each with the condition of what is counted and of what it is counted against: reuse
    depth, overrides, reruns after replacements (RS-10). Nothing to count against gives 0."""
    counts = [c for i, (a, b) in enumerate(measures.values()) for c in (F.count_if(a).alias(f"a{i}"), F.count_if(b).alias(f"b{i}"))]
    rows = [F.struct(F.lit(n).alias("measure"), F.col(f"a{i}").alias("counted"), F.col(f"b{i}").alias("against"), F.coalesce(F.col(f"a{i}") / F.nullif(F.col(f"b{i}"), F.lit(0)), F.lit(0.0)).alias("ratio")) for i, n in enumerate(measures)]
    return events.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def trend(events: DataFrame, kinds: dict[str, str], unit: str = "day") -> DataFrame:
    """Counts of some kinds of events (name -> event type) side by side, by day, week or month; only buckets with one (RS-10)."""
    own = events.where(F.col("event_type").isin(list(kinds.values())))
    return own.groupBy(F.date_trunc(unit, "at").cast("date").cast("string").alias("bucket")).agg(*[F.count_if(F.col("event_type") == k).alias(n) for n, k in kinds.items()])


def sessions(events: DataFrame, by: list[str], at: str, minutes: int) -> DataFrame:
    """Numbers of bursts of events at most `minutes` apart (WN-13)."""
    order = Window.partitionBy(*by).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(order).cast("timestamp"))
    new = F.when(gap.isNull() | (gap > minutes * 60_000_000), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sequence(deliveries: DataFrame, family: str, order: list) -> DataFrame:
    """Delivery number within a family (WN-10)."""
    return deliveries.withColumn("sequence", F.row_number().over(Window.partitionBy(family).orderBy(*order)))


def stale_results(bindings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Results bound to a superseded snapshot (WN-11)."""
    return bindings.join(snapshots.select("snapshot_id", "status"), "snapshot_id").groupBy("result_id").agg(F.max((F.col("status") == "superseded").cast("int")).alias("s")).select("result_id", (F.col("s") == 1).alias("stale"))


def effective_threshold(rows: DataFrame, scopes: tuple[str, ...] = ("engagement", "dimension", "default")) -> DataFrame:
    """Latest threshold of each (diagnostic, key), narrower scopes first (WN-12)."""
    rank = F.array_position(F.array(*map(F.lit, scopes)), F.col("scope"))
    rn = F.row_number().over(Window.partitionBy("diagnostic", "key").orderBy(rank, F.desc("id")))
    return rows.withColumn("rn", rn).where("rn = 1").drop("rn")


def lineage(edges: DataFrame, start: DataFrame, gather: int = 20) -> DataFrame:
    """Everything reachable from `start` (node) over edges (source, target), with its distance (RS-11), however far. The
    frontier of each round is written to the shared folder; nodes seen before are left out, and every `gather` rounds
    what was seen is written as one table."""
    seen = materialise(start.select("node").distinct().withColumn("distance", F.lit(0)), "lineage")
    front = seen
    for d in count(1):
        step = front.join(edges, front.node == edges.source).select(F.col("target").alias("node")).distinct()
        front = materialise(step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)), "lineage")
        if not front.take(1):
            break
        seen = seen.unionByName(front) if d % gather else materialise(seen.unionByName(front), "lineage")
    return seen


def masked(c: Column, salt: str, prefix: str = "ID-") -> Column:
    """Salted hash of an identifier, 12 hexadecimal digits (RS-12)."""
    return F.when(c.isNotNull(), F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), c.cast("string")), 256), 1, 12))))


def external_report(df: DataFrame, identifiers: dict[str, str], segment: str, policy: str, salt: str) -> DataFrame:
    """Rows for readers outside (RS-12): identifiers (column -> prefix) become salted references, the segment is kept as it
    is (retain), becomes a reference (mask) or is emptied (omit). Nulls stay null; no salt or another policy is an error."""
    if not salt or policy not in ("retain", "mask", "omit"):
        raise ValueError("a report needs a salt and one of the policies retain, mask and omit")
    label = {"retain": F.col(segment), "mask": masked(F.col(segment), f"{salt}|SEG", "SEG-"), "omit": F.lit(None).cast("string")}[policy]
    return df.withColumns({c: masked(F.col(c), f"{salt}|{p}", f"{p}-") for c, p in identifiers.items()} | {segment: label})


def expired(rules: DataFrame, today: str, months: int) -> DataFrame:
    """Confirmed rules past their shelf life, or whose table's schema hash changed, fall back to inferred (RS-13)."""
    old = F.add_months("confirmed_at", months) < F.lit(today).cast("date")
    changed = F.col("stored_hash") != F.col("current_hash")
    return rules.withColumn("state", F.when(old | changed, "inferred").otherwise("confirmed"))


def asset_rollup(snapshots: DataFrame) -> DataFrame:
    """Per asset: snapshots by status, last upload, columns of the current one (RS-6, RS-14)."""
    return snapshots.groupBy("asset").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "superseded").alias("superseded"), F.max("uploaded").alias("last_upload"), F.max_by("columns", "uploaded").alias("columns"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """An order-free hash of a table's rows: count, and sums of two row hashes (manifests, version checks)."""
    h = lambda s: F.sum(F.xxhash64(F.lit(s), *columns).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), h(1).cast("string"), h(2).cast("string")), 256).alias("fingerprint"))


def row_ids(df: DataFrame, key: list[str], scope: str) -> DataFrame:
    """Deterministic row id: SHA-256 of the scope and the natural key (IO-8). A null part is told from an empty one."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    return df.withColumn("row_id", F.sha2(F.concat_ws("|", F.lit(scope), *[part(c) for c in key]), 256))


def ordinal_row_ids(df: DataFrame, snapshot: str, revision: str, name: str) -> DataFrame:
    """Deterministic row id of a parsed file's rows: SHA-256 of snapshot, parser revision, table and the row's ordinal in its
    file (IO-8). For DataFrames read straight from files; ordinals are the readers', so nothing is sorted."""
    at = F.concat_ws(":", F.element_at(F.split("_metadata.file_path", "/"), -1), F.col("_metadata.row_index").cast("string"))
    return df.select("*", F.sha2(F.concat_ws("|", F.lit(snapshot), F.lit(revision), F.lit(name), at), 256).alias("row_id"))


def usage_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("actor"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("object_id"))


@query("rollup_suite", """SELECT 'lineitem' AS "table", c AS "check", round(a, 6) AS actual, e AS expected, a >= e AS passed FROM (SELECT 'quantity_positive' AS c, avg((l_quantity > 0)::INT) AS a, 1.0 AS e FROM lineitem UNION ALL SELECT 'tax_low', avg((l_tax <= 0.05)::INT), 0.7 FROM lineitem UNION ALL SELECT 'flag_known', avg((l_returnflag IN ('A', 'N', 'R'))::INT), 0.99 FROM lineitem)""")
def rollup_suite(spark, sf_dir):
    return line_suite(spark, sf_dir).withColumn("actual", rounded(F.col("actual")))


def line_suite(spark, sf_dir):
    checks = {"quantity_positive": (F.col("l_quantity") > 0, 1.0), "tax_low": (F.col("l_tax") <= 0.05, 0.7), "flag_known": (F.col("l_returnflag").isin("A", "N", "R"), 0.99)}
    return suite(table(spark, sf_dir, "lineitem"), "lineitem", checks)


@query("rollup_scores", """WITH s AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'reach' ELSE 'depth' END AS category, event_type, CASE event_type WHEN 'view' THEN 'High' WHEN 'click' THEN 'Low' ELSE 'Medium' END AS criticality, avg((value > 10)::INT) AS f FROM events GROUP BY ALL),
 c AS (SELECT category, sum(f * CASE criticality WHEN 'High' THEN 5 WHEN 'Medium' THEN 3 ELSE 1 END) / sum(CASE criticality WHEN 'High' THEN 5 WHEN 'Medium' THEN 3 ELSE 1 END) * 100 AS score FROM s GROUP BY 1) SELECT category, round(score, 5) AS score, round(avg(score) OVER (), 5) AS final FROM c""")
def rollup_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    units = roll_up(e.withColumn("passed", F.col("value") > 10), ["event_type"]).withColumns({"category": F.when(F.col("event_type").isin("view", "click"), "reach").otherwise("depth"), "criticality": F.when(F.col("event_type") == "view", "High").when(F.col("event_type") == "click", "Low").otherwise("Medium")})
    return scores(units).select("category", rounded(F.col("score"), 5).alias("score"), rounded(F.col("final"), 5).alias("final"))


@query("rollup_criticality", """WITH t AS (SELECT p_brand AS test, count(*) AS n FROM part GROUP BY 1), r AS (SELECT test, n, row_number() OVER (ORDER BY n DESC, test) AS rn, count(*) OVER () // 2 AS cap FROM t) SELECT test, n, CASE WHEN rn <= ceil(cap / 2) THEN 'High' WHEN rn <= cap THEN 'Medium' ELSE 'Low' END AS criticality FROM r""")
def rollup_criticality(spark, sf_dir):
    return criticality(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("test")).agg(F.count("*").alias("n")), [F.desc("n"), "test"])


@query("rollup_failures", """WITH l AS (SELECT event_type AS "table", user_id AS test, arg_max(value, ts) AS v, max(value) AS w FROM events GROUP BY 1, 2), f AS (SELECT "table", test, CASE WHEN "table" = 'error' THEN 'High' ELSE 'Low' END AS criticality, v, w FROM l WHERE v > 50)
 SELECT "table", test, criticality, v AS violations, w AS worst, row_number() OVER (ORDER BY CASE criticality WHEN 'High' THEN 1 ELSE 3 END, v DESC, "table", test)::INT AS position FROM f""")
def rollup_failures(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("table"), F.col("user_id").alias("test"), F.col("ts").alias("run_at"), F.col("value").alias("violations"), (F.col("value") <= 50).alias("passed"))
    plan = runs.where("table = 'error'").select("table", "test").distinct().withColumn("criticality", F.lit("High"))
    return latest_failures(runs, plan)


@query("rollup_coverage", """SELECT CASE WHEN c_acctbal < 0 THEN 'gap' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'run' ELSE 'not run' END AS status, count(*) AS entries FROM customer GROUP BY 1""")
def rollup_coverage(spark, sf_dir):
    return coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 0).alias("executable")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("rollup_usage", """SELECT event_type, date_trunc('week', ts)::DATE::VARCHAR AS bucket, count(*) AS events, count(DISTINCT user_id) AS actors FROM events GROUP BY 1, 2""")
def rollup_usage(spark, sf_dir):
    return usage(usage_events(spark, sf_dir), ["event_type"], "week")


@query("rollup_usage_detail", """SELECT (props->>'$.k')::INT AS object_id, event_type, count(*) AS events, count(DISTINCT user_id) AS actors FROM events GROUP BY 1, 2""")
def rollup_usage_detail(spark, sf_dir):
    return usage(usage_events(spark, sf_dir), ["object_id", "event_type"])


@query("rollup_durations", """WITH e AS (SELECT *, (props->>'$.k')::INT AS o FROM events), s AS (SELECT o, max(ts) AS a FROM e WHERE event_type = 'view' GROUP BY 1) SELECT o AS object_id, count(*) AS ends, round(avg(floor(epoch_us(ts) / 1e6) - floor(epoch_us(a) / 1e6)), 3) AS mean_seconds FROM s JOIN e USING (o) WHERE event_type = 'click' GROUP BY 1""")
def rollup_durations(spark, sf_dir):
    return durations(usage_events(spark, sf_dir), "view", "click").groupBy("object_id").agg(F.count("*").alias("ends"), rounded(F.avg("seconds"), 3).alias("mean_seconds"))


_RATIO = "SELECT '{n}' AS measure, count(*) FILTER (WHERE {a}) AS counted, count(*) FILTER (WHERE {b}) AS against, coalesce(round(count(*) FILTER (WHERE {a}) / nullif(count(*) FILTER (WHERE {b}), 0), 6), 0) AS ratio FROM events"


@query("rollup_ratios", " UNION ALL ".join(_RATIO.format(n=n, a=a, b=b) for n, a, b in (("reuse_depth", "event_type = 'click'", "event_type = 'view'"), ("override_rate", "event_type IN ('error', 'click')", "event_type IN ('error', 'click', 'view')"), ("rerun_rate", "event_type = 'view' AND (props->>'$.k')::INT < 10", "event_type = 'view'"), ("never", "event_type = 'view'", "event_type = 'none'"))))
def rollup_ratios(spark, sf_dir):
    kind = F.col("event_type")
    measures = {"reuse_depth": (kind == "click", kind == "view"), "override_rate": (kind.isin("error", "click"), kind.isin("error", "click", "view")), "rerun_rate": ((kind == "view") & (F.col("object_id") < 10), kind == "view"), "never": (kind == "view", kind == "none")}
    return ratios(usage_events(spark, sf_dir), measures).withColumn("ratio", rounded(F.col("ratio")))


@query("rollup_trend", """SELECT ts::DATE::VARCHAR AS bucket, count(*) FILTER (WHERE event_type = 'view') AS bound, count(*) FILTER (WHERE event_type = 'click') AS created FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def rollup_trend(spark, sf_dir):
    return trend(usage_events(spark, sf_dir), {"bound": "view", "created": "click"})


@query("rollup_sessions", """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, count(*) AS events, sum(n)::BIGINT AS sessions FROM g GROUP BY 1""")
def rollup_sessions(spark, sf_dir):
    s = sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 30)
    return s.groupBy("user_id").agg(F.count("*").alias("events"), F.max("session").alias("sessions"))


@query("rollup_sequence", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS sequence FROM orders")
def rollup_sequence(spark, sf_dir):
    return sequence(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "sequence")


@query("rollup_stale_results", "SELECT l_orderkey AS result_id, max((o_orderstatus = 'O')::INT) = 1 AS stale FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def rollup_stale_results(spark, sf_dir):
    snaps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.when(F.col("o_orderstatus") == "O", "superseded").otherwise("active").alias("status"))
    return stale_results(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.col("l_orderkey").alias("snapshot_id")), snaps)


@query("rollup_thresholds", """SELECT diagnostic, key, scope, id FROM (SELECT o_custkey AS diagnostic, o_orderpriority AS key, CASE o_orderstatus WHEN 'F' THEN 'engagement' WHEN 'P' THEN 'dimension' ELSE 'default' END AS scope, o_orderkey AS id FROM orders) QUALIFY row_number() OVER (PARTITION BY diagnostic, key ORDER BY CASE scope WHEN 'engagement' THEN 1 WHEN 'dimension' THEN 2 ELSE 3 END, id DESC) = 1""")
def rollup_thresholds(spark, sf_dir):
    scope = F.when(F.col("o_orderstatus") == "F", "engagement").when(F.col("o_orderstatus") == "P", "dimension").otherwise("default")
    return effective_threshold(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("diagnostic"), F.col("o_orderpriority").alias("key"), scope.alias("scope"), F.col("o_orderkey").alias("id")))


@query("rollup_lineage", """WITH RECURSIVE e AS (SELECT o_orderkey AS s, o_orderkey // 2 AS t FROM orders WHERE o_orderkey > 0), l(node, distance) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT t, distance + 1 FROM l JOIN e ON e.s = l.node) SELECT node, min(distance)::INT AS distance FROM l GROUP BY 1""")
def rollup_lineage(spark, sf_dir):
    """Every order stems from the one of half its number."""
    o = table(spark, sf_dir, "orders")
    edges = o.where("o_orderkey > 0").select(F.col("o_orderkey").alias("source"), F.expr("o_orderkey div 2").alias("target"))
    return lineage(edges, o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node")))


@query("rollup_masked", "SELECT c_custkey, 'ID-' || upper(left(sha256('salt|' || c_name), 12)) AS masked FROM customer")
def rollup_masked(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", masked(F.col("c_name"), "salt").alias("masked"))


@query("rollup_external_report", """SELECT 'CUS-' || upper(left(sha256('salt|CUS|' || c_custkey), 12)) AS c_custkey, 'SEG-' || upper(left(sha256('salt|SEG|' || c_mktsegment), 12)) AS c_mktsegment, c_nationkey FROM customer""")
def rollup_external_report(spark, sf_dir):
    return external_report(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), {"c_custkey": "CUS"}, "c_mktsegment", "mask", "salt")


@query("rollup_expired", "SELECT CASE WHEN o_orderdate::DATE + INTERVAL 24 MONTH < DATE '1999-06-30' OR o_orderpriority <> (SELECT max(o_orderpriority) FROM orders) THEN 'inferred' ELSE 'confirmed' END AS state, count(*) AS rules FROM orders GROUP BY 1")
def rollup_expired(spark, sf_dir):
    """An order stands for a rule, its priority for the hash of the schema that it was confirmed on."""
    o = table(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderpriority").alias("current_hash"))
    rules = o.select(F.to_date("o_orderdate").alias("confirmed_at"), F.col("o_orderpriority").alias("stored_hash")).crossJoin(F.broadcast(now))  # one row beside each
    return expired(rules, "1999-06-30", 24).groupBy("state").agg(F.count("*").alias("rules"))


@query("rollup_assets", "SELECT o_custkey AS asset, count(*) FILTER (WHERE o_orderstatus <> 'O') AS active, count(*) FILTER (WHERE o_orderstatus = 'O') AS superseded, max(o_orderkey) AS last_upload, arg_max(o_totalprice, o_orderkey) AS columns FROM orders GROUP BY 1")
def rollup_assets(spark, sf_dir):
    return asset_rollup(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.when(F.col("o_orderstatus") == "O", "superseded").otherwise("active").alias("status"), F.col("o_orderkey").alias("uploaded"), F.col("o_totalprice").alias("columns")))


@query("rollup_row_ids", "SELECT l_orderkey, l_linenumber, l_shipdate, count(*) AS n, sha256('v1|' || l_orderkey || '|' || l_linenumber) AS row_id FROM lineitem GROUP BY ALL")
def rollup_row_ids(spark, sf_dir):
    ids = row_ids(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "v1")
    return ids.groupBy("l_orderkey", "l_linenumber", "l_shipdate", "row_id").agg(F.count("*").alias("n"))


@query("rollup_fingerprint")
def rollup_fingerprint(spark, sf_dir):
    return fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


def _detailed(spark, sf_dir):
    """Events with the detail of what they tell, from their properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    detail = F.to_json(F.struct(F.when(k % 3 == 0, F.concat(F.lit("t"), (k % 7).cast("string"))).alias("test_id"), F.when(k % 4 == 0, "kept").alias("disposition"), F.when(k % 2 == 0, "dropped").alias("action"), (k % 5 == 0).alias("after_replacement")))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), detail.alias("detail"), F.when(k < 50, "monthly").when(k < 75, "").alias("context"))


_DETAILED = "WITH e AS (SELECT event_type AS type, (props->>'$.k')::INT AS k FROM events)"


@query("rollup_usage_details", f"""{_DETAILED} SELECT 'preferences' AS measure, 't' || (k % 7) AS key, count(*) AS events FROM e WHERE type = 'view' AND k % 3 = 0 GROUP BY 2 UNION ALL SELECT 'dispositions', CASE WHEN k % 4 = 0 THEN 'kept' ELSE 'dropped' END, count(*) FROM e WHERE type = 'purchase' AND k % 2 = 0 GROUP BY 2
 UNION ALL SELECT 'cadence', 'monthly', count(*) FROM e WHERE type = 'signup' AND k < 50""")
def rollup_usage_details(spark, sf_dir):
    return usage_details(_detailed(spark, sf_dir), {"preferences": ("view", ["test_id"]), "dispositions": ("purchase", ["disposition", "action"]), "cadence": ("signup", None)})


@query("rollup_reruns", f"{_DETAILED} SELECT count(*) AS runs, count(*) FILTER (WHERE k % 5 = 0) AS reruns, round(count(*) FILTER (WHERE k % 5 = 0) / count(*), 6) AS rate FROM e WHERE type = 'click'")
def rollup_reruns(spark, sf_dir):
    return rerun_rate(_detailed(spark, sf_dir), "click", "after_replacement").withColumn("rate", rounded(F.col("rate")))
