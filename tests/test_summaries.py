"""Key quality, summaries of value semantics, and warnings of new tables."""

import random

from pyspark.sql import functions as F

from plumbline.operators import ingest, keys
from plumbline.operators import semanticsummary as ss
from plumbline.operators.panel import peer_coverage
from plumbline.operators.rollup import latest_failures


def test_grain_by_hand(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "?", "a1"]), rng.choice([1, 11, None]), rng.randint(0, 400), rng.randint(0, 1)) for _ in range(500)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "s string, k int, u int, v int")
    candidates = [["u"], ["s", "k"], ["u", "k", "s"], ["u", "v"], ["s", "k", "u", "v"]]
    got = {r.key: r for r in keys.grain(df, candidates, {"s": [" ? "]}, {"u": "identifier"}).collect()}
    at = {"s": 0, "k": 1, "u": 2, "v": 3}
    for c in candidates:
        usable = [r for r in rows if all(r[at[x]] is not None for x in c) and not ("s" in c and r[0] == "?")]
        groups = {}
        for r in usable:
            groups.setdefault(tuple(r[at[x]] for x in c), []).append(r)
        many = [g for g in groups.values() if len(g) > 1]
        r = got["+".join(c)]
        assert (r.distinct, r.excess, r.null_keys, r.rows_in_duplicates) == (len(groups), len(usable) - len(groups), len(rows) - len(usable), sum(map(len, many)))
        near = len(groups) >= 0.95 * len(usable)
        assert (r.duplicate_groups, r.exact_groups) == ((len(many), sum(len(set(g)) == 1 for g in many)) if near else (0, 0)), c
        assert r.verdict == ("near_unique" if near else "insufficient") and not r.is_unique
    assert sorted(r.position for r in got.values()) == [1, 2, 3, 4, 5]
    unique = spark.range(50).withColumn("v", F.col("id") % 2)
    got = {r.key: r for r in keys.grain(unique, [["id"], ["v"], ["id", "v"]]).collect()}
    assert (got["id"].verdict, got["id"].position, got["id+v"].position, got["v"].verdict) == ("exact", 1, 2, "insufficient")
    assert [r.verdict for r in keys.grain(unique.where("false"), [["id"]]).collect()] == ["insufficient"]


def test_keys_that_only_look_alike_are_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("1:a", ""), ("", "1:a")], "x string, y string")
    assert keys.grain(df, [["x", "y"]]).first().verdict == "exact"


def test_hot_and_many_keys_in_one_shuffle(spark):
    df = spark.range(20_000).select((F.col("id") % 3 * F.col("id")).alias("k"), F.lit(1).alias("one"))
    got = {r.key: r for r in keys.grain(df, [["k"], ["one"], ["k", "one"]]).collect()}
    assert got["one"].distinct == 1 and got["k"].distinct == got["k+one"].distinct == df.select("k").distinct().count()


def case(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 5), (3, "y", 6), (4, "z", 7)], "id int, a string, b int")
    rows = [(1, "a", "e1", "CENSORED", "APPLIED_TAG"), (1, "a", "e2", "NOT_APPLICABLE", "APPLIED_TAG"), (2, "a", "e1", None, "NO_TAG"), (2, "a", "e2", "NOT_APPLICABLE", "APPLIED_TAG"), (3, "a", "e1", None, "UNCLASSIFIED"), (3, "a", "e2", None, "UNCLASSIFIED"), (4, "b", "e3", "STALE_FROZEN", "APPLIED_TAG")]
    found = ss.with_unscoped(spark.createDataFrame(rows, "id int, variable string, entry string, tag string, status string"), ["id"], [("c", "e9")])
    plan = spark.createDataFrame([("e1", "READY_FOR_EVALUATION"), ("e9", "UNSCOPED")], "entry string, routing string")
    return df, ss.summarize(df, ["id"], found, {"a": ["amount"], "b": ["rest"], "id": ["key"]}, ["amount", "rest"], plan)


def test_summaries(spark):
    _, s = case(spark)
    got = {r.variable: r for r in s.fields.collect()}
    a = got["a"]
    assert (a.assessed_cells, a.tagged_cells, a.censored, a.not_applicable, a.no_tag_cells, a.unclassified_assessments, a.examination) == (3, 2, 0, 2, 1, 2, "ASSESSED")
    assert (got["id"].examination, got["b"].tag_rate, got["b"].stale_frozen) == ("NO_RULE_ENTRY", 1.0, 1)
    assert {r.variable: r.examination for r in s.unexamined.collect()} == {"id": "NO_RULE_ENTRY"}
    assert [(r.id, r.variable, r.entry, r.value) for r in s.populated.collect()] == [(1, "a", "e2", "x")]  # the cell of row 2 is empty
    assert [(r.id, r.claims, r.winning_tag, r.suppressed) for r in s.overlaps.collect()] == [(1, 2, "NOT_APPLICABLE", "CENSORED")]
    d = s.dataset.first()
    assert (d.verdict, d.assessments, d.tagged_cells, d.multi_claim_cells, d.unscoped_entries, d.populated_where_not_applicable, d.ready_routes, d.unscoped_routes, d.examined_fields) == ("PARTIALLY_CLASSIFIED", 7, 3, 1, 1, 1, 1, 1, 2)
    assert {(r.entry, r.status): r["count"] for r in s.outcomes.collect()}[("e2", "APPLIED_TAG")] == 2
    per = {(r.entry, r.variable): (r.assessments, r.tagged, r.tag_rate) for r in s.rules.collect()}
    assert per["e9", "c"] == (0, 0, None) and per["e2", "a"][:2] == (3, 2)
    found = spark.createDataFrame([("e", "v", True, True, "TAGGED"), ("e", "v", True, False, "NO_TAG"), ("e", "v", False, False, "BELOW_MINIMUM")], "entry string, variable string, assessed boolean, tagged boolean, outcome string")
    g = ss.groups(found).first()
    assert (g.candidate_groups, g.assessed_groups, g.tagged_groups, g.below_minimum_groups) == (3, 2, 1, 1)


def test_declared_types(spark):
    said = [("Date", "datetime"), ("runtime", "datetime"), ("INTEGER", "numerical"), ("growth rate", "numerical"), ("bool", "binary"), ("credit rating", "ordinal"), ("grade", "ordinal"), ("enum", "categorical"), ("id", "identifier"), ("loan_id", "identifier"), ("varchar", "text"), ("blob", None), ("", None), (None, None)]
    got = [(r.d, r.k) for r in spark.createDataFrame([(d,) for d, _ in said], "d string").select("d", ingest.declared_class(F.col("d")).alias("k")).collect()]
    assert got == said


def test_values_that_do_not_fit(spark):
    rows = [(str(i) if i % 10 else "x", str(i) if i % 5 else "x", None, "a", "2020-01-01" if i % 4 else "soon", "yes" if i else "perhaps") for i in range(100)]
    df = spark.createDataFrame(rows, "few string, many string, none string, text string, day string, flag string")
    observed = spark.createDataFrame([("few", "numerical"), ("many", "numerical"), ("none", "text"), ("text", "text"), ("day", "datetime"), ("flag", "binary")], "column string, logical_type string")
    got = {(r["column"], r.code) for r in ingest.column_warnings(df, observed).collect()}
    assert got == {("few", "column_mixed_type"), ("many", "column_mixed_type"), ("many", "column_parse_failure_rate"), ("none", "column_all_null"), ("day", "column_mixed_type"), ("day", "column_parse_failure_rate")}
    assert ingest.column_warnings(df.where("false"), observed).count() == 0


def test_plans_without_keys_stand_many_rows(spark):
    runs = spark.range(5000).select(F.lit("t").alias("table"), F.col("id").alias("test"), F.lit(1).alias("run_at"), F.lit(False).alias("passed"), (F.col("id") * 7919 % 5003).alias("violations"))
    plan = runs.where("test % 2 = 0").select("table", "test").withColumn("criticality", F.lit("High"))
    got = latest_failures(runs, plan)
    rows = sorted(got.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 5001))
    assert all((a.criticality == "High", a.violations) >= (b.criticality == "High", b.violations) for a, b in zip(rows, rows[1:]))
    cells = spark.range(1001).select((F.col("id") % 2).alias("ordinal"), F.col("id").cast("double").alias("coverage"))
    assert {r.peer_median for r in peer_coverage(cells).where("ordinal = 0").collect()} == {500.0}
    for df in (got, peer_coverage(cells)):
        plan_text = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan_text
