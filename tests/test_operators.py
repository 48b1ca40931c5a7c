"""Hand-computed cases of single operators."""

import datetime as dt
import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.functions import tails
from plumbline.functions.prefix import cumulative
from plumbline.functions.quantiles import percentiles
from plumbline.functions.values import date as values_date
from plumbline.functions.values import name_tokens, number, parse_period, period_key
from plumbline.operators import association, drift, matching, missingness, panel, population, rollup, rules, semantics
from plumbline.plans.registry import Check, Registry
from plumbline.sources import readers


def exposures(spark, clustered: bool):
    rows = []
    for i in range(60):
        bad = i < 10 if clustered else i % 6 == 0
        region = "south" if (i < 20 if clustered else i % 3 == 0) else "north"
        rows.append((i, region, 90.0 if bad else 100.0, 95.0))
    return spark.createDataFrame(rows, "facility_id int, region string, ead double, drawn double")


RULE = {"id": "E1", "expression": {"kind": "ineq", "a": "ead", "op": ">=", "b": "drawn"}}


def test_rule_violation_and_tolerance(spark):
    r = rules.evaluate(exposures(spark, True), [RULE, RULE | {"id": "E2", "tolerance": 0.2}]).collect()
    by = {x.rule_id: x for x in r}
    assert by["E1"].outcome == "VIOLATION" and by["E1"].n_violations == 10 and abs(by["E1"].rate - 10 / 60) < 1e-12
    assert by["E2"].outcome == "PASS" and by["E2"].n_violations == 10


def test_rule_pattern(spark):
    per = {x.segment: x for x in rules.pattern(exposures(spark, True), RULE, "region").collect()}
    assert abs(per["south"].lift - 3.0) < 1e-9 and per["south"].pattern == "CLUSTERED"
    assert {x.pattern for x in rules.pattern(exposures(spark, False), RULE, "region").collect()} != {None}


@pytest.mark.parametrize(
    ("spec", "values", "want"),
    [
        ({"kind": "ineq", "a": "x", "op": "<=", "b": "#5"}, ["4", "6", None, "n/a", "abc"], [True, False, None, None, None]),
        ({"kind": "dom_set", "col": "x", "allowed": [1, "B"]}, ["1.0", "B", "C", None], [True, True, False, None]),
        ({"kind": "dom_range", "col": "x", "lo": 0, "hi": 1}, ["0", "1.5", "", "-1"], [True, False, None, False]),
        ({"kind": "presence", "cols": ["x"]}, ["a", None, "NaN"], [True, False, False]),
        ({"kind": "identity", "target": "x", "operands": ["#6", "#0"], "op": "/"}, ["1"], [None]),
        ({"kind": "dateorder", "earlier": "x", "later": "x", "allow_equal": False}, ["2024-01-05", "05/01/2024", "x"], [False, False, None]),
        ({"kind": "in_cond", "col": "x", "vals": ["a"]}, ["a", "b", None], [True, False, False]),
    ],
)
def test_predicates_are_three_valued(spark, spec, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    assert [r.p for r in df.select("i", rules.predicate(spec).alias("p")).orderBy("i").collect()] == want


def test_rule_not_applicable(spark):
    got = {r.rule_id: r for r in rules.evaluate(exposures(spark, True), [{"id": "A", "expression": {"kind": "present_number", "col": "nope"}}, {"id": "B", "condition": {"kind": "eq_cond", "col": "region", "val": "west"}, **{k: v for k, v in RULE.items() if k != "id"}}]).collect()}
    assert got["A"].outcome == got["B"].outcome == "NOT-APPLICABLE" and got["A"].reason == "column absent: nope" and got["B"].reason == "empty scope"


def test_panel_example(spark):
    df = spark.createDataFrame([("A", "2025-01"), ("A", "2025-02"), ("A", "2025-03"), ("B", "2025-02"), ("B", "2025-03")], "facility_id string, period string")
    rows = panel.prepared(df, "facility_id", "period", "month")
    one = panel.continuity(rows).first()
    assert (one.required, one.received, one.coverage) == (5, 5, 1.0)


def test_panel_with_defects(spark):
    df = spark.createDataFrame([("A", "2025-01", 1), ("A", "2025-01", 1), ("A", "2025-03", 1), (" ", "2025-01", 1), ("B", "2025-01", 1), ("B", "2025-Q1", 2)], "e string, p string, v int")
    rows = panel.prepared(df, "e", "p", "month")
    assert {(r.invalid, r.rows) for r in panel.invalid_rows(rows).collect()} == {("blank entity", 1), ("bad period", 1)}
    assert [r.period for r in panel.calendar_gaps(rows, "month").collect()] == ["2025-02"]
    assert [(r.kind, r.pairs, r.surplus) for r in panel.duplicates(rows, ["v"]).collect()] == [("exact", 1, 1)]
    assert [(r.entity_key, r.ordinal) for r in panel.missing_pairs(rows).collect()] == [("A", 2025 * 12 + 1)]


@pytest.mark.parametrize(
    ("label", "grain", "key"),
    [("2025-03", "month", "2025-03"), ("2025-Q2", "quarter", "2025-Q2"), ("2025q4", "quarter", "2025-Q4"), ("2025-H2", "half", "2025-H2"), ("2025", "year", "2025"), ("2025-05-17", "quarter", "2025-Q2"), ("2025-Q1", "month", None), ("2025-13", "month", None), ("", "year", None)],
)
def test_periods(spark, label, grain, key):
    df = spark.createDataFrame([(label,)], "x string").select(parse_period(F.col("x"), grain).alias("o"))
    assert df.select(period_key(F.col("o"), grain).alias("k")).first().k == key


def test_drift_of_mean(spark):
    rows = [(0.0 if i < 50 else 10.0, dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(100)]
    df = drift.early_recent(spark.createDataFrame(rows, "x double, d date"), "d", 0.5)
    one = drift.window_drift(df, "x").first()
    assert (one.early_mean, one.recent_mean, one.mean_change) == (0.0, 10.0, 10.0)
    assert drift.ks(df, "x", F.col("window") == "early").first().ks == 1.0


def test_governed_psi_edges_and_classes(spark):
    df = spark.createDataFrame([("baseline", x) for x in (1.0, 2.0, 3.0, None)] + [("current", x) for x in (1.0, 2.0, 99.0, None)], "population string, x double")
    parts = {r.bin: r for r in drift.governed_psi(df, [{"feature": "x", "edges": [1.0, 2.0]}]).collect()}
    assert parts["B0"].baseline == 1 and parts["B2"].current == 1 and parts["MISSING"].contribution == 0
    with pytest.raises(ValueError):
        drift.validate_bins({"feature": "x", "edges": [2.0, 1.0]})
    got = spark.createDataFrame([(0.25,), (0.10,), (0.0999,)], "p double").select(drift.psi_class(F.col("p"))).collect()
    assert [r[0] for r in got] == ["investigate", "watch", "stable"]


def test_split_policies(spark):
    df = spark.createDataFrame([(1,), (5,), (None,), (-999,)], "x int")
    got = [r.population for r in population.split(df, "x", {"operator": "<", "value": 3}, "current", [-999], "exclude").collect()]
    assert got == ["baseline", "current", "current", None]


def test_woe_by_hand(spark):
    stats = spark.createDataFrame([("f", "a", 10, 2), ("f", "b", 10, 8)], "feature string, bin string, n int, s int")
    got = {r.bin: r for r in association.woe(stats).collect()}
    want = math.log((8.5 / 11) / (2.5 / 11))
    assert abs(got["a"].woe - want) < 1e-12 and abs(got["a"].feature_iv - 2 * (6 / 11) * want) < 1e-12


def test_optimal_bins_follow_the_trend(spark):
    rows = [("f", i, 100, 5 + 10 * (i // 3)) for i in range(9)]
    fine = spark.createDataFrame(rows, "feature string, position bigint, n bigint, s bigint")
    got = {r.position: r for r in association.optimal_coarse(fine, max_bins=3).collect()}
    assert [got[i].coarse for i in range(9)] == [0, 0, 0, 1, 1, 1, 2, 2, 2] and got[0].trend == "ascending"


def test_structural_break_and_blocks(spark):
    df = spark.createDataFrame([(m, None if m < 3 else 1, None if m < 3 else 2) for m in range(6) for _ in range(4)], "m int, x int, y int")
    assert missingness.structural_breaks(df, {"x": F.col("x").isNull()}, F.col("m")).first().period == "3"
    assert missingness.blocks(missingness.co_missing(df, ["x", "y", "m"])) == [{"x", "y"}]


def test_cumulative_is_global(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.lit(1).alias("n")).repartition(7)
    got = cumulative(df, ["id"], {"c": "n"}, ["g"]).collect()
    assert all(r.c == r.id // 3 + 1 and r.c_total == 334 - (r.g > 0) for r in got)


def test_tails():
    assert abs(tails.t_two_sided(2.228138852, 10) - 0.05) < 1e-6
    assert abs(tails.chi2_one(3.841458821) - 0.05) < 1e-6
    assert abs(tails.hypergeometric_greater(3, 3, 3, 6) - 1 / 20) < 1e-12


def test_values(spark):
    df = spark.createDataFrame([("12", "custKey2Name")], "a string, n string")
    r = df.select(number(F.col("a")).alias("a"), name_tokens(F.col("n")).alias("t")).first()
    assert r.a == 12.0 and r.t == ["cust", "key", "2", "name"] or r.t == ["cust", "key", "2name"]


def test_registry(spark):
    reg = Registry()
    check = Check("nulls", lambda df, column: df.agg(F.count_if(F.col(column).isNull()).alias("n")), {"column": ...}, ("completeness",), ("n",))
    reg.register(check)
    df = spark.createDataFrame([(None, 1), (2, 3)], "a int, b int")
    assert reg.call("nulls", df, column="a").first().n == 1
    assert reg.serving("completeness") == ["nulls"]
    with pytest.raises(ValueError):
        reg.register(check)
    with pytest.raises(ValueError):
        reg.call("nulls", df)
    with pytest.raises(ValueError):
        reg.validate(Check("bad", lambda df, column: df, {"column": ...}, (), ("n",)), df, [{"column": "a"}] * 3)
    with pytest.raises(ValueError):
        reg.validate(Check("few", check.run, {"column": ...}, (), ("n",)), df, [{"column": "a"}])
    assert reg.validate(Check("own", check.run, {"column": ...}, (), ("n",)), df, [{"column": "a"}, {"column": "b"}, {"column": "a"}]).first().n == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|a\n2|b\n")
    assert readers.delimited(spark, str(tmp_path / "a.csv"), "pipe").count() == 2
    (tmp_path / "bad.csv").write_text("x,X\n1,2\n")
    with pytest.raises(ValueError):
        readers.delimited(spark, str(tmp_path / "bad.csv"))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("one.csv", "x,y\n1,a\n")
        z.writestr("two.csv", "z\n5\n6\n")
    (tmp_path / "all.zip").write_bytes(buffer.getvalue())
    rows = readers.zipped_csv(spark, str(tmp_path / "all.zip"))
    assert [r.z for r in readers.member(rows, "two.csv", ["z"]).orderBy("line").collect()] == ["5", "6"]
    readers.save(rows.select("member", "line"), str(tmp_path / "out"), ["member"])
    assert readers.snapshot(spark, str(tmp_path / "out"), ["line"]).count() == 3
    with pytest.raises(ValueError):
        readers.snapshot(spark, str(tmp_path / "out"), ["nope"])


def test_streams_agree_with_batch(spark, tmp_path):
    from plumbline.streaming.checks import windowed_bins, windowed_missing, windowed_rules

    src = "/root/testdata/sf0.001/events.parquet"
    one = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    one.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))
    rule = {"id": "V", "expression": {"kind": "dom_range", "col": "value", "lo": 0, "hi": 50}}
    plans = {"bins": windowed_bins(stream, {"feature": "value", "edges": [10.0, 50.0]}, "ts", "7 days"), "rules": windowed_rules(stream, [rule], "ts", "7 days"), "missing": windowed_missing(stream, ["value"], "ts", "7 days")}
    for name, plan in plans.items():
        q = plan.writeStream.format("memory").queryName(f"stream_{name}").outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("stream_bins").agg(F.sum("rows")).first()[0] == one.count()
    assert spark.table("stream_rules").agg(F.sum("V_violations")).first()[0] == one.where("value > 50 or value < 0").count()
    assert spark.table("stream_missing").agg(F.sum("rows")).first()[0] == one.count()


def test_segments_beyond_a_thousand_keep_their_statistic(spark):
    rows = [(f"s{i}", float(i % 7 + k)) for i in range(1200) for k in range(2)] + [("base", float(k)) for k in range(10)]
    got = {r.segment: r.ks for r in drift.ks_by_segment(spark.createDataFrame(rows, "segment string, value double"), "value", "segment").collect()}
    assert len(got) == 1200 and all(v is not None for v in got.values())
    base = [float(k) for k in range(10)]
    for i in (0, 3, 6, 1199):
        own = [float(i % 7 + k) for k in range(2)]
        want = max(abs(sum(x <= v for x in base) / 10 - sum(x <= v for x in own) / 2) for v in [*base, *own])
        assert abs(got[f"s{i}"] - want) < 1e-12


def test_lineage_of_any_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(45)] + [(3, 9)], "source int, target int")
    got = {r.node: r.distance for r in rollup.lineage(edges, spark.createDataFrame([(0,)], "node int"), gather=10).collect()}
    assert got == {i: i if i < 9 else i - 5 for i in range(46)}


def test_all_suppressed_claims_are_listed(spark):
    rows = [(1, "v", f"e{i:03d}", "APPLIED_TAG", semantics.PRECEDENCE[i % len(semantics.PRECEDENCE)]) for i in range(130)]
    r = semantics.resolve(spark.createDataFrame(rows, "id int, variable string, entry string, status string, tag string"), ["id"]).first()
    assert r.claims == 130 and len(r.suppressed.split(",")) == 129


def test_names_without_a_common_beginning_meet(spark):
    d = spark.createDataFrame([("t", "xcustomer_key", 0)], "table string, name string, position int")
    c = spark.createDataFrame([("t", "customer_key", "bigint")], "table string, column string, dtype string")
    assert [(r["column"], r.kind) for r in matching.dictionary_mapping(d, c).collect()] == [("customer_key", "suggested")]


def test_row_ids_tell_null_parts(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, "a"), ("", "a"), ("a", "")], "x string, y string")
    assert rollup.row_ids(df, ["x", "y"], "s").select("row_id").distinct().count() == 4
    df.write.parquet(str(tmp_path / "t"))
    own = lambda: {(r.x, r.y): r.row_id for r in rollup.ordinal_row_ids(spark.read.parquet(str(tmp_path / "t")), "s1", "r1", "t").collect()}
    assert len(set(own().values())) == 4 and own() == own()


def test_percentiles_by_definition(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(f"g{i % 3}", float(x)) for i, x in enumerate(rng.integers(0, 40, 500) / 4)] + [("g0", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for r in percentiles(df, {"x": F.col("x")}, shares, ["g"]).collect():
        assert np.allclose(r.q, np.quantile([x for g, x in rows if g == r.g and x is not None], shares))
    assert percentiles(df.where("x is null"), {"x": F.col("x")}, shares).count() == 0


@pytest.mark.parametrize(("text", "day"), [("2020-02-03", "2020-02-03"), ("2020/02/03", "2020-02-03"), ("03/02/2020", "2020-02-03"), ("03-02-2020", "2020-02-03"), ("20200203", "2020-02-03"), ("2020-02-03 04:05:06", "2020-02-03"), ("03 Feb 2020", "2020-02-03"), ("2020-13-03", None), ("x", None), ("", None)])
def test_dates_of_every_format(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(values_date(F.col("t")).cast("string").alias("d")).first().d
    assert got == day


@pytest.mark.parametrize("trend", sorted(association.TRENDS))
def test_optimal_bins_are_the_best_of_all_cuts(spark, trend):
    import itertools
    import math
    import random

    dice = random.Random(trend)
    cells = [("x", i, 40 + dice.randrange(60), dice.randrange(1, 39)) for i in range(9)]
    total, events = sum(c[2] for c in cells), sum(c[3] for c in cells)

    def judged(cuts):
        bins = [(sum(c[2] for c in cells[a:b]), sum(c[3] for c in cells[a:b])) for a, b in zip(cuts, cuts[1:])]
        rates = [s / n for n, s in bins]
        steps = [b - a for a, b in zip(rates, rates[1:])]
        signs = [k for k, _ in itertools.groupby(1 if d > 0 else -1 for d in steps)]
        fits = tuple(signs) == association.TRENDS[trend] or (len(signs) == 1 and signs[0] in association.TRENDS[trend])
        if not fits or any(abs(d) < 0.01 for d in steps) or any(n < 0.05 * total or s < 20 or n - s < 20 for n, s in bins):
            return None
        share = [((s + 0.5) / (events + 2.5), (n - s + 0.5) / (total - events + 2.5)) for n, s in bins]
        return sum((b - a) * math.log(b / a) for a, b in share)

    found = [(judged((0, *inner, 9)), (0, *inner, 9)) for k in range(1, 5) for inner in itertools.combinations(range(1, 9), k)]
    want = max((f for f in found if f[0] is not None), default=None)
    got = association.optimal_coarse(spark.createDataFrame(cells, "feature string, position int, n bigint, s bigint"), min_events=20, min_difference=0.01, trends=(trend,)).orderBy("position").collect()
    if want is None:
        assert got[0].trend == "none" and len({r.coarse for r in got}) == 2
    else:
        assert got[0].trend == trend and abs(got[0].objective - want[0]) < 1e-9
        assert [r.coarse for r in got] == [sum(c <= i for c in want[1][1:-1]) for i in range(9)]


def test_quick_mode_adapts_to_the_cells():
    assert association.quick_limits(2, 10) == (4, 2)
    assert association.quick_limits(100, 10) == (20, 6)
    assert association.quick_limits(10_000, 10, continuous=True) == (16, 5)


def test_optimal_bins_fall_back(spark):
    flat = spark.createDataFrame([("x", i, 10, 5) for i in range(4)] + [("y", 0, 10, 5)], "feature string, position int, n bigint, s bigint")
    got = {(r.feature, r.position): (r.coarse, r.trend) for r in association.optimal_coarse(flat).collect()}
    assert [got["x", i][0] for i in range(4)] == [0, 0, 1, 1] and got["y", 0] == (0, "none")


def test_dictionary_claims_in_file_order(spark):
    d = spark.createDataFrame([("t", "Loan Amt", 0), ("t", "loan_amount", 1), ("t", "LOAN-AMOUNT", 2), ("t", "qqq", 3)], "table string, name string, position int")
    c = spark.createDataFrame([("t", "loan_amount", "x"), ("t", "loan_id", "x")], "table string, column string, logical_type string")
    got = {r.name: (r["column"], r.kind) for r in matching.dictionary_mapping(d, c).collect()}
    assert got == {"Loan Amt": ("loan_amount", "suggested"), "loan_amount": (None, "below_floor"), "LOAN-AMOUNT": (None, "below_floor"), "qqq": (None, "below_floor")}
    score = {r.name: r.score for r in matching.dictionary_mapping(d, c).collect()}
    assert abs(score["Loan Amt"] - 16 / 19) < 1e-12 and score["qqq"] is None


def test_matches_by_alias_words_and_none(spark):
    base = spark.createDataFrame([("dti", "debt to income ratio"), ("ltv", "loan to value ratio"), ("age", "age of the customer")], "entry string, text string")
    names = spark.createDataFrame([("Debt-Income", "x"), ("x1", "ratio of debt to income"), ("x2", "qwerty"), ("x3", "value of a loan to")], "name string, description string")
    alias = spark.createDataFrame([("debt income", "dti"), ("both", "dti"), ("both", "ltv")], "alias string, entry string")
    ranked = matching.ranked_matches(names, base, aliases_=alias).collect()
    first = {r.name: (r.entry, r.status) for r in ranked if r.position in (None, 1)}
    assert first == {"Debt-Income": ("dti", "exact_match"), "x1": ("dti", "candidate_match"), "x2": (None, "no_match"), "x3": ("ltv", "candidate_match")}
    weight = {w: math.log(4 / (n + 1)) + 1 for w, n in {"debt": 1, "to": 2, "income": 1, "ratio": 2, "of": 1, "debt to": 1, "to income": 1, "income ratio": 1}.items()}
    size = lambda words: math.sqrt(sum(weight[w] ** 2 for w in words))
    q, e = ["ratio", "of", "debt", "to", "income", "debt to", "to income"], ["debt", "to", "income", "ratio", "debt to", "to income", "income ratio"]
    want = 0.5 * 4 / 5 + 0.5 * sum(weight[w] ** 2 for w in set(q) & set(e)) / (size(q) * size(e))
    assert abs(next(r.score for r in ranked if (r.name, r.entry) == ("x1", "dti")) - want) < 1e-12
    truth = spark.createDataFrame([("Debt-Income", "dti", "a"), ("x1", "dti", "a"), ("x2", "age", "b"), ("x3", "dti", "b")], "name string, expected string, category string")
    got = {r.category: (r.cases, r.top1, r.top3) for r in matching.accuracy(spark.createDataFrame(ranked), truth).collect()}
    assert got == {"a": (2, 1.0, 1.0), "b": (2, 0.0, 0.5), "overall": (4, 0.5, 0.75)}


def test_report_policies(spark):
    df = spark.createDataFrame([("f1", "north"), (None, None)], "facility string, segment string")
    report = lambda policy: rollup.external_report(df, {"facility": "FAC"}, "segment", policy, "s").collect()
    kept, hidden, gone = report("retain"), report("mask"), report("omit")
    assert kept[0].segment == "north" and hidden[0].segment.startswith("SEG-") and gone[0].segment is None
    assert kept[0].facility == hidden[0].facility != "f1" and kept[1].facility is None and hidden[1].segment is None
    with pytest.raises(ValueError):
        rollup.external_report(df, {"facility": "FAC"}, "segment", "mask", "")


def test_scope_plan_needs_one_column_a_role(spark):
    entries = spark.createDataFrame([("e1", ["a"], []), ("e2", ["a", "b"], ["d"]), ("e3", ["c"], ["x"]), ("e4", [], [])], "entry string, roles array<string>, declarations array<string>")
    bound = spark.createDataFrame([("a", "c1"), ("a", "c1"), ("b", "c2"), ("b", "c3")], "role string, column string")
    got = {r[0]: tuple(r)[1:] for r in semantics.scope_plan(entries, bound, spark.createDataFrame([("d",)], "name string")).collect()}
    ready = ("READY_FOR_EVALUATION", "", "")
    assert got == {"e1": ready, "e2": ("UNSCOPED", "b", ""), "e3": ("UNSCOPED", "c", "x"), "e4": ready}


def test_panel_with_a_wild_date_and_an_entity_of_many_periods(spark):
    rows = [("A", f"2025-{m:02d}") for m in (1, 2, 5)] + [("B", "2025-02"), ("B", "9025-02"), ("C", "2025-05"), ("C", "2025-05")]
    p = panel.prepared(spark.createDataFrame(rows, "e string, p string"), "e", "p", "month")
    one = panel.continuity(p).first()
    want = {("A", m) for m in range(1, 6)} | {("B", m) for m in range(2, 7000 * 12 + 3)} | {("C", 5)}
    assert (one.required, one.received, one.entities_with_gaps) == (len(want), 6, 2)
    assert one.periods_with_gaps == 2 + 1 + 7000 * 12 - 4  # March, April, A's May (B lacks it), and B's until 9025-01
    per = {r.period: (r.required, r.received) for r in panel.period_coverage(p, "month").collect()}
    assert (per["2025-01"], per["2025-02"], per["2025-05"], per["9025-02"]) == ((1, 1), (2, 2), (3, 2), (1, 1)) and len(per) == 7000 * 12 + 2
    assert panel.missing_pairs(p).count() == one.missing
    empty = panel.continuity(p.where("e = 'none'")).first()
    assert (empty.required, empty.received, empty.periods_with_gaps, empty.coverage) == (0, 0, 0, None)


def test_later_event_by_stretches_equals_all_pairs(spark):
    import random

    r = random.Random(3)
    days = lambda n: [(r.choice("ab"), f"20{r.randint(10, 13)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}") for _ in range(n)]
    a, b = (spark.createDataFrame(days(n), "e string, d string").selectExpr("e", "date(d) AS d") for n in (60, 40))
    for months in (1, 5, 12):
        got = sorted(map(tuple, panel.later_event(a, b, "e", "d", months).collect()))
        a.createOrReplaceTempView("_a"), b.createOrReplaceTempView("_b")
        want = spark.sql(f"SELECT * FROM _a WHERE EXISTS (SELECT 1 FROM _b WHERE _b.e = _a.e AND _b.d > _a.d AND _b.d <= add_months(_a.d, {months}))")
        assert got == sorted(map(tuple, want.collect())) and got


def test_concordance_equals_all_pairs(spark):
    import random

    r = random.Random(5)
    for levels in (1, 2, 9, 200):
        rows = [(float(r.randint(1, levels)), r.randint(0, 6)) for _ in range(150)] + [(None, 1), (1.0, None)]
        whole = [x for x in rows if None not in x]
        scores = [0.5 if a[0] == b[0] else float(a[0] > b[0]) for a in whole for b in whole if a[1] > b[1]]
        want = sum(scores) / len(scores)
        assert abs(association.concordance(spark.createDataFrame(rows, "s double, t int"), "s", "t").first().auc - max(want, 1 - want)) < 1e-9


def test_categories_merge_by_least_loss(spark):
    import math

    counts = {"a": (50, 2, 3), "b": (10, 40, 1), "c": (48, 3, 3), "d": (9, 35, 6), "e": (1, 1, 30)}
    rows = [("f", v, str(i), k) for v, ks in counts.items() for i, k in enumerate(ks)]
    got = {r.value: r.grp for r in association.merge_categories(spark.createDataFrame(rows, "feature string, value string, class_ string, k long"), 3).collect()}
    cost = lambda ks: -sum(k * math.log(k / sum(ks)) for k in ks if k)
    groups = [((v,), ks) for v, ks in counts.items()]
    while len(groups) > 3:
        tried = [(cost([p + q for p, q in zip(a[1], b[1])]) - cost(a[1]) - cost(b[1]), a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]]
        _, a, b = min(tried, key=lambda t: t[0])
        groups = [g for g in groups if g not in (a, b)] + [(a[0] + b[0], tuple(p + q for p, q in zip(a[1], b[1])))]
    assert {frozenset(v for v in got if got[v] == n) for n in got.values()} == {frozenset(g[0]) for g in groups}
    many = spark.createDataFrame([("f", f"v{i}", "0", 1) for i in range(association.CELLS + 1)], "feature string, value string, class_ string, k long")
    with pytest.raises(Exception, match="categories"):
        association.merge_categories(many, 3).collect()
