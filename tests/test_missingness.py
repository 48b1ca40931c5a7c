"""Missing values, verdicts on columns, and the search for drivers."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import drivers, gates
from plumbline.operators import missingness as ms
from plumbline.operators.drift import governed_psi


def test_texts_are_compared_in_their_compatibility_form(spark):
    rows = [(" ",), ("　 ",), ("",), ("ＮＡ",), (" NA",), ("N A",), ("na",), (None,), ("ﬁ",), ("\x1f",)]
    df = spark.createDataFrame([(a, float("nan") if i == 2 else None if i == 3 else -9.0 if i < 2 else 1.0) for i, (a,) in enumerate(rows)], "t string, x double")
    got = {r["column"]: r for r in ms.rates(df, ["t", "x"], {"t": ["NA", "fi"], "x": ["-9", "z"]}).collect()}
    assert (got["t"].nulls, got["t"].blanks, got["t"].coded) == (1, 4, 3)
    assert (got["x"].nulls, got["x"].blanks, got["x"].coded, got["x"].not_null) == (2, 0, 2, False)
    assert ms.parse_codes(" a, ,b ,-9 ") == ["a", "b", "-9"] and ms.parse_codes(None) == []


def test_breaks_need_extreme_shares(spark):
    rng = random.Random(1)
    rows = [(f"2020-{m:02d}", i, m) for m in range(1, 13) for i in range(40)]
    df = spark.createDataFrame([(p, None if m < 5 and i > 0 else 1, None if m < 5 and i > 4 else 1, 1 if m < 9 else None, None if rng.random() < 0.5 else 1) for p, i, m in rows] + [(None, 1, 1, 1, 1)] * 9, "p string, most int, many int, ends int, some int")
    got = {r["column"]: (r.period, round(r.before, 3), round(r.after, 3)) for r in ms.structural_breaks(df, {c: F.col(c).isNull() for c in ("most", "many", "ends", "some")}, F.col("p")).collect()}
    assert got == {"most": ("2020-05", 0.975, 0.0), "ends": ("2020-09", 0.0, 1.0)}  # 35 of 40 are too few


def planted(spark, n=3000):
    rows = [(i, "abcde"[i % 5], "xy"[i // 5 % 2], i * 7 % 100) for i in range(n)]
    return spark.createDataFrame(rows, "i int, g string, h string, z int")


def verdict(df, column, predictors=None, **more):
    return {r["column"]: r for r in gates.column_verdicts(df, {column: "unmarked"}, predictors, **more).collect()}[column]


def test_patterns_need_pure_leaves(spark):
    df = planted(spark)
    half = verdict(df.withColumn("t", F.when(~((F.col("g") == "a") & (F.col("i") % 10 < 5)), 1)), "t", ["g", "h"])
    assert (half.verdict, half.subtype, half.rules) in [("b", "tree_strong", ["g = a and h = x"]), ("b", "tree_strong", ["h <> y and g = a"])]  # i % 10 < 5 is h = x
    noisy = verdict(df.withColumn("t", F.when(~((F.col("g") == "a") & (F.crc32(F.col("i").cast("string").cast("binary")) % 2 == 0)), 1)), "t", ["g", "h"])
    assert (noisy.verdict, noisy.subtype, noisy.rules) == ("c", "no_explainable_pattern", [])
    whole = verdict(df.withColumn("t", F.when(F.col("g") != "a", 1)), "t", ["g", "h"])
    assert (whole.verdict, whole.subtype, whole.coverage, whole.precision, whole.agrees, whole.max_lift) == ("b", "tree_strong", 1.0, 1.0, True, 5.0)
    narrow = verdict(df.withColumn("t", F.when(~((F.col("g") == "a") & (F.col("h") == "x") | (F.crc32(F.col("i").cast("string").cast("binary")) % 3 == 0)), 1)), "t", ["g", "h"])
    assert (narrow.verdict, narrow.subtype, narrow.confidence) == ("b", "tree_weak", "low") and narrow.coverage < 0.4 and "coverage" in narrow.reason


def test_importance_must_agree_with_the_paths(spark):
    # z lowers the rate most of all, but only within its low side does h make a small pure leaf
    encoded = gates.Encoded(spark.createDataFrame([(1.0 if p else 0.0, 1.0 if q else 0.0, y) for p, q, y, n in [(1, 0, 0.0, 900), (0, 0, 0.0, 150), (0, 0, 1.0, 550), (0, 1, 1.0, 100)] for _ in range(n)], "f0 double, f1 double, y double"), ["p", "q"], ["p", "q"])
    tree = gates.grow(encoded, F.col("y"), [0, 1], 30)
    pure = [x for x in tree.leaves if x.pattern]
    assert pure and tree.agrees and abs(sum(tree.importance.values()) - 1) < 1e-9
    on_paths = {s for x in pure for s in x.sources}
    assert max(tree.importance, key=tree.importance.get) in on_paths
    shown = gates.Pattern(tree.leaves, 0.9, 1.0, False, tree.importance)
    assert shown.verdict == ("b", "tree_weak") and gates.Pattern(tree.leaves, 0.9, 1.0, True, {}).verdict == ("b", "tree_strong")
    # by hand: decrease of squared error of each cut, summed to its column
    assert tree.importance["p"] > tree.importance["q"] > 0


def test_block_mates_explain_nothing(spark):
    df = planted(spark).withColumns({"t": F.when(F.col("g") != "a", 1), "twin": F.when(F.col("g") != "a", F.col("z"))})
    got = verdict(df, "t", ["twin"])
    assert (got.verdict, got.subtype) == ("d", "untestable") and "block" in got.reason
    with_z = verdict(df, "t", ["twin", "g"])
    assert with_z.subtype == "tree_strong" and with_z.features == ["g"]


def test_gates_in_order(spark):
    df = planted(spark).withColumns({"none": F.lit(None).cast("int"), "few": F.when(F.col("i") > 40, 1), "full": F.lit(1), "late": F.when(F.col("i") >= 1500, 1), "p": F.lpad((F.col("i") / 500).cast("int").cast("string"), 2, "0")})
    roles = {"none": "optional", "few": "identifier", "full": "mandatory", "late": "unmarked"}
    got = {r["column"]: (r.verdict, r.subtype) for r in gates.column_verdicts(df, roles, ["g", "h"], "p").collect()}
    assert got == {"none": ("b", "entirely_empty"), "few": ("d", "untestable"), "full": ("a", "below_threshold"), "late": ("b", "lineage_break")}
    assert gates.column_verdicts(df.where("false"), roles, ["g", "h"], "p").where("verdict <> 'a'").count() == 0


def fit(spark, rows):
    columns = "column string, role string, share double, tolerance double, verdict string, subtype string, coverage double, max_lift double, features array<string>, block string"
    return gates.fitness(spark.createDataFrame(rows, columns)).first()


def test_fitness(spark):
    fine = [(f"c{i}", "unmarked", 0.0, 0.05, "a", "below_threshold", None, None, [], f"B{i}") for i in range(8)]
    assert fit(spark, fine).status == "ready"
    strong = ("s", "unmarked", 0.3, 0.05, "b", "tree_strong", 0.9, 3.0, ["g", "h"], "B0")
    got = fit(spark, [*fine, strong])
    assert (got.status, got.breached, got.shared_blocks, got.risk_fields) == ("conditional", 1, 1, ["s"]) and [(f.feature, f.findings, f.coverage, f.lift) for f in got.top_features] == [("g", 1, 0.9, 3.0), ("h", 1, 0.9, 3.0)]
    for row in [("k", "identifier", 0.01, 0.0, "c", "x", None, None, [], "B9"), ("k", "unmarked", 0.1, 0.05, "d", "x", None, None, [], "B9")]:
        assert fit(spark, [*fine, row]).status == "not_ready"
    assert fit(spark, [*fine[:4], *[("n", "unmarked", 0.1, 0.05, "c", "x", None, None, [], "B9")] * 2]).status == "not_ready"
    assert fit(spark, [*fine[:1], strong, strong]).status == "not_ready"


def test_universe_goes_by_names(spark):
    names = ["debt", "id", "user_id", "ids", "measure", "debt_missing", "is_missing_debt", "index_a", "year", *[f"x{i}" for i in range(60)]]
    got = {r["column"]: r.reason for r in drivers.universe(spark.createDataFrame([], ", ".join(f"{n} int" for n in names)), "debt", "year", ["measure", "gone"]).collect()}
    assert (got["debt"], got["id"], got["user_id"], got["ids"], got["debt_missing"], got["is_missing_debt"], got["index_a"], got["year"], got["gone"]) == ("affected", "identifier", "identifier", None, "indicator", "indicator", "identifier", "split", "absent")
    assert sum(r is None for r in got.values()) == drivers.PREDICTORS and got["measure"] is None and got["x59"] == "beyond the limit" and len(got) == 70


def test_universe_counts_all_rows(spark):
    df = spark.range(200).select((F.col("id") * 2).alias("debt"), F.lit(1).alias("one"), F.when(F.col("id") == 199, 1).alias("last"), (F.col("id") == 199).cast("int").alias("late"), F.col("id").alias("measure"))
    got = {r["column"]: (r.used, r.reason, r.distinct) for r in drivers.surveyed(df, "debt").collect()}
    assert got == {"debt": (False, "affected", 200), "one": (False, "constant", 1), "last": (False, "constant", 1), "late": (True, None, 2), "measure": (True, None, 200)}
    assert {r.distinct for r in drivers.surveyed(df.where("false"), "debt").collect()} == {0}


def test_classes_are_dealt_to_the_row(spark):
    df = spark.range(1003).select(F.col("id").alias("uid"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    got = {r.y: (r.n, r.k) for r in drivers.dealt(df).groupBy("y").agg(F.count("*").alias("n"), F.count_if("learn").alias("k")).collect()}
    assert got == {1: (144, 101), 0: (859, 601)}


def account_frame(spark):
    rows = [(2011 if i < 200 else 2015, 100.0 + i, "older" if i < 180 or 200 <= i < 220 else "recent", i % 4, f"acct-{i}") for i in range(400)]
    return spark.createDataFrame(rows, "year int, debt double, origination_band string, noise int, account_id string")


def test_a_planted_driver_is_found(spark):
    from plumbline.operators.population import split

    df = split(account_frame(spark), "year", {"operator": "in", "values": ["2011"]}, "baseline")
    used = [r["column"] for r in drivers.universe(df.drop("population"), "debt", "year").where("used").collect()]
    assert used == ["origination_band", "noise"]
    rows, y = drivers.target(df, "population_membership", "debt")
    found = drivers.search(rows, y, used)
    assert found.importance.first().feature == "origination_band"
    m = found.metrics.first()
    assert m.auc > 0.8 and m.balanced_accuracy > 0.8 and m.leading == "origination_band" and m.learned == 280
    top = found.rules.first()
    assert "origination_band" in top.rule and top.lift > 1 and top.rows <= 120
    assert {r.segment: r.rows for r in found.segments.collect()} == {"origination_band regular": 400}
    with pytest.raises(ValueError, match="20 rows"):
        drivers.search(df.limit(30), (F.col("noise") == 0).cast("int"), ["noise"])


def test_scores_by_hand(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0.1, 0.4, 0.6, 0.9]), float(rng.random() < 0.4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, y double")
    p, q = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert abs(drivers.score_auc(df).first().auc - sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in p for b in q) / len(p) / len(q)) < 1e-9
    assert abs(drivers.balanced_accuracy(df).first()[0] - (sum(s >= 0.5 for s in p) / len(p) + sum(s < 0.5 for s in q) / len(q)) / 2) < 1e-9


def test_targets_and_encodings(spark):
    rows = [(i, None if i % 10 == 0 else -1.0 if i % 10 == 1 else float(i), f"2020Q{i % 4 + 1}", f"2021-0{i % 9 + 1}-01", f"t{i % 30}", f"u{i}", "baseline" if i < 60 else "current" if i < 120 else None) for i in range(130)]
    df = spark.createDataFrame(rows, "i int, x double, quarter string, open_date string, kind string, note string, population string")
    kept, y = drivers.target(df, "missingness", "x", [-1])
    assert kept.count() == 120 and kept.agg(F.sum(y)).first()[0] == 24
    bins = {"feature": "x", "edges": [50.0]}
    parts = governed_psi(df, [bins]).select("bin", "contribution")
    assert drivers.dominant_bin(parts) in ("B0", "B1")
    kept, y = drivers.target(df, "psi_bin_membership", "x", bins=bins, target_bin="MISSING")
    assert kept.agg(F.sum(y)).first()[0] == 12
    for bad in ({"mode": "other"}, {"mode": "psi_bin_membership"}):
        with pytest.raises(ValueError):
            drivers.target(df, affected="x", **bad)
    found = drivers.encode(df, F.lit(1), ["x", "quarter", "open_date", "kind", "note"], {"x": [-1]})
    assert found.rejected == {"kind": "30 values", "note": "130 values"}
    assert found.names == ["x missing", "x special: -1", "x", "quarter missing", "quarter year", "quarter quarter", "open_date missing", "open_date year", "open_date quarter"]
    one = found.rows.join(df.select(F.col("i")), F.lit(True)).where("false").columns  # columns stay apart
    assert "y" in one
    values = {(r.f0, r.f1): r.f2 for r in found.rows.collect()}
    assert values[1.0, 0.0] == values[0.0, 1.0]  # both have the median of the regular values
    more = drivers.encode(spark.createDataFrame([(f"c{i % 25}",) for i in range(500)], "kind string"), F.lit(1), ["kind"])
    assert len(more.names) == 22 and more.names[-1] == "kind = <other>"
    wide = more.rows.select(*[F.sum(f"f{i}").alias(f"s{i}") for i in range(22)]).first()
    assert sum(wide) == 500 and wide.s21 == 100


def test_ascii_columns_start_no_python(spark):
    from plumbline.operators.missingness import ascii_columns, missing_mask

    df = spark.createDataFrame([(" a", "Ａ"), (None, "b"), (" ", None)], "x string, y string")
    assert ascii_columns(df, ["x", "y"]) == {"x"}
    plan = lambda c, a: df.select(missing_mask(df, c, ascii_only=a).alias("m"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" in plan("x", False) and "Python" not in plan("x", True)
    assert [r.m for r in df.select(missing_mask(df, "x", ascii_only=True).alias("m")).collect()] == [False, True, True]
