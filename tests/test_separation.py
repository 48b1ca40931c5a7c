"""Trees, buckets and the scan for leakage of single features."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import separation as sp

FRAME = "feature string, state string, label string, low double, high double, n bigint, v array<double>, levels bigint"


def best_partition(cells, leaves):
    """Largest sum of squares over partitions of four cells that a best-first tree of full depth can reach by single cuts: by trying
    every sequence of cuts, the best one first."""
    values = [c[1] for c in cells]

    def cuts(part):
        for x in sorted({values[i] for i in part})[:-1]:
            yield [i for i in part if values[i] <= x], [i for i in part if values[i] > x]
        for s in sorted({cells[i][0] for i in part} - {"regular"}):
            yield [i for i in part if cells[i][0] != s], [i for i in part if cells[i][0] == s]

    def gain(a, b):
        sq = lambda p: sum(cells[i][3] for i in p) ** 2 / sum(cells[i][2] for i in p)
        return sq(a) + sq(b) - sq(a + b)

    parts = [list(range(len(cells)))]
    while len(parts) < leaves:
        tried = [(gain(a, b), p, a, b) for p in parts for a, b in cuts(p) if a and b and min(sum(cells[i][2] for i in q) for q in (a, b)) >= 50]
        tried = [t for t in tried if t[0] > 1e-9]
        if not tried:
            break
        _, p, a, b = max(tried, key=lambda t: t[0])
        parts.remove(p)
        parts += [a, b]
    return {frozenset(p) for p in parts}


def test_trees_of_four_cells_by_all_cuts(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(60):
        kinds = ["regular", "regular", "regular" if k % 3 else "special:9", "missing" if k % 2 else "regular"]
        x, cells = 0.0, []
        for s in kinds:
            x += 1
            n = int(rng.integers(20, 200))
            cells.append((s, x, n, float(rng.integers(0, n + 1))))
        regular = sorted(c[1] for c in cells if c[0] == "regular")
        weights = [c[2] for c in cells if c[0] == "regular"]
        spread = np.repeat(regular, weights)
        filled = [(s, v if s == "regular" else float(np.median(spread)), n, e) for s, v, n, e in cells]
        levels = sum(s != "missing" for s in kinds)
        rows += [(f"f{k}", s, None, v if s == "regular" else None, v if s == "regular" else None, n, [e], levels) for s, v, n, e in cells]
        want[f"f{k}"] = ({frozenset(filled[i][3] * 1000 + filled[i][2] for i in p) for p in best_partition(filled, 4)}, cells)
    got = {}
    for r in sp.grown(spark.createDataFrame(rows, FRAME), {"t": (4, 3, 0.01)}).collect():
        got.setdefault(r.feature, {}).setdefault(r.leaf, set()).add(r.v[0] * 1000 + r.n)
    assert {f: {frozenset(x) for x in leaves.values()} for f, leaves in got.items()} == {f: w[0] for f, w in want.items()}


def test_rules_ends_and_mix(spark):
    rows = [(float(i // 60), 1.0 if i < 300 else 0.0) for i in range(600)] + [(-1.0, 1.0)] * 60 + [(None, 0.0)] * 70
    df = spark.createDataFrame(rows, "x double, y double")
    counts = sp.value_counts(df, ["x"], sp.outcomes_of(F.col("y")), {"x": [-1]})
    leaves = sp.leaf_table(sp.grown(sp.cells(counts), {"t": (8, 4, 0.01)})).collect()
    assert sum(r.n for r in leaves) == 730 and sum(r.v[0] for r in leaves) == 360 and min(r.n for r in leaves) >= 50
    assert sum(r.missing for r in leaves) == 70 and sum(r.special for r in leaves) == 60
    text = {r.rule for r in leaves}
    assert any("x <= 4" in t for t in text) and any("x >= 5" in t for t in text) and any("is special value -1" in t for t in text)
    for r in leaves:  # rules hold for the values of their leaves
        for part in r.rule.split(" and "):
            if part.startswith("x <= ") and r.high is not None:
                assert r.high <= float(part[5:])


def test_limits_adapt_to_the_states(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else 1.0, "a" if i % 3 else "b", float(i % 3 == 0)) for i in range(600)], "x double, c string, y double")
    counts = sp.value_counts(df, ["x", "c"], sp.outcomes_of(F.col("y")))
    got = {r.feature: r for r in sp.tree_separation(counts).collect()}
    for f in "xc":
        assert (got[f].auc, got[f].risk, got[f].leaves, got[f].leaf_cap_reached, got[f].robustness) == (1.0, "high", 2, True, "robust high association")
    flat = spark.createDataFrame([(1.0, float(i % 2)) for i in range(300)], "x double, y double")
    one = sp.tree_separation(sp.value_counts(flat, ["x"], sp.outcomes_of(F.col("y")))).first()
    assert (one.auc, one.risk, one.leaves, one.robustness) == (0.5, "low", 1, "not sensitivity-tested (low initial risk)")


def test_many_values_are_gathered_whole(spark):
    df = spark.createDataFrame([(float(i % 5000), float(i % 5000 >= 2500)) for i in range(20_000)], "x double, y double")
    counts = sp.value_counts(df, ["x"], sp.outcomes_of(F.col("y")))
    got = sp.cells(counts, limit=100).collect()
    assert len(got) <= 100 and sum(r.n for r in got) == 20_000 and all(r.n == 4 * (r.high - r.low + 1) for r in got)
    assert sp.tree_separation(counts).first().auc == 1.0
    with pytest.raises(Exception, match="categories"):
        sp.grown(spark.createDataFrame([("f", "category", f"c{i}", None, None, 60, [1.0], 1001) for i in range(1001)], FRAME), {"t": (2, 1, 0.0)}).collect()


def auc_of(score, y):
    a, b = [s for s, t in zip(score, y) if t], [s for s, t in zip(score, y) if not t]
    x = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in a for q in b) / (len(a) * len(b))
    return max(x, 1 - x)


def test_classes_one_against_the_rest(spark):
    rng = np.random.default_rng(6)
    rows = [(float(x), str(c)) for x, c in zip(np.round(rng.normal(size=300), 1), rng.choice(["a", "b", "c"], 300, p=[0.5, 0.3, 0.2]))] + [(None, "a")] * 20 + [(99.0, "b")] * 30
    counts = sp.value_counts(spark.createDataFrame(rows, "x double, c string"), ["x"], sp.outcomes_of(F.col("c"), ["a", "b", "c"]), {"x": [99]})
    got = sp.percentile_benchmark(counts).first()
    frame = pd.DataFrame(rows, columns=["x", "c"])
    regular = frame.x.notna() & (frame.x != 99)
    frame["b"] = pd.qcut(frame.x[regular], 10, duplicates="drop").astype(str)
    frame.loc[frame.x.isna(), "b"], frame.loc[frame.x == 99, "b"] = "missing", "special"
    aucs = []
    for c in "abc":
        y = frame.c == c
        aucs.append(auc_of(frame.b.map(y.groupby(frame.b).mean()), y))
    weights = [float((frame.c == c).sum()) for c in "abc"]
    assert abs(got.auc - max(aucs)) < 1e-9 and abs(got.macro - np.mean(aucs)) < 1e-9 and abs(got.weighted - np.average(aucs, weights=weights)) < 1e-9


def fisher(hits, drawn, events, total):
    return sum(math.comb(events, k) * math.comb(total - events, drawn - k) for k in range(hits, min(drawn, events) + 1)) / math.comb(total, drawn)


def scanned(rows, feature_kind):
    """Every candidate by rows. rows: (value, y)."""
    total, events = len(rows), sum(y for _, y in rows)
    found = {}
    values = sorted({v for v, _ in rows if v is not None})
    tests = {}
    if feature_kind == "numeric":
        for v in values[:-1]:
            tests["lower", v] = [y for x, y in rows if x is not None and x <= v]
            tests["upper", v] = [y for x, y in rows if x is not None and x > v]
    if feature_kind != "numeric" or len(values) <= 20:
        for v in values:
            tests["exact" if feature_kind == "numeric" else "category", v] = [y for x, y in rows if x == v]
    tests["missing", None] = [y for x, y in rows if x is None]
    least = max(30, math.ceil(0.001 * total))
    tests = {k: t for k, t in tests.items() if least <= len(t) < total}
    for key, t in tests.items():
        if sum(t) >= 5 and sum(t) / len(t) >= 0.9 and sum(t) / len(t) - events / total >= 0.1:
            found[key] = (len(t), sum(t), sum(t) / events, fisher(sum(t), len(t), events, total))
    return found, len(tests)


@pytest.mark.parametrize("seed", range(4))
def test_scan_against_every_candidate(spark, seed):
    rng = np.random.default_rng(seed)
    n = 500
    levels = [8, 60, 15, 200][seed]
    x = [None if rng.random() < 0.1 else float(rng.integers(0, levels)) for _ in range(n)]
    c = [None if rng.random() < 0.08 else str(rng.choice(list("abcd"))) for _ in range(n)]
    y = [int(rng.random() < (0.97 if (a is None and seed % 2) or (a is not None and a >= 0.8 * levels) or b == "d" else 0.2)) for a, b in zip(x, c)]
    counts = sp.value_counts(spark.createDataFrame(list(zip(x, c, map(float, y))), "x double, c string, y double"), ["x", "c"], sp.outcomes_of(F.col("y")))
    got = {r.feature: r for r in sp.localized(counts).collect()}
    per = {"x": scanned(list(zip(x, y)), "numeric"), "c": scanned(list(zip(c, y)), "text")}
    tests = sum(t for _, t in per.values())
    for f, (found, _) in per.items():
        sure = {k: v for k, v in found.items() if min(1, v[3] * tests) <= 0.01}
        if not sure:
            assert f not in got
            continue
        (kind, value), best = min(sure.items(), key=lambda i: (-i[1][2], i[1][3]))
        assert (got[f].rows, got[f].events) == best[:2] and abs(got[f].p - min(1, best[3] * tests)) < 1e-9
        assert got[f].kind == kind


def test_chance_is_no_leakage(spark):
    rows = [(float(i), 0.0) for i in range(960)] + [(float(i), 1.0) for i in range(960, 1000)]
    found = sp.localized(sp.value_counts(spark.createDataFrame(rows, "x double, y double"), ["x"], sp.outcomes_of(F.col("y")))).collect()
    assert [(r.kind, r.value, r.rows, r.capture) for r in found] == [("upper", 959.0, 40, 1.0)] and found[0].p < 1e-10
    # 31 of 33 events where the rate is 0.8: adjusted for all that is tried, no evidence
    weak = [(1.0 if i < 33 else 0.0, float(i != 5 and i != 6 if i < 33 else i % 5 != 0)) for i in range(500)]
    assert sp.localized(sp.value_counts(spark.createDataFrame(weak, "x double, y double"), ["x"], sp.outcomes_of(F.col("y")))).count() == 0


def test_findings(spark):
    cases = list(itertools.product([None, 0.55, 0.7, 0.95], [None, 0.01, 0.2, 0.6], [False, True]))
    named = [(f"f{i}", *c) for i, c in enumerate(cases)]
    aucs = spark.createDataFrame([(f, a) for f, a, _, _ in named], "feature string, auc double")
    ivs = spark.createDataFrame([(f, v) for f, _, v, _ in named], "feature string, iv double")
    leaks = spark.createDataFrame([(f,) for f, _, _, x in named if x], "feature string")
    got = {r.feature: r for r in sp.separation_table(aucs, ivs, leaks).collect()}
    for f, a, v, x in named:
        leak = x or (a or 0) >= 0.9 or (v or 0) >= 0.5
        poor = (a is not None and a < 0.6) or (v is not None and v < 0.05)
        assert got[f].finding == ("target_leakage" if leak else "poor_discrimination" if poor else None) and got[f].leakage_status == ("candidate" if x else "clear")
    assert {r.leakage_status for r in sp.separation_table(aucs, ivs).collect()} == {"not_available"}


def test_continuous_targets_by_pairs(spark):
    rng = np.random.default_rng(9)
    n = 400
    x = np.round(rng.normal(size=n), 1)
    c = rng.choice(["a", "b", "c"], n)
    y = np.round(2 * x + np.where(c == "a", 3, 0) + rng.normal(size=n), 1)
    missing = rng.random(n) < 0.2
    rows = [(None if m else float(a), str(b), float(t)) for m, a, b, t in zip(missing, x, c, y)]
    df = spark.createDataFrame(rows, "x double, c string, y double")
    got = {r.feature: r for r in sp.continuous_separation(df, ["x", "c"], "y").collect()}
    counts = sp.value_counts(df, ["x", "c"], {"1": F.col("y")})
    leaves = {}
    for r in sp.grown(sp.cells(counts), {"primary": sp.TREES["primary"]}).collect():
        leaves[r.feature, r.label if r.feature == "c" else r.low] = r.leaf
    for f, values in (("x", [None if m else float(a) for m, a in zip(missing, x)]), ("c", c.tolist())):
        at = [leaves[f, v] for v in values]
        mean = {k: np.mean([t for t, a in zip(y, at) if a == k]) for k in set(at)}
        score = [mean[a] for a in at]
        pairs = [(1.0 if score[i] > score[j] else 0.5 if score[i] == score[j] else 0.0) for i in range(n) for j in range(n) if y[i] > y[j]]
        want = sum(pairs) / len(pairs)
        assert abs(got[f].auc - max(want, 1 - want)) < 1e-9
    flat = sp.continuous_separation(df.withColumn("one", F.lit(1.0)), ["one"], "y").first()
    assert (flat.auc, flat.risk, flat.leaves) == (0.5, "low", 1)
