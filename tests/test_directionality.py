"""Direction of features against a target."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import directionality as dy


def assessed(spark, data: dict, target="t", kind="continuous", **more):
    found = dy.assess(spark.createDataFrame(pd.DataFrame(data)), [c for c in data if c not in (target, "g")], target, kind, **more).collect()
    return {(r.segment, r.feature): r for r in found}


def test_movements_count_in_deviations_of_the_target(spark):
    rng = np.random.default_rng(1)
    x = np.arange(400.0)
    noise = np.concatenate([rng.permutation(np.tile([-1000.0, 1000.0], 40)) for _ in range(5)])  # no bin's mean differs
    got = assessed(spark, {"x": x, "t": noise + (x > 300)})[None, "x"]
    assert (got.shape, got.direction, got.strength) == ("FLAT", "WEAK_OR_NO_RELATIONSHIP", "WEAK") and got.bins[4].target_mean > got.bins[0].target_mean
    rise = assessed(spark, {"x": x, "t": x / 40_000})[None, "x"]
    assert (rise.shape, rise.direction, rise.strength) == ("INCREASING", "INCREASING", "STRONG")
    few = assessed(spark, {"x": x % 2, "t": x})[None, "x"]
    assert few.shape == "UNAVAILABLE" and len(few.bins) == 1


@pytest.mark.parametrize(
    ("votes", "shape", "want"),
    [
        ("IID", "DECREASING", ("INCREASING", "MODERATE")), ("III", "INCREASING", ("INCREASING", "STRONG")), ("DDF", "FLAT", ("DECREASING", "MODERATE")), ("IDF", "FLAT", ("CONFLICTING_EVIDENCE", "NOT_APPLICABLE")),
        ("IFF", "FLAT", ("WEAK_OR_NO_RELATIONSHIP", "WEAK")), ("FFF", "FLAT", ("WEAK_OR_NO_RELATIONSHIP", "WEAK")), ("III", "NON_MONOTONIC", ("NON_MONOTONIC", "NOT_APPLICABLE")), ("DDD", "DECREASING", ("DECREASING", "STRONG")),
    ],
)
def test_votes(spark, votes, shape, want):
    names = {"I": "INCREASING", "D": "DECREASING", "F": "FLAT"}
    row = spark.range(1).select(*(c.alias(n) for n, c in zip(("d", "s"), dy.consensus([F.lit(names[v]) for v in votes], F.lit(shape))))).first()
    assert (row.d, row.s) == want


def by_rows(x, y):
    """Shape and movement by rows: quantile bins of pandas."""
    frame = pd.DataFrame({"x": x, "y": y})
    means = frame.groupby(pd.qcut(frame.x, 5, duplicates="drop"), observed=True).y.mean().to_numpy()
    sd = frame.y.std(ddof=0)
    if len(means) < 3:
        return "UNAVAILABLE", None
    turn = max(means[1:-1].max() - max(means[0], means[-1]), min(means[0], means[-1]) - means[1:-1].min()) / sd
    move = (means[-1] - means[0]) / sd
    trend = np.polyfit(range(len(means)), means, 1)[0]
    return ("NON_MONOTONIC", turn) if turn >= 0.1 else ("FLAT" if abs(move) < 0.1 else "INCREASING" if trend > 0 else "DECREASING", move)


def test_every_feature_equals_its_own_analysis(spark):
    rng = np.random.default_rng(8)
    n = 300
    x = np.linspace(-2, 2, n)
    data = {"u": x, "ties": np.round(x), "noise": np.round(rng.normal(size=n), 1), "up": x + rng.normal(size=n), "heavy": np.where(rng.random(n) < 0.7, 0.0, x), "g": np.where(np.arange(n) % 3 == 0, "b", "a")}
    data["t"] = np.round(x**2 + 0.3 * data["up"] + rng.normal(0, 0.1, n), 2)
    got = assessed(spark, data, accepted=F.col("g") == "b")
    for segment, rows in ((None, slice(None)), ("accepted", slice(0, n, 3))):
        for f in ("u", "ties", "noise", "up", "heavy"):
            r, a, b = got[segment, f], pd.Series(data[f][rows]), pd.Series(data["t"][rows])
            assert r.n_input == r.n_paired == len(a)
            assert abs(r.r - a.corr(b)) < 1e-9 and abs(r.slope - r.r) < 1e-9 and abs(r.rho - a.rank().corr(b.rank())) < 1e-9
            shape, value = by_rows(a, b)
            assert r.shape == shape and (value is None or abs(r.movement - value) < 1e-9), (segment, f)
            line = np.polyfit(a, b, 1)
            assert [round(p.x, 6) for p in r.curve] == [round(a.min(), 6), round(a.max(), 6)] and abs(r.curve[1].y - np.polyval(line, a.max())) < 1e-6
    assert got[None, "u"].direction == "NON_MONOTONIC"


def test_logistic_fits_of_all_features_equal_newton_on_rows(spark):
    rng = np.random.default_rng(7)
    n = 400
    data = {"a": np.round(rng.normal(3, 2, n), 1), "b": np.round(rng.normal(0, 1, n), 2), "c": np.arange(n) % 7.0}
    y = rng.random(n) < 1 / (1 + np.exp(1.5 - 0.7 * data["a"]))
    got = assessed(spark, data | {"t": np.where(y, "bad", "good")}, kind="binary", label="bad")
    for f, x in data.items():
        z, beta = (x - x.mean()) / x.std(), np.zeros(2)
        m = np.stack([np.ones(n), z], 1)
        for _ in range(40):
            p = 1 / (1 + np.exp(-m @ beta))
            beta += np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m, m.T @ (y - p))
        p = 1 / (1 + np.exp(-m @ beta))
        statistic = 2 * (np.log(np.where(y, p, 1 - p)).sum() - n * (y.mean() * math.log(y.mean()) + (1 - y.mean()) * math.log(1 - y.mean())))
        r = got[None, f]
        assert abs(r.intercept - beta[0]) < 1e-4 and abs(r.slope - beta[1]) < 1e-4 and abs(r.slope_p - math.erfc(math.sqrt(statistic / 2))) < 1e-6
        assert len(r.curve) == 41 and abs(r.curve[40].y - 1 / (1 + math.exp(-beta[0] - beta[1] * z.max()))) < 1e-4
    assert (got[None, "a"].direction, got[None, "a"].event) == ("INCREASING", "bad")


def test_classes_and_special_values(spark):
    x = np.arange(120.0)
    words = np.array(["good"] * 60 + ["bad"] * 60)
    got = assessed(spark, {"x": x, "t": words}, kind="binary", label="bad")[None, "x"]
    assert (got.event, got.direction) == ("bad", "INCREASING") and got.slope > 5
    assert assessed(spark, {"x": x, "t": words}, kind="binary")[None, "x"].direction == "DECREASING"  # the last label in order
    coded = assessed(spark, {"x": np.arange(121.0), "t": [-999] + [0] * 60 + [1] * 60}, kind="binary", label=1, target_specials=[-999])[None, "x"]
    assert (coded.event, coded.n_special, coded.n_paired, coded.direction) == ("1", 1, 120, "INCREASING")
    odd = assessed(spark, {"x": np.append(x, [-1.0, np.nan, np.inf]), "t": np.append(x, [5, 6, 7])}, specials=[-1])[None, "x"]
    assert (odd.n_input, odd.n_paired, odd.n_special) == (123, 120, 1)


def test_reasons(spark):
    x = np.arange(40.0)
    reason = lambda **k: assessed(spark, k.pop("data"), **k)[None, "x"]
    small = reason(data={"x": x[:20], "t": x[:20]})
    assert (small.direction, small.strength, small.reason) == ("INSUFFICIENT_DATA", "NOT_APPLICABLE", "Only 20 usable observations; 30 required.") and small.slope is None
    assert reason(data={"x": x * 0, "t": x}).reason == "Feature is constant after cleaning."
    assert reason(data={"x": x, "t": x * 0}).reason == "Continuous target is constant."
    assert reason(data={"x": x, "t": ["a", "b", "c", "d"] * 10}, kind="binary").reason == "Binary target does not contain exactly two usable classes."
    assert reason(data={"x": x, "t": ["a", "b"] * 20}, kind="binary", label="z").reason == "Configured positive class is not present in the usable target."
    assert reason(data={"x": x, "t": ["a"] * 35 + ["b"] * 5}, kind="binary").reason == "The smaller binary class is below the minimum sample."
    text = reason(data={"x": ["p", "q"] * 20, "t": x})
    assert (text.direction, text.reason, text.n_input) == ("NOT_APPLICABLE", "Feature is not numeric.", 40)
    with pytest.raises(ValueError):
        assessed(spark, {"x": x, "t": x}, kind="ordinal")
    assert dy.assess(spark.createDataFrame([], "x double, t double"), ["x"], "t", "continuous").count() == 0


def test_variant_rule(spark):
    def one(means, rows=20, deviation=1.0, votes=("FLAT",)):
        bins = F.array(*(F.struct(F.lit(float(m)).alias("target_mean"), F.lit(rows).alias("rows")) for m in means))
        got = spark.range(1).select(*(c.alias(n) for n, c in zip("udts", dy.variant(bins, F.lit(deviation), False, [F.lit(v) for v in votes])))).first()
        return tuple(got)

    assert one([0, 1, 2, 3, 4]) == (4, 0, "INCREASING", "INCREASING")
    assert one([0, 1, 2, 1.5, 4]) == (3, 1, "NON_MONOTONIC", "NON_MONOTONIC")
    assert one([0, 1, 2, 1.5, 4], votes=("INCREASING",))[3] == "CONFLICTING_EVIDENCE"
    assert one([0, 1, 2, 3, 4], votes=("DECREASING", "FLAT"))[3] == "CONFLICTING_EVIDENCE"
    assert one([0, 1, 2, 3, 4], rows=9) == (0, 0, "INSUFFICIENT", "WEAK_OR_NO_RELATIONSHIP")
    assert one([0, 0.01, 0.02, 0.03, 0.04])[2:] == ("FLAT", "WEAK_OR_NO_RELATIONSHIP")


def test_expected_directions(spark):
    rng = random.Random(2)
    seen = ["INCREASING", "DECREASING", "NON_MONOTONIC", "WEAK_OR_NO_RELATIONSHIP", "CONFLICTING_EVIDENCE", "INSUFFICIENT_DATA", "NOT_APPLICABLE"]
    wanted = ["INCREASING", "DECREASING", "NON_MONOTONIC", "NO_CLEAR_DIRECTION", "NOT_APPLICABLE", None]
    cases = [(f"f{i}", rng.choice(seen), rng.choice(wanted), rng.choice(["HIGHER_IS_BETTER", "HIGHER_IS_WORSE"])) for i in range(200)]
    found = spark.createDataFrame([(None, f, s, "STRONG") for f, s, _, _ in cases], "segment string, feature string, direction string, strength string")
    got = {r.feature: r for r in dy.against_expected(found, spark.createDataFrame([(f, w, o) for f, _, w, o in cases], "feature string, expected string, orientation string")).collect()}
    for f, s, w, o in cases:
        turned = {"INCREASING": "DECREASING", "DECREASING": "INCREASING"}.get(w, w) if o == "HIGHER_IS_BETTER" else w
        if w in (None, "NOT_APPLICABLE") or s == "NOT_APPLICABLE":
            want = "NOT_APPLICABLE"
        elif w == "NO_CLEAR_DIRECTION":
            want = "NO_ECONOMIC_PRIOR"
        elif s in ("INSUFFICIENT_DATA", "CONFLICTING_EVIDENCE", "WEAK_OR_NO_RELATIONSHIP"):
            want = s
        else:
            want = "AGREEMENT" if s == turned else "REVIEW_RECOMMENDED"
        assert got[f].conclusion == want


def test_continuous_targets_are_ranked_once(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import directionality

    df = spark.range(40).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("b"), (F.col("id") % 10).cast("double").alias("y"))
    base, per_y, xs = directionality.continuous_values(df, ["a", "b"], "y", [], [], F.col("a") < 20)
    assert {(r.segment, r.feature): (r.n_input, r.n_paired) for r in base.collect()} == {(0, 0): (40, 40), (0, 1): (40, 30), (1, 0): (20, 20), (1, 1): (20, 15)}
    assert {(r.segment, r.feature): r.target_levels for r in per_y.collect()} == {(0, 0): 10, (0, 1): 10, (1, 0): 10, (1, 1): 10}
    got = {(r.segment, r.feature, r.x): (r.n, r.k, r.kr) for r in xs.collect()}
    assert got[0, 0, 0.0] == (1, 0.0, 2.5) and got[1, 0, 0.0] == (1, 0.0, 1.5) and got[0, 1, 1.0] == (1, 1.0, 4.5) and len(got) == 40 + 30 + 20 + 15
