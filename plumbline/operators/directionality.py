"""Direction of every numeric feature against one target, for the whole table and for a chosen segment, in one plan (DR-3 to
DR-9, DR-13). Features are unpivoted; all their statistics are grouped aggregations over distinct values, which are counted
once: ranks and quantiles from range partitions, logistic fits by Newton steps that are one aggregation for all features."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.prefix import cumulative
from plumbline.functions.tails import chi2_one
from plumbline.functions.values import rounded
from plumbline.operators.direction import ALPHA, MATERIAL, t_tail
from plumbline.plans.registry import query
from plumbline.session import materialise, ship, table

#: Least rows and rows of the rarer class, floors of the standardised slope and of movements in deviations of
#: the target, number of bins, points of a logistic curve.
LEAST_ROWS, LEAST_CLASS = 30, 10
SLOPE_FLOOR, MOVE_FLOOR = 0.10, 0.10
BINS, CURVE_POINTS = 5, 41
#: Fixed values of the variant shape rule: least rows of a bin; least step and range of a rate, and of other targets in
#: deviations.
VARIANT = {"rows": 10, "binary": (0.002, 0.01), "continuous": (0.05, 0.10)}
RIDGE = 1e-6
NEWTON_STEPS = 25
#: Groups (features times segments) whose statistics are broadcast to the rows; more are joined.
FEW_GROUPS = 20_000

KEYS = ["segment", "feature"]
_BIN = "struct<bin:int,lower:double,upper:double,rows:bigint,feature_mean:double,target_mean:double>"
RESULT = (
    "segment string, feature string, n_input bigint, n_paired bigint, n_special bigint, reason string, r double, r_p double, pearson string, rho double, rho_p double, spearman string, slope double, intercept double, slope_p double, "
    f"regression string, curve array<struct<x:double,y:double>>, bins array<{_BIN}>, movement double, shape string, ups int, downs int, trend string, variant string, direction string, strength string, event string"
)


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v != v else chi2_one(v)).astype("float64")


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == math.inf), None).otherwise(c)


def _with(df: DataFrame, stats: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    return df.join(F.broadcast(stats) if few else stats, KEYS, how)


def cells(df: DataFrame, features: Sequence[str], target: str, specials: Sequence[float], target_specials: Sequence[float], accepted: Column | None) -> DataFrame:
    """(segment, feature, x, y, special) of a binary target with the number of rows w. Segment 0 is the whole table, 1 the side for which `accepted`
    holds; features go by their place, since numbers sort and hash faster than names. Values that are special on either side are counted apart and take no part."""
    sides = F.array(F.lit(0), F.when(F.coalesce(accepted, F.lit(False)), 1)) if accepted is not None else F.array(F.lit(0))
    number = F.col(target).cast("string").try_cast("double") if df.schema[target].dataType.typeName() == "string" else F.col(target).cast("double")
    y = F.col(target).cast("string")
    named = F.array(*(F.struct(F.lit(i).alias("feature"), _finite(F.col(f).cast("double")).alias("x")) for i, f in enumerate(features)))
    odd = F.coalesce(number.isin(*map(float, target_specials)), F.lit(False)) if target_specials else F.lit(False)
    rows = df.select(F.array_compact(sides).alias("sides"), y.alias("y"), odd.alias("odd"), named.alias("named"))
    long = rows.select(F.explode("sides").alias("segment"), "y", "odd", "named").select("segment", "y", "odd", F.inline("named"))
    if specials:
        long = long.withColumn("odd", F.col("odd") | F.coalesce(F.col("x").isin(*map(float, specials)), F.lit(False)))
    values = {c: F.when(~F.col("odd"), F.col(c)) for c in "xy"}
    return long.withColumns(values).groupBy(*KEYS, "x", "y", F.col("odd").alias("special")).agg(F.count("*").alias("w"))


def classes(counted: DataFrame, label: str | None) -> DataFrame:
    """(segment, feature, labels, event, present): the usable labels of a binary target and the one that counts as event, the
    last in order where none is given."""
    usable = counted.where(~F.col("special") & F.col("y").isNotNull()).groupBy(*KEYS, "y").agg(F.sum("w").alias("w"))
    event = F.max("y") if label is None else F.lit(str(label))
    found = F.lit(True) if label is None else F.max(F.col("y") == str(label))
    return usable.groupBy(*KEYS).agg(F.count("*").alias("labels"), event.alias("event"), found.alias("present"))


def continuous_values(df: DataFrame, features: Sequence[str], target: str, specials: Sequence[float], target_specials: Sequence[float], accepted: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, per_y, xs) of a continuous target: counts of each group, the levels of its target with the squares of values and
    ranks, and (segment, feature, x) with rows, sum of the target and sum of its ranks.

    The target is ranked once for all features that no row with a target lacks, and once for each of the others; rows meet
    their ranks before they are unpivoted, and both segments are summed side by side, so the rows are shuffled once."""
    spark = df.sparkSession
    number = F.col(target).cast("string").try_cast("double") if df.schema[target].dataType.typeName() == "string" else F.col(target).cast("double")
    odd = F.coalesce(number.isin(*map(float, target_specials)), F.lit(False)) if target_specials else F.lit(False)
    named = F.array(*(F.struct(F.lit(i).alias("feature"), _finite(F.col(f).cast("double")).alias("x")) for i, f in enumerate(features)))
    side = F.coalesce(accepted, F.lit(False)) if accepted is not None else F.lit(False)
    rows = df.select(side.alias("side"), _finite(number).alias("y"), odd.alias("odd"), named.alias("named"))
    special = F.col("odd") | (F.coalesce(F.col("x").isin(*map(float, specials)), F.lit(False)) if specials else F.lit(False))
    usable, paired = F.col("y").isNotNull() & ~F.col("odd"), F.col("x").isNotNull() & F.col("y").isNotNull() & ~special
    long, counts = rows.select("side", "y", "odd", F.inline("named")), []
    for k, inside in enumerate((F.lit(True), F.col("side"))):
        counts += [F.count_if(inside).alias(f"i{k}"), F.count_if(inside & paired).alias(f"p{k}"), F.count_if(inside & special).alias(f"s{k}"), F.count_if(inside & usable).alias(f"u{k}"), F.avg(F.when(inside & paired, F.col("y"))).alias(f"m{k}")]
    found = sorted(long.groupBy("feature").agg(*counts).collect())  # one row a feature
    segments = range(1 + (accepted is not None))
    full = [r.feature for r in found if r.p0 == r.u0]
    own = [r.feature for r in found if r.p0 != r.u0]
    base = spark.createDataFrame([(k, r.feature, r[f"i{k}"], r[f"p{k}"], r[f"s{k}"]) for r in found for k in segments if r[f"i{k}"]], "segment int, feature int, n_input bigint, n_paired bigint, n_special bigint")

    def value(i: int) -> Column:
        x = F.col("named")[i]["x"]
        return F.when(~F.coalesce(x.isin(*map(float, specials)), F.lit(False)), x) if specials else x

    sets = [F.struct(F.lit(-1).alias("ranking"), F.array(*(value(i) for i in full)).alias("xs"))] if full else []
    sets += [F.struct(F.lit(i).alias("ranking"), F.array(value(i)).alias("xs")) for i in own]
    met = rows.where(usable).select("side", "y", F.inline(F.array(*sets))) if sets else spark.createDataFrame([], "side boolean, y double, ranking int, xs array<double>")
    met = met.where((F.col("ranking") < 0) | F.col("xs")[0].isNotNull())
    each = met.groupBy("ranking", "y").agg(F.count("*").alias("n0"), F.count_if("side").alias("n1"))
    ys = cumulative(each, ["y"], {"upto0": "n0", "upto1": "n1"}, ["ranking"]).withColumns({f"r{k}": F.col(f"upto{k}") - (F.col(f"n{k}") - 1) / 2 for k in (0, 1)})
    means = spark.createDataFrame([(-1, r.m0, r.m1) for r in found if r.feature in full[:1]] + [(r.feature, r.m0, r.m1) for r in found if r.feature in own], "ranking int, m0 double, m1 double")
    squares = []
    for k in (0, 1):
        y, rank = F.col("y") - F.col(f"m{k}"), F.col(f"r{k}") - (F.col(f"upto{k}_total") + 1) / 2
        squares += [F.count_if(F.col(f"n{k}") > 0).alias(f"l{k}"), F.sum(F.col(f"n{k}") * y * y).alias(f"yy{k}"), F.sum(F.col(f"n{k}") * rank * rank).alias(f"ryy{k}")]
    owner = spark.createDataFrame([(r.feature, -1 if r.p0 == r.u0 else r.feature) for r in found], "feature int, ranking int")
    per_y = ys.join(F.broadcast(means), "ranking").groupBy("ranking").agg(*squares).join(F.broadcast(owner), "ranking")  # a row or less a feature
    per_y = per_y.select("feature", F.inline(F.array(*(F.struct(F.lit(k).alias("segment"), F.col(f"l{k}").alias("target_levels"), F.col(f"yy{k}").alias("yy"), F.col(f"ryy{k}").alias("ryy")) for k in segments)))).where("target_levels > 0")
    ranked = met.join(ys.select("ranking", "y", "r0", "r1"), ["ranking", "y"]).select("side", "y", "r0", "r1", "ranking", F.posexplode("xs").alias("at", "x"))
    place = F.when(F.col("ranking") < 0, F.element_at(F.array(*map(F.lit, full)), F.col("at") + 1)).otherwise(F.col("ranking")) if full else F.col("ranking")
    sums = []
    for k, inside in enumerate((F.lit(True), F.col("side"))):
        sums += [F.count_if(inside).alias(f"n{k}"), F.sum(F.when(inside, F.col("y"))).alias(f"k{k}"), F.sum(F.when(inside, F.col(f"r{k}"))).alias(f"kr{k}")]
    xs = ranked.groupBy(place.alias("feature"), "x").agg(*sums)
    xs = xs.select("feature", "x", F.inline(F.array(*(F.struct(F.lit(k).alias("segment"), F.col(f"n{k}").alias("n"), F.col(f"k{k}").alias("k"), F.col(f"kr{k}").alias("kr")) for k in segments)))).where("n > 0")
    return base, materialise(per_y, "direction-targets"), xs


def quantile_of(share: float) -> list[Column]:
    """The two values around a share of a group's rows, and the place between them, of rows with their running count."""
    place = F.floor((F.col("upto_total") - 1) * F.lit(share))
    at = lambda k: F.max(F.when(F.col("upto") - F.col("n") <= F.least(place + k, F.col("upto_total") - 1), F.col("x")))
    return [at(0), at(1), F.max((F.col("upto_total") - 1) * F.lit(share) - place)]


def fit(values: DataFrame, stats: DataFrame, few: bool) -> DataFrame:
    """(segment, feature, slope, intercept, likelihood): logistic regression of every group on its standardised feature, with
    a ridge on the slope. Each step is one aggregation for all groups that still move."""
    z = (F.col("x") - F.col("mx")) / F.col("sx")
    log_odds = F.log(F.col("my") / (1 - F.col("my")))
    now = stats.select(*KEYS, "mx", "sx", F.col("rows").alias("rows"), log_odds.alias("a"), F.lit(0.0).alias("b"), F.lit(True).alias("moves"))
    for _ in range(NEWTON_STEPS):
        joined = _with(values, now.where("moves"), few).withColumn("z", z)
        p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("z"))))
        over, w = F.col("k") - F.col("n") * p, F.col("n") * p * (1 - p)
        sums = joined.groupBy(*KEYS).agg(F.sum(over).alias("g0"), F.sum(over * F.col("z")).alias("g1"), F.sum(w).alias("h0"), F.sum(w * F.col("z")).alias("h1"), F.sum(w * F.col("z") * F.col("z")).alias("h2"))
        g1, h2 = F.col("g1") - F.col("b") * RIDGE, F.col("h2") + RIDGE
        det = F.col("h0") * h2 - F.col("h1") * F.col("h1")
        able = F.col("moves") & (det > 1e-12 * F.col("rows"))
        da = F.when(able, (h2 * F.col("g0") - F.col("h1") * g1) / det).otherwise(0.0)
        db = F.when(able, (F.col("h0") * g1 - F.col("h1") * F.col("g0")) / det).otherwise(0.0)
        moved = now.join(sums, KEYS, "left").withColumns({"da": da, "db": db})
        now = materialise(moved.select(*KEYS, "mx", "sx", "rows", (F.col("a") + F.col("da")).alias("a"), (F.col("b") + F.col("db")).alias("b"), (F.abs("da") + F.abs("db") >= 1e-9).alias("moves")), "logistic")
        if now.where("moves").isEmpty():
            break
    joined = _with(values, now, few).withColumn("p", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * z))))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    fitted = joined.groupBy(*KEYS).agg(F.sum(F.col("k") * F.log(p) + (F.col("n") - F.col("k")) * F.log(1 - p)).alias("likelihood"))
    return now.join(fitted, KEYS).select(*KEYS, F.col("b").alias("slope"), F.col("a").alias("intercept"), "likelihood")


def signed(value: Column, material: Column) -> Column:
    """The direction of a piece of evidence; FLAT where it is not material."""
    return F.when(material & (value > 0), "INCREASING").when(material & (value < 0), "DECREASING").otherwise("FLAT")


def shape_of(bins: Column, deviation: Column) -> tuple[Column, Column]:
    """(shape, value) of the target's means over bins: an interior extreme beyond both ends by a floor is a turn; else the
    movement from end to end counts, with the sign of the means' trend. Fewer than three bins give UNAVAILABLE (DR-5)."""
    means = F.transform(bins, lambda b: b["target_mean"])
    k = F.size(bins)
    inner, first, last = F.slice(means, 2, F.greatest(k - 2, F.lit(0))), F.element_at(means, 1), F.element_at(means, -1)
    scaled = lambda c: F.when(deviation > 0, c / deviation).otherwise(0.0)
    turn = scaled(F.greatest(F.array_max(inner) - F.greatest(first, last), F.least(first, last) - F.array_min(inner)))
    middle = (k + 1) / 2
    trend = F.aggregate(F.zip_with(F.sequence(F.lit(1), k), means, lambda i, m: (i - middle) * m), F.lit(0.0), lambda s, v: s + v)
    move = scaled(last - first)
    shape = F.when(k < 3, "UNAVAILABLE").when(turn >= MOVE_FLOOR, "NON_MONOTONIC").otherwise(signed(trend, F.abs(move) >= MOVE_FLOOR))
    return shape, F.when(k >= 3, F.when(turn >= MOVE_FLOOR, turn).otherwise(move))


def consensus(votes: Sequence[Column], shape: Column) -> tuple[Column, Column]:
    """(direction, strength) of three votes: a turn decides alone, three equal votes are strong, two moderate; one vote
    against another is a conflict, and one alone tells nothing (DR-6)."""
    count = lambda d: sum((F.when(v == d, 1).otherwise(0) for v in votes), F.lit(0))
    ups, downs = count("INCREASING"), count("DECREASING")
    leading = F.when(ups > downs, "INCREASING").otherwise("DECREASING")
    turn, majority, opposed = shape == "NON_MONOTONIC", F.greatest(ups, downs) >= 2, (ups > 0) & (downs > 0)
    direction = F.when(turn, "NON_MONOTONIC").when(majority, leading).when(opposed, "CONFLICTING_EVIDENCE").otherwise("WEAK_OR_NO_RELATIONSHIP")
    strength = F.when(turn, "NOT_APPLICABLE").when(F.greatest(ups, downs) == len(votes), "STRONG").when(majority, "MODERATE").when(opposed, "NOT_APPLICABLE").otherwise("WEAK")
    return direction, strength


def variant(bins: Column, deviation: Column, binary: bool, global_votes: Sequence[Column]) -> tuple[Column, Column, Column, Column]:
    """(ups, downs, trend, direction) by the variant rule: steps between neighbouring bins beyond a threshold, bins of a least
    size, and a synthesis in which every material sign must agree (DR-13)."""
    step, least_range = VARIANT["binary" if binary else "continuous"]
    unit = F.lit(1.0) if binary else deviation
    means = F.transform(bins, lambda b: b["target_mean"])
    steps = F.zip_with(F.slice(means, 2, F.greatest(F.size(means) - 1, F.lit(0))), F.slice(means, 1, F.greatest(F.size(means) - 1, F.lit(0))), lambda b, a: b - a)
    ups, downs = F.size(F.filter(steps, lambda s: s >= step * unit)), F.size(F.filter(steps, lambda s: s <= -step * unit))
    usable = (F.size(bins) >= 3) & ~F.exists(bins, lambda b: b["rows"] < VARIANT["rows"])
    wide = F.array_max(means) - F.array_min(means) >= least_range * unit
    trend = F.when(~usable, "INSUFFICIENT").when(~wide, "FLAT").when((ups > 0) & (downs > 0), "NON_MONOTONIC").when(ups > 0, "INCREASING").when(downs > 0, "DECREASING").otherwise("FLAT")
    any_ = lambda d: sum((F.when(v == d, 1).otherwise(0) for v in global_votes), F.lit(0)) > 0
    up, down = any_("INCREASING"), any_("DECREASING")
    conflict = (up & down) | ((trend == "NON_MONOTONIC") & (up | down)) | ((trend == "INCREASING") & down) | ((trend == "DECREASING") & up)
    direction = F.when(conflict, "CONFLICTING_EVIDENCE").when(trend == "NON_MONOTONIC", trend).when(up | (trend == "INCREASING"), "INCREASING").when(down | (trend == "DECREASING"), "DECREASING").otherwise("WEAK_OR_NO_RELATIONSHIP")
    return F.when(usable, ups).otherwise(0), F.when(usable, downs).otherwise(0), trend, direction


def assess(
    df: DataFrame, features: Sequence[str], target: str, kind: str, label: str | None = None, specials: Sequence[float] = (),
    target_specials: Sequence[float] = (), accepted: Column | None = None, bins: int = BINS,
) -> DataFrame:
    """One row for each feature and segment (the whole table, and the accepted side where one is given): counts, the evidence of
    correlation, ranks, regression and bins, the direction with its strength, or the reason why it is not assessed (DR-7, DR-9).
    `kind` is binary (with the event's label, of any type) or continuous. Features that are not numbers get their row too."""
    ship(df.sparkSession)
    if kind not in ("binary", "continuous"):
        raise ValueError(f"target type {kind!r} is not supported")
    binary = kind == "binary"
    usable = [f for f in features if isinstance(df.schema[f].dataType, T.NumericType)]
    few = (1 + (accepted is not None)) * len(features) <= FEW_GROUPS
    whole = lambda found: found.unionByName(_unfit(df, features, usable, accepted), allowMissingColumns=True)
    if not usable:
        return whole(df.sparkSession.createDataFrame([], RESULT))
    if binary:
        counted = materialise(cells(df, usable, target, specials, target_specials, accepted), "direction-cells")
        paired = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col("special")
        base = counted.groupBy(*KEYS).agg(F.sum("w").alias("n_input"), F.sum(F.when(paired, F.col("w")).otherwise(0)).alias("n_paired"), F.sum(F.when(F.col("special"), F.col("w")).otherwise(0)).alias("n_special"))
        labels = classes(counted, label)
        base = base.join(labels, KEYS, "left")
        pairs = _with(counted.where(paired).drop("special"), labels, few).withColumn("y", (F.col("y") == F.col("event")).cast("double"))
        ys = cumulative(pairs.groupBy(*KEYS, "y").agg(F.sum("w").alias("n")), ["y"], {"upto": "n"}, KEYS).withColumn("ry", F.col("upto") - (F.col("n") - 1) / 2)
        ranked = ys.select(*KEYS, "y", "ry")
        met = pairs.join(F.broadcast(ranked) if few else ranked, [*KEYS, "y"])  # two rows a group
        xs = met.groupBy(*KEYS, "x").agg(F.sum("w").alias("n"), F.sum(F.col("y") * F.col("w")).alias("k"), F.sum(F.col("ry") * F.col("w")).alias("kr"))
        levels = ys.groupBy(*KEYS).agg(F.count("*").alias("target_levels"), F.min("n").alias("rarer"))
    else:
        base, per_y, xs = continuous_values(df, usable, target, specials, target_specials, accepted)
        levels = per_y.select(*KEYS, "target_levels")
    xs = materialise(cumulative(xs, ["x"], {"upto": "n"}, KEYS).withColumn("rx", F.col("upto") - (F.col("n") - 1) / 2), "direction-values")
    edges = [quantile_of(i / bins) for i in range(bins + 1)]
    stats = xs.groupBy(*KEYS).agg(
        F.sum("n").alias("rows"), F.count("*").alias("levels"), F.min("x").alias("low"), F.max("x").alias("high"),
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mx"), (F.sum("k") / F.sum("n")).alias("my"),
        F.array(*(lo + (hi - lo) * at for lo, hi, at in edges)).alias("edges"),
    )
    stats = stats.join(levels, KEYS).withColumn("mr", (F.col("rows") + 1) / 2).withColumn("edges", F.array_distinct("edges"))
    stats = materialise(stats, "direction-stats")

    x, y, rx, ry, n = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("rx") - F.col("mr"), F.col("ry") - F.col("mr"), F.col("n")
    by_x = _with(xs, stats, few).groupBy(*KEYS).agg(
        F.sum(n * x * x).alias("xx"), F.sum(x * (F.col("k") - n * F.col("my"))).alias("xy"), F.sum(n * rx * rx).alias("rxx"), F.sum(rx * (F.col("kr") - n * F.col("mr"))).alias("rxy")
    )
    by_y = _with(ys.select(*KEYS, "y", "n", "ry"), stats, few).groupBy(*KEYS).agg(F.sum(n * y * y).alias("yy"), F.sum(n * ry * ry).alias("ryy")) if binary else per_y.drop("target_levels")
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))).otherwise(F.array().cast("array<double>"))
    binned = _with(xs, stats, few).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("x"))) + 1)
    binned = binned.groupBy(*KEYS, "bin", F.element_at("edges", F.col("bin")).alias("lower"), F.element_at("edges", F.least(F.col("bin") + 1, F.size("edges"))).alias("upper")).agg(
        F.sum("n").alias("rows"), (F.sum(F.col("x") * n) / F.sum("n")).alias("feature_mean"), (F.sum("k") / F.sum("n")).alias("target_mean")
    )
    shapes = binned.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("bin", "lower", "upper", "rows", "feature_mean", "target_mean"))).alias("bins"))

    root = lambda c: F.nullif(F.sqrt(c), F.lit(0.0))
    one = base.join(stats.drop("edges", "mr"), KEYS, "left").join(by_x, KEYS, "left").join(by_y, KEYS, "left").join(shapes, KEYS, "left")
    one = one.withColumns({"sx": F.sqrt(F.col("xx") / F.col("rows")), "sy": F.sqrt(F.col("yy") / F.col("rows")), "r": F.col("xy") / root(F.col("xx") * F.col("yy")), "rho": F.col("rxy") / root(F.col("rxx") * F.col("ryy"))})
    short = F.concat(F.lit("Only "), F.col("n_paired").cast("string"), F.lit(f" usable observations; {LEAST_ROWS} required."))
    reason = F.when(F.col("n_paired") < LEAST_ROWS, short).when(F.col("levels") < 2, "Feature is constant after cleaning.")
    if binary:
        reason = reason.when((F.col("labels") != 2) | ((F.col("target_levels") != 2) & F.col("present")), "Binary target does not contain exactly two usable classes.")
        reason = reason.when(~F.col("present"), "Configured positive class is not present in the usable target.").when(F.col("rarer") < LEAST_CLASS, "The smaller binary class is below the minimum sample.")
    else:
        reason = reason.when(F.col("target_levels") < 2, "Continuous target is constant.")
    one = one.withColumn("reason", reason)
    one = materialise(one, "direction-evidence") if binary else one  # the fit and the result read it
    rows = F.col("rows").cast("double")
    if binary:
        able = one.where(F.col("reason").isNull())
        fits = fit(xs.select(*KEYS, "x", "n", "k"), able, few)
        null = F.col("rows") * (F.col("my") * F.log("my") + (1 - F.col("my")) * F.log(1 - F.col("my")))
        one = one.join(fits, KEYS, "left").withColumn("slope_p", _chi2_tail(F.greatest(F.lit(0.0), 2 * (F.col("likelihood") - null))))
        point = lambda v: 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * (v - F.col("mx")) / F.col("sx"))))
        points = CURVE_POINTS
    else:
        one = one.withColumns({"slope": F.col("r"), "intercept": F.lit(0.0), "slope_p": t_tail("r", rows)})
        point = lambda v: F.col("my") + F.col("slope") * F.col("sy") * (v - F.col("mx")) / F.col("sx")
        points = 2
    along = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / (points - 1))
    curve = F.transform(along, lambda v: F.struct(v.alias("x"), point(v).alias("y")))
    one = one.withColumns({"r_p": t_tail("r", rows), "rho_p": t_tail("rho", rows), "curve": curve})
    gate = lambda value, p, floor: (F.abs(value) >= floor) & (F.col(p) <= ALPHA)
    ranks, slopes = signed(F.col("rho"), gate("rho", "rho_p", MATERIAL)), signed(F.col("slope"), gate("slope", "slope_p", SLOPE_FLOOR))
    linear = signed(F.col("r"), gate("r", "r_p", MATERIAL))
    shape, move = shape_of(F.col("bins"), F.col("sy"))
    one = one.withColumns({"pearson": linear, "spearman": ranks, "regression": slopes, "shape": shape, "movement": move})
    direction, strength = consensus([F.col("spearman"), F.col("regression"), F.col("shape")], F.col("shape"))
    ups, downs, trend, other = variant(F.col("bins"), F.col("sy"), binary, [F.col("pearson"), F.col("spearman"), F.col("regression")])
    fine = F.col("reason").isNull()
    shown = {c: F.when(fine, F.col(c)) for c in ("r", "r_p", "pearson", "rho", "rho_p", "spearman", "slope", "intercept", "slope_p", "regression", "curve", "bins", "movement")}
    shown |= {"shape": F.when(fine, F.col("shape")).otherwise("UNAVAILABLE"), "ups": F.when(fine, ups), "downs": F.when(fine, downs), "trend": F.when(fine, trend), "variant": F.when(fine, other)}
    shown |= {"direction": F.when(fine, direction).otherwise("INSUFFICIENT_DATA"), "strength": F.when(fine, strength).otherwise("NOT_APPLICABLE"), "event": F.col("event") if binary else F.lit(None).cast("string")}
    names = {"segment": F.when(F.col("segment") == 1, "accepted"), "feature": F.element_at(F.array(*map(F.lit, usable)), F.col("feature") + 1)}
    return whole(one.select(*(c.alias(n) for n, c in names.items()), "n_input", "n_paired", "n_special", "reason", *(c.alias(n) for n, c in shown.items())))


def _unfit(df: DataFrame, features: Sequence[str], usable: Sequence[str], accepted: Column | None) -> DataFrame:
    """Rows of the features that are not numbers."""
    rest = [f for f in features if f not in usable]
    if not rest:
        return df.sparkSession.createDataFrame([], "segment string, feature string, direction string")
    sizes = df.agg(F.count("*").alias("all"), F.count_if(accepted if accepted is not None else F.lit(False)).alias("side"))
    sides = F.array(F.struct(F.lit(None).cast("string").alias("segment"), F.col("all").alias("n_input")), *([F.struct(F.lit("accepted").alias("segment"), F.col("side").alias("n_input"))] if accepted is not None else []))
    rows = sizes.select(F.inline(sides)).select("*", F.explode(F.array(*map(F.lit, rest))).alias("feature"))
    said = {"direction": "NOT_APPLICABLE", "strength": "NOT_APPLICABLE", "reason": "Feature is not numeric.", "shape": "UNAVAILABLE"}
    return rows.select("segment", "feature", "n_input", F.lit(0).cast("bigint").alias("n_paired"), F.lit(0).cast("bigint").alias("n_special"), *(F.lit(v).alias(k) for k, v in said.items()))


def against_expected(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed against expected direction of risk (feature, expected, orientation): a target of which more is better turns the
    expectation (DR-8)."""
    better = F.col("orientation") == "HIGHER_IS_BETTER"
    want = F.when(better & (F.col("expected") == "INCREASING"), "DECREASING").when(better & (F.col("expected") == "DECREASING"), "INCREASING").otherwise(F.col("expected"))
    seen = F.col("direction")
    conclusion = (
        F.when(F.col("expected").isNull() | (want == "NOT_APPLICABLE") | (seen == "NOT_APPLICABLE"), "NOT_APPLICABLE").when(want == "NO_CLEAR_DIRECTION", "NO_ECONOMIC_PRIOR")
        .when(seen.isin("INSUFFICIENT_DATA", "CONFLICTING_EVIDENCE", "WEAK_OR_NO_RELATIONSHIP"), seen).when(seen == want, "AGREEMENT").otherwise("REVIEW_RECOMMENDED")
    )
    review = conclusion.isin("REVIEW_RECOMMENDED", "CONFLICTING_EVIDENCE", "WEAK_OR_NO_RELATIONSHIP")
    return found.join(F.broadcast(expected), "feature", "left").select("segment", "feature", "direction", "strength", "expected", want.alias("expected_target"), conclusion.alias("conclusion"), review.alias("review"))


LINE = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_SHOWN = ["segment", "feature", "n_paired", "shape", "spearman", "regression", "direction", "strength", "ups", "downs", "trend", "variant"]


def _sql(features: Sequence[str], rows: str, target: str, p_floor: bool = True) -> str:
    """Ranks, slopes, quantile bins, votes and consensus of a continuous target; with many rows a correlation beyond its floor
    always has a p below 0.05, and below 30 rows nothing is assessed, so p is stated by t against its 0.05 bound of 1.96 to 2.05."""
    long = " UNION ALL ".join(f"SELECT segment, '{f}' AS feature, {f}::DOUBLE AS x, ({target})::DOUBLE AS y FROM rows" for f in features)
    return f"""WITH rows AS ({rows}), long AS ({long}),
 q AS (SELECT segment, feature, list_distinct(list_sort(quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM long GROUP BY ALL),
 r AS (SELECT long.*, list_sort(e)[2 : len(e) - 1] AS inner_e, rank() OVER (PARTITION BY long.segment, long.feature ORDER BY x) + (count(*) OVER (PARTITION BY long.segment, long.feature, x) - 1) / 2 AS rx,
   rank() OVER (PARTITION BY long.segment, long.feature ORDER BY y) + (count(*) OVER (PARTITION BY long.segment, long.feature, y) - 1) / 2 AS ry
   FROM long JOIN q ON q.segment = long.segment AND q.feature = long.feature),
 s AS (SELECT segment, feature, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho, stddev_pop(y) AS sy FROM r GROUP BY ALL),
 b AS (SELECT segment, feature, len(list_filter(inner_e, lambda z: z < x)) AS bin, avg(y) AS m, count(*) AS n FROM r GROUP BY ALL),
 m AS (SELECT segment, feature, list(m ORDER BY bin) AS m, min(n) AS least FROM b GROUP BY ALL),
 v AS (SELECT s.segment, s.feature, s.n, sy, m, least, len(m) AS k,
   CASE WHEN abs(rho) >= 0.2 AND abs(rho) * sqrt((s.n - 2) / (1 - rho * rho)) > 2 THEN CASE WHEN rho > 0 THEN 'INCREASING' ELSE 'DECREASING' END ELSE 'FLAT' END AS spearman,
   CASE WHEN abs(r) >= 0.2 AND abs(r) * sqrt((s.n - 2) / (1 - r * r)) > 2 THEN CASE WHEN r > 0 THEN 'INCREASING' ELSE 'DECREASING' END ELSE 'FLAT' END AS pearson,
   CASE WHEN abs(r) >= 0.1 AND abs(r) * sqrt((s.n - 2) / (1 - r * r)) > 2 THEN CASE WHEN r > 0 THEN 'INCREASING' ELSE 'DECREASING' END ELSE 'FLAT' END AS regression
   FROM s JOIN m ON m.segment = s.segment AND m.feature = s.feature),
 w AS (SELECT *, CASE WHEN k < 3 THEN 'UNAVAILABLE' WHEN greatest(list_max(m[2 : k - 1]) - greatest(m[1], m[k]), least(m[1], m[k]) - list_min(m[2 : k - 1])) / sy >= 0.1 THEN 'NON_MONOTONIC'
     WHEN abs(m[k] - m[1]) / sy < 0.1 THEN 'FLAT' WHEN list_sum(list_transform(range(1, k + 1), lambda i: (i - (k + 1) / 2) * m[i])) > 0 THEN 'INCREASING' ELSE 'DECREASING' END AS shape,
   len(list_filter(range(2, k + 1), lambda i: m[i] - m[i - 1] >= 0.05 * sy)) AS u, len(list_filter(range(2, k + 1), lambda i: m[i] - m[i - 1] <= -0.05 * sy)) AS d FROM v),
 c AS (SELECT *, list_filter([spearman, regression, shape], lambda z: z = 'INCREASING') AS up, list_filter([spearman, regression, shape], lambda z: z = 'DECREASING') AS down,
   list_contains([pearson, spearman, regression], 'INCREASING') AS gu, list_contains([pearson, spearman, regression], 'DECREASING') AS gd,
   CASE WHEN k < 3 OR least < 10 THEN 'INSUFFICIENT' WHEN list_max(m) - list_min(m) < 0.1 * sy THEN 'FLAT' WHEN u > 0 AND d > 0 THEN 'NON_MONOTONIC' WHEN u > 0 THEN 'INCREASING' WHEN d > 0 THEN 'DECREASING' ELSE 'FLAT' END AS trend FROM w)
 SELECT nullif(segment, '') AS segment, feature, n AS n_paired, shape, spearman, regression,
   CASE WHEN shape = 'NON_MONOTONIC' THEN shape WHEN len(up) >= 2 THEN 'INCREASING' WHEN len(down) >= 2 THEN 'DECREASING' WHEN len(up) > 0 AND len(down) > 0 THEN 'CONFLICTING_EVIDENCE' ELSE 'WEAK_OR_NO_RELATIONSHIP' END AS direction,
   CASE WHEN shape = 'NON_MONOTONIC' THEN 'NOT_APPLICABLE' WHEN greatest(len(up), len(down)) = 3 THEN 'STRONG' WHEN greatest(len(up), len(down)) = 2 THEN 'MODERATE' WHEN len(up) > 0 AND len(down) > 0 THEN 'NOT_APPLICABLE' ELSE 'WEAK' END AS strength,
   CASE WHEN trend = 'INSUFFICIENT' THEN 0 ELSE u END AS ups, CASE WHEN trend = 'INSUFFICIENT' THEN 0 ELSE d END AS downs, trend,
   CASE WHEN (gu AND gd) OR (trend = 'NON_MONOTONIC' AND (gu OR gd)) OR (trend = 'INCREASING' AND gd) OR (trend = 'DECREASING' AND gu) THEN 'CONFLICTING_EVIDENCE' WHEN trend = 'NON_MONOTONIC' THEN trend
     WHEN gu OR trend = 'INCREASING' THEN 'INCREASING' WHEN gd OR trend = 'DECREASING' THEN 'DECREASING' ELSE 'WEAK_OR_NO_RELATIONSHIP' END AS variant FROM c"""


_BOTH_SIDES = "SELECT '' AS segment, * FROM lineitem UNION ALL SELECT 'accepted', * FROM lineitem WHERE l_returnflag = 'R'"
_CHARGE = "l_extendedprice / 10 + l_quantity * 1500 - l_discount * 200000 + (l_linenumber - 4) * (l_linenumber - 4) * 5000"
_ASSESSED = _sql(LINE, _BOTH_SIDES, _CHARGE)


def _assessed(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("charge", F.expr(_CHARGE))
    return assess(df, LINE, "charge", "continuous", accepted=F.col("l_returnflag") == "R")


@query("direction_assessed", _ASSESSED)
def direction_assessed(spark, sf_dir):
    """Four features of line items against a charge that one raises, one lowers, one turns and one does not touch, for all rows and the
    returned ones."""
    return _assessed(spark, sf_dir).select(*_SHOWN)


@query("direction_expected", f"""WITH found AS ({_ASSESSED}), e(feature, expected, orientation) AS (VALUES ('l_quantity', 'DECREASING', 'HIGHER_IS_BETTER'), ('l_discount', 'NO_CLEAR_DIRECTION', 'HIGHER_IS_WORSE'), ('l_tax', 'INCREASING', 'HIGHER_IS_WORSE')),
 w AS (SELECT segment, feature, direction, strength, expected, CASE WHEN orientation = 'HIGHER_IS_BETTER' THEN CASE expected WHEN 'INCREASING' THEN 'DECREASING' WHEN 'DECREASING' THEN 'INCREASING' ELSE expected END ELSE expected END AS expected_target FROM found LEFT JOIN e USING (feature)),
 c AS (SELECT *, CASE WHEN expected IS NULL OR expected_target = 'NOT_APPLICABLE' OR direction = 'NOT_APPLICABLE' THEN 'NOT_APPLICABLE' WHEN expected_target = 'NO_CLEAR_DIRECTION' THEN 'NO_ECONOMIC_PRIOR'
   WHEN direction IN ('INSUFFICIENT_DATA', 'CONFLICTING_EVIDENCE', 'WEAK_OR_NO_RELATIONSHIP') THEN direction WHEN direction = expected_target THEN 'AGREEMENT' ELSE 'REVIEW_RECOMMENDED' END AS conclusion FROM w)
 SELECT *, conclusion IN ('REVIEW_RECOMMENDED', 'CONFLICTING_EVIDENCE', 'WEAK_OR_NO_RELATIONSHIP') AS review FROM c""")
def direction_expected(spark, sf_dir):
    rows = [("l_quantity", "DECREASING", "HIGHER_IS_BETTER"), ("l_discount", "NO_CLEAR_DIRECTION", "HIGHER_IS_WORSE"), ("l_tax", "INCREASING", "HIGHER_IS_WORSE")]
    return against_expected(_assessed(spark, sf_dir), spark.createDataFrame(rows, "feature string, expected string, orientation string"))


@query("direction_linear", """SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 6) AS slope, round(avg(l_extendedprice) + corr(l_quantity, l_extendedprice) * stddev_pop(l_extendedprice) * (min(l_quantity) - avg(l_quantity)) / stddev_pop(l_quantity), 2) AS curve_start,
 round(avg(l_extendedprice) + corr(l_quantity, l_extendedprice) * stddev_pop(l_extendedprice) * (max(l_quantity) - avg(l_quantity)) / stddev_pop(l_quantity), 2) AS curve_end FROM lineitem""")
def direction_linear(spark, sf_dir):
    found = assess(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", "continuous")
    return found.select("feature", rounded(F.col("slope")).alias("slope"), rounded(F.col("curve")[0]["y"], 2).alias("curve_start"), rounded(F.col("curve")[1]["y"], 2).alias("curve_end"))


@query("direction_logistic")
def direction_logistic(spark, sf_dir):
    """Three features against a class given by its text, special values apart; no SQL (an iterative fit), equal to Newton steps on
    rows in the tests."""
    df = table(spark, sf_dir, "lineitem").withColumn("price", F.when(F.col("l_extendedprice") > 40000, "high").otherwise("low"))
    return assess(df, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "price", "binary", "high", specials=[50]).drop("curve", "bins")


@query("direction_binned", """WITH e AS (SELECT quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM lineitem), b AS (SELECT len(list_filter(list_distinct(q[2:5]), lambda z: z < l_quantity)) + 1 AS bin, any_value(q) AS q, count(*) AS rows, avg(l_quantity) AS f, avg(l_extendedprice) AS m FROM lineitem, e GROUP BY 1)
 SELECT bin::INTEGER AS bin, q[bin] AS lower, q[bin + 1] AS upper, rows, round(f, 4) AS feature_mean, round(m, 2) AS target_mean FROM b""")
def direction_binned(spark, sf_dir):
    found = assess(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", "continuous")
    return found.select(F.inline("bins")).withColumns({"feature_mean": rounded(F.col("feature_mean"), 4), "target_mean": rounded(F.col("target_mean"), 2)})
