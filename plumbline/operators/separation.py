"""How well single features tell a target apart (TA-18, TA-21 to TA-27). Every feature's values are counted once, by state
(regular, missing, special, category) and outcome; trees, buckets and the scan for leakage all work on these counts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.prefix import cumulative
from plumbline.functions.tails import hypergeometric_greater
from plumbline.functions.values import rounded
from plumbline.operators.association import CELLS, concordance, grouped_auc, woe
from plumbline.plans.registry import query
from plumbline.session import materialise, ship, table

#: Leaves, depth and smallest share of a leaf of each tree; AUC of medium and high risk; spread that counts as stable.
TREES = {"primary": (8, 4, 0.010), "conservative": (4, 3, 0.020), "permissive": (12, 5, 0.005)}
LEAST_LEAF = 50
MEDIUM_RISK, HIGH_RISK, STABLE = 0.60, 0.75, 0.05
#: Fixed values of the scan: least rows, their least share, least events, rate and rise of the rate, highest adjusted p, most
#: distinct values that are tried one by one.
SCAN = {"rows": 30, "share": 0.001, "events": 5, "rate": 0.90, "rise": 0.10, "p": 0.01, "exact": 20}
#: Fixed values of findings: AUC and information value of leakage and of poor discrimination.
LEAKAGE_AUC, LEAKAGE_IV, POOR_AUC, POOR_IV = 0.90, 0.50, 0.60, 0.05


def outcomes_of(target: Column, classes: Sequence | None = None) -> dict[str, Column]:
    """0/1 columns: the event of a 0/1 target, or one a class."""
    return {"1": target.cast("double")} if classes is None else {str(c): (target.cast("string") == str(c)).cast("double") for c in classes}


def value_rows(df: DataFrame, features: Sequence[str], outcomes: Mapping[str, Column], specials: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(v0, v1, ..., feature, state, x, label): a row for each row and feature. Numeric columns have the states missing, regular and
    special:<code>, all others missing and category. Rows without an outcome take no part."""
    specials = specials or {}

    def of(f: str) -> Column:
        if isinstance(df.schema[f].dataType, T.NumericType):
            x = F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
            state = F.when(x.isNull(), "missing")
            for code in specials.get(f, ()):
                state = state.when(x == float(code), f"special:{code}")
            state = state.otherwise("regular")
            return F.struct(F.lit(f).alias("feature"), state.alias("state"), F.when(state == "regular", x).alias("x"), F.lit(None).cast("string").alias("label"))
        label = F.col(f).cast("string")
        return F.struct(F.lit(f).alias("feature"), F.when(label.isNull(), "missing").otherwise("category").alias("state"), F.lit(None).cast("double").alias("x"), label.alias("label"))

    names = [f"v{i}" for i in range(len(outcomes))]
    wide = df.select(*(c.alias(v) for v, c in zip(names, outcomes.values())), F.array(*map(of, features)).alias("named"))
    return wide.where(" and ".join(f"{v} is not null" for v in names)).select(*names, F.inline("named"))


def value_counts(df: DataFrame, features: Sequence[str], outcomes: Mapping[str, Column], specials: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(feature, state, x, label, n, v, upto, upv, upto_total, levels, regular_levels, rows): each distinct value of each feature with its
    rows and outcome sums, and both summed up to it in the order of its state (value_rows())."""
    names = [f"v{i}" for i in range(len(outcomes))]
    rows = value_rows(df, features, outcomes, specials)
    per = rows.groupBy("feature", "state", "x", "label").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in names))
    up = cumulative(per, ["x", "label"], {"upto": "n"} | {f"up{v}": v for v in names}, ["feature", "state"])
    here = F.col("state") != "missing"
    sizes = per.groupBy("feature").agg(F.count_if(here).alias("levels"), F.count_if(F.col("state") == "regular").alias("regular_levels"), F.sum("n").alias("rows"), F.array(*(F.sum(v) for v in names)).alias("all"))
    both = up.join(F.broadcast(sizes), "feature")  # one row a feature
    return both.select("feature", "state", "x", "label", "n", F.array(*names).alias("v"), "upto", F.array(*(f"up{v}" for v in names)).alias("upv"), F.array(*(f"up{v}_total" for v in names)).alias("upv_total"), "upto_total", "levels", "regular_levels", "rows", "all")


def cell_of(limit: int = CELLS) -> Column:
    """The cell of a value of `value_counts`: its own, or one of `limit` of equal shares of rows where there are more values."""
    many = (F.col("state") == "regular") & (F.col("regular_levels") > limit)
    return F.when(many, F.floor((F.col("upto") - F.col("n")) * limit / F.col("upto_total")).cast("double")).otherwise(F.col("x"))


def cells(counts: DataFrame, outcomes: int = 1, limit: int = CELLS) -> DataFrame:
    """`counts` with at most `limit` cells of regular values a feature: each value is its own cell where that is enough, else
    values are gathered by equal shares of rows, whole values only."""
    per = counts.withColumn("cell", cell_of(limit)).groupBy("feature", "state", "cell", "label")
    sums = F.array(*(F.sum(F.col("v")[i]) for i in range(outcomes)))
    return per.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("n"), sums.alias("v"), F.first("levels").alias("levels"))


class Node:
    __slots__ = ("at", "depth", "gain", "path", "split")

    def __init__(self, at, depth, path):
        self.at, self.depth, self.path = at, depth, path


class Tree:
    """Best-first tree of one feature over its cells: each column of the feature (its value, with the median where it has none, an
    indicator of missing values, one of each special code or category) may be cut anywhere."""

    def __init__(self, g: pd.DataFrame, leaves: int, depth: int, share: float):
        self.name, self.g = g.feature.iloc[0], g
        self.n, self.v = g.n.to_numpy(float), np.stack(g.v.to_list()).astype(float)
        total, states = self.n.sum(), int(g.levels.iloc[0]) + int((g.state == "missing").any())
        self.least = max(LEAST_LEAF, math.ceil(share * total))
        self.most, self.deepest = max(2, min(leaves, states)), max(1, min(depth, states - 1))
        self.columns = self.tests()
        self.leaves = [self.node(np.arange(len(g)), 0, [])]
        while len(self.leaves) < self.most:
            best = max(self.leaves, key=lambda x: x.gain)
            if best.split is None:
                break
            self.leaves.remove(best)
            column, cut = best.split
            left = self.columns[column][best.at] <= cut
            for side, kept in ((True, left), (False, ~left)):
                self.leaves.append(self.node(best.at[kept], best.depth + 1, [*best.path, self.condition(column, cut, side)]))

    def tests(self) -> dict:
        g, out = self.g, {}
        regular = (g.state == "regular").to_numpy()
        if regular.any():
            order = np.argsort(g.high.to_numpy(float)[regular])
            upto, value = self.n[regular][order].cumsum(), g.high.to_numpy(float)[regular][order]
            places = [(upto[-1] - 1) // 2, upto[-1] // 2]
            median = sum(value[np.searchsorted(upto, p, "right")] for p in places) / 2
            out["value", ""] = np.where(regular, g.high.to_numpy(float), median)
        for state in sorted({s for s in g.state if s not in ("regular", "category")}):
            out["state", state] = (g.state == state).to_numpy().astype(float)
        for label in sorted({x for x, s in zip(g.label, g.state) if s == "category"}):
            out["label", label] = (g.label == label).to_numpy().astype(float)
        return out

    def node(self, at, depth: int, path: list) -> Node:
        node = Node(at, depth, path)
        node.gain, node.split = 0.0, None
        if depth >= self.deepest:
            return node
        n, v = self.n[at], self.v[at]
        base = (v.sum(0) ** 2).sum() / n.sum()
        for column, values in self.columns.items():
            x = values[at]
            order = np.argsort(x, kind="stable")
            x, ln, lv = x[order], n[order].cumsum(), v[order].cumsum(0)
            cuts = np.flatnonzero(x[:-1] < x[1:])
            rn = ln[-1] - ln[cuts]
            able = (ln[cuts] >= self.least) & (rn >= self.least)
            cuts, rn = cuts[able], rn[able]
            if not len(cuts):
                continue
            gains = (lv[cuts] ** 2).sum(1) / ln[cuts] + ((lv[-1] - lv[cuts]) ** 2).sum(1) / rn - base
            k = int(np.argmax(gains))
            if gains[k] > node.gain + 1e-9:
                node.gain, node.split = float(gains[k]), (column, x[cuts[k]])
        return node

    def condition(self, column: tuple, cut: float, left: bool) -> str:
        """As text, with the observed values next to the cut."""
        kind, what = column
        if kind == "value":
            seen = self.g.loc[self.g.state == "regular"]
            side = seen.high[seen.high <= cut].max() if left else seen.low[seen.low > cut].min()
            return f"{self.name} {'<=' if left else '>='} {side:.6g}" if side == side else f"{self.name} {'<=' if left else '>'} {cut:.4g}"
        word = "is not" if left else "is"
        return f"{self.name} {word} {what if kind == 'label' else what.replace('special:', 'special value ')}"


_LEAVES = "feature string, configuration string, leaf int, rule array<string>, state string, label string, low double, high double, n bigint, v array<double>, most_leaves int"


def grown(cell_counts: DataFrame, trees: Mapping[str, tuple] = TREES) -> DataFrame:
    """The trees of every feature: a row for each cell with its leaf and the leaf's rule, so leaves are sums of rows and cells
    lead rows to leaves (TA-18, TA-24). One small group a feature; more than CELLS categories are an error."""

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        if (g.state == "category").sum() > CELLS:
            raise ValueError(f"{g.feature.iloc[0]} has more than {CELLS} categories; gather the rare ones first")
        g = g.sort_values(["state", "low", "label"]).reset_index(drop=True)
        out = []
        for name, (leaves, depth, share) in trees.items():
            tree = Tree(g, leaves, depth, share)
            for i, leaf in enumerate(sorted(tree.leaves, key=lambda x: int(x.at[0]))):
                for k in leaf.at:
                    r = g.iloc[int(k)]
                    out.append((r.feature, name, i, leaf.path or ["all rows"], r.state, r.label, r.low, r.high, int(r.n), list(map(float, r.v)), tree.most))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _LEAVES.split(", ")])

    ship(cell_counts.sparkSession)
    return cell_counts.groupBy("feature").applyInPandas(grow, _LEAVES)


def leaf_table(trees: DataFrame, outcomes: int = 1) -> DataFrame:
    """(feature, configuration, leaf, rule, n, v, low, high, regular, missing, special, most_leaves): the leaves of trees, the
    ends of their regular values and the mix of their rows."""
    at = lambda s: F.sum(F.when(s, F.col("n")).otherwise(0))
    sums = F.array(*(F.sum(F.col("v")[i]) for i in range(outcomes)))
    return trees.groupBy("feature", "configuration", "leaf", F.array_join("rule", " and ").alias("rule"), "most_leaves").agg(
        F.sum("n").alias("n"), sums.alias("v"), F.min("low").alias("low"), F.max("high").alias("high"),
        at(F.col("state").isin("regular", "category")).alias("regular"), at(F.col("state") == "missing").alias("missing"), at(F.col("state").startswith("special:")).alias("special"),
    )


def class_aucs(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by..., auc, macro, weighted): of groups with n rows and outcome sums v, scored by each outcome's rate; one outcome is
    an event, more are classes against the rest: the largest AUC, their mean, and their mean by rows (TA-21)."""
    one = scored.select(*by, "n", F.posexplode("v").alias("outcome", "p"))
    found = grouped_auc(one.select(*by, "outcome", (F.col("p") / F.col("n")).alias("score"), "p", (F.col("n") - F.col("p")).alias("q")), [*by, "outcome"])
    rows = one.groupBy(*by, "outcome").agg(F.sum("p").alias("rows"))
    return found.join(rows, [*by, "outcome"]).groupBy(*by).agg(F.max("auc").alias("auc"), F.avg("auc").alias("macro"), (F.sum(F.col("auc") * F.col("rows")) / F.sum("rows")).alias("weighted"))


def continuous_separation(df: DataFrame, features: Sequence[str], target: str, specials: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """tree_separation() for a continuous target: trees by squared error, whose leaves' means are scored by the concordance of pairs of
    rows with different targets (TA-18, TA-20). Values lead rows to cells and cells to leaves; what is compared are the counts of (leaf,
    target), of all features and trees at once."""
    outcomes = {"1": F.col(target).cast("double")}
    counts = materialise(value_counts(df, features, outcomes, specials), "counts")
    keys = ["feature", "state", "label"]
    trees = materialise(grown(cells(counts)), "trees")
    leaves = materialise(leaf_table(trees), "leaves")
    means = trees.join(leaves.select("feature", "configuration", "leaf", (F.col("v")[0] / F.col("n")).alias("score")), ["feature", "configuration", "leaf"])
    cell = counts.withColumn("cell", cell_of()).groupBy(*keys, "cell").agg(F.min("x").alias("low"))
    same = lambda a, b, names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    scores = means.alias("m").join(F.broadcast(cell.alias("c")), same("m", "c", [*keys, "low"])).select("m.configuration", "m.score", *(F.col(f"m.{k}").alias(k) for k in keys), "c.cell")  # CELLS a feature
    values = counts.select("feature", "state", "label", "x", cell_of().alias("cell"))
    rows = value_rows(df, features, outcomes, specials).groupBy(*keys, "x", F.col("v0").alias("y")).agg(F.count("*").alias("n"))
    placed = rows.alias("r").join(values.alias("v"), same("r", "v", [*keys, "x"])).groupBy(*(F.col(f"r.{k}").alias(k) for k in keys), "v.cell", "r.y").agg(F.sum("r.n").alias("n"))
    scored = placed.alias("p").join(F.broadcast(scores.alias("s")), same("p", "s", [*keys, "cell"])).select("p.feature", "s.configuration", "s.score", "p.y", "p.n")
    aucs = concordance(scored, "score", "y", ["feature", "configuration"], "n")
    every = leaves.select("feature", "configuration").distinct().join(aucs, ["feature", "configuration"], "left").na.fill(0.5, ["auc"])
    return judged(every.withColumns({"macro": F.col("auc"), "weighted": F.col("auc")}), leaves)


def tier(auc: Column) -> Column:
    return F.when(auc >= HIGH_RISK, "high").when(auc >= MEDIUM_RISK, "medium").otherwise("low")


def tree_separation(counts: DataFrame, outcomes: int = 1) -> DataFrame:
    """Per feature: AUC of the primary tree and its risk; for medium risk also the conservative tree, for high risk the
    permissive one too, the spread of their AUCs, and what that says of its robustness (TA-18)."""
    leaves = materialise(leaf_table(grown(cells(counts, outcomes)), outcomes), "leaves")
    return judged(class_aucs(leaves, ["feature", "configuration"]), leaves)


def judged(aucs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Risk and robustness of each feature by the AUCs of its trees."""
    found = aucs.withColumn("tier", tier(F.col("auc")))
    found = found.join(leaves.groupBy("feature", "configuration", "most_leaves").agg(F.count("*").cast("int").alias("leaves")), ["feature", "configuration"])
    mine = F.struct("auc", "macro", "weighted", "tier", "leaves", "most_leaves")
    wide = found.groupBy("feature").agg(*(F.max(F.when(F.col("configuration") == c, mine)).alias(c) for c in TREES))
    p, c, l = (F.col(x) for x in TREES)
    risk = p["tier"]
    tested = F.when(risk == "high", F.array(p, c, l)).when(risk == "medium", F.array(p, c)).otherwise(F.array(p))
    aucs, tiers = F.transform(tested, lambda t: t["auc"]), F.transform(tested, lambda t: t["tier"])
    spread = F.array_max(aucs) - F.array_min(aucs)
    robust = (
        F.when(F.size(tested) == 1, "not sensitivity-tested (low initial risk)").when((spread > STABLE) | (F.size(F.array_distinct(tiers)) > 1), "configuration-sensitive")
        .when(risk == "high", "robust high association").otherwise("stable within tested configurations")
    )
    return wide.select(
        "feature", p["auc"].alias("auc"), (2 * p["auc"] - 1).alias("gini"), p["macro"].alias("macro"), p["weighted"].alias("weighted"), risk.alias("risk"),
        p["leaves"].alias("leaves"), (p["leaves"] >= p["most_leaves"]).alias("leaf_cap_reached"), spread.alias("spread"), robust.alias("robustness"),
    )


def benchmark_buckets(counts: DataFrame, buckets: int = 10) -> DataFrame:
    """(feature, bucket, n, v): quantile buckets of the regular values of each feature, as many as it has values at most, and a bucket
    each of missing values and special codes."""
    regular = counts.where("state = 'regular'")
    parts = F.greatest(F.lit(2), F.least(F.lit(buckets), F.col("regular_levels")))
    # the share of each edge depends on the feature's own number of buckets
    at = []
    for i in range(1, buckets):
        place = (F.col("upto_total") - 1) * i / parts
        value = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("x")))
        lo, hi, part = value(F.floor(place)), value(F.ceil(place)), F.max(place - F.floor(place))
        at.append(F.when(i < F.max(parts), lo + (hi - lo) * part))
    edges = regular.groupBy("feature").agg(F.array_compact(F.array(*at)).alias("edges"))
    joined = counts.join(F.broadcast(edges), "feature", "left")  # one row a feature
    number = F.size(F.filter(F.array_distinct("edges"), lambda e: e < F.col("x")))
    bucket = F.when(F.col("state") == "regular", F.concat(F.lit("R"), number.cast("string"))).when(F.col("state") == "category", F.concat(F.lit("="), F.col("label"))).otherwise(F.upper("state"))
    one = joined.select("feature", bucket.alias("bucket"), "n", F.posexplode("v").alias("outcome", "p"))
    sums = one.groupBy("feature", "bucket", "outcome").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    return sums.groupBy("feature", "bucket", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("outcome", "p"))), lambda s: s["p"]).alias("v"))


def percentile_benchmark(counts: DataFrame, buckets: int = 10) -> DataFrame:
    """AUC of buckets scored by their own outcome rates (TA-21)."""
    return class_aucs(benchmark_buckets(counts, buckets), ["feature"]).withColumn("gini", 2 * F.col("auc") - 1)


@F.pandas_udf(T.DoubleType())
def _fisher(hits: pd.Series, drawn: pd.Series, events: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_greater(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(hits, drawn, events, total)], dtype="float64")


def tried(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, outcome, kind, value, label, rows, events, all_events, all_rows) of every state, category, tail and, where a feature has few
    values, single value that is large enough to be tried, and not the whole (TA-22)."""
    lead = F.col("upto") < F.col("upto_total")
    one = counts.select("feature", "state", "x", "label", "n", "upto", "upto_total", "regular_levels", "rows", F.posexplode(F.arrays_zip("v", "upv", "upv_total", "all")).alias("outcome", "o"))
    each = F.array_compact(F.array(
        F.when(F.col("state") != "regular", F.struct(F.col("state").alias("kind"), F.col("n").alias("rows"), F.col("o.v").alias("events"))),
        F.when((F.col("state") == "regular") & lead, F.struct(F.lit("lower").alias("kind"), F.col("upto").alias("rows"), F.col("o.upv").alias("events"))),
        F.when((F.col("state") == "regular") & lead, F.struct(F.lit("upper").alias("kind"), (F.col("upto_total") - F.col("upto")).alias("rows"), (F.col("o.upv_total") - F.col("o.upv")).alias("events"))),
        F.when((F.col("state") == "regular") & (F.col("regular_levels") <= SCAN["exact"]), F.struct(F.lit("exact").alias("kind"), F.col("n").alias("rows"), F.col("o.v").alias("events"))),
    ))
    all_ = one.select("feature", F.element_at(F.array(*map(F.lit, names)), F.col("outcome") + 1).alias("outcome"), F.col("x").alias("value"), "label", F.col("rows").alias("all_rows"), F.col("o.all").alias("all_events"), F.explode(each).alias("k"))
    least = F.greatest(F.lit(SCAN["rows"]), F.ceil(F.lit(SCAN["share"]) * F.col("all_rows")))
    return all_.select("feature", "outcome", "k.kind", "value", "label", "k.rows", "k.events", "all_events", "all_rows").where((F.col("rows") >= least) & (F.col("rows") < F.col("all_rows")))


def localized(counts: DataFrame, names: Sequence[str] = ("1",)) -> DataFrame:
    """Leakage that a whole AUC does not show: the best state, value or tail of each feature and outcome whose rate is high, well
    above the outcome's own and, by Fisher's exact test adjusted for all that was tried, no chance (TA-22, TA-23)."""
    ship(counts.sparkSession)
    all_ = materialise(tried(counts, names), "tried")
    rate, base = F.col("events") / F.col("rows"), F.col("all_events") / F.col("all_rows")
    kept = all_.where((F.col("events") >= SCAN["events"]) & (rate >= SCAN["rate"]) & (rate - base >= SCAN["rise"]))
    number = all_.agg(F.count("*").alias("tests"))
    scored = kept.crossJoin(F.broadcast(number)).withColumn("p", F.least(F.lit(1.0), _fisher("events", "rows", "all_events", "all_rows") * F.col("tests")))  # one row
    sure = scored.where(F.col("p") <= SCAN["p"]).withColumn("capture", F.col("events") / F.col("all_events"))
    # of equals, states come before tails, tails in the order of their values, single values last; candidates may be many
    place = F.when(F.col("kind") == "exact", 2).when(F.col("kind").isin("lower", "upper"), 1).otherwise(0)
    row = F.struct("rows", F.col("events").cast("bigint").alias("events"), rate.alias("rate"), base.alias("base_rate"), (rate / base).alias("lift"), "capture", "p")
    best = sure.groupBy("feature", "outcome").agg(F.min(F.struct((-F.col("capture")).alias("less"), F.col("p").alias("first"), place.alias("place"), "value", "kind", "label", row.alias("row"))).alias("b"))
    return best.select("feature", "outcome", "b.kind", "b.value", "b.label", "b.row.*")


def separation(auc: Column, iv: Column) -> Column:
    """suspicious, strong, medium or weak by AUC or information value (TA-25)."""
    return F.when((auc >= 0.9) | (iv >= 0.5), "suspicious").when((auc >= 0.7) | (iv >= 0.3), "strong").when((auc >= 0.55) | (iv >= 0.05), "medium").otherwise("weak")


def separation_table(aucs: DataFrame, ivs: DataFrame, leaks: DataFrame | None = None) -> DataFrame:
    """AUC and information value by feature, whether the scan found it a candidate of leakage, its category, and the finding with all its
    reasons: any sign of leakage, or else any of poor discrimination (TA-26, TA-27)."""
    both = aucs.select("feature", "auc").join(ivs.select("feature", "iv"), "feature", "full_outer")
    if leaks is None:
        both = both.withColumn("leakage_status", F.lit("not_available"))
    else:
        both = both.join(leaks.select("feature").distinct().withColumn("_leaks", F.lit(True)), "feature", "left").withColumn("leakage_status", F.when(F.col("_leaks"), "candidate").otherwise("clear")).drop("_leaks")
    auc, iv, local = F.col("auc"), F.col("iv"), F.col("leakage_status") == "candidate"
    said = [(auc >= LEAKAGE_AUC, "auc_leakage_threshold"), (iv >= LEAKAGE_IV, "iv_leakage_threshold"), (local, "localized_leakage"), (auc < POOR_AUC, "auc_poor_discrimination"), (iv < POOR_IV, "iv_poor_discrimination")]
    reasons = F.array_compact(F.array(*(F.when(c, r) for c, r in said)))
    leak = F.arrays_overlap(reasons, F.array(*(F.lit(r) for _, r in said[:3])))
    finding = F.when(leak, "target_leakage").when(F.size(reasons) > 0, "poor_discrimination")
    return both.withColumns({"category": separation(auc, iv), "finding": finding, "reasons": F.array_join(reasons, "; ")})


def _line(spark, sf_dir) -> DataFrame:
    """Line items with a missing discount, a special quantity and a price band."""
    df = table(spark, sf_dir, "lineitem")
    return df.withColumns({
        "discount": F.when(F.col("l_discount") < 0.08, F.col("l_discount")), "quantity": F.when(F.col("l_quantity") > 48, -1.0).otherwise(F.col("l_quantity")),
        "size": F.when(F.col("l_quantity") > 45, "large").when(F.col("l_quantity") > 20, "middle").otherwise("small"), "y": ((F.col("l_quantity") > 45) | ((F.col("l_quantity") < 12) & (F.col("l_discount") > 0.06))).cast("int"),
    })


_FEATURES = ["quantity", "discount", "l_tax", "size", "l_returnflag"]
_SPECIALS = {"quantity": [-1.0]}
_LINE = """line AS (SELECT *, CASE WHEN l_discount < 0.08 THEN l_discount END AS discount, CASE WHEN l_quantity > 48 THEN -1.0 ELSE l_quantity END AS quantity,
 CASE WHEN l_quantity > 45 THEN 'large' WHEN l_quantity > 20 THEN 'middle' ELSE 'small' END AS size, (l_quantity > 45 OR (l_quantity < 12 AND l_discount > 0.06))::INT AS y FROM lineitem)"""
_COUNTS = f"""{_LINE}, per AS (SELECT 'quantity' AS feature, CASE WHEN quantity = -1 THEN 'special:-1.0' ELSE 'regular' END AS state, CASE WHEN quantity <> -1 THEN quantity END AS x, NULL AS label, count(*) AS n, sum(y) AS e FROM line GROUP BY ALL
 UNION ALL SELECT 'discount', CASE WHEN discount IS NULL THEN 'missing' ELSE 'regular' END, discount, NULL, count(*), sum(y) FROM line GROUP BY ALL UNION ALL SELECT 'l_tax', 'regular', l_tax, NULL, count(*), sum(y) FROM line GROUP BY ALL
 UNION ALL SELECT 'size', 'category', NULL, size, count(*), sum(y) FROM line GROUP BY ALL UNION ALL SELECT 'l_returnflag', 'category', NULL, l_returnflag, count(*), sum(y) FROM line GROUP BY ALL)"""


def _counts(spark, sf_dir) -> DataFrame:
    return value_counts(_line(spark, sf_dir), _FEATURES, outcomes_of(F.col("y")), _SPECIALS)


@query("separation_tree_cut", f"""WITH {_COUNTS}, m AS (SELECT 'quantity' AS feature, quantile_cont(quantity, 0.5) FILTER (WHERE quantity <> -1) AS med FROM line UNION ALL SELECT 'discount', quantile_cont(discount, 0.5) FROM line UNION ALL SELECT 'l_tax', quantile_cont(l_tax, 0.5) FROM line),
 t AS (SELECT feature, sum(n) AS tn, sum(e) AS te FROM per GROUP BY 1),
 c AS (SELECT per.feature, 'value' AS kind, '' AS what, coalesce(x, med) AS place, n, e FROM per JOIN m USING (feature)
  UNION ALL SELECT feature, 'state', s, (state = s)::INT, n, e FROM per JOIN (SELECT DISTINCT feature, state AS s FROM per WHERE state NOT IN ('regular', 'category')) USING (feature)
  UNION ALL SELECT feature, 'label', l, (label = l)::INT, n, e FROM per JOIN (SELECT DISTINCT feature, label AS l FROM per WHERE state = 'category') USING (feature)),
 v AS (SELECT feature, kind, what, place, sum(n) AS n, sum(e) AS e FROM c GROUP BY ALL), u AS (SELECT *, sum(n) OVER w AS ln, sum(e) OVER w AS le, lead(place) OVER w AS next FROM v WINDOW w AS (PARTITION BY feature, kind, what ORDER BY place)),
 g AS (SELECT feature, kind, ln, le, tn - ln AS rn, te - le AS re, le * le / ln + (te - le) * (te - le) / (tn - ln) - te * te / tn AS gain FROM u JOIN t USING (feature) WHERE next IS NOT NULL AND ln >= greatest(50, ceil(0.01 * tn)) AND tn - ln >= greatest(50, ceil(0.01 * tn)))
 SELECT feature, ln::BIGINT AS left_rows, le::DOUBLE AS left_events, rn::BIGINT AS right_rows, re::DOUBLE AS right_events FROM g WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, kind = 'value' DESC) = 1""")
def separation_tree_cut(spark, sf_dir):
    """The first cut of every feature's tree, over its value, its missing values, its special codes and its categories."""
    leaves = leaf_table(grown(cells(_counts(spark, sf_dir)), {"first": (2, 1, 0.01)}))
    both = leaves.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct(F.col("rule").rlike(" (>=|>|is) (?!not)").alias("right"), "n", F.col("v")[0].alias("s")))).alias("k")).where(F.size("k") == 2)
    return both.select("feature", F.col("k")[0]["n"].alias("left_rows"), F.col("k")[0]["s"].alias("left_events"), F.col("k")[1]["n"].alias("right_rows"), F.col("k")[1]["s"].alias("right_events"))


@query("separation_tree_risk", f"""WITH {_COUNTS}, a AS (SELECT feature, e / n AS score, sum(e) AS p, sum(n - e) AS q FROM per WHERE feature IN ('size', 'l_returnflag') GROUP BY 1, 2),
 c AS (SELECT feature, p * (sum(q) OVER (PARTITION BY feature ORDER BY score) - q / 2) AS a, p, q FROM a), u AS (SELECT feature, sum(a) / (sum(p) * sum(q)) AS x, count(*) AS leaves FROM c GROUP BY 1), z AS (SELECT feature, greatest(x, 1 - x) AS auc, leaves FROM u)
 SELECT feature, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, CASE WHEN auc >= 0.75 THEN 'high' WHEN auc >= 0.6 THEN 'medium' ELSE 'low' END AS risk, leaves::INTEGER AS leaves, 0.0 AS spread,
 CASE WHEN auc >= 0.75 THEN 'robust high association' WHEN auc >= 0.6 THEN 'stable within tested configurations' ELSE 'not sensitivity-tested (low initial risk)' END AS robustness FROM z""")
def separation_tree_risk(spark, sf_dir):
    """Risk and robustness of two features of three categories, which every tree tells apart wholly."""
    found = tree_separation(value_counts(_line(spark, sf_dir), ["size", "l_returnflag"], outcomes_of(F.col("y"))))
    return found.select("feature", rounded(F.col("auc")).alias("auc"), rounded(F.col("gini")).alias("gini"), "risk", "leaves", rounded(F.col("spread")).alias("spread"), "robustness")


@query("separation_tree")
def separation_tree(spark, sf_dir):
    """Risk of all features, numeric ones with missing values and special codes; no SQL (best-first growth), equal to a search by
    definition in the tests."""
    found = tree_separation(_counts(spark, sf_dir))
    return found.withColumns({c: rounded(F.col(c)) for c in ("auc", "gini", "macro", "weighted", "spread")})


@query("separation_tree_leaves")
def separation_tree_leaves(spark, sf_dir):
    """The leaves of the primary trees, with rules, ends and mixes; no SQL, tested like separation_tree."""
    return leaf_table(grown(cells(_counts(spark, sf_dir)), {"primary": TREES["primary"]})).select("feature", "leaf", "rule", "n", F.col("v")[0].alias("events"), "low", "high", "regular", "missing", "special")


@query("separation_tree_classes", f"""WITH {_LINE}, per AS (SELECT l_linestatus AS v, l_returnflag AS c, count(*) AS k FROM line GROUP BY ALL), b AS (SELECT v, sum(k) AS n FROM per GROUP BY 1), t AS (SELECT c, sum(k) AS rows FROM per GROUP BY 1),
 g AS (SELECT t.c, rows, b.v, n, coalesce(k, 0) AS k FROM b CROSS JOIN t LEFT JOIN per ON per.v = b.v AND per.c = t.c), a AS (SELECT c, any_value(rows) AS rows, k / n AS score, sum(k) AS p, sum(n - k) AS q FROM g GROUP BY c, k / n),
 d AS (SELECT c, rows, p * (sum(q) OVER (PARTITION BY c ORDER BY score) - q / 2) AS a, p, q FROM a), u AS (SELECT c, any_value(rows) AS rows, sum(a) / (sum(p) * sum(q)) AS x FROM d GROUP BY 1)
 SELECT 'l_linestatus' AS feature, round(max(greatest(x, 1 - x)), 6) AS auc, round(avg(greatest(x, 1 - x)), 6) AS macro, round(sum(greatest(x, 1 - x) * rows) / sum(rows), 6) AS weighted FROM u""")
def separation_tree_classes(spark, sf_dir):
    """A target of three classes, one against the rest."""
    counts = value_counts(_line(spark, sf_dir), ["l_linestatus"], outcomes_of(F.col("l_returnflag"), ["A", "N", "R"]))
    return tree_separation(counts, 3).select("feature", *(rounded(F.col(c)).alias(c) for c in ("auc", "macro", "weighted")))


@query("separation_tree_continuous", """WITH per AS (SELECT l_returnflag AS v, count(*) AS n, avg(l_extendedprice) AS score FROM lineitem GROUP BY 1), c AS (SELECT v, l_quantity::DOUBLE AS t, count(*) AS n FROM lineitem GROUP BY ALL),
 m AS (SELECT l_returnflag AS v, avg(l_quantity) AS score FROM lineitem GROUP BY 1), p AS (SELECT sum(a.n * b.n * CASE WHEN x.score = y.score THEN 0.5 WHEN x.score > y.score THEN 1 ELSE 0 END) / sum(a.n * b.n) AS u FROM c a JOIN m x ON x.v = a.v, c b JOIN m y ON y.v = b.v WHERE a.t > b.t)
 SELECT 'l_returnflag' AS feature, round(greatest(u, 1 - u), 6) AS auc, CASE WHEN greatest(u, 1 - u) >= 0.75 THEN 'high' WHEN greatest(u, 1 - u) >= 0.6 THEN 'medium' ELSE 'low' END AS risk FROM p""".replace("SELECT v, l_quantity::DOUBLE", "SELECT l_returnflag AS v, l_quantity::DOUBLE"))
def separation_tree_continuous(spark, sf_dir):
    """Three categories against a quantity: their means order the pairs of rows."""
    found = continuous_separation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return found.select("feature", rounded(F.col("auc")).alias("auc"), "risk")


@query("separation_benchmark", f"""WITH {_LINE}, e AS (SELECT quantile_cont(quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (WHERE quantity <> -1) AS q, quantile_cont(discount, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS d FROM line),
 s AS (SELECT 'quantity' AS feature, CASE WHEN quantity = -1 THEN 'S' ELSE 'R' || len(list_filter(list_distinct(q), lambda z: z < quantity)) END AS b, count(*) AS n, sum(y) AS s FROM line, e GROUP BY ALL
  UNION ALL SELECT 'discount', CASE WHEN discount IS NULL THEN 'M' ELSE 'R' || len(list_filter(list_distinct(d), lambda z: z < discount)) END, count(*), sum(y) FROM line, e GROUP BY ALL),
 a AS (SELECT feature, s / n AS score, sum(s) AS p, sum(n - s) AS q FROM s GROUP BY 1, 2), c AS (SELECT feature, p * (sum(q) OVER (PARTITION BY feature ORDER BY score) - q / 2) AS a, p, q FROM a), u AS (SELECT feature, sum(a) / (sum(p) * sum(q)) AS x FROM c GROUP BY 1)
 SELECT feature, round(greatest(x, 1 - x), 6) AS auc, round(2 * greatest(x, 1 - x) - 1, 6) AS gini FROM u""")
def separation_benchmark(spark, sf_dir):
    """Buckets of values (ten, and eight where there are eight values), of missing values and of a special code."""
    counts = value_counts(_line(spark, sf_dir), ["quantity", "discount"], outcomes_of(F.col("y")), _SPECIALS)
    return percentile_benchmark(counts).select("feature", rounded(F.col("auc")).alias("auc"), rounded(F.col("gini")).alias("gini"))


_FISHER = "exp(lgamma(te + 1) - lgamma(i + 1) - lgamma(te - i + 1) + lgamma(tn - te + 1) - lgamma(n - i + 1) - lgamma(tn - te - n + i + 1) - lgamma(tn + 1) + lgamma(n + 1) + lgamma(tn - n + 1))"
_SCANNED = f"""{_COUNTS}, t AS (SELECT feature, sum(n)::BIGINT AS tn, sum(e)::BIGINT AS te, count(*) FILTER (WHERE state = 'regular') AS levels FROM per GROUP BY 1),
 c AS (SELECT *, sum(n) OVER w AS un, sum(e) OVER w AS ue, sum(n) OVER a AS an, sum(e) OVER a AS ae FROM per JOIN t USING (feature) WINDOW w AS (PARTITION BY feature, state ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature, state)),
 k AS (SELECT feature, state AS kind, x AS value, label, n::BIGINT AS n, e::BIGINT AS e, tn, te FROM c WHERE state <> 'regular' UNION ALL SELECT feature, 'lower', x, label, un::BIGINT, ue::BIGINT, tn, te FROM c WHERE state = 'regular' AND un < an
  UNION ALL SELECT feature, 'upper', x, label, (an - un)::BIGINT, (ae - ue)::BIGINT, tn, te FROM c WHERE state = 'regular' AND un < an UNION ALL SELECT feature, 'exact', x, label, n::BIGINT, e::BIGINT, tn, te FROM c WHERE state = 'regular' AND levels <= 20),
 s AS (SELECT *, count(*) OVER () AS tests FROM k WHERE n >= greatest(30, ceil(0.001 * tn)) AND n < tn),
 p AS (SELECT *, least(1, tests * list_sum(list_transform(range(greatest(e, n - tn + te), least(n, te) + 1), lambda i: {_FISHER}))) AS p FROM s WHERE e >= 5 AND e / n >= 0.9 AND e / n - te / tn >= 0.1),
 leaks AS (SELECT * FROM p WHERE p <= 0.01 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY e / te DESC, p, CASE WHEN kind = 'exact' THEN 2 WHEN kind IN ('lower', 'upper') THEN 1 ELSE 0 END, value, kind, label) = 1)"""


@query("separation_localized", f"""WITH {_SCANNED} SELECT feature, '1' AS outcome, kind, value, label, n AS rows, e AS events, round(e / n, 6) AS rate, round(te / tn, 6) AS base_rate, round(e * tn / n / te, 5) AS lift, round(e / te, 6) AS capture, round(p, 8) AS p FROM leaks""")
def separation_localized(spark, sf_dir):
    found = localized(_counts(spark, sf_dir))
    return found.withColumns({c: rounded(F.col(c), d) for c, d in (("rate", 6), ("base_rate", 6), ("lift", 5), ("capture", 6), ("p", 8))})


@query("separation_table", f"""WITH {_SCANNED}, b AS (SELECT feature, CASE WHEN state = 'regular' THEN 'R' || x ELSE coalesce(label, state) END AS bin, n, e FROM per WHERE feature <> 'quantity'), w AS (SELECT *, count(*) OVER f AS k, sum(e) OVER f AS be, sum(n - e) OVER f AS bn FROM b WINDOW f AS (PARTITION BY feature)),
 i AS (SELECT feature, sum(((n - e + 0.5) / (bn + 0.5 * k) - (e + 0.5) / (be + 0.5 * k)) * ln(((n - e + 0.5) / (bn + 0.5 * k)) / ((e + 0.5) / (be + 0.5 * k)))) AS iv FROM w GROUP BY 1),
 o AS (SELECT feature, e / n AS score, sum(e) AS p, sum(n - e) AS q FROM per WHERE feature <> 'l_tax' GROUP BY 1, 2), r AS (SELECT feature, p * (sum(q) OVER (PARTITION BY feature ORDER BY score) - q / 2) AS a, p, q FROM o), u AS (SELECT feature, sum(a) / (sum(p) * sum(q)) AS x FROM r GROUP BY 1),
 z AS (SELECT feature, greatest(x, 1 - x) AS auc, iv, CASE WHEN feature IN (SELECT feature FROM leaks) THEN 'candidate' ELSE 'clear' END AS leakage_status FROM u FULL JOIN i USING (feature)),
 y AS (SELECT *, list_filter([CASE WHEN auc >= 0.9 THEN 'auc_leakage_threshold' END, CASE WHEN iv >= 0.5 THEN 'iv_leakage_threshold' END, CASE WHEN leakage_status = 'candidate' THEN 'localized_leakage' END, CASE WHEN auc < 0.6 THEN 'auc_poor_discrimination' END, CASE WHEN iv < 0.05 THEN 'iv_poor_discrimination' END], lambda q: q IS NOT NULL) AS r FROM z)
 SELECT feature, round(auc, 6) AS auc, round(iv, 6) AS iv, leakage_status, CASE WHEN auc >= 0.9 OR iv >= 0.5 THEN 'suspicious' WHEN auc >= 0.7 OR iv >= 0.3 THEN 'strong' WHEN auc >= 0.55 OR iv >= 0.05 THEN 'medium' ELSE 'weak' END AS category,
 CASE WHEN list_has_any(r, ['auc_leakage_threshold', 'iv_leakage_threshold', 'localized_leakage']) THEN 'target_leakage' WHEN len(r) > 0 THEN 'poor_discrimination' END AS finding, array_to_string(r, '; ') AS reasons FROM y""")
def separation_table_query(spark, sf_dir):
    """AUC of single values for some features, information value for others, and the scan for all."""
    counts = materialise(_counts(spark, sf_dir), "counts")
    one = counts.select("feature", (F.col("v")[0] / F.col("n")).alias("score"), F.col("v")[0].alias("p"), (F.col("n") - F.col("v")[0]).alias("q"))
    bins = counts.where("feature <> 'quantity'").select("feature", F.concat_ws("|", "state", F.col("x").cast("string"), "label").alias("bin"), "n", F.col("v")[0].alias("s"))
    ivs = woe(bins).groupBy("feature").agg(F.first("feature_iv").alias("iv"))
    found = separation_table(grouped_auc(one.where("feature <> 'l_tax'"), ["feature"]), ivs, localized(counts))
    return found.withColumns({"auc": rounded(F.col("auc")), "iv": rounded(F.col("iv"))})
