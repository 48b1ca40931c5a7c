"""Binning, weight of evidence, AUC and concordance (TA-1 to TA-16, TA-19, TA-20, TA-28, TA-29). All features of a table share one unpivoted
aggregation; optimal bins work on its bounded statistics, one feature a group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.prefix import cumulative
from plumbline.functions.values import bucket, rounded
from plumbline.plans.registry import query
from plumbline.session import materialise, ship, table

CELLS = 1000


def target_route(df: DataFrame, target: str, requested: str = "auto", label=None) -> DataFrame:
    """(kind, label) of a target: as requested, or binary with two values, continuous if a number, else multinomial; and of a binary
    one the label that counts as event, given (by text or, if one label only equals it, as a number) or the last in order
    (TA-1). Fewer than two values, or a label that is not there, are errors. The driver sees three values at most."""
    values = df.where(F.col(target).isNotNull()).select(F.col(target).alias("v")).distinct()
    found = sorted(str(r.v) for r in values.select(F.col("v").cast("string").alias("v")).limit(3).collect())
    if len(found) < 2:
        raise ValueError("the target needs two different values at least")
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    kind = requested if requested != "auto" else "binary" if len(found) == 2 else "continuous" if numeric else "multinomial"
    event = None
    if kind == "binary":
        if len(found) != 2:
            raise ValueError("a binary target has exactly two classes")
        event = found[1] if label is None else str(label)
        if event not in found:
            same = [f for f in found if _number(f) is not None and _number(f) == _number(event)]
            if len(same) != 1:
                raise ValueError(f"class {event!r} is not in {found}")
            event = same[0]
    return df.sparkSession.createDataFrame([(target, kind, event)], "target string, kind string, label string")


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def review(df: DataFrame, feature: str, definition: dict, target: Column, min_share: float = 0.02, min_events: int = 5) -> DataFrame:
    """An edited definition (edges, specials, guards) applied to all rows again: rows, events, rate, weight of evidence and information
    value of each bin, and its warnings (TA-17). Rows without a target are an error, as in a supervised fit."""
    if df.where(target.isNull()).limit(1).count():
        raise ValueError("the target has missing values")
    edges = definition.get("edges", [])
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must ascend")
    bins = apply_bins(feature, edges, definition.get("specials"), definition.get("guards"))
    stats = woe(fine_statistics(long_bins(df, {feature: bins}, target)))
    found = bin_warnings(stats, min_share, min_events).groupBy("feature", "bin").agg(F.array_join(F.array_sort(F.collect_list("warning")), "; ").alias("warnings"))
    return stats.join(found, ["feature", "bin"], "left").withColumn("warnings", F.coalesce("warnings", F.lit("")))


def positive(target: str, label) -> Column:
    """1 for the positive class by label or number, 0 for others, null for null (TA-1)."""
    c = F.col(target)
    return F.when(c.isNull(), None).when((F.trim(c.cast("string")) == str(label)) | F.coalesce(c.cast("string").try_cast("double") == F.lit(str(label)).try_cast("double"), F.lit(False)), 1).otherwise(0)


def fine_splits(df: DataFrame, feature: str, k: int = 20, zero: bool = False) -> list[float]:
    """Midpoints of neighbouring values at the first value whose cumulative count reaches each 1/k (TA-2). The driver sees
    the k values and their successors."""
    per = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("double").alias("v")).agg(F.count("*").alias("n"))
    cum = cumulative(per, ["v"], {"c": "n"})
    at = cum.groupBy(F.floor(F.col("c") * k / F.col("c_total")).alias("q")).agg(F.min("v").alias("v")).where("q >= 1")
    cuts = sorted({r.v for r in at.collect()})
    if not cuts:
        return [0.0] if zero else []
    after = per.agg(*[F.min(F.when(F.col("v") > c, F.col("v"))).alias(f"s{i}") for i, c in enumerate(cuts)]).first()
    found = {(c + s) / 2 for c, s in zip(cuts, after) if s is not None}
    return sorted(found | ({0.0} if zero else set()))


def fine_groups(df: DataFrame, feature: str, top: int = 49) -> DataFrame:
    """value -> bin: the `top` most frequent (ties by value), the rest OTHER (TA-3)."""
    per = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("string").alias("value")).agg(F.count("*").alias("n"))
    first = per.orderBy(F.desc("n"), "value").limit(top).select("value", F.col("value").alias("bin"))  # `top` rows
    return per.join(F.broadcast(first), "value", "left").withColumn("bin", F.coalesce("bin", F.lit("OTHER")))


def apply_bins(feature: str, edges: list[float], specials: list | None = None, guards: tuple[float, float] | None = None) -> Column:
    """MISSING, S<n>, GUARD_LOW, GUARD_HIGH or R<n> of a numeric definition (TA-4)."""
    c = F.col(feature)
    out = F.when(c.isNull(), "MISSING")
    for i, v in enumerate(specials or []):
        out = out.when(c.cast("double") == float(v), f"S{i}")
    if guards:
        out = out.when(c < guards[0], "GUARD_LOW").when(c > guards[1], "GUARD_HIGH")
    return out.otherwise(F.concat(F.lit("R"), bucket(c.cast("double"), edges, right=True).cast("string")))


def long_bins(df: DataFrame, definitions: dict[str, Column], target: Column) -> DataFrame:
    """(feature, bin, y): one row a feature and row (TA-16, TA-17)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), b.alias("bin")) for f, b in definitions.items()])).alias("b")
    return df.select(target.alias("y"), pairs).where("y is not null").select("y", "b.*")


def fine_statistics(rows: DataFrame) -> DataFrame:
    """Sufficient statistics of every fine bin: kept, coarse bins need no second scan (TA-9)."""
    return rows.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))


def coarse(fine: DataFrame, groups: DataFrame) -> DataFrame:
    """Fine statistics merged by (feature, bin, coarse); bins without a group stay alone (TA-9, TA-10)."""
    return fine.join(groups, ["feature", "bin"], "left").groupBy("feature", F.coalesce("coarse", "bin").alias("bin")).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])


def woe(stats: DataFrame) -> DataFrame:
    """Binary: event rate, weight of evidence ln(non-event share / event share) with 0.5 smoothing over the populated
    bins, information value of bin and feature (TA-5)."""
    own = Window.partitionBy("feature")
    bins = F.count("*").over(own)
    e, ne = F.col("s"), F.col("n") - F.col("s")
    pe, pn = (e + 0.5) / (F.sum("s").over(own) + 0.5 * bins), (ne + 0.5) / (F.sum(F.col("n") - F.col("s")).over(own) + 0.5 * bins)
    out = stats.select("feature", "bin", "n", F.col("s").alias("events"), (e / F.col("n")).alias("event_rate"), F.log(pn / pe).alias("woe"), ((pn - pe) * F.log(pn / pe)).alias("iv"))
    return out.withColumn("feature_iv", F.sum("iv").over(own))


def variance_ratio(stats: DataFrame) -> DataFrame:
    """Continuous: between-bin share of the variance of each feature (TA-6)."""
    total = stats.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return total.select("feature", ((F.col("b") - mean) / F.nullif(F.col("ss") - mean, F.lit(0.0))).alias("variance_ratio"))


def multinomial_iv(rows: DataFrame) -> DataFrame:
    """(feature, bin, y as class): one-versus-rest information value of each class, macro, weighted and maximum (TA-7)."""
    per = rows.groupBy("feature", "bin", "y").agg(F.count("*").alias("k"))
    bins = per.groupBy("feature", "bin").agg(F.sum("k").alias("n"))
    classes = per.groupBy("feature", "y").agg(F.sum("k").alias("events"))
    grid = bins.join(classes, "feature").join(per, ["feature", "bin", "y"], "left").withColumn("s", F.coalesce("k", F.lit(0)))
    keyed = grid.select(F.concat_ws("␟", "feature", F.col("y").cast("string")).alias("feature"), "bin", "n", "s")
    one = woe(keyed).groupBy("feature").agg(F.first("feature_iv").alias("iv"), F.sum("events").alias("events"))
    parts = F.split("feature", "␟")
    return one.select(parts[0].alias("feature"), parts[1].alias("class_"), "iv", "events").groupBy("feature").agg(F.avg("iv").alias("macro"), (F.sum(F.col("iv") * F.col("events")) / F.sum("events")).alias("weighted"), F.max("iv").alias("maximum"))


def bin_ranges(df: DataFrame, feature: str, bins: Column, expected: list[str]) -> DataFrame:
    """Rows, minimum, maximum and mean of the feature per bin; expected bins without rows (guards) count zero (TA-8)."""
    per = df.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min(feature).alias("low"), F.max(feature).alias("high"), F.avg(feature).alias("mean"))
    grid = df.sparkSession.createDataFrame([(b,) for b in expected], "bin string")
    return per.join(grid, "bin", "full_outer").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "low", "high", "mean")


def merge_categories(counts: DataFrame, max_groups: int) -> DataFrame:
    """Categories (feature, value, class_, k) merged pair by pair, the least loss of class entropy first, to at most
    `max_groups` (TA-13). One group a feature: fine groups (fine_groups) bound its categories, and more than CELLS are an
    error."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        table_ = g.pivot_table(index="value", columns="class_", values="k", aggfunc="sum", fill_value=0).sort_index()
        if len(table_) > CELLS:
            raise ValueError(f"{g.feature.iloc[0]} has {len(table_)} categories; gather the rare ones first")
        groups = [([v], row.to_numpy(float)) for v, row in table_.iterrows()]

        def cost(x):
            n = x.sum()
            return -sum(c * math.log(c / n) for c in x if c > 0) if n else 0.0

        while len(groups) > max_groups:
            loss, i, j = min((cost(groups[i][1] + groups[j][1]) - cost(groups[i][1]) - cost(groups[j][1]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            groups[i] = (groups[i][0] + groups[j][0], groups[i][1] + groups[j][1])
            del groups[j]
        rows = [(g.feature.iloc[0], v, b) for b, (values, _) in enumerate(groups) for v in values]
        return pd.DataFrame(rows, columns=["feature", "value", "grp"])

    ship(counts.sparkSession)
    return counts.groupBy("feature").applyInPandas(solve, "feature string, value string, grp bigint")


def bin_warnings(bins: DataFrame, min_share: float = 0.02, min_events: int = 5) -> DataFrame:
    """Bins that are too small or hold too few events, and breaks of monotonic event rates in bin order (TA-15)."""
    own = Window.partitionBy("feature")
    w = bins.withColumns({"share": F.col("n") / F.sum("n").over(own), "before": F.lag("event_rate").over(own.orderBy("bin")), "later": F.lead("event_rate").over(own.orderBy("bin"))})
    turn = (F.col("event_rate") - F.col("before")) * (F.col("later") - F.col("event_rate")) < 0
    found = F.array_compact(F.array(F.when(F.col("share") < min_share, "small"), F.when(F.col("events") < min_events, "few events"), F.when(turn, "not monotonic")))
    return w.select("feature", "bin", F.explode(found).alias("warning"))


#: Phases of the event rate from bin to bin (1 rises, -1 falls) that each trend allows.
TRENDS = {"ascending": (1,), "descending": (-1,), "peak": (1, -1), "valley": (-1, 1)}


def quick_limits(cells: int, max_bins: int, continuous: bool = False) -> tuple[int, int]:
    """(fine bins, coarse bins) of quick mode, by the number of distinct values (TA-14)."""
    root = math.sqrt(max(cells, 1))
    fine = max(4, min(16, math.ceil(1.5 * root)) if continuous else min(25, math.ceil(2 * root)))
    return fine, min(max_bins, max(2, min(5 if continuous else 6, math.ceil(math.log2(max(cells, 1) + 1)))))


def optimal_coarse(fine: DataFrame, max_bins: int = 5, min_share: float = 0.05, order: str = "position", min_events: float = 0, min_difference: float = 0.0, trends: tuple[str, ...] = ("ascending", "descending"), quick: bool = False) -> DataFrame:
    """Contiguous merge of each feature's fine bins (feature, position, n, s) that maximises the information value under
    a bound on bins, a least size, least events and non-events a bin and a least difference of the event rates of
    neighbours, with rates that rise, fall, or, where `trends` says so, turn once (peak, valley); the best trend is kept
    (TA-11). Coarse bins never exceed the fine ones, and in quick mode adapt to their number (TA-14). If no trend of two
    bins is feasible, the fallback cuts at the fine bin nearest to half of the rows (TA-12); a single fine bin stays one. At most
    some hundred fine bins a feature: one small group each."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        n, s = g.n.to_numpy(float), g.s.to_numpy(float)
        cn, cs, m = [0, *n.cumsum()], [0, *s.cumsum()], len(g)
        te, tn = max(cs[-1], 1e-9), max(cn[-1] - cs[-1], 1e-9)
        limit = max(1, min(quick_limits(m, max_bins)[1] if quick else max_bins, m))
        least = min_share * cn[-1]

        def value(i, j):
            e, ne = cs[j] - cs[i], cn[j] - cn[i] - cs[j] + cs[i]
            a, b = (e + 0.5) / (te + 0.5 * max_bins), (ne + 0.5) / (tn + 0.5 * max_bins)
            return (b - a) * math.log(b / a)

        def rate(i, j):
            return (cs[j] - cs[i]) / max(cn[j] - cn[i], 1e-9)

        def allowed(i, j):
            e = cs[j] - cs[i]
            return cn[j] - cn[i] >= least and e >= min_events and cn[j] - cn[i] - e >= min_events

        best = (-1.0, None, "none")
        for trend in trends:
            phases = TRENDS[trend]
            # reach[i, j]: best value of a chain whose last bin is [i, j), per number of bins and phase of its last step
            reach = {(0, j): {(1, 0): (value(0, j), None)} for j in range(1, m + 1) if allowed(0, j)}
            for j in range(2, m + 1):
                for i in range(1, j):
                    if not allowed(i, j):
                        continue
                    here = {}
                    for h in range(i):
                        step = rate(i, j) - rate(h, i) if (h, i) in reach else 0.0
                        for (k, phase), (v, _) in reach.get((h, i), {}).items():
                            for later in range(phase, len(phases)):
                                if k < limit and phases[later] * step > 0 and abs(step) >= min_difference and v + value(i, j) > here.get((k + 1, later), (-1.0,))[0]:
                                    here[k + 1, later] = (v + value(i, j), (h, i, (k, phase)))
                    if here:
                        reach[i, j] = here
            for (i, j), own in reach.items():
                for state, (v, _) in own.items():
                    if j == m and i > 0 and v > best[0]:
                        cuts, at = [m], (i, j, state)
                        while at:
                            cuts.append(at[0])
                            at = reach[at[0], at[1]][at[2]][1]
                        best = (v, sorted(set(cuts)), trend)
        cuts, objective = best[1], best[0]
        if cuts is None:
            cut = min(range(1, m), key=lambda i: abs(cn[i] - cn[-1] / 2)) if m > 1 and limit > 1 else 0
            cuts = sorted({0, cut, m})
            objective = sum(value(a, b) for a, b in zip(cuts, cuts[1:]))
        label = [next(b for b in range(len(cuts) - 1) if cuts[b] <= i < cuts[b + 1]) for i in range(m)]
        return pd.DataFrame({"feature": g.feature, "position": g[order].astype("int64"), "coarse": label, "trend": best[2], "objective": objective})

    ship(fine.sparkSession)
    return fine.groupBy("feature").applyInPandas(solve, "feature string, position bigint, coarse bigint, trend string, objective double")


def grouped_auc(scored: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Folded area under the ROC curve of a grouped score: rows (by..., score, p, q) of positives and negatives (TA-19)."""
    per = scored.groupBy(*by, score).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    c = cumulative(per, [score], {"cq": "q", "cp": "p"}, by)
    area = F.col("p") * (F.col("cq") - F.col("q") / 2)
    out = c.select(*by, area.alias("a"), "p", "q").groupBy(*by).agg((F.sum("a") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))
    return out.withColumn("auc", F.greatest("auc", 1 - F.col("auc"))).withColumn("gini", 2 * F.col("auc") - 1)


def concordance(df: DataFrame, score: str, target: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Share of concordant pairs of rows with different targets, score ties at a half, folded (TA-20), for each group of `by`; rows
    may carry their number in `weight`. Null scores and targets take no part.

    Scores are numbered in their order. Two different numbers agree above their highest differing bit, so each pair of cells
    (score, target) meets exactly once, under that bit and the bits above it, the lower score with a 0 and the higher with
    a 1; there running counts in the order of targets tell how many pairs agree. Rows grow as cells x bits of the number of scores,
    and no two levels are joined."""
    by = by or []
    rows = df.select(*by, F.col(score).alias("s"), F.col(target).alias("t"), (F.col(weight) if weight else F.lit(1)).alias("w")).where("s is not null and t is not null")
    per = materialise(rows.groupBy(*by, "s", "t").agg(F.sum("w").alias("n")), "concordance")
    number = cumulative(per.select(*by, "s").distinct().withColumn("one", F.lit(1)), ["s"], {"r": "one"}, by).select(*by, "s", F.col("r").cast("long").alias("r"))
    bits = max(1, per.agg(F.count_distinct("s")).first()[0].bit_length())
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.shiftright("r", k + 1).alias("above"), F.shiftright("r", k).bitwiseAND(F.lit(1)).alias("high")) for k in range(bits + 1)])).alias("b")
    cells = per.join(number, [*by, "s"]).select(*by, "t", "n", at).groupBy(*by, "b.bit", "b.above", "t").agg(F.sum(F.when(F.col("b.high") == 0, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("b.high") == 1, F.col("n")).otherwise(0)).alias("high"))
    c = cumulative(cells, ["t"], {"upto": "low"}, [*by, "bit", "above"])
    high = F.col("high").cast("double")
    apart = c.groupBy(*by).agg(F.sum(high * (F.col("upto") - F.col("low"))).alias("agree"), F.sum(high * (F.col("upto_total") - F.col("upto"))).alias("disagree"))
    same = per.groupBy(*by, "s").agg(F.sum("n").cast("double").alias("all"), F.sum(F.col("n").cast("double") * F.col("n")).alias("own")).groupBy(*by).agg((F.sum(F.col("all") * F.col("all") - F.col("own")) / 2).alias("ties"))
    one = apart.join(same, by) if by else apart.crossJoin(F.broadcast(same))  # one row beside one row
    auc = (F.col("agree") + F.col("ties") / 2) / F.nullif(F.col("agree") + F.col("disagree") + F.col("ties"), F.lit(0.0))
    return one.select(*by, F.greatest(auc, 1 - auc).alias("auc"))


def leakage(df: DataFrame, post_outcome: list[str]) -> DataFrame:
    """Post-outcome columns that are present and populated (TA-28)."""
    there = [c for c in post_outcome if c in df.columns]
    if not there:
        return df.sparkSession.createDataFrame([], "column string, populated bigint")
    one = df.agg(*[F.count(c).alias(c) for c in there])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("populated")) for c in there])).alias("r")).select("r.*").where("populated > 0")


def smell(df: DataFrame, features: list[str], target: Column) -> DataFrame:
    """Pearson correlation of each feature with the target (TA-29)."""
    one = df.agg(*[F.corr(F.col(f).cast("double"), target.cast("double")).alias(f) for f in features])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features])).alias("r")).select("r.*")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
EDGES = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_extendedprice": [20000.0, 40000.0, 60000.0], "l_discount": [0.025, 0.055, 0.085]}


def line_bins(spark, sf_dir):
    return long_bins(table(spark, sf_dir, "lineitem"), {f: apply_bins(f, e) for f, e in EDGES.items()}, positive("l_returnflag", "R"))


_LONG = "WITH r AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, 'R' || len(list_filter({e}, lambda z: z < {f})) AS bin, (l_returnflag = 'R')::INT AS y FROM lineitem WHERE l_returnflag IS NOT NULL" for f, e in EDGES.items()) + "), s AS (SELECT feature, bin, count(*) AS n, sum(y)::BIGINT AS s FROM r GROUP BY 1, 2)"
_WOE = _LONG + """, t AS (SELECT *, count(*) OVER w AS k, sum(s) OVER w AS te, sum(n - s) OVER w AS tn FROM s WINDOW w AS (PARTITION BY feature)),
 p AS (SELECT *, (s + 0.5) / (te + 0.5 * k) AS pe, (n - s + 0.5) / (tn + 0.5 * k) AS pn FROM t), v AS (SELECT *, ln(pn / pe) AS w, (pn - pe) * ln(pn / pe) AS iv FROM p)"""


@query("bins_woe", f"{_WOE} SELECT feature, bin, n, s AS events, round(s / n, 6) AS event_rate, round(w, 6) AS woe, round(iv, 7) AS iv, round(sum(iv) OVER (PARTITION BY feature), 6) AS feature_iv FROM v")
def bins_woe(spark, sf_dir):
    return woe(fine_statistics(line_bins(spark, sf_dir))).withColumns({c: rounded(F.col(c), 7 if c == "iv" else 6) for c in ("event_rate", "woe", "iv", "feature_iv")})


@query("bins_coarse", f"""{_LONG}, c AS (SELECT feature, CASE WHEN bin IN ('R0', 'R1') THEN 'low' ELSE bin END AS bin, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s FROM s GROUP BY 1, 2) SELECT feature, bin, n, s FROM c""")
def bins_coarse(spark, sf_dir):
    groups = spark.createDataFrame([(f, b, "low") for f in FEATURES for b in ("R0", "R1")], "feature string, bin string, coarse string")
    return coarse(fine_statistics(line_bins(spark, sf_dir)), groups).select("feature", "bin", "n", "s")


@query("bins_warnings", f"""{_WOE}, b AS (SELECT feature, bin, n, s, s / n AS r, n / sum(n) OVER (PARTITION BY feature) AS share, lag(s / n) OVER (PARTITION BY feature ORDER BY bin) AS x, lead(s / n) OVER (PARTITION BY feature ORDER BY bin) AS z FROM v)
 SELECT feature, bin, unnest(list_filter([CASE WHEN share < 0.02 THEN 'small' END, CASE WHEN s < 5 THEN 'few events' END, CASE WHEN (r - x) * (z - r) < 0 THEN 'not monotonic' END], lambda q: q IS NOT NULL)) AS warning FROM b""")
def bins_warnings(spark, sf_dir):
    return bin_warnings(woe(fine_statistics(line_bins(spark, sf_dir))))


@query("bins_variance_ratio", """WITH r AS (SELECT len(list_filter([10, 20, 30, 40], lambda z: z < l_quantity)) AS bin, l_extendedprice AS y FROM lineitem), b AS (SELECT count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM r GROUP BY bin)
 SELECT 'l_quantity' AS feature, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS variance_ratio FROM b""")
def bins_variance_ratio(spark, sf_dir):
    rows = long_bins(table(spark, sf_dir, "lineitem"), {"l_quantity": apply_bins("l_quantity", EDGES["l_quantity"])}, F.col("l_extendedprice"))
    return variance_ratio(fine_statistics(rows)).withColumn("variance_ratio", rounded(F.col("variance_ratio")))


@query("bins_multinomial", """WITH r AS (SELECT 'R' || len(list_filter([10, 20, 30, 40], lambda z: z < l_quantity)) AS bin, l_returnflag AS y FROM lineitem), b AS (SELECT bin, count(*) AS n FROM r GROUP BY 1), c AS (SELECT y, count(*) AS ev FROM r GROUP BY 1),
 g AS (SELECT b.bin, c.y, b.n, c.ev, (SELECT count(*) FROM r WHERE r.bin = b.bin AND r.y = c.y) AS s FROM b, c), t AS (SELECT *, count(*) OVER w AS k, sum(s) OVER w AS te, sum(n - s) OVER w AS tn FROM g WINDOW w AS (PARTITION BY y)),
 p AS (SELECT y, ev, (s + 0.5) / (te + 0.5 * k) AS pe, (n - s + 0.5) / (tn + 0.5 * k) AS pn FROM t), v AS (SELECT y, any_value(ev) AS ev, sum((pn - pe) * ln(pn / pe)) AS iv FROM p GROUP BY y)
 SELECT 'l_quantity' AS feature, round(avg(iv), 7) AS macro, round(sum(iv * ev) / sum(ev), 7) AS weighted, round(max(iv), 7) AS maximum FROM v""")
def bins_multinomial(spark, sf_dir):
    rows = long_bins(table(spark, sf_dir, "lineitem"), {"l_quantity": apply_bins("l_quantity", EDGES["l_quantity"])}, F.col("l_returnflag"))
    return multinomial_iv(rows).withColumns({c: rounded(F.col(c), 7) for c in ("macro", "weighted", "maximum")})


@query("bins_fine_groups", """SELECT value, n, CASE WHEN row_number() OVER (ORDER BY n DESC, value) <= 3 THEN value ELSE 'OTHER' END AS bin FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1)""")
def bins_fine_groups(spark, sf_dir):
    return fine_groups(table(spark, sf_dir, "part"), "p_brand", 3)


@query("bins_fine_splits", """WITH p AS (SELECT value AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS c, lead(v) OVER (ORDER BY v) AS nx, sum(n) OVER () AS t FROM p),
 q AS (SELECT floor(c * 5 / t) AS q, min(v) AS v, arg_min(nx, v) AS nx FROM c WHERE nx IS NOT NULL GROUP BY 1) SELECT round((v + nx) / 2, 6) AS split FROM q WHERE q >= 1""")
def bins_fine_splits(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in fine_splits(table(spark, sf_dir, "events"), "value", 5)], "split double").withColumn("split", rounded(F.col("split")))


@query("bins_optimal", """WITH r AS (SELECT 'l_quantity' AS feature, len(list_filter([5, 10, 15, 20, 25, 30, 35, 40, 45], lambda e: l_quantity >= e)) AS p, (l_returnflag = 'R')::INT AS y FROM lineitem
  UNION ALL SELECT 'l_discount', len(list_filter([0.005, 0.015, 0.025, 0.035, 0.045, 0.055, 0.065, 0.075, 0.085, 0.095], lambda e: l_discount >= e)), (l_returnflag = 'R')::INT FROM lineitem),
 f AS (SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY p) - 1 AS i, p, count(*) AS n, sum(y) AS s FROM r GROUP BY feature, p), t AS (SELECT feature, count(*) AS m, sum(n) AS tn, sum(s) AS ts FROM f GROUP BY 1),
 k AS (SELECT feature, m, tn, ts, unnest(range(1::BIGINT, 1::BIGINT << (m - 1))) AS mask FROM t),
 b AS (SELECT f.feature, mask, bit_count(mask & ((1::BIGINT << f.i) - 1)) AS bin, any_value(tn) AS tn, any_value(ts) AS ts, sum(n) AS n, sum(s) AS s FROM k JOIN f ON f.feature = k.feature WHERE bit_count(mask) <= 4 GROUP BY 1, 2, 3),
 v AS (SELECT *, s / n - lag(s / n) OVER (PARTITION BY feature, mask ORDER BY bin) AS step, ((n - s + 0.5) / (tn - ts + 2.5) - (s + 0.5) / (ts + 2.5)) * ln(((n - s + 0.5) / (tn - ts + 2.5)) / ((s + 0.5) / (ts + 2.5))) AS iv FROM b),
 c AS (SELECT feature, mask, sum(iv) AS objective, CASE WHEN min(step) > 0 THEN 'ascending' ELSE 'descending' END AS trend FROM v GROUP BY 1, 2 HAVING min(n) >= 0.05 * any_value(tn) AND (min(step) > 0 OR max(step) < 0)),
 d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY feature ORDER BY objective DESC) = 1)
 SELECT f.feature, f.p AS "position", bit_count(mask & ((1::BIGINT << f.i) - 1))::BIGINT AS coarse, trend, round(objective, 6) AS objective FROM f JOIN d ON d.feature = f.feature""")
def bins_optimal(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    rows = long_bins(df, {f: bucket(F.col(f), e) for f, e in {"l_quantity": [float(i) for i in range(5, 50, 5)], "l_discount": [i / 100 + 0.005 for i in range(10)]}.items()}, positive("l_returnflag", "R"))
    fine = fine_statistics(rows).withColumn("position", F.col("bin").cast("long"))
    return optimal_coarse(fine.select("feature", "position", "n", "s")).withColumn("objective", rounded(F.col("objective")))


_SCORED = f"""{_LONG}, a AS (SELECT feature, s / n AS score, sum(s) AS p, sum(n - s) AS q FROM s GROUP BY 1, 2), c AS (SELECT feature, p * (sum(q) OVER (PARTITION BY feature ORDER BY score) - q / 2) AS a, p, q FROM a),
 u AS (SELECT feature, sum(a) / (sum(p) * sum(q)) AS x FROM c GROUP BY 1)"""


def line_auc(spark, sf_dir):
    stats = fine_statistics(line_bins(spark, sf_dir))
    return grouped_auc(stats.select("feature", (F.col("s") / F.col("n")).alias("score"), F.col("s").alias("p"), (F.col("n") - F.col("s")).alias("q")), ["feature"])


@query("separation_auc", f"{_SCORED} SELECT feature, round(greatest(x, 1 - x), 6) AS auc, round(2 * greatest(x, 1 - x) - 1, 6) AS gini FROM u")
def separation_auc(spark, sf_dir):
    return line_auc(spark, sf_dir).withColumns({"auc": rounded(F.col("auc")), "gini": rounded(F.col("gini"))})


@query("separation_concordance", """WITH s AS (SELECT l_linenumber AS s, l_quantity AS t, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT sum(a.n * b.n * CASE WHEN a.s = b.s THEN 0.5 WHEN a.s > b.s THEN 1 ELSE 0 END) / sum(a.n * b.n) AS x FROM s a, s b WHERE a.t > b.t) SELECT round(greatest(x, 1 - x), 6) AS auc FROM p""")
def separation_concordance(spark, sf_dir):
    return concordance(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity").withColumn("auc", rounded(F.col("auc")))


@query("separation_leakage", "SELECT 'l_tax' AS \"column\", count(l_tax) AS populated FROM lineitem")
def separation_leakage(spark, sf_dir):
    return leakage(table(spark, sf_dir, "lineitem"), ["l_tax", "recovery_date"])


@query("separation_smell", " UNION ALL ".join(f"SELECT '{f}' AS feature, round(corr({f}, (l_returnflag = 'R')::INT), 6) AS correlation FROM lineitem" for f in FEATURES))
def separation_smell(spark, sf_dir):
    return smell(table(spark, sf_dir, "lineitem"), FEATURES, positive("l_returnflag", "R")).withColumn("correlation", rounded(F.col("correlation")))


@query("bins_ranges", """SELECT bin, sum(n)::BIGINT AS n, round(min(low), 4) AS low, round(max(high), 4) AS high, round(max(mean), 4) AS mean FROM (
 SELECT CASE WHEN l_quantity < 2 THEN 'GUARD_LOW' WHEN l_quantity > 60 THEN 'GUARD_HIGH' ELSE 'R' || len(list_filter([10, 20, 30, 40], lambda z: z < l_quantity)) END AS bin, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, avg(l_quantity) AS mean FROM lineitem GROUP BY 1
 UNION ALL SELECT unnest(['GUARD_LOW', 'GUARD_HIGH']), 0, NULL, NULL, NULL) GROUP BY 1""")
def bins_ranges(spark, sf_dir):
    out = bin_ranges(table(spark, sf_dir, "lineitem"), "l_quantity", apply_bins("l_quantity", EDGES["l_quantity"], guards=(2.0, 60.0)), ["GUARD_LOW", "GUARD_HIGH"])
    return out.withColumns({c: rounded(F.col(c), 4) for c in ("low", "high", "mean")})


@query("bins_merged_categories")
def bins_merged_categories(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.lit("o_orderpriority").alias("feature"), F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("class_")).agg(F.count("*").alias("k"))
    return merge_categories(per, 3)


@query("bins_target_route", """SELECT 'o_orderstatus' AS target, CASE count(DISTINCT o_orderstatus) WHEN 2 THEN 'binary' ELSE 'multinomial' END AS kind, CASE count(DISTINCT o_orderstatus) WHEN 2 THEN max(o_orderstatus) END AS label FROM orders UNION ALL SELECT 'o_totalprice', CASE count(DISTINCT o_totalprice) WHEN 2 THEN 'binary' ELSE 'continuous' END, NULL FROM orders
 UNION ALL SELECT 'l_linestatus', 'binary', max(l_linestatus) FROM lineitem UNION ALL SELECT 'toxic', 'binary', max(toxic)::VARCHAR FROM labels""")
def bins_target_route(spark, sf_dir):
    orders, labels = table(spark, sf_dir, "orders"), table(spark, sf_dir, "labels")
    found = [target_route(orders, "o_orderstatus"), target_route(orders, "o_totalprice"), target_route(table(spark, sf_dir, "lineitem"), "l_linestatus"), target_route(labels, "toxic", label="1.0")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("bins_review", """WITH b AS (SELECT CASE WHEN l_quantity = 50 THEN 'S0' WHEN l_quantity < 2 THEN 'GUARD_LOW' WHEN l_quantity > 60 THEN 'GUARD_HIGH' ELSE 'R' || len(list_filter([5, 20, 49], lambda z: z < l_quantity)) END AS bin, (l_returnflag = 'R')::INT AS y FROM lineitem), s AS (SELECT bin, count(*) AS n, sum(y)::BIGINT AS s FROM b GROUP BY 1),
 p AS (SELECT *, (s + 0.5) / (sum(s) OVER () + 0.5 * count(*) OVER ()) AS pe, (n - s + 0.5) / (sum(n - s) OVER () + 0.5 * count(*) OVER ()) AS pn, lag(s / n) OVER (ORDER BY bin) AS x, lead(s / n) OVER (ORDER BY bin) AS z, n / sum(n) OVER () AS share FROM s)
 SELECT bin, n, s AS events, round(ln(pn / pe), 6) AS woe, round((pn - pe) * ln(pn / pe), 8) AS iv, array_to_string(list_sort(list_filter([CASE WHEN share < 0.02 THEN 'small' END, CASE WHEN s < 5 THEN 'few events' END, CASE WHEN (s / n - x) * (z - s / n) < 0 THEN 'not monotonic' END], lambda q: q IS NOT NULL)), '; ') AS warnings FROM p""")
def bins_review(spark, sf_dir):
    found = review(table(spark, sf_dir, "lineitem"), "l_quantity", {"edges": [5.0, 20.0, 49.0], "specials": [50], "guards": (2.0, 60.0)}, positive("l_returnflag", "R"))
    return found.select("bin", "n", "events", rounded(F.col("woe")).alias("woe"), rounded(F.col("iv"), 8).alias("iv"), "warnings")
