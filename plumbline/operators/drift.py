"""Stability, drift and representativeness (ST-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.prefix import cumulative
from plumbline.functions.quantiles import percentile_row, percentiles
from plumbline.functions.values import bucket, rounded
from plumbline.operators.profile import counts, histogram, numeric
from plumbline.plans.registry import query
from plumbline.session import materialise, shuffle_partitions, table

WATCH, INVESTIGATE = 0.10, 0.25
EPSILON = 1e-6


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Distinct linear quantiles at 0, 1/bins, ..., 1: bins + 1 numbers at most."""
    return sorted(set(percentile_row(df, F.col(column), [i / bins for i in range(bins + 1)])))


def indexed(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with _index, the row's place in the order, from range partitions and their sizes; no single task sorts all.

    The driver sees one count per partition."""
    spark = df.sparkSession
    dealt = materialise(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r._part: r.n for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    base, at = [], 0
    for p in sorted(sizes):
        base.append((p, at))
        at += sizes[p]
    offsets = spark.createDataFrame(base, "_part int, _base bigint")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn("_index", F.col("_base") + F.col("_local")).drop("_part", "_local", "_base")


def expectation_psi(df: DataFrame, feature: str, date: str, tie: str, ref_share: float = 0.4, bins: int = 10) -> DataFrame:
    """Reference: the first floor(share * n) rows by date (ties by `tie`); edges are the reference's quantiles, bins are
    closed on the left (the last on both sides), shares are clipped at 1e-6 (ST-1)."""
    rows = materialise(indexed(df.select(feature, date, tie).where(F.col(feature).isNotNull() & F.col(date).isNotNull()), [date, tie]), "psi-order")
    cut = int(ref_share * rows.count())
    ref = F.col("_index") < cut
    edges = quantile_edges(rows.where(ref), feature, bins)
    if len(edges) < 2:
        return rows.limit(0).agg(F.lit(0.0).alias("psi"))
    inside = F.col(feature).between(edges[0], edges[-1])
    per = rows.where(inside).groupBy(bucket(F.col(feature), edges[1:-1]).alias("bin")).agg(F.count_if(ref).alias("r"), F.count_if(~ref).alias("u"))
    grid = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(per, "bin", "left").fillna(0)
    all_ = Window.partitionBy()  # one row a bin
    r, u = (F.greatest(F.col(c) / F.sum(c).over(all_), F.lit(EPSILON)) for c in ("r", "u"))
    return grid.select(((u - r) * F.log(u / r)).alias("part")).agg(F.sum("part").alias("psi"))


def early_recent(df: DataFrame, date: str, share: float = 0.4) -> DataFrame:
    """`df` with window: early up to the date quantile, recent after it; rows without a date are dropped (ST-2)."""
    at = next(iter(percentile_row(df, F.unix_micros(F.col(date).cast("timestamp")), [share])), None)
    early = F.unix_micros(F.col(date).cast("timestamp")) <= F.lit(at)
    return df.where(F.col(date).isNotNull()).withColumn("window", F.when(early, "early").otherwise("recent"))


def window_drift(df: DataFrame, feature: str) -> DataFrame:
    """Count, mean and median of either window and their changes (ST-3)."""
    x, early = F.col(feature).cast("double"), F.col("window") == "early"
    agg = {}
    for name, cond in (("early", early), ("recent", ~early)):
        agg |= {f"{name}_n": F.count(F.when(cond, x)), f"{name}_mean": F.avg(F.when(cond, x))}
    medians = percentiles(df, {"early": F.when(early, x), "recent": F.when(~early, x)}, [0.5])
    middle = medians.agg(*[F.max(F.when(F.col("column") == n, F.col("q")[0])).alias(f"{n}_median") for n in ("early", "recent")])
    one = df.agg(*[v.alias(k) for k, v in agg.items()]).crossJoin(F.broadcast(middle))  # one row beside one
    one = one.select("early_n", "early_mean", "early_median", "recent_n", "recent_mean", "recent_median")
    return one.withColumns({"mean_change": F.col("recent_mean") - F.col("early_mean"), "median_change": F.col("recent_median") - F.col("early_median")})


def decomposition(df: DataFrame, feature: str, bins: int = 10) -> DataFrame:
    """PSI contribution of each quantile bin of the early window (closed on the right) and the cumulative KS gap (ST-4),
    with each bin's share of the absolute total (ST-5)."""
    rows = df.where(F.col(feature).isNotNull())
    edges = quantile_edges(rows.where("window = 'early'"), feature, bins)
    per = rows.groupBy(bucket(F.col(feature), edges[1:-1], right=True).alias("bin")).agg(F.count_if(F.col("window") == "early").alias("e"), F.count_if(F.col("window") == "recent").alias("r"))
    all_, upto = Window.partitionBy(), Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    e, r = F.col("e") / F.sum("e").over(all_), F.col("r") / F.sum("r").over(all_)
    part = (r - e) * F.log((r + EPSILON) / (e + EPSILON))
    out = per.select("bin", "e", "r", part.alias("contribution"), F.abs(F.sum("e").over(upto) / F.sum("e").over(all_) - F.sum("r").over(upto) / F.sum("r").over(all_)).alias("ks_gap"))
    return out.withColumn("share", F.abs("contribution") / F.nullif(F.sum(F.abs("contribution")).over(all_), F.lit(0.0)))


def psi_class(psi: Column) -> Column:
    return F.when(psi >= INVESTIGATE, "investigate").when(psi >= WATCH, "watch").otherwise("stable")


def draft_bins(df: DataFrame, feature: str, numeric_: bool, max_groups: int = 49) -> dict:
    """Frozen bins of a baseline: all values but the last where there are fewer than ten, else distinct deciles; for
    categories the 49 most frequent and the rest (ST-7)."""
    if numeric_:
        few = [r[0] for r in df.where(F.col(feature).isNotNull()).select(F.col(feature).cast("double")).distinct().limit(10).collect()]
        return {"feature": feature, "edges": sorted(few)[:-1] if len(few) < 10 else quantile_edges(df, feature)[1:-1]}
    top = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(max_groups + 1).collect()
    return {"feature": feature, "groups": [r.v for r in top[:max_groups]], "other": len(top) > max_groups}


def validate_bins(spec: dict) -> None:
    """Ordered finite edges or distinct groups, and specials apart from both (ST-8)."""
    edges, groups = spec.get("edges"), spec.get("groups")
    if (edges is None) == (groups is None):
        raise ValueError("give edges or groups")
    if edges is not None and (any(e != e or abs(e) == float("inf") for e in edges) or any(a >= b for a, b in zip(edges, edges[1:]))):
        raise ValueError("edges must be finite and ascending")
    if groups is not None and len(set(groups)) != len(groups):
        raise ValueError("groups overlap")
    if groups is not None and set(map(str, spec.get("specials", []))) & set(groups):
        raise ValueError("a special value is also a group")


def assign(spec: dict) -> Column:
    """The frozen bin's label of each row: MISSING, S<k>, B<k>, OTHER or UNSEEN."""
    c = F.col(spec["feature"])
    out = F.when(c.isNull(), "MISSING")
    for i, v in enumerate(spec.get("specials", [])):
        out = out.when(c.cast("string") == str(v), f"S{i}")
    if "edges" in spec:
        return out.otherwise(F.concat(F.lit("B"), bucket(c.cast("double"), spec["edges"], right=True).cast("string")))
    for i, g in enumerate(spec["groups"]):
        out = out.when(c.cast("string") == g, f"B{i}")
    return out.otherwise("OTHER" if spec.get("other") else "UNSEEN")


def governed_psi(populated: DataFrame, specs: list[dict]) -> DataFrame:
    """Contribution of every bin of every feature between the populations; all features in one shuffle (ST-6, ST-9)."""
    bins = F.explode(F.array(*[F.struct(F.lit(s["feature"]).alias("feature"), assign(s).alias("bin")) for s in specs])).alias("b")
    rows = populated.where("population is not null").select("population", bins).select("population", "b.*")
    per = rows.groupBy("feature", "bin").agg(F.count_if(F.col("population") == "baseline").alias("baseline"), F.count_if(F.col("population") == "current").alias("current"))
    own = Window.partitionBy("feature")
    p, q = F.col("baseline") / F.sum("baseline").over(own), F.col("current") / F.sum("current").over(own)
    a, b = F.greatest(p, F.lit(EPSILON)), F.greatest(q, F.lit(EPSILON))
    return per.withColumn("contribution", F.when((p == 0) & (q == 0), 0.0).otherwise((b - a) * F.log(b / a)))


def psi_summary(parts: DataFrame) -> DataFrame:
    out = parts.groupBy("feature").agg(F.sum("contribution").alias("psi"), F.max_by("bin", F.struct("contribution", "bin")).alias("dominant_bin"))
    return out.withColumn("classification", psi_class(F.col("psi")))


def bin_coverage(df: DataFrame, spec: dict) -> DataFrame:
    """Observed values without a group and groups without values (ST-10)."""
    seen = df.where(F.col(spec["feature"]).isNotNull()).select(F.col(spec["feature"]).cast("string").alias("value")).distinct()
    groups = df.sparkSession.createDataFrame([(g,) for g in spec["groups"]], "value string")
    return seen.join(groups, "value", "left_anti").withColumn("status", F.lit("unmatched")).unionByName(groups.join(seen, "value", "left_anti").withColumn("status", F.lit("unused")))


def project_groups(df: DataFrame, feature: str, groups: DataFrame) -> DataFrame:
    """Coarse groups (value, grp) on the observed categories; values without a group stand alone (ST-11)."""
    seen = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return seen.join(groups, "value", "left").groupBy(F.coalesce("grp", "value").alias("grp")).agg(F.sum("n").alias("n"), F.count("*").alias("categories"))


def ks(df: DataFrame, value: str, is_a: Column, by: list[str] | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of rows with and without `is_a` (ST-12). Distinct values are counted
    first, and their running sums need no single task."""
    by = by or []
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count_if(is_a).alias("a"), F.count_if(~is_a).alias("b"))
    return largest_gap(per, by)


def largest_gap(per: DataFrame, by: list[str]) -> DataFrame:
    """KS of counts (by..., v, a, b)."""
    c = cumulative(per, ["v"], {"ca": "a", "cb": "b"}, by)
    gap = F.abs(F.col("ca") / F.nullif(F.col("ca_total"), F.lit(0)) - F.col("cb") / F.nullif(F.col("cb_total"), F.lit(0)))
    return c.select(*by, gap.alias("gap")).groupBy(*by).agg(F.max("gap").alias("ks"))


def ks_by_segment(df: DataFrame, value: str, segment: str) -> DataFrame:
    """KS of every segment against the largest one (ties to the smaller name) (ST-13)."""
    rows = df.where(F.col(value).isNotNull() & F.col(segment).isNotNull()).select(F.col(value).alias("v"), F.col(segment).cast("string").alias("segment"))
    largest = rows.groupBy("segment").agg(F.count("*").alias("n")).agg(F.min_by("segment", F.struct(-F.col("n"), "segment")).alias("s")).first().s
    base = rows.groupBy("v").agg(F.count_if(F.col("segment") == largest).alias("a"))
    base = cumulative(base, ["v"], {"ca": "a"})
    per = rows.where(F.col("segment") != largest).groupBy("segment", "v").agg(F.count("*").alias("b"))
    # between two values of a segment only the base moves, so the gap is widest at a value or just before one
    both = cumulative(per, ["v"], {"cb": "b"}, ["segment"]).join(base, "v")
    at = F.abs(F.col("ca") / F.col("ca_total") - F.col("cb") / F.col("cb_total"))
    before = F.abs((F.col("ca") - F.col("a")) / F.col("ca_total") - (F.col("cb") - F.col("b")) / F.col("cb_total"))
    return both.groupBy("segment").agg(F.max(F.greatest(at, before)).alias("ks")).withColumn("baseline", F.lit(largest))


def quarterly_rate(df: DataFrame, target: str, date: str) -> DataFrame:
    """Range and population deviation of the target's mean over calendar quarters (ST-14)."""
    return df.groupBy(F.date_trunc("quarter", date).alias("q")).agg(F.avg(target).alias("rate")).agg((F.max("rate") - F.min("rate")).alias("range"), F.stddev_pop("rate").alias("std"), F.count("*").alias("quarters"))


def observation_months(df: DataFrame, date: str) -> DataFrame:
    """Whole months from the first to the last month (ST-15)."""
    lo, hi = F.min(date), F.max(date)
    return df.agg(((F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)).alias("months"))


def regime_coverage(df: DataFrame, date: str, first: str, last: str, floor: float = 0.05) -> DataFrame:
    """Share of rows in a regime's months; passes without rows to judge when the data do not reach into it (ST-16)."""
    m = F.date_format(date, "yyyy-MM")
    one = df.agg(F.avg(m.between(first, last).cast("int")).alias("share"), F.min(m).alias("lo"), F.max(m).alias("hi"))
    overlap = (F.col("lo") <= last) & (F.col("hi") >= first)
    return one.select("share", overlap.alias("overlaps"), (~overlap | (F.col("share") >= floor)).alias("passed"))


def relationship_drift(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation in either window and its change (ST-17)."""
    early = F.col("window") == "early"
    one = df.agg(F.corr(F.when(early, F.col(a)), F.when(early, F.col(b))).alias("early"), F.corr(F.when(~early, F.col(a)), F.when(~early, F.col(b))).alias("recent"))
    return one.withColumn("change", F.col("recent") - F.col("early"))


def segment_attribution(df: DataFrame, feature: str, segment: str) -> DataFrame:
    """Change of the mean per segment, ranked by size (ST-18)."""
    early = F.col("window") == "early"
    per = df.groupBy(F.col(segment).alias("segment")).agg(F.avg(F.when(early, F.col(feature))).alias("early"), F.avg(F.when(~early, F.col(feature))).alias("recent")).withColumn("change", F.col("recent") - F.col("early"))
    numbered = indexed(per.withColumns({"_none": F.col("change").isNull(), "_less": -F.abs("change")}), ["_none", "_less", "segment"])  # segments may be many
    return numbered.withColumn("position", (F.col("_index") + 1).cast("int")).drop("_index", "_none", "_less")


def gaps(df: DataFrame, date: str, top: int = 10) -> DataFrame:
    """The longest gaps between neighbouring distinct days (ST-19, WN-8)."""
    days = df.where(F.col(date).isNotNull()).select(F.to_date(date).alias("d")).distinct()  # days, not rows
    near = days.withColumn("before", F.lag("d").over(Window.partitionBy().orderBy("d"))).where("before is not null")
    return near.select(F.col("before").cast("string").alias("from_day"), F.col("d").cast("string").alias("to_day"), F.datediff("d", "before").alias("days")).orderBy(F.desc("days"), "from_day").limit(top)


def version_diff(old: DataFrame, new: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Distribution tier of two versions: null share, distinct, range, mean, deviation and L1 histogram shift (ST-20)."""
    def own(df, side):
        m = counts(df, columns).join(numeric(df, columns), "column")
        hist = None
        for c in columns:
            h = histogram(df, c, bins).groupBy(F.lit(c).alias("column")).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("h"))
            hist = h if hist is None else hist.unionByName(h)
        m = m.join(hist, "column")
        return m.select("column", *[F.col(x).alias(f"{side}_{x}") for x in ("total", "missing_share", "distinct_raw", "low", "high", "mean", "std", "h")])

    both = own(old, "old").join(own(new, "new"), "column", "full_outer")
    shift = F.aggregate(F.zip_with("old_h", "new_h", lambda a, b: F.abs(a["n"] / F.col("old_total") - b["n"] / F.col("new_total"))), F.lit(0.0), lambda x, y: x + y)
    return both.select("column", (F.col("new_total") - F.col("old_total")).alias("row_change"), (F.col("new_distinct_raw") - F.col("old_distinct_raw")).alias("distinct_change"), (F.col("new_mean") - F.col("old_mean")).alias("mean_change"), (F.col("new_std") - F.col("old_std")).alias("std_change"), shift.alias("histogram_shift"))


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


_SPLIT = """w AS (SELECT *, CASE WHEN epoch_us({d}) <= (SELECT quantile_cont(epoch_us({d}), 0.4) FROM {t}) THEN 'early' ELSE 'recent' END AS w FROM {t} WHERE {d} IS NOT NULL)"""
_ORDERS = "WITH " + _SPLIT.format(d="o_orderdate", t="orders")
_EVENTS = "WITH " + _SPLIT.format(d="ts", t="events")


def orders_windows(spark, sf_dir):
    return early_recent(table(spark, sf_dir, "orders"), "o_orderdate")


@query("drift_expectation_psi", """WITH i AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, floor(0.4 * count(*) OVER ()) AS c FROM orders),
 e AS (SELECT quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM i WHERE k < c),
 b AS (SELECT len(list_filter(q[2:10], lambda y: y <= x)) AS bin, k < c AS r FROM i, e WHERE x BETWEEN q[1] AND q[11]),
 g AS (SELECT bin, count(*) FILTER (WHERE r) AS r, count(*) FILTER (WHERE NOT r) AS u FROM b GROUP BY 1),
 s AS (SELECT greatest(r / sum(r) OVER (), 1e-6) AS r, greatest(u / sum(u) OVER (), 1e-6) AS u FROM g)
 SELECT round(sum((u - r) * ln(u / r)), 6) AS psi FROM s""")
def drift_expectation_psi(spark, sf_dir):
    return _round(expectation_psi(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", "o_orderkey"), psi=6)


@query("drift_window", f"""{_ORDERS}, a AS (SELECT count(*) FILTER (WHERE w = 'early') AS early_n, avg(o_totalprice) FILTER (WHERE w = 'early') AS early_mean, median(o_totalprice) FILTER (WHERE w = 'early') AS early_median,
 count(*) FILTER (WHERE w = 'recent') AS recent_n, avg(o_totalprice) FILTER (WHERE w = 'recent') AS recent_mean, median(o_totalprice) FILTER (WHERE w = 'recent') AS recent_median FROM w)
 SELECT early_n, recent_n, round(early_mean, 3) AS early_mean, round(recent_mean, 3) AS recent_mean, round(early_median, 3) AS early_median, round(recent_median, 3) AS recent_median, round(recent_mean - early_mean, 3) AS mean_change, round(recent_median - early_median, 3) AS median_change FROM a""")
def drift_window(spark, sf_dir):
    return _round(window_drift(orders_windows(spark, sf_dir), "o_totalprice"), early_mean=3, recent_mean=3, early_median=3, recent_median=3, mean_change=3, median_change=3)


@query("drift_decomposition", f"""{_ORDERS}, e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM w WHERE w = 'early'),
 g AS (SELECT len(list_filter(q[2:10], lambda y: y < o_totalprice))::INT AS bin, count(*) FILTER (WHERE w = 'early') AS e, count(*) FILTER (WHERE w = 'recent') AS r FROM w, e GROUP BY 1),
 s AS (SELECT *, e / sum(e) OVER () AS p, r / sum(r) OVER () AS q FROM g), c AS (SELECT bin, e, r, (q - p) * ln((q + 1e-6) / (p + 1e-6)) AS k, abs(sum(p) OVER (ORDER BY bin) - sum(q) OVER (ORDER BY bin)) AS gap FROM s)
 SELECT bin, e, r, round(k, 6) AS contribution, round(gap, 6) AS ks_gap, round(abs(k) / sum(abs(k)) OVER (), 5) AS share FROM c""")
def drift_decomposition(spark, sf_dir):
    return _round(decomposition(orders_windows(spark, sf_dir), "o_totalprice"), contribution=6, ks_gap=6, share=5)


_GOVERNED = """WITH p AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'baseline' ELSE 'current' END AS population FROM orders),
 e AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM p WHERE population = 'baseline'),
 r AS (SELECT 'o_totalprice' AS feature, 'B' || len(list_filter(q, lambda y: y < o_totalprice)) AS bin, population FROM p, e
 UNION ALL SELECT 'o_orderpriority', CASE o_orderpriority WHEN '1-URGENT' THEN 'B0' WHEN '2-HIGH' THEN 'B1' ELSE 'UNSEEN' END, population FROM p),
 g AS (SELECT feature, bin, count(*) FILTER (WHERE population = 'baseline') AS baseline, count(*) FILTER (WHERE population = 'current') AS "current" FROM r GROUP BY 1, 2),
 s AS (SELECT *, greatest(baseline / sum(baseline) OVER (PARTITION BY feature), 1e-6) AS a, greatest("current" / sum("current") OVER (PARTITION BY feature), 1e-6) AS b FROM g),
 k AS (SELECT feature, bin, baseline, "current", (b - a) * ln(b / a) AS contribution FROM s)"""


def governed(spark, sf_dir):
    from plumbline.operators.population import split

    df = split(table(spark, sf_dir, "orders"), "o_orderdate", {"operator": "<", "value": "1998-01-01 00:00:00"})
    numbers = draft_bins(df.where("population = 'baseline'"), "o_totalprice", True)
    groups = {"feature": "o_orderpriority", "groups": ["1-URGENT", "2-HIGH"]}
    for spec in (numbers, groups):
        validate_bins(spec)
    return governed_psi(df, [numbers, groups])


@query("drift_governed_psi", f"""{_GOVERNED} SELECT feature, bin, baseline, "current", round(contribution, 6) AS contribution FROM k""")
def drift_governed_psi(spark, sf_dir):
    return _round(governed(spark, sf_dir), contribution=6)


@query("drift_governed_summary", f"""{_GOVERNED} SELECT feature, round(sum(contribution), 6) AS psi, arg_max(bin, (contribution, bin)) AS dominant_bin, CASE WHEN sum(contribution) >= 0.25 THEN 'investigate' WHEN sum(contribution) >= 0.1 THEN 'watch' ELSE 'stable' END AS classification FROM k GROUP BY 1""")
def drift_governed_summary(spark, sf_dir):
    return _round(psi_summary(governed(spark, sf_dir)), psi=6)


@query("drift_bin_coverage", """SELECT DISTINCT o_orderpriority AS value, 'unmatched' AS status FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '9-NONE') UNION ALL SELECT '9-NONE', 'unused'""")
def drift_bin_coverage(spark, sf_dir):
    return bin_coverage(table(spark, sf_dir, "orders"), {"feature": "o_orderpriority", "groups": ["1-URGENT", "9-NONE"]})


@query("drift_project_groups", """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'top' ELSE o_orderpriority END AS grp, count(*) AS n, count(DISTINCT o_orderpriority) AS categories FROM orders GROUP BY 1""")
def drift_project_groups(spark, sf_dir):
    return project_groups(table(spark, sf_dir, "orders"), "o_orderpriority", spark.createDataFrame([("1-URGENT", "top"), ("2-HIGH", "top")], "value string, grp string"))


@query("drift_ks", f"""{_EVENTS}, g AS (SELECT value, count(*) FILTER (WHERE w = 'early') AS a, count(*) FILTER (WHERE w <> 'early') AS b FROM w GROUP BY 1),
 c AS (SELECT abs(sum(a) OVER (ORDER BY value) / sum(a) OVER () - sum(b) OVER (ORDER BY value) / sum(b) OVER ()) AS gap FROM g) SELECT round(max(gap), 6) AS ks FROM c""")
def drift_ks(spark, sf_dir):
    return _round(ks(early_recent(table(spark, sf_dir, "events"), "ts"), "value", F.col("window") == "early"), ks=6)


@query("drift_ks_by_segment", """WITH b AS (SELECT event_type AS s FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), v AS (SELECT DISTINCT value FROM events), o AS (SELECT DISTINCT event_type AS s FROM events WHERE event_type <> (SELECT s FROM b)),
 g AS (SELECT o.s AS segment, v.value, count(*) FILTER (WHERE e.event_type = (SELECT s FROM b)) AS a, count(*) FILTER (WHERE e.event_type = o.s) AS b FROM o, v JOIN events e ON e.value = v.value GROUP BY 1, 2),
 c AS (SELECT segment, abs(sum(a) OVER (PARTITION BY segment ORDER BY value) / sum(a) OVER (PARTITION BY segment) - sum(b) OVER (PARTITION BY segment ORDER BY value) / sum(b) OVER (PARTITION BY segment)) AS gap FROM g)
 SELECT segment, round(max(gap), 6) AS ks, (SELECT s FROM b) AS baseline FROM c GROUP BY 1""")
def drift_ks_by_segment(spark, sf_dir):
    return _round(ks_by_segment(table(spark, sf_dir, "events"), "value", "event_type"), ks=6)


@query("drift_quarterly_rate", "SELECT round(max(r) - min(r), 6) AS range, round(stddev_pop(r), 6) AS std, count(*) AS quarters FROM (SELECT avg((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY date_trunc('quarter', l_shipdate))")
def drift_quarterly_rate(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return _round(quarterly_rate(df, "y", "l_shipdate"), range=6, std=6)


@query("drift_observation_months", "SELECT ((year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate)))::INT AS months FROM orders")
def drift_observation_months(spark, sf_dir):
    return observation_months(table(spark, sf_dir, "orders"), "o_orderdate")


@query("drift_regime_coverage", "SELECT round(avg((strftime(o_orderdate, '%Y-%m') BETWEEN '1997-03' AND '1997-12')::INT), 6) AS share, true AS overlaps, avg((strftime(o_orderdate, '%Y-%m') BETWEEN '1997-03' AND '1997-12')::INT) >= 0.05 AS passed FROM orders")
def drift_regime_coverage(spark, sf_dir):
    return _round(regime_coverage(table(spark, sf_dir, "orders"), "o_orderdate", "1997-03", "1997-12"), share=6)


@query("drift_relationship", f"""WITH {_SPLIT.format(d="l_shipdate", t="lineitem")}, a AS (SELECT corr(l_quantity, l_extendedprice) FILTER (WHERE w = 'early') AS e, corr(l_quantity, l_extendedprice) FILTER (WHERE w = 'recent') AS r FROM w)
 SELECT round(e, 6) AS early, round(r, 6) AS recent, round(r - e, 6) AS change FROM a""")
def drift_relationship(spark, sf_dir):
    return _round(relationship_drift(early_recent(table(spark, sf_dir, "lineitem"), "l_shipdate"), "l_quantity", "l_extendedprice"), early=6, recent=6, change=6)


@query("drift_segments", f"""{_ORDERS}, a AS (SELECT o_orderpriority AS segment, avg(o_totalprice) FILTER (WHERE w = 'early') AS e, avg(o_totalprice) FILTER (WHERE w = 'recent') AS r FROM w GROUP BY 1)
 SELECT segment, round(e, 3) AS early, round(r, 3) AS recent, round(r - e, 3) AS change, row_number() OVER (ORDER BY abs(r - e) DESC, segment)::INT AS position FROM a""")
def drift_segments(spark, sf_dir):
    return _round(segment_attribution(orders_windows(spark, sf_dir), "o_totalprice", "o_orderpriority"), early=3, recent=3, change=3)


@query("drift_gaps", """SELECT b::VARCHAR AS from_day, d::VARCHAR AS to_day, (d - b)::INT AS days FROM (SELECT d, lag(d) OVER (ORDER BY d) AS b FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)) WHERE b IS NOT NULL ORDER BY days DESC, from_day LIMIT 10""")
def drift_gaps(spark, sf_dir):
    return gaps(table(spark, sf_dir, "orders"), "o_orderdate")


@query("drift_version_diff", """WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-07-01'), n AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01'),
 eo AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS c FROM o), en AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS c FROM n),
 ho AS (SELECT least(floor((o_totalprice - lo) / (hi - lo) * 10), 9)::INT AS b, count(*) / any_value(c) AS p FROM o, eo GROUP BY 1), hn AS (SELECT least(floor((o_totalprice - lo) / (hi - lo) * 10), 9)::INT AS b, count(*) / any_value(c) AS p FROM n, en GROUP BY 1)
 SELECT 'o_totalprice' AS "column", (SELECT count(*) FROM n) - (SELECT count(*) FROM o) AS row_change, (SELECT count(DISTINCT o_totalprice) FROM n) - (SELECT count(DISTINCT o_totalprice) FROM o) AS distinct_change,
 round((SELECT avg(o_totalprice) FROM n) - (SELECT avg(o_totalprice) FROM o), 3) AS mean_change, round((SELECT stddev_pop(o_totalprice) FROM n) - (SELECT stddev_pop(o_totalprice) FROM o), 3) AS std_change,
 (SELECT round(sum(abs(coalesce(ho.p, 0) - coalesce(hn.p, 0))), 6) FROM ho FULL JOIN hn ON ho.b = hn.b) AS histogram_shift""")
def drift_version_diff(spark, sf_dir):
    df, cut = table(spark, sf_dir, "orders"), F.col("o_orderdate") < F.lit("1997-07-01").cast("timestamp")
    return _round(version_diff(df.where(cut), df.where(~cut), ["o_totalprice"]), mean_change=3, std_change=3, histogram_shift=6)
