"""Search for the drivers of a symptom by a shallow tree that is judged on held-out rows (DV-1 to DV-6)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.prefix import cumulative
from plumbline.functions.quantiles import percentiles
from plumbline.functions.values import rounded
from plumbline.operators.drift import assign, governed_psi
from plumbline.operators.population import split
from plumbline.operators.profile import distinct_counts, is_special
from plumbline.plans.registry import query
from plumbline.session import materialise, table

#: Parts of names that tell identifiers and direct indicators of a column, most predictors.
IDENTIFIER_PARTS = ("id", "uuid", "guid", "row_number", "row_num", "index")
INDICATOR_PARTS = ("missing", "missing_flag", "is_missing", "null_flag", "complete_flag")
PREDICTORS = 50
#: Share of rows to learn from, depth, least rows of a class, of a leaf and their share, levels of a category, rules shown.
LEARN, DEPTH, LEAST_CLASS, LEAST_LEAF, LEAF_SHARE, LEVELS, RULES = 0.7, 3, 20, 20, 0.02, 20, 8
NUMERIC_SHARE, DATE_SHARE = 0.9, 0.8


def universe(df: DataFrame, affected: str, split_feature: str | None = None, requested: Sequence[str] = (), values: DataFrame | None = None) -> DataFrame:
    """(column, used, reason) of every column, those asked for first: the affected and the split column, identifiers and direct
    indicators of the affected column by their names are out, and so is what is beyond the first PREDICTORS (DV-2). With `values`
    (column, distinct) columns of fewer than two values are out as well."""
    order = [*requested, *(c for c in df.columns if c not in requested)]
    catalogue = df.sparkSession.createDataFrame([(i, c, c in df.columns) for i, c in enumerate(order)], "position int, column string, present boolean")
    name, own = F.lower("column"), affected.lower()
    identifier = F.lit(False)
    for part in IDENTIFIER_PARTS:
        identifier = identifier | (name == part) | name.endswith(f"_{part}") | name.startswith(f"{part}_")
    indicator = name.isin(*[f"{own}_{p}" for p in INDICATOR_PARTS], *[f"{p}_{own}" for p in INDICATOR_PARTS])
    reason = F.when(~F.col("present"), "absent").when(F.col("column") == affected, "affected").when(F.col("column") == F.lit(split_feature), "split").when(identifier, "identifier").when(indicator, "indicator")
    if values is not None:
        catalogue = catalogue.join(F.broadcast(values), "column", "left")  # one row a column
        reason = reason.when(F.coalesce("distinct", F.lit(0)) < 2, "constant")
    found = catalogue.withColumn("reason", reason)
    place = F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(Window.partitionBy().orderBy("position"))  # one row a column
    found = found.withColumn("reason", F.when(F.col("reason").isNull() & (place > PREDICTORS), "beyond the limit").otherwise(F.col("reason")))
    return found.select("column", F.col("reason").isNull().alias("used"), "reason")


def surveyed(df: DataFrame, affected: str, split_feature: str | None = None, requested: Sequence[str] = ()) -> DataFrame:
    """The universe with the number of different values of every column (distinct), counted over all rows: constants are out."""
    values = materialise(distinct_counts(df, df.columns).select("column", F.col("distinct_raw").alias("distinct")), "survey")
    return universe(df, affected, split_feature, requested, values).join(F.broadcast(values), "column", "left").na.fill(0, ["distinct"])


def dominant_bin(parts: DataFrame) -> str:
    """The bin of the largest movement, up or down, of one feature's PSI contributions (bin, contribution)."""
    return parts.orderBy(F.desc(F.abs("contribution")), "bin").first().bin


def target(df: DataFrame, mode: str, affected: str, codes: Sequence = (), bins: Mapping | None = None, target_bin: str | None = None) -> tuple[DataFrame, Column]:
    """The rows that take part and the 0/1 target over them (DV-1): population membership (current against baseline), missing
    values and declared codes, or membership of a frozen PSI bin (the bin of missing values is plain nullness). Where `df` names
    populations, rows of neither are out."""
    rows = df.where("population is not null") if "population" in df.columns else df
    if mode == "population_membership":
        if "population" not in df.columns:
            raise ValueError("split the rows into populations first")
        return rows, (F.col("population") == "current").cast("int")
    if mode == "missingness":
        return rows, (F.col(affected).isNull() | is_special(F.col(affected), list(codes))).cast("int")
    if mode == "psi_bin_membership":
        if not bins or not target_bin:
            raise ValueError("give the frozen bins and the target bin")
        return rows, (assign(dict(bins)) == target_bin).cast("int")
    raise ValueError(f"unknown target mode {mode!r}")


@dataclass
class Encoded:
    rows: DataFrame
    names: list[str]
    sources: list[str]
    rejected: dict[str, str]


def encode(df: DataFrame, y: Column, columns: Sequence[str], specials: Mapping[str, Sequence] | None = None) -> Encoded:
    """Stored rows (uid, y, f0, f1, ...): for each column an indicator of missing values and one of each special code, and its
    regular values as year and quarter (names of dates and quarters that parse in 80 %), as a number (90 % parse; the
    median elsewhere), or as the 20 most frequent texts and the rest; texts of too many values are rejected (DV-3)."""
    specials = specials or {}
    names: list[str] = []
    exprs: list[Column] = []
    sources: list[str] = []
    rejected: dict[str, str] = {}

    def add(name: str, source: str, e: Column) -> None:
        names.append(name)
        sources.append(source)
        exprs.append(e)

    regular = {c: F.col(c).isNotNull() & ~is_special(F.col(c), list(specials.get(c, ()))) for c in columns}
    text = {c: F.when(regular[c], F.col(c).cast("string")) for c in columns}
    dated = {c: any(t in c.lower() for t in ("date", "time", "quarter", "month")) for c in columns}
    quarter = {c: F.regexp_extract(text[c], r"(\d{4})\D*[Qq]([1-4])", 1) for c in columns}
    day = {c: F.to_date(F.when(regular[c], F.col(c).cast("timestamp"))) if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.to_date(F.try_to_timestamp(text[c])) for c in columns}
    number = {c: F.when(regular[c], F.col(c).cast("double")) if isinstance(df.schema[c].dataType, T.NumericType) else text[c].try_cast("double") for c in columns}
    counted = []
    for i, c in enumerate(columns):
        counted += [F.count_if(regular[c]).alias(f"r{i}"), F.count(number[c]).alias(f"n{i}")]
        counted += [F.count(day[c]).alias(f"d{i}"), F.count_if(quarter[c] != "").alias(f"q{i}")] if dated[c] else []
    one = df.agg(F.count("*").alias("rows"), *counted).first()
    middle: dict[str, Column] = {}
    plan: dict[str, str] = {}
    for i, c in enumerate(columns):
        r = one[f"r{i}"]
        if "quarter" in c.lower() and r and one[f"q{i}"] >= DATE_SHARE * r:
            plan[c], parts = "date", {"year": F.nullif(quarter[c], F.lit("")).cast("double"), "quarter": F.nullif(F.regexp_extract(text[c], r"(\d{4})\D*[Qq]([1-4])", 2), F.lit("")).cast("double")}
        elif dated[c] and r and one[f"d{i}"] >= DATE_SHARE * r:
            plan[c], parts = "date", {"year": F.year(day[c]).cast("double"), "quarter": F.quarter(day[c]).cast("double")}
        elif r and one[f"n{i}"] >= NUMERIC_SHARE * r:
            plan[c], parts = "number", {"": number[c]}
        else:
            plan[c], parts = "text", {}
        middle |= {f"{c}\0{k}": v for k, v in parts.items()}
    medians = {r["column"]: r.q[0] for r in percentiles(df, middle, [0.5]).collect()} if middle else {}  # one row a predictor
    texts = [c for c in columns if plan[c] == "text"]
    levels: dict[str, list[str]] = {}
    if texts:
        per = df.select(F.array(*[F.struct(F.lit(c).alias("column"), text[c].alias("v")) for c in texts]).alias("r")).select(F.inline("r")).where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
        per = materialise(per, "levels")
        sizes = {r["column"]: r.k for r in per.groupBy("column").agg(F.count("*").alias("k")).collect()}  # one row a column
        most = min(50, max(12, math.ceil(0.2 * one.rows)))
        rejected = {c: f"{sizes[c]} values" for c in texts if sizes.get(c, 0) > most}
        place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "v"))
        for r in per.where(~F.col("column").isin(*rejected) if rejected else F.lit(True)).withColumn("i", place).where(F.col("i") <= most).orderBy("column", "i").collect():  # at most 50 a column
            levels.setdefault(r["column"], []).append(r.v)
    for c in columns:
        if c in rejected:
            continue
        add(f"{c} missing", c, F.col(c).isNull().cast("double"))
        for code in specials.get(c, ()):
            add(f"{c} special: {code}", c, is_special(F.col(c), [code]).cast("double"))
        for key, value in middle.items():
            if key.split("\0")[0] == c:
                part = key.split("\0")[1]
                add(f"{c} {part}".strip(), c, F.coalesce(value, F.lit(float(medians.get(key) or 0.0))))
        if plan[c] == "text":
            top = levels.get(c, [])[:LEVELS]
            for v in top:
                add(f"{c} = {v}", c, F.coalesce(text[c] == v, F.lit(False)).cast("double"))
            if len(levels.get(c, [])) > LEVELS:
                add(f"{c} = <other>", c, F.coalesce(~text[c].isin(*top), F.lit(False)).cast("double"))
    kept = [c for c in ("population",) if c in df.columns]
    rows = df.select(F.monotonically_increasing_id().alias("uid"), y.cast("double").alias("y"), *kept, *[e.alias(f"f{i}") for i, e in enumerate(exprs)])
    return Encoded(materialise(rows, "drivers"), names, sources, rejected)


def dealt(rows: DataFrame, share: float = LEARN) -> DataFrame:
    """`rows` (uid, y, ...) with `learn`: in each class the given share of its rows, to the row, in the order of a hash of
    uid. Ranks come from range partitions, so no class is in one task (DV-4)."""
    ranked = cumulative(rows.withColumns({"_hash": F.xxhash64("uid"), "_one": F.lit(1)}), ["_hash", "uid"], {"_rank": "_one"}, ["y"])
    return ranked.withColumn("learn", F.col("_rank") <= F.round(F.col("_rank_total") * share)).drop("_hash", "_one", "_rank", "_rank_total")


def balanced_accuracy(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Mean of the shares at which rows of either class are told at a score of one half (DV-4)."""
    hit = ((F.col(score) >= 0.5).cast("int") == F.col(y).cast("int")).cast("double")
    return scored.agg(((F.avg(F.when(F.col(y) == 1, hit)) + F.avg(F.when(F.col(y) == 0, hit))) / 2).alias("balanced_accuracy"))


def score_auc(scored: DataFrame) -> DataFrame:
    """AUC of a score with few different values (the leaves'): one row a score."""
    per = scored.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    below = F.sum("q").over(Window.partitionBy().orderBy("score"))  # one row a leaf
    return per.withColumn("a", F.col("p") * (below - F.col("q") / 2)).agg((F.sum("a") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auc"))


@dataclass
class Found:
    """importance: (rank, feature, importance); rules: (rule, features, rows, hits, rate, base_rate, lift) of the held-out rows;
    metrics: one row; segments: (segment, rows, hits, rate) of the leading feature's states; attribution: the leading rule's part in
    the movement between the populations, or None."""

    importance: DataFrame
    rules: DataFrame
    metrics: DataFrame
    segments: DataFrame | None
    attribution: DataFrame | None
    rejected: dict[str, str]


def search(df: DataFrame, y: Column, columns: Sequence[str], specials: Mapping[str, Sequence] | None = None) -> Found:
    """The search itself: the tree learns from 70 % of the rows of either class; rules, AUC and balanced accuracy are of the
    others; importance is summed to the source columns (DV-4, DV-5, DV-6)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    spark = df.sparkSession
    encoded = encode(df, y, columns, specials)
    sizes = {r.y: r.n for r in encoded.rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0.0, 1.0} or min(sizes.values()) < LEAST_CLASS:
        raise ValueError(f"the target needs two classes with at least {LEAST_CLASS} rows each")
    if not encoded.names:
        raise ValueError("no predictor could be encoded")
    rows = materialise(dealt(encoded.rows), "dealt")
    features = [f"f{i}" for i in range(len(encoded.names))]
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    learned = rows.where("learn").count()
    least = max(LEAST_LEAF, math.ceil(learned * LEAF_SHARE))
    model = DecisionTreeRegressor(labelCol="y", maxDepth=DEPTH, minInstancesPerNode=least, maxBins=64, seed=41).fit(vectors.where("learn"))
    paths: list[tuple[list[tuple[int, bool, float]], float]] = []
    cuts: dict[int, float] = {}

    def walk(node, path):
        if node.getClass().getSimpleName() == "LeafNode":
            paths.append((path, float(node.prediction())))
            return
        cut = node.split()
        cuts.setdefault(cut.featureIndex(), cut.threshold())
        walk(node.leftChild(), [*path, (cut.featureIndex(), True, cut.threshold())])
        walk(node.rightChild(), [*path, (cut.featureIndex(), False, cut.threshold())])

    walk(model._java_obj.rootNode(), [])
    leaf = score = None
    for i, (path, said) in enumerate(paths):
        hit = F.lit(True)
        for f, left, at in path:
            hit = hit & (F.col(f"f{f}") <= at if left else F.col(f"f{f}") > at)
        leaf = F.when(hit, i) if leaf is None else leaf.when(hit, i)
        score = F.when(hit, said) if score is None else score.when(hit, said)
    kept = [c for c in ("population",) if c in rows.columns]
    scored = materialise(rows.select("y", "learn", *kept, leaf.alias("leaf"), score.alias("score")), "scored")
    held = scored.where("not learn")
    base = held.agg(F.avg("y")).first()[0]

    def text(f: int, left: bool, at: float) -> str:
        name = encoded.names[f]
        if " = " in name or name.endswith(" missing") or " special: " in name:
            return f"not {name}" if left else name
        return f"{name} {'<=' if left else '>'} {at:.4g}"

    per = {r.leaf: r for r in held.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("y").alias("k")).collect()}  # 2 ** DEPTH leaves at most
    rules = []
    for i, (path, _) in enumerate(paths):
        if i in per and per[i].k / per[i].n > base:
            rate = per[i].k / per[i].n
            rules.append((i, " and ".join(text(*p) for p in path) or "all rows", list(dict.fromkeys(encoded.sources[f] for f, _, _ in path)), per[i].n, int(per[i].k), rate, base, rate / base if base else None))
    rules = sorted(rules, key=lambda r: (-(r[7] or 0), -r[3], r[1]))[:RULES]
    total: dict[str, float] = {}
    for s, v in zip(encoded.sources, model.featureImportances.toArray()):
        total[s] = total.get(s, 0.0) + float(v)
    ranked = sorted(total.items(), key=lambda x: (-x[1], x[0]))
    leading = ranked[0][0] if ranked and ranked[0][1] > 0 else None
    importance = spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(ranked, 1) if v > 0][:8], "rank int, feature string, importance double")
    metrics = score_auc(held).crossJoin(balanced_accuracy(held)).crossJoin(spark.createDataFrame([(leading, learned, least, base)], "leading string, learned bigint, least_leaf bigint, base_rate double"))  # single rows
    segments = None
    if leading is not None:
        cut = next((at for f, at in cuts.items() if encoded.names[f] == leading), None)
        segments = exclusive_segments(df, y == 1, leading, cut, list((specials or {}).get(leading, ())))
    moved = attribution(scored, rules[0][0], rules[0][1]) if rules and kept else None
    shown = spark.createDataFrame([r[1:] for r in rules], "rule string, features array<string>, rows bigint, hits bigint, rate double, base_rate double, lift double")
    return Found(importance, shown, metrics, segments, moved, encoded.rejected)


def attribution(scored: DataFrame, leaf: int, rule: str) -> DataFrame:
    """(population, rule, rows, segment_rows, hits, rate, share): the rule's rows in either population, the symptom's rate among them
    and its share of the population; movement and its share of the whole movement are the same in both rows."""
    inside = F.col("leaf") == leaf
    per = scored.groupBy("population").agg(F.count("*").alias("rows"), F.count_if(inside).alias("segment_rows"), F.count_if(inside & (F.col("y") == 1)).alias("hits"), F.avg("y").alias("whole"))
    both = Window.partitionBy()  # two rows
    share = F.col("hits") / F.col("rows")
    change = lambda c: F.max(F.when(F.col("population") == "current", c)).over(both) - F.max(F.when(F.col("population") == "baseline", c)).over(both)
    out = per.withColumns({"share": share, "rate": F.col("hits") / F.nullif(F.col("segment_rows"), F.lit(0))})
    out = out.withColumns({"movement": change(F.col("share")), "whole_movement": change(F.col("whole"))})
    return out.select("population", F.lit(rule).alias("rule"), "rows", "segment_rows", "hits", "rate", "share", "movement", (F.abs("movement") / F.nullif(F.abs("whole_movement"), F.lit(0.0))).alias("movement_share"))


def exclusive_segments(df: DataFrame, symptom: Column, feature: str, threshold: float | None = None, codes: Sequence | None = None) -> DataFrame:
    """Mutually exclusive states of a feature (regular, at or below and above a threshold if there is one; missing; each
    special code) with rows, target rows and their rate (DV-6)."""
    x = F.col(feature)
    state = F.when(x.isNull(), f"{feature} missing")
    for v in codes or []:
        state = state.when(is_special(x, [v]), f"{feature} special: {v}")
    if threshold is not None:
        number = x.cast("string").try_cast("double")
        state = state.when(number <= threshold, f"{feature} <= {threshold:.4g}").when(number > threshold, f"{feature} > {threshold:.4g}")
    state = state.otherwise(f"{feature} regular")
    return df.groupBy(state.alias("segment")).agg(F.count("*").alias("rows"), F.count_if(symptom).alias("hits")).withColumn("rate", F.col("hits") / F.col("rows"))


_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_clerk_id", "o_totalprice_missing", "row_number"]


def _orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.withColumns({"o_clerk_id": F.col("o_custkey") % 7, "o_totalprice_missing": F.lit(0), "row_number": F.col("o_orderkey")}).select(*_COLUMNS)


@query("gates_universe", "WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_custkey % 7 AS o_clerk_id, 0 AS o_totalprice_missing, o_orderkey AS row_number FROM orders), n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS d FROM o" for c in _COLUMNS) + "), r AS (SELECT \"column\", d, CASE WHEN \"column\" = 'o_totalprice' THEN 'affected' WHEN \"column\" = 'o_orderdate' THEN 'split' WHEN regexp_matches(\"column\", '(^|_)(id|uuid|guid|row_number|row_num|index)$|^(id|uuid|guid|row_number|row_num|index)_') THEN 'identifier' WHEN regexp_matches(\"column\", '^o_totalprice_(missing|missing_flag|is_missing|null_flag|complete_flag)$') THEN 'indicator' WHEN d < 2 THEN 'constant' END AS reason FROM n) SELECT \"column\", reason IS NULL AS used, reason, d AS \"distinct\" FROM r")
def gates_universe(spark, sf_dir):
    return surveyed(_orders(spark, sf_dir), "o_totalprice", "o_orderdate")


@query("gates_segments", """SELECT CASE WHEN l_quantity = 50 THEN 'l_quantity special: 50' WHEN l_quantity <= 25 THEN 'l_quantity <= 25' ELSE 'l_quantity > 25' END AS segment, count(*) AS rows, count(*) FILTER (WHERE l_extendedprice > 40000) AS hits, round(count(*) FILTER (WHERE l_extendedprice > 40000) / count(*), 6) AS rate FROM lineitem GROUP BY 1""")
def gates_segments(spark, sf_dir):
    return exclusive_segments(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice") > 40000, "l_quantity", 25, [50]).withColumn("rate", F.round("rate", 6))


@query("drivers_split", "SELECT (l_returnflag = 'R')::INTEGER AS y, count(*) AS rows, round(count(*) * 0.7)::BIGINT AS learned FROM lineitem GROUP BY 1")
def drivers_split(spark, sf_dir):
    """Rows of either class to learn from, to the row."""
    rows = materialise(table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("uid"), (F.col("l_returnflag") == "R").cast("int").alias("y")), "uids")
    return dealt(rows).groupBy("y").agg(F.count("*").alias("rows"), F.count_if("learn").alias("learned"))


_BINS = {"feature": "o_totalprice", "edges": [50000.0, 150000.0, 250000.0]}


def _populations(spark, sf_dir):
    """Orders before and from 1998, where urgent orders of the later ones cost more."""
    df = split(table(spark, sf_dir, "orders"), "o_orderdate", {"operator": "<", "value": "1998-01-01 00:00:00"})
    dear = (F.col("population") == "current") & (F.col("o_orderpriority") == "1-URGENT")
    return df.withColumn("o_totalprice", F.when(dear, F.lit(260000.0) + F.col("o_orderkey") % 1000).otherwise(F.least(F.col("o_totalprice"), F.lit(240000.0))))


_MOVED = """p AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'baseline' ELSE 'current' END AS population, o_orderpriority, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '1-URGENT' THEN 260000.0 + o_orderkey % 1000 ELSE least(o_totalprice, 240000.0) END AS price FROM orders WHERE o_orderdate IS NOT NULL),
 b AS (SELECT population, o_orderpriority, 'B' || ((price > 50000)::INT + (price > 150000)::INT + (price > 250000)::INT) AS bin FROM p), c AS (SELECT bin, count(*) FILTER (WHERE population = 'baseline') AS b, count(*) FILTER (WHERE population = 'current') AS c FROM b GROUP BY 1),
 s AS (SELECT bin, greatest(b / sum(b) OVER (), 1e-6) AS x, greatest(c / sum(c) OVER (), 1e-6) AS y FROM c), d AS (SELECT bin FROM s ORDER BY abs((y - x) * ln(y / x)) DESC, bin LIMIT 1)"""


def _searched(spark, sf_dir) -> Found:
    df = _populations(spark, sf_dir)
    bin_ = dominant_bin(governed_psi(df, [_BINS]).where("feature = 'o_totalprice'").select("bin", "contribution"))
    rows, y = target(df, "psi_bin_membership", "o_totalprice", bins=_BINS, target_bin=bin_)
    used = [r["column"] for r in universe(df.drop("population"), "o_totalprice").where("used").collect()]
    return search(rows, y, [c for c in used if c not in ("o_orderkey", "o_comment")])


@query("drivers_attribution_rule", f"""WITH {_MOVED}, t AS (SELECT population, o_orderpriority, b.bin = d.bin AS y FROM b, d), g AS (SELECT population, count(*) AS rows, count(*) FILTER (WHERE y AND o_orderpriority = '1-URGENT') AS hits, avg(y::INT) AS whole FROM t GROUP BY 1),
 m AS (SELECT *, hits / rows AS share FROM g) SELECT population, rows, hits, round(share, 6) AS share, round(max(CASE WHEN population = 'current' THEN share END) OVER () - max(CASE WHEN population = 'baseline' THEN share END) OVER (), 6) AS movement,
 round(abs(max(CASE WHEN population = 'current' THEN share END) OVER () - max(CASE WHEN population = 'baseline' THEN share END) OVER ()) / abs(max(CASE WHEN population = 'current' THEN whole END) OVER () - max(CASE WHEN population = 'baseline' THEN whole END) OVER ()), 6) AS movement_share FROM m""")
def drivers_attribution_rule(spark, sf_dir):
    """The dominant PSI bin as target: the leading rule names the urgent orders of the later years, which hold all of it."""
    found = _searched(spark, sf_dir).attribution
    return found.select("population", "rows", "hits", *(rounded(F.col(c)).alias(c) for c in ("share", "movement", "movement_share")))


@query("drivers_features")
def drivers_features(spark, sf_dir):
    """Importance by source column; no SQL (a tree at binned thresholds), tested on a planted driver."""
    return _searched(spark, sf_dir).importance


@query("missing_tree")
def missing_tree(spark, sf_dir):
    """Rules, on held-out rows, of prices that urgent orders lack; no SQL, as above."""
    from plumbline.operators.gates import planted

    rows, y = target(planted(spark, sf_dir), "missingness", "urgent_gone")
    return search(rows, y, ["o_orderpriority", "o_orderstatus", "o_custkey"]).rules.drop("features")
