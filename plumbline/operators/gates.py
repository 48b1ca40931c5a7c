"""The missingness engine: predictors screened with reasons, a tree of each column's missing rows, verdicts, reviews and the
dataset's fitness (CM-7 to CM-13, CM-39)."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.quantiles import percentiles
from plumbline.functions.values import normal_text, rounded
from plumbline.operators.missingness import ascii_columns, block_table, co_missing, missing_mask, structural_breaks
from plumbline.plans.registry import query
from plumbline.session import materialise, table

#: Tolerated missing share by role, and the gates of leaves, categories and breaks.
TOLERANCES = {"identifier": 0.00, "target": 0.00, "mandatory": 0.01, "unmarked": 0.05, "optional": 0.15, "free_text": 0.30}
DEPTH, PURITY, ENRICHMENT, LIFT, EXPLAINED = 3, 0.80, 0.15, 1.25, 0.40
LEVELS, RAW_LEVELS, NUMERIC_PARSE = 20, 100, 0.95
USABLE = ("categorical", "binary", "continuous", "period", "date")
#: Roles whose breach makes a dataset unfit.
CRITICAL = ("identifier", "target", "mandatory")
OTHER = "<OTHER>"


def resolved(rows: int) -> dict[str, int]:
    """Parameters that depend on the number of rows (CM-12)."""
    return {"min_leaf_rows": max(30, round(0.01 * rows)), "min_category_rows": max(2, round(0.005 * rows))}


def _is_text(df: DataFrame, column: str) -> bool:
    return not isinstance(df.schema[column].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def profiles(df: DataFrame, columns: Sequence[str], masks: Mapping[str, Column], rows: int, types: Mapping[str, str] | None = None, ascii_only: Collection[str] = ()) -> DataFrame:
    """(column, logical_type, raw_levels, parsed, observed, retained, top): distinct known values of every column, from one shuffle of
    (column, value); texts in their compatibility form. The logical type is the given one, or told from the values: binary
    with two, date, continuous, categorical up to RAW_LEVELS, else free text (CM-7). `top` holds the most frequent levels of
    columns that have no more than RAW_LEVELS, most frequent first; levels are only gathered where they are so few."""
    text = {c: normal_text(F.col(c), c in ascii_only) if _is_text(df, c) else F.col(c).cast("string") for c in columns}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~masks[c], text[c]).alias("v")) for c in columns])
    per = df.select(pairs.alias("r")).select(F.inline("r")).where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
    per = materialise(per, "levels")
    least = resolved(rows)["min_category_rows"]
    sizes = per.groupBy("column").agg(F.count("*").alias("raw_levels"), F.sum("n").alias("observed"), F.sum(F.when(F.col("v").try_cast("double").isNotNull(), F.col("n")).otherwise(0)).alias("parsed"), F.count_if(F.col("n") >= least).alias("retained"))
    few = per.join(F.broadcast(sizes.where(F.col("raw_levels") <= RAW_LEVELS).select("column")), "column")  # one row a column
    ranked = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "v"))
    top = few.withColumn("i", ranked).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("i", "v", "n"))).alias("top"))
    kinds = {}
    for c in columns:
        kind = df.schema[c].dataType
        kinds[c] = "boolean" if isinstance(kind, T.BooleanType) else "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "number" if isinstance(kind, T.NumericType) else "text"
    given = types or {}
    catalogue = df.sparkSession.createDataFrame([(i, c, kinds[c], given.get(c)) for i, c in enumerate(columns)], "position int, column string, storage string, given string")
    levels = F.coalesce("raw_levels", F.lit(0))
    kind = (
        F.when(F.col("given").isNotNull(), F.col("given")).when((F.col("storage") == "boolean") | (levels == 2), "binary").when(F.col("storage") == "date", "date")
        .when(F.col("storage") == "number", "continuous").when(levels <= RAW_LEVELS, "categorical").otherwise("free_text")
    )
    return catalogue.join(sizes, "column", "left").join(top, "column", "left").select("position", "column", "storage", kind.alias("logical_type"), levels.alias("raw_levels"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("parsed", "observed", "retained")), "top")


def screen(found: DataFrame, target: str, block: Sequence[str] = ()) -> DataFrame:
    """(position, column, logical_type, status, reason, raw_levels, retained_levels, pooled_levels, encoded_levels, storage, top) of
    every column as a predictor of the target's missing rows: the target and its co-missing block mates are out, as are types
    that cannot be used, constants, categories with too many levels and texts that are no numbers (CM-8)."""
    kind, raw = F.col("logical_type"), F.col("raw_levels")
    categorical = kind.isin("categorical", "binary") | (kind.isin("period", "date") & (F.col("storage") == "text"))
    kept = F.when(F.col("retained") < F.least(F.lit(2), raw), F.least(F.lit(2), raw)).otherwise(F.col("retained"))
    pooling = (kept < raw) | (raw > LEVELS)
    kept = F.greatest(F.lit(1), F.least(kept, F.when(pooling, LEVELS - 1).otherwise(LEVELS)))
    kept = F.when(categorical, F.least(kept, F.greatest(raw, F.lit(1))))
    pooled = F.when(categorical, F.greatest(F.lit(0), raw - kept))
    levels = kept + (pooled > 0).cast("int")
    out = (
        F.when(F.col("column") == target, "target column").when(F.col("column").isin(*[b for b in block if b != target]), "target co-missingness block mate")
        .when(~kind.isin(*USABLE), F.concat(F.lit("logical type '"), kind, F.lit("' is not predictor-eligible")))
        .when(categorical & (raw < 2), "fewer than two observed normalized levels")
        .when(categorical & (raw > RAW_LEVELS), F.concat(raw.cast("string"), F.lit(f" levels exceed raw categorical limit {RAW_LEVELS}")))
        .when(categorical & (levels < 2), "rare-level pooling left fewer than two levels")
        .when((kind == "continuous") & (raw < 2), "fewer than two usable numeric values")
        .when((kind == "continuous") & (F.col("storage") == "text") & (F.col("parsed") < NUMERIC_PARSE * F.col("observed")), "fewer than 95% of observed values parse as numeric")
        .when(raw < 2, "fewer than two observed values")
    )
    fine = F.when(categorical, F.concat(F.lit("categorical encoded to "), levels.cast("string"), F.lit(" level(s)"))).when(kind == "continuous", "usable continuous predictor").otherwise("usable date or period predictor")
    return found.select(
        "position", "column", "logical_type", F.when(out.isNull(), "included").otherwise("excluded").alias("status"), F.coalesce(out, fine).alias("reason"), "raw_levels",
        kept.cast("int").alias("retained_levels"), pooled.cast("int").alias("pooled_levels"), levels.cast("int").alias("encoded_levels"), "storage", "top",
    )


@dataclass
class Encoded:
    """Predictors as columns f0, f1, ... of stored rows, with their names and source columns; missing masks as m_<column>."""

    rows: DataFrame
    names: list[str]
    sources: list[str]


def encode(df: DataFrame, screened: DataFrame, masks: Mapping[str, Column], ascii_only: Collection[str] = ()) -> Encoded:
    """All usable predictors at once: categories as their kept levels with the most frequent one for missing values and the rest
    pooled, numbers and dates with the median (CM-9). The rows are stored once for the trees of all columns."""
    named: list[tuple[str, str, Column]] = []
    numbers: dict[str, Column] = {}
    for r in screened.where("status = 'included'").orderBy("position").collect():  # one row a column
        c = r["column"]
        if r.encoded_levels is not None:
            kept = [t.v for t in (r.top or [])[: r.retained_levels]]
            text = normal_text(F.col(c), c in ascii_only) if r.storage == "text" else F.col(c).cast("string")
            value = F.coalesce(F.when(~masks[c], text), F.lit(r.top[0].v))
            level = F.when(value.isin(*kept), value).otherwise(OTHER)
            named += [(f"{c} = {v}", c, (level == v).cast("double")) for v in [*kept, *([OTHER] if r.pooled_levels else [])]]
        else:
            x = F.unix_micros(F.col(c).cast("timestamp")).cast("double") if r.storage == "date" else F.col(c).cast("string").try_cast("double")
            numbers[c] = F.when(~masks[c], x)
    middle = {r["column"]: r.q[0] for r in percentiles(df, numbers, [0.5]).collect()} if numbers else {}  # one row a predictor
    named += [(c, c, F.coalesce(x, F.lit(middle[c]))) for c, x in numbers.items() if c in middle]
    rows = df.select(*[m.alias(f"m_{c}") for c, m in masks.items()], *[e.alias(f"f{i}") for i, (_, _, e) in enumerate(named)])
    return Encoded(materialise(rows, "encoded"), [n for n, _, _ in named], [s for _, s, _ in named])


@dataclass
class Leaf:
    rule: str
    sources: list[str]
    rows: int
    hits: int
    share: float
    enrichment: float
    lift: float
    pattern: bool


@dataclass
class Pattern:
    """What a tree tells: its leaves, and over those that count as patterns the share of missing rows that they hold and
    whether the source column of most impurity decrease is on one of their paths."""

    leaves: list[Leaf]
    coverage: float
    precision: float
    agrees: bool
    importance: dict[str, float]

    @property
    def verdict(self) -> tuple[str, str]:
        if not any(x.pattern for x in self.leaves):
            return "c", "no_explainable_pattern"
        return "b", "tree_strong" if self.coverage >= EXPLAINED and self.agrees else "tree_weak"


def grow(encoded: Encoded, target: Column, use: Sequence[int], least: int, depth: int = DEPTH) -> Pattern:
    """A shallow tree of a 0/1 target on the predictors `use`; its leaves are counted on all rows (CM-10)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = encoded.rows.select(*[f"f{i}" for i in use], target.cast("double").alias("y"))
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in use], outputCol="features").transform(rows)
    # the variance of a 0/1 target is half its Gini impurity; a classifier would join leaves of the same majority
    model = DecisionTreeRegressor(labelCol="y", maxDepth=depth, minInstancesPerNode=least, maxBins=64, seed=7).fit(vectors)
    paths: list[list[tuple[int, bool, float]]] = []

    def walk(node, path):
        if node.getClass().getSimpleName() == "LeafNode":
            paths.append(path)
            return
        split = node.split()
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            walk(child, [*path, (use[split.featureIndex()], left, split.threshold())])

    walk(model._java_obj.rootNode(), [])
    number = None
    for i, path in enumerate(paths):
        hit = F.lit(True)
        for f, left, at in path:
            hit = hit & (F.col(f"f{f}") <= at if left else F.col(f"f{f}") > at)
        number = F.when(hit, i) if number is None else number.when(hit, i)
    per = {r.leaf: r for r in rows.groupBy(number.alias("leaf")).agg(F.count("*").alias("n"), F.sum("y").alias("hits")).collect()}  # 2 ** depth leaves at most
    total, hits = sum(r.n for r in per.values()), sum(r.hits for r in per.values())
    base = hits / total if total else 0.0

    def condition(f: int, left: bool, at: float) -> str:
        name = encoded.names[f]
        if " = " in name:
            return name.replace(" = ", " <> ", 1) if left else name
        return f"{name} {'<=' if left else '>'} {at:.6g}"

    leaves = []
    for i, path in enumerate(paths):
        if i in per:
            n, k = per[i].n, int(per[i].hits)
            share = k / n
            enrichment, lift = share - base, share / base if base else 0.0
            counts = n >= least and share >= PURITY and enrichment >= ENRICHMENT and lift >= LIFT
            leaves.append(Leaf(" and ".join(condition(*p) for p in path) or "all rows", [encoded.sources[f] for f, _, _ in path], n, k, share, enrichment, lift, counts))
    leaves.sort(key=lambda x: (-x.share, -x.rows, x.rule))
    importance: dict[str, float] = {}
    for i, v in zip(use, model.featureImportances.toArray()):
        importance[encoded.sources[i]] = importance.get(encoded.sources[i], 0.0) + float(v)
    pure = [x for x in leaves if x.pattern]
    on_paths = {s for x in pure for s in x.sources}
    leading = max(importance, key=importance.get) if importance else None
    held, chosen = sum(x.hits for x in pure), sum(x.rows for x in pure)
    return Pattern(leaves, held / hits if hits else 0.0, held / chosen if chosen else 0.0, not on_paths or leading in on_paths, importance)


VERDICTS = "column string, logical_type string, role string, share double, tolerance double, verdict string, subtype string, confidence string, coverage double, precision double, agrees boolean, max_lift double, rules array<string>, features array<string>, block string, reason string"


def column_verdicts(df: DataFrame, roles: Mapping[str, str], predictors: Sequence[str] | None = None, period: str | None = None, codes: Mapping[str, list] | None = None, types: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each column of `roles`: within its role's tolerance (a); entirely empty, broken at a period, or explained by
    pure leaves (b), strongly where they hold a broad share of the missing rows and agree with the importance of columns, weakly
    where not; no pattern (c); untestable (d), with the reason (CM-11, CM-12). One pass counts, one shuffle profiles and one
    store encodes all columns; a tree is grown for those that reach the last gate. All of `df`'s columns are candidates unless
    `predictors` names some."""
    spark, codes = df.sparkSession, codes or {}
    candidates = list(predictors) if predictors is not None else list(df.columns)
    columns = list(dict.fromkeys([*roles, *candidates]))
    plain = ascii_columns(df, columns)
    masks = {c: missing_mask(df, c, codes.get(c), c in plain) for c in columns}
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(masks[c]).alias(c) for c in roles]).first()
    n = one["_n"]
    share = {c: one[c] / n if n else 0.0 for c in roles}
    suspects = [c for c in roles if TOLERANCES[roles[c]] < share[c] < 1]
    least = resolved(n)["min_leaf_rows"]
    found = materialise(profiles(df, columns, masks, n, types, plain), "profiles")
    kinds = {r["column"]: r.logical_type for r in found.collect()}  # one row a column
    broken = {}
    if period is not None and suspects:
        broken = {r["column"]: r for r in structural_breaks(df, {c: masks[c] for c in suspects if c != period}, F.col(period)).collect()}
    pairs = materialise(co_missing(df, columns, masks), "co-missing")
    own = {r["column"]: r.block for r in block_table(pairs, columns).collect()}
    tested = [c for c in suspects if kinds[c] != "other" and c not in broken and min(one[c], n - one[c]) >= 2 * least]
    encoded = encode(df, screen(found.where(F.col("column").isin(*candidates)), ""), masks, plain) if tested else None
    out = []
    for c, role in roles.items():
        says = {"coverage": None, "precision": None, "agrees": None, "max_lift": None, "rules": [], "features": [], "reason": None, "confidence": "high"}
        if share[c] <= TOLERANCES[role]:
            verdict, subtype = "a", "below_threshold"
        elif share[c] == 1:
            verdict, subtype = "b", "entirely_empty"
        elif c in broken:
            verdict, subtype = "b", "lineage_break"
            says |= {"rules": [f"structural break at {broken[c].period}"], "features": [period]}
        elif c not in tested:
            verdict, subtype = "d", "untestable"
            says["reason"] = "type unresolved; only the flat-rate check is valid" if kinds[c] == "other" else "too few minority rows to fit a tree at this data volume"
        else:
            mates = [x for x in columns if own[x] == own[c]]
            use = [i for i, s in enumerate(encoded.sources) if s not in mates]
            if not use:
                verdict, subtype = "d", "untestable"
                says["reason"] = "every column tracking this gap is in its own co-missingness block" if len(mates) > 1 else "no independent column available to test against"
            else:
                tree = grow(encoded, F.col(f"m_{c}"), use, least)
                verdict, subtype = tree.verdict
                pure = [x for x in tree.leaves if x.pattern]
                says |= {"coverage": tree.coverage, "precision": tree.precision, "agrees": tree.agrees, "max_lift": max((x.lift for x in pure), default=0.0), "rules": [x.rule for x in pure], "features": list(dict.fromkeys(s for x in pure for s in x.sources))}
                if subtype == "tree_weak":
                    limits = ([] if tree.coverage >= EXPLAINED else ["coverage of missing rows is too low"]) + ([] if tree.agrees else ["paths and importance disagree"])
                    says |= {"confidence": "low", "reason": "; ".join(limits)}
        out.append((c, kinds[c], role, float(share[c]), TOLERANCES[role], verdict, subtype, says["confidence"], says["coverage"], says["precision"], says["agrees"], says["max_lift"], says["rules"], says["features"], own[c], says["reason"]))
    return spark.createDataFrame(out, VERDICTS)


def observations(verdicts: DataFrame) -> DataFrame:
    """One review row a column, open where its tolerance is exceeded (CM-39)."""
    return verdicts.select("column", "subtype", F.when(F.col("share") > F.col("tolerance"), "open").otherwise("closed").alias("review"))


def fitness(verdicts: DataFrame, top: int = 3) -> DataFrame:
    """One row: whether the dataset is ready, conditionally so or not, with the numbers behind it, the columns furthest beyond
    their tolerance, and the columns that most findings with a pattern name (CM-13). Not ready: a breach of a critical role, an
    untestable breach, more than half of the columns in breach, or more than a quarter without a pattern."""
    over, n = F.col("share") > F.col("tolerance"), F.col("n")
    excess = F.col("share") - F.col("tolerance")
    risk = F.array_sort(F.collect_list(F.when(over, F.struct((-F.round(excess, 9)).alias("k"), (-F.col("share")).alias("s"), F.col("column").alias("column")))))
    shared = verdicts.groupBy("block").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared_blocks"))
    named = verdicts.where("verdict = 'b'").select(F.explode(F.array_distinct("features")).alias("feature"), "coverage", "max_lift")
    named = named.groupBy("feature").agg(F.count("*").alias("findings"), F.avg("coverage").alias("coverage"), F.avg("max_lift").alias("lift"))
    ranked = named.agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("findings")).alias("k"), "feature", "findings", "coverage", "lift"))), 1, top).alias("f"))
    one = verdicts.agg(
        F.count("*").alias("n"), F.count_if(over).alias("breached"), F.count_if(over & F.col("role").isin(*CRITICAL)).alias("critical"), F.count_if(F.col("verdict") == "b").alias("structured"),
        F.count_if(F.col("verdict") == "c").alias("unexplained"), F.count_if(F.col("verdict") == "d").alias("untestable"), F.avg("share").alias("missing_cell_share"), F.slice(risk, 1, top).alias("risk"),
    )
    bad = (F.col("critical") > 0) | (F.col("untestable") > 0) | (F.col("breached") > 0.5 * n) | (F.col("unexplained") > 0.25 * n)
    status = F.when(bad, "not_ready").when(F.col("breached") > 0, "conditional").otherwise("ready")
    return one.crossJoin(ranked).crossJoin(shared).select(  # single rows
        status.alias("status"), (n - F.col("breached")).alias("acceptable"), "breached", "critical", "structured", "unexplained", "untestable", "missing_cell_share", "shared_blocks",
        F.transform("risk", lambda r: r["column"]).alias("risk_fields"), F.transform("f", lambda r: F.struct(r["feature"].alias("feature"), r["findings"].alias("findings"), r["coverage"].alias("coverage"), r["lift"].alias("lift"))).alias("top_features"),
    )


def planted(spark, sf_dir) -> DataFrame:
    """Orders with columns that go missing in every way that a verdict tells."""
    x, key, day = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_orderdate")
    urgent, dealt = F.col("o_orderpriority") == "1-URGENT", F.crc32(key.cast("string").cast("binary"))
    return table(spark, sf_dir, "orders").withColumns({
        "whole": x, "empty": F.lit(None).cast("double"), "late": F.when(day >= F.lit("1998-01-01").cast("timestamp"), x), "few": F.when(key % 500 != 1, x), "month": F.date_format(day, "yyyy-MM"),
        "urgent_gone": F.when(~urgent, x), "half_urgent_gone": F.when(~(urgent & (dealt % 2 == 0)), x), "third_gone": F.when(dealt % 3 != 0, x),
        "open_urgent_gone": F.when(~(urgent & (F.col("o_orderstatus") == "O")), x), "urgent_and_some_gone": F.when(~(urgent | (dealt % 2 == 0)), x), "mate": F.when(~urgent, key),
    })


_ROLES = {"whole": "mandatory", "empty": "optional", "late": "unmarked", "few": "identifier", "urgent_gone": "unmarked", "half_urgent_gone": "unmarked", "third_gone": "unmarked", "open_urgent_gone": "unmarked", "urgent_and_some_gone": "unmarked"}
_GONE = {
    "whole": "o_totalprice IS NULL", "empty": "true", "late": "o_orderdate < TIMESTAMP '1998-01-01'", "few": "o_orderkey % 500 = 1", "urgent_gone": "u", "half_urgent_gone": "u AND k % 2 = 0", "third_gone": "k % 3 = 0",
    "open_urgent_gone": "u AND o_orderstatus = 'O'", "urgent_and_some_gone": "u OR k % 2 = 0",
}
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(o_orderkey::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
_VERDICTS = f"""WITH o AS (SELECT *, o_orderpriority = '1-URGENT' AS u, {_CRC} AS k FROM orders), r(c, role_limit) AS (VALUES {', '.join(f"('{c}', {TOLERANCES[r]})" for c, r in _ROLES.items())}),
 g AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, o_orderpriority AS p, o_orderstatus AS s, strftime(o_orderdate, '%Y-%m') AS m, ({e}) AS gone FROM o" for c, e in _GONE.items())}),
 t AS (SELECT c, count(*) AS n, count(*) FILTER (WHERE gone) AS k FROM g GROUP BY 1), l AS (SELECT *, greatest(30, round(0.01 * n)) AS least, k / n AS share FROM t),
 months AS (SELECT c, m, sum(count(*) FILTER (WHERE gone)) OVER b / sum(count(*)) OVER b AS before, sum(count(*) FILTER (WHERE gone)) OVER a / sum(count(*)) OVER a AS after FROM g GROUP BY c, m
  WINDOW b AS (PARTITION BY c ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY c ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 breaks AS (SELECT DISTINCT c FROM months WHERE (before >= 0.95 AND after <= 0.05) OR (after >= 0.95 AND before <= 0.05)),
 cells AS (SELECT c, 'p' AS kind, p AS at_p, NULL AS at_s, count(*) AS n, count(*) FILTER (WHERE gone) AS k FROM g GROUP BY c, p UNION ALL SELECT c, 'ps', p, s, count(*), count(*) FILTER (WHERE gone) FROM g GROUP BY c, p, s),
 pure AS (SELECT cells.c, kind, sum(cells.k) / any_value(l.k) AS coverage FROM cells JOIN l ON l.c = cells.c WHERE cells.n >= least AND cells.k / cells.n >= 0.8 AND cells.k / cells.n - share >= 0.15 AND cells.k / cells.n / share >= 1.25 GROUP BY cells.c, kind),
 best AS (SELECT c, max(coverage) AS coverage FROM pure GROUP BY 1),
 v AS (SELECT l.c AS "column", share, role_limit, CASE WHEN share <= role_limit THEN 'below_threshold' WHEN share = 1 THEN 'entirely_empty' WHEN breaks.c IS NOT NULL THEN 'lineage_break' WHEN least(k, n - k) < 2 * least THEN 'untestable'
   WHEN best.c IS NULL THEN 'no_explainable_pattern' WHEN coverage >= 0.4 THEN 'tree_strong' ELSE 'tree_weak' END AS subtype FROM l JOIN r ON r.c = l.c LEFT JOIN breaks ON breaks.c = l.c LEFT JOIN best ON best.c = l.c)"""


def _verdicts(spark, sf_dir):
    return column_verdicts(planted(spark, sf_dir), _ROLES, ["o_orderpriority", "o_orderstatus"], "month")


@query("gates_review", _VERDICTS + """ SELECT "column", subtype, CASE WHEN share > role_limit THEN 'open' ELSE 'closed' END AS review FROM v""")
def gates_review(spark, sf_dir):
    """The SQL tells pure cells of priority and status, which the tree cuts out."""
    return observations(_verdicts(spark, sf_dir))


@query("missing_fitness", _VERDICTS + """, w AS (SELECT *, CASE subtype WHEN 'below_threshold' THEN 'a' WHEN 'no_explainable_pattern' THEN 'c' WHEN 'untestable' THEN 'd' ELSE 'b' END AS verdict, share > role_limit AS over FROM v),
 m AS (SELECT count(*) AS n, count(*) FILTER (WHERE over) AS breached, count(*) FILTER (WHERE over AND "column" IN ('whole', 'few')) AS critical, count(*) FILTER (WHERE verdict = 'b') AS structured, count(*) FILTER (WHERE verdict = 'c') AS unexplained, count(*) FILTER (WHERE verdict = 'd') AS untestable, avg(share) AS cells,
  array_to_string((list("column" ORDER BY round(share - role_limit, 9) DESC, share DESC, "column") FILTER (WHERE over))[1 : 3], ',') AS risk_fields FROM w)
 SELECT CASE WHEN critical > 0 OR untestable > 0 OR breached > 0.5 * n OR unexplained > 0.25 * n THEN 'not_ready' WHEN breached > 0 THEN 'conditional' ELSE 'ready' END AS status, n - breached AS acceptable, breached, critical, structured, unexplained, untestable, round(cells, 6) AS missing_cell_share, risk_fields FROM m""")
def missing_fitness(spark, sf_dir):
    found = fitness(_verdicts(spark, sf_dir))
    return found.select("status", "acceptable", "breached", "critical", "structured", "unexplained", "untestable", rounded(F.col("missing_cell_share")).alias("missing_cell_share"), F.array_join("risk_fields", ",").alias("risk_fields"))


@query("gates_leaf_rule", """WITH o AS (SELECT o_orderpriority = '1-URGENT' AS u, o_orderstatus = 'O' AS s FROM orders), c AS (SELECT 'urgent_gone' AS "column", count(*) FILTER (WHERE u) AS hits, count(*) AS n FROM o UNION ALL SELECT 'open_urgent_gone', count(*) FILTER (WHERE u AND s), count(*) FROM o)
 SELECT "column", hits AS rows, 1.0 AS share, round(n / hits, 6) AS lift, round(1 - hits / n, 6) AS enrichment, 1.0 AS coverage FROM c""")
def gates_leaf_rule(spark, sf_dir):
    """The pattern leaves of two columns: one level, and two levels together."""
    df = planted(spark, sf_dir)
    plain = ascii_columns(df, ["o_orderpriority", "o_orderstatus"])
    masks = {c: missing_mask(df, c, ascii_only=c in plain) for c in ("o_orderpriority", "o_orderstatus", "urgent_gone", "open_urgent_gone")}
    n = df.count()
    encoded = encode(df, screen(profiles(df, ["o_orderpriority", "o_orderstatus"], masks, n, ascii_only=plain), ""), masks, plain)
    out = []
    for c in ("urgent_gone", "open_urgent_gone"):
        tree = grow(encoded, F.col(f"m_{c}"), range(len(encoded.names)), resolved(n)["min_leaf_rows"])
        out += [(c, x.rows, x.share, x.lift, x.enrichment, tree.coverage) for x in tree.leaves if x.pattern]
    return spark.createDataFrame(out, "column string, rows bigint, share double, lift double, enrichment double, coverage double").withColumns({c: rounded(F.col(c)) for c in ("share", "lift", "enrichment", "coverage")})


_SCREENED = {"o_orderkey": "continuous", "o_custkey": "continuous", "o_orderstatus": None, "o_totalprice": "continuous", "o_orderdate": "date", "o_orderpriority": None, "clerk": None, "comment": None, "one": None, "mostly": None, "mate": "continuous", "urgent_gone": "continuous"}


@query("gates_screen", """WITH o AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice::VARCHAR AS o_totalprice, o_orderdate::VARCHAR AS o_orderdate, o_orderpriority, 'C' || (o_custkey % 60) AS clerk, 'note ' || o_orderkey AS comment, 'x' AS one,
  CASE WHEN o_orderkey % 900 = 0 THEN 'r' || (o_orderkey % 4) ELSE 'common' END AS mostly, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey END::VARCHAR AS mate, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END::VARCHAR AS urgent_gone FROM orders),
 l AS (UNPIVOT o ON COLUMNS(*) INTO NAME "column" VALUE v), c AS (SELECT "column", v, count(*) AS n FROM l GROUP BY 1, 2), n AS (SELECT greatest(2, round(0.005 * count(*))) AS least FROM orders), d AS (SELECT "column", count(*) AS raw, count(*) FILTER (WHERE c.n >= least) AS kept FROM c, n GROUP BY 1),
 k AS (SELECT *, CASE WHEN "column" IN ('o_orderkey', 'o_custkey', 'o_totalprice', 'mate', 'urgent_gone') THEN 'continuous' WHEN "column" = 'o_orderdate' THEN 'date' WHEN raw = 2 THEN 'binary' WHEN raw <= 100 THEN 'categorical' ELSE 'free_text' END AS logical_type, greatest(kept, least(2, raw)) AS k0 FROM d),
 p AS (SELECT *, CASE WHEN logical_type IN ('binary', 'categorical') THEN least(k0, CASE WHEN k0 < raw OR raw > 20 THEN 19 ELSE 20 END) END AS k1 FROM k), q AS (SELECT *, k1 + CASE WHEN raw > k1 THEN 1 ELSE 0 END AS levels FROM p)
 SELECT "column", logical_type, CASE WHEN "column" = 'urgent_gone' THEN 'target column' WHEN "column" = 'mate' THEN 'target co-missingness block mate' WHEN logical_type = 'free_text' THEN 'logical type ''free_text'' is not predictor-eligible' WHEN raw < 2 THEN 'fewer than two observed normalized levels'
  WHEN k1 IS NOT NULL THEN 'categorical encoded to ' || levels || ' level(s)' WHEN logical_type = 'continuous' THEN 'usable continuous predictor' ELSE 'usable date or period predictor' END AS reason, raw AS raw_levels, k1::INTEGER AS retained_levels, (raw - k1)::INTEGER AS pooled_levels, levels::INTEGER AS encoded_levels FROM q""")
def gates_screen(spark, sf_dir):
    """Every kind of candidate for the missing rows of a column, among them one that goes missing with it."""
    df = planted(spark, sf_dir)
    key = F.col("o_orderkey")
    df = df.withColumns({"clerk": F.concat(F.lit("C"), (F.col("o_custkey") % 60).cast("string")), "comment": F.concat(F.lit("note "), key.cast("string")), "one": F.lit("x"), "mostly": F.when(key % 900 == 0, F.concat(F.lit("r"), (key % 4).cast("string"))).otherwise("common")})
    columns = list(_SCREENED)
    plain = ascii_columns(df, columns)
    masks = {c: missing_mask(df, c, ascii_only=c in plain) for c in columns}
    mates = block_table(co_missing(df, columns, masks), columns)
    block = [r["column"] for r in mates.join(mates.where("column = 'urgent_gone'").select("block"), "block").collect()]  # one row a column
    return screen(profiles(df, columns, masks, df.count(), ascii_only=plain), "urgent_gone", block).select("column", "logical_type", "reason", "raw_levels", "retained_levels", "pooled_levels", "encoded_levels")
