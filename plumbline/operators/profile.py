"""Column profiles, types and anomalies (AG-*, OT-*, PF-9..11). Every profile is one aggregation over all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.quantiles import percentile_row, percentiles
from plumbline.functions.values import kinds, rounded, similarity
from plumbline.plans.registry import query
from plumbline.session import table

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
BINS = 10


def is_special(c: Column, codes: list) -> Column:
    """Equal to a code as trimmed text, or as a number (PF-11)."""
    if not codes:
        return F.lit(False)
    texts, numbers = [str(v).strip() for v in codes], [float(v) for v in codes if str(v).strip().lstrip("-").replace(".", "", 1).isdigit()]
    hit = F.trim(c.cast("string")).isin(texts)
    if numbers:
        hit = hit | c.cast("string").try_cast("double").isin(numbers)
    return F.coalesce(hit, F.lit(False))


def state(c: Column, codes: list) -> Column:
    """regular, missing or special:<code>; the first match wins (PF-9)."""
    out = F.when(c.isNull(), "missing")
    for code in codes:
        out = out.when(is_special(c, [code]), f"special:{code}")
    return out.otherwise("regular")


def states(df: DataFrame, column: str, codes: list) -> DataFrame:
    """Rows per state with their share; the states add up to all rows."""
    return df.groupBy(state(F.col(column), codes).alias("state")).agg(F.count("*").alias("rows")).withColumn("share", rounded(F.col("rows") / F.sum("rows").over(Window.partitionBy())))


def analysis_frame(df: DataFrame, codes: dict[str, list]) -> DataFrame:
    """Special values as null, with a 0/1 indicator column for each code (PF-10)."""
    indicators = {f"{c}__is_{str(v).replace('-', 'm').replace('.', '_')}": is_special(F.col(c), [v]).cast("int") for c, own in codes.items() for v in own}
    return df.withColumns(indicators).withColumns({c: F.when(~is_special(F.col(c), own), F.col(c)) for c, own in codes.items()})


def _stack(one: DataFrame, columns: list[str], metrics: list[str]) -> DataFrame:
    """The wide row of `<metric>__<column>` values as one row a column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{m}__{c}`").alias(m) for m in metrics]) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def distinct_counts(df: DataFrame, columns: list[str], specials: dict[str, list] | None = None) -> DataFrame:
    """(column, distinct_raw, distinct_regular): distinct values, and those that are no special value. The columns' values
    are counted in one shuffle of (column, value), each row once a column."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), is_special(F.col(c), (specials or {}).get(c, [])).alias("special")) for c in columns]
    found = df.select(F.explode(F.array(*pairs)).alias("r")).select("r.*").where("value is not null").groupBy("column", "value").agg(F.min("special").alias("special"))
    return found.groupBy("column").agg(F.count("*").alias("distinct_raw"), F.count_if(~F.col("special")).alias("distinct_regular"))


def counts(df: DataFrame, columns: list[str], specials: dict[str, list] | None = None) -> DataFrame:
    """Counts block: total, null, special, regular, effectively missing, shares to four digits, distinct (AG-1)."""
    specials, aggregates = specials or {}, []
    for c in columns:
        x, sp = F.col(c), is_special(F.col(c), specials.get(c, []))
        regular = F.when(x.isNotNull() & ~sp, x)
        aggregates += [F.count("*").alias(f"total__{c}"), F.count_if(x.isNull()).alias(f"nulls__{c}"), F.count_if(sp).alias(f"special__{c}"), F.count(regular).alias(f"regular__{c}")]
    long = _stack(df.agg(*aggregates), columns, ["total", "nulls", "special", "regular"]).join(distinct_counts(df, columns, specials), "column", "left").na.fill(0, ["distinct_raw", "distinct_regular"])
    return long.withColumn("missing_share", F.round((F.col("nulls") + F.col("special")) / F.nullif(F.col("total"), F.lit(0)), 4))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric block: parse failures, zeros, negatives, moments, percentiles (AG-2, 3, 5)."""
    typed, aggregates = kinds(df.schema), []
    parsed = {c: F.col(c).cast("double") if typed.get(c) == "number" else F.col(c).cast("string").try_cast("double") for c in columns}
    for c in columns:
        x = parsed[c]
        fine = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        flat = F.var_pop(fine) == 0
        for name, value in {
            "parse_failures": F.count_if(F.col(c).isNotNull() & x.isNull()), "finite": F.count(fine), "zeros": F.count_if(fine == 0), "negatives": F.count_if(fine < 0),
            "low": F.min(fine), "high": F.max(fine), "mean": F.avg(fine), "variance": F.var_pop(fine), "std": F.stddev_pop(fine),
            "skew": F.when(~flat, F.skewness(fine)), "kurt": F.when(~flat, F.kurtosis(fine)),
        }.items():
            aggregates.append(value.alias(f"{name}__{c}"))
    long = _stack(df.agg(*aggregates), columns, ["parse_failures", "finite", "zeros", "negatives", "low", "high", "mean", "variance", "std", "skew", "kurt"])
    ranks = percentiles(df, {c: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) for c, x in parsed.items()}, list(PERCENTILES))
    long = long.join(ranks.withColumnRenamed("q", "percentiles"), "column", "left")
    named = {f"p{int(p * 100):02d}": F.get("percentiles", F.lit(i)) for i, p in enumerate(PERCENTILES)}
    return long.withColumns(named).withColumn("iqr", F.col("p75") - F.col("p25")).drop("percentiles")


def mad(df: DataFrame, column: str) -> DataFrame:
    """Median absolute deviation, unscaled (AG-4)."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    middle = percentile_row(x, F.col("x"), [0.5])
    median = F.lit(middle[0] if middle else None).cast("double")
    return percentiles(x, {"x": F.abs(F.col("x") - median)}, [0.5]).select(median.alias("median"), F.col("q")[0].alias("mad"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last edge closed; empty bins included (AG-6)."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    found = x.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row beside each
    grid = ends.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / bins
    return grid.join(found, "bin", "left").select("bin", edge(F.col("bin")).alias("start"), edge(F.col("bin") + 1).alias("end"), F.coalesce("n", F.lit(0)).alias("n"))


def datetimes(df: DataFrame, column: str) -> DataFrame:
    """First and last moment in ISO form, parse failures and their share (AG-7)."""
    t = F.try_to_timestamp(F.col(column).cast("string"))
    failed = F.count_if(F.col(column).isNotNull() & t.isNull())
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return df.agg(F.date_format(F.min(t), iso).alias("first"), F.date_format(F.max(t), iso).alias("last"), failed.alias("failures"), (failed / F.nullif(F.count(column), F.lit(0))).alias("failure_share"))


def quarters(df: DataFrame, label: Column) -> DataFrame:
    """First and last YYYYQn label with the dates that they span (AG-8)."""
    y, q = F.regexp_extract(label, r"^(\d{4})-?Q([1-4])$", 1).try_cast("int"), F.regexp_extract(label, r"^(\d{4})-?Q([1-4])$", 2).try_cast("int")
    ends = df.agg(F.min(y * 4 + q - 1).alias("a"), F.max(y * 4 + q - 1).alias("b"))
    name = lambda c: F.concat(F.floor(F.col(c) / 4).cast("string"), F.lit("Q"), (F.col(c) % 4 + 1).cast("string"))
    day = lambda c: F.make_date(F.floor(F.col(c) / 4).cast("int"), (F.col(c) % 4 * 3 + 1).cast("int"), F.lit(1))
    return ends.select(name("a").alias("first_quarter"), name("b").alias("last_quarter"), day("a").cast("string").alias("start_date"), F.last_day(F.add_months(day("b"), 2)).cast("string").alias("end_date"))


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select("r.*").where("value is not null")


def top_values(df: DataFrame, columns: list[str], k: int = 50) -> DataFrame:
    """The k most frequent values of each column, ties by value (AG-10); all columns in one shuffle."""
    found = _values(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return found.withColumn("position", rank).where(F.col("position") <= k)


def categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mode, its count and share, distinct ratio, rows in duplicated values (AG-9)."""
    found = _values(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "value"))
    out = found.groupBy("column").agg(best.alias("b"), F.count("*").alias("distinct"), F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicated"))
    return out.select("column", F.col("b.value").alias("mode"), (-F.col("b.m")).alias("mode_count"), (-F.col("b.m") / F.col("rows")).alias("mode_share"), (F.col("distinct") / F.col("rows")).alias("distinct_ratio"), "duplicated")


def distinct_hash(df: DataFrame, columns: list[str], limit: int = 100) -> DataFrame:
    """SHA-256 of the sorted distinct values of columns with at most `limit` of them (AG-11)."""
    found = _values(df, columns).distinct().withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("k") <= limit + 1)
    out = found.groupBy("column").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("value")), "|").alias("all"))
    return out.where(F.col("n") <= limit).select("column", "n", F.sha2("all", 256).alias("hash"))


def discovery(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null rate, cardinality, candidate key (distinct >= 95 % of rows), likely foreign key (>= 50 % and a key-like name), sample deviation (AG-17)."""
    aggregates = []
    for c in columns:
        numeric_ = isinstance(df.schema[c].dataType, T.NumericType)
        x = F.col(c).cast("double") if numeric_ else F.lit(None).cast("double")
        aggregates += [F.count("*").alias(f"n__{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls__{c}"), F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}")]
    distinct = distinct_counts(df, columns).select("column", F.col("distinct_raw").alias("distinct"))
    long = _stack(df.agg(*aggregates), columns, ["n", "nulls", "mean", "std"]).join(distinct, "column", "left").na.fill(0, ["distinct"]).select("column", "n", "nulls", "distinct", "mean", "std")
    ratio, keyish = F.col("distinct") / F.nullif(F.col("n"), F.lit(0)), F.lower("column").rlike("(_id|id|key|code|_no)$")
    return long.withColumns({"null_rate": F.col("nulls") / F.nullif(F.col("n"), F.lit(0)), "candidate_key": F.coalesce(ratio >= 0.95, F.lit(False)), "likely_foreign_key": F.coalesce((ratio >= 0.5) & (ratio < 0.95) & keyish, F.lit(False))})


def segment_missing(df: DataFrame, column: str, segment: str) -> DataFrame:
    """Missing share per segment state, with worst and best marked (AG-14)."""
    seg = F.coalesce(F.col(segment).cast("string"), F.lit("(missing)"))
    per = df.groupBy(seg.alias("segment")).agg(F.count("*").alias("rows"), F.count_if(F.col(column).isNull()).alias("missing")).withColumn("share", F.col("missing") / F.col("rows"))
    ends = per.agg(F.max_by("segment", F.struct("share", "segment")).alias("_worst"), F.min_by("segment", F.struct("share", "segment")).alias("_best"))  # one row
    return per.crossJoin(F.broadcast(ends)).withColumns({"worst": F.col("_worst") == F.col("segment"), "best": F.col("_best") == F.col("segment")}).drop("_worst", "_best")


def cross_check(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with both, only a, only b populated, and their correlation (AG-15)."""
    x, y = F.col(a), F.col(b)
    return df.agg(F.count_if(x.isNotNull() & y.isNotNull()).alias("both"), F.count_if(x.isNotNull() & y.isNull()).alias("only_a"), F.count_if(x.isNull() & y.isNotNull()).alias("only_b"), F.corr(x.cast("double"), y.cast("double")).alias("correlation"))


def classify(df: DataFrame, columns: list[str]) -> DataFrame:
    """Logical type of each column from all of its rows: datetime, identifier, binary, numerical, categorical or text (OT-4), with parse rates (OT-3)."""
    aggregates = []
    for c in columns:
        s = F.trim(F.col(c).cast("string"))
        aggregates += [F.count(c).alias(f"n__{c}"), F.count_if(s.try_cast("double").isNotNull()).alias(f"nums__{c}"), F.count_if(s.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(s).isNotNull()).alias(f"dates__{c}"), F.count_if(~F.lower(s).isin("0", "1", "y", "n", "yes", "no", "true", "false")).alias(f"nonbinary__{c}")]
    texts = df.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in columns])
    different = distinct_counts(texts, columns).select("column", F.col("distinct_raw").alias("distinct"))
    long = _stack(df.agg(*aggregates), columns, ["n", "nums", "dates", "nonbinary"]).join(different, "column", "left").na.fill(0, ["distinct"])
    n, share = F.col("n"), lambda m: F.col(m) / F.nullif(F.col("n"), F.lit(0))
    kind = (
        F.when(n == 0, "text").when(share("dates") >= 0.9, "datetime").when((F.col("nonbinary") == 0) & (F.col("distinct") <= 2), "binary")
        .when((n >= 5) & (share("distinct") >= 0.98) & (F.lower("column").rlike("(id|key)$") | (share("nums") < 0.5)), "identifier")
        .when(share("nums") >= 0.5, "numerical").when(F.col("distinct") <= 30, "categorical").otherwise("text")
    )
    return long.select("column", kind.alias("logical_type"), share("nums").alias("number_rate"), share("dates").alias("date_rate"))


def role(name: Column, logical_type: Column | None = None, target: str | None = None, unique_text: Column | None = None, temporal: Column | None = None) -> Column:
    """Role of a column: the target by its own name or a target's, an identifier by type or name or because all its texts differ, a
    period or date by evidence or type (never by name alone), a score by name, else a feature (OT-6)."""
    label = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    n, kind, when = label(name), F.lower(F.trim(F.coalesce(logical_type, F.lit("")))) if logical_type is not None else F.lit(""), temporal if temporal is not None else F.lit(None).cast("string")
    own = label(F.lit(target))
    return (
        F.when((own != "") & (n == own), "Target").when(n.rlike("(^| )(target|label|outcome|default)( |$)"), "Target")
        .when((kind == "identifier") | n.endswith(" id") | (n == "id") | (unique_text if unique_text is not None else F.lit(False)), "Identifier").when(when == "period", "Period")
        .when((when == "date") | kind.isin("date", "datetime", "timestamp"), "Date").when(n.rlike("(^| )(score|rating|grade)( |$)"), "Score").otherwise("Feature")
    )


def warnings(metrics: DataFrame) -> DataFrame:
    """Ingest warnings of counts() joined with classify() (OT-5)."""
    all_null = F.col("nulls") == F.col("total")
    mixed = (F.col("number_rate") > 0.1) & (F.col("number_rate") < 0.9)
    found = F.array_compact(F.array(F.when(all_null, "all_null"), F.when(mixed, "mixed_type"), F.when(F.col("distinct_raw") == 1, "constant"), F.when(F.col("missing_share") > 0.2, "sparse")))
    return metrics.select("column", F.explode(found).alias("warning"))


def sigma_range(df: DataFrame, column: str, sigmas: float = 5.0, mostly: float = 0.999) -> DataFrame:
    """Share of values within mean +- sigmas population deviations, and whether it reaches `mostly` (OT-1)."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    m = x.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    inside = F.abs(F.col("x") - F.col("m")) <= sigmas * F.col("s")
    return x.crossJoin(F.broadcast(m)).agg(F.count("*").alias("n"), F.avg(inside.cast("int")).alias("inside")).withColumn("passed", F.col("inside") >= mostly)  # one row beside each


def iqr_outliers(df: DataFrame, column: str, times: float = 1.5) -> DataFrame:
    """Bounds, number and rate of values beyond `times` interquartile ranges (OT-2; 3 for far outliers, OT-8)."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    q = percentiles(x, {"x": F.col("x")}, [0.25, 0.75]).select((F.col("q")[0] - times * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + times * (F.col("q")[1] - F.col("q")[0])).alias("high"))
    out = (F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))
    return x.crossJoin(F.broadcast(q)).groupBy("low", "high").agg(F.count_if(out).alias("outliers"), F.avg(out.cast("int")).alias("rate"))  # one row beside each


#: Words of names of shares in 0 to 1 and 0 to 100, and parts of names of what is never negative.
UNIT_WORDS, PERCENT_WORDS = ("pd", "lgd", "prob", "probability"), ("pct", "percent", "percentage")
NOT_NEGATIVE = (
    "amount", "balance", "age", "count", "qty", "quantity", "num", "nbr", "units", "principal", "exposure", "income", "salary", "limit", "tenure", "duration", "days", "months", "years", "price", "value", "score", "weight",
    "volume", "revenue", "cost", "fee", "deposit", "loan", "ltv",
)


def far_outliers(df: DataFrame, columns: list[str], times: float = 3.0) -> DataFrame:
    """(column, far, far_share) of the values beyond `times` interquartile ranges, for all numeric columns in one pass after their
    quartiles, which are one row a column (OT-8)."""
    quartiles = {r["column"]: r.q for r in percentiles(df, {c: F.col(c) for c in columns}, [0.25, 0.75]).collect()} if columns else {}
    wide = {c: q for c, q in quartiles.items() if q[1] > q[0]}
    if not wide:
        return df.sparkSession.createDataFrame([], "column string, far bigint, far_share double")
    each = []
    for c, (low, high) in wide.items():
        x = F.col(c).cast("double")
        far = (x < low - times * (high - low)) | (x > high + times * (high - low))
        each.append(F.struct(F.lit(c).alias("column"), F.count_if(far).alias("far"), F.avg(far.cast("int")).alias("far_share")))
    return df.agg(F.array(*each).alias("r")).select(F.inline("r"))


def anomalies(metrics: DataFrame) -> DataFrame:
    """Flags of numeric() joined with counts() and far_outliers(), most severe first: the worst tier of nulls, one value only, a
    range that the name rules out (one finding a column), and far outliers with their number and share (OT-8, OT-9)."""
    name = F.lower("column")
    parts = F.split(name, "[^a-z0-9]+")
    has = lambda some: F.arrays_overlap(parts, F.array(*map(F.lit, some)))
    share = F.col("nulls") / F.nullif(F.col("total"), F.lit(0))
    low, high = F.col("low"), F.col("high")
    unit, percent = has(UNIT_WORDS), has(PERCENT_WORDS) & ~has(UNIT_WORDS)
    ranged = (unit & ((low < 0) | (high > 1))) | (percent & ((low < 0) | (high > 100)))
    flags = {
        "null_critical": (3, share >= 1), "null_high": (2, (share >= 0.5) & (share < 1)), "null_elevated": (1, (share > 0.2) & (share < 0.5)), "constant_value": (2, F.col("distinct_raw") == 1), "range_violation": (3, ranged),
        "negative_values": (2, ~ranged & (low < 0) & name.rlike("|".join(NOT_NEGATIVE))), "extreme_outliers": (1, F.col("far") > 0),
    }
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("flag"))) for n, (s, c) in flags.items()]))
    long = metrics.select("column", "far", "far_share", F.explode(found).alias("f"))
    shown = {c: F.when(F.col("f.flag") == "extreme_outliers", F.col(c)) for c in ("far", "far_share")}
    return long.select("column", "f.severity", "f.flag", *(v.alias(k) for k, v in shown.items())).withColumn("position", F.row_number().over(Window.partitionBy().orderBy(F.desc("severity"), "column", "flag")))  # columns x flags rows


def mostly_null(metrics: DataFrame) -> DataFrame:
    """One row: the columns of a table that are null in more than half of the rows, in the order of names (OT-8)."""
    return metrics.agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("nulls") > 0.5 * F.col("total"), F.col("column")))), ", ").alias("high_null_columns"))


def schema_drift(old: DataFrame, new: DataFrame, floor: float = 0.8) -> DataFrame:
    """Added, removed, retyped and likely renamed columns of two catalogues (column, dtype, position) (OT-7, PF-7)."""
    a, b = old.select("column", F.col("dtype").alias("old_type"), F.col("position").alias("old_at")), new.select("column", F.col("dtype").alias("new_type"), F.col("position").alias("new_at"))
    both = a.join(b, "column", "full_outer")
    status = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "retyped").when(F.col("old_at") != F.col("new_at"), "reordered").otherwise("same")
    both = both.withColumn("status", status)
    gone, come = both.where("status = 'removed'").select(F.col("column").alias("was"), "old_type"), both.where("status = 'added'").select(F.col("column").alias("now"), "new_type")
    pairs = gone.join(come, F.col("old_type") == F.col("new_type")).withColumn("likeness", similarity(F.col("was"), F.col("now"))).where(F.col("likeness") >= floor)
    return both.join(pairs.groupBy(F.col("was").alias("column")).agg(F.max_by("now", F.struct("likeness", "now")).alias("renamed_to")), "column", "left").select("column", "old_type", "new_type", "status", "renamed_to")


def catalogue(df: DataFrame, name: str) -> DataFrame:
    """(table, column, dtype, position) of a DataFrame."""
    return df.sparkSession.createDataFrame([(name, f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema)], "table string, column string, dtype string, position int")


def live_catalogue(df: DataFrame, name: str) -> DataFrame:
    """The catalogue with the number of populated rows and distinct values of each column; columns that are null in every
    row are left out. One scan."""
    found = counts(df, df.columns).select("column", (F.col("total") - F.col("nulls")).alias("populated"), F.col("distinct_raw").alias("distinct"))
    return catalogue(df, name).join(found, "column").where("populated > 0")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns and row count of each table (IO-5, IO-7, AG-18)."""
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).withColumns({"table": F.lit(n), "columns": F.lit(len(df.columns)).cast("long")}) for n, df in tables.items()])
    return rows.select("table", "rows", "columns")


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(columns, template):
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query("profile_counts", _each(["l_quantity", "l_discount", "l_returnflag"], """SELECT '{c}' AS "column", count(*) AS total, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {c}::VARCHAR IN ('N') OR TRY_CAST({c}::VARCHAR AS DOUBLE) = 1) AS special,
 count(*) FILTER (WHERE NOT ({c}::VARCHAR IN ('N') OR coalesce(TRY_CAST({c}::VARCHAR AS DOUBLE) = 1, false))) AS regular, count(DISTINCT {c}) AS distinct_raw,
 count(DISTINCT CASE WHEN NOT ({c}::VARCHAR IN ('N') OR coalesce(TRY_CAST({c}::VARCHAR AS DOUBLE) = 1, false)) THEN {c} END) AS distinct_regular,
 round(count(*) FILTER (WHERE {c} IS NULL OR {c}::VARCHAR IN ('N') OR TRY_CAST({c}::VARCHAR AS DOUBLE) = 1) / count(*), 4) AS missing_share FROM lineitem"""))
def profile_counts(spark, sf_dir):
    cols = ["l_quantity", "l_discount", "l_returnflag"]
    return counts(table(spark, sf_dir, "lineitem"), cols, {c: ["N", 1] for c in cols})


_NUM = _each(LINE_NUMBERS, """SELECT '{c}' AS "column", 0 AS parse_failures, count({c}) AS finite, count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives, min({c}) AS low, max({c}) AS high,
 round(avg({c}), 6) AS mean, round(var_pop({c}), 4) AS variance, round(stddev_pop({c}), 6) AS std, round(avg(power(({c} - m) / s, 3)), 6) AS skew, round(avg(power(({c} - m) / s, 4)) - 3, 6) AS kurt,
 quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99,
 quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem)""")
_ROUND_NUM = ", ".join(f"round({c}, 4) AS {c}" for c in "p01 p05 p25 p50 p75 p95 p99 iqr".split())


@query("profile_numeric", f"""SELECT "column", parse_failures, finite, zeros, negatives, low, high, mean, variance, std, skew, kurt, {_ROUND_NUM} FROM ({_NUM})""")
def profile_numeric(spark, sf_dir):
    df = numeric(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    digits = {c: 6 for c in "mean std skew kurt".split()} | {"variance": 4} | {c: 4 for c in "p01 p05 p25 p50 p75 p95 p99 iqr".split()}
    return df.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


@query("profile_mad", "SELECT m AS median, round(median(abs(o_totalprice - m)), 4) AS mad FROM orders, (SELECT median(o_totalprice) AS m FROM orders) GROUP BY m")
def profile_mad(spark, sf_dir):
    return mad(table(spark, sf_dir, "orders"), "o_totalprice").withColumn("mad", rounded(F.col("mad"), 4))


@query("profile_histogram", """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
 c AS (SELECT least(floor((o_totalprice - lo) / (hi - lo) * 10), 9)::INT AS bin, count(*) AS n FROM orders, e GROUP BY 1)
 SELECT g.bin::INT AS bin, round(lo + (hi - lo) * g.bin / 10, 4) AS start, round(lo + (hi - lo) * (g.bin + 1) / 10, 4) AS "end", coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) g, e LEFT JOIN c ON c.bin = g.bin""")
def profile_histogram(spark, sf_dir):
    return histogram(table(spark, sf_dir, "orders"), "o_totalprice").withColumns({"start": rounded(F.col("start"), 4), "end": rounded(F.col("end"), 4)})


@query("profile_datetimes", "SELECT strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%S') AS first, strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S') AS last, 0 AS failures, 0.0 AS failure_share FROM lineitem")
def profile_datetimes(spark, sf_dir):
    return datetimes(table(spark, sf_dir, "lineitem"), "l_shipdate")


@query("profile_quarters", """WITH o AS (SELECT min(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS a, max(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS b FROM orders)
 SELECT (a // 4) || 'Q' || (a % 4 + 1) AS first_quarter, (b // 4) || 'Q' || (b % 4 + 1) AS last_quarter, make_date(a // 4, a % 4 * 3 + 1, 1)::VARCHAR AS start_date, last_day(make_date(b // 4, b % 4 * 3 + 3, 1))::VARCHAR AS end_date FROM o""")
def profile_quarters(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return quarters(df, F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string")))


_TOP = ["o_orderpriority", "o_orderstatus"]
_VALS = _each(_TOP, """SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY ALL""")


@query("profile_top_values", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INT AS position FROM ({_VALS})) WHERE position <= 3""")
def profile_top_values(spark, sf_dir):
    return top_values(table(spark, sf_dir, "orders"), _TOP, 3)


@query("profile_categorical", f"""SELECT "column", arg_min(value, (-n, value)) AS mode, max(n) AS mode_count, round(max(n) / sum(n), 6) AS mode_share, round(count(*) / sum(n), 6) AS distinct_ratio, (sum(n) FILTER (WHERE n > 1))::BIGINT AS duplicated FROM ({_VALS}) GROUP BY 1""")
def profile_categorical(spark, sf_dir):
    return categorical(table(spark, sf_dir, "orders"), _TOP).withColumns({"mode_share": rounded(F.col("mode_share")), "distinct_ratio": rounded(F.col("distinct_ratio"))})


@query("profile_distinct_hash", f"""SELECT "column", count(*) AS n, sha256(string_agg(value, '|' ORDER BY value)) AS hash FROM ({_VALS}) GROUP BY 1 HAVING count(*) <= 100""")
def profile_distinct_hash(spark, sf_dir):
    return distinct_hash(table(spark, sf_dir, "orders"), _TOP)


_DISC = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("profile_discovery", _each(_DISC, """SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS "distinct", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_rate, count(DISTINCT {c}) / count(*) >= 0.95 AS candidate_key, count(DISTINCT {c}) / count(*) BETWEEN 0.5 AND 0.9499999 AND regexp_matches('{c}', '(_id|id|key|code|_no)$') AS likely_foreign_key FROM orders"""))
def profile_discovery(spark, sf_dir):
    return discovery(table(spark, sf_dir, "orders"), _DISC).withColumns({"mean": rounded(F.col("mean"), 4), "std": rounded(F.col("std"), 4)})


@query("profile_states", """SELECT CASE WHEN o_orderpriority IS NULL THEN 'missing' WHEN o_orderpriority = '5-LOW' THEN 'special:5-LOW' ELSE 'regular' END AS state, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1""")
def profile_states(spark, sf_dir):
    return states(table(spark, sf_dir, "orders"), "o_orderpriority", ["5-LOW"])


@query("profile_analysis_frame", """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS l_tax, (l_tax = 0)::INT AS l_tax__is_0 FROM lineitem""")
def profile_analysis_frame(spark, sf_dir):
    return analysis_frame(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), {"l_tax": [0]})


@query("profile_segment_missing", """WITH p AS (SELECT coalesce(d.lang, '(missing)') AS segment, count(*) AS rows, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
 SELECT segment, rows, missing, round(missing / rows, 6) AS share, segment = (SELECT arg_max(segment, (missing / rows, segment)) FROM p) AS worst, segment = (SELECT arg_min(segment, (missing / rows, segment)) FROM p) AS best FROM p""")
def profile_segment_missing(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return segment_missing(df, "toxic", "lang").withColumn("share", rounded(F.col("share")))


@query("profile_cross_check", """SELECT count(*) FILTER (WHERE toxic IS NOT NULL AND n_chars IS NOT NULL) AS "both", count(*) FILTER (WHERE toxic IS NOT NULL AND n_chars IS NULL) AS only_a, count(*) FILTER (WHERE toxic IS NULL AND n_chars IS NOT NULL) AS only_b,
 round(corr(toxic, n_chars), 6) AS correlation FROM documents LEFT JOIN labels USING (doc_id)""")
def profile_cross_check(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return cross_check(df, "toxic", "n_chars").withColumn("correlation", rounded(F.col("correlation")))


_TYPED = ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"]


def _texts(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS c, trim({c}::VARCHAR) AS t FROM {source}" for c in columns)


@query("profile_classify", f"""WITH l AS ({_texts(_TYPED, "orders")}), m AS (SELECT c, count(t) AS n, count(try_cast(t AS DOUBLE)) / nullif(count(t), 0) AS nums, count(*) FILTER (WHERE regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(t AS TIMESTAMP) IS NOT NULL) / nullif(count(t), 0) AS dates,
 count(DISTINCT t) AS k, count(*) FILTER (WHERE lower(t) NOT IN ('0', '1', 'y', 'n', 'yes', 'no', 'true', 'false')) AS other FROM l GROUP BY c)
 SELECT c AS "column", CASE WHEN n = 0 THEN 'text' WHEN dates >= 0.9 THEN 'datetime' WHEN other = 0 AND k <= 2 THEN 'binary' WHEN n >= 5 AND k / n >= 0.98 AND (regexp_matches(c, '(id|key)$') OR nums < 0.5) THEN 'identifier'
 WHEN nums >= 0.5 THEN 'numerical' WHEN k <= 30 THEN 'categorical' ELSE 'text' END AS logical_type, nums AS number_rate, dates AS date_rate FROM m""")
def profile_classify(spark, sf_dir):
    return classify(table(spark, sf_dir, "orders"), _TYPED)


@query("profile_sigma_range", "SELECT count(*) AS n, avg((abs(value - m) <= 5 * s)::INT) AS inside, avg((abs(value - m) <= 5 * s)::INT) >= 0.999 AS passed FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE value IS NOT NULL")
def profile_sigma_range(spark, sf_dir):
    return sigma_range(table(spark, sf_dir, "events"), "value")


@query("profile_iqr_outliers", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
 SELECT round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high, count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers, round(avg((value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INT), 6) AS rate FROM events, q WHERE value IS NOT NULL GROUP BY a, b""")
def profile_iqr_outliers(spark, sf_dir):
    return iqr_outliers(table(spark, sf_dir, "events"), "value").withColumns({"low": rounded(F.col("low"), 4), "high": rounded(F.col("high"), 4), "rate": rounded(F.col("rate"))})


_STAINED = {
    "o_totalprice": "o_totalprice", "currency": "'EUR'", "late_rate": "o_totalprice / 100000", "net_price": "o_totalprice - 2000",
    "open_price": "CASE WHEN o_orderstatus = 'O' THEN o_totalprice END", "known_price": "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END", "mixed": "CASE WHEN o_orderstatus = 'F' THEN '12' ELSE 'x' END",
}
_STAINS = f"""WITH d AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _STAINED.items())} FROM orders), l AS ({_texts(list(_STAINED), "d")}),
 m AS (SELECT c, count(*) AS n, (count(*) - count(t)) / count(*) AS gone, count(DISTINCT t) AS k, min(try_cast(t AS DOUBLE)) AS low, max(try_cast(t AS DOUBLE)) AS high, count(try_cast(t AS DOUBLE)) / nullif(count(t), 0) AS nums FROM l GROUP BY c)"""


def stained_orders(spark, sf_dir) -> DataFrame:
    """All orders under columns with the defects that flags and warnings are about."""
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _STAINED.items()])


_FLAGGED = {
    "whole_pd": "o_totalprice", "share_pct": "o_totalprice / 1000", "fine_prob": "CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 0.25 END", "net_price": "o_totalprice - 200000", "far_one": "CASE WHEN o_orderkey % 1000 = 1 THEN 5000000 ELSE o_totalprice END",
    "none": "CAST(NULL AS DOUBLE)", "mostly": "CASE WHEN o_orderstatus = 'P' THEN o_totalprice END", "third": "CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END", "same_value": "7",
}


@query("profile_anomalies", f"""WITH d AS (SELECT {', '.join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _FLAGGED.items())} FROM orders), l AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, {c} AS x FROM d" for c in _FLAGGED)}),
 q AS (SELECT c, quantile_cont(x, [0.25, 0.75]) AS q FROM l GROUP BY 1), m AS (SELECT l.c, count(*) AS n, (count(*) - count(x)) / count(*) AS gone, count(DISTINCT x) AS k, min(x) AS low, max(x) AS high,
  count(*) FILTER (WHERE q[2] > q[1] AND (x < q[1] - 3 * (q[2] - q[1]) OR x > q[2] + 3 * (q[2] - q[1]))) AS far, count(x) AS there FROM l JOIN q ON q.c = l.c GROUP BY l.c),
 r AS (SELECT *, (regexp_matches(c, '(^|_)(pd|lgd|prob|probability)(_|$)') AND (low < 0 OR high > 1)) OR (regexp_matches(c, '(^|_)(pct|percent|percentage)(_|$)') AND (low < 0 OR high > 100)) AS ranged FROM m),
 f AS (SELECT c, 3 AS severity, 'null_critical' AS flag, NULL AS far, NULL AS far_share FROM r WHERE gone = 1 UNION ALL SELECT c, 2, 'null_high', NULL, NULL FROM r WHERE gone >= 0.5 AND gone < 1 UNION ALL SELECT c, 1, 'null_elevated', NULL, NULL FROM r WHERE gone > 0.2 AND gone < 0.5 UNION ALL SELECT c, 2, 'constant_value', NULL, NULL FROM r WHERE k = 1
  UNION ALL SELECT c, 3, 'range_violation', NULL, NULL FROM r WHERE ranged UNION ALL SELECT c, 2, 'negative_values', NULL, NULL FROM r WHERE coalesce(NOT ranged, true) AND low < 0 AND regexp_matches(c, '{"|".join(NOT_NEGATIVE)}') UNION ALL SELECT c, 1, 'extreme_outliers', far, far / there FROM r WHERE far > 0)
 SELECT c AS "column", severity, flag, far, round(far_share, 6) AS far_share, row_number() OVER (ORDER BY severity DESC, c, flag)::INT AS position FROM f""")
def profile_anomalies(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in _FLAGGED.items()])
    metrics = counts(df, df.columns).join(numeric(df, df.columns).select("column", "low", "high"), "column").join(far_outliers(df, df.columns), "column", "left")
    return anomalies(metrics).withColumn("far_share", rounded(F.col("far_share")))


@query("profile_mostly_null", """SELECT array_to_string(list_sort(list_filter([CASE WHEN count(*) > 0 THEN 'none' END, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') < 0.5 * count(*) THEN 'mostly' END, CASE WHEN count(*) FILTER (WHERE o_orderkey % 4 = 0) > 0.5 * count(*) THEN 'third' END], lambda x: x IS NOT NULL)), ', ') AS high_null_columns FROM orders""")
def profile_mostly_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _FLAGGED.items()])
    return mostly_null(counts(df, df.columns))


@query("profile_roles", """WITH c AS (SELECT column_name AS c, data_type AS t, trim(regexp_replace(lower(column_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM duckdb_columns() WHERE table_name IN ('labels', 'documents', 'events')), k AS (SELECT count(DISTINCT props) = count(*) AS u FROM events)
 SELECT DISTINCT c AS "column", CASE WHEN n = 'quality' THEN 'Target' WHEN regexp_matches(n, '(^| )(target|label|outcome|default)( |$)') THEN 'Target' WHEN n LIKE '% id' OR n = 'id' THEN 'Identifier' WHEN t LIKE 'TIMESTAMP%' THEN 'Date' WHEN regexp_matches(n, '(^| )(score|rating|grade)( |$)') THEN 'Score' ELSE 'Feature' END AS role FROM c""")
def profile_roles(spark, sf_dir):
    """Columns of three tables with their types of storage; one is named as the target."""
    found = [catalogue(table(spark, sf_dir, t), t) for t in ("labels", "documents", "events")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("column", role(F.col("column"), F.col("dtype").substr(1, 9), "quality").alias("role")).distinct()


@query("profile_warnings", f"""{_STAINS} SELECT c AS "column", 'all_null' AS warning FROM m WHERE gone = 1 UNION ALL SELECT c, 'mixed_type' FROM m WHERE nums > 0.1 AND nums < 0.9 UNION ALL SELECT c, 'constant' FROM m WHERE k = 1 UNION ALL SELECT c, 'sparse' FROM m WHERE gone > 0.2""")
def profile_warnings(spark, sf_dir):
    df = stained_orders(spark, sf_dir)
    return warnings(counts(df, df.columns).join(classify(df, df.columns), "column"))


@query("source_inventory", " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS rows, {n} AS columns FROM {t}""" for t, n in (("orders", 6), ("lineitem", 11), ("customer", 5), ("events", 6))))
def source_inventory(spark, sf_dir):
    return inventory({t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "events")})


@query("source_schema_drift", """WITH o AS (SELECT column_name AS "column", lower(data_type) AS t, column_index - 1 AS p FROM duckdb_columns() WHERE table_name = 'documents' AND column_name <> 'n_chars'),
 n AS (SELECT CASE column_name WHEN 'source' THEN 'source_' ELSE column_name END AS "column", lower(data_type) AS t, column_index - 1 AS p FROM duckdb_columns() WHERE table_name = 'documents'),
 b AS (SELECT coalesce(o."column", n."column") AS "column", o.t AS a, n.t AS b FROM o FULL JOIN n ON o."column" = n."column")
 SELECT "column", CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a <> b THEN 'retyped' ELSE 'same' END AS status, CASE WHEN "column" = 'source' THEN 'source_' END AS renamed_to FROM b""")
def source_schema_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return schema_drift(live_catalogue(d.drop("n_chars"), "documents"), live_catalogue(d.withColumnRenamed("source", "source_"), "documents")).select("column", "status", "renamed_to")
