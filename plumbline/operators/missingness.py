"""Missingness: rates, declared codes, co-missing blocks and breaks (CM-1 to CM-6, CM-35), and attribution (DV-7)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.quantiles import percentile_row
from plumbline.functions.values import is_ascii, missing, normal_text, rounded
from plumbline.operators.profile import is_special
from plumbline.plans.registry import query
from plumbline.session import materialise, table

#: Tolerated missing share, likeness of columns of one block, share on either side of a break.
TOLERANCE, JACCARD, EXTREME = 0.01, 0.95, 0.95


def parse_codes(cell) -> list[str]:
    """The codes of one dictionary cell: comma-separated, blanks left out (CM-4)."""
    return [] if cell is None else [p.strip() for p in str(cell).split(",") if p.strip()]


def dictionary_codes(dictionary: DataFrame, name: str = "column_name", codes: str = "missing_codes") -> dict[str, list[str]]:
    """Codes by column of a dictionary table, which has one row a column of the data (CM-4)."""
    return {r[0]: parse_codes(r[1]) for r in dictionary.select(name, codes).collect() if parse_codes(r[1])}


def ascii_columns(df: DataFrame, columns: list[str]) -> set[str]:
    """Those of the columns that hold texts, none of them beyond ASCII; one aggregation over all rows."""
    texts = [c for c in dict.fromkeys(columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return set()
    beyond = df.agg(*[F.count_if(~is_ascii(F.col(c))).alias(f"b{i}") for i, c in enumerate(texts)]).first()
    return {c for i, c in enumerate(texts) if not beyond[i]}


def missing_parts(df: DataFrame, column: str, codes: list | None = None, ascii_only: bool = False) -> tuple[Column, Column, Column]:
    """Whether a row's value is null (or not a number), blank, or a declared code, never two of them. Texts and codes are
    compared in their compatibility form, so a no-break space is blank and full-width letters match; numbers by value (CM-4)."""
    x, codes = F.col(column), codes or []
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        text = normal_text(x, ascii_only)
        known = [unicodedata.normalize("NFKC", str(v)).strip() for v in codes]
        return x.isNull(), x.isNotNull() & text.isNull(), F.coalesce(text.isin(known), F.lit(False)) if known else F.lit(False)
    null = x.isNull() | (F.isnan(x) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False))
    return null, F.lit(False), is_special(x, codes)


def missing_mask(df: DataFrame, column: str, codes: list | None = None, ascii_only: bool = False) -> Column:
    null, blank, coded = missing_parts(df, column, codes, ascii_only)
    return null | blank | coded


def rates(df: DataFrame, columns: list[str], codes: dict[str, list] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Null, blank and coded values of every column in one pass, with the tolerance's verdict and whether a not-null
    expectation holds (CM-1, 4, 35, 39)."""
    codes, aggregates = codes or {}, [F.count("*").alias("_n")]
    for c in columns:
        aggregates += [F.count_if(part).alias(f"{k}_{c}") for k, part in zip("nbc", missing_parts(df, c, codes.get(c)))]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"b_{c}").alias("blanks"), F.col(f"c_{c}").alias("coded")) for c in columns])
    long = df.agg(*aggregates).select("_n", F.explode(rows).alias("r")).select("_n", "r.*")
    rate = (F.col("nulls") + F.col("blanks") + F.col("coded")) / F.nullif(F.col("_n"), F.lit(0))
    return long.withColumns({"rate": rate, "passed": rate <= tolerance, "not_null": F.col("nulls") == 0}).drop("_n")


def change(windowed: DataFrame, column: str) -> DataFrame:
    """Missing rate early and recent (CM-2)."""
    null, early = F.col(column).isNull().cast("int"), F.col("window") == "early"
    one = windowed.agg(F.avg(F.when(early, null)).alias("early"), F.avg(F.when(~early, null)).alias("recent"))
    return one.withColumn("change", F.col("recent") - F.col("early"))


def cross_tab(populated: DataFrame, column: str, segment: str, codes: list) -> DataFrame:
    """Physical, declared and effective missing counts by population and segment (CM-3)."""
    x = F.col(column)
    special = is_special(x, codes)
    return populated.where("population is not null").groupBy("population", F.coalesce(F.col(segment).cast("string"), F.lit("(missing)")).alias("segment")).agg(F.count("*").alias("rows"), F.count_if(x.isNull()).alias("physical"), F.count_if(special).alias("declared"), F.count_if(x.isNull() | special).alias("effective"))


def co_missing(df: DataFrame, columns: list[str], masks: dict[str, Column] | None = None) -> DataFrame:
    """Jaccard of the missing rows of every pair of columns, one aggregation over the rows (CM-5)."""
    mask = masks or {c: missing(F.col(c)) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.count_if(m).alias(f"m_{c}") for c, m in mask.items()], *[F.count_if(mask[a] & mask[b]).alias(f"p_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p_{i}").alias("both"), (F.col(f"m_{a}") + F.col(f"m_{b}") - F.col(f"p_{i}")).alias("either")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")))


def blocks(pairs: DataFrame, floor: float = JACCARD) -> list[set[str]]:
    """Columns joined over pairs of a Jaccard of at least `floor`: a graph of columns, not rows (CM-5)."""
    found: list[set[str]] = []
    for r in pairs.where(F.col("jaccard") >= floor).select("a", "b").collect():
        touching = [b for b in found if b & {r.a, r.b}]
        found = [b for b in found if b not in touching] + [set().union({r.a, r.b}, *touching)]
    return sorted(found, key=min)


def block_table(pairs: DataFrame, columns: list[str], floor: float = JACCARD) -> DataFrame:
    """(column, block, size) of every column; block numbers follow the columns' order, and a column without mates is alone (CM-5)."""
    found = blocks(pairs, floor)
    own = {c: next((b for b in found if c in b), {c}) for c in columns}
    number = {}
    for c in columns:
        number.setdefault(frozenset(own[c]), f"B{len(number) + 1:03d}")
    return pairs.sparkSession.createDataFrame([(c, number[frozenset(own[c])], len(own[c])) for c in columns], "column string, block string, size int")


def structural_breaks(df: DataFrame, masks: dict[str, Column], period: Column, extreme: float = EXTREME) -> DataFrame:
    """(column, period, before, after): for each column the first period before which at least `extreme` of the rows lack it
    and from which on at most the rest, or the other way round. Rows without a period take no part, and periods are ordered as
    texts; all columns share one aggregation (CM-6)."""
    per = df.groupBy(period.cast("string").alias("period")).agg(F.count("*").alias("n"), *[F.count_if(m).alias(f"m_{c}") for c, m in masks.items()]).where("period is not null")
    long = per.select("period", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("m")) for c in masks])).alias("r")).select("period", "n", "r.*")
    order = Window.partitionBy("column").orderBy("period")  # one row a period
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    cut = long.select("column", "period", (F.sum("m").over(before) / F.sum("n").over(before)).alias("before"), (F.sum("m").over(after) / F.sum("n").over(after)).alias("after"))
    flipped = ((F.col("before") >= extreme) & (F.col("after") <= 1 - extreme)) | ((F.col("after") >= extreme) & (F.col("before") <= 1 - extreme))
    return cut.where(flipped).groupBy("column").agg(F.min_by(F.struct("period", "before", "after"), "period").alias("r")).select("column", "r.*")


def attribution(populated: DataFrame, symptom: Column, segment: Column) -> DataFrame:
    """Share of a symptom's movement between the populations that rows in and out of a segment make up (DV-7)."""
    per = populated.where("population is not null").groupBy(segment.alias("segment")).agg(F.count_if(F.col("population") == "baseline").alias("bn"), F.count_if(F.col("population") == "current").alias("cn"), F.count_if((F.col("population") == "baseline") & symptom).alias("bs"), F.count_if((F.col("population") == "current") & symptom).alias("cs"))
    per = materialise(per, "segments")  # one row a segment, and these may be many
    whole = per.agg(F.sum("cn").alias("_cn"), F.sum("bn").alias("_bn"))
    out = per.crossJoin(F.broadcast(whole)).select("segment", (F.col("cs") / F.col("_cn") - F.col("bs") / F.col("_bn")).alias("movement"))
    total = out.agg(F.sum("movement").alias("_total"))
    return out.crossJoin(F.broadcast(total)).select("segment", "movement", (F.col("movement") / F.nullif(F.col("_total"), F.lit(0.0))).alias("share"))


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("missing_rates", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE trim({c}::VARCHAR) = '') AS blanks, count(*) FILTER (WHERE {c}::VARCHAR = 'es') AS coded, round(avg(({c} IS NULL OR {c}::VARCHAR = 'es')::INT), 6) AS rate, avg(({c} IS NULL OR {c}::VARCHAR = 'es')::INT) <= 0.01 AS passed, count(*) FILTER (WHERE {c} IS NULL) = 0 AS not_null FROM documents LEFT JOIN labels USING (doc_id)""" for c in ("lang", "toxic", "quality")))
def missing_rates(spark, sf_dir):
    return rates(labelled(spark, sf_dir), ["lang", "toxic", "quality"], {"lang": ["es"]}).withColumn("rate", rounded(F.col("rate")))


@query("missing_change", """WITH j AS (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), m AS (SELECT avg((toxic IS NULL)::INT) FILTER (WHERE doc_id < (SELECT median(doc_id) FROM documents)) AS e, avg((toxic IS NULL)::INT) FILTER (WHERE doc_id >= (SELECT median(doc_id) FROM documents)) AS r FROM j)
 SELECT round(e, 6) AS early, round(r, 6) AS recent, round(r - e, 6) AS change FROM m""")
def missing_change(spark, sf_dir):
    df = labelled(spark, sf_dir)
    middle = percentile_row(df, F.col("doc_id"), [0.5])[0]
    out = change(df.withColumn("window", F.when(F.col("doc_id") < middle, "early").otherwise("recent")), "toxic")
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query("missing_cross_tab", """SELECT CASE WHEN n_chars < 1000 THEN 'baseline' ELSE 'current' END AS population, lang AS segment, count(*) AS rows, count(*) FILTER (WHERE toxic IS NULL) AS physical, count(*) FILTER (WHERE toxic = 1) AS declared, count(*) FILTER (WHERE toxic IS NULL OR toxic = 1) AS effective FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def missing_cross_tab(spark, sf_dir):
    from plumbline.operators.population import split

    return cross_tab(split(labelled(spark, sf_dir), "n_chars", {"operator": "<", "value": 1000}), "toxic", "lang", [1])


@query("missing_co_missing", """SELECT 'quality' AS a, 'toxic' AS b, count(*) FILTER (WHERE quality IS NULL AND toxic IS NULL) AS "both", count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL) AS either, 1.0 AS jaccard FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT 'quality', 'lang', 0, count(*) FILTER (WHERE quality IS NULL), 0.0 FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', 'lang', 0, count(*) FILTER (WHERE toxic IS NULL), 0.0 FROM documents LEFT JOIN labels USING (doc_id)""")
def missing_co_missing(spark, sf_dir):
    return co_missing(labelled(spark, sf_dir), ["quality", "toxic", "lang"])


@query("drivers_attribution", """WITH p AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'baseline' ELSE 'current' END AS p, o_totalprice > 300000 AS s, o_orderpriority AS segment FROM orders),
 g AS (SELECT segment, count(*) FILTER (WHERE p = 'baseline') AS bn, count(*) FILTER (WHERE p = 'current') AS cn, count(*) FILTER (WHERE p = 'baseline' AND s) AS bs, count(*) FILTER (WHERE p = 'current' AND s) AS cs FROM p GROUP BY 1), m AS (SELECT segment, cs / sum(cn) OVER () - bs / sum(bn) OVER () AS m FROM g)
 SELECT segment, round(m, 6) AS movement, round(m / sum(m) OVER (), 4) AS share FROM m""")
def drivers_attribution(spark, sf_dir):
    from plumbline.operators.population import split

    df = split(table(spark, sf_dir, "orders"), "o_orderdate", {"operator": "<", "value": "1998-01-01 00:00:00"})
    out = attribution(df, F.col("o_totalprice") > 300000, F.col("o_orderpriority"))
    return out.select("segment", rounded(F.col("movement")).alias("movement"), rounded(F.col("share"), 4).alias("share"))


@query("missing_break", """WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, count(*) FILTER (WHERE NOT (o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderkey % 40 = 0)) AS late, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-06-01') AS ended, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey % 5 <> 0) AS partly FROM orders GROUP BY 1),
 l AS (UNPIVOT p ON late, ended, partly INTO NAME "column" VALUE m), w AS (SELECT "column", period, sum(m) OVER b / sum(n) OVER b AS before, sum(m) OVER a / sum(n) OVER a AS after FROM l
  WINDOW b AS (PARTITION BY "column" ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY "column" ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT "column", period, round(before, 6) AS before, round(after, 6) AS after FROM w WHERE (before >= 0.95 AND after <= 0.05) OR (after >= 0.95 AND before <= 0.05) QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY period) = 1""")
def missing_break(spark, sf_dir):
    """Columns recorded (but for a few) from 1998 on, recorded until the middle of 1997, and mostly missing before 1998."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    later = day >= F.lit("1998-01-01").cast("timestamp")
    masks = {"late": ~(later | (key % 40 == 0)), "ended": day >= F.lit("1997-06-01").cast("timestamp"), "partly": ~later & (key % 5 != 0)}
    found = structural_breaks(table(spark, sf_dir, "orders"), masks, F.date_format("o_orderdate", "yyyy-MM"))
    return found.select("column", "period", rounded(F.col("before")).alias("before"), rounded(F.col("after")).alias("after"))


@query("missing_codes", """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN chr(160) || ' ' WHEN 1 THEN chr(65326) || chr(65313) WHEN 2 THEN ' NA ' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'kept' END AS note, CASE WHEN o_custkey % 7 = 0 THEN -999 ELSE o_custkey END AS cust FROM orders)
 SELECT 'note' AS "column", count(*) FILTER (WHERE note IS NULL) AS nulls, count(*) FILTER (WHERE trim(replace(note, chr(160), ' ')) = '') AS blanks, count(*) FILTER (WHERE trim(note) IN ('NA', chr(65326) || chr(65313))) AS coded, round(avg((note IS DISTINCT FROM 'kept')::INT), 6) AS rate, false AS passed, count(*) FILTER (WHERE note IS NULL) = 0 AS not_null FROM r
 UNION ALL SELECT 'cust', 0, 0, count(*) FILTER (WHERE cust = -999), round(avg((cust = -999)::INT), 6), avg((cust = -999)::INT) <= 0.01, true FROM r""")
def missing_codes(spark, sf_dir):
    """No-break spaces and full-width letters, with the codes of a dictionary table."""
    key = F.col("o_orderkey")
    note = F.when(key % 6 == 0, "\u00a0 ").when(key % 6 == 1, "\uff2e\uff21").when(key % 6 == 2, " NA ").when(key % 6 == 4, "").when(key % 6 == 5, "kept")
    df = table(spark, sf_dir, "orders").select(note.alias("note"), F.when(F.col("o_custkey") % 7 == 0, -999).otherwise(F.col("o_custkey")).alias("cust"))
    dictionary = spark.createDataFrame([("note", "NA, ?"), ("cust", "-999"), ("other", None)], "column_name string, missing_codes string")
    return rates(df, ["note", "cust"], dictionary_codes(dictionary)).withColumn("rate", rounded(F.col("rate")))


@query("missing_blocks", """WITH j AS (SELECT quality, toxic, quality AS again, lang FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT avg((quality IS NULL AND toxic IS NULL)::INT) / nullif(avg((quality IS NULL OR toxic IS NULL)::INT), 0) AS qt FROM j)
 SELECT unnest(['quality', 'toxic', 'again', 'lang']) AS "column", unnest(CASE WHEN qt >= 0.95 THEN ['B001', 'B001', 'B001', 'B002'] ELSE ['B001', 'B002', 'B001', 'B003'] END) AS block, unnest(CASE WHEN qt >= 0.95 THEN [3, 3, 3, 1] ELSE [2, 1, 2, 1] END)::INTEGER AS size FROM c""")
def missing_blocks(spark, sf_dir):
    columns = ["quality", "toxic", "again", "lang"]
    return block_table(co_missing(labelled(spark, sf_dir).withColumn("again", F.col("quality")), columns), columns)
