"""Matching of names: dictionaries, entities and knowledge-base entries to columns (MT-1 to MT-3, MT-5, MT-7, MT-8, MT-10). The catalogues are
tables of columns, so the work grows with columns and names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import jaccard, name_tokens, norm_name, rounded, similarity
from plumbline.plans.registry import query
from plumbline.session import ship, table

SUGGEST, ALIAS = 0.60, 0.84


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over both lengths; for the few names of catalogues."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def scored_pairs(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All pairs of names (left.name, right.other) within `by` with exact, edit and word likeness. Both sides are catalogues
    of names, a table's columns on either, so the pairs are as few as those; no pair is left out by a block."""
    by = by or []
    left, right = left.withColumns({"name_words": name_tokens(F.col("name")), "_one": F.lit(1)}), right.withColumns({"other_words": name_tokens(F.col("other")), "_one": F.lit(1)})
    pairs = left.join(right, by or ["_one"]).dropDuplicates([*by, "name", "other"])
    exact = norm_name(F.col("name")) == norm_name(F.col("other"))
    score = F.when(exact, 1.0).otherwise(F.greatest(similarity(norm_name(F.col("name")), norm_name(F.col("other"))), jaccard(F.col("name_words"), F.col("other_words"))))
    return pairs.select(*by, "name", "other", exact.alias("exact"), score.alias("score"))


def dictionary_mapping(dictionary: DataFrame, columns: DataFrame, floor: float = SUGGEST) -> DataFrame:
    """One-to-one mapping of dictionary names to columns within each table, in file order: a name takes the free column that
    equals it when normalised, else suggests the free column of the highest sequence ratio, else is below the floor, with
    that ratio and no column (MT-1). One group a table: the names of its columns. A dictionary of a table without columns
    gives no row. The greedy choice is a loop over a table's names and columns: some thousand of each are borne."""
    left = dictionary.select("table", "name", "position", norm_name(F.col("name")).alias("a"))
    right = columns.select("table", F.col("column").alias("other"), norm_name(F.col("column")).alias("b")).distinct()
    pairs = left.join(right, "table").withColumn("score", sequence_ratio("a", "b")).withColumn("exact", F.col("a") == F.col("b"))

    def greedy(g: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, own in g.sort_values(["position", "name_", "exact", "score", "other"], ascending=[True, True, False, False, True]).groupby(["position", "name_"], sort=False):
            free = [r for r in own.itertuples() if r.other not in used and r.score > 0]
            one = free[0] if free else None
            if one is not None and (one.exact or one.score >= floor):
                used.add(one.other)
                out.append((one.table, one.name_, one.other, "exact" if one.exact else "suggested", one.score))
            else:
                out.append((own["table"].iloc[0], own.name_.iloc[0], None, "below_floor", one.score if one is not None else None))
        return pd.DataFrame(out, columns=["table", "name", "column", "kind", "score"])

    ship(dictionary.sparkSession)
    kept = pairs.select("table", F.col("name").alias("name_"), "position", "other", "score", "exact")
    return kept.groupBy("table").applyInPandas(greedy, "table string, name string, column string, kind string, score double")


def dictionary_state(columns: DataFrame, mapped: DataFrame) -> DataFrame:
    """yes, thin or absent by the share of described columns (MT-2)."""
    n = columns.groupBy("table").agg(F.count("*").alias("columns"))
    m = mapped.where("kind = 'exact'").groupBy("table").agg(F.count("*").alias("described"))
    share = F.coalesce(F.col("described"), F.lit(0)) / F.col("columns")
    return n.join(m, "table", "left").select("table", "columns", F.coalesce("described", F.lit(0)).alias("described"), F.when(share >= 0.5, "yes").when(share > 0, "thin").otherwise("absent").alias("state"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with counts (MT-3)."""
    return df.where(F.col(column).isNotNull()).groupBy(F.trim(F.lower(F.col(column).cast("string"))).alias("value")).agg(F.count("*").alias("n"))


def aliases(headers: DataFrame, known: DataFrame, floor: float = ALIAS) -> DataFrame:
    """Headers (name) to canonical fields (alias -> field): exact alias or a likeness of at least the floor (MT-3)."""
    pairs = scored_pairs(headers, known.select(F.col("alias").alias("other"))).where(F.col("score") >= floor).join(known.withColumnRenamed("alias", "other"), "other")
    rn = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "field"))
    return pairs.withColumn("rn", rn).where("rn = 1").select("name", "field", "score")


def entity_tables(bindings: DataFrame) -> DataFrame:
    """The table that most roles of an entity are bound to (MT-5)."""
    per = bindings.groupBy("entity", "table").agg(F.count("*").alias("votes"))
    return per.groupBy("entity").agg(F.min_by("table", F.struct(-F.col("votes"), "table")).alias("table"), F.max("votes").alias("votes"))


def ranked_matches(queries_: DataFrame, base: DataFrame, top: int = 3, aliases_: DataFrame | None = None) -> DataFrame:
    """Knowledge-base entries (entry, text) of each query (name, description), with position and status (MT-7). A query whose
    name equals an alias (alias, entry) of one entry only, both normalised, is an exact match; else entries are ranked by
    half the likeness of word sets and half the TF-IDF cosine of words and word pairs, whose weights come from the base; a
    query that shares no word with the base has one row without an entry, "no_match"."""
    if aliases_ is not None:
        known = aliases_.groupBy(norm_name(F.col("alias")).alias("a")).agg(F.min("entry").alias("entry"), F.count_distinct("entry").alias("k")).where("k = 1")
        exact = queries_.select("name", norm_name(F.col("name")).alias("a")).join(known, "a").select("name", "entry", F.lit(1.0).alias("score"), F.lit(1).alias("position"), F.lit("exact_match").alias("status"))
        return exact.unionByName(ranked_matches(queries_.join(exact, "name", "left_anti"), base, top))

    def grams(df, key, c):
        words = df.select(key, name_tokens(F.col(c)).alias("t"))
        pairs = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
        return words.select(key, F.explode(F.concat("t", pairs)).alias("w")).groupBy(key, "w").agg(F.count("*").alias("tf"))

    n = base.select("entry").distinct().count()
    b, q = grams(base, "entry", "text"), grams(queries_, "name", "description")
    idf = b.groupBy("w").agg((F.log((F.lit(n) + 1) / (F.count("*") + 1)) + 1).alias("idf"))
    single = (~F.contains(F.col("w"), F.lit(" "))).cast("int")
    norm = lambda df, key: df.join(idf, "w", "left").groupBy(key).agg(F.sqrt(F.sum(F.pow(F.col("idf") * F.col("tf"), 2))).alias(f"{key}_norm"), F.sum(single).alias(f"{key}_n"))
    shared = q.join(b.withColumnRenamed("tf", "tf_b"), "w").join(idf, "w").groupBy("name", "entry").agg(F.sum(F.col("idf") * F.col("idf") * F.col("tf") * F.col("tf_b")).alias("dot"), F.sum(single).alias("k"))
    both = shared.join(norm(q, "name"), "name").join(norm(b, "entry"), "entry")
    score = 0.5 * F.col("k") / (F.col("name_n") + F.col("entry_n") - F.col("k")) + 0.5 * F.col("dot") / (F.col("name_norm") * F.col("entry_norm"))
    rn = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(F.round("score", 9)), "entry"))  # sums in any order
    found = both.select("name", "entry", score.alias("score")).withColumn("position", rn).where(F.col("position") <= top)
    out = queries_.select("name").distinct().join(found, "name", "left")
    return out.withColumn("status", F.when(F.col("entry").isNull(), "no_match").otherwise("candidate_match"))


def accuracy(ranked_: DataFrame, truth: DataFrame) -> DataFrame:
    """Top-1 and top-3 accuracy by category (name, expected, category) and over all cases, category "overall" (MT-8)."""
    right = F.coalesce(F.col("entry") == F.col("expected"), F.lit(False))
    hit = ranked_.join(truth, "name", "right").groupBy("name", "category").agg(F.max((right & (F.col("position") == 1)).cast("int")).alias("one"), F.max((right & (F.col("position") <= 3)).cast("int")).alias("three"))
    rows = hit.select(F.explode(F.array("category", F.lit("overall"))).alias("category"), F.coalesce("one", F.lit(0)).alias("one"), F.coalesce("three", F.lit(0)).alias("three"))
    return rows.groupBy("category").agg(F.count("*").alias("cases"), F.avg("one").alias("top1"), F.avg("three").alias("top3"))


def applicable(library: DataFrame, columns: DataFrame) -> DataFrame:
    """Tests (test, needs: array of types) whose every needed type some column has (MT-10)."""
    needs = library.select("test", F.explode("needs").alias("logical_type"))
    have = columns.select("logical_type").distinct().withColumn("have", F.lit(1))
    return needs.join(have, "logical_type", "left").groupBy("test").agg((F.count("*") == F.count("have")).alias("applicable"))


def populated_columns(spark, sf_dir, names=("orders", "customer")) -> DataFrame:
    """(table, column) of the columns that hold a value in any row."""
    from functools import reduce

    def one(t):
        df = table(spark, sf_dir, t)
        return df.agg(F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in df.columns])).alias("c")).select(F.lit(t).alias("table"), F.explode("c").alias("column"))

    return reduce(DataFrame.unionByName, map(one, names))


def column_types(spark, sf_dir, names=("orders", "customer")) -> DataFrame:
    """(table, column, logical_type) of whole tables, by their values."""
    from functools import reduce

    from plumbline.operators.profile import classify

    tables = {t: table(spark, sf_dir, t) for t in names}
    return reduce(DataFrame.unionByName, [classify(df, df.columns).withColumn("table", F.lit(t)) for t, df in tables.items()])


@query("matching_vocabulary", "SELECT trim(lower(c_mktsegment)) AS value, count(*) AS n FROM customer GROUP BY 1")
def matching_vocabulary(spark, sf_dir):
    return vocabulary(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("matching_dictionary", """SELECT * FROM (VALUES ('orders', 'O_ORDERKEY', 'o_orderkey', 'exact', 1.0), ('orders', 'o_order_date', 'o_orderdate', 'suggested', 0.956522), ('orders', 'zzz', NULL, 'below_floor', NULL)) v("table", name, "column", kind, score) WHERE (SELECT count(*) FROM orders) > 0""")
def matching_dictionary(spark, sf_dir):
    d = spark.createDataFrame([("orders", "O_ORDERKEY", 0), ("orders", "o_order_date", 1), ("orders", "zzz", 2)], "table string, name string, position int")
    return dictionary_mapping(d, populated_columns(spark, sf_dir)).withColumn("score", rounded(F.col("score")))


@query("matching_state", """WITH d("table", name) AS (VALUES ('orders', 'O_ORDERKEY'), ('orders', 'o_custkey'), ('orders', 'O Order Status'), ('orders', 'nothing'), ('customer', 'c_name'), ('customer', 'zzz')),
 c AS (SELECT table_name AS "table", column_name AS c FROM duckdb_columns() WHERE table_name IN ('orders', 'customer', 'nation')), m AS (SELECT DISTINCT c."table", c FROM c JOIN d ON d."table" = c."table" AND regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g') = regexp_replace(lower(trim(c)), '[^a-z0-9]+', '_', 'g'))
 SELECT "table", count(*) AS columns, count(m.c) AS described, CASE WHEN count(m.c) >= 0.5 * count(*) THEN 'yes' WHEN count(m.c) > 0 THEN 'thin' ELSE 'absent' END AS state FROM c LEFT JOIN m USING ("table", c) GROUP BY 1""")
def matching_state(spark, sf_dir):
    """How far a dictionary covers three tables."""
    names = [("orders", "O_ORDERKEY", 0), ("orders", "o_custkey", 1), ("orders", "O Order Status", 2), ("orders", "nothing", 3), ("customer", "c_name", 0), ("customer", "zzz", 1)]
    columns = populated_columns(spark, sf_dir, ("orders", "customer", "nation"))
    return dictionary_state(columns, dictionary_mapping(spark.createDataFrame(names, "table string, name string, position int"), columns, 2.0))


@query("matching_aliases", """WITH k(alias, field) AS (VALUES ('custkey', 'customer'), ('orderkey', 'order'), ('totalprice', 'amount')), h AS (SELECT substr(column_name, 3) AS name FROM duckdb_columns() WHERE table_name = 'orders'),
 s AS (SELECT name, field, CASE WHEN name = alias THEN 1.0 ELSE 1 - levenshtein(name, alias) / greatest(length(name), length(alias)) END AS score FROM h, k) SELECT name, field, round(score, 6) AS score FROM s WHERE score >= 0.84 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, field) = 1""")
def matching_aliases(spark, sf_dir):
    """Headers of orders, without their prefix, and known names of fields."""
    headers = populated_columns(spark, sf_dir, ("orders",)).select(F.substring("column", 3, 100).alias("name"))
    known = spark.createDataFrame([("custkey", "customer"), ("orderkey", "order"), ("totalprice", "amount")], "alias string, field string")
    return aliases(headers, known).withColumn("score", rounded(F.col("score")))


@query("matching_applicable", """WITH k AS (SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_name) AS names FROM customer), d AS (SELECT count(o_orderdate) > 0 AS dated FROM orders),
 have AS (SELECT CASE WHEN data_type LIKE 'TIMESTAMP%' AND dated THEN 'datetime' WHEN data_type = 'VARCHAR' AND column_name = 'c_mktsegment' AND segments BETWEEN 3 AND 30 THEN 'categorical' WHEN data_type = 'VARCHAR' AND column_name = 'c_name' AND names > 30 THEN 'long' WHEN data_type = 'DOUBLE' THEN 'numerical' END AS kind FROM duckdb_columns(), k, d WHERE table_name IN ('orders', 'customer')),
 n(test, needs) AS (VALUES ('drift', ['numerical', 'datetime']), ('text', ['categorical', 'free_text']), ('groups', ['categorical']))
 SELECT test, list_has_all((SELECT list(DISTINCT kind) FROM have WHERE kind IS NOT NULL), needs) AS applicable FROM n""")
def matching_applicable(spark, sf_dir):
    library = spark.createDataFrame([("drift", ["numerical", "datetime"]), ("text", ["categorical", "free_text"]), ("groups", ["categorical"])], "test string, needs array<string>")
    return applicable(library, column_types(spark, sf_dir))


@query("matching_entities", "WITH v AS (SELECT c_mktsegment AS entity, c_nationkey AS t, count(*) AS votes FROM customer GROUP BY 1, 2) SELECT entity, arg_min(t, (-votes, t))::VARCHAR AS \"table\", max(votes) AS votes FROM v GROUP BY 1")
def matching_entities(spark, sf_dir):
    b = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("entity"), F.col("c_nationkey").alias("table"))
    return entity_tables(b).withColumn("table", F.col("table").cast("string"))


def _grams(rows: str) -> str:
    spaced = r"regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')"
    words = f"SELECT k, list_filter(regexp_split_to_array(lower({spaced}), '[^a-z0-9]+'), lambda y: y <> '') AS t FROM ({rows})"
    return f"SELECT k, w, count(*) AS tf FROM (SELECT k, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS w FROM ({words})) GROUP BY 1, 2"


@query("matching_accuracy", f"""WITH q AS ({_grams("SELECT item_id AS k, split_part(text, '.', 1) AS x FROM benchmark")}), b AS ({_grams("SELECT item_id AS k, text AS x FROM benchmark")}),
 idf AS (SELECT w, ln(((SELECT count(DISTINCT item_id) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS v, (NOT contains(w, ' '))::INT AS one FROM b GROUP BY w),
 qn AS (SELECT k, sqrt(sum((v * tf) ** 2)) AS norm, sum((NOT contains(w, ' '))::INT) AS n FROM q LEFT JOIN idf USING (w) GROUP BY k), bn AS (SELECT k, sqrt(sum((v * tf) ** 2)) AS norm, sum(one) AS n FROM b JOIN idf USING (w) GROUP BY k),
 s AS (SELECT q.k AS name, b.k AS entry, sum(v * v * q.tf * b.tf) AS dot, sum(one) AS shared FROM q JOIN b USING (w) JOIN idf USING (w) GROUP BY 1, 2),
 r AS (SELECT name, entry, row_number() OVER (PARTITION BY name ORDER BY round(0.5 * shared / (qn.n + bn.n - shared) + 0.5 * dot / (qn.norm * bn.norm), 9) DESC, entry) AS position FROM s JOIN qn ON qn.k = name JOIN bn ON bn.k = entry),
 h AS (SELECT item_id, CASE WHEN length(split_part(text, '.', 1)) > 40 THEN 'long' ELSE 'short' END AS category, coalesce(position = 1, false)::INT AS one, coalesce(position <= 3, false)::INT AS three FROM benchmark LEFT JOIN r ON name = item_id AND entry = item_id)
 SELECT category, count(*) AS cases, round(avg(one), 6) AS top1, round(avg(three), 6) AS top3 FROM (SELECT category, one, three FROM h UNION ALL SELECT 'overall', one, three FROM h) GROUP BY 1""")
def matching_accuracy(spark, sf_dir):
    """Benchmark passages looked up by their first sentence."""
    base = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), "text")
    q = base.select(F.col("entry").alias("name"), F.substring_index("text", ".", 1).alias("description"))
    truth = q.select("name", F.col("name").alias("expected"), F.when(F.length("description") > 40, "long").otherwise("short").alias("category"))
    return accuracy(ranked_matches(q, base), truth).withColumns({c: rounded(F.col(c)) for c in ("top1", "top3")})
