"""Interaction audit of filters (operator 11).

Every document has a mask, one bit for each filter that it fails; the documents of a part are counted by mask, by all
tasks. Of the n! orders of the filters in lexicographic rank (Lehmer code), those that begin with the same letters are
neighbours, so a mask is removed at step k by whole intervals of ranks: one for each run of k - 1 filters that it passes and
a filter that it fails. The counts of the masks are added where an interval begins and taken off where it ends, and the
running sum over the ranks gives what each step of each order removes. The work on documents does not depend on the number
of orders, and what follows has a few hundred rows a part.

`audit` takes any frame with a boolean column a filter (up to seven), `filter_flags` makes the five of the registered query.

Null texts are empty, null langs the part of the empty string; empty texts have no words. Texts are read whole and compared
by SHA-256, equal texts of one id (repeated rows) are no copies of each other, and a row without an id is neither a copy
nor an original. A document is good or toxic if any of its label rows says so; labels of no document do nothing. Other
columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import table

FILTERS = "ABCDE"
MOST_FILTERS = 7
WORD_BREAK = r"[\x20\x09-\x0D]+"


def rank(prefix: tuple[int, ...], n: int) -> int:
    """Lexicographic rank of the first permutation of range(n) that begins with `prefix`."""
    return sum((x - sum(y < x for y in prefix[:i])) * factorial(n - 1 - i) for i, x in enumerate(prefix))


def intervals(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders in which the mask's first failing filter has that step."""
    for mask in range(1, 1 << n):
        failed, passed = [f for f in range(n) if mask >> f & 1], [f for f in range(n) if not mask >> f & 1]
        for before in range(len(passed) + 1):
            for prefix in permutations(passed, before):
                for f in failed:
                    at = rank((*prefix, f), n)
                    yield mask, before + 1, at, at + factorial(n - 1 - before)


def audit(docs: DataFrame, filters: str = FILTERS, part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """One row a part, order of the filters and step, from a frame with a boolean column for each letter of `filters` and
    the columns named: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS or len(set(filters)) != n:
        raise ValueError(f"one to {MOST_FILTERS} different filters")
    spark, letters = docs.sparkSession, sorted(filters)
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(letters)), F.lit(0))
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    masks = docs.groupBy(F.col(part).alias("part"), mask.alias("mask")).agg(F.count("*").alias("docs"), one(good).alias("good"), one(toxic).alias("toxic"))
    failing = lambda i: F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("docs")).otherwise(0)
    alone = lambda i: F.when(F.col("mask") == 1 << i, F.col("docs")).otherwise(0)
    array = lambda of: F.array(*(F.sum(of(i)) for i in range(n)))
    parts = masks.groupBy("part").agg(F.sum("docs").alias("docs"), array(failing).alias("fails"), array(alone).alias("alone"))

    spans = spark.createDataFrame(list(intervals(n)), "mask int, step int, start int, stop int")
    ends = masks.join(F.broadcast(spans), "mask").select("part", "step", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("sign")))).alias("end"), "docs", "good", "toxic")
    change = ends.groupBy("part", "step", F.col("end.at").alias("at")).agg(*(F.sum(F.col("end.sign") * F.col(c)).alias(c) for c in ("docs", "good", "toxic")))
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("at")).select("part", "at", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    along = Window.partitionBy("part", "step").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lost = grid.join(change, ["part", "step", "at"], "left").select("part", "step", "at", *(F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in ("docs", "good", "toxic")))

    orders = spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(permutations(letters))], "at int, filter_order string")
    rows = lost.withColumnsRenamed({"docs": "removed", "good": "good_lost", "toxic": "toxic_lost"}).join(F.broadcast(orders), "at").join(parts, "part")
    rows = rows.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    index = F.array_position(F.array(*map(F.lit, letters)), F.col("filter")).cast("int")
    rows = rows.withColumns({"fails": F.element_at("fails", index), "alone": F.element_at("alone", index)})
    done = Window.partitionBy("part", "at").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "part", "filter_order", "step",
        (F.col("docs") - F.sum("removed").over(done)).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        F.col("alone").alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def filter_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, A to E, good, toxic), one row a row of `docs`. A: few words, B: few different words, C: many capitals,
    D: symbols of markup, E: a copy of a document of smaller id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", "text", F.array_remove(F.split("text", WORD_BREAK), "").alias("words"), F.sha2("text", 256).alias("digest")
    )
    rows = rows.select(
        "doc_id", "part", "digest",
        (F.size("words") < 200).alias("A"), (100 * F.size(F.array_distinct("words")).cast("long") < 50 * F.size("words").cast("long")).alias("B"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 3 * F.length("text").cast("long")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    # an original is met by (text, id), so copies of one text go to different tasks
    originals = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("original", F.lit(True))
    flagged = rows.join(originals, ["digest", "doc_id"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("original").isNull())
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return flagged.join(known, "doc_id", "left").select("doc_id", "part", *FILTERS, "good", "toxic")


def op11_filteraudit(spark, sf_dir):
    return audit(filter_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                        regexp_matches(t, '[#$%&*|]'), coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
          FROM words LEFT JOIN known ON known.doc_id = words.doc_id),
masks AS (SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
           WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
firsts AS (SELECT part, filter_order, docs, good, toxic, fails, coalesce(list_position(list_transform(range(1, 6), lambda s: fails[ascii(filter_order[s]) - 64]), true), 6) AS gone FROM masks, orders),
steps AS (SELECT part, filter_order, step, filter_order[step] AS f,
                 sum(CASE WHEN gone > step THEN docs ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN docs ELSE 0 END) AS removed,
                 sum(CASE WHEN gone < step AND fails[ascii(filter_order[step]) - 64] THEN docs ELSE 0 END) AS redundant,
                 sum(CASE WHEN fails[ascii(filter_order[step]) - 64] AND len(list_filter(fails, lambda x: x)) = 1 THEN docs ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
          FROM firsts, (SELECT unnest(range(1, 6)) AS step) GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM steps
"""
