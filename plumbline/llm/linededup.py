"""Site-relative line deduplication (operator 8).

A line is boilerplate on a host if it stands in more than RATIO of the host's pages, whatever the host's size, and in
LEAST_PAGES of them at least, so that a host of one page is not emptied.
Pages containing a line are counted once each: lines are made distinct per page, hashed to 128 bits and counted with
partial aggregation, so a host with a third of all rows is summed by all tasks. A host has at most (lines per page) /
RATIO boilerplate lines, whatever its size; their hashes form one array per host, which is broadcast if it is small when
measured and joined otherwise. Pages keep their other lines, in order.

Lines are compared without the spaces around them; blank lines always stay, and a line of any length counts whole. A null
text stays null and has no lines, but its page counts for the host. A null host is a host of its own. Repeated rows are pages of their own. Other columns pass through;
n_chars, where there is one, is brought up to date. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise, table

RATIO = 0.05
LEAST_PAGES = 2
#: Measured size of the per-host table up to which it is broadcast.
BROADCAST_BYTES = 8 << 20
#: Tasks among which the pages of one host are dealt beyond that.
PARTS = 32


def line_counts(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(host, line_hash, pages, host_pages, ratio) of every non-blank line of every host."""
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.unhex(F.md5(x))))
    lines = docs.select(F.col(host).alias("host"), F.explode(keys).alias("line_hash"))
    counts = lines.groupBy("host", "line_hash").agg(F.count("*").alias("pages"))
    joined = counts.join(pages.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return joined.withColumn("ratio", F.col("pages") / F.col("host_pages"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, bad): the hashes of each host's boilerplate lines, for hosts that have any."""
    return line_counts(docs, host, text).where((F.col("ratio") > ratio) & (F.col("pages") >= min_pages)).groupBy("host").agg(F.array_sort(F.collect_set("line_hash")).alias("bad"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = LEAST_PAGES) -> DataFrame:
    """`docs` with the boilerplate lines taken out of `text`, and the number taken out in lines_dropped."""
    own = lambda name: next(n for n in (name + "_" * k for k in range(1, len(docs.columns) + 2)) if n not in docs.columns)
    at, lines_of, part = own("host"), own("bad"), own("part")
    bad = materialise(boilerplate(docs, host, text, ratio, min_pages), "boilerplate").select(F.col("host").alias(at), F.col("bad").alias(lines_of))
    size = bad.agg(F.coalesce(F.sum(F.size(lines_of) * 24 + 64), F.lit(0)).alias("bytes")).first().bytes
    same = F.col(host).eqNullSafe(F.col(at))
    if size <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(bad), same, "left")
    else:  # a host's pages are dealt to PARTS tasks, and its lines go to each of them
        dealt = docs.withColumn(part, F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]), F.lit(PARTS)))
        spread = bad.withColumn(own("of"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
        joined = dealt.join(spread, same & (F.col(part) == F.col(own("of"))), "left").drop(part, own("of"))
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(lines_of), F.unhex(F.md5(F.trim(x)))))
    text_now = F.when(F.col(lines_of).isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(lines_of).isNull() | F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    columns = {text: text_now, "lines_dropped": dropped}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(lines_of).isNull(), F.col("n_chars")).otherwise(F.length(text_now)).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(columns).drop(at, lines_of)


def op8_linededup(spark, sf_dir):
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", F.col("n_chars"), "lines_dropped")


OP8_SQL = f"""
WITH pages AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
counts AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
bad AS (SELECT c.source, c.line FROM counts c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
        WHERE c.pages * 1.0 / p.host_pages > {RATIO} AND c.pages >= {LEAST_PAGES}),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE b.line IS NULL) AS text, count(b.line) AS lines_dropped
         FROM l LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM l.source AND b.line = trim(l.line, ' ') GROUP BY l.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN k.lines_dropped > 0 THEN length(coalesce(k.text, '')) ELSE d.n_chars END AS n_chars, coalesce(k.lines_dropped, 0) AS lines_dropped
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
