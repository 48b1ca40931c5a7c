"""Benchmark passages in documents, by Wu-Manber search over words (operator 13).

Patterns are all runs of WINDOW words of the items, and whole items of fewer words. Patterns of one length form one searcher:
its shift table tells, for the last BLOCK words of the place looked at, how far the next pattern end can lie, so words between
are skipped; where the shift is zero, the bucket of those words, and in it that of the pattern's first words, names the
patterns, and a direct comparison of the words confirms an occurrence. Shorter items do not shorten the others' shifts.

The benchmark is cut into pieces of bounded size and dealt to groups of at most GROUP_BYTES; the documents are searched for
one group after another, each broadcast (a stated query set against all rows, in blocks). One group is the common case
and takes no shuffle at all. With more, what the others find is put together by document.

Words are runs of ASCII letters, digits and characters beyond ASCII, after lower-casing A-Z. A text is read in parts of PART
bytes, so a very long one takes no more memory; patterns that lie across parts are found. Null and empty texts have no words
and no hits; items without words match nothing. Repeated rows of documents each have their row, repeated items count once by
id, a null item id counts as the empty string. Other columns are not looked at. Empty tables: no rows, or rows without hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise, ship, table

WINDOW = 10
BLOCK = 3
#: Words of a piece of an item; size of the pieces that are searched for at once.
PIECE = 2000
GROUP_BYTES = 2 << 20  # some 350,000 windows, under 200 MB of tables in a worker
PART = 1 << 20

IN_WORDS = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
LOWERED = bytes((b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in IN_WORDS else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWERED).split()


def parts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """`text` in parts of about `size` bytes that do not cut words."""
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and LOWERED[text[end]] != 32:
            end += 1
        yield text[at:end]
        at = end


class Searcher:
    """Patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, list]):
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for p, ids in patterns.items():
            for end in range(self.block, length + 1):
                b = p[end - self.block : end]
                if length - end < self.shift.get(b, self.most):
                    self.shift[b] = length - end
            self.buckets.setdefault(p[-self.block :], {}).setdefault(p[: self.block], []).append((p, ids))

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, list]]:
        """(first word, ids of the items) of every occurrence."""
        length, block, most, shift, buckets = self.length, self.block, self.most, self.shift.get, self.buckets
        at, end = length, len(text)
        while at <= end:
            last = tuple(text[at - block : at])
            skip = shift(last, most)
            if skip:
                at += skip
                continue
            start = at - length
            for p, ids in buckets[last].get(tuple(text[start : start + block]), ()):
                if tuple(text[start:at]) == p:
                    yield start, ids
            at += 1


class Patterns:
    """Searchers of the pieces (item id, words joined by spaces)."""

    def __init__(self, pieces: list[tuple[str, bytes]]):
        by_length: dict[int, dict[tuple, list]] = {}
        for item, text in pieces:
            w = text.split(b" ")
            n = min(len(w), WINDOW)
            found = by_length.setdefault(n, {})
            for k in range(len(w) - n + 1):
                ids = found.setdefault(tuple(w[k : k + n]), [])
                if not ids or ids[-1] != item:
                    ids.append(item)
        self.searchers = [Searcher(n, p) for n, p in sorted(by_length.items())]

    def search(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(number of words, stretches of hit words, items found)."""
        total, carry, items = 0, [], set()
        spans: list[tuple[int, int]] = []
        for part in parts(text):
            now = carry + words(part)
            base = total - len(carry)
            found = []
            for s in self.searchers:
                for start, ids in s.occurrences(now):
                    if start + s.length <= len(carry):
                        continue  # found in the part before
                    found.append((base + start, base + start + s.length))
                    items.update(ids)
            for start, stop in sorted(found):
                # an occurrence across parts overlaps all that begin after it in the part before
                while spans and start < spans[-1][0]:
                    start, stop = min(start, spans[-1][0]), max(stop, spans.pop()[1])
                if spans and start <= spans[-1][1]:
                    spans[-1] = spans[-1][0], max(stop, spans[-1][1])
                else:
                    spans.append((start, stop))
            total = base + len(now)
            carry = now[-(WINDOW - 1) :]
        return total, spans, items


_made: dict[str, Patterns] = {}


def made(name: str, broadcast) -> Patterns:
    """The tables of a group, made once a Python worker; those of the group before go."""
    if name not in _made:
        _made.clear()
        _made[name] = Patterns(broadcast.value)
    return _made[name]


def pieces(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, bytes): the words of each item in pieces of PIECE windows that overlap by all but one word of a window."""

    def run(batches):
        for batch in batches:
            for key, value in zip(*batch.columns):
                w = words(value.as_py() or b"")
                starts = range(0, max(1, len(w) - WINDOW + 1), PIECE) if w else ()
                cut = [b" ".join(w[k : k + PIECE + WINDOW - 1]) for k in starts]
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(cut), pa.string()), pa.array(cut, pa.binary()), pa.array(list(map(len, cut)), pa.int64())], ["item", "words", "bytes"])

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").cast("binary").alias("text"))
    return named.mapInArrow(run, "item string, words binary, bytes bigint")


def search(docs: DataFrame, found: list[tuple[str, bytes]], only_hits: bool) -> DataFrame:
    """(doc_id, key, n_words, spans, items) of `docs` (doc_id, key, text as bytes) against the pieces."""
    spark = docs.sparkSession
    broadcast, name = spark.sparkContext.broadcast(found), uuid.uuid4().hex
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        patterns = made(name, broadcast)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                for i, value in enumerate(part.column(2)):
                    n, spans, items = patterns.search(value.as_py() or b"")
                    if spans or not only_hits:
                        rows.append((i, n, [{"start": a, "stop": b} for a, b in spans], sorted(items)))
                if rows:
                    at, n, spans, items = zip(*rows)
                    kept = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], ["doc_id", "key", "n_words", "spans", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key string, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): the stretches of words of each document that stand in the benchmark (sorted, apart from
    each other), and the ids of the items they come from."""
    spark = docs.sparkSession
    ship(spark)
    cut = materialise(pieces(benchmark).distinct(), "benchmark")
    size = cut.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().bytes
    groups = max(1, -(-size // group_bytes))
    read = lambda g: [(r.item, bytes(r.words)) for r in cut.where(F.pmod(F.xxhash64("item", "words"), F.lit(groups)) == g).select("item", "words").collect()]
    text = F.col("text").cast("string").cast("binary").alias("text")
    if groups == 1:
        return search(docs.select("doc_id", F.lit("").alias("key"), text), read(0), False).drop("key")
    keyed = docs.select("doc_id", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("key"), text)
    first = search(keyed, read(0), False)
    rest = None
    for g in range(1, groups):
        more = materialise(search(keyed, read(g), True), "hits")
        rest = more if rest is None else rest.unionByName(more)
    merged = rest.distinct().groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    joined = first.join(merged, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    spans = F.array_sort(F.concat("spans", F.coalesce("_spans", none)))
    united = F.aggregate(
        spans, none,
        lambda done, x: F.when((F.size(done) == 0) | (F.element_at(done, -1)["stop"] < x["start"]), F.concat(done, F.array(x))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))))
        ),
    )
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))))
    return joined.select("doc_id", "n_words", united.alias("spans"), items.alias("items"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of what `contamination` found."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def op13_decontamination(spark, sf_dir):
    return digests(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM patterns))),
found AS (SELECT r, item, i, n FROM grams JOIN patterns USING (n, g)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
