"""SpotSigs document fingerprints (operator 1).

A signature is the chain of the next CHAIN content words after an anchor. Anchors are common words of the languages at
hand; so that texts without such words (tables, word lists, other languages) also get signatures, every eighth content
word, by its hash, is an anchor too. A fingerprint is the sorted set of the 32-bit hashes of a text's signatures (the
k-th repetition of a signature is a signature of its own, so that the set stands for the multiset), written in base64.
Two fingerprints are alike as the Jaccard coefficient of their sets; two empty sets count as alike (1).

near_links() finds all pairs of at least a given likeness: sets are partitioned by length, so that only lengths that
can reach the likeness meet, and each set is looked up by its rarest signatures only; near_classes() tells them by row.

Null texts count as empty (empty fingerprint). Texts of any length are read whole, in memory that grows with one text. Keys
are numbers or dates. Rows that repeat a key are ordered by their text. Null keys come first.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import worker_object
from plumbline.session import materialise, ship, shuffle_partitions, table

#: Common words of English, French, German and Spanish.
ANCHORS = """
the of and to a in is it that was for on are with as be by this at from or an
le la les de des du un une et est que qui dans pour par sur avec au pas ce
der die das und ist ein eine den dem von zu mit sich auf für nicht des im
el los las del en es y una por con para se no lo su
""".split()
CHAIN = 2
EVERY = 8
SIMILARITY = 0.8
CACHED_TOKENS = 400_000
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¿¡"
FINE = 64
RARITY = 20


class Signer:
    """Signature sets of texts, with the codes of the tokens seen so far kept per worker."""

    def __init__(self, anchors: str):
        self.anchors = frozenset(anchors.split(" "))
        self.codes: dict[str, int] = {}

    def code(self, token: str) -> int:
        """0 for a token without letters or digits; else a hash whose lowest bits tell an anchor (1) and a content word (2)."""
        word = token.strip(EDGES)
        if not word:
            return 0
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if word in self.anchors:
            return (h >> 3 << 2) | 1
        return (h >> 3 << 2) | 2 | (h % EVERY == 0)

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().split()
        codes = self.codes
        if len(codes) > CACHED_TOKENS:
            codes.clear()
        for t in set(tokens).difference(codes):
            codes[t] = self.code(t)
        c = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
        kind = (c & np.uint64(3)).astype(np.int64)
        content = c[kind >= 2]
        anchors = np.flatnonzero(kind & 1)
        after = np.cumsum(kind >= 2)[anchors]  # content words up to the anchor: the chain starts there
        good = after + CHAIN <= len(content)
        mixed, after = c[anchors[good]], after[good]
        if not len(mixed):  # too short for any chain: the whole text is one signature
            return np.array([xxhash.xxh32_intdigest(" ".join(tokens).encode("utf-8", "replace"))], np.uint32) if tokens else np.empty(0, np.uint32)
        for k in range(CHAIN):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + content[after + k]
        mixed.sort()
        new = np.concatenate([[True], mixed[1:] != mixed[:-1]])
        at = np.arange(len(mixed))
        mixed = mixed + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def shown(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: list[str] | None = None) -> DataFrame:
    """(key, signatures, digest): the set of each text, as 32-bit words in ascending unsigned order, and its 128-bit hash."""
    ship(docs.sparkSession)
    words = " ".join(anchors or ANCHORS)

    def run(batches):
        sign = worker_object(Signer, words)
        for batch in batches:
            found = [sign(x) for x in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int32) for x in found], pa.list_(pa.int32())), pa.array(digests, pa.binary())], [key, "signatures", "digest"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, signatures array<int>, digest binary")


def probes(classes: DataFrame, threshold: float) -> DataFrame:
    """(class, n, s): the rarest n - ceil(threshold * n) + 1 signatures of each class (class, signatures).

    Rarity is the number of classes with a signature of the same RARITY bits: one order for all sets, which is all that the
    result rests on, and a table of 2^RARITY counts at any size of the corpus."""
    bucket = F.col("s").bitwiseAND((1 << RARITY) - 1)
    found = classes.select(F.explode("signatures").alias("s")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << RARITY, np.uint32)
    counts[found["bucket"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)

    def run(batches):
        for batch in batches:
            owners, lengths, rare = [], [], []
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.values.to_numpy()
                n = len(x)
                first = n - math.ceil(threshold * n - 1e-9) + 1
                x = x[np.lexsort((x, counts[x & ((1 << RARITY) - 1)]))[:first]]
                owners.append(np.full(len(x), c, np.int64))
                lengths.append(np.full(len(x), n, np.int32))
                rare.append(x)
            if owners:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (owners, lengths, rare)], ["class", "n", "s"])

    return classes.select("class", "signatures").mapInArrow(run, "class bigint, n int, s int")


def near_links(docs: DataFrame, threshold: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, likeness), a < b, for every pair of different classes of equal fingerprints with
    likeness >= threshold; members (key, class), one for every row. A class is a number; empty sets have the null class,
    which links to nothing.

    Lengths of such pairs differ by at most the factor `threshold`, so a set of length n in length partition p meets
    partitions p and p + 1 only. Among the rarest n - ceil(threshold * n) + 1 signatures such a pair shares at least one,
    so only those are joined. Copies of a text are one class, so a group of copies is never joined with itself."""
    sets = materialise(signatures(docs, key, text), "signatures")
    classes = sets.where(F.size("signatures") > 0).groupBy("digest").agg(F.first("signatures").alias("signatures"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "signature-classes")
    members = sets.select(key, "digest").join(classes.select("digest", "class"), "digest", "left").select(key, "class")
    part = F.floor(F.log("n") / -math.log(threshold) + 1e-9).cast("int")
    small = probes(classes, threshold).select("s", part.alias("part"), "class", "n")
    large = small.select("s", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("class").alias("b"), F.col("n").alias("m"))
    met = small.join(large, ["s", "part"]).where("class != b and n <= m and n >= m * %r - 1e-9 and (n < m or class < b)" % threshold)
    pairs = met.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()
    left, right = classes.select(F.col("class").alias("a"), F.col("signatures").alias("x")), classes.select(F.col("class").alias("b"), F.col("signatures").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    scored = pairs.join(left, "a").join(right, "b").withColumn("likeness", shared / (F.size("x") + F.size("y") - shared))
    return scored.where(F.col("likeness") >= threshold).select("a", "b", "likeness"), members


def near_classes(docs: DataFrame, threshold: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, copies, links) of every row: the smallest key of the rows of equal fingerprint, how many they are, and
    how many other classes are as like as the threshold."""
    links, members = near_links(docs, threshold, key, text)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    known = members.groupBy("class").agg(F.min(key).alias("class_id"), F.count("*").alias("copies")).join(ends, "class", "left")
    rows = members.alias("m").join(known.alias("k"), F.col("m.class").eqNullSafe(F.col("k.class")))
    return rows.select(F.col(f"m.{key}").alias(key), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def part_number(key: Column, splits: list) -> Column:
    """How many of the ascending `splits` are at most the key (0 for null), by a two-level search."""
    if not splits:
        return F.lit(0)
    fine, coarse = F.array(*map(F.lit, splits)), F.array(*map(F.lit, splits[::FINE]))
    block = F.size(F.filter(coarse, lambda s: s <= key))
    within = F.size(F.filter(F.slice(fine, F.greatest((block - 1) * FINE + 1, F.lit(1)), F.lit(FINE)), lambda s: s <= key))
    return F.when(key.isNull() | (block == 0), 0).otherwise((block - 1) * FINE + within).cast("int")


def followed(docs: DataFrame, key: str, text: str, finish) -> DataFrame:
    """Rows in ascending key order dealt over ranges, each range followed by a copy of the next range's first row (the
    last by the first of all); `finish` is (schema, function of a batch iterator) and reads them in order.

    The texts are shuffled once. The driver sees the range bounds only."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranges = min(4096, 4 * n)
    found = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q"), F.count_if(F.col("key").isNull()).alias("nulls")).first()
    splits = sorted(set(found.q or []))
    rows = rows.withColumn("part", part_number(F.col("key"), splits))
    firsts = sorted((r.part, r.first) for r in rows.groupBy("part").agg(F.min("key").alias("first")).collect() if r.first is not None or found.nulls)
    copies = F.lit(None).cast("array<struct<part:int,ahead:int>>")
    if firsts:
        places = []
        for (p, _), (_, first) in zip(firsts, firsts[1:]):
            places.append((first, p, 1))
        wrap = (None if found.nulls else firsts[0][1], firsts[-1][0], 2)
        ahead = F.map_from_arrays(F.array(*[F.lit(x[0]) for x in places]), F.array(*[F.lit(x[1]) for x in places])) if places else None
        next_to = F.when(F.col("key").isNull(), None).otherwise(ahead[F.col("key")]) if places else F.lit(None).cast("int")
        is_first = F.col("key").isNull() if wrap[0] is None else F.col("key") == F.lit(wrap[0])
        copies = F.array_compact(F.array(F.when(next_to.isNotNull(), F.struct(next_to.alias("part"), F.lit(1).alias("ahead"))), F.when(is_first, F.struct(F.lit(wrap[1]).alias("part"), F.lit(2).alias("ahead")))))
    own = F.array(F.struct(F.col("part").cast("int").alias("part"), F.lit(0).alias("ahead")))
    dealt = rows.select("key", "text", F.explode(F.concat(own, F.coalesce(copies, F.array().cast("array<struct<part:int,ahead:int>>")))).alias("at"))
    dealt = dealt.select("at.part", "at.ahead", "key", "text").repartition(n, "part").sortWithinPartitions("part", "ahead", "key", "text")
    return dealt.mapInArrow(finish[1], finish[0])


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: list[str] | None = None) -> DataFrame:
    """Per row: fingerprints of the text and of its edit by the next row's text, and how alike they are."""
    ship(docs.sparkSession)
    words = " ".join(anchors or ANCHORS)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        sign = worker_object(Signer, words)
        last = None  # part, key, text, signatures of the row before, if it is not a copy
        for batch in batches:
            out = [[] for _ in names]
            for part, ahead, k, here in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] == part:
                    before, own = last[2], last[3]
                    now = own if here == before else sign(here)
                    half = len(before) // 2
                    edited = before[: len(before) - half] + here[:half]
                    other = own if edited == before else sign(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                    for c, v in zip(out, (last[1], len(before), sha, shown(own), shown(other), jaccard(own, other), jaccard(own, now))):
                        c.append(v)
                else:
                    now = None
                last = None if ahead else (part, k, here, sign(here) if now is None else now)
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return followed(docs, key, text, (schema, run))


def op1_spotsigs(spark, sf_dir):
    return edited_likeness(table(spark, sf_dir, "documents"))


def spotsigs_links(spark, sf_dir):
    """The partitioned comparison of operator 1 over all documents: class and number of links of each."""
    return near_classes(table(spark, sf_dir, "documents"))
