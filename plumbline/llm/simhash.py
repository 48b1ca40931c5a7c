"""SimHash near-duplicates by anchor points of a covering code (operator 3).

A text's fingerprint has, in each of 64 bits, the majority of its word shingles' hashes. Fingerprints that differ in at
most three bits differ in at most one bit of one of two 31-bit blocks. On each block the codewords of the perfect
Hamming code of length 31 are the anchors: every block value lies within the covering radius, 1, of exactly one anchor.
Each fingerprint goes to every anchor within radius plus threshold, 1 + 1 (16 at most), so the nearest anchor of
either of two such fingerprints also receives the other, and whole fingerprints are compared per anchor.

Equal fingerprints are grouped before anything is replicated, and each anchor returns a spanning forest of its links,
never all pairs. Components are found by star contraction. Null texts count as empty: fingerprint zero, linked like any
other. Rows with equal text share a component; a null doc_id never names a component unless all of its ids are null.
A very long text is hashed whole, in memory proportional to it. Extra columns are ignored. An empty table stays empty.
The near-duplicate stage of the pipeline uses the same method with settings of its own (nearcopies).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.runs import complete_runs
from plumbline.session import materialise, ship, shuffle_partitions, table

WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCK = 31
SHORT_RUN = 32
LONG_RUN = 1 << 15
BATCH_TEXTS = 1_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint, unsigned."""
    found = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1]).tolist()
    shingles = [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) per row; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(start, BATCH_TEXTS)
                found = np.array([fingerprint(x) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, fp bigint")


def syndrome(value: Column) -> Column:
    """The exclusive or of the (1-based) places of the set bits of a 31-bit value; 0 for a codeword."""
    out = F.lit(0)
    for b in range(5):
        mask = sum(1 << i for i in range(BLOCK) if (i + 1) >> b & 1)
        out = out + F.bit_count(value.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)) * (1 << b)
    return out


def block_anchors(value: Column, syndrome: Column) -> Column:
    """Codewords of the Hamming code of length 31 within distance 2 of a 31-bit value.

    With the value's syndrome s, flipping bit s gives the nearest codeword; the others within distance 2 flip two
    bits j and k with j xor k = s. A codeword (s = 0) has no other within distance 2."""
    def bit(j: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (j - 1).cast("int"))

    pairs = F.filter(F.sequence(F.lit(1), F.lit(BLOCK)), lambda j: j < j.bitwiseXOR(syndrome))
    two = F.transform(pairs, lambda j: value.bitwiseXOR(bit(j)).bitwiseXOR(bit(j.bitwiseXOR(syndrome))))
    return F.when(syndrome == 0, F.array(value)).otherwise(F.concat(F.array(value.bitwiseXOR(bit(syndrome))), two))


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, fp): each distinct fingerprint at each anchor of its two blocks."""
    mask = F.lit((1 << BLOCK) - 1).cast("long")
    low, high = F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", BLOCK).bitwiseAND(mask)
    blocks = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("n"), low.alias("v")), F.struct(F.lit(1).cast("long").alias("n"), high.alias("v")))).alias("b"))
    blocks = blocks.select("fp", "b.n", "b.v", syndrome(F.col("b.v")).alias("s"))
    spread = blocks.select("fp", "n", F.explode(block_anchors(F.col("v"), F.col("s"))).alias("code"))
    return spread.select((F.col("code") + F.col("n") * (1 << BLOCK)).alias("anchor"), "fp")


def spanning(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked among distinct fingerprints: each newly reached one is linked once."""
    out, left, todo = [], fps, []
    while todo or len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        here = todo.pop()
        near = np.bitwise_count(left ^ here) <= MAX_BITS
        if near.any():
            new = left[near]
            left = left[~near]
            out.append((np.full(len(new), here), new))
            todo += list(new)
    return out


def links_in_order(anchor: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of rows sorted by anchor: short runs by comparing rows k apart, long runs one by one."""
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(starts, len(anchor)))
    out = []
    for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        out += spanning(fp[s : s + n])
    short = np.repeat((sizes <= SHORT_RUN) & (sizes > 1), sizes)
    anchor, fp = anchor[short], fp[short]
    for k in range(1, SHORT_RUN):
        same = anchor[k:] == anchor[:-k]
        if not same.any():
            break
        near = same & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= MAX_BITS)
        if near.any():
            out.append((fp[:-k][near], fp[k:][near]))
    return out


def met(rows: DataFrame, limit: int | None) -> DataFrame:
    """(a, b): links of the fingerprints that meet under one key; (key, null) for a key with more than `limit` of them."""

    def run(batches):
        for cols, long in complete_runs(batches, limit):
            if long is not None:
                yield pa.RecordBatch.from_arrays([pa.array([long]), pa.array([None], pa.int64())], ["a", "b"])
            elif found := links_in_order(cols[0], cols[1].view(np.uint64)):
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints of `fps` that connect exactly what links of at most three bits connect.

    An anchor with more than LONG_RUN fingerprints is dealt anew, by its equal 16-bit quarters, of which two fingerprints
    that differ in at most three bits share at least one; a task then holds those of one quarter only."""
    rows = anchored(fps)
    found = materialise(met(rows, LONG_RUN).distinct(), "links")
    long = found.where("b IS NULL").select(F.col("a").alias("anchor"))
    links = found.where("b IS NOT NULL")
    if long.isEmpty():
        return links
    quarters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.struct(q.alias("q"), F.call_function("shiftrightunsigned", F.col("fp"), (q * 16).cast("int")).bitwiseAND(F.lit(0xFFFF).cast("long")).alias("v")))
    dealt = rows.join(long, "anchor", "left_semi").select("anchor", "fp", F.explode(quarters).alias("own"))
    dealt = dealt.select(F.xxhash64("anchor", "own.q", "own.v").alias("anchor"), "fp")
    return links.union(met(dealt, None)).distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: key, fingerprint (hex), component_id (smallest key reachable over links)."""
    fps = materialise(fingerprints(docs, key, text), "fingerprints")
    firsts = materialise(fps.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    roots = components(near_links(firsts.select("fp"))).select(F.col("node").alias("fp"), "root")
    # only linked fingerprints have a root; each of the others is a component of its own
    linked = materialise(roots.join(firsts, "fp"), "linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    ids = firsts.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(ids, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))
