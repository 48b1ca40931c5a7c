"""Packing documents into fixed-length token sequences in space-filling-curve order (operator 9).

Every document is tokenised and its ids are hashed to a vector, the mean of a fixed random sign per id and dimension. The
corpus' mean vector is taken off and what is left is brought to unit length, so that it says which ids a document has
more of than others have, whatever its length; DIMENSIONS random directions of it give the document's cell on a Hilbert
curve, which is its sort key, so that similar documents become neighbours. A range sort by the key
(ties by doc_id, then row) gives each document its start in one long stream of ids; the stream is cut every `length`
ids, so only the last sequence is short. Ids are written once to the shared folder; the sort moves only keys and
lengths, and the ids move once, to meet their positions. The driver sees one number per range partition.

A null text is empty and packs as its end id alone, in the middle cell; repeated rows each get their own place, ties go by
doc_id and then row; a text of over LONG_TEXT characters is encoded by operator 10's own encoder, which gives the same
ids and takes runs of white space of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import PATTERN, ByteBpe, byte_alphabet, chunks, default_vocabulary, worker_object
from plumbline.session import materialise, ship, shuffle_partitions, table

LENGTH = 1024
END_ID = 0
HASHED = 16
DIMENSIONS = 3
BITS = 16
#: Cells cover this many standard deviations of a random direction on either side.
SPREAD = 3.5
LONG_TEXT = 100_000
BATCH_TEXTS = 500
#: Chunks whose ids a task remembers.
CACHED_CHUNKS = 150_000


class TokenBytes:
    """Ids of whole texts as little-endian bytes (2 a token where the vocabulary allows, else 4)."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.own = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.code, self.kind = ("H", np.uint16) if max([*ranks.values(), *self.special.values()]) < 1 << 16 else ("I", np.uint32)
        self.known: dict[str, bytes] = {}
        signs = np.random.default_rng(20240229).integers(0, 2, (1 + max(ranks.values(), default=0) + len(self.special), HASHED)) * 2 - 1
        self.signs = signs.astype(np.float32)

    def plain(self, text: str) -> bytes:
        return array(self.code, self.encoding.encode_ordinary(text)).tobytes()

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if len(text) > LONG_TEXT:
            self.own = self.own or ByteBpe(self.path)
            return array(self.code, self.own.encode(text)).tobytes()
        if any(s in text for s in self.special):
            return array(self.code, self.encoding.encode(text, allowed_special="all")).tobytes()
        pieces = chunks(text)
        if pieces is None:
            return self.plain(text)
        known, first, plain = self.known, pieces[0], self.encoding.encode_ordinary
        del pieces[0]
        if len(known) > CACHED_CHUNKS:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = array(self.code, plain(" " + piece)).tobytes()
        return self.plain(first) + b"".join(map(known.__getitem__, pieces))

    def vector(self, ids: np.ndarray) -> np.ndarray:
        """Mean sign per dimension."""
        total = np.zeros(HASHED)
        for start in range(0, len(ids), 1 << 14):  # in slices, for little memory
            total += self.signs[ids[start : start + (1 << 14)]].sum(0)
        return total / max(1, len(ids))


#: The random directions, at right angles to each other.
DIRECTIONS = np.linalg.qr(np.random.default_rng(20240301).normal(size=(HASHED, DIMENSIONS)))[0]


def cells(vectors: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The cell of each row: its difference from the mean, at unit length, along each direction."""
    off = vectors - mean
    length = np.sqrt((off**2).sum(1, keepdims=True))
    at = np.divide(off, length, out=np.zeros_like(off), where=length > 1e-12) @ DIRECTIONS * np.sqrt(HASHED)
    return np.clip((at + SPREAD) * ((1 << BITS) / (2 * SPREAD)), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of non-negative integer cells below 2**bits.

    Works on all rows at once: the coordinates are turned into their transposed Gray form plane by plane and the
    planes are interleaved, most significant first."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for d in range(n):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    fold = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        fold = np.where((x[n - 1] & q) != 0, fold ^ (q - 1), fold)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | (((x[d] ^ fold) >> b) & 1)
    return key


def tokenised(docs: DataFrame, vocabulary: str, key: str, text: str) -> DataFrame:
    """Row id, document id, hashed vector, number of ids with the end id, and the ids."""

    def run(batches):
        tok = worker_object(TokenBytes, vocabulary)
        end = array(tok.code, [END_ID]).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(start, BATCH_TEXTS)
                raw = [tok(x.as_py()) + end for x in part.column(2)]
                ids = [np.frombuffer(x, tok.kind) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([tok.vector(x) for x in ids], pa.list_(pa.float32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary())],
                    ["uid", "doc_id", "vector", "doc_tokens", "ids"],
                )
        tok.known.clear()  # the worker lives on with other tasks

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"uid bigint, doc_id {kind}, vector array<float>, doc_tokens bigint, ids binary")


def curve_keys(rows: DataFrame) -> DataFrame:
    """uid, doc_id, doc_tokens and the key on the curve; the driver sees the mean vector only."""
    found = rows.agg(*[F.avg(F.col("vector")[d]).alias(f"m{d}") for d in range(HASHED)]).first()
    mean = np.array([x or 0.0 for x in found])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = cells(batch.column(3).flatten().to_numpy().reshape(-1, HASHED).astype(np.float64), mean)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hilbert_key(at), pa.int64())], ["uid", "doc_id", "doc_tokens", "curve_key"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("uid", "doc_id", "doc_tokens", "vector").mapInArrow(run, f"uid bigint, doc_id {kind}, doc_tokens bigint, curve_key bigint")


def stream_positions(rows: DataFrame) -> DataFrame:
    """uid and start of each document in the stream ordered by (curve_key, doc_id, uid)."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part), pa.int64()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64())], ["uid", "part", "pos", "n"])
            at = int(ends[-1]) if len(n) else at

    spark = rows.sparkSession
    order = ["curve_key", "doc_id", "uid"]
    keys = materialise(curve_keys(rows), "curve-keys")
    ordered = keys.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    local = materialise(ordered.select("uid", "doc_tokens").mapInArrow(run, "uid bigint, part bigint, pos bigint, n bigint"), "positions")
    totals = {r.part: r.total for r in local.groupBy("part").agg(F.sum("n").alias("total")).collect()}  # one row a range partition
    offsets, at = [], 0
    for p in sorted(totals):
        offsets.append((p, at))
        at += totals[p]
    offsets = spark.createDataFrame(offsets, "part bigint, base bigint")
    return local.join(F.broadcast(offsets), "part").select("uid", (F.col("base") + F.col("pos")).alias("stream_at"))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts in its document, its length, its sequence and offset there."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary or default_vocabulary()
    rows = materialise(tokenised(docs, vocabulary, key, text), "tokenised")
    places = stream_positions(rows)

    def run(batches):
        kind = worker_object(TokenBytes, vocabulary).kind
        for batch in batches:
            docs_, ids, at = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            source, cols = [], [[] for _ in range(6)]
            for row, (raw, begin) in enumerate(zip(ids, at)):
                own = np.frombuffer(raw, kind).astype("<u4")
                n, start = len(own), 0
                while start < n:
                    offset = (begin + start) % length
                    size = min(length - offset, n - start)
                    source.append(row)
                    for c, v in zip(cols, (start, size, zlib.crc32(own[start : start + size].tobytes()), n, (begin + start) // length, offset)):
                        c.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([docs_.take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    joined = rows.select("uid", "doc_id", "ids").join(places, "uid").select("doc_id", "ids", "stream_at")
    return joined.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op9_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
