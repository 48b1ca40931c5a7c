"""Exact top-k inner products over a bit-sliced index (operator 5).

Vectors are quantised to floor(256 * x). Rows are dealt to blocks of about BLOCK_ROWS; a block's index holds, for every
dimension, bitmaps of the bits of the coarse value (the low DROP_ROW bits left out). For a query, the coarse scores of
all rows of a block are formed at once with bitmap arithmetic: the weight of a dimension is taken bit by bit, the
slices chosen by a bit are added in a tree of carry-save adders, and the sums are added at their place values; negative
weights read the complement. The k best coarse scores are selected from the most significant slice downward. What the
coarse score leaves out is bounded by the norms of the remainders (Cauchy-Schwarz); every row whose coarse score is
within twice that bound of the k-th is a boundary row, and is resolved by its exact integer score.

A block's slices are made once and stored with it. Queries are packed in chunks that meet every block; only k rows of
each query and block go on to the last ranking. Vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros. A query never meets its own row, but does meet other rows of the same id or
values; ties go to the smaller id, a null id comes last. A null id meets no condition on ids, so it is a candidate only.
Components are whole numbers of any size below 2**62 (a larger one is an error); a score that does not fit a long is an
error too, never a wrong number. Vectors of any length are taken whole. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.session import materialise, ship, table

SCALE = 256
TOP = 5
EVERY = 50
BLOCK_ROWS = 8192
CHUNK_QUERIES = 4096
DROP_ROW = 2
DROP_QUERY = 1
LARGEST = 1 << 62


def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two bit-sliced numbers (least significant slice first), slice by slice with a carry."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        if i < len(b):
            half = x ^ b[i]
            if carry is None:
                out.append(half)
                carry = x & b[i]
            else:
                out.append(half ^ carry)
                carry = (x & b[i]) | (half & carry)
        elif carry is None:
            out.append(x)
        else:
            out.append(x ^ carry)
            carry = x & carry
    if carry is not None:
        out.append(carry)
    return out


def add_all(slices: np.ndarray) -> list[np.ndarray]:
    """Sum over the first axis of [numbers, slices, words], in a tree; all pairs of a level are added at once."""
    now = [slices[:, s] for s in range(slices.shape[1])]
    while (n := len(now[0])) > 1:
        if n % 2:
            last = [x[-1:] for x in now]
            now = add([x[0 : n - 1 : 2] for x in now], [x[1:n:2] for x in now])
            now = [np.concatenate([x, last[i] if i < len(last) else np.zeros_like(x[:1])]) for i, x in enumerate(now)]
        else:
            now = add([x[0::2] for x in now], [x[1::2] for x in now])
    return [x[0] for x in now]


def exact_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs; in Python's integers where a long might not hold a sum."""
    largest = max(map(abs, (int(values.min()), int(values.max())))) * max(map(abs, (int(query.min()), int(query.max())))) if values.size else 0
    if largest * values.shape[1] < 1 << 63:
        return values @ query
    out = values.astype(object) @ query.astype(object)
    if any(not -(1 << 63) <= x < 1 << 63 for x in out):
        raise OverflowError("an inner product does not fit a long")
    return out.astype(np.int64)


class Block:
    """The bit-sliced index of one block of quantised vectors; `stored` has what packed() gave."""

    def __init__(self, values: np.ndarray, stored: tuple | None = None):
        self.values, self.n = values, len(values)
        words = -(-self.n // 64)
        if stored is None:
            coarse = (values + (1 << DROP_ROW >> 1)) >> DROP_ROW
            low = int(coarse.min())
            bits = max(1, (int(coarse.max()) - low).bit_length())
            planes = np.zeros((values.shape[1], bits, words * 64), np.uint8)
            shifted = (coarse - low).T.astype(np.uint64)
            for s in range(bits):
                planes[:, s, : self.n] = (shifted >> np.uint64(s)) & np.uint64(1)
            self.slices = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)
            self.rest = float(np.sqrt(((values - (coarse << DROP_ROW)) ** 2).sum(1).max()))
            self.norm = float(np.sqrt((values.astype(np.float64) ** 2).sum(1).max())) * (1 + 1e-9)
        else:
            raw, bits, self.rest, self.norm = stored
            self.slices = np.frombuffer(raw, np.uint64).reshape(values.shape[1], bits, words)
        self.complement = ~self.slices
        live = np.zeros(words * 64, np.uint8)
        live[: self.n] = 1
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def packed(self) -> tuple:
        return self.slices.tobytes(), self.slices.shape[1], self.rest, self.norm

    def coarse_scores(self, weight: np.ndarray) -> list[np.ndarray]:
        """Bit slices of sum |w| * y, where y is the coarse value above the block's lowest, or its complement where w < 0."""
        size, total = np.abs(weight), []
        for k in range(int(size.max()).bit_length()):
            on = (size >> k & 1).astype(bool)
            if not on.any():
                continue
            chosen = np.concatenate([self.slices[on & (weight > 0)], self.complement[on & (weight < 0)]])
            part = add_all(chosen)
            total = total + [np.zeros_like(self.live)] * max(0, k - len(total))
            total = total[:k] + (add(total[k:], part) if total[k:] else part)
        return total

    def best(self, query: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows among which the k best are (all ties included, row `skip` left out), and their exact scores."""
        weight = (query + (1 << DROP_QUERY >> 1)) >> DROP_QUERY
        rows = None
        if self.n > 4 * k and weight.any():
            slices = self.coarse_scores(weight)
            certain, open_, kth = np.zeros_like(self.live), self.live, 0
            want = k + (skip is not None)
            for s in range(len(slices) - 1, -1, -1):  # from the most significant slice downward
                both = certain | (open_ & slices[s])
                if int(np.bitwise_count(both).sum()) >= want:
                    open_ = open_ & slices[s]
                    kth |= 1 << s
                else:
                    certain, open_ = both, open_ & ~slices[s]
            unit = 1 << DROP_ROW + DROP_QUERY
            left = query - (weight << DROP_QUERY)
            bound = float(np.linalg.norm(weight << DROP_QUERY)) * self.rest + float(np.linalg.norm(left)) * self.norm
            floor = kth - int(2 * bound / unit) - 2
            if floor > 0:
                more, equal = np.zeros_like(self.live), self.live
                for s in range(max(len(slices), floor.bit_length()) - 1, -1, -1):
                    x = slices[s] if s < len(slices) else np.zeros_like(self.live)
                    if floor >> s & 1:
                        equal = equal & x
                    else:
                        more, equal = more | (equal & x), equal & ~x
                rows = np.flatnonzero(np.unpackbits((more | equal).view(np.uint8), bitorder="little"))
        if rows is None:
            rows = np.arange(self.n)
        if skip is not None:
            rows = rows[rows != skip]
        return rows, exact_scores(self.values[rows], query)


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(uid, vec_id, q): the rows that take part, with their quantised components as an array of longs."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def quantum(v):
        far = F.raise_error(F.lit("a component is too large to be quantised")).cast("bigint")
        return F.when(F.abs(v * SCALE) < float(LARGEST), F.floor(v * SCALE)).otherwise(far)

    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("vec_id"), x.alias("x")).where(F.coalesce(good, F.lit(False)))
    return rows.select("uid", "vec_id", F.transform("x", quantum).alias("q"))


def matrix(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def to_bytes(values: np.ndarray) -> bytes:
    """As the narrowest of int16, int32 and int64 that holds them all, with one byte in front that says which."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def from_bytes(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(-1, dims).astype(np.int64)


def top_k(vectors: DataFrame, queries, k: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that meets the condition `queries` (on vec_id), its k best rows by
    score, ties to the smaller id."""
    spark = vectors.sparkSession
    ship(spark)
    rows = materialise(quantised(vectors, key, vector), "quantised")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dims"), F.count_if(queries).alias("queries")).first()
    dims, blocks, chunks = max(1, facts.dims), -(-facts.n // BLOCK_ROWS) or 1, -(-facts.queries // CHUNK_QUERIES) or 1
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def by_hash(n):
        return F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[sorted(range(len(group)), key=lambda i: (pd.isna(group.vec_id.iloc[i]), group.vec_id.iloc[i]))]  # rows in order of ids
        ids = [None if pd.isna(x) else x for x in group.vec_id]
        values = matrix(group.q, dims)
        slices, bits, rest, norm = Block(values).packed()
        return pd.DataFrame({"block": [group.block.iloc[0]], "uids": [group.uid.to_numpy(np.int64).tobytes()], "ids": [ids], "data": [to_bytes(values)], "slices": [slices], "bits": [bits], "rest": [rest], "norm": [norm]})

    def collect(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [group.chunk.iloc[0]], "quids": [group.uid.to_numpy(np.int64).tobytes()], "qids": [group.vec_id.tolist()], "asked": [to_bytes(matrix(group.q, dims))]})

    index = rows.withColumn("block", by_hash(blocks)).groupBy("block").applyInPandas(build, f"block int, uids binary, ids array<{id_type}>, data binary, slices binary, bits int, rest double, norm double")
    index = materialise(index, "bit-sliced-blocks").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = rows.where(queries).withColumn("chunk", by_hash(chunks)).groupBy("chunk").applyInPandas(collect, f"chunk int, quids binary, qids array<{id_type}>, asked binary")
    asked = materialise(asked, "query-chunks").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                uids, ids = np.frombuffer(row["uids"], np.int64), row["ids"]
                block = Block(from_bytes(row["data"], dims), (row["slices"], row["bits"], row["rest"], row["norm"]))
                place = {u: n for n, u in enumerate(uids.tolist())}
                out = []
                for uid, qid, q in zip(np.frombuffer(row["quids"], np.int64).tolist(), row["qids"], from_bytes(row["asked"], dims)):
                    found, scores = block.best(q, k, place.get(uid))
                    out += [(uid, qid, ids[found[n]], int(scores[n])) for n in np.lexsort((found, -scores))[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), kinds, kinds, pa.int64()))], ["uid", "query_id", "vec_id", "score"])

    kinds = to_arrow_type(rows.schema["vec_id"].dataType)
    both = index.join(asked, ["block", "chunk"]).select("uids", "ids", "data", "slices", "bits", "rest", "norm", "quids", "qids", "asked")
    local = both.mapInArrow(search, f"uid bigint, query_id {id_type}, vec_id {id_type}, score bigint")
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_bitsliced(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP5_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
