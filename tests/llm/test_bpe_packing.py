"""Operators 10 and 9 against the tokenizers library and an exact round trip."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.bpe import ByteBpe, Digester, Merger, decode, default_vocabulary, digests, encode
from plumbline.llm.packing import BITS, DIRECTIONS, HASHED, LENGTH, SPREAD, TokenBytes, cells, curve_keys, hilbert_key, pack, tokenised
from tests.llm.helpers import ROWS, documents, empty

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(default_vocabulary())


def odd_texts():
    random.seed(3)
    letters = "ab c \n\t'sé1,. x 　"
    return ["", " ", "\n ", "a \nb", "x\x85 y", "aaaa" * 3000, "a<|endoftext|>b <|endoftext|>", "don't  I'll", *["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(400)]]


def test_ids_and_round_trip(reference):
    texts = odd_texts() + [r[1] or "" for r in ROWS]
    bpe = ByteBpe(default_vocabulary())
    for text, (n, ids_sha, shown_sha) in zip(texts, Digester(default_vocabulary())(texts)):
        ids = reference.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == text
        assert n == len(ids)
        assert ids_sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert shown_sha == hashlib.sha256(text.encode()).hexdigest()


def test_segment_tree_merges_leftmost_lowest_rank():
    pairs = {(1, 1): (1, 2), (2, 2): (0, 3), (2, 1): (2, 4)}
    assert Merger(pairs)([1] * 5) == [3, 1]
    assert Merger(pairs)([1] * 3) == [4]
    assert Merger(pairs)([]) == []


def test_digests_edge_cases(spark, reference):
    got = digests(documents(spark)).collect()
    assert len(got) == len(ROWS)
    assert digests(empty(spark)).count() == 0
    null = next(r for r in got if r.doc_id == 3)
    assert null.n_tokens == 0 and null.ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_encode_decode_columns(spark):
    back = decode(encode(documents(spark).select("doc_id", "text"))).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_hilbert_curve_visits_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    key = hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_pack(spark, reference):
    rows = pack(documents(spark)).collect()
    ids = {}
    for r in ROWS:
        ids[r[0]] = np.array(reference.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
    total = sum(len(ids[r[0]]) for r in ROWS)
    assert sum(r.length for r in rows) == total
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(-(-total // LENGTH)))
    for k, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == LENGTH or k == max(sequences)
    assert pack(empty(spark)).count() == 0


def test_pack_covers_repeated_rows(spark):
    df = documents(spark).where(F.col("doc_id") == 9)
    assert sum(r.length for r in pack(df).collect()) == 2 * pack(df.limit(1)).first().doc_tokens


def test_long_white_space_and_long_texts(spark, reference):
    texts = [" " * 1_000_000, "\n\t " * 150_000, "word " * 60_000, ("é🙂 " * 200 + "x" * 5_000) * 20]
    got = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert len(got) == 4 and all(r.n == r.m for r in got)
    bpe = ByteBpe(default_vocabulary())
    for r in got:
        assert r.m == len(bpe.encode(texts[r.doc_id])) + 1
    assert bpe.encode(texts[2]) == reference.encode(texts[2], add_special_tokens=False).ids


def test_order_follows_likeness_and_not_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = tokenised(docs, default_vocabulary(), "doc_id", "text").cache()
    keys = sorted((r.curve_key, r.doc_id) for r in curve_keys(rows).collect())
    ids = {r.doc_id: frozenset(np.frombuffer(r.ids, np.uint16).tolist()) for r in rows.collect()}
    at = [ids[d] for _, d in keys]

    def like(pairs):
        return np.mean([len(a & b) / len(a | b) for a, b in pairs])

    shuffled = np.random.default_rng(1).permutation(len(at))
    assert like(zip(at, at[1:])) > 1.5 * like(zip(at, [at[i] for i in shuffled]))
    vectors = np.array([r.vector for r in rows.select("vector").collect()], float)
    c = cells(vectors, vectors.mean(0))
    assert ((c == 0) | (c == (1 << BITS) - 1)).any(1).mean() < 0.01


def test_keys_of_the_curve_by_definition(spark):
    """The stream is in the order of the curve's keys, computed here document by document."""
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tok = TokenBytes(default_vocabulary())
    vectors = np.array([[np.mean([tok.signs[i][d] for i in np.frombuffer(tok(t) + b"\0\0", np.uint16)]) for d in range(HASHED)] for _, t in rows])
    off = vectors - vectors.mean(0)
    at = (off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)) @ DIRECTIONS * HASHED**0.5
    want = {}
    for (k, _), c in zip(rows, at):
        cell = [int(min(max((x + SPREAD) * 2**BITS / (2 * SPREAD), 0), 2**BITS - 1)) for x in c]
        want.setdefault(k, set()).add(int(hilbert_key(np.array([cell]))[0]) >> 24)
    got = {}
    for r in curve_keys(tokenised(docs, default_vocabulary(), "doc_id", "text")).collect():
        got.setdefault(r.doc_id, set()).add(r.curve_key >> 24)  # up to rounding of the vectors
    assert sum(got[k] == want[k] for k in want) >= len(want) - 1
