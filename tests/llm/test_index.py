"""Operators 4 and 5 on awkward tables, and the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bitsliced, sharding, toxicity
from plumbline.session import materialise, table
from tests.llm import helpers
from tests.llm.helpers import SF_DIR, documents, empty


def test_bit_sliced_best_is_exact():
    rng = np.random.default_rng(1)
    for n in (1, 4, 65, 700):
        v = np.floor(256 * rng.normal(size=(n, 16)) / 4).astype(np.int64)
        v[: n // 3] = v[0]  # many ties
        block = bitsliced.Block(v)
        for q in range(min(n, 12)):
            rows, scores = block.best(v[q], 5, q)
            exact = v @ v[q]
            want = sorted((i for i in range(n) if i != q), key=lambda i: (-exact[i], i))[:5]
            assert [int(rows[i]) for i in np.lexsort((rows, -scores))[:5]] == want


def brute_top(rows, k=5):
    """By definition, in Python's integers; rows are (id, components)."""
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for n, (i, v) in enumerate(q):
        if i is not None and i % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for m, (j, w) in enumerate(q) if m != n]
            out |= {(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])}
    return out


def test_bit_sliced_edge_cases(spark):
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.001, -0.001]), (None, [1.0, 1.0]), (None, [1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, score string, rank int")
    got = {tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute_top([(i, v) for i, v in rows])
    assert bitsliced.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [1e7, 0.0]), (1, [1e7, 0.0]), (2, [9e6, 5.0]), (3, [-1e7, 3.0])] + [(i, [float(i), -float(i)]) for i in range(10, 60)]
    got = {tuple(r) for r in bitsliced.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()}
    assert got == brute_top(rows) and (0, 1, 1, 6553600000000000000) in got
    for far in (1e9, 1e300):  # a score, a component too large for a long
        with pytest.raises(Exception, match="does not fit a long|too large"):
            bitsliced.top_k(spark.createDataFrame([(0, [far]), (1, [far]), (2, [far])], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()


def test_many_blocks_and_chunks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3]) for i in range(900)]
    kept = bitsliced.BLOCK_ROWS, bitsliced.CHUNK_QUERIES
    bitsliced.BLOCK_ROWS, bitsliced.CHUNK_QUERIES = 200, 5
    try:
        got = {tuple(r) for r in bitsliced.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()}
    finally:
        bitsliced.BLOCK_ROWS, bitsliced.CHUNK_QUERIES = kept
    assert got == brute_top(rows)


def test_sharding_edge_cases(spark):
    got = sharding.shards(documents(spark), limit=64).collect()
    assert len(got) == len(helpers.ROWS)
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r)
    for shard, own in sizes.items():
        assert sum(r.n_bytes for r in own) == own[0].shard_bytes and len(own) == own[0].shard_rows and len(shard) == own[0].depth
        assert own[0].fits == (own[0].shard_bytes <= 64)
        assert own[0].fits or len(own) == 1
    assert sharding.shards(empty(spark)).count() == 0
    assert {r.shard for r in sharding.shards(documents(spark), limit=1 << 30).collect()} == {""}


def test_a_hot_key_is_split(spark):
    df = spark.range(400).selectExpr("if(id < 300, 7, id) AS doc_id", "repeat('x', 10) AS text", "'clash' AS shard")
    got = sharding.shards(df, limit=100).collect()
    assert len(got) == 400 and all(r.fits for r in got)
    names = sorted({r.shard for r in got})
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))  # a prefix code: every row has one place


def test_pipeline_against_brute_force(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    model = toxicity.train(docs, labels)
    scorer = toxicity.Scorer(model)
    rows = [r for r in docs.collect() if scorer(r.text) < 0.5]
    pages, lines = {}, {}
    for r in rows:
        pages[r.source] = pages.get(r.source, 0) + 1
        for x in {x.strip(" ") for x in r.text.split("\n")} - {""}:
            lines[r.source, x] = lines.get((r.source, x), 0) + 1
    bad = {k for k, n in lines.items() if n / pages[k[0]] > 0.05 and n >= 2}
    texts = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad) for r in rows}
    sets = {i: helpers.shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    groups = helpers.components([(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], ids)
    kept = {i for i in texts if groups[i] == i}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = materialise(stage(spark, now, SF_DIR), name)
        if name != "packing":
            assert now.columns == docs.columns
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == kept
    assert now.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in now.select("doc_id", "doc_tokens").distinct().collect())


def test_pipeline_edge_cases(spark):
    df = documents(spark)
    out = df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF_DIR)
    assert out.count() > 0
    out = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF_DIR)
    assert out.count() == 0
