"""The near-duplicate and boilerplate stages of the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import linededup, nearcopies
from plumbline.session import table
from tests.llm import helpers
from tests.llm.helpers import SF_DIR

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def near_copies(n):
    """n texts of 120 words: each has one word in another place changed, so that any two are 0.84 alike or more."""
    words = [f"w{i}" for i in range(120)]
    return [" ".join([*words[: 4 + 5 * k % 110], f"new{k}", *words[5 + 5 * k % 110 :]]) for k in range(n)]


def near_dedup(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "h", 0) for k, t in rows], COLUMNS)
    return sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect())


def test_stage_joins_all_near_copies(spark):
    rng = np.random.default_rng(3)
    texts = [t for g in range(12) for t in [" ".join(f"g{g}{w}" for w in x.split()) for x in near_copies(3)]]
    texts += [" ".join(f"r{i}" for i in rng.integers(0, 50_000, 80)) for _ in range(20)]
    sets = list(map(helpers.shingles, texts))
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) == 36
    root = helpers.components(pairs, list(range(len(texts))))
    assert [k for k, _ in near_dedup(spark, enumerate(texts))] == sorted(set(root.values()))


def test_crowded_anchors_are_compared_whole(spark):
    # a chain: neighbours are near copies, the ends are not
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join([*(f"x{i}" for i in range(k * 6)), *words[k * 6 :]]) for k in range(40)]
    sets = list(map(helpers.shingles, chain))
    pairs = [(a, b) for b in range(40) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = helpers.components(pairs, list(range(40)))
    assert set(root.values()) == {0}
    for limit in (4, nearcopies.LONG_RUN):
        kept, nearcopies.LONG_RUN = nearcopies.LONG_RUN, limit
        try:
            assert [k for k, _ in near_dedup(spark, enumerate(chain))] == [0]
        finally:
            nearcopies.LONG_RUN = kept


def test_codes_meet_within_one_bit():
    for v in range(256):
        for b in range(8):
            assert set(nearcopies.LISTS[v]) & set(nearcopies.LISTS[v ^ 1 << b]) - {-1}


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (3, 2)).astype(np.uint64)
    x = np.repeat(base, 20, 0)
    for i in range(60):
        for b in rng.choice(128, 12, replace=False):
            x[i, b // 64] ^= np.uint64(1 << int(b) % 64)
    a, b = nearcopies.forest(x)
    near = [(i, j) for i in range(60) for j in range(i) if int(nearcopies.distances(x[i], x[j])) <= nearcopies.NEAR_BITS]
    assert len(a) < 60 and helpers.components(list(zip(a.tolist(), b.tolist())), list(range(60))) == helpers.components(near, list(range(60)))


def test_repeated_and_null_ids_lose_no_text(spark):
    a, b = near_copies(2)
    other = " ".join(f"z{i}" for i in range(50))
    got = near_dedup(spark, [(1, a), (2, b), (2, other), (3, "short"), (3, "another short text"), (3, "short")])
    assert got == [(1, a), (2, other), (3, "another short text"), (3, "short")]
    docs = spark.createDataFrame([(None, a), (7, b), (None, other), (None, None), (None, ""), (5, "A  b"), (5, "c d")], "doc_id bigint, text string")
    rows = sorted(((r.doc_id, r.text) for r in nearcopies.one_per_group(docs).collect()), key=repr)
    assert len(rows) == 5 and {(7, b), (None, other), (5, "A  b"), (5, "c d")} <= set(rows) and rows.count((None, a)) == 0


def test_run_with_extra_and_clashing_columns(spark, tmp_path):
    table(spark, SF_DIR, "documents").limit(60).withColumn("score", F.lit("x")).withColumn("root", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF_DIR, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_small_hosts_lose_their_boilerplate(spark):
    rows = [(i, "Home | About\nbody %d" % i, "en", "small", 20) for i in range(6)] + [(9, "Home | About\nonly page", "en", "one", 22)]
    rows += [(100 + i, ("menu\n" if i < 9 else "") + "text %d" % i, "en", "mid", 10) for i in range(50)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, COLUMNS), SF_DIR).collect()}
    assert [got[i] for i in range(6)] == ["body %d" % i for i in range(6)]
    assert got[9] == "Home | About\nonly page"
    assert [got[100 + i] for i in range(50)] == ["text %d" % i for i in range(50)]


def test_settings_follow_the_number_of_classes():
    assert nearcopies.settings(1) == nearcopies.settings(3_000_000) == (13, 40)
    for n in (10**7, 10**9, 10**11):
        raw, blocks = nearcopies.settings(n)
        meets = 0.85**raw * (0.85**8 + 8 * 0.15 * 0.85**7)
        assert 2.3 * n / (16 * 2**raw) <= nearcopies.LOAD and 1 - (1 - meets) ** blocks >= nearcopies.MEETING
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, (3, nearcopies.SIMHASH_WORDS)).astype(np.uint64)
    for raw, blocks in ((13, 40), (22, 175)):
        bits = nearcopies.block_bits(raw, blocks)
        assert bits.shape == (blocks, 8 + raw) and all(len(set(b)) == 8 + raw for b in bits.tolist())
        row, anchor = nearcopies.anchors(x, raw, blocks)
        assert len(set(zip(row.tolist(), anchor.tolist()))) == len(row) and anchor.max() < (blocks << 4) << raw


def test_columns_of_its_own_are_named(spark):
    docs = spark.createDataFrame([(1, "a b c", 5)], "doc_id bigint, text string, _n int")
    with pytest.raises(ValueError, match="_n"):
        nearcopies.one_per_group(docs)


@pytest.mark.parametrize("limit", [linededup.BROADCAST_BYTES, 0])
def test_boilerplate_goes_whatever_the_columns_are_called(spark, monkeypatch, limit):
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", limit)
    rows = [(i, ("menu\n" if i % 2 else "") + f"text {i}", None if i < 40 else "big", "x", 1, 2, 3) for i in range(120)] + [(7, None, "big", "x", 1, 2, 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, bad string, _host int, host_ int, bad_ int")
    got = linededup.drop_boilerplate(docs)
    assert got.columns == [*docs.columns, "lines_dropped"] and got.count() == 122
    texts = {r.doc_id: (r.text, r.lines_dropped) for r in got.where("text is not null").collect()}
    assert texts == {i: (f"text {i}", i % 2) for i in range(120)}


def test_every_pair_at_the_threshold_is_joined(spark):
    rng = random.Random(8)

    def altered(words, k):
        words = list(words)
        for i in rng.sample(range(2, len(words) - 2), k):
            words[i] = f"x{rng.random()}"
        return words

    def near(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return 10 * len(x & y) >= 8 * len(x | y)

    texts = []
    for g in range(150):  # pairs of their own, most of them just at the threshold
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([60, 120, 240, 700]))]
        texts += [base, altered(base, len(base) // 45)]
    core = [f"core{i}" for i in range(200)]
    texts += [altered(core, 3) for _ in range(60)]  # a dense group around the threshold
    groups = helpers.components([(i, j) for i in range(len(texts)) for j in range(max(0, i - 1) if i < 300 else 300, i) if near(texts[i], texts[j])], range(len(texts)))
    want = sorted(set(groups.values()))
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    kept = nearcopies.LISTED, nearcopies.MEET
    try:
        for limits in (kept, (2, 4)):
            nearcopies.LISTED, nearcopies.MEET = limits
            assert [k for k, _ in near_dedup(spark, rows)] == want
    finally:
        nearcopies.LISTED, nearcopies.MEET = kept


def test_parity_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n, m in ((3, 3), (250, 260), (250, 300), (4000, 4300)):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 2**63, m - n // 2).astype(np.uint64)]))
        a, b = nearcopies.parity(x), nearcopies.parity(y)
        words = min(len(a), len(b))
        apart = int(np.bitwise_count(nearcopies.folded(a, words) ^ nearcopies.folded(b, words)).sum(dtype=np.int64))
        real = len(np.setxor1d(x, y))
        assert 0.8 * real <= apart <= real
