"""Operators 1 and 3 against brute force."""

import hashlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash, spotsigs
from plumbline.llm.components import components
from plumbline.session import table
from tests.llm import helpers
from tests.llm.helpers import ROWS, SF_DIR, documents, empty


def test_fingerprints_by_definition(spark):
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(documents(spark)).collect()}
    for r in ROWS:
        assert got[r[0]] == helpers.fingerprint(r[1])


def test_groups_on_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    want = helpers.near_groups([(r.doc_id, r.text) for r in docs.collect()])
    got = simhash.near_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_groups_edge_cases(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(documents(spark)).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (9, 9)} <= got
    assert simhash.near_groups(empty(spark)).count() == 0


def test_every_near_pair_meets_at_an_anchor(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**63), 2**63, 2000, dtype=np.int64)
    y = x.view(np.uint64).copy()
    for i in range(len(y)):
        for b in rng.choice(64, 3, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    y = y.view(np.int64)
    fps = spark.createDataFrame([(int(v),) for v in np.concatenate([x, y])], "fp bigint")
    got = {frozenset((r.a, r.b)) for r in simhash.near_links(fps).collect()}
    assert all(frozenset(p) in got for p in zip(x.tolist(), y.tolist()))
    assert simhash.anchored(fps).groupBy("fp").count().agg(F.max("count")).first()[0] <= 32


def test_dense_anchor_gives_few_links_and_one_component():
    base = np.uint64(0x0123456789ABCDEF)
    near = np.array([base] + [base ^ np.uint64(1 << a) for a in range(60)] + [base ^ np.uint64(1 << a | 1 << (a + 1)) for a in range(60)], np.uint64)
    links = simhash.spanning(near)
    assert sum(len(a) for a, _ in links) == len(near) - 1


def test_crowded_anchors_lose_no_link(spark):
    base = 0x0123456789ABCDEF
    near = [base] + [base ^ 1 << a for a in range(60)] + [base ^ (1 << a | 1 << a + 1) for a in range(60)] + [base ^ 0xFFFF << 8 ^ 7 << a for a in range(0, 60, 7)]
    want = helpers.components([(a, b) for n, a in enumerate(near) for b in near[:n] if (a ^ b).bit_count() <= 3], near)
    kept, simhash.LONG_RUN = simhash.LONG_RUN, 4
    try:
        links = [(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(v,) for v in near], "fp bigint")).collect()]
    finally:
        simhash.LONG_RUN = kept
    assert helpers.components(links, near) == want


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_edited_likeness(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    got = {r.doc_id: r for r in spotsigs.edited_likeness(docs).collect()}
    sign = spotsigs.Signer(" ".join(spotsigs.ANCHORS))
    assert len(got) == len(rows)
    for i, (k, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = set(sign(text).tolist()), set(sign(edited).tolist()), set(sign(after).tolist())
        r = got[k]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == spotsigs.shown(sign(text)) and r.edited_fingerprint == spotsigs.shown(sign(edited))
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 1e-12
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1)) < 1e-12


def chains(text):
    """Signatures by words, with their number: an anchor and the next two content words after it."""
    words = [t.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¿¡") for t in text.lower().split()]
    words = [w for w in words if w]
    common = set(spotsigs.ANCHORS)
    found = Counter()
    for i, w in enumerate(words):
        if w in common or xxhash.xxh64_intdigest(w.encode()) % 8 == 0:
            after = [x for x in words[i + 1 : i + 400] if x not in common][:2]
            if len(after) == 2:
                found[w, *after] += 1
    return found or Counter([text.lower().split() and " ".join(text.lower().split())] if text.split() else [])


def test_likeness_is_that_of_chains_of_words(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in spotsigs.edited_likeness(docs).collect()}
    for i, (k, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        a, b, c = chains(text), chains(text[: len(text) - half] + after[:half]), chains(after)
        for value, other in ((got[k].near_edited, b), (got[k].near_next, c)):
            assert abs(value - ((a & other).total() / (a | other).total() if a or other else 1)) < 1e-6, k
    words = "the cat sat on a mat in the house of cards"
    assert ("the", "cat", "sat") in chains(words) and ("in", "house", "cards") in chains(words)


def test_edited_likeness_edge_cases(spark):
    got = spotsigs.edited_likeness(documents(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1
    assert by[3].fingerprint == by[4].fingerprint == ""
    last = by[9]
    assert last.n_chars == 19
    assert spotsigs.edited_likeness(empty(spark)).count() == 0
    one = spotsigs.edited_likeness(documents(spark).where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def linked_by_brute_force(rows, threshold=0.8):
    """(key, class, copies, links) of every row, all pairs compared."""
    sign = spotsigs.Signer(" ".join(spotsigs.ANCHORS))
    sets = [(k, frozenset(sign(t).tolist())) for k, t in rows]
    keys = {s: [k for k, x in sets if x == s] for _, s in sets}
    links = {s: sum(o != s and bool(s) and bool(o) and len(o & s) >= threshold * len(o | s) for o in keys) for s in keys}
    return sorted((repr(k), min((x for x in keys[s] if x is not None), default=None), len(keys[s]), links[s]) for k, s in sets)


def linked(docs):
    return sorted((repr(r.doc_id), r.class_id, r.copies, r.links) for r in spotsigs.near_classes(docs).collect())


def test_length_partitioned_links(spark):
    docs = table(spark, SF_DIR, "documents")
    want = linked_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert linked(docs) == want and any(x[3] for x in want) and any(x[2] > 1 for x in want)


def test_links_of_dense_near_copies(spark):
    body = [f"the word{i} of thing{i % 37}" for i in range(60)]
    rows = [(k, " ".join([*body[: k + 1], "the new", f"item{k}", *body[k + 1 :]]) if k % 5 else " ".join(body)) for k in range(40)]
    want = linked_by_brute_force(rows)
    assert linked(spark.createDataFrame(rows, "doc_id bigint, text string")) == want and max(x[3] for x in want) > 20


def test_links_edge_cases(spark):
    assert linked(documents(spark)) == linked_by_brute_force([(r[0], r[1]) for r in ROWS])
    assert spotsigs.near_classes(empty(spark)).count() == 0
