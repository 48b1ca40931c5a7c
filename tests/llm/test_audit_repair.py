"""Operators 11, 12 and 13."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import conversationrepair as cr
from plumbline.llm import decontamination as dc
from plumbline.llm import filteraudit as fa
from tests.llm import helpers
from tests.llm.helpers import documents, empty
from tests.oracle import connect, differences

LABELS = "doc_id bigint, quality int, toxic int, part string"


def test_intervals_are_the_steps_of_all_orders():
    for n in (1, 3, 5):
        orders = list(itertools.permutations(range(n)))
        assert [fa.rank(o, n) for o in orders] == list(range(len(orders)))
        found = {(m, r): s for m, s, a, b in fa.intervals(n) for r in range(a, b)}
        assert sum(b - a for _, _, a, b in fa.intervals(n)) == len(found) == ((1 << n) - 1) * len(orders)
        assert all(found[m, r] == next(k for k, f in enumerate(o, 1) if m >> f & 1) for m in range(1, 1 << n) for r, o in enumerate(orders))


def audit_by_hand(rows):
    """rows: (part, set of failed filters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order, 1):
                gone, before = [r for r in left if f in r[1]], len(left)
                left = [r for r in left if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                out[part, order, k] = [before - len(gone), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    totals = {}
    for (part, order, k), v in out.items():
        totals[part, order[k - 1]] = totals.get((part, order[k - 1]), 0) + v[1]
    return {key: (*v, totals[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_against_every_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["", "en", "x"]), {f for f in "ABCDE" if rng.random() < 0.4}, rng.random() < 0.3, rng.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame([(p, *(f in s for f in "ABCDE"), g or None, t) for p, s, g, t in rows], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    assert audited(fa.audit(df)) == audit_by_hand(rows)
    with pytest.raises(ValueError):
        fa.audit(df, "ABCDEFGH")


def test_flags_of_awkward_rows(spark, tmp_path):
    long = " ".join(f"w{i % 150}" for i in range(250))
    rows = [(7, long, "en"), (5, long, "en"), (5, long, "en"), (None, long, None), (None, None, None), (3, None, ""), (8, "", "de"), (9, "A B $\x1f C", "de"), (10, "X" * 3 + "y" * 97, "fr"), (11, "X" * 4 + "y" * 96, "fr"), (12, "a a a", "fr")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, part string, good int").repartition(3)
    labels = spark.createDataFrame([(7, 1, 0, "p"), (7, 0, 1, "p"), (5, None, None, "p"), (None, 1, 1, "p"), (99, 1, 1, "p")], LABELS)
    got = sorted(((r.doc_id, r.part, "".join(f for f in "ABCDE" if r[f]), bool(r.good), bool(r.toxic)) for r in fa.filter_flags(docs, labels).collect()), key=str)
    want = [(7, "en", "E", True, True), (5, "en", "", False, False), (5, "en", "", False, False), (None, "", "", False, False), (None, "", "A", False, False), (3, "", "A", False, False), (8, "de", "AE", False, False)]
    want += [(9, "de", "ACD", False, False), (10, "fr", "A", False, False), (11, "fr", "AC", False, False), (12, "fr", "AB", False, False)]
    assert got == sorted(want, key=str)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = connect(str(tmp_path / "none"))
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert not differences(fa.op11_filteraudit(spark, str(tmp_path)), con, fa.OP11_SQL)


def test_audit_of_nothing(spark):
    docs = documents(spark)
    assert fa.audit(fa.filter_flags(empty(spark), spark.createDataFrame([], LABELS))).count() == 0
    assert fa.audit(fa.filter_flags(docs, spark.createDataFrame([], LABELS))).count() == 600 * 4


def best_repair(rows):
    """All edits tried. rows: (role, text, fault)."""
    best = None

    def tried(k, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows):
            for n in range(3):
                for more in itertools.product(["user", "assistant"], repeat=n):
                    full = lines + [(r, "") for r in more]
                    if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in full)):
                        found = cost + 3 * n, audit + "I" * n, "\n".join(f"{r}:{t}" for r, t in full)
                        best = found if best is None else min(best, found)
            return
        role, text, fault = rows[k]
        for n in range(3):
            for more in itertools.product(["user", "assistant"], repeat=n):
                now = lines + [(r, "") for r in more]
                tried(k + 1, cost + 3 * n + 4, audit + "I" * n + "D", now)
                if fault not in (1, 2):
                    kept = 3 * (fault == 3) + cost + 3 * n
                    tried(k + 1, kept, audit + "I" * n + "K", [*now, (role, text)])
                    for x in ("user", "assistant"):
                        tried(k + 1, kept + 3, audit + "I" * n + "R", [*now, (x, text)])

    tried(0, 0, "", [])
    return best


def repaired_by_class(rows):
    r = cr.Repair()
    for role, text, fault in rows:
        r.row(role, text.encode(), fault)
    return r.end()


def test_repair_is_the_best_of_all_edits():
    rng = random.Random(2)
    for _ in range(150):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), f"t{k}", rng.choice([0, 0, 0, 1, 2, 3])) for k in range(rng.randint(0, 4))]
        cost, audit, text = best_repair(rows)
        assert repaired_by_class(rows) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def test_long_conversations_go_by_blocks(monkeypatch):
    rng = random.Random(3)
    for n in (64, 65, 128, 500):
        rows = [(rng.choice(["system", "user", "assistant"]), f"t{k}", rng.choice([0, 0, 1, 2, 3])) for k in range(n)]
        # by strings, over nodes of rows and roles
        nodes = {0: (0, "", "")}
        for role, text, fault in rows:
            found = {}
            for state, (cost, audit, lines) in nodes.items():
                for extra in cr.INSERTED[state]:
                    at, now = state, lines
                    for x in extra:
                        now += ("\n" if now else "") + cr.NAMES[x] + ":"
                        at = x
                    c, a = cost + 3 * len(extra), audit + "I" * len(extra)
                    ways = [(at, c + 4, a + "D", now)]
                    if fault not in (1, 2):
                        start = now + ("\n" if now else "")
                        ways += [(x, c + (3 if fault == 3 else 0), a + "K", f"{start}{role}:{text}") for x in cr.FOLLOWS[at] if cr.INITIALS.get(role[:1]) == x]
                        ways += [(x, c + (6 if fault == 3 else 3), a + "R", f"{start}{cr.NAMES[x]}:{text}") for x in cr.FOLLOWS[at] if x in cr.NAMES]
                    for to, *way in ways:
                        found[to] = min(found.get(to, (1 << 60, "", "")), tuple(way))
            nodes = found
        ends = [(c + 3 * len(e), a + "I" * len(e), t + "".join(("\n" if t or i else "") + cr.NAMES[x] + ":" for i, x in enumerate(e))) for s, (c, a, t) in nodes.items() for e in cr.INSERTED[s] if (e[-1] if e else s) in (0, 3)]
        cost, audit, text = min(ends)
        assert repaired_by_class(rows) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


CONVERSATIONS = [
    (1, 0, "system", "Be good."), (1, 1, "user", "Hi?"), (1, 3, "assistant", "No end"), (1, None, "user", "First!"), (2, 0, None, None), (2, 0, "user", "x."), (2, 0, "user", "x."), (2, 7, "user", "x."),
    (None, None, "assistant", "y?"), (None, 2, "user", ""), (3, 5, "", "No role."), (3, 6, "tool", " "), (3, 9, "user", "long " * 50_000 + "."), (4, 1, "user", " \n"),
    *((50, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(200)), *((c, 0, "user", "Same everywhere.") for c in range(100, 160)),
]
CONV = "conv_id bigint, turn bigint, role string, text string"


def conversations(spark):
    return spark.createDataFrame(CONVERSATIONS, CONV).withColumn("fault", F.lit("x")).withColumn("gone", F.lit(1)).repartition(3)


def test_repair_against_sql(spark, tmp_path):
    conversations(spark).write.parquet(f"{tmp_path}/conversations.parquet")
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = cr.op12_conversations(spark, str(tmp_path))
    assert not differences(df, con, cr.OP12_SQL)
    assert df.count() == len({c[0] for c in CONVERSATIONS})


def test_repaired_rows_are_those_of_the_digest(spark):
    rows = cr.damage(conversations(spark))
    lines = {}
    for r in sorted(cr.repaired(rows).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(lines[r.conv_id]) and (r.edit != "I" or (r.text == "" and r.turn is None))
    for r in cr.repair(rows).collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in lines.get(r.conv_id, [])))


def test_repair_of_nothing_and_of_text_keys(spark):
    none = spark.createDataFrame([], CONV)
    assert cr.repair(cr.damage(none)).count() == 0 and cr.repaired(cr.damage(none)).count() == 0
    named = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Hi."), ("b", 0, "user", "x")], "conv_id string, turn int, role string, text string").withColumn("gone", F.col("conv_id") == "b")
    got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in cr.repair(named).collect()}
    assert got == {"a": (0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Hi.").hexdigest()), "b": (0, "", hashlib.sha256(b"").hexdigest())}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def search_by_hand(text, items):
    w, hit, found = words_of(text), set(), set()
    for item, t in items:
        b = words_of(t)
        n = min(10, len(b))
        for p in {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == p:
                    hit.update(range(k, k + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def search_case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "the", "Zoë", "été", "x9", "7", "日本"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 14, 40]) if k % 5 else 12)) for k in range(30)] + [(None, text(12)), (5, text(11)), (50, None), (51, "--- ,"), (52, "")]
    items = [(k, t) for k, t in items if len(words_of(t)) not in (1, 2)] + [(90, "unique"), (91, "two unique")]
    docs = [(k, text(rng.randint(0, 60)) + (" " + (rng.choice(items)[1] or "") + " " + text(5)) * (k % 2)) for k in range(60)]
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "this is unique and TWO-UNIQUE!"), (103, "uniqueness twounique"), (104, docs[1][1]), (104, docs[1][1])]
    return docs, items


@pytest.mark.parametrize("group_bytes", [dc.GROUP_BYTES, 400])
def test_search_against_all_places(spark, group_bytes):
    docs, items = search_case(4)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_words", F.lit("x")).withColumn("key", F.lit(1)).repartition(4)
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit("x"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.digests(dc.contamination(d, b, group_bytes)).collect()), key=str)
    assert got == sorted(((i, *search_by_hand(t, items)) for i, t in docs), key=str)
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)


def test_long_texts_are_searched_in_parts(monkeypatch):
    docs, items = search_case(6)
    whole = "\n".join(t or "" for _, t in docs)
    patterns = dc.Patterns([(str(k), b" ".join(dc.words(t.encode()))) for k, t in items if words_of(t)])
    want = patterns.search(whole.encode())
    for size in (1, 7, 50, 1000):
        monkeypatch.setattr(dc.parts, "__defaults__", (size,))
        assert patterns.search(whole.encode()) == want
    assert dc.words("Ab9-ÉÀ_[]`{}é\x00\x7f~".encode()) == [b"ab9", "ÉÀ".encode(), "é".encode()]


def test_pieces_of_long_items_overlap(spark, monkeypatch):
    monkeypatch.setattr(dc, "PIECE", 3)
    text = " ".join(f"w{k}" for k in range(25))
    cut = [r.words.decode().split(" ") for r in dc.pieces(spark.createDataFrame([(1, text), (2, "a b"), (3, None)], "item_id bigint, text string")).collect()]
    assert ["a", "b"] in cut and {tuple(c[k : k + 10]) for c in cut if len(c) > 2 for k in range(len(c) - 9)} == {tuple(text.split()[k : k + 10]) for k in range(16)}


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.contamination(empty(spark), none).count() == 0
    rows = dc.digests(dc.contamination(documents(spark), none)).collect()
    assert len(rows) == len(helpers.ROWS) and not any(r.contaminated for r in rows) and {r.items_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
