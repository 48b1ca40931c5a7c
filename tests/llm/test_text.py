"""Operators 2, 6, 7 and 8."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import licenses, linededup, toxicity
from plumbline.llm.textdensity import Page, extract, main_text
from plumbline.session import table
from tests.llm.helpers import ROWS, SF_DIR, documents, empty
from tests.oracle import connect, differences

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="content"><h2>Title &amp; more</h2><p>First   paragraph with quite a lot of text to count, and <a href=q>a link</a> in it.
<p>Second &nbsp; paragraph, <b>bolder<br>than</b> the first.</p><ul><li>one<li>two</ul></div><div class="ad">Buy!</div>
<section class="comments"><p>A long reader comment that is as dense as the article itself, or more so.</p></section>
<form><label>Mail</label></form><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n\n") == ["Title & more", "First paragraph with quite a lot of text to count, and a link in it.", "Second paragraph, bolder than the first.", "one", "two"]


def test_layout_names_do_not_hide_the_article():
    page = '<body><div class="page-with-sidebar layout"><div id="menu-wrap header"><article class="post no-comments"><h1>Head</h1><p>Body text.</p></article></div><div class="sidebar"><p>Side text</p></div><div class="comments"><article class="comment"><p>Nice.</p></article></div></div></body>'
    assert main_text(page) == "Head\n\nBody text."


@pytest.mark.parametrize(("source", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<script>x", ""), ("<body><nav>x</nav>", ""), ("<article><h1>H</h1><p>b &lt;c&gt;</article>", "H\n\nb <c>")])
def test_main_text_edge_cases(source, text):
    assert main_text(source) == text


UNNAMED = (
    "<body><div>" + "".join(f"<p><a href=x{i}>link number {i}</a></p>" for i in range(12)) + "</div><div>"
    + "".join(f"<p>Paragraph {i} " + "goes on for quite a number of words " * 6 + "</p>" for i in range(4)) + "<p>Short end.</p></div><div>Copyright</div></body>"
)


def test_density_decides_where_no_name_tells(monkeypatch):
    got = main_text(UNNAMED)
    assert got.startswith("Paragraph 0") and got.endswith("Short end.") and "link" not in got and "Copyright" not in got
    plain = Page.densities
    for changed in (lambda d: [1 / x if x else 0.0 for x in d], lambda d: [1.0 if x else 0.0 for x in d]):
        monkeypatch.setattr(Page, "densities", lambda self, changed=changed: changed(plain(self)))
        assert main_text(UNNAMED) != got


def random_tree(rng, depth=0):
    kind = rng.choice(["div", "p", "a", "b"]) if depth < 4 else "b"
    inside = ["w" * rng.randint(1, 9) if rng.random() < 0.6 or depth >= 4 or kind == "p" else random_tree(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return (kind, inside)


def source_of(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(source_of, node[1]))}</{node[0]}>"


def counts(node):
    """Characters, tags, characters in links and link tags below a node, by definition."""
    c = t = lc = lt = 0
    for x in node[1]:
        if isinstance(x, str):
            c += len(x)
        else:
            a, b, d, e = counts(x)
            c, t = c + a, t + 1 + b
            lc, lt = (lc + a, lt + 1 + b) if x[0] == "a" else (lc + d, lt + e)
    return c, t, lc, lt


def test_densities_by_definition():
    rng = random.Random(6)
    for _ in range(300):
        root = ("html", [("body", [random_tree(rng) for _ in range(rng.randint(1, 4))])])
        page = Page("".join(map(source_of, root[1])))
        got, nodes = page.densities(), []

        def walk(node):
            nodes.append(node)
            for x in node[1]:
                if not isinstance(x, str):
                    walk(x)

        walk(root)
        assert [n[0] for n in nodes] == page.tag
        c0, _, lc0, _ = counts(root)
        for n, d in zip(nodes, got):
            c, t, lc, lt = counts(n)
            if n[0] == "a":  # a link's own characters and tags are link characters and tags
                lc, lt = c, t
            if not c:
                assert d == 0
                continue
            t = max(1, t)
            base = math.log(c / max(1, c - lc) * lc + lc0 / max(1, c0) * c + math.e)
            top = math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1e-9)
            assert abs(d - c / t * max(0.0, top / (math.log(base + 1e-9) if base > math.e else 1.0))) < 1e-9


@pytest.mark.parametrize("source", ["<a " * 350_000, "<div>" * 50_000 + "x", "<div>" * 50_000 + "x" + "</b>" * 50_000, '<p class="x>' * 80_000, "<title>" * 100_000, '<div class="ad"><article>' * 20_000 + "t", "<b><table>" + "<i>" * 50_000 + "</b>" * 50_000])
def test_broken_pages_take_linear_time(source):
    began = time.perf_counter()
    main_text(source)
    assert time.perf_counter() - began < 4


def test_parts_set_apart():
    page = "<body><p>One lonely paragraph of the article, long enough to be read.</p><section id=commentList><p>A reader says so, at length, again and again and again.</p></section><footer>F</footer></body>"
    assert main_text(page) == "One lonely paragraph of the article, long enough to be read."
    assert main_text("<body><div class=comments><p>Only comments here.</p></div></body>") == ""


def test_extract_drops_source_and_counts(spark):
    df = spark.createDataFrame([(1, "u", "<p>é🙂", "clash"), (2, None, None, None)], "page_id bigint, url string, html string, n_chars string")
    got = {r.page_id: r for r in extract(df).collect()}
    assert got[1].text == "é🙂" and got[1].n_chars == 2 and got[2].text == "" and "html" not in extract(df).columns


def test_licenses_edge_cases(spark):
    got = {(r.doc_id, r.template): r.containment for r in licenses.scan(documents(spark)).collect()}
    assert got == {(8, "mit-line"): 1.0}
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(documents(spark), {}).count() == 0


def test_long_license_in_long_text(spark):
    notice = licenses.TEMPLATES["mit-permission"]
    broken = notice.replace("merge", "blend")
    text = " ".join(f"w{i}" for i in range(3000)) + " " + broken + " " + " ".join(f"v{i}" for i in range(3000))
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.template) for r in got] == [(1, "mit-permission")] and 0.8 <= got[0].containment < 1


def test_every_template_is_found_in_a_longer_text(spark):
    filler = " ".join(f"w{i}" for i in range(700))
    rows = [(k, f"{filler} {v} {filler}") for k, v in sorted(licenses.TEMPLATES.items())]
    got = {(r.doc_id, r.template): r.containment for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(got[k, k] == 1.0 for k, _ in rows)


@pytest.mark.parametrize("name", ["op4_sharding", "op5_bitsliced", "op6_licenses", "op8_linededup"])
def test_query_against_sql(spark, name):
    from plumbline.llm.queries import ORACLE_SQL, QUERIES

    assert not differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE_SQL[name])


def test_linededup_edge_cases(spark):
    rows = [(i, "home\nbody %d\n\n home" % i, "h", 5, i) for i in range(20)] + [(100, None, "h", None, 0), (101, "home", None, 4, 0), (102, "only home\nhome", "h", 14, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, lines_dropped bigint")
    got = {r.doc_id: r for r in linededup.drop_boilerplate(df).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "body 3\n" and got[3].n_chars == 7 and got[3].lines_dropped == 2
    assert got[100].text is None and got[101].text == "home" and got[102].text == "only home"
    assert linededup.drop_boilerplate(empty(spark)).count() == 0
    assert linededup.drop_boilerplate(documents(spark)).count() == len(ROWS)


def test_toxicity_held_out(spark):
    """Above the recall (0.866) and near the precision (0.988) of the same regression on the annotations themselves."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    hit, said = scored.toxic == 1, scored.predicted == 1
    assert (hit == said).mean() > 0.98 and (hit & said).sum() / said.sum() > 0.96 and (hit & said).sum() / hit.sum() > 0.9


def test_label_model_finds_planted_voters():
    rng = np.random.default_rng(8)
    truth = rng.random(6000) < 0.2
    rates = [(0.8, 0.02), (0.6, 0.05), (0.7, 0.1), (0.5, 0.01), (0.3, 0.2), (0.9, 0.15)]
    votes = np.stack([np.where(truth, rng.random(6000) < one, rng.random(6000) < zero) for one, zero in rates], 1).astype(float)
    twins = np.concatenate([votes, votes[:, 4:5], votes[:, 4:5], votes[:, 4:5]], 1)  # a weak voter, four times
    for v in (votes, twins):
        posterior, report = toxicity.label_model(v, votes[:, 0])
        assert abs(report["prior"] - 0.2) < 0.03
        for k, (one, zero) in enumerate(rates):
            assert abs(report["hit1"][k] - one) < 0.06 and abs(report["hit0"][k] - zero) < 0.04
        # the exact posterior under the planted rates, row by row
        exact = np.array([0.2 * np.prod([o if x else 1 - o for x, (o, _) in zip(row, rates)]) for row in votes[:500]])
        other = np.array([0.8 * np.prod([z if x else 1 - z for x, (_, z) in zip(row, rates)]) for row in votes[:500]])
        assert np.mean((posterior[:500] >= 0.5) == (exact >= other)) > 0.97
    assert report["correlation"][4, 6] > 0.9


def test_scores_by_definition(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    model = toxicity.train(docs, labels)
    names = {h: i for h, i in model.lexicon.index.items()}
    for r in toxicity.score(docs, model).join(docs, "doc_id").collect():
        words = re.findall(r"[^\W_]+", (r.text or "").lower())
        hit = [[names[h] for h in (zlib.crc32(f.encode()) for f in [w, *(w[:k] + "-" for k in range(3, 7) if len(w) > k)]) if h in names] for w in words]
        found = {i for own in hit for i in own}
        share = sum(map(bool, hit)) / max(20, len(words)) if len(found) >= 2 else 0
        z = model.intercept + sum(model.weights[i] for i in found) + np.dot(model.other_weights, [*toxicity.patterns(r.text or ""), *(share >= t for t in toxicity.SHARES_ALL)])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_repeated_ids_are_learned_from_once(spark):
    docs = table(spark, SF_DIR, "documents")
    labels = table(spark, SF_DIR, "labels")
    once, often = toxicity.train(docs, labels), toxicity.train(docs.unionByName(docs).unionByName(docs), labels)
    assert once.lexicon.index == often.lexicon.index and abs(once.intercept - often.intercept) < 1e-9


def test_toxicity_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.score(documents(spark), toxicity.train(documents(spark), none)).collect()
    assert len(got) == len(ROWS) and all(r.score == 0 and r.predicted == 0 for r in got)
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (6, None)], "doc_id bigint, toxic int")
    model = toxicity.train(documents(spark), one)
    assert model.constant is not None
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.without_toxic(documents(spark), none).columns == documents(spark).columns


def test_held_out_fold(spark):
    got = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
