"""Roles resolved to columns."""

import difflib
import random
import re

import pytest

from plumbline.operators import rolescores as rs


def canon(s):
    return re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).strip()


def by_hand(role, dtype, synonyms, column, told, known, numbers, others):
    name, best = canon(column), 0.0
    for s in {role, *synonyms}:
        said, cw, sw = canon(s), set(canon(column).split()), set(canon(s).split())
        best = max(best, 1.0 if name == canon(role) else 0, 0.92 if name == said else 0, 0.88 if told and said and said in canon(told) else 0, 0.8 if sw and sw <= cw else 0)
        ratio = difflib.SequenceMatcher(None, name, said).ratio()
        best = max(best, 0.55 + 0.2 * (ratio - 0.8) / 0.2 if ratio >= 0.8 else 0, 0.35 + 0.25 * len(cw & sw) / len(cw | sw) if cw & sw else 0)
    if known and (dtype in ("number", "flag") and numbers < 0.6 * known or dtype == "flag" and others):
        return 0.0
    return round(best, 3)


def test_ladder_by_hand(spark):
    rng = random.Random(4)
    parts = ["Loan", "balance", "exposure", "at", "Default", "flag", "amt", "id", "date", "x1"]
    name = lambda: rng.choice(["_", " ", ""]).join(rng.sample(parts, rng.randint(1, 3)))
    roles = [(f"{name()}{i}" if i % 3 else name(), rng.choice([None, "number", "flag", "date"]), [name() for _ in range(rng.randint(0, 3))]) for i in range(25)]
    roles = list({r[0]: r for r in roles}.values())
    columns = [("t", c, i, rng.choice([0, 10, 100]), rng.choice([0, 6, 59, 60, 100]), rng.choice([0, 0, 5]), rng.choice([None, "", f"holds the {name()} of it"])) for i, c in enumerate({name() for _ in range(40)})]
    frame = spark.createDataFrame(columns, "table string, column string, place int, known bigint, numbers bigint, others bigint, description string")
    got = {(r.role, r.column): r.score for r in rs.rungs(spark.createDataFrame(roles, "role string, dtype string, synonyms array<string>"), frame).collect()}
    assert len(got) == len(roles) * len(columns)
    for role, dtype, synonyms in roles:
        for _, c, _, known, numbers, others, told in columns:
            assert abs(got[role, c] - by_hand(role, dtype, synonyms, c, told, known, numbers, others)) < 0.00101, (role, synonyms, c, told)  # ties of the third digit


def test_best_columns_floor_and_overrides(spark):
    columns = spark.createDataFrame([("a", "amount", 0, 10, 10, 10, None), ("b", "amount", 1, 10, 10, 10, None), ("b", "note", 2, 10, 0, 10, None), ("b", "paid", 3, 10, 10, 0, None)], "table string, column string, place int, known bigint, numbers bigint, others bigint, description string")
    roles = spark.createDataFrame([("amount", "number", None), ("note", "number", None), ("paid", "flag", []), ("far", None, ["away"]), ("moved", None, []), ("bare", None, [])], "role string, dtype string, synonyms array<string>")
    got = {r.role: (r.table, r.column, r.score, r.via) for r in rs.resolve(roles, columns, {"moved": "b.note", "bare": "paid", "other": "a.amount", "amount": ""}).collect()}
    assert got == {"amount": ("a", "amount", 1.0, "auto"), "note": (None, None, 0.0, "unresolved"), "paid": ("b", "paid", 1.0, "auto"), "far": (None, None, 0.0, "unresolved"), "moved": ("b", "note", 1.0, "override"), "bare": ("b", "paid", 1.0, "override")}


def test_evidence_of_values(spark):
    df = spark.createDataFrame([("1", True, 1.5), ("x", False, None), (None, None, float("nan")), ("n/a", True, 0.0)], "a string, b boolean, c double")
    got = {r.column: (r.known, r.numbers, r.others, r.place) for r in rs.evidence(df, "t", 2).collect()}
    assert got == {"a": (2, 1, 1, 200000), "b": (3, 0, 0, 200001), "c": (2, 2, 1, 200002)}


@pytest.mark.parametrize("configured", [None, "opened"])
def test_panels(spark, configured):
    rows = [("p", "report_month", None, None, "text"), ("p", "loan_id", None, None, "text"), ("p", "market_segment", None, None, "text"), ("p", "opened", None, None, "datetime"), ("q", "as_of", "period", None, "text"), ("q", "k", None, "business_key", "text"), ("q", "s", "segment", None, "text"), ("r", "facility", None, None, "text"), ("r", "when", None, None, "date")]
    inventory = spark.createDataFrame(rows, "table string, column string, role string, dictionary_role string, classification string")
    scores = {(r.role, r.column): r.score for r in rs.panel_scores(inventory, configured).collect()}
    want = {("period", "report_month"): 0.78, ("period", "opened"): 1.0 if configured else 0.70, ("period", "as_of"): 0.95, ("period", "when"): 0.70, ("facility_id", "loan_id"): 0.84, ("facility_id", "k"): 0.95, ("facility_id", "facility"): 0.82, ("segment", "market_segment"): 0.80, ("segment", "s"): 0.95}
    assert scores == want
    assert [(r.role, r.table, r.column) for r in rs.panel_binding(inventory, configured).collect()] == [("period", "q", "as_of"), ("facility_id", "q", "k"), ("segment", "q", "s")]
    assert [(r.role, r.column) for r in rs.panel_binding(inventory.where("table <> 'q'"), configured).collect()] == [("period", configured or "report_month"), ("facility_id", "loan_id"), ("segment", "market_segment")]
