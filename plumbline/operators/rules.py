"""Declarative three-valued business rules (RL-*), evaluated for a whole table in one aggregation.

A rule is a dictionary: id, expression and optional condition, exceptions, severity, tolerance, kind. A predicate is true,
false or null; null (a missing or unparseable value) is skipped, never a violation. The rate divides violations by the
evaluated rows, excepted ones included.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import date, kinds, missing, number, rounded
from plumbline.plans.registry import query
from plumbline.session import materialise, table

SEVERITIES = ("CRITICAL", "MATERIAL", "MINOR")
LIFT, COVERAGE = 3.0, 0.5


def ineq(a: str, op: str, b, tol: float = 0.0, factor: float = 1.0, offset: float = 0.0, types: dict | None = None) -> Column:
    """a op b * factor + offset; b is a column, or '#n' or a number for a literal (RL-1)."""
    right = F.lit(float(str(b).lstrip("#"))) if not isinstance(b, str) or b.startswith("#") else number(F.col(b), (types or {}).get(b))
    left, right = number(F.col(a), (types or {}).get(a)), right * factor + offset
    ops = {">=": left >= right - tol, "<=": left <= right + tol, ">": left > right - tol, "<": left < right + tol, "==": F.abs(left - right) <= tol, "!=": F.abs(left - right) > tol}
    return ops[op]


def dateorder(earlier: str, later: str, allow_equal: bool = True, types: dict | None = None) -> Column:
    a, b = date(F.col(earlier), (types or {}).get(earlier)), date(F.col(later), (types or {}).get(later))
    return a <= b if allow_equal else a < b


def formula(operands: list, op: str, factor: float = 1.0, offset: float = 0.0, types: dict | None = None) -> Column:
    """Operands joined by one operator; a zero divisor gives null (RL-3)."""
    cols = [F.lit(float(x.lstrip("#"))) if isinstance(x, str) and x.startswith("#") else number(F.col(x), (types or {}).get(x)) for x in operands]
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / F.nullif(y, F.lit(0.0))}
    return reduce(ops[op], cols) * factor + offset


def identity(target: str, operands: list, op: str, tol: float = 0.0, factor: float = 1.0, offset: float = 0.0, types: dict | None = None) -> Column:
    return F.abs(number(F.col(target), (types or {}).get(target)) - formula(operands, op, factor, offset, types)) <= tol


def dom_range(col: str, lo=None, hi=None, types: dict | None = None) -> Column:
    x = number(F.col(col), (types or {}).get(col))
    out = x.isNotNull() | F.lit(None)
    if lo is not None:
        out = out & (x >= lo)
    return out & (x <= hi) if hi is not None else out


def dom_set(col: str, allowed: list, types: dict | None = None) -> Column:
    texts, numbers = [str(v).strip() for v in allowed], [float(v) for v in allowed if str(v).replace(".", "", 1).lstrip("-").isdigit()]
    hit = F.trim(F.col(col).cast("string")).isin(texts)
    if numbers:
        hit = hit | F.coalesce(number(F.col(col), (types or {}).get(col)).isin(numbers), F.lit(False))
    return F.when(~missing(F.col(col), (types or {}).get(col)), hit)


def presence(cols: list[str], must: str = "all", types: dict | None = None) -> Column:
    """Two-valued: all populated, or none (RL-6)."""
    return reduce(lambda a, b: a & b, [~missing(F.col(c), (types or {}).get(c)) if must == "all" else missing(F.col(c), (types or {}).get(c)) for c in cols])


def eq_cond(col: str, val, types: dict | None = None) -> Column:
    same = number(F.col(col), (types or {}).get(col)) == float(val) if isinstance(val, (int, float)) else F.trim(F.col(col).cast("string")) == str(val)
    return F.coalesce(same & ~missing(F.col(col), (types or {}).get(col)), F.lit(False))


def in_cond(col: str, vals: list, types: dict | None = None) -> Column:
    return F.coalesce(F.trim(F.col(col).cast("string")).isin([str(v) for v in vals]) & ~missing(F.col(col), (types or {}).get(col)), F.lit(False))


KINDS = {
    "ineq": ineq, "dateorder": dateorder, "identity": identity, "dom_range": dom_range, "dom_set": dom_set, "presence": presence,
    "present_number": lambda col, types=None: ~missing(F.col(col), (types or {}).get(col)), "eq_cond": eq_cond, "in_cond": in_cond,
}


def predicate(spec: dict, types: dict | None = None) -> Column:
    """A predicate of its specification, {kind: ..., parameters} (RL-10). `types` are the columns that are numbers or dates by
    their type (values.kinds); others are read as texts."""
    return KINDS[spec["kind"]](**{k: v for k, v in spec.items() if k != "kind"}, types=types)


def columns_of(spec: dict | None) -> set[str]:
    """The columns that a predicate reads."""
    if not spec:
        return set()
    own = [spec.get(k) for k in ("a", "b", "col", "earlier", "later", "target")] + list(spec.get("cols") or []) + list(spec.get("operands") or [])
    return {x for x in own if isinstance(x, str) and not x.startswith("#")}


def rule_columns(rule: dict) -> set[str]:
    return columns_of(rule["expression"]) | columns_of(rule.get("condition")) | {c for e in rule.get("exceptions") or [] for c in columns_of(e)}


def states(rule: dict, types: dict | None = None) -> tuple[Column, Column, Column]:
    """(in scope and evaluable, excepted, violating), all two-valued."""
    value = predicate(rule["expression"], types)
    scope = F.coalesce(predicate(rule["condition"], types), F.lit(False)) if rule.get("condition") else F.lit(True)
    excepted = reduce(lambda a, b: a | b, [F.coalesce(predicate(e, types), F.lit(False)) for e in rule.get("exceptions") or []], F.lit(False))
    evaluated = scope & value.isNotNull()
    return evaluated, evaluated & excepted, evaluated & ~excepted & ~F.coalesce(value, F.lit(True))


def first_match_join(left: DataFrame, right: DataFrame, on: list[str], order: str, wanted: list[str] | None = None) -> DataFrame:
    """Left join with the right side reduced to one row a key: the first by `order`, null keys dropped (JN-1). Only the `wanted`
    columns of the right side are read, where they are named."""
    rest = [c for c in right.columns if c not in on and (wanted is None or c in wanted)]
    first = right.dropna(subset=on).groupBy(*on).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return left.join(first.select(*on, *[F.col(f"_first.{c}").alias(c) for c in rest if c not in left.columns]), on, "left")


def evaluate(df: DataFrame, rules: list[dict]) -> DataFrame:
    """One row a rule: outcome PASS, VIOLATION or NOT-APPLICABLE with its reason, and the counts (RL-11)."""
    spark, types, usable, rows = df.sparkSession, kinds(df.schema), [], []
    for r in rules:
        absent = sorted(rule_columns(r) - set(df.columns))
        (rows.append((r["id"], f"column absent: {', '.join(absent)}")) if absent else usable.append(r))
    parts = []
    if usable:
        stages, aggregates = [], []
        for i, r in enumerate(usable):  # 0 out of scope, 1 not evaluable, 2 passing, 3 excepted, 4 violating: each predicate is computed once a row
            evaluated, excepted, violating = states(r, types)
            scope = F.coalesce(predicate(r["condition"], types), F.lit(False)) if r.get("condition") else F.lit(True)
            stages.append(F.when(~scope, 0).when(~evaluated, 1).when(excepted, 3).when(violating, 4).otherwise(2).alias(f"c{i}"))
            aggregates += [F.count_if(cond).alias(f"{n}{i}") for n, cond in (("s", F.col(f"c{i}") >= 1), ("n", F.col(f"c{i}") >= 2), ("e", F.col(f"c{i}") == 3), ("v", F.col(f"c{i}") == 4))]
        one = df.select(*stages).agg(*aggregates)  # one pass for all rules
        stack = ", ".join(f"'{r['id']}', '{r.get('severity', 'MINOR')}', {float(r.get('tolerance', 0))}d, s{i}, n{i}, e{i}, v{i}" for i, r in enumerate(usable))
        long = one.selectExpr(f"stack({len(usable)}, {stack}) AS (rule_id, severity, tolerance, n_scope, n_evaluated, n_excepted, n_violations)")
        rate = F.when(F.col("n_evaluated") > 0, F.col("n_violations") / F.col("n_evaluated"))
        outcome = F.when(F.col("n_evaluated") == 0, "NOT-APPLICABLE").when(rate > F.col("tolerance"), "VIOLATION").otherwise("PASS")
        reason = F.when(F.col("n_scope") == 0, "empty scope").when(F.col("n_evaluated") == 0, "nothing evaluable")
        parts.append(long.withColumns({"rate": rate, "outcome": outcome, "reason": reason}))
    if rows:
        none = spark.createDataFrame(rows, "rule_id string, reason string")
        zero = {c: F.lit(0).cast("long") for c in ("n_scope", "n_evaluated", "n_excepted", "n_violations")}
        parts.append(none.withColumns({"severity": F.lit("MINOR"), "tolerance": F.lit(0.0), **zero, "rate": F.lit(None).cast("double"), "outcome": F.lit("NOT-APPLICABLE")}))
    return reduce(DataFrame.unionByName, parts)


def bounded(df: DataFrame, by: list[str], order: list[Column | str], cap: int) -> DataFrame:
    """Up to `cap` rows of each group in an order, with their place `rn`, the group's total and whether it is cut: a report's
    sample (SL-2). Only the first rows of each sorted part are kept before groups meet."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= cap)
    totals = df.groupBy(*by).agg(F.count("*").alias("total"))
    return ranked.join(totals, by).withColumn("truncated", F.col("total") > cap)


def evidence(df: DataFrame, rules: list[dict], keys: list[str], cap: int = 5) -> DataFrame:
    """Up to `cap` violating rows a rule, by key, with the rule's total."""
    found = F.array_compact(F.array(*[F.when(states(r, kinds(df.schema))[2], F.lit(r["id"])) for r in rules]))
    return bounded(df.select(*keys, F.explode(found).alias("rule_id")), ["rule_id"], keys, cap)


def pattern(df: DataFrame, rule: dict, segment: str) -> DataFrame:
    """Per segment: scope, violations, lift; CLUSTERED if segments of lift >= 3 hold half of the violations (RL-12)."""
    evaluated, _, violating = states(rule, kinds(df.schema))
    per = df.where(F.col(segment).isNotNull()).groupBy(F.col(segment).cast("string").alias("segment")).agg(F.count_if(evaluated).alias("scope"), F.count_if(violating).alias("violations"))
    per = materialise(per, "segments")  # one row a segment, and these may be many
    whole = per.agg((F.sum("violations") / F.nullif(F.sum("scope"), F.lit(0))).alias("_rate"), F.sum("violations").alias("_all"))
    per = per.crossJoin(F.broadcast(whole)).withColumn("lift", F.when((F.col("scope") > 0) & (F.col("_rate") > 0), F.col("violations") / F.col("scope") / F.col("_rate")))
    high = per.agg(F.sum(F.when(F.col("lift") >= LIFT, F.col("violations")).otherwise(0)).alias("_high"))
    share = F.col("_high") / F.nullif(F.col("_all"), F.lit(0))
    return per.crossJoin(F.broadcast(high)).withColumn("pattern", F.when(share >= COVERAGE, "CLUSTERED").otherwise("SCATTERED")).drop("_rate", "_all", "_high")


def rollup(results: DataFrame) -> DataFrame:
    """Counts by outcome and severity with the dataset's verdict and its rate of violated rules (RL-13)."""
    total = Window.partitionBy()
    per = results.groupBy("outcome", "severity").agg(F.count("*").alias("rules"))
    bad, good = (F.sum(F.when(F.col("outcome") == o, F.col("rules")).otherwise(0)).over(total) for o in ("VIOLATION", "PASS"))
    verdict = F.when(bad > 0, "VIOLATION").when(good > 0, "PASS").otherwise("NOT-APPLICABLE")
    return per.withColumns({"verdict": verdict, "violated_rate": rounded(bad / F.nullif(bad + good, F.lit(0)))})


def ranked(results: DataFrame) -> DataFrame:
    """Violations by severity, rate and id, then passes, then the rest, numbered (SL-1)."""
    first = F.when(F.col("outcome") == "VIOLATION", 0).when(F.col("outcome") == "PASS", 1).otherwise(2)
    severity = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    order = [first, F.when(first == 0, severity).otherwise(0), F.when(first == 0, -F.col("rate")).otherwise(0.0), F.col("rule_id")]
    # one row a rule: a list that the caller wrote
    return results.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(*order)))


def from_table(rules: DataFrame, use_case: str | None = None) -> list[dict]:
    """Rules kept as rows (rule_id, spec JSON, use_cases array): those in scope of a use case (RL-14, RL-15)."""
    if use_case:
        rules = rules.where(F.array_contains("use_cases", use_case))
    return [json.loads(r.spec) for r in rules.select("spec").orderBy("rule_id").collect()]


ORDER_RULES = [
    {"id": "R1", "severity": "CRITICAL", "expression": {"kind": "dateorder", "earlier": "o_orderdate", "later": "l_shipdate"}},
    {"id": "R2", "severity": "MATERIAL", "expression": {"kind": "dom_set", "col": "l_returnflag", "allowed": ["A", "N"]}, "tolerance": 0.2},
    {"id": "R3", "severity": "MATERIAL", "expression": {"kind": "dom_range", "col": "l_discount", "lo": 0.01, "hi": 0.09}, "tolerance": 0.5},
    {"id": "R4", "severity": "MINOR", "expression": {"kind": "ineq", "a": "l_extendedprice", "op": ">=", "b": "l_quantity", "factor": 1000.0}, "exceptions": [{"kind": "in_cond", "col": "l_linestatus", "vals": ["O"]}]},
    {"id": "R5", "severity": "MINOR", "condition": {"kind": "eq_cond", "col": "o_orderstatus", "val": "F"}, "expression": {"kind": "presence", "cols": ["o_orderpriority", "l_tax"]}},
    {"id": "R6", "severity": "MINOR", "condition": {"kind": "eq_cond", "col": "o_orderstatus", "val": "X"}, "expression": {"kind": "present_number", "col": "l_tax"}},
    {"id": "R7", "severity": "CRITICAL", "expression": {"kind": "identity", "target": "l_extendedprice", "operands": ["l_quantity", "#1500"], "op": "*", "tol": 20000.0}, "tolerance": 0.9},
    {"id": "R8", "severity": "MINOR", "expression": {"kind": "present_number", "col": "no_such_column"}},
    {"id": "R9", "severity": "MINOR", "condition": {"kind": "eq_cond", "col": "o_orderstatus", "val": "O"}, "expression": {"kind": "present_number", "col": "l_tax"}},
]


def order_lines(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    wanted = sorted({c for r in ORDER_RULES for c in rule_columns(r)})
    return first_match_join(table(spark, sf_dir, "lineitem"), orders, ["l_orderkey"], "o_orderdate", wanted)


_JOINED = """j AS (SELECT l.*, o.* FROM lineitem l LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate) = 1) o ON o.o_orderkey = l.l_orderkey)"""
_STATES = f"""WITH {_JOINED},
s AS (SELECT *, o_orderdate::DATE <= l_shipdate::DATE AS p1, l_returnflag IN ('A', 'N') AS p2, l_discount BETWEEN 0.01 AND 0.09 AS p3, l_extendedprice >= l_quantity * 1000 AS p4,
      (o_orderpriority IS NOT NULL AND l_tax IS NOT NULL) AS p5, l_tax IS NOT NULL AS p6, abs(l_extendedprice - l_quantity * 1500) <= 20000 AS p7 FROM j),
u AS (SELECT 'R1' AS rule_id, 'CRITICAL' AS severity, 0.0::DOUBLE AS tolerance, true AS sc, p1 AS p, false AS ex, * FROM s
 UNION ALL SELECT 'R2', 'MATERIAL', 0.2, true, p2, false, * FROM s UNION ALL SELECT 'R3', 'MATERIAL', 0.5, true, p3, false, * FROM s
 UNION ALL SELECT 'R4', 'MINOR', 0, true, p4, l_linestatus = 'O', * FROM s UNION ALL SELECT 'R5', 'MINOR', 0, o_orderstatus = 'F', p5, false, * FROM s
 UNION ALL SELECT 'R6', 'MINOR', 0, o_orderstatus = 'X', p6, false, * FROM s UNION ALL SELECT 'R7', 'CRITICAL', 0.9, true, p7, false, * FROM s UNION ALL SELECT 'R9', 'MINOR', 0, o_orderstatus = 'O', p6, false, * FROM s)"""
_RESULTS = f"""{_STATES},
a AS (SELECT rule_id, severity, tolerance, count(*) FILTER (WHERE sc) AS n_scope, count(*) FILTER (WHERE sc AND p IS NOT NULL) AS n_evaluated,
      count(*) FILTER (WHERE sc AND p IS NOT NULL AND ex) AS n_excepted, count(*) FILTER (WHERE sc AND NOT p AND NOT ex) AS n_violations FROM u GROUP BY ALL
      UNION ALL SELECT 'R8', 'MINOR', 0, 0, 0, 0, 0),
r AS (SELECT *, CASE WHEN n_evaluated > 0 THEN n_violations / n_evaluated END AS rate0,
      CASE WHEN n_evaluated = 0 THEN 'NOT-APPLICABLE' WHEN n_violations / n_evaluated > tolerance THEN 'VIOLATION' ELSE 'PASS' END AS outcome,
      CASE WHEN rule_id = 'R8' THEN 'column absent: no_such_column' WHEN n_scope = 0 THEN 'empty scope' WHEN n_evaluated = 0 THEN 'nothing evaluable' END AS reason FROM a)"""


@query("rules_order_lines", f"{_RESULTS} SELECT rule_id, severity, tolerance, n_scope, n_evaluated, n_excepted, n_violations, round(rate0, 6) AS rate, outcome, reason FROM r")
def rules_order_lines(spark, sf_dir):
    return evaluate(order_lines(spark, sf_dir), ORDER_RULES).withColumn("rate", rounded(F.col("rate")))


@query("rules_ranked", f"""{_RESULTS} SELECT rule_id, outcome, row_number() OVER (ORDER BY CASE outcome WHEN 'VIOLATION' THEN 0 WHEN 'PASS' THEN 1 ELSE 2 END,
 CASE WHEN outcome = 'VIOLATION' THEN CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'MATERIAL' THEN 2 ELSE 3 END ELSE 0 END, CASE WHEN outcome = 'VIOLATION' THEN -rate0 ELSE 0 END, rule_id)::INTEGER AS position FROM r""")
def rules_ranked(spark, sf_dir):
    return ranked(evaluate(order_lines(spark, sf_dir), ORDER_RULES)).select("rule_id", "outcome", "position")


@query("rules_rollup", f"""{_RESULTS}, g AS (SELECT outcome, severity, count(*) AS rules FROM r GROUP BY ALL)
 SELECT *, 'VIOLATION' AS verdict, round((SELECT sum(rules) FROM g WHERE outcome = 'VIOLATION') / (SELECT sum(rules) FROM g WHERE outcome <> 'NOT-APPLICABLE'), 6) AS violated_rate FROM g""")
def rules_rollup(spark, sf_dir):
    return rollup(evaluate(order_lines(spark, sf_dir), ORDER_RULES))


@query("rules_evidence", f"""{_STATES}, v AS (SELECT rule_id, l_orderkey, l_linenumber, l_partkey FROM u WHERE rule_id IN ('R1', 'R2', 'R4') AND sc AND NOT p AND NOT ex)
 SELECT rule_id, l_orderkey, l_linenumber, l_partkey, rn::INTEGER AS rn, total, total > 5 AS truncated FROM (
 SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn, count(*) OVER (PARTITION BY rule_id) AS total FROM v) WHERE rn <= 5""")
def rules_evidence(spark, sf_dir):
    return evidence(order_lines(spark, sf_dir), [ORDER_RULES[i] for i in (0, 1, 3)], ["l_orderkey", "l_linenumber", "l_partkey"])


@query("rules_pattern", f"""{_STATES}, g AS (SELECT l_shipdate, o_orderpriority AS segment, count(*) AS scope, count(*) FILTER (WHERE NOT p) AS violations FROM u WHERE rule_id = 'R2' AND o_orderpriority IS NOT NULL GROUP BY ALL),
 k AS (SELECT segment, sum(scope)::BIGINT AS scope, sum(violations)::BIGINT AS violations FROM g GROUP BY segment),
 f AS (SELECT *, (violations / scope) / (sum(violations) OVER () / sum(scope) OVER ()) AS lift0 FROM k)
 SELECT segment, scope, violations, round(lift0, 6) AS lift, CASE WHEN (SELECT coalesce(sum(violations) FILTER (WHERE lift0 >= 3), 0) / sum(violations) FROM f) >= 0.5 THEN 'CLUSTERED' ELSE 'SCATTERED' END AS pattern FROM f""")
def rules_pattern(spark, sf_dir):
    return pattern(order_lines(spark, sf_dir), ORDER_RULES[1], "o_orderpriority").withColumn("lift", rounded(F.col("lift")))


@query("rules_label_consistency", """WITH j AS (SELECT l.*, d.n_chars, d.lang FROM labels l JOIN documents d USING (doc_id))
 SELECT 'L1' AS rule_id, count(*) AS n_evaluated, count(*) FILTER (WHERE toxic NOT IN (0, 1)) AS n_violations FROM j
 UNION ALL SELECT 'L2', count(*) FILTER (WHERE quality = 1), count(*) FILTER (WHERE quality = 1 AND NOT n_chars >= 200) FROM j
 UNION ALL SELECT 'L3', count(*), count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr')) FROM j""")
def rules_label_consistency(spark, sf_dir):
    """Rules on label fields, tolerance 0 (RL-16)."""
    rules = [
        {"id": "L1", "expression": {"kind": "dom_set", "col": "toxic", "allowed": [0, 1]}},
        {"id": "L2", "condition": {"kind": "eq_cond", "col": "quality", "val": 1}, "expression": {"kind": "ineq", "a": "n_chars", "op": ">=", "b": "#200"}},
        {"id": "L3", "expression": {"kind": "dom_set", "col": "lang", "allowed": ["en", "de", "fr"]}},
    ]
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return evaluate(df, rules).select("rule_id", "n_evaluated", "n_violations")


@query("rules_in_scope", f"""{_RESULTS} SELECT rule_id, n_scope, n_violations, outcome FROM r WHERE rule_id IN ('R2', 'R3', 'R9')""")
def rules_in_scope(spark, sf_dir):
    """Rules kept as rows of a table, of which those of one use case run."""
    cases = {"R2": ["pricing"], "R3": ["pricing", "audit"], "R4": ["audit"], "R7": [], "R9": ["pricing"]}
    rows = [(r["id"], json.dumps(r), cases[r["id"]]) for r in ORDER_RULES if r["id"] in cases]
    wanted = from_table(spark.createDataFrame(rows, "rule_id string, spec string, use_cases array<string>"), "pricing")
    return evaluate(order_lines(spark, sf_dir), wanted).select("rule_id", "n_scope", "n_violations", "outcome")


@query("rules_bounded", """SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS total, count(*) OVER (PARTITION BY o_orderpriority) > 12 AS truncated FROM orders QUALIFY rn <= 12""")
def rules_bounded(spark, sf_dir):
    """The dearest orders of each priority, with how many there are."""
    df = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return bounded(df, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 12)
