"""Roles of rules and of panels resolved to columns by names, descriptions and values (MT-4, MT-6). Roles, synonyms and columns
are catalogues; of the data only counts are read, one pass a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import missing, number, rounded
from plumbline.operators.matching import sequence_ratio
from plumbline.plans.registry import query
from plumbline.session import ship, table

#: Scores of the rungs, the graded ones with their ends, least ratio, floor, least share of numbers, values of flags.
EXACT, SYNONYM, DESCRIBED, WORDS = 1.00, 0.92, 0.88, 0.80
RATIO_FLOOR, RATIO_LOW, RATIO_SPAN = 0.80, 0.55, 0.20
OVERLAP_LOW, OVERLAP_SPAN = 0.35, 0.25
RESOLVED, NUMERIC = 0.70, 0.6
FLAGS = ("0", "1", "0.0", "1.0", "True", "False")
#: Roles of panels by saved metadata, by words of names, and their scores.
PERIOD_ROLES, PERIOD_DICTIONARY, PERIOD_WORDS, DATE_CLASSES = ("period", "date"), ("period", "date", "reporting_period"), ("period", "month", "quarter", "year", "date"), ("date", "datetime", "timestamp")
KEY_ROLES, ENTITY_WORDS, KEY_WORDS, ENTITY_NAMES = ("identifier", "primary_key", "business_key"), ("facility", "account", "loan", "contract", "customer", "obligor"), ("id", "key", "number", "no"), ("facility", "facility_id", "account_id", "loan_id", "contract_id")
SEGMENT_DICTIONARY = ("segment", "portfolio_segment")


def canonical(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(canonical(c), " "), ""))


def evidence(df: DataFrame, name: str, position: int = 0) -> DataFrame:
    """(table, column, place, known, numbers, others): of every column the values that are there, those that are numbers, and those
    that no flag has; one pass over the table."""
    each = []
    for c in df.columns:
        known = ~missing(F.col(c))
        text = F.initcap(F.col(c).cast("string")) if df.schema[c].dataType.typeName() == "boolean" else F.col(c).cast("string")
        each += [F.count_if(known).alias(f"k_{c}"), F.count_if(known & number(F.col(c)).isNotNull()).alias(f"n_{c}"), F.count_if(known & ~text.isin(*FLAGS)).alias(f"o_{c}")]
    rows = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(position * 100_000 + i).alias("place"), F.col(f"k_{c}").alias("known"), F.col(f"n_{c}").alias("numbers"), F.col(f"o_{c}").alias("others")) for i, c in enumerate(df.columns)])
    return df.agg(*each).select(rows.alias("r")).select(F.inline("r"))


def rungs(roles: DataFrame, columns: DataFrame) -> DataFrame:
    """(role, table, column, place, score, rung) of every role (role, dtype, synonyms) and column (evidence() with a description, or
    null): the highest of the rungs, or 0 where the values refuse the role's type. A role's own name is one of its synonyms."""
    ship(roles.sparkSession)
    phrases = roles.select("role", "dtype", F.explode(F.array_union(F.array("role"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("phrase"))
    pairs = phrases.crossJoin(F.broadcast(columns))  # catalogues: names of roles beside names of columns
    name, said, told = canonical(F.col("column")), canonical(F.col("phrase")), canonical(F.col("description"))
    own, theirs = words(F.col("column")), words(F.col("phrase"))
    shared = F.size(F.array_intersect(own, theirs)) / F.size(F.array_union(own, theirs))
    tried = pairs.withColumn("ratio", sequence_ratio(name, said))
    found = F.greatest(
        F.struct(F.when(name == canonical(F.col("role")), EXACT).otherwise(0.0).alias("score"), F.lit("name").alias("rung")),
        F.struct(F.when(name == said, SYNONYM).otherwise(0.0).alias("score"), F.lit("synonym").alias("rung")),
        F.struct(F.when((told != "") & (said != "") & F.contains(told, said), DESCRIBED).otherwise(0.0).alias("score"), F.lit("description").alias("rung")),
        F.struct(F.when((F.size(theirs) > 0) & (F.size(F.array_except(theirs, own)) == 0), WORDS).otherwise(0.0).alias("score"), F.lit("all words").alias("rung")),
        F.struct(F.when(F.col("ratio") >= RATIO_FLOOR, RATIO_LOW + RATIO_SPAN * (F.col("ratio") - RATIO_FLOOR) / (1 - RATIO_FLOOR)).otherwise(0.0).alias("score"), F.lit("likeness").alias("rung")),
        F.struct(F.when((F.size(own) > 0) & (F.size(theirs) > 0) & (shared > 0), OVERLAP_LOW + OVERLAP_SPAN * shared).otherwise(0.0).alias("score"), F.lit("some words").alias("rung")),
    )
    best = tried.groupBy("role", "dtype", "table", "column", "place", "known", "numbers", "others").agg(F.max(found).alias("best"))
    numeric = F.col("dtype").isin("number", "flag") & (F.col("numbers") < NUMERIC * F.col("known"))
    veto = F.coalesce((F.col("known") > 0) & (numeric | ((F.col("dtype") == "flag") & (F.col("others") > 0))), F.lit(False))
    return best.select("role", "table", "column", "place", F.when(veto, 0.0).otherwise(F.round("best.score", 3)).alias("score"), F.when(veto, "refused").when(F.col("best.score") == 0, "none").otherwise(F.col("best.rung")).alias("rung"))


def resolve(roles: DataFrame, columns: DataFrame, overrides: Mapping[str, str] | None = None, floor: float = RESOLVED) -> DataFrame:
    """(role, table, column, score, rung, via): each role's best column, the first in the tables' order among equals; unresolved with
    its score below the floor. An override, "table.column" or a column of the first table that has it, always wins."""
    scored = rungs(roles, columns)
    best = scored.groupBy("role").agg(F.max_by(F.struct("table", "column", "score", "rung"), F.struct("score", -F.col("place"))).alias("b"))
    weak = F.col("b.score") < floor
    auto = best.select("role", F.when(~weak, F.col("b.table")).alias("table"), F.when(~weak, F.col("b.column")).alias("column"), F.col("b.score").alias("score"), F.col("b.rung").alias("rung"), F.when(weak, "unresolved").otherwise("auto").alias("via"))
    given = {r: s for r, s in (overrides or {}).items() if s}
    if not given:
        return auto
    listed = roles.sparkSession.createDataFrame([(r, *(s.split(".", 1) if "." in s else (None, s))) for r, s in given.items()], "role string, given_table string, given_column string")
    first = columns.groupBy("column").agg(F.min_by("table", "place").alias("first_table"))
    fixed = listed.join(first, F.col("given_column") == F.col("column"), "left").select("role", F.coalesce("given_table", "first_table").alias("table"), F.col("given_column").alias("column"), F.lit(1.0).alias("score"), F.lit("override").alias("rung"), F.lit("override").alias("via"))
    named = roles.select("role").distinct()
    return auto.join(listed, "role", "left_anti").unionByName(fixed.join(named, "role", "left_semi"))


def panel_scores(inventory: DataFrame, configured_period: str | None = None) -> DataFrame:
    """(role, table, column, score) of the columns (table, column, role, dictionary_role, classification) that may be a panel's
    period, facility or segment: by what was chosen or saved, then by name, then by type (MT-6)."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    saved, dictionary, kind = low("role"), low("dictionary_role"), low("classification")
    own = words(F.col("column"))
    has = lambda names: F.arrays_overlap(own, F.array(*map(F.lit, names)))
    chosen = F.col("column") == F.lit(configured_period) if configured_period else F.lit(False)
    period = F.when(chosen, 1.0).when(saved.isin(*PERIOD_ROLES) | dictionary.isin(*PERIOD_DICTIONARY), 0.95).when(has(PERIOD_WORDS), 0.78).when(kind.isin(*DATE_CLASSES), 0.70).otherwise(0.0)
    facility = F.when(saved.isin(*KEY_ROLES) | dictionary.isin(*KEY_ROLES, "facility_id"), 0.95).when(has(ENTITY_WORDS) & has(KEY_WORDS), 0.84).when(F.lower("column").isin(*ENTITY_NAMES), 0.82).otherwise(0.0)
    segment = F.when((saved == "segment") | dictionary.isin(*SEGMENT_DICTIONARY), 0.95).when(has(("segment",)), 0.80).otherwise(0.0)
    each = F.array(*[F.struct(F.lit(n).alias("for_role"), s.alias("score")) for n, s in (("period", period), ("facility_id", facility), ("segment", segment))])
    return inventory.select("table", "column", F.inline(each)).where("score > 0").select(F.col("for_role").alias("role"), "table", "column", "score")


def panel_binding(inventory: DataFrame, configured_period: str | None = None) -> DataFrame:
    """(role, table, column, score) of the chosen table: the one of the highest sum of its best period and best facility scores, then
    of the higher of their lower ones, then of the last name; in it each role takes the best column that no role before took."""
    scores = panel_scores(inventory, configured_period)
    best = scores.groupBy("table", "role").agg(F.max("score").alias("s"))
    at = lambda r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("s"))), F.lit(0.0))
    per = inventory.select("table").distinct().join(best, "table", "left").groupBy("table").agg(at("period").alias("p"), at("facility_id").alias("f"))
    chosen = per.agg(F.max_by("table", F.struct(F.round(F.col("p") + F.col("f"), 9), F.least("p", "f"), "table")).alias("table"))
    own = scores.join(chosen, "table").orderBy(F.desc("score"), "column").collect()  # columns of one table
    taken: list[tuple] = []
    for role in ("period", "facility_id", "segment"):
        found = next((r for r in own if r.role == role and r.column not in {t[2] for t in taken}), None)
        if found:
            taken.append((role, found.table, found.column, found.score))
    return inventory.sparkSession.createDataFrame(taken, "role string, table string, column string, score double")


TABLES = ("orders", "customer")
_ROLES = [
    ("o_orderdate", None, []), ("order_date", "date", ["o_orderdate"]), ("buyer_group", None, ["marketing segment"]), ("priority", None, ["orderpriority"]), ("paid", "flag", ["o_orderstatus"]),
    ("balance", "number", ["acctbal"]), ("quite unlike", None, []), ("held", None, ["o_custkey"]),
]
_COLUMNS = [("orders", "o_orderkey"), ("orders", "o_custkey"), ("orders", "o_orderstatus"), ("orders", "o_totalprice"), ("orders", "o_orderdate"), ("orders", "o_orderpriority"), ("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_nationkey"), ("customer", "c_acctbal"), ("customer", "c_mktsegment")]
_DESCRIPTIONS = {("customer", "c_mktsegment"): "Marketing segment of the customer."}


def catalogue(spark, sf_dir, names: Sequence[str] = TABLES, descriptions: Mapping[tuple[str, str], str] | None = None) -> DataFrame:
    """Evidence of whole tables, with descriptions."""
    found = reduce(DataFrame.unionByName, [evidence(table(spark, sf_dir, t), t, i) for i, t in enumerate(names)])
    text = F.lit(None).cast("string")
    for (t, c), d in (descriptions or {}).items():
        text = F.when((F.col("table") == t) & (F.col("column") == c), d).otherwise(text)
    return found.withColumn("description", text)


_CANON = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("matching_roles", f"""WITH r(role, dtype, synonyms) AS (VALUES {', '.join(f"('{r}', {repr(d) if d else 'NULL'}, {[r, *s]})" for r, d, s in _ROLES)}),
 counted AS ({' UNION ALL '.join(f"SELECT '{t}' AS t, '{c}' AS c, count({c}) AS known, count(TRY_CAST({c}::VARCHAR AS DOUBLE)) AS numbers, count({c}) FILTER (WHERE {c}::VARCHAR NOT IN ('0', '1', '0.0', '1.0', 'True', 'False')) AS others FROM {t}" for t, c in _COLUMNS)}),
 c AS (SELECT table_name AS t, column_name AS c, (CASE WHEN table_name = 'orders' THEN 0 ELSE 100 END) + column_index AS place, CASE WHEN column_name = 'c_mktsegment' THEN 'Marketing segment of the customer.' ELSE '' END AS told FROM duckdb_columns() WHERE table_name IN ('orders', 'customer')),
 p AS (SELECT role, dtype, t, c, place, {_CANON.format('c')} AS name, {_CANON.format('told')} AS told, {_CANON.format('role')} AS own, {_CANON.format('unnest(synonyms)')} AS said FROM r, c),
 w AS (SELECT *, string_split(name, ' ') AS cw, string_split(said, ' ') AS sw FROM p),
 s AS (SELECT role, dtype, t, c, place, max(greatest(CASE WHEN name = own THEN 1.0 ELSE 0 END, CASE WHEN name = said THEN 0.92 ELSE 0 END, CASE WHEN told <> '' AND contains(told, said) THEN 0.88 ELSE 0 END, CASE WHEN list_has_all(cw, sw) THEN 0.8 ELSE 0 END,
   CASE WHEN list_has_any(cw, sw) THEN 0.35 + 0.25 * len(list_intersect(cw, sw)) / len(list_distinct(list_concat(cw, sw))) ELSE 0 END)) AS score FROM w GROUP BY ALL),
 v AS (SELECT s.*, CASE WHEN (dtype IN ('number', 'flag') AND numbers < 0.6 * known) OR (dtype = 'flag' AND others > 0) THEN 0 ELSE round(score, 3) END AS final FROM s LEFT JOIN counted USING (t, c)),
 b AS (SELECT role, arg_max(t, (final, -place)) AS t, arg_max(c, (final, -place)) AS c, max(final) AS score FROM v WHERE role <> 'held' GROUP BY 1)
 SELECT role, CASE WHEN score >= 0.7 THEN t END AS "table", CASE WHEN score >= 0.7 THEN c END AS "column", score::DOUBLE AS score, CASE WHEN score >= 0.7 THEN 'auto' ELSE 'unresolved' END AS via FROM b
 UNION ALL SELECT 'held', 'customer', 'c_custkey', 1.0, 'override' FROM c WHERE c = 'c_custkey'""")
def matching_roles(spark, sf_dir):
    """All rungs but likeness (which no role here reaches first), values that refuse a type, and an override."""
    roles = spark.createDataFrame(_ROLES, "role string, dtype string, synonyms array<string>")
    return resolve(roles, catalogue(spark, sf_dir, descriptions=_DESCRIPTIONS), {"held": "c_custkey"}).drop("rung")


@query("matching_panel", """WITH n AS (SELECT count(o_orderdate) AS dated FROM orders), c AS (SELECT table_name AS t, CASE column_name WHEN 'o_custkey' THEN 'customer_no' WHEN 'c_custkey' THEN 'customer_key' WHEN 'c_mktsegment' THEN 'market_segment' ELSE column_name END AS c, CASE WHEN data_type LIKE 'TIMESTAMP%' AND dated > 0 THEN 'datetime' ELSE 'other' END AS kind FROM duckdb_columns(), n WHERE table_name IN ('orders', 'customer')),
 w AS (SELECT *, string_split(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g'), ' ') AS w FROM c),
 s AS (SELECT t, c, unnest(['period', 'facility_id', 'segment']) AS role, unnest([CASE WHEN list_has_any(w, ['period', 'month', 'quarter', 'year', 'date']) THEN 0.78 WHEN kind = 'datetime' THEN 0.7 ELSE 0 END, CASE WHEN list_has_any(w, ['facility', 'account', 'loan', 'contract', 'customer', 'obligor']) AND list_has_any(w, ['id', 'key', 'number', 'no']) THEN 0.84 ELSE 0 END, CASE WHEN list_contains(w, 'segment') THEN 0.8 ELSE 0 END]) AS score FROM w)
 SELECT role, t AS "table", c AS "column", score::DOUBLE AS score FROM s WHERE score > 0""")
def matching_panel(spark, sf_dir):
    """Columns of two tables under names of panels."""
    from plumbline.operators.matching import column_types

    named = {"o_custkey": "customer_no", "c_custkey": "customer_key", "c_mktsegment": "market_segment"}
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("column")), F.col("column"))
    none = F.lit(None).cast("string")
    inventory = column_types(spark, sf_dir).select("table", name.alias("column"), none.alias("role"), none.alias("dictionary_role"), F.col("logical_type").alias("classification"))
    return panel_scores(inventory).withColumn("score", rounded(F.col("score")))
