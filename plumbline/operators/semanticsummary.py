"""Summaries of value semantics: fields, rules, groups, outcomes, overlaps, populated cells that do not apply, unexamined fields, and
the dataset's verdict (VS-10). All are sums over the ledger and the resolved tags; no cell without an assessment is made."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import rounded
from plumbline.operators.semantics import ledger, resolve
from plumbline.plans.registry import query
from plumbline.session import materialise, table

TAGS = {"CENSORED": "censored", "STALE_FROZEN": "stale_frozen", "NOT_APPLICABLE": "not_applicable"}


def with_unscoped(assessments: DataFrame, key: Sequence[str], unscoped: Sequence[tuple[str, str]]) -> DataFrame:
    """The ledger with a row, without a key, for each (variable, entry) that could not be routed."""
    if not unscoped:
        return assessments
    rows = assessments.sparkSession.createDataFrame([(v, e) for v, e in unscoped], "variable string, entry string")
    return assessments.unionByName(rows.withColumn("status", F.lit("UNSCOPED")), allowMissingColumns=True)


def fields(columns: Sequence[str], rows: int, assessments: DataFrame, tags: DataFrame, key: Sequence[str], bindings: Mapping[str, Sequence[str]], targets: Sequence[str]) -> DataFrame:
    """One row a column: its roles, assessed and tagged cells, tags by kind, cells without a tag, unclassified and unscoped assessments, the
    share of tagged cells, and whether it was examined. `bindings` are roles by column, `targets` the roles that entries aim at.
    A cell that several entries assess counts once."""
    spark = assessments.sparkSession
    there = F.col(key[0]).isNotNull()
    cells = assessments.where(there).groupBy("variable", *key).agg(F.count_if(F.col("status") == "UNCLASSIFIED").alias("unclassified"))
    assessed = cells.groupBy("variable").agg(F.count("*").alias("assessed_cells"), F.sum("unclassified").alias("unclassified"))
    unscoped = assessments.groupBy("variable").agg(F.count_if(F.col("status") == "UNSCOPED").alias("unscoped"))
    tagged = tags.groupBy("variable").agg(F.count("*").alias("tagged_cells"), *(F.count_if(F.col("tag") == t).alias(n) for t, n in TAGS.items()))
    named = [(i, c, ";".join(bindings.get(c, ())), c in bindings, bool(set(bindings.get(c, ())) & set(targets))) for i, c in enumerate(columns)]
    catalogue = spark.createDataFrame(named, "position int, variable string, roles string, bound boolean, targeted boolean")
    one = catalogue.join(assessed, "variable", "left").join(unscoped, "variable", "left").join(tagged, "variable", "left").na.fill(0)
    examined = F.when(~F.col("bound"), "NO_SEMANTIC_ROLE").when(~F.col("targeted"), "NO_RULE_ENTRY").when(F.col("assessed_cells") > 0, "ASSESSED").otherwise("UNSCOPED")
    return one.select(
        "variable", "roles", F.lit(rows).cast("bigint").alias("total_rows"), "assessed_cells", "tagged_cells", *TAGS.values(), F.greatest(F.lit(0), F.col("assessed_cells") - F.col("tagged_cells")).alias("no_tag_cells"),
        F.col("unclassified").alias("unclassified_assessments"), F.col("unscoped").alias("unscoped_entries"), (F.col("tagged_cells") / F.nullif(F.col("assessed_cells"), F.lit(0))).alias("tag_rate"), examined.alias("examination"),
    )


def rules(assessments: DataFrame, key: Sequence[str]) -> DataFrame:
    """(entry, variable, assessments, tagged, no_tag, unclassified, unscoped, tag_rate)."""
    count = lambda s: F.count_if(F.col("status") == s)
    per = assessments.groupBy("entry", "variable").agg(F.count_if(F.col(key[0]).isNotNull()).alias("assessments"), count("APPLIED_TAG").alias("tagged"), count("NO_TAG").alias("no_tag"), count("UNCLASSIFIED").alias("unclassified"), count("UNSCOPED").alias("unscoped"))
    return per.withColumn("tag_rate", F.col("tagged") / F.nullif(F.col("assessments"), F.lit(0)))


def groups(found: DataFrame) -> DataFrame:
    """(entry, variable, ...) of group assessments (entry, variable, assessed, tagged, outcome): candidates, assessed, tagged and too
    small groups, and the share assessed."""
    per = found.groupBy("entry", "variable").agg(F.count("*").alias("candidate_groups"), F.count_if("assessed").alias("assessed_groups"), F.count_if("tagged").alias("tagged_groups"), F.count_if(F.col("outcome") == "BELOW_MINIMUM").alias("below_minimum_groups"))
    return per.withColumn("assessed_group_share", F.col("assessed_groups") / F.col("candidate_groups"))


def outcomes(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy("variable", "entry", "status").agg(F.count("*").alias("count"))


def overlaps(tags: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells with several claims: the winning tag and the suppressed ones."""
    return tags.where("claims > 1").select(*key, "variable", "claims", F.col("tag").alias("winning_tag"), "suppressed")


def populated_where_not_applicable(df: DataFrame, tags: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., variable, entry, value): cells that hold a value where a rule says none applies. Only tagged rows meet the data."""
    wanted = tags.where(F.col("tag") == "NOT_APPLICABLE").select(*key, "variable", "entry")
    values = [c for c in df.columns if c not in key]
    long = df.select(*key, F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in values]).alias("cells"))
    joined = wanted.join(long, list(key))
    value = F.filter("cells", lambda c: c["variable"] == F.col("variable"))[0]["value"]
    return joined.select(*key, "variable", "entry", value.alias("value")).where("value is not null")


@dataclass
class Summaries:
    dataset: DataFrame
    fields: DataFrame
    rules: DataFrame
    outcomes: DataFrame
    overlaps: DataFrame
    populated: DataFrame
    unexamined: DataFrame


def summarize(df: DataFrame, key: Sequence[str], assessments: DataFrame, bindings: Mapping[str, Sequence[str]], targets: Sequence[str], plan: DataFrame | None = None) -> Summaries:
    """All summaries of a ledger (key..., variable, entry, tag, status); `plan` is the routing of entries (semantics.scope_plan)."""
    assessments = materialise(assessments, "ledger")
    tags = materialise(resolve(assessments, list(key)), "tags")
    rows = df.count()
    field = fields(df.columns, rows, assessments, tags, key, bindings, targets)
    populated = populated_where_not_applicable(df, tags, key)
    unexamined = field.where(F.col("examination").isin("NO_SEMANTIC_ROLE", "NO_RULE_ENTRY", "UNSCOPED")).select("variable", "roles", "examination", "unscoped_entries")
    seen = field.agg(F.count_if(F.col("examination") == "ASSESSED").alias("examined_fields"), F.count_if(F.col("examination") != "ASSESSED").alias("unexamined_fields"))
    stated = assessments.agg(F.count_if(F.col(key[0]).isNotNull()).alias("assessments"), F.count_if(F.col("status") == "UNCLASSIFIED").alias("unclassified_assessments"), F.count_if(F.col("status") == "UNSCOPED").alias("unscoped_entries"))
    tagged = tags.agg(F.count("*").alias("tagged_cells"), *(F.count_if(F.col("tag") == t).alias(f"{n}_cells") for t, n in TAGS.items()), F.count_if(F.col("claims") > 1).alias("multi_claim_cells"))
    routed = plan.agg(F.count_if(F.col("routing") == "READY_FOR_EVALUATION").alias("ready_routes"), F.count_if(F.col("routing") == "UNSCOPED").alias("unscoped_routes")) if plan is not None else df.sparkSession.createDataFrame([(None, None)], "ready_routes bigint, unscoped_routes bigint")
    held = populated.agg(F.count("*").alias("populated_where_not_applicable"))
    one = seen.crossJoin(stated).crossJoin(tagged).crossJoin(routed).crossJoin(held)  # single rows
    verdict = F.when((F.col("unclassified_assessments") > 0) | (F.col("unscoped_entries") > 0), "PARTIALLY_CLASSIFIED").otherwise("FULLY_CLASSIFIED")
    sizes = {"input_rows": F.lit(rows).cast("bigint"), "input_columns": F.lit(len(df.columns)), "columns_with_roles": F.lit(len(bindings)), "verdict": verdict}
    return Summaries(one.withColumns(sizes), field, rules(assessments, key), outcomes(assessments), overlaps(tags, key), populated, unexamined)


_BOUND = {"o_totalprice": ["amount"], "o_orderpriority": ["rank"], "o_custkey": ["party", "owner"]}
_ENTRIES = """l AS (SELECT o_orderkey, 'o_totalprice' AS variable, 'open' AS entry, 'CENSORED' AS tag, o_orderstatus = 'O' AS hit FROM orders UNION ALL SELECT o_orderkey, 'o_totalprice', 'low', 'NOT_APPLICABLE', o_orderpriority = '5-LOW' FROM orders
 UNION ALL SELECT o_orderkey, 'o_totalprice', 'flat', 'STALE_FROZEN', CASE WHEN o_totalprice < 10000 THEN NULL ELSE o_totalprice > 400000 END FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', 'done', 'NOT_APPLICABLE', o_orderstatus = 'F' FROM orders),
 a AS (SELECT o_orderkey, variable, entry, tag, CASE WHEN hit IS NULL THEN 'UNCLASSIFIED' WHEN hit THEN 'APPLIED_TAG' ELSE 'NO_TAG' END AS status FROM l UNION ALL SELECT NULL, 'o_custkey', 'maturity', NULL, 'UNSCOPED' FROM (SELECT 1)),
 r AS (SELECT o_orderkey, variable, arg_min(tag, CASE tag WHEN 'NOT_APPLICABLE' THEN 1 WHEN 'CENSORED' THEN 2 ELSE 3 END) AS tag, count(*) AS claims FROM a WHERE status = 'APPLIED_TAG' GROUP BY 1, 2)"""


def _summaries(spark, sf_dir) -> Summaries:
    df = table(spark, sf_dir, "orders")
    entries = {
        ("o_totalprice", "open", "CENSORED"): F.col("o_orderstatus") == "O", ("o_totalprice", "low", "NOT_APPLICABLE"): F.col("o_orderpriority") == "5-LOW",
        ("o_totalprice", "flat", "STALE_FROZEN"): F.when(F.col("o_totalprice") >= 10000, F.col("o_totalprice") > 400000), ("o_orderpriority", "done", "NOT_APPLICABLE"): F.col("o_orderstatus") == "F",
    }
    found = with_unscoped(ledger(df, ["o_orderkey"], entries), ["o_orderkey"], [("o_custkey", "maturity")])
    return summarize(df, ["o_orderkey"], found, _BOUND, ["amount", "rank", "owner"])


@query("semantics_fields", f"""WITH {_ENTRIES}, f(variable, roles, bound, targeted) AS (VALUES ('o_orderkey', '', false, false), ('o_custkey', 'party;owner', true, true), ('o_orderstatus', '', false, false), ('o_totalprice', 'amount', true, true), ('o_orderdate', '', false, false), ('o_orderpriority', 'rank', true, true)),
 s AS (SELECT variable, count(DISTINCT o_orderkey) AS assessed, count(*) FILTER (WHERE status = 'UNCLASSIFIED') AS uc, count(*) FILTER (WHERE status = 'UNSCOPED') AS us FROM a GROUP BY 1), t AS (SELECT variable, count(*) AS tagged, count(*) FILTER (WHERE tag = 'CENSORED') AS c, count(*) FILTER (WHERE tag = 'STALE_FROZEN') AS f, count(*) FILTER (WHERE tag = 'NOT_APPLICABLE') AS n FROM r GROUP BY 1)
 SELECT variable, roles, (SELECT count(*) FROM orders) AS total_rows, coalesce(assessed, 0) AS assessed_cells, coalesce(tagged, 0) AS tagged_cells, coalesce(c, 0) AS censored, coalesce(f.f, 0) AS stale_frozen, coalesce(n, 0) AS not_applicable, coalesce(assessed, 0) - coalesce(tagged, 0) AS no_tag_cells, coalesce(uc, 0) AS unclassified_assessments, coalesce(us, 0) AS unscoped_entries,
 round(tagged / nullif(assessed, 0), 6) AS tag_rate, CASE WHEN NOT bound THEN 'NO_SEMANTIC_ROLE' WHEN NOT targeted THEN 'NO_RULE_ENTRY' WHEN assessed > 0 THEN 'ASSESSED' ELSE 'UNSCOPED' END AS examination FROM (SELECT * FROM f LEFT JOIN s USING (variable) LEFT JOIN t USING (variable)) f""".replace("coalesce(f.f, 0)", 'coalesce(f."f", 0)'))
def semantics_fields(spark, sf_dir):
    return _summaries(spark, sf_dir).fields.withColumn("tag_rate", rounded(F.col("tag_rate")))


@query("semantics_rules", f"WITH {_ENTRIES} SELECT entry, variable, count(o_orderkey) AS assessments, count(*) FILTER (WHERE status = 'APPLIED_TAG') AS tagged, count(*) FILTER (WHERE status = 'NO_TAG') AS no_tag, count(*) FILTER (WHERE status = 'UNCLASSIFIED') AS unclassified, count(*) FILTER (WHERE status = 'UNSCOPED') AS unscoped, round(count(*) FILTER (WHERE status = 'APPLIED_TAG') / nullif(count(o_orderkey), 0), 6) AS tag_rate FROM a GROUP BY 1, 2")
def semantics_rules(spark, sf_dir):
    return _summaries(spark, sf_dir).rules.withColumn("tag_rate", rounded(F.col("tag_rate")))


@query("semantics_dataset", f"""WITH {_ENTRIES}, s AS (SELECT count(o_orderkey) AS assessments, count(*) FILTER (WHERE status = 'UNCLASSIFIED') AS uc, count(*) FILTER (WHERE status = 'UNSCOPED') AS us FROM a),
 t AS (SELECT count(*) AS tagged, count(*) FILTER (WHERE tag = 'CENSORED') AS c, count(*) FILTER (WHERE tag = 'STALE_FROZEN') AS f, count(*) FILTER (WHERE tag = 'NOT_APPLICABLE') AS n, count(*) FILTER (WHERE claims > 1) AS m FROM r),
 p AS (SELECT count(*) AS held FROM r JOIN orders USING (o_orderkey) WHERE tag = 'NOT_APPLICABLE' AND CASE variable WHEN 'o_totalprice' THEN o_totalprice IS NOT NULL ELSE o_orderpriority IS NOT NULL END)
 SELECT (SELECT count(*) FROM orders) AS input_rows, 6 AS input_columns, 3 AS columns_with_roles, 2 AS examined_fields, 4 AS unexamined_fields, assessments, uc AS unclassified_assessments, us AS unscoped_entries, tagged AS tagged_cells, c AS censored_cells, f AS stale_frozen_cells, n AS not_applicable_cells, m AS multi_claim_cells,
 held AS populated_where_not_applicable, CASE WHEN uc > 0 OR us > 0 THEN 'PARTIALLY_CLASSIFIED' ELSE 'FULLY_CLASSIFIED' END AS verdict FROM s, t, p""")
def semantics_dataset(spark, sf_dir):
    return _summaries(spark, sf_dir).dataset.drop("ready_routes", "unscoped_routes")
