"""Warnings of newly read tables and their dictionary, none of which stops anything (OT-5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import norm_name
from plumbline.operators.matching import dictionary_mapping
from plumbline.operators.profile import classify
from plumbline.plans.registry import query
from plumbline.session import table

#: Share of values that may fail to parse, words of declared types by class (the first class that has one counts),
#: texts of two-valued columns.
PARSE_FAILURES = 0.10
DECLARED = {
    "datetime": ("date", "time", "timestamp"), "numerical": ("int", "float", "double", "decimal", "numeric", "number", "rate", "ratio", "continuous"), "binary": ("bool", "binary", "flag", "indicator"),
    "ordinal": ("ordinal", "grade", "rating"), "categorical": ("category", "categorical", "enum"), "identifier": ("identifier",), "text": ("str", "char", "text", "object"),
}
TWO_VALUED = ("true", "false", "0", "1", "yes", "no", "y", "n", "t", "f")


def declared_class(c: Column) -> Column:
    """The class that a dictionary's type names, null if none is known."""
    raw = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.when(raw == "", None)
    for kind, parts in DECLARED.items():
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(raw, F.lit(p))
        if kind == "identifier":
            hit = hit | (raw == "id") | raw.endswith("_id")
        out = out.when(hit, kind)
    return out


def column_warnings(df: DataFrame, observed: DataFrame) -> DataFrame:
    """(column, code) from the values: nothing but nulls; numbers or dates among other texts; more than a tenth that the observed type
    (column, logical_type) cannot read. One pass over the rows."""
    each = []
    for c in df.columns:
        kind, x = df.schema[c].dataType, F.col(c)
        text = F.trim(x.cast("string"))
        number = x.isNotNull() if isinstance(kind, T.NumericType) else text.try_cast("double").isNotNull()
        day = x.isNotNull() if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.try_to_timestamp(text).isNotNull() & text.rlike(r"^\d{4}-\d{2}-\d{2}") if isinstance(kind, T.StringType) else F.lit(False)
        each.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("n"), F.count_if(number).alias("numbers"), F.count_if(day).alias("days"), F.count_if(F.lower(text).isin(*TWO_VALUED)).alias("flags")))
    long = df.agg(F.array(*each).alias("r")).select(F.inline("r")).join(observed.select("column", "logical_type"), "column", "left")
    n, kind = F.col("n"), F.col("logical_type")
    read = F.when(kind == "numerical", F.col("numbers")).when(kind == "datetime", F.col("days")).when(kind == "binary", F.col("flags"))
    part = lambda c: (F.col(c) > 0) & (F.col(c) < n)
    codes = F.array_compact(F.array(F.when((F.col("rows") > 0) & (n == 0), "column_all_null"), F.when((n > 0) & (part("numbers") | part("days")), "column_mixed_type"), F.when((n > 0) & (1 - read / n > PARSE_FAILURES), "column_parse_failure_rate")))
    return long.select("column", F.explode(codes).alias("code"))


def dictionary_warnings(mapped: DataFrame, dictionary: DataFrame, columns: DataFrame, observed: DataFrame) -> DataFrame:
    """(table, column, code) of a dictionary (table, name, declared) against the columns (table, column), its mapping to them
    (matching.dictionary_mapping) and the types observed (table, column, logical_type): names that no column has, names whose
    column another name took, types that are unknown, and types that the data contradict. All are catalogues."""
    there = columns.select("table", norm_name(F.col("column")).alias("_n")).distinct().withColumn("_there", F.lit(True))
    lost = mapped.where("kind = 'below_floor'").withColumn("_n", norm_name(F.col("name"))).join(there, ["table", "_n"], "left")
    names = lost.select("table", F.col("name").alias("column"), F.when(F.col("_there"), "dict_field_unused").otherwise("dict_var_not_in_dataset").alias("code"))
    applied = mapped.where("column is not null").join(dictionary.select("table", "name", "declared"), ["table", "name"]).join(observed.select("table", "column", "logical_type"), ["table", "column"])
    kind = declared_class(F.col("declared"))
    given = F.trim(F.coalesce("declared", F.lit(""))) != ""
    codes = F.array_compact(F.array(F.when(kind.isNotNull() & (kind != F.col("logical_type")), "type_conflict"), F.when(given & kind.isNull(), "unsupported_value")))
    return names.unionByName(applied.select("table", "column", F.explode(codes).alias("code")))


def warnings(tables: Mapping[str, DataFrame], dictionary: DataFrame | None = None, order: Sequence[str] = ()) -> DataFrame:
    """(table, column, code) of several tables and, where there is one, of their dictionary (table, name, position, declared)."""
    from functools import reduce

    names = [*order, *(t for t in tables if t not in order)]
    observed = {t: classify(tables[t], tables[t].columns).select("column", "logical_type") for t in names}
    found = reduce(DataFrame.unionByName, [column_warnings(tables[t], observed[t]).select(F.lit(t).alias("table"), "column", "code") for t in names])
    if dictionary is None:
        return found
    spark = dictionary.sparkSession
    columns = spark.createDataFrame([(t, c) for t in names for c in tables[t].columns], "table string, column string")
    types = reduce(DataFrame.unionByName, [observed[t].withColumn("table", F.lit(t)) for t in names])
    return found.unionByName(dictionary_warnings(dictionary_mapping(dictionary, columns), dictionary, columns, types))


_DICTIONARY = [("orders", "o_orderkey", 0, "BIGINT"), ("orders", "O_ORDERDATE", 1, "number"), ("orders", "o_totalprice", 3, "blob"), ("orders", "absent_thing", 4, "text"), ("orders", "empty", 5, None), ("orders", "half", 6, "categorical"), ("orders", "HALF", 7, "text")]


@query("ingest_warnings", """WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS third, count(*) FILTER (WHERE o_orderkey % 20 = 0) AS few, count(DISTINCT o_orderkey) / count(*) AS keys FROM orders)
 SELECT 'orders' AS "table", unnest(['empty', 'half', 'mostly', 'O_ORDERDATE', 'o_totalprice', 'absent_thing', 'HALF', 'half']) AS "column",
 unnest(['column_all_null', 'column_mixed_type', 'column_mixed_type', 'type_conflict', 'unsupported_value', 'dict_var_not_in_dataset', 'dict_field_unused', 'column_parse_failure_rate']) AS code FROM o WHERE third > 0.1 * n AND third < 0.5 * n AND few > 0 AND few < 0.1 * n AND keys = 1
 UNION ALL SELECT 'orders', 'half', 'type_conflict' FROM o UNION ALL SELECT 'orders', 'o_orderkey', 'type_conflict' FROM o WHERE keys >= 0.98""".replace("'O_ORDERDATE', 'o_totalprice'", "'o_orderdate', 'o_totalprice'"))
def ingest_warnings(spark, sf_dir):
    """Orders with an empty column, one of which a third is no number, one of which few are none, and a dictionary with a name twice,
    an absent name, a type that is unknown and types that the data contradict."""
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").withColumns({"empty": F.lit(None).cast("string"), "half": F.when(key % 3 == 0, "none so").otherwise(key.cast("string")), "mostly": F.when(key % 20 == 0, "?").otherwise((key % 500).cast("string"))})
    return warnings({"orders": df}, spark.createDataFrame(_DICTIONARY, "table string, name string, position int, declared string"))
