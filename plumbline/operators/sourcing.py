"""Sources and sinks at work on the given tables, and duplicates dropped (IO-1, IO-4, IO-6, SO-3)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import rounded
from plumbline.plans.registry import query
from plumbline.session import scratch_dir, table
from plumbline.sources import readers


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of each kind: of equal rows, or of rows that are equal in `columns`, any one (SO-3)."""
    return df.dropDuplicates(columns) if columns else df.distinct()


@query("source_delimited", "SELECT c_nationkey, count(*) AS customers, count(DISTINCT c_name) AS names, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def source_delimited(spark, sf_dir):
    """Customers written as text with bars between fields, and read again by their header."""
    path = f"{scratch_dir(spark)}/plumbline-delimited-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("header", True).option("sep", "|").csv(path)
    back = readers.delimited(spark, path, "pipe", "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double")
    return back.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.count_distinct("c_name").alias("names"), rounded(F.sum("c_acctbal"), 2).alias("balance"))


@query("source_snapshot", "SELECT o_orderstatus, count(*) AS orders, max(o_orderkey) AS last FROM orders GROUP BY 1")
def source_snapshot(spark, sf_dir):
    """Two columns of a table, which are all that is read."""
    return readers.snapshot(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_orderstatus"]).groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last"))


@query("source_saved", "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def source_saved(spark, sf_dir):
    """Orders saved in a folder a priority; only two folders are read back."""
    path = f"{scratch_dir(spark)}/plumbline-saved-{uuid.uuid4().hex}"
    readers.save(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path, ["o_orderpriority"])
    back = readers.snapshot(spark, path).where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("source_distinct", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def source_distinct(spark, sf_dir):
    return distinct_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))
