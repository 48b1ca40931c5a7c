import pytest
from pyspark.sql import functions as F

from plumbline.plans.checks import standard
from plumbline.session import table

SF_DIR = "/root/testdata/sf0.001"


def test_standard_checks_keep_their_contract(spark):
    reg = standard()
    orders = table(spark, SF_DIR, "orders")
    calls = {
        "time_window_drift": {"date": "o_orderdate", "feature": "o_totalprice"},
        "iqr_outliers": {"column": "o_totalprice"},
        "key_health": {"key": "o_custkey"},
        "granularity": {"date": "o_orderdate"},
        "rules": {"specs": [{"id": "A", "expression": {"kind": "dom_range", "col": "o_totalprice", "lo": 0}}]},
        "rows": {},
    }
    for name, params in calls.items():
        assert reg.call(name, orders, **params).count() >= 1
    assert reg.serving("keys") == ["duplicate_keys", "key_health"]


def test_readiness_manifest_and_run(spark):
    reg = standard()
    orders = table(spark, SF_DIR, "orders")
    assert reg.readiness("pearson", orders, a="o_totalprice") == {"name": "pearson", "ready": False, "missing_parameters": ["b"], "missing_columns": []}
    assert reg.readiness("pearson", orders, a="o_totalprice", b="gone")["missing_columns"] == ["gone"]
    with pytest.raises(ValueError, match="not ready"):
        reg.manifest("pearson", orders, a="gone", b="o_custkey")
    stated = reg.manifest("pearson", orders, a="o_totalprice", b="o_custkey")
    assert stated["digest"] == reg.manifest("pearson", orders, a="o_totalprice", b="o_custkey")["digest"]
    assert reg.execute(stated, orders).columns[:2] == ["r", "n"]
    for other, frame, said in (({**stated, "params": {"a": "o_custkey", "b": "o_custkey"}}, orders, "changed"), (stated, orders.drop("o_custkey"), "schema")):
        with pytest.raises(ValueError, match=said):
            reg.execute(other, frame)


def test_binned_shape_of_a_frame(spark):
    lines = table(spark, SF_DIR, "lineitem").withColumn("gross", F.col("l_quantity") * F.col("l_extendedprice"))
    got = standard().call("binned_shape", lines, feature="l_quantity", target="gross")
    assert got.first().shape == "INCREASING"
