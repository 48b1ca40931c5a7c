"""The library's own checks by name, ready for Registry.call() (UD-1, UD-2, UD-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import direction, directionality, drift, keys, missingness, panel, profile, rules
from plumbline.plans.registry import Check, Registry


def _windowed(f):
    """A check on the early and recent windows of a date column."""
    return lambda df, date, share, **rest: f(drift.early_recent(df, date, share), **rest)


def standard() -> Registry:
    reg = Registry()
    early = {"date": ..., "share": 0.4}
    for check in (
        Check("time_window_drift", _windowed(drift.window_drift), early | {"feature": ...}, ("drift",), ("early_mean", "recent_mean", "mean_change")),
        Check("psi_decomposition", _windowed(drift.decomposition), early | {"feature": ..., "bins": 10}, ("drift",), ("bin", "contribution", "ks_gap")),
        Check("segment_attribution", _windowed(drift.segment_attribution), early | {"feature": ..., "segment": ...}, ("drift",), ("segment", "change")),
        Check("relationship_drift", _windowed(drift.relationship_drift), early | {"a": ..., "b": ...}, ("drift",), ("early", "recent")),
        Check("missingness_change", _windowed(missingness.change), early | {"column": ...}, ("completeness",), ("early", "recent")),
        Check("freshness_gaps", lambda df, date, top: drift.gaps(df, date, top), {"date": ..., "top": 10}, ("freshness",), ("days",)),
        Check("iqr_outliers", lambda df, column, times: profile.iqr_outliers(df, column, times), {"column": ..., "times": 1.5}, ("outliers",), ("outliers", "rate")),
        Check("sigma_range", lambda df, column, sigmas, mostly: profile.sigma_range(df, column, sigmas, mostly), {"column": ..., "sigmas": 5.0, "mostly": 0.999}, ("outliers",), ("inside", "passed")),
        Check("schema_types", lambda df, columns: profile.classify(df, columns), {"columns": ...}, ("types",), ("logical_type",)),
        Check("key_health", lambda df, key: keys.key_health(df, key), {"key": ...}, ("keys",), ("duplicate_rate",)),
        Check("duplicate_keys", lambda df, key, top: keys.duplicate_keys(df, key, top), {"key": ..., "top": 10}, ("keys",), ("n",)),
        Check("cadence", lambda df, entity, date: keys.cadence(df, entity, date), {"entity": ..., "date": ...}, ("structure",), ("state",)),
        Check("granularity", lambda df, date: panel.granularity(df, date), {"date": ...}, ("structure",), ("modal_gap",)),
        Check("pearson", lambda df, a, b: direction.pearson(df, a, b), {"a": ..., "b": ...}, ("direction",), ("r", "p")),
        Check("spearman", lambda df, a, b: direction.spearman(df, a, b), {"a": ..., "b": ...}, ("direction",), ("r", "p")),
        Check("binned_shape", lambda df, feature, target, bins: directionality.assess(df, [feature], target, "continuous", bins=bins), {"feature": ..., "target": ..., "bins": 5}, ("direction",), ("shape",)),
        Check("rules", lambda df, specs: rules.evaluate(df, specs), {"specs": ...}, ("rules",), ("rule_id", "outcome")),
        Check("rows", lambda df: df.agg(F.count("*").alias("rows")), {}, ("inventory",), ("rows",)),
    ):
        reg.register(check)
    return reg
