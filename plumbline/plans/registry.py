"""Registration of queries with the SQL that states the same result, and of checks by name (UD-1..4)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register `f(spark, sf_dir)` under a name that is not taken yet."""

    def take(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return take


#: Parameters of checks that name a column.
COLUMN_PARAMETERS = ("column", "feature", "target", "date", "key", "entity", "segment", "a", "b")


def _digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Check:
    """A named check: parameters with defaults, the tests it serves, the columns that it returns."""

    name: str
    run: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)
    serves: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()


class Registry:
    """Checks by name; a call validates parameters before and the output's columns after."""

    def __init__(self):
        self._checks: dict[str, Check] = {}

    def register(self, check: Check) -> Check:
        if check.name in self._checks:
            raise ValueError(f"check {check.name} is registered twice")
        self._checks[check.name] = check
        return check

    def serving(self, test: str) -> list[str]:
        return sorted(n for n, c in self._checks.items() if test in c.serves)

    def names(self) -> list[str]:
        return sorted(self._checks)

    def call(self, name: str, df: DataFrame, **params) -> DataFrame:
        check = self._checks[name]
        unknown = set(params) - set(check.params)
        if unknown:
            raise ValueError(f"{name} has no parameters {sorted(unknown)}")
        given = {**check.params, **params}
        absent = [k for k, v in given.items() if v is ...]
        if absent:
            raise ValueError(f"{name} needs {absent}")
        out = check.run(df, **given)
        missing = [c for c in check.columns if c not in out.columns]
        if missing:
            raise ValueError(f"{name} did not return {missing}")
        return out

    def readiness(self, name: str, df: DataFrame, **params) -> dict:
        """Whether a check may run on `df`, and what it lacks: parameters, or columns that text parameters name (UD-4)."""
        check = self._checks[name]
        given = {**check.params, **params}
        lacking = [k for k, v in given.items() if v is ...]
        named = [v for k, v in given.items() if isinstance(v, str) and k in COLUMN_PARAMETERS]
        absent = sorted({v for v in named if v not in df.columns})
        return {"name": name, "ready": not (lacking or absent), "missing_parameters": lacking, "missing_columns": absent}

    def manifest(self, name: str, df: DataFrame, **params) -> dict:
        """A frozen statement of a run: the check, its parameters, the columns with their types, and a digest of all of it."""
        state = self.readiness(name, df, **params)
        if not state["ready"]:
            raise ValueError(f"{name} is not ready: {state}")
        body = {"name": name, "params": {**self._checks[name].params, **params}, "schema": [(f.name, f.dataType.simpleString()) for f in df.schema]}
        return {**body, "digest": _digest(body)}

    def execute(self, manifest: dict, df: DataFrame) -> DataFrame:
        """Run what a manifest states on a frame of the stated schema."""
        body = {k: manifest[k] for k in ("name", "params", "schema")}
        if _digest(body) != manifest.get("digest"):
            raise ValueError("the manifest was changed")
        if [tuple(x) for x in manifest["schema"]] != [(f.name, f.dataType.simpleString()) for f in df.schema]:
            raise ValueError("the frame has another schema than the manifest")
        return self.call(manifest["name"], df, **manifest["params"])

    def validate(self, check: Check, df: DataFrame, examples: list[dict]) -> DataFrame:
        """Accept a check of the user's: three parameter examples at least, each of which runs on `df` and keeps the contract."""
        if len(examples) < 3:
            raise ValueError("three parameter examples are needed")
        trial = Registry()
        trial.register(check)
        for example in examples:
            trial.call(check.name, df, **example).write.format("noop").mode("overwrite").save()
        self.register(check)
        return self.call(check.name, df, **examples[0])
