"""Column expressions shared by the operators: missing values, numbers, dates, periods, names."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts read as missing, and the accepted date formats with the shape of their texts.
MISSING_TEXTS = ("", "nan", "none", "null", "na", "n/a")
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "dd MMM yyyy": r"^\d{2} [A-Za-z]{3} \d{4}$",
}


def kinds(schema: T.StructType) -> dict[str, str]:
    """The columns that are numbers or dates by their type; their values need no parsing."""
    number_ = {f.name: "number" for f in schema if isinstance(f.dataType, T.NumericType)}
    return number_ | {f.name: "date" for f in schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}


def missing(c: Column, kind: str | None = None) -> Column:
    """Null, NaN or a text that stands for nothing."""
    if kind == "number":
        return c.isNull() | F.isnan(c.cast("double"))
    if kind == "date":
        return c.isNull()
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*MISSING_TEXTS)


def number(c: Column, kind: str | None = None) -> Column:
    """As double; null where missing or unparseable."""
    if kind == "date":
        return F.lit(None).cast("double")
    x = c.cast("double") if kind == "number" else c.cast("string").try_cast("double")
    return F.when(missing(c, kind) | F.isnan(x), None).otherwise(x)


def date(c: Column, kind: str | None = None) -> Column:
    """As date by the accepted format that has the text's shape; null elsewhere. A format is only tried on texts of its
    shape, since a failing parse is dear; dates and timestamps are cast, by their type or their text."""
    if kind == "date":
        return c.cast("date")
    text = F.trim(c.cast("string"))
    out = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$"), text.try_cast("timestamp").cast("date"))
    for f, shape in DATE_FORMATS.items():
        if not f.startswith("yyyy-MM-dd"):
            out = out.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(f))))
    return out


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip())


def is_ascii(c: Column) -> Column:
    return c.cast("string").rlike(r"^[\x00-\x7F]*\z")


def normal_text(c: Column, ascii_only: bool = False) -> Column:
    """Compatibility form (NFKC) without white space around it, null where nothing is left; case stays. Only texts beyond ASCII
    go through Python; where a column is known to have none, no Python worker is started."""
    text = c.cast("string")
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"))
    if ascii_only:
        return F.nullif(trimmed, F.lit(""))
    plain = is_ascii(c)
    return F.nullif(F.when(plain, trimmed).otherwise(_compatible(F.when(~plain, text))), F.lit(""))


def norm(c: Column) -> Column:
    """Upper case, trimmed, whole numbers without their '.0'."""
    return F.regexp_replace(F.upper(F.trim(c.cast("string"))), r"\.0$", "")


def norm_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_")


def name_tokens(c: Column) -> Column:
    """Words of a column name: split at case changes, digits and separators."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Za-z])([0-9])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    return F.when(F.greatest(F.length(a), F.length(b)) == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def period_ordinal(d: Column, grain: str) -> Column:
    """Integer ordinal of the month, quarter, half or year of a date."""
    y = F.year(d)
    return {"month": y * 12 + F.month(d) - 1, "quarter": y * 4 + F.quarter(d) - 1, "half": y * 2 + F.when(F.month(d) > 6, 1).otherwise(0), "year": y}[grain]


def period_key(ordinal: Column, grain: str) -> Column:
    """The label of an ordinal: YYYY-MM, YYYY-Qn, YYYY-Hn or YYYY."""
    n = {"month": 12, "quarter": 4, "half": 2, "year": 1}[grain]
    year, part = F.floor(ordinal / n).cast("int").cast("string"), (ordinal % n + 1).cast("int").cast("string")
    if grain == "year":
        return year
    if grain == "month":
        return F.concat(year, F.lit("-"), F.lpad(part, 2, "0"))
    return F.concat(year, F.lit("-Q" if grain == "quarter" else "-H"), part)


def parse_period(c: Column, grain: str) -> Column:
    """Ordinal of a label of this grain, or of a full date mapped into it; null for labels of other grains."""
    text = F.upper(F.trim(c.cast("string")))

    def part(pattern, scale):
        y, p = F.regexp_extract(text, pattern, 1).try_cast("int"), F.regexp_extract(text, pattern, 2).try_cast("int")
        return F.when(text.rlike(pattern), y * scale + p - 1)

    own = {
        "month": [part(r"^(\d{4})[-/]?(0[1-9]|1[0-2])$", 12)],
        "quarter": [part(r"^(\d{4})[- ]?Q([1-4])$", 4)],
        "half": [part(r"^(\d{4})[- ]?H([12])$", 2)],
        "year": [F.when(text.rlike(r"^\d{4}$"), text.try_cast("int"))],
    }[grain]
    full = F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")))
    return F.coalesce(*own, period_ordinal(full, grain)).cast("int")


def bucket(x: Column, edges: list[float], right: bool = False) -> Column:
    """Number of edges below x (right: the edge itself belongs to the bucket below it)."""
    if not edges:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [F.when(x > e if right else x >= e, 1).otherwise(0) for e in edges])


def rounded(c: Column, digits: int = 6) -> Column:
    """For results compared across engines: rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
