"""Censored measurements: parsing, bounds, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse(raw: Column) -> Column:
    """struct<relation, value> of texts such as " > 16 ", "≤8", "2.5e1"; null for ranges, ~, zero, negative and other texts."""
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), "≤", "<="), "≥", ">=")
    pattern = r"^(<=|>=|<|>|=)?\s*([0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)$"
    value = F.regexp_extract(text, pattern, 2).try_cast("double")
    relation = F.regexp_extract(text, pattern, 1)
    ok = (value > 0) & (value < float("inf"))
    return F.when(ok, F.struct(F.when(relation == "", "=").otherwise(relation).alias("relation"), value.alias("value")))


def bounds(relation: Column, value: Column) -> Column:
    """struct<lo, hi, lo_closed, hi_closed>; an absent bound is null."""
    lo, hi = F.when(relation.isin("=", ">", ">="), value), F.when(relation.isin("=", "<", "<="), value)
    return F.struct(lo.alias("lo"), hi.alias("hi"), relation.isin("=", ">=").alias("lo_closed"), relation.isin("=", "<=").alias("hi_closed"))


def label(relation: Column, value: Column, threshold: float = 16.0) -> Column:
    """1 if the value is surely at most the threshold, 0 if surely above, else null."""
    sure = (relation.isin("=", "<=", "<")) & (value <= threshold)
    above = ((relation == "=") & (value > threshold)) | ((relation == ">") & (value >= threshold)) | ((relation == ">=") & (value > threshold))
    return F.when(sure, 1).when(above, 0)


def ratio_bounds(a: Column, b: Column, ratio: float) -> Column:
    """struct<certain, possible>: whether b / a surely, or possibly, reaches the ratio; a, b are bounds() structs."""
    certain = F.coalesce(b["lo"] >= ratio * a["hi"], F.lit(False))
    strict = ~(b["hi_closed"] & a["lo_closed"])
    possible = b["hi"].isNull() | a["lo"].isNull() | (b["hi"] > ratio * a["lo"]) | ((b["hi"] == ratio * a["lo"]) & ~strict)
    return F.struct(certain.cast("int").alias("certain"), possible.cast("int").alias("possible"))


def to_null(text: Column) -> Column:
    """Trimmed text; null for the usual words for nothing."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin("", "none", "nan", "n/a", "[]"), t)


def publication_key(title: Column, year: Column) -> Column:
    return F.sha2(F.concat(year.cast("string"), F.lit(":"), F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))), 256)
