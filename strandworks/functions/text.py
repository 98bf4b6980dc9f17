"""Small text functions of the measurement tables: units, names, keys, references, formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Spellings of the micro sign.
MICRO = "µμ"


def spaces(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unit(c: Column) -> Column:
    """A unit with a plain u for the micro sign, lower-cased, without spaces."""
    return F.lower(F.translate(F.regexp_replace(c, r"\s+", ""), MICRO, "uu"))


def micromolar(value: Column, unit_: Column, mass: Column) -> Column:
    """A value in micromoles a litre; mass units need the molecular mass; null for other units."""
    u = unit(unit_)
    return F.when(u == "um", value).when(u == "nm", value / 1000).when(u.isin("ug/ml", "mg/l"), value * 1000 / F.nullif(mass, F.lit(0.0)))


def interval(c: Column) -> Column:
    """struct<lower, upper> of "2-8" or "2–8"; of one number both; null for other texts and inverted bounds."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    t = F.regexp_replace(c, r"\s+", "")
    two = F.regexp_extract(t, f"^{number}[-–]{number}$", 0) != ""
    lower = F.regexp_extract(t, f"^{number}(?:[-–]{number})?$", 1).try_cast("double")
    upper = F.when(two, F.regexp_extract(t, f"^{number}[-–]{number}$", 2).try_cast("double")).otherwise(lower)
    return F.when(lower <= upper, F.struct(lower.alias("lower"), upper.alias("upper")))


def species(target: Column) -> Column:
    """The first two words."""
    return F.substring_index(spaces(target), " ", 2)


def family(name: Column) -> Column:
    """A run's name without its seed suffix -s<digits>."""
    return F.regexp_replace(name, "-s[0-9]+$", "")


def references(token: Column, articles: Column) -> Column:
    """The articles that a one-based list such as "1, 3" names; empty if any part of it isn't a place in the list."""
    parts = F.transform(F.split(F.trim(token), r"\s*,\s*"), lambda x: F.when(x.rlike("^[0-9]{1,6}$"), x.try_cast("int")))
    good = F.forall(parts, lambda i: F.coalesce((i >= 1) & (i <= F.size(articles)), F.lit(False)))
    return F.when(good, F.transform(parts, lambda i: F.get(articles, i - 1))).otherwise(F.slice(articles, 1, 0))


def content_id(c: Column) -> Column:
    return F.concat(F.lit("sha256_"), F.sha2(c, 256))


def json_key(*columns: str) -> Column:
    """sha256 of the columns as JSON, names in order; nulls don't count."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def cell_column(letters: Column) -> Column:
    """The number, from 1, of a spreadsheet column."""
    upper = F.upper(letters)
    return F.aggregate(F.filter(F.split(upper, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def significant(c: Column, digits: int) -> Column:
    """A number with so many significant digits, shortest form, as ``%g`` writes it without an exponent."""
    x = c.cast("double")
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    rounded = F.when(x == 0, F.lit("0")).otherwise(F.format_string(f"%.{digits + 8}f", F.bround(x * F.pow(F.lit(10.0), places), 0) / F.pow(F.lit(10.0), places)))
    return F.regexp_replace(F.regexp_replace(rounded, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def one_hot(c: Column, categories: list[str]) -> Column:
    """array of 0/1 for each category, then one for a value that is none of them (null too)."""
    return F.concat(F.array(*[F.coalesce((c == k).cast("int"), F.lit(0)) for k in categories]), F.array((~F.coalesce(c.isin(categories), F.lit(False))).cast("int")))


def outer_product(a: Column, b: Column) -> Column:
    """Products of every element of one array with every element of another, row by row."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def four_mers(contig: Column) -> Column:
    """array of the windows of four letters, those with other letters than ACGT left out."""
    s = F.upper(contig)
    spans = F.when(F.length(s) >= 4, F.sequence(F.lit(1), F.length(s) - 3)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(spans, lambda i: F.substring(s, i, 4)), lambda w: w.rlike("^[ACGT]{4}$"))


def reverse_complement(c: Column) -> Column:
    return F.translate(F.reverse(c), "ACGT", "TGCA")
