"""Column functions over short sequences (strings over a small alphabet)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The twenty residue letters and the Kyte-Doolittle hydropathy scale.
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}


def chars(s: Column) -> Column:
    """array of one-character strings; empty for the empty string."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def count_of(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def composition(s: Column, letters: str = LETTERS) -> Column:
    """array of the share of each letter; null for the empty string."""
    return F.transform(F.array(*[count_of(s, c) for c in letters]), lambda n: n / F.nullif(F.length(s), F.lit(0)))


def shares_entropy(shares: Column) -> Column:
    """Shannon entropy in bits of an array of shares."""
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def entropy(s: Column, letters: str = LETTERS) -> Column:
    """Shannon entropy in bits over the letters' shares."""
    return shares_entropy(composition(s, letters))


def max_share(s: Column, letters: str = LETTERS) -> Column:
    return F.array_max(composition(s, letters))


def longest_run(s: Column) -> Column:
    """Length of the longest run of one character."""
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("m"))

    def step(acc, c):
        n = F.when(acc["c"] == c, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(c.alias("c"), n.alias("n"), F.greatest(acc["m"], n).alias("m"))

    return F.aggregate(chars(s), start, step, lambda acc: acc["m"])


def longest_stretch_without(s: Column, breaks: str) -> Column:
    """Length of the longest stretch that holds none of the characters."""
    return F.array_max(F.transform(F.split(s, f"[{breaks}]"), lambda p: F.length(p)))


def motif_count(s: Column, *patterns: str) -> Column:
    """Non-overlapping matches, summed over the patterns."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(s, F.lit(p))
    return total


def scale_mean(s: Column, scale: dict[str, float]) -> Column:
    """Mean of a letter scale; letters without a value count as 0."""
    table = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])
    return F.aggregate(chars(s), F.lit(0.0), lambda acc, c: acc + F.coalesce(table[c], F.lit(0.0))) / F.nullif(F.length(s), F.lit(0))


def window_mean_max(s: Column, scale: dict[str, float], width: int) -> Column:
    """Highest mean of a scale over windows of ``width`` letters, or of the whole string if it is shorter."""
    w = F.least(F.length(s), F.lit(width))
    spans = F.sequence(F.lit(1), F.greatest(F.length(s) - w + 1, F.lit(1)))
    return F.array_max(F.transform(spans, lambda i: scale_mean(F.substring(s, i, w), scale)))


def moment(s: Column, scale: dict[str, float], degrees: float = 100.0) -> Column:
    """Length of the vector sum of a scale turned by so many degrees a letter, over the letters' number."""
    table = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])

    def part(f):
        return F.aggregate(F.transform(chars(s), lambda c, i: F.coalesce(table[c], F.lit(0.0)) * f(F.radians(i * F.lit(degrees)))), F.lit(0.0), lambda a, x: a + x)

    return F.hypot(part(F.cos), part(F.sin)) / F.nullif(F.length(s), F.lit(0))


def overlap_bound(a: Column, b: Column, letters: str) -> Column:
    """Upper bound of letters that can match: the multiset intersection's size."""
    total = F.lit(0)
    for c in letters:
        total = total + F.least(count_of(a, c), count_of(b, c))
    return total


def alphabet_ok(s: Column, low: int = 8, high: int = 50, letters: str = LETTERS) -> Column:
    return F.length(s).between(low, high) & s.rlike(f"^[{letters}]+$")


def hash_bucket(s: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(s, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_split(s: Column) -> Column:
    b = hash_bucket(s)
    return F.when(b < 0.70, "train").when(b < 0.85, "development").otherwise("holdout")


def clamp_score(x: Column, low: float, high: float, falling: bool = False) -> Column:
    """0..100 along a straight line from low to high; falling: from high to low."""
    part = (F.lit(high) - x) / (high - low) if falling else (x - F.lit(low)) / (high - low)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * part))


def range_score(x: Column, low: float, high: float, slack: float) -> Column:
    """100 inside [low, high], falling to 0 at ``slack`` outside."""
    away = F.greatest(F.lit(low) - x, x - F.lit(high), F.lit(0.0))
    return F.greatest(F.lit(0.0), 100.0 * (1.0 - away / slack))


def linear_head(vector: Column, mean: list[float], scale: list[float], weights: list[float], bias: float) -> Column:
    """((x - mean) / scale) . weights + bias of an array column; null for other lengths."""
    table = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s"), F.lit(float(w)).alias("w")) for m, s, w in zip(mean, scale, weights)])
    terms = F.zip_with(vector, table, lambda x, t: (x - t["m"]) / t["s"] * t["w"])
    return F.when(F.size(vector) == len(weights), F.aggregate(terms, F.lit(float(bias)), lambda a, x: a + x))
