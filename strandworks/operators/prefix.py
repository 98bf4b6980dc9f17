"""Selections whose tests cost much: an ordered table is read in doubling prefixes, and only what was read is tested.

Ties of the whole order stay together. Rows that are null, or not finite, in a column of the order take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kernels
from . import greedy, joins
from .graph import cut

Order = list[tuple[str, bool]]
#: Rows of the first prefix, and the most that one adds.
FIRST, MOST = 500, 1_000_000


def _sorted(order: Order, back: bool = False) -> list[Column]:
    return [F.col(c).asc() if up != back else F.col(c).desc() for c, up in order]


def _after(order: Order, bound) -> Column:
    """Rows that come after a row in the order."""
    out = F.lit(False)
    for c, up in reversed(order):
        v = F.lit(bound[c])
        out = (F.col(c) > v if up else F.col(c) < v) | ((F.col(c) == v) & out)
    return out


def _usable(df: DataFrame, order: Order) -> DataFrame:
    for c, _ in order:
        ok = F.col(c).isNotNull()
        if df.schema[c].dataType.typeName() in ("double", "float"):
            ok = ok & ~F.isnan(c) & ~F.col(c).isin(float("inf"), float("-inf"))
        df = df.where(ok)
    return df


def prefixes(df: DataFrame, order: Order, first: int = FIRST, most: int = MOST) -> Iterator[DataFrame]:
    """The rows in order, in parts of first, first, 2 * first, 4 * first ... rows and ties with the last, each found by one scan."""
    if first < 1 or most < first:
        raise ValueError("a prefix needs a row")
    rest, size, n = _usable(df, order), first, 0
    while True:
        part = rest.orderBy(*_sorted(order)).limit(size)
        bound = part.orderBy(*_sorted(order, back=True)).limit(1).collect()
        if not bound:
            return
        later = _after(order, bound[0])
        yield rest.where(~later)
        rest, size, n = rest.where(later), size if n == 0 else min(2 * size, most), n + 1


def until(df: DataFrame, order: Order, test: Callable[[DataFrame], DataFrame], choose: Callable[[DataFrame], DataFrame | None], first: int = FIRST, most: int = MOST) -> DataFrame | None:
    """What ``choose`` makes of the tested rows read so far, as soon as it isn't None; None if it never is.

    test: a prefix to its rows with what the test found (or without those that fail). Each prefix is tested once.
    """
    seen = None
    for part in prefixes(df, order, first, most):
        tested = cut(test(part))
        seen = tested if seen is None else seen.unionByName(tested)
        if (chosen := choose(seen)) is not None:
            return chosen
    return None


def first_passing(df: DataFrame, order: Order, test: Callable[[DataFrame], DataFrame], n: int, first: int = FIRST, most: int = MOST) -> DataFrame:
    """The first n rows of those that ``test`` lets through; fewer are an error."""

    def choose(seen: DataFrame) -> DataFrame | None:
        return seen.orderBy(*_sorted(order)).limit(n) if len(seen.take(n)) == n else None

    got = until(df, order, test, choose, first, most)
    if got is None:
        raise ValueError(f"infeasible: fewer than {n} rows pass")
    return got


def clear_first(df: DataFrame, key: str, text: str, order: Order, reference: DataFrame, limit: float, k: int, first: int = FIRST) -> DataFrame:
    """The first k rows in order whose highest ratio to the reference texts is at most the limit."""
    return first_passing(df, order, lambda part: joins.clear_of(part, reference, text, key, limit), k, first)


def starter_top(df: DataFrame, key: str, text: str, score: str, challenge: DataFrame, known: DataFrame, k: int, apart: float = 0.4, known_max: float = 0.6, challenge_max: float = 0.8, within: float | None = None, first: int = FIRST) -> DataFrame:
    """(key, place, similarity, within): k rows by ascending score, then key, no two of local similarity above ``apart``.

    Rows above the limits to a reference text never enter; they fail whatever was taken, so they are sorted out
    before the walk, and only the others of the prefixes read so far pass through one task.
    """

    def test(part: DataFrame) -> DataFrame:
        flagged = greedy.reference_flags(part, key, text, challenge, known, challenge_max, known_max)
        return flagged.where("NOT near_challenge AND NOT near_known").select(key, text, score)

    def choose(seen: DataFrame) -> DataFrame | None:
        head = seen.count()
        if head < k:
            return None
        ranked = seen.withColumn("_s", -F.col(score).cast("double"))
        got = cut(greedy.diverse_top(ranked, key, text, "_s", key, k, [greedy.Step(head, pairwise=apart)], {}, short=True, similarity=kernels.local_ratio))
        return got if got.count() == k else None

    got = until(df.select(key, text, score), [(score, True), (key, True)], test, choose, first)
    if got is None:
        raise ValueError(f"infeasible: fewer than {k} rows are apart and clear of the references")
    own = df.select(F.col(key).alias("_k"), (F.col(score) <= within if within is not None else F.lit(None).cast("boolean")).alias("within"))
    return got.join(own, F.col(key) == F.col("_k")).select(key, "place", "similarity", "within")


def screened_top(df: DataFrame, key: str, text: str, score: str, raw: str, screen: Callable[[DataFrame], DataFrame], k: int, steps: list[greedy.Step], flags: dict[str, Column], cluster: str | None = None, first: int = FIRST) -> DataFrame:
    """As greedy.diverse_top, where a costly screen is asked only about the rows read so far.

    screen: rows to (key, rejected); a row that it gives no answer for, or null, is rejected. The rows by score
    (high first) and key are screened prefix by prefix until a step of the ladder fills k from those screened.
    """

    def test(part: DataFrame) -> DataFrame:
        answers = screen(part).select(F.col(key).alias("_k"), "rejected")
        joined = part.join(answers, F.col(key) == F.col("_k"), "left")
        return joined.withColumn("_external", F.coalesce("rejected", F.lit(True))).drop("_k", "rejected")

    def choose(seen: DataFrame) -> DataFrame | None:
        got = cut(greedy.diverse_top(seen, key, text, score, raw, k, steps, flags | {"external": F.col("_external")}, cluster, short=True))
        return got if got.count() == k else None

    got = until(df, [(score, False), (key, True)], test, choose, first)
    if got is None:
        raise ValueError(f"infeasible: the screen and the limits leave fewer than {k}")
    return got
