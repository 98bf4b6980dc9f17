"""Alignments of many pairs of strings at once: numpy over anti-diagonals of a batch of pairs.

Global alignments have affine gaps (a gap of n costs opening + (n - 1) * extension). Of equal scores the one
with more equal letters counts, then the one with fewer columns: score, letters and columns are summed up in
one whole number whose order is that order, so a plain maximum keeps all three. Scores are halves at least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: The letters of amino acids, and the BLOSUM45 scores of each with those up to itself.
LETTERS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM45 = """
5
-2 7
-1 0 6
-2 -1 2 7
-1 -3 -2 -3 12
-1 1 0 0 -3 6
-1 0 0 2 -3 2 6
0 -2 0 -1 -3 -2 -2 7
-2 0 1 0 -3 1 0 -2 10
-1 -3 -2 -4 -3 -2 -3 -4 -3 5
-1 -2 -3 -3 -2 -2 -2 -3 -2 2 5
-1 3 0 0 -3 1 1 -2 -1 -3 -3 5
-1 -1 -2 -3 -2 0 -2 -2 0 2 2 -1 6
-2 -2 -2 -4 -2 -4 -3 -3 -2 0 1 -3 0 8
-1 -2 -2 -1 -4 -1 0 -2 -2 -2 -3 -1 -2 -3 9
1 -1 1 0 -1 0 0 0 -1 -2 -3 -1 -2 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -1 -1 2 5
-2 -2 -4 -4 -5 -2 -3 -2 -3 -2 -2 -2 -2 1 -3 -4 -3 15
-2 -1 -2 -2 -3 -1 -2 -3 2 0 0 -1 0 3 -3 -2 -1 3 8
0 -2 -3 -3 -1 -3 -3 -3 -3 3 1 -2 1 0 -3 -1 0 -3 -1 5
"""
OTHER = -1  # of a letter that has no row with any, itself too

ROOM, SAME = 1 << 36, 1 << 18  # a half point of score, an equal letter; a column is -1
LOW = -(1 << 60)
CELLS = 1_000_000


def blosum45() -> np.ndarray:
    """Scores by place in LETTERS; the last row and column are of all other letters."""
    n = len(LETTERS)
    out = np.full((n + 1, n + 1), OTHER, np.int64)
    for i, line in enumerate(BLOSUM45.split("\n")[1:-1]):
        for j, v in enumerate(line.split()):
            out[i, j] = out[j, i] = int(v)
    return out


def points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the BLOSUM45 score of code points."""
    place = np.full(128, len(LETTERS), np.int64)
    place[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    at = lambda c: place[np.where((c >= 0) & (c < 128), c, 0)]
    return 2 * blosum45()[at(a), at(b)]


def equal_or_not(match: float, mismatch: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda a, b: np.where(a == b, int(2 * match), int(2 * mismatch))


def padded(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a text a row, and lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), pad, np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out[np.repeat(np.arange(len(texts)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def batches(a: list[str], b: list[str]) -> Iterator[np.ndarray]:
    """Places of pairs of about one length, so many that a batch's tables stay small."""
    size = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * (size[order[end]] + 2) <= CELLS:
            end += 1
        yield order[at:end]
        at = end


def global_alignments(a: list[str], b: list[str], score: Callable, opening: float, extension: float) -> tuple[np.ndarray, np.ndarray]:
    """(equal letters, columns) of a best global alignment of each pair; ``score`` gives twice the score of code points."""
    same, columns = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    new, more = int(2 * opening) * ROOM + 1, int(2 * extension) * ROOM + 1
    for own in batches(a, b):
        x, nx = padded([a[k] for k in own], -1)
        y, ny = padded([b[k] for k in own], -2)
        n, lx, ly = len(own), x.shape[1], y.shape[1]
        back = y[:, ::-1]
        sums = nx + ny
        ends = {k: np.flatnonzero(sums == k) for k in np.unique(sums).tolist()}
        best = np.full(n, LOW, np.int64)
        empty = lambda: np.full((n, lx + 1), LOW, np.int64)
        # of the last diagonal, by what the last column is: a pair, a letter of a alone, a letter of b alone; and the best of the one before
        m, p, q, before = empty(), empty(), empty(), empty()
        m[:, 0] = 0
        if 0 in ends:
            best[ends[0]] = 0
        for k in range(1, lx + ly + 1):
            lo, hi = max(0, k - ly), min(k, lx)
            m2, p2, q2 = empty(), empty(), empty()
            lo1, hi1 = max(1, lo), min(hi, k - 1)  # a pair needs a letter of both
            if lo1 <= hi1:
                u, v = x[:, lo1 - 1 : hi1], back[:, ly - k + lo1 : ly - k + hi1 + 1]
                m2[:, lo1 : hi1 + 1] = before[:, lo1 - 1 : hi1] + score(u, v) * ROOM + (u == v) * SAME - 1
            if hi >= 1:
                s = slice(max(1, lo) - 1, hi)
                p2[:, max(1, lo) : hi + 1] = np.maximum(np.maximum(m[:, s], q[:, s]) - new, p[:, s] - more)
            if lo <= k - 1:
                s = slice(lo, min(hi, k - 1) + 1)
                q2[:, s] = np.maximum(np.maximum(m[:, s], p[:, s]) - new, q[:, s] - more)
            before = np.maximum(np.maximum(m, p), q)
            m, p, q = m2, p2, q2
            if k in ends:
                r = ends[k]
                best[r] = np.maximum(np.maximum(m[r, nx[r]], p[r, nx[r]]), q[r, nx[r]])
        rest = (best + ROOM // 2) % ROOM - ROOM // 2
        same[own] = -((-rest) // SAME)
        columns[own] = same[own] * SAME - rest
    return same, columns


def local_scores(a: list[str], b: list[str]) -> np.ndarray:
    """Best local alignment of each pair: match 1, mismatch -1, gap -1."""
    out = np.zeros(len(a), np.int64)
    for own in batches(a, b):
        x, _ = padded([a[k] for k in own], -1)
        y, _ = padded([b[k] for k in own], -2)
        n, lx, ly = len(own), x.shape[1], y.shape[1]
        back = y[:, ::-1]
        now, before, best = np.zeros((n, lx + 1), np.int32), np.zeros((n, lx + 1), np.int32), np.zeros(n, np.int32)
        for k in range(2, lx + ly + 1):
            lo, hi = max(1, k - ly), min(k - 1, lx)
            new = np.zeros((n, lx + 1), np.int32)
            hit = np.where(x[:, lo - 1 : hi] == back[:, ly - k + lo : ly - k + hi + 1], 1, -1)
            new[:, lo : hi + 1] = np.maximum(np.maximum(before[:, lo - 1 : hi] + hit, 0), np.maximum(now[:, lo - 1 : hi], now[:, lo : hi + 1]) - 1)
            if lo <= hi:
                best = np.maximum(best, new[:, lo : hi + 1].max(axis=1))
            before, now = now, new
        out[own] = best
    return out


def by_pairs(a: pd.Series, b: pd.Series, work: Callable[[list[str], list[str]], np.ndarray]) -> pd.Series:
    """``work`` on the distinct pairs that hold no null, in lexical order."""
    known = (a.notna() & b.notna()).to_numpy()
    pairs = [(x, y) if x <= y else (y, x) for x, y in zip(a[known], b[known])]
    place = {p: k for k, p in enumerate(dict.fromkeys(pairs))}
    got = work([p[0] for p in place], [p[1] for p in place])
    out = pd.Series([None] * len(a), dtype=object)
    out[known] = [got[place[p]] for p in pairs]
    return out


def identities(a: list[str], b: list[str]) -> np.ndarray:
    """Equal letters over columns, under BLOSUM45 with gaps of 5 and 1; 1 for two empty strings."""
    same, columns = global_alignments(a, b, points, 5, 1)
    return np.where(columns > 0, same / np.maximum(columns, 1), 1.0)


def homologies(a: list[str], b: list[str], least: float = 0.8) -> np.ndarray:
    """Identity and coverage of at least ``least`` under match 2, mismatch -1, gaps of 2 and 0.5; never of an empty string."""
    same, columns = global_alignments(a, b, equal_or_not(2, -1), 2, 0.5)
    na, nb = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    longer, aligned = np.maximum(na, nb), na + nb - columns
    return (np.minimum(na, nb) > 0) & (same >= least * columns) & (aligned >= least * longer)


@F.pandas_udf(T.DoubleType())
def _identity(a: pd.Series, b: pd.Series) -> pd.Series:
    return by_pairs(a, b, identities).astype("float64")


@F.pandas_udf(T.BooleanType())
def _homology(a: pd.Series, b: pd.Series) -> pd.Series:
    return by_pairs(a, b, homologies).astype("boolean")


@F.pandas_udf(T.LongType())
def _local(a: pd.Series, b: pd.Series) -> pd.Series:
    return by_pairs(a, b, local_scores).astype("Int64")


def global_identity(a: Column, b: Column) -> Column:
    """Identity of two strings of amino acids; never above their longest common subsequence over the longer length."""
    return _identity(a, b)


def homology(a: Column, b: Column) -> Column:
    return _homology(a, b)


def local_score(a: Column, b: Column) -> Column:
    return _local(a, b)


def homologous_identity(a: Column, b: Column) -> Column:
    """1 for homologous strings, else 0: a measure for similar_pairs() at 0.8, since what is homologous shares a subsequence of 0.8 of the longer."""
    return F.when(_homology(a, b), 1.0).otherwise(0.0)
