"""Arrow-batched kernels for pairs of short strings: common subsequences; alignments are in align."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from . import align


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a's positions."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_lengths(text: str, others: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of one text with many: all others side by side in one row of bits.

    A bit between two of them takes the carry of the one before, so that none reaches its neighbour.
    """
    sizes = np.array([len(o) for o in others], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer("\0".join(others).encode("utf-32-le", "surrogatepass"), np.uint32)
    held = np.ones(len(codes), bool)
    held[starts[1:] - 1] = False
    bits = lambda at: int.from_bytes(np.packbits(at, bitorder="little").tobytes(), "little")
    masks = {c: bits((codes == ord(c)) & held) for c in set(text)}
    full = bits(held)
    row = full
    for c in text:
        if hit := row & masks[c]:
            row = (row + hit | row - hit) & full
    found = np.unpackbits(np.frombuffer((full & ~row).to_bytes(len(codes) // 8 + 1, "little"), np.uint8), bitorder="little")
    before = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
    return (before[starts + sizes] - before[starts]).tolist()


def local_score(a: str, b: str) -> int:
    """Best local alignment of one pair: match 1, mismatch -1, gap -1; of many pairs: align.local_scores()."""
    before, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, before[j] + (1 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        best = max(best, max(row))
        before = row
    return best


def local_ratio(a: str, b: str) -> float:
    """Local alignment score over the longer length; 0 for two empty strings."""
    return local_score(a, b) / max(len(a), len(b), 1)


def lcs_ratio(a: str, b: str) -> float:
    return 2 * lcs_length(*sorted((a, b), key=len)) / (len(a) + len(b)) if a or b else 1.0


def lcs_identity(a: str, b: str) -> float:
    return lcs_length(*sorted((a, b), key=len)) / max(len(a), len(b), 1)


@F.pandas_udf(T.LongType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_length(x, y) for x, y in zip(a, b)], dtype="Int64")


def ratio(a, b):
    """Indel similarity 2 LCS / (len a + len b); 1 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * lcs(a, b) / total)


def identity(a, b):
    """LCS over the longer length."""
    return lcs(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))


def local_similarity(a, b):
    return align.local_score(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))
