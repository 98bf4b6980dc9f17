"""Joins with contracts, and similarity joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import align, kernels
from .graph import over_blocks, spread


class ContractError(ValueError):
    """A table breaks what a join or a reader asks of it."""


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).count().where("count > 1")


def require_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    if bad := repeated(df, keys).take(1):
        raise ContractError(f"{name} repeats the key {bad[0].asDict()}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return require_unique(left, on, "left").join(require_unique(right, on, "right"), on, how)


def join_many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(require_unique(right, on, "right"), on, how)


def join_with_presence(left: DataFrame, right: DataFrame, on: list[str], flag: str = "present") -> DataFrame:
    """Left join that keeps what is missing visible."""
    return left.join(right.withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def require_covered(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    if bad := left.select(*on).join(right, on, "left_anti").take(1):
        raise ContractError(f"no row for {bad[0].asDict()}")
    return left


def in_order_of(df: DataFrame, key: str, order: DataFrame, position: str = "position") -> DataFrame:
    """Rows of the keys listed in ``order`` (key, position), in that order."""
    return df.join(order, key).orderBy(position)


def _tokens(df: DataFrame) -> DataFrame:
    """(id, s, m) -> (id, m, token): each letter with how often it came before, as a set."""
    letters = F.array_sort(F.filter(F.split("s", ""), lambda c: c != ""))
    numbered = df.select("id", "m", letters.alias("c")).select("id", "m", F.transform("c", lambda x, i: F.concat(x, (i - F.array_position("c", x)).cast("string"))).alias("t"))
    return numbered.select("id", "m", F.explode("t").alias("token"))


def _by_rare_letters(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Candidate pairs (a.id, b.id) that share one of their rarest letters.

    A common subsequence is shared letters, so a ratio is at most twice the shared letters over both
    lengths; of n letters, all but n * least / (2 - least), and one more, taken rarest first, hold one in common.
    """
    ta, tb = _tokens(a), _tokens(b)
    rare = ta.select("token").unionByName(tb.select("token")).groupBy("token").agg(F.count("*").alias("f"))  # alphabet x length

    def head(t: DataFrame, name: str) -> DataFrame:
        listed = t.join(rare, "token").groupBy("id", "m").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("l"))
        n = F.col("m") - F.ceil(F.col("m") * F.lit(least / (2 - least)) - 1e-9) + 1
        return listed.select(F.col("id").alias(name), F.col("m").alias(f"{name}_m"), F.explode(F.slice("l", 1, n.cast("int"))).alias("_e")).select(name, f"{name}_m", F.col("_e.token").alias("token"))

    hit = head(ta, "x").join(head(tb, "y"), "token").where(2 * F.least("x_m", "y_m") >= F.lit(least) * (F.col("x_m") + F.col("y_m")) - 1e-9)
    empty = a.where("m = 0").select(F.col("id").alias("x"), F.lit(0).alias("k")).join(b.where("m = 0").select(F.col("id").alias("y"), F.lit(0).alias("k")), "k")
    return hit.select("x", "y").unionByName(empty.select("x", "y"))


def similar_pairs(left: DataFrame, right: DataFrame, text: str, least: float, itself: bool = False, id_: str = "id", measure=None, within: list[str] | None = None) -> DataFrame:
    """Pairs (id_a, id_b, ratio) of short texts with a ratio 2 LCS / (len a + len b) >= least; self-joins give a pair once, the smaller id first.

    ``measure``: another column function of two texts that is never above that ratio, such as
    kernels.identity. ``within``: columns that both ends share; from 0.75 on they are part of the candidates' key,
    below it they are compared before any alignment. Below 0.75 candidates share a rare letter; from 0.75 on they share a segment:

    Candidates come from an equi-join, not a product. A pair with that ratio is at most D insertions and
    deletions apart, D following from the shorter length n; so of D + 1 segments of the shorter text one
    stands unchanged in the longer, at most D places off. Shorter texts give their segments, longer ones
    the substrings in reach, keyed by (n, segment, characters). Pairs of ids are made distinct before
    texts are fetched, cut by letter counts, then aligned.
    """
    of = F.struct(*within) if within else F.lit(0)
    rows = lambda df: df.select(F.col(id_).alias("id"), F.col(text).alias("s"), F.length(text).alias("m"), of.alias("g")).where("s IS NOT NULL")
    a, b = rows(left), rows(right)
    wide = 2.0 / least - 1.0  # longer <= wide * shorter
    reach = lambda n: F.floor(F.lit((1.0 - least) * (1.0 + wide)) * n + 1e-9).cast("int")
    place = lambda n, k, i: F.floor(i * n / k).cast("int")  # noqa: E731  where segment i of k begins, from 0
    key = lambda n, i, c: F.xxhash64(n, i, c, "g").alias("key")

    def short_side(df: DataFrame) -> DataFrame:
        seg = df.withColumn("k", reach(F.col("m")) + 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        at, end = place(F.col("m"), F.col("k"), F.col("i")), place(F.col("m"), F.col("k"), F.col("i") + 1)
        return seg.select("id", "s", key(F.col("m"), F.col("i"), F.substring(F.col("s"), at + 1, end - at)))

    def long_side(df: DataFrame) -> DataFrame:
        n = df.withColumn("n", F.explode(F.sequence(F.ceil(F.col("m") / F.lit(wide) - 1e-9).cast("int"), F.col("m")))).withColumn("k", reach(F.col("n")) + 1)
        seg = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        seg = seg.withColumn("at", place(F.col("n"), F.col("k"), F.col("i"))).withColumn("len", place(F.col("n"), F.col("k"), F.col("i") + 1) - F.col("at"))
        low, high = F.greatest(F.col("at") - F.col("k") + 1, F.lit(0)), F.least(F.col("at") + F.col("k") - 1, F.col("m") - F.col("len"))
        seg = seg.where(high >= low).withColumn("p", F.explode(F.sequence(low, high)))
        return seg.select(F.col("id").alias("id2"), F.col("s").alias("s2"), key(F.col("n"), F.col("i"), F.substring(F.col("s"), F.col("p") + 1, F.col("len")))).distinct()

    if least < 0.75:
        hit = _by_rare_letters(a, b, least)
    else:
        hit = short_side(a).select("key", F.col("id").alias("x")).join(long_side(b).select("key", F.col("id2").alias("y")), "key").select("x", "y")
        if not itself:
            hit = hit.unionByName(short_side(b).select("key", F.col("id").alias("y")).join(long_side(a).select("key", F.col("id2").alias("x")), "key").select("x", "y"))
    if itself:
        hit = hit.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = hit.distinct().join(a.select(F.col("id").alias("x"), F.col("s").alias("a"), F.col("g").alias("ga")), "x").join(b.select(F.col("id").alias("y"), F.col("s").alias("b"), F.col("g").alias("gb")), "y")
    pairs = pairs.where("ga = gb") if within else pairs
    total = F.length("a") + F.length("b")
    pairs = pairs.where(2 * letter_bound(F.col("a"), F.col("b")) >= F.lit(least) * total - 1e-9)
    pairs = pairs.withColumn("ratio", (measure or kernels.ratio)(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)
    return pairs.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), "ratio")


def aligned_pairs(df: DataFrame, text: str, id_: str, least: float = 0.8, homologous: bool = False) -> DataFrame:
    """Edges (id_a, id_b, ratio) of a table to itself by alignment, not by common letters alone.

    Global identity (BLOSUM45) of at least ``least``; or homology: identity and coverage of 0.8, with a ratio of 1.
    Either needs a common subsequence of that share of the longer text, so candidates are those of similar_pairs().
    """
    measure = align.homologous_identity if homologous else align.global_identity
    return similar_pairs(df, df, text, 0.8 if homologous else least, itself=True, id_=id_, measure=measure)


def letter_bound(a: Column, b: Column) -> Column:
    """Upper bound of a common subsequence: shared ASCII letters by count, other characters freely."""
    total = F.lit(0)
    rest_a, rest_b = F.length(a), F.length(b)
    for c in "abcdefghijklmnopqrstuvwxyz ":
        na = F.length(a) - F.length(F.replace(a, F.lit(c), F.lit("")))
        nb = F.length(b) - F.length(F.replace(b, F.lit(c), F.lit("")))
        total, rest_a, rest_b = total + F.least(na, nb), rest_a - na, rest_b - nb
    return total + F.least(rest_a, rest_b)


class References:
    """A block of reference texts by length, with letter counts (letters fall into buckets, which keeps bounds safe)."""

    BUCKETS = 48

    def __init__(self, texts: list[str]):
        self.texts = sorted(texts, key=lambda t: (len(t), t))
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.counts = np.stack([self.letters(t) for t in self.texts]) if texts else np.zeros((0, self.BUCKETS), np.int32)

    @classmethod
    def letters(cls, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.bincount(codes % cls.BUCKETS, minlength=cls.BUCKETS).astype(np.int32)

    def best(self, text: str, top: float, by_longer: bool, measure, enough: float = float("inf")) -> float:
        """The highest measure over the texts and ``top``; texts whose bound isn't above the best so far are not aligned."""
        n = len(text)
        if not len(self.sizes):
            return top
        if not n and not by_longer and self.sizes[0] == 0:
            return 1.0
        under = np.maximum(self.sizes, n) if by_longer else (self.sizes + n) / 2
        short = np.minimum(self.sizes, n) / np.maximum(under, 1)
        at = np.flatnonzero(short > top)
        bound = np.minimum(self.counts[at], self.letters(text)).sum(axis=1) / np.maximum(under[at], 1)
        order, done, size = np.argsort(-bound, kind="stable"), 0, 4
        while done < len(order) and bound[order[done]] > top and top < enough:
            some = order[done : done + size]
            top = max(top, *measure(text, [self.texts[k] for k in at[some[bound[some] > top]]]))
            done, size = done + size, min(2 * size, 512)  # the first few mostly settle it
        return top


def _local_ratios(text: str, others: list[str]) -> list[float]:
    return (align.local_scores([text] * len(others), others) / np.maximum([max(len(text), len(o)) for o in others], 1)).tolist()


def _lcs_ratios(text: str, others: list[str]) -> list[float]:
    return [2 * k / (len(text) + len(o)) if text or o else 1.0 for k, o in zip(kernels.lcs_lengths(text, others), others)] if others else []


def max_similarity(left: DataFrame, reference: DataFrame, text: str, id_: str, most_rows: int = 50_000, local: bool = False) -> DataFrame:
    """(id, max_ratio) of each left text over all reference texts: by common subsequences, or by local alignments.

    The reference, a stated set, is broadcast in blocks of ``most_rows``. Of a block only texts whose length and
    letter-count bounds beat the best so far are aligned, the highest bound first.
    """
    ref = reference.select(text).where(F.col(text).isNotNull()).distinct()

    def merged(state: DataFrame, block: list) -> DataFrame:
        shared = left.sparkSession.sparkContext.broadcast(References(block))

        @F.pandas_udf("double")
        def best(texts: pd.Series, tops: pd.Series) -> pd.Series:
            measure = _local_ratios if local else _lcs_ratios
            return pd.Series([None if t is None else shared.value.best(t, top, local, measure) for t, top in zip(texts, tops)], dtype="float64")

        return state.withColumn("max_ratio", best(F.col(text), F.col("max_ratio")))

    state = spread(left.select(id_, text)).withColumn("max_ratio", F.when(F.col(text).isNotNull(), F.lit(0.0)))
    return over_blocks(state, ref, most_rows, merged).select(id_, "max_ratio")


def above(left: DataFrame, reference: DataFrame, text: str, most: float, local: bool = False, most_rows: int = 50_000) -> DataFrame:
    """(id): left texts with a similarity above ``most`` to some reference text; alignment ends at the first one found."""
    ref = reference.select(text).where(F.col(text).isNotNull()).distinct()

    def merged(state: DataFrame, block: list) -> DataFrame:
        shared = left.sparkSession.sparkContext.broadcast(References(block))

        @F.pandas_udf("boolean")
        def hit(texts: pd.Series, seen: pd.Series) -> pd.Series:
            measure = _local_ratios if local else _lcs_ratios
            return pd.Series([bool(s) or t is not None and shared.value.best(t, most, local, measure, np.nextafter(most, 2)) > most for t, s in zip(texts, seen)])

        # a filter that Spark may move would go below the deal and the groups, to every row that these were made of
        return state.withColumn("hit", hit.asNondeterministic()(F.col(text), F.col("hit")))

    return over_blocks(spread(left.select("id", text)).withColumn("hit", F.lit(False)), ref, most_rows, merged).where("hit").select("id")


def clear_of(left: DataFrame, reference: DataFrame, text: str, id_: str, most: float, local: bool = False) -> DataFrame:
    """Left rows whose similarity to every reference text is at most ``most``."""
    near = above(left.select(F.col(id_).alias("id"), text), reference, text, most, local).select(F.col("id").alias("_near"))
    return left.join(near, F.col(id_) == F.col("_near"), "left_anti")


def require_aligned(records: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The records, if each has a row of its key in the table with equal columns; else an error that names one."""
    other = table.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    if bad := records.join(other, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | ~same).take(1):
        raise ContractError(f"no equal row for {bad[0][key]!r}")
    return records


def scores_for(rows: DataFrame, scores: DataFrame, key: str, score: str, valid: Column) -> DataFrame:
    """Rows with their score by key; a valid row without one is an error when it is read, others may lack it."""
    joined = rows.join(scores.select(key, score), key, "left")
    missing = valid & (F.col(score).isNull() | F.isnan(F.col(score).cast("double")))
    return joined.withColumn(score, F.when(missing, F.raise_error(F.concat(F.lit("no score for "), F.col(key).cast("string"))).cast("double")).otherwise(F.col(score)))


def tensor_cells(measured: DataFrame, cells: DataFrame, on: list[str], value: str, threshold: float = 16.0) -> DataFrame:
    """Measured rows with median and median absolute deviation of log2 of their cell's values, and the share at most the threshold."""
    x = F.log2(value)
    base = cells.groupBy(*on).agg(F.sort_array(F.collect_list(x)).alias("_x"), F.avg((F.col(value) <= threshold).cast("double")).alias("share"))  # a cell has a value a model

    def middle(a: Column) -> Column:
        n = F.size(a)
        return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2

    base = base.withColumn("median", middle(F.col("_x"))).withColumn("mad", middle(F.array_sort(F.transform("_x", lambda v: F.abs(v - F.col("median"))))))
    return measured.join(base.select(*on, "median", "mad", "share"), on, "left")


def missing_pairs(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) of either order that the known table has in neither."""
    order = lambda df: df.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    return order(wanted).join(order(known), ["id_a", "id_b"], "left_anti")


def extended_matrix(texts: DataFrame, known: DataFrame, id_: str, text: str, measure=align.global_identity, block: int = 2048) -> DataFrame:
    """(id_a, id_b, ratio), id_a below id_b: every cell of a table's matrix, from known cells where there are some, else by the measure.

    Ids and texts are unique; known cells (id_a, id_b, ratio) are of rows of the table, finite and the same in both
    orders, those of the diagonal 1; a measured value outside [0, 1] is an error. Rows meet by pairs of blocks of
    about ``block`` rows, so a task holds block^2 cells; the diagonal, which is 1, is left out.
    """
    require_unique(texts, [id_], "texts")
    require_unique(texts, [text], "texts")
    cells = known.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.min("ratio").alias("ratio"), F.max("ratio").alias("_top"), F.count("ratio").alias("_n"), F.count("*").alias("_m"))
    sound = (F.col("_n") == F.col("_m")) & (F.abs(F.col("_top") - F.col("ratio")) <= 1e-8) & ~F.isnan("_top") & ~F.col("_top").isin(float("inf"), float("-inf")) & ((F.col("id_a") != F.col("id_b")) | (F.abs(F.col("ratio") - 1) <= 1e-8))
    if bad := cells.where(~F.coalesce(sound, F.lit(False))).take(1):
        raise ContractError(f"known cell ({bad[0].id_a!r}, {bad[0].id_b!r}) isn't one finite value")
    require_covered(cells.select(F.explode(F.array("id_a", "id_b")).alias(id_)).distinct(), texts.select(id_), [id_])
    count = max(1, -(-texts.count() // block))
    own = texts.select(F.col(id_).alias("id"), F.col(text).alias("s"), F.pmod(F.xxhash64(id_), F.lit(count)).cast("int").alias("k"))
    others = F.sequence(F.lit(0), F.lit(count - 1))
    left = own.select(F.col("id").alias("x"), F.col("s").alias("a"), F.col("k").alias("ka"), F.explode(others).alias("kb"))
    right = own.select(F.col("id").alias("y"), F.col("s").alias("b"), F.explode(others).alias("ka"), F.col("k").alias("kb"))
    wanted = left.join(right, ["ka", "kb"]).where("x < y")
    missing = wanted.join(cells.select(F.col("id_a").alias("x"), F.col("id_b").alias("y")), ["x", "y"], "left_anti")
    measured = missing.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), measure(F.col("a"), F.col("b")).alias("ratio"))
    fraction = F.coalesce(F.col("ratio").between(0, 1), F.lit(False))
    measured = measured.withColumn("ratio", F.when(fraction, F.col("ratio")).otherwise(F.raise_error(F.lit("an identity isn't a fraction")).cast("double")))
    return cells.where("id_a <> id_b").select("id_a", "id_b", F.col("ratio").cast("double")).unionByName(measured)


def ratio_bounds_by_key(a: DataFrame, b: DataFrame, key: str, ratios: list[float]) -> DataFrame:
    """(key, ratio, certain, possible): for each key with both intervals (lower, upper) whether b / a surely, or possibly, reaches each ratio."""
    both = a.select(key, F.col("lower").alias("al"), F.col("upper").alias("au")).join(b.select(key, F.col("lower").alias("bl"), F.col("upper").alias("bu")), key)
    grid = both.withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))
    return grid.select(key, "ratio", F.coalesce(F.col("bl") >= F.col("ratio") * F.col("au"), F.lit(False)).cast("int").alias("certain"), (F.col("bu").isNull() | F.col("al").isNull() | (F.col("bu") >= F.col("ratio") * F.col("al"))).cast("int").alias("possible"))


def unique_match(left: DataFrame, right: DataFrame, on: list[str], id_: str) -> DataFrame:
    """Left rows with the right id whose keys are all equal (null equals null), where just one is; ``matches`` counts them."""
    marks = right.groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(F.count("*").alias("matches"), F.min(id_).alias("_id"))
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = left.join(marks, cond, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("match", F.when(F.col("matches") == 1, F.col("_id"))).drop("_id", *[f"_{c}" for c in on])


def near_values(a: DataFrame, b: DataFrame, on: list[str], value: str, relative: float = 0.01, absolute: float = 0.005) -> DataFrame:
    """(id_a, id_b): rows of equal keys whose values differ by at most a share of the larger, or absolutely.

    Values go into logarithmic cells twice as wide as the tolerance, so that only neighbouring cells meet.
    """
    width = 2 * relative
    cell = lambda c: F.floor(F.log(F.greatest(F.abs(c), F.lit(absolute / relative))) / width)
    x = a.select(F.col("id").alias("id_a"), *on, F.col(value).alias("va"), F.explode(F.sequence(cell(F.col(value)) - 1, cell(F.col(value)) + 1)).alias("cell"))
    y = b.select(F.col("id").alias("id_b"), *on, F.col(value).alias("vb"), cell(F.col(value)).alias("cell"))
    gap = F.abs(F.col("va") - F.col("vb"))
    return x.join(y, [*on, "cell"]).where((gap <= absolute) | (gap <= relative * F.greatest(F.abs("va"), F.abs("vb")))).select("id_a", "id_b")


def pairs_of_ids(pairs: DataFrame, rows: DataFrame, id_: str) -> DataFrame:
    """Pairs (id_a, id_b) with both ends' rows as structs left and right; a pair and its reverse are an error, and so is an end without a row."""
    key = [F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi")]
    if bad := pairs.groupBy(*key).count().where("count > 1").take(1):
        raise ContractError(f"the pair {bad[0].lo}, {bad[0].hi} comes twice")
    ends = rows.select(F.col(id_).alias("_id"), F.struct(*rows.columns).alias("row"))
    require_covered(pairs.select(F.col("id_a").alias("_id")).unionByName(pairs.select(F.col("id_b").alias("_id"))), ends, ["_id"])
    left, right = (ends.select(F.col("_id").alias(i), F.col("row").alias(n)) for i, n in (("id_a", "left"), ("id_b", "right")))
    return pairs.join(left, "id_a").join(right, "id_b")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n): for each key column how many distinct values stand in both tables; all 0 if they are apart."""
    side = lambda df, n: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in keys])).alias("x")).select("x.key", "x.v").where("v IS NOT NULL").distinct().withColumn(n, F.lit(1))
    both = side(a, "a").join(side(b, "b"), ["key", "v"]).groupBy("key").agg(F.count("*").alias("n"))
    spine = a.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return spine.join(both, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def pairs_within(df: DataFrame, group: list[str], text: str, least: float, evidence: DataFrame) -> DataFrame:
    """(id_a, id_b, ratio, known): similar pairs of different texts that share a group; known: the pair is in ``evidence`` (id_a, id_b)."""
    near = similar_pairs(df, df, text, least, itself=True, within=group)
    ends = lambda i, n: df.select(F.col("id").alias(i), F.col(text).alias(f"t{n}"))
    same = near.where("ratio < 1").join(ends("id_a", 1), "id_a").join(ends("id_b", 2), "id_b").where("t1 <> t2")
    seen = evidence.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct().withColumn("known", F.lit(True))
    return same.join(seen, ["id_a", "id_b"], "left").select("id_a", "id_b", "ratio", F.coalesce("known", F.lit(False)).alias("known"))


def changed_edges(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b, ratio_a, ratio_b): pairs that reach the ratio in one table only; a pair that a table lacks has none there."""
    both = a.withColumnRenamed("ratio", "ratio_a").join(b.withColumnRenamed("ratio", "ratio_b"), ["id_a", "id_b"], "full")
    is_edge = lambda c: F.coalesce(F.col(c) >= least, F.lit(False))
    return both.where(is_edge("ratio_a") != is_edge("ratio_b")).select("id_a", "id_b", "ratio_a", "ratio_b")
