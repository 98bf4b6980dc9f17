"""Packing of tokenised documents into sequences by bin completion.

Only the histogram of piece lengths decides a packing, and it has at most ``capacity`` entries whatever
the corpus holds; so it is solved on the driver and the pieces are placed by rank, in parallel.

Solver: best fit decreasing gives the incumbent. Bin completion then takes the largest length left and
enumerates the undominated fillings of the space around it: no part of such a filling (nor nothing) can
be exchanged for one larger or equal piece that is left, which is Martello and Toth's dominance. They come
one by one, exact sums first, then by waste, large pieces before small ones, and none is left out. A
branch is cut when the waste so far shows that it can't beat the incumbent. The search ends when the
lower bound (Martello and Toth's) is met or after ``nodes`` fillings tried beyond the first descent, with
the incumbent; that is its only limit, and None searches to the end. A filling is tried as often at once
as its lengths last, then fewer times.

Rows: null text is empty (one piece, the end token alone); repeated rows are packed as often as they
come; null ids are kept; columns other than doc_id and text aren't used; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import byte_alphabet
from .common import blocks, cut

CAPACITY, END_TOKEN, NODES = 4096, 1, 2000
#: Steps of an enumeration that found nothing which count as one filling tried.
FRUITLESS = 500
#: Levels of the search, the deepest, whose tables of sums are held at once.
KEEP = 8
CACHE_WORDS, CACHE_BYTES = 200_000, 64

Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: np.ndarray, cap: int) -> int:
    """Bins that any packing needs; counts[L] = pieces of length L, L up to cap."""
    size = np.arange(cap + 1)
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * size)])
    best = -(-int(s[-1]) // cap)
    half = cap // 2
    for k in range(half + 1):  # pieces over cap - k stand alone; those from k to half fill what the large ones leave
        big = int(n[cap + 1] - n[half + 1])
        mid_n, mid_s = int(n[cap - k + 1] - n[half + 1]), int(s[cap - k + 1] - s[half + 1])
        small = int(s[half + 1] - s[k])
        best = max(best, big + max(0, -(-(small - (mid_n * cap - mid_s)) // cap)))
    return best


def best_fit(counts: np.ndarray, cap: int) -> Plan:
    """Best fit decreasing over the histogram: bins of equal content are moved together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    has = np.zeros(cap + 1, bool)

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if times:
            open_bins.setdefault(room, []).append((pattern, times))
            has[room] = True

    for length in range(cap, 0, -1):
        left = int(counts[length])
        while left:
            fit = np.flatnonzero(has[length:])
            if len(fit):
                room = int(fit[0]) + length
                pattern, times = open_bins[room].pop()
                has[room] = bool(open_bins[room])
            else:
                room, pattern, times = cap, (), left
            k = room // length
            full = min(times, left // k)
            put((*pattern, *(length,) * k), full, room - k * length)
            left -= full * k
            times -= full
            if times and left:
                put((*pattern, *(length,) * left), 1, room - left * length)
                times, left = times - 1, 0
            if pattern:
                put(pattern, times, room)
    return [b for bins in open_bins.values() for b in bins]


def spread(sums: int, width: int) -> int:
    """The bit set of s + k for the members s and 0 <= k <= width."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        sums |= sums << step
        done += step
    return sums


def times_more(sums: int, x: int, m: int) -> int:
    """Subset sums after m more pieces of length x."""
    chunk = 1
    while m:
        take = min(chunk, m)
        sums |= sums << (x * take)
        m, chunk = m - take, 2 * chunk
    return sums


def dominated(filling: tuple[int, ...], waste: int, left: dict[int, int], free: int) -> bool:
    """Whether some part of the filling, or nothing, can be exchanged for one piece of those left that is as large or larger.

    A piece x can take the place of a part of sum s if s <= x <= s + waste; x for x itself doesn't count.
    ``left``: how many pieces there are of each length, the filling's own among them; ``free``: these lengths as bits.
    """
    own: dict[int, int] = {}
    for x in filling:
        own[x] = own.get(x, 0) + 1
    sums = 1
    for x, m in own.items():
        sums = times_more(sums, x, m)
        free &= ~(1 << x)
    if spread(sums, waste) & free:
        return True
    more = [x for x, m in own.items() if left[x] > m]
    high = spread(sums << 1, waste - 1) if waste and more else 0
    for x in more:
        rest = 1
        for y, m in own.items():
            if y < x:
                rest = times_more(rest, y, m)
        if (high | rest) >> x & 1:
            return True
    return False


class Space:
    """What is left beside one piece ``top`` that fits into ``room``: lengths, their numbers, and the sums they make.

    The tables (up to 2 MB) are made when first asked for, from the counts as they stand; ``drop`` lets go of
    them, and they are made again, from the same counts, when the search comes back.
    """

    def __init__(self, counts: np.ndarray, top: int, room: int):
        self.counts, self.top, self.room, self.tables = counts, top, room, None

    def have(self, x: int) -> int:
        return int(self.counts[x]) - int(x == self.top)

    def get(self) -> tuple[list[int], dict[int, int], int, list[int]]:
        """(lengths from short to long, number of each, lengths as bits, sums that the so many shortest make)."""
        if self.tables is None:
            low = np.flatnonzero(self.counts[: self.room + 1]).tolist()
            left = dict(zip(low, self.counts[low].tolist()))
            if self.top in left:
                left[self.top] -= 1
            low, full, reach = [x for x in low if left[x]], (1 << (self.room + 1)) - 1, [1]
            for x in low:
                reach.append(times_more(reach[-1], x, min(left[x], self.room // x)) & full)
            self.tables = low, left, sum(1 << x for x in low), reach
        return self.tables

    def drop(self) -> None:
        self.tables = None


def undominated(space: Space, most: int) -> Iterator[tuple[tuple[int, ...] | None, int]]:
    """(lengths, waste) of every undominated filling of the space with at most ``most`` waste.

    (None, 0) stands for FRUITLESS steps without a filling.
    """
    room, have = space.room, space.have
    if room and have(room) > 0:
        yield (room,), 0  # dominates all others
        return
    for a in range(room - 1, (room - 1) // 2, -1):
        b = room - a
        if have(a) > 0 and have(b) > (a == b):
            yield (a, b), 0
    steps = 0

    def of_sum(j: int, rest: int, taken: tuple[int, ...], sums: int) -> Iterator[tuple[int, ...] | None]:
        """Fillings that add ``rest`` from the j smallest lengths to ``taken``, whose subset sums are ``sums``."""
        nonlocal steps
        if not rest:
            yield taken
            return
        while j and space.get()[3][j] >> rest & 1:
            j -= 1
            low, left, free, reach = space.get()
            x = low[j]
            for m in range(min(left[x], rest // x), 0, -1):
                low, left, free, reach = space.get()
                if not reach[j] >> (rest - m * x) & 1:
                    continue
                steps += 1
                if steps % FRUITLESS == 0:
                    yield None
                new = times_more(sums, x, m)
                # parts of two or more pieces that make a longer piece left over: every filling below is dominated
                made = (new & ~sums & free) >> (x + 1) << (x + 1)
                if made and made & ~sum(1 << y for y in set(taken) if left[y] == taken.count(y)):
                    continue
                del low, left, free, reach
                yield from of_sum(j, rest - m * x, (*taken, *(x,) * m), new)

    for waste in range(min(most, room) + 1):
        if not space.get()[3][-1] >> (room - waste) & 1:
            continue
        for found in of_sum(len(space.get()[0]), room - waste, (), 1):
            if found is None:
                yield None, 0
            elif not (waste == 0 and len(found) == 2) and not dominated(found, waste, *space.get()[1:3]):
                yield found, waste


def solve(counts: np.ndarray, cap: int = CAPACITY, nodes: int | None = NODES) -> Plan:
    """Patterns of lengths and how often each is used; together they hold counts exactly."""
    counts = np.asarray(counts, np.int64).copy()
    full = int(counts[cap])
    counts[cap] = 0
    whole: Plan = [((cap,), full)] if full else []
    best = best_fit(counts, cap)
    n_best, bound = sum(m for _, m in best), lower_bound(counts, cap)
    total = int((counts * np.arange(cap + 1)).sum())
    spare, tried, descended = (n_best - 1) * cap - total, 0, False
    path: list[tuple[np.ndarray, np.ndarray, tuple[int, ...], int, int]] = []  # kinds, of each, pattern, times, waste
    stack: list[Iterator] = []
    spaces: list[Space] = []
    work = counts.copy()
    spent = 0

    def choices() -> Iterator[tuple | None]:
        top = int(np.flatnonzero(work)[-1])
        spaces.append(Space(work, top, cap - top))
        if len(spaces) > KEEP:
            spaces[-KEEP - 1].drop()
        for filling, waste in undominated(spaces[-1], spare - spent):
            if filling is None:
                yield None
                continue
            kinds, need = np.unique((top, *filling), return_counts=True)
            for times in range(int((work[kinds] // need).min()), 0, -1):
                yield kinds, need, (top, *filling), times, waste

    def undo() -> None:
        nonlocal spent
        kinds, need, _, times, waste = path.pop()
        work[kinds] += need * times
        spent -= waste * times

    if n_best > bound:
        stack.append(choices())
    while stack and n_best > bound and (nodes is None or tried <= nodes):
        step = next(stack[-1], ())
        if step == ():
            stack.pop()
            spaces.pop()
            if path:
                undo()
            descended = True
            continue
        tried += descended
        if step is None:
            tried += not descended
            continue
        kinds, need, _, times, waste = step
        if spent + waste * times > spare:
            continue
        work[kinds] -= need * times
        path.append(step)
        spent += waste * times
        if work.any():
            stack.append(choices())
            continue
        descended = True
        used = sum(p[3] for p in path)
        if used < n_best:
            best, n_best = [(p[2], p[3]) for p in path], used
            spare = (n_best - 1) * cap - total
        undo()
    return whole + [(tuple(sorted(p, reverse=True)), m) for p, m in best]


def slots(plan: Plan) -> tuple[np.ndarray, ...]:
    """Rank ranges of each length: arrays (key, first sequence, copies, offset), sorted by key = length << 40 | first rank."""
    rows, base, rank = [], 0, {}
    for pattern, times in plan:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            copies = pattern.count(length)
            first = rank.get(length, 0)
            rows.append((length << 40 | first, base, copies, at))
            rank[length] = first + copies * times
            at += copies * length
        base += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 4


class Words:
    """Token ids of texts, through a bounded cache of white-space-separated words.

    The vocabulary's pattern drops white space and no token crosses it, so words are encoded apart. Words
    of Latin letters, which normalisation only lower-cases, are cut by the vocabulary's own pattern and
    go to the library's model by the piece; other words go through its whole pipeline.
    """

    def __init__(self, path: str):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.model = models.BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], end_of_word_suffix=model["end_of_word_suffix"])
        marks = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.marks = {m: i.to_bytes(4, "little") for m, i in marks.items()}
        self.at_marks = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")").split if marks else None
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.little = [i.to_bytes(4, "little") for i in range(max(model["vocab"].values(), default=0) + 1)]
        self.table = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            wide = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.table)
            got = b"".join([self.little[t.id] for t in self.model.tokenize(wide)])
            if len(piece) <= CACHE_BYTES:
                if len(self.pieces) >= CACHE_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if text.isascii() or max(text) < "\u0250" and "\u0130" not in text:
            low = text.lower()
            if low.isalpha():  # a letter run is one match of the pattern, and so is a mark behind it
                return self._piece(low)
            if low[-1] in ".,;:!?" and low[:-1].isalpha():
                return self._piece(low[:-1]) + self._piece(low[-1])
            return b"".join(map(self._piece, self.cut(low)))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.at_marks and any(m in text for m in self.marks):  # the library cuts these out first
            return b"".join([self.marks[part] if k % 2 else self._ids(part) for k, part in enumerate(self.at_marks(text))])
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        words = text.encode("utf-8").split()
        cache, old = self.cache, self.old
        for w in words:
            if w not in cache:
                cache[w] = old[w] if w in old else self._word(w)
        out = b"".join(map(cache.__getitem__, words))
        for w in [w for w in words if len(w) > CACHE_BYTES]:
            cache.pop(w, None)
        if len(cache) > CACHE_WORDS:  # what is used again moves on to the new one
            self.cache, self.old = {}, cache
        return out


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """docs -> doc_id, piece, start, length, ids_crc32 and, if kept, ids (little-endian unsigned 32-bit)."""
    end = np.array([END_TOKEN], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        for batch in (part for whole in batches for part in blocks(whole)):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = w.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(cols, kinds, names)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(parts: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ...), which are read twice: give a stored table.

    A length's pieces are ranked by salt, so that no length, however common, is ordered in one task.
    """
    spark = parts.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = cut(counts.withColumn("_base", F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")), "lengths")
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("_n")).collect():  # at most `capacity` rows
        hist[length] = n
    plan = spark.sparkContext.broadcast(slots(solve(hist, capacity, nodes)))
    own = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("_own", own.cast("long")).join(counts.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), "_base").hint("merge"), (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.select(*parts.columns, (F.col("_base") + F.col("_own") - 1).alias("_rank"))
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, copies, at = plan.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
            slot = np.searchsorted(key, length << 40 | rank, side="right") - 1
            own = rank - (key[slot] & ((1 << 40) - 1))
            sequence, offset = base[slot] + own // copies[slot], at[slot] + own % copies[slot] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    return ranked.mapInArrow(run, T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, nodes: int = NODES, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and place documents."""
    return place(cut(pieces(docs, path, capacity, keep_ids), "pieces"), capacity, nodes)
