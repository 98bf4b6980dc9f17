"""Personal data by a semi-Markov conditional random field over whole spans, beside exact base patterns.

Base spans of each kind are leftmost and non-overlapping, and all stay. The field adds spans that the
patterns miss (telephone numbers without a plus sign, cards in other groupings, spaced-out addresses):
runs of words with digits or ``@`` are cut into tokens; every span of at most ``MAX_TOKENS`` tokens that
could be of a kind is scored by features of the whole span and its surroundings; a dynamic program over
span ends picks boundaries and kinds jointly; of segmentations that score alike it takes the one whose
spans come first in the candidates' order. A span that touches a base span isn't added. Weights are
fitted by conditional likelihood (gradients by forward-backward over segmentations) on sentences that
``examples`` makes from a seed, with look-alikes (dates, prices, order numbers, versions) unlabelled.

Offsets are code points, ends exclusive. Rows: null and empty texts have no spans; texts are scanned
whole, in time linear in their length; repeated rows each get the same spans; null ids are kept; other
columns aren't used by ``find``; no rows give no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, carried

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
#: Candidates whose features are held at once.
ROWS = 20_000

# The base patterns. A digit run is entered at its first digit, which changes no match.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FLAG = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[\x20\x09-\x0D]+|.", re.S)
# Words that announce a kind.
CUES = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "mastercard", "credit", "cc", "pay"},
    "phone": {"tel", "phone", "call", "mobile", "fax", "ring", "telephone"},
}
N_FEATURES = 25

Span = tuple[int, int, str]


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return bool(s) and total % 10 == 0


def base(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    if FLAG.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words with a digit or @, over at most one other word between two of them.

    A word that begins or ends with @ takes in its neighbour on that side.
    """
    start = end = None
    gap, before, take = 0, None, False
    for m in WORD.finditer(text):
        if FLAG.search(m[0]):
            if start is None:
                start = before if m[0][0] == "@" and before is not None else m.start()
            end, gap, take = m.end(), 0, m[0][-1] == "@"
        elif start is not None:
            gap += 1
            if take and gap == 1:
                end = m.end()
            if gap > 1:
                yield start, end
                start = None
        before = m.start()
    if start is not None:
        yield start, end


def features(text: str, a: int, b: int, kind: str) -> np.ndarray:
    """Features of the whole span [a, b) as one of a kind."""
    s = text[a:b]
    d = digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups]
    seps = set(re.sub(r"[0-9()+]", "", s))
    before = re.findall(r"[a-z]+", text[max(0, a - 24) : a].lower())
    near = lambda c: c.isalnum() or c in "-._/=#@+"
    return np.array([
        1, luhn(d), s[:1] == "+", s.count("(") == 1 == s.count(")"), len(seps) <= 1, sizes[-3:] == [3, 3, 4], len(d) in (10, 11), 14 <= len(d) <= 16,
        len(groups) == 1, bool(CUES[kind] & set(before[-2:])), a > 0 and near(text[a - 1]), b < len(text) and near(text[b]) and not (text[b] == "." and not text[b + 1 : b + 2].isalnum()),
        all(int(g[-4:]) <= 255 and len(g) <= 3 for g in groups), sizes == [4, 4, 4, 4], "." in s, len(d) < 10,
        d[:1] == "0" and s[:1] != "+", len(sizes) >= 4 and set(sizes[-4:]) == {2}, len(groups) > 1 and min(sizes) >= 2 and max(sizes) <= 7, sizes[:1] == [1], not seps & set(" -"),
        len(groups) == 2 and seps == {"."}, sizes[:3] == [4, 2, 2], len(groups) == 5 and set(sizes) == {2}, min(sizes, default=9) == 1,
    ], float)


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Token edges of a region, and (first token, token after the last, kind) of what could be a span."""
    edges = [m.start() for m in TOKEN.finditer(text, start, end)] + [end]
    toks = [text[a:b] for a, b in zip(edges, edges[1:])]
    n = len(toks)
    cum = lambda f: np.concatenate([[0], np.cumsum([f(t) for t in toks])])
    dig = cum(lambda t: len(t) if "0" <= t[0] <= "9" else 0)
    at, dot = cum(lambda t: t == "@"), cum(lambda t: t == ".")
    alpha, other = cum(lambda t: t[0].isalpha()), cum(lambda t: not (t[0].isalnum() or t[0] in "+().- \t"))
    found = []
    for i, t in enumerate(toks):
        if not (t[0].isalnum() or t[0] in "+("):
            continue
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            if not toks[j - 1][0].isalnum():
                continue
            nd, letters = dig[j] - dig[i], alpha[j] - alpha[i]
            if at[j] - at[i] == 1 and dot[j] - dot[i] and t[0].isalnum() and at[i + 1] - at[i] == 0:
                found.append((i, j, "email"))
            if letters or other[j] - other[i] or at[j] - at[i]:
                continue
            if 7 <= nd <= 15:
                found.append((i, j, "phone"))
            if 13 <= nd <= 19 and t[0].isdigit():
                found.append((i, j, "card"))
            if dot[j] - dot[i] == 3 and j - i == 7 and 4 <= nd <= 12 and all(x.isdigit() and int(x) <= 255 for x in toks[i:j:2]):
                found.append((i, j, "ip"))
    return edges, found


def rows_of(text: str, edges: list[int], found: list[tuple[int, int, str]]) -> np.ndarray:
    x = np.zeros((len(found), len(KINDS) * N_FEATURES))
    for r, (i, j, k) in enumerate(found):
        c = KINDS.index(k) * N_FEATURES
        x[r, c : c + N_FEATURES] = features(text, edges[i], edges[j], k)
    return x


def decode(n: int, found: list[tuple[int, int, str]], score: np.ndarray) -> list[int]:
    """The best segmentation: indices of the spans picked; a token outside spans scores 0."""
    ends: dict[int, list[int]] = {}
    for r, (_, j, _) in enumerate(found):
        ends.setdefault(j, []).append(r)
    best, via = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for r in ends.get(j, ()):
            if (s := best[found[r][0]] + score[r]) > best[j]:
                best[j], via[j] = s, r
    out, j = [], n
    while j > 0:
        if via[j] >= 0:
            out.append(via[j])
            j = found[via[j]][0]
        else:
            j -= 1
    return out[::-1]


def expected(n: int, found: list[tuple[int, int, str]], score: np.ndarray) -> tuple[float, np.ndarray]:
    """Log of the sum over segmentations, and each span's probability."""
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for r, (i, j, _) in enumerate(found):
        ends.setdefault(j, []).append(r)
        starts.setdefault(i, []).append(r)
    f, b = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        f[j] = np.logaddexp.reduce([f[j - 1], *(f[found[r][0]] + score[r] for r in ends.get(j, ()))])
    for i in range(n - 1, -1, -1):
        b[i] = np.logaddexp.reduce([b[i + 1], *(b[found[r][1]] + score[r] for r in starts.get(i, ()))])
    p = np.array([np.exp(f[i] + score[r] + b[j] - f[n]) for r, (i, j, _) in enumerate(found)])
    return float(f[n]), p


def examples(n: int = 340, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Sentences with labelled spans and unlabelled look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioustrnlmd") for _ in range(r.randint(2, 8)))

    def card(valid: bool) -> str:
        while luhn(s := r.choice("3456") + d(15)) != valid:
            pass
        return s

    def four(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def make() -> tuple[str, str | None]:
        return r.choice([
            lambda: (f"({r.randint(2, 9)}{d(2)}) {d(3)}-{d(4)}", "phone"),
            lambda: (f"{r.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}", "phone"),
            lambda: (f"+{r.randint(1, 9)} ({d(3)}) {d(3)}-{d(4)}", "phone"),
            lambda: (f"{r.randint(2, 9)}{d(2)}.{d(3)}.{d(4)}", "phone"),
            lambda: (f"1{(s := r.choice('- .'))}{r.randint(2, 9)}{d(2)}{s}{d(3)}{s}{d(4)}", "phone"),
            lambda: (f"0{d(2)} {d(4)}{r.choice(' -')}{d(4)}", "phone"),
            lambda: (f"0{d(r.choice((2, 3, 4)))} {d(r.choice((6, 7)))}", "phone"),
            lambda: (f"(0{d(r.choice((2, 3)))}) {d(r.choice((3, 4)))} {d(4)}", "phone"),
            lambda: ((s := r.choice(" -")).join([f"0{d(1)}", d(2), d(2), d(2), d(2)]), "phone"),
            lambda: (f"00{r.randint(1, 9)}{d(1)} {d(2)} {d(4)} {d(4)}", "phone"),
            lambda: (card(True), "card"),
            lambda: (four(card(True), r.choice(" -.")), "card"),
            lambda: (".".join(str(r.randint(0, 255)) for _ in range(4)), "ip"),
            lambda: (f"{word()}{d(2)}@{word()}.{word()}.com", "email"),
            lambda: (f"{word()} @ {word()}.com", "email"),
            lambda: (four(card(False), r.choice(["", " ", "-", "."])), None),
            lambda: (f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", None),
            lambda: (f"{d(3)},{d(3)}.{d(2)}", None),
            lambda: (d(r.randint(5, 13)), None),
            lambda: (f"{d(2)}.{d(1)}.{d(2)}", None),
            lambda: (f"97{r.choice('89')}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", None),
            lambda: (f"{d(5)}-{d(6)}-{d(2)}", None),
            lambda: (f"{r.randint(256, 999)}.{d(3)}.{d(2)}.{d(3)}", None),
            lambda: (f"{d(r.randint(1, 3))}.{d(r.randint(8, 16))}", None),
            lambda: (f"{word()}@{d(2)}", None),
            lambda: (f"{r.randint(1, 9)}{d(3)} {d(3)} {d(4)}", None),
            lambda: (f"{r.randint(1, 9)}{d(1)} {d(2)} {d(2)} {d(2)}", None),
            lambda: (f"{r.randint(1, 9)}{d(2)} {d(4)} {d(2)} {d(3)}", None),
            lambda: (f"{d(1)} {d(2)} {d(1)} {d(2)} {d(1)} {d(2)}", None),
            lambda: (f"{r.randint(1, 9)}{d(2)} {d(3)} {d(3)}", None),
        ])()

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(1, 3))), []
        for _ in range(r.randint(1, 2)):
            s, kind = make()
            cue = r.choice(sorted(CUES[kind])) + r.choice([" ", ": "]) if kind and r.random() < 0.3 else ""
            text += " " + cue
            if kind:
                spans.append((len(text), len(text) + len(s), kind))
            text += s + r.choice(["", ",", "."]) + " " + " ".join(word() for _ in range(r.randint(1, 4)))
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def fitted(rounds: int = 80, rate: float = 0.4, decay: float = 0.002) -> np.ndarray:
    """Weights by AdaGrad on the conditional likelihood of the examples' segmentations."""
    data = []
    for text, spans in examples():
        for a, b in regions(text):
            edges, found = candidates(text, a, b)
            gold = np.array([(edges[i], edges[j], k) in spans for i, j, k in found], float)
            if len(found):
                data.append((len(edges) - 1, found, rows_of(text, edges, found), gold))
    w, seen = np.zeros(len(KINDS) * N_FEATURES), np.full(len(KINDS) * N_FEATURES, 1e-6)
    for _ in range(rounds):
        g = -decay * len(data) * w
        for n, found, x, gold in data:
            g += x.T @ (gold - expected(n, found, x @ w)[1])
        seen += g * g
        w = w + rate * g / np.sqrt(seen)
    return w


def free_of(found: list[tuple[int, int, str]], edges: list[int], held: list[Span]) -> list[tuple[int, int, str]]:
    """The candidates that touch no held span; held is sorted by start."""
    if not held or not found:
        return found
    starts = np.array([s[0] for s in held])
    furthest = np.maximum.accumulate([s[1] for s in held])
    at = np.array(edges)
    i, j = (at[[f[k] for f in found]] for k in (0, 1))
    before = np.searchsorted(starts, j)  # so many begin ahead of the candidate's end
    hit = (before > 0) & (furthest[np.maximum(before - 1, 0)] > i)
    return [f for f, h in zip(found, hit.tolist()) if not h]


def spans(text: str | None, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    text = text or ""
    if not FLAG.search(text):
        return [], []
    own = base(text)
    more = []
    low = high = 0
    furthest = np.maximum.accumulate([s[1] for s in own]).tolist() if own else []
    for a, b in regions(text):
        while low < len(own) and furthest[low] <= a:
            low += 1
        high = max(high, low)
        while high < len(own) and own[high][0] < b:
            high += 1
        edges, found = candidates(text, a, b)
        found = free_of(found, edges, own[low:high])
        if found:
            score = np.concatenate([rows_of(text, edges, found[k : k + ROWS]) @ weights for k in range(0, len(found), ROWS)])
            more += [(edges[found[r][0]], edges[found[r][1]], found[r][2]) for r in decode(len(edges) - 1, found, score)]
    return own, sorted(own + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def say(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redact(text: str, found: list[Span]) -> str:
    """Each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, clean: bool = False, carry: list[str] | None = None) -> DataFrame:
    """docs -> doc_id, base counts, base_spans, spans and, if asked for, the redacted text as ``cleaned``; row of carried columns."""
    extra, extra_schema = carried(docs, carry)
    more = bool(extra)
    shared = docs.sparkSession.sparkContext.broadcast(fitted())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", *(["cleaned"] if clean else []), *(["row"] if more else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole)):
            texts = [t.as_py() for t in batch.column("text")]
            got = [spans(t, shared.value) for t in texts]
            cols = [batch.column("doc_id"), *(pa.array([sum(s[2] == k for s in own) for own, _ in got], pa.int64()) for k in KINDS), pa.array([say(o) for o, _ in got], pa.string()), pa.array([say(s) for _, s in got], pa.string())]
            if clean:
                cols.append(pa.array([t if t is None else redact(t, s) for t, (_, s) in zip(texts, got)], pa.string()))
            yield pa.RecordBatch.from_arrays([*cols, *([batch.column("row")] if more else [])], names=names)

    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_spans string", "spans string", *(["cleaned string"] if clean else [])])
    return docs.select("doc_id", "text", *extra).mapInArrow(run, schema + extra_schema)
