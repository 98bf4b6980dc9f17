"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. Features of a block: its word count and link density (words
in links over words), those of the blocks before and after it, whether it is a heading, whether an article
or main element holds it, and, of the elements of page furniture that hold it (by name, and by words of
class and id apart), the share of the page's words in the smallest one and whether an article or main
element stands in that one: a form or a "with-sidebar" around a whole page is no furniture. A decision tree
(Gini splits) is fitted to the blocks of the small labelled pages ``PAGES``.

Scripts, styles, templates, the head and comments give no text; a script's string isn't markup. A silent
element that has an end tag of its own is passed over up to there, whatever stands in it. The head ends at
the first element of a body, foreign elements (svg, math) without an end tag at a block element. Character references are decoded once; white space within a block becomes one space; blocks are
trimmed and joined by two newlines. Unclosed tags are closed by the tags that end them, stray end tags are
ignored, a quote that is never closed ends at the next ``>``, and a tag cut off by the end of the page is
dropped. Each character of a page is scanned a bounded number of times.

Rows: null and empty html give an empty text; repeated rows and null ids stay; other columns aren't used;
no rows give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks as slices

# HTML element names by what they do to text.
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select title head".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that may stand in a head.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - frozenset("button label body html".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog fieldset label".split())
HINTS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification notices pager pagination popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
MAIN_HINTS = frozenset("article content entry main post story text".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
SKIP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
#: Silent elements whose content is parsed as elements.
HOLDS = SILENT - RAW - {"head"}
HOLD_TAG = re.compile(rf"<(/?)({'|'.join(sorted(HOLDS))})(?=[\s/>])[^>]*>", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[A-Za-z]+")
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form"}

#: Labelled pages: {m40} stands for 40 words of main text, {x12} for 12 words that aren't, {l5} for 5 links of
#: one word that aren't, {k3} for 3 words in a link within main text.
PAGES = [
    "<nav><ul><li>{l1}<li>{l1}<li>{l1}<li>{l1}</ul></nav><div class=ad>{x12}</div><article><h1>{m9}</h1><p>{m60}<p>{m2}<p>{m25}{k3}{m9}</article><footer>{x9}</footer>",
    "<header><h1>{x2}</h1><p>{x8}</header><nav>{l6}</nav><main><article><h1>{m6}</h1><p>{m120}<p>{m1}<h2>{m3}</h2><p>{m45}<ul><li>{m4}<li>{m7}<li>{m2}</ul></article></main><aside><h3>{x2}</h3><ul><li>{l3}<li>{l4}</ul></aside><footer>{x3}{l3}</footer>",
    "<nav>{l5}</nav><div class=ad>{x30}</div><article><h1>{m4}</h1><p>{m5}</article><footer>{x14}</footer>",
    "<div class=page-with-sidebar><ul><li>{l1}<li>{l1}<li>{l1}</ul><article><h1>{m7}</h1><p>{m80}<p>{m3}</article><div class=sidebar><p>{x20}<p>{x6}</div></div><p>{x7}{l2}",
    "<form action=/><div>{l1}</div><div>{l1}</div><h1>{m6}</h1><p>{m70}</p><p>{m35}</p><p>{m4}</p><div>{x2}{l3}</div></form>",
    "<form action=/><nav>{l4}</nav><main><h1>{m5}</h1><p>{m50}<p>{m90}<form><label>{x2}</label><button>{x1}</button></form></main><footer>{x11}</footer></form>",
    "<ul><li>{l1}<li>{l2}<li>{l1}</ul><div><h1>{m8}</h1><p>{m44}<p>{m31}<p>{m6}<p>{m75}</div><ul><li>{l2}<li>{l1}</ul>",
    "<div>{l2}{x1}{l1}</div><h2>{m5}</h2><p>{m33}<p>{m52}{k2}{m20}<p>{m18}<div>{x2}{l3}</div>",
    "<table><tr><td>{l1}<td>{l1}<td>{l1}</table><table><tr><td><h3>{m4}</h3><p>{m110}<p>{m64}<p>{m27}</table><table><tr><td>{x4}{l2}</table>",
    "<div class=content><h1>{m6}</h1><p>{m42}<blockquote>{m22}</blockquote><p>{m9}<pre>{m12}</pre><div class=share>{x1}{l4}</div><p>{m16}</div><div id=comments><h3>{x2}</h3><div class=comment><p>{x25}</div><div class=comment><p>{x60}</div></div>",
    "<main><article><h1>{m5}</h1><p>{m36}<p>{m58}<section class=comments><h2>{x1}</h2><article><p>{x30}</article><article><p>{x12}</article></section></article></main>",
    "<article><h1>{m3}</h1><div class=post-ad><p>{x18}</div><p>{m40}<figure><figcaption>{m7}</figcaption></figure><aside><p>{x15}</aside><p>{m66}<p>{k4}<nav>{l2}</nav></article>",
    "<div id=cookie-notice><p>{x35}<button>{x2}</button></div><div class=has-ads><nav>{l3}</nav><article><h1>{m5}</h1><p>{m28}<p>{m15}</article></div><div class='newsletter signup'><p>{x24}<form><label>{x1}</label></form></div>",
    "<div role=navigation>{l7}</div><div role=main><h1>{m4}</h1><p>{m55}<p>{m12}<p>{m38}</div><div role=complementary><p>{x40}</div><div role=contentinfo>{x16}</div>",
    "<h1>{m6}</h1><p>{m22}<p>{m1}<p>{m90}<p>{m5}<p>{m47}", "<article>{m1}</article>", "<p>{m75}", "<article><p>{m12}<p>{m3}<p>{m8}</article><div class=ad>{x60}</div>",
    "<div>{l1}</div><div>{l1}</div><div>{l1}</div><div><p>{m35}</div><div><p>{m50}</div><div>{x3}{l5}</div><div>{l2}</div>",
    "<body class='page sidebar-right'><nav>{l4}</nav><article><h1>{m6}</h1><p>{m30}<p>{m14}<h2>{m2}</h2><p>{m21}</article><aside><p>{x12}<p>{x10}<p>{x45}</aside></body>",
    "<article><h1>{m6}</h1><table><tr><td>{m1}<td>{m1}<tr><td>{m2}<td>{m3}</table><p>{m20}{k8}<ul><li>{k2}<li>{k3}</ul></article><div class=related><ul><li>{l5}<li>{l6}</ul></div>",
    "<article><h1>{m5}</h1><p>{m20}<p>{k3}<p>{m30}<p>{k2}</article>", "<article><h1>{m6}</h1><p>{k1}<p>{m40}<p>{m30}</article>", "<div><p>{m50}<p>{m30}<p>{m12}</div>", "<article><p>{m30}<p>{m10}{k5}<p>{k4}<p>{m2}</article>",
    "<article><h1>{m3}</h1><p>{m8}</article><div class=ad>{x20}</div>", "<div class=promo><p>{x25}<p>{x18}</div><article><p>{m20}<p>{m9}</article>", "<div class=with-sidebar><article><p>{m30}<p>{m10}</article></div><footer>{x25}</footer>",
    "<nav>{l4}</nav><div class='layout no-sidebar'><h1>{m5}</h1><p>{m60}<p>{m40}<p>{m9}</div><footer>{x8}</footer>", "<nav>{l2}</nav><article><h1>{m4}</h1><p>{m16}</article><footer>{x40}</footer>", "<form><p>{m40}<p>{m30}</form><div class=ad>{x4}</div>",
    "<div>{x2}</div><div>{l1}</div><div>{x1}</div><div>{l2}</div><h1>{m5}</h1><p>{m40}<p>{m3}<p>{m22}<h3>{x2}</h3><div>{l3}</div><div>{l2}</div>", "<div>{x3}</div><div>{l4}</div><div>{l1}</div><p>{m33}<p>{m52}<p>{m2}<p>{m14}<div>{x2}</div><ul><li>{l1}<li>{l2}</ul><div>{x4}</div><div>{l1}</div>",
    "<div>{l1}</div><div>{x1}</div><div>{l1}</div><article><h1>{m3}</h1><p>{m1}<p>{k2}<p>{m2}<p>{k1}</article><h4>{x3}</h4><div>{l5}</div><div>{x1}</div><div>{l2}</div>",
    "<nav>{l4}</nav><h1>{m4}</h1><p>{m30}<p>{m1}<p>{m14}", "<article><h1>{m9}</h1><p>{m9}<p>{m31}</article><div class=advert>{x12}</div><div>{l3}</div>", "<h2>{m3}</h2><p>{m14}<p>{m25}<p>{m8}<div>{l1}</div>",
    "<header>{x5}<nav>{l4}</nav></header><div><div><p>{m26}<p>{m64}<p>{m30}</div></div><section class=comments><p>{x22}<p>{x41}</section><footer><p>{x30}<p>{x5}</footer>",
]


def filled(page: str) -> str:
    """A labelled page with its words: m for main text, x for the rest."""
    word = {"m": lambda n: "m " * n, "x": lambda n: "x " * n, "l": lambda n: "<a href=/>x</a> " * n, "k": lambda n: "<a href=/>" + "m " * n + "</a> "}
    return re.sub(r"\{([mxlk])(\d+)\}", lambda g: word[g[1]](int(g[2])), page)


def fit_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 8):
    """A decision tree: a leaf's label, or (feature, threshold, tree if at most, tree if above)."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = (np.inf, 0, 0.0)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            gini = sum(s.sum() * (p := labels[s].mean()) * (1 - p) for s in (low, ~low))
            best = min(best, (round(gini, 9), f, float(cut)))
    if best[0] == np.inf:
        return int(share >= 0.5)
    _, f, cut = best
    low = rows[:, f] <= cut
    return f, cut, fit_tree(rows[low], labels[low], depth - 1), fit_tree(rows[~low], labels[~low], depth - 1)


@lru_cache(maxsize=1)
def tree():
    rows, labels = [], []
    for page in PAGES:
        found = blocks(filled(page))
        rows += features(found)
        labels += [b.text[0] == "m" for b in found]
    return fit_tree(np.array(rows, float), np.array(labels, float))


def verdict(node, row) -> int:
    while not isinstance(node, int):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node


class Holder:
    """An element of page furniture: its words, and whether an article or main element stands in it, once it is closed."""

    __slots__ = ("words", "wraps")

    def __init__(self, words: int, wraps: int):
        self.words, self.wraps = words, wraps  # what stands before it

    def shut(self, words: int, wraps: int) -> None:
        self.words, self.wraps = words - self.words, wraps > self.wraps


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    by_name: Holder | None  # the innermost element that is furniture by its name, and by class or id
    by_hint: Holder | None
    main: bool
    heading: bool


def tag_at(page: str, at: int, last: dict[str, int]) -> tuple[str, dict[str, str], bool, int] | None:
    """(name, class, id and role, self-closing, end) of the tag whose name begins at ``at``; none if the page ends within it.

    last: where each kind of quote stands last in the page.
    """
    m = NAME.match(page, at)
    name, at, n, found, slash = m[0].lower(), m.end(), len(page), {}, False
    while True:
        was, at = at, SKIP.match(page, at).end()
        if at >= n:
            return None
        if page[at] == ">":
            return name, found, page[at - 1] == "/" and at > was, at + 1
        m = ATTRIBUTE.match(page, at)
        key, at = m[0].lower(), m.end()
        if eq := EQUALS.match(page, at):
            at = eq.end()
            quote = page[at : at + 1]
            if quote in last and at < last[quote]:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                m = BARE.match(page, at)
                value, at = m[0], m.end()
            if key in ("class", "id", "role"):
                found.setdefault(key, value)


def ends_of(page: str) -> dict[int, int]:
    """Where silent elements end, by where they begin; those that are never closed are left out."""
    found, begun = {}, {}
    for m in HOLD_TAG.finditer(page):
        open_ = begun.setdefault(m[2].lower(), [])
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.append(m.start())
        elif open_:
            found[open_.pop()] = m.end()
    return found


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, Holder | None, Holder | None, bool]] = []  # element, what it is as furniture, whether it makes main text
    names: list[Holder] = []  # open furniture by name
    hints: list[Holder] = []  # and by class or id
    main = links = silent = total = articles = 0
    heading = False
    text: list[str] = []
    linked = 0
    last = {q: page.rfind(q) for q in "\"'"}
    counts: dict[str, int] = {}
    endless: set[str] = set()  # raw elements with no end tag further on
    ends = ends_of(page)

    def say(s: str) -> None:
        nonlocal linked
        if s and not silent:
            s = html.unescape(s)
            text.append(s)
            linked += links and len(s.split())

    def close() -> None:
        nonlocal linked, total
        s = SPACE.sub(" ", "".join(text)).strip()
        if s:
            words = len(s.split(" "))
            total += words
            out.append(Block(s, words, min(words, linked), names[-1] if names else None, hints[-1] if hints else None, main > 0, heading))
        text.clear()
        linked = 0

    def pop() -> str:
        nonlocal main, links, silent
        name, bad, hint, good = stack.pop()
        if bad:
            names.pop().shut(total, articles)
        if hint:
            hints.pop().shut(total, articles)
        main -= good
        links -= name == "a"
        silent -= name in SILENT
        counts[name] -= 1
        return name

    def pop_to(name: str) -> None:
        while pop() != name:
            pass

    at = 0
    while (lt := page.find("<", at)) >= 0:
        said = page[at:lt]
        if counts.get("head") and said.strip():
            pop_to("head")
        say(said)
        at = lt + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 1)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[at : at + 1] in ("!", "?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            continue
        ending = page[at : at + 1] == "/"
        if not NAME.match(page, at + ending):
            say("<")
            continue
        if lt in ends:
            if NAME.match(page, at)[0].lower() in ("select", "object", "iframe", "canvas"):
                say(" ")
            at = ends[lt]
            continue
        got = tag_at(page, at + ending, last)
        if got is None:
            at = len(page)
            break  # cut off by the end of the page
        name, marked, self_closing, at = got
        if ending:
            if name == "p" and not counts.get("p"):
                close()
            if counts.get(name):
                if name in BLOCKS:
                    close()
                pop_to(name)
                if name[:1] == "h" and len(name) == 2:
                    heading = False
            continue
        if counts.get("head") and name not in IN_HEAD:
            pop_to("head")
        if name in BLOCKS:
            for foreign in ("svg", "math"):
                if counts.get(foreign):
                    pop_to(foreign)
            close()
            if name in ENDS_P and counts.get("p"):
                while stack and stack[-1][0] != "p" and stack[-1][0] not in BLOCKS and stack[-1][0] not in HOLDS:
                    pop()
                if stack and stack[-1][0] == "p":
                    pop()
            for same in (("li",) if name == "li" else ("dd", "dt") if name in ("dd", "dt") else ("td", "th") if name in ("td", "th") else ("tr", "td", "th") if name == "tr" else ()):
                if stack and stack[-1][0] == same:
                    pop()
            if name == "tr" and stack and stack[-1][0] == "tr":
                pop()
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name == "br":
            say(" ")
        if name in VOID or self_closing and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            end = None if name in endless else RAW_END[name].search(page, at)
            if not end:
                endless.add(name)
            at = end.end() if end else at if self_closing else len(page)
            continue
        if name == "a" and counts.get("a"):
            pop_to("a")
        words = [x.lower() for v in marked.values() for x in WORDS.findall(v)]
        kind = next((ROLES[x] for x in words if x in ROLES), name)
        hint = not HINTS.isdisjoint(words) and name not in ("html", "body", "main")
        bad = kind in FURNITURE
        good = (name in ("article", "main") or not MAIN_HINTS.isdisjoint(words) and name not in ("html", "body")) and not hint and not bad
        stack.append((name, Holder(total, articles) if bad else None, Holder(total, articles) if hint else None, good))
        articles += name in ("article", "main") and not hint
        if bad:
            names.append(stack[-1][1])
        if hint:
            hints.append(stack[-1][2])
        main += good
        links += name == "a"
        silent += name in SILENT
        counts[name] = counts.get(name, 0) + 1
    if at < len(page):
        if counts.get("head") and page[at:].strip():
            pop_to("head")
        say(page[at:])
    close()
    while stack:
        pop()
    return out


def features(found: list[Block]) -> list[tuple]:
    """The features of each block."""
    total = sum(b.words for b in found)
    none = Block("", 0, 0, None, None, False, False)
    rows = []
    for before, b, after in zip([none, *found], found, [*found[1:], none]):
        near = [x for o in (b, before, after) for x in (o.words, o.linked / o.words if o.words else 0.0)]
        held = [x for h in (b.by_name, b.by_hint) for x in ((h.words / total, h.wraps) if h else (1.0, False))]
        rows.append((*near, *held, b.main, b.heading))
    return rows


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, features(found)) if verdict(tree(), row))


def extract(pages: DataFrame) -> DataFrame:
    """pages -> page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, column="html")):
            got = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
