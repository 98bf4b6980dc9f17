import time

from strandworks.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="post"><header><h1>Site</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<!-- <p>ad</p> --><div class="ad">Buy now and save a lot of money today friends</div><div id="cookie-notice"><p>We use cookies to make this site work for all of you.</p></div>
<main><article><h1>A  headline</h1><p><b>First &lt;b&gt; para&shy;graph
 with <a href=x>link</a> &amp; more.<br>next<p>Short.</p><p>Last</article>
<section class="comments"><p>I think this article is very good indeed, thank you all.</p></section></main>
<aside>Related: <a href=/q>Q</a></aside><form><label>Mail</label><input></form><script>if (a < b) {}</script><footer>&copy; us</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "A headline\n\nFirst <b> para­graph with link & more. next\n\nShort.\n\nLast"


def test_without_article_element():
    p = "<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div><p>" + "Many words stand here in a row. " * 6 + "</p><p>Then some more words that follow them, and so on and on.</p></div><ul><li><a href=3>Next</a></ul>"
    assert H.main_text(p) == ("Many words stand here in a row. " * 6).strip() + "\n\nThen some more words that follow them, and so on and on."


def test_odd_input():
    for t in (None, "", "   ", "<", "<<<>>>", "<p", "<!--", "</p></div>", "<a><a><a>"):
        H.main_text(t)
    assert H.main_text("<article><p>a < b &amp;lt; c</p><p>cut <a hre") == "a < b &lt; c\n\ncut"
    assert H.main_text("<article>x</article><script>never closed <p>y") == "x"


def test_linear_time():
    began = time.time()
    for t in ("<div>" * 50_000, "<p>a" * 50_000, "<" * 200_000, "<a b='" * 20_000, "&" * 100_000, "<!--" * 50_000, "</p>" * 50_000, "<b>" * 50_000 + "<p>" * 2000):
        H.main_text("<article>" + t)
    assert time.time() - began < 60


def test_tree_fits_its_pages():
    for page in H.PAGES:
        found = H.blocks(H.filled(page))
        for b, row in zip(found, H.features(found)):
            assert H.verdict(H.tree(), row) == (b.text[0] == "m"), (page, b)


BODY = "<h1>Head</h1><p>Some words of the article stand here.</p><p>Short.</p>"


def test_wrappers_heads_and_foreign_elements():
    want = "Head\n\nSome words of the article stand here.\n\nShort."
    for page in (
        f"<html><head><title>t</title><body><article>{BODY}</article>", f"<head><meta charset=x><article>{BODY}</article>", f"<head><title>t</title></head><article>{BODY}</article>",
        f"<div class='page-with-sidebar'><article>{BODY}</article><div class=sidebar>Other things to read</div></div>", f"<form action=/><article>{BODY}</article></form>",
        f"<svg/><math/><article>{BODY}</article>", f"<nav><svg><path d='M0'></nav><article>{BODY}</article>", f"<script src=x /><article>{BODY}</article>", f"<article>{BODY}<svg><path d='M0 0'/></svg></article>",
        f"<article title=don't data-x='>'>{BODY}</article>", f"<article class='a>{BODY}</article>",
    ):
        assert H.main_text(page) == want, page
    assert H.main_text("<head>First body words<p>and more of them</p>").startswith("First body words")


def test_silent_elements_stay_silent():
    for inside in ("<select><option>France<option>Spain</select>", "<noscript><div>Please enable scripts</div> now</noscript>", "<template><div>row<p>cell</div><template>x</template>y</template>", "<object><p>No plug-in</p></object>", "<svg><title>t</title><foreignObject><div>label</div></foreignObject><text>rest</text></svg>", "<canvas><table><tr><td>no canvas</table></canvas>", "<math><mi>x</mi><p>y</p>z</math>"):
        for page in (f"<article><h1>Head</h1><p>Some words of the {inside}article stand here.<p>Short.</article>", f"<head>{inside}<title>t</title></head><article><h1>Head</h1><p>Some words of the article stand here.</p><p>Short.</article>"):
            got = H.main_text(page)
            assert got == "Head\n\nSome words of the article stand here.\n\nShort.", (page, got)
    assert H.main_text("<article><p>One<select><option>Two</article>") == "One"
    assert H.main_text(f"<svg><path><article>{BODY}</article>").endswith("Short.")
    began = time.time()
    for t in ("<svg>" * 50_000 + "</svg>", "<select><template>" * 30_000, "</svg>" * 50_000, "<p><object>" * 30_000 + "</object>" * 30_000, "<svg a='" * 50_000):
        H.main_text("<article>" + t)
    assert time.time() - began < 60


def test_time_of_attributes_is_linear():
    began = time.time()
    for t in ("<a " * 100_000 + '"', "<a b=\"" * 50_000 + "'", "<script/>" * 40_000, "<svg/>" * 50_000, "<a b='" * 50_000 + '"' * 50_000, "<head>x" * 40_000, "<form><form>" * 50_000 + "<p>a" * 50_000):
        H.main_text(t)
    assert time.time() - began < 60


MUTE = ("select", "noscript", "svg", "template")


def plain(page):
    """Main text of a page of well-formed elements, by another parser: words outside furniture, nothing learned."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out, self.text = [], [], []

        def cut(self):
            if s := " ".join("".join(self.text).split()):
                self.out.append(s)
            self.text = []

        def handle_starttag(self, tag, attrs):
            if any(t in MUTE for t, _ in self.open) or tag in MUTE:
                self.open.append((tag, ""))
            elif tag in ("p", "div", "nav", "article", "h1", "footer", "aside", "section", "ul", "li", "table", "td", "tr", "style", "script", *MUTE):
                self.cut()
                self.open.append((tag, dict(attrs).get("class") or ""))

        def handle_endtag(self, tag):
            if any(t in MUTE for t, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass
            elif self.open and self.open[-1][0] == tag:
                self.cut()
                self.open.pop()

        def handle_data(self, data):
            if not any(t in ("nav", "footer", "aside", "style", "script", *MUTE) or c in ("ad", "comments", "cookie-notice") for t, c in self.open):
                self.text.append(data)

    r = Reader()
    r.feed(page)
    r.cut()
    return "\n\n".join(r.out)


def test_matches_plain_reading_of_random_pages():
    import random

    r = random.Random(3)
    say = lambda n: " ".join(r.choice(["ah", "be &amp; co", "tion&eacute;", "3 &lt; 4", "<b>no</b>", "wo<i>rd</i>"]) for _ in range(n))
    links = lambda n: "".join(f"<li><a href=/{i}>{say(1)}</a></li>" for i in range(n))
    for _ in range(300):
        body = "".join(r.choice(["<p>{}</p>", "<p>{} <select><option>no<option>nor</select></p>", "<p><noscript><div>no</div> nor</noscript>{}</p>", "<div><svg><p>no</p>nor</svg>{}</div>", "<p>{}<template><div>no<p>nor</div></template></p>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<section><p>{}</p></section>", "<table><tr><td>{}</td></tr></table>"]).format(say(r.choice([1, 3, 9, 30, 80]))) for _ in range(r.randint(1, 9)))
        inside = r.choice(["", f"<div class=ad>{say(6)}</div>", f"<aside><p>{say(5)}</p></aside>", f"<section class=comments><p>{say(9)}</p></section>"])
        page = r.choice([f"<style>p{{}}</style><script>var t='</p>';</script>", ""]) + f"<nav><ul>{links(r.randint(2, 7))}</ul></nav><!-- <p>no</p> -->" + r.choice(["", f"<div class=ad>{say(4)}</div>", f"<div class=cookie-notice>{say(12)}</div>"])
        page += f"<article><h1>{say(4)}</h1>{body}{say(1)}<p>{say(40)}</p>{inside}</article><footer>{say(7)}</footer>"
        assert H.main_text(page) == plain(page), page


def test_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, PAGE, "x"), (2, None, PAGE, "x"), (None, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert [r.page_id for r in got] == [1, 2, 2, None] and got[0].text == got[3].text == "" and got[1].text == got[2].text != ""
    assert H.extract(df.limit(0)).count() == 0
