"""Main text of pages: the cut against exhaustive search, pages against a plain reading, odd pages."""

import html
import itertools
import random
import re

import duckdb

from ribospark.llm import html_extraction as H
from ribospark.llm.queries import op12_html_extraction

SENTENCE = "This sentence is long enough to look like the running text of a story, and it ends with a stop."


def test_cut_equals_exhaustive_search():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        own = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 5)) for _ in range(rng.randint(0, 14))]

        def cost(side):
            return sum(abs(c) for c, s in zip(own, side) if (c > 0) != s and c) + sum(w for a, b, w in edges if side[a] != side[b])

        every = list(itertools.product((False, True), repeat=n))
        least = min(map(cost, every))
        largest = [any(s[v] for s in every if cost(s) == least) for v in range(n)]  # the union of cheapest sides is one of them
        assert H.minimum_cut(own, edges) == largest
    chain = [5] * 3 + [-1] * 2000 + [4] * 3
    assert H.minimum_cut(chain, [(i, i + 1, 3) for i in range(len(chain) - 1)]) == [True] * 3 + [False] * 2000 + [True] * 3


def _text(page):
    return H.main_text(page, H.Layout())


def test_parts_that_are_no_article():
    page = f"""<!doctype html><html><head><title>T &amp; t</title><style>p{{}}</style><script>if (a < b) "</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><div id="content"><article class="post"><header><h1>The   title</h1></header>
    <p>First&nbsp;one &lt;b&gt; <b>bo</b>ld.<br>Line two<p>{SENTENCE}<ins class="adsbygoogle">Buy!</ins><ul><li>One<li>Two</ul>
    <aside>Aside words.</aside><form><p>Your name</p><input></form><div class="ad">Advert</div><p>Short.</p><!-- hidden > <p>no</p> -->
    <footer>Share this</footer><section id="comments"><article><p>{SENTENCE}</p></article></section></article></div>
    <div class="sidebar"><p>{SENTENCE}</p></div><div hidden>{SENTENCE}</div><footer>&copy; 2020</footer></body></html>"""
    assert _text(page) == f"The title First one <b> bold. Line two {SENTENCE} One Two Short."


def test_odd_pages():
    assert _text(None) == "" and _text("") == "" and _text("<p>") == "" and _text("<!-- never closed <p>x") == ""
    assert _text("<article>a < b &am &amp c</article") == "a < b &am & c"
    assert _text('<article title="a > b"><p>x</p></article><p class="foot') == "x"
    assert _text("<article><button>never closed<p>y</p></article>") == "never closed y"
    assert _text("<script>x<article>y</article>") == ""
    assert _text("</p></div><main>z</main></main>") == "z"
    assert _text("<NAV>n</NAV><Article>Ü\n\t ü</ARTICLE>") == "Ü ü"
    deep = "<div>" * 50_000 + "<article><p>deep</p></article>" + "</section>" * 50_000
    assert _text(deep) == "deep"
    many = "<article>" + "".join(f"<p>word{i} and more.</p><div class='ad'>x{i}</div>" for i in range(30_000)) + "</article>"
    assert _text(many) == " ".join(f"word{i} and more." for i in range(30_000))
    assert len(_text("<article>" + "long " * 600_000 + "</article>")) == 5 * 600_000 - 1


def test_layout_alone_separates_text_from_links():
    layout = H.Layout({(0, 0): 1.0, (0, 3): -2.0, (1, 0): -1.5, (1, 2): 1.0, (2, 1): 1.0, (2, 0): -1.0, (3, 0): 0.5, (3, 2): -0.5, (3, 3): -0.5})
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(6))
    page = f"<body><div><ul>{links}</ul></div><div><p>{SENTENCE}</p><p>A word</p><p>{SENTENCE}</p></div><div><ul>{links}</ul></div></body>"
    assert H.main_text(page, layout) == f"{SENTENCE} A word {SENTENCE}"  # the short block goes with its neighbours


def _plain(page):
    """The given pages' articles by a regular expression."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if re.match(r"</?(p|h1|br)", m[0]) else "", inner)).split())


def test_extraction(spark):
    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in op12_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (u, _plain(p), len(_plain(p))) for i, u, p in rows}
    schema = "page_id long, url string, html string, text int, page string, id string, n_chars string"
    odd = spark.createDataFrame([(1, None, None, 1, "c", "c", "c"), (None, "u", "", 1, "c", "c", "c"), (2, "u", "<main>a</main>", 1, "c", "c", "c"), (2, "u", "<main>a</main>", 1, "c", "c", "c")], schema)
    layout = H.learn_layout(odd)
    assert sorted(map(str, H.extract_text(odd, layout).collect())) == sorted(["Row(page_id=1, url=None, text='', n_chars=0)", "Row(page_id=None, url='u', text='', n_chars=0)", *["Row(page_id=2, url='u', text='a', n_chars=1)"] * 2])
    assert H.learn_layout(odd.limit(0)).odds == {} and H.extract_text(odd.limit(0), layout).count() == 0
