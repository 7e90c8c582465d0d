import itertools
import random
import re
from html import unescape

import pytest

from ledgerlight.llm.extraction import blocks_of, extract, main_text, minimum_cut, op13_extraction

SF = "/root/testdata/sf0.01"


def article_of(page):
    """By brute force, for pages with one article element that nothing but paragraphs and a heading stands in."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    found = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inside)]
    return "\n".join(x for x in found if x)


def test_query_equals_brute_force(spark):
    have = {r["page_id"]: r for r in op13_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(have) == len(pages)
    for p in pages:
        got = have[p["page_id"]]
        assert (got["url"], got["text"], got["n_chars"]) == (p["url"], article_of(p["html"]), len(article_of(p["html"])))


@pytest.mark.parametrize("seed", range(60))
def test_minimum_cut_equals_every_labelling(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    terminal = [float(rng.randint(-6, 6)) for _ in range(n)]
    edges = {i: {} for i in range(n)}
    for i, j in itertools.combinations(range(n), 2):
        if rng.random() < 0.5:
            edges[i][j] = edges[j][i] = float(rng.randint(1, 4))

    def cost(side):
        own = sum(abs(t) for t, s in zip(terminal, side, strict=True) if (t > 0) != s)
        return own + sum(c for i in edges for j, c in edges[i].items() if i < j and side[i] != side[j])

    assert cost(minimum_cut(terminal, edges)) == min(cost(s) for s in itertools.product([False, True], repeat=n))


LONG = "The council met on Tuesday to weigh the plan for the old harbour, and it heard from many of those who live there."
PAGES = {
    "boilerplate round an article": (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header><nav><a href=a>One</a> <a href=b>Two</a></nav><div class='cookie-notice'><p>{LONG} We use cookies.</p></div>"
        f"<article><h1>Title</h1><p>{LONG}</p><div class=\"ad-slot\"><p>{LONG} Buy.</p></div><p>Short.</p><form><label>Mail</label><input><button>Go</button></form><aside><p>{LONG}</p></aside><ul><li>First point</li><li>Second</ul></article>"
        f"<section id=comments><article><p>{LONG} I agree.</p></article></section><footer><p>{LONG}</p></footer></body></html>",
        f"Title\n{LONG}\nShort.\nFirst point\nSecond",
    ),
    "no mark but classes": (
        f"<body><div id='topbar'>Welcome</div><div class='menu'><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><div class='content'><h2>Head</h2><p>{LONG}</p><p>Be.</p><p>{LONG}</p></div><div class=sidebar-right><p>{LONG}</p></div>"
        f"<div class='reader-comments'><p>{LONG}</p></div><div id=footer>All rights</div>",
        f"Head\n{LONG}\nBe.\n{LONG}",
    ),
    "no marks at all": (
        f"<div><a href=1>Home</a> <a href=2>About</a> <a href=3>News</a></div><div><h1>Head</h1><p>{LONG}</p><p>So be it.</p><p>{LONG}</p></div><div><a href=4>Terms</a> <a href=5>Contact</a></div>",
        f"Head\n{LONG}\nSo be it.\n{LONG}",
    ),
    "references, white space, comments, scripts": (
        "<article><p>a &lt;b&gt; &amp;amp; caf&eacute;\n\t &#8364; x<!-- <p>no</p> --></p><script>var t = '</p><p>no</p>';</script><p>1 < 2 and <b>bold<br>line</b></p><noscript><p>no</p></noscript><p title='hidden > here'>kept</p><p hidden>no</p><p>x <span style='display: none'>no</span> y</p>",
        "a <b> &amp; café € x\n1 < 2 and bold line\nkept\nx y",
    ),
    "upper case and open elements": (f"<BODY><NAV>Menu<UL><LI>A<LI>B</UL></NAV><ARTICLE><P><B>{LONG}<P>Two</ARTICLE><FOOTER>Foot", f"{LONG}\nTwo"),
    "a form round all": (f"<form id=aspnet><div class=header>x</div><main><p>{LONG}</p></main></form>", LONG),
    "repeated paragraphs": (f"<article><p>{LONG}</p><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    "a quote that never ends": ("<article><p>One</p><p class=\"x>Two</p><p>Three</p></article>", "One\nTwo\nThree"),
    "all boilerplate": ("<nav><a href=x>Home</a></nav><footer>Foot</footer>", ""),
    "text alone": (LONG, LONG),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def test_odd_rows_and_columns(spark):
    long = "<article>" + "<p>word and word.</p>" * 30_000 + "</article>"
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (3, "<nav>x</nav>", 3, "c"), (4, long, 4, "d"), (5, "<article>é\U0001f600</article>", 5, None), (5, "<article>é\U0001f600</article>", 5, None), (None, "<p", 6, "f")]
    have = extract(spark.createDataFrame(rows, "page_id long, html string, side long, _text string"), text="main").collect()
    got = sorted(((r["side"], r["main"], r["n_chars"], r["_text"]) for r in have), key=str)
    want = [(1, "", 0, "a"), (2, "", 0, "b"), (3, "", 0, "c"), (4, "\n".join(["word and word."] * 30_000), 15 * 30_000 - 1, "d"), (5, "é\U0001f600", 2, None), (5, "é\U0001f600", 2, None), (6, "", 0, "f")]
    assert got == sorted(want, key=str)
    with pytest.raises(ValueError, match="text"):
        extract(spark.createDataFrame([("x", "y")], "html string, Text string"))
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_deep_pages_and_many_open_quotes():
    deep = "<div>" * 5000 + LONG
    assert main_text(deep) == LONG
    assert len(blocks_of('<a "' * 20_000 + "<p>x")[0]) >= 1
