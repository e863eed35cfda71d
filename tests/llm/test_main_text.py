"""Main text: the cut against all labellings, pages of several designs, and the given pages against their markup."""

import html
import itertools
import random
import re

import pytest

from reelsift.llm import main_text as M


def cost(odds, edges, labels):
    return sum(max(u, 0) if not x else max(-u, 0) for u, x in zip(odds, labels)) + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_minimum_cut_is_the_least_of_all_labellings():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 9)
        odds = [r.choice([0.0, r.uniform(-2, 2)]) for _ in range(n)]
        edges = [(*r.sample(range(n), 2), r.uniform(0, 2)) for _ in range(r.randint(0, 2 * n))] if n > 1 else []
        best = min(cost(odds, edges, x) for x in itertools.product([False, True], repeat=n))
        assert cost(odds, edges, M.minimum_cut(odds, edges)) == pytest.approx(best, abs=1e-9)


def test_flow_alone_is_a_minimum_cut_of_chains():
    r = random.Random(3)
    for _ in range(50):
        n = 12
        u = [r.uniform(-1, 1) for _ in range(n)]
        near = [{j: 1.0 for j in (i - 1, i + 1) if 0 <= j < n} for i in range(n)]
        side = [None] * n
        M._flow(list(range(n)), u, near, side)
        edges = [(i, i + 1, 1.0) for i in range(n - 1)]
        assert cost(u, edges, side) == pytest.approx(min(cost(u, edges, x) for x in itertools.product([False, True], repeat=n)), abs=1e-9)


ONE = "The river rises in the hills, and runs for a hundred miles before it meets the sea."
TWO = "Short."
THREE = "In spring, when the snow melts, it floods the meadows; farmers wait for that."
DESIGNS = [
    # semantic elements, with an aside and a form within the article
    f"<body><header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><main><article><header><h1>Rivers</h1></header><p>{ONE}<p>{TWO}<aside>See also: lakes.</aside><form><label>Mail</label><input><button>Send</button></form><p>{THREE}</article><section class='comments'><h2>Comments</h2><p>{ONE} I like it.</p></section></main><footer>&copy; us</footer>",
    # divisions whose class or id says what they are
    f"<div id=wrapper class='page-with-sidebar'><div class='topNav'><a href=x>A</a> | <a href=y>B</a></div><div id='cookie-notice'>We use cookies, as all do. Accept?</div><div class='post-content'><h1>Rivers</h1><p>{ONE}</p><div class=ad-slot>Buy now, pay later! It is the best offer.</div><p>{TWO}</p><p>{THREE}</p></div><div class='sidebar'><h3>Popular</h3><p>{THREE}</p></div><div id=comments><article class='comment-body'><p>{ONE}</p></article></div></div>",
    # a form around everything, the article's title in a header of its own
    f"<form action=/><div class='site-header'><a href=/>Site</a></div><div class='post'><div class='entry-header'><h1>Rivers</h1></div><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div><div class='discussion'><p>{THREE} So it is.</p></div></form>",
    # bare divisions
    f"<table><tr><td><a href=1>News</a><br><a href=2>Sport</a></td><td><div><h1>Rivers</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div></td></tr></table><div><a href=3>Imprint</a> <a href=4>Contact</a></div>",
]


@pytest.mark.parametrize("page", DESIGNS)
def test_designs(page):
    read = M.Page(page)
    got = [t for t, main in zip(read.texts, M.label(read, M.PRIOR)[1]) if main]
    assert got == ["Rivers", ONE, TWO, THREE]


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ("", []), ("   ", []), ("plain &amp; simple", ["plain & simple"]), ("a < b and c > d", ["a < b and c > d"]), ("<p>one<p>two", ["one", "two"]),
        ("<p>a<b>b</b>\n\t c&nbsp;d</p>", ["ab c d"]), ("<p>x<br>y</p>", ["x y"]), ("<script>var a='</p><p>no';</script><p>yes", ["yes"]), ("<style>p{}</style>t", ["t"]),
        ("<title>no</title><!-- <p>no --><p>yes<!-- open", ["yes"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<div hidden>no</div><div style='display:none'>no<p>no</div><p>yes", ["yes"]), ("<p>cut <a href='x", ["cut"]), ("<p title=\"a>b\">t</p>", ["t"]), ("<p title=\"open>t</p>", ["t"]),
        ("<select><option>no</select><button>no</button><svg><text>no</text></svg>yes", ["yes"]), ("<head><meta charset=u><body>yes", ["yes"]), ("</div></p>yes</article>", ["yes"]), ("&#x41;&#66;&lt;p&gt;", ["AB<p>"]),
    ],
)
def test_blocks(source, blocks):
    assert M.Page(source).texts == blocks


def article(source):
    """The given pages' articles by their own markup."""
    own = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h\d)>", own))
    return "\n".join(x for x in parts if x)


def test_given_pages_and_edges(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    got = M.main_text(pages).collect()
    assert len(got) == len(want) and all((r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    long = "<article>" + f"<p>{ONE}</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (1, "u", ""), (None, "u", DESIGNS[0]), (2, "u", long), (2, "u", long)]
    few = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, odds long, text string")
    out = sorted(((r.page_id or 0, r.url, r.text) for r in M.main_text(few).collect()), key=str)
    assert out == sorted([(1, None, ""), (1, "u", ""), (0, "u", "\n".join(["Rivers", ONE, TWO, THREE])), *[(2, "u", "\n".join([ONE] * 20_000))] * 2], key=str)
    blocks = M.page_blocks(few.where("page_id is null"), M.PRIOR).orderBy("block").collect()
    assert [b.block for b in blocks] == list(range(len(blocks))) and [b.text for b in blocks if b.main] == ["Rivers", ONE, TWO, THREE]
    assert M.main_text(few.limit(0)).count() == 0
