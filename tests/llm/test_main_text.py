"""Main text of pages of many layouts, the best run against all runs, and damaged markup."""

import random
import time

import pytest

from sextant.llm import main_text
from sextant.llm.main_text import PRIOR, Page, weights_of

LONG = "The council met on Tuesday to discuss the new budget and the long list of repairs that had been put off for years."
LONG2 = "Several members asked for more time, since the figures had reached them only the day before, and a vote was put off."
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li></ul></nav>"


def marked(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{a}}</style></head><body>{MENU}<div class=ad>Buy now and save</div><article>{body}</article><footer>&copy; 2024 Site</footer></body></html>"


@pytest.fixture(scope="module")
def learnt():
    from collections import Counter

    inside, outside = Counter(), Counter()
    for k in range(200):
        a, b = Page(marked(f"<h1>Title {k}</h1><p>{LONG}<p>{LONG2}</p><p>Short.</p>")).labelled()
        inside.update(a)
        outside.update(b)
    return weights_of({n: (inside[n], outside[n]) for n in inside | outside})


LAYOUTS = {
    "article": (marked(f"<h1>Budget</h1><p>{LONG}</p><p>Of.</p>"), ["Budget", LONG, "Of."]),
    "unclosed": (marked(f"<h1>Budget</h1><p><b>{LONG}<br><p>Second <i>line</i></p><p>A &amp; B&nbsp;&#8212; c &lt;d&gt; caf&eacute; &copy"), ["Budget", LONG, "Second line", "A & B — c <d> café ©"]),
    "parts inside": (
        marked(f"<header><h1>Budget</h1><span>By A. Writer</span></header><p>{LONG}</p><div class='ad-slot'><p>Buy a car today, it is cheap.</p></div><aside>See also</aside><p>{LONG2}</p><form><label>Mail</label><input name=m></form><ul class=social-share><li>Tweet</li></ul><section id='comments'><h2>2 comments</h2><p>{LONG}</p></section>"),
        ["Budget", LONG, LONG2],
    ),
    "comment articles": (marked(f"<h1>B</h1><p>{LONG}</p><article><p>I do not agree with that at all, since the figures are wrong.</p></article>"), ["B", LONG]),
    "main": (f"<body class='has-sidebar'>{MENU}<main id=main><h1>B</h1><p>{LONG}</p><ul><li>one</li><li>two</li></ul></main><div class='sidebar'>Most read</div></body>", ["B", LONG, "one", "two"]),
    "div": (f"<body><div id=top class='site-header'>My site</div><div class=wrap><div class='post-content'><h1>B</h1><p>{LONG}</p><p>{LONG2}</p><div>End.</div></div><div class='cookie-notice'>We use cookies to make this site better for you and us.</div></div></body>", ["B", LONG, LONG2, "End."]),
    "no container": (f"<html><body>{MENU}<h1>B</h1><p>{LONG}</p><p>Of.</p><div>Imprint</div></body></html>", ["B", LONG, "Of."]),
    "unmarked menu": (f"<body><table><tr><td><a href=a>One</a><br><a href=b>Two</a></td><td><p>{LONG}</p><p>{LONG2}</p></td></tr></table></body>", [LONG, LONG2]),
    "form around all": (f"<body><form action=x><div class=menu>Menu</div><article><p>{LONG}</p></article><input></form></body>", [LONG]),
    "scripts": (marked(f"<p>{LONG}<script>var t='</p><p>no';</script> and on.</p><noscript>Turn it on</noscript><!-- <p>no</p> --><template><p>no</p></template><textarea>no</textarea>"), [f"{LONG} and on."]),
    "layout names": (f"<body class='nav-open'><div class='content-with-sidebar menu-open'><div class='sidebar-left'>Most read</div><div class='text has-ads'><h1>B</h1><p>{LONG}</p><p>{LONG2}</p></div></div></body>", ["B", LONG, LONG2]),
    "teasers": (f"<body><main><article><h1>B</h1><p>{LONG}</p><p>{LONG2}</p></article><section class=more>" + "".join(f"<article><h2>More {k}</h2><p>{LONG2}</p></article>" for k in range(3)) + "</section></main></body>", ["B", LONG, LONG2]),
    "named wrapper": (f"<body><div id='widget-page'><div class='top-banner'>Sale</div><main><h1>B</h1><p>{LONG}</p></main></div></body>", ["B", LONG]),
    "comment list": (f"<body><div class=post><h1>B</h1><p>{LONG}</p><figure><img src=x><figcaption>A view.</figcaption></figure></div><ol class=commentlist><li id=comment-12><p>{LONG2}</p></li></ol><div id=respond><form><p>Leave a reply</p></form></div></body>", ["B", LONG, "A view."]),
    "notices": (marked(f"<div role=alert>Old browser</div><p class='notice'>Members only.</p><p>{LONG}</p><div class='newsletter-signup'><p>Get it by mail every day of the week.</p></div><iframe src=x>no</iframe>"), [LONG]),
    "hidden": (marked(f"<p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p><span aria-hidden=true>no</span>"), [LONG]),
    "table": (marked(f"<p>{LONG}</p><table><tr><th>Year<td>2024<tr><td>Cost<td>3 &lt; 4</table>"), [LONG, "Year", "2024", "Cost", "3 < 4"]),
    "pre and inline": (marked(f"<p>{LONG}</p><pre>a\n  b\tc</pre><p>H<sub>2</sub>O <a href=x>here</a></p>"), [LONG, "a b c", "H2O here"]),
    "only text": (LONG, [LONG]),
    "nothing": (f"<body>{MENU}<footer>x</footer></body>", []),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(learnt, name):
    source, lines = LAYOUTS[name]
    assert Page(source, learnt).main_text() == "\n".join(lines)


@pytest.mark.parametrize("name", [n for n in LAYOUTS if n not in ("no container",)])
def test_layouts_without_labelled_pages(name):
    source, lines = LAYOUTS[name]
    assert Page(source, dict(PRIOR)).main_text() == "\n".join(lines)


def test_the_run_is_the_best_of_all():
    chance = random.Random(1)
    for _ in range(300):
        page = Page("")
        n = chance.randrange(1, 12)
        page.scores = [chance.choice([0.0, 0.5, 1.0, 7.0]) for _ in range(n)]
        page.costs = [-chance.choice([0.0, 0.5, 2.0, 6.0]) for _ in range(n)]
        total = lambda i, j: sum(page.scores[i : j + 1]) + sum(page.costs[i + 1 : j + 1])  # noqa: B023, E731
        best = max(total(i, j) for i in range(n) for j in range(i, n))
        run = page.best_run()
        assert (run is None and best == 0) or total(*run) == best


def test_damaged_markup_never_fails_and_takes_linear_time():
    chance = random.Random(2)
    bits = ["<p>", "</p>", "<div", ">", "<a href='", '"', "'", "</a>", "<b>", "</b>", "<table>", "<td>", "</tr>", "<li>", "<!--", "-->", "<script>", "</script>", "<![CDATA[", "&#xD800;", "&#0;", "&amp", "<", "</", "<article>", "</article>", "<form>", "<title>", "word ", "\x00", "<!", "<?", "<h1>", "</h1>"]
    for _ in range(400):
        text = Page("".join(chance.choice(bits) for _ in range(chance.randrange(60))), dict(PRIOR)).main_text()
        assert isinstance(text, str)
        text.encode()
    for one in ("<", "<a ", "<a <b", "<div>", "<b>", "<p><b>", "<li>", "</p>", "<!--", "<a href='", "<td><p>", "<b><p></b>", "<form><article>", "&", "<script", "</"):
        began = time.time()
        Page(one * 40_000, dict(PRIOR)).main_text()
        assert time.time() - began < 8, one


def test_rows(spark):
    source = marked(f"<h1>B</h1><p>{LONG}</p>")
    rows = [(1, "u", source), (1, "u", source), (None, None, None), (3, "v", ""), (4, "w", f"<article><p>{'word ' * 1_200_000}</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' AS text", "'x' AS feature", "7 AS N_CHARS").repartition(3)
    got = main_text.extract(pages, main_text.learn(pages))
    assert got.columns == ["page_id", "url", "html", "feature", "text", "n_chars"]
    found = sorted(((r["page_id"], r["url"], r["text"][:40], r["n_chars"], r["feature"]) for r in got.collect()), key=repr)
    text = f"B\n{LONG}"
    assert found == sorted([(1, "u", text[:40], len(text), "x")] * 2 + [(None, None, "", 0, "x"), (3, "v", "", 0, "x"), (4, "w", ("word " * 9)[:40], 5_999_999, "x")], key=repr)
    empty = pages.where("false")
    assert main_text.extract(empty, main_text.learn(empty)).collect() == []


def test_the_whole_table_against_its_markup(spark, sf_small):
    """The given pages mark their article plainly; learning must not need that mark: it is taken away here."""
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    weights = main_text.learn(pages)
    assert weights["long"] > 0 >= weights["<p"] > weights["<li"]
    rows = pages.collect()
    same = 0
    for r in rows:
        bare = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        same += Page(bare, weights).main_text() == Page(r["html"], weights).main_text()
    assert same >= 0.95 * len(rows)
