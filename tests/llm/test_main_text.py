"""Operator 11 on pages whose article is known."""

import random
import time

import numpy as np
import pytest

from tessera.llm import main_text as op
from tests.llm.util import with_clashes

S = ["The river rose slowly through the night, and by morning the lower fields were under water.",
     "Nobody in the village had seen it so high; the old marks on the mill were covered within hours.",
     "It fell again on Thursday.", "Why?", "Engineers say the new gates held, although two of them had been left half open since spring."]
ARTICLE = "<h1>High water</h1>" + "".join(f"<p>{s}</p>" for s in S)
WANT = "\n".join(["High water", *S])
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/w">Weather and tides</a></li></ul>'
LONG = "We and our partners store information on your device; you may change your choice at any time in the settings of this site."
JUNK = {
    "nav": f"<nav>{MENU}</nav>",
    "plain menu": f'<div>{MENU}</div>',
    "line of links": '<p><a href="/a">Home</a> | <a href="/b">Sport</a> | <a href="/c">Travel</a></p>',
    "header": '<header><h1>The Daily Reader</h1><p>All the news that is fit to be read by anybody who has the time for it.</p></header>',
    "footer": f"<footer>&copy; 2024 The Daily Reader. {LONG}</footer>",
    "aside": f"<aside><h2>Most read</h2><p>{LONG}</p></aside>",
    "sidebar": f'<div class="left-sidebar"><h3>Weather</h3><p>{LONG}</p></div>',
    "notice": f'<div id="cookieNotice"><p>{LONG}</p><button>Accept</button></div>',
    "advert": f'<div class="ad-slot ad"><p>{LONG}</p></div>',
    "role": f'<div role="complementary"><p>{LONG}</p></div>',
    "form": f'<form action="/s"><label>Your address</label><input name="q"><p>{LONG}</p><textarea>text</textarea></form>',
    "script": '<script>if (a < b) { document.write("<p>text</p>"); }</script><style>p > a { color: red }</style>',
    "template": "<template><p>Not shown</p></template><noscript><p>Enable scripts</p></noscript><!-- <p>a comment</p> -->",
    "hidden": f'<div style="display: none"><p>{LONG}</p></div><div hidden><p>{LONG}</p></div>',
    "comments": f'<section class="comments"><h2>2 comments</h2><article class="comment-body"><p>{LONG}</p><p>{LONG}</p></article></section>',
    "named comments": f"<section><h3>Reader comments (2)</h3><p>{LONG}</p><p>{LONG} {LONG}</p></section>",
}


@pytest.mark.parametrize("frame", [
    "{before}<article>{x}</article>{after}", "{before}<main>{x}</main>{after}", '{before}<div class="post">{x}</div>{after}',
    '<div id="wrap">{before}<div><div class="content">{x}</div></div>{after}</div>',
    '<form id="aspnet">{before}<article>{x}</article>{after}</form>',
    "<table><tr><td>{before}</td><td>{x}</td><td>{after}</td></tr></table>",
    "<div class='page with-sidebar'>{before}<div role='main'>{x}</div>{after}</div>",
])
@pytest.mark.parametrize("name", JUNK)
def test_junk_around_the_article_goes(frame, name):
    for before, after in ((JUNK[name], ""), ("", JUNK[name]), (JUNK[name], JUNK["footer"]), (JUNK["nav"], JUNK[name] + JUNK["footer"])):
        page = frame.format(before=before, after=after, x=ARTICLE)
        assert op.main_text(f"<html><head><title>High water</title></head><body>{page}</body></html>") == WANT


def test_junk_inside_the_article_goes():
    for name, junk in JUNK.items():
        got = op.main_text(f"<body><article>{ARTICLE}{junk}</article></body>")
        assert got == WANT if name != "header" else got.startswith(WANT), name
        if not name.endswith("comments"):
            got = op.main_text(f"<body><main><h1>High water</h1><p>{S[0]}</p>{junk}" + "".join(f"<p>{s}</p>" for s in S[1:]) + "</main>")
            assert got.replace("The Daily Reader\n", "") == WANT, name


def test_flat_body():
    page = f"<body>{JUNK['line of links']}<h1>High water</h1>" + "".join(f"<p>{s}" for s in S) + JUNK["line of links"] + "<p>(c) 2024"
    assert op.main_text(page) == WANT


def test_unclosed_and_misnested():
    loose = "<h1>High water</h1>" + "".join(f"<p><b>{s}<br>" for s in S)
    for page in (f"<article>{loose}</article><footer>{LONG}</footer>", f"<div><article>{loose}</b></div><footer>{LONG}",
                 f"<nav>{MENU}<article>{loose}</article>", f"<article>{loose}</article><!-- <p>{LONG}", f"<article>{loose}<p cl"):
        assert op.main_text(page) == WANT


def test_white_space_references_and_blocks():
    page = ("<article><p> a&nbsp;&amp;\n\tb &lt;i&gt; &#233;&eacute; &copy &am caf&eacute <i>x</i>y<br>z</p>one<br><br>two<p></p><ul><li>p<li>q</ul>"
            "<table><tr><td>1</td><td> 2 </td><tr><td>3<td>4</table><pre>l\n  m</pre><h2>T</h2><p>a long line that closes the article, as it must.</p></article>")
    assert op.main_text(page) == ("a & b <i> éé © &am café xy z\none\ntwo\np\nq\n1 2\n3 4\nl m\nT\na long line that closes the article, as it must.")


def test_nothing_to_find():
    for page in (None, "", "   ", "<html></html>", "<nav>x</nav>", "<script>x", "<!-- x", "<p", "</p>", f"<nav>{MENU}</nav>"):
        assert op.main_text(page) == ""
    assert op.main_text("plain words") == "plain words"


def test_short_article_between_long_junk():
    page = "<body>" + "".join(JUNK.values()) + "<article><h1>No.</h1><p>Yes.</p></article>" + "".join(JUNK.values())
    assert op.main_text(page) == "No.\nYes."


def test_smoothing_is_a_convolution():
    x = np.random.default_rng(1).random(40)
    k = {d: np.exp(-0.5 * (d / 1.5) ** 2) for d in range(-5, 6)}
    want = [sum(k[d] * x[i + d] for d in k if 0 <= i + d < 40) / sum(k.values()) for i in range(40)]
    assert np.allclose(op.smooth(x, 1.5), want)
    assert len(op.smooth(np.array([2.0]), 1.0)) == 1


def test_very_long_page_in_linear_time():
    def seconds(n):
        t = time.time()
        text = op.main_text("<div>" * 50 + "<article>" + f"<p>{S[0]}</p><div><b>{S[1]}</b> <a href='x'>{S[2]}</a></div>" * n)
        assert text.count("\n") == 2 * n - 1
        return time.time() - t
    seconds(500)
    assert seconds(8000) < 12 * seconds(2000)


def test_table(spark):
    rng = random.Random(1)
    rows = [(i, f"u{i}", f"<body>{JUNK['nav']}<article>{''.join(rng.sample([f'<p>{s}</p>' for s in S], 5))}</article>") for i in range(30)]
    rows += [(1, None, None), (None, "u", ""), (1, "u1", rows[1][2]), (1, "u1", rows[1][2])]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), "text", "n_chars", "page")
    got = op.extract(df)
    assert got.columns == ["page", "text", "n_chars"] and got.schema["page"].dataType.names == ["page_id", "url", "text", "n_chars", "page"]
    want = sorted((str(p), str(u), op.main_text(h), len(op.main_text(h))) for p, u, h in rows)
    assert sorted((str(r.page.page_id), str(r.page.url), r.text, r.n_chars) for r in got.collect()) == want
    assert op.extract(df.limit(0)).count() == 0
