import html
import re

import numpy as np

from loomstat.llm import html_text as op


def test_held_out_pages():
    pages = op.labelled_pages(300, seed=99)
    f = op.Forest(pages)
    right = (op.default_model().marginals(f) > 0.5) == f.label
    own = f.x[:, -op.NUMBERS] > 0
    assert right[own].mean() > 0.97


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    m = op.Model(rng.normal(0, 1, op.FEATURES), rng.normal(0, 1, (op.EDGE_KINDS, 2, 2)))
    for page in ("<div><p>a</p><ul><li>b<li>c</ul></div>", "<nav><div class=ad>x</div></nav><p>y</p>", ""):
        f = op.Forest([page, "<p>other"])
        n = len(f.trees[0].tag)
        total, on = 0.0, np.zeros(n)
        for bits in range(1 << n):
            s = np.array([bits >> k & 1 for k in range(n)])
            w = np.exp(sum(f.x[k] @ m.unary * s[k] for k in range(n)) + sum(m.pair[f.edge[k], s[f.parent[k]], s[k]] for k in range(1, n)))
            total += w
            on += w * s
        assert np.allclose(m.marginals(f)[:n], on / total)


def test_every_page_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n".join(x for x in blocks if x)
    out = op.extract(pages).collect()
    assert {r.page_id: r.text for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out)


def test_markup():
    one = lambda page: [t for _, t, _ in op.Tree(page).lines]
    assert one("<p>a &amp; b&nbsp;&#x41;&lt;x&gt; \n c<p>d<br>e<div>f</div>g") == ["a & b A<x> c", "d e", "f", "g"]
    assert one('<script>if (a<b) "</p>"</script>x<style>p{}</style><!-- <p>no --><b>y</b> z') == ["xy z"]
    assert one("<ul><li>a<li>b <ul><li>c</ul>d</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["a", "b", "c", "d", "1", "2", "3"]
    assert one('<a title=">">x</a> 1 < 2 <img alt="q">') == ["x 1 < 2"]
    assert one("</div></p>a<!DOCTYPE html><!--") == ["a"]
    assert one("<script>x") == [] and one("") == []
    assert [t.tag for t in [op.Tree("<html><body><p>a</body></html><p>b")]][0] == ["html", "body", "p", "p"]


def test_layouts_by_name():
    page = """<html><body><header class="site-header"><div class=logo>Site</div></header><div class="cookie-notice"><p>We use cookies on this site to make it better for you.</p></div>
    <div class="content"><h1>Title of it</h1><p>First paragraph of the story, long enough to be one.</p><p>Second one, which also says a thing or two.</p></div>
    <div id="comments"><div class="comment"><p>I read this and I do not agree at all with what it says.</p></div></div>
    <form><label>Name</label><input></form><aside><p>Something related that others have read today.</p></aside><footer>Copyright</footer></body></html>"""
    assert op.texts([page], op.default_model()) == ["Title of it\nFirst paragraph of the story, long enough to be one.\nSecond one, which also says a thing or two."]


ONE, TWO = "Some longer paragraph of the story, which tells what happened, and why it did so.", "Another paragraph follows here with more words and a second sentence. It ends."


def test_pages_that_are_only_an_article():
    for page, lines in {
        f"<html><body><p>{ONE}</p></body></html>": [ONE], f"<html><head><title>x</title></head><body><p>{ONE}</p><p>{TWO}</p><p>{ONE}</p></body></html>": [ONE, TWO, ONE], f"<html><body>{ONE}</body></html>": [ONE],
        f"<html><head><title>x</title></head><body><div>{ONE}</div></body></html>": [ONE], f"<p>{ONE}</p>": [ONE], ONE: [ONE], "<p>Hi</p>": ["Hi"], f"<div><p>{ONE}</p><p>{TWO}</p></div>": [ONE, TWO], f"<html><body><h1>Head</h1><p>{ONE}</p></body></html>": ["Head", ONE],
    }.items():
        assert op.texts([page], op.default_model()) == ["\n".join(lines)], page


def test_comments_and_notes_without_their_names():
    story = f"<h1>Head</h1><p>{ONE}</p><p>{TWO}</p>"
    said = "".join(f"<div><b>{n}</b> <span>{k} hours ago</span><p>{t}</p><a href=#>Reply</a></div>" for n, k, t in (("Ann", 3, "I do not agree with what it says here."), ("Bob", 2, "I liked it a lot, thanks.")))
    for page in (
        f'<html><body><article>{story}</article><section id="responses"><h3>Responses</h3><div><b>Ann</b><p>I do not agree with it.</p></div><div><b>Bob</b><p>I liked it.</p></div></section></body></html>',
        f"<html><body><article>{story}</article><div>{said}</div></body></html>", f"<html><body><nav><a href=/>Home</a></nav><div>{story}</div><section>{said}</section></body></html>",
        f'<html><body><div class="content"><div class="hatnote">This is about the town. For the river see elsewhere.</div>{story}</div></body></html>', f'<html><body><article><div role="note">This is about the town.</div>{story}</article></body></html>',
    ):
        assert op.texts([page], op.default_model()) == [f"Head\n{ONE}\n{TWO}"], page


def test_embedded_elements():
    lines = lambda page: [t for _, t, _ in op.Tree(page).lines]
    assert lines("<canvas id=c><p>a</p><p>b</p>") == ["a", "b"]
    assert lines("<p>a</p><object><object>x</object>y</object><p>b</p>") == ["a", "b"]
    assert lines("<div><canvas>no</div><p>a</p><div><canvas>no</canvas></div>b") == ["a", "b"]
    assert lines("<p>a <svg><text>x</text><path/></svg>b</p><template><p>x</p></template><noscript><img></noscript>c") == ["a b", "c"]
    assert lines("<video><script>'</video>'</script>x</video>a") == ["a"]
    assert lines("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>") == ["so x=1"]
    assert lines("<SVG/>a<object/>b") == ["ab"]


def test_hostile_markup():
    many = 30_000
    assert [t for _, t, _ in op.Tree("<div>" * many + "</x>" * many + "a" + "</p>" * many).lines] == ["a"]
    assert len(op.Tree("<canvas>" * many + "<p>a").lines) == 1
    assert [t for _, t, _ in op.Tree("<ul>" * 5000 + "<li>a" * 5000).lines] == ["a"] * 5000
    assert op.texts(["<div>" * many + "<p>" + ONE], op.default_model()) == [ONE]


def test_weights_are_those_of_training():
    f, m = op.Forest(op.labelled_pages(50, seed=5)), op.train(op.labelled_pages())
    assert np.abs(m.marginals(f) - op.default_model().marginals(f)).max() < 0.05


def test_nulls_repeats_and_long_pages(spark):
    long = "<article>" + "<p>Some words that make a line of text.</p>" * 20000 + "</article>"
    deep = "<div>" * 3000 + "<p>x" + "</div>" * 3000
    rows = [(1, None, None, 1), (None, "u", "", 2), (2, "u", long, 3), (2, "u", long, 3), (3, "u", deep, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0, r.n_chars) for r in op.extract(df).collect()))
    assert got[:2] == [(0, 0), (1, 0)] and got[2] == got[3] and got[2][1] == 20000 * (len("Some words that make a line of text.") + 1) - 1
    assert len(got) == 5
    assert op.extract(df.limit(0)).count() == 0


def test_layouts_that_were_not_trained_on():
    import random

    one, two = "Some longer paragraph of the story, which tells what happened, and why it did so.", "Another paragraph follows here with more words and a second sentence. It ends."
    junk = [
        '<div class="cookie-banner"><p>We use cookies to improve your experience. Accept all.</p></div>', '<div id="menu"><a href=/>Home</a> <a href=/a>About us</a></div>',
        '<div class="col-right sidebar"><h3>Related</h3><ul><li><a href=x>One two three</a></li></ul><p>Read more about this topic here.</p></div>',
        '<section id="comments"><h2>3 comments</h2><ol class="commentlist"><li><p>I think this is a very good article and I liked it a lot, thank you.</p></li></ol></section>',
        '<div class="footer">Copyright 2024 Example Corp. All rights reserved.</div>', '<div class="newsletter-signup"><form><label>Email</label><input></form><p>Subscribe to our newsletter today.</p></div>',
        '<div class="ad-slot">Buy now the best product of the year, cheap.</div>', "<header><h2>Site name</h2><nav><ul><li><a href=1>A</a><li><a href=2>B</a></ul></nav></header>",
        "<footer><p>Contact us at our office. Terms apply.</p></footer>", '<div class="notice">This site will be down on Sunday.</div>', "<aside><h3>Popular</h3><p>Ten things you should know about it.</p></aside>",
    ]
    text = f"<h1>Head line</h1><p>{one}</p><p>{two}</p>"
    bodies = [f"<article>{text}</article>", f"<main>{text}</main>", f'<div id="content">{text}</div>', f'<div class="c12">{text}</div>', text, f"<table><tr><td>{text}</td></tr></table>", f'<div class="wrap"><div class="row"><div class="entry">{text}<ul><li>First point made</li></ul></div></div></div>']
    rnd, right = random.Random(1), []
    for body in bodies * 20:
        some = rnd.sample(junk, 5)
        page = f"<html><head><title>T</title></head><body>{''.join(some[:2])}{body}{''.join(some[2:])}</body></html>"
        right.append(op.texts([page], op.default_model())[0] == "\n".join(t for _, t, _ in op.Tree(body).lines))
    assert np.mean(right) > 0.95
