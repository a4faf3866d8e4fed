"""Main text of pages written by hand, none of them by the makers of the training pages; depth; elements of an article."""

import time

import pytest

from spindex.llm import html_blocks, html_extraction, labelled_pages

#: Each page with the lines of its main text.
PAGES = [
    (
        """<!doctype html><html><head><title>River reopens | The Courier</title><meta name=x></head><body class="home-page">
<div id="cookie-banner"><p>We use cookies to make this site work. <a href="/c">More</a></p><button>Accept</button></div>
<header class="site-header"><a href="/">The Courier</a><nav><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/l">Local</a></li></ul></nav></header>
<main><article class="story"><h1>River path reopens after repairs</h1>
<div class="article-body"><p>The path along the river was reopened on Tuesday, nine weeks after the flood washed it away.</p>
<div class="advert"><p>Shoes at half the price, this week only.</p></div>
<p>Engineers laid new stone and raised the banks by a metre.<br>The town paid for the work.</p>
<blockquote><p>&ldquo;We walked here every day,&rdquo; said a neighbour.</p></blockquote>
<h2>What comes next</h2><ul><li>New lamps will be set up in May.</li><li>The bridge is to be painted.</li></ul></div></article></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">School wins the cup</a></li><li><a href="/2">Market moves to the square</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p class="author">Ann</p><p>About time that they did something there.</p></div><div class="comment"><p class="author">Bob</p><p>It will flood again.</p></div></section>
<footer><p>&copy; 2023 The Courier. All rights reserved.</p><ul><li><a href="/p">Privacy</a></li><li><a href="/t">Terms</a></li></ul></footer></body></html>""",
        ["River path reopens after repairs", "The path along the river was reopened on Tuesday, nine weeks after the flood washed it away.", "Engineers laid new stone and raised the banks by a metre. The town paid for the work.", "“We walked here every day,” said a neighbour.", "What comes next", "New lamps will be set up in May.", "The bridge is to be painted."],
    ),
    (
        """<html><body><table width="100%"><tr><td class="leftnav"><a href="a">Start</a><br><a href="b">Recipes</a><br><a href="c">Contact</a></td>
<td class="content"><h1>Onion soup</h1><p>Slice six onions and let them brown in butter, slowly, for most of an hour.<p>Add flour, wine and broth; let it boil up once.
<p>Serve with toasted bread and cheese.</td></tr></table><div id="footer">Made by hand in 1999. Best seen with any browser.</div></body></html>""",
        ["Onion soup", "Slice six onions and let them brown in butter, slowly, for most of an hour.", "Add flour, wine and broth; let it boil up once.", "Serve with toasted bread and cheese."],
    ),
    (
        """<html><body><div class="wrapper"><div class="navbar"><ul><li><a href="/docs">Docs</a><li><a href="/api">API</a><li><a href="/blog">Blog</a></ul></div>
<div class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Usage</a></li></ul></div>
<section class="page-content"><h1>Getting started</h1><p>This guide shows how to install the tool and how to run it for the first time.</p><h2>Install</h2><pre>tool install --all</pre>
<p>Then open a new shell, so that the <code>PATH</code> is read again.</p><h2>Usage</h2><p>Run the command in an empty folder; it asks a few questions and writes a file.</p>
<table><tr><th>Option</th><th>Meaning</th></tr><tr><td>--all</td><td>takes every part</td></tr></table></section>
<div class="pager"><a href="/p">Previous</a> <a href="/n">Next</a></div>
<form class="search"><label>Search the docs</label><input name=q><button>Go</button></form>
<footer class="footer">Copyright 2021 The tool's authors</footer></div></body></html>""",
        ["Getting started", "This guide shows how to install the tool and how to run it for the first time.", "Install", "tool install --all", "Then open a new shell, so that the PATH is read again.", "Usage", "Run the command in an empty folder; it asks a few questions and writes a file.", "Option", "Meaning", "--all", "takes every part"],
    ),
    (
        """<html lang=de><body><div id=page><div class="masthead"><h2><a href="/">Das Tagebuch</a></h2></div><ul class="menu"><li><a href="/">Anfang</a></li><li><a href="/ueber">Über mich</a></li></ul>
<div class="post"><h1>Ein Tag am See</h1><p>Heute waren wir am See, und das Wasser war noch kalt.</p><p>Die Kinder haben Steine gesammelt, bis es dunkel wurde. Auf dem Weg nach Hause gab es Kuchen.</p>
<div class="share-buttons"><a href="#">Teilen</a> <a href="#">Drucken</a></div></div>
<div id="respond"><h3>Kommentar schreiben</h3><form><p><label>Name</label><input></p><p><label>Text</label><textarea>leer</textarea></p><button>Senden</button></form></div>
<ol class="comment-list"><li class="comment"><div class="meta">Eva</div><p>Schön war das, wir kommen bald wieder.</p></li></ol>
<div class="widget"><h3>Schlagwörter</h3><a href="#">See</a> <a href="#">Sommer</a></div><div class="footer"><p>Impressum und Datenschutz</p></div></div></body></html>""",
        ["Ein Tag am See", "Heute waren wir am See, und das Wasser war noch kalt.", "Die Kinder haben Steine gesammelt, bis es dunkel wurde. Auf dem Weg nach Hause gab es Kuchen."],
    ),
    (
        """<html><body><nav class="breadcrumb"><a href="/">Home</a> &gt; <a href="/e">Encyclopedia</a></nav><div class="mw-body content"><h1>Heron</h1>
<p>The heron is a <b>long-legged</b> bird of <a href="/f">fresh water</a> and coasts, found on most continents.</p>
<p>Most of its food is <a href="/fish">fish</a>, which it takes by standing still, and then striking at once.</p><h2>Nest</h2>
<p>The nest is built of sticks, high in a tree.</p><figure><img src=h.png><figcaption>A heron at a pond.</figcaption></figure>
<p>Its speed is <math><mi>v</mi><mo>=</mo><mn>40</mn></math> kilometres an hour.</p><noscript><p>Pictures are shown at the end, for those without scripts.</p></noscript></div>
<div class="related"><h3>See also</h3><ul><li><a href="/crane">Crane</a></li><li><a href="/stork">Stork</a></li></ul></div><footer><p>Text is free to use.</p></footer></body></html>""",
        ["Heron", "The heron is a long-legged bird of fresh water and coasts, found on most continents.", "Most of its food is fish, which it takes by standing still, and then striking at once.", "Nest", "The nest is built of sticks, high in a tree.", "A heron at a pond.", "Its speed is v=40 kilometres an hour.", "Pictures are shown at the end, for those without scripts."],
    ),
    (
        """<html><head><script>if (a < b) { x = "</div><p>no"; }</script></head><body><div class="css-1a2b3c"><div class="css-9f8e7d" role="navigation"><a href="#">Shop</a><a href="#">Help</a></div>
<div class="css-00ff00"><article><h1>How to mend a chair</h1><p>A loose leg is the most common fault, and the easiest to mend.</p><p>Take the leg out, clean the joint, and glue it. Wait for a day before you sit down.</p>
<div class="sponsored"><p>Glue of the best kind, from our partner.</p></div><ol><li>Clean the joint.</li><li>Put glue on both sides.</li><li>Press for a day.</li></ol></article></div>
<div class="newsletter-signup"><h4>Never miss a tip</h4><p>Get our letter every week, for free.</p><form><input type=email><button>Subscribe</button></form></div>
<div class="footer-links"><a href="#">Jobs</a><a href="#">Press</a></div></div></body></html>""",
        ["How to mend a chair", "A loose leg is the most common fault, and the easiest to mend.", "Take the leg out, clean the joint, and glue it. Wait for a day before you sit down.", "Clean the joint.", "Put glue on both sides.", "Press for a day."],
    ),
]


def test_pages_written_by_hand():
    model = html_extraction.default_model()
    missed = extra = right = 0
    for page, want in PAGES:
        got = html_extraction.main_text(page, model).split("\n")
        right += len(set(got) & set(want))
        missed += len(set(want) - set(got))
        extra += len(set(got) - set(want))
    assert right / (right + missed) > 0.95 and right / (right + extra) > 0.95, (right, missed, extra)


@pytest.mark.parametrize("maker,most", [(labelled_pages.Maker, 0.01), (labelled_pages.Portal, 0.02)])
def test_accuracy_on_other_pages_of_each_maker(maker, most):
    model, wrong, total = html_extraction.default_model(), 0, 0
    for found, labels in html_extraction.parsed(labelled_pages.labelled_pages(150, 77, (maker,))):
        wrong += sum(a != b for a, b in zip(model.decode(found), labels))
        total += len(labels)
    assert wrong / total < most


@pytest.mark.parametrize("page", ["<div class=a>x" * 100_000, "<div>x" * 50_000 + "</span></p></li></i>" * 50_000, "<ul><li>x" * 50_000, "<p>x" * 100_000, "<svg>" * 100_000 + "x", "<" * 200_000, "<a href='" * 100_000, "&lt" * 300_000])
def test_depth_and_length_take_seconds(page):
    began = time.perf_counter()
    found = html_blocks.blocks(page)
    html_extraction.default_model().decode(found)
    assert time.perf_counter() - began < 20 and len(found) <= len(page)


def test_elements_share_what_is_around_them():
    found = html_blocks.blocks("<div class='a b'>x<div class=b>y<p>z")
    inner = found[2].at
    assert (inner.tag, inner.up.tag, inner.up.up.tag, inner.up.up.up) == ("p", "div", "div", None)
    assert inner.up.up is found[0].at and inner.up.up.fresh == ("tag:div", "name:a", "name:b") and inner.up.fresh == ()
    assert sorted(html_extraction.path_features(inner)) == ["name:a", "name:b", "own:p", "tag:div", "tag:p", "up:div"]


def test_nothing_of_an_article_is_dropped():
    kept = "".join(f"<p>start {t} <{t}>inner {t}</{t}> end {t}</p>" for t in ("noscript", "object", "canvas", "audio", "video", "math", "svg", "em", "ruby"))
    texts = [b.text for b in html_blocks.blocks(f"<article>{kept}<p>Pick <select><option>one<option>two</select> now<p>Last<select><option>x<p>after</article>")]
    assert texts[:9] == [f"start {t} inner {t} end {t}" for t in ("noscript", "object", "canvas", "audio", "video", "math", "svg", "em", "ruby")]
    assert texts[9:] == ["Pick now", "Last", "after"]


def test_query_against_all_paths(spark, tmp_path):
    """Each page's text by the best of all label paths, as far as their number allows, and by one page at a time."""
    import itertools

    from spindex.llm.queries import op8_html_extraction

    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(50, "v", None), (51, "v", ""), (52, None, "<p>One sentence, of the text.<div class=menu><a href=x>no</a></div>"), (53, "w", "<article><h1>T</h1><p>Words here, and there.<p>And more of them.</article><footer>&copy; X</footer>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    model, got = html_extraction.default_model(), {r["page_id"]: r for r in op8_html_extraction(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for page, url, text in rows:
        found = html_blocks.blocks(text or "")
        if len(found) <= 14:
            e = [model.emission(b) for b in found]

            def score(path):
                return (model.first[path[0]] + model.last[path[-1]] if path else 0) + sum(x[y] for x, y in zip(e, path)) + sum(model.step[a][b] for a, b in zip(path, path[1:]))

            want = "\n".join(b.text for b, y in zip(found, max(itertools.product((0, 1), repeat=len(found)), key=score)) if y == labelled_pages.MAIN)
        else:
            want = html_extraction.main_text(text, model)
        assert (got[page]["url"], got[page]["text"], got[page]["n_chars"]) == (url, want, len(want))
