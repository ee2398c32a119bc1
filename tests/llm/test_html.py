from __future__ import annotations

import re
import time

import numpy as np

from covenantry.llm import html_text
from covenantry.llm.html_labelled import labelled_pages
from covenantry.llm.html_tree import parse


def texts(*pages):
    return html_text.main_texts(list(pages), *html_text.trained())


def test_marginals_match_enumeration():
    forest = html_text.Forest([parse("<body><nav>a b<div>c d.</div></nav><p>e, f</p></body>"), parse("<p>x")])
    rng = np.random.default_rng(5)
    weights, pairs = rng.normal(size=html_text.NODE_FEATURES), rng.normal(size=(html_text.EDGE_KINDS, 2, 2))
    got, _, partition = forest.messages(weights, pairs)
    n, score = len(forest.parent), forest.features @ weights
    total, one = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        value = np.exp(sum(score[i] * y[i] for i in range(n)) + sum(pairs[forest.edge[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0))
        total += value
        one += value * np.array(y)
    assert np.allclose(np.exp(got[:, 1]), one / total)
    assert np.isclose(np.log(total), partition)


def test_unseen_fillings_of_labelled_layouts():
    right = total = 0
    for page in labelled_pages(copies=3, seed=99):
        tree = parse(page)
        want = [t for t, y in zip(tree.text, html_text._labels(tree), strict=True) if t is not None and y]
        got = texts(page.replace(' data-content="1"', "").replace(' data-content="0"', ""))[0].split("\n\n")
        right += set(want) == set(got)
        total += 1
    assert right / total > 0.9


def test_pages_give_their_article(pages):
    for r in html_text.extract(pages).collect():
        html = next(x.html for x in PAGES(pages) if x.page_id == r.page_id)
        inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        import html as h

        want = " ".join(h.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert " ".join(r.text.split()) == want and r.n_chars == len(r.text)


def PAGES(pages, held={}):  # noqa: B006
    if "rows" not in held:
        held["rows"] = pages.collect()
    return held["rows"]


def test_blocks_references_and_white_space():
    page = "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three <b>four</b>.</p><script>if (a < b) x('</p>')</script><p>caf&eacute; &#8212; <!-- no --> end.<div>Last one here.</div></article></body>"
    assert texts(page) == ["A & B\n\nOne two three four.\n\ncafé — end.\n\nLast one here."]


def test_other_parts_are_left_out():
    p = "This is a sentence of the article, and it goes on for some time. Then it ends."
    page = f"""<html><body><header><h2>Site</h2></header><div class="cookie-banner">We use cookies.</div><ul class="menu"><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul>
    <div class="content"><h1>Title of it</h1><p>{p}</p><div class="advertisement">Buy now, buy here.</div><p>{p}</p></div><div class="sidebar"><p>{p}</p></div>
    <section class="comments"><p>{p} I agree.</p></section><form><p>Your mail, please.</p></form><footer>Copyright, 2024.</footer></body></html>"""
    assert texts(page) == [f"Title of it\n\n{p}\n\n{p}"]


def test_edge_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<<<>>> & < b"), (None, "u", "<p>Just a text, with words."), (3, "u", "<div>" * 3000 + "deep text, here." + "</div>"), (4, "u", "<article><p>" + "long words, here. " * 30_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    assert by[1, "u"].text == "" and by[2, "u"].n_chars == 0
    assert by[4, "u"].text == ("long words, here. " * 30_000).strip()
    assert html_text.extract(df.limit(0)).count() == 0


def test_time_is_in_proportion_to_a_page_whatever_its_markup():
    for unit in ("<a ", '<a "', "<a '>", "<div>", "<p>", "<li><a>", "<!--x-->", "<![CDATA[", "<!", "<script>x</script>", "</div>", "<b><td>", "&amp", "<a b='\"><c \"'>"):
        spent = []
        for size in (250_000, 1_000_000):
            page = unit * (size // len(unit)) + "end >"
            began = time.process_time()
            parse(page)
            spent.append(time.process_time() - began)
        assert spent[1] < 8 * spent[0] + 0.5, (unit, spent)


def test_markup_without_its_end_loses_nothing():
    p = "This is a sentence of the article, and it goes on for some time. Then it ends."
    for broken in ("<video src=x>", "<select><option>one", '<a href="x>', "<object>", "<svg>", "<noscript>"):
        page = f"<article><h1>Title of it</h1><p>{p}</p>{broken}</p></select><p>{p}</p></article>"
        assert texts(page)[0].count("goes on for some time") == 2, broken
    page = f"<article><p>{p}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold, and so on.</p><p>{p}</p></article>"
    assert "Let x=2 hold, and so on." in texts(page)[0]
    deep = "<div>" * 5000 + f"<p>{p}</p>"
    assert len(parse(deep).parent) < 600 and "goes on" in texts(deep)[0]
