"""Labelled pages: layouts whose elements are marked ``data-content="1"`` or ``"0"``, filled with made-up words."""

from __future__ import annotations

import random

# The layouts. {p} a paragraph, {s} a short phrase, {w} a word, {l} a list of links.
LAYOUTS = (
    """<html><head><title>{s}</title></head><body><nav data-content="0"><ul>{l}</ul></nav><div class="ad" data-content="0">{t}</div>
    <article data-content="1"><h1>{s}</h1><p><b>{s}<br><p>{p}</p><p>{p}</p><p>{s}</p></article><footer data-content="0">&copy; {w}.com &middot; {t}</footer></body></html>""",
    """<body><header class="site-header" data-content="0"><a href="/">{w}</a><p>{s}</p></header><div id="cookie-notice" data-content="0"><p>{t}</p><button>{w}</button></div>
    <main data-content="1"><h1>{s}</h1><div><p>{p}</p><p>{p}</p><ul><li>{t}</li><li>{t}</li></ul><blockquote>{t}</blockquote></div></main>
    <aside data-content="0"><h3>{s}</h3><p>{t}</p><ul>{l}</ul></aside><footer data-content="0"><p>{t}</p></footer></body>""",
    """<body><div class="menu" data-content="0">{l}</div><div id="content" data-content="1"><h2>{s}</h2><p>{p}</p><p>{p}</p><p>{t} <a href="/x">{w}</a>, {t}</p></div>
    <div class="comments" data-content="0"><h3>{s}</h3><div class="comment"><b>{w}</b><p>{p}</p></div><div class="comment"><p>{t}</p></div></div><div class="footer" data-content="0">{t}</div></body>""",
    """<body><div class="page"><div class="navbar" data-content="0"><ul>{l}</ul></div><div class="post" data-content="1"><h1>{s}</h1><p>{p}</p>
    <div class="ad-banner" data-content="0"><p>{t}</p></div><p>{p}</p><table><tr><th>{w}</th><td>{t}</td></tr><tr><td>{w}</td><td>{w}</td></tr></table><p>{p}</p></div>
    <div class="sidebar" data-content="0"><p>{p}</p><p>{t}</p></div></div></body>""",
    """<body><article data-content="1"><header><h1>{s}</h1><p>{t}</p></header><section><h2>{s}</h2><p>{p}</p></section><section><h2>{s}</h2><p>{p}</p><p>{t}</p></section>
    <aside data-content="0"><p>{t}</p></aside><footer data-content="0"><p>{s}</p>{l}</footer></article>
    <section id="comments" data-content="0"><h2>{s}</h2><ol class="commentlist"><li><p>{p}</p></li><li><p>{t}</p></li></ol><form><label>{w}</label><p>{t}</p></form></section></body>""",
    """<body><form class="search" data-content="0"><p>{s}</p><button>{w}</button></form><div data-content="1"><h1>{s}</h1><p>{p}</p><p>{p}</p><p>{p}</p></div>
    <div class="related" data-content="0"><h4>{s}</h4><ul>{l}</ul></div><div class="newsletter-signup" data-content="0"><p>{t}</p></div></body>""",
    """<body><div id="header" data-content="0"><p>{t}</p></div><div class="notice" data-content="0">{t}</div><div class="entry-content" data-content="1">{p}<br><br>{p}<p>{t}</p><pre>{t}</pre></div>
    <div class="share" data-content="0">{s}</div><div class="promo" data-content="0"><p>{p}</p></div><div id="footer" data-content="0">{l}<p>&copy; {t}</p></div></body>""",
    """<body><nav class="breadcrumb" data-content="0">{l}</nav><main data-content="1"><article><h1>{s}</h1><p>{t}</p><dl><dt>{w}</dt><dd>{t}</dd></dl><h3>{w}</h3><p>{s}</p></article></main>
    <div class="widget" data-content="0"><p>{p}</p></div><dialog data-content="0"><p>{t}</p></dialog></body>""",
    """<body><p data-content="1">{p}</p><p data-content="1">{p}</p><div class="reader-comments" data-content="0"><p>{p}</p><p>{p}</p></div></body>""",
)


def labelled_pages(copies: int = 4, seed: int = 7) -> list[str]:
    """Each layout with so many fillings."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 3)))

    def words(low: int, high: int) -> str:
        return " ".join(word() + ("," if draw.random() < 0.08 else "") for _ in range(draw.randint(low, high))).strip(",")

    def fill(layout: str) -> str:
        pieces = layout.split("{")
        out = [pieces[0]]
        for piece in pieces[1:]:
            kind, rest = piece[0], piece[2:]
            if kind == "p":
                made = " ".join(words(5, 25).capitalize() + "." for _ in range(draw.randint(1, 5)))
            elif kind == "t":
                made = words(4, 14).capitalize() + "."
            elif kind == "s":
                made = words(1, 7).capitalize()
            elif kind == "l":
                made = "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(draw.randint(2, 7)))
            else:
                made = word()
            out += [made, rest]
        return "".join(out)

    return [fill(x) for x in LAYOUTS for _ in range(copies)]
