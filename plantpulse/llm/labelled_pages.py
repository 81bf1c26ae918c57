"""Labelled pages to train the block labeller on, made from layout rules.

Each page draws a layout: where the article stands, what surrounds it, and how
carelessly it is written (unclosed tags, cut-off ends).  Labels follow from
the layout: 1 for the article's own blocks, 0 for everything else.
"""

from __future__ import annotations

import numpy as np

_SYLLABLES = "ka to mi re sol va nen dir pol esh an or ul ti gra ben cho lu wex ry".split()
#: Words that pages name their parts by, and elements and roles for them.
_PARTS = {
    "article": ("article post entry content story text body main document single prose".split(), "div div section article main td".split(), "main article".split()),
    "menu": ("nav menu navigation navbar breadcrumb breadcrumbs links topbar tabs toc".split(), "nav nav div ul header td".split(), "navigation menubar".split()),
    "header": ("header masthead branding logo site-title tagline top".split(), "header header div td".split(), "banner".split()),
    "side": ("sidebar aside related widget share social recommended popular recent secondary tags archive".split(), "aside aside div section td".split(), "complementary".split()),
    "advert": ("ad ads advert advertisement banner sponsored promo promotion sponsor".split(), "div div aside ins section".split(), []),
    "notice": ("cookie notice consent popup alert privacy gdpr newsletter subscribe modal".split(), "div div section".split(), "alert dialog".split()),
    "footer": ("footer copyright colophon imprint bottom legal site-info credits".split(), "footer footer div td".split(), "contentinfo".split()),
    "comments": ("comments comment replies respond discussion reactions commentlist thread".split(), "div section ol".split(), []),
    "form": ("search login contact signup form".split(), "form".split(), "search form".split()),
}
#: Words that say nothing of a part.
_NEUTRAL = "wrapper container inner box block area section col left right wide list item row page site clearfix primary group module".split()


def _word(rng) -> str:
    return "".join(rng.choice(_SYLLABLES, int(rng.integers(1, 4))))


def _sentence(rng, n: int) -> str:
    words = [_word(rng) for _ in range(max(1, n))]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", "", "&amp;", ","])


def _name(rng, words) -> str:
    """A class or id with one of the words, alone or among neutral ones."""
    name = str(rng.choice(words))
    if rng.random() < 0.35:
        other = str(rng.choice(_NEUTRAL))
        name = rng.choice("- _".split()).join([name, other] if rng.random() < 0.6 else [other, name])
    return name + (f" {rng.choice(_NEUTRAL)}" if rng.random() < 0.2 else "")


def _element(rng, part: str) -> tuple[str, str]:
    """Start and end tags of an element for that part; the tag, a name or a role tells it."""
    words, tags, roles = _PARTS[part]
    tag = str(rng.choice(tags))
    plain = tag in ("div", "section", "td", "ul", "ol")
    told = "" if not plain and rng.random() < 0.5 else f' {rng.choice(["class", "class", "id"])}="{_name(rng, words)}"'
    if roles and rng.random() < 0.15:
        told = f' role="{rng.choice(roles)}"' + (told if rng.random() < 0.5 else "")
    before, after = ("<table><tr>", "</tr></table>") if tag == "td" else ("", "")
    return f"{before}<{tag}{told}>", f"</{tag}>{after}"


def page(seed: int) -> tuple[str, list[int]]:
    """(html, label of each leaf block) of one page."""
    rng = np.random.default_rng([2024, seed])
    html, labels = ['<!DOCTYPE html><html><head><meta charset="utf-8"><title>t</title><style>p{}</style><script>var a = 1 < 2;</script></head><body>'], []

    def put(markup: str, label: int | None = None):
        html.append(markup)
        if label is not None:
            labels.append(label)

    def box(part, pieces):
        before, after = _element(rng, part)
        put(before)
        for markup in pieces:
            put(markup, 0)
        put(after)

    def links(n):
        return [f'<li><a href="/{_word(rng)}">{_word(rng)}</a></li>' for _ in range(n)]

    def prose(n, least=2, most=30):
        return [f"<p>{_sentence(rng, int(rng.integers(least, most)))}</p>" for _ in range(n)]

    def maybe(p):
        return rng.random() < p

    def item(n):
        return rng.choice([f"<p>{_sentence(rng, n)}</p>", f"<div>{_sentence(rng, n)}</div>", f"<li>{_sentence(rng, n)}</li>", f"<h3>{_sentence(rng, min(n, 8))}</h3>"])

    def aside():
        box("side", [*([f"<h3>{_sentence(rng, 2)}</h3>"] if maybe(0.4) else []), *(prose(int(rng.integers(1, 4)), 2, 15) if maybe(0.4) else links(int(rng.integers(2, 6))))])

    def comments():
        """A heading, then a list of entries; either may carry names of its own."""
        called = lambda: f' class="{_name(rng, _PARTS["comments"][0])}"' if maybe(0.5) else ""
        before, after = _element(rng, "comments")
        put(before)
        if maybe(0.6):
            put(f"<h{rng.integers(2, 5)}{called()}>{_sentence(rng, int(rng.integers(1, 6)))}</h3>", 0)
        outer, inner = (("ol", "li"), ("ul", "li"), ("div", "div"), ("section", "article"))[int(rng.integers(0, 4))]
        put(f"<{outer}{called()}>")
        for _ in range(int(rng.integers(1, 5))):
            put(f"<{inner}{called()}>")
            if maybe(0.3):
                put(f"<{(t := rng.choice(['p', 'h4', 'div']))}>{_word(rng)} {_word(rng)}</{t}>", 0)
            if maybe(0.7):
                put(f"<p>{_sentence(rng, int(rng.integers(2, 50)))}</p>", 0)
            else:
                put(f"<div>{_sentence(rng, int(rng.integers(2, 50)))}</div>", 0)
            put(f"</{inner}>")
        put(f"</{outer}>" + after)

    wrappers = [f'<div {rng.choice(["class", "id"])}="{rng.choice(_NEUTRAL)}">' for _ in range(int(rng.integers(0, 3)))]
    put("".join(wrappers))
    if maybe(0.5):
        box("header", [*prose(1, 1, 6), *(links(2) if maybe(0.2) else [])])
    if maybe(0.85):
        plain = [f'<a href="/{_word(rng)}">{_word(rng)}</a> | ' for _ in range(3)]
        box("menu", links(int(rng.integers(2, 9))) if maybe(0.8) else ["".join(plain)])
    if maybe(0.35):
        box("notice", [item(int(rng.integers(5, 25))), *([f"<button>{_word(rng)}</button>"] if maybe(0.3) else [])])
    if maybe(0.6):
        box("advert", [item(int(rng.integers(2, 25)))])
    if maybe(0.3):
        aside()
    nested = [_element(rng, "article")]
    if maybe(0.4):
        nested.append((f'<div class="{rng.choice(_NEUTRAL)}">', "</div>") if maybe(0.3) else _element(rng, "article"))
    put("".join(x for x, _ in nested))
    if maybe(0.8):
        put(f"<{(h := rng.choice(['h1', 'h1', 'h2']))}>{_sentence(rng, int(rng.integers(1, 12)))}</{h}>", 1)
    for _ in range(int(rng.integers(1, 12))):
        kind = rng.random()
        n = int(rng.integers(1, 12)) if maybe(0.3) else int(rng.integers(8, 90))
        if kind < 0.47:
            put(f"<p>{_sentence(rng, n)}</p>", 1)
        elif kind < 0.53:
            put(f"<p>{_sentence(rng, n)}", 1)
            put("<p>")
        elif kind < 0.6:
            put(f"<p><{(t := rng.choice(['b', 'em', 'i']))}>{_sentence(rng, n)}{rng.choice(['<br>', '', f'</{t}><br>'])}", 1)
            put("<p>")
        elif kind < 0.66:
            put(f"<h2>{_sentence(rng, int(rng.integers(1, 8)))}</h2>", 1)
        elif kind < 0.71:
            tag = rng.choice(["ul", "ol", "dl"])
            put(f"<{tag}>")
            for _ in range(int(rng.integers(1, 4))):
                inner = rng.choice(["dt", "dd"]) if tag == "dl" else "li"
                put(f"<{inner}>{_sentence(rng, int(rng.integers(2, 14)))}</{inner}>", 1)
            put(f"</{tag}>")
        elif kind < 0.74:
            put(f"<blockquote>{_sentence(rng, n)}</blockquote>", 1)
        elif kind < 0.78:
            put(f'<p>{_sentence(rng, n)} <a href="/x">{_word(rng)}</a> {_word(rng)}.</p>', 1)
        elif kind < 0.93:
            box("advert", [item(int(rng.integers(2, 20))) for _ in range(int(rng.integers(1, 3)))])
        elif kind < 0.96:
            box("form", [item(4), f"<button>{_word(rng)}</button>"])
        else:
            aside()
    inside = maybe(0.6)  # what follows the article may stand in its outer element, or in the only one
    put("".join(x for _, x in nested[:0:-1]) if inside else "".join(x for _, x in reversed(nested)))
    if maybe(0.55):
        comments()
    if inside:
        put(nested[0][1])
    if maybe(0.2):
        box("form", [f"<label>{_word(rng)}</label><input>", f"<button>{_word(rng)}</button>"])
    if maybe(0.4):
        aside()
    if maybe(0.85):
        box("footer", [f"&copy; {_word(rng)} &middot; {_sentence(rng, int(rng.integers(1, 15)))}" if maybe(0.5) else item(int(rng.integers(2, 15)))])
    put("</div>" * len(wrappers) + "</body></html>")
    return "".join(html), labels
