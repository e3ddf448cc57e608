"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text without a block-level tag between them. Each block has features of its
ancestors (tags, words of their classes, ids and roles) and of its text (length, links, punctuation). The field scores
content against the rest for each block, and pairs of neighbouring blocks by whether they share their container; Viterbi
picks the best labelling of the page. It is trained on PAGES generated labelled pages (a fixed seed) with many layouts,
by full-batch AdaGrad on the likelihood, on the driver; pages are then mapped one by one, without a shuffle.

Character references are decoded, white space inside a block becomes one space, and content blocks are joined by one line
feed in page order. A line-break tag is white space. Scripts, styles, templates, titles and form controls hold no blocks.

Nulls: a null page is an empty one and gives an empty text. Unclosed, stray or crossing tags are tolerated. Repeated rows
and further columns pass through.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

PAGES, ROUNDS, SEED = 800, 80, 1

# Markup is read by patterns that are matched where the reader stands and never look back, so that a page of any kind
# takes time in proportion to its length.
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?)?)""")
# Kinds of HTML elements.
SKIPPED = frozenset("script style noscript template title textarea select svg math iframe object canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button caption".split())
RAW = frozenset("script style noscript title textarea iframe".split())
ENDS_P = BLOCKS - {"button", "label", "summary", "caption", "html", "head", "body"}
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th")}
OPTIONAL = frozenset("p li dt dd tr td th tbody thead tfoot".split())
#: Words of classes, ids and roles that are features.
WORDS = re.compile(r"nav|menu|head|foot|side|bar|ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|promoted|banner|cookie|consent|notice|alert|gdpr|comment|comments|reply|replies|respond|discussion|disqus|social|share|related|recommended|newsletter|subscribe|signup|login|search|breadcrumb|breadcrumbs|crumbs|widget|form|modal|popup|copyright|legal|meta|byline|tags|pagination|pager|content|article|post|entry|main|story|body|text|page|masthead|logo|navigation|header|footer|sidebar|complementary|contentinfo|topbar|toolbar|links|teaser|hidden|skip|user|thread|feedback|review|reviews|wrapper|container")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


TELLING = frozenset("nav header footer aside form article main".split())
SECTIONS = frozenset("article main section nav aside header footer form body div table ul ol".split())


class Element(NamedTuple):
    """An open element, with what its blocks need to know of its ancestors: sets that children share while they add nothing."""

    tag: str
    words: tuple
    every: frozenset
    near: tuple
    container: int


ROOT = Element("", (), frozenset(), (), 0)


def child(parent: Element, tag: str, words: tuple, number: int) -> Element:
    new = {"in_" + tag, *words}
    near = tuple("near_" + w for w in words or (tag,)) if words or tag in TELLING else parent.near
    return Element(tag, words, parent.every if new <= parent.every else parent.every | new, near, number if tag in SECTIONS else parent.container)


class Block:
    __slots__ = ("parts", "linked", "element")

    def __init__(self, element: Element):
        self.parts, self.linked, self.element = [], 0, element


def tags(page: str, resume: list[int]):
    """(start, end, name, closing, attributes as (start, end), self-closing) of each tag; name is None for comments and the like.

    Reading goes on at resume[0] if the caller has set it further. A tag that never ends reaches to the end of the page. A quote that never closes is a character like others.
    """
    at, end = page.find("<"), len(page)
    while at >= 0:
        m = NAME.match(page, at + 1)
        if m:
            place = first = m.end()
            before = place
            while place < end and (a := ATTRIBUTE.match(page, place)):
                before, place = place, a.end()
                if a[1]:
                    break
            else:
                place = before = end
            yield at, place, m[1].lower(), page[at + 1] == "/", (first, before), page[place - 2 : place] == "/>" and before < place - 1
        elif page.startswith("<!--", at):
            close = page.find("-->", at + 2)
            place = close + 3 if close >= 0 else end
            yield at, place, None, False, (0, 0), False
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            close = page.find(">", at)
            place = close + 1 if close >= 0 else end
            yield at, place, None, False, (0, 0), False
        else:
            place = at + 1
        at = page.find("<", max(place, resume[0]))


def blocks(page: str) -> list[tuple[str, float, Element]]:
    """(text, share of it in links, innermost element) of each leaf block with text."""
    out, stack, links, now, at, number, unclosed, opened, resume = [], [ROOT], 0, None, 0, 0, set(), Counter(), [0]
    end = len(page)

    def put(a: int, b: int) -> None:
        nonlocal now
        if a < b:
            text = page[a:b]
            if "&" in text:
                text = html.unescape(text)
            if now is None:
                if text.isspace():
                    return
                now = Block(stack[-1])
                out.append(now)
            now.parts.append(text)
            if links:
                now.linked += len(text)

    def leave(names, through) -> None:
        """Close the innermost element of these names, and what it holds, if only elements of `through` are in it."""
        if not any(opened[n] for n in names):
            return
        i = len(stack) - 1
        while i and stack[i].tag not in names:
            if through is not None and stack[i].tag not in through:
                return
            i -= 1
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    for start, stop, tag, closing, (first, last), alone in tags(page, resume):
        put(at, start)
        at = stop
        if tag is None:
            continue
        if tag in SKIPPED:
            if not closing and not (alone and tag in ("svg", "math")) and tag not in unclosed:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                if close:
                    resume[0] = at = page.find(">", close.end()) + 1 or end
                else:
                    unclosed.add(tag)
                    resume[0] = at = end if tag in RAW else at
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCKS:
            continue
        now, links = None, 0
        if closing:
            leave((tag,), None)
            continue
        if tag in ENDS_P:
            leave(("p",), OPTIONAL)
        if tag in IMPLIED:
            leave(IMPLIED[tag], OPTIONAL)
        if tag != "hr":
            number += 1
            opened[tag] += 1
            stack.append(child(stack[-1], tag, named(page[first:last]) if first < last else (), number))
    put(at, end)
    found = []
    for b in out:
        raw = "".join(b.parts)
        if text := " ".join(raw.split()):
            found.append((text, b.linked / len(raw), b.element))
    return found


@lru_cache(65536)
def named(attributes: str) -> tuple[str, ...]:
    """Features of an element's class, id, role and visibility."""
    out = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[2] or "").lower(), m[3] or m[4] or m[5] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            out |= {"w_" + w.lower() for w in CAMEL.findall(value) if WORDS.fullmatch(w.lower())}
        elif name == "style" and "none" in value.replace(" ", "").lower():
            out.add("w_hidden")
    return tuple(sorted(out))


def step(n: float, cuts) -> int:
    return sum(n >= c for c in cuts)


def page_features(found) -> tuple[list[list[str]], list[int]]:
    """Features of each block, and whether it shares its nearest sectioning ancestor with the block before."""
    out, same, before = [], [], None
    total = len(found)
    for i, (text, linked, element) in enumerate(found):
        f = {"bias", *element.every, *element.near}
        if element.tag:
            f.add("own_" + element.tag)
            f.update("own_" + w for w in element.words)
        words = text.count(" ") + 1
        f.add(f"words_{step(words, (2, 4, 8, 15, 30, 60))}")
        f.add(f"links_{step(linked, (0.01, 0.3, 0.7, 0.95))}")
        f.add("stop" if text[-1] in ".!?:;\"'”»" else "nostop")
        f.add(f"commas_{step(text.count(',') + text.count('. '), (1, 3, 8))}")
        if "©" in text or "(c)" in text[:8].lower():
            f.add("copyright")
        f.add("first" if i == 0 else "last" if i == total - 1 else "middle")
        out.append(list(f))
        same.append(int(element.container == before))
        before = element.container
    return out, same


class Chain:
    """The field: content score of each feature, and scores of label pairs for blocks in different and in one container."""

    def __init__(self):
        self.score: dict[str, float] = {}
        self.pair = np.zeros((2, 2, 2))

    def label(self, found) -> list[bool]:
        """Viterbi."""
        if not found:
            return []
        rows, same = page_features(found)
        get, pairs = self.score.get, self.pair.tolist()
        no, yes, back = 0.0, 0.0, []
        for n, (row, s) in enumerate(zip(rows, same)):
            score = sum(get(f, 0.0) for f in row)
            if n:
                p = pairs[s]
                a, b = no + p[0][0], yes + p[1][0]
                c, d = no + p[0][1], yes + p[1][1]
                back.append((b > a, d > c))
                no, yes = max(a, b), max(c, d) + score
            else:
                yes = score
        out = [yes > no]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]

    def fit(self, pages: list[tuple[list, list[bool]]], rounds: int) -> Chain:
        data = [(*page_features(found), truth) for found, truth in pages if found]
        names = sorted({f for rows, _, _ in data for r in rows for f in r})
        number = {f: i for i, f in enumerate(names)}
        n, longest = len(data), max(len(d[0]) for d in data)
        page, place, column = np.array([(p, t, number[f]) for p, (rows, _, _) in enumerate(data) for t, r in enumerate(rows) for f in r]).T
        size = np.array([len(d[0]) for d in data])
        same, truth = np.zeros((n, longest), int), np.zeros((n, longest), int)
        for p, (_, s, y) in enumerate(data):
            same[p, : len(s)], truth[p, : len(y)] = s, y
        live = np.arange(longest)[None, :] < size[:, None]
        weights, pair = np.zeros(len(names)), np.zeros((2, 2, 2))
        seen_w, seen_p = np.full(len(names), 1e-6), np.full((2, 2, 2), 1e-6)
        every = np.arange(n)
        for _ in range(rounds):
            emit = np.zeros((n, longest, 2))
            np.add.at(emit[:, :, 1], (page, place), weights[column])
            forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            forward[:, 0] = emit[:, 0]
            for t in range(1, longest):
                forward[:, t] = emit[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + pair[same[:, t]], axis=1)
            for t in range(longest - 2, -1, -1):
                after = np.logaddexp.reduce(pair[same[:, t + 1]] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where((t + 1 < size)[:, None], after, 0)
            norm = np.logaddexp.reduce(forward[every, size - 1], axis=1)
            chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - norm[:, None])
            gradient = np.bincount(column, weights=(truth - chance)[page, place], minlength=len(names)) - 0.05 * weights
            both = np.exp(forward[:, :-1, :, None] + pair[same[:, 1:]] + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, None, None, None])
            off = -both
            np.add.at(off, (every[:, None], np.arange(longest - 1)[None, :], truth[:, :-1], truth[:, 1:]), 1)
            off[~live[:, 1:]] = 0
            turn = np.zeros((2, 2, 2))
            np.add.at(turn, same[:, 1:].ravel(), off.reshape(-1, 2, 2))
            turn -= 0.05 * pair
            seen_w += gradient**2
            seen_p += turn**2
            weights += 0.5 * gradient / np.sqrt(seen_w)
            pair += 0.5 * turn / np.sqrt(seen_p)
        self.score, self.pair = dict(zip(names, weights.tolist())), pair
        return self


def generated(rng: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout and the texts of its content blocks."""
    pick = rng.choice
    content: list[str] = []
    serial = iter(range(10**9))

    def words(low: int, high: int, stop: str = "") -> str:
        w = ["".join(pick("aeiorstnlmdéü") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
        if rng.random() < 0.6:
            w = [x + "," if rng.random() < 0.08 else x + "." if rng.random() < 0.08 else x for x in w]
        return f"{' '.join(w).capitalize()} {next(serial)}{stop}"

    def good(tag: str, low: int, high: int, stop: str = ".") -> str:
        text = words(low, high, stop if rng.random() < 0.8 else "")
        content.append(text)
        inner = text
        if rng.random() < 0.3:
            parts = text.split(" ")
            k = rng.randrange(len(parts))
            name = pick(["b", "i", "em", "strong", "a href='/x'", "span"])
            parts[k] = f"<{name}>{parts[k]}</{name.split()[0]}>"
            inner = " ".join(parts)
        return f"<{tag}>{inner}" + ("" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>")

    def wrap(names: list[str], inner: str) -> str:
        name = pick(names)
        tag = name.split()[0]
        return f"<{name}>{inner}</{tag}>"

    def links(low: int, high: int) -> str:
        items = [f"<a href='/{k}'>{words(1, 3)}</a>" for k in range(rng.randint(low, high))]
        return pick([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items), lambda: "".join(f"<p>{x}</p>" for x in items)])()

    def prose(n: int) -> str:
        return "".join(f"<p>{words(3, 40, pick(['.', '', '!']))}</p>" for _ in range(rng.randint(1, n)))

    def plain() -> str:
        return pick([lambda: words(3, 25, pick([".", ""])), lambda: prose(2), lambda: f"<h3>{words(1, 4)}</h3>" + prose(2), lambda: f"<p>{words(4, 20, '.')} <a href='/o'>{words(1, 2)}</a></p>"])()

    header = lambda: wrap(["header", "div class='header'", "div id='masthead'", "div class='site-header'", "header class='page-header'", "div id='top-header'"], pick([f"<h1>{words(1, 4)}</h1>", f"<p>{words(1, 6)}</p>", words(1, 5), f"<div class='logo'><a href='/'>{words(1, 2)}</a></div>"]) + (links(2, 5) if rng.random() < 0.4 else ""))
    nav = lambda: wrap(["nav", "div class='nav'", "div class='menu'", "ul class='menu'", "div id='navigation'", "div role='navigation'", "nav class='main-nav'", "div class='breadcrumbs'", "div class='topbar'"], links(2, 8))
    side = lambda: wrap(["aside", "div class='sidebar'", "div id='sidebar'", "aside class='side'", "div class='widget'", "div class='related'", "section class='related'", "div role='complementary'"], pick([lambda: f"<h3>{words(1, 3)}</h3>" + links(2, 6), plain])())
    notice = lambda: wrap(["div class='notice'", "div class='cookie-notice'", "div id='cookie-banner'", "p class='notice'", "div role='alert'", "div class='alert'", "div class='gdpr-consent'", "section class='notice'"], pick([lambda: words(4, 20, "."), lambda: f"{words(4, 15, '.')} <button>{words(1, 2)}</button>"])())
    advert = lambda: wrap(["div class='ad'", "div class='ads'", "div class='advert'", "div class='advertisement'", "div class='sponsored'", "div id='banner-ad'", "aside class='promo'", "section class='ad'", "p class='ad'", "div class='ad-box'"], plain())
    form = lambda: "<form action='/s'>" + "".join(pick([f"<label>{words(1, 3)}</label><input name=q>", f"<p>{words(3, 12, '.')}</p>", f"<button>{words(1, 2)}</button>", f"<div>{words(2, 8)}</div>"]) for _ in range(rng.randint(1, 4))) + "</form>"
    remark = lambda: wrap(["div class='comment'", "li class='comment'", "article class='comment'", "div class='reply'", "p", "li", "div class='user-comment'"], pick([lambda: f"<p>{words(3, 40, '.')}</p>", lambda: words(3, 40, "."), lambda: f"<b>{words(1, 2)}</b><p>{words(3, 40, '.')}</p>"])())
    comments = lambda: wrap(["section class='comments'", "div id='comments'", "div class='comments'", "section id='comments'", "div class='discussion'", "ol class='comment-list'", "div class='reader-comments'"], (f"<h2>{words(1, 3)}</h2>" if rng.random() < 0.5 else "") + "".join(remark() for _ in range(rng.randint(1, 5))))
    footer = lambda: wrap(["footer", "div class='footer'", "div id='footer'", "footer class='site-footer'", "div role='contentinfo'"], pick([lambda: f"&copy; {words(1, 4)} &middot; {words(2, 12, '.')}", lambda: prose(2), lambda: links(2, 6) + f"<p>&copy; {words(1, 6)}</p>"])())
    other = [header, nav, side, notice, advert, form, comments, footer]

    def article() -> str:
        parts = [good(pick(["h1", "h1", "h2"]), 1, 12, "")] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 9)):
            parts.append(pick([lambda: good("p", 1, 90), lambda: good("p", 1, 90), lambda: good("p", 5, 60), lambda: good("p", 1, 3), lambda: good("h2", 1, 6, ""), lambda: "<ul>" + "".join(good("li", 1, 15) for _ in range(rng.randint(1, 4))) + "</ul>", lambda: "<blockquote>" + good("p", 3, 40) + "</blockquote>", lambda: "<table><tr>" + good("td", 1, 4, "") + good("td", 1, 4, "") + "</tr></table>", lambda: good("div", 3, 60), lambda: "<p><b>" + good("span", 4, 60) + "<br>", lambda: good("pre", 2, 20), lambda: "<figure><img src=x>" + good("figcaption", 2, 12) + "</figure>"])())
            if rng.random() < 0.1:
                parts.append(pick([advert, side, form, notice, comments])())
        return "".join(parts)

    bodies = ["article", "article", "main", "div class='content'", "div id='content'", "div class='post-body'", "div class='article-text'", "section class='story'", "div class='entry'", "div role='main'", "article class='post'", "section", "div"]
    before = [x() for x in rng.sample([header, nav, nav, notice, advert, side, form], rng.randint(1, 4))]
    inner = article()
    main = wrap(bodies, inner)
    if rng.random() < 0.3:
        main = wrap(["main", "div class='wrapper'", "div id='page'", "div class='container'"], main + (side() if rng.random() < 0.5 else ""))
    after = [x() for x in rng.sample(other[2:], rng.randint(1, 4))]
    return f"<html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{''.join(before)}{main}{''.join(after)}</body></html>", content


@lru_cache(1)
def trained(pages: int = PAGES, rounds: int = ROUNDS, seed: int = SEED) -> Chain:
    rng, data = random.Random(seed), []
    for _ in range(pages):
        page, content = generated(rng)
        found, known = blocks(page), {" ".join(c.split()) for c in content}
        data.append((found, [b[0] in known for b in found]))
    return Chain().fit(data, rounds)


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, good in zip(found, chain.label(found)) if good)


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), chain: Chain | None = None) -> DataFrame:
    """The kept columns with text and n_chars."""
    chain = chain or trained()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(p, chain) if p else "" for p in batch.column("__html").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*keep, "text", "n_chars"])

    chosen = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_batches(chosen, run, f"{schema}, text string, n_chars long")
