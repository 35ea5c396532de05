"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements; inline elements belong to the block around them. Each block
is content or not: a potential of its own comes from its tag, the words of its class, id and role, and its
text and links, and a potential between parent and child from both states and the kind of the child. The
tree has no cycles, so sum-product messages, up to the root and down again, give exact marginals; all
pages of a batch are passed level by level at once. Weights maximise the likelihood of labelled pages,
with gradients from the same messages.

Labelled pages are HTML whose ``data-main`` attributes say 1 or 0 for a block and those inside it.
``labelled_pages`` invents them from many layouts; pages of one's own can be given instead.

Text of a block between other blocks is one line: references decoded, white space made one space. Embedded
elements (pictures, players, templates) are parsed and left out with what is in them; one that is never
closed, or that the end of a block around it cuts off, takes nothing else with it. Formulas are text.
``WEIGHTS`` holds the weights of ``train(labelled_pages())``; ``python -m loomstat.llm.html_text`` writes it.

Null and empty pages, and pages without content, have an empty text; a page that is only an article, be
it loose text, one block or a fragment, is all content. Pages are handled one by one, so repeated rows and
ids give repeated results, and no size or depth of a page drops anything. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import prepare

# Names of HTML elements by how the standard's parser treats them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr br".split())
INLINE |= frozenset("math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands up to the end tag is not markup.
RAW = frozenset("script style iframe noframes noembed".split())
#: Elements whose content is no text of the page: pictures, or what stands in for something that is not shown.
EMBEDDED = frozenset("svg canvas object applet audio video template noscript annotation annotation-xml".split())
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
    "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
TAGS = "html body head title div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th nav header footer aside form fieldset button select option textarea blockquote pre figure figcaption address details summary dialog menu input".split()
TAG_AT = {t: k for k, t in enumerate(TAGS)}
#: Words in class, id, role and itemprop, by what they say of a block.
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pagination pager skip topbar",
    "head": "header masthead logo branding hero-nav topnav banner",
    "foot": "footer foot copyright colophon contentinfo legal bottom",
    "side": "sidebar side aside complementary rail widget widgets related recommended recommendations popular trending more-stories tags tagcloud archive",
    "advert": "ad ads advert adverts advertisement advertorial adsense adbox sponsor sponsored promo promotion dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall message disclaimer warning note hatnote",
    "form": "form search searchbox login signin register contact-form survey",
    "comment": "comment comments commentlist comment-list disqus discussion reply replies respond response responses reader-comments feedback thread threads",
    "share": "share sharing social follow like tweet buttons toolbar print byline-tools meta",
    "hidden": "hidden invisible sr-only visually-hidden screen-reader-text",
    "main": "article main content post entry story body text page-content post-content entry-content article-body articlebody story-body maincontent main-content",
}
KIND_OF = {w: k for k, words in enumerate(KINDS.values()) for w in words.split()}
BAD_TAGS = frozenset("nav header footer aside form fieldset button select option textarea menu input head title dialog".split())
GOOD_TAGS = frozenset("article main".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NUMBERS = 20
#: A short line with a date, a time or how long ago.
DATED = re.compile(r"\b\d{1,2}:\d{2}\b|\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b(?:19|20)\d\d\b|\bago\b", re.I)
#: Elements that an article is made of.
PROSE = frozenset("p h1 h2 h3 h4 blockquote pre".split())
FEATURES = 1 + len(TAGS) + len(KINDS) + NUMBERS
EDGE_KINDS = 3


@lru_cache(maxsize=20_000)
def _kinds(attributes: str) -> tuple[tuple[int, ...], int | None]:
    """Kinds that attributes tell of, and the label in them."""
    found, label = set(), None
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for word in value.split():
                for x in (word, *re.split(r"[-_:\d]+", word)):
                    if x in KIND_OF:
                        found.add(KIND_OF[x])
        elif name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
            found.add(KIND_OF["hidden"])
        elif name == "data-main":
            label = int(value == "1")
    if re.search(r"\shidden(?=[\s=]|\Z)", ATTRIBUTE.sub(" ", attributes)):
        found.add(KIND_OF["hidden"])
    return tuple(sorted(found)), label


class Tree:
    """Blocks of one page: parent, tag, attributes, and lines of text as (block, text, length of its links)."""

    __slots__ = ("attributes", "lines", "parent", "tag")

    def __init__(self, page: str):
        self.parent, self.tag, self.attributes, self.lines = [-1], ["html"], [""], []
        stack, text, link, in_link, pos = [0], [], 0, False, 0
        parent, tag, attributes = self.parent, self.tag, self.attributes
        open_: dict[str, int] = {}  # how many blocks of a name are open
        dropped: list[str] = []  # an embedded element and what is open in it
        last_end: dict[str, int] = {}

        def flush() -> None:
            nonlocal link
            if text:
                line = " ".join(entities.unescape("".join(text)).split())
                if line:
                    self.lines.append((stack[-1], line, min(link, len(line))))
                text.clear()
            link = 0

        def leave(k: int) -> None:
            for x in stack[k:]:
                open_[tag[x]] -= 1
            del stack[k:]

        def up_to(names: frozenset, within: frozenset = frozenset()) -> int:
            """Place on the stack of the innermost block of these names, 0 if there is none before one of within."""
            if any(open_.get(x) for x in names):
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] in within:
                        return 0
                    if tag[stack[k]] in names:
                        return k
            return 0

        def ends_later(name: str, at: int) -> bool:
            if name not in last_end:
                last_end[name] = max((m.start() for m in re.finditer(f"</{re.escape(name)}(?=[\\s/>])", page, re.I)), default=-1)
            return last_end[name] >= at

        while True:
            restart = False
            for m in TOKEN.finditer(page, pos):
                if m.start() > pos and not dropped:
                    text.append(page[pos : m.start()])
                    if in_link:
                        link += m.start() - pos
                pos, name = m.end(), m[2]
                if name is None:
                    continue
                name, closing = name.lower(), m[1]
                if name in RAW:
                    if not closing and not m[3].endswith("/"):
                        end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, pos)
                        pos, restart = end.end() if end else len(page), True
                        break
                    continue
                if dropped:
                    if not closing:
                        if name not in INLINE and name not in VOID and not m[3].endswith("/"):
                            dropped.append(name)
                        continue
                    if name in dropped:
                        del dropped[len(dropped) - 1 - dropped[::-1].index(name) :]
                        continue
                    if name in INLINE or name in ("html", "body") or not open_.get(name):
                        continue
                    dropped.clear()  # the block around it ends
                if name in INLINE:
                    if name == "a":
                        in_link = not closing
                    elif name == "br":
                        text.append(" ")
                    continue
                if name in EMBEDDED:
                    if not closing and not m[3].endswith("/") and ends_later(name, pos):
                        dropped.append(name)
                    continue
                flush()
                if closing:
                    if name not in ("body", "html") and (k := up_to(frozenset((name,)))):
                        leave(k)
                    continue
                if name in ("html", "body") and len(stack) == 1 and name in tag[: 1 if name == "html" else None]:
                    if name == "html":
                        attributes[0] = m[3]
                    continue
                if len(stack) > 1 and tag[stack[-1]] == "p":
                    leave(len(stack) - 1)
                if name in CLOSES:
                    shut, within = CLOSES[name]
                    k = up_to(shut, within)
                    if name == "tr" and k and tag[stack[k]] != "tr" and tag[stack[k - 1]] in shut:
                        k = up_to(frozenset(("tr",)), within) or k
                    if k:
                        leave(k)
                parent.append(stack[-1]), tag.append(name), attributes.append(m[3])
                if name not in VOID and not m[3].endswith("/"):
                    stack.append(len(tag) - 1)
                    open_[name] = open_.get(name, 0) + 1
            if not restart:
                break
        if pos < len(page) and not dropped:
            text.append(page[pos:])
        flush()


class Forest:
    """Pages of a batch as arrays over all blocks, and blocks by depth."""

    def __init__(self, pages: Iterable[str]):
        self.trees = [Tree(p) for p in pages]
        n = [len(t.tag) for t in self.trees]
        self.first = np.r_[0, np.cumsum(n)].astype(np.int64)
        total = int(self.first[-1])
        own = np.repeat(self.first[:-1], n)
        local = np.fromiter((p for t in self.trees for p in t.parent), np.int64, total)
        self.parent = np.where(local >= 0, local + own, -1)
        depth = np.zeros(total, np.int64)
        for t, s in zip(self.trees, self.first, strict=False):
            d = [0] * len(t.tag)
            for k in range(1, len(d)):
                d[k] = d[t.parent[k]] + 1
            depth[s : s + len(d)] = d
        order = np.argsort(depth, kind="stable")
        at = np.searchsorted(depth[order], np.arange((depth.max() if total else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.x = np.zeros((total, FEATURES), np.float32)
        self.edge = np.zeros(total, np.int64)
        self.label = np.full(total, -1)
        self._features(total)

    def _features(self, total: int) -> None:
        x, k = self.x, 0
        x[:, 0] = 1
        for t in self.trees:
            for tag, attributes in zip(t.tag, t.attributes, strict=True):
                if (at := TAG_AT.get(tag)) is not None:
                    x[k, 1 + at] = 1
                kinds, label = _kinds(attributes) if attributes else ((), None)
                for kind in kinds:
                    x[k, 1 + len(TAGS) + kind] = 1
                main = KIND_OF["main"]
                bad = tag in BAD_TAGS or any(kind != main for kind in kinds)
                self.edge[k] = 1 if bad else 2 if tag in GOOD_TAGS or kinds else 0
                if label is not None:
                    self.label[k] = label
                k += 1
        chars, links, lines, ends, dated = (np.zeros(total) for _ in range(5))
        for t, s in zip(self.trees, self.first, strict=False):
            for node, line, link in t.lines:
                k = s + node
                chars[k] += len(line)
                links[k] += link
                lines[k] += 1
                ends[k] += line[-1] in ".!?…。！？\"”»:"
                dated[k] += len(line) < 80 and DATED.search(line) is not None
        all_chars, all_links, all_ends, all_lines, all_dated = chars.copy(), links.copy(), ends.copy(), lines.copy(), dated.copy()
        for level in self.levels[:0:-1]:
            for a in (all_chars, all_links, all_ends, all_lines, all_dated):
                np.add.at(a, self.parent[level], a[level])
        prose, again, rows, entry = (np.zeros(total) for _ in range(4))
        page = np.repeat(self.first[:-1], np.diff(self.first))
        marked = np.zeros(total)  # text in marked blocks, and entries, by page
        for t, s in zip(self.trees, self.first, strict=False):
            inside: list[list[str]] = [[] for _ in t.tag]
            for node, tag in enumerate(t.tag):
                if node:
                    inside[t.parent[node]].append(tag)
                    if tag in PROSE and not self.edge[s + node]:  # children that are not marked as anything
                        prose[s + t.parent[node]] += chars[s + node]
                if self.edge[s + node] == 1:
                    marked[s] += all_chars[s + node]
            # Siblings that are built alike, as the entries of a thread or a listing are.
            alike: dict[tuple, list[int]] = {}
            for node, tag in enumerate(t.tag):
                if node and tag not in PROSE and (inside[node] or tag in ("li", "div", "section")):
                    alike.setdefault((t.parent[node], tag, *inside[node][:4]), []).append(node)
            for (up, _, *first), nodes in alike.items():
                if len(nodes) > 1:
                    at = [s + x for x in nodes]
                    again[at] = len(nodes)
                    rows[s + up] = max(rows[s + up], len(nodes))
                    entry[at] = bool(first) & (all_dated[at] > 0)
        for level in self.levels[1:]:  # what is in an entry is of it
            entry[level] = np.maximum(entry[level], entry[self.parent[level]])
        np.add.at(marked, page, entry)
        share = lambda a, b: a / np.maximum(b, 1)
        has, whole = chars > 0, all_chars[page] if total else chars
        x[:, -NUMBERS:] = np.stack([
            has, np.minimum(np.log1p(chars), 7) / 7, share(links, chars), share(ends, lines), (share(links, chars) > 0.6) * has, np.minimum(np.log1p(all_chars), 9) / 9, share(all_links, all_chars), (all_chars == 0), np.minimum(all_ends, 5) / 5,
            np.minimum(np.log1p(prose), 8) / 8, prose > 0, np.minimum(np.log1p(again), 3) / 3, np.minimum(np.log1p(rows), 3) / 3, share(dated, lines), share(all_dated, all_lines), entry, (rows > 0) * np.minimum(1, 3 * share(all_dated, all_lines)),
            share(all_chars, whole), has * (x[:, 1 + TAG_AT["html"]] + x[:, 1 + TAG_AT["body"]]), (marked[page] == 0) if total else has,
        ], 1)
        if (self.label >= 0).any():  # a label holds for the blocks inside
            for level in self.levels[1:]:
                inherit = self.label[level] < 0
                self.label[level[inherit]] = self.label[self.parent[level[inherit]]]


class Model:
    """Weights of the potentials: unary over features, pair by the child's kind, the parent's and the child's state."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Log beliefs of every block, and for every block but roots the log belief of (parent, own) states."""
        n = len(f.x)
        up = np.zeros((n, 2))
        up[:, 1] = f.x @ self.unary
        sent = np.zeros((n, 2))
        for level in f.levels[:0:-1]:
            s = self.pair[f.edge[level]] + up[level][:, None, :]
            sent[level] = np.logaddexp(s[:, :, 0], s[:, :, 1])
            np.add.at(up, f.parent[level], sent[level])
        both = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            above = up[f.parent[level]] - sent[level]  # what the parent believes without this child
            own = self.pair[f.edge[level]] + above[:, :, None]
            both[level] = own + up[level][:, None, :]
            up[level] += np.logaddexp(own[:, 0, :], own[:, 1, :])
        return up, both

    def marginals(self, f: Forest) -> np.ndarray:
        """Probability of each block to be content."""
        up, _ = self.messages(f)
        return 1 / (1 + np.exp(np.clip(up[:, 0] - up[:, 1], -50, 50)))


def train(pages: list[str], steps: int = 500, rate: float = 0.08, decay: float = 5e-4) -> Model:
    """Maximum likelihood on labelled pages, by Adam on exact gradients."""
    f = Forest(pages)
    y = np.maximum(f.label, 0)
    child = np.concatenate(f.levels[1:])
    seen = np.zeros((EDGE_KINDS, 2, 2))
    np.add.at(seen, (f.edge[child], y[f.parent[child]], y[child]), 1)
    m = Model(np.zeros(FEATURES), np.zeros((EDGE_KINDS, 2, 2)))
    params, n = [m.unary, m.pair], len(f.x)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        up, both = m.messages(f)
        p1 = 1 / (1 + np.exp(np.clip(up[:, 0] - up[:, 1], -50, 50)))
        b = both[child]
        b = np.exp(b - b.max((1, 2), keepdims=True))
        b /= b.sum((1, 2), keepdims=True)
        hoped = np.zeros_like(seen)
        np.add.at(hoped, f.edge[child], b)
        for k, (p, g) in enumerate(zip(params, ((p1 - y) @ f.x / n * 20 + decay * m.unary, (hoped - seen) / n * 20 + decay * m.pair), strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return m


def labelled_pages(n: int = 800, seed: int = 11) -> list[str]:
    """Invented pages of many layouts, with data-main on their blocks."""
    rnd = random.Random(seed)
    pick, maybe = rnd.choice, lambda p: rnd.random() < p

    def words(a: int, b: int, stop: str = ".") -> str:
        w = ["".join(pick("aeioubcdlmnrstvp") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(a, b))]
        for k in range(8, len(w), rnd.randint(9, 18)):
            w[k] += pick(".,.,;")
        return " ".join(w).capitalize() + stop

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 4, "")}</a></li>' for i in range(k))

    def body_blocks() -> str:
        out = [f"<h1>{words(3, 14, pick(['', '', '.']))}</h1>"] if maybe(0.8) else []
        for _ in range(rnd.randint(1, 9)):
            p = words(3, 120)
            if maybe(0.12):
                p = words(1, 8, "") + f" {date()} " + words(1, 12, pick([".", ""]))
            elif maybe(0.15):
                p = words(2, 20) + f' <a href="#">{words(1, 5, "")}</a> ' + words(3, 40)
            kind = rnd.random()
            if kind < 0.7:
                out.append(f"<p>{'<b>' if maybe(0.1) else ''}{p}{'<br>' if maybe(0.1) else ''}{'</p>' if maybe(0.85) else ''}")
            elif kind < 0.76:
                out.append(f"<h2>{words(2, 8, '')}</h2><p>{p}</p>")
            elif kind < 0.82:
                out.append(f"<{(t := pick(['ul', 'ol']))}>" + "".join(f"<li>{words(2, 25, pick(['', '.']))}</li>" for _ in range(rnd.randint(2, 6))) + f"</{t}>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{p}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<pre>{words(4, 30, '')}</pre>")
            elif kind < 0.94:
                dates = maybe(0.4)
                out.append("<table>" + "".join(f"<tr><td>{rnd.randint(1900, 2030) if dates else words(1, 4, '')}</td><td>{words(1, 6, '')}</td></tr>" for _ in range(rnd.randint(2, 6))) + "</table>")
            elif kind < 0.97:
                out.append(f"<figure><img src=x><figcaption>{words(3, 15)}</figcaption></figure>")
            else:
                out.append(f"<div>{p}</div>")
            if maybe(0.06):
                out.append(f'<div class="{pick(["ad", "ads", "advert", "promo", "sponsored"])}" data-main="0">{words(3, 30)}</div>')
            if maybe(0.03):
                out.append(f'<aside data-main="0"><p>{words(4, 30)}</p></aside>')
        return "".join(out)

    def article() -> str:
        inner = body_blocks()
        if maybe(0.15):
            inner = f'<header>{f"<h1>{words(3, 9, str())}</h1>"}</header>' + inner
        if maybe(0.2):
            inner += f'<div class="{pick(["share", "social", "tags", "related"])}" data-main="0"><ul>{links(3)}</ul></div>'
        if maybe(0.1):
            inner += f'<footer data-main="0">{words(2, 12)}</footer>'
        if maybe(0.15):
            inner += junk(pick(["comments", "form", "notice", "side"]))
        shape = rnd.random()
        if shape < 0.15:  # no element of its own: the body holds it
            return inner
        if shape < 0.45:
            return f'<article data-main="1">{inner}</article>'
        if shape < 0.6:
            return f'<main data-main="1">{inner}</main>'
        if shape < 0.7:
            return f'<main data-main="1"><article>{inner}</article></main>'
        name = pick(["content", "post", "entry-content", "story-body", "article-body", "main-content", "text", "post-content"])
        if shape < 0.95:
            return f'<div {pick(["class", "id"])}="{name}" data-main="1">{inner}</div>'
        return f'<div data-main="1">{inner}</div>'

    def prose_or_links() -> str:
        return pick([lambda: f"<ul>{links(rnd.randint(2, 7))}</ul>", lambda: f"<p>{words(3, 40)}</p>", lambda: words(3, 40), lambda: f"<h3>{words(1, 4, '')}</h3><p>{words(3, 30)}</p>"])()

    def junk(kind: str) -> str:
        name = {
            "nav": ["menu", "navbar", "breadcrumb", "main-menu", "nav"], "header": ["header", "masthead", "site-header", "top-banner"],
            "footer": ["footer", "site-footer", "legal", "copyright"], "side": ["sidebar", "widget", "related", "popular", "side"],
            "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "promo"], "notice": ["cookie-notice", "cookies", "notice", "alert", "newsletter", "popup", "consent", "modal"],
            "comments": ["comments", "comment-list", "reader-comments", "disqus", "discussion", "replies"], "form": ["search", "login", "contact-form", "signup"],
        }[kind]
        name = pick(name)
        attributes = f'{pick(["class", "class", "id"])}="{name}"'
        if kind == "comments":
            inner = f"<h2>{words(1, 3, '')}</h2>" * maybe(0.6) + "".join(pick([f'<div class="comment"><p>{words(5, 80)}</p></div>', f'<li class="comment">{words(5, 60)}</li>', f"<p>{words(5, 60)}</p>"]) for _ in range(rnd.randint(1, 5)))
            tag = pick(["div", "section", "ol", "div"])
        elif kind == "form":
            inner, tag = f'<label>{words(1, 3, "")}</label><input name=q><select><option>{words(1, 2, "")}</option></select><button>{words(1, 2, "")}</button><p>{words(3, 20)}</p>', pick(["form", "form", "div"])
            inner = f"<form>{inner}</form>" if tag == "div" else inner
        elif kind == "nav":
            inner, tag = pick([f"<ul>{links(rnd.randint(3, 8))}</ul>", "".join(f'<a href="/{k}">{words(1, 2, "")}</a> ' for k in range(5))]), pick(["nav", "nav", "div", "ul"])
        elif kind == "header":
            inner, tag = f'<div class="logo">{words(1, 3, "")}</div>' + pick(["", f"<p>{words(2, 12)}</p>", f"<ul>{links(4)}</ul>"]), pick(["header", "header", "div"])
        else:
            inner, tag = prose_or_links(), {"footer": pick(["footer", "footer", "div"]), "side": pick(["aside", "aside", "div"])}.get(kind, pick(["div", "div", "section", "p"]))
            if tag == "p":
                inner = words(3, 40)
        plain = tag in ("nav", "header", "footer", "aside", "form")
        return f'<{tag} {attributes if not plain or maybe(0.5) else ""} data-main="0">{inner}</{tag}>'

    def date() -> str:
        return pick([f"{rnd.randint(1, 28)}.{rnd.randint(1, 12)}.20{rnd.randint(10, 29)}", f"20{rnd.randint(10, 29)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)} 1{rnd.randint(0, 9)}:{rnd.randint(10, 59)}", f"{rnd.randint(2, 20)} hours ago", f"{words(1, 1, '')} {rnd.randint(1, 28)}, 20{rnd.randint(10, 29)}"])

    def thread() -> str:
        """What readers say, without a name that tells."""
        tag, inner = pick([("div", "div"), ("section", "div"), ("ul", "li"), ("ol", "li"), ("div", "section"), ("section", "article")])
        shape = rnd.randint(0, 3)
        name = pick(["", "", f' class="{"".join(pick("abcdxyz") for _ in range(4))}"'])

        def one() -> str:
            said = f"<p>{words(3, 70)}</p>" + (f"<p>{words(3, 40)}</p>" if maybe(0.2) else "")
            reply = f'<a href="#">{words(1, 1, "")}</a>'
            return [f"<b>{words(1, 2, '')}</b> <span>{date()}</span>{said}{reply}", f"<div>{words(1, 2, '')} {date()}</div>{said}<div>{reply} {reply}</div>", f"<p><b>{words(1, 2, '')}</b>, {date()}</p>{said}", f"<h4>{words(1, 2, '')}</h4><time>{date()}</time><div>{words(3, 70)}</div>{reply}"][shape]

        entries = "".join(f"<{inner}{name}>{one()}{f'<{inner}{name}>{one()}</{inner}>' if maybe(0.1) and inner == 'div' else ''}</{inner}>" for _ in range(rnd.randint(2, 7)))
        return f'<{tag}{pick(["", f""" id="{words(1, 1, str())}" """])} data-main="0">{"" if maybe(0.6) else f"<h3>{words(1, 3, str())}</h3>"}{entries}</{tag}>'

    def bare() -> str:
        """A page that is only an article."""
        kind = rnd.randint(0, 8)
        p = lambda a=1, b=60: f"<p>{words(a, b, pick(['.', '.', '']))}</p>"
        inner = [lambda: p(), lambda: p() + p() + p(), lambda: words(1, 80, pick([".", ""])), lambda: f"<div>{words(1, 80, pick(['.', '']))}</div>", lambda: f"<div>{p()}{p()}</div>", lambda: f"<h1>{words(1, 8, '')}</h1>{p()}", body_blocks, lambda: f"<pre>{words(3, 60, '')}</pre>", lambda: "".join(f"<div>{words(3, 60)}</div>" for _ in range(rnd.randint(2, 5)))][kind]()
        if maybe(0.4):
            return f"<html data-main=1>{pick([inner, inner, words(2, 80, pick(['.', ''])), words(2, 30) + inner])}"
        title = f"<head data-main=0><title>{words(1, 6, '')}</title></head>" if maybe(0.6) else ""
        return f"<html data-main=0>{title}<body data-main=1>{inner}</body></html>"

    out = []
    for _ in range(n):
        if maybe(0.22):
            out.append(bare())
            continue
        few = 0.1 if maybe(0.25) else 1
        before = [junk(k) for k in ("header", "nav", "notice", "ad", "form") if maybe(few * {"nav": 0.8, "header": 0.5}.get(k, 0.35))]
        after = [junk(k) for k in ("ad", "comments", "side", "footer", "notice", "form") if maybe(few * {"footer": 0.8, "comments": 0.5}.get(k, 0.35))]
        rnd.shuffle(before)
        if maybe(0.35):
            after.insert(rnd.randint(0, min(1, len(after))), thread())
        main = article()
        if maybe(0.3):
            main = f'<div class="{pick(["wrapper", "container", "page", "row", "layout"])}">{main}{junk("side") if maybe(0.5) else ""}</div>'
        loose = not re.match(r"<[^>]*data-main", main)
        if loose and main.startswith("<div class"):
            main = main.replace(">", ' data-main="1">', 1)
            loose = False
        out.append(f"<html data-main=0><head><title>{words(2, 8, '')}</title></head><body{' data-main=1' if loose else ''}>{''.join(before)}{main}{''.join(after)}</body></html>")
    return out


#: Weights that train(labelled_pages()) has found.
WEIGHTS = Path(__file__).with_name("html_weights.json")


@lru_cache(maxsize=1)
def default_model() -> Model:
    if not WEIGHTS.exists():
        return train(labelled_pages())
    w = json.loads(WEIGHTS.read_text())
    return Model(np.array(w["unary"]), np.array(w["pair"]))


def texts(pages: list[str], model: Model) -> list[str]:
    """Main text of each page."""
    f = Forest(pages)
    keep = model.marginals(f) > 0.5
    return ["\n".join(line for node, line, _ in t.lines if keep[s + node]) for t, s in zip(f.trees, f.first, strict=False)]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html)."""
    prepare(pages.sparkSession)
    model = model or default_model()
    unary, pair = model.unary, model.pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(unary, pair)
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                out = texts([p or "" for p in part.column(2).to_pylist()], m)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.select("page_id", "url").dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


if __name__ == "__main__":
    fitted = train(labelled_pages())
    WEIGHTS.write_text(json.dumps({"unary": fitted.unary.round(4).tolist(), "pair": fitted.pair.round(4).tolist()}, indent=0) + "\n")
