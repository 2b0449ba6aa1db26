"""Main-text extraction from HTML with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the borders of block elements. Each block has features of its
ancestors (tags, roles, words of class and id) and of its text (length, links, punctuation). The field has two
labels, main text or not, weights for the features and for pairs of neighbouring labels, and is decoded by Viterbi.
It is trained on labelled pages, which `labelled_pages` lays out from a seed in many variants of the usual furniture.

Null and empty pages give an empty text. Scripts, styles, templates, comments, the head, what browsers show instead of scripts
and frames (noscript, iframe), drawings (svg) and the values of form controls (textarea, select) are no text; all other text,
that within object, video, audio and canvas included, is only left out by the field's verdict. None of these, no image, icon, input
or inline element, and no unknown element after text ends a block: only the elements in BLOCK do, and buttons and unknown
elements that begin one. Classes of the page itself, and of elements that hold most of its text, are features of
their own, so that a wrapper called has-sidebar does not take the article along.

Pages are read as browsers read them, in one pass over the characters: markup of any kind that is never closed reaches to the
end, a declaration that is none is a comment up to the next ">", and no page is an error. Work and memory grow with the page,
not with its depth. Unclosed and unmatched tags are taken roughly as browsers do: the head ends at the
first thing that it can't hold, svg and math at the first HTML element. Of an element that holds text only (title, noscript)
and is never closed, only the text up to the next block is left out. Formulas are text; their annotations are not. Character
references are decoded, white space becomes one space. Repeated rows are handled alike, and other columns are not read.
"""

import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm import words as W
from priceloom.llm.shared import table

# HTML elements by what they mean for the text.
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data datalist del desc dfn em font i iframe ins kbd label map mark metadata meter noembed noframes noscript object output picture progress q rp rt ruby s samp script select slot small span strike strong style sub sup svg template textarea time title tt u var video".split())
INLINE |= frozenset("math annotation annotation-xml maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
SILENT = frozenset("svg template noscript noframes noembed head title desc metadata annotation annotation-xml iframe textarea select datalist".split())
RAW = frozenset("script style".split())
#: What a head can hold; elements that hold text only; HTML that ends svg and math, but not within the parts that hold HTML.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
TEXT_ONLY = frozenset("title textarea noscript noframes iframe".split())
FOREIGN = frozenset("svg math".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_SELECT = frozenset("input keygen select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# Parts of class names and ids that tell what an element is for.
STEMS = (
    "ad", "advert", "alert", "article", "author", "banner", "body", "breadcrumb", "byline", "comment", "consent", "content", "cookie", "copyright", "disqus",
    "entry", "footer", "form", "gdpr", "head", "login", "main", "masthead", "menu", "modal", "nav", "newsletter", "notice", "outbrain", "page", "pager",
    "pagination", "popup", "post", "promo", "recommend", "related", "reply", "respond", "search", "share", "sidebar", "signup", "social", "sponsor", "story",
    "subscribe", "tag", "text", "toolbar", "topbar", "warning", "widget",
)
SHORT = frozenset(s for s in STEMS if len(s) <= 4)
WIDE = 0.5


# White space, names and values in tags.
SPACE, SLASHES, NAME = re.compile(r"[\t\n\f\r ]*"), re.compile(r"[\t\n\f\r /]*"), re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
KEY, VALUE = re.compile(r"=?[^\t\n\f\r />=]*"), re.compile(r"[^\t\n\f\r >]*")
COMMENT_END = re.compile("--!?>")


@lru_cache(20)
def end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I)


def tag_at(html: str, at: int) -> tuple[str, list[tuple[str, str | None]], int]:
    """Name and attributes of the tag whose name begins there, and where it ends; -1 if it never does."""
    name = NAME.match(html, at)
    at, size, attributes = name.end(), len(html), []
    while True:
        at = SLASHES.match(html, at).end()
        if at >= size:
            return name.group().lower(), attributes, -1
        if html[at] == ">":
            return name.group().lower(), attributes, at + 1
        key = KEY.match(html, at)
        at, value = SPACE.match(html, key.end()).end(), None
        if html.startswith("=", at):
            at = SPACE.match(html, at + 1).end()
            quote = html[at : at + 1]
            if quote in ('"', "'"):
                end = html.find(quote, at + 1)
                if end < 0:
                    return name.group().lower(), attributes, -1
                value, at = html[at + 1 : end], end + 1
            else:
                found = VALUE.match(html, at)
                value, at = found.group(), found.end()
        attributes.append((key.group().lower(), unescape(value) if value else value))


class Blocks:
    """The leaf blocks of a page: text, characters within links, and the innermost block element that holds it.

    Elements are numbered as they begin; `nodes` has of each the number of its parent (-1: none), tag and marks. Work and
    memory grow with the page, however deep it is: open elements are found by their tag, not by going up.
    """

    def __init__(self):
        self.nodes: list[tuple[int, str, str]] = []
        self.stack: list[tuple[str, int]] = []  # tag and innermost block element
        self.places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is
        self.blocks: list[int] = []  # where in the stack the block elements are
        self.silent = self.links = self.linked = self.unended = 0
        self.begun = False  # whether the body has begun
        self.ends: dict[str, int] = {}
        self.parts: list[str] = []
        self.found: list[tuple[str, int, int]] = []

    @property
    def node(self) -> int:
        return self.stack[-1][1] if self.stack else -1

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((text, self.linked, self.node))
        self.parts, self.linked = [], 0

    def _next_end(self, html: str, tag: str, at: int) -> int:
        """Where the next end tag of that name begins, from there on; -1 if there is none."""
        if -1 < self.ends.get(tag, 0) <= at:
            found = end_tag(tag).search(html, at)
            self.ends[tag] = found.start() if found else -1
        return self.ends[tag]

    def _begin(self):
        """The body begins at the first thing that a head can't hold, whether or not the head was closed."""
        if not self.places["template"]:
            self.begun = True
            self._end(("head",))

    def _leave(self):
        """End svg and math, unless a part of them that holds HTML lies between."""
        after = max((self.places[t][-1] for t in HOLDS_HTML if self.places[t]), default=-1)
        inner = [own[k] for own in (self.places[t] for t in FOREIGN) if (k := bisect_right(own, after)) < len(own)]
        if inner:
            self._cut(min(inner))

    def _end(self, tags):
        """End the outermost open element of those tags."""
        first = min((self.places[t][0] for t in tags if self.places[t]), default=None)
        if first is not None:
            self._cut(first)

    def _starts(self, html: str, tag: str, attrs: list, at: int) -> int:
        """Take a start tag that ends at `at`; where to read on."""
        if tag == "head" and self.begun:
            return at
        if tag in ENDS_FOREIGN and (self.places["svg"] or self.places["math"]):
            self._leave()
        if self.unended and tag in BLOCK:
            self._end(TEXT_ONLY)
        if not self.begun and tag not in IN_HEAD:
            self._begin()
        if self.silent and tag in ENDS_SELECT:
            self._end(("select",))
        if tag in RAW or tag in TEXT_ONLY:
            end = self._next_end(html, tag, at)
            if end >= 0 or tag in RAW:
                return end if end >= 0 else len(html)
        if tag == "br":
            self.parts.append(" ")
        if tag == "hr" and not self.silent:
            self.flush()
        if tag in VOID:
            return at
        # Buttons and unknown elements are blocks where no text comes before them, else part of it.
        block = tag in BLOCK or (tag not in INLINE and not any(map(str.strip, self.parts)))
        if block:
            if not self.silent:
                self.flush()
                if tag in ENDS_P:
                    self._close({"p"}, 1)
                if tag in CLOSED_BY:
                    self._close(CLOSED_BY[tag], 3)
            marks = [v for k, v in attrs if v and k in ("class", "id", "role")]
            hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and "none" in (v or "")) for k, v in attrs)
            self.nodes.append((self.node, tag, " ".join([*marks, *["~hidden"] * hidden])))
            self.blocks.append(len(self.stack))
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, len(self.nodes) - 1 if block else self.node))
        self.silent += tag in SILENT
        self.unended += tag in TEXT_ONLY
        self.links += tag == "a"
        return at

    def _close(self, tags: set[str], most: int):
        """Close the innermost block element if it has one of those tags, `most` times."""
        while most and self.blocks and self.stack[self.blocks[-1]][0] in tags:
            self._cut(self.blocks[-1])
            most -= 1

    def _cut(self, k: int):
        for tag, _ in self.stack[k:]:
            self.places[tag].pop()
            self.silent -= tag in SILENT
            self.unended -= tag in TEXT_ONLY
            self.links -= tag == "a"
        del self.stack[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def _stops(self, tag: str):
        if tag == "br":
            self.parts.append(" ")
        if not self.places[tag]:
            if tag == "p" and not self.silent:
                self.flush()
            return
        k = self.places[tag][-1]
        at = bisect_left(self.blocks, k)
        if at < len(self.blocks) and not self.silent:  # a block element ends
            self.flush()
        self._cut(k)

    def _text(self, data: str):
        if not self.begun and data.strip() and (not self.stack or self.stack[-1][0] in ("html", "head")):
            self._begin()
        if not self.silent:
            data = unescape(data)
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def read(self, html: str) -> "Blocks":
        at, size = 0, len(html)
        while at < size:
            tag = html.find("<", at)
            if tag != at:
                self._text(html[at : tag if tag >= 0 else size])
                at = tag if tag >= 0 else size
                continue
            after = html[at + 1 : at + 2]
            if after.isalpha() and after.isascii():
                name, attrs, end = tag_at(html, at + 1)
                at = size if end < 0 else self._starts(html, name, attrs, end)
            elif after == "/" and html[at + 2 : at + 3].isalpha() and html[at + 2 : at + 3].isascii():
                name, _, end = tag_at(html, at + 2)
                at = size if end < 0 else end
                if end >= 0:
                    self._stops(name)
            elif html.startswith("<![CDATA[", at) and (self.places["svg"] or self.places["math"]):
                end = html.find("]]>", at)
                self._text(html[at + 9 : end if end >= 0 else size].replace("&", "&amp;"))
                at = end + 3 if end >= 0 else size
            elif html.startswith("<!--", at):
                shut = 5 if html.startswith("<!-->", at) else 6 if html.startswith("<!--->", at) else 0
                found = None if shut else COMMENT_END.search(html, at + 4)
                at = at + shut if shut else found.end() if found else size
            elif after in ("!", "?") or (after == "/" and at + 2 < size):
                end = html.find(">", at)
                at = end + 1 if end >= 0 else size
            else:
                self._text("<")
                at += 1
        self.flush()
        return self

    def wide(self) -> list[bool]:
        """Whether each element holds at least WIDE of the page's text: what wraps a page is seldom a part of its furniture."""
        sizes = [0] * len(self.nodes)
        for text, _, node in self.found:
            if node >= 0:
                sizes[node] += len(text)
        for k in range(len(sizes) - 1, 0, -1):
            if self.nodes[k][0] >= 0:
                sizes[self.nodes[k][0]] += sizes[k]
        total = sum(len(f[0]) for f in self.found)
        return [size >= WIDE * total for size in sizes]


@lru_cache(20_000)
def node_features(tag: str, marks: str, wide: bool) -> tuple[str, ...]:
    """Features of an ancestor. Those of the page itself, and of elements that hold most of it, are features of their own."""
    kind = "page" if tag in ("html", "body") else "wide" if wide else "in"
    out = {f"{kind}:{tag}"}
    for word in marks.lower().replace("-", " ").replace("_", " ").replace("/", " ").split():
        out.add(f"{kind}-w:{word}")
        out.update(f"{kind}-s:{s}" for s in STEMS if (word in (s, s + "s") if s in SHORT else s in word))
    return tuple(sorted(out))


def path_features(page: Blocks, wide: list[bool], node: int) -> list[str]:
    """The distinct features of an element and its ancestors."""
    out, leaf = set(), f"leaf:{page.nodes[node][1]}" if node >= 0 else "leaf:"
    while node >= 0:
        parent, tag, marks = page.nodes[node]
        out.update(node_features(tag, marks, wide[node]))
        node = parent
    return sorted(out | {leaf})


def text_features(text: str, linked: int) -> list[str]:
    size, n_words = len(text), text.count(" ") + 1
    return [
        "bias",
        f"words:{min(6, n_words.bit_length())}",
        f"links:{min(4, 4 * linked // size)}",
        f"end:{text[-1] in '.!?…。'}",
        f"rights:{'©' in text or 'ights reserved' in text}",
        f"bars:{text.count('|') + text.count('»') > 1}",
    ]


class Field:
    """Weights: of each feature for the label 1 against 0, and of each pair of neighbouring labels."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def scores(self, page: Blocks) -> list[float]:
        """Of each block, the weight of label 1. Elements are entered and left once, with a count of each of their features."""
        weights, wide, nodes = self.weights, page.wide(), page.nodes
        path, on, above, out = [-1], {-1}, 0.0, []
        active: dict[str, int] = defaultdict(int)
        for text, linked, node in page.found:
            fresh, at = [], node
            while at not in on:
                fresh.append(at)
                at = nodes[at][0]
            while path[-1] != at:
                k = path.pop()
                on.remove(k)
                for f in node_features(*nodes[k][1:], wide[k]):
                    active[f] -= 1
                    above -= 0.0 if active[f] else weights.get(f, 0.0)
            for k in reversed(fresh):
                path.append(k)
                on.add(k)
                for f in node_features(*nodes[k][1:], wide[k]):
                    above += 0.0 if active[f] else weights.get(f, 0.0)
                    active[f] += 1
            leaf = f"leaf:{nodes[node][1]}" if node >= 0 else "leaf:"
            out.append(above + weights.get(leaf, 0.0) + sum(weights.get(f, 0.0) for f in text_features(text, linked)))
        return out

    def decode(self, page: Blocks) -> list[int]:
        """Viterbi."""
        pairs, best, back = self.pairs.tolist(), [0.0, 0.0], []
        for k, score in enumerate(self.scores(page)):
            own = (0.0, score)
            if not k:
                best = list(own)
                continue
            came = [max((0, 1), key=lambda a, b=b: best[a] + pairs[a][b]) for b in (0, 1)]
            best = [best[came[b]] + pairs[came[b]][b] + own[b] for b in (0, 1)]
            back.append(came)
        labels = [int(best[1] > best[0])] if page.found else []
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]


class Labelled:
    """Blocks of labelled pages as arrays: which block has which feature, its label, and where it is on its page."""

    def __init__(self, pages: list[tuple[str, list[str]]]):
        self.names: dict[str, int] = {}
        rows, cols, labels, sizes = [], [], [], []
        for html, main in pages:
            page, left = Blocks().read(html), list(main)
            wide = page.wide()
            sizes.append(len(page.found))
            for text, linked, node in page.found:
                is_main = bool(left) and left[0] == text
                labels.append(int(is_main))
                if is_main:
                    left.pop(0)
                for f in [*path_features(page, wide, node), *text_features(text, linked)]:
                    rows.append(len(labels) - 1)
                    cols.append(self.names.setdefault(f, len(self.names)))
            if left:
                raise ValueError(f"a labelled block isn't on its page: {left[0][:80]}")
        self.rows, self.cols, self.labels = np.array(rows), np.array(cols), np.array(labels)
        self.mask = np.arange(max(sizes))[None, :] < np.array(sizes)[:, None]
        gold = np.zeros(self.mask.shape, int)
        gold[self.mask] = self.labels
        self.both = self.mask[:, 1:]
        self.gold_pairs = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & self.both).sum() for b in (0, 1)] for a in (0, 1)], float)

    def objective(self, weights: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
        """Mean log likelihood of a page's labels less the decay of the weights, and its slope. Sums over all labelings by forward and backward passes."""
        emit = np.zeros((*self.mask.shape, 2))
        emit[self.mask, 1] = np.bincount(self.rows, weights[self.cols], len(self.labels))
        pairs, most = weights[-4:].reshape(2, 2), self.mask.shape[1]
        total = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, most):
            ahead[:, t] = np.where(self.mask[:, t, None], total(ahead[:, t - 1, :, None] + pairs, 1) + emit[:, t], ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            behind[:, t] = np.where(self.mask[:, t + 1, None], total(pairs + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0.0)
        whole = total(ahead[:, -1], 1)
        share = np.exp(ahead + behind - whole[:, None, None])[self.mask][:, 1]
        joint = np.exp(ahead[:, :-1, :, None] + pairs + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        slope = np.append(np.bincount(self.cols, (self.labels - share)[self.rows], len(self.names)), (self.gold_pairs - (joint * self.both[:, :, None, None]).sum((0, 1))).ravel())
        gold = emit[self.mask][:, 1] @ self.labels + (self.gold_pairs * pairs).sum()
        return (gold - whole.sum()) / len(self.mask) - decay / 2 * weights @ weights, slope / len(self.mask) - decay * weights


def train(pages: list[tuple[str, list[str]]], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent with Adam. pages: html and the texts of the main blocks, in order."""
    data = Labelled(pages)
    weights = np.zeros(len(data.names) + 4)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        _, slope = data.objective(weights, decay)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(weights[k]) for f, k in data.names.items()}, weights[-4:].reshape(2, 2).copy())


# How page furniture is marked up; {} takes its blocks.
FURNITURE = {
    "menu": ("<nav>{}</nav>", '<nav class="menu">{}</nav>', '<div class="navbar">{}</div>', '<div id="navigation">{}</div>', '<div class="breadcrumbs">{}</div>', '<div role="navigation">{}</div>', '<ul class="menu">{}</ul>', '<div class="main-menu">{}</div>', '<div class="pagination">{}</div>'),
    "header": ("<header>{}</header>", '<header class="site-header">{}</header>', '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div class="topbar">{}</div>', '<div role="banner">{}</div>', '<div class="page-header">{}</div>'),
    "footer": ("<footer>{}</footer>", '<footer class="site-footer">{}</footer>', '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<div class="copyright">{}</div>', '<div role="contentinfo">{}</div>'),
    "side": ("<aside>{}</aside>", '<aside class="sidebar">{}</aside>', '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<div class="widget">{}</div>', '<div class="related-posts">{}</div>', '<section class="recommended">{}</section>', '<div class="social-share">{}</div>', '<div class="tags">{}</div>'),
    "notice": ('<div class="cookie-notice">{}</div>', '<div class="notice">{}</div>', '<div id="consent">{}</div>', '<div class="alert" role="alert">{}</div>', '<div class="gdpr-banner">{}</div>', '<div class="popup modal">{}</div>', '<div class="warning">{}</div>', '<div role="dialog">{}</div>', '<section class="cookies">{}</section>'),
    "advert": ('<div class="ad">{}</div>', '<div class="ads">{}</div>', '<div class="advert">{}</div>', '<div class="advertisement">{}</div>', '<div class="sponsored">{}</div>', '<div class="promo">{}</div>', '<div id="ad-slot">{}</div>', '<section class="banner-ad">{}</section>', '<aside class="ad">{}</aside>'),
    "form": ("<form>{}</form>", '<form class="search">{}</form>', '<div class="newsletter-signup">{}</div>', '<div class="subscribe">{}</div>', '<form id="login">{}</form>', '<div class="search-form">{}</div>', "<fieldset>{}</fieldset>"),
    "comments": ('<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comment-list">{}</div>', '<ol class="commentlist">{}</ol>', '<div class="comments-area">{}</div>', '<div id="disqus">{}</div>', '<div class="reader-comments">{}</div>', '<div class="reply comment">{}</div>'),
}
ARTICLE = ("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="post">{}</div>', '<div class="entry-content">{}</div>', '<div class="article-body">{}</div>', '<div id="main"><div class="story">{}</div></div>', '<section class="text">{}</section>', '<article class="post"><div class="body">{}</div></article>', "{}", "<div>{}</div>", '<section class="news-item">{}</section>', "<section>{}</section>", '<section class="node">{}</section>', '<div class="row"><div class="col-8">{}</div></div>', '<div class="block panel">{}</div>', '<table><tr><td class="cell">{}</td></tr></table>', '<div class="post has-sidebar">{}</div>')
# Classes of the page and wrappers of all that is on it; they tell nothing of what is within.
BODY = ("", "", "", "has-sidebar", "no-sidebar", "with-ads", "header-fixed", "logged-in comments-open", "single single-post", "search-on", "menu-open", "cookies-accepted", "home page", "footer-wide newsletter-on")
AROUND = ("{}", "{}", "{}", '<div class="wrapper">{}</div>', '<form id="form1" method="post">{}</form>', '<div class="site has-sidebar">{}</div>', '<div id="page">{}</div>', '<div class="layout sidebar-right"><div class="inner">{}</div></div>', '<section class="container">{}</section>', '<div class="header-fixed with-ads">{}</div>', "<table><tr><td>{}</td></tr></table>")


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages with invented words, and the texts of their main blocks. Words and lengths tell nothing by themselves:
    furniture may hold whole paragraphs, and the article short lines; adverts, notices and forms stand in articles too."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v w".split() for b in "a e i o u an er in".split()]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 2, 2, 3))))

    noisy = [False]

    def line(low, high, end=".") -> str:
        noise = ("", *rng.sample(("***", "###", "|", "$$$", "%%%", "!", "»"), 3)) if noisy[0] else ("",)
        return " ".join(word() + rng.choice(noise) for _ in range(rng.randint(low, high))).capitalize() + (end if rng.random() < 0.85 else rng.choice(noise))

    def listed(items, link=True):
        return "<ul>" + "".join(f"<li><a href='/x'>{x}</a></li>" if link else f"<li>{x}</li>" for x in items) + "</ul>"

    def furniture(kind: str) -> str:
        if kind == "menu":
            inner = rng.choice((listed([word() for _ in range(rng.randint(2, 8))]), " | ".join(f"<a href='#'>{word()}</a>" for _ in range(4))))
        elif kind == "header":
            inner = rng.choice((f"<h1>{line(1, 4, '')}</h1>", f"<p>{line(2, 9)}</p>", f"<a href='/'>{word()}</a><p>{line(1, 8, '')}</p>", listed([word() for _ in range(4)])))
        elif kind == "footer":
            inner = rng.choice((f"&copy; {word()}.example &middot; {line(3, 14)}", f"<p>{line(4, 20)}</p>", listed([word() for _ in range(4)]) + f"<p>&copy; {word()}</p>"))
        elif kind == "side":
            inner = f"<h3>{line(1, 3, '')}</h3>" * rng.randint(0, 1) + rng.choice((listed([line(2, 8, "") for _ in range(rng.randint(2, 5))]), f"<p>{line(5, 40)}</p>", line(4, 15)))
        elif kind == "form":
            inner = rng.choice((f"<label>{word()}</label><input name='q'><button>{word()}</button>", f"<p>{line(4, 18)}</p><input><button>{word()}</button>", f"<p>{line(3, 9)}</p>"))
        elif kind == "comments":
            inner = f"<h3>{line(1, 3, '')}</h3>" * rng.randint(0, 1) + "".join(rng.choice(("<div class='comment'><p>{}</p></div>", "<li>{}</li>", "<p>{}</p>", "<article><p>{}</p></article>")).format(line(3, 50)) for _ in range(rng.randint(1, 4)))
        else:
            inner = rng.choice((line(3, 25), f"<p>{line(3, 30)}</p>", f"<p>{line(3, 10)}</p><a href='/y'>{word()}</a>"))
        return rng.choice(FURNITURE[kind]).format(inner)

    pages = []
    for _ in range(n):
        main, body = [], []
        noisy[0] = rng.random() < 0.15

        def keep(text: str, main=main) -> str:
            main.append(" ".join(text.split()))
            return text

        if rng.random() < 0.8:
            body.append(f"<h1>{keep(line(1, 9, rng.choice(('', '.'))))}</h1>")
        for _ in range(rng.choice((1, 2, 3, 5, 8))):
            kind = rng.random()
            if kind < 0.66:
                inner = line(1, 90)
                body.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>")).format(keep(inner)))
            elif kind < 0.74:
                body.append(f"<h2>{keep(line(1, 6, ''))}</h2>")
            elif kind < 0.8:
                body.append("<ul>" + "".join(f"<li>{keep(line(1, 15))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.85:
                body.append(f"<blockquote>{keep(line(4, 40))}</blockquote>")
            else:
                body.append(furniture(rng.choice(("advert", "notice", "form", "side", "advert"))))
        article = rng.choice(ARTICLE).format("".join(body) + (furniture("comments") if rng.random() < 0.1 else ""))
        some = lambda kinds, p: "".join(furniture(k) for k in kinds if rng.random() < p)
        before, after = some(("header", "menu", "notice", "advert", "side", "form"), rng.choice((0, 0.3, 0.5))), some(("comments", "side", "advert", "form", "menu", "footer"), 0.45)
        if rng.random() < 0.08:
            before, article = "", f'<table><tr><td class="menu">{before}</td><td>{article}</td></tr></table>'
        around, classes = rng.choice(AROUND), rng.choice(BODY)
        body_tag = f'<body class="{classes}">' if classes else "<body>"
        pages.append((f"<html><head><title>{word()}</title></head>{body_tag}{around.format(before + article + after)}</body></html>", main))
    return pages


TRAINING_PAGES = 800


@lru_cache(1)
def field() -> Field:
    return train(labelled_pages(TRAINING_PAGES))


def main_text(html: str | None, by: Field) -> str:
    page = Blocks().read(html or "")
    return "\n\n".join(b[0] for b, keep in zip(page.found, by.decode(page), strict=True) if keep)


def extract(pages: DataFrame, by: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages."""
    by = by or field()

    def read(batches):
        for batch in W.pieces(batches, ("html",)):
            texts = [main_text(h, by) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    rows = pages.select("page_id", "url", "html").mapInArrow(read, f"{kinds}, text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
