"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded as a hierarchy.

A tolerant scanner turns a page into its block elements.  Each block is described by the density of its subtree
(text, tags, links), the tokens of its class, id and role, its depth, and how it compares with its siblings, and
boosted trees give the odds that it holds article text.  Decoding picks the set of blocks with the best
total odds in which no block stays without its parent, so a dropped comment section takes its prose with it.

The trees are fitted on a bounded sample of the pages themselves that mark their article.  Each of them is also set
anew in other page designs made of its own and the sample's texts, where the article is known but not marked;
so the trees learn densities, positions and names and not just one tag.
"""
from __future__ import annotations

import heapq
import re
import zlib
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.llm.common import as_texts, map_batches, read
from ledgerscope.llm.hashed import first_by_hash
from ledgerscope.session import materialize

# fixed values: element names of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("head template svg math select option datalist object canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
TAGS = ("html body div section article main header footer nav aside form ul ol li p h1 h2 h3 blockquote pre table tr td dl "
        "figure figcaption button details").split()

MEANING = ("article", "main", "nav", "header", "footer", "aside", "form")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
TOKEN_BUCKETS = 48


class Page:
    """The block elements of a page in page order and the text between their borders."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs, self.depth = ["html"], [-1], [""], [0]
        self.pieces: list[tuple[int, str]] = []  # (block, text); an empty text is a border inside a block
        self.link_chars, self.tags = [0], [0]
        stack, names, hidden, links = [("html", 0)], {"html": 1}, 0, 0

        def leave():
            nonlocal hidden, links
            name, _ = stack.pop()
            names[name] -= 1
            hidden -= name in HIDDEN
            links -= name == "a"
            if name not in INLINE:
                self.pieces.append((stack[-1][1], ""))

        def close(name, barrier=()):
            """Leave elements up to the nearest ``name`` that no barrier hides."""
            if names.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        while len(stack) > k:
                            leave()
                        return
                    if stack[k][0] in barrier:
                        return

        def text(a, b):
            if a < b and not hidden:
                said = html[a:b]
                said = unescape(said) if "&" in said else said
                block = stack[-1][1]
                self.pieces.append((block, said))
                if links:
                    self.link_chars[block] += len(said.strip())

        at = 0
        for m in _TAG.finditer(html, 0, html.rfind(">") + 1):
            if m.start() < at:
                continue  # inside a raw element
            text(at, m.start())
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                close(name)
                continue
            if name in CLOSES_P:
                close("p", ("button", "object"))
            if name == "li":
                close("li", ("ul", "ol", "menu"))
            elif name in ("dd", "dt"):
                close("dd", ("dl",))
                close("dt", ("dl",))
            elif name in ("tr", "td", "th"):
                for other in ("td", "th", "tr")[:2 + (name == "tr")]:
                    close(other, ("table",))
            block = stack[-1][1]
            self.tags[block] += 1
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(html, at)
                at = end.start() if end else len(html)
                continue
            if name in VOID:
                if name not in INLINE:
                    self.pieces.append((block, ""))
                continue
            if name not in INLINE:
                self.pieces.append((block, ""))
                self.tag.append(name)
                self.parent.append(block)
                self.attrs.append(" ".join("".join(x) for x in _ATTR.findall(m[3])).lower() if m[3] else "")
                self.depth.append(self.depth[block] + 1)
                self.link_chars.append(0)
                self.tags.append(0)
                block = len(self.tag) - 1
            stack.append((name, block))
            names[name] = names.get(name, 0) + 1
            hidden += name in HIDDEN
            links += name == "a"
        text(at, len(html))

    def text(self, kept) -> str:
        """The text of the kept blocks; every border of a block is white space."""
        return " ".join("".join([t if t and kept[b] else " " for b, t in self.pieces]).split())

    def own_chars(self) -> np.ndarray:
        out = np.zeros(len(self.tag))
        for b, t in self.pieces:
            out[b] += len(t) - t.count(" ") if t else 0
        return out


def up_sums(values: np.ndarray, parent: list[int]) -> np.ndarray:
    """Sums over subtrees; parents come before their children."""
    out = values.tolist()
    for k in range(len(parent) - 1, 0, -1):
        out[parent[k]] += out[k]
    return np.array(out)


def features(page: Page) -> np.ndarray:
    n, parent = len(page.tag), np.array(page.parent)
    own, p = page.own_chars(), page.parent
    stops = np.zeros(n)
    for b, t in page.pieces:
        if t:
            stops[b] += t.count(".") + t.count(",")
    all_text, links, tags = up_sums(own, p), up_sums(np.array(page.link_chars, float), p), up_sums(np.array(page.tags, float), p)
    blocks, all_stops = up_sums((own > 0).astype(float), p), up_sums(stops, p)
    total = max(1.0, all_text[0])
    up = np.maximum(parent, 0)
    kids = np.bincount(parent[1:], minlength=n)
    nth = np.zeros(n)
    seen: dict[int, int] = {}
    like: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        nth[k] = seen[p[k]] = seen.get(p[k], -1) + 1
        like[p[k], page.tag[k]] = like.get((p[k], page.tag[k]), 0) + 1
    same = np.array([like.get((a, t), 1) for a, t in zip(p, page.tag)], float)
    siblings = np.maximum(1, kids[up])
    before = np.r_[0.0, np.cumsum(own)[:-1]]
    cols = [np.array(page.depth), np.log1p(all_text), np.log1p(own), links / np.maximum(1, all_text), all_text / (tags + 1), np.log1p(tags),
            all_text / total, before / total, (before + all_text) / total, kids, nth, nth / siblings, same / siblings,
            np.log1p(all_text[up] / siblings), all_text / np.maximum(1, all_text[up]), all_stops / np.maximum(1, all_text), all_text / np.maximum(1, blocks),
            np.log1p(blocks)]
    # where a block stands to the elements whose names carry a meaning: 1 inside or equal, -1 around, 0 neither
    for name in MEANING:
        inside, mine = np.zeros(n), np.array([t == name for t in page.tag])
        for k in range(n):
            inside[k] = mine[k] or k and inside[p[k]]
        cols += [np.where(inside > 0, 1, np.where(up_sums(mine.astype(float), p) > 0, -1, 0)), np.full(n, float(mine.any()))]
    x = np.zeros((n, len(cols) + len(TAGS) + 1 + 2 * TOKEN_BUCKETS), np.float32)
    x[:, :len(cols)] = np.stack(cols, axis=1)
    place = {t: len(cols) + k for k, t in enumerate(TAGS)}
    first = len(cols) + len(TAGS) + 1
    for k in range(n):
        x[k, place.get(page.tag[k], first - 1)] = 1
        if k and p[k] >= 0:
            x[k, first + TOKEN_BUCKETS:] = np.maximum(x[p[k], first + TOKEN_BUCKETS:], x[p[k], first:first + TOKEN_BUCKETS])
        for token in _TOKEN.findall(page.attrs[k]):
            x[k, first + zlib.crc32(token.encode()) % TOKEN_BUCKETS] = 1
    return x


class Trees:
    """Gradient-boosted regression trees for the logistic loss, grown level by level on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, l2: float = 1.0, share: float = 0.4):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.share = rounds, depth, rate, bins, l2, share
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Trees":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        used = [f for f, e in enumerate(edges) if len(e)]
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score, rng = np.full(len(y), self.base), np.random.default_rng(11)
        rare = 0.001 * len(y)
        used = [f for f in used if min((binned[:, f] > 0).sum(), (binned[:, f] == 0).sum()) > rare or len(edges[f]) > 1]
        whole = binned
        for _ in range(self.rounds):  # each tree sees a random share of the rows
            some = np.flatnonzero(rng.random(len(y)) < self.share)
            binned = np.ascontiguousarray(whole[some].T)
            p = 1 / (1 + np.exp(-score[some]))
            g, h = weight[some] * (p - y[some]), weight[some] * p * (1 - p)
            n_nodes = 2 ** self.depth - 1
            feature, cut = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.inf, np.float32)
            at = np.zeros(len(some), np.int64)
            for level in range(self.depth):
                first, width = 2 ** level - 1, 2 ** level
                best = np.full(width, 1e-6)
                where = at - first
                gt, ht = np.bincount(where, g, width), np.bincount(where, h, width)
                pick, split = np.zeros(width, np.int64), np.full(width, self.bins)
                for f in used:
                    key = where * self.bins + binned[f]
                    gl = np.bincount(key, g, width * self.bins).reshape(width, -1).cumsum(1)
                    hl = np.bincount(key, h, width * self.bins).reshape(width, -1).cumsum(1)
                    gain = gl ** 2 / (hl + self.l2) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + self.l2) - (gt ** 2 / (ht + self.l2))[:, None]
                    gain = gain[:, :len(edges[f])]
                    b = gain.argmax(1)
                    better = gain[np.arange(width), b] > best
                    best = np.where(better, gain[np.arange(width), b], best)
                    pick, split = np.where(better, f, pick), np.where(better, b, split)
                for k in range(width):
                    if split[k] < self.bins:
                        feature[first + k], cut[first + k] = pick[k], edges[pick[k]][split[k]]
                at = 2 * at + 1 + (binned[pick[where], np.arange(len(some))] > split[where])
            leaf = at - n_nodes
            gl, hl = np.bincount(leaf, g, n_nodes + 1), np.bincount(leaf, h, n_nodes + 1)
            value = -self.rate * gl / (hl + self.l2)
            self.trees.append((feature, cut, value))
            score += self._leaf_values(x, self.trees[-1])
        return self

    def _leaf_values(self, x: np.ndarray, tree) -> np.ndarray:
        (feature, cut, value), at, rows = tree, np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        return value[at - len(feature)]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._leaf_values(x, tree) for tree in self.trees)


def decode(odds: np.ndarray, parent: list[int], own: np.ndarray) -> list[bool]:
    """The best set of blocks in which every block's parent is kept; the root always is.

    A block's odds weigh as much as the text blocks below it, for they are a statement on all of those.
    """
    n = len(parent)
    below = up_sums((own > 0).astype(float), parent) - (own > 0)
    gain = (np.clip(odds, -4, 4) * (1 + below)).tolist()
    for k in range(n - 1, 0, -1):
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    kept = [True] * n
    for k in range(1, n):
        kept[k] = gain[k] > 0 and kept[parent[k]]
    return kept


def article_labels(page: Page) -> np.ndarray | None:
    """1 for blocks with text of the marked article in or below them; None if the page marks none."""
    inside = [False] * len(page.tag)
    for k in range(1, len(page.tag)):
        inside[k] = inside[page.parent[k]] or page.tag[k] == "article" or "articlebody" in page.attrs[k] or page.attrs[k] == "article"
    if not any(inside):
        return None
    return (up_sums(np.array(inside) * page.own_chars(), page.parent) > 0).astype(float)


# fixed values: names that page designs give to their parts
_CONTENT = ("content", "main-content", "post", "post-body", "entry-content", "story", "text", "article-body", "article", "")
_PARTS = {
    "nav": ("nav", "menu", "navbar", "breadcrumbs", "topnav", "navigation"), "header": ("header", "masthead", "site-header", "top", "branding"),
    "aside": ("sidebar", "widget", "related", "aside", "popular", "trending", "right-column"), "notice": ("notice", "cookie", "banner", "consent", "alert", "popup", "message"),
    "ad": ("ad", "ads", "advert", "sponsored", "promo", "adsense"), "form": ("newsletter", "search", "signup", "subscribe", "login", "contact"),
    "comments": ("comments", "comment-list", "discussion", "replies", "responses", "reader-comments"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "legal")}


def redesign(rng: np.random.Generator, paragraphs: list[str], other: list[str]) -> str:
    """A page of another design around the paragraphs, which stand in an element marked ``data-truth``."""
    say = lambda low, high: escape(" ".join(other[int(rng.integers(0, len(other)))].split()[:int(rng.integers(low, high))]))
    one = lambda names: names[int(rng.integers(0, len(names)))]

    def element(kind, inner, tags):
        tag, name = one(tags), one(_PARTS[kind])
        named = "" if tag not in ("div", "section", "p") and rng.random() < 0.5 else f' {one(("class", "id"))}="{name}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    links = lambda n: "<ul>" + "".join(f'<li><a href="#">{say(1, 5)}</a></li>' for _ in range(n)) + "</ul>"
    wrap = lambda t: one((f"<p>{t}</p>", f"<div>{t}</div>", t))
    parts = {
        "nav": lambda: element("nav", links(int(rng.integers(3, 9))), ("nav", "div")),
        "header": lambda: element("header", f"<h1>{say(1, 4)}</h1>" * int(rng.random() < .5) + wrap(say(2, 9)) + links(int(rng.integers(0, 5))), ("header", "div")),
        "aside": lambda: element("aside", f"<h3>{say(1, 4)}</h3>" + one((links(int(rng.integers(2, 8))), f"<p>{say(5, 60)}</p>", f"<p>{say(4, 20)}</p>" + links(3))), ("aside", "div", "section")),
        "notice": lambda: element("notice", wrap(say(5, 40)) + one(("", "<button>OK</button>")), ("div", "section", "p")),
        "ad": lambda: element("ad", wrap(say(3, 30)), ("div", "aside", "section")),
        "form": lambda: element("form", f"<form><label>{say(1, 6)}</label><input name=q><button>{say(1, 3)}</button>" + one(("", f"<p>{say(4, 20)}</p>")) + "</form>", ("div", "section")),
        "comments": lambda: element("comments", f"<h3>{say(1, 4)}</h3>" + "".join(one((f'<div class="comment"><b>{say(1, 3)}</b><p>{say(5, 80)}</p></div>', f"<li><p>{say(5, 80)}</p></li>", f"<p>{say(5, 60)}</p>"))
                                                                   for _ in range(int(rng.integers(1, 7)))), ("div", "section", "ul")),
        "footer": lambda: element("footer", one((f"&copy; {say(2, 14)}", f"<p>{say(3, 25)}</p>")) + one(("", links(3))), ("footer", "div"))}
    draw = lambda kinds, most: [parts[one(kinds)]() for _ in range(int(rng.integers(0, most)))]
    body = [f"<h1>{escape(paragraphs[0])[:80]}</h1>"] * int(rng.random() < .4) + [f"<p>{escape(t)}</p>" for t in paragraphs]
    if rng.random() < 0.35:
        body.insert(int(rng.integers(1, len(body) + 1)), parts[one(("ad", "notice", "aside", "form"))]())
    tag, name = one(("div", "div", "main", "section", "article")), one(_CONTENT)
    named = f' {one(("class", "id"))}="{name}"' if name else ""
    story = f"<{tag}{named} data-truth>" + "".join(body) + f"</{tag}>"
    column = "".join([*draw(("ad", "notice"), 2), story, *draw(("comments", "form", "ad", "aside"), 4)])
    if rng.random() < 0.6:
        column = f'<div class="{one(("container", "wrapper", "row", "page", "column", "layout"))}">{column}{"".join(draw(("aside",), 4))}</div>'
    return ("<html><body>" + "".join(draw(("header", "nav", "notice", "ad"), 5)) + column
            + "".join(draw(("comments", "aside", "form", "notice", "footer"), 4)) + one(("", parts["footer"]())) + "</body></html>")


_TRUTH = re.compile(r"<(\w+)([^>]*) data-truth>")


def training_set(htmls: list[str], designs: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Features, labels and weights of the blocks of the marked pages and of their redesigns."""
    rng, marked = np.random.default_rng(seed), []
    for html in htmls:
        page = Page(html)
        y = article_labels(page)
        if y is not None:
            texts = [t for k in range(len(page.tag)) if y[k] and page.tag[k] in ("p", "li", "blockquote", "pre")
                     for t in [page.text([k == j for j in range(len(page.tag))])] if t]
            marked.append((page, y, texts))
    other = [t for _, _, texts in marked for t in texts]
    if not other:
        return None
    xs, ys, ws = [], [], []

    def add(page, y, weight=1.0):
        xs.append(features(page))
        ys.append(y)
        ws.append(np.full(len(y), weight))

    for page, y, texts in marked:
        add(page, y, float(designs))
        for _ in range(designs if texts else 0):
            k = int(rng.integers(0, len(texts)))
            html = redesign(rng, texts[k:k + int(rng.integers(1, 12))], other)
            new = Page(_TRUTH.sub(r'<\1\2><div class="truth-mark">', html))
            truth = next(j for j in range(len(new.tag)) if new.attrs[j] == "truth-mark")
            add(*_unmarked(html, new, truth))
    x, y = np.concatenate(xs), np.concatenate(ys)
    return x, y, np.concatenate(ws) * np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1.0)


def _unmarked(html: str, marked: Page, truth: int) -> tuple[Page, np.ndarray]:
    """The redesigned page without its mark, and the labels that the mark gives: parts set into the story are no article."""
    page = Page(_TRUTH.sub(r"<\1\2>", html))
    story = marked.parent[truth]  # the same number in both pages, as the mark comes after it
    inside = [False] * len(page.tag)
    for k in range(story, len(page.tag)):
        inside[k] = k == story or inside[page.parent[k]] and (page.parent[k] != story or page.tag[k] in ("p", "h1") and not page.attrs[k])
    return page, (up_sums(np.array(inside) * page.own_chars(), page.parent) > 0).astype(float)


def fit_extractor(pages: DataFrame, id_col: str, html_col: str, most_pages: int) -> Trees | None:
    """Trees fitted on at most ``most_pages`` of the pages that mark their article, the first by the hash of their id."""
    def run(batches):
        best: dict[int, tuple[int, str]] = {}  # hash and page of the task's first ids so far
        last: list[tuple[int, int]] = []  # the same ids, the last one on top
        for b in batches:
            for at in range(b.num_rows):
                i, h = b.column(0)[at].as_py(), b.column(1)[at].as_py()
                if i not in best and len(best) == most_pages and (h, i) > (-last[0][0], -last[0][1]):
                    continue
                html = b.column(2)[at].as_py()
                if article_labels(Page(html)) is None:
                    continue
                if i not in best:
                    heapq.heappush(last, (-h, -i))
                best[i] = h, min(html, best[i][1]) if i in best else html
                if len(best) > most_pages:
                    del best[-heapq.heappop(last)[1]]
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([t for _, t in best.values()], pa.string())], ["id", "html"])

    named = (pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
             .where(F.col("id").isNotNull() & F.lower("html").contains("article")).select("id", F.xxhash64("id").alias("h"), "html"))
    marked = materialize(map_batches(named, run, "id long, html string"), "marked")
    ids = first_by_hash(marked.select("id").distinct(), most_pages)
    rows = marked.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("html").alias("html")).collect()
    data = training_set([r["html"] or "" for r in sorted(rows, key=lambda r: r["id"])])
    return Trees().fit(*data) if data else None


def extract(htmls: list[str], trees: Trees | None) -> list[str]:
    """Main texts; without trees every visible block is kept."""
    pages = [Page(h) for h in htmls]
    if trees is None:
        return [p.text([True] * len(p.tag)) for p in pages]
    odds = trees.odds(np.concatenate([features(p) for p in pages]))
    ends = np.cumsum([len(p.tag) for p in pages])
    return [p.text(decode(odds[e - len(p.tag):e], p.parent, p.own_chars())) for p, e in zip(pages, ends)]


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_pages: int = 120) -> DataFrame:
    """``page_id, url, text, n_chars`` per row.

    The trees are fitted on at most ``most_pages`` pages of the table that mark their article; every page is extracted whole.  Null and empty pages give
    the empty text; without a page that marks its article all visible text counts as main; repeated rows and
    rows without an id are extracted like any other; other columns are not read.
    """
    trees = fit_extractor(pages, id_col, html_col, most_pages)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = extract(as_texts(part.column(2)), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return map_batches(picked, run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))
