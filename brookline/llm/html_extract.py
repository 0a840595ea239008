"""Main text of HTML pages by gradient-boosted trees over DOM-node features, with hierarchical decoding.

Every block element has features of its own (element, tokens of its class, id and role, depth, place among its
siblings, link and subtree density, punctuation, what its heading or short text announces) and of what encloses it. Boosted trees give the log-odds that it is
main text; decoding picks the likeliest labelling in which nothing below a dropped element is kept: a dynamic program
over the tree. Scripts, styles, controls and markup never are text.

The trees are trained here, on pages that a seeded generator composes from the layouts and names that pages use
(TRAIN_PAGES of them, the bound of the fit), so that the labels are exact; no page of the input is learnt from.

Defined results: a null or empty page has an empty text; a page without kept text too; a null id or url stays null;
rows that repeat give a row each; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import Node, blocks, read

TRAIN_PAGES, TREES, DEPTH, RATE, BINS, PAGES_AT_ONCE = 1500, 90, 5, 0.2, 32, 200

# Words of class names and the like, by what they hint at.
HINTS = {
    "content": "article articlebody content contents entry main maincontent post postbody story text body prose markdown paragraph abstract blog page chapter lead intro summary",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs pager pagination paging toc toolbar skip sitemap dropdown submenu",
    "edge": "header masthead topbar banner hero logo footer foot bottom copyright colophon legal imprint branding",
    "side": "sidebar aside side rail related recommended recommendations popular trending widget widgets secondary more tags tagcloud archive archives bio author",
    "advert": "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted banner doubleclick outbrain taboola commercial affiliate",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall signup warning message toast disclaimer announcement",
    "talk": "comment comments commentlist respond reply replies discussion disqus thread reaction reactions feedback review reviews",
    "form": "form login search searchbox register contact input field signin",
    "share": "share sharing social follow facebook twitter instagram like likes print email meta byline rating",
}
# Words with which headings and short texts announce what they are.
SAID = {
    "talk": "comment comments reply replies responses discussion respond reactions",
    "side": "related recommended popular trending next also author tags categories archives latest newsletter subscribe more",
    "edge": "copyright rights reserved privacy terms imprint cookies cookie contact © disclaimer",
    "share": "share follow tweet print",
    "form": "search login register sign password",
}
_SAID = {w: i for i, words in enumerate(SAID.values()) for w in words.split()}
_SAYING = re.compile(r"[a-z]+|©")
_HINT = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
_TAGS = [{"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"article"}, {"main"}, {"section"}, {"div"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption"}, {"address", "dialog", "menu", "details", "summary"}, {"body", "html", ""}]
_KIND = {t: i for i, tags in enumerate(_TAGS) for t in tags}
_ENCLOSING = [5, 6, 7, 8, 9, 10, 11]
N_HINTS, N_KINDS, N_SAID = len(HINTS), len(_TAGS), len(SAID)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def says(node: Node) -> list[int]:
    """What a node's own text announces, if it is a short one (12 words)."""
    if not 0 < node.words <= 12 or node.chars > 100:
        return []
    return [_SAID[w] for w in _SAYING.findall("".join(t for _, t in node.runs).lower()) if w in _SAID]


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    total = np.array([(x.chars, x.linked, x.words, x.stops, x.links, x.tags + 1, x.hidden, 1) for x in nodes], float).reshape(n, 8)
    own = total.copy()
    parent = np.array([place[id(x.parent)] if x.parent else 0 for x in nodes])
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    hints, kinds = np.zeros((n, N_HINTS)), np.zeros((n, N_KINDS))
    said = np.zeros((n, N_SAID))
    up = np.zeros((n, N_HINTS + len(_ENCLOSING) + N_SAID))
    for i, x in enumerate(nodes):
        for k in says(x):
            said[i, k] = 1
            # A heading speaks for what it stands in, if it comes first there.
            if x.tag in _HEADINGS and x.parent and x.parent.children[0] is x:
                said[parent[i], k] = 1
    sib = np.zeros((n, 6))
    for i, x in enumerate(nodes):
        for t in x.tokens:
            if t in _HINT:
                hints[i, _HINT[t]] = 1
        kinds[i, _KIND.get(x.tag, N_KINDS - 1)] = 1
        if i:
            above = parent[i]
            up[i] = np.maximum(up[above], np.concatenate([hints[above], kinds[above, _ENCLOSING], said[above]]))
        same, alike = len(x.children), Counter(c.tag for c in x.children)
        for k, c in enumerate(x.children):
            sib[place[id(c)]] = (k / max(1, same - 1), same, alike[c.tag] / same, 0, k > 0 and x.children[k - 1].tag == c.tag, k + 1 < same and x.children[k + 1].tag == c.tag)
    sib[:, 3] = total[:, 0] / np.maximum(1, total[parent, 0])
    chars = np.maximum(1, total[:, 0])
    depth = np.array([x.depth for x in nodes], float)
    shape = np.column_stack([
        np.log1p(total[:, 0]), np.log1p(own[:, 0]), total[:, 1] / chars, total[:, 0] / total[:, 5], total[:, 3] / np.maximum(1, total[:, 2]),
        np.log1p(total[:, 2]), total[:, 4] / np.maximum(1, total[:, 2]), total[:, 6] / total[:, 7], np.log1p(total[:, 7]), depth, total[:, 0] / max(1, total[0, 0]), np.arange(n) / n,
    ])
    return np.hstack([shape, sib, hints, kinds, said, up])


class Trees:
    """Gradient-boosted regression trees for the logistic loss, of even depth, split on quantile bins."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)]).astype(np.int64)
        m, self.depth, self.trees = x.shape[1], depth, []
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        raw = np.full(len(y), self.bias)
        wide = binned + BINS * np.arange(m)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p) + 1e-9
            at = np.zeros(len(y), np.int64)
            splits = []
            for level in range(depth):
                k = 1 << level
                key = (at[:, None] * (m * BINS) + wide).ravel()
                gs, hs = (np.bincount(key, np.repeat(v, m), k * m * BINS).reshape(k, m, BINS).cumsum(2) for v in (g, h))
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 2) | (ht - hs < 2)] = 0
                best = gain.reshape(k, -1).argmax(1)
                f, b = best // BINS, best % BINS
                splits.append((f, b))
                at = 2 * at + (binned[np.arange(len(y)), f[at]] > b[at])
            k = 1 << depth
            leaf = -np.bincount(at, g, k) / (np.bincount(at, h, k) + 1) * rate
            self.trees.append(([(f, np.array([self.cuts[i][j] if j < len(self.cuts[i]) else np.inf for i, j in zip(f, b, strict=True)])) for f, b in splits], leaf))
            raw += leaf[at]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for splits, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for f, cut in splits:
                at = 2 * at + (x[rows, f[at]] > cut[at])
            out += leaf[at]
        return out


def decode(nodes: list[Node], logit: np.ndarray) -> list[bool]:
    """The likeliest labels such that a kept node's ancestors are kept: best totals bottom-up, choices top-down."""
    place = {id(x): i for i, x in enumerate(nodes)}
    logit = np.clip(logit, -12, 12)
    yes, no = -np.log1p(np.exp(-logit)), -np.log1p(np.exp(logit))
    keep, drop = yes.tolist(), no.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        p = place[id(nodes[i].parent)]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [True] * len(nodes)
    for i, x in enumerate(nodes):
        if i:
            out[i] = out[place[id(x.parent)]] and keep[i] >= drop[i]
    return out


# --- training pages ---------------------------------------------------------------------------------------------------


def training_page(r: random.Random) -> str:
    """A page whose main text's elements carry data-component="keep"; the reader sees that as a token."""
    words = ["".join(r.choice(["ka", "lo", "mi", "ter", "sun", "a", "ve", "ing", "or", "st", "é"]) for _ in range(r.randint(1, 4))) for _ in range(120)]
    # Many names of main text say nothing, and some pages write their paragraphs as div elements.
    named = lambda kind: (r.choice(words)[:9] if kind == "content" and r.random() < 0.4 else r.choice(HINTS[kind].split())) + r.choice(["", "", "", "-box", "-inner", "-1"])
    para = "div" if r.random() < 0.2 else "p"

    def phrase(lo: int, hi: int, stops: bool = True) -> str:
        w = [r.choice(words) for _ in range(r.randint(lo, hi))]
        if stops:
            w = [x + "," if r.random() < 0.08 else x + "." if r.random() < 0.08 else x for x in w]
            w[-1] += "."
        return " ".join(w).capitalize()

    def link(lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/{r.choice(words)}">{phrase(lo, hi, False)}</a>'

    def name(kind: str, chance: float = 0.8) -> str:
        if r.random() > chance:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{named(kind)}{" " + r.choice(words) if r.random() < 0.3 else ""}"'

    K = ' data-component="keep"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>" if r.random() < 0.8 else " | ".join(link() for _ in range(n))

    def prose(keep: str) -> str:
        return "".join(f"<p{keep}>{phrase(2, 60)}{' ' + link() + ' ' + phrase(1, 9) if r.random() < 0.2 else ''}</p>" for _ in range(r.randint(1, 4)))

    def boiler(kind: str) -> str:
        tag = {"menu": "nav", "edge": r.choice(["header", "footer"]), "side": "aside", "form": "form"}.get(kind, r.choice(["div", "section", "aside"]))
        plain = r.random() < 0.4
        # Some say what they are in their words alone.
        tells = kind in SAID and r.random() < 0.35
        tag, attr = ("div" if plain else tag), "" if tells else name(kind, 0.7 if kind == "menu" else 1.0 if plain or kind in ("advert", "notice", "talk", "share") else 0.5)
        spoken = lambda: f"{phrase(1, 2, False) + ' ' if r.random() < 0.3 else ''}{r.choice(SAID[kind].split()).capitalize()}{' ' + phrase(1, 2, False) if r.random() < 0.4 else ''}"
        if kind == "menu":
            inner = links(r.randint(2, 12))
        elif kind == "edge" and tells:
            line = r.choice(["All rights reserved", f"&copy; 2024 {phrase(1, 3, False)}", f"Copyright {phrase(1, 4, False)}", f"{phrase(1, 3, False)} All rights reserved.", "Privacy Terms Contact"])
            inner = r.choice([line, f"<p>{line}</p>", f"{line} {link(1, 1)} {link(1, 2)}"])
        elif kind == "edge":
            inner = r.choice([f"<p>&copy; {phrase(2, 10)}</p>", f"&copy; {phrase(1, 8)}", f"<h1>{phrase(1, 4, False)}</h1>", f"<div>{link()}</div>{links(4)}", phrase(2, 12)])
        elif kind == "side":
            inner = f"<h3>{spoken() if tells else phrase(1, 4, False)}</h3>" + r.choice([links(r.randint(2, 8)), prose(""), f"<p>{phrase(5, 30)}</p>{link()}"])
        elif kind == "advert":
            inner = r.choice([phrase(3, 25), f"<p>{phrase(4, 30)}</p>", link(3, 12), f"<a href='/x'><img src='/a.png'></a><span>{phrase(2, 8)}</span>"])
        elif kind == "notice":
            inner = f"<p>{phrase(5, 40)}</p>" + r.choice(["<button>OK</button>", link(), "", f"<div>{phrase(2, 9)}</div>"])
        elif kind == "talk":
            head, rank = spoken() if tells else phrase(1, 3, False), r.randint(2, 4)
            inner = f"<h{rank}>{head}</h{rank}>" * (tells or r.random() < 0.6)
            if r.random() < 0.3:
                inner += "<ul>" + "".join(f"<li>{r.choice(['<p>{}</p>', '<b>{}</b> {}', '{}']).format(phrase(3, 40), phrase(3, 30))}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
            inner += "" if inner.endswith("</ul>") else "".join(r.choice([f"<div{name('talk', 0.6)}><b>{phrase(1, 2, False)}</b><p>{phrase(3, 40)}</p></div>", f"<li><p>{phrase(3, 40)}</p></li>", f"<article{name('talk')}><p>{phrase(3, 40)}</p></article>", f"<p>{phrase(3, 40)}</p>"]) for _ in range(r.randint(1, 6)))
        elif kind == "share" and tells:
            inner = f"<h4>{spoken()}</h4>{links(3)}"
        elif kind == "form":
            inner = f"<label>{phrase(1, 3, False)}</label><input name='q'><p>{phrase(2, 12)}</p><button>{phrase(1, 2, False)}</button>"
        else:
            inner = links(r.randint(2, 5))
        return f"<{tag}{attr}>{inner}</{tag}>"

    def block() -> str:
        k = r.random()
        if k < 0.62:
            end = f"</{para}>" if para == "div" or r.random() < 0.85 else ""
            return f"<{para}{K}>{phrase(1, 80)}{end}" if r.random() < 0.85 else f"<{para}{K}>{phrase(2, 30)} {link()} {phrase(2, 30)}{end}"
        if k < 0.72:
            return f"<p{K}><b>{phrase(1, 10)}</b></p>" if r.random() < 0.5 else f"<p{K}><b>{phrase(1, 10)}<br>"
        if k < 0.8:
            level = r.randint(2, 4)
            title = phrase(1, 7, False)
            if r.random() < 0.15:  # words that announce something elsewhere occur in titles too
                title = r.choice([f"{title} {r.choice(list(_SAID))} {phrase(1, 3, False)}", f"{r.choice(list(_SAID)).capitalize()} {phrase(1, 4, False)}"])
            return f"<h{level}{K}>{title}</h{level}>"
        if k < 0.87:
            linked = r.choice([0, 0.15, 0.5])
            return f"<ul{K}>" + "".join(f"<li{K}>{phrase(1, 14, r.random() < 0.6)}{' ' + link(1, 3) + (' ' + phrase(1, 6) if r.random() < 0.4 else '') if r.random() < linked else ''}</li>" for _ in range(r.randint(1, 7))) + "</ul>"
        if k < 0.9:
            return f"<blockquote{K}><p{K}>{phrase(4, 40)}</p></blockquote>"
        if k < 0.93:
            return f"<pre{K}>{phrase(4, 30)}</pre>"
        if k < 0.96:
            return f"<table{K}>" + "".join(f"<tr{K}>" + "".join(f"<td{K}>{phrase(1, 3, False)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<div{K}>{phrase(3, 50)}</div>"

    body = [f"<h1{K}>{phrase(1, 9, r.random() < 0.3)}</h1>"] * (r.random() < 0.85) + [block() for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9, 15, 30]))]
    for kind in ("advert", "share", "side", "notice", "form"):
        if r.random() < 0.12:
            body.insert(r.randint(0, len(body)), boiler(kind))
    if r.random() < 0.15:  # the article's own header and footer go like any other
        inner = r.choice([f"<h1>{phrase(1, 9, False)}</h1>", "", f"<h2>{phrase(1, 9, False)}</h2>"]) + r.choice([f"<p>{phrase(1, 5)}</p>", f"<span>{phrase(1, 5, False)}</span>", f"<time>{phrase(1, 3, False)}</time>"])
        body.insert(0, f"<header{name('share', 0.3)}>{inner}</header>")
    if r.random() < 0.15:
        body.append(f"<footer{name('share', 0.3)}>{r.choice([phrase(1, 6, False), f'<p>{phrase(2, 9)}</p>', links(3), f'{phrase(1, 2, False)}: {link()}, {link()}'])}</footer>")
    body = "".join(body)
    tag = r.choice(["article"] * 5 + ["main", "div", "div", "section"])
    attr = name("content", 0.3 if tag in ("article", "main") else 1.0)
    main = f"<{tag}{attr}{K}>{body}{boiler('talk') if r.random() < 0.12 else ''}</{tag}>"
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        w = r.choice(["div", "main", "section"])
        main = f"<{w}{name('content', 0.5)}{K}>{boiler(r.choice(['share', 'side', 'menu', 'advert'])) if r.random() < 0.3 else ''}{main}{boiler(r.choice(['talk', 'side', 'advert'])) if r.random() < 0.3 else ''}</{w}>"
    before = [boiler(r.choice(["menu", "edge", "advert", "notice", "form", "side"])) for _ in range(r.choice([0, 1, 2, 2, 3]))]
    after = [boiler(r.choice(["edge", "side", "talk", "advert", "notice", "menu", "share"])) for _ in range(r.choice([0, 1, 1, 2, 3, 4]))]
    if r.random() < 0.1:
        main = ""
    elif r.random() < 0.12:  # a bare page: nothing around the text, and no names
        depth = r.randint(0, 3)
        paragraphs = "".join(f"<{para}{K}>{phrase(1, r.choice([10, 80]))}</{para}>" if r.random() < 0.8 else block() for _ in range(r.choice([1, 2, 3, 5, 12])))
        main, before, after = f"<div{K}>" * depth + paragraphs + "</div>" * depth, [], [boiler("edge")] if r.random() < 0.3 else []
    return f"<html{K}><head><title>x</title></head><body{K}>{''.join(before)}{main}{''.join(after)}</body></html>"


_MODEL: list[Trees] = []


def model(pages: int = TRAIN_PAGES, seed: int = 7) -> Trees:
    """The trees, fitted once in a process that asks for them."""
    if not _MODEL:
        r, xs, ys = random.Random(seed), [], []
        for _ in range(pages):
            nodes = read(training_page(r))
            ys.append([float("keep" in x.tokens or not x.tag) for x in nodes])
            for x in nodes:
                x.tokens = tuple(t for t in x.tokens if t != "keep")
            xs.append(features(nodes))
        _MODEL.append(Trees().fit(np.vstack(xs), np.concatenate(ys)))
    return _MODEL[0]


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main texts of pages."""
    read_in = [read(p) if p else [] for p in pages]
    made = [features(n) for n in read_in if n]
    logit, out, at = trees.logit(np.vstack(made)) if made else np.empty(0), [], 0
    for nodes in read_in:
        out.append(blocks(nodes, decode(nodes, logit[at : at + len(nodes)])) if nodes else "")
        at += len(nodes)
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    trees = pages.sparkSession.sparkContext.broadcast(model())  # TREES trees of 2 ** DEPTH leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PAGES_AT_ONCE):
                some = b.slice(lo, PAGES_AT_ONCE)
                texts = extract(some.column(2).to_pylist(), trees.value)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
