"""Main text of HTML pages: boosted trees over DOM nodes, decoded hierarchically."""

from __future__ import annotations

import html
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deucebase.llm.common import released, short_batches

TOKEN = re.compile(r"<!--|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>")
ATTR = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Fixed values of the HTML standard: elements without content, elements whose content is no markup (without an end tag
# they reach to the end of the page), elements within a line, elements that end an open paragraph, optional end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
ITEM = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
OPAQUE = frozenset("td th button object template caption".split())  # a paragraph outside is not ended from within
FOREIGN = frozenset("svg math".split())  # only here does a slash at the end of a tag close the element
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd td th figcaption caption summary address legend option button".split())  # their own text is part of them
TEXT = "#text"  # a run of text directly in any other element
TAGS = [TEXT, *"article main section div p h1 h2 h3 h4 li ul ol dl nav header footer aside form table tr td blockquote pre figure figcaption span a button select svg object details body".split()]
_TAG = {t: i for i, t in enumerate(TAGS)}
_BUCKETS = 4096


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: tuple[int, ...]
    at: int
    index: int = 0
    children: list[int] = field(default_factory=list)
    own: int = 0
    linked: int = 0
    marks: int = 0
    links: int = 0
    controls: int = 0
    signs: int = 0


Block = list[tuple[int, str]]


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Nodes in page order (0 is the root) and blocks of text in page order, each of pieces (node, text as written).

    Nodes are the block-level elements, elements within a line that have a class, id or role, and runs of text that stand
    directly among block-level elements. Unclosed and misnested elements end where their parents do.
    """
    nodes = [Node("body", -1, 0, (), 0)]
    blocks: list[Block] = []
    run: Block = []
    stack, linked, at, n, bare = [0], False, 0, len(page), -1

    def add(tag, words, where):
        up = stack[-1]
        nodes.append(Node(tag, up, nodes[up].depth + 1, words, where, len(nodes[up].children)))
        nodes[up].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def flush():
        nonlocal run, bare
        if any(k >= 0 for k, _ in run):
            blocks.append(run)
        run, bare = [], -1

    def take(s, where):
        nonlocal bare
        if not s or s.isspace():
            if s and run:
                run.append((-1, " "))
            return
        k = stack[-1]
        if nodes[k].tag not in LINES and nodes[k].tag not in INLINE:
            if bare < 0 or nodes[bare].parent != k:
                bare = add(TEXT, (), where)
            k = bare
        run.append((k, s))
        d, size = nodes[k], len(s)
        d.own += size
        d.marks += s.count(",") + s.count(".")
        d.signs += s.count("©") + s.count("&copy") + s.count("|") + s.count("»")
        if linked:
            d.linked += size

    def close_to(k):
        flush()
        del stack[k:]

    def opened(tag):
        return next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag), 0)

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            take(page[at:], at)
            break
        take(page[at : m.start()], at)
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1]:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in ("html", "head", "body"):
            if not m[1]:
                nodes[0].words += _words(m[3])
            flush()
            continue
        if tag == "br":
            if run:
                run.append((-1, " "))
            continue
        if tag in VOID:
            nodes[stack[-1]].controls += tag == "input"
            if tag == "hr":
                flush()
            continue
        if m[1]:
            if tag == "a":
                linked = False
            k = opened(tag)
            if tag in INLINE:
                if k and all(nodes[stack[j]].tag in INLINE for j in range(k, len(stack))):
                    del stack[k:]
            elif k:
                close_to(k)
            else:
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                linked = True
                nodes[stack[-1]].links += 1
            if words := _words(m[3]):
                stack.append(add(tag, words, m.start()))
            continue
        flush()
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == "p":
                    close_to(k)
                    break
                if nodes[stack[k]].tag in OPAQUE:
                    break
        if tag in ITEM:
            like, stop = ITEM[tag]
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in stop:
                    break
                if nodes[stack[k]].tag in like.split():
                    close_to(k)
                    break
        k = add(tag, _words(m[3]), m.start())
        nodes[k].controls += tag in ("button", "select", "form")
        if not (m[3].endswith("/") and (tag in FOREIGN or any(nodes[j].tag in FOREIGN for j in stack))):
            stack.append(k)
    flush()
    return nodes, blocks


def block_text(block: Block, kept: np.ndarray) -> str:
    """The kept pieces of a block, references decoded, white space single."""
    return " ".join(html.unescape("".join(s for k, s in block if k < 0 or kept[k])).split())


@lru_cache(maxsize=8192)
def _words(attrs: str) -> tuple[int, ...]:
    """Hashes of the words of class, id, role, label and item attributes."""
    found = {w.lower() for m in ATTR.finditer(attrs) for w in PART.findall(m[1] or m[2] or m[3] or "")}
    return tuple(sorted({zlib.crc32(w.encode()) % _BUCKETS for w in found}))


N_NUMBERS = 36
N_FEATURES = 2 * len(TAGS) + N_NUMBERS


def features(nodes: list[Node], weight: np.ndarray) -> np.ndarray:
    """A row per node: tags of it and its ancestors, what its attribute words have weighed, text and link density of node
    and subtree, depth, siblings, place on the page. ``weight``: log-odds by hashed attribute word, learned from pages."""
    n, nt = len(nodes), len(TAGS)
    x = np.zeros((n, N_FEATURES), np.float32)
    text, linked, links, marks, count, paras, controls, signs = np.zeros((8, n))
    before, so_far = np.zeros(n), 0
    for i, d in enumerate(nodes):
        before[i] = so_far
        so_far += d.own
    for i in range(n - 1, -1, -1):
        d = nodes[i]
        text[i] += d.own
        linked[i] += d.linked
        links[i] += d.links
        marks[i] += d.marks
        controls[i] += d.controls
        signs[i] += d.signs
        count[i] += 1
        paras[i] += d.tag in ("p", TEXT) and d.own > 80
        if d.parent >= 0:
            for a in (text, linked, links, marks, count, paras, controls, signs):
                a[d.parent] += a[i]
    total, all_paras = max(text[0], 1), max(paras[0], 1)
    low, high = np.zeros(n), np.zeros(n)  # least and greatest weight of the words of a node's ancestors
    for i, d in enumerate(nodes):
        r, p = x[i], d.parent
        if d.tag in _TAG:
            r[_TAG[d.tag]] = 1
        own = weight[list(d.words)] if d.words else np.zeros(1)
        sib = nodes[p].children if p >= 0 else [i]
        inner = d.children
        if p >= 0:
            r[nt : 2 * nt] = np.maximum(x[p, nt : 2 * nt], x[p, :nt])
            low[i], high[i] = x[p, 2 * nt + 1], x[p, 2 * nt + 2]
        lo, hi = min(low[i], own.min()), max(high[i], own.max())
        alike = [c for c in sib if nodes[c].tag == d.tag and nodes[c].words == d.words]
        prev, nxt = (sib[d.index - 1] if d.index else -1), (sib[d.index + 1] if d.index + 1 < len(sib) else -1)
        others = text[sib].sum() - text[i]
        r[2 * nt :] = (
            own.sum(), lo, hi, low[i], high[i], len(d.words),
            np.log1p(d.own), np.log1p(text[i]), text[i] / total, before[i] / total, linked[i] / max(text[i], 1), links[i] / max(count[i], 1),
            marks[i] / max(text[i], 1) * 100, d.marks / max(d.own, 1) * 100, text[i] / count[i], np.log1p(count[i]), paras[i], paras[i] / all_paras,
            d.depth, d.index / len(sib), len(sib), np.log1p(others / max(len(sib) - 1, 1)), np.log1p(text[prev]) if prev >= 0 else -1, np.log1p(text[nxt]) if nxt >= 0 else -1,
            paras[p] / all_paras if p >= 0 else 1, text[p] / total if p >= 0 else 1, linked[p] / max(text[p], 1) if p >= 0 else 0,
            len(inner), len(alike), np.log1p(text[alike].mean()), sum(nodes[c].tag == d.tag for c in sib), d.linked / max(d.own, 1),
            controls[i], signs[i] / max(text[i], 1) * 100, _TAG.get(nodes[prev].tag, -1) if prev >= 0 else -2, max((text[c] for c in inner), default=0) / max(text[i], 1),
        )
    return x


class Boosted:
    """Gradient-boosted trees for logistic loss, all of one depth, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 24, reg: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.reg = rounds, depth, rate, bins, reg
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.base = float(np.log((y.mean() + 1e-3) / (1.001 - y.mean())))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        cuts = [c if len(np.unique(x[:, j])) > self.bins else (np.unique(x[:, j])[:-1] + np.unique(x[:, j])[1:]) / 2 for j, c in enumerate(cuts)]
        width = max(map(len, cuts)) + 1
        code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        flat = code + np.arange(f) * width
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            leaf = np.zeros(n, np.int64)
            feat, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for d in range(self.depth):
                size = 1 << d
                at = ((leaf * (f * width))[:, None] + flat).ravel()
                hist = [np.bincount(at, np.repeat(w, f), size * f * width).reshape(size, f, width).cumsum(2) for w in (g, h)]
                gl, hl = hist
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.reg) + (gt - gl) ** 2 / (ht - hl + self.reg) - gt**2 / (ht + self.reg)
                gain[:, :, -1] = 0
                for k in range(size):
                    j, b = np.unravel_index(int(gain[k].argmax()), (f, width))
                    if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                        feat[size - 1 + k], cut[size - 1 + k] = j, cuts[j][b]
                leaf = 2 * leaf + (x[np.arange(n), feat[size - 1 + leaf]] > cut[size - 1 + leaf])
            gs, hs = (np.bincount(leaf, w, 1 << self.depth) for w in (g, h))
            value = -self.rate * gs / (hs + self.reg)
            score += value[leaf]
            self.trees.append((feat, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feat, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feat[at]] > cut[at])
            score += value[at - ((1 << self.depth) - 1)]
        return score


@dataclass
class Model:
    """Log-odds of main text by hashed attribute word, and the trees."""

    weight: np.ndarray
    trees: Boosted


# --- labelled pages, made here

# Names that sites commonly give to what is not, and to what is, main text.
CLUTTER = {
    "menu": "nav menu navigation navbar topbar breadcrumb breadcrumbs pagination pager toolbar tabs tags share social links sitemap",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adslot partner offer",
    "side": "sidebar side aside widget related recommended popular trending rail complementary more",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr message warning paywall",
    "comments": "comments comment responses discussion replies reply disqus thread feedback respond reviews",
    "form": "newsletter subscribe signup login form search register contact subscription",
    "header": "header banner masthead top branding logo",
    "footer": "footer copyright legal bottom colophon imprint contentinfo",
}
CONTENT = "content post entry story article text main body page maincontent articlebody prose hentry document chapter"
WRAP = "wrapper container wrap page row col column grid inner outer layout site box group block"


class _Maker:
    """Random pages whose nodes are known to be main text or not: clutter stands between the comments <!--0--> and <!--1-->."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        s = " ".join("".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiouéä") for _ in range(r.randint(1, 4))) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high)))
        return s.capitalize() + ("." if r.random() < 0.8 else "")

    def attrs(self, names: str, none: float = 0.0, strange: float = 0.3) -> str:
        """A class or id of one of ``names``, of a meaningless word, or none."""
        r = self.r
        if r.random() < none:
            return ""
        v = r.choice(names.split())
        if r.random() < strange:
            v = "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, 7)))
        v = r.choice([v, v, f"{v}-{r.choice(WRAP.split())}", f"js-{v}", f"site-{v}", f"{v}_{r.randint(1, 99)}", f"{r.choice(WRAP.split())} {v}"])
        return f' {r.choice(["class", "class", "id", "role" if r.random() < 0.3 else "class"])}="{v}"'

    def links(self, k: int) -> str:
        r = self.r
        if r.random() < 0.3:
            return r.choice([" | ", " ", " &middot; ", "<br>"]).join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(k))
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 6)}</a></li>' for i in range(k)) + "</ul>"

    def sentence(self) -> str:
        r = self.r
        t = self.words(6, 90)
        if r.random() < 0.12:
            t = f"<b>{t}" if r.random() < 0.5 else f"{t} <em>{self.words(1, 6)}</em> {self.words(2, 20)}"
        if r.random() < 0.15:
            t += f' <a href="#">{self.words(1, 3)}</a> {self.words(3, 20)}'
        if r.random() < 0.08:
            t += f' <span{self.attrs("highlight term quote name date lang")}>{self.words(1, 12)}</span> {self.words(2, 20)}'
        if r.random() < 0.06:
            t += f'<!--0--><span{self.attrs(CLUTTER["advert"], strange=0.05)}>{self.words(2, 12)}</span><!--1--> {self.words(2, 10)}'
        return t

    def paragraphs(self, k: int) -> str:
        r, out = self.r, []
        for _ in range(k):
            u = r.random()
            if u < 0.6:
                out.append(f"<p{self.attrs('intro lead first para text', 0.9)}>{self.sentence()}" + ("</p>" if r.random() < 0.85 else ""))
            elif u < 0.68:
                out.append(f"<h{(h := r.choice('2234'))}>{self.words(1, 8)}</h{h}>")
            elif u < 0.75:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 25)}" + ("</li>" if r.random() < 0.7 else "") for _ in range(r.randint(2, 6))) + "</ul>")
            elif u < 0.8:
                out.append(f"<blockquote>{f'<p>{self.words(8, 50)}</p>' if r.random() < 0.6 else self.words(8, 50)}</blockquote>")
            elif u < 0.84:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            elif u < 0.87:
                out.append(f"<pre>{self.words(5, 30)}</pre>")
            elif u < 0.92:
                out.append(f"<div{self.attrs(CONTENT, 0.7)}>{self.sentence()}</div>")
            elif u < 0.94:
                out.append(f"<figure><img src=x><figcaption>{self.words(3, 15)}</figcaption></figure>")
            elif u < 0.955:
                out.append(f"<button>{self.sentence()}<p>{self.sentence()}</p>")  # never closed: it goes on to the end of its parent
            else:
                out.append(f"<p>{self.words(1, 6)}</p>")
        return "".join(out)

    def clutter(self, late: bool = False) -> str:
        """``late``: below the article, where readers' comments stand."""
        r = self.r
        kind = r.choice(["menu", "menu", "advert", "side", "side", "notice", "form", "newsletter", "header", "footer", "bare", "control"] + ["comments"] * (6 if late else 0))
        u = r.random()
        if kind == "menu":
            t = r.choice(["nav", "nav", "div", "ul"])
            inner = self.links(r.randint(2, 9))
            out = f"<{t}{self.attrs(CLUTTER['menu'], 0.4)}>{inner}</{t}>"
        elif kind == "advert":
            out = f"<div{self.attrs(CLUTTER['advert'], strange=0.05)}>{f'<p>{self.words(2, 40)}</p>' if u < 0.3 else self.words(2, 40)}</div>"
        elif kind == "side":
            t = r.choice(["aside", "aside", "div", "section"])
            body = self.links(r.randint(2, 6)) if u < 0.6 else f"<p>{self.words(4, 60)}</p>"
            out = f"<{t}{self.attrs(CLUTTER['side'], 0.3 if t == 'aside' else 0, 0.3 if u < 0.6 or t == 'aside' else 0.05)}>{f'<h3>{self.words(1, 4)}</h3>' if r.random() < 0.5 else ''}{body}</{t}>"
        elif kind == "notice":
            out = f"<div{self.attrs(CLUTTER['notice'], strange=0.05)}>{'<p>' if u < 0.5 else ''}{self.words(4, 50)}{'<button>' + self.words(1, 2) + '</button>' if r.random() < 0.4 else ''}</div>"
        elif kind == "comments":
            t, name = r.choice(["li", "div", "article"]), self.attrs("comment reply item response", 0.2)
            who = lambda: f"<{(b := r.choice(['b', 'strong', 'h4', 'cite']))}>{self.words(1, 2)}</{b}>"
            item = lambda: f"<{t}{name}>{who() if r.random() < 0.8 else ''}{f'<p>{self.words(3, 70)}</p>' if r.random() < 0.8 else self.words(3, 70)}{'<a href=#>' + self.words(1, 1) + '</a>' if r.random() < 0.4 else ''}</{t}>"
            whole = r.choice(["section", "div", "div", "ol"])
            out = f"<{whole}{self.attrs(CLUTTER['comments'], 0.05)}>{f'<h{(h := r.choice("234"))}>' + self.words(1, 3) + f'</h{h}>' if r.random() < 0.6 else ''}{''.join(item() for _ in range(r.randint(1, 7)))}</{whole}>"
        elif kind == "form":
            out = f"<form{self.attrs(CLUTTER['form'], 0.5)}><p>{self.words(2, 25)}</p><label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button></form>"
        elif kind == "newsletter":
            out = f"<div{self.attrs(CLUTTER['form'], strange=0.1)}><p>{self.words(3, 40)}</p>{'<input name=mail>' if u < 0.5 else ''}</div>"
        elif kind == "header":
            t = r.choice(["header", "header", "div"])
            out = f"<{t}{self.attrs(CLUTTER['header'], 0.5 if t == 'header' else 0, 0.1)}>{f'<h1>{self.words(1, 4)}</h1>' if r.random() < 0.3 else ''}{self.links(r.randint(1, 6)) if u < 0.5 else f'<p>{self.words(2, 20)}</p>'}</{t}>"
        elif kind == "footer":
            t = r.choice(["footer", "footer", "div"])
            out = f"<{t}{self.attrs(CLUTTER['footer'], 0.5 if t == 'footer' else 0, 0.1)}>{'<p>' if u < 0.5 else ''}{r.choice(['&copy; ', '© ', 'Copyright '])}{self.words(2, 35)}{self.links(r.randint(1, 5)) if r.random() < 0.3 else ''}</{t}>"
        elif kind == "control":
            out = r.choice([f"<button{self.attrs('btn button share like', 0.5)}>{self.words(1, 3)}</button>", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>", f"<svg><title>{self.words(1, 2)}</title><text>{self.words(1, 2)}</text></svg>"])
        else:
            out = r.choice([f'<a href="#c">{self.words(1, 4)}</a>', f"{r.choice(['&copy; ', '© ', 'Copyright '])}{r.randint(1990, 2030)} {self.words(1, 6)}", self.links(r.randint(2, 5)), f"{self.words(1, 3)} | {self.words(1, 3)}"])
            return f"<!--0-->{out}<!--1--><div></div>"
        return f"<!--0-->{out}<!--1-->"

    def article(self) -> str:
        r = self.r
        inner = [f"<h1>{self.words(2, 14)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.15:
            inner = [f"<header>{''.join(inner)}<p>{self.words(3, 20)}</p></header>"] if inner else inner
        for _ in range(r.randint(1, 4)):
            part = self.paragraphs(r.randint(1, 5))
            if r.random() < 0.15:
                t = r.choice(["section", "div"])
                part = f"<{t}{self.attrs(CONTENT, 0.5)}>{part}</{t}>"
            inner.append(part)
            if r.random() < 0.3:
                inner.append(self.clutter())
        return "".join(inner)

    def page(self) -> str:
        r = self.r
        before = "".join(self.clutter() for _ in range(r.randint(0, 4)))
        after = "".join(self.clutter(True) for _ in range(r.randint(0, 4)))
        u = r.random()
        if u < 0.07:  # straight in the body, lines apart
            body = f"<h1>{self.words(2, 9)}</h1>" + "<br><br>".join(self.sentence() for _ in range(r.randint(2, 8)))
            if before and not before.endswith("</div>"):
                before += "<div></div>"
            return f"<html><body>{before}{body}<div></div>{after}</body></html>"
        if u < 0.14:  # paragraphs straight in the body
            return f"<html><body>{before}{self.article()}{after}</body></html>"
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        body = f"<{tag}{self.attrs(CONTENT, {'article': 0.7, 'main': 0.7}.get(tag, 0.15))}>{self.article()}</{tag}>"
        if tag == "td":
            cell = lambda: f"<td{self.attrs(CLUTTER['side'], 0.5)}>{self.clutter()}</td>"
            body = f"<table><tr>{cell() if r.random() < 0.6 else ''}{body}{cell() if r.random() < 0.4 else ''}</tr></table>"
        for _ in range(r.choice([0, 0, 1, 2])):
            first, last = (self.clutter() if r.random() < 0.4 else "" for _ in range(2))
            w = r.choice(["div", "main", "section"])
            body = f"<{w}{self.attrs(f'{WRAP} {CONTENT}', 0.3)}>{first}{body}{last}</{w}>"
        if after and r.random() < 0.2:
            after = f"<div{self.attrs(WRAP, 0.3)}>{after}</div>"
        return f"<html><body>{before}{body}{after}" + ("</body></html>" if r.random() < 0.8 else "")


def labels(page: str, nodes: list[Node]) -> np.ndarray:
    """1 for nodes that hold main text, 0 for others, nan for nodes without text."""
    spans, open_ = [], 0
    for m in re.finditer("<!--([01])-->", page):
        open_ += 1 if m[1] == "0" else -1
        if open_ == 1 and m[1] == "0":
            spans.append([m.start(), len(page)])
        elif not open_:
            spans[-1][1] = m.start()
    start = np.array([a for a, _ in spans] + [len(page) + 1])
    end = np.array([b for _, b in spans] + [len(page) + 1])
    main, any_ = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):
        d = nodes[i]
        k = int(np.searchsorted(start, d.at, side="right")) - 1
        any_[i] |= d.own > 0
        main[i] |= d.own > 0 and not (k >= 0 and d.at < end[k])
        if d.parent >= 0:
            any_[d.parent] |= any_[i]
            main[d.parent] |= main[i]
    return np.where(any_, main, np.nan)


@lru_cache(maxsize=2)
def train(pages: int = 600, seed: int = 7) -> Model:
    """The model, fitted on labelled pages made here from ``seed``; no page of a corpus is used. One third of as many
    other pages give the weights of attribute words, so that the trees do not trust them too much."""
    maker = _Maker(seed)
    keep, drop = np.zeros(_BUCKETS), np.zeros(_BUCKETS)
    for _ in range(pages // 3):
        page = maker.page()
        nodes, _blocks = parse(page)
        for d, y in zip(nodes, labels(page, nodes), strict=True):
            for w in d.words:
                keep[w] += y == 1
                drop[w] += y == 0
    weight = np.log((keep + 1) / (drop + 1))
    xs, ys = [], []
    for _ in range(pages):
        page = maker.page()
        nodes, _blocks = parse(page)
        y = labels(page, nodes)
        fit = ~np.isnan(y)
        xs.append(features(nodes, weight)[fit])
        ys.append(y[fit])
    return Model(weight, Boosted().fit(np.concatenate(xs), np.concatenate(ys)))


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """Which nodes are main text: the labelling of greatest total log-odds in which nothing below a dropped node stays.
    The root is only what holds the others; text straight in it is a node of its own."""
    n = len(nodes)
    keep, drop = score.copy(), -score
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    state = np.zeros(n, bool)
    state[0] = True
    for i in range(1, n):
        state[i] = state[nodes[i].parent] and keep[i] > drop[i]
    return state


def extract_batch(pages: list[str | None], model: Model) -> list[list[str]]:
    """The blocks of main text of each page, in page order."""
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    score = model.trees.predict(np.concatenate([features(nodes, model.weight) for nodes, _ in parsed]))
    found, at = [], 0
    for nodes, blocks in parsed:
        state = decode(nodes, score[at : at + len(nodes)])
        at += len(nodes)
        found.append([t for t in (block_text(b, state) for b in blocks) if t])
    return found


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, one row per input row; nothing is shuffled, whole pages are read.

    Every node (:func:`parse`) gets log-odds of being main text from trees over its own and its ancestors' tags, the
    learned weights of their hashed attribute words, the density of text, links and punctuation in its subtree, its depth
    and its siblings. The kept set is the best one in which no kept node stands below a dropped one. Text is the kept
    pieces of the blocks, joined by newlines.

    Null or empty html, or a page without main text: empty text, 0. What a browser shows of malformed markup is read, with
    one simplification: formatting elements left open are not opened again in the next block.
    Repeated rows give repeated rows; other columns are not read.
    """
    spark = pages.sparkSession
    short_batches(spark, 256)
    shared = spark.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = extract_batch(b.column(2).to_pylist(), shared.value)
            text = ["\n".join(x) for x in blocks]
            columns = [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(x) for x in blocks], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.selectExpr(f"CAST(`{id_col}` AS bigint) AS page_id", f"CAST(`{url_col}` AS string) AS url", f"`{html_col}` AS html")
    return rows.mapInArrow(released(run), "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint")
