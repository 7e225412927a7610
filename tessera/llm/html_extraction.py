"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks: runs of text that no block-level tag divides, in page order. A block's features are the
tags and the class, id and role words of its ancestors and buckets of its own text's looks (length, share of link text,
marks, place). The field has two labels, main text or not; neighbours are tied by weights that depend on whether both blocks
stand in the same part of the page. Viterbi's best label sequence decides, block by block.

It is trained on labelled pages: pages whose markup names the article (`article`, `main`) label themselves, and the same
texts are laid out anew, label by label, in varied layouts with and without such names, with menus, notices, forms, adverts,
sidebars and readers' comments around and inside. At most `PAGES` pages of at most `PAGE_CHARS` characters are taken for that,
chosen by a hash; extraction itself reads every page whole.

A null or empty page, or one without main text, gives the empty string. Scripts, styles, comments, templates and all of
`head` are no text. References are decoded once. Any Unicode white space inside a block becomes one space; blocks are joined
by an empty line. Repeated rows and null ids are rows of their own. Other columns are ignored. An empty table gives no rows; without pages to
learn from, the layouts are filled with stand-in words. A page is parsed by one task in time and memory that grow with its
length.
"""

from __future__ import annotations

import html as references
import random
import re
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = 240
PAGE_CHARS = 100_000
WIDTH = 1 << 13  # hashed features
CHAIN = 120  # blocks of a training page that are taken, from a place that the page's hash chooses
LAYOUTS = 1200  # pages that the sample is laid out into

_TAG = re.compile(
    r"""<(?:(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^">]*+"|'[^'>]*+'|"[^"]{0,4096}+"|'[^']{0,4096}+'|["'])*+)>"""
    r"""|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {"script", "style", "title", "textarea", "template", "noscript", "iframe", "noembed", "noframes", "xmp", "svg", "math", "object"}
_VOID = {"br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "param", "source", "track", "hr", "keygen", "frame"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img input".split()
)
_CLOSES = {  # a start tag ends open elements of these names, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}
_IN_P = {"button", "table", "td", "th", "caption", "object"}  # an open paragraph outside of these stays open


class Element:
    """An open element: its tag and the hashed features of itself and all around it; names: those that tell parts of a page."""

    __slots__ = ("tag", "features", "names", "score")

    def __init__(self, tag: str, above: Element | None, own: list[str]):
        around, names = (above.features, above.names) if above else (frozenset(), frozenset())
        new = [x for x in map(_hashed, own) if x not in around]
        telling = [_hashed(x) for x in own if x not in _PLAIN]
        self.tag, self.features, self.score = tag, around.union(new) if new else around, None
        self.names = names if names.issuperset(telling) else names.union(telling)

    def tie(self, before: Element) -> int:
        """0: another part of the page, 1: alike in all features, 2: the same part with other tags."""
        return 1 if self.tag == before.tag and self.features == before.features else 2 if self.names == before.names else 0


_PLAIN = {f"tag={x}" for x in "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th div center body html".split()}


@lru_cache(maxsize=1 << 16)
def _hashed(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % WIDTH


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    links: int  # characters within links


def _names(attributes: str) -> list[str]:
    out = []
    for kind, *values in _ATTRIBUTE.findall(attributes):
        for word in _WORD.findall(_HUMP.sub(" ", "".join(values)).lower())[:20]:
            out.append(f"{kind.lower() if kind.lower() in ('role', 'itemprop') else 'name'}={word.removesuffix('s') or word}")
    return out


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks in page order, by the rules for omitted and misplaced end tags."""
    html = html or ""
    out: list[Block] = []
    stack = [Element("#page", None, [])]
    opened: dict[str, int] = {}
    pieces: list[tuple[str, bool]] = []
    linked = False

    def flush():
        if pieces:
            text = " ".join("".join(x for x, _ in pieces).split())
            if text:
                out.append(Block(text, stack[-1], sum(len(" ".join(x.split())) for x, a in pieces if a)))
            pieces.clear()

    def pop_to(names: set[str], stop: set[str]):
        """Ends the innermost open element of these names, unless one of `stop` stands inside it."""
        if not any(opened.get(n) for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                flush()
                for e in stack[k:]:
                    opened[e.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    def say(text: str):  # text ends an open head, and so do elements that have no place in one
        if text and opened.get("head") and not text.isspace():
            pop_to({"head"}, set())
        if text and not opened.get("head"):
            pieces.append((references.unescape(text) if "&" in text else text, linked))

    at = 0
    while True:
        found = _TAG.search(html, at)
        if not found:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["end"]:
            if name == "a":
                linked = False
            elif name == "br":
                say(" ")
            elif name not in _INLINE:
                flush()  # a stray end tag divides text, too
                pop_to({name}, _IN_P if name == "p" else {"td", "th"} if name not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html") else set())
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            if name not in ("svg", "math"):
                flush()
            continue
        if name in _INLINE:
            if name == "a":
                linked = True
            elif name == "br":
                say(" ")
            continue
        flush()
        linked = False
        if opened.get("p"):
            pop_to({"p"}, _IN_P)
        if name in _CLOSES:
            pop_to(*_CLOSES[name])
        if name in _VOID:
            continue
        if opened.get("head"):
            pop_to({"head"}, set())
        own = [f"tag={name}", *_names(found["attributes"])]
        stack.append(Element(name, stack[-1], own))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def _bucket(n: int) -> int:
    return min(int(n).bit_length(), 12)


def looks(block: Block, at: int, n: int) -> list[str]:
    """Features of the block's own text and place."""
    text = block.text
    words = text.count(" ") + 1
    share = block.links / len(text)
    return [
        "bias", f"own={block.element.tag}", f"words={_bucket(words)}", f"chars={_bucket(len(text))}", f"links={min(int(4 * share + 0.5), 4)}", f"wordlinks={_bucket(words)},{share > 0.5}",
        f"ends={text[-1] if text[-1] in '.!?:;…»”)' else 'a' if text[-1].isalpha() else 'x'}", f"commas={_bucket(text.count(','))}",
        f"mark={text[0] in '©®'}{'©' in text or '|' in text or '·' in text}", f"digits={int(10 * sum(map(str.isdigit, text[:400])) / min(len(text), 400))}",
        f"first={min(at, 3)}", f"last={min(n - 1 - at, 3)}", f"part={8 * at // n}",
    ]


def chain(page: list[Block]) -> tuple[list[list[int]], list[int]]:
    """Feature numbers of every block, and how it is tied to the one before."""
    rows = [[*map(_hashed, looks(b, k, len(page))), *b.element.features] for k, b in enumerate(page)]
    ties = [0, *(b.element.tie(a.element) for a, b in zip(page, page[1:]))]
    return rows, ties


@dataclass
class Model:
    weights: list[float]  # of every feature, for main text against the rest
    ties: list[list[list[float]]]  # [kind of tie][label before][label]


def labels(page: list[Block], model: Model) -> list[int]:
    """The most probable label sequence, by Viterbi."""
    if not page:
        return []
    w, back, here = model.weights, [], None
    for k, b in enumerate(page):
        e = b.element
        if e.score is None:
            e.score = sum(w[f] for f in e.features)
        score = e.score + sum(w[_hashed(f)] for f in looks(b, k, len(page)))
        if here is None:
            here = (0.0, score)
        else:
            t = model.ties[e.tie(page[k - 1].element)]
            low = [here[0] + t[0][0], here[1] + t[1][0]]
            high = [here[0] + t[0][1], here[1] + t[1][1]]
            back.append((int(low[1] > low[0]), int(high[1] > high[0])))
            here = (max(low), score + max(high))
    out = [int(here[1] > here[0])]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def main_text(html: str | None, model: Model) -> str:
    page = blocks(html)
    return "\n\n".join(b.text for b, label in zip(page, labels(page, model)) if label)


# Training

NAMED = {"article", "main"}
APART = {"nav", "header", "footer", "aside", "form", "menu", "select", "button", "dialog", "fieldset"}
APART_NAMES = ("ad", "advert", "comment", "notice", "sidebar", "menu", "cookie", "footer", "share", "related", "newsletter")


def self_labelled(page: list[Block]) -> list[int] | None:
    """Labels from markup that names the article; None if nothing does."""
    inside, outside = {_hashed(f"tag={x}") for x in NAMED}, {_hashed(f"tag={x}") for x in APART} | {_hashed(f"name={x}") for x in APART_NAMES}
    out = [int(bool(b.element.features & inside) and not b.element.features & outside) for b in page]
    return out if any(out) and not all(out) else None


KINDS = {  # names that sites give to parts of a page
    "menu": ["nav", "menu", "navbar", "navigation", "topbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc"],
    "header": ["header", "masthead", "site-header", "page-header", "branding", "logo", "top"],
    "footer": ["footer", "site-footer", "copyright", "legal", "colophon", "bottom", "credits"],
    "sidebar": ["sidebar", "side-bar", "widget", "aside", "rail", "related", "recommended", "popular", "trending", "more-stories", "tags", "archive"],
    "notice": ["notice", "cookie", "cookies", "consent", "banner", "alert", "gdpr", "popup", "modal", "paywall", "announcement", "message", "warning", "overlay"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "teaser", "offer", "ad-slot"],
    "form": ["newsletter", "subscribe", "signup", "search", "login", "contact", "search-form", "register"],
    "comments": ["comments", "comment", "comment-list", "disqus", "replies", "responses", "discussion", "reply", "user-comments", "reader-comments"],
    "share": ["share", "social", "sharing", "follow", "buttons", "toolbar", "print"],
}
HOMES = ["content", "post", "entry", "article", "story", "main", "body", "text", "entry-content", "post-body", "article-body", "main-content", "page", "single", "hentry"]


def laid_out(texts: list[str], words: list[str], pick: random.Random) -> tuple[str, list[int]]:
    """A page around these paragraphs and the label of each of its blocks."""
    parts: list[str] = []
    marks: list[int] = []
    say = lambda k: " ".join(pick.choice(words) for _ in range(k))
    prose = lambda: pick.choice(texts)[: pick.choice([60, 200, 600])] + pick.choice([".", "", "!"])

    def named(kind: str) -> str:
        name = pick.choice(KINDS[kind])
        return pick.choice([f' class="{name}"', f' class="{name} {say(1)[:8]}"', f' id="{name}"', f" class='{pick.choice(['block', 'box', 'section', 'wrap'])}-{name}'"])

    def put(text: str, mark: int, tag: str = "p"):
        if text.split():
            inner = references.escape(text) if pick.random() < 0.7 else text.replace("&", "&amp;").replace("<", "&lt;")
            if pick.random() < 0.1:
                inner = f"<b>{inner}" + ("</b>" if pick.random() < 0.5 else "")
            parts.append(f"<{tag}>{inner}" + ("" if tag in ("p", "li") and pick.random() < 0.2 else f"</{tag}>"))
            marks.append(mark)

    def items(k: int, link: float = 0.95):
        parts.append("<ul>")
        for _ in range(k):
            word = say(pick.randint(1, 4))
            parts.append(f'<li><a href="/x">{references.escape(word)}</a></li>' if pick.random() < link else f"<li>{references.escape(word)}</li>")
            marks.append(0)
        parts.append("</ul>")

    def part(kind: str):
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        bare = pick.random()
        tag = tag if bare < 0.5 else "div"
        name = named(kind) if tag in ("div", "section") or pick.random() < 0.4 else ""
        role = {"menu": ' role="navigation"', "footer": ' role="contentinfo"', "form": ' role="search"'}.get(kind, "") if pick.random() < 0.15 else ""
        parts.append(f"<{tag}{name}{role}>")
        if kind == "menu":
            items(pick.randint(1, 8))
        elif kind == "header":
            put(say(2), 0, pick.choice(["h1", "div", "p", "h2"]))
            if pick.random() < 0.5:
                items(pick.randint(2, 6))
        elif kind == "footer":
            if pick.random() < 0.4:
                items(pick.randint(2, 5))
            put(pick.choice(["© ", "(c) ", "", "Copyright "]) + pick.choice([say(3), prose()]), 0, pick.choice(["p", "div", "small-print"]))
        elif kind == "sidebar":
            put(say(2), 0, pick.choice(["h3", "h2", "h4"]))
            if pick.random() < 0.6:
                items(pick.randint(2, 6))
            if pick.random() < 0.6:
                put(prose(), 0)
        elif kind in ("notice", "advert"):
            for _ in range(pick.randint(1, 2)):
                put(prose(), 0, pick.choice(["p", "div", "h4"]))
        elif kind == "form":
            put(say(3), 0, pick.choice(["p", "h3", "div", "legend"]))
            if pick.random() < 0.4:
                put(prose(), 0)
            parts.append('<input type="text" name="q"><select><option>')
            for _ in range(2):
                parts.append(say(1) + "<option>")
                marks.append(0)
            parts.append("</select>")
            put(say(1), 0, "button")
        elif kind == "comments":
            put(say(2), 0, pick.choice(["h3", "h2"]))
            for _ in range(pick.randint(1, 4)):
                parts.append(pick.choice(['<div class="comment">', "<div>", '<article class="comment">', "<li>"]))
                put(say(2), 0, pick.choice(["span-name", "cite-name", "h4", "div"]))
                put(prose(), 0)
                parts.append("</div>")
        else:
            items(pick.randint(2, 4))
        parts.append(f"</{tag}>")

    around = ["menu", "sidebar", "notice", "advert", "form", "share", "comments"]
    parts.append("<html><head><title>t</title></head><body>")
    alone = pick.random() < 0.15  # nothing around the article
    wrapped = pick.random() < 0.5
    if wrapped:
        parts.append(f'<div class="{pick.choice(["page", "wrapper", "container", "site", "layout"])}">')
    for kind in ["header", "menu", *pick.sample(around, pick.randint(0, 3))]:
        if not alone and pick.random() < 0.8:
            part(kind)
    home = pick.random()
    tag, name = ("article", "") if home < 0.3 else ("main", "") if home < 0.4 else ("div", f' {pick.choice(["class", "id"])}="{pick.choice(HOMES)}"') if home < 0.9 else ("div", "")
    parts.append(f"<{tag}{name}>")
    if pick.random() < 0.6:
        put(texts[0][:60], 1, pick.choice(["h1", "h1", "h2"]))
    for k, text in enumerate(texts):
        kind = pick.random()
        put(text, 1, "p" if kind < 0.8 else pick.choice(["blockquote", "h2", "h3", "pre", "li", "div", "figcaption", "td"]))
        if pick.random() < 0.2:
            part(pick.choice(["advert", "share", "sidebar", "form", "notice", "advert"]))
    if pick.random() < 0.4:
        part("comments")
    parts.append(f"</{tag}>")
    for kind in [*pick.sample(around, pick.randint(0, 3)), "footer"]:
        if not alone and pick.random() < 0.85:
            part(kind)
    return "".join(parts), marks


def training_pages(htmls: list[str], *, layouts: int = LAYOUTS, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages: those that label themselves, and their texts in other layouts."""
    out = []
    stock = [f"w{k} " * (1 + k % 9) for k in range(40)]
    htmls = htmls or [""]
    for at, html in enumerate(htmls):
        pick = random.Random(seed * 1_000_003 + at)
        page = blocks(html)
        own = self_labelled(page)
        if own:
            out.append((page, own))
        texts = [b.text for b, mark in zip(page, own or [1] * len(page)) if mark][:40] or pick.sample(stock, 12)
        words = [w for b in page[:60] for w in b.text.split()[:40]] or ["word"]
        for _ in range(-(-layouts // len(htmls))):
            some = pick.sample(texts, min(len(texts), pick.randint(1, 12)))
            html, marks = laid_out(some, words, pick)
            made = blocks(html)
            if len(made) == len(marks):  # words that are marks alone may leave no block
                out.append((made, marks))
    return out


def fit_field(pages: list[tuple[list[Block], list[int]]], *, steps: int = 200, rate: float = 0.1, ridge: float = 3e-4) -> Model:
    """Penalised likelihood by full-batch steps; sums over all label sequences run forward and backward over all pages at once."""
    rows, ties, marks = [], [], []
    for at, (page, own) in enumerate(pages):
        r, t = chain(page)
        begin = (at * 7919) % max(len(r) - CHAIN + 1, 1)
        rows.append(r[begin : begin + CHAIN])
        ties.append([0, *t[begin + 1 : begin + CHAIN]])
        marks.append(own[begin : begin + CHAIN])
    n, long = len(rows), max(map(len, rows))
    size = np.array([len(r) for r in rows])
    flat = np.array([f for r in rows for b in r for f in b])
    counts = np.array([len(b) for r in rows for b in r])
    heads = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(long)[None, :] < size[:, None]
    tie, y = np.zeros((n, long), dtype=np.int64), np.zeros((n, long))
    tie[inside], y[inside] = np.concatenate(ties), np.concatenate(marks)
    w, t = np.zeros(WIDTH), np.zeros((3, 2, 2))
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, t)]
    pair = inside[:, 1:]
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (tie[:, 1:][pair], y[:, :-1][pair].astype(int), y[:, 1:][pair].astype(int)), 1)
    for step in range(1, steps + 1):
        emit = np.zeros((n, long, 2))
        emit[..., 1][inside] = np.add.reduceat(w[flat], heads)
        step_scores = t[tie] * 1.0  # [page, place, before, label]
        ahead, behind = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        ahead[:, 0] = emit[:, 0]
        for k in range(1, long):
            ahead[:, k] = emit[:, k] + np.logaddexp(ahead[:, k - 1, :1] + step_scores[:, k, 0], ahead[:, k - 1, 1:] + step_scores[:, k, 1])
        for k in range(long - 2, -1, -1):
            x = emit[:, k + 1] + behind[:, k + 1]
            value = np.logaddexp(step_scores[:, k + 1, :, 0] + x[:, :1], step_scores[:, k + 1, :, 1] + x[:, 1:])
            behind[:, k] = np.where(inside[:, k + 1, None], value, 0.0)
        total = np.logaddexp(ahead[:, 0, 0] + behind[:, 0, 0], ahead[:, 0, 1] + behind[:, 0, 1])
        chance = np.exp(np.minimum(ahead[..., 1] + behind[..., 1] - total[:, None], 0.0))
        slope = np.bincount(flat, weights=(y - chance)[inside][owner], minlength=WIDTH) / n - ridge * w
        both = ahead[:, :-1, :, None] + step_scores[:, 1:] + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, tie[:, 1:][pair], np.exp(np.minimum(both[pair], 0.0)))
        for v, g, (m, s) in zip((w, t), (slope, (seen - expected) / n - ridge * t), state):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(w.tolist(), t.tolist())


def sample(pages: DataFrame, *, limit: int = PAGES, chars: int = PAGE_CHARS) -> list[str]:
    """At most `limit` distinct pages of at most `chars` characters, chosen by a hash."""
    short = pages.where(F.length("html").between(1, chars)).select(F.xxhash64("html").alias("h")).distinct()
    chosen = [r["h"] for r in short.orderBy("h").limit(limit).collect()]
    rows = pages.where(F.length("html").between(1, chars)).select(F.xxhash64("html").alias("h"), "html").where(F.col("h").isin(chosen)).dropDuplicates(["h"]).collect()
    return [r["html"] for r in sorted(rows, key=lambda r: r["h"])]


def fit(pages: DataFrame, *, limit: int = PAGES, chars: int = PAGE_CHARS, layouts: int = LAYOUTS) -> Model:
    return fit_field(training_pages(sample(pages, limit=limit, chars=chars), layouts=layouts))


def _extract(model: Model):
    def run(batches):
        for batch in batches:
            texts, done, held = [], 0, 0
            for html in batch.column("html"):
                texts.append(main_text(html.as_py(), model))
                held += len(texts[-1])
                if held > 1 << 22:
                    yield _rows(batch, done, texts)
                    done, texts, held = done + len(texts), [], 0
            if texts:
                yield _rows(batch, done, texts)

    return run


def _rows(batch: pa.RecordBatch, done: int, texts: list[str]) -> pa.RecordBatch:
    keys = [batch.column(c).slice(done, len(texts)) for c in ("page_id", "url")]
    return pa.RecordBatch.from_arrays([*keys, pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
