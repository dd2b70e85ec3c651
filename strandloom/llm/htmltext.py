"""Main text of web pages by tag-path ratios.

The visible text of a page is cut into blocks, each with the path of block
elements from the root down to it (inline markup doesn't count).  Text length
(links count against it) and punctuation are added up per path, as ratios to its
nodes and as shares of the page, smoothed along the page and fused into one
score.  Paths whose score passes a threshold are content, and their blocks are
kept wherever they stand.

What HTML itself marks as something else (elements, roles and class words of
menus, headers, footers, sidebars, forms, adverts, notices, comments) is
evidence: a marked path has to pass the best score of those that aren't, by the more the
less text it has, so a mark that only looks like one doesn't lose an article.  The element around the
heaviest content is the article; what belongs to it is kept but for marked blocks
and blocks that are mostly links, so that titles, short paragraphs and lists
inside it are not lost, as are headings right before content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"'<]")
_ATTR = re.compile(r"""(?<![^\s"'=<>/])([^\s"'=<>/]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "noframes", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "html head body article section main header footer nav aside div p ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre form fieldset figure figcaption address details summary h1 h2 h3 h4 h5 h6 hr br dialog menu "
    "center hgroup search option select optgroup button label legend datalist output".split()
)
#: Elements that are never article text, wherever they stand.
APART = set("head nav aside form fieldset footer dialog menu search select optgroup option button datalist".split())
#: Roles, and words of a class or an id, that mark such elements.
APART_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
APART_WORDS = set(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs masthead footer sidebar aside widget widgets related recommended recommendations share sharing social "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment "
    "comments commentlist respond reply replies discussion disqus pagination pager toolbar skip paywall teaser".split()
)
CONTAINERS = {"article", "main"}
AS_ARTICLE = 2.0
#: So many characters give a mark and a score the same say.
SUPPORT = 1000
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: p ends where one of these begins.
_ENDS_P = BLOCKS - {"br", "option", "select", "optgroup", "button", "label", "legend", "datalist", "output"}
_ENDS_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Block:
    __slots__ = ("path", "tags", "text", "linked", "apart")

    def __init__(self, path: tuple[str, ...], tags: tuple[str, ...], text: str, linked: int, apart: bool):
        self.path, self.tags, self.text, self.linked, self.apart = path, tags, text, linked, apart


def _marks(attrs: str) -> tuple[str, bool]:
    """The class for the path, and whether class, id or role sets the element apart."""
    kind, apart = "", False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in ("class", "id", "role"):
            continue
        if name == "role":
            apart |= value.strip().lower() in APART_ROLES
        else:
            if name == "class":
                kind = "." + ".".join(value.split()) if value.strip() else ""
            apart |= any(w.lower() in APART_WORDS for w in _WORD.findall(value))
    return kind, apart


def blocks_of(source: str) -> list[Block]:
    """The text blocks of a page, in order.  Broken and cut-off markup is read on."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, key in the path, apart
    pieces: list[str] = []
    links = linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(tuple(k for _, k, _ in stack), tuple(t for t, _, _ in stack), text, linked, bool(stack) and stack[-1][2]))
            pieces.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len("".join(text.split()))

    def close(name: str, within: set[str] | None = None) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == name:
                del stack[depth:]
                return
            if within and stack[depth][0] in within:
                return

    size = len(source)
    last = {quote: source.rfind(quote) for quote in "\"'"}

    def attributes(at: int) -> tuple[str, int]:
        """The attributes from there on, and where the tag ends: behind a > or before a < that no quotes
        hold.  A quote that nothing closes is a character like any other."""
        start = at
        while stop := _STOP.search(source, at):
            here, mark = stop.start(), stop[0]
            if mark in last:
                at = (source.find(mark, here + 1) if here < last[mark] else here) + 1
            else:
                return source[start:here], here + (mark == ">")
        return source[start:], size

    while at < size:
        token = _TOKEN.search(source, at)
        if not token:
            put(source[at:])
            break
        put(source[at : token.start()])
        at = token.end()
        if token["comment"]:
            end = source.find("-->", at)
            at = end + 3 if end >= 0 else size
            continue
        if token["other"]:
            end = source.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        name = token["name"].lower()
        attrs, at = attributes(at)
        if token["close"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                flush()
                close(name)
            continue
        if name in RAW:
            if not attrs.endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
            continue
        if name == "a":
            links = 1
        if name not in BLOCKS:
            # An inline element may be set apart as well, and then stands in the path.
            continue
        flush()
        if name in VOID:
            continue
        if name in _ENDS_P:
            close("p", {"td", "th", "button", "table"})
        if name in _ENDS_SAME:
            close(name, _ENDS_SAME[name])
            if name in ("dt", "dd"):
                close("dd" if name == "dt" else "dt", {"dl"})
        kind, apart = _marks(attrs) if attrs else ("", False)
        inside = any(t in CONTAINERS for t, _, _ in stack)
        apart = apart and name not in ("html", "body") or name in APART or name == "header" and not inside
        stack.append((name, name + kind, apart or bool(stack) and stack[-1][2]))
        if name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            links = 0
    flush()
    return out


def path_scores(blocks: list[Block], smooth: float = 1.0) -> dict[tuple[str, ...], float]:
    """The fused score of each path: text length times punctuation, each as the ratio to the path's
    nodes, smoothed along the page, times the path's share of the page, relative to the mean path."""
    paths = {b.path: i for i, b in enumerate(blocks)}
    paths = {p: i for i, p in enumerate(paths)}
    of = np.array([paths[b.path] for b in blocks])
    nodes = np.bincount(of, minlength=len(paths))
    lengths = np.array([max(0, len(b.text) - 2 * b.linked) for b in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) * (len(b.text) > 2 * b.linked) for b in blocks], float)
    weights = np.exp(-0.5 * (np.arange(-2, 3) / smooth) ** 2)
    fused = np.ones(len(paths))
    for values in (lengths, marks):
        total = np.bincount(of, values, len(paths))
        along = np.convolve((total / nodes)[of], weights / weights.sum(), "full")[2 : 2 + len(of)]
        ratio = np.bincount(of, along, len(paths)) / nodes
        fused *= (ratio / max(ratio.mean(), 1e-9) + 0.05) * (total / max(total.mean(), 1e-9) + 0.05)
    return {p: float(fused[i] * (lengths[of == i].sum() > 0)) for p, i in paths.items()}


def content_blocks(blocks: list[Block], threshold: float = 0.1) -> list[Block]:
    """The blocks of the article.  threshold: in standard deviations of the paths' scores."""
    if not blocks:
        return []
    scores = path_scores(blocks)
    marked = {b.path for b in blocks if b.apart}
    plain = {p: s for p, s in scores.items() if p not in marked}
    # Where class words mark all that is left, they tell nothing; elements do.
    plain = plain or {b.path: scores[b.path] for b in blocks if not APART & set(b.tags) and not ("header" in b.tags and not CONTAINERS & set(b.tags))}
    if not plain:
        return []
    # Evidence for an article counts like evidence against one.
    bar = max(s * (AS_ARTICLE if any(k.split(".")[0] in CONTAINERS for k in p) else 1.0) for p, s in plain.items())
    # The score of a marked path counts the more the more text it rests on.
    total = dict.fromkeys(scores, 0)
    for b in blocks:
        total[b.path] += len(b.text)
    held = {p: (total[p] / (total[p] + SUPPORT)) ** 2 if p in marked else 1.0 for p in scores}
    sound = {p: s for p, s in scores.items() if p in plain or s * held[p] >= bar > 0}
    values = np.array(list(sound.values()))
    floor = min(values.max(), threshold * values.std())
    chosen = {p for p, s in sound.items() if s > 0 and s >= floor}
    if not chosen:
        return []
    weight: dict[tuple[str, ...], float] = {}
    for b in blocks:
        if b.path in chosen:
            depth = next((d + 1 for d, t in enumerate(b.tags) if t in CONTAINERS), max(0, len(b.path) - 1))
            home = b.path[:depth]
            article = any(k.split(".")[0] in CONTAINERS for k in home)
            weight[home] = weight.get(home, 0.0) + scores[b.path] * len(b.text) * (AS_ARTICLE if article else 1.0)
    home = max(weight.items(), key=lambda x: (x[1], x[0]))[0]
    linked: dict[tuple[str, ...], list[int]] = {}
    for b in blocks:
        pair = linked.setdefault(b.path, [0, 0])
        pair[0] += b.linked
        pair[1] += len(b.text.replace(" ", ""))
    menus = {p for p, (a, n) in linked.items() if 2 * a > n}
    sure = any(k.split(".")[0] in CONTAINERS for k in home)
    outer = sum(b.path[: len(home)] == home and b.apart for b in blocks) == sum(b.path[: len(home)] == home for b in blocks)

    def near(b: Block) -> bool:
        inside = b.path[: len(home)] == home
        return inside and (outer or not b.apart) and (b.path not in menus or sure and b.tags[-1] in HEADINGS)

    keep = [b.path in chosen or near(b) for b in blocks]
    # A heading elsewhere belongs to the content that follows it below its parent.
    follows: Block | None = None
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if keep[i]:
            follows = b
        elif follows and b.tags and b.tags[-1] in HEADINGS and b.path not in menus and not b.apart and follows.path[: len(b.path) - 1] == b.path[:-1]:
            keep[i] = True
    return [b for b, k in zip(blocks, keep) if k]


def extract(source: str | None) -> str:
    """The main text: blocks in page order, joined by one space; empty if there is none."""
    return " ".join(b.text for b in content_blocks(blocks_of(source or "")))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars.  A null page counts as empty
    and gives an empty text; repeated ids keep their rows.  No shuffle."""
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
