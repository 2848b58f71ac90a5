"""HTML extraction by tag-path ratios (operator 5).

Text length and punctuation are summed for each path of tags and class names from the root to a block, put
over the number of blocks on that path, smoothed along the page and fused. Evidence scales the ratio: names
of menus, notices, adverts, forms and comments, text that is mostly links, an article elsewhere. A path also takes
the best ratio of the containers around it, less with each one further out. Blocks on paths
whose score reaches a share of the page's best are the text; nothing else selects them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "select", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "head", "body", "main", "article", "section", "nav", "aside", "header", "footer", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6",
    "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "form", "fieldset", "blockquote", "pre",
    "figure", "figcaption", "address", "details", "summary", "dialog", "hgroup", "center", "hr",
}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"html", "body", "div", "article", "section", "main", "table", "ul", "ol", "dl", "blockquote", "td", "th", "nav", "aside", "header", "footer", "form"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "dialog", "head"}
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related",
    "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: The share of text, with that outside all marks, from which a marked region without an article is a wrapper.
WRAPPER = 0.8
#: What evidence leaves of a ratio: a name or an element of no main text, mostly links, an article elsewhere that holds half of the text.
MARKED, LINKED, BESIDE = 1e-3, 1e-2, 2e-2
#: What a path takes of the best ratio in its second container, and so on; the share of the page's best score that selects a path.
FURTHER, THRESHOLD = 0.25, 0.04
#: Shares below this can't select a path.
TINY = 1e-15
#: Weights of the path before, of a path and of the next one.
KERNEL = (0.1, 0.8, 0.1)
#: Elements that hold a part of a page; lists, tables and quotations belong to the part around them.
CONTAINERS = {"html", "body", "main", "article", "section", "div", "nav", "aside", "header", "footer", "form", "fieldset", "center", "details", "dialog"}
#: Beside a mark in one class, as in has-sidebar or menu-closed: the class tells of a state, not of what the element is.
STATES = {"has", "no", "with", "without", "open", "opened", "closed"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>""", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")


class Path:
    """A path of tags and class names from the root, linked to the one above it: as many objects as a page has different paths."""

    __slots__ = ("number", "above", "step", "container", "article", "below")

    def __init__(self, number: int, above: Path | None, step: str):
        self.number, self.above, self.step, self.below = number, above, step, {}
        tag = step.split(".")[0]
        #: The nearest container, itself included (the root stands for the page), and the outermost article or main.
        self.container = self if above is None or tag in CONTAINERS - {"html", "body"} else above.container
        self.article = (above.article if above else None) or (self if tag in ("article", "main") else None)


class Node:
    """An open block element, linked to its parent."""

    __slots__ = ("number", "tag", "parent", "path", "out", "named", "chain", "article")

    def __init__(self, number: int, tag: str, parent: Node | None, path: Path, mark: str):
        self.number, self.tag, self.parent, self.path = number, tag, parent, path
        self.named = mark == "named"
        #: Marked for good, it or a parent; the innermost node around, itself included, that is marked by name; within an article or main.
        self.out = mark == "out" or parent is not None and parent.out
        self.chain = self if self.named else parent.chain if parent else None
        self.article = tag in ("article", "main") or parent is not None and parent.article


class Block:
    """A text with the number of its characters in links, and the element around it (none at the page's top level)."""

    __slots__ = ("text", "linked", "node", "root")

    def __init__(self, text: str, linked: int, node: Node | None, root: Path):
        self.text, self.linked, self.node, self.root = text, min(linked, len(text)), node, root

    @property
    def place(self) -> Path:
        return self.node.path if self.node else self.root

    @property
    def out(self) -> bool:
        return self.node is not None and self.node.out

    @property
    def chain(self) -> Node | None:
        return self.node.chain if self.node else None

    @property
    def article(self) -> bool:
        return self.node is not None and self.node.article

    @property
    def path(self) -> tuple[str, ...]:
        """Its steps from the root on."""
        steps, at = [], self.place
        while at.above is not None:
            steps.append(at.step)
            at = at.above
        return tuple(reversed(steps))

    @property
    def named(self) -> tuple[int, ...]:
        """Numbers of the nodes around it that are marked by name, from the root on."""
        return _chained(self.chain)


def _chained(node: Node | None) -> tuple[int, ...]:
    out = []
    while node is not None:
        out.append(node.number)
        node = node.parent.chain if node.parent else None
    return tuple(reversed(out))


def _element(tag: str, attributes: str, inside: bool) -> tuple[str, str]:
    """An element's mark and its step in a path: the tag and the class names without digits.

    ``out``: a region that is never main text; ``named``: one by its name only, or a form; ``inside``: it stands in an article.
    """
    if not attributes:
        return _mark(tag, {}, inside), tag
    values = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attributes)}
    names = re.sub("[0-9]+", "", values.get("class", "").lower()).split()
    return _mark(tag, values, inside), ".".join([tag, *sorted(names)])


def _mark(tag: str, values: dict[str, str], inside: bool) -> str:
    if tag in OUTSIDE - {"form"} or tag == "header" and not inside:
        return "out"
    named = "named" if tag == "form" else ""
    if not values or tag in ("html", "body", "article", "main"):
        return named
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
        return "out"
    names = [set(re.split(r"[^a-z0-9]+", x)) for x in f"{values.get('class', '')} {values.get('id', '')}".lower().split()]
    return "named" if any(x & MARKS and not x & STATES for x in names) or values.get("role", "").lower() in ROLES else named


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """The page's blocks of text in order, and the tag of every node. Time is linear in the page, however broken or deep it is."""
    tags: list[str] = []
    stack: list[Node] = []  # open block elements
    opened: Counter[str] = Counter()  # by tag
    root = Path(-1, None, "")
    paths = 0
    found: list[Block] = []
    words: list[str] = []
    links: list[str] = []
    linked = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split()) if words else ""
        if text:
            found.append(Block(text, len(" ".join(html.unescape("".join(links)).split())), stack[-1] if stack else None, root))
        words.clear()
        links.clear()

    def close(names: set[str], scope: set[str]) -> None:
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in names:
                opened.subtract(x.tag for x in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    at, n = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends beyond: what looks like one there is text
    while at < n:
        m = _TAG.search(page, at, last) if at < last else None
        said = page[at : m.start()] if m else page[at:].partition("<!--")[0]
        words.append(said)
        if linked:
            links.append(said)
        if m is None or m[0].startswith("<!--") and not m[0].endswith("-->"):  # an unclosed comment holds the rest
            break
        at, ends, tag = m.end(), m[1], (m[2] or "").lower()
        if tag in RAW and not ends:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            words.append(" ")
        if tag == "a":
            linked = not ends
        if tag not in BLOCK and tag != "button":
            continue
        flush()
        linked = False
        if ends:
            close({tag}, set())
        else:
            if tag in BLOCK and tag not in ("html", "body") and stack and stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "head"):
                close({stack[-1].tag}, set())
            if tag == "body":
                close({"head"}, set())
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], SCOPES - {"td", "th"} if tag in ("tr", "td", "th") else SCOPES)
            if tag in VOID:
                continue
            parent = stack[-1] if stack else None
            mark, step = _element(tag, m[3], parent is not None and parent.article)
            above = parent.path if parent else root
            if step not in above.below:
                above.below[step] = Path(paths, above, step)
                paths += 1
            stack.append(Node(len(tags), tag, parent, above.below[step], mark))
            opened[tag] += 1
            tags.append(tag)
    flush()
    return found, tags


def wrappers(found: list[Block], tags: list[str]) -> set[int]:
    """Nodes marked by name that hold the bulk of the text, so that the name tells nothing.

    Comments may outweigh a short text: they are no wrapper unless they hold an article or nearly all of the page.
    """
    found = [b for b in found if not b.out]
    if all(b.chain for b in found) is False and any(b.article for b in found if not b.chain):
        return set()
    weight: dict[Node | None, int] = {None: 0}
    held: dict[Node | None, int] = {}
    for b in found:
        weight[b.chain] = weight.get(b.chain, 0) + len(b.text) - b.linked
        if b.article:
            held[b.chain] = held.get(b.chain, 0) + len(b.text)
    # An article or main in a wrapper: its text is not to be lost, whatever else the page has.
    most = max(held, key=lambda x: held[x]) if held else max(weight, key=lambda x: (weight[x], x is None))
    if most and (most in held or weight[most] >= WRAPPER * (weight[most] + weight[None])):
        return set(_chained(most))
    return set()


def path_scores(found: list[Block], tags: list[str]) -> list[float]:
    """The score of each block's path, as a share of the page's best; every block of a path has the same one.

    A path is that of its tags and class names, and whether it is marked. Where nothing is unmarked, all scores are 0.
    """
    forgiven = wrappers(found, tags)
    # nodes marked by name are all forgiven from the root down to the innermost forgiven one
    keys = [(b.place, b.out or b.chain is not None and b.chain.number not in forgiven) for b in found]
    paths = list(dict.fromkeys(keys))
    place = {p: i for i, p in enumerate(paths)}
    length, linked, marks, count = (np.zeros(len(paths)) for _ in range(4))
    for b, key in zip(found, keys, strict=True):
        i = place[key]
        length[i] += len(b.text)
        linked[i] += b.linked
        marks[i] += len(_PUNCTUATION.findall(b.text))
        count[i] += 1
    free = length - 0.9 * linked  # text in links tells little
    smooth = [np.convolve(np.pad(x / count, 1, mode="edge"), KERNEL, mode="valid") for x in (free, marks)]
    ratio = np.sqrt(smooth[0] * (smooth[1] + 0.1))
    out = np.array([o for _, o in paths])
    # Text by the outermost article or main around it: one that holds half of all makes the rest doubtful.
    around = [path.article for path, _ in paths]
    weight: dict[Path | None, float] = {}
    for a, x, o in zip(around, free, out, strict=True):
        weight[a] = weight.get(a, 0.0) + x * (not o)
    main = max((a for a in weight if a), key=lambda a: weight[a], default=None)
    if main and 2 * weight[main] < sum(weight.values()):
        main = None
    evidence = np.where(out, MARKED, 1.0)
    for i, a in enumerate(around):
        if main and a != main:
            evidence[i] *= BESIDE
        elif not a and linked[i] > length[i] / 2:
            evidence[i] *= LINKED
    own = ratio * evidence
    if out.all():
        return [0.0] * len(found)
    best: dict[Path, float] = {}
    for (path, _), x in zip(paths, own, strict=True):
        best[path.container] = max(best.get(path.container, 0.0), x)
    for c in sorted(_upwards(best), key=lambda c: -c.number):  # those below come first
        if c.above is not None:
            best[c.above.container] = max(best.get(c.above.container, 0.0), best.get(c, 0.0))
    score = own.copy()
    for i, (path, _) in enumerate(paths):
        share, c = 1.0, path.container
        if main and around[i] is main:  # within it nothing is lost, and no container's best exceeds that of those around it
            c = main
        while c is not None and share > TINY:
            score[i] = max(score[i], evidence[i] * share * best[c])
            share *= FURTHER
            c = c.above.container if c.above else None
    top = own[~out].max()
    return [float(score[place[key]] / top) if top else 0.0 for key in keys]


def _upwards(containers: Iterable[Path]) -> set[Path]:
    """The containers and all around them."""
    out: set[Path] = set()
    for c in containers:
        while c is not None and c not in out:
            out.add(c)
            c = c.above.container if c.above else None
    return out


def main_text(page: str | None) -> str:
    found, tags = blocks(page or "")
    return "\n".join(b.text for b, score in zip(found, path_scores(found, tags), strict=True) if score >= THRESHOLD) if found else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row ``(page_id, url, text, n_chars)`` for each row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
    joined by a line feed in page order. A null, empty or wholly marked page gives an empty text. Broken
    markup is read as browsers do: open elements end with their parents, unclosed comments and scripts
    with the page; a tag that nothing closes is text. Very long and deep pages take time in proportion. Repeated rows are read each. Only the id, ``url`` and ``html_col`` are read.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), "url", F.col(html_col).alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
