"""Main text of web pages by tag-path ratios.

Every block of text has the path of block tags from the root to it, with words of class, id and role as part of it. Per
path, text length outside links and punctuation are summed over its blocks; their ratios are those to the number of
parents that hold such blocks, so that an article, whose blocks share a parent, stands above notices, teasers and
comments, which come one by one. Ratios are fused to one value, smoothed along the page between blocks that belong
together, and blocks whose path reaches a share of the page's mean are content.

Blocks belong together when one lies within the other's parent: headings, lists, quotes and tables (by their tags) then
take half of the higher value of the nearest such block before and after, others half of the lower, so that a list at the
end of an article stays and a box at its end does not. A first heading that stands right before the content belongs to it.

Elements that are no text by their tag (menus, forms, buttons, asides, footers, page headers) weigh nothing; words of
class, id or role that name such a thing lower a path's value. Neither counts for html, body, main and article, nor for
an element with most of the page's text, so that no name can delete an article.

Null pages count as empty and give an empty text, as do pages without any text outside such elements. Very long pages are
taken whole, in time proportional to their length. Each row stands for itself; repeated rows and ids give repeated
results. All columns of the input stay; the result is the column main_text, which replaces one of that name.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import MARK, table, whole

#: Share of the page's mean fused value from which a block is content.
THRESHOLD = 0.3
#: What a telling name leaves of a value, and the share of the page's unlinked text from which an element's names and
#: tag are not believed.
NAMED, WRAPPER = 0.02, 0.7
#: Ancestors among which a block looks for others that it belongs to.
REACH = 32

# HTML's elements by kind.
_RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo "
    "mrow mfrac msup msub msqrt mtext semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("svg select object audio video canvas template noscript datalist annotation".split())
_ASIDE_TAGS = frozenset("nav footer aside form button dialog menu head fieldset".split())
_NEVER_ASIDE = frozenset("html body main article".split())
_TEXTUAL = frozenset(
    "h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption section header hgroup details summary center "
    "address".split()
)
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent cookie cookies footer "
    "login menu modal nav navbar navigation newsletter notice pagination popup promo related reply replies search share sharing "
    "sidebar signup social sponsor sponsored subscribe widget contentinfo".split()
)
# An opening tag of the key ends an open element of the values.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split()
)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？、]")

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|</?[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-zA-Z]+")


@dataclass(eq=False)
class Element:
    tag: str
    words: tuple[str, ...] = ()
    parent: Element | None = None
    #: The path as a number, the same for the same path.
    path: int = 0
    hidden: bool = False
    #: Characters outside links in it, and whether it or a parent is no part of an article by tag; what names leave of it.
    text: int = 0
    aside: bool = False
    value: float = 1.0


@dataclass(eq=False)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def _named(attrs: str) -> tuple[str, ...]:
    return tuple(w.lower() for m in _NAMED.finditer(attrs) for w in _PART.findall(m[1] or m[2] or m[3] or ""))


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Runs of text within one block element, and the elements, both in page order."""
    root = Element("")
    out, elements, stack = [], [root], [root]
    paths: dict[tuple, int] = {}
    links, current, at = 0, None, 0

    def put(text: str) -> None:
        nonlocal current
        if not text or stack[-1].hidden:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(stack[-1])
            out.append(current)
        current.parts.append(text)
        current.linked += len(text) if links else 0

    def innermost(tags, stop=()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in stop:
                break
        return 0

    for m in _TOKEN.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag == "wbr":
            put(" ")
        elif tag in _INLINE:
            links = max(0, links + (-1 if m["close"] else 1)) if tag == "a" else links
        elif m["close"]:
            if k := innermost({tag}):
                # What is hidden within a block does not end it.
                if not stack[k].hidden:
                    current, links = None, 0
                del stack[k:]
        else:
            above = stack[-1]
            hidden = above.hidden or tag in _HIDDEN
            if hidden and (tag in _VOID or m["attrs"].endswith("/")):
                continue
            if not hidden:
                current, links = None, 0
                if tag in _ENDS_P and (k := innermost({"p"}, {"td", "th", "li", "button"})):
                    del stack[k:]
                if tag in _ENDS and (k := innermost(_ENDS[tag], {"ul", "ol", "dl", "table"})):
                    del stack[k:]
                if tag in _VOID:
                    continue
                above = stack[-1]
            words = () if hidden else _named(m["attrs"])
            stack.append(Element(tag, words, above, paths.setdefault((above.path, tag, words), len(paths) + 1), hidden))
            elements.append(stack[-1])
    put(page[at:])
    return out, elements


def _judge(found: list[tuple[Block, str]], elements: list[Element]) -> None:
    """Which elements are no part of an article by their tag, and what their names leave of their text."""
    for block, text in found:
        block.element.text += max(0, len(text) - block.linked)
    for e in reversed(elements[1:]):
        e.parent.text += e.text
    most = WRAPPER * elements[0].text
    inside = {id(elements[0]): False}
    for e in elements[1:]:
        above = e.parent
        inside[id(e)] = inside[id(above)] or e.tag in ("article", "main")
        e.aside, e.value = above.aside, above.value
        if e.tag in _NEVER_ASIDE or (e.text >= most and e.text > 0 and e.tag != "nav"):
            continue
        e.aside = e.aside or e.tag in _ASIDE_TAGS or (e.tag == "header" and not inside[id(e)])
        if e.value == 1 and not _ASIDE_WORDS.isdisjoint(e.words):
            e.value = NAMED


def path_values(found: list[tuple[Block, str]]) -> list[float]:
    """The fused ratio of each block's path: characters outside links per parent, times a measure of punctuation per
    parent, times the share outside links."""
    length, marks, linked = (defaultdict(float) for _ in range(3))
    parents: dict[int, set[int]] = defaultdict(set)
    for block, text in found:
        path = block.element.path
        length[path] += len(text)
        marks[path] += len(_PUNCTUATION.findall(text))
        linked[path] += min(block.linked, len(text))
        parents[path].add(id(block.element.parent))
    fused = {}
    for path, n in ((p, len(x)) for p, x in parents.items()):
        own = 1 - linked[path] / length[path]
        fused[path] = own * own * (length[path] / n) * math.log(2 + marks[path] / n)
    return [fused[block.element.path] for block, _ in found]


def _nearest(found: list[tuple[Block, str]]) -> list[tuple[int, bool]]:
    """Of each block the nearest one before it, of another path, in whose parent it lies, or -1; and whether all tags on the
    way to it are textual."""
    # Of each parent its last block, and the last one before that of another path.
    last: dict[int, tuple[int, int]] = {}
    out = []
    for k, (block, _) in enumerate(found):
        best, textual, best_textual, e, path = -1, True, False, block.element, block.element.path
        for _ in range(REACH):
            if e is None:
                break
            textual = textual and e.tag in _TEXTUAL
            at, other = last.get(id(e.parent), (-1, -1))
            if at >= 0 and found[at][0].element.path == path:
                at = other
            if at > best:
                best, best_textual = at, textual
            e = e.parent
        out.append((best, best_textual))
        at, other = last.get(id(block.element.parent), (-1, -1))
        last[id(block.element.parent)] = (k, other if at >= 0 and found[at][0].element.path == path else at)
    return out


def smoothed(found: list[tuple[Block, str]], values: list[float]) -> list[float]:
    """Half of each value and half of that of the blocks it belongs to."""
    before = _nearest(found)
    after = [(len(found) - 1 - k if k >= 0 else -1, t) for k, t in reversed(_nearest(found[::-1]))]
    out = []
    for k, value in enumerate(values):
        sides = [(values[j] if j >= 0 else 0.0, textual and j >= 0) for j, textual in (before[k], after[k])]
        lent = max((v for v, textual in sides if textual), default=0.0)
        lent = max(lent, min(v for v, _ in sides))
        out.append(max(value, (value + lent) / 2))
    return out


def content(found: list[tuple[Block, str]]) -> list[bool]:
    """Which of a page's blocks are content, by the values of their paths."""
    values = path_values(found)
    own = [1 - min(block.linked, len(text)) / len(text) for block, text in found]
    weights = [block.element.value for block, _ in found]
    smooth = [v * w * (x > 0.5) for v, w, x in zip(smoothed(found, values), weights, own)]
    total = sum(len(text) * w for (_, text), w in zip(found, weights))
    mean = sum(v * w * len(text) * w for (_, text), v, w in zip(found, values, weights)) / max(total, 1)
    chosen = [v >= THRESHOLD * mean and v > 0 for v in smooth]
    for k in range(len(found) - 1):
        if chosen[k + 1]:
            block = found[k][0]
            chosen[k] = chosen[k] or (block.element.tag in ("h1", "h2") and weights[k] == 1 and own[k] > 0.5)
            break
    return chosen


def main_text(page: str) -> str:
    """The article's blocks in page order, one per line."""
    found, elements = blocks(page)
    found = [(b, t) for b in found if (t := b.text())]
    _judge(found, elements)
    found = [(b, t) for b, t in found if not b.element.aside]
    return "\n".join(t for (_, t), kept in zip(found, content(found)) if kept)


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of pages with main_text, from the whole html."""

    @F.pandas_udf("string")
    def main_texts(batch: pd.Series) -> pd.Series:
        return batch.map(main_text)

    return pages.withColumn("main_text", main_texts(whole(html)))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = extract_main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    text = f"{MARK}text"
    # A name of its own, so that the Python result is worked out once for both columns.
    return pages.select("page_id", "url", F.col("main_text").alias(text)).select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("long").alias("n_chars"))
