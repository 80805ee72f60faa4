"""Wiki pages: fields of the page XML, plain text of the markup, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpulse.functions.names import strip

# The dump's tags, the English markers and the clean-up patterns.
TEXT_TAG = '<text xml:space="preserve">'
REDIRECT_MARKERS = ("#REDIRECT", "#redirect")
DISAMBIGUATION = r"(?i)\{\{disambig\w*\}\}"
STUB_TEMPLATE = "stub}}"
STUB_PAGE = "Wikipedia:Stub"
LANGUAGE = "en"
LANGUAGE_LINK = r"\[\[[a-z\-]+:[^\]]+\]\]"
REFERENCE = r"<ref>.*?</ref>"
COMMENT = r"(?s)<!--.*?-->"
WEB_ADDRESS = r"http://[^ <]+"
TEMPLATE = r"\{\{.*?\}\}"
TAG = r"<[^!][^>]*>"

# Our own patterns for the render step: links, outer links, emphasis, headings, list marks.
_RENDER = (
    (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"),
    (r"\[\[([^\[\]]*)\]\]", "$1"),
    (r"\[https?://[^ \]]+ ([^\]]*)\]", "$1"),
    (r"'{2,5}", ""),
    (r"(?m)^=+ *(.*?) *=+ *$", "$1"),
    (r"(?m)^[*#:;]+ *", ""),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _between(text: Column, start: str, end: str) -> Column:
    """Text between the first ``start`` and the next ``end``; null when there is none."""
    opening = F.locate(start, text)
    rest = F.substring(text, opening + len(start), F.length(text))
    closing = F.locate(end, rest)
    return F.when((opening > 0) & (closing > 0), F.substring(rest, F.lit(1), closing - 1))


def decode_entities(text: Column | str) -> Column:
    """HTML entities to characters, through the text library on Spark's class path."""
    text = _col(text)
    decoded = F.java_method(
        F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), F.coalesce(text, F.lit(""))
    )
    return F.when(text.isNotNull(), decoded)


def page_fields(xml: Column | str) -> dict[str, Column]:
    """Columns of one raw ``<page>`` element. Take them in one ``select``."""
    xml = _col(xml)
    namespace = _between(xml, "<ns>", "</ns>")
    markup = _between(xml, TEXT_TAG, "</text>")
    opening = F.locate(TEXT_TAG, xml)
    from_text = F.when(opening > 0, F.substring(xml, opening, F.length(xml)))
    redirect = markup.startswith(REDIRECT_MARKERS[0]) | markup.startswith(REDIRECT_MARKERS[1])
    stub = F.coalesce(from_text, xml).contains(STUB_TEMPLATE) | xml.contains(STUB_PAGE)
    return {
        "page_id": _between(xml, "<id>", "</id>"),
        "title": decode_entities(_between(xml, "<title>", "</title>")),
        "is_article": F.coalesce(strip(namespace) == "0", F.lit(True)),
        "is_empty": opening == 0,
        "is_redirect": F.coalesce(redirect, F.lit(False)),
        "is_disambiguation": xml.rlike(DISAMBIGUATION),
        "is_stub": stub,
        "language": F.lit(LANGUAGE),
        "markup": markup,
        "raw_xml": xml,
    }


def render(markup: Column | str) -> Column:
    """Links to their anchors, no emphasis, headings and list marks as plain lines."""
    text = _col(markup)
    for pattern, by in _RENDER:
        text = F.regexp_replace(text, pattern, by)
    return text


def without_markup(text: Column | str) -> Column:
    """References, comments, addresses, templates and tags to one blank each, in this order."""
    text = _col(text)
    for pattern in (REFERENCE, COMMENT, WEB_ADDRESS, TEMPLATE, TAG):
        text = F.regexp_replace(text, pattern, " ")
    return text


def plain_text(title: Column | str, markup: Column | str) -> Column:
    """Title, line break, text. Entities are decoded twice: dumps encode some of them twice."""
    body = render(F.regexp_replace(_col(markup), LANGUAGE_LINK, " "))
    return without_markup(decode_entities(decode_entities(F.concat(_col(title), F.lit("\n"), body))))


def links(page: Column | str) -> Column:
    """``array<struct<anchor, target>>`` in page order; no special, empty or page-internal links."""
    inner = F.regexp_extract_all(_col(page), F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    plain = F.filter(inner, lambda s: ~s.contains(":"))

    def link(text: Column) -> Column:
        target = F.substring_index(F.substring_index(text, "|", 1), "#", 1)
        bar = F.locate("|", text)
        anchor = F.when(bar > 0, F.substring(text, bar + 1, F.length(text))).otherwise(target)
        return F.struct(anchor.alias("anchor"), target.alias("target"))

    return F.filter(F.transform(plain, link), lambda pair: pair["target"] != "")


def language_link(page: Column | str, language: str) -> Column:
    """Title of the page in another language; null if absent, empty or broken by a line end."""
    found = _between(_col(page), f"[[{language}:", "]]")
    return F.when((found != "") & ~found.contains("\n"), found)


def paragraphs(content: Column | str) -> Column:
    """Trimmed lines that hold something."""
    lines = F.transform(F.split(_col(content), "\n"), strip)
    return F.filter(lines, lambda line: line != "")
