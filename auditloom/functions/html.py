"""Markup regexes and attribute access as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.cached import per_context
from auditloom.functions.text import decode_entities

# Quotes only open after '='. Possessive quantifiers keep every branch linear and iterative.
TAG_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
TOKEN_RE = (
    r"(?is)("
    r"<!--.*?(?:-->|\z)"
    rf"|<script(?=[\s/>]){TAG_REST}.*?(?:</script\s*+>|\z)"
    rf"|<style(?=[\s/>]){TAG_REST}.*?(?:</style\s*+>|\z)"
    rf"|</?[a-z]{TAG_REST}"
    r"|<[a-z/!?][^>]*+>?"
    r"|(?:[^<]++|<(?![a-z/!?]))++"
    r")"
)
TAG_RE = r"^</?([A-Za-z][^\s/>]*)"
SELF_CLOSED_RE = r"""(?s)(?:["'\s]|^<[A-Za-z][^\s/>]*)/>$"""

# Markup vocabulary.
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
]
EXCLUDED_TAGS = [
    "script", "style", "nav", "footer", "header", "link", "noscript", "g", "menu", "button", "svg",
    "canvas",
]
EXCLUDED_CLASSES = ["ad", "ads", "advertisements", "banner", "promo", "sponsored"]
RAW_TAGS = ["script", "style"]
HIDDEN_TEXT_TAGS = ["template", "rt", "rp"]
HEAD_TAGS = ["html", "head", "title", "meta", "link", "base", "script", "style"]
# A paragraph or an unclosed heading ends where one of these starts or ends.
BLOCK_TAGS = HEADING_TAGS + [
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr",
    "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
]


def html_token_array(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN_RE), F.lit(1))


def attr_source(raw: Column, name: str) -> Column:
    """The first occurrence of an attribute as written, name and value; '' when the tag lacks it."""
    value = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
    pattern = (
        rf"(?is)^<[^\s/>]++(?:[\s/]++(?!{name}[\s=/>])[^\s=/>]++{value})*+[\s/]++({name}(?=[\s=/>]){value})"
    )
    return F.regexp_extract(raw, pattern, 1)


def attr_value(source: Column) -> Column:
    """Value of an attribute as written, quotes taken off; '' for a bare attribute, NULL when absent."""
    value = F.regexp_replace(source, r"(?s)^[^\s=]+\s*=?\s*", "")
    quoted = F.substring(value, 1, 1).isin('"', "'") & (F.length(value) > 1)
    bare = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.when(source != "", bare)


@per_context
def attr(name: str) -> Column:
    """An attribute of the tag in column `raw`, entities decoded."""
    return decode_entities(attr_value(attr_source(F.col("raw"), name)))
