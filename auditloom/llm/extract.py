"""Main text of web pages: blocks are classified by two passes of rules."""

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of some languages.
STOP_WORDS = frozenset(
    "a about all an and are as at be been but by for from had has have he her his i in is it its not of on or our she "
    "that the their there they this to was we were which will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine er es für hat ich im in ist mit nicht sich sie sind "
    "so und von war wie zu zum "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les mais ne nous on ou par pas plus pour que qui "
    "se son sur un une vous "
    "al como con del el ella era es está fue la las lo los más no o para pero por se ser si sin su sus un una y ya".split()
)
# Elements that hold no text of a page, elements that end a block, elements without content.
UNSEEN = "script style title textarea noscript template iframe object svg math select button canvas audio video".split()
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notification pagination "
    "popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE = frozenset(("article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<unseen>{'|'.join(UNSEEN)})(?=[\s/>]).*?(?:</(?P=unseen)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+>|[^>]*(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass. Lengths in characters, densities as shares of words or characters."""

    most_links: float = 0.33
    short: int = 70
    long: int = 200
    low_stop_words: float = 0.10
    high_stop_words: float = 0.25


@dataclass
class Block:
    inside: bool  # within an article or main element
    aside: bool  # within a menu, footer, advert ...
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _is_aside(tag: str, rest: str, inside: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not inside):
        return True
    if tag in ARTICLE or tag in ("body", "html"):
        return False
    if HIDDEN.search(rest):
        return True
    for name, *values in NAMED.findall(rest):
        value = "".join(values)
        if name.lower() == "role":
            if value.strip().lower() in ASIDE_ROLES:
                return True
        elif any(part.lower() in ASIDE_NAMES for part in NAME_PART.findall(value)):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Text between block elements, in page order, with the text that is inside links counted."""
    opened: list[tuple[str, bool, bool, bool]] = []  # tag, inside, aside, heading of what is open
    links, out, now = 0, [], None
    at = 0
    for m in [*TOKEN.finditer(page), None]:
        text = page[at : m.start()] if m else page[at:]
        if text and not text.isspace():
            if now is None:
                _, inside, aside, heading = opened[-1] if opened else ("", False, False, False)
                now = Block(inside, aside, heading)
                out.append(now)
        if text and now is not None:
            now.parts.append(text)
            now.linked += len(text) * (links > 0)
        if m is None:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            now = None
        elif tag == "br" and now is not None:
            now.parts.append(" ")
        if tag == "a":
            links = 0 if m["close"] else 1
        elif m["close"]:
            depth = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == tag), None)
            if depth is not None:
                del opened[depth:]
        elif tag in BLOCKS and tag not in VOID and not m["rest"].endswith("/>"):
            # a new paragraph or item ends an open one
            if opened and opened[-1][0] in ("p", tag) and tag in ("p", "li", "dt", "dd", "tr", "td", "th") or (opened and opened[-1][0] == "p"):
                opened.pop()
            _, inside, aside, heading = opened[-1] if opened else ("", False, False, False)
            opened.append((tag, inside or tag in ARTICLE, aside or _is_aside(tag, m["rest"], inside), heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
        elif tag not in VOID and tag == "span" and now is None and _is_aside(tag, m["rest"], True):
            _, inside, aside, heading = opened[-1] if opened else ("", False, False, False)
            opened.append((tag, inside, True, heading))
    for block in out:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
    return [b for b in out if b.text]


def first_pass(block: Block, has_article: bool, rules: Rules) -> str:
    """Label by place, link density, length and stop-word density."""
    if block.aside or (has_article and not block.inside):
        return BAD
    links = block.linked / max(1, sum(map(len, block.parts)))
    if links > rules.most_links and not (block.inside and links < 0.9 and len(block.text) >= rules.long):
        return BAD if len(block.text) >= rules.short or links > 0.9 else SHORT
    if block.inside:
        return GOOD  # the page itself says that this is its article
    if len(block.text) < rules.short:
        return SHORT
    words = block.text.lower().split()
    stop = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if stop >= rules.high_stop_words:
        return GOOD if len(block.text) >= rules.long else NEAR
    return NEAR if stop >= rules.low_stop_words else BAD


def second_pass(labels: list[str], headings: list[bool]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided blocks.

    Between two good ones a block is good; between two bad ones it's bad. Where they differ, a fair text (near) and a
    heading that stands before good text are good, and other short blocks follow the nearer side, or are bad if both
    are as near. The edges of a page count as bad. A page without any good block keeps its fair texts.
    """
    n = len(labels)
    decided = [x in (GOOD, BAD) for x in labels]
    before: list[tuple[str, int]] = []
    label, at = BAD, -1
    for i in range(n):
        before.append((label, i - at))
        if decided[i]:
            label, at = labels[i], i
    out, label, at = [False] * n, BAD, n
    fair_only = GOOD not in labels
    for i in range(n - 1, -1, -1):
        if decided[i]:
            out[i] = labels[i] == GOOD
            label, at = labels[i], i
            continue
        (left, far_left), (right, far_right) = before[i], (label, at - i)
        if left == right:
            out[i] = left == GOOD or (fair_only and labels[i] == NEAR)
        elif labels[i] == NEAR:
            out[i] = True
        elif headings[i]:
            out[i] = right == GOOD
        else:
            out[i] = (far_left < far_right) == (left == GOOD) and far_left != far_right
    return out


def main_text(page: str | None, rules: Rules = Rules(), separator: str = "\n") -> str:
    """Kept blocks of a page, joined by the separator."""
    blocks = blocks_of(page or "")
    has_article = any(b.inside and not b.aside for b in blocks)
    labels = [first_pass(b, has_article, rules) for b in blocks]
    kept = second_pass(labels, [b.heading for b in blocks])
    return separator.join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract_text(pages: DataFrame, html_column: str = "html", column: str = "text", rules: Rules = Rules(), separator: str = "\n\n") -> DataFrame:
    """pages and the main text of each, from the whole HTML, with the separator between blocks; null or empty HTML gives
    an empty text.

    Each row is judged by itself. A column of the name given is replaced; other columns stay as they are.
    """

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py(), rules, separator) for x in batch], pa.string())

    return pages.withColumn(column, extract.asNondeterministic()(F.col(html_column)))
