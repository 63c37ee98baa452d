"""Text helpers as Column expressions: words, strip, rounding, entities."""

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 Unicode white-space characters, as a Java regex class body.
SPACE_CHARS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
SPACE_STRING = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000])
)
ENTITY_PIECE_RE = r"&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[A-Za-z][A-Za-z0-9]*+;|&|[^&]++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and give it to `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_STRING))


def _plainly_spaced(col: Column) -> Column:
    """Every white-space character as a blank."""
    return F.translate(col, SPACE_STRING, " " * len(SPACE_STRING))


def words(col: Column) -> Column:
    """All maximal runs of non-blank characters. Split, not matched: a match costs a copy of the whole text."""
    return F.filter(F.split(_plainly_spaced(col), " +"), lambda w: w != "")


def word_count(col: Column) -> Column:
    """Number of words, 0 for NULL; stays inside code generation."""
    count = let(F.btrim(_plainly_spaced(col)), lambda x: F.when(x != "", F.size(F.split(x, " +"))).otherwise(0))
    return F.coalesce(count, F.lit(0))


def is_blank(col: Column) -> Column:
    """True for NULL and the empty string, the two forms of 'missing'."""
    return F.coalesce(col, F.lit("")) == ""


def half_even(col: Column) -> Column:
    """Round a DOUBLE to the nearest integer, ties to even."""
    return F.rint(col.cast("double")).cast("int")


def _code_point(digits: Column, base: int) -> Column:
    n = F.conv(digits, base, 10).cast("bigint")
    text = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), text).otherwise("")


def _named_entities() -> Column:
    # The table comes from the standard library, not from a list of our own. One literal keeps the plan
    # small; the optimizer folds the map.
    pairs = "\n".join(f"&{name};\t{chr(point)}" for name, point in sorted(name2codepoint.items()))
    return F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))


def decode_entities(col: Column) -> Column:
    """Decode named and numeric character references in one left-to-right pass."""

    def piece(p: Column) -> Column:
        named = F.coalesce(F.try_element_at(_named_entities(), p), p)
        return (
            F.when(~p.startswith("&"), p)
            .when(p.rlike("^&#[0-9]{1,9};?$"), _code_point(F.regexp_extract(p, "[0-9]+", 0), 10))
            .when(p.rlike("^&#[xX]0*[0-9a-fA-F]{1,7};?$"), _code_point(F.regexp_extract(p, "(?<=[xX])[0-9a-fA-F]+", 0), 16))
            .when(p.rlike("^&#."), F.lit(""))
            .otherwise(named)
        )

    decoded = F.array_join(
        F.transform(F.regexp_extract_all(col, F.lit(f"({ENTITY_PIECE_RE})"), F.lit(1)), piece), ""
    )
    return F.when(F.instr(col, "&") > 0, decoded).otherwise(col)
