"""URL resolution and normalisation as Column expressions.

Intermediate values are bound with `let`, so each regex over a URL runs once per row and the expression
stays small wherever the optimizer moves it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.text import let

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# groups: authority with its slashes, path, query with '?', fragment with '#'
SPLIT_RE = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#@:]+)"


def scheme(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, SCHEME_RE, 1))


def host(col: Column) -> Column:
    """Lower-case host name, NULL when the URL has none."""
    return F.nullif(F.lower(F.regexp_extract(col, HOST_RE, 1)), F.lit(""))


def url_path(col: Column) -> Column:
    return F.regexp_extract(col, SPLIT_RE, 2)


def same_host(url: Column, base: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) == host(base)), F.lit(False))


def _clean(col: Column) -> Column:
    """Drop leading controls and blanks, and tabs and line breaks anywhere."""
    return F.regexp_replace(col, r"^[\x00-\x20]+|[\t\r\n]+", "")


def _nonempty(col: Column) -> Column:
    """A bare '?' or '#' does not survive resolution."""
    return F.when(F.length(col) > 1, col).otherwise(F.lit(""))


def _squeeze(path: Column) -> Column:
    """Drop empty inner segments, as happens when a relative path is merged."""
    segs = F.split(path, "/")
    kept = F.filter(segs, lambda s, i: (s != "") | (i == 0) | (i == F.size(segs) - 1))
    return F.when(F.instr(path, "//") > 0, F.array_join(kept, "/")).otherwise(path)


def _remove_dots(path: Column) -> Column:
    empty = F.array().cast("array<string>")
    segs = F.split(path, "/")
    kept = F.aggregate(
        segs,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    flat = F.array_join(F.concat(kept, tail), "/")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), flat).otherwise(path)


def _parts(url: Column, prefix: str) -> list[Column]:
    def part(group: int) -> Column:
        return F.regexp_extract(url, SPLIT_RE, group)

    return [
        scheme(url).alias(f"{prefix}_scheme"),
        part(1).alias(f"{prefix}_authority"),
        part(2).alias(f"{prefix}_path"),
        _nonempty(part(3)).alias(f"{prefix}_query"),
        _nonempty(part(4)).alias(f"{prefix}_fragment"),
    ]


def _resolve_cleaned(u: Column) -> Column:
    """`u` holds the cleaned link and base."""
    return let(
        F.struct(u.href.alias("href"), u.base.alias("base"), *_parts(u.href, "h"), *_parts(u.base, "b")),
        _resolve_parts,
    )


def _resolve_parts(p: Column) -> Column:
    folder = F.when(p.b_path == "", F.lit("/")).otherwise(F.regexp_replace(p.b_path, r"[^/]*$", ""))
    merged = F.when(p.h_path.startswith("/"), p.h_path).otherwise(_squeeze(F.concat(folder, p.h_path)))
    rooted = let(
        let(merged, _remove_dots),
        lambda x: F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x)),
    )
    start = F.concat(p.b_scheme, F.lit(":"))
    own_query = F.when(p.h_query != "", p.h_query).otherwise(p.b_query)
    return (
        F.when(p.href == "", p.base)
        .when((p.h_scheme != "") & (p.h_scheme != p.b_scheme), p.href)
        .when(
            F.length(p.h_authority) > 2,
            F.concat(start, p.h_authority, p.h_path, p.h_query, p.h_fragment),
        )
        .when(p.h_path == "", F.concat(start, p.b_authority, p.b_path, own_query, p.h_fragment))
        .otherwise(F.concat(start, p.b_authority, rooted, p.h_query, p.h_fragment))
    )


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of `href` seen from the page `base` (an http or https URL)."""
    cleaned = F.struct(_clean(href).alias("href"), _clean(base).alias("base"))
    return F.when(href.isNotNull() & base.isNotNull(), let(cleaned, _resolve_cleaned))


def normalize(href: Column, base: Column) -> Column:
    """Same-host link in canonical form: no query, fragment, port or user, all lower case, no trailing
    slashes; NULL for anything that leaves the host."""

    def finish(url: Column) -> Column:
        parts = F.struct(
            scheme(url).alias("scheme"), host(url).alias("host"), url_path(url).alias("path"), host(base).alias("home")
        )
        return let(
            parts,
            lambda u: F.when(
                u.scheme.isin("http", "https") & (u.host == u.home),
                F.regexp_replace(F.lower(F.concat(u.scheme, F.lit("://"), u.host, u.path)), "/+$", ""),
            ),
        )

    return F.when(href.isNotNull(), let(resolve(href, base), finish))
