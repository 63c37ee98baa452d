"""Page signals to one wide row per page: a single aggregation over the token table.

The aggregation is keyed on `page_id`, on which the tokens are already clustered, so it adds no exchange.
Texts are collected once per page in token order; body text, headings and sections are slices of that
one array, so no range join and no pairing of headings with texts takes place.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import text as T
from auditloom.functions import variants as V
from auditloom.functions.cached import per_context
from auditloom.operators.tokens import page_signals


def _ordered(condition: Column, *fields: Column) -> Column:
    """Collected structs in token order; the first field is the position."""
    return F.sort_array(F.collect_list(F.when(condition, F.struct(*fields))))


def _texts(first: Column, last: Column) -> Column:
    """Texts of the token positions first..last."""
    return F.slice("texts", first + 1, F.greatest(last - first + 1, F.lit(0)))


def _joined(items: Column, own_depth: Column | None = None) -> Column:
    """Stripped, non-empty parts with single blanks. A script counts only as a direct sibling."""
    def wanted(t: Column) -> Column:
        text_only = t.script_depth.isNull()
        if own_depth is not None:
            text_only = text_only | (t.script_depth == own_depth)
        return (t.stripped != "") & text_only

    return F.array_join(F.transform(F.filter(items, wanted), lambda t: t.stripped), " ")


def collect_signals(signals: DataFrame) -> DataFrame:
    """One row per page with the ordered raw material of every extractor."""
    c = F.col
    kept, pos = c("kept"), c("pos")
    opened = c("kind") == "open"
    is_text = kept & (c("kind") == "text")
    is_script = kept & (c("kind") == "raw") & c("val").isNotNull()
    shown = F.when((is_text & ~c("hidden")) | is_script, T.strip(c("val")))
    signals = signals.withColumns(
        {
            "_stripped": shown,
            "_exact": F.when(is_text & c("exact"), c("val")),
            "_script_depth": F.when(is_script, c("depth")),
        }
    )
    heading = kept & opened & c("tag").isin(H.HEADING_TAGS)
    return signals.groupBy("page_id").agg(
        F.first("page", ignorenulls=True).alias("page"),
        _ordered(
            pos.isNotNull(),
            pos,
            c("_stripped").alias("stripped"),
            c("_exact").alias("exact"),
            c("_script_depth").alias("script_depth"),
            (kept & c("hidden")).alias("hidden"),
        ).alias("texts"),
        _ordered(heading, pos, c("tag"), c("end_pos"), c("stop_pos"), c("depth")).alias("heads"),
        _ordered(kept & (c("role") == "link"), pos, c("val")).alias("links"),
        _ordered(kept & (c("role") == "jsonld"), pos, c("val")).alias("scripts"),
        F.count_if(kept & (c("role") == "image")).cast("int").alias("images_without_alt"),
        F.min(F.when(kept & opened & (c("tag") == "title"), F.struct(pos, c("end_pos")))).alias("title_span"),
        *[
            F.min(F.when(kept & (c("role") == r), F.struct(pos, c("val")))).alias(r)
            for r in ("description", "robots", "canonical")
        ],
        F.max("container_pos").alias("container_pos"),
        F.max("container_end").alias("container_end"),
    )


@per_context
def _extract_stages() -> list[dict[str, Column]]:
    """The columns of a parsed page, in stages."""
    c = F.col
    only_child = F.get(c("texts"), c("title_span.pos") + 1)
    title = F.when(c("title_span.end_pos") - c("title_span.pos") == 2, F.nullif(only_child.exact, F.lit("")))

    def heading(h: Column) -> Column:
        parts = F.transform(
            F.filter(_texts(h.pos + 1, h.end_pos), lambda t: t.exact.isNotNull() & ~t.hidden), lambda t: t.exact
        )
        return F.struct(h.tag.alias("tag"), T.strip(F.array_join(parts, "")).alias("text"))

    def section(h: Column, i: Column) -> Column:
        return F.struct(
            i.alias("pos"),
            _joined(_texts(h.pos + 1, h.end_pos)).alias("heading"),
            _joined(_texts(h.end_pos + 1, h.stop_pos - 1), h.depth).alias("content"),
        )

    body = F.when(
        c("container_pos").isNotNull(), _joined(_texts(c("container_pos") + 1, c("container_end")))
    )
    parsed = F.transform(
        "scripts",
        lambda s: F.struct(
            s.val.alias("text"), V.parse_json_strict(s.val).alias("node"), V.json_depth(s.val).alias("depth")
        ),
    )
    return [
        {"body_text_content": body, "_blocks": F.filter(parsed, lambda b: b.node.isNotNull())},
        {
            "_nodes": F.transform("_blocks", lambda b: b.node),
            "_depth": F.coalesce(F.array_max(F.transform("_blocks", lambda b: b.depth)), F.lit(0)),
        },
        {
            "word_count": T.word_count(c("body_text_content")),
            "has_schema": F.size("_blocks") > 0,
            "images_without_alt": c("images_without_alt"),
            "title": title,
            "meta_description": c("description.val"),
            "meta_robots": c("robots.val"),
            "canonical_url": c("canonical.val"),
            "body_text_content": c("body_text_content"),
            "headings": F.transform("heads", heading),
            "internal_links": F.transform("links", lambda x: x.val),
            "json_ld_schema": F.transform("_blocks", lambda b: b.text),
            "schema_types": F.array_sort(F.array_distinct(V.schema_types(c("_nodes"), c("_depth")))),
            "faq_items": V.faq_items(c("_nodes"), c("_depth")),
            "sections": F.transform("heads", section),
        },
    ]


def extract_pages(collected: DataFrame) -> DataFrame:
    *early, last = _extract_stages()
    for stage in early:
        collected = collected.withColumns(stage)
    return collected.select("page.*", *[column.alias(name) for name, column in last.items()])


def parse_pages(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """Captured pages (`page_id`, `url`, `html`, anything else) to one wide row per page.

    One exchange, on the captured page itself; none when the source is bucketed on `page_id` and
    `clustered` is set. Columns beside `html` are kept.
    """
    return extract_pages(collect_signals(page_signals(pages, clustered)))
