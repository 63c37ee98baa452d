"""HTML as a token table: tokens, element spans, pruning.

Pages are clustered on `page_id` once, before the tokens are exploded, so what crosses the network is
the captured page and not the wider token rows. Every window below is keyed on `page_id` plus more
columns and reuses that clustering; none of them adds an exchange.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import text as T
from auditloom.functions.cached import per_context
from auditloom.functions.urls import normalize
from auditloom.session import input_bytes

TASK_BYTES = 4 << 20  # of input files for a parsing task: the sorted tokens take some 40 times as much memory


def cluster_pages(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """Hash pages on `page_id`; pass clustered=True for a source bucketed on it, which needs no exchange.

    Where the input is files, the number of partitions grows with their size, so that what a task sorts does not.
    """
    if clustered:
        return pages
    needed = -(-input_bytes(pages) // TASK_BYTES)
    if needed > int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return pages.repartition(needed, "page_id")
    return pages.repartition("page_id")


def html_tokens(pages: DataFrame) -> DataFrame:
    """One row per token: open, close, void, raw (script and style), text, other. `pos` counts from 0.

    Columns of `pages` other than `html` stay on every row. A page without any token keeps one row with
    NULL pos, so no page is lost.
    """
    keep = [c for c in pages.columns if c != "html"]
    raw = F.col("raw")
    tokens = pages.select(*keep, F.posexplode_outer(H.html_token_array(F.col("html"))).alias("pos", "raw"))
    tokens = tokens.withColumn("tag", F.lower(F.regexp_extract(raw, H.TAG_RE, 1)))
    kind = (
        F.when(F.col("pos").isNull(), F.lit("other"))
        .when((F.col("tag") == "") & raw.rlike("^<[A-Za-z/!?]"), F.lit("other"))
        .when(F.col("tag") == "", F.lit("text"))
        .when(~raw.endswith(">") & ~F.col("tag").isin(H.RAW_TAGS), F.lit("other"))
        .when(raw.startswith("</"), F.lit("close"))
        .when(F.col("tag").isin(H.RAW_TAGS), F.lit("raw"))
        .when(F.col("tag").isin(H.VOID_TAGS) | (raw.endswith("/>") & raw.rlike(H.SELF_CLOSED_RE)), F.lit("void"))
        .otherwise(F.lit("open"))
    )
    tokens = tokens.withColumn("kind", kind)
    return tokens.select(*keep, "pos", "kind", F.when(F.col("kind") == "other", "").otherwise(F.col("tag")).alias("tag"), "raw")


@per_context
def _is_excluded() -> Column:
    raw, tag = F.col("raw"), F.col("tag")
    classes = T.words(H.attr_value(H.attr_source(raw, "class")))
    by_class = (F.instr(F.lower(raw), "class") > 0) & F.coalesce(
        F.arrays_overlap(classes, F.array(*[F.lit(c) for c in H.EXCLUDED_CLASSES])), F.lit(False)
    )
    return F.col("kind").isin("open", "void", "raw") & (tag.isin(H.EXCLUDED_TAGS) | by_class)


def with_marks(tokens: DataFrame) -> DataFrame:
    """Add the two facts about a token's markup that `with_tree` needs."""
    return tokens.withColumns(
        {
            "excluded": _is_excluded(),
            "nonblank": (F.col("kind") == "text") & F.col("raw").rlike(T.NON_SPACE),
        }
    )


def _lead_nonnull(value: str, keys: str) -> Column:
    """Next non-NULL value of an expression in token order; linear, unlike a frame of following rows."""
    return F.expr(f"lead({value}) ignore nulls over (partition by {keys} order by pos)")


def with_tree(tokens: DataFrame) -> DataFrame:
    """Add the tree facts of every token: depth, end_pos, stop_pos and whether it survives pruning.

    An open tag pairs with the close tag of the same name that brings the running balance of that name
    back. Paired elements carry depth. Repair rules for the rest: a paragraph or unclosed heading ends
    before the next block tag; any other unclosed element ends with its parent, or with the page.
    The container is the first `main`, else the first `body`, else the implied body.
    """
    c = F.col
    in_order = Window.partitionBy("page_id").orderBy("pos")
    whole_page = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = tokens.withColumn("_pair", F.when(c("kind").isin("open", "close"), c("tag")))
    delta = F.when(c("kind") == "open", 1).when(c("kind") == "close", -1).otherwise(0)
    by_tag = Window.partitionBy("page_id", "_pair").orderBy("pos")
    t = t.withColumn("_key", F.sum(delta).over(by_tag) + (c("kind") == "close").cast("int"))

    by_key = Window.partitionBy("page_id", "_pair", "_key").orderBy("pos")
    t = t.withColumns(
        {
            "_next_kind": F.lead("kind").over(by_key),
            "_next_pos": F.lead("pos").over(by_key),
            "_prev_kind": F.lag("kind").over(by_key),
        }
    )
    neutral = c("tag") == "p"
    step = (
        F.when(neutral, 0)
        .when((c("kind") == "open") & (c("_next_kind") == "close"), 1)
        .when((c("kind") == "close") & (c("_prev_kind") == "open"), -1)
        .otherwise(0)
    )
    t = t.withColumn("_step", step)

    is_block = c("kind").isin("open", "close", "void") & c("tag").isin(H.BLOCK_TAGS)
    t = t.withColumn("_block_pos", F.when(is_block, c("pos")))
    t = t.withColumns(
        {
            "depth": (F.sum("_step").over(in_order) - F.greatest(c("_step"), F.lit(0))).cast("int"),
            "_break": _lead_nonnull("_block_pos", "page_id"),
            "_prev_tag": F.lag("tag").over(in_order),
        }
    )
    opened = c("kind") == "open"
    body_like = (c("kind").isin("open", "void") & ~c("tag").isin(H.HEAD_TAGS)) | (
        c("nonblank") & (F.coalesce(c("_prev_tag"), F.lit("")) != "title")
    )
    t = t.withColumns(
        {
            "_main": F.min(F.when(opened & (c("tag") == "main"), c("pos"))).over(whole_page),
            "_body": F.min(F.when(opened & (c("tag") == "body"), c("pos"))).over(whole_page),
            "_implied": F.min(F.when(body_like, c("pos"))).over(whole_page),
            "_last": F.max("pos").over(whole_page),
        }
    ).withColumns(
        {
            "container_pos": F.coalesce("_main", "_body", c("_implied") - 1),
            # a close tag ends the level inside its element, one below its own
            "_level": c("depth") + (c("_step") == -1).cast("int"),
            "_close_pos": F.when(c("_step") == -1, c("pos")),
            "_head_pos": F.when(opened & c("tag").isin(H.HEADING_TAGS), c("pos")),
        }
    )
    t = t.withColumns(
        {
            "_next_close": _lead_nonnull("_close_pos", "page_id, _level"),
            "_next_head": _lead_nonnull("_head_pos", "page_id, _level"),
        }
    )
    end_pos = (
        F.when(~opened, c("pos"))
        .when(neutral, F.coalesce(c("_break") - 1, c("_last")))
        .when(c("_step") == 1, c("_next_pos"))
        .when(
            c("tag").isin(H.HEADING_TAGS),
            F.coalesce(F.least(c("_break"), c("_next_close")) - 1, c("_last")),
        )
        .otherwise(F.coalesce(c("_next_close") - 1, c("_last")))
    )
    t = t.withColumn("end_pos", end_pos).withColumn(
        "stop_pos", F.coalesce(F.least("_next_head", "_next_close"), c("_last") + 1)
    )

    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covers = c("excluded") & (c("pos") > c("container_pos"))
    t = t.withColumns(
        {
            "_container_end": F.max(F.when(c("pos") == c("container_pos"), c("end_pos"))).over(whole_page),
            "_cover_end": F.max(F.when(covers, c("end_pos"))).over(running),
            "_hidden_end": F.max(
                F.when(opened & c("tag").isin(H.HIDDEN_TEXT_TAGS), c("end_pos"))
            ).over(running),
            "_exact_end": F.max(
                F.when(opened & c("tag").isin(H.HEADING_TAGS + ["title"]), c("end_pos"))
            ).over(running),
        }
    )
    explicit = c("_main").isNotNull() | c("_body").isNotNull()
    container_end = F.when(explicit, c("_container_end")).otherwise(c("_last"))
    pos = c("pos")
    inside = (pos > c("container_pos")) & (pos <= container_end)
    covered = F.coalesce(c("_cover_end") >= pos, F.lit(False))
    return t.select(
        *tokens.columns,
        "depth",
        "end_pos",
        "stop_pos",
        "container_pos",
        container_end.alias("container_end"),
        F.coalesce(~(inside & covered), F.lit(True)).alias("kept"),
        F.coalesce(c("_hidden_end") >= pos, F.lit(False)).alias("hidden"),
        F.coalesce(c("_exact_end") >= pos, F.lit(False)).alias("exact"),
        (c("_step") == 1).alias("closed"),
    )


def element_spans(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """Start, end and depth of every element that has an open tag."""
    slim = cluster_pages(pages.select("page_id", "html"), clustered)
    tree = with_tree(with_marks(html_tokens(slim)))
    return tree.where("kind = 'open'").select(
        "page_id", "tag", F.col("pos").alias("start_pos"), "end_pos", "depth"
    )


def pruned_tokens(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """Tokens that are left after removing excluded elements from the container."""
    slim = cluster_pages(pages.select("page_id", "html"), clustered)
    tree = with_tree(with_marks(html_tokens(slim)))
    return tree.where("kept AND kind <> 'other'").select("page_id", "pos", "kind", "tag", "raw")


def _by_tag(attributes: dict[str, str]) -> Column:
    """For each of the tags its attribute as written."""
    raw = F.col("raw")
    source = None
    for tag, name in attributes.items():
        chosen = H.attr_source(raw, name)
        hit = F.col("tag") == tag
        source = F.when(hit, chosen) if source is None else source.when(hit, chosen)
    return F.when(F.col("kind").isin("open", "void", "raw"), source)


@per_context
def _signal_stages() -> list[dict[str, Column]]:
    """The columns of a token's contribution, in stages; each regex over the markup runs once."""
    c, raw = F.col, F.col("raw")
    is_text = c("kind") == "text"
    script = F.regexp_replace(raw, rf"(?is)^<(?:script|style){H.TAG_REST}|</(?:script|style)\s*>\z", "")
    role = (
        F.when(c("_target").isNotNull(), "link")
        .when((c("tag") == "img") & c("kind").isin("open", "void") & (F.coalesce(T.strip(c("_value")), F.lit("")) == ""), "image")
        .when((c("tag") == "meta") & c("_key").isin("description", "robots"), c("_key"))
        .when((c("tag") == "link") & F.array_contains(T.words(c("_key")), "canonical"), "canonical")
        .when((c("tag") == "script") & (c("_key") == "application/ld+json"), "jsonld")
    )
    # other scripts only matter beside a heading outside a main container
    needed = (c("role") == "jsonld") | ((c("kind") == "raw") & c("_has_main"))
    return [
        {
            "_key": H.attr_value(_by_tag({"meta": "name", "link": "rel", "script": "type"})),
            "_value": F.when(is_text, raw).otherwise(
                H.attr_value(_by_tag({"a": "href", "img": "alt", "meta": "content", "link": "href"}))
            ),
        },
        {"_value": T.decode_entities(c("_value"))},
        {"_target": F.when((c("tag") == "a") & ~is_text, normalize(c("_value"), c("url")))},
        {"role": role},
        {
            "val": F.when(c("role") == "link", c("_target"))
            .when(is_text | c("role").isin("description", "robots", "canonical"), c("_value"))
            .when(needed, script)
        },
    ]


def page_signals(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """Token table with what each token contributes to the audit, tree facts included.

    `role` names the contribution (link, image, description, robots, canonical, jsonld) and `val` holds
    it; for text tokens `val` is the decoded text. The markup itself is dropped before the windows.
    Other page columns travel on the first token of the page only, as the struct `page`.
    """
    page_cols = [x for x in pages.columns if x != "html"]
    wide = cluster_pages(pages, clustered).withColumn("_has_main", F.instr(F.lower("html"), "<main") > 0)
    t = with_marks(html_tokens(wide))
    for stage in _signal_stages():
        t = t.withColumns(stage)
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    slim = t.select(
        "page_id", "pos", "kind", "tag", "excluded", "nonblank", "role", "val",
        F.when(first, F.struct(*page_cols)).alias("page"),
    )
    return with_tree(slim)
