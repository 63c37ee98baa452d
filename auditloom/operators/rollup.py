"""Site roll-ups: scores, most frequent messages, nested reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators.scoring import CATEGORIES
from auditloom.schemas import MESSAGE_ORDER, MESSAGES

TOP = 5


def mean_half_even(col: str) -> Column:
    """Half-even mean, summed exactly."""
    return T.half_even(F.sum(col).cast("double") / F.count(col))


def site_scores(scores: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Mean page score per site; sites without a scored page get 0."""
    means = scores.groupBy("site_id").agg(
        mean_half_even("overall_score").alias("overall_score"), F.count("*").cast("int").alias("pages_scored")
    )
    if sites is None:
        return means
    joined = sites.select("site_id").join(means, "site_id", "left")
    return joined.select(
        "site_id",
        F.coalesce("overall_score", F.lit(0)).alias("overall_score"),
        F.coalesce("pages_scored", F.lit(0)).alias("pages_scored"),
    )


def site_messages(scores: DataFrame) -> DataFrame:
    """One row per message with its place in the counting order. No exchange."""
    lists = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(at).alias("category_pos"),
            F.col(category)[f"{kind}s"].alias("items"),
        )
        for at, category in enumerate(MESSAGE_ORDER)
        for kind in ("finding", "recommendation")
    ]
    flat = scores.select("site_id", "crawl_pos", F.inline(F.array(*lists)))
    return flat.select(
        "site_id", "kind", "crawl_pos", "category_pos", F.posexplode("items").alias("pos", "message")
    )


def top_messages(messages: DataFrame, top: int = TOP) -> DataFrame:
    """Most frequent messages per site and kind; the one met first wins a tie.

    Counts and first places combine before the shuffle. What is ranked per site is its distinct messages,
    a set the rule table bounds, not its pages.
    """
    counted = messages.groupBy("site_id", "kind", "message").agg(
        F.count("*").alias("n"), F.min(F.struct("crawl_pos", "category_pos", "pos")).alias("_first")
    )
    by_rank = Window.partitionBy("site_id", "kind").orderBy(F.desc("n"), "_first")
    ranked = counted.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    return ranked.select("site_id", "kind", "rank", "message", "n")


def top_lists(tops: DataFrame, prefix: str = "") -> DataFrame:
    def pick(kind: str) -> Column:
        items = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "message"))))
        return F.transform(items, lambda x: x.message).alias(f"{prefix}{kind}s")

    return tops.groupBy("site_id").agg(pick("finding"), pick("recommendation"))


def message_text(code: Column) -> Column:
    """The wording of a message code, with the number or heading that follows a code ending in ':'. Codes without a
    wording stay as they are."""
    known = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    stem = F.regexp_extract(code, "^[^:]*:?", 0)
    rest = F.substring(code, F.length(stem) + 1, F.length(code))
    wording = F.element_at(known, stem)
    return F.when(wording.isNull(), code).when(rest == "", wording).otherwise(F.concat(wording, F.lit(": "), rest))


def crawl_durations(captures: DataFrame) -> DataFrame:
    """Seconds between the first and the last capture of a site."""
    return captures.groupBy("site_id").agg(_duration("crawl_duration_seconds"))


def _duration(name: str) -> Column:
    span = F.max("fetched_at").cast("timestamp").cast("double") - F.min("fetched_at").cast("timestamp").cast("double")
    return span.alias(name)


def category_rollup(scores: DataFrame) -> DataFrame:
    """Mean score of every category and rule per site, with category and site subtotals."""
    items = []
    for category, rules in CATEGORIES.items():
        for name, _, _ in rules:
            items.append(
                F.struct(
                    F.lit(category).alias("category"),
                    F.lit(name).alias("metric"),
                    F.col(category).metrics[name].alias("points"),
                )
            )
    flat = scores.select("site_id", F.inline(F.array(*items)))
    return flat.rollup("site_id", "category", "metric").agg(
        F.count("*").alias("n"), (F.sum("points").cast("double") / F.count("points")).alias("mean_points")
    ).where("site_id IS NOT NULL")


def site_report(
    sites: DataFrame,
    captures: DataFrame,
    scores: DataFrame,
    unreachable: DataFrame,
    semantic_pages: DataFrame,
) -> DataFrame:
    """One row per site: scores, page counts, top lists and crawl duration.

    `sites` holds (site_id, url); the others carry site_id. Every table is combined per site before it is joined, so
    no site is gathered; `page_details` holds the pages, a row each.
    """
    from auditloom.operators.semantic import site_semantic, top_semantic_messages

    counts = captures.groupBy("site_id").agg(
        F.count("*").cast("int").alias("pages_crawled"), _duration("crawl_duration_seconds")
    )
    semantic = site_semantic(semantic_pages).select("site_id", F.col("overall_score").alias("semantic_score"))
    gone = unreachable.groupBy("site_id").agg(F.count("*").cast("int").alias("pages_unreachable"))
    report = sites.select("site_id", "url")
    for table in (
        counts,
        site_scores(scores),
        gone,
        semantic,
        top_lists(top_messages(site_messages(scores))),
        top_lists(top_semantic_messages(semantic_pages), "semantic_"),
    ):
        report = report.join(table, "site_id", "left")
    empty = F.array().cast("array<string>")
    return report.select(
        "site_id",
        "url",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("pages_crawled", "pages_scored", "pages_unreachable", "overall_score", "semantic_score")
        ],
        *[
            F.coalesce(c, empty).alias(c)
            for c in ("findings", "recommendations", "semantic_findings", "semantic_recommendations")
        ],
        F.coalesce("crawl_duration_seconds", F.lit(0.0)).alias("crawl_duration_seconds"),
    )


def page_details(scores: DataFrame, unreachable: DataFrame, semantic_pages: DataFrame) -> DataFrame:
    """One row per audited page of a site: site_id, crawl_pos, url and, where it has them, the structs `page` (scores
    by category), `semantic` and `unreachable`. A site may have any number of pages."""
    page = F.struct("overall_score", *[F.col(c) for c in CATEGORIES])
    gone = F.struct("status_code", "reason")
    section = F.transform(
        "section_scores",
        lambda s: F.struct(s.heading, s.section_position, s.alignment_score, s.finding, s.recommendation),
    ).alias("section_scores")
    meaning = F.struct("overall_score", section, "finding", "recommendation")

    def rows(df: DataFrame, name: str, item: Column) -> DataFrame:
        return df.select("site_id", "crawl_pos", "url", item.alias(name))

    both = (
        rows(scores, "page", page)
        .unionByName(rows(unreachable, "unreachable", gone), allowMissingColumns=True)
        .unionByName(rows(semantic_pages, "semantic", meaning), allowMissingColumns=True)
    )
    return both.groupBy("site_id", "crawl_pos").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("url", "page", "semantic", "unreachable")]
    )


def audit_digest(report: DataFrame) -> DataFrame:
    """Flat summary of a finished audit: what a notification shows."""
    lists = [
        F.slice(c, 1, TOP).alias(c)
        for c in ("findings", "semantic_findings", "recommendations", "semantic_recommendations")
    ]
    return report.select(
        "site_id",
        "url",
        "overall_score",
        "semantic_score",
        "pages_crawled",
        F.bround("crawl_duration_seconds", 2).alias("crawl_duration_seconds"),
        *lists,
    )
