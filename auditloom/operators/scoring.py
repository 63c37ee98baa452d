"""Rule scores as Column expressions, and the page score built from them.

A rule gives struct(score, findings, recommendations). Everything here is a projection: no shuffle.
"""

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.functions.cached import per_context
from auditloom.schemas import (
    CATEGORY_WEIGHTS,
    ROBOTS_POINTS,
    SCHEMA_TYPE_POINTS,
    UNREACHABLE_REASONS,
)


def _messages(items) -> Column:
    columns = [F.lit(i) if isinstance(i, str) else i for i in items]
    return F.array(*columns) if columns else F.array().cast("array<string>")


def rule(score: Column | int, findings=(), recommendations=()) -> Column:
    value = F.lit(score) if isinstance(score, int) else score
    return F.struct(
        value.cast("int").alias("score"),
        _messages(findings).alias("findings"),
        _messages(recommendations).alias("recommendations"),
    )


def _ratio(n: Column, limit: float, points: float) -> Column:
    return T.half_even(n.cast("double") / F.lit(float(limit)) * F.lit(float(points)))


def _length_rule(col: Column, low: int, high: int, name: str) -> Column:
    def bands(n: Column) -> Column:
        return (
            F.when(n < low, rule(_ratio(n, low, 30), [f"{name}.short"], [f"{name}.lengthen", f"{name}.describe"]))
            .when(n <= high, rule(30, [f"{name}.good"]))
            .otherwise(
                rule(F.greatest(30 - (n - high) * 2, F.lit(10)), [f"{name}.long"], [f"{name}.shorten"])
            )
        )

    missing = rule(0, [f"{name}.missing", f"{name}.empty"], [f"{name}.add", f"{name}.matters"])
    return F.when(T.is_blank(col), missing).otherwise(T.let(T.word_count(col), bands))


def score_title(title: Column) -> Column:
    return _length_rule(title, 5, 15, "title")


def score_meta_description(description: Column) -> Column:
    return _length_rule(description, 15, 20, "description")


def score_canonical(url: Column) -> Column:
    return F.when(T.is_blank(url), rule(0, ["canonical.missing"], ["canonical.add"])).otherwise(
        rule(20, ["canonical.present"])
    )


def _points(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def _total(items: Column, table: dict) -> Column:
    points = _points(table)
    return F.aggregate(
        items, F.lit(0), lambda acc, x: acc + F.coalesce(F.try_element_at(points, x), F.lit(0))
    )


def score_meta_robots(robots: Column) -> Column:
    names = F.transform(F.split(F.coalesce(robots, F.lit("")), ","), lambda d: F.lower(T.strip(d)))

    def bands(s: Column) -> Column:
        return (
            F.when(s == 0, rule(s, ["robots.blocked"], ["robots.unblock"]))
            .when(s < 12, rule(s, ["robots.restricted"], ["robots.review"]))
            .when(s == 12, rule(s, ["robots.default"], ["robots.state"]))
            .when(s < 20, rule(s, ["robots.mostly_open"]))
            .otherwise(rule(s, ["robots.open"]))
        )

    return T.let(F.greatest(F.lit(0), F.least(F.lit(20), _total(names, ROBOTS_POINTS) + 12)), bands)


def score_word_count(n: Column) -> Column:
    return (
        F.when(n < 800, rule(_ratio(n, 800, 20), ["length.short"], ["length.lengthen", "length.detail"]))
        .when(n <= 2500, rule(20, ["length.good"]))
        .otherwise(
            rule(F.greatest(20 - (n - 2500) * 2, F.lit(7)), ["length.long"], ["length.focus", "length.spam"])
        )
    )


def _sum_rules(*parts: Column) -> Column:
    """Add up the scores and chain the messages of several rule results."""
    score = parts[0].score
    for p in parts[1:]:
        score = score + p.score
    return F.struct(
        score.alias("score"),
        F.concat(*[p.findings for p in parts]).alias("findings"),
        F.concat(*[p.recommendations for p in parts]).alias("recommendations"),
    )


def _add_up(parts: Column) -> Column:
    """The same for an array of rule results."""
    return F.struct(
        F.aggregate(parts, F.lit(0), lambda acc, p: acc + p.score).alias("score"),
        F.flatten(F.transform(parts, lambda p: p.findings)).alias("findings"),
        F.flatten(F.transform(parts, lambda p: p.recommendations)).alias("recommendations"),
    )


def score_headings(headings: Column) -> Column:
    tags = F.transform(headings, lambda h: h.tag)
    n_words = F.aggregate(headings, F.lit(0), lambda acc, h: acc + T.word_count(h.text))
    facts = F.struct(
        F.size(F.filter(tags, lambda t: t == "h1")).alias("h1"),
        F.array_contains(tags, "h2").alias("has_h2"),
        F.size(headings).alias("total"),
        F.when(F.size(headings) > 0, n_words / F.size(headings)).otherwise(F.lit(0.0)).alias("mean"),
    )

    def bands(x: Column) -> Column:
        return F.array(
            F.when(x.h1 == 1, rule(10, ["h1.single"]))
            .when(x.h1 > 1, rule(5, ["h1.several"], ["h1.keep_one"]))
            .otherwise(rule(0, ["h1.missing"], ["h1.add"])),
            F.when(x.total >= 3, rule(10, ["headings.enough"]))
            .when(x.total > 0, rule(5, ["headings.few"], ["headings.add_more"]))
            .otherwise(rule(0, ["headings.none"], ["headings.add"])),
            F.when((x.h1 > 0) & x.has_h2, rule(10, ["hierarchy.good"]))
            .when(x.h1 > 0, rule(5, ["hierarchy.no_h2"], ["hierarchy.add_h2"]))
            .otherwise(rule(0, ["hierarchy.none"], ["hierarchy.add"])),
            F.when(x["mean"].between(5, 10), rule(10, ["heading_words.good"]))
            .when((x["mean"] >= 1) & (x["mean"] < 5), rule(5, ["heading_words.brief"], ["heading_words.lengthen"]))
            .otherwise(rule(0, ["heading_words.off"], ["heading_words.fix"])),
        )

    return T.let(T.let(facts, bands), _add_up)


def score_body_content(body: Column) -> Column:
    def ratio(found: Column) -> Column:
        share = F.size(F.array_distinct(found)) / F.size(found)
        return F.when(F.size(found) > 0, share).otherwise(F.lit(0.0))

    def bands(r: Column) -> Column:
        points = T.half_even(F.lit(40.0) * r)
        return (
            F.when(r > F.lit(0.7), rule(40, ["body.diverse"]))
            .when(r >= F.lit(0.4), rule(points, ["body.moderate"], ["body.vary"]))
            .otherwise(rule(points, ["body.repetitive"], ["body.rewrite", "body.no_stuffing"]))
        )

    empty = rule(0, ["body.empty"], ["body.write", "body.matters"])
    return F.when(T.is_blank(body), empty).otherwise(T.let(T.let(T.words(body), ratio), bands))


def score_has_schema(flag: Column) -> Column:
    return F.when(flag, rule(20, ["schema.present"])).otherwise(rule(0, ["schema.missing"], ["schema.add"]))


def score_schema_types(names: Column) -> Column:
    def bands(s: Column) -> Column:
        return (
            F.when(s == 0, rule(s, ["types.none"], ["types.add"]))
            .when(s <= 10, rule(s, ["types.basic"], ["types.add_more"]))
            .when(s <= 25, rule(s, ["types.good"]))
            .otherwise(rule(s, ["types.excellent"]))
        )

    return T.let(F.least(_total(names, SCHEMA_TYPE_POINTS), F.lit(30)), bands)


def score_faq(items: Column) -> Column:
    n_words = F.aggregate(items, F.lit(0), lambda acc, x: acc + T.word_count(x.answer))
    facts = F.struct(F.size(items).alias("n"), (n_words / F.size(items)).alias("mean"))

    def bands(x: Column) -> Column:
        n, mean = x["n"], x["mean"]
        return F.array(
            rule(10),
            F.when(n <= 5, rule(_ratio(n, 5, 20), ["faq.limited"], ["faq.add_more"]))
            .when(n <= 10, rule(20, ["faq.good"]))
            .otherwise(rule(F.greatest(20 - (n - 10) * 2, F.lit(7)), ["faq.many"], ["faq.reduce"])),
            F.when(mean < 10, rule(0, ["faq_answers.brief"], ["faq_answers.expand"]))
            .when(mean <= 50, rule(_ratio(mean, 50, 20), ["faq_answers.good"]))
            .otherwise(rule(10, ["faq_answers.long"], ["faq_answers.shorten"])),
        )

    none = rule(0, ["faq.none"], ["faq.add"])
    return F.when(F.size(items) == 0, none).otherwise(T.let(T.let(facts, bands), _add_up))


def score_internal_links(links: Column) -> Column:
    n = F.size(links)
    return (
        F.when(n == 0, rule(0, ["links.none"], ["links.add"]))
        .when(n <= 5, rule(30, ["links.few"], ["links.add_more"]))
        .when(n <= 20, rule(_ratio(n, 20, 100), ["links.good"]))
        .otherwise(rule(F.greatest(100 - (n - 20) * 2, F.lit(50)), ["links.many"], ["links.reduce"]))
    )


def score_images_alt(n: Column) -> Column:
    counted = F.concat(F.lit("images.missing:"), n.cast("string"))
    wide = n.cast("double")
    return (
        F.when(n == 0, rule(100, ["images.good"]))
        .when(n <= 10, rule(T.half_even(100 - wide / 10 * 50), [counted], ["images.add"]))
        .when(n <= 20, rule(T.half_even(50 - (wide - 10) / 10 * 50), [counted], ["images.urgent"]))
        .otherwise(rule(0, ["images.critical", counted], ["images.audit"]))
    )


# rule name, input column, scorer; grouped by category in message order
CATEGORIES = {
    "metadata": [
        ("title", "title", score_title),
        ("meta_description", "meta_description", score_meta_description),
        ("canonical_url", "canonical_url", score_canonical),
        ("meta_robots", "meta_robots", score_meta_robots),
    ],
    "content_quality": [
        ("word_count", "word_count", score_word_count),
        ("headings", "headings", score_headings),
        ("body_text_content", "body_text_content", score_body_content),
    ],
    "structured_data": [
        ("has_schema", "has_schema", score_has_schema),
        ("schema_types", "schema_types", score_schema_types),
        ("faq_items", "faq_items", score_faq),
    ],
    "connectivity": [("internal_links", "internal_links", score_internal_links)],
    "technical_compliance": [("images_without_alt", "images_without_alt", score_images_alt)],
}


@per_context
def _rule_columns(category: str) -> dict[str, Column]:
    return {f"_rule_{name}": scorer(F.col(source)) for name, source, scorer in CATEGORIES[category]}


@per_context
def _category_column(category: str) -> Column:
    rules = CATEGORIES[category]
    total = _sum_rules(*[F.col(f"_rule_{name}") for name, _, _ in rules])
    metrics = F.create_map(
        *chain.from_iterable((F.lit(name), F.col(f"_rule_{name}").score) for name, _, _ in rules)
    )
    return F.struct(
        total.score.alias("score"),
        F.lit(100).alias("max_possible"),
        metrics.alias("metrics"),
        total.findings.alias("findings"),
        total.recommendations.alias("recommendations"),
    ).alias(category)


def with_categories(df: DataFrame, categories: list[str]) -> DataFrame:
    """Add category scores; each rule is evaluated once, in a projection below."""
    keep = df.columns
    rules = {k: v for c in categories for k, v in _rule_columns(c).items()}
    return df.withColumns(rules).select(*keep, *[_category_column(c) for c in categories])


def unreachable_reason(status: Column) -> Column:
    return F.try_element_at(_points(UNREACHABLE_REASONS), status)


def with_reachability(pages: DataFrame) -> DataFrame:
    """Add `reason`, set only for the status codes that make a page unreachable."""
    return pages.withColumn("reason", unreachable_reason(F.col("status_code")))


def unreachable_pages(pages: DataFrame) -> DataFrame:
    return with_reachability(pages).where("reason IS NOT NULL")


def overall_score() -> Column:
    total = None
    for name, weight in CATEGORY_WEIGHTS:
        part = F.col(name).score.cast("double") * F.lit(weight)
        total = part if total is None else total + part
    return T.half_even(total)


def score_pages(parsed: DataFrame) -> DataFrame:
    """Scores of all reachable pages: the page's own columns, five categories, overall score."""
    df = with_reachability(parsed).where("reason IS NULL")
    signals = {"reason", "has_schema", "json_ld_schema", "sections"} | {
        source for rules in CATEGORIES.values() for _, source, _ in rules
    }
    scored = with_categories(df, list(CATEGORIES)).withColumn("overall_score", overall_score())
    return scored.drop(*signals)
