"""Every rule at the edges of its bands, and the page score."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import scoring as S


def w(n):
    return " ".join(f"w{i}" for i in range(n))


def run(spark, scorer, ddl, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {ddl}")
    rows = df.select("id", scorer(F.col("v")).alias("r")).orderBy("id").collect()
    return [(r.r.score, len(r.r.findings), len(r.r.recommendations)) for r in rows]


HEADS = "array<struct<tag:string,text:string>>"
FAQ = "array<struct<question:string,answer:string>>"
CASES = [
    (S.score_title, "string", [(None, (0, 2, 2)), ("", (0, 2, 2)), (" ", (0, 1, 2)), (w(4), (24, 1, 2)), (w(5), (30, 1, 0)), (w(15), (30, 1, 0)), (w(16), (28, 1, 1)), (w(40), (10, 1, 1))]),
    (S.score_meta_description, "string", [(None, (0, 2, 2)), (w(5), (10, 1, 2)), (w(14), (28, 1, 2)), (w(15), (30, 1, 0)), (w(20), (30, 1, 0)), (w(21), (28, 1, 1)), (w(99), (10, 1, 1))]),
    (S.score_canonical, "string", [(None, (0, 1, 1)), ("", (0, 1, 1)), ("x", (20, 1, 0))]),
    (S.score_meta_robots, "string", [(None, (12, 1, 1)), ("index, follow", (20, 1, 0)), ("NOINDEX", (2, 1, 1)), ("none", (0, 1, 1)), ("all, none", (12, 1, 1)), ("noarchive,nosnippet", (2, 1, 1)), ("index,noarchive", (17, 1, 0)), ("odd", (12, 1, 1))]),
    (S.score_word_count, "int", [(0, (0, 1, 2)), (799, (20, 1, 2)), (100, (2, 1, 2)), (800, (20, 1, 0)), (2500, (20, 1, 0)), (2501, (18, 1, 2)), (9999, (7, 1, 2))]),
    (S.score_headings, HEADS, [([], (0, 4, 4)), ([("h1", w(5)), ("h2", w(5)), ("h3", w(5))], (40, 4, 0)), ([("h1", "a"), ("h1", "b")], (20, 4, 4)), ([("h2", w(11))], (5, 4, 4)), ([("h1", w(10)), ("h2", "")], (35, 4, 1))]),
    (S.score_body_content, "string", [(None, (0, 1, 2)), (w(10), (40, 1, 0)), ("a b a b c", (24, 1, 1)), ("a a a a b", (16, 1, 1)), ("a a a", (13, 1, 2)), ("A a", (40, 1, 0))]),
    (S.score_has_schema, "boolean", [(True, (20, 1, 0)), (False, (0, 1, 1))]),
    (S.score_schema_types, "array<string>", [([], (0, 1, 1)), (["Odd"], (0, 1, 1)), (["Product", "Organization"], (10, 1, 1)), (["Product", "Organization", "Event"], (13, 1, 0)), (["Product", "Organization", "Article", "BreadcrumbList", "LocalBusiness", "Person"], (26, 1, 0)), (["Product"] * 9, (30, 1, 0))]),
    (S.score_faq, FAQ, [([], (0, 1, 1)), ([("q", w(9))], (14, 2, 2)), ([("q", w(25))] * 5, (40, 2, 1)), ([("q", w(50))] * 6, (50, 2, 0)), ([("q", w(60))] * 12, (36, 2, 2)), ([("q", "a")] * 30, (17, 2, 2))]),
    (S.score_internal_links, "array<string>", [([], (0, 1, 1)), (["x"] * 5, (30, 1, 1)), (["x"] * 6, (30, 1, 0)), (["x"] * 20, (100, 1, 0)), (["x"] * 21, (98, 1, 1)), (["x"] * 60, (50, 1, 1))]),
    (S.score_images_alt, "int", [(0, (100, 1, 0)), (1, (95, 1, 1)), (10, (50, 1, 1)), (11, (45, 1, 1)), (20, (0, 1, 1)), (21, (0, 2, 1))]),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0].__name__ for c in CASES])
def test_rule(spark, case):
    scorer, ddl, rows = case
    assert run(spark, scorer, ddl, [v for v, _ in rows]) == [want for _, want in rows]


def bare_pages(spark, rows):
    schema = (
        "page_id long, status_code int, title string, meta_description string, canonical_url string, meta_robots string,"
        f"word_count int, headings {HEADS}, body_text_content string, has_schema boolean, schema_types array<string>,"
        f"faq_items {FAQ}, internal_links array<string>, images_without_alt int"
    )
    return spark.createDataFrame(
        [(i, code, None, None, None, None, 0, [], None, schema_, [], [], [], 0) for i, (code, schema_) in enumerate(rows)], schema
    )


def test_page_score(spark):
    pages = bare_pages(spark, [(200, False), (201, True), (404, True), (299, False)])
    scores = {r.page_id: r for r in S.score_pages(pages).collect()}
    assert {k: v.overall_score for k, v in scores.items()} == {0: 8, 1: 16, 3: 8}
    assert scores[0].metadata.score == 12 and scores[0].content_quality.score == 0
    assert [r.page_id for r in S.unreachable_pages(pages).collect()] == [2]
    for r in scores.values():
        for c in S.CATEGORIES:
            assert 0 <= r[c].score <= 100
            assert r[c].score == sum(r[c].metrics.values())


def test_all_messages_have_wording(spark):
    from auditloom.schemas import MESSAGES

    scores = S.score_pages(bare_pages(spark, [(200, False), (200, True)])).collect()
    for r in scores:
        for c in S.CATEGORIES:
            for code in [*r[c].findings, *r[c].recommendations]:
                assert code in MESSAGES or code.split(":")[0] + ":" in MESSAGES
