"""The whole audit as one job: crawl replay, parse, score, roll up."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.extract import parse_pages
from auditloom.operators.links import DEFAULT_AGENT, crawl_replay
from auditloom.operators.rollup import page_details, site_report
from auditloom.operators.scoring import score_pages, unreachable_pages
from auditloom.operators.semantic import embed_with_bag, page_semantic, score_chunks, text_chunks
from auditloom.session import checkpoint


class Audit(NamedTuple):
    parsed: DataFrame
    scores: DataFrame
    unreachable: DataFrame
    semantic_pages: DataFrame
    report: DataFrame
    details: DataFrame


PLACE = ["site_id", "crawl_pos"]


def audit_pages(sites: DataFrame, captures: DataFrame, embed=embed_with_bag, store: bool = True, clustered: bool = False) -> Audit:
    """Audit captures that already carry site_id and crawl_pos.

    A page that several sites hold is parsed once: `page_id` stands for one capture. Parsed pages feed scores and
    semantics, and both feed several roll-ups; each is written once (`store`) rather than computed by every consumer.
    `clustered`: captures are bucketed on `page_id` and each page is there once, so parsing needs no exchange.
    """
    keep = checkpoint if store else lambda df: df
    pages = captures.drop(*PLACE)
    parsed = parse_pages(pages if clustered else pages.dropDuplicates(["page_id"]), clustered)
    parsed = keep(parsed.join(captures.select("page_id", *PLACE), "page_id"))
    return _rolled_up(sites, captures.drop("html"), parsed, embed, keep)


def _rolled_up(sites: DataFrame, captures: DataFrame, parsed: DataFrame, embed, keep) -> Audit:
    scores = keep(score_pages(parsed))
    gone = unreachable_pages(parsed).select(*PLACE, "url", "status_code", "reason")
    semantic = keep(page_semantic(score_chunks(embed(text_chunks(parsed)))))
    report = site_report(sites, captures, scores, gone, semantic)
    return Audit(parsed, scores, gone, semantic, report, page_details(scores, gone, semantic))


def audit_sites(
    pages: DataFrame,
    seeds: DataFrame,
    robots: DataFrame | None = None,
    limit: int = 20,
    agent: str = DEFAULT_AGENT,
    missing_robots: str = "deny",
    embed=embed_with_bag,
    clustered: bool = False,
) -> Audit:
    """Audit many sites from their seed URLs: (site_id, seed_url) over a table of captured pages.

    Only pages that some crawl reached are parsed, each once however many sites reached it.
    """
    crawl = checkpoint(crawl_replay(pages, seeds, robots, limit, agent, missing_robots).select("page_id", *PLACE))
    reached = pages.drop(*PLACE).join(crawl, "page_id", "left_semi")
    parsed = checkpoint(parse_pages(reached, clustered).join(crawl, "page_id"))
    sites = seeds.select("site_id", F.col("seed_url").alias("url"))
    captures = pages.select("page_id", "fetched_at").join(crawl, "page_id")
    return _rolled_up(sites, captures, parsed, embed, checkpoint)
