"""Every operator as a query over the given tables, with flat result columns."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.functions import variants as V
from auditloom.operators import jobs as J
from auditloom.operators import links as L
from auditloom.operators import rollup as R
from auditloom.operators import scoring as S
from auditloom.operators import semantic as M
from auditloom.operators import tokens as K
from auditloom.operators.cooldown import client_key, cooldown_admit
from auditloom.operators.extract import parse_pages
from auditloom.plans import fixtures as X
from auditloom.plans.audit import audit_pages, audit_sites
from auditloom.session import checkpoint, configure, scratch_folder
from auditloom.sources.captures import fetch_ok, page_scan, scan_json
from auditloom.streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEP = "|"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def joined(col: Column) -> Column:
    return F.array_join(col, SEP)


def _enriched(spark, d) -> DataFrame:
    return X.table(spark, d, X.ENRICHED_PAGES)


def _captures(spark, d) -> DataFrame:
    rows = X.table(spark, d, X.SITE_CAPTURES)
    return rows.withColumn("fetched_at", F.timestamp_seconds("fetched")).drop("fetched")


def _parsed(spark, d) -> DataFrame:
    return parse_pages(_enriched(spark, d))


def _site_parsed(spark, d) -> DataFrame:
    return parse_pages(_captures(spark, d).drop("fetched_at"))


def _sites(spark, d) -> DataFrame:
    # one site more than there are captures for
    rows = spark.read.parquet(f"{d}/pages.parquet").select((F.col("page_id") % 9).cast("int").alias("site_id"))
    return rows.distinct().withColumn("url", F.concat(F.lit("https://site"), "site_id", F.lit(".example.com")))


# 2.1 sources and jobs


@query
def page_scan_query(spark, d):
    return page_scan(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


@query
def page_scan_json(spark, d):
    folder = f"{scratch_folder(spark)}/captures"
    line = F.to_json(F.struct("page_id", "url", "html"))
    case = F.col("page_id") % 10
    torn = F.when(case == 3, F.expr("left(line, length(line) - 12)")).when(case == 7, F.regexp_replace("line", '"page_id":([0-9]+)', '"page_id":"x$1"'))
    spark.read.parquet(f"{d}/pages.parquet").select("page_id", line.alias("line")).select(F.coalesce(torn, "line")).write.text(folder)
    rows = scan_json(spark, folder)
    return rows.select(
        "page_id", "url", F.length("html").alias("n_chars"), F.regexp_extract("rescued", '"page_id":"?(x?[0-9]+)', 1).alias("rescued_id")
    )


@query
def fetch_ok_filter(spark, d):
    return fetch_ok(_enriched(spark, d)).select("page_id", "status_code")


def _audit(spark, d):
    return audit_pages(_sites(spark, d), _captures(spark, d))


@query
def report_write(spark, d):
    text = J.report_json(_audit(spark, d).report)

    def field(path):
        return F.get_json_object("result", path)

    return text.select(
        "site_id",
        field("$.url").alias("url"),
        field("$.pages_crawled").cast("int").alias("pages_crawled"),
        field("$.overall_score").cast("int").alias("overall_score"),
        field("$.findings[0]").alias("first_finding"),
        field("$.pages_scored").cast("int").alias("n_pages"),
    )


def _job_id():
    return F.concat(F.lit("job-"), "site_id")


def _jobs_with_reports(report):
    return J.job_outcome(report.withColumn("job_id", _job_id()), F.timestamp_seconds(F.lit(1704153600)))


@query
def report_read(spark, d):
    audit = _audit(spark, d)
    jobs = _jobs_with_reports(audit.report)
    pages = J.report_pages(jobs, audit.details.withColumn("job_id", _job_id()))
    points = pages.groupBy("job_id").agg(
        F.count("page").cast("int").alias("n_pages"), F.sum(F.col("page.content_quality.score")).cast("int").alias("content_points")
    )
    r = F.col("result")
    return J.read_reports(jobs).join(points, "job_id", "left").select(
        "job_id",
        "status",
        "error_message",
        r.overall_score.alias("overall_score"),
        r.pages_crawled.alias("pages_crawled"),
        joined(r.findings).alias("findings"),
        "n_pages",
        "content_points",
    )


@query
def job_life_cycle(spark, d):
    # an audit request for every site, its run, and the outcome that its report decides
    def at(column, seconds):
        return F.timestamp_seconds(F.lit(1704067200 + seconds) + F.col(column))

    sites = _sites(spark, d)
    requests = sites.select(F.col("site_id").cast("long").alias("event_id"), at("site_id", 0).alias("ts"), "url", F.lit("a@example.org").alias("email"))
    created = J.create_jobs(requests)
    running = J.progress_events(created, {status: at("event_id", 60 * (k + 1)) for k, status in enumerate(J.RUNNING)})
    report = _audit(spark, d).report.join(created.select("job_id", F.col("event_id").cast("int").alias("site_id")), "site_id")
    events = J.job_events(created, running, J.job_outcome(report, at("site_id", 600)))
    r = F.col("result")
    return J.job_reports(events).select(
        "job_id", "url", "email", "status", "error_message", "created_at", "updated_at", "completed_at",
        r.overall_score.alias("overall_score"), r.pages_crawled.alias("pages_crawled"), joined(r.findings).alias("findings"),
    )


@query
def report_pages(spark, d):
    audit = _audit(spark, d)
    return audit.details.select(
        "site_id", "crawl_pos", "url", F.col("page.overall_score").alias("page_score"),
        F.col("semantic.overall_score").alias("semantic_score"), F.size("semantic.section_scores").alias("n_sections"),
        F.col("unreachable.status_code").alias("gone_code"), F.col("unreachable.reason").alias("gone_reason"),
    )


@query
def job_outcome(spark, d):
    return _jobs_with_reports(_audit(spark, d).report).select(
        "job_id", "status", "error_message", "url", F.col("result").isNotNull().alias("has_result")
    )


@query
def job_latest_state(spark, d):
    return J.job_latest_state(X.table(spark, d, X.JOB_EVENTS)).select(
        "job_id", "status", "error_message", "created_at", "updated_at"
    )


@query
def job_lookup(spark, d):
    # the filter moves below the aggregation, into the scan
    return J.job_lookup(J.job_latest_state(X.table(spark, d, X.JOB_EVENTS)), "job-7").select(
        "job_id", "status", "error_message"
    )


@query
def job_create(spark, d):
    rows = X.table(spark, d, X.REQUESTS).select(
        "event_id", "ts", F.concat(F.lit("https://"), client_key(F.col("xff"))).alias("url"), F.lit("a@example.org").alias("email")
    )
    return J.create_jobs(rows).select("job_id", "event_id", "url", "status")


# 2.2 URLs


def _link_shapes(spark, d):
    shapes = F.posexplode(F.array(*[F.lit(h) for h in X.LINK_SHAPES])).alias("case_id", "href")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", shapes)


@query
def url_resolve(spark, d):
    resolved = U.resolve(F.col("href"), F.col("url"))
    return _link_shapes(spark, d).select("page_id", "case_id", resolved.alias("resolved"))


@query
def url_same_host(spark, d):
    same = U.let(U.resolve(F.col("href"), F.col("url")), lambda u: U.same_host(u, F.col("url")))
    return _link_shapes(spark, d).select("page_id", "case_id", same.alias("same_host"))


@query
def url_normalize(spark, d):
    link = U.normalize(F.col("href"), F.col("url"))
    return _link_shapes(spark, d).select("page_id", "case_id", link.alias("link"))


# 2.3 extraction


@query
def html_tokens(spark, d):
    tokens = K.html_tokens(spark.read.parquet(f"{d}/pages.parquet"))
    return tokens.where("pos IS NOT NULL").select("page_id", "pos", "kind", "tag", F.length("raw").alias("n_chars"))


@query
def element_spans(spark, d):
    return K.element_spans(_enriched(spark, d))


@query
def pruned_tokens(spark, d):
    return K.pruned_tokens(_enriched(spark, d)).select("page_id", "pos", "kind", "tag")


@query
def page_title(spark, d):
    return _parsed(spark, d).select("page_id", "title")


@query
def meta_description(spark, d):
    return _parsed(spark, d).select("page_id", "meta_description")


@query
def meta_robots(spark, d):
    return _parsed(spark, d).select("page_id", "meta_robots")


@query
def canonical_url(spark, d):
    return _parsed(spark, d).select("page_id", "canonical_url")


@query
def headings(spark, d):
    rows = _parsed(spark, d).select("page_id", F.posexplode("headings").alias("pos", "h"))
    return rows.select("page_id", "pos", "h.tag", "h.text")


@query
def body_text(spark, d):
    return _parsed(spark, d).select("page_id", "body_text_content")


@query
def word_count(spark, d):
    return _parsed(spark, d).select("page_id", "word_count")


@query
def internal_links(spark, d):
    return _parsed(spark, d).select("page_id", F.posexplode("internal_links").alias("pos", "link"))


@query
def images_without_alt(spark, d):
    return _parsed(spark, d).select("page_id", "images_without_alt")


@query
def jsonld_blocks(spark, d):
    return _parsed(spark, d).select("page_id", F.posexplode("json_ld_schema").alias("block", "text"))


def _blocks(spark, d):
    rows = jsonld_blocks(spark, d)
    return rows.withColumns(
        {"node": V.parse_json_strict(F.col("text")), "depth": V.json_depth(F.col("text"))}
    )


@query
def jsonld_walk(spark, d):
    rows = _blocks(spark, d).select("page_id", "block", F.inline(V.walk(F.col("node"), F.col("depth"))))
    return rows.where("depth > 0").select(
        "page_id", "block", "depth", "path", "key", V.string_of(F.col("value")).alias("string_value")
    )


@query
def schema_types(spark, d):
    return _parsed(spark, d).select("page_id", joined(F.col("schema_types")).alias("schema_types"))


@query
def has_schema(spark, d):
    return _parsed(spark, d).select("page_id", "has_schema")


@query
def faq_build(spark, d):
    entity = F.try_variant_get("node", "$.mainEntity", "variant")
    rows = _blocks(spark, d).withColumn("entity", entity).where("entity IS NOT NULL")
    built = rows.select("page_id", "block", F.posexplode(V.faq_build(F.col("entity"), F.col("depth"))).alias("pos", "item"))
    return built.select("page_id", "block", "pos", "item.question", "item.answer")


@query
def faq_items(spark, d):
    rows = _parsed(spark, d).select("page_id", F.posexplode("faq_items").alias("pos", "item"))
    return rows.select("page_id", "pos", "item.question", "item.answer")


@query
def sections(spark, d):
    return _parsed(spark, d).select("page_id", F.inline("sections"))


@query
def parse_page(spark, d):
    return _parsed(spark, d).select(
        "page_id", "url", "status_code", "word_count", "has_schema", "images_without_alt", "title",
        "meta_description", "meta_robots", "canonical_url", "body_text_content",
        joined(F.transform("headings", lambda h: F.concat(h.tag, F.lit("="), h.text))).alias("headings"),
        joined(F.col("internal_links")).alias("internal_links"),
        joined(F.col("json_ld_schema")).alias("json_ld_schema"),
        joined(F.col("schema_types")).alias("schema_types"),
        joined(F.transform("faq_items", lambda q: F.concat(q.question, F.lit("="), q.answer))).alias("faq_items"),
        joined(F.transform("sections", lambda s: F.concat(s.heading, F.lit("="), s.content))).alias("sections"),
    )


# 2.4 link graph


def _site_pages(spark, d):
    return X.table(spark, d, X.SITE_PAGES)


def _robots(spark, d):
    return X.table(spark, d, X.ROBOTS)


def _seeds(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select((F.col("page_id") % 4).cast("int").alias("site_id")).distinct()
    return rows.withColumn("seed_url", F.concat(F.lit("https://S"), "site_id", F.lit(".example.com/p0/?start=1")))


def _links(spark, d):
    """Links of the captured pages."""
    return L.crawl_links(spark.read.parquet(f"{d}/pages.parquet"))


@query
def robots_rules(spark, d):
    return L.robots_rules(_robots(spark, d)).select("host", "entry", "agents", "line", "allow", "path")


@query
def crawl_links(spark, d):
    return _links(spark, d).select("page_id", "pos", "target")


@query
def robots_filter(spark, d):
    return L.robots_filter(_links(spark, d), _robots(spark, d)).select("page_id", "pos", "target")


@query
def robots_filter_allow(spark, d):
    return L.robots_filter(_links(spark, d), _robots(spark, d), missing_robots="allow").select("page_id", "pos", "target")


@query
def new_links(spark, d):
    # links of every third page have been visited in earlier rounds, as have their pages
    links = _links(spark, d).select((F.col("page_id") % 4).cast("int").alias("site_id"), F.col("page_id").alias("crawl_pos"), "pos", "target")
    before = F.col("crawl_pos") % 3 == 0
    return L.new_links(links.where(~before), links.where(before).select("site_id", F.col("target").alias("url")))


def _replay(spark, d, **options):
    robots = X.table(spark, d, X.SITE_ROBOTS) if options.pop("robots", False) else None
    rows = L.crawl_replay(_site_pages(spark, d), _seeds(spark, d), robots, **options)
    return rows.select("site_id", "crawl_pos", "page_id", "url")


@query
def crawl_replay(spark, d):
    return _replay(spark, d)


@query
def crawl_replay_limit_5(spark, d):
    return _replay(spark, d, limit=5)


@query
def crawl_replay_robots(spark, d):
    return _replay(spark, d, limit=10, robots=True)


@query
def crawl_replay_robots_allow(spark, d):
    return _replay(spark, d, limit=10, robots=True, missing_robots="allow")


# 2.5 rules


def _rule_query(name, source, scorer):
    def run(spark, d):
        rows = _parsed(spark, d).select("page_id", scorer(F.col(source)).alias("r"))
        return rows.select(
            "page_id", "r.score", joined(F.col("r.findings")).alias("findings"),
            joined(F.col("r.recommendations")).alias("recommendations"),
        )

    run.__name__ = name
    query(run)


for _name, _source, _scorer in [
    ("score_title", "title", S.score_title),
    ("score_meta_description", "meta_description", S.score_meta_description),
    ("score_canonical", "canonical_url", S.score_canonical),
    ("score_meta_robots", "meta_robots", S.score_meta_robots),
    ("score_word_count", "word_count", S.score_word_count),
    ("score_headings", "headings", S.score_headings),
    ("score_body_content", "body_text_content", S.score_body_content),
    ("score_has_schema", "has_schema", S.score_has_schema),
    ("score_schema_types", "schema_types", S.score_schema_types),
    ("score_faq", "faq_items", S.score_faq),
    ("score_internal_links", "internal_links", S.score_internal_links),
    ("score_images_alt", "images_without_alt", S.score_images_alt),
]:
    _rule_query(_name, _source, _scorer)


def _category_query(name, category):
    def run(spark, d):
        rows = S.with_categories(_parsed(spark, d), [category])
        c = F.col(category)
        metrics = F.transform(F.map_entries(c.metrics), lambda e: F.concat(e.key, F.lit("="), e.value))
        return rows.select(
            "page_id", c.score.alias("score"), c.max_possible.alias("max_possible"),
            joined(F.array_sort(metrics)).alias("metrics"), joined(c.findings).alias("findings"),
            joined(c.recommendations).alias("recommendations"),
        )

    run.__name__ = name
    query(run)


for _name, _category in [
    ("category_metadata", "metadata"),
    ("category_content", "content_quality"),
    ("category_structured", "structured_data"),
    ("category_connectivity", "connectivity"),
    ("category_technical", "technical_compliance"),
]:
    _category_query(_name, _category)


@query
def reachability(spark, d):
    return S.with_reachability(_enriched(spark, d)).select(
        "page_id", "status_code", F.col("reason").isNull().alias("scorable"), "reason"
    )


@query
def score_page(spark, d):
    return S.score_pages(_parsed(spark, d)).select(
        "page_id", "overall_score", *[F.col(c).score.alias(f"{c}_score") for c in S.CATEGORIES]
    )


# 2.6 roll-ups


def _scores(spark, d):
    return S.score_pages(_site_parsed(spark, d))


@query
def site_score(spark, d):
    return R.site_scores(_scores(spark, d), _sites(spark, d))


@query
def site_messages(spark, d):
    return R.site_messages(_scores(spark, d))


def _top(spark, d, kind):
    tops = R.top_messages(R.site_messages(_scores(spark, d)))
    return tops.where(F.col("kind") == kind).select("site_id", "rank", "message", "n")


@query
def top_findings(spark, d):
    return _top(spark, d, "finding")


@query
def top_recommendations(spark, d):
    return _top(spark, d, "recommendation")


def _flat_report(report):
    return report.select(
        "site_id", "url", "pages_crawled", "pages_scored", "pages_unreachable", "overall_score", "semantic_score",
        *[joined(F.col(c)).alias(c) for c in ("findings", "recommendations", "semantic_findings", "semantic_recommendations")],
        "crawl_duration_seconds",
    )


@query
def site_report(spark, d):
    return _flat_report(_audit(spark, d).report)


@query
def report_messages(spark, d):
    tops = R.top_messages(R.site_messages(_scores(spark, d)))
    return tops.select("site_id", "kind", "rank", R.message_text(F.col("message")).alias("text"), "n")


@query
def audit_from_seed(spark, d):
    # the first and the last page of each host are seeds
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", U.host(F.col("url")).alias("host"))
    ends = pages.groupBy("host").agg(F.array_distinct(F.array(F.min("page_id"), F.max("page_id"))).alias("ends"))
    seeds = ends.select(F.explode("ends").alias("page_id")).join(pages, "page_id")
    seeds = seeds.select(F.col("page_id").cast("int").alias("site_id"), F.col("url").alias("seed_url"))
    return _flat_report(audit_sites(_captures(spark, d).drop("site_id", "crawl_pos"), seeds).report)


@query
def crawl_duration(spark, d):
    return R.crawl_durations(_captures(spark, d))


@query
def audit_digest(spark, d):
    digest = R.audit_digest(_audit(spark, d).report)
    lists = ("findings", "semantic_findings", "recommendations", "semantic_recommendations")
    return digest.select(
        "site_id", "url", "overall_score", "semantic_score", "pages_crawled", "crawl_duration_seconds",
        *[joined(F.col(c)).alias(c) for c in lists],
    )


@query
def category_rollup(spark, d):
    return R.category_rollup(_scores(spark, d))


# 2.7 semantics


@query
def chunks(spark, d):
    return M.text_chunks(_parsed(spark, d)).select("page_id", "section_position", "heading", "content")


@query
def embed_chunks(spark, d):
    rows = M.embed_with_bag(M.text_chunks(_parsed(spark, d)))
    flat = rows.select("page_id", "section_position", F.posexplode("content_vector").alias("bucket", "weight"))
    return flat.where("weight <> 0").select("page_id", "section_position", "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def _letter_counts():
    """A model without weights: length, two letters and blanks of a text."""

    def predict(texts):
        return np.array([[len(t), t.count("e"), t.count("n"), t.count(" ")] for t in texts], dtype="float32")

    return predict


@query
def embed_chunks_model(spark, d):
    parsed = checkpoint(M.text_chunks(_parsed(spark, d)))
    folder = f"{scratch_folder(spark)}/vectors"
    # an earlier run has embedded every third page
    M.embed_with_store(parsed.where("page_id % 3 = 0"), _letter_counts, folder)
    rows = M.embed_with_store(parsed, _letter_counts, folder)
    sides = [F.transform(f"{side}_vector", lambda x: F.round(x.cast("double"), 5)) for side in ("heading", "content")]
    values = [side[k].alias(f"{name}{k}") for name, side in zip("hc", sides) for k in range(4)]
    return rows.select("page_id", "section_position", *values)


def _vector_chunks(spark, d):
    rows = X.table(spark, d, X.CHUNK_VECTORS)
    return rows.select(
        "chunk_id",
        "page_id",
        (F.col("page_id") % 5).cast("int").alias("site_id"),
        F.floor(F.col("page_id") / 5).cast("int").alias("crawl_pos"),
        F.col("chunk_id").cast("int").alias("section_position"),
        F.concat(F.lit("h"), "chunk_id").alias("heading"),
        F.col("hv").alias("heading_vector"),
        F.col("cv").alias("content_vector"),
    )


@query
def embed_chunks_table(spark, d):
    chunks_only = _vector_chunks(spark, d).drop("heading_vector", "content_vector")
    vectors = _vector_chunks(spark, d).select("chunk_id", "heading_vector", "content_vector")
    rows = M.embed_with_table(chunks_only, vectors, ["chunk_id"])
    return rows.select("chunk_id", "page_id", F.size("heading_vector").alias("n_dims"))


@query
def alignment_score(spark, d):
    return M.score_chunks(_vector_chunks(spark, d)).select("chunk_id", "alignment_score")


@query
def alignment_band(spark, d):
    return M.score_chunks(M.embed_with_bag(M.text_chunks(_parsed(spark, d)))).select(
        "page_id", "section_position", "alignment_score", "finding", "recommendation"
    )


def _semantic_pages(spark, d):
    return M.page_semantic(M.score_chunks(_vector_chunks(spark, d)))


@query
def page_semantic(spark, d):
    return _semantic_pages(spark, d).select(
        "page_id", "overall_score", "finding", "recommendation",
        joined(F.transform("section_scores", lambda s: F.concat(s.heading, F.lit("="), s.alignment_score))).alias("sections"),
    )


@query
def site_semantic(spark, d):
    pages = _semantic_pages(spark, d)
    tops = R.top_lists(M.top_semantic_messages(pages))
    return M.site_semantic(pages).join(tops, "site_id").select(
        "site_id", "overall_score", joined(F.col("findings")).alias("findings"),
        joined(F.col("recommendations")).alias("recommendations"),
    )


# 2.8 streams


@query
def client_key_query(spark, d):
    return X.table(spark, d, X.REQUESTS).select("event_id", client_key(F.col("xff")).alias("client"))


def _client_requests(spark, d):
    return X.table(spark, d, X.REQUESTS).select("event_id", "ts", client_key(F.col("xff")).alias("client"))


@query
def cooldown_admit_query(spark, d):
    return cooldown_admit(_client_requests(spark, d)).select("event_id", "client", "admitted")


@query
def cooldown_admit_day(spark, d):
    return cooldown_admit(_client_requests(spark, d), 86400).select("event_id", "client", "admitted")


def _stream(spark, d, name):
    """A table's files as a stream, be the table one file or a folder of them."""
    # a path with a pattern, as a stream takes a plain path for a folder; a filter on file names misses those inside one
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


@query
def stream_cooldown(spark, d):
    folder = scratch_folder(spark)
    key = client_key(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(", proxy")))
    requests = _stream(spark, d, "events").select("event_id", "ts", key.alias("client"))
    ST.cooldown_stream(requests, folder, f"{folder}/checkpoints", 86400).awaitTermination()
    return ST.read_admitted(spark, folder, 86400, ended=True).select("event_id", "client")


@query
def stream_job_state(spark, d):
    folder = scratch_folder(spark)
    status = (
        F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "CRAWLING")
        .when(F.col("event_type") == "click", "SCORING").when(F.col("event_type") == "purchase", "SUCCESS")
        .otherwise("FAILURE")
    )
    events = _stream(spark, d, "events").select(
        F.concat(F.lit("job-"), "user_id").alias("job_id"), "ts", "event_id", status.alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
    )
    ST.job_state_stream(events, folder, f"{folder}/state").awaitTermination()
    return ST.read_job_state(spark, folder, events.schema).select(
        "job_id", "status", "error_message", "created_at", "updated_at"
    )


@query
def stream_page_audit(spark, d):
    folder = scratch_folder(spark)
    captures = _stream(spark, d, "pages").select(
        (F.col("page_id") % 8).cast("int").alias("site_id"),
        F.floor(F.col("page_id") / 8).cast("int").alias("crawl_pos"),
        "page_id", "url", "html", F.lit(200).alias("status_code"),
        F.timestamp_seconds(1704067200 + F.col("page_id")).alias("fetched_at"),
    )
    ST.page_audit_stream(captures, _sites(spark, d), folder, f"{folder}/state").awaitTermination()
    pages = ST.read_latest_details(spark, folder).groupBy("site_id").agg(F.sum("page.overall_score").alias("points"))
    return ST.read_latest_reports(spark, folder).join(pages, "site_id", "left").select(
        "site_id", "pages_crawled", "pages_scored", "overall_score", "semantic_score",
        joined(F.col("findings")).alias("findings"), joined(F.col("semantic_findings")).alias("semantic_findings"), "points",
    )


for _old, _new in [("page_scan_query", "page_scan"), ("client_key_query", "client_key"), ("cooldown_admit_query", "cooldown_admit")]:
    QUERIES[_new] = QUERIES.pop(_old)
