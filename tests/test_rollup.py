"""Site roll-ups, semantics, jobs, cooldown and the stream forms."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import cooldown as C
from auditloom.operators import jobs as J
from auditloom.operators import rollup as R
from auditloom.operators import semantic as M
from auditloom.operators.cooldown import client_key, cooldown_admit
from auditloom.plans.audit import audit_pages, audit_sites
from auditloom.plans.catalog import QUERIES
from auditloom.session import scratch_folder
from auditloom.sources.captures import write_reports
from auditloom.streaming import streams as ST


def test_top_messages_break_ties_by_first_place(spark):
    rng = random.Random(3)
    rows = []
    for site in range(3):
        for page in range(40):
            for pos in range(4):
                rows.append((site, "finding", page, 0, pos, f"m{rng.randrange(12)}"))
    df = spark.createDataFrame(rows, "site_id int, kind string, crawl_pos int, category_pos int, pos int, message string")
    for parts in (1, 7):
        got = {}
        for r in R.top_messages(df.repartition(parts)).collect():
            got.setdefault(r.site_id, []).append((r.rank, r.message))
        for site in range(3):
            want = [m for m, _ in Counter(r[5] for r in rows if r[0] == site).most_common(5)]
            assert [m for _, m in sorted(got[site])] == want


def test_site_score_is_half_even(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3)], "site_id int, overall_score int")
    sites = spark.createDataFrame([(0,), (1,), (2,)], "site_id int")
    got = {r.site_id: r.overall_score for r in R.site_scores(df, sites).collect()}
    assert got == {0: 2, 1: 2, 2: 0}


def test_semantic_bands(spark):
    def pair(score):
        return [1.0, 0.0], [score / 100, (1 - (score / 100) ** 2) ** 0.5]

    rows = [(0, i, f"h{i}", *pair(s)) for i, s in enumerate((71, 70, 31, 30, -20))]
    df = spark.createDataFrame(rows, "page_id long, section_position int, heading string, heading_vector array<double>, content_vector array<double>")
    got = M.score_chunks(df).orderBy("section_position").collect()
    assert [r.alignment_score for r in got] == [71, 70, 31, 30, -20]
    assert [r.finding.split(":")[0].split(".")[1] for r in got] == ["coherent", "drifts", "drifts", "misaligned", "misaligned"]
    page = M.page_semantic(M.score_chunks(df)).first()
    assert page.overall_score == round((71 + 70 + 31 + 30 - 20) / 5) and page.finding == "page.poor"


def test_model_hook(spark):
    def make_predict():
        def predict(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype="float32")

        return predict

    df = spark.createDataFrame([(0, 0, "ab", "abcd")], "page_id long, section_position int, heading string, content string")
    row = M.embed_with_model(df, make_predict).first()
    assert abs(sum(x * x for x in row.content_vector) - 1) < 1e-6


def brute_force(rows, seconds):
    last, good = {}, set()
    for event_id, ts, client in sorted(rows, key=lambda r: (r[1], r[0])):
        if client not in last or ts >= last[client] + timedelta(seconds=seconds):
            last[client] = ts
            good.add(event_id)
    return good


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cooldown_with_a_hot_client(spark, seed):
    rng = random.Random(seed)
    start, rows = datetime(2024, 1, 1), []
    for i in range(6000):
        client = "hot" if rng.random() < 0.4 else f"c{rng.randrange(200)}"
        rows.append((i, start + timedelta(seconds=rng.randrange(40000), microseconds=rng.choice([0, 500])), client))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, client string")
    got = {r.event_id for r in cooldown_admit(df, 300, partitions=13).where("admitted").collect()}
    assert got == brute_force(rows, 300)


def test_cooldown_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng, start = random.Random(9), datetime(2024, 1, 1)
        rows = [(i, start + timedelta(seconds=rng.randrange(5000)), rng.choice(["a", "a", "b", "c"])) for i in range(500)]
        df = spark.createDataFrame(rows, "event_id long, ts timestamp, client string")
        for parts in (1, 5):
            got = {r.event_id for r in cooldown_admit(df, 60, partitions=parts).where("admitted").collect()}
            assert got == brute_force(rows, 60)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seconds, bits", [(86400, 9), (300, 9), (86400, 5)])
def test_cooldown_of_one_busy_client(spark, seconds, bits):
    rng, start, n = random.Random(seconds + bits), datetime(2024, 1, 1), 20_000 if bits == 9 else 2_000
    rows = [(i, start + timedelta(seconds=rng.randrange(30 * 86400)), "one") for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, client string")
    got = {r.event_id for r in cooldown_admit(df, seconds, partitions=5, piece_bits=bits).where("admitted").collect()}
    assert got == brute_force(rows, seconds)
    # no step sees more of the client than a piece, or a row for each of its pieces
    pieces = C.ranged_pieces(df.select("client", F.unix_micros("ts").alias("at")).distinct(), ["client", "at"], bits, 5)
    assert pieces.groupBy("piece").count().agg(F.max("count")).first()[0] <= 1 << bits
    entries = pieces.mapInPandas(C._entries(seconds * 1_000_000), "client string, piece long, entry long, until long")
    assert entries.groupBy("piece").count().agg(F.max("count")).first()[0] <= 1 << bits


def test_next_at_or_after(spark):
    rng = random.Random(4)
    points = sorted({(rng.choice("abc"), rng.randrange(1000)) for _ in range(150)})
    probes = sorted({(rng.choice("abcd"), rng.randrange(1100)) for _ in range(300)})
    frames = [spark.createDataFrame(x, "client string, at long") for x in (points, probes)]
    for bits in (2, 16):
        got = {(r.client, r.at): r.next for r in C.next_at_or_after(*frames, bits).collect()}
        want = {(c, t): min(p for k, p in points if k == c and p >= t) for c, t in probes if any(k == c and p >= t for k, p in points)}
        assert got == want


def test_cooldown_of_odd_rows(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, None), (2, t, None), (3, None, "a"), (4, t, ""), (5, t + timedelta(seconds=300), None), (6, t + timedelta(seconds=299), "")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, client string")
    got = cooldown_admit(df)
    assert {r.event_id: r.admitted for r in got.collect()} == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}
    assert cooldown_admit(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cooldown_admit(df, 0)


def test_client_key(spark):
    df = spark.createDataFrame([(" a , b", "p"), (None, "p"), ("c", "p")], "xff string, peer string")
    assert [r.k for r in df.select(client_key(F.col("xff"), F.col("peer")).alias("k")).collect()] == ["a", "p", "c"]


def test_job_state_and_outcome(spark):
    t = datetime(2024, 1, 1)
    rows = [
        ("j", t, 1, "u", "PENDING", None),
        ("j", t + timedelta(seconds=2), 3, None, "FAILURE", "why"),
        ("j", t + timedelta(seconds=1), 2, None, "STARTED", "old"),
        ("k", t, 4, "v", "PENDING", None),
    ]
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, event_id long, url string, status string, error_message string")
    got = {r.job_id: (r.url, r.status, r.error_message) for r in J.job_latest_state(df).collect()}
    assert got == {"j": ("u", "FAILURE", "why"), "k": ("v", "PENDING", None)}
    report = spark.createDataFrame(
        [("a", "u", 0, 0), ("b", "u", 3, 0), ("c", "u", 3, 1)], "job_id string, url string, pages_crawled int, pages_scored int"
    )
    got = {r.job_id: (r.status, r.error_message) for r in J.job_outcome(report).collect()}
    assert got == {"a": ("FAILURE", J.UNREACHED), "b": ("FAILURE", J.BLOCKED), "c": ("SUCCESS", None)}


HTML = "<title>one two three four five</title><body><h1>A heading of five words</h1><p>some text here</p><a href='/p{0}'>x</a><a href='/p{1}'>y</a></body>"


def captures(spark, n=30):
    rows = [
        (i, f"https://s.example/p{i}", HTML.format(2 * i + 1, 2 * i + 2), 200, datetime(2024, 1, 1) + timedelta(seconds=i))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, status_code int, fetched_at timestamp")


def test_audit_from_seed(spark):
    seeds = spark.createDataFrame([(1, "https://s.example/p0"), (2, "https://none.example")], "site_id int, seed_url string")
    audit = audit_sites(captures(spark), seeds, limit=5)
    got = {r.site_id: r for r in audit.report.collect()}
    assert got[1].pages_crawled == 6 and got[1].pages_scored == 6
    assert got[2].pages_crawled == 0 and got[2].overall_score == 0 and got[2].pages_scored == 0
    assert got[1].crawl_duration_seconds == 5.0
    assert [r.crawl_pos for r in audit.details.where("site_id = 1").orderBy("crawl_pos").collect()] == list(range(6))


def test_seeds_that_share_a_host_share_its_pages(spark):
    def run(*seeds):
        df = spark.createDataFrame([(i, u) for i, u in seeds], "site_id int, seed_url string")
        audit = audit_sites(captures(spark), df, limit=4)
        pages = {(r.site_id, r.crawl_pos): (r.url, r.title, r.word_count) for r in audit.parsed.collect()}
        return pages, {r.site_id: r.asDict() for r in audit.report.collect()}

    pages, reports = run((1, "https://s.example/p0"), (2, "https://s.example/p0"), (3, "https://s.example/p1"))
    for site, seed in ((1, "https://s.example/p0"), (2, "https://s.example/p0"), (3, "https://s.example/p1")):
        alone, report = run((site, seed))
        assert {k: v for k, v in pages.items() if k[0] == site} == alone
        assert reports[site] == report[site] and report[site]["overall_score"] > 0


def test_all_pages_of_a_large_site_count(spark):
    pages = captures(spark, 100).withColumns(
        {
            "site_id": F.lit(1), "crawl_pos": F.col("page_id").cast("int"),
            "status_code": F.when(F.col("page_id") < 64, 404).otherwise(200),
        }
    )
    a = audit_pages(spark.createDataFrame([(1, "u")], "site_id int, url string"), pages)
    report = a.report.withColumn("job_id", F.lit("j"))
    r = report.first()
    assert (r.pages_crawled, r.pages_scored, r.pages_unreachable) == (100, 36, 64)
    jobs = J.job_outcome(report)
    assert jobs.first().status == "SUCCESS"
    assert J.read_reports(jobs).first().result.pages_crawled == 100
    details = J.report_pages(jobs, a.details.withColumn("job_id", F.lit("j"))).collect()
    assert len(details) == 100 and sum(d.page is not None for d in details) == 36
    assert sum(d.unreachable is not None for d in details) == 64 and sum(d.semantic is not None for d in details) == 100


def test_written_reports_read_back(spark):
    folder = scratch_folder(spark)
    pages = captures(spark, 3).withColumns({"site_id": F.lit(1), "crawl_pos": F.col("page_id").cast("int")})
    a = audit_pages(spark.createDataFrame([(1, "u")], "site_id int, url string"), pages)
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        write_reports(a.report, a.details, folder, day=day)
    assert spark.read.json(f"{folder}/sites").count() == 2 and spark.read.json(f"{folder}/pages").count() == 6


def test_page_audit_stream_equals_batch(spark):
    folder = scratch_folder(spark)
    pages = captures(spark, 12).withColumns({"site_id": (F.col("page_id") % 2).cast("int"), "crawl_pos": F.floor(F.col("page_id") / 2).cast("int")})
    pages.repartition(3).write.parquet(f"{folder}/in")
    sites = spark.createDataFrame([(0, "u"), (1, "v")], "site_id int, url string")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ST.page_audit_stream(stream, sites, f"{folder}/out", f"{folder}/state", buckets=3).awaitTermination()
    got = ST.read_latest_reports(spark, f"{folder}/out", 3).orderBy("site_id").collect()
    audit = audit_pages(sites, pages)
    want = audit.report.orderBy("site_id").collect()
    assert [r.asDict(True) for r in got] == [r.asDict(True) for r in want]
    got = ST.read_latest_details(spark, f"{folder}/out", 3).orderBy("site_id", "crawl_pos").collect()
    want = audit.details.orderBy("site_id", "crawl_pos").collect()
    assert [r.asDict(True) for r in got] == [r.asDict(True) for r in want]


def test_page_captured_again_replaces_the_older_capture(spark):
    folder = scratch_folder(spark)
    first = captures(spark, 2)
    later = first.where("page_id = 0").withColumns(
        {"html": F.lit("<title>new</title><p>x"), "fetched_at": F.col("fetched_at") + F.expr("interval 1 day")}
    )
    place = {"site_id": F.lit(1), "crawl_pos": F.col("page_id").cast("int")}
    sites = spark.createDataFrame([(1, "u")], "site_id int, url string")
    for k, rows in enumerate((first, later, first.where("page_id = 1"))):
        rows.withColumns(place).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.withColumns(place).schema).parquet(f"{folder}/in")
        ST.page_audit_stream(stream, sites, f"{folder}/out", f"{folder}/state", buckets=3).awaitTermination()
    now = later.unionByName(first.where("page_id = 1")).withColumns(place)
    got = ST.read_latest_reports(spark, f"{folder}/out", 3).collect()
    assert [r.asDict(True) for r in got] == [r.asDict(True) for r in audit_pages(sites, now).report.collect()]
    assert got[0].pages_crawled == 2 and ST.read_latest_details(spark, f"{folder}/out", 3).count() == 2


@pytest.mark.parametrize("name", ["score_page", "site_messages", "crawl_replay_robots", "cooldown_admit_day"])
def test_query_equals_sql(spark, name):
    from tools.compare import compare, connect

    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), name, folder) == ""


def test_every_query_has_a_check():
    from auditloom.plans.checks import CHECKS

    assert set(QUERIES) == set(CHECKS)
