"""Streams over several micro-batches, and the keyed store under them."""

import random
import re
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditloom.operators import jobs as J
from auditloom.operators.cooldown import admitted_requests
from auditloom.plans.audit import audit_pages
from auditloom.plans.catalog import QUERIES
from auditloom.session import scratch_folder
from auditloom.sources.keyed_store import KeyedStore
from auditloom.streaming import streams as ST

START = datetime(2024, 1, 1)


def in_batches(spark, folder, batches, schema):
    """One file per micro-batch, read in the order written."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
        df.coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    return spark.readStream.schema(schema if isinstance(schema, str) else batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


# ---- keyed store ----


def greatest(rows):
    return rows.groupBy("k").agg(F.max("v").alias("v"))


def test_store_stays_bounded_over_fifty_batches(spark):
    folder, rng = f"{scratch_folder(spark)}/store", random.Random(1)
    schema = spark.createDataFrame([], "k string, v long").schema
    store = KeyedStore(spark, folder, ["k"], schema, greatest, buckets=2, fan=4)
    want = {}
    for n in range(50):
        rows = [(rng.choice([None, *"abcdefgh"]), rng.randrange(10_000)) for _ in range(6)]
        for k, v in rows:
            want[k] = max(v, want.get(k, -1))
        store.put(spark.createDataFrame(rows, schema), n)
        if n in (0, 3, 15, 30):
            assert {r.k: r.v for r in store.table().collect()} == want
    assert store.batches() == 50
    assert {r.k: r.v for r in store.table().collect()} == want
    # 50 is 302 to the base 4
    assert [r.removeprefix(folder) for r in store.live(50)] == ["/level=0/run=48", "/level=0/run=49", *[f"/level=2/run={k}" for k in range(3)]]
    # live runs, and those that the last merge has read and a retry may read again
    for bucket in (0, 1):
        assert len(list(Path(folder.removeprefix("file:")).glob(f"level=*/run=*/bucket={bucket}/*.parquet"))) <= 3 * 3 + 4
    some = store.of(spark.createDataFrame([("a",), (None,)], "k string"), 50)
    assert {r.k: r.v for r in some.collect()} == {k: want[k] for k in ("a", None) if k in want}


def test_store_takes_a_retried_batch(spark):
    folder = f"{scratch_folder(spark)}/store"
    store = KeyedStore(spark, folder, ["k"], spark.createDataFrame([], "k string, v long").schema, greatest, buckets=2, fan=2)
    for n in (0, 1, 1, 2, 3, 3):
        store.put(spark.createDataFrame([("a", n), (f"b{n}", n)], "k string, v long"), n)
    assert {r.k: r.v for r in store.table().collect()} == {"a": 3, "b0": 0, "b1": 1, "b2": 2, "b3": 3}


def test_store_drops_what_is_not_kept_when_it_merges(spark):
    folder = f"{scratch_folder(spark)}/store"
    store = KeyedStore(spark, folder, ["k"], spark.createDataFrame([], "k string, v long").schema, greatest, buckets=2, fan=2)
    for n in range(4):
        store.put(spark.createDataFrame([(f"k{n}", n)], "k string, v long"), n, keep=F.col("v") >= 2)
    assert {r.k for r in store.table().collect()} == {"k2", "k3"}


# ---- cooldown ----

REQUESTS = "client string, ts timestamp, event_id long"


def requests(seed, n=600, span=4000):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "a", "b", None]), START + timedelta(seconds=rng.randrange(span)), i) for i in range(n)]


def admitted(rows):
    return sorted((r.client or "", r.at, r.event_id) for r in rows.collect())


def test_cooldown_in_three_batches_equals_batch(spark):
    rows = sorted(requests(1), key=lambda r: r[1])
    folder = scratch_folder(spark)
    stream = in_batches(spark, folder, [rows[:200], rows[200:400], rows[400:]], REQUESTS)
    ST.cooldown_stream(stream, f"{folder}/out", f"{folder}/state", 300, 0, buckets=3).awaitTermination()
    want = admitted(admitted_requests(spark.createDataFrame(rows, REQUESTS), 300))
    assert admitted(ST.read_admitted(spark, f"{folder}/out", 300, ended=True, buckets=3)) == want
    assert ST.late_count(spark, f"{folder}/out") == 0 == ST.read_late(spark, f"{folder}/out").count()


def test_cooldown_of_rows_out_of_order(spark):
    rng, rows = random.Random(2), requests(2)
    arriving = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(500)))
    folder = scratch_folder(spark)
    stream = in_batches(spark, folder, [arriving[k : k + 120] for k in range(0, 600, 120)], REQUESTS)
    ST.cooldown_stream(stream, f"{folder}/out", f"{folder}/state", 300, 600, buckets=3).awaitTermination()
    assert admitted(ST.read_admitted(spark, f"{folder}/out", 300, ended=True, buckets=3)) == admitted(admitted_requests(spark.createDataFrame(rows, REQUESTS), 300))
    assert ST.late_count(spark, f"{folder}/out") == 0


def test_late_requests_are_kept_and_counted(spark):
    rows = sorted(requests(3, 300), key=lambda r: r[1])
    late = [("hot", START, 1000), ("a", START + timedelta(seconds=10), 1001), ("a", None, 1002)]
    folder = scratch_folder(spark)
    stream = in_batches(spark, folder, [rows[:250], rows[250:] + late, late[:1]], REQUESTS)
    ST.cooldown_stream(stream, f"{folder}/out", f"{folder}/state", 300, 60, buckets=3).awaitTermination()
    assert ST.late_count(spark, f"{folder}/out") == 4
    assert sorted(r.event_id for r in ST.read_late(spark, f"{folder}/out").collect()) == [1000, 1000, 1001, 1002]
    assert admitted(ST.read_admitted(spark, f"{folder}/out", 300, ended=True, buckets=3)) == admitted(admitted_requests(spark.createDataFrame(rows, REQUESTS), 300))


# ---- job state ----


def test_job_state_over_batches(spark):
    rows = [(f"j{i % 7}", START + timedelta(seconds=i), i, "PENDING" if i < 7 else "STARTED", None if i % 3 else f"u{i}") for i in range(60)]
    schema = "job_id string, ts timestamp, event_id long, status string, url string"
    folder = scratch_folder(spark)
    stream = in_batches(spark, folder, [rows[k : k + 10] for k in range(0, 60, 10)], schema)
    ST.job_state_stream(stream, f"{folder}/out", f"{folder}/state", buckets=3).awaitTermination()
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, J.job_latest_state(df).collect()))
    assert sorted(map(tuple, ST.read_job_state(spark, f"{folder}/out", df.schema, buckets=3).collect())) == want
    one = ST.read_job_state(spark, f"{folder}/out", df.schema, spark.createDataFrame([("j3",)], "job_id string"), buckets=3)
    assert [tuple(r) for r in one.collect()] == [r for r in want if r[0] == "j3"]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", one._jdf.queryExecution().toString())


# ---- page audit ----

HTML = "<title>{0}</title><body><h1>A heading of {1} words</h1><p>some {2} text here</p><a href='/p{1}'>x</a></body>"


@pytest.mark.parametrize("n_batches", [10])
def test_page_audit_over_ten_batches_with_recaptures(spark, n_batches):
    rng, batches, last = random.Random(6), [], {}
    for n in range(n_batches):
        rows = []
        for page in rng.sample(range(12), 4):
            html = HTML.format(" ".join(["word"] * rng.randrange(9)), rng.randrange(30), "more " * rng.randrange(5))
            row = (page % 3, page // 3, page, f"https://s{page % 3}.example/p{page}", html, rng.choice([200, 200, 200, 404]), START + timedelta(hours=n, seconds=page))
            rows.append(row)
            last[page] = row
        batches.append(rows)
    schema = "site_id int, crawl_pos int, page_id long, url string, html string, status_code int, fetched_at timestamp"
    folder = scratch_folder(spark)
    sites = spark.createDataFrame([(k, f"u{k}") for k in range(3)], "site_id int, url string")
    stream = in_batches(spark, folder, batches, schema)
    ST.page_audit_stream(stream, sites, f"{folder}/out", f"{folder}/state", buckets=3).awaitTermination()
    audit = audit_pages(sites, spark.createDataFrame(list(last.values()), schema))
    for got, want, order in (
        (ST.read_latest_reports(spark, f"{folder}/out", 3), audit.report, ["site_id"]),
        (ST.read_latest_details(spark, f"{folder}/out", 3), audit.details, ["site_id", "crawl_pos"]),
    ):
        got, want = ([r.asDict(True) for r in df.orderBy(*order).collect()] for df in (got, want))
        assert got == want


@pytest.mark.parametrize("as_folder", [True, False])
def test_streams_read_tables_in_one_file_or_many(spark, tmp_path, as_folder):
    pages = spark.createDataFrame([(k, f"https://s.example/p{k}", HTML.format("word", k, "more ")) for k in range(9)], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    if not as_folder:
        pages.coalesce(1).write.parquet(str(tmp_path / "one"))
        (tmp_path / "alone").mkdir()
        shutil.copy(next((tmp_path / "one").glob("*.parquet")), tmp_path / "alone" / "pages.parquet")
    rows = QUERIES["stream_page_audit"](spark, str(tmp_path if as_folder else tmp_path / "alone")).collect()
    assert sorted((r.site_id, r.pages_crawled) for r in rows) == [(0, 2), *[(k, 1) for k in range(1, 8)]]
