"""Stream forms: client cooldown, running job state, audit of arriving captures.

Every write of a micro-batch goes to a place of its own and is overwritten when the batch is retried, so sinks are
idempotent. State that outlives a batch lies in keyed stores, which merge their runs as they grow.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from auditloom.operators.cooldown import TTL_SECONDS, admitted_requests
from auditloom.operators.extract import parse_pages
from auditloom.operators.jobs import fold_parts, latest_parts, merge_parts
from auditloom.operators.rollup import page_details, site_report
from auditloom.operators.scoring import score_pages, unreachable_pages
from auditloom.operators.semantic import embed_with_bag, page_semantic, score_chunks, text_chunks
from auditloom.session import checkpoint
from auditloom.sources.keyed_store import KeyedStore


BUCKETS = 64  # of a store, by default: a batch reads those that its keys are in; the same for a stream and its readers


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _start(stream: DataFrame, on_batch, checkpoint_dir: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# ---- cooldown ----

REQUESTS = StructType([StructField("client", StringType()), StructField("at", LongType()), StructField("event_id", LongType())])
CLOCK = StructType([StructField("newest", LongType()), StructField("late", LongType())])
STATES = StructType([StructField("client", StringType()), StructField("blocked", LongType())])


def _client_states(spark: SparkSession, path: str, buckets: int) -> KeyedStore:
    def last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("client").agg(F.max("blocked").alias("blocked"))

    return KeyedStore(spark, f"{path}/states", ["client"], STATES, last, buckets)


def _decided(due: DataFrame, states: DataFrame, seconds: int) -> DataFrame:
    """Admissions of due rows (client, at, event_id), given until when clients are blocked (client, blocked)."""
    # the last admission of a client stands before its due rows, without an id
    before = states.select("client", (F.col("blocked") - seconds * 1_000_000).alias("at"), F.lit(None).cast("long").alias("event_id"))
    rows = due.unionByName(before).select("client", F.timestamp_micros("at").alias("ts"), "event_id")
    return admitted_requests(rows, seconds).where("event_id IS NOT NULL")


def cooldown_stream(
    requests: DataFrame, path: str, checkpoint_dir: str, seconds: int = TTL_SECONDS, lateness: int = 600, trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Admit the requests of a stream (client, ts, event_id: long) as they become due.

    A request is decided once none before it can come any more: when the newest time seen in all batches so far is
    `lateness` seconds ahead. Until then it waits in `pending`, so requests may arrive in any order within that time and
    admissions are those of the batch form. A request that comes later still, or has no time, goes to `late`, and the
    count of those is kept (`late_count`): nothing is lost without a trace.

    A batch's due rows are decided by the batch form, so a busy client's rows are spread over tasks. What is kept
    for a client is one number, until the newest decided time has passed it.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = checkpoint(batch.select("client", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id")))
        last = spark.read.schema(CLOCK).parquet(f"{path}/clock/batch_id={batch_id - 1}").first() if batch_id else None
        newest, late = (last["newest"], last["late"]) if last else (None, 0)
        closed = None if newest is None else newest - lateness * 1_000_000
        missed = F.col("at").isNull() if closed is None else F.col("at").isNull() | (F.col("at") < closed)
        _write_batch(rows.where(missed), f"{path}/late", batch_id)
        seen = rows.agg(F.max("at").alias("newest"), F.count_if(missed).alias("late")).first()
        newest = max((x for x in (newest, seen["newest"]) if x is not None), default=None)
        spark.createDataFrame([(newest, late + seen["late"])], CLOCK).coalesce(1).write.mode("overwrite").parquet(f"{path}/clock/batch_id={batch_id}")

        open_rows = rows.where(~missed)
        if batch_id:
            open_rows = open_rows.unionByName(spark.read.schema(REQUESTS).parquet(f"{path}/pending/batch_id={batch_id - 1}"))
        closing = F.lit(None).cast("long") if newest is None else F.lit(newest - lateness * 1_000_000)
        is_due = F.coalesce(F.col("at") < closing, F.lit(False))
        _write_batch(open_rows.where(~is_due), f"{path}/pending", batch_id)
        states, due = _client_states(spark, path, buckets), checkpoint(open_rows.where(is_due))
        admitted = checkpoint(_decided(due, states.of(due, batch_id), seconds))
        _write_batch(admitted, f"{path}/admitted", batch_id)
        blocked = admitted.groupBy("client").agg((F.max("at") + seconds * 1_000_000).alias("blocked"))
        states.put(blocked, batch_id, keep=F.coalesce(F.col("blocked") > closing, F.lit(True)))

    return _start(requests, on_batch, checkpoint_dir, trigger)


def read_admitted(spark: SparkSession, path: str, seconds: int = TTL_SECONDS, ended: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Admitted requests (client, at, event_id); ended: those still pending are decided as if no more came."""
    out = spark.read.schema(REQUESTS).parquet(f"{path}/admitted").select(*REQUESTS.names)
    if not ended:
        return out
    states = _client_states(spark, path, buckets)
    n = states.batches()
    pending = spark.read.schema(REQUESTS).parquet(f"{path}/pending/batch_id={n - 1}")
    return out.unionByName(_decided(pending, states.of(pending, n), seconds).select(*REQUESTS.names))


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Requests that came too late to be decided, or without a time."""
    return spark.read.schema(REQUESTS).parquet(f"{path}/late").select(*REQUESTS.names)


def late_count(spark: SparkSession, path: str) -> int:
    return spark.read.schema(CLOCK).parquet(f"{path}/clock").agg(F.max("late")).first()[0]


# ---- job state ----


def _job_states(spark: SparkSession, path: str, schema: StructType, buckets: int) -> KeyedStore:
    return KeyedStore(spark, f"{path}/parts", ["job_id"], schema, fold_parts, buckets)


def job_state_stream(events: DataFrame, path: str, checkpoint_dir: str, trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last value of each column of each job; `read_job_state` gives them. A batch writes its own jobs only."""
    schema = latest_parts(_like(events)).schema

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        _job_states(batch.sparkSession, path, schema, buckets).put(latest_parts(batch), batch_id)

    return _start(events, on_batch, checkpoint_dir, trigger)


def _like(stream: DataFrame) -> DataFrame:
    """An empty table with the stream's columns."""
    return stream.sparkSession.createDataFrame([], stream.schema)


def read_job_state(spark: SparkSession, path: str, events: StructType, jobs: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per job, from the store of a stream of such events; jobs (job_id): only those, other buckets are not read."""
    store = _job_states(spark, path, latest_parts(spark.createDataFrame([], events)).schema, buckets)
    return merge_parts(store.table() if jobs is None else store.of(jobs, store.batches()))


# ---- page audit ----


def _newest(captures: DataFrame, *more: str) -> DataFrame:
    """The last capture of each page of a site."""
    last = Window.partitionBy("site_id", "page_id").orderBy(F.desc("fetched_at"), *[F.desc(c) for c in more], F.desc("crawl_pos"))
    return captures.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


ROLLED = ("scores", "unreachable", "semantic")


def _page_store(spark: SparkSession, path: str, schema: StructType, buckets: int) -> KeyedStore:
    return KeyedStore(spark, f"{path}/pages", ["site_id"], schema, lambda rows: _newest(rows, "batch_id"), buckets)


def _report_store(spark: SparkSession, path: str, schema: StructType, buckets: int) -> KeyedStore:
    def last(rows: DataFrame) -> DataFrame:
        newest = Window.partitionBy("site_id").orderBy(F.desc("batch_id"))
        return rows.withColumn("_last", F.row_number().over(newest)).where("_last = 1").drop("_last")

    return KeyedStore(spark, f"{path}/reports", ["site_id"], schema, last, buckets)


def _tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Captures, scores, unreachable pages and semantic pages of a site's current rows."""
    return rows.drop(*ROLLED, "batch_id"), *[rows.where(f"{name} IS NOT NULL").select(f"{name}.*") for name in ROLLED]


def page_audit_stream(
    captures: DataFrame,
    sites: DataFrame,
    path: str,
    checkpoint_dir: str,
    embed=embed_with_bag,
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Parse and score arriving captures (with site_id and crawl_pos) once and refresh the reports of their sites.

    A page has one row in the store: its last capture and what it adds to the reports. A page captured again replaces
    that row, older ones go when runs are merged, and a batch reads the rows of its own sites. Window order is not
    available on streams, so each micro-batch is a batch job.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = checkpoint(_newest(batch))
        pages = arrived.drop("site_id", "crawl_pos").dropDuplicates(["page_id", "fetched_at"])
        # sites may hold different captures of a page, so a capture is told by its time, too
        key = F.xxhash64("page_id", "fetched_at")
        parsed = parse_pages(pages.withColumns({"_page": F.col("page_id"), "page_id": key})).withColumn("page_id", F.col("_page")).drop("_page")
        parsed = checkpoint(parsed.join(arrived.select("page_id", "fetched_at", "site_id", "crawl_pos"), ["page_id", "fetched_at"]))
        parts = {
            "scores": score_pages(parsed),
            "unreachable": unreachable_pages(parsed).select("site_id", "page_id", "crawl_pos", "url", "status_code", "reason"),
            "semantic": page_semantic(score_chunks(embed(text_chunks(parsed)))),
        }
        rows = arrived.drop("html").withColumn("batch_id", F.lit(batch_id))
        for name, part in parts.items():
            rows = rows.join(part.select("site_id", "page_id", F.struct(*part.columns).alias(name)), ["site_id", "page_id"], "left")
        store = _page_store(spark, path, rows.schema, buckets)
        store.put(rows, batch_id)
        touched = arrived.select("site_id").distinct()
        current, *tables = _tables(checkpoint(store.of(touched, batch_id + 1)))
        report = site_report(sites.join(touched, "site_id", "left_semi"), current, tables[0], tables[1].drop("page_id"), tables[2])
        report = report.withColumn("batch_id", F.lit(batch_id))
        _report_store(spark, path, report.schema, buckets).put(report, batch_id)
        for name, df in (("pages", rows), ("reports", report)):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/schemas/{name}")

    return _start(captures, on_batch, checkpoint_dir, trigger)


def read_latest_reports(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The newest report of every site."""
    return _report_store(spark, path, spark.read.parquet(f"{path}/schemas/reports").schema, buckets).table().drop("batch_id")


def read_latest_details(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The pages of every site as of its newest report."""
    pages = _page_store(spark, path, spark.read.parquet(f"{path}/schemas/pages").schema, buckets).table()
    _, scores, unreachable, semantic = _tables(pages)
    return page_details(scores, unreachable.drop("page_id"), semantic)
