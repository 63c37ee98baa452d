"""Audit jobs as an append-only event table and views over it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.schemas import JOB_EVENTS_SCHEMA, JOB_STATUSES, REPORT_SCHEMA

UNREACHED = "The site could not be reached"
BLOCKED = "No page of the site could be audited"
RUNNING = [s for s in JOB_STATUSES if s not in ("PENDING", "SUCCESS", "FAILURE")]
# columns that an event may set; NULL leaves the earlier value
STATE_COLUMNS = ["url", "email", "status", "result", "error_message", "completed_at"]


def create_jobs(requests: DataFrame, stable_ids: bool = True) -> DataFrame:
    """A PENDING event per request. Stable ids hash the request, so a retried task gives the same job."""
    if stable_ids:
        job_id = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "url", "email"), 256)
    else:
        job_id = F.uuid()
    return requests.select(
        job_id.alias("job_id"), "ts", "event_id", "url", "email", F.lit("PENDING").alias("status")
    )


def job_events(*tables: DataFrame) -> DataFrame:
    """Tables of events as one, with the columns of the event table; a status of no job fails the run."""
    known = F.col("status").isNull() | F.col("status").isin(JOB_STATUSES)
    status = F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown job status: "), F.col("status"))))
    rows = None
    for table in tables:
        have = {f.name for f in JOB_EVENTS_SCHEMA} & set(table.columns)
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in JOB_EVENTS_SCHEMA]
        rows = table.select(*columns) if rows is None else rows.unionByName(table.select(*columns))
    return rows.withColumn("status", status)


def progress_events(jobs: DataFrame, at: dict[str, Column]) -> DataFrame:
    """An event for each job (job_id, event_id) and status of the run, at the time given for it."""
    steps = F.array(*[F.struct(F.lit(status).alias("status"), at[status].cast("timestamp").alias("ts")) for status in RUNNING])
    return jobs.select("job_id", "event_id", F.inline(steps))


def job_reports(events: DataFrame) -> DataFrame:
    """What a reader of jobs gets: state, times and typed report of every job in the event table."""
    return read_reports(job_latest_state(events)).select(
        "job_id", "url", "email", "status", "result", "error_message", "created_at", "updated_at", "completed_at"
    )


def latest_parts(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per job and column the last value set, still mergeable: struct(at, value) columns.

    Maxima combine before the shuffle, so a job with very many events stays cheap.
    """
    columns = [c for c in STATE_COLUMNS if c in events.columns]
    at = F.struct("ts", "event_id").alias("at")
    return events.groupBy(*(keys or ["job_id"])).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("value")))).alias(c) for c in columns],
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def fold_parts(parts: DataFrame) -> DataFrame:
    """One partial state per job from any number of them."""
    columns = [c for c in STATE_COLUMNS if c in parts.columns]
    return parts.groupBy("job_id").agg(
        *[F.max(c).alias(c) for c in columns],
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """Latest state from any number of partial states per job."""
    columns = [c for c in STATE_COLUMNS if c in parts.columns]
    return fold_parts(parts).select(
        "job_id", *[F.col(c).value.alias(c) for c in columns], "created_at", "updated_at"
    )


def job_latest_state(events: DataFrame) -> DataFrame:
    """One row per job: last write wins per column, `updated_at` moves with every event."""
    return merge_parts(latest_parts(events))


def job_lookup(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def job_outcome(report: DataFrame, at: Column | None = None) -> DataFrame:
    """Closing event of each audited job from its site report (`job_id` on the report row)."""
    at = F.current_timestamp() if at is None else at
    error = F.when(F.col("pages_crawled") == 0, F.lit(UNREACHED)).when(F.col("pages_scored") == 0, F.lit(BLOCKED))
    done = report.withColumn("error_message", error)
    good = F.col("error_message").isNull()
    body = F.struct(*[c for c in report.columns if c not in ("site_id", "job_id")])
    return done.select(
        "job_id",
        at.alias("ts"),
        F.when(good, F.col("url")).alias("url"),
        F.when(good, "SUCCESS").otherwise("FAILURE").alias("status"),
        F.when(good, F.to_json(body)).alias("result"),
        "error_message",
        at.alias("completed_at"),
    )


def report_json(report: DataFrame) -> DataFrame:
    """The site report as one JSON text per site."""
    body = F.struct(*[c for c in report.columns if c != "site_id"])
    return report.select("site_id", F.to_json(body).alias("result"))


def read_reports(jobs: DataFrame) -> DataFrame:
    """Stored jobs with the report typed, the status in lower case and empty texts as NULL."""
    parsed = F.from_json(F.nullif(F.col("result"), F.lit("")), REPORT_SCHEMA)
    return jobs.withColumns(
        {
            "status": F.lower("status"),
            "result": parsed,
            **({"error_message": F.nullif(F.col("error_message"), F.lit(""))} if "error_message" in jobs.columns else {}),
        }
    )


def report_pages(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """All pages of every successful job, a row each; `details` carries `job_id` beside `page_details`."""
    done = jobs.where(F.lower("status") == "success").select("job_id")
    return details.join(done, "job_id", "left_semi")
