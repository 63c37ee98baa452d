"""Reading captures and writing reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.urls import host
from auditloom.schemas import CAPTURE_SCHEMA


def page_scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = CAPTURE_SCHEMA) -> DataFrame:
    """Captured pages with a declared schema; missing columns read as NULL."""
    return spark.read.format(fmt).schema(schema).load(path)


def scan_json(spark: SparkSession, path: str, schema: T.StructType = CAPTURE_SCHEMA) -> DataFrame:
    """Captures from lines of JSON. A line that is no JSON, or whose fields don't have the declared types, is kept whole in
    `rescued`, and its other columns are NULL; `rescued` is NULL otherwise."""
    read = spark.read.schema(T.StructType([*schema, T.StructField("rescued", T.StringType())]))
    rows = read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "rescued").json(path)
    good = F.col("rescued").isNull()
    return rows.select(*[F.when(good, F.col(f.name)).alias(f.name) for f in schema], "rescued")


def capture_counts(captures: DataFrame) -> DataFrame:
    """One row: n_good and n_rescued lines of `scan_json`."""
    bad = F.col("rescued").isNotNull()
    return captures.select("page_id", bad.alias("bad")).agg(F.count_if(~F.col("bad")).alias("n_good"), F.count_if("bad").alias("n_rescued"))


def fetch_ok(pages: DataFrame) -> DataFrame:
    """Only captures with status 200; pushed into the scan."""
    return pages.where("status_code = 200")


def write_captures(pages: DataFrame, table: str, buckets: int, by: str = "page_id") -> None:
    """Store captures bucketed on `page_id`, so that parsing them needs no exchange at all, or on `host` (a column made
    from the URL), so that the captures of some seeds' hosts are found without one."""
    if by == "host":
        pages = pages.withColumn("host", host(F.col("url")))
    pages.write.bucketBy(buckets, by).sortBy(by).mode("overwrite").saveAsTable(table)


def write_reports(report: DataFrame, details: DataFrame, path: str, fmt: str = "json", day: str | None = None) -> None:
    """Store site reports and their pages, partitioned by date when a day is given (a day written again is replaced)."""
    for name, rows in (("sites", report), ("pages", details)):
        out = (rows.withColumn("day", F.lit(day)) if day else rows).write.format(fmt).mode("overwrite")
        if day:
            out = out.option("partitionOverwriteMode", "dynamic").partitionBy("day")
        out.save(f"{path}/{name}")
