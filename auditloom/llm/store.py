"""Intermediate tables in the folder all executors share."""

import contextlib
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from auditloom.session import ship_package


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where nobody set it, a folder of this session's own on one machine, and an error on a cluster,
    whose executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile remove their shuffle files when they end. Else these stay on the executors' disks until the
    driver happens to collect its garbage, many times what one query needs."""
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage like checkpoint(), but computes df once, keeps columns prunable and survives lost executors. The
    shuffles that made df go with it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() returned. Nothing may read them any more, nor anything made from them but not yet stored."""
    for table in tables:
        if path := _folders.pop(table, None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def bound_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Fewer rows per Arrow batch than Spark's default: whole texts are long, and a task holds a few batches at once.

    Executors get this package, too.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
    return spark


def own_columns_aside(*used: str) -> Callable:
    """For a function from documents to documents: columns it doesn't use go through it under names that clash with none
    of its own. A column that it adds replaces one of the same name."""

    def wrap(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(function)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            mark = uuid.uuid4().hex  # functions of this kind may call each other
            aside = {c: f"own {mark} {k}" for k, c in enumerate(docs.columns) if c not in used}
            out = function(docs.withColumnsRenamed(aside), *args, **options)
            replaced = [name for c, name in aside.items() if c in out.columns]
            return out.drop(*replaced).withColumnsRenamed({name: c for c, name in aside.items() if name not in replaced})

        return run

    return wrap
