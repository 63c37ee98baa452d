"""Session settings, the shared checkpoint folder, and this package on the executors."""

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application: Python tasks import it there. Local mode has it."""
    context = spark.sparkContext
    one_machine = context.master == "local" or context.master.startswith("local[")
    if not one_machine and context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings the results depend on. Sizes and parallelism are left to the cluster."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # the last of duplicate JSON keys wins
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def _checkpoint_ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write to the shared folder and cut the lineage there; survives lost executors."""
    _checkpoint_ready(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for stream sinks and state, beside the shared checkpoints."""
    _checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def input_bytes(df: DataFrame) -> int:
    """Size of the files that a DataFrame reads; 0 if it reads none."""
    context, total = df.sparkSession.sparkContext, 0
    for file in df.inputFiles():
        path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(file))
        total += path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total
