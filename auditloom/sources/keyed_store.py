"""A log-structured table of keyed rows that micro-batches write.

Each batch adds one run, split into buckets by a hash of the key. `fan` runs of a level are merged into one run of the
next, so that after n batches the live runs are the digits of n to the base `fan`: a reader meets at most fan - 1 runs of
each level, and a row is rewritten once a level. Which runs are live follows from n alone, so a retried batch
overwrites its own runs and nothing else.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

Fold = Callable[[DataFrame], DataFrame]


class KeyedStore:
    """keys: columns whose hash tells a row's bucket. fold: leaves the rows that count, of any rows of the store; folding
    folded rows together must give what folding all of them gives. Batches are numbered from 0 without gaps."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, fold: Fold, buckets: int = 64, fan: int = 4):
        self.spark, self.path, self.keys, self.fold, self.buckets, self.fan = spark, path, keys, fold, buckets, fan
        self.schema = StructType([StructField(f.name, f.dataType) for f in schema])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _run(self, level: int, number: int) -> str:
        return f"{self.path}/level={level}/run={number}"

    def live(self, batches: int) -> list[str]:
        """Runs that hold the state after so many batches."""
        out, level, end = [], 0, batches
        while end:
            low = end - end % self.fan
            out += [self._run(level, k) for k in range(low, end)]
            level, end = level + 1, low // self.fan
        return out

    def _write(self, rows: DataFrame, run: str) -> None:
        # one file for each bucket
        placed = rows.select(*self.schema.names, self.bucket().alias("bucket")).repartition(self.buckets, "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(run)

    def _read(self, runs: list[str], buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.createDataFrame([], self.schema)
        if runs:
            schema = StructType([*self.schema, StructField("bucket", IntegerType())])
            read = self.spark.read.schema(schema)
            parts = [read.option("basePath", run).parquet(run) for run in runs]
            rows = parts[0]
            for part in parts[1:]:
                rows = rows.unionByName(part)
            if buckets is not None:
                rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select(*self.schema.names)

    def put(self, rows: DataFrame, batch_id: int, keep: Column | None = None) -> None:
        """Add a batch's rows; rows that keep does not hold for are dropped when runs are merged."""
        self._forget(batch_id)
        self._write(self.fold(rows), self._run(0, batch_id))
        level, n = 0, batch_id + 1
        while n % self.fan == 0:
            n //= self.fan
            merged = self.fold(self._read([self._run(level, k) for k in range((n - 1) * self.fan, n * self.fan)]))
            level += 1
            self._write(merged if keep is None else merged.where(keep), self._run(level, n - 1))
        # two places in turn: one of them is whole at any time
        head = self.spark.range(1).select(F.lit(batch_id + 1).alias("batches"))
        head.write.mode("overwrite").parquet(f"{self.path}/head-{batch_id % 2}")

    def _forget(self, batches: int) -> None:
        """Delete runs that were merged by the batch before, which can't be retried any more."""
        level, n = 0, batches
        while n and n % self.fan == 0:
            n //= self.fan
            for k in range((n - 1) * self.fan, n * self.fan):
                self._file_system(self._run(level, k), "delete")
            level += 1

    def _file_system(self, path: str, action: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files.exists(hadoop) if action == "exists" else files.delete(hadoop, True)

    def batches(self) -> int:
        """How many batches have been put."""
        heads = [h for h in (f"{self.path}/head-{k}" for k in (0, 1)) if self._file_system(f"{h}/_SUCCESS", "exists")]
        return max((self.spark.read.parquet(h).first()["batches"] for h in heads), default=0)

    def table(self, batches: int | None = None) -> DataFrame:
        """The state after so many batches, by default all."""
        return self.fold(self._read(self.live(self.batches() if batches is None else batches)))

    def of(self, keys: DataFrame, batches: int) -> DataFrame:
        """The state of the rows with these values of the key columns; other buckets are not read."""
        keys = keys.select(*self.keys).distinct()
        buckets = [r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]  # self.buckets at most
        rows = self._read(self.live(batches), buckets)
        same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"keys.{k}")) for k in self.keys]
        return self.fold(rows.alias("rows").join(keys.alias("keys"), same, "left_semi"))
