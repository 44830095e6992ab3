"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatemeter.session import delete_folder, fresh_folder

#: Rows of a bounded table that one task writes; each file costs the time of some processes, see below.
FILE_ROWS = 100_000
#: Bytes of an Arrow batch while scratch tables are written; rows with whole sets are wide.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Where the shared folder is of the machine's file system, Hadoop starts a `chmod` for each file, for each file of
#: checksums and for each folder, and until such a process runs, the whole JVM counts once more. Files made without
#: permissions of their own need none, and Parquet's pages have checksums already. Other file systems aren't concerned.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


class Scratch:
    """Parquet tables of one run. Those that results may still read go when the program ends."""

    def __init__(self, spark: SparkSession, batch_bytes: int = BATCH_BYTES):
        self.spark = spark
        self.batch_bytes = batch_bytes
        self.top = fresh_folder(spark)
        self.count = 0

    def cut(self, df: DataFrame, most: int | None = None) -> DataFrame:
        """The rows of df, written and read again. most: a bound of their number, so that few rows make few files."""
        self.count += 1
        if most is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-most // FILE_ROWS)))
        path = f"{self.top}/{self.count}"
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(self.batch_bytes))
        try:
            df.write.options(**_PLAIN).parquet(path)
        finally:
            self.spark.conf.set(_BATCH, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_folder(self.spark, t.scratch_path)

    def clear(self) -> None:
        """Delete all tables of the run, if the session still stands."""
        delete_folder(self.spark, self.top)
