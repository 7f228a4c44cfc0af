"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none (tests on one machine) a temporary one
    is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """As ``stored``, in buckets by ``column``: what is joined or grouped by it is not shuffled once more.

    A task writes one file for each bucket that it has rows of, so its rows should have few values.
    """
    spark = df.sparkSession
    folder, table = f"{shared_dir(spark)}/tables", f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", f"{folder}/{table}").bucketBy(buckets, column).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone; the files stay until ``discard``
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows in one Arrow batch: few enough that a batch of very long texts fits a worker.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lean(run):
    """``run``, for mapInPandas or mapInArrow: when its task ends, the memory that it has freed goes back to the system.

    Workers live through all stages of an application, and their allocators keep what is freed, so
    that each would stay as large as its largest stage has made it.
    """

    @functools.wraps(run)
    def task(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text"):
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
