"""Tables whose rows belong to a key and are replaced or deleted by it.

A table is a Parquet folder partitioned by a hash of the key.  A change reads the
buckets of the changed keys alone and writes them anew (dynamic partition
overwrite); files of other buckets stay as they are.  Every bucket written holds one
row with a null key, so that one which loses its last row is overwritten as well;
reading leaves that row out.  Nothing is changed before the job that writes has
ended, so a lost executor only costs its tasks; a driver that ends while files are
moved into place may leave a bucket to be written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.duplicates import checkpoints

BUCKET = "key_bucket"
#: Keys of at most this many bytes are sent to every task; more are joined by a shuffle.
BROADCAST = 32 << 20


@dataclass(frozen=True)
class KeyedTable:
    """The table at ``path``; ``buckets`` must be the same in every session, and large enough that a bucket is a fair share of work."""

    path: str
    key: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, new: DataFrame, buckets: DataFrame, held: DataFrame | None = None) -> None:
        markers = buckets.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields if f.name != BUCKET], BUCKET)
        # a rebalance splits a bucket of many rows over tasks and joins small ones; what was held comes in its buckets and is not moved
        rows = new.unionByName(markers).hint("rebalance", BUCKET)
        rows = rows if held is None else held.unionByName(rows)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Write all of ``rows``; those without a key belong to nobody and are left out."""
        every = rows.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias(BUCKET))
        self._write(rows.where(F.col(self.key).isNotNull()).withColumn(BUCKET, self._bucket()), every)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).where(F.col(self.key).isNotNull()).drop(BUCKET)

    def replace(self, keys: DataFrame, rows: DataFrame | None = None) -> None:
        """``keys`` (a column of the key's name) lose their rows; ``rows``, whose keys must be among them, take their place.

        Repeated and null keys count for nothing; rows of other keys are refused by being left out.
        """
        spark = keys.sparkSession
        checkpoints(spark)
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().checkpoint()
        touched = keys.select(self._bucket().alias(BUCKET)).distinct()  # at most ``buckets`` rows
        size = keys.agg(F.sum(F.octet_length(F.col(self.key).cast("string")) + 16)).first()[0] or 0
        named = F.broadcast(keys) if size <= BROADCAST else keys
        held = spark.read.parquet(self.path).join(F.broadcast(touched), BUCKET, "left_semi").where(F.col(self.key).isNotNull())
        columns = [c for c in held.columns if c != BUCKET]
        new = held.limit(0) if rows is None else rows.select(*columns).join(named, self.key, "left_semi").withColumn(BUCKET, self._bucket())
        self._write(new.select(*columns, BUCKET), touched, held.join(named, self.key, "left_anti"))


def delete_cascade(keys: DataFrame, tables: list[KeyedTable]) -> None:
    """Delete ``keys`` (one column) from every table, children first; the tables may name their key as they like."""
    (name,) = keys.columns
    for table in tables:
        table.replace(keys.withColumnRenamed(name, table.key))


def attach(children: KeyedTable, derived: list[KeyedTable], headers: KeyedTable, rows: DataFrame, counted: dict[str, Column]) -> None:
    """Replace the children of all keys in ``rows``, delete what was derived from the old ones and write their counts into ``headers``.

    ``counted`` names the header's columns that are aggregates over the new children; its other columns stay.  ``rows`` are read more
    than once and must not come from these tables.
    """
    spark = rows.sparkSession
    keys = rows.select(children.key).distinct()
    children.replace(keys, rows)
    for table in derived:
        table.replace(keys.withColumnRenamed(children.key, table.key))
    counts = rows.groupBy(F.col(children.key).alias(headers.key)).agg(*[c.alias(n) for n, c in counted.items()])
    old = headers.read(spark)
    new = old.drop(*counted).join(counts, headers.key).select(*old.columns)
    headers.replace(keys.withColumnRenamed(children.key, headers.key), new)
