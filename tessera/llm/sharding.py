"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a score ``-weight / ln(u)``, u uniform in (0, 1)
from a hash of the pair; the record goes to the shard of the highest score.
The scores of the old shards do not change when a shard is added, so the only
records that move are those that the new shard wins, and a shard's share is
proportional to its weight.  All of it is column expressions; no Python runs on
the executors, and the text itself is never shuffled.

Slots number the records of a shard without gaps.  They are dealt in two
levels: each shard is cut into ``buckets`` by a second hash, a window numbers
the rows of one (shard, bucket), and a table of shards x buckets running
counts (bounded by these two parameters, hence broadcast) lifts them.  No task
ever holds a whole shard.

Defined cases: a null key is a key of its own (all null keys share a shard); a
null text has size 1 and the crc32 of nothing, 0; repeated rows share a shard
and get different slots; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, whole_text

#: 2^52: the hash is cut to this many values so that it is exact in a double.
UNIT = 1 << 52


def score(key: Column, shard: int, weight: float, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(F.lit(seed), key, F.lit(shard)), F.lit(UNIT)) + F.lit(0.5)) / F.lit(float(UNIT))
    return F.lit(-float(weight)) / F.ln(u)


def rendezvous(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """The shard of ``key``: the highest score, the lowest shard on a tie."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    best = F.array_max(F.array(*[F.struct(score(key, j, w, seed).alias("s"), F.lit(-j).alias("j")) for j, w in enumerate(weights)]))
    return (-best["j"]).cast("int")


def record_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("k"), F.col(column).cast("string")), F.lit("null"))


def shard_records(
    docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, seed: int = 17, buckets: int = 256
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every record.

    ``grown_shard`` is the shard after one more of the mean weight is added.
    """
    grown = [*weights, sum(weights) / len(weights)]
    k = record_key(key)
    placed = docs.select(
        F.col(key),
        (F.octet_length(whole_text(text)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(whole_text(text), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(k, weights, seed).alias("shard"),
        rendezvous(k, grown, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), k), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = docs.select(rendezvous(k, weights, seed).alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 1), k), F.lit(buckets)).cast("int").alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )  # at most len(weights) x buckets rows
    within = Window.partitionBy("shard", "bucket").orderBy(key, "size", "text_crc32")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select(key, "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"), "grown_shard")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(documents(spark, sf_dir))
