"""Timed sentences and the ranges over them, in hundredths of a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def by_sentence():
    return Window.partitionBy("doc_id").orderBy("idx")


def timed_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, idx, sentence, tokens, n, start_cs, end_cs under the synthetic clock (34 a word, 51 a pause)."""
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))
    rows = rows.withColumn("tokens", T.tokens(F.col("sentence"))).withColumn("n", F.size("tokens").cast("long"))
    before = F.coalesce(F.sum(34 * F.col("n") + 51).over(by_sentence().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start_cs", before).withColumn("end_cs", F.col("start_cs") + 34 * F.col("n") - 4).withColumn("idx", F.col("idx").cast("long"))


def range_windows(rows: DataFrame, low: int, high: int, keep: list[str] | None = None) -> DataFrame:
    """All pairs of sentences s < e of one document with low <= end(e) - start(s) <= high.

    The join's key is the document and a time bin of width ``high``: a start meets ends in its own
    bin and the next only, so a long document makes no square of pairs and a hot one is split.
    """
    keep = keep or []
    left = rows.select("doc_id", F.col("idx").alias("s"), "start_cs", *[F.col(c).alias(f"s_{c}") for c in keep])
    left = left.withColumn("bin", F.explode(F.array(F.floor(F.col("start_cs") / high), F.floor(F.col("start_cs") / high) + 1)))
    right = rows.select("doc_id", F.col("idx").alias("e"), "end_cs", F.floor(F.col("end_cs") / high).alias("bin"), *[F.col(c).alias(f"e_{c}") for c in keep])
    span = F.col("end_cs") - F.col("start_cs")
    return left.join(right, ["doc_id", "bin"]).where((F.col("e") > F.col("s")) & span.between(low, high)).withColumn("span_cs", span).drop("bin")


def nearest_other(rows: DataFrame, key: str, time: str, tie: str, label: str, asking) -> DataFrame:
    """For each row where ``asking`` holds: near (its time, tie, label and distance d) among its key's rows where it does not hold.

    Of rows equally far the earlier counts, of rows at one time that of the least ``tie``.  Both
    sides are running extremes, so the work is a sort by key and time, however many rows a key has.
    A row with nothing else under its key has no result.
    """
    own = Window.partitionBy(key)
    other = lambda *c: F.when(~asking, F.struct(*c))
    before = F.max(other(F.col(time).alias("t"), (-F.col(tie)).alias("tie"), F.col(label).alias("label"))).over(own.orderBy(time, tie).rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(other(F.col(time).alias("t"), F.col(tie).alias("tie"), F.col(label).alias("label"))).over(own.orderBy(F.desc(time), F.desc(tie)).rowsBetween(Window.unboundedPreceding, -1))
    side = lambda c, sign: F.when(c.isNotNull(), F.struct(F.abs(c["t"] - F.col(time)).alias("d"), c["t"].alias("t"), (sign * c["tie"]).alias("tie"), c["label"].alias("label")))
    found = rows.withColumns({"before": before, "after": after}).where(asking)
    near = F.array_min(F.array_compact(F.array(side(F.col("before"), -1), side(F.col("after"), 1))))
    return found.withColumn("near", near).drop("before", "after").where("near IS NOT NULL")


def onto_segments(words: DataFrame, segments: DataFrame, key: str, least: int) -> DataFrame:
    """Words (key, id, start, end) on the time that is left when only ``segments`` (key, a, b, disjoint) are kept: out_start and out_end.

    A time inside a segment moves back by all that was removed before it.  A word with neither end inside is dropped; one that starts
    outside starts where it ends, one that ends outside (or before it starts) lasts as long as before, ``least`` at least.  The segment
    that holds a time is the last one that begins by then: a running last over both in order of time, so no pair of words and segments is made.
    """
    order = Window.partitionBy(key).orderBy("a")
    kept = segments.select(key, "a", "b", F.coalesce(F.sum(F.col("b") - F.col("a")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("out"))
    edges = F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("t")), F.struct(F.lit(1).alias("side"), F.col("end").alias("t")))
    asked = words.select(key, "id", (F.col("end") - F.col("start")).alias("lasts"), F.explode(edges).alias("x")).select(key, "id", "lasts", "x.side", "x.t")
    both = asked.unionByName(kept.select(key, F.col("a").alias("t"), F.struct("a", "b", "out").alias("segment")), allowMissingColumns=True)
    # at one time the segment comes first: its bounds are inside
    running = Window.partitionBy(key).orderBy("t", F.col("side").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("held", F.last("segment", ignorenulls=True).over(running)).where("side IS NOT NULL")
    there = F.when(F.col("t") <= F.col("held.b"), F.col("held.out") + F.col("t") - F.col("held.a"))
    side = lambda k: F.max(F.when(F.col("side") == k, there))
    rows = both.groupBy(key, "id", "lasts").agg(side(0).alias("s"), side(1).alias("e")).where("s IS NOT NULL OR e IS NOT NULL")
    rows = rows.withColumn("out_start", F.coalesce("s", "e"))
    return rows.select(key, "id", "out_start", F.when(F.col("e") >= F.col("out_start"), F.col("e")).otherwise(F.col("out_start") + F.greatest("lasts", F.lit(least))).alias("out_end"))
