"""Queries that write tables by key, change them in place and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import transcript as R
from tessera.operators.duplicates import checkpoints
from tessera.plans.base import query, table
from tessera.plans.text import TIMED_SQL
from tessera.sinks.keyed import KeyedTable, attach, delete_cascade


def fresh(spark, name: str, key: str) -> KeyedTable:
    """A new table in the shared checkpoint folder."""
    checkpoints(spark)
    return KeyedTable(f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}", key)


LINES_SQL = f"{TIMED_SQL}, bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM bad WHERE doc_id IS NOT NULL)), own AS (SELECT doc_id, idx, sentence, n FROM sent WHERE doc_id IS NOT NULL)"


def _rewritten(spark, sf_dir) -> dict[str, KeyedTable]:
    """Lines, long lines and counts of all documents; toxic ones get a single line instead, those of low quality are deleted."""
    lines = R.lines_of(R.spoken(table(spark, sf_dir, "documents"))).select("doc_id", "idx", "sentence", "n")
    tables = {name: fresh(spark, name, "doc_id") for name in ("lines", "long", "counts")}
    tables["lines"].create(lines)
    held = tables["lines"].read(spark)
    tables["long"].create(held.where("n >= 12").select("doc_id", "idx"))
    counted = {"lines": F.count(F.lit(1)), "words": F.sum("n")}
    tables["counts"].create(held.groupBy("doc_id").agg(*[c.alias(k) for k, c in counted.items()], F.min("idx").alias("first")))
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("toxic") == 1).alias("toxic"), F.bool_or(F.col("quality") == 0).alias("low"))
    kinds = {f.name: f.dataType for f in held.schema.fields}
    notice = labels.where("toxic").select("doc_id", F.lit(0).cast(kinds["idx"]).alias("idx"), F.lit("[removed]").alias("sentence"), F.lit(1).cast(kinds["n"]).alias("n"))
    attach(tables["lines"], [tables["long"]], tables["counts"], notice, counted)
    delete_cascade(labels.where("low AND NOT coalesce(toxic, false)").select("doc_id"), [tables["long"], tables["lines"], tables["counts"]])
    return tables


@query(f"{LINES_SQL} SELECT doc_id, idx, sentence FROM own WHERE doc_id NOT IN (SELECT doc_id FROM bad WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT doc_id FROM low WHERE doc_id IS NOT NULL) UNION ALL SELECT doc_id, 0, '[removed]' FROM bad WHERE doc_id IS NOT NULL")
def replaced_lines(spark, sf_dir):
    """The lines of a table after its toxic documents' lines were replaced and those of low quality deleted."""
    return _rewritten(spark, sf_dir)["lines"].read(spark).select("doc_id", "idx", "sentence")


@query(f"""{LINES_SQL}, h AS (SELECT doc_id, count(*) AS lines, sum(n)::BIGINT AS words, count(*) FILTER (n >= 12) AS long FROM own GROUP BY 1)
SELECT doc_id, CASE WHEN b.k THEN 1 ELSE lines END AS lines, CASE WHEN b.k THEN 1 ELSE words END AS words, CASE WHEN b.k THEN 0 ELSE long END AS long FROM h LEFT JOIN (SELECT doc_id, true AS k FROM bad) b USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM low WHERE doc_id IS NOT NULL)""")
def replaced_counts(spark, sf_dir):
    """Each document's counts after the same changes, and how many derived rows it still has."""
    tables = _rewritten(spark, sf_dir)
    long = tables["long"].read(spark).groupBy("doc_id").agg(F.count(F.lit(1)).alias("long"))
    return tables["counts"].read(spark).join(long, "doc_id", "left").select("doc_id", "lines", "words", F.coalesce("long", F.lit(0).cast("long")).alias("long"))
