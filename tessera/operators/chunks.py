"""Packing of a document's lines into chunks of text with an overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP, MOST, BREAK_AT = 2, 40, 0.55


def chunk_bounds(lines: Column) -> Column:
    """array<struct<first,fresh,last>> of ``lines``, an array of (size, opens, budget): one fold over the document.

    A chunk ends before a line that would take it over the budget, or that opens a topic when it is 0.55 full; the next begins with its
    last two lines (``fresh`` is the first one after them).  The fold carries sizes and line numbers only.
    """
    zero = F.lit(0).cast("long")
    names = ["size", "before", "last", "count", "first", "fresh", "at"]

    def step(a: Column, x: Column) -> Column:
        full = (a["count"] > 0) & ((a["size"] + x["size"] > x["budget"]) | (x["opens"] & (a["size"] > x["budget"] * BREAK_AT)))
        kept = F.least(a["count"], F.lit(OVERLAP).cast("long"))
        size = F.when(~full, a["size"]).otherwise(F.when(kept > 1, a["before"] + a["last"]).otherwise(a["last"]))
        new = {
            "size": size + x["size"] + 1, "before": a["last"], "last": x["size"], "count": F.when(full, kept).otherwise(a["count"]) + 1,
            "first": F.when(full, a["at"] - kept).otherwise(a["first"]), "fresh": F.when(full, a["at"]).otherwise(a["fresh"]), "at": a["at"] + 1,
        }
        out = F.when(full, F.array_append(a["out"], F.struct(a["first"].alias("first"), a["fresh"].alias("fresh"), (a["at"] - 1).alias("last")))).otherwise(a["out"])
        return F.struct(*[new[n].alias(n) for n in names], out.alias("out"))

    start = F.struct(*[zero.alias(n) for n in names], F.array().cast("array<struct<first:bigint,fresh:bigint,last:bigint>>").alias("out"))
    end = lambda a: F.when(a["count"] == 0, a["out"]).otherwise(F.array_append(a["out"], F.struct(a["first"].alias("first"), a["fresh"].alias("fresh"), (a["at"] - 1).alias("last"))))
    return F.aggregate(lines, start, step, end)


def chunks(docs: DataFrame, most_chars: int, most: int = MOST) -> DataFrame:
    """doc_id, chunk, first, last, start_cs, end_cs, text of documents with lines (sentence, start_cs, end_cs) and opens.

    The budget is ``most_chars``, or what makes ``most`` chunks of the document if that is more; of more chunks evenly spaced ones stay.
    """
    clock = lambda cs: F.format_string("[%02d:%02d:%02d] ", F.floor(cs / 360_000), F.floor(cs / 6_000) % 60, F.floor(cs / 100) % 60)
    docs = docs.where(F.size("lines") > 0).withColumn("said", F.transform("lines", lambda x: F.concat(clock(x["start_cs"]), F.trim(x["sentence"]))))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x["sentence"]))
    docs = docs.withColumn("budget", F.greatest(F.lit(most_chars).cast("long"), F.floor(total / most).cast("long")))
    # the fold is told the budget by each line; both uses keep its expression out of the lambda
    told = F.zip_with("said", "opens", lambda t, o: F.struct(F.length(t).cast("long").alias("size"), o.alias("opens"), F.greatest(F.col("budget"), F.lit(most_chars)).alias("budget"), (F.col("budget") > 0).alias("some")))
    docs = docs.withColumn("found", chunk_bounds(told))
    n = F.size("found")
    docs = docs.withColumn("kept", F.when(n <= most, F.col("found")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.get("found", F.floor(j * (n / float(most))).cast("int")))))
    each = F.transform("kept", lambda c: F.struct(
        c["first"].alias("first"), c["last"].alias("last"), F.get("lines", c["fresh"].cast("int"))["start_cs"].alias("start_cs"), F.get("lines", c["last"].cast("int"))["end_cs"].alias("end_cs"),
        F.array_join(F.slice("said", c["first"].cast("int") + 1, (c["last"] - c["first"]).cast("int") + 1), "\n").alias("text"),
    ))
    rows = docs.select("doc_id", F.posexplode_outer(each).alias("chunk", "c")).where("c IS NOT NULL")
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "c.*")
