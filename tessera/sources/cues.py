"""Cue files as rows: path, idx, start_ms, end_ms, text.

Files are read whole (``wholetext``), one row each, and cut by column
expressions; a file of no known suffix gives no rows.  A cue without text, or
that does not end after it starts, is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

CLOCK = r"(?:\d+:)?\d{1,2}:\d{2}(?:[,.]\d{1,3})?"
ARROW = rf"({CLOCK})[ \t]*-->[ \t]*({CLOCK})[^\n]*"


def _valid(cues: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("pos")
    cues = cues.withColumn("text", T.clean_markup(F.col("text"))).where("text <> '' AND start_ms >= 0 AND end_ms > start_ms")
    return cues.withColumn("idx", F.row_number().over(order) - 1).select("path", "idx", "start_ms", "end_ms", "text")


def arrow_cues(files: DataFrame) -> DataFrame:
    """SRT and VTT: ``start --> end`` and the lines up to the next cue, without counters and headers."""
    body = F.replace(F.col("value"), F.lit("\r"), F.lit(""))
    rows = files.withColumn("heads", F.regexp_extract_all(body, F.lit(ARROW), F.lit(0))).withColumn("bodies", F.slice(F.split(body, ARROW, -1), F.lit(2), F.size("heads")))
    rows = rows.select("path", F.posexplode(F.arrays_zip("heads", "bodies")).alias("pos", "cue"))
    lines = F.filter(F.split("cue.bodies", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^\d+$|^WEBVTT$"))
    at = lambda i: T.clock_to_ms(F.regexp_extract("cue.heads", ARROW, i))
    return _valid(rows.select("path", "pos", at(1).alias("start_ms"), at(2).alias("end_ms"), F.concat_ws(" ", lines).alias("text")))


JSON3 = "events array<struct<tStartMs:long,dDurationMs:long,segs:array<struct<utf8:string>>>>"


def json3_cues(files: DataFrame) -> DataFrame:
    """JSON events: a missing start is 0, a missing duration lasts to the next event, else 1.5 s."""
    rows = files.select("path", F.posexplode(F.from_json("value", JSON3)["events"]).alias("pos", "e"))
    rows = rows.select("path", "pos", F.coalesce("e.tStartMs", F.lit(0).cast("long")).alias("start_ms"), F.col("e.dDurationMs").alias("d"), F.array_join(F.transform("e.segs", lambda s: T.filled(s["utf8"])), "").alias("text"))
    after = F.lead("start_ms").over(Window.partitionBy("path").orderBy("pos"))
    end = F.when(F.col("d") > 0, F.col("start_ms") + F.col("d")).when(after > F.col("start_ms"), after).otherwise(F.col("start_ms") + 1500)
    return _valid(rows.withColumn("end_ms", end).drop("d"))


def plain_cues(files: DataFrame) -> DataFrame:
    """Lines ``start --> end text``, dropped where the end is not later, or ``[start] text`` with an optional ``-`` or ``:`` between.

    A start alone lasts to the next cue's if that is later, else 3 s.
    """
    lines = F.split(F.replace(F.col("value"), F.lit("\r"), F.lit("")), "\n")
    rows = files.select("path", F.posexplode(lines).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"^\s+", ""))
    rows = rows.withColumns({"left": F.rtrim(F.substring_index("line", "-->", 1)), "right": F.regexp_replace(F.substr("line", F.length(F.substring_index("line", "-->", 1)) + 4), r"^\s+", "")})
    whole, leading = rf"^{CLOCK}$", rf"^{CLOCK}"
    both = F.contains("line", F.lit("-->")) & F.col("left").rlike(whole) & F.col("right").rlike(leading + r"\s*\S")
    bare = F.regexp_replace("line", r"^\[", "")
    stamp = F.regexp_extract(bare, r"^\d+(?::\d\d){1,2}(?:[,.]\d{1,3})?", 0)
    said = F.regexp_replace(F.regexp_replace(F.substr(bare, F.length(stamp) + 1), r"^\]?\s*", ""), r"^[-–:]?\s*", "")
    end = F.regexp_extract("right", leading, 0)
    rows = rows.select(
        "path", "pos", both.alias("both"), T.clock_to_ms(F.when(both, F.col("left")).otherwise(stamp)).alias("start_ms"), F.when(both, T.clock_to_ms(end)).alias("given"),
        F.when(both, F.substr("right", F.length(end) + 1)).when(stamp != "", said).otherwise("").alias("text"),
    ).where("NOT both OR given > start_ms")
    rows = rows.where(T.clean_markup(F.col("text")) != "")
    after = F.lead("start_ms").over(Window.partitionBy("path").orderBy("pos"))
    later = F.when(after > F.col("start_ms"), F.greatest(after, F.col("start_ms") + 80)).otherwise(F.col("start_ms") + 3000)
    return _valid(rows.withColumn("end_ms", F.coalesce("given", later)).drop("given", "both"))


def cues_of(files: DataFrame) -> DataFrame:
    """Cues of ``files`` (path, value), each read by its suffix."""
    suffix: Column = F.lower(F.substring_index("path", ".", -1))
    return (
        arrow_cues(files.where(suffix.isin("srt", "vtt")))
        .unionByName(json3_cues(files.where(suffix == "json3")))
        .unionByName(plain_cues(files.where(suffix == "txt")))
    )


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """All cue files under ``path``, each read by its suffix, without a byte-order mark."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return cues_of(files)


def srt_lines(cues: DataFrame) -> DataFrame:
    """path, idx, block: each cue as a block of an SRT file."""
    at = lambda c: F.format_string("%02d:%02d:%02d,%03d", F.floor(F.col(c) / 3_600_000), F.floor(F.col(c) / 60_000) % 60, F.floor(F.col(c) / 1000) % 60, F.col(c) % 1000)
    return cues.select("path", "idx", F.concat((F.col("idx") + 1).cast("string"), F.lit("\n"), at("start_ms"), F.lit(" --> "), at("end_ms"), F.lit("\n"), "text", F.lit("\n")).alias("block"))
