"""Cue files and event streams."""

import json

from pyspark.sql import functions as F

from tessera.sources import cues
from tessera.streaming import events
from tests.conftest import SF


def test_cue_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nfirst <b>line</b>\nsecond line\n\n2\n00:00:03,000 --> 00:00:03,000\nno length\n\n3\n0:04.5 --> 0:05.25\nlast &amp; least\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000 align:start\nhello\n")
    (tmp_path / "c.json3").write_text(json.dumps({"events": [{"tStartMs": 0, "dDurationMs": 700, "segs": [{"utf8": "one "}, {"utf8": "two"}]}, {"tStartMs": 1000, "segs": [{"utf8": "three"}]}, {"tStartMs": 4000, "segs": [{"utf8": "four"}]}, {"tStartMs": 5000}]}))
    (tmp_path / "d.txt").write_text("[00:00:01] start only\n00:00:05 --> 00:00:06 both ends\nno clock\n")
    (tmp_path / "e.md").write_text("00:00:01 --> 00:00:02\nnot a cue file\n")
    (tmp_path / "empty.srt").write_text("")
    got = {(r["path"].rsplit("/", 1)[1], r["idx"]): (r["start_ms"], r["end_ms"], r["text"]) for r in cues.read_cues(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.srt", 0): (1000, 2500, "first line second line"), ("a.srt", 1): (4500, 5250, "last & least"), ("b.vtt", 0): (1000, 2000, "hello"),
        ("c.json3", 0): (0, 700, "one two"), ("c.json3", 1): (1000, 4000, "three"), ("c.json3", 2): (4000, 5000, "four"),
        ("d.txt", 0): (1000, 5000, "start only"), ("d.txt", 1): (5000, 6000, "both ends"),
    }
    again = cues.srt_lines(cues.read_cues(spark, str(tmp_path / "a.srt"))).orderBy("idx").collect()
    assert again[0]["block"] == "1\n00:00:01,000 --> 00:00:02,500\nfirst line second line\n"


def test_plain_lines_marks_and_orders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\ufeff0:01 first\n[00:03]- dash\n00:05:colon\n00:09 --> 00:08 ends before\n00:12 --> 00:12.5 whole\n00:10 earlier next\n[00:02]no space\nno clock\n00:20\n", encoding="utf-8")
    (tmp_path / "b.json3").write_text("\ufeff" + json.dumps({"events": [{"dDurationMs": 500, "segs": [{"utf8": "no start"}]}, {"tStartMs": 9000, "dDurationMs": 100, "segs": [{"utf8": "late"}]}, {"tStartMs": 4000, "dDurationMs": 100, "segs": [{"utf8": "early"}]}]}), encoding="utf-8")
    (tmp_path / "c.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nWEBVTT is a format\n")
    got = [(r["path"].rsplit("/", 1)[1], r["start_ms"], r["end_ms"], r["text"]) for r in cues.read_cues(spark, str(tmp_path)).orderBy("path", "idx").collect()]
    assert got == [
        ("a.txt", 1000, 3000, "first"), ("a.txt", 3000, 5000, "dash"), ("a.txt", 5000, 12000, "colon"), ("a.txt", 12000, 12500, "whole"), ("a.txt", 10000, 13000, "earlier next"), ("a.txt", 2000, 5000, "no space"),
        ("b.json3", 0, 500, "no start"), ("b.json3", 9000, 9100, "late"), ("b.json3", 4000, 4100, "early"), ("c.vtt", 1000, 2000, "WEBVTT is a format"),
    ]


def streamed(spark, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.limit(300).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = streamed(spark, events.hourly_counts(stream), "hourly")
    want = events.hourly_counts(batch)
    assert got.subtract(want).count() == 0 and want.subtract(got).count() <= 5  # windows after the watermark stay open
    assert streamed(spark, events.sessions(stream), "sessions").subtract(events.sessions(batch)).count() == 0
    passed = streamed(spark, events.throttled(stream, 3600.0), "throttled").collect()
    want = set()
    for rows in batch.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("r")).collect():
        last = None
        for x in rows["r"]:
            due = last is None or (x["ts"] - last).total_seconds() >= 3600
            if due or x["event_type"] == "error":
                want.add(x["event_id"])
            last = x["ts"] if due else last
    assert {r["event_id"] for r in passed} == want
    assert events.in_scope(batch, None).count() == 300 and events.in_scope(batch, 1).where("user_id <> 1").count() == 0
