"""The data source of cue files: places, partitions and filters taken over."""

import os

from tessera.sources.cue_files import CueFiles, CueFilesReader, EqualTo, In, best_cues

CUES = "1\n00:00:01,000 --> 00:00:02,500\n{} says a few words\n"


def put(root, name, text, when):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    os.utime(path, (when, when))


def test_cue_files(spark, tmp_path):
    put(tmp_path, "a/track.SRT", CUES.format("track"), 100)
    put(tmp_path, "a/newer.srt", CUES.format("newer"), 200)
    put(tmp_path, "a/Provided.txt", "\ufeff[00:00:01] provided by a user of the engine\n", 50)
    put(tmp_path, "b/x.vtt", "WEBVTT\n\n" + CUES.format("vtt"), 100)
    put(tmp_path, "b/y.txt", "[00:00:01] plain text comes after the others\n", 900)
    put(tmp_path, "b/small.srt", "1\n", 900)
    put(tmp_path, "b/notes.md", "x" * 99, 900)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CueFiles)
    files = spark.read.format("cue_files").option("groupBytes", 100).load(str(tmp_path))
    assert [(r["path"].rsplit("/", 1)[1], r["place"]) for r in files.orderBy("folder", "place").collect()] == [("Provided.txt", 0), ("newer.srt", 1), ("track.SRT", 2), ("x.vtt", 0), ("y.txt", 1)]
    assert files.rdd.getNumPartitions() > 1
    assert {r["text"] for r in best_cues(spark, str(tmp_path)).collect()} == {"provided by a user of the engine", "vtt says a few words"}
    assert files.where("suffix IN ('srt', 'vtt') AND place = 0 AND bytes > 1").count() == 1
    (tmp_path / "none").mkdir()
    assert best_cues(spark, str(tmp_path / "none")).collect() == []


def test_filters_leave_files_unopened(tmp_path):
    put(tmp_path, "a/x.srt", CUES.format("one"), 100)
    put(tmp_path, "a/y.txt", CUES.format("two"), 100)
    reader = CueFilesReader({"path": str(tmp_path), "groupbytes": "1"})
    assert len(reader.partitions()) == 2
    other = EqualTo(("bytes",), 3)
    assert list(reader.pushFilters([EqualTo(("place",), 0), In(("suffix",), ("srt", "txt")), other])) == [other]
    assert [r[2] for g in reader.partitions() for r in g.rows] == ["srt"]
    assert list(reader.pushFilters([EqualTo(("suffix",), "txt")])) == [] and [g.rows for g in reader.partitions()] == [[]]
