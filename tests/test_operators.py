"""Operators on small tables of their own, against plain loops."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import greedy
from tessera.operators.timed import nearest_other, range_windows
from tessera.operators.transcript import ranges_ahead


def test_nearest_other_with_ties(spark):
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 2, 3]), draw.randrange(12), i, draw.choice(["ask", "a", "b"])) for i in range(120)]
    rows += [(9, 5, 500, "ask"), (None, 1, 600, "ask"), (None, 1, 601, "a")]
    frame = spark.createDataFrame(rows, "k int, t long, id long, kind string")
    got = {(r["id"]): (r["near"]["d"], r["near"]["t"], r["near"]["tie"], r["near"]["label"]) for r in nearest_other(frame, "k", "t", "id", "kind", F.col("kind") == "ask").collect()}
    want = {}
    for k, t, i, kind in rows:
        others = [(abs(u - t), u, j, c) for m, u, j, c in rows if m == k and c != "ask"]
        if kind == "ask" and others:
            want[i] = min(others)
    assert got == want
    assert nearest_other(frame.limit(0), "k", "t", "id", "kind", F.col("kind") == "ask").count() == 0


def test_sampled_windows_are_picked_from_all(spark):
    draw, rows = random.Random(5), []
    for doc, size in ((1, 60), (2, 3), (3, 1), (4, 40)):
        at = 0
        for i in range(size):
            length = draw.choice([30, 64, 200, 336, 2500 if doc == 4 else 100])
            rows.append((doc, i, at, at + length, i * 7))
            at += length + draw.choice([0, 51])
    frame = spark.createDataFrame(rows, "doc_id long, idx long, start_cs long, end_cs long, w long")
    every = sorted((r["doc_id"], r["s"], r["e"]) for r in range_windows(frame, 2000, 6000).collect())
    want = set()
    for _, run in itertools.groupby(every, key=lambda r: r[:2]):
        run = list(run)
        m = len(run)
        want |= set(run) if m <= 14 else {run[int(k * (m - 1) / 13 + 0.5)] for k in range(14)}
    got = ranges_ahead(frame, 2000, 6000, ["w"]).select("doc_id", F.col("idx").alias("s"), "start_cs", F.explode("picks").alias("e")).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["s"], r["e"]["idx"]) for r in got} == want
    assert all(r["e"]["w"] == 7 * r["e"]["idx"] and 2000 <= r["e"]["end_cs"] - r["start_cs"] <= 6000 for r in got)


def test_non_overlapping_compares_all_that_can_meet(spark):
    draw = random.Random(7)
    rows = []
    for i in range(300):
        a = draw.randrange(20_000)
        rows.append((1, i, i, a, a + draw.choice([10, 400, 3000, 9000]), draw.randrange(20)))
    frame = spark.createDataFrame(rows, "doc_id long, s long, e long, start_cs long, end_cs long, score long")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[1])):
        if all(max(0, min(r[4], y) - max(r[3], x)) <= 0.35 * min(r[4] - r[3], y - x) for x, y in ((k[3], k[4]) for k in kept)):
            kept.append(r)
    assert {r["s"] for r in greedy.non_overlapping(frame).collect()} == {r[1] for r in kept}


def test_text_helpers(spark):
    row = spark.createDataFrame([("“Hello,”", "one two three", "li<b>n</b>e﻿ &amp; so")], "w string, t string, m string").select(T.normalize_word(F.col("w")).alias("w"), T.ellipsize(F.col("t"), 10).alias("t"), T.clean_markup(F.col("m")).alias("m")).first()
    assert tuple(row) == ("hello", "one two…", "line & so")
