"""Moving the edges of ranges to where a thought begins and ends.

All ranges of a document move together, one step of the rules at a time, on
arrays of its lines: extend back for the setup, trim, drop a trailing tangent,
grow, snap to the last complete sentence, fit.  Each step looks a few lines to
either side of an edge, so the work is that of the ranges, whatever their document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["start_cs", "end_cs", "tokens", "questions", "terminal", "deictic", "conjunction", "opens"]
SHORT_TAIL, SETUPS = 12, 3


def optimised(x: dict[str, np.ndarray], s: np.ndarray, e: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the moved ranges; ``x`` has the lines' ``FIELDS``, a range lasts ``low`` to ``high``."""
    s, stop, n = s.copy(), e + 1, len(x["start_cs"])
    start, end, final = x["start_cs"], x["end_cs"], x["terminal"].astype(bool)
    lasts = lambda a, b: end[np.clip(b - 1, 0, n - 1)] - start[np.clip(a, 0, n - 1)]
    answers = np.concatenate([[False], (x["questions"][:-1] > 0) & (x["questions"][1:] == 0)])
    unready = x["deictic"].astype(bool) | x["conjunction"].astype(bool) | (x["tokens"] < 4) | answers
    moving = np.ones(len(s), bool)
    for _ in range(SETUPS):
        moving &= (s > 0) & unready[s] & (lasts(s - 1, stop) * 100 <= high * 102)
        s -= moving
    while (long := (stop - s > 2) & (lasts(s, stop) > high)).any():
        stop -= long
    tail = (stop - s > 2) & (x["tokens"][stop - 1] <= SHORT_TAIL) & (lasts(s, stop - 1) >= low)
    stop -= tail & (~final[stop - 1] | x["opens"][stop - 1].astype(bool))
    while (short := (lasts(s, stop) < low) & (stop < n)).any():
        stop += short
    seeking, at = (stop - s >= 2) & ~final[stop - 1], stop - 1
    while (seeking := seeking & (at > s + 1)).any():
        found = seeking & final[np.maximum(at - 1, 0)] & (lasts(s, at) >= low)
        stop = np.where(found, at, stop)
        seeking &= ~found
        at = at - 1
    while (long := (lasts(s, stop) > high) & (stop - s > 1)).any():
        stop -= long
    while (short := (lasts(s, stop) < low) & (s > 0) & (stop - s < 3)).any():
        s -= short
    return s, stop - 1


def moved(lines: Column, ranges: Column, low: int, high: int) -> Column:
    """array<struct<s,e>>: the moved ``ranges`` (an array of s and e) of a document, ``lines`` its lines' ``FIELDS`` in order."""

    @F.arrow_udf("array<struct<s:bigint,e:bigint>>")
    def move(lines: pa.Array, ranges: pa.Array) -> pa.Array:
        sizes, counts = (a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (lines, ranges))
        all_lines, all_ranges = lines.flatten(), ranges.flatten()
        x = {f: all_lines.field(f).to_numpy(zero_copy_only=False) for f in FIELDS}
        s, e = (all_ranges.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("s", "e"))
        out, at, line = [np.zeros((2, 0), np.int64)], 0, 0
        for n, k in zip(sizes, counts, strict=True):
            own = {f: v[line : line + n] for f, v in x.items()}
            if k:
                out.append(np.stack(optimised(own, s[at : at + k], e[at : at + k], low, high)))
            line, at = line + n, at + k
        new = np.concatenate(out, axis=1)
        each = pa.StructArray.from_arrays([pa.array(new[0]), pa.array(new[1])], ["s", "e"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), each)

    return move(lines, ranges)


def optimise_bounds(lines: DataFrame, ranges: DataFrame, low: int, high: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, s, e, ``keep``, to_s, to_e of all ``ranges`` (doc_id, s, e, ``keep``) over ``lines`` (doc_id, idx, ``FIELDS``)."""
    own = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", *FIELDS))).alias("lines"))
    wanted = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", *keep))).alias("ranges"))
    rows = own.join(wanted, "doc_id").withColumn("moved", moved(F.col("lines"), F.col("ranges"), low, high))
    each = rows.select("doc_id", F.explode(F.arrays_zip("ranges", "moved")).alias("x"))
    return each.select("doc_id", *[f"x.ranges.{c}" for c in ("s", "e", *keep)], F.col("x.moved.s").alias("to_s"), F.col("x.moved.e").alias("to_e"))
