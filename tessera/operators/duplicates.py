"""Greedy removal of duplicates as an independent set in rounds.

The greedy order (best first, each kept unless it conflicts with one kept before)
gives the same set as rounds on the conflict graph: what no remaining better one
conflicts with is kept, what it conflicts with goes, and so on.  A round is a few
joins by key on edges alone, so no document is folded in one task; the number of
rounds is the longest chain of such decisions, and edges are written in the
checkpoint folder after each.

Ranges of documents conflict with others of their own document only, and start
close to them.  Their conflicts and what these drop are worked out on the
document's row, all rows of a batch at once: no pair is shuffled.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.similarity import following


def checkpoints(spark: SparkSession) -> None:
    """The folder of ``spark.checkpoint.dir``; on one machine alone a temporary one where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tessera-"))


def written_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder, in buckets by ``column``: what is joined, grouped or ordered within it is not shuffled.

    Joins on ``column`` and others keep to these buckets too.  A checkpoint would hold the rows uncompressed and forget how they are dealt.
    """
    spark = df.sparkSession
    checkpoints(spark)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{spark.sparkContext.getCheckpointDir()}/{table}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone; the files stay
    return found


def dropped_in_rounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys and lo of all that go: ``edges`` (keys, hi, lo) has a row for each conflict, hi the better one.

    Repeated edges count once; an empty table drops nothing.
    """
    checkpoints(edges.sparkSession)
    left = edges.select(*keys, "hi", "lo").checkpoint()
    gone = left.select(*keys, "lo").limit(0)
    while not left.isEmpty():
        worse = left.select(*keys, F.col("lo").alias("hi")).distinct()
        kept = left.join(worse, [*keys, "hi"], "left_anti").select(*keys, "hi").distinct()
        now = left.join(kept, [*keys, "hi"], "left_semi").select(*keys, "lo").distinct().checkpoint()
        gone = gone.unionByName(now)
        left = left.join(now, [*keys, "lo"], "left_anti").join(now.withColumnRenamed("lo", "hi"), [*keys, "hi"], "left_anti").select(*keys, "hi", "lo").checkpoint()
    return gone


#: Kinds of conflicts, by number.
KINDS = ["", "overlap_duplicate", "semantic_duplicate"]


@dataclass(frozen=True)
class Limits:
    """Two ranges are one moment if they share ``shared`` of their union or ``inside`` of the shorter (ten-thousandths), and are ``alike`` (millionths), share
    ``same`` of their union or start at most ``lines`` lines apart; others that are ``alike`` are duplicates.  Pairs start less than ``within`` apart."""

    shared: int
    inside: int
    same: int
    alike: int
    within: int
    lines: int = 6


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run of ``n`` numbers, run after run."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def conflicting(ranges: pa.Array, terms: pa.Array, limits: Limits) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The ranges of some documents (s, e, start_cs, end_cs, score, by start), and their conflicts: document, hi and lo (places of ranges, hi the better one), iou, inside, alike, kind.

    A range's text is its first, middle and last line; ``terms`` has the words of each line of each document.
    """
    counts, sizes = (a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (ranges, terms))
    flat, lines = ranges.flatten(), terms.flatten()
    x = {f: flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("s", "e", "start_cs", "end_cs", "score")}
    words = lines.flatten().dictionary_encode().indices.to_numpy()
    lengths = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begun = np.cumsum(lengths) - lengths
    reaches, found, at, line = [np.zeros(0, np.int64)], [np.zeros(0)], 0, 0
    for k, n in zip(counts, sizes, strict=True):
        s, e, start = (x[f][at : at + k] for f in ("s", "e", "start_cs"))
        middle = s + np.rint((e - s) / 2).astype(np.int64)
        said = np.stack([s, middle, e], axis=1) + line
        own = np.stack([np.ones(k, bool), middle != s, (e != middle) & (e != s)], axis=1)
        own = np.where(own, lengths[said] if len(said) else 0, 0)
        reach = np.searchsorted(start, start + limits.within) - np.arange(k) - 1
        reaches.append(reach)
        found.append(following(own.sum(axis=1), words[runs(begun[said.ravel()], own.ravel())], reach))
        at, line = at + k, line + n
    reach, alike = np.concatenate(reaches), np.concatenate(found).astype(np.int64)
    a, b = np.repeat(np.arange(len(reach)), reach), runs(np.arange(len(reach)) + 1, reach)
    start, end = x["start_cs"], x["end_cs"]
    both = np.maximum(np.minimum(end[a], end[b]) - start[b], 0)
    iou = np.floor(both * 10000.0 / (np.maximum(end[a], end[b]) - start[a]) + 0.5).astype(np.int64)
    inside = np.floor(both * 10000.0 / np.minimum(end[a] - start[a], end[b] - start[b]) + 0.5).astype(np.int64)
    moment, like = (iou >= limits.shared) | (inside >= limits.inside), alike >= limits.alike
    kind = np.where(moment, like | (iou >= limits.same) | (x["s"][b] - x["s"][a] <= limits.lines), 2 * like)
    later = x["score"][b] > x["score"][a]
    pairs = {"doc": np.repeat(np.arange(len(counts)), counts)[a], "hi": np.where(later, b, a), "lo": np.where(later, a, b), "iou": iou, "inside": inside, "alike": alike, "kind": kind}
    return x, {f: v[kind > 0] for f, v in pairs.items()}


def kept_first(hi: np.ndarray, lo: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` ranges stay, best first: the rounds of ``dropped_in_rounds``."""
    stays = np.ones(n, bool)
    while len(hi):
        worse, now = np.zeros(n, bool), np.zeros(n, bool)
        worse[lo] = True
        now[lo[~worse[hi]]] = True
        stays &= ~now
        left = ~now[lo] & ~now[hi]
        hi, lo = hi[left], lo[left]
    return stays


def conflicts(ranges: Column, terms: Column, limits: Limits) -> Column:
    """array<struct<hi,lo,iou,inside,alike,kind>>: all conflicts of a document's ``ranges``, hi and lo by their first lines (see ``conflicting``)."""

    @F.arrow_udf("array<struct<hi:bigint,lo:bigint,iou:bigint,inside:bigint,alike:bigint,kind:string>>")
    def find(ranges: pa.Array, terms: pa.Array) -> pa.Array:
        x, pairs = conflicting(ranges, terms, limits)
        fields = {"hi": x["s"][pairs["hi"]], "lo": x["s"][pairs["lo"]], "iou": pairs["iou"], "inside": pairs["inside"], "alike": pairs["alike"]}
        kind = pa.array(KINDS).take(pa.array(pairs["kind"]))
        each = pa.StructArray.from_arrays([*map(pa.array, fields.values()), kind], [*fields, "kind"])
        offsets = np.searchsorted(pairs["doc"], np.arange(len(ranges) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), each)

    return find(ranges, terms)


def settled(ranges: Column, terms: Column, limits: Limits) -> Column:
    """array<struct<s,e,score,status,duplicate_of,code>>: each of a document's ``ranges`` as kept, or as the duplicate of the best kept one that it conflicts with."""

    @F.arrow_udf("array<struct<s:bigint,e:bigint,score:bigint,status:string,duplicate_of:bigint,code:string>>")
    def settle(ranges: pa.Array, terms: pa.Array) -> pa.Array:
        x, pairs = conflicting(ranges, terms, limits)
        n = len(x["s"])
        hi, lo, kind = pairs["hi"], pairs["lo"], pairs["kind"]
        own = kept_first(hi, lo, n)[hi]
        hi, lo, kind = hi[own], lo[own], kind[own]
        order = np.lexsort([x["start_cs"][hi], -x["score"][hi], lo])
        known, first = np.unique(lo[order], return_index=True)
        of, code = np.zeros(n, np.int64), np.zeros(n, np.int64)
        of[known], code[known] = x["s"][hi[order][first]], kind[order][first]
        status = pa.array(["kept", "duplicate"]).take(pa.array((code > 0).astype(np.int64)))
        columns = [pa.array(x["s"]), pa.array(x["e"]), pa.array(x["score"]), status, pa.array(of, mask=code == 0), pa.array(KINDS).take(pa.array(code))]
        each = pa.StructArray.from_arrays(columns, ["s", "e", "score", "status", "duplicate_of", "code"])
        sizes = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), each)

    return settle(ranges, terms)
