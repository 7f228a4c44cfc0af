"""Best-two-fit packing of token documents into sequences of a fixed capacity.

1.  Every whole text is encoded, the end id appended, and the ids stored in
    pieces of at most ``capacity`` (only a longer document has more than one).
    Each piece carries the task that wrote it and its number among that task's
    pieces of its length; a last row of each task counts them.
2.  A packing depends on lengths alone, and there are at most ``capacity`` of
    them, so the driver gets one row a length: how many pieces have it, in all
    documents.  ``best_two_fit`` fills a sequence greedily (the longest that fits,
    again and again), then takes its shortest document out for the two unpacked
    ones that fill the larger gap best, while that makes it tighter.  The same
    choices are made until a length runs short, so a pattern is found once and
    repeated at once; there are at most ``capacity`` times its logarithm of them,
    whatever the number of documents.
3.  A piece's rank among all of its length is the sum of the counts of earlier
    tasks (a window over tasks by length, a join by task and length) plus its
    number in its own.  Length and rank say its sequence and offset, looked up in
    the patterns in batches.  No ids are shuffled, unless ``sequences`` puts them
    together.

Defined cases: a null or empty text is the end id alone; a null key is packed
like any other; repeated rows are packed each; an empty table has no pieces;
extra columns are not read.  Ids of a length tie by task and number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored, whole_text
from tessera.llm.encoding import WORD_BPE, piece_encoder

WIDTH = 4  # bytes of a stored id
RANK_BITS = 44  # a length and a rank are looked up as one number


def cut_documents(docs: DataFrame, path: str, end: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids, task, nth of all pieces; counts is null but in the last row of a task."""
    tail, size = int(end).to_bytes(WIDTH, "little"), capacity * WIDTH

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task = piece_encoder(path, WIDTH), TaskContext.get().partitionId()
        met = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for k, ids in zip(batch[key], encoder.encode(list(batch["t"])), strict=True):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    length = len(part) // WIDTH
                    rows.append((k, piece, at // WIDTH, length, part, met[length]))
                    met[length] += 1
            out = pd.DataFrame(rows, columns=[key, "piece", "start", "length", "ids", "nth"])
            out[key] = out[key].astype("Int64")
            yield out.assign(task=task, counts=None)[[key, "piece", "start", "length", "ids", "task", "nth", "counts"]]
        none = pd.Series([None], dtype="Int64")
        counts = [{"length": i, "n": n} for i, n in enumerate(met) if n]
        yield pd.DataFrame({key: none, "piece": none, "start": none, "length": none, "ids": [None], "task": [task], "nth": none, "counts": [counts]})

    schema = f"{key} long, piece int, start long, length int, ids binary, task int, nth long, counts array<struct<length:int,n:long>>"
    return docs.select(F.col(key).cast("long"), whole_text(text).alias("t")).mapInPandas(encode, schema)


@dataclass
class Patterns:
    """Runs of pieces of one length by rank: ``uses`` in each of the sequences from ``sequence`` on, from ``offset`` on."""

    length: np.ndarray
    first: np.ndarray
    uses: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int = 0

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of each piece."""
        run = np.searchsorted((self.length << RANK_BITS) + self.first, (length << RANK_BITS) + rank, "right") - 1
        turn, slot = np.divmod(rank - self.first[run], self.uses[run])
        return self.sequence[run] + turn, self.offset[run] + slot * length


def largest_within(left: np.ndarray) -> np.ndarray:
    """For each x the largest length of at most x that is left, else 0."""
    return np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))


def best_pair(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths left whose sum is the largest within ``room``, the first as long as possible; (0, 0) if none fit."""
    a = np.flatnonzero(left[:room])
    if not len(a):
        return 0, 0
    most = np.minimum(room - a, a)
    most -= (most == a) & (left[a] == 1)
    b = largest_within(left[: room + 1])[most]
    total = np.where(b > 0, a + b, 0)
    best = len(a) - 1 - int(np.argmax(total[::-1]))
    return (int(a[best]), int(b[best])) if total[best] else (0, 0)


def best_two_fit(counts: np.ndarray, capacity: int) -> Patterns:
    """Pack ``counts[n]`` pieces of each length n from 1 to ``capacity``."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    rank, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    within = largest_within(left)
    while (top := int(within[capacity])) > 0:
        gap, uses = capacity, {}
        while top:
            uses[top] = min(int(left[top]), gap // top)
            gap -= uses[top] * top
            top = int(within[min(gap, top - 1)])
        need = dict(uses)
        while gap:
            shortest = min(n for n, k in uses.items() if k)
            rest = left.copy()
            for n, k in uses.items():
                rest[n] -= k
            a, b = best_pair(rest, gap + shortest)
            if a + b <= shortest:
                break
            gap += shortest - a - b
            uses[shortest] -= 1
            for n in (a, b):
                uses[n] = uses.get(n, 0) + 1
                need[n] = max(need.get(n, 0), uses[n])
        uses = {n: uses[n] for n in sorted(uses, reverse=True) if uses[n]}
        # the choices above stay the same while every length has what they need of it
        times = min((int(left[n]) - need[n]) // k + 1 for n, k in uses.items())
        offset = 0
        for n, k in uses.items():
            runs.append((n, rank[n], k, sequence, offset))
            rank[n] += k * times
            left[n] -= k * times
            offset += n * k
        sequence += times
        within = largest_within(left)
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Patterns(*table.T.copy(), sequences=sequence)


def task_counts(pieces: DataFrame) -> DataFrame:
    """task, length, n, and before: how many pieces of the length earlier tasks have."""
    each = pieces.where("counts IS NOT NULL").select("task", F.explode("counts").alias("c")).select("task", "c.length", "c.n")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def length_counts(pieces: DataFrame, capacity: int) -> np.ndarray:
    """Pieces of each length; at most ``capacity`` rows reach the driver."""
    each = pieces.where("counts IS NOT NULL").select(F.explode("counts").alias("c"))
    rows = each.groupBy(F.col("c.length").alias("length")).agg(F.sum("c.n").alias("n")).toPandas()
    out = np.zeros(capacity + 1, np.int64)
    out[rows["length"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def place(pieces: DataFrame, patterns: Patterns, *carry) -> DataFrame:
    """length, sequence_id, offset of every piece, with the columns to ``carry``."""
    rows = pieces.where("ids IS NOT NULL").select("task", "length", "nth", *carry)
    offsets = task_counts(pieces).select("task", "length", "before")
    ranked = rows.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("task", "nth", "before")
    shared = pieces.sparkSession.sparkContext.broadcast(patterns)  # five numbers a run; their number is bounded by the capacity

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            sequence, offset = shared.value.places(length, rank) if len(rank) else (rank, rank)
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    names = [f for f in ranked.schema.fields if f.name != "rank"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    return ranked.mapInArrow(look_up, f"{kinds}, sequence_id long, offset long")


def sequences(pieces: DataFrame, patterns: Patterns, key: str = "doc_id") -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian, 32 bits each), documents (key, piece, offset): the packed sequences.

    A group is one sequence, so no more than ``capacity`` ids.
    """
    parts = place(pieces, patterns, key, "piece", "ids")
    own = F.array_sort(F.collect_list(F.struct("offset", F.col(key), "piece", "length", "ids"))).alias("own")
    joined = F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    members = F.transform("own", lambda x: F.struct(x[key].alias(key), x["piece"].alias("piece"), x["offset"].alias("offset")))
    return parts.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), own).select("sequence_id", "n_tokens", joined.alias("ids"), members.alias("documents"))


def pack(docs: DataFrame, path: str, end: int, capacity: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Patterns]:
    """The stored pieces of all documents and the patterns that place them."""
    pieces = stored(cut_documents(docs, path, end, capacity, key, text), "pieces")
    return pieces, best_two_fit(length_counts(pieces, capacity), capacity)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, patterns = pack(documents(spark, sf_dir), WORD_BPE, 1, 4096)
    found = place(pieces, patterns, "doc_id", "piece", "start", F.crc32("ids").alias("ids_crc32"))
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
