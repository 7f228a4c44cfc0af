"""Token-id output: canonical length-limited Huffman coding of token ids.

1.  Every whole text is encoded; the ids are kept as a Parquet table, and beside
    them, in a last row of each task, how often each id occurs in the task.
2.  These counts, of all documents, are added up (a shuffle by id of what is in
    that one column; the ids are not read again), and the driver, which gets at most one row
    for each id of the vocabulary, finds code lengths of at most ``max_bits`` by
    package-merge and assigns canonical codes.
3.  The rows are dealt by ranges of the key, with a hash of the ids as a tie
    break so that one key cannot fill a task, and each task writes one file: a
    run of independent blocks of whole documents.  A block holds its bits, the
    bit offset of every ``STEP``-th id as a checkpoint, and its documents' keys
    and lengths.
4.  Reading decodes all checkpoints of many blocks in lock step with one table
    of 2^max_bits entries.

Defined cases: a null or empty text has the end id alone; a null key sorts
first; repeated rows are written as often as they occur; an empty table gives an
empty file table; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored, whole_text
from tessera.llm.encoding import WORD_BPE, id_width, piece_encoder

STEP = 512  # ids between two checkpoints
BLOCK = 1 << 16  # ids of a block at least, unless the file ends


def limited_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Code lengths of at most ``max_bits`` with the least total, by package-merge; 0 for a count of 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    packages, levels = leaves[:0], []
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, found = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        found[:k] += 1
        take = 2 * (take - k)
    lengths[used] = found
    return lengths


@dataclass
class Code:
    """A canonical code: shorter codes first, ascending ids within a length."""

    lengths: np.ndarray

    def __post_init__(self):
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        sizes = self.lengths[order].astype(np.int64)
        self.bits = int(sizes.max(initial=1))
        spans = 1 << (self.bits - sizes)
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (starts >> (self.bits - sizes)).astype(np.uint64)
        self.symbols = np.zeros(1 << self.bits, np.uint32)
        self.symbols[: spans.sum()] = np.repeat(order, spans)
        self.steps = np.ones(1 << self.bits, np.int64)
        self.steps[: spans.sum()] = np.repeat(sizes, spans)


def pack(ids: np.ndarray, code: Code) -> tuple[bytes, bytes]:
    """The bits of the ids in big-endian words, and the checkpoints' bit offsets (u64)."""
    sizes = code.lengths[ids].astype(np.int64)
    if len(ids) and not sizes.all():
        raise ValueError("an id without a code")
    ends = np.cumsum(sizes)
    at = ends - sizes
    word, value = at >> 5, code.codes[ids] << (64 - sizes - (at & 31)).astype(np.uint64)
    n = int(ends[-1] // 32 + 2) if len(ids) else 2
    # within a word the bits of different ids do not overlap, so sums are exact unions
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    return words.astype(">u4").tobytes(), at[::STEP].astype("<u8").tobytes()


def unpack(parts: list[tuple[bytes, bytes, int]], code: Code) -> np.ndarray:
    """The ids of blocks (bits, checkpoints, number of ids), one after the other."""
    words = np.frombuffer(b"".join(x[0] for x in parts) + b"\0" * 8, ">u4").astype(np.uint64)
    lanes, counts, base = [], [], 0
    for bits, checkpoints, n in parts:
        lanes.append(np.frombuffer(checkpoints, "<u8").astype(np.int64) + base * 8)
        counts.append(np.minimum(STEP, n - STEP * np.arange(len(lanes[-1]))))
        base += len(bits)
    at, left = np.concatenate(lanes), np.concatenate(counts)
    out = np.zeros((STEP, len(at)), np.uint32)
    shift = np.uint64(64 - code.bits)
    last = len(words) - 2
    wide = words[:-1] << np.uint64(32) | words[1:]
    table = code.symbols.astype(np.int64) << 8 | code.steps  # one look at a table gives both
    for i in range(int(left.max(initial=0))):
        w = np.minimum(at >> 5, last)
        found = table[wide[w] << (at & 31).view(np.uint64) >> shift]
        out[i] = found >> 8
        at += found & 255
    return out.T[np.arange(STEP)[None, :] < left[:, None]]


def encode_documents(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (little-endian, as narrow as the vocabulary allows) with the end id appended; counts is null.

    The last row of each task has no ids but ``counts``: the task's occurrences
    of every id that it met.
    """
    width = id_width(path)
    tail = int(end).to_bytes(width, "little")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = piece_encoder(path, width)
        total = np.zeros(1 << 16 if width == 2 else 1 << 18, np.int64)
        for batch in batches:
            ids = [x + tail for x in encoder.encode(list(batch["t"]))]
            total += np.bincount(np.frombuffer(b"".join(ids), f"<u{width}"), minlength=len(total))
            yield pd.DataFrame({key: batch[key], "ids": ids, "counts": None})
        used = np.flatnonzero(total)
        yield pd.DataFrame({key: pd.Series([None], dtype="Int64"), "ids": [None], "counts": [[{"id": int(i), "n": int(n)} for i, n in zip(used, total[used], strict=True)]]})

    return docs.select(F.col(key).cast("long"), whole_text(text).alias("t")).mapInPandas(encode, f"{key} long, ids binary, counts array<struct<id:long,n:long>>")


def global_counts(tokens: DataFrame, width: int) -> np.ndarray:
    """Occurrences of every id over all documents; one row an id reaches the driver."""
    each = tokens.where("counts is not null").select(F.explode("counts").alias("c"))
    rows = each.groupBy(F.col("c.id").alias("id")).agg(F.sum("c.n").alias("n")).toPandas()
    out = np.zeros(1 << 16 if width == 2 else 1 << 18, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


FILE_SCHEMA = "file int, block int, first long, n_ids long, keys array<long>, lengths array<long>, bits binary, checkpoints binary"


def write_files(tokens: DataFrame, lengths: np.ndarray, width: int, key: str = "doc_id") -> DataFrame:
    """The blocks of all files, in ascending key order from file to file."""
    coded = tokens.sparkSession.sparkContext.broadcast(lengths)  # one byte an id of the vocabulary

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, file = Code(coded.value), TaskContext.get().partitionId()
        block = first = 0
        keys: list = []
        parts: list[bytes] = []

        def flush() -> pd.DataFrame:
            nonlocal block, first, keys, parts
            ids = np.frombuffer(b"".join(parts), f"<u{width}")
            bits, checkpoints = pack(ids, code)
            row = pd.DataFrame([(file, block, first, len(ids), keys, [len(x) // width for x in parts], bits, checkpoints)], columns=["file", "block", "first", "n_ids", "keys", "lengths", "bits", "checkpoints"])
            block, first, keys, parts = block + 1, first + len(ids), [], []
            return row

        size = 0
        for batch in batches:
            for k, ids in zip(batch[key], batch["ids"], strict=True):
                keys.append(None if pd.isna(k) else int(k))
                parts.append(ids)
                size += len(ids)
                if size >= BLOCK * width:
                    yield flush()
                    size = 0
        if parts:
            yield flush()

    dealt = tokens.where("ids is not null").withColumn("tie", F.xxhash64("ids")).repartitionByRange(key, "tie").sortWithinPartitions(key, "tie")
    return dealt.select(key, "ids").mapInPandas(write, FILE_SCHEMA)


def read_files(files: DataFrame, lengths: np.ndarray, key: str = "doc_id", group: int = 1 << 21) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the decoded blocks."""
    spark = files.sparkSession
    coded = spark.sparkContext.broadcast(lengths)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(coded.value)
        for batch in batches:
            rows = list(batch.itertuples(index=False))
            while rows:
                some, n = [], 0
                while rows and (not some or n + rows[0].n_ids <= group):
                    some.append(rows.pop(0))
                    n += some[-1].n_ids
                ids = unpack([(x.bits, x.checkpoints, x.n_ids) for x in some], code).astype("<u4").tobytes()
                at = 0
                for x in some:
                    out, start = [], x.first
                    for k, size in zip(x.keys, x.lengths, strict=True):
                        out.append((x.file, k, start, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at, start = at + int(size), start + int(size)
                    found = pd.DataFrame(out, columns=["file", key, "in_file", "n_tokens", "ids_crc32"])
                    found[key] = found[key].astype("Int64")
                    yield found

    # one row a file, that is, a task of the writing job
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    found = files.mapInPandas(read, f"file int, {key} long, in_file long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "file").select(key, (F.col("offset") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end: int, max_bits: int = 16) -> tuple[DataFrame, np.ndarray]:
    """Encode, count, code and write; the stored file table and the code lengths."""
    width = id_width(path)
    tokens = stored(encode_documents(docs, path, end), "token-ids")
    lengths = limited_lengths(global_counts(tokens, width), max_bits)
    return stored(write_files(tokens, lengths, width), "token-files"), lengths


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(*token_files(documents(spark, sf_dir), WORD_BPE, 1))
