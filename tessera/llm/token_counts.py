"""Token counts of flat token files without an index, by a separator scan.

A flat file is nothing but ids, document after document, each ended by the
separator, cut into blocks without regard to documents.  A task finds the
separators of each block at once with numpy; what a block does not know, where
its first document began, follows from a prefix scan over the blocks of the
file: the running number of ids before a block, and the last separator in any
earlier block.  Only one small row a block is shuffled, never the ids.

The separator cannot stand for anything else in a file, as texts are encoded
with the special tokens' strings as ordinary text.  Each block carries the keys
of the documents that end in it (a manifest of keys, without places or
lengths), matched to its separators in order.

Defined cases: a null or empty text counts 0; a null key is kept; repeated rows
are counted each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored, whole_text
from tessera.llm.encoding import WORD_BPE, id_width, piece_encoder

BLOCK = 1 << 17  # ids in a block

SEPARATOR = 49407  # <|endoftext|> of the word_bpe_49k vocabulary


def flat_files(docs: DataFrame, path: str, separator: int, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """file, block, payload, keys: one flat file for each task, cut every ``block`` ids."""
    width = id_width(path)
    tail, size = int(separator).to_bytes(width, "little"), block * width

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, file, number = piece_encoder(path, width, True), TaskContext.get().partitionId(), 0
        held, done, keys = bytearray(), 0, []  # keys: (end of the document in the file, key)

        def cut(n: int) -> pd.DataFrame:
            nonlocal number, done, keys, held
            own = [k for end, k in keys if end <= done + n]
            row = pd.DataFrame([(file, number, bytes(held[:n]), own)], columns=["file", "block", "payload", "keys"])
            keys, number, done = keys[len(own) :], number + 1, done + n
            del held[:n]
            return row

        for batch in batches:
            for k, ids in zip(batch[key], encoder.encode(list(batch["t"])), strict=True):
                held += ids
                held += tail
                keys.append((done + len(held), None if pd.isna(k) else int(k)))
                while len(held) >= size:
                    yield cut(size)
        if held:
            yield cut(len(held))

    rows = docs.select(F.col(key).cast("long"), whole_text(text).alias("t"))
    return rows.mapInPandas(write, "file int, block int, payload binary, keys array<long>")


def scan_blocks(files: DataFrame, separator: int, width: int) -> DataFrame:
    """file, block, n_ids, ends (places of the separators), keys: a small row a block."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.frombuffer(x, f"<u{width}") for x in batch["payload"]]
            ends = [np.flatnonzero(x == separator) for x in ids]
            yield batch[["file", "block", "keys"]].assign(n_ids=[len(x) for x in ids], ends=ends)[["file", "block", "n_ids", "ends", "keys"]]

    return files.mapInPandas(scan, "file int, block int, n_ids long, ends array<long>, keys array<long>")


def count_tokens(files: DataFrame, separator: int, width: int, key: str = "doc_id") -> DataFrame:
    """key, file, start, n_tokens (without the separator) of every document in the files."""
    run = Window.partitionBy("file").orderBy("block")
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    blocks = scan_blocks(files, separator, width)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("last", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
    blocks = blocks.withColumn("carry", F.coalesce(F.last("last", ignorenulls=True).over(earlier), F.lit(-1)))
    ends = F.transform("ends", lambda x: x + F.col("base"))
    starts = F.transform(F.concat(F.array("carry"), ends), lambda x: x + 1)
    docs = blocks.select("file", F.explode(F.arrays_zip(F.col("keys"), ends.alias("end"), F.slice(starts, F.lit(1), F.size("ends")).alias("start"))).alias("d"))
    return docs.select(F.col("d.keys").alias(key), "file", F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(flat_files(documents(spark, sf_dir), WORD_BPE, SEPARATOR), "flat-tokens")
    return count_tokens(files, SEPARATOR, id_width(WORD_BPE))
