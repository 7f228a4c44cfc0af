"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

The index holds the test items; every passage of every training document is a
query.  An item's word weighs its BM25 impact divided by the item's own
threshold, so that an item is retrieved if the weights of its words in the
passage sum to 1 or more.  The threshold is the most that an item can lose and
still have ``similarity`` of its five-word shingles (each lost shingle costs it
one word at most, so it is the item's own score less its heaviest words, one for each shingle that may be missing): no leak
that the verification would accept is lost in retrieval.

Passages are windows of 2 L words every L words, L the length of the longest
item.  For all windows of a batch the block-max bounds (the sums of the largest
weights in each block of items) come first, in numpy; only windows with a block
that may reach 1 run block-max WAND, with cursors, pivots and skipping by
block.  What it retrieves is verified: ``similarity`` of the shingles of the whole
item must be in the window.  How many of those of its question (they begin
before the last sentence) and of its answer (the rest, and so many before them
that they are ``SHINGLE`` at least) are there is evidence, and decides nothing.

The items are the bounded, stated query set.  Their size is checked: up to
``slice_chars`` characters make one broadcast index, larger sets are searched
in several slices, with the document frequencies of all items.  Documents are
never shuffled.

Defined cases: null and empty texts leak nothing; items of fewer than five
words cannot be verified and match nothing; equal items are each reported;
repeated documents are each reported; an empty benchmark leaves all documents
clean; extra columns are not read by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
SHINGLE = 5
K1, B = 1.2, 0.75  # the usual BM25 parameters


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


class Item:
    """A test item: its words, and its shingles as question and answer."""

    def __init__(self, item_id: int, text: str):
        self.id, self.words = item_id, words_of(text)
        all_ = shingles(self.words)
        last = len(words_of(SENTENCE.split(text.strip())[-1]))
        cut = max(0, min(len(self.words) - last, len(all_) - 1))
        # one changed word may be in all shingles of a short last sentence, so it is told with what comes before
        context = max(0, min(cut, len(all_) - SHINGLE))
        self.all, self.question, self.answer = set(all_), set(all_[:cut]) or set(all_), set(all_[context:])


def share(part: set, of: set) -> float:
    return len(part & of) / len(part) if part else 0.0


class Index:
    """Impacts of the items' words, with the largest of each block of items."""

    def __init__(self, items: list[Item], df: dict[str, int], n: int, mean: float, similarity: float, block: int = 8):
        self.items = items = sorted((x for x in items if x.all), key=lambda x: (len(x.words), x.id))
        self.block, self.span = block, max([len(x.words) for x in items], default=SHINGLE)
        self.terms = {w: i for i, w in enumerate(sorted({w for x in items for w in x.words}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, item in enumerate(items):
            tf = Counter(item.words)
            norm = K1 * (1 - B + B * len(item.words) / mean)
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in tf.items()}
            missing = len(item.all) - math.ceil(similarity * len(item.all) - 1e-9)
            kept = sorted(impact.values())[: max(1, len(impact) - missing)]
            least = sum(kept) * (1 - 1e-9)
            for w, x in impact.items():
                postings[self.terms[w]].append((i, x / least))
        self.blocks = -(-len(items) // block)
        self.lists = [([i for i, _ in p], [x for _, x in p]) for p in postings]
        self.most = [max(x) for _, x in self.lists]
        self.block_most = np.zeros((len(self.terms), max(1, self.blocks)), np.float32)
        for t, p in enumerate(postings):
            for i, x in p:
                self.block_most[t, i // block] = max(self.block_most[t, i // block], x * (1 + 1e-6))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items of a score of 1 or more for these (distinct) words."""
        cursors = [[*self.lists[t], 0, self.most[t], self.block_most[t]] for t in terms]
        found = []

        def forward(c: list, item: int) -> None:
            while c[2] < len(c[0]) and c[0][c[2]] < item:
                c[2] += 1

        while True:
            cursors = sorted((c for c in cursors if c[2] < len(c[0])), key=lambda c: c[0][c[2]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[3]
                if total >= 1:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0][cursors[pivot][2]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][2]] == item:
                pivot += 1
            at = item // self.block
            if sum(float(c[4][at]) for c in cursors[: pivot + 1]) < 1:
                # no item up to the end of this block, or to where another word joins, can reach 1
                until = (at + 1) * self.block
                if pivot + 1 < len(cursors):
                    until = min(until, cursors[pivot + 1][0][cursors[pivot + 1][2]])
                for c in cursors[: pivot + 1]:
                    forward(c, until)
            elif cursors[0][0][cursors[0][2]] == item:
                score = sum(c[1][c[2]] for c in cursors[: pivot + 1])
                if score >= 1:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    c[2] += 1
            else:
                for c in cursors[:pivot]:
                    forward(c, item)

    def candidates(self, texts: list[list[str]]) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word, distinct words' ids) of the windows with a block whose bound reaches 1."""
        get, span = self.terms.get, self.span
        found = [[-1 if (i := get(w)) is None else i for w in x] for x in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        windows = np.maximum(1, -(-sizes // span))
        base = np.cumsum(windows) - windows
        term = np.array([i for x in found for i in x], np.int64)
        text = np.repeat(np.arange(len(found)), sizes)
        place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = term >= 0
        term, text, place = term[known], text[known], place[known]
        if not len(term):
            return
        key = text * len(self.terms) + term
        order = np.argsort(key, kind="stable")
        before = np.full(len(term), -1, np.int64)
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:][same]] = place[order[:-1][same]]
        window = place // span
        here = before < window * span  # the first of its word in the window that begins in this stretch
        earlier = (window > 0) & (before < (window - 1) * span)  # and in the one before
        n = int(windows.sum())
        reach = np.zeros(n, bool)
        for at in range(0, self.block_most.shape[1], 32):
            bound = np.zeros((n, min(32, self.block_most.shape[1] - at)), np.float64)
            for some, back in ((here, 0), (earlier, 1)):
                w = (base[text] + window - back)[some]
                if len(w):
                    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                    bound[w[first]] += np.add.reduceat(self.block_most[term[some], at : at + 32], first, axis=0, dtype=np.float64)
            reach |= (bound >= 1).any(axis=1)
        owner = np.repeat(np.arange(len(found)), windows)
        for w in np.flatnonzero(reach).tolist():
            d = int(owner[w])
            start = (w - int(base[d])) * span
            yield d, start, list(dict.fromkeys(i for i in found[d][start : start + 2 * span] if i >= 0))

    def leaks(self, texts: list[list[str]], similarity: float) -> Iterator[tuple[int, int, int, float, float, float, float]]:
        """(text, item id, first word of the window, score, overlap of all, of the question, of the answer)."""
        best: dict[tuple[int, int], tuple] = {}
        for d, start, terms in self.candidates(texts):
            if hits := self.retrieve(terms):
                there = set(shingles(texts[d][start : start + 2 * self.span]))
                for i, score in hits:
                    item = self.items[i]
                    got = (share(item.all, there), share(item.question, there), share(item.answer, there))
                    if got[0] >= similarity and got > best.get((d, i), ((),))[0]:
                        best[d, i] = (got, start, score)
        for (d, i), (got, start, score) in best.items():
            yield (d, self.items[i].id, start, score, *got)


def build_indexes(benchmark: DataFrame, similarity: float, slice_chars: int, key: str, text: str) -> list[Index]:
    """One index for each slice of the items, under statistics of all items."""
    items = benchmark.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(chars / slice_chars))
    part = F.pmod(F.xxhash64("id", "t"), F.lit(n))
    df: Counter = Counter()
    count = total = 0
    slices = []
    for i in range(n):  # each slice is bounded by slice_chars, up to the unevenness of the hash
        own = [Item(r["id"], r["t"]) for r in items.where(part == i).orderBy("id", "t").collect()]
        for x in own:
            df.update(set(x.words))
            count, total = count + 1, total + len(x.words)
        slices.append(own)
    return [Index(x, df, count, max(1.0, total / max(1, count)), similarity) for x in slices]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, slice_chars: int = 4_000_000,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """key, item, start_word, score, overlap, question_overlap, answer_overlap: every leaked item of every document."""
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("t")).where("t is not null")
    schema = f"{key} long, {item} long, start_word int, score double, overlap double, question_overlap double, answer_overlap double"
    out = None
    for index in build_indexes(benchmark, similarity, slice_chars, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = list(shared.value.leaks([words_of(t) for t in batch["t"]], similarity))
                keys = batch[key].iloc[[x[0] for x in found]].reset_index(drop=True)
                yield pd.concat([keys, pd.DataFrame([x[1:] for x in found], columns=[item, "start_word", "score", "overlap", "question_overlap", "answer_overlap"])], axis=1)

        part = rows.mapInPandas(lean(search), schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, slice_chars: int = 4_000_000,
    text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The documents, all columns, without those that hold a test item."""
    for index in build_indexes(benchmark, similarity, slice_chars, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                texts = [words_of(t) if t else [] for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                keep = np.ones(len(texts), bool)
                keep[[x[0] for x in shared.value.leaks(texts, similarity)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(clean), docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
