"""Substring dedup: every byte in a string of ``length`` bytes that also starts elsewhere.

The suffixes of the whole corpus (cut to ``length`` bytes; those nearer to the end of
their document have no such string) are sorted in buckets, so that equal ones
come to lie together, without ever shuffling one row a suffix:

1.  Buckets.  In every string of ``length`` bytes the ``gram``-byte string of the
    least hash is its anchor.  Equal strings have equal anchors at equal
    offsets, so a bucket is named by its anchor's hash.  Suffixes that share one
    anchor place form a run, kept as one row: bucket, hash of the bytes that the run
    covers, document, first suffix, number of suffixes.
2.  Pre-aggregation.  Buckets with one run are dropped by partial sums before the
    shuffle.  Runs whose covered bytes are equal in whole are repeated in whole,
    and stand for one in what follows; a hot passage so adds a handful of rows.
3.  Deep-shallow sorting.  Only runs that share an anchor but not all bytes are
    sorted: their bytes are fetched, and each task sorts the suffixes of its
    buckets by multikey quicksort to a shallow depth (a symbol is eight bytes,
    all buckets of a batch advance together).  Groups still undecided go into
    blind tries, which keep only the place where their strings branch, found from
    the common prefix with the group's first, and look at one symbol there.
    Leaves with more than one suffix are repeated strings.
4.  Buckets of more than ``hot`` different runs, too large for one task, are
    dealt out by suffix: a 128-bit hash for each, counted with partial sums.
5.  A document's removed ranges, in bytes, are merged and cut from it.

A row is named by a 64-bit hash of key and text in between (n rows make about
n^2 / 2^65 clashes), and covered bytes are compared by bucket, length, offset and a second hash,
128 bits in all.  Documents are shuffled once.

Defined cases: null counts as empty; texts shorter than ``length`` bytes lose
nothing; equal rows are copies of each other; periodic texts match
themselves; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored, whole_text
from tessera.llm.shingles import mix

LENGTH, GRAM = 200, 48
#: Symbols (of eight bytes) that quicksort looks at before tries take over.
SHALLOW = 2
#: Different runs in a bucket that one task sorts; suffixes that it sorts at a time.
HOT, BATCH = 4096, 500_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64; kept, and doubled as needed."""
    if len(_tables.get(base, ())) < n:
        table = np.full(1 << max(20, (n - 1).bit_length()), base, np.uint64)
        table[0] = 1
        _tables[base] = np.multiply.accumulate(table)
    return _tables[base][:n]


class Hashed:
    """Texts end to end, with the hash of any range in constant time."""

    def __init__(self, data: list[bytes]):
        self.raw = np.frombuffer(b"".join(data), np.uint8)
        self.sizes = np.array([len(x) for x in data], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(self.raw)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * powers(_INVERSE, len(self.raw) + 1)[start]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from prefix and suffix minima of blocks."""
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def runs(data: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all runs: text, first suffix (in its text), number of suffixes, anchor (in its text), bucket, hash of the covered bytes."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = Hashed(data)
    n = len(h.raw)
    if n < length:
        return none
    place = np.arange(n - gram + 1)
    grams = mix(h.of(place, place + gram))
    least = sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64), length - gram + 1)
    start = np.arange(len(least))
    start = start[np.repeat(h.ends, h.sizes)[: len(least)] - start >= length]
    if not len(start):
        return none
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, count, anchor = start[new], np.diff(np.append(new, len(start))), anchor[new]
    shape = (anchor - first).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)
    covered = mix(h.of(first, first + count - 1 + length) ^ mix(shape))
    text = np.searchsorted(h.ends, first, "right")
    base = (h.ends - h.sizes)[text]
    return text, first - base, count, anchor - base, grams[anchor], covered


def _regroup(group: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: their group's number by all keys given, and whether it has other rows."""
    new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in (group, *more)])])
    number = np.cumsum(new) - 1
    return number, np.bincount(number)[number] > 1


def repeated_suffixes(raw: bytes, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each start equals that at another start of its group.

    Multikey quicksort to SHALLOW symbols, then blind tries.
    """
    if length < 8:
        raise ValueError("length must be 8 or more")
    out = np.zeros(len(start), bool)
    if not len(start):
        return out
    word = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    symbols = np.minimum(8 * np.arange(-(-length // 8)), length - 8)
    who = np.argsort(group, kind="stable")
    group, many = _regroup(group[who])
    who, group = who[many], group[many]
    for at in symbols[:SHALLOW]:
        if not len(who):
            return out
        value = word[start[who] + at].astype(np.uint64)
        order = np.lexsort((value, group))
        who, group, value = who[order], group[order], value[order]
        group, many = _regroup(group, value)
        who, group = who[many], group[many]
    depth = np.full(len(who), min(SHALLOW, len(symbols)))
    while len(who):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        leader = np.repeat(start[who[first]], np.diff(np.append(first, len(who))))
        # symbols in common with the first of the group
        common, live = depth.copy(), np.flatnonzero(depth < len(symbols))
        while len(live):
            at = symbols[common[live]]
            live = live[word[start[who[live]] + at] == word[leader[live] + at]]
            common[live] += 1
            live = live[common[live] < len(symbols)]
        branch = np.repeat(np.minimum.reduceat(common, first), np.diff(np.append(first, len(who))))
        equal = branch == len(symbols)
        out[who[equal]] = True
        who, group, branch = who[~equal], group[~equal], branch[~equal]
        if not len(who):
            break
        value = word[start[who] + symbols[branch]].astype(np.uint64)  # the one symbol that a blind trie looks at
        order = np.lexsort((value, group))
        who, group, value, branch = who[order], group[order], value[order], branch[order]
        group, many = _regroup(group, value)
        who, group, depth = who[many], group[many], branch[many] + 1
    return out


def ranges(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of flagged places, in order: owner, first, last."""
    owner, place = owner[flags], place[flags]
    if not len(owner):
        return owner, place, place
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)])
    at = np.flatnonzero(new)
    return owner[at], place[at], place[np.append(at[1:], len(owner)) - 1]


def portions(data: list[bytes], size: int = 400_000) -> Iterator[slice]:
    start = n = 0
    for i, x in enumerate(data):
        n += len(x)
        if n >= size:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(data):
        yield slice(start, len(data))


RUN = "bucket long, covered long, id long, first int, suffixes int, anchor int"


def all_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, ids = [t.encode() for t in batch["t"]], batch["id"].to_numpy()
            for some in portions(data):
                text, first, count, anchor, bucket, covered = runs(data[some], length, gram)
                yield pd.DataFrame({"bucket": bucket.view(np.int64), "covered": covered.view(np.int64), "id": ids[some][text], "first": first, "suffixes": count, "anchor": anchor})

    return rows.select("id", "t").mapInPandas(find, RUN)


def sort_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """id, start, last: stretches of repeated suffixes of the runs that occur once; contexts come with their bytes."""
    dealt = contexts.repartition("bucket").sortWithinPartitions("bucket")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        data = rows["bytes"].tolist()
        base = np.cumsum([0, *map(len, data[:-1])])
        count = rows["suffixes"].to_numpy(np.int64)
        owner = np.repeat(np.arange(len(rows)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        offset = (rows["anchor"] - rows["first"]).to_numpy(np.int64)[owner] - step
        bucket = np.cumsum(np.concatenate([[0], rows["bucket"].to_numpy()[1:] != rows["bucket"].to_numpy()[:-1]]))
        flags = repeated_suffixes(b"".join(data), base[owner] + step, bucket[owner] * (length + 1) + offset, length)
        flags &= (rows["n"].to_numpy() == 1)[owner]
        who, a, b = ranges(flags, owner, step)
        first = rows["first"].to_numpy(np.int64)[who]
        return pd.DataFrame({"id": rows["id"].to_numpy()[who], "start": first + a, "last": first + b})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(batch["suffixes"].sum())
            if size >= BATCH:
                rows = pd.concat(held, ignore_index=True)
                open_ = (rows["bucket"] == rows["bucket"].iloc[-1]).to_numpy()  # this bucket may go on
                if not open_.all():
                    yield solve(rows[~open_])
                held = [rows[open_]]
                size = int(held[0]["suffixes"].sum())
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(run, "id long, start int, last int")


def hash_suffixes(contexts: DataFrame, length: int) -> DataFrame:
    """id, start, last of the repeated suffixes of hot buckets: one hash row a suffix, counted."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, i, first, n, times, data in zip(batch["bucket"], batch["id"], batch["first"], batch["suffixes"], batch["n"], batch["bytes"], strict=True):
                h = Hashed([data])
                at = np.arange(n)
                a = h.of(at, at + length)
                b = np.array([int.from_bytes(hashlib.blake2b(data[k : k + length], digest_size=8).digest(), "little", signed=True) for k in range(n)], np.int64)
                yield pd.DataFrame({"h1": mix(a ^ np.uint64(bucket & (2**64 - 1))).view(np.int64), "h2": b, "id": i, "start": first + at, "once": times == 1})

    rows = contexts.mapInPandas(each, "h1 long, h2 long, id long, start int, once boolean")
    twice = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h1", "h2")
    return rows.where("once").join(twice, ["h1", "h2"]).select("id", "start", F.col("start").alias("last"))


def repeated_ranges(rows: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """id, ranges (array of start and end in bytes; unordered, overlapping) of the rows (id, t) with repeated strings."""
    found = all_runs(rows, length, gram)
    shared = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("covered").alias("low"), F.max("covered").alias("high"))
    # stored, so that the join below has a shuffle of its own whose hot buckets Spark can split
    shared = stored(shared.where("k > 1").select("bucket", (F.col("low") == F.col("high")).alias("same")), "shared-buckets")
    repeated = stored(found.join(shared, "bucket"), "runs")

    mixed = repeated.where("not same")
    distinct = mixed.groupBy("bucket", "covered").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "first", "suffixes", "anchor")).alias("r"))
    distinct = stored(distinct.select("bucket", "covered", "n", "r.*"), "distinct-runs")
    copies = distinct.where("n > 1").select("bucket", "covered")
    whole = repeated.where("same").select("id", "first", "suffixes").unionByName(mixed.join(copies, ["bucket", "covered"], "left_semi").select("id", "first", "suffixes"))
    whole = whole.select("id", F.col("first").alias("start"), (F.col("first") + F.col("suffixes") - 1).alias("last"))

    large = distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("bucket", F.lit(True).alias("hot"))
    wanted = distinct.join(large, "bucket", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = wanted.groupBy("id").agg(F.collect_list(F.struct("bucket", "n", "first", "suffixes", "anchor", "hot")).alias("asked"))  # at most the runs of one text

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t, some in zip(batch["id"], batch["t"], batch["asked"], strict=True):
                data = t.encode()
                out += [(x["bucket"], x["n"], i, x["first"], x["suffixes"], x["anchor"], x["hot"], data[x["first"] : x["first"] + x["suffixes"] - 1 + length]) for x in some]
            yield pd.DataFrame(out, columns=["bucket", "n", "id", "first", "suffixes", "anchor", "hot", "bytes"])

    contexts = rows.join(asked, "id").select("id", "t", "asked").mapInPandas(fetch, "bucket long, n long, id long, first int, suffixes int, anchor int, hot boolean, bytes binary")
    contexts = stored(contexts, "contexts").dropDuplicates(["bucket", "id", "first"])
    some = sort_buckets(contexts.where("not hot"), length).unionByName(hash_suffixes(contexts.where("hot"), length))
    parts = whole.unionByName(some).select("id", F.struct(F.col("start"), (F.col("last") + length).alias("end")).alias("range"))
    return parts.groupBy("id").agg(F.collect_set("range").alias("ranges"))


def merged(ranges_: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in ranges_):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans (array of start and end of the removed ranges, in bytes), kept (the remaining bytes)."""
    rows = docs.select(F.col(key).cast("long").alias(key), whole_text(text).alias("t"))
    rows = rows.withColumn("id", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null")), "t"))
    found = repeated_ranges(rows.select("id", "t"), length, gram, hot)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[] if x is None else merged(x) for x in batch["ranges"]]
            data = [t.encode() for t in batch["t"]]
            kept = [b"".join(x[a:b] for a, b in zip([0, *[e for _, e in s]], [*[a for a, _ in s], len(x)], strict=True)) for x, s in zip(data, spans, strict=True)]
            yield pd.DataFrame({key: batch[key].astype("Int64"), "n_bytes": [len(x) for x in data], "spans": [[{"start": a, "end": b} for a, b in s] for s in spans], "kept": kept})

    joined = rows.join(found, "id", "left").select(key, "t", "ranges")
    return joined.mapInPandas(cut, f"{key} long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return dedup_substrings(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
