"""Near-duplicate documents by consistent weighted sampling.

1.  Document frequencies, exact for every shingle (five words), over all
    documents.  Of heavy ones, in one ``HEAVY``-th of the texts or more: the texts
    with each of ``2**DF_BITS`` cells of hashed shingles are counted, and the shingles
    of cells of so many exactly in a second pass; there are at most ``HEAVY`` times
    the mean number of shingles of a text of them, which is broadcast.  Of all
    others: runs of texts (portions) ask each of ``RANGES`` ranges of hashes for
    the frequencies of their shingles in it; a group is one range, and the answers
    go back to their portion.  The idf falls with the logarithm of the frequency, to
    1 in every text.
2.  Signatures: improved consistent weighted sampling (Ioffe) of the weights
    tf x idf.  Sample k takes from each text the shingle with the least
    ``ln c - r (t - beta) - r``, ``t = floor(ln w / r + beta)``, with r, c ~ Gamma(2, 1)
    and beta ~ U(0, 1) drawn from a hash of shingle and k; two texts give the same
    (shingle, t) with the probability of their weighted Jaccard similarity.
3.  Bands of ``ROWS`` samples: equal texts are one node, and the nodes with an
    equal band are a bucket.  Each is compared with one leader of its bucket, the
    node whose bands most others share: of a group of copies that is the text
    nearest to all, the same one in all buckets.  Pairs grow with the nodes.
4.  The rest, exactly.  Nodes of buckets that hold more than one component of the
    links found so far are open.  Any two open nodes that are similar share a
    shingle of both their prefixes, and no pair of other components is left out:
    only shingles met in two components can link, a text's shingles are ordered
    from the rarest among open nodes on, and its prefix ends where what follows
    weighs less than ``similarity`` of the text.  Texts that only share a passage
    have no prefix at all, so a passage in a third of all rows makes no pairs.
    A pair is made if the weights that both share with others, and those from their
    first common shingle on, allow the similarity.  The best node of each component
    goes first, the nodes of components that this has not joined follow.
5.  Verification: the exact weighted Jaccard similarity of the two texts'
    shingles must be ``similarity`` or more.  The members of a leader are dealt in
    salted groups of at most ``GROUP``, each with its own copy of the leader.
6.  Connected components of the verified links are the classes.

With 24 bands of 2 samples a single pair at exactly 0.8 always shares a band, one at
0.4 with probability 0.985.  ``op10_near_dedup`` and the pipeline take ``NEAR``, 0.4:
shingles of five words are that alike if one word in ten was replaced, and in a group of many
copies what they share weighs less than their edits, which are rare.  What the steps keep in between (32-bit shingles of one text
in each portion of its equals, beside the signatures) lies in buckets by portion and
is shuffled for nodes in shared buckets alone; texts are not shuffled.

Defined cases: null counts as empty; equal texts, empty ones too, are one
class; a text without words is near no other text; repeated rows are each
reported; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, documents, lean, stored, stored_by, whole_text
from tessera.llm.components import components
from tessera.llm.shingles import mix, multisets, portions

BANDS, ROWS = 24, 2
#: The similarity of near copies; whole documents that share no more than passages are less alike.
NEAR = 0.4
DF_BITS, HEAVY, IDF_SPAN = 16, 64, 0.5
#: Characters of a portion; ranges of hashes, each of which one task holds at once (1/2048 of the shingles met in a portion).
PORTION, RANGES = 1 << 22, 1 << 11
GROUP = 512
#: What float32 sums of weights may be off by.
SLACK = 1e-5


def _gamma2_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 64.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


R = _gamma2_quantiles(1 << 12).astype(np.float32)
INV_R = (1 / _gamma2_quantiles(1 << 12)).astype(np.float32)
LN_C = np.log(_gamma2_quantiles(1 << 14)).astype(np.float32)


@dataclass
class Idf:
    """The heavy shingles in ascending order, and what they weigh; all others by their frequency in ``texts``.

    Without their frequencies they weigh 1 + ``IDF_SPAN``, what a shingle weighs that is just not heavy.
    """

    heavy: np.ndarray
    value: np.ndarray
    texts: int = 0

    def of(self, hashes: np.ndarray, df: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(hashes), 1 + IDF_SPAN, np.float32)
        if df is not None:
            out = (1 + IDF_SPAN * np.log(np.maximum(self.texts / np.maximum(df, 1), 1)) / np.log(HEAVY)).astype(np.float32)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, hashes), len(self.heavy) - 1)
            known = self.heavy[at] == hashes
            out[known] = self.value[at[known]]
        return out


def weights(hashes: np.ndarray, tf: np.ndarray, idf: Idf, df: np.ndarray | None = None) -> np.ndarray:
    return tf.astype(np.float32) * idf.of(hashes, df)


def stored_weights(data: bytes, df: bytes, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a stored text and their weights."""
    hashes, tf = np.unique(np.frombuffer(data, "<u4"), return_counts=True)
    return hashes, weights(hashes, tf, idf, np.frombuffer(df, "<u4"))


def signatures(hashes: np.ndarray, w: np.ndarray, counts: np.ndarray, samples: int, part: int = 1 << 16) -> np.ndarray:
    """(texts, samples) 32-bit samples; rows of texts without shingles are 0."""
    out = np.zeros((len(counts), samples), np.uint32)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts[full])
    i = 0
    while i < len(full):  # runs of texts of about ``part`` shingles, to stay in the cache
        begin = ends[i] - counts[full[i]]
        j = max(i + 1, int(np.searchsorted(ends, begin + part, "right")))
        h, ln_w = mix(hashes[begin : ends[j - 1]].astype(np.uint64)), np.log(w[begin : ends[j - 1]])
        starts = ends[i:j] - counts[full[i:j]] - begin
        for k in range(samples):
            x = h * np.uint64(2 * k + 0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(30)
            r, inv = R[(x & np.uint64(0xFFF)).astype(np.intp)], INV_R[(x & np.uint64(0xFFF)).astype(np.intp)]
            beta = (x >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(ln_w * inv + beta)
            ln_a = LN_C[((x >> np.uint64(12)) & np.uint64(0x3FFF)).astype(np.intp)] - r * (t - beta) - r
            # positive floats order like their bits; the low half says which (shingle, t) it was
            order = (ln_a + np.float32(128)).view(np.uint32).astype(np.uint64) << np.uint64(32)
            order |= (x >> np.uint64(16)) * np.uint64(0x9E3779B1) + t.astype(np.int64).astype(np.uint64) * np.uint64(0x85EBCA77) & np.uint64(0xFFFFFFFF)
            out[full[i:j], k] = np.minimum.reduceat(order, starts) & np.uint64(0xFFFFFFFF)
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    sig = sig.reshape(len(sig), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(sig.shape[1], dtype=np.uint64), sig.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
    return key.view(np.int64)


def planes(numbers: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """32-bit numbers, each run between two cuts by itself: all lowest bytes, then all second ones and so on.

    High bytes are mostly 0, which Spark's compression of shuffles then takes away.
    """
    data = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4)
    return [data[a:b].T.tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def document_frequencies(rows: DataFrame) -> Idf:
    """The heavy shingles of all rows (t), by exact frequencies; ``light_frequencies`` has those of the others."""
    size = 1 << DF_BITS
    cell_of = np.uint32(size - 1)

    def count_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            texts = list(batch["t"])
            n += len(texts)
            for some in portions(texts):
                hashes, _, counts = multisets(texts[some])
                cell = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << DF_BITS) | (hashes & cell_of)
                cell.sort()
                once = cell[np.concatenate([[True], cell[1:] != cell[:-1]])] if len(cell) else cell
                total += np.bincount(once & (size - 1), minlength=size)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"cell": np.append(used, -1), "n": np.append(total[used], n)})

    cells = rows.select("t").mapInPandas(lean(count_cells), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    texts = int(cells.loc[cells["cell"] < 0, "n"].sum())
    least = max(2, -(-texts // HEAVY))
    full = np.zeros(size, bool)
    full[cells.loc[(cells["cell"] >= 0) & (cells["n"] >= least), "cell"].to_numpy(np.int64)] = True
    if not full.any():
        return Idf(np.zeros(0, np.uint32), np.zeros(0, np.float32), texts)

    def count_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["t"])
            for some in portions(texts, 1 << 20):
                hashes, _, _ = multisets(texts[some])
                own, n = np.unique(hashes[full[hashes & cell_of]], return_counts=True)
                yield pd.DataFrame({"shingle": own.astype(np.int64), "n": n})

    df = rows.select("t").mapInPandas(lean(count_shingles), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    df = df.where(F.col("n") >= least).toPandas().sort_values("shingle")  # at most HEAVY x the mean number of shingles of a text
    share = np.log(np.maximum(texts / df["n"].to_numpy(np.float64), 1.0)) / np.log(HEAVY)
    return Idf(df["shingle"].to_numpy(np.uint32), (1 + IDF_SPAN * np.minimum(share, 1)).astype(np.float32), texts)


def shingled(named: DataFrame, key: str) -> DataFrame:
    """One row for each portion of the rows (key, t, node): portion, keys, nodes, counts, hashes, tf.

    The distinct hashes of every text and how often each occurs are 32-bit numbers, text after text.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, size, held = TaskContext.get().partitionId(), 0, 0, []

        def row() -> pd.DataFrame:
            nonlocal number, size, held
            keys, nodes, counts, hashes, tf = zip(*held, strict=True)
            out = {
                "portion": [task << 32 | number], "keys": [[x for k in keys for x in k]], "nodes": [[x for n in nodes for x in n]], "counts": [np.concatenate(counts)],
                "hashes": [np.concatenate(hashes).astype("<u4").tobytes()], "tf": [np.concatenate(tf).astype("<u4").tobytes()],
            }
            number, size, held = number + 1, 0, []
            return pd.DataFrame(out)

        for batch in batches:
            texts = list(batch["t"])
            for some in portions(texts, min(PORTION, 1 << 18)):
                hashes, tf, counts = multisets(texts[some])
                part = batch.iloc[some]
                held.append(([None if pd.isna(k) else int(k) for k in part[key]], list(part["node"]), counts, hashes, tf))
                size += sum(map(len, texts[some]))
                if size >= PORTION:
                    yield row()
        if held:
            yield row()

    schema = "portion long, keys array<long>, nodes array<binary>, counts array<int>, hashes binary, tf binary"
    return named.select(key, "t", "node").mapInPandas(lean(cut), schema)


def light_frequencies(table: DataFrame, idf) -> DataFrame:
    """portion, dfs: for each portion of ``shingled``, the number of rows that have each of its shingles that are not heavy.

    dfs holds (range, df) in order of the ranges: 32-bit numbers, one for each such shingle of the portion in ascending order.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for portion, data in zip(batch["portion"], batch["hashes"], strict=True):
                own, n = np.unique(np.frombuffer(data, "<u4"), return_counts=True)
                light = ~np.isin(own, idf.value.heavy, assume_unique=True)
                own, n = own[light], n[light].astype("<u4")
                used, starts = np.unique(own.astype(np.int64) * RANGES >> 32, return_index=True)
                gaps = np.diff(own, prepend=own[:1])
                gaps[starts] = own[starts]  # the first of a range is itself, the others are told by their distance
                cuts = np.append(starts, len(own))
                yield pd.DataFrame({"range": used, "portion": portion, "gaps": planes(gaps, cuts), "n": planes(n, cuts)})

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.cumsum(from_planes(x), dtype="<u4") for x in group["gaps"]])
        n = np.concatenate([from_planes(x) for x in group["n"]])
        _, of = np.unique(hashes, return_inverse=True)
        df = np.bincount(of, n).astype("<u4")[of]
        cuts = np.cumsum([0, *(len(x) // 4 for x in group["gaps"])])
        return pd.DataFrame({"portion": group["portion"], "range": group["range"], "df": [df[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    asked = table.select("portion", "hashes").mapInPandas(lean(ask), "range int, portion long, gaps binary, n binary")
    told = asked.groupBy("range").applyInPandas(answer, "portion long, range int, df binary")
    return told.groupBy("portion").agg(F.array_sort(F.collect_list(F.struct("range", "df"))).alias("dfs"))


def similar_pairs(pairs: DataFrame, payload: DataFrame, idf, similarity: float) -> DataFrame:
    """The (leader, node) of ``pairs`` whose weighted Jaccard similarity is ``similarity`` or more, with it."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("salts"))
    members = pairs.withColumn("salt_key", F.xxhash64("node")).join(sizes, "leader").select("leader", F.pmod("salt_key", "salts").cast("int").alias("salt"), "node", F.lit(1).alias("part"))
    leaders = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("node"), F.lit(0).alias("part"))
    rows = members.unionByName(leaders).join(payload, "node").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "part")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = own_w = own_sum = group = None
        for batch in batches:
            found = []
            for leader, salt, node, part, data, df in zip(batch["leader"], batch["salt"], batch["node"], batch["part"], batch["hashes"], batch["df"], strict=True):
                hashes, w = stored_weights(data, df, idf.value)
                if part == 0:
                    group, own, own_w, own_sum = (leader, salt), hashes, w, float(w.sum())
                    continue
                assert group == (leader, salt), "a group without its leader"
                at = np.minimum(np.searchsorted(own, hashes), max(len(own) - 1, 0))
                same = own[at] == hashes if len(own) else np.zeros(len(hashes), bool)
                shared = float(np.minimum(own_w[at[same]], w[same]).sum())
                total = own_sum + float(w.sum()) - shared
                if total > 0 and shared / total >= similarity - 1e-7:
                    found.append((leader, node, shared / total))
            yield pd.DataFrame(found, columns=["leader", "node", "similarity"])

    return rows.select("leader", "salt", "node", "part", "hashes", "df").mapInPandas(lean(verify), "leader binary, node binary, similarity double")


def open_links(open_nodes: DataFrame, payload: DataFrame, idf, similarity: float) -> DataFrame:
    """(a, b): similar pairs that join all open nodes (node, component) which any similar pair would join.

    First each shingle's best node of every component is compared with those of the others, so two
    large components meet in a few pairs; what is then still apart is compared in full.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, c, data, df in zip(batch["node"], batch["c"], batch["hashes"], batch["df"], strict=True):
                hashes, w = stored_weights(data, df, idf.value)
                yield pd.DataFrame({"node": node, "c": c, "shingle": hashes.view(np.int32), "w": w, "total": float(w.sum(dtype=np.float64))})

    # a component is told by a 64-bit hash: only whether all holders of one shingle are of one component matters
    held = open_nodes.select("node", F.xxhash64("component").alias("c")).join(payload, "node")
    held = held.mapInPandas(lean(_gathered(spread)), "node binary, c long, shingle int, w float, total double")
    held = stored(held, "open-shingles")
    live = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("shingle", "n")
    own = Window.partitionBy("node")  # the shingles of one text
    rest = own.orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.join(live, "shingle").withColumns({"rest": F.sum(F.col("w").cast("double")).over(rest), "shared": F.sum(F.col("w").cast("double")).over(own)})
    prefix = ranked.where(F.col("rest") >= (similarity - SLACK) * F.col("total")).select("shingle", "node", "c", "rest", "shared", "total")
    prefix = stored(prefix, "prefixes")
    best = F.max_by(F.struct("node", "rest", "shared", "total"), F.struct(F.col("rest") / F.col("total"), "node"))
    first = stored(_candidates(prefix.groupBy("shingle", "c").agg(best.alias("r")).select("shingle", "c", "r.*"), similarity), "first-pairs")
    found = stored(similar_pairs(first.select("leader", "node"), payload, idf, similarity).join(first, ["leader", "node"]).select("leader", "node", "ca", "cb"), "first-links")
    merged = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("node", "c")
    apart = prefix.join(merged, "c", "left").withColumn("c", F.coalesce("component", "c"))
    second = stored(_candidates(apart, similarity).select("leader", "node").join(first, ["leader", "node"], "left_anti"), "second-pairs")
    more = similar_pairs(second, payload, idf, similarity).select("leader", "node")
    links = stored(found.select("leader", "node").unionByName(more).toDF("a", "b"), "links")
    discard(held, prefix, first, found, second)
    return links


def _candidates(prefix: DataFrame, similarity: float) -> DataFrame:
    """leader, node, ca, cb of the pairs of different components whose weights allow the similarity.

    The first shingle that two texts share bounds what they share by the weights from it on, so a
    pair of which no match passes that bound cannot be similar.
    """
    a, b = prefix.alias("a"), prefix.alias("b")
    least = lambda c: F.least(f"a.{c}", f"b.{c}")
    needed = (similarity / (1 + similarity) - SLACK) * (F.col("a.total") + F.col("b.total"))
    sized = least("total") >= (similarity - SLACK) * F.greatest("a.total", "b.total")
    pairs = a.join(b, F.expr("a.shingle = b.shingle AND a.node < b.node AND a.c <> b.c") & (least("shared") >= needed) & sized & (least("rest") >= needed))
    return pairs.select(F.col("a.node").alias("leader"), F.col("b.node").alias("node"), F.col("a.c").alias("ca"), F.col("b.c").alias("cb")).distinct()


def _gathered(run, rows: int = 200_000):
    """``run`` with its frames put together to about ``rows`` rows."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in run(batches):
            held.append(frame)
            n += len(frame)
            if n >= rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return gather


def near_links(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key and node, the MD5 of the text, of every row; node and component of all nodes with links)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias(key), whole_text(text).alias("t"))
    idf = spark.sparkContext.broadcast(document_frequencies(rows))
    named = rows.withColumn("node", F.unhex(F.md5(F.encode("t", "UTF-8"))))

    table = stored_by(shingled(named, key), "shingled", "portion")
    answered = table.join(light_frequencies(table, idf), "portion", "left")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                hashes, tf = np.frombuffer(row.hashes, "<u4"), np.frombuffer(row.tf, "<u4")
                counts = np.array(row.counts, np.int64)
                df = np.zeros(len(hashes), "<u4")
                light = np.flatnonzero(~np.isin(hashes, idf.value.heavy))
                if len(light):
                    _, of = np.unique(hashes[light], return_inverse=True)
                    df[light] = np.frombuffer(b"".join(x["df"] for x in row.dfs), "<u4")[of]
                keys = band_keys(signatures(hashes, weights(hashes, tf, idf.value, df), counts, BANDS * ROWS))
                held, dfs, seen, at = [], [], set(), 0
                for node, n in zip(row.nodes, counts.tolist(), strict=True):
                    new = n > 0 and node not in seen
                    held.append(np.repeat(hashes[at : at + n], tf[at : at + n]).tobytes() if new else None)
                    dfs.append(df[at : at + n].tobytes() if new else None)
                    seen.add(node)
                    at += n
                bands = [k if c else k[:0] for k, c in zip(keys, counts, strict=True)]
                yield pd.DataFrame({key: pd.array(row.keys, "Int64"), "node": row.nodes, "bands": bands, "portion": row.portion, "hashes": held, "df": dfs})

    schema = f"{key} long, node binary, bands array<long>, portion long, hashes binary, df binary"
    signed = stored_by(answered.select("portion", "keys", "nodes", "counts", "hashes", "tf", "dfs").mapInPandas(lean(sign), schema), "signatures", "portion")
    discard(table)
    members = signed.where("hashes is not null").select("node", F.explode("bands").alias("band")).distinct()
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(members.join(shared, "band"), "buckets")
    central = buckets.withColumn("centre", F.sum("n").over(Window.partitionBy("node")))  # the bands of one text
    leaders = central.groupBy("band").agg(F.max(F.struct("centre", "node"))["node"].alias("leader"))
    pairs = stored(buckets.join(leaders, "band").where("node <> leader").select("leader", "node").distinct(), "pairs")

    own = signed.where("hashes is not null").select("node", "portion", "hashes", "df")
    holders = own.select("node", "portion").join(buckets, "node", "left_semi").groupBy("node").agg(F.min("portion").alias("p")).select(F.col("node").alias("wanted"), F.col("p").alias("portion"))

    def chosen(texts: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:  # of one portion
        names = set(wanted["wanted"])  # not isin, to which bytes that end in zeros are shorter ones
        return texts.loc[[x in names for x in texts["node"]], ["node", "hashes", "df"]]

    # texts lie in buckets by portion, so of these groups only the names are shuffled
    payload = own.groupBy("portion").cogroup(holders.groupBy("portion")).applyInPandas(chosen, "node binary, hashes binary, df binary")
    payload = stored(payload, "shingles")
    links = stored(similar_pairs(pairs, payload, idf, similarity).select(F.col("leader").alias("a"), F.col("node").alias("b")), "links")

    of = components(links)
    told = buckets.select("band", "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    code = F.xxhash64("component")
    open_ = told.groupBy("band").agg(F.min(code).alias("low"), F.max(code).alias("high")).where("low <> high")
    open_nodes = stored(told.join(open_, "band", "left_semi").select("node", "component").distinct(), "open-nodes")
    more_links = open_links(open_nodes, payload, idf, similarity)
    if not more_links.isEmpty():
        of = components(links.unionByName(more_links))
    discard(buckets, pairs, payload, open_nodes)
    return signed.select(key, "node"), of


def near_classes(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, node, class_id (the least key of the class), class_size (rows of the class) of every row."""
    rows, of = near_links(docs, similarity, key, text)
    named = rows.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = named.groupBy("component").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(classes, "component").select(key, "node", "class_id", "class_size")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, one row (of the least key, nulls last) for each class.

    Of rows with equal key and text, that whose JSON form is least stays.
    """
    rows, of = near_links(docs, similarity, key, text)
    named = rows.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("node")))
    keep = stored(named.groupBy("component").agg(first.alias("r")).select(F.coalesce(F.col("r.k").cast("string"), F.lit("null")).alias("k"), "r.node"), "kept")
    marked = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long").cast("string"), F.lit("null")).alias("k"), F.unhex(F.md5(F.encode(whole_text(text), "UTF-8"))).alias("node"))
    return marked.join(keep, ["k", "node"], "left_semi").groupBy("k", "node").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir), NEAR).select("doc_id", "class_id", "class_size")
