"""Toxicity by weak supervision.

1.  Sample: at most ``max_rows`` labelled training documents (those of least
    hash; a documented bound for fitting alone).  The chosen ids are broadcast to
    fetch their texts; the other texts are not shuffled.  Of equal texts with the
    same label one stays; all other rows count, whatever passages they share.
2.  Voters: words, word stems (first 4 to 8 letters) and writing patterns
    are counted by label in the sample.  Those that speak for label 1 with a
    smoothed precision of ``precision`` or more, on ``support`` documents at least,
    vote 1; one more voter votes 0 where none of them does.
3.  Label model: class-conditional vote rates of all voters by expectation
    maximisation, starting from the rates under the given labels.  Voters whose votes are correlated within the
    class (nested stems, above all) form groups, and a group speaks with the mean
    of its voters' log odds, so that it is not counted many times.
4.  A logistic regression learns the posterior labels from the voters that are
    needed to reach the documents of label 1 or that speak often and are not
    part of a more general one, and from the patterns.  Its intercept is set so that the
    sample is split best at 0.5.  It alone scores, over every whole text, in one pass without a shuffle.

Only the text goes into a score.

Defined cases: null and empty texts get the score of no features at all; with
no labels, or of one class only, all scores are the share of label 1 (0 with
none); labels of unknown documents and repeated labels are harmless; repeated
documents get equal scores; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, stored, whole_text
from tessera.llm.encoding import Remembered

WORD = re.compile(r"[^\W\d_]+")
STRETCHED = re.compile(r"([^\W\d_])\1{4}")
STEMS = (4, 5, 6, 7, 8)


def features_of_word(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "*" for k in STEMS if len(word) >= k))


CAPITALS, SMALL = bytes(range(ord("A"), ord("Z") + 1)), bytes(range(ord("a"), ord("z") + 1))


def patterns(text: str) -> Iterator[str]:
    """Ways of writing, as features; capitals are counted among the letters A to Z."""
    data = text.encode()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    if capitals > len(data) - len(data.translate(None, SMALL)):
        yield "#capitals"
    if text.count("!") >= 3:
        yield "#exclaims"
    if text.count("?!") or text.count("!!"):
        yield "#stacked"
    if STRETCHED.search(text):
        yield "#stretched"


def features(text: str) -> set[str]:
    found = set(patterns(text))
    for word in set(WORD.findall(text.lower())):
        found.update(features_of_word(word))
    return found


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


@dataclass
class LabelModel:
    """Rates of each voter's 1 given the class, and the voters' groups."""

    rates: np.ndarray
    prior: float
    group: np.ndarray

    def posterior(self, votes: list[np.ndarray]) -> np.ndarray:
        n = int(self.group.max(initial=-1)) + 1
        odds = np.log(self.rates[1]) - np.log(self.rates[0])
        out = np.zeros(len(votes))
        for i, v in enumerate(votes):
            said = np.bincount(self.group[v], odds[v], n)
            count = np.bincount(self.group[v], minlength=n)
            out[i] = (said[count > 0] / count[count > 0]).sum()
        return 1 / (1 + np.exp(-np.clip(out + np.log(self.prior / (1 - self.prior)), -30, 30)))


def correlated_groups(votes: list[np.ndarray], n: int, p: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Voters joined where their votes correlate by ``least`` or more within either class."""
    matrix = np.zeros((len(votes), n), np.float32)
    for i, v in enumerate(votes):
        matrix[i, v] = 1
    group = np.arange(n)
    for w in (p, 1 - p):
        w = (w / max(w.sum(), 1e-9)).astype(np.float32)
        mean = w @ matrix
        joint = (matrix * w[:, None]).T @ matrix - np.outer(mean, mean)
        spread = np.sqrt(np.clip(np.diag(joint), 1e-9, None))
        for a, b in zip(*np.nonzero(np.triu(joint / np.outer(spread, spread), 1) >= least), strict=True):
            if min(mean[a], mean[b]) > 0 and group[a] != group[b]:
                group[group == group[b]] = group[a]
    return np.unique(group, return_inverse=True)[1]


def fit_label_model(votes: list[np.ndarray], n: int, start: np.ndarray, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    p = start.astype(float)
    flat, owner = np.concatenate([*votes, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(votes)), [len(v) for v in votes])
    prior = min(max(p.mean(), 1e-4), 1 - 1e-4)
    group = correlated_groups(votes, n, p)
    for _ in range(rounds):
        rates = np.stack([(np.bincount(flat, w[owner], n) + 0.5 * s) / (w.sum() + 1) for w, s in ((1 - p, 0.02), (p, 0.2))])
        model = LabelModel(rates, prior, group)
        q = model.posterior(votes)
        if np.abs(q - p).max(initial=0) < 1e-4:
            break
        p = q
    return model, model.posterior(votes)


def fit_logistic(rows: list[np.ndarray], target: np.ndarray, n: int, penalty: float = 1e-3, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent; both classes weigh the same."""
    flat, sizes = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    share = target.mean()
    weight = target / share + (1 - target) / (1 - share)
    weight /= weight.sum()
    w = seen = np.zeros(n + 1)
    step = 1 / (0.25 * (1 + sizes.max(initial=0)) + penalty)
    for k in range(rounds):
        ahead = seen + (k / (k + 3)) * (seen - w) if k else seen
        z = np.bincount(owner, ahead[flat], len(rows)) + ahead[n]
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad = np.append(np.bincount(flat, r[owner], n), r.sum())
        grad[:n] += penalty * ahead[:n]
        w, seen = seen, ahead - step * grad
    return seen[:n], float(seen[n])


@dataclass
class Scorer:
    """The linear classifier: a weight for each feature, and the intercept."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def start(self) -> None:
        self.known = Remembered(200_000)

    def _learn(self, new: set[str]) -> None:
        for word in new:
            self.known[word] = tuple(f for f in features_of_word(word) if f in self.weights)

    def scores(self, texts: list[str]) -> Iterable[float]:
        words = (WORD.findall(t.lower()) for t in texts)
        for text, found in zip(texts, self.known.look_up(words, self._learn), strict=True):
            active = {f for some in set(found) for f in some}
            active.update(f for f in patterns(text) if f in self.weights)
            z = self.bias + sum(self.weights[f] for f in sorted(active))
            yield float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, key: str, text: str, label: str) -> DataFrame:
    """(y, t) of at most ``max_rows`` training labels, stored."""
    train = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col(key).isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col(key)))
    train = train.groupBy(key).agg(F.max("y").alias("y")).orderBy(F.xxhash64(key), key).limit(max_rows)
    rows = docs.select(F.col(key), whole_text(text).alias("t")).join(F.broadcast(train), key).select(F.col("y"), "t")

    kept = rows.groupBy("y", F.sha2(F.encode("t", "UTF-8"), 256).alias("same")).agg(F.first("t").alias("t"))
    return stored(kept.select("y", "t").repartition(8), "labelled")


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Where to cut the sample's scores: most of label 1 above less three times the share of label 0; the middle of the gap."""
    at = np.unique(z)
    best, cut = -np.inf, 0.0
    for low, high in zip([at[0] - 2, *at[:-1]], at, strict=True):
        gain = (z[y == 1] >= high).mean() - 3 * (z[y == 0] >= high).mean()
        if gain > best + 1e-12:
            best, cut = gain, (low + high) / 2
    return float(cut)


def general(names: list[str], voters: np.ndarray) -> list[int]:
    """Voters that no shorter stem among the voters contains."""
    stems = {names[i].rstrip("*") for i in voters if names[i].endswith("*")}
    return [i for i in voters if not any(names[i][:k] in stems for k in STEMS if k < len(names[i].rstrip("*")) or (k == len(names[i]) and not names[i].endswith("*")))]


def cover(on: list[np.ndarray], y: np.ndarray, voters: np.ndarray, least: int) -> list[int]:
    """Voters that, one after the other, add most documents of label 1 not reached before; until one adds fewer than ``least``."""
    at = {int(v): j for j, v in enumerate(voters)}
    some = [x for x, label in zip(on, y, strict=True) if label == 1]
    there = np.zeros((len(some), len(voters)), bool)
    for i, x in enumerate(some):
        there[i, [at[j] for j in x.tolist() if j in at]] = True
    chosen = []
    while len(there) and (gain := there.sum(axis=0)).max(initial=0) >= least:
        chosen.append(int(voters[int(gain.argmax())]))
        there = there[~there[:, int(gain.argmax())]]
    return chosen


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, precision: float = 0.9, support: int = 6, max_voters: int = 400, max_features: int = 2_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    sample = labelled_sample(docs, labels, max_rows, key, text, label)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for y, t in zip(batch["y"], batch["t"], strict=True):
                counts[y].update(features(t))
                n[y] += 1
        counts[1][""], counts[0][""] = n[1], n[0]
        names = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"f": pd.Series(names, dtype=object), "n1": [counts[1][x] for x in names], "n0": [counts[0][x] for x in names]})

    counts = sample.mapInPandas(lean(count), "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    total = counts.where("f = ''").first()
    n1, n0 = (total["n1"], total["n0"]) if total else (0, 0)
    if not n1 or not n0:
        return Scorer() if not n1 else Scorer(bias=30.0)
    seen = F.col("n1") + F.col("n0")
    chance = n1 / (n1 + n0)
    evidence = (F.col("n1") - seen * chance) / F.sqrt(seen * chance * (1 - chance))  # standard deviations from chance
    kept = counts.where((F.col("f") != "") & (seen >= support)).withColumn("z", evidence).orderBy(F.desc(F.abs("z")), "f").limit(max_features).toPandas()
    names = kept["f"].tolist()
    index = {f: i for i, f in enumerate(names)}
    sure = (kept["n1"] + 0.5) / (kept["n1"] + kept["n0"] + 1) >= precision
    voters = kept.index[sure & (kept["n1"] >= support)].to_numpy()[:max_voters]
    place = {int(i): j for j, i in enumerate(voters)}

    def active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "on": [sorted(index[f] for f in features(t) if f in index) for t in batch["t"]]})

    rows = sample.mapInPandas(lean(active), "y int, on array<int>").toPandas()  # at most max_rows short lists
    on = [np.asarray(x, np.int64) for x in rows["on"]]
    y = rows["y"].to_numpy()
    votes = [np.array([place[i] for i in x.tolist() if i in place] or [len(place)], np.int64) for x in on]  # the last voter: none of the others
    _, posterior = fit_label_model(votes, len(place) + 1, y)
    often = max(support, int(0.01 * n1))
    used = set(cover(on, y, voters, least=2)) | {int(i) for i in general(names, voters) if kept["n1"][i] >= often}
    used = sorted(used | {i for i, f in enumerate(names) if f[0] == "#"})
    column = {i: j for j, i in enumerate(used)}
    w, bias = fit_logistic([np.array([column[i] for i in x.tolist() if i in column], np.int64) for x in on], posterior, len(used))
    z = np.array([bias + sum(w[column[i]] for i in x.tolist() if i in column) for x in on])
    return Scorer({names[i]: float(x) for i, x in zip(used, w, strict=True)}, bias - threshold(z, y))


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # at most max_features weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        model.start()
        for batch in batches:
            yield batch[[key, "held_out"]].assign(score=list(model.scores(list(batch["t"]))))

    rows = docs.select(F.col(key).cast("long").alias(key), held_out(F.col(key)).alias("held_out"), whole_text(text).alias("t"))
    return rows.mapInPandas(lean(run), f"{key} long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, without those that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        model.start()
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield batch.filter(pa.array([s < threshold for s in model.scores(texts)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
