"""Embedding whitening by hierarchical merging of singular value decompositions.

1.  Vectors without nulls or non-finite entries become integers; the fit list is
    each distinct one once (an aggregation whose tasks drop copies before the
    shuffle), stored.
2.  A task folds its vectors, some thousands at a time, into a summary: their
    number, sums, mean, and all singular values with right vectors of the
    centred rows.  Two summaries merge by stacking both (values times vectors)
    with one more row, sqrt(n m / (n + m)) times the difference of the means, and
    decomposing that again: nothing is truncated, so the result is that of all
    rows up to rounding.  Summaries merge in groups of ``FAN`` in as many steps
    as their number needs; the driver gets the last one, of dimensions squared.
3.  The covariance's eigenvalues are the squared singular values over n.  Every
    vector is centred in exact integers (n x - S) before it is multiplied.
    The covariance of the whitened fit list is added up over the tasks, and its
    distance from the identity is reported.

Defined cases: a null or empty vector, or one with a null or non-finite entry,
has no row, nor has one whose length is not that of most rows.  Repeated rows
each have theirs, and count once in the fit list.  A null id is kept.  A
component whose eigenvalue is zero (to rounding) has null in whitened and no
part in the identity error.  A deviation beyond a long is null.  An empty table
has no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.vectors import block, integers, usual_length, whole_entries

FAN = 8  # summaries merged in one task
FOLD = 4096  # rows decomposed at once
LONG = (1 << 63) - 1


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers where longs could overflow."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x.sum(axis=0) if most * max(len(x), 1) <= LONG else x.astype(object).sum(axis=0)


@dataclass
class Summary:
    """n rows, the exact sums of their columns, their mean less ``base``, and the singular values and vectors of the centred rows."""

    n: int
    sums: np.ndarray
    base: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(x: np.ndarray, base: np.ndarray) -> Summary:
        """``base``, a row of integers near the data, is taken off before anything is rounded."""
        y = (x.astype(object) - base).astype(float) if np.abs(x.astype(float)).max() > 1 << 61 else (x - base).astype(float)
        mean = y.mean(axis=0)
        _, values, vectors = np.linalg.svd(y - mean, full_matrices=False)
        return Summary(len(x), exact_sums(x).astype(object), base, mean, values, vectors)

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        mean = other.mean + (other.base - self.base).astype(float)
        apart = mean - self.mean
        correction = np.sqrt(self.n * other.n / n) * apart
        rows = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, correction])
        _, values, vectors = np.linalg.svd(rows, full_matrices=False)
        return Summary(n, self.sums + other.sums, self.base, self.mean + apart * (other.n / n), values, vectors)

    SCHEMA = "id long, n long, sums array<decimal(38,0)>, base array<long>, mean array<double>, values array<double>, vectors array<double>"
    ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("base", pa.list_(pa.int64())), *((f, pa.list_(pa.float64())) for f in ("mean", "values", "vectors"))])

    def row(self, at: int) -> dict:
        return {"id": at, "n": self.n, "sums": [int(s) for s in self.sums], "base": self.base.astype(np.int64), "mean": self.mean, "values": self.values, "vectors": self.vectors.ravel()}

    @staticmethod
    def read(row: dict) -> Summary:
        mean = np.array(row["mean"], float)
        return Summary(row["n"], np.array([int(s) for s in row["sums"]], object), np.array(row["base"], np.int64), mean, np.array(row["values"], float), np.array(row["vectors"], float).reshape(-1, len(mean)))


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=Summary.ARROW)


def summarise(vectors: DataFrame, width: int) -> DataFrame:
    """One summary a task of the column ``x``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            x = block(batch.column("x"), width)
            for at in range(0, len(x), FOLD):
                part = Summary.of(x[at : at + FOLD], found.base if found else x[0])
                found = found.merge(part) if found else part
        if found:
            yield batch_of([found.row(TaskContext.get().partitionId())])

    return vectors.select("x").mapInArrow(fold, Summary.SCHEMA)


def merged(summaries: DataFrame) -> Summary | None:
    """All summaries as one; each step has a task for every ``FAN`` of the step before."""

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        found = Summary.read(rows[0])
        for r in rows[1:]:
            found = found.merge(Summary.read(r))
        return pa.Table.from_batches([batch_of([found.row(rows[0]["id"] // FAN)])])

    most = summaries.agg(F.max("id")).first()[0]
    while most:
        summaries = summaries.groupBy(F.floor(F.col("id") / FAN).alias("group")).applyInArrow(join, Summary.SCHEMA)
        most //= FAN
    last = summaries.collect() if most is not None else []
    return Summary.read(last[0].asDict()) if last else None


@dataclass
class Whitening:
    """The first components of a summary: ``weights`` takes centred rows to whitened ones; ``explained`` is each one's share."""

    n: int
    sums: np.ndarray
    weights: np.ndarray
    explained: np.ndarray
    small: bool = field(init=False)

    def __post_init__(self):
        self.small = self.n * max((abs(int(s)) for s in self.sums), default=0) <= 1 << 60

    @staticmethod
    def of(summary: Summary, components: int) -> Whitening:
        width, k = len(summary.mean), min(components, len(summary.mean))
        values = np.zeros(width)
        values[: len(summary.values)] = summary.values
        vectors = np.zeros((width, width))
        vectors[: len(summary.values)] = summary.vectors
        eigen = values * values / summary.n
        there = values > values.max(initial=0) * width * np.finfo(float).eps
        scale = np.divide(1.0, np.sqrt(eigen), out=np.full(width, np.nan), where=there)
        total = eigen.sum()
        return Whitening(summary.n, summary.sums, (vectors * scale[:, None])[:k].T.copy(), (eigen / total if total else eigen)[:k])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.small and max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n <= 1 << 60:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def whiten(self, x: np.ndarray) -> tuple[list, np.ndarray]:
        """The deviation of each row (None beyond a long) and its whitened components."""
        c = self.centred(x)
        most = max(abs(int(c.max(initial=0))), abs(int(c.min(initial=0))))
        wide = c if most * most * c.shape[1] <= LONG else c.astype(object)
        deviation = [int(d) if d <= LONG else None for d in (wide * wide).sum(axis=1)]
        return deviation, (c / self.n).astype(float) @ self.weights


def identity_error(fit: DataFrame, model: Whitening, width: int) -> float:
    """The largest distance of an entry of the whitened fit list's covariance from the identity."""
    there = np.flatnonzero(np.isfinite(model.weights).all(axis=0))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(there), len(there)))
        for batch in batches:
            for at in range(0, len(batch), FOLD):
                w = model.whiten(block(batch.column("x"), width)[at : at + FOLD])[1][:, there]
                total += w.T @ w  # the rows are centred by the exact means
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "total"])

    sums = fit.select("x").mapInArrow(add, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).toPandas()
    covariance = np.zeros(len(there) ** 2)
    covariance[sums["at"].to_numpy(np.int64)] = sums["total"].to_numpy(float) / model.n
    return float(np.abs(covariance.reshape(len(there), -1) - np.eye(len(there))).max(initial=0.0)) if len(there) else 0.0


def fit_whitening(rows: DataFrame, width: int, components: int) -> tuple[Whitening | None, float]:
    """The model of the distinct vectors ``x`` of ``rows``, all of ``width`` entries, and its identity error."""
    fit = stored(rows.select("x").distinct(), "fit-list")
    summary = merged(stored(summarise(fit, width), "summaries"))
    if summary is None:
        return None, 0.0
    model = Whitening.of(summary, components)
    return model, identity_error(fit, model, width)


def apply_whitening(rows: DataFrame, model: Whitening, width: int) -> DataFrame:
    """id, deviation, whitened (an array, null for components without variance) of every row."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), FOLD):
                part = batch.slice(at, FOLD)
                deviation, w = model.whiten(block(part.column("x"), width))
                flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(deviation, pa.int64()), pa.FixedSizeListArray.from_arrays(flat, w.shape[1]).cast(pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(project, "id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, key: str, vector: str, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, Whitening | None, float]:
    """id, deviation, whitened of all whole vectors, the model, and its identity error."""
    rows = vectors.where(whole_entries(vector)).select(F.col(key).cast("long").alias("id"), integers(vector, scale, shift).alias("x"))
    width = usual_length(rows, "x")
    rows = rows.where(F.size("x") == width)
    model, error = fit_whitening(rows, width, components) if width else (None, 0.0)
    if model is None:
        return rows.select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None, error
    return apply_whitening(rows, model, width), model, error


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    rows = found.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(x)) for x in (model.explained if model else [0.0])])
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
