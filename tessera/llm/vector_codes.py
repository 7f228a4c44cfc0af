"""Vector code compression: codebooks by filtering Lloyd rounds over kd-trees.

1.  Vectors without nulls or non-finite entries become integers, floor(1024 x),
    and are cut into equal parts.  Each task gathers ``BLOCK`` vectors at a time
    and builds a kd-tree over each part position: the parts in the order of the
    tree's leaves, and for each node its bounding box, count and sum.  The trees
    are written once as a table and read in every round.
2.  A round walks each tree from the root, a level at a time.  For a node, the
    entry nearest to the middle of its box is taken, and every entry that is
    farther from the whole box (or as far and of a higher index) is eliminated:
    that difference is linear, so its greatest value is at a corner of the box.
    A node with one entry left gives its cached count and sum to it without
    being opened; a leaf compares its parts with the entries left.
3.  Counts and sums by (part, entry) are added in the task, then in Spark; the
    driver gets one row an entry, forms the new codebooks and starts the next
    round.  After the last, trees are walked once more for codes and errors.

All arithmetic is on integers: in doubles while every product and sum stays
below 2^53, else in Python's own integers, so ties are exact.

Defined cases: a null or empty vector, or one with a null or non-finite entry,
has no row, nor has one whose length is not that of most rows.  Lengths that the
number of parts does not divide are filled up with zeros.  The first codebooks
are the rows of the least ids; of equal ids the least vector comes first, and a
null id comes last.  With fewer rows than entries there are only as many entries.
Repeated rows count as often as they occur.  An empty table has no rows.  An
error beyond a long is null.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.vectors import block, integers, usual_length, whole_entries

BLOCK = 8192  # vectors of a tree
LEAF = 32  # parts of a leaf at most
EXACT = 1 << 21  # integers up to this have exact squared distances in doubles


def exact(values: np.ndarray) -> np.ndarray:
    """The integers in a type that adds and multiplies them exactly."""
    return values.astype(np.float64) if not values.size or max(int(values.max()), -int(values.min())) <= EXACT else values.astype(object)


@dataclass
class Tree:
    """A kd-tree over the rows of ``points``, which stand in the order of its leaves; ``order`` has their former places.

    Node i covers rows start[i] to stop[i]; child[i] is its first child, the
    second comes next; a leaf's is 0.  The root is node 0.
    """

    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> Tree:
        order = np.arange(len(points))
        start, stop, child, low, high, total = [0], [len(points)], [], [], [], []
        for a, b in zip(start, stop, strict=False):  # grows meanwhile
            own = points[order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            total.append(exact(own).sum(axis=0))
            extent = high[-1] - low[-1]
            if b - a <= LEAF or not extent.any():
                child.append(0)
                continue
            child.append(len(start))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, int(np.argmax(extent))], middle)]
            start += [a, a + middle]
            stop += [a + middle, b]
        return Tree(order, points[order], *(np.array(x) for x in (start, stop, child, low, high, total)))

    FIELDS = ("order", "points", "start", "stop", "child", "low", "high", "total")
    SCHEMA = "order array<int>, points array<long>, start array<int>, stop array<int>, child array<int>, low array<long>, high array<long>, total array<decimal(38,0)>"

    def walk(self, book: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
        """(node, first row, end, entries) of nodes that are settled: one entry for all rows (an int array of one) or one for each."""
        book = exact(book)
        norms = (book * book).sum(axis=1)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        while len(nodes):
            low, high = exact(self.low[nodes]), exact(self.high[nodes])
            # the entry nearest to the middle of the box: |2m - 2z|^2 less what all entries share
            near = 4 * norms - 4 * ((low + high) @ book.T)
            near = np.where(alive, near, np.inf if near.dtype == np.float64 else near.max() + 1).argmin(axis=1)
            # an entry's greatest lead over it is |z*|^2 - |z|^2 + 2 max p(z - z*), each axis at the bound of the step's sign
            lead = np.empty(alive.shape, book.dtype)
            for z in np.unique(near):
                own, step = near == z, book - book[z]
                up, down = np.maximum(step, 0), np.minimum(step, 0)
                lead[own] = norms[z] - norms + 2 * (high[own] @ up.T + low[own] @ down.T)
            index = np.arange(len(book))
            alive &= (lead > 0) | ((lead == 0) & (index < near[:, None]))
            alive[np.arange(len(nodes)), near] = True
            single, leaf = alive.sum(axis=1) == 1, self.child[nodes] == 0
            for i in np.flatnonzero(single | leaf):
                node, entries = int(nodes[i]), np.flatnonzero(alive[i])
                a, b = int(self.start[node]), int(self.stop[node])
                if len(entries) > 1:
                    far = norms[entries] - 2 * (exact(self.points[a:b]) @ book[entries].T)
                    yield node, a, b, entries[far.argmin(axis=1)]
                else:
                    yield node, a, b, entries
            opened = ~(single | leaf)
            first = self.child[nodes[opened]]
            nodes, alive = np.concatenate([first, first + 1]), np.concatenate([alive[opened]] * 2)

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the parts that are nearest to each entry."""
        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, object)
        for node, a, b, entries in self.walk(book):
            if len(entries) == 1:
                count[entries] += b - a
                total[entries] += self.total[node]
            else:
                for z in np.unique(entries):
                    own = self.points[a:b][entries == z]
                    count[z] += len(own)
                    total[z] += exact(own).sum(axis=0)
        return count, total

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry and the squared distance of each part, in their former places."""
        code = np.zeros(len(self.points), np.int64)
        for _, a, b, entries in self.walk(book):
            code[self.order[a:b]] = entries
        points = np.empty_like(self.points)
        points[self.order] = self.points
        apart = exact(points - book[code]) if max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)) <= EXACT else points.astype(object) - book[code].astype(object)
        return code, (apart * apart).sum(axis=1)


def plant_trees(rows: DataFrame, parts: int, width: int, size: int = BLOCK) -> DataFrame:
    """ids, labels and one tree a part position for each ``size`` vectors of a task; ``rows`` has id, label, v (integers)."""
    part = -(-width // parts)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def trees(table: pa.Table) -> pa.RecordBatch:
            v = block(table.column("v").combine_chunks(), width)
            v = np.pad(v, ((0, 0), (0, part * parts - width)))
            columns = {"ids": [table.column("id").to_pylist()], "labels": [table.column("label").to_pylist()], "trees": [[]]}
            for i in range(parts):
                tree = Tree.build(np.ascontiguousarray(v[:, i * part : (i + 1) * part]))
                columns["trees"][0].append({f: getattr(tree, f).ravel() if f != "total" else [int(x) for x in tree.total.ravel()] for f in Tree.FIELDS})
            return pa.RecordBatch.from_pydict(columns, schema=arrow)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= size:
                table = pa.Table.from_batches(held)
                while len(table) >= size:
                    yield trees(table.slice(0, size))
                    table = table.slice(size)
                held = table.to_batches()
        if any(map(len, held)):
            yield trees(pa.Table.from_batches(held))

    kinds = dict(order=pa.int32(), points=pa.int64(), start=pa.int32(), stop=pa.int32(), child=pa.int32(), low=pa.int64(), high=pa.int64(), total=pa.decimal128(38, 0))
    arrow = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("trees", pa.list_(pa.struct([(f, pa.list_(k)) for f, k in kinds.items()])))])
    return rows.select("id", "label", "v").mapInArrow(grow, f"ids array<long>, labels array<long>, trees array<struct<{', '.join(x.replace(' ', ':', 1) for x in Tree.SCHEMA.split(', '))}>>")


def read_trees(row: pa.StructScalar | pa.Array, part: int) -> list[Tree]:
    """The trees of one row of the table."""
    out = []
    for i in range(len(row)):
        x = {f: row.field(f)[i].values for f in Tree.FIELDS}
        flat = {f: x[f].to_numpy(zero_copy_only=False) for f in Tree.FIELDS if f != "total"}
        total = x["total"].cast(pa.int64()).to_numpy() if np.abs(flat["points"]).max(initial=0) <= EXACT else np.array([int(t) for t in x["total"].to_pylist()], object)
        out.append(Tree(flat["order"], flat["points"].reshape(-1, part), flat["start"], flat["stop"], flat["child"], flat["low"].reshape(-1, part), flat["high"].reshape(-1, part), total.reshape(-1, part)))
    return out


def lloyd_round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """New codebooks: each entry the floor of the mean of its parts; the driver gets one row an entry."""
    part = books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for row in batch.column("trees"):
                for i, tree in enumerate(read_trees(row.values, part)):
                    n, s = tree.sums(books[i])
                    count[i] += n
                    total[i] += s
        at = [(i, z) for i, n in enumerate(count) for z in np.flatnonzero(n)]
        sums = pa.array([[int(t) for t in total[i][z]] for i, z in at], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([int(z) for _, z in at], pa.int32()), pa.array([int(count[i][z]) for i, z in at], pa.int64()), sums], ["part", "entry", "n", "total"])

    each = trees.select("trees").mapInArrow(add, "part int, entry int, n long, total array<decimal(38,0)>")
    sums = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(part)]
    new = [b.copy() for b in books]
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        new[r["part"]][r["entry"]] = [int(r[f"t{j}"]) // r["n"] for j in range(part)]
    return new


def first_books(rows: DataFrame, parts: int, width: int, entries: int) -> list[np.ndarray]:
    """The parts of the ``entries`` rows of the least ids."""
    part = -(-width // parts)
    least = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    v = np.array([r["v"] for r in least], np.int64).reshape(-1, width)
    v = np.pad(v, ((0, 0), (0, part * parts - width)))
    return [np.ascontiguousarray(v[:, i * part : (i + 1) * part]) for i in range(parts)]


def fit_codebooks(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """The stored trees of ``rows`` (id, label, v of one length) and the codebooks after all rounds."""
    width = usual_length(rows, "v")
    if not width:
        return stored(plant_trees(rows, parts, parts), "trees"), [np.zeros((0, 1), np.int64)] * parts
    rows = rows.where(F.size("v") == width)
    books = first_books(rows, parts, width, entries)
    trees = stored(plant_trees(rows, parts, width), "trees")
    for _ in range(rounds):
        books = lloyd_round(trees, books)
    return trees, books


def assign(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """id, label, code (two hex digits a part), error of every vector of the trees."""
    part = books[0].shape[1]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.column("trees")):
                found = [tree.codes(b) for tree, b in zip(read_trees(row.values, part), books, strict=True)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                error = sum(e.astype(object) for _, e in found)
                error = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
                ids, labels = (pa.array(batch.column(n)[k].values) for n in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes]), error], ["id", "label", "code", "error"])

    return trees.mapInArrow(code, "id long, label long, code string, error long")


def books_text(books: list[np.ndarray]) -> str:
    """All components of all entries by part, entry and position."""
    return ",".join(str(int(x)) for b in books for x in b.ravel())


def compress(vectors: DataFrame, key: str, vector: str, label: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, code, error of all whole vectors, stored, and the codebooks, at most 256 entries each."""
    rows = vectors.where(whole_entries(vector)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), integers(vector, scale).alias("v"))
    trees, books = fit_codebooks(rows, parts, entries, rounds)
    return stored(assign(trees, books), "codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    # one row a label; where labels are too many to broadcast, Spark splits what a frequent label has in the join
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    rows = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
