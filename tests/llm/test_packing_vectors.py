"""Packing, whitening and vector codes, against plain loops over all rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, vector_codes, whitening
from tessera.llm.encoding import WORD_BPE
from tests.conftest import SF, SF_LARGER
from tests.llm.conftest import texts

VECTORS = "vec_id long, embedding array<float>, label int, id long, x int, v string, n long, code string, error long"


def plain_two_fit(lengths, capacity):
    """One sequence after the other, one piece after the other."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        for n in list(left):
            if n <= gap:
                own.append(n)
                left.remove(n)
                gap -= n
        while gap:
            room = gap + own[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room]
            if not pairs or max(pairs)[0] <= own[-1]:
                break
            _, a, b = max(pairs)
            left.append(own.pop())
            for n in (a, b):
                left.remove(n)
                own.append(n)
            left.sort(reverse=True)
            own.sort(reverse=True)
            gap = capacity - sum(own)
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_two_fit_is_that_of_a_plain_loop(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 20, 64, 200])
    lengths = [min(capacity, 1 + int(r.expovariate(1 / r.choice([3, 9, 30])))) for _ in range(r.choice([0, 1, 5, 90, 160]))]
    if seed % 3 == 0:
        lengths += [lengths[0]] * 60 if lengths else []
    want = plain_two_fit(lengths, capacity)
    counts = np.bincount(np.array(lengths, int), minlength=capacity + 1)
    got = packing.best_two_fit(counts, capacity)
    n = np.array(lengths, np.int64)
    rank = np.array([sum(m == k for m in lengths[:i]) for i, k in enumerate(lengths)], np.int64)
    sequence, offset = got.places(n, rank)
    bins = defaultdict(list)
    for s, o, k in zip(sequence, offset, n, strict=True):
        bins[s].append((int(o), int(k)))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))] and sum(k for _, k in own) <= capacity
    assert got.sequences == len(want) == len(bins) and set(bins) == set(range(len(bins)))
    assert sorted(sorted((k for _, k in own), reverse=True) for own in bins.values()) == sorted(want)


def encoded(rows):
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation(), t.no_padding()
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for i, x in rows]


def check_packing(rows, want, capacity):
    pieces = sorted((key is None, key or 0, i, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())) for key, ids in want for i, a in enumerate(range(0, len(ids), capacity)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    own = defaultdict(list)
    for r in rows:
        own[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in own.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= capacity
    assert len(own) == len(plain_two_fit([p[4] for p in pieces], capacity))
    return len(own)


@pytest.mark.parametrize("capacity", [50, 4096])
def test_packing_of_hostile_rows(spark, hostile, nothing, capacity):
    from pyspark.sql import functions as F

    pieces, patterns = packing.pack(hostile, WORD_BPE, 1, capacity)
    rows = packing.place(pieces, patterns, "doc_id", "piece", "start", F.crc32("ids").alias("ids_crc32")).collect()
    assert check_packing(rows, encoded(texts()), capacity) == patterns.sequences
    whole = packing.sequences(pieces, patterns).collect()
    assert len(whole) == patterns.sequences and all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * capacity for r in whole)
    assert sum(r["n_tokens"] for r in whole) == sum(len(ids) for _, ids in encoded(texts()))
    by_key = {k: ids for k, ids in encoded(texts())}
    at = {(r["doc_id"], r["piece"], r["sequence_id"]): (r["start"], r["length"]) for r in rows}
    for r in whole:
        for d in r["documents"]:
            start, n = at[d["doc_id"], d["piece"], r["sequence_id"]]
            assert r["ids"][4 * d["offset"] : 4 * (d["offset"] + n)] == by_key[d["doc_id"]][start : start + n].tobytes()
    pieces, patterns = packing.pack(nothing, WORD_BPE, 1, capacity)
    assert packing.place(pieces, patterns, "doc_id").count() == 0 and packing.sequences(pieces, patterns).count() == 0


def test_packing_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = packing.op11_packing(spark, SF)
    assert [f"{n} {t}" for n, t in found.dtypes] == ["doc_id bigint", "piece int", "start bigint", "length bigint", "ids_crc32 bigint", "sequence_id bigint", "offset bigint"]
    rows = found.collect()
    want = encoded(docs)
    assert check_packing(rows, want, 4096) <= math.ceil(sum(len(ids) for _, ids in want) / 4096) + 1


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2, "v", 3, "c", 4) for i, v, l in rows], VECTORS)


def hostile_vectors(width=8, n=700, large=False):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=width) * (0.3 if i % 3 else 0.01)).astype(float).tolist(), i % 4) for i in range(n)]
    rows += [(n + i, rows[3][1], None) for i in range(400)]  # a hot vector
    rows += [(3, rows[3][1], 3), (3, rows[4][1], 3), (None, rows[5][1], None), (None, rows[6][1], 1)]
    bad = rows[0][1]
    rows += [(5000, None, 1), (5001, [], 1), (5002, [None, *bad[1:]], 1), (5003, [float("nan"), *bad[1:]], 1), (5004, [*bad[1:], float("-inf")], 2), (5005, bad[:3], 2)]
    return rows + ([(6000, [1e6 * x for x in bad], 7), (6001, [3e30 * x for x in bad], 7)] if large else [])


def kept(rows, width):
    return [(i, v, l) for i, v, l in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]


def floors(v, scale, shift=0):
    return [max(-(1 << 62), min(1 << 62, math.floor(scale * float(np.float32(x))))) + shift for x in v]


def plain_whitening(rows, k=16):
    x = [(i, floors(v, 64, 1_000_000)) for i, v, _ in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), object)
    n, sums = len(fit), fit.sum(axis=0)
    c = np.array([[float(a) for a in r] for r in (n * fit - sums) / n])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    share = e / np.trace(c.T @ c / n)
    out = []
    for i, v in x:
        d = n * np.array(v, object) - sums
        out.append((i, n, int((d * d).sum()), (d / n).astype(float) @ u / np.sqrt(e), share))
    return out


def check_whitening(found, want):
    rows = defaultdict(list)
    for r in found:
        rows[r["vec_id"], r["deviation"]].append(r)
    own = defaultdict(list)
    for i, n, deviation, w, share in want:
        own[i, deviation if deviation < 1 << 63 else None].append((n, w, share))
    assert rows.keys() == own.keys()
    signs = None
    for key, mine in own.items():
        there = defaultdict(list)
        for r in rows[key]:
            there[r["component"]].append(r)
        n, w, share = mine[0]
        assert sorted(there) == list(range(1, len(w) + 1)) and all(len(x) == len(mine) for x in there.values())
        got = np.array([there[c][0]["whitened"] for c in sorted(there)])
        signs = np.sign(got * w) if signs is None else signs
        assert np.abs(got * signs - w).max() < 1e-8 * max(1, np.abs(w).max())
        assert all(r["n"] == n and abs(r["explained"] / share[c - 1] - 1) < 1e-9 for c, x in there.items() for r in x)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def exploded(found, model, error):
    from pyspark.sql import functions as F

    rows = found.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened")).collect()
    return [r.asDict() | {"component": r["at"] + 1, "n": model.n, "explained": model.explained[r["at"]], "identity_error": error} for r in rows]


def test_whitening_of_hostile_rows(spark):
    rows = hostile_vectors()
    table = vectors(spark, rows).repartition(7)  # several steps of merging
    check_whitening(exploded(*whitening.whiten(table, "vec_id", "embedding", 5)), plain_whitening(kept(rows, 8), 5))
    found, model, error = whitening.whiten(vectors(spark, []), "vec_id", "embedding")
    assert found.count() == 0 and model is None and error == 0.0


def test_whitening_without_variance(spark):
    """All the same in one entry, two entries always equal: those components are null, and the others still white."""
    r = np.random.default_rng(1)
    rows = [(i, [0.5, a, a, b], 0) for i, (a, b) in enumerate(r.normal(size=(90, 2)).tolist())]
    found, model, error = whitening.whiten(vectors(spark, rows), "vec_id", "embedding")
    assert error < 1e-9 and model.explained[2:].max() < 1e-12
    assert all(x["whitened"][2:] == [None, None] and None not in x["whitened"][:2] for x in found.collect())
    one = whitening.whiten(vectors(spark, rows[:1]), "vec_id", "embedding")[0].collect()
    assert [(x["id"], x["deviation"], x["whitened"]) for x in one] == [(0, 0, [None] * 4)]


def test_whitening_of_large_entries(spark):
    rows = hostile_vectors(large=True)
    found = whitening.whiten(vectors(spark, rows), "vec_id", "embedding", 2)[0].collect()
    want = {(i, d if d < 1 << 63 else None) for i, _, d, _, _ in plain_whitening(kept(rows, 8), 2)}
    assert {(r["id"], r["deviation"]) for r in found} == want and any(d is None for _, d in want)


def test_summaries_merge_without_loss():
    r = np.random.default_rng(2)
    x = np.floor(r.normal(size=(300, 6)) * 40).astype(np.int64) + 1_000_000
    parts = [whitening.Summary.of(p, p[0]) for p in np.array_split(x, [1, 3, 50, 280])]
    left = parts[0]
    for p in parts[1:]:
        left = left.merge(p)
    right = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3].merge(parts[4])))
    centred = x - x.mean(axis=0)
    for s in (left, right):
        assert s.n == 300 and list(s.sums) == list(x.sum(axis=0)) and len(s.values) == 6
        assert np.allclose((s.values[:, None] * s.vectors).T @ (s.values[:, None] * s.vectors), centred.T @ centred, rtol=1e-10)
        assert np.allclose(s.mean + s.base, x.mean(axis=0), rtol=1e-14)


@pytest.mark.parametrize("sf", [SF, SF_LARGER])
def test_whitening_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = whitening.op12_whitening(spark, sf)
    assert [f"{n} {t}" for n, t in found.dtypes] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    check_whitening([r.asDict() for r in found.collect()], plain_whitening(rows))


def plain_codes(rows, parts, entries, rounds):
    v = np.array([floors(x, 1024) for _, x, _ in rows], object)
    v = np.hstack([v, np.zeros((len(v), -v.shape[1] % parts), object)])
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, tuple(v[k])))
    p, codes, books, error = v.shape[1] // parts, [], [], [0] * len(rows)
    for i in range(parts):
        x, book = v[:, i * p : (i + 1) * p], [list(v[k, i * p : (i + 1) * p]) for k in order[:entries]]
        for turn in range(rounds + 1):
            far = [((np.array(b, object) - x) ** 2).sum(axis=1) for b in book]
            own = [min(range(len(book)), key=lambda z, k=k: (far[z][k], z)) for k in range(len(x))]
            if turn < rounds:
                for z in range(len(book)):
                    mine = [k for k, o in enumerate(own) if o == z]
                    if mine:
                        book[z] = [int(t) // len(mine) for t in x[mine].sum(axis=0)]
        codes.append(own)
        books.append(book)
        error = [e + far[o][k] for k, (e, o) in enumerate(zip(error, own, strict=True))]
    text = ",".join(str(c) for b in books for entry in b for c in entry)
    found = [(rows[k][0], "".join(f"{c[k]:02x}" for c in codes), error[k], rows[k][2]) for k in range(len(rows))]
    return sorted(found, key=repr), text


@pytest.mark.parametrize(("width", "entries", "large"), [(8, 6, False), (8, 256, False), (7, 40, False), (8, 9, True)])
def test_codes_of_hostile_rows(spark, width, entries, large):
    rows = hostile_vectors(width, large=large)
    found, books = vector_codes.compress(vectors(spark, rows).repartition(3), "vec_id", "embedding", "label", 4, entries, 4)
    want, text = plain_codes(kept(rows, width), 4, entries, 4)
    got = sorted(((r["id"], r["code"], r["error"], r["label"]) for r in found.collect()), key=repr)
    assert vector_codes.books_text(books) == text
    assert got == sorted(((i, c, e if e < 1 << 63 else None, l) for i, c, e, l in want), key=repr)


def test_codes_of_nothing_and_few(spark):
    assert vector_codes.compress(vectors(spark, []), "vec_id", "embedding", "label")[0].count() == 0
    few = [(2, [1.0, 0.0, 0.5, 0.25], 1), (1, [0.0, 0.0, 0.5, 0.5], None)]
    found, books = vector_codes.compress(vectors(spark, few), "vec_id", "embedding", "label")
    assert {(r["id"], r["code"], r["error"]) for r in found.collect()} == {(1, "00000000", 0), (2, "01000001", 0)} and len(books[0]) == 2


def test_tree_walk_is_exact_on_ties():
    """Grids and repeats: many parts as far from one entry as from another, and nodes of no extent."""
    r = np.random.default_rng(9)
    for width, span in ((1, 4), (2, 3), (3, 30), (16, 2)):
        points = r.integers(-span, span, (900, width))
        points[:300] = points[0]
        book = r.integers(-span, span, (40, width))
        far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        tree = vector_codes.Tree.build(points)
        code, error = tree.codes(book)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        count, total = tree.sums(book)
        assert (count == np.bincount(code, minlength=40)).all() and all((total[z] == points[code == z].sum(axis=0)).all() for z in range(40))


@pytest.mark.parametrize("sf", [SF])
def test_codes_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, text = plain_codes(rows, 4, 256, 4)
    digest, sums = hashlib.sha256(text.encode()).hexdigest(), defaultdict(int)
    for _, _, e, label in want:
        sums[label] += e
    found = vector_codes.op13_vector_codes(spark, sf)
    assert [f"{n} {t}" for n, t in found.dtypes] == ["vec_id bigint", "code string", "error bigint", "label_error bigint", "codebooks_sha256 string"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, c, e, sums[label], digest) for i, c, e, label in want), key=repr)
