"""Features, likeness, topic blocks, scores and duplicates against plain loops."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.lexicon import MARKERS, PENALTIES, STOPWORDS, WEIGHTS
from tessera.functions.phrases import phrase_counts
from tessera.operators import bounds, chunks, duplicates, scoring, similarity
from tessera.operators import transcript as R
from tessera.operators.duplicates import dropped_in_rounds
from tessera.plans import catalog, scores
from tests.conftest import SF

TALK = (
    "Nobody talks about this, but most people never save money. What happens when you stop? I remember when I was broke, and I cried. "
    "You should focus on one habit, it turns out. So I started with 3.5 percent and 20 dollars! That's why I realized the truth is simple. "
    "Um, like, basically it was fine. Imagine if you always listen and think. The reason is fear, which means you need to act. He said don't do it. "
    "We were scared and angry. In the end my friend was proud and happy. So that's why I love my life. You have to make sure it works! Haha, what a joke. It was over"
)


def unit(lines):
    n, df = len(lines), {}
    for ws in lines:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = []
    for ws in lines:
        v = {w: ws.count(w) * (math.log((1 + n) / (1 + df[w])) + 1) for w in ws}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({w: x / norm for w, x in v.items()})
    return out


def mean(vectors, over=None):
    out = {}
    for v in vectors:
        for w, x in v.items():
            out[w] = out.get(w, 0.0) + x
    return {w: x / (over or len(vectors)) for w, x in out.items()}


def dot(a, b):
    return sum(x * b.get(w, 0.0) for w, x in a.items())


def plain_likeness(lines, reach):
    v = unit(lines)
    for s in range(len(lines)):
        for stop in range(s + 2, s + 2 + reach[s]):
            own, earlier = mean(v[s:stop]), mean(v[: s - 6]) if s > 6 else {}
            size, best = stop - s, 0.0
            for k in (1, 2, 3):
                if s - k * size < 0 or s < 4:
                    break
                best = max(best, dot(own, mean(v[s - k * size : s - k * size + size])))
            yield (None if not own else dot(own, earlier) if earlier else -1e-6), best if own else 0.0


@pytest.mark.parametrize("block", [256, 5])
@pytest.mark.parametrize("seed", range(4))
def test_likeness_is_that_of_a_plain_loop(monkeypatch, seed, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    r = random.Random(seed)
    n = r.choice([0, 1, 9, 60, 90])
    lines = [[r.choice("abcdefghijklmnop") for _ in range(r.choice([0, 0, 1, 3, 6]))] for _ in range(n)]
    reach = np.array([min(r.randrange(9), n - 1 - i) for i in range(n)], np.int64)
    words = np.array([ord(w) for ws in lines for w in ws], np.int64)
    before, some, earlier, near = similarity.compared(np.array([len(ws) for ws in lines], np.int64), words, reach)
    want = list(plain_likeness(lines, reach))
    assert len(want) == len(before)
    for (x, y), b, ok, e in zip(want, before, some, earlier, strict=True):
        assert ok == (x is not None) and (not ok or abs(b - x * 1e6) <= 1) and abs(e - y * 1e6) <= 1
    v = unit(lines)
    for i in range(n - 1):
        assert abs(near[i] - 1e6 * dot(mean(v[max(i - 1, 0) : i + 1], 2), mean(v[i + 1 : i + 3], 2))) <= 1
    ahead = similarity.following(np.array([len(ws) for ws in lines], np.int64), words, reach)
    assert [abs(a - 1e6 * dot(v[i], v[j])) <= 1 for a, (i, j) in zip(ahead, [(i, j) for i in range(n) for j in range(i + 1, i + 1 + reach[i])], strict=True)].count(False) == 0


def test_phrases_overlap_and_nest(spark):
    r = random.Random(3)
    some = sorted({p for g in MARKERS.values() for p in g})
    texts = [" ".join(r.choices([*some, "x", "no", "zz"], k=r.randrange(9))) for _ in range(300)] + [None, "", "nobody talks about the truth nobody"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", phrase_counts(F.col("t"), MARKERS).alias("n")).collect()
    assert all(x["n"] == [sum(p in (x["t"] or "") for p in g) for g in MARKERS.values()] for x in got)


def test_score_of_a_talk(spark):
    """Every range's factors, by the rules written out again on its lines."""
    docs = spark.createDataFrame([(7, TALK + ". " + TALK), (8, None), (9, ""), (10, "One line only.")], "doc_id long, text string")
    lines = {r["idx"]: r for r in scoring.lines(docs, 6000).where("doc_id = 7").collect()}
    rows = scoring.scored(scoring.range_rows(scoring.lines(docs, 6000), 2000, 6000), 2000).collect()
    assert rows and {r["doc_id"] for r in rows} == {7}
    clamp = lambda x: max(0.0, min(1.0, x))
    for r in rows:
        own = [lines[i] for i in range(r["s"], r["e"] + 1)]
        n = {k: sum(x[k] for x in own) for k in R.SUMS}
        assert all(n[k] == r[k] for k in R.SUMS)
        first, last, total, minutes = own[0], own[-1], max(n["tokens"], 1), (own[-1]["end_cs"] - own[0]["start_cs"]) / 6000
        wpm = n["tokens"] / minutes
        pace = 1.0 if 120 <= wpm <= 190 else clamp(1 - (120 - wpm) / 110) if wpm < 120 else clamp(1 - (wpm - 190) / 160)
        feelings = [x["emotion_pos"] - x["emotion_neg"] for x in own]
        hook = 0.3 + 0.22 * bool(first["questions"] or first["asks"]) + (min(0.2 + 0.04 * first["m_curiosity"], 0.3) if first["m_curiosity"] else 0) + 0.08 * bool(first["m_intensity"]) + 0.07 * bool(first["second_person"]) + 0.06 * bool(first["numbers"])
        hook += (0.08 if 4 <= first["tokens"] <= 16 else -0.12 if first["tokens"] > 26 else 0) - 0.15 * bool(first["m_continuation"])
        content = {w for x in (first, last) for w in ("12345" if x["content"] is None else x["content"])}  # None: five or more
        alone = 0.65 - 0.12 * first["deictic"] - 0.08 * first["conjunction"] - 0.08 * (first["deictic"] and len(content) < 5) + (0.18 if last["terminal"] else -0.1) - 0.22 * bool(n["m_continuation"]) - (0.25 if minutes < 1 / 3 else 0)
        want = {
            "hook": hook, "standalone": alone,
            "emotion": 0.18 + 0.15 * n["m_emotion"] + 0.04 * min(n["exclamations"], 4) + 0.04 * n["m_intensity"] + 0.05 * n["m_profanity"] + 0.55 * n["first_person"] / total + 0.25 * clamp((max(feelings) - min(feelings)) / 3),
            "story": 0.16 + 0.055 * n["m_story"] + min(n["past_tense"] / total * 3.2, 0.42) + 0.12 * (n["first_person"] / total > 0.1),
            "payoff": 0.2 + 0.1 * n["m_payoff"] + 0.16 * (3 <= last["tokens"] <= 18) + 0.1 * last["terminal"] + 0.08 * (last["second_person"] > 0),
            "engagement": 0.2 + 0.3 * pace + min(n["second_person"] / total * 1.8, 0.25) + min(n["questions"] * 0.05, 0.12) + min(n["imperatives"] * 0.04, 0.14),
            "shareability": 0.15 + 0.13 * min(n["quotable"], 3) + min(n["second_person"] / total * 1.6, 0.25) + 0.08 * bool(n["numbers"]),
            "filler": n["fillers"] / total * 4.5, "abrupt_end": 0.0 if last["terminal"] else 0.3, "weak_delivery": (1 - pace) * 0.55,
            "novelty": 0.62 if r["s"] < 6 else 0.6 if r["before"] < 0 else 1 - r["before"] * 1.45e-6, "repetition": (r["earlier"] / 1e6 - 0.52) / 0.48, "low_confidence": 0.3,
        }
        for k, x in want.items():
            assert abs(r[k] - 10_000 * clamp(x)) <= 1, (k, r["s"], r["e"])
        raw = sum(w * r[k] for k, w in WEIGHTS.items()) - sum(w * r[k] for k, w in PENALTIES.items())
        assert r["raw"] == max(0, min(1_000_000, raw)) and abs(r["score"] - 1000 * (r["raw"] / 1e6) ** 0.8) <= 0.51
    assert any(r["earlier"] > 0 for r in rows) and any(r["before"] > 0 for r in rows)


def test_counts_of_a_talk(spark):
    rows = R.counted(R.lines_of(R.spoken(spark.createDataFrame([(1, TALK)], "doc_id long, text string")))).orderBy("idx").collect()
    first = rows[0]
    assert (first["m_curiosity"], first["m_contrast"], first["m_absolutes"], first["m_life_theme"], first["quotable"], first["tokens"]) == (2, 1, 2, 1, 1, 10)
    assert [r["questions"] for r in rows[:3]] == [0, 1, 0] and rows[1]["asks"] and rows[4]["numbers"] == 4 and rows[4]["exclamations"] == 1 and rows[3]["turns"] == 1
    assert rows[6]["fillers"] == 3 and rows[9]["imperatives"] == 2 and not rows[-1]["terminal"] and rows[9]["deictic"] and rows[4]["conjunction"]
    assert "nobody" in first["content"] and not set(first["content"]) & set(STOPWORDS)


def test_topic_blocks_fold(spark):
    rows = scoring.opened(spark.read.parquet(f"{SF}/documents.parquet"), 6000).select("doc_id", "sizes", "alike.cohesion", "bounds").collect()
    for r in rows:
        c = [x for x in r["cohesion"] if x is not None]
        threshold = max(0.02e6, np.mean(c) - 0.55 * np.std(c)) if len(c) >= 4 else 0.08e6
        at = begin = 0
        want = []
        for i, n in enumerate(r["sizes"]):
            span = at + 34 * n - 4 - begin
            at += 34 * n + 51
            if i + 1 < len(r["sizes"]) and (c[i] < threshold or span >= 24_000) and span >= 1_200:
                want.append(i + 1)
                begin = at
        assert r["bounds"] == want


def test_rounds_drop_what_the_greedy_loop_drops(spark):
    r = random.Random(8)
    edges, want = [], set()
    for doc in range(6):
        order = list(range(60))
        r.shuffle(order)  # best first
        pairs = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if abs(a - b) < 9 and r.random() < 0.4} if doc else {(i, i + 1) for i in range(40)}
        edges += [(doc, a, b) for a, b in pairs] * (2 if doc == 3 else 1)
        kept = []
        for n in order if doc else range(41):
            (want.add((doc, n)) if any((k, n) in pairs for k in kept) else kept.append(n))
    table = spark.createDataFrame(edges, "doc_id long, hi long, lo long")
    assert {(x["doc_id"], x["lo"]) for x in dropped_in_rounds(table, ["doc_id"]).collect()} == want
    assert dropped_in_rounds(table.limit(0), ["doc_id"]).count() == 0


def test_kept_first_is_the_greedy_loop():
    r = random.Random(9)
    for n in (0, 1, 50, 200):
        pairs = [(a, b) for a in range(n) for b in range(a + 1, min(n, a + 12)) if r.random() < 0.4]
        kept = []
        for b in range(n):
            kept += [] if any((a, b) in pairs for a in kept) else [b]
        hi, lo = (np.array([p[i] for p in pairs * 2], np.int64) for i in (0, 1))
        assert np.flatnonzero(duplicates.kept_first(hi, lo, n)).tolist() == kept


def odd_documents(spark, folder):
    odd = [None, "", "One line only.", TALK, " ".join([TALK] * 4), "Same words again here today. " * 60, "- . - ? " * 50, "Über ähnliche x. " * 90]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["duplicate_pairs", "deduplicated_ranges"])
def test_conflicts_stay_on_their_documents_row(spark, tmp_path, name):
    """Nothing runs before it is asked for, no pair is shuffled or joined, and odd documents give what the SQL gives."""
    folder = odd_documents(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["duplicate_pairs"]).fetchall()
    got = catalog.QUERIES[name](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange hashpartitioning") <= 2 and plan.count("Join") == 1 and "ExistingRDD" not in plan
    rows = got.collect()
    if name == "duplicate_pairs":
        assert want and sorted(tuple(r) for r in rows) == sorted(want)
    else:
        kind = {(d, hi, lo): k for d, hi, lo, *_, k in want}
        kept = {(r["doc_id"], r["s"]) for r in rows if r["status"] == "kept"}
        assert all(((r["doc_id"], r["duplicate_of"]) in kept and kind[r["doc_id"], r["duplicate_of"], r["s"]] == r["code"]) if r["code"] else r["duplicate_of"] is None for r in rows)
        assert not any((d, hi) in kept and (d, lo) in kept for d, hi, lo in kind) and len(rows) == scores.best(spark, folder).count()


def test_deduplicated_ranges(spark):
    pairs, pool = scores.duplicate_pairs(spark, SF).toPandas(), scores.best(spark, SF).toPandas()
    kind = {(d, a, b): k for d, a, b, k in zip(pairs["doc_id"], pairs["hi"], pairs["lo"], pairs["kind"], strict=True)}
    want = {}
    for doc, own in pool.groupby("doc_id"):
        kept = []
        for x in own.sort_values(["score", "s"], ascending=[False, True]).itertuples():
            of = next((k for k in kept if (doc, k, x.s) in kind), None)
            want[doc, x.s] = ("kept", None, "") if of is None else ("duplicate", of, kind[doc, of, x.s])
            kept += [x.s] if of is None else []
    got = {(r["doc_id"], r["s"]): (r["status"], r["duplicate_of"], r["code"]) for r in catalog.QUERIES["deduplicated_ranges"](spark, SF).collect()}
    assert got == want and len({x[2] for x in want.values()}) >= 2


def plain_bounds(x, s, e, low, high):
    """One range, one line at a time; the end is exclusive."""
    stop, n = e + 1, len(x)
    lasts = lambda a, b: x[b - 1]["end_cs"] - x[a]["start_cs"]
    for _ in range(3):
        if s == 0:
            break
        here, before = x[s], x[s - 1]
        if not (here["deictic"] or here["conjunction"] or here["tokens"] < 4 or (before["questions"] and not here["questions"])) or lasts(s - 1, stop) > 1.02 * high:
            break
        s -= 1
    while stop - s > 2 and lasts(s, stop) > high:
        stop -= 1
    if stop - s > 2 and x[stop - 1]["tokens"] <= 12 and lasts(s, stop - 1) >= low and (not x[stop - 1]["terminal"] or x[stop - 1]["opens"]):
        stop -= 1
    while lasts(s, stop) < low and stop < n:
        stop += 1
    if stop - s >= 2 and not x[stop - 1]["terminal"]:
        for c in range(stop - 1, s + 1, -1):
            if x[c - 1]["terminal"] and lasts(s, c) >= low:
                stop = c
                break
    while lasts(s, stop) > high and stop - s > 1:
        stop -= 1
    while lasts(s, stop) < low and s > 0 and stop - s < 3:
        s -= 1
    return s, stop - 1


@pytest.mark.parametrize("seed", range(5))
def test_bounds_of_random_lines(seed):
    r = random.Random(seed)
    for _ in range(60):
        x, at = [], 0
        for _ in range(r.randrange(1, 40)):
            size = r.choice([30, 300, 900, 2500])
            x.append({"start_cs": at, "end_cs": at + size, "tokens": r.randrange(1, 20), "questions": r.choice([0, 0, 1]), "terminal": r.random() < 0.5, "deictic": r.random() < 0.3, "conjunction": r.random() < 0.2, "opens": r.random() < 0.2})
            at += size + r.choice([0, 55])
        ranges = [(a, b) for a in range(len(x)) for b in range(a, min(len(x), a + 12))]
        arrays = {f: np.array([y[f] for y in x]) for f in bounds.FIELDS}
        s, e = bounds.optimised(arrays, np.array([a for a, _ in ranges]), np.array([b for _, b in ranges]), 2000, 6000)
        assert list(zip(s.tolist(), e.tolist(), strict=True)) == [plain_bounds(x, a, b, 2000, 6000) for a, b in ranges]


def test_optimised_bounds(spark):
    lines = {}
    for r in scores.lines(spark, SF).select("doc_id", "idx", *bounds.FIELDS).orderBy("idx").collect():
        lines.setdefault(r["doc_id"], []).append(r)
    pool = {(r["doc_id"], r["s"]): r for r in scores.best(spark, SF).collect()}
    got = catalog.QUERIES["optimised_bounds"](spark, SF).collect()
    assert len(got) == len(pool)
    known = {(r["doc_id"], r["s"], r["e"]): r["score"] for r in scores.scored(spark, SF).select("doc_id", "s", "e", "score").collect()}
    for r in got:
        assert (r["e"], r["score"]) == (pool[r["doc_id"], r["s"]]["e"], pool[r["doc_id"], r["s"]]["score"])
        assert (r["to_s"], r["to_e"]) == plain_bounds(lines[r["doc_id"]], r["s"], r["e"], 2000, 6000)
        assert known.get((r["doc_id"], r["to_s"], r["to_e"]), r["new_score"]) == r["new_score"]
    assert any((r["s"], r["e"]) != (r["to_s"], r["to_e"]) for r in got)


def test_optimised_bounds_keep_their_buckets(spark, tmp_path):
    """What is written once is read by document: no window or join on it shuffles lines again."""
    got = catalog.QUERIES["optimised_bounds"](spark, odd_documents(spark, tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "ExistingRDD" not in plan
    pool = scores.best(spark, str(tmp_path)).count()
    assert pool and got.count() == got.select("doc_id", "s").distinct().count() == pool


def plain_chunks(lines, most_chars, most=40):
    """The packing of one document, a line at a time."""
    budget = max(most_chars, sum(len(x["sentence"]) for x in lines) // most)
    out, held, size, fresh = [], [], 0, 0
    for i, x in enumerate(lines):
        t = x["start_cs"]
        text = f"[{t // 360000:02d}:{t // 6000 % 60:02d}:{t // 100 % 60:02d}] {x['sentence'].strip(' ')}"
        if held and (size + len(text) > budget or (x["opens"] and size > budget * 0.55)):
            out.append((held[0][0], i - 1, lines[fresh]["start_cs"], lines[i - 1]["end_cs"], "\n".join(h[1] for h in held)))
            held, fresh = held[-2:], i
            size = sum(len(h[1]) for h in held)
        held.append((i, text))
        size += len(text) + 1
    out.append((held[0][0], len(lines) - 1, lines[fresh]["start_cs"], lines[-1]["end_cs"], "\n".join(h[1] for h in held)))
    return out if len(out) <= most else [out[int(j * (len(out) / most))] for j in range(most)]


@pytest.mark.parametrize(("most_chars", "most"), [(1500, 40), (120, 400), (100, 5)])
def test_chunks(spark, most_chars, most):
    rows = R.clocked(R.lines_of(scoring.opened(spark.read.parquet(f"{SF}/documents.parquet"), 6000), "opens"), [])
    each = F.array_sort(F.collect_list(F.struct("idx", "sentence", "start_cs", "end_cs", "opens")))
    docs = rows.groupBy("doc_id").agg(each.alias("lines")).withColumn("opens", F.transform("lines", lambda x: x["opens"])).cache()
    want = {(d["doc_id"], k): c for d in docs.collect() for k, c in enumerate(plain_chunks(d["lines"], most_chars, most))}
    got = {(r["doc_id"], r["chunk"]): (r["first"], r["last"], r["start_cs"], r["end_cs"], r["text"]) for r in chunks.chunks(docs, most_chars, most).collect()}
    assert got == want
    if most_chars == 1500:
        assert {(r["doc_id"], r["chunk"]): r["text"] for r in catalog.QUERIES["prompt_chunks"](spark, SF).collect()} == {k: c[4] for k, c in want.items()}
