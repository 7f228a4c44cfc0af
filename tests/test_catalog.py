"""Every query against its SQL on the smallest tables, and the folds against plain loops."""

import math
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators.timed import timed_sentences
from tessera.plans import catalog
from tests.conftest import SF

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        return None if not isinstance(v, str) and pd.isna(v) else v if isinstance(v, str) else int(v) if float(v).is_integer() else float(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "rank", "s", "e", "start_cs", "end_cs", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_greedy_non_overlap(spark):
    got = catalog.QUERIES["greedy_non_overlap"](spark, SF).toPandas()
    pool = catalog.QUERIES["best_end_per_start"](spark, SF).toPandas()
    times = catalog.QUERIES["sentence_split"](spark, SF).toPandas().set_index(["doc_id", "idx"])
    want = set()
    for doc, own in pool.groupby("doc_id"):
        kept = []
        for r in own.sort_values(["score", "s", "e"], ascending=[False, True, True]).itertuples():
            a, b = times.loc[(doc, r.s), "start_cs"], times.loc[(doc, r.e), "end_cs"]
            if all(max(0, min(b, y) - max(a, x)) / min(b - a, y - x) <= 0.35 for x, y in kept):
                kept.append((a, b))
                want.add((doc, r.s, r.e))
    assert set(zip(got["doc_id"], got["s"], got["e"], strict=True)) == want


def test_caption_lines(spark):
    got = catalog.QUERIES["caption_lines"](spark, SF).toPandas()
    assert (got["text"].str.split(" ").map(len) <= 5).all() and (got["end_cs"] - got["start_cs"] <= 260).all()
    words = sum(len(t.split()) for t in catalog.QUERIES["sentence_split"](spark, SF).toPandas()["sentence"])
    assert abs(got["text"].str.split(" ").map(len).sum() - words) <= 0.01 * words


def plain_captions(sentences, most=5, gap=32, span=260):
    """The caption lines of one document, a word at a time."""
    lines, count, last, first = [], 0, 0, 0
    for start_cs, sentence in sentences:
        for k, word in enumerate(x for x in re.split(r"[ \t\n\x0b\f\r]+", sentence) if x):
            start, end = start_cs + 34 * k, start_cs + 34 * k + 30
            if not count or count >= most or start - last >= gap or end - first > span:
                lines.append([])
                count, first = 0, start
            lines[-1].append((word, start, end))
            count, last = (0 if word[-1] in ".!?…" else count + 1), end
    return [(i, " ".join(w for w, _, _ in x), min(a for _, a, _ in x), max(b for _, _, b in x)) for i, x in enumerate(lines)]


@pytest.mark.parametrize("portion", [1 << 21, 300])
def test_caption_lines_of_a_plain_loop(spark, tmp_path, monkeypatch, portion):
    """All lines, of odd texts too; nothing is shuffled by a key."""
    monkeypatch.setattr("tessera.operators.greedy.PORTION", portion)
    odd = [None, "", " \n ", "... ! ?", "One", "a-b c'd e/f/g h/i/j k. A/b/c/d! x…  y z", "\u0130stanbul\u00a0and \u2003wide  spaces.\tAnd \x0b more\n" * 9, "no final mark " * 40, "- - - - - - - -. 1/2/3/4/5/6/7/8 9. / / / / / /a."]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for r in timed_sentences(docs).orderBy("doc_id", "idx").collect():
        want.setdefault(r["doc_id"], []).append((r["start_cs"], r["sentence"]))
    want = {(d, *x) for d, s in want.items() for x in plain_captions(s)}
    found = catalog.QUERIES["caption_lines"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "line", "text", "start_cs", "end_cs"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_kmeans(spark):
    got = catalog.QUERIES["kmeans_clusters"](spark, SF).toPandas()
    assert got["cluster"].between(0, 5).all() and got["vec_id"].is_unique and math.isclose(len(got), len(set(got["vec_id"])))
