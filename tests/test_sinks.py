"""Tables by key: what is replaced, what is deleted, and which files stay."""

from pathlib import Path

from pyspark.sql import functions as F

from tessera.sinks.keyed import KeyedTable, attach, delete_cascade


def files(path) -> dict[str, int]:
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def content(spark, table) -> list:
    return sorted(tuple(r) for r in table.read(spark).collect())


def test_replace_leaves_other_files(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), "k", 8)
    rows = [(k, i, f"{k}-{i}") for k in range(40) for i in range(3)] + [(None, 0, "nobody")]
    table.create(spark.createDataFrame(rows, "k long, i int, v string"))
    assert content(spark, table) == sorted(r for r in rows if r[0] is not None)
    before, bucket = files(tmp_path / "t"), spark.range(1).select(F.pmod(F.xxhash64(F.lit(7).cast("long")), F.lit(8))).first()[0]
    # the row of key 8 is not among the replaced keys and is left out; key 7 is named twice
    table.replace(spark.createDataFrame([(7,), (7,), (None,)], "k long"), spark.createDataFrame([("new", 9, 7), ("other", 9, 8)], "v string, i int, k long"))
    assert content(spark, table) == sorted([r for r in rows if r[0] not in (None, 7)] + [(7, 9, "new")])
    after, own = files(tmp_path / "t"), f"key_bucket={bucket}/"
    assert {p: t for p, t in before.items() if own not in p} == {p: t for p, t in after.items() if own not in p}
    assert not {p for p in before if own in p} & set(after)
    # a bucket that loses all rows is emptied, a key that was never there changes nothing
    table.replace(spark.range(40).withColumnRenamed("id", "k"))
    assert content(spark, table) == []
    table.replace(spark.createDataFrame([(1000,)], "k long"), spark.createDataFrame([(1000, 1, "first")], "k long, i int, v string"))
    assert content(spark, table) == [(1000, 1, "first")]
    table.replace(spark.createDataFrame([], "k long"))
    assert content(spark, table) == [(1000, 1, "first")]


def test_hot_key_empty_table_and_cascade(spark, tmp_path):
    lines, marks, heads = (KeyedTable(str(tmp_path / n), k, 4) for n, k in (("lines", "doc"), ("marks", "of"), ("heads", "id")))
    lines.create(spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("doc"), F.col("id").alias("i")))
    marks.create(spark.createDataFrame([(1, "a"), (2, "b"), (4500, "c")], "of long, m string"))
    heads.create(spark.createDataFrame([(1, 4000, "kept"), (2, 0, "two"), (4500, 1, "x")], "id long, n long, title string"))
    attach(lines, [marks], heads, spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc long, i long"), {"n": F.count(F.lit(1))})
    assert [r for r in content(spark, lines) if r[0] < 4000] == [(1, 0), (1, 1), (2, 0)] and len(content(spark, lines)) == 1003
    assert content(spark, marks) == [(4500, "c")] and content(spark, heads) == [(1, 2, "kept"), (2, 1, "two"), (4500, 1, "x")]
    delete_cascade(spark.createDataFrame([(4500,), (1,)], "doc long"), [marks, lines, heads])
    assert content(spark, marks) == [] and content(spark, heads) == [(2, 1, "two")] and 1 not in {r[0] for r in content(spark, lines)}
    empty = KeyedTable(str(tmp_path / "empty"), "k", 2)
    empty.create(spark.createDataFrame([], "k string, v int"))
    assert content(spark, empty) == []
