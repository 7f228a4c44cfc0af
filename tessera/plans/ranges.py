"""Queries on timed ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import greedy
from tessera.operators import transcript as R
from tessera.operators.timed import by_sentence, nearest_other, onto_segments, range_windows, timed_sentences
from tessera.plans.base import query, table
from tessera.plans.text import TIMED_SQL

#: A range lasts 20 to 60 seconds, in hundredths.
LOW, HIGH = 2_000, 6_000
WINDOWS_SQL = f"{TIMED_SQL}, windows AS (SELECT a.doc_id, a.idx AS s, b.idx AS e, a.start_cs, b.end_cs, b.end_cs - a.start_cs AS span_cs FROM sent a JOIN sent b ON a.doc_id = b.doc_id AND b.idx > a.idx AND b.end_cs - a.start_cs BETWEEN {LOW} AND {HIGH})"
SAMPLED_SQL = f"""{WINDOWS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY e) - 1 AS r, count(*) OVER (PARTITION BY doc_id, s) AS m FROM windows),
sampled AS (SELECT * FROM ranked WHERE m <= 14 OR list_contains([floor(k * (m - 1) / 13.0 + 0.5)::BIGINT FOR k IN range(14)], r))"""


def sentences_of(spark, sf_dir):
    return timed_sentences(table(spark, sf_dir, "documents"))


@query(f"{WINDOWS_SQL} SELECT doc_id, s, count(*) AS ends, min(span_cs)::BIGINT AS shortest, max(span_cs)::BIGINT AS longest FROM windows GROUP BY ALL")
def range_windows_counts(spark, sf_dir):
    w = range_windows(sentences_of(spark, sf_dir), LOW, HIGH)
    return w.groupBy("doc_id", "s").agg(F.count(F.lit(1)).alias("ends"), F.min("span_cs").alias("shortest"), F.max("span_cs").alias("longest"))


@query(f"{TIMED_SQL} SELECT doc_id, idx, start_cs, end_cs FROM sent WHERE end_cs >= 5000 - 5 AND start_cs <= 9000 + 5")
def interval_overlap_filter(spark, sf_dir):
    return sentences_of(spark, sf_dir).where("end_cs >= 5000 - 5 AND start_cs <= 9000 + 5").select("doc_id", "idx", "start_cs", "end_cs")


@query(f"{TIMED_SQL}, d AS (SELECT DISTINCT doc_id FROM sent), q AS (SELECT doc_id, t FROM d, (VALUES (0), (1000), (2500), (100000)) v(t)) SELECT q.doc_id, q.t::BIGINT AS t, coalesce(min(idx) FILTER (start_cs <= t AND t <= end_cs), -1)::BIGINT AS at, coalesce(min(idx) FILTER (start_cs >= t), -1)::BIGINT AS next FROM q JOIN sent USING (doc_id) GROUP BY ALL")
def point_in_interval(spark, sf_dir):
    """For fixed times: the sentence at it and the first that starts from it on, -1 if none; one pass, no join."""
    s = sentences_of(spark, sf_dir).select("doc_id", "idx", "start_cs", "end_cs", F.explode(F.array(*[F.lit(t).cast("long") for t in (0, 1000, 2500, 100_000)])).alias("t"))
    at, after = F.min(F.when(F.col("t").between(F.col("start_cs"), F.col("end_cs")), F.col("idx"))), F.min(F.when(F.col("start_cs") >= F.col("t"), F.col("idx")))
    return s.groupBy("doc_id", "t").agg(F.coalesce(at, F.lit(-1)).alias("at"), F.coalesce(after, F.lit(-1)).alias("next"))


@query(f"{TIMED_SQL} SELECT doc_id, idx, sum(n) OVER w::BIGINT AS words_so_far, (lead(start_cs) OVER w2 - end_cs)::BIGINT AS gap_cs FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY doc_id ORDER BY idx)".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"))
def sentence_gaps(spark, sf_dir):
    s = sentences_of(spark, sf_dir)
    return s.select("doc_id", "idx", F.sum("n").over(by_sentence().rowsBetween(Window.unboundedPreceding, 0)).alias("words_so_far"), (F.lead("start_cs").over(by_sentence()) - F.col("end_cs")).alias("gap_cs"))


EVENT_SPANS_SQL = "WITH ev AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 3600 + (event_id % 7) * 600 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ev), g AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen + 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, event_id) AS island FROM m), k AS (SELECT user_id, island, min(a) AS a, max(b) AS b FROM g GROUP BY ALL)"


def event_spans(spark, sf_dir):
    """Merged spans of each user's events: those that touch within a minute are one."""
    a = F.unix_seconds(F.col("ts").cast("timestamp"))
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", a.alias("a"), (a + 3600 + F.col("event_id") % 7 * 600).alias("b"))
    w = Window.partitionBy("user_id").orderBy("a", "event_id")
    ev = ev.withColumn("seen", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ev = ev.withColumn("island", F.sum(F.when(F.col("seen").isNull() | (F.col("a") > F.col("seen") + 60), 1).otherwise(0)).over(w))
    return ev.groupBy("user_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))


@query(f"{EVENT_SPANS_SQL} SELECT user_id, island::BIGINT AS island, a, b, lead(a) OVER (PARTITION BY user_id ORDER BY a) - b AS silence FROM k")
def interval_complement(spark, sf_dir):
    """Kept spans and the silence after each."""
    return event_spans(spark, sf_dir).withColumn("silence", F.lead("a").over(Window.partitionBy("user_id").orderBy("a")) - F.col("b"))


@query(f"""{EVENT_SPANS_SQL}, s AS (SELECT *, a - lag(b) OVER (PARTITION BY user_id ORDER BY a) AS gap FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC NULLS LAST, a DESC) AS rank FROM s),
c AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND rank <= 9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a) AS part FROM r) SELECT user_id, part::BIGINT AS part, min(a) AS a, max(b) AS b FROM c GROUP BY ALL""")
def coarsen_gaps(spark, sf_dir):
    """At most ten spans a user: only the nine widest gaps stay, the later one on a tie."""
    own = Window.partitionBy("user_id")
    s = event_spans(spark, sf_dir).withColumn("gap", F.col("a") - F.lag("b").over(own.orderBy("a")))
    s = s.withColumn("rank", F.row_number().over(own.orderBy(F.desc_nulls_last("gap"), F.desc("a"))))
    s = s.withColumn("part", F.sum(F.when(F.col("gap").isNotNull() & (F.col("rank") <= 9), 1).otherwise(0)).over(own.orderBy("a")))
    return s.groupBy("user_id", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))


@query("""WITH ev AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS t FROM events), p AS (SELECT user_id, event_id, t AS a, t + 200000 AS b FROM ev WHERE event_type = 'purchase'),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p), g AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, event_id) AS island FROM m),
k AS (SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, island), seg AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM k),
w AS (SELECT user_id, event_id AS id, t AS s, t + 3600 * (1 + event_id % 40) AS e FROM ev WHERE event_type <> 'purchase'),
h AS (SELECT w.user_id, w.id, w.e - w.s AS lasts, x.o + w.s - x.a AS os, y.o + w.e - y.a AS oe FROM w LEFT JOIN seg x ON x.user_id = w.user_id AND w.s BETWEEN x.a AND x.b LEFT JOIN seg y ON y.user_id = w.user_id AND w.e BETWEEN y.a AND y.b),
r AS (SELECT user_id, id, coalesce(os, oe) AS s, CASE WHEN oe >= coalesce(os, oe) THEN oe ELSE coalesce(os, oe) + greatest(lasts, 60) END AS e FROM h WHERE os IS NOT NULL OR oe IS NOT NULL)
SELECT user_id, id, s::BIGINT AS out_start, (CASE WHEN e > lead(s) OVER o THEN greatest(s + 30, lead(s) OVER o) ELSE e END)::BIGINT AS out_end FROM r WINDOW o AS (PARTITION BY user_id ORDER BY s, id)""")
def remapped_spans(spark, sf_dir):
    """Each user's other events on the time left when only the spans of purchases are kept; what overlaps the next is cut there."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    own = Window.partitionBy("user_id")
    kept = ev.where("event_type = 'purchase'").select("user_id", "event_id", F.col("t").alias("a"), (F.col("t") + 200_000).alias("b"))
    kept = kept.withColumn("seen", F.max("b").over(own.orderBy("a", "event_id").rowsBetween(Window.unboundedPreceding, -1)))
    kept = kept.withColumn("island", F.sum(F.when(F.col("seen").isNull() | (F.col("a") > F.col("seen")), 1).otherwise(0)).over(own.orderBy("a", "event_id")))
    kept = kept.groupBy("user_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    words = ev.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("start"), (F.col("t") + 3600 * (1 + F.col("event_id") % 40)).alias("end"))
    found = onto_segments(words, kept, "user_id", 60)
    after = F.lead("out_start").over(own.orderBy("out_start", "id"))
    return found.select("user_id", "id", "out_start", F.when(F.col("out_end") > after, F.greatest(F.col("out_start") + 30, after)).otherwise(F.col("out_end")).alias("out_end"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t FROM events), p AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'purchase'), o AS (SELECT * FROM e WHERE event_type <> 'purchase')
SELECT p.user_id, p.event_id, arg_min(o.event_type, (abs(o.t - p.t), o.t, o.event_id)) AS near_type, min(abs(o.t - p.t)) AS distance FROM p JOIN o USING (user_id) GROUP BY ALL""")
def nearest_asof(spark, sf_dir):
    """Each purchase with the nearest other event of its user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    found = nearest_other(e, "user_id", "t", "event_id", "event_type", F.col("event_type") == "purchase")
    return found.select("user_id", "event_id", F.col("near.label").alias("near_type"), F.col("near.d").alias("distance"))


@query(f"""{TIMED_SQL}, label AS (SELECT doc_id, idx // 3 AS block, min(start_cs) AS a, max(end_cs) - 100 AS b FROM sent GROUP BY ALL), o AS (SELECT s.doc_id, s.idx, l.block, least(s.end_cs, l.b) - greatest(s.start_cs, l.a) AS shared FROM sent s JOIN label l ON s.doc_id = l.doc_id AND l.a < s.end_cs AND s.start_cs < l.b)
SELECT s.doc_id, s.idx, coalesce(arg_max(o.block, (o.shared, -o.block)), -1)::BIGINT AS label FROM sent s LEFT JOIN o USING (doc_id, idx) GROUP BY ALL""")
def max_overlap_label(spark, sf_dir):
    """Each sentence with the labelled span it overlaps most; the first on a tie, -1 for none.  Joined on time bins."""
    s = sentences_of(spark, sf_dir).select("doc_id", "idx", "start_cs", "end_cs")
    label = s.groupBy("doc_id", F.floor(F.col("idx") / 3).alias("block")).agg(F.min("start_cs").alias("a"), (F.max("end_cs") - 100).alias("b"))
    bins = lambda x, y: F.explode(F.sequence(F.floor(x / 3000), F.greatest(F.floor(y / 3000), F.floor(x / 3000))))
    left = s.withColumn("bin", bins(F.col("start_cs"), F.col("end_cs")))
    right = label.withColumn("bin", bins(F.col("a"), F.col("b")))
    hit = left.join(right, ["doc_id", "bin"]).where((F.col("a") < F.col("end_cs")) & (F.col("start_cs") < F.col("b")))
    shared = F.least("end_cs", "b") - F.greatest("start_cs", "a")
    top = hit.groupBy("doc_id", "idx").agg(F.max_by("block", F.struct(shared, -F.col("block"))).alias("label"))
    return s.select("doc_id", "idx").join(top, ["doc_id", "idx"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


@query()
def caption_lines(spark, sf_dir):
    """Words packed into caption lines, on their document's row; tested against a plain loop."""
    rows = R.spoken(table(spark, sf_dir, "documents"))
    rows = rows.select("doc_id", F.explode(greedy.packed_lines(F.col("found"), F.col("sizes"), R.WORD, R.PAUSE, R.TAIL)).alias("x"))
    return rows.select("doc_id", "x.*")
