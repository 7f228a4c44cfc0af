"""Queries on stages, tracks, stamps and the lists that a service shows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.timed import by_sentence
from tessera.plans.base import query, table
from tessera.plans.jobs import events, orders
from tessera.plans.ranges import sentences_of
from tessera.plans.text import PUNCTUATION_SQL, STOP, TIMED_SQL, quoted

# The stages of a run in their order and what each weighs, in hundredths of the whole.
STAGES = {"metadata": 2, "download": 16, "audio": 5, "language": 3, "transcribe": 30, "diarize": 4, "segment": 4, "discover": 12, "score": 8, "dedupe": 3, "validate": 3, "boundaries": 5, "prepare": 5}


@query(f"""WITH st AS (SELECT key, w, (sum(w) OVER (ORDER BY i))::BIGINT - w AS before, i FROM (VALUES {", ".join(f"({i}, '{k}', {w})" for i, (k, w) in enumerate(STAGES.items()))}) v(i, key, w))
SELECT o_orderkey, key AS stage, before * 100 + w * (o_orderkey % 101) AS progress, i AS done, {len(STAGES) - 1} - i AS pending FROM orders JOIN st ON i = o_orderkey % {len(STAGES)}""")
def stage_progress(spark, sf_dir):
    """Overall progress in ten-thousandths, with the stages before and after; the order key stands for stage and share done."""
    weights, names = list(STAGES.values()), list(STAGES)
    i, one = (F.col("o_orderkey") % len(STAGES)).cast("int"), lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("i") + 1)
    o = orders(spark, sf_dir).select("o_orderkey", i.alias("i"))
    progress = one([sum(weights[:k]) for k in range(len(weights))]) * 100 + one(weights) * (F.col("o_orderkey") % 101)
    return o.select("o_orderkey", one(names).alias("stage"), progress.cast("long").alias("progress"), F.col("i").cast("long").alias("done"), (len(STAGES) - 1 - F.col("i")).cast("long").alias("pending"))


@query(f"""{TIMED_SQL}, c AS (SELECT *, greatest(1, least((end_cs - start_cs) // 200, 60)) AS k FROM sent WHERE end_cs > start_cs)
SELECT doc_id, idx, i, (2 * start_cs * k + (end_cs - start_cs) * (2 * i + 1)) // (2 * k) AS at_cs FROM (SELECT *, unnest(range(k)) AS i FROM c)""")
def sample_times(spark, sf_dir):
    """The middles of equal parts of each sentence: one in two seconds, 1 to 60 of them."""
    s = sentences_of(spark, sf_dir).where("end_cs > start_cs").withColumn("k", F.expr("greatest(1L, least((end_cs - start_cs) div 200, 60L))"))
    s = s.select("doc_id", "idx", "start_cs", "end_cs", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
    return s.select("doc_id", "idx", "i", F.expr("(2 * start_cs * k + (end_cs - start_cs) * (2 * i + 1)) div (2 * k)").alias("at_cs"))


@query(f"""{TIMED_SQL}, f AS (SELECT doc_id, idx, n::DOUBLE AS x, coalesce(lag(n) OVER w, n)::DOUBLE AS a, coalesce(lead(n) OVER w, n)::DOUBLE AS b FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
m AS (SELECT doc_id, idx, greatest(least(a, b), least(greatest(a, b), x)) AS v FROM f)
SELECT doc_id, count(*) AS points, floor(list_reduce(list(v ORDER BY idx), lambda p, v: 0.45::DOUBLE * v + 0.55::DOUBLE * p) * 10000 + 0.5)::BIGINT AS level FROM m GROUP BY doc_id""")
def smoothed_track(spark, sf_dir):
    """Sentence lengths by a median of three (ends repeated), then exponential smoothing of 0.45: the level each document ends at."""
    w = by_sentence()
    s = sentences_of(spark, sf_dir).select("doc_id", "idx", F.col("n").alias("x"), F.coalesce(F.lag("n").over(w), "n").alias("a"), F.coalesce(F.lead("n").over(w), "n").alias("b"))
    middle = F.greatest(F.least("a", "b"), F.least(F.greatest("a", "b"), "x")).cast("double")
    track = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", middle.alias("v")))).alias("t"))
    level = F.aggregate(F.slice("t", 2, F.size("t")), F.col("t")[0]["v"], lambda p, r: 0.45 * r["v"] + 0.55 * p)
    return track.select("doc_id", F.size("t").cast("long").alias("points"), T.per_myriad(level).alias("level"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + event_id % 5 - 1 AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, a AS opens, greatest(b, a + 2) AS closes FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, greatest(e.a, r.closes), greatest(e.b, greatest(e.a, r.closes) + 2) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id, opens, closes FROM r""")
def repaired_times(spark, sf_dir):
    """Spans made to follow each other: none opens before the last closes, each lasts two seconds or more.

    closes(i) = max(b, a + 2, closes(i - 1) + 2), so closes(i) - 2 i is a running maximum: one sort, no loop.
    """
    a = F.unix_seconds("ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf_dir).select("user_id", "event_id", "ts", a.alias("a"), (a + F.col("event_id") % 5 - 1).alias("b")).withColumn("i", F.row_number().over(w).cast("long"))
    e = e.withColumn("closes", F.max(F.greatest(F.col("b"), F.col("a") + 2) - 2 * F.col("i")).over(w) + 2 * F.col("i"))
    return e.select("user_id", "event_id", F.greatest("a", F.lag("closes").over(w)).alias("opens"), "closes")


@query(f"""{TIMED_SQL}, x AS (SELECT doc_id, idx, unnest(tokens) AS raw FROM sent), y AS (SELECT doc_id, idx, trim(raw, {PUNCTUATION_SQL}) AS term FROM x),
tf AS (SELECT doc_id, idx, term, count(*) AS k FROM y WHERE term <> '' AND term NOT IN ({quoted(STOP)}) GROUP BY ALL), tot AS (SELECT doc_id, count(*) AS s FROM sent GROUP BY ALL), df AS (SELECT doc_id, term, count(*) AS d FROM tf GROUP BY ALL),
v AS (SELECT doc_id, idx, term, k * (ln((1.0 + s) / (1.0 + d)) + 1) AS w FROM tf JOIN df USING (doc_id, term) JOIN tot USING (doc_id)), u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, idx)) AS unit FROM v)
SELECT a.doc_id, a.idx, floor(sum(a.unit * b.unit) * 1000 + 0.5)::BIGINT AS similarity FROM u a JOIN u b ON b.doc_id = a.doc_id AND b.idx = a.idx + 1 AND b.term = a.term GROUP BY ALL""")
def tfidf_cosine_adjacent(spark, sf_dir):
    """Cosine of the normalised TF-IDF vectors of neighbouring sentences, in thousandths, where they share a term.

    A term's next sentence is found by a window on (document, term): no join of a table with itself.
    """
    s = sentences_of(spark, sf_dir).withColumn("s", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    terms = s.select("doc_id", "idx", "s", F.explode(F.transform("tokens", T.normalize_word)).alias("term")).where((F.col("term") != "") & ~F.col("term").isin(STOP))
    tf = terms.groupBy("doc_id", "idx", "s", "term").agg(F.count(F.lit(1)).alias("k"))
    same = Window.partitionBy("doc_id", "term")
    w = F.col("k") * (F.log((1.0 + F.col("s")) / (1.0 + F.count(F.lit(1)).over(same))) + 1)
    v = tf.select("doc_id", "idx", "term", w.alias("w"))
    v = v.withColumn("unit", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "idx"))))
    v = v.withColumn("next", F.lead(F.struct("idx", "unit")).over(same.orderBy("idx"))).where("next.idx = idx + 1")
    return v.groupBy("doc_id", "idx").agg(F.floor(F.sum(F.col("unit") * F.col("next.unit")) * 1000 + 0.5).cast("long").alias("similarity"))


@query("""WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS rendered, count(*) FILTER (o_orderstatus <> 'F') AS pending,
arg_min(o_orderkey, (o_orderstatus <> 'P', o_orderdate, o_orderkey)) FILTER (o_orderstatus IN ('O', 'P')) AS active FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(rendered, 0) AS rendered, coalesce(pending, 0) AS pending, coalesce(active, -1) AS active FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def owner_overview(spark, sf_dir):
    """Each owner with counts of finished and open rows and the active one: the oldest running, else the oldest queued, -1 for none."""
    live = F.col("o_orderstatus").isin("O", "P")
    first = F.min(F.when(live, F.struct((F.col("o_orderstatus") != "P").alias("waits"), "o_orderdate", "o_orderkey")))["o_orderkey"]
    o = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("rendered"), F.count_if(F.col("o_orderstatus") != "F").alias("pending"), first.alias("active"))
    filled = [F.coalesce(c, F.lit(d)).alias(c) for c, d in (("rendered", 0), ("pending", 0), ("active", -1))]
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", *filled)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS place FROM orders")
def status_ordered_queue(spark, sf_dir):
    """Running rows before queued ones before the rest, each by age."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderdate", "o_orderkey")).cast("long")
    return orders(spark, sf_dir).select("o_custkey", "o_orderkey", place.alias("place"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) GROUP BY 1")
def unknown_ids(spark, sf_dir):
    """Owners asked for that no event knows, with how often; counted before the join, so a hot id is one row of it."""
    asked = orders(spark, sf_dir).where("o_custkey IS NOT NULL").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(events(spark, sf_dir).select(F.col("user_id").alias("o_custkey")), "o_custkey", "left_anti")


@query("""WITH p AS (SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, octet_length(encode(coalesce(html, ''))) AS size FROM pages)
SELECT coalesce(host, '(all)') AS host, count(*) AS files, sum(size)::BIGINT AS bytes FROM p GROUP BY ROLLUP (host)""")
def size_rollup(spark, sf_dir):
    """Bytes by folder with the total."""
    p = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"), F.octet_length(T.filled(F.col("html"))).cast("long").alias("size"))
    return p.rollup("host").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).select(F.coalesce("host", F.lit("(all)")).alias("host"), "files", "bytes")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 80")
def capped_log(spark, sf_dir):
    """The last 80 entries of each log: the limit is the feature."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events(spark, sf_dir).withColumn("place", place).where("place <= 80").select("user_id", "event_id")


@query("""SELECT event_type, floor(count(*) * 10000.0 / (SELECT count(DISTINCT user_id) FROM events) + 0.5)::BIGINT AS mean FROM events GROUP BY 1""")
def factor_means(spark, sf_dir):
    """The mean of each key over all owners, one that lacks the key counting as 0."""
    e = events(spark, sf_dir)
    owners = e.agg(F.count_distinct("user_id")).scalar()
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.floor(F.col("n") * 10000.0 / owners + 0.5).cast("long").alias("mean"))


@query("""WITH h AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#' || left(md5(p_name), 6) WHEN 1 THEN left(md5(p_name), 3) WHEN 2 THEN p_name ELSE NULL END AS hex FROM part), t AS (SELECT p_partkey, ltrim(coalesce(hex, ''), '#') AS x FROM h),
f AS (SELECT p_partkey, CASE WHEN length(x) = 3 THEN regexp_replace(x, '(.)', '\\1\\1', 'g') ELSE x END AS x FROM t), g AS (SELECT p_partkey, CASE WHEN regexp_matches(x, '^[0-9a-fA-F]{6}$') THEN upper(x) ELSE 'FFFFFF' END AS x FROM f)
SELECT p_partkey, '&H00' || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS colour FROM g""")
def caption_colours(spark, sf_dir):
    """#RRGGBB or #RGB as &H00BBGGRR; white where it is no colour."""
    k, digest = F.col("p_partkey") % 4, F.md5(F.encode("p_name", "UTF-8"))
    given = F.when(k == 0, F.concat(F.lit("#"), F.left(digest, F.lit(6)))).when(k == 1, F.left(digest, F.lit(3))).when(k == 2, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.caption_colour(given).alias("colour"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS stamp FROM events")
def iso_stamps(spark, sf_dir):
    """ISO stamps in UTC; the fraction is left out where it is zero."""
    fraction = F.when(F.unix_micros("ts") % 1_000_000 == 0, "").otherwise(F.date_format("ts", ".SSSSSS"))
    return events(spark, sf_dir).select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z")).alias("stamp"))
