"""Queries on catalogues, queues and event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.lifecycle import transitions
from tessera.plans.base import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE p_name ILIKE '%a%' ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def paged_search(spark, sf_dir):
    """Case-blind substring search, one page, with the count of all hits (a scalar sub-query)."""
    found = table(spark, sf_dir, "part").where(F.col("p_name").ilike("%a%"))
    page = found.orderBy(F.desc("p_retailprice"), "p_partkey").offset(50).limit(25).select("p_partkey", "p_name")
    return page.withColumn("total", found.agg(F.count(F.lit(1))).scalar())


SORTS = {"price": ("o_totalprice DESC", lambda: F.desc("o_totalprice")), "newest": ("o_orderdate DESC", lambda: F.desc("o_orderdate")), "oldest": ("o_orderdate", lambda: F.asc("o_orderdate")), "status": ("o_orderstatus", lambda: F.asc("o_orderstatus"))}


def _named_sort(name: str):
    by_sql, by = SORTS[name]

    def run(spark, sf_dir):
        return orders(spark, sf_dir).orderBy(by(), "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus")

    run.__name__ = f"named_sort_{name}"
    query(f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {by_sql}, o_orderkey LIMIT 100")(run)


for _name in SORTS:
    _named_sort(_name)


@query("""WITH busy AS (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') * 3 > count(*))
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN (SELECT o_orderpriority FROM busy) ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1""")
def claim_next(spark, sf_dir):
    """The next queued row of a class with at most a third of its rows running."""
    o = orders(spark, sf_dir)
    busy = o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count(F.lit(1)).alias("n")).where("p * 3 > n")
    return o.where("o_orderstatus = 'O'").join(busy, "o_orderpriority", "left_anti").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


@query("""WITH latest AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS place FROM latest)
SELECT o_orderkey, o_orderstatus, place, coalesce(c_name, '') AS owner FROM r LEFT JOIN customer ON c_custkey = o_custkey WHERE place <= CASE o_orderstatus WHEN 'O' THEN 25 ELSE 15 END""")
def queue_buckets(spark, sf_dir):
    """The latest 200 rows, in buckets by status with a cap each, with their owners' names."""
    latest = orders(spark, sf_dir).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)
    place = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long")
    capped = latest.withColumn("place", place).where(F.col("place") <= F.when(F.col("o_orderstatus") == "O", 25).otherwise(15))
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    named = owner.join(F.broadcast(capped.select("o_custkey")), "o_custkey", "left_semi")  # at most 200 rows on either side
    return capped.join(F.broadcast(named), "o_custkey", "left").select("o_orderkey", "o_orderstatus", "place", F.coalesce("c_name", F.lit("")).alias("owner"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice >= 200000) AS large, count(*) FILTER (o_totalprice < 50000) AS small FROM orders GROUP BY ALL")
def counts_by_status(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") >= 200_000).alias("large"), F.count_if(F.col("o_totalprice") < 50_000).alias("small"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_has_children(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(orders(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_no_live_job(spark, sf_dir):
    live = orders(spark, sf_dir).where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(live, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""WITH a AS (SELECT doc_id, quality * 100 AS score FROM labels), b AS (SELECT doc_id, 55 + doc_id % 45 AS score FROM documents WHERE text <> '')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.score IS NULL THEN b.score * 10 WHEN b.score IS NULL THEN a.score * 10 ELSE (a.score * 55 + b.score * 45) // 10 END::BIGINT AS score, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'old' ELSE 'both' END AS side FROM a FULL JOIN b USING (doc_id)""".replace("a.doc_id IS NULL", "a.score IS NULL").replace("b.doc_id IS NULL", "b.score IS NULL").replace("coalesce(a.doc_id, b.doc_id) AS doc_id", "doc_id"))
def full_outer_merge(spark, sf_dir):
    """Two scored sets by key, labels and documents with a text: blended where both have it, else taken over."""
    a = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality").cast("long") * 100).alias("old"))
    b = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", (55 + F.col("doc_id") % 45).alias("new"))
    score = F.when(F.col("old").isNull(), F.col("new") * 10).when(F.col("new").isNull(), F.col("old") * 10).otherwise(F.floor((F.col("old") * 55 + F.col("new") * 45) / 10))
    side = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "old").otherwise("both")
    return a.join(b, "doc_id", "full_outer").select("doc_id", score.cast("long").alias("score"), side.alias("side"))


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 5")
def candidate_cap(spark, sf_dir):
    """At most five rows an owner; those in work always first."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderstatus") == "P"), F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return orders(spark, sf_dir).withColumn("place", place).where("place <= 5").select("o_custkey", "o_orderkey", "place")


@query("""SELECT count(*) AS seen, count(*) FILTER (l_quantity < 5) AS too_short, count(*) FILTER (l_quantity > 45) AS too_long, count(*) FILTER (l_discount > 0.08) AS discounted,
count(*) FILTER (l_quantity BETWEEN 5 AND 45 AND l_discount <= 0.08) AS kept FROM lineitem""")
def rejection_report(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("seen"), F.count_if(q < 5).alias("too_short"), F.count_if(q > 45).alias("too_long"), F.count_if(d > 0.08).alias("discounted"), F.count_if(q.between(5, 45) & (d <= 0.08)).alias("kept"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts)::TIMESTAMP AS at, count(*) AS changes, date_diff('second', min(ts), max(ts)) AS seconds FROM events GROUP BY user_id".replace("date_diff('second', min(ts), max(ts))", "(epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000").replace("max(ts)::TIMESTAMP AS at", "epoch_us(max(ts)) AS at"))
def latest_job_state(spark, sf_dir):
    e = events(spark, sf_dir)
    us = lambda c: F.unix_micros(c)
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), us(F.max("ts")).alias("at"), F.count(F.lit(1)).alias("changes"), F.floor((us(F.max("ts")) - us(F.min("ts"))) / 1_000_000).cast("long").alias("seconds"))


@query("""WITH ring AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT event_id, user_id, event_type FROM ring WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 40""")
def event_replay(spark, sf_dir):
    """The last 40 of interest within the last 200 of all."""
    newest = [F.desc("ts"), F.desc("event_id")]
    return events(spark, sf_dir).orderBy(*newest).limit(200).where("event_type <> 'view'").orderBy(*newest).limit(40).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def enqueue_dedupe(spark, sf_dir):
    """The first of each kind and owner; counted by min_by, with partial sums instead of a sort."""
    e = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("r"))
    return e.select("r.event_id", "user_id", "event_type")


@query("SELECT event_type, count(*) AS n, sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


GAP = 6 * 3600
GAPS_SQL = f"WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {GAP}000000 THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)"


@query(f"{GAPS_SQL} SELECT user_id, island::BIGINT AS island, count(*) AS n, epoch_us(min(ts)) AS opens, epoch_us(max(ts)) AS closes FROM i GROUP BY ALL")
def gap_sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    e = events(spark, sf_dir).withColumn("new", F.when(us - F.lag(us).over(w) <= GAP * 1_000_000, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return e.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts")).alias("opens"), F.unix_micros(F.max("ts")).alias("closes"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour, event_type, count(*) AS n, count(value) AS valued FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    """Extension: events by hour."""
    e = events(spark, sf_dir).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("valued"))
    return e.select(F.unix_micros("window.start").alias("hour"), "event_type", "n", "valued")


@query("""WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), r AS (SELECT *, sum(CASE WHEN role IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
SELECT conv_id, run::BIGINT AS run, role, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(coalesce(text, '')))::BIGINT AS chars FROM r GROUP BY ALL""")
def speaker_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w))
    t = t.withColumn("run", F.sum(F.when(~F.col("role").eqNullSafe(F.col("before")), 1).otherwise(0)).over(w))
    return t.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length(T.filled(F.col("text")))).alias("chars"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, sum(o_totalprice::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS held FROM orders) SELECT o_custkey, count(*) FILTER (held <= 1000000) AS kept, count(*) FILTER (held > 1000000) AS dropped FROM s GROUP BY 1""".replace("o_totalprice::BIGINT", "floor(o_totalprice)::BIGINT"))
def cache_trim(spark, sf_dir):
    """The newest rows within a budget stay, for each owner."""
    held = F.sum(F.floor("o_totalprice")).over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    s = orders(spark, sf_dir).select("o_custkey", held.alias("held"))
    return s.groupBy("o_custkey").agg(F.count_if(F.col("held") <= 1_000_000).alias("kept"), F.count_if(F.col("held") > 1_000_000).alias("dropped"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, floor(avg(nullif(l_discount, 0)) * 10000 + 0.5)::BIGINT AS mean_discount, floor(median(l_quantity) * 10 + 0.5)::BIGINT AS mid_quantity, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL""")
def summary_by_flag(spark, sf_dir):
    """Means without zeros, true medians and exact distinct counts."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return a.agg(F.count(F.lit(1)).alias("n"), T.per_myriad(F.avg(F.nullif("l_discount", F.lit(0.0)))).alias("mean_discount"), F.floor(F.median("l_quantity") * 10 + 0.5).cast("long").alias("mid_quantity"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AND count(*) >= 2 AS removable, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def cleanup_decision(spark, sf_dir):
    """Owners not busy; removable if all they have is finished, and twice at least.  One pass, no anti-join."""
    g = orders(spark, sf_dir).groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("busy"), F.bool_and(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("n"))
    return g.where("NOT busy").select("o_custkey", (F.col("done") & (F.col("n") >= 2)).alias("removable"), "n")


@query("""WITH p AS (SELECT s_suppkey AS key, 'patched' AS value FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 1000000 + n_nationkey, n_name FROM nation), b AS (SELECT s_suppkey AS key, s_name AS value FROM supplier)
SELECT coalesce(p.key, b.key) AS key, coalesce(p.value, b.value) AS value FROM b FULL JOIN p ON p.key = b.key""")
def upsert_by_key(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    patch = s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("key"), F.lit("patched").alias("new")).union(table(spark, sf_dir, "nation").select((1_000_000 + F.col("n_nationkey")).cast("long"), "n_name"))
    base = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("old"))
    return base.join(patch, "key", "full_outer").select("key", F.coalesce("new", "old").alias("value"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (b // 1024) || ' KB' WHEN b < 1073741824 THEN (b // 1048576) || ' MB' ELSE (b // 1073741824) || ' GB' END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS b FROM orders)""")
def size_labels(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", T.human_size(F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("size"))


@query("""SELECT n_name, r_name, count(*) AS customers, floor(sum(floor(c_acctbal * 100)) / 100)::BIGINT AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def owners_by_region(spark, sf_dir):
    """A star join: the two dimension tables are fixed in size (25 and 5 rows)."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dims = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum(F.floor(F.col("c_acctbal") * 100)).alias("cents"))
    return c.join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "customers", F.floor(F.col("cents") / 100).cast("long").alias("balance"))


ACTION = "CASE event_type WHEN 'signup' THEN 'claim' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'retry' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'finish' ELSE 'claim' END WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'cancel' WHEN 1 THEN 'stop' ELSE 'recover' END END"
#: The state after an action, or NULL where it is refused.
AFTER_SQL = """CASE WHEN j.action = 'claim' AND r.after = 'queued' THEN 'running' WHEN j.action = 'finish' AND r.after IN ('running', 'cancelling') THEN 'succeeded' WHEN j.action = 'fail' AND r.after IN ('running', 'cancelling') THEN 'failed'
WHEN j.action = 'cancel' THEN CASE r.after WHEN 'queued' THEN 'cancelled' WHEN 'running' THEN 'cancelling' ELSE r.after END WHEN j.action = 'stop' AND r.after = 'cancelling' THEN 'cancelled' WHEN j.action = 'retry' AND r.after IN ('failed', 'cancelled') THEN 'queued'
WHEN j.action = 'recover' THEN CASE WHEN r.after = 'running' AND r.starts < 2 THEN 'queued' WHEN r.after IN ('running', 'cancelling') THEN 'failed' ELSE r.after END END"""
LIVES_SQL = f"""WITH RECURSIVE j AS (SELECT user_id AS job, event_id, epoch_us(ts) AS us, {ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND {ACTION} IS NOT NULL),
r AS (SELECT job, 0::BIGINT AS i, 0::BIGINT AS event_id, '' AS action, '' AS before, 'queued' AS after, true AS accepted, 0 AS starts FROM j WHERE i = 1
UNION ALL SELECT j.job, j.i, j.event_id, j.action, r.after, coalesce({AFTER_SQL}, r.after), {AFTER_SQL} IS NOT NULL, r.starts + (j.action = 'claim' AND r.after = 'queued')::INT FROM r JOIN j ON j.job = r.job AND j.i = r.i + 1)"""


def job_events(spark, sf_dir):
    """Events as those of a job a user: the type stands for the action."""
    return events(spark, sf_dir).select(F.col("user_id").alias("job"), "event_id", "ts", F.expr(ACTION).alias("action"))


@query(f"{LIVES_SQL} SELECT job, event_id, action, before, after, accepted FROM r WHERE i > 0")
def job_transitions(spark, sf_dir):
    """What each event does to its job, in order of time: the state before and after, and whether it is accepted."""
    return transitions(job_events(spark, sf_dir)).drop("at")


@query(f"""{LIVES_SQL}, t AS (SELECT r.*, us FROM r JOIN j USING (job, event_id) WHERE r.i > 0)
SELECT job, arg_max(after, (us, event_id)) AS state, count(*) FILTER (NOT accepted) AS refused, count(*) FILTER (action = 'claim' AND accepted) AS starts, count(*) FILTER (action = 'retry' AND accepted) AS retries, count(*) FILTER (before <> 'queued' AND action = 'recover' AND after = 'queued') AS resumed,
arg_max(after, (us, event_id)) IN ('failed', 'cancelled') AS retryable, arg_max(after, (us, event_id)) IN ('succeeded', 'cancelled') AS purgeable, arg_max(after, (us, event_id)) IN ('queued', 'running', 'cancelling') AS active FROM t GROUP BY job""")
def job_outcomes(spark, sf_dir):
    """Each job's last state, what it was refused, how often it started, was retried and resumed, and what may be done with it."""
    found = transitions(job_events(spark, sf_dir)).groupBy("job").agg(
        F.max_by("after", F.struct("at", "event_id")).alias("state"), F.count_if(~F.col("accepted")).alias("refused"), F.count_if((F.col("action") == "claim") & F.col("accepted")).alias("starts"),
        F.count_if((F.col("action") == "retry") & F.col("accepted")).alias("retries"), F.count_if((F.col("before") != "queued") & (F.col("action") == "recover") & (F.col("after") == "queued")).alias("resumed"),
    )
    return found.withColumns({"retryable": F.col("state").isin("failed", "cancelled"), "purgeable": F.col("state").isin("succeeded", "cancelled"), "active": F.col("state").isin("queued", "running", "cancelling")})
