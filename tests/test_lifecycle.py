"""Jobs as a state machine: blocks against a plain loop, and on a stream with a restart."""

import datetime as dt
import time

from pyspark.sql import functions as F

from tessera.operators.lifecycle import ACTIONS, allowed, transitions
from tessera.plans import jobs
from tessera.streaming.jobs import followed
from tests.conftest import SF

NOON = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)


def plain(rows):
    """(job, event_id) -> (before, after, accepted) by a loop over each job's events."""
    state, starts, found = {}, {}, {}
    for job, event_id, _ts, action in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        before = state.get(job, "queued")
        after = allowed(before, starts.get(job, 0), action)
        if after and action == "claim":
            starts[job] = starts.get(job, 0) + 1
        state[job] = after or before
        found[job, event_id] = (before, state[job], after is not None)
    return found


def test_blocks_equal_a_loop(spark):
    rows = [tuple(r) for r in jobs.job_events(spark, SF).select("job", "event_id", "ts", "action").where("ts IS NOT NULL").collect()]
    for seconds in (600, 86_400 * 365):
        got = {(r["job"], r["event_id"]): (r["before"], r["after"], r["accepted"]) for r in transitions(jobs.job_events(spark, SF), seconds).collect()}
        assert got == plain(rows)
    assert {a for *_, a in rows} == set(ACTIONS)


def test_hot_job_nulls_and_empty(spark):
    schema = "job long, event_id long, ts timestamp, action string, before string"
    hot = [(1, i, NOON + dt.timedelta(minutes=i % 700), ACTIONS[i * 5 % 7], "clash") for i in range(3000)]
    odd = [(None, 1, NOON, "claim", ""), (2, 2, None, "claim", ""), (2, 3, NOON, None, ""), (2, 4, NOON, "unknown", ""), (2, 5, NOON, "finish", "")]
    got = transitions(spark.createDataFrame(hot + odd, schema), 3600).collect()
    assert {(r["job"], r["event_id"]): (r["before"], r["after"], r["accepted"]) for r in got} == plain([r[:4] for r in [*hot, odd[-1]]])
    assert transitions(spark.createDataFrame([], schema)).collect() == []
    twice = transitions(spark.createDataFrame([(1, 1, NOON, "claim", "")] * 2, schema)).collect()
    assert sorted(r["accepted"] for r in twice) == [False, True]


def run(spark, folder, name, out):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("job long, event_id long, ts timestamp, action string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = followed(stream, 15_000, "30 seconds").writeStream.format("parquet").option("checkpointLocation", str(out / f"{name}-state")).outputMode("append").trigger(availableNow=True).start(str(out / name))
    q.awaitTermination(180)
    assert q.exception() is None
    return {(r["job"], r["event_id"], int(r["ts"].timestamp())): (r["before"], r["after"], r["outcome"]) for r in spark.read.parquet(str(out / name)).collect()}


def test_stream_with_restart_late_rows_and_heartbeat(spark, tmp_path):
    def put(number, rows):
        frame = spark.createDataFrame([(j, i, NOON + dt.timedelta(seconds=s), a) for j, i, s, a in rows], "job long, event_id long, ts timestamp, action string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    at = lambda s: int(NOON.timestamp()) + s
    put(1, [(1, 2, 5, "finish"), (1, 1, 0, "claim"), (2, 3, 1, "claim"), (3, 9, 2, None)])
    run(spark, tmp_path / "in", "a", tmp_path)
    put(2, [(1, 4, 6, "finish"), (2, 5, 0, "cancel"), (9, 6, 100, "claim")])
    run(spark, tmp_path / "in", "a", tmp_path)
    put(3, [(9, 7, 101, "fail")])
    got = run(spark, tmp_path / "in", "a", tmp_path)
    beats = {k[0] for k, v in got.items() if v[2] == "heartbeat"}
    assert {k: v for k, v in got.items() if v[2] != "heartbeat"} == {
        (1, 1, at(0)): ("queued", "running", "accepted"), (1, 2, at(5)): ("running", "succeeded", "accepted"), (1, 4, at(6)): ("succeeded", "succeeded", "refused"),
        (2, 3, at(1)): ("queued", "running", "accepted"), (2, 5, at(0)): ("running", "running", "late"), (9, 6, at(100)): ("queued", "running", "accepted"), (9, 7, at(101)): ("running", "failed", "accepted"),
    }
    assert {1, 2} <= beats <= {1, 2, 9}
    assert (2, None, at(16)) in got and got[2, None, at(16)] == ("running", "running", "heartbeat")


def test_stream_by_the_machines_clock_with_expiring_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 1, NOON, "claim"), (1, 2, NOON, "retry"), (2, 3, NOON, "claim"), (2, 4, NOON + dt.timedelta(seconds=1), "fail")]
    spark.createDataFrame(rows, "job long, event_id long, ts timestamp, action string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job long, event_id long, ts timestamp, action string").parquet(str(tmp_path / "in"))
    # by this clock a query never runs out of batches, as timers may be due: it is stopped once its rows are there
    q = followed(stream, 3_600_000, None, 3_600_000).writeStream.format("memory").queryName("by_machine").outputMode("append").start()
    until = time.time() + 60
    while time.time() < until and spark.table("by_machine").count() < 4:
        time.sleep(1)
    q.stop()
    assert {(r["event_id"], r["after"], r["outcome"]) for r in spark.table("by_machine").collect()} == {(1, "running", "accepted"), (2, "running", "refused"), (3, "running", "accepted"), (4, "failed", "accepted")}
