"""The life of a job as a state machine over its events.

An event that its job's state does not allow changes nothing and is marked.  A
step maps states to states, and such maps compose, so a job's events need not be
folded in one task: each block of time is folded once for every state it could
start in, the maps of a job's blocks are chained, and each block is then replayed
from the state it really starts in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, events and how many starts a job may have had to be resumed after a restart.
STATES = ["queued", "running", "cancelling", "succeeded", "failed", "cancelled"]
ACTIONS = ["claim", "finish", "fail", "cancel", "stop", "retry", "recover"]
RESUMES = 2

LIVE = ("running", "cancelling")


def allowed(state: str, starts: int, action: str) -> str | None:
    """The state after ``action``, or None where it is refused; a cancelled or settled job takes a cancel or recovery as it is."""
    match action:
        case "claim" if state == "queued":
            return "running"
        case "finish" if state in LIVE:
            return "succeeded"
        case "fail" if state in LIVE:
            return "failed"
        case "cancel":
            return {"queued": "cancelled", "running": "cancelling"}.get(state, state)
        case "stop" if state == "cancelling":
            return "cancelled"
        case "retry" if state in ("failed", "cancelled"):
            return "queued"
        case "recover" if state == "running" and starts < RESUMES:
            return "queued"
        case "recover":
            return "failed" if state in LIVE else state
    return None


def _code(state: str, starts: int) -> int:
    return STATES.index(state) * (RESUMES + 1) + min(starts, RESUMES)


#: All (state, starts), starts counted up to the limit; 0 is a queued job that never ran.
CODES = [(s, n) for s in STATES for n in range(RESUMES + 1)]
TARGET = [allowed(s, n, a) for s, n in CODES for a in ACTIONS]
STEP = [c if to is None else _code(to, n + (a == "claim")) for (c, (s, n), a), to in zip([(c, x, a) for c, x in enumerate(CODES) for a in ACTIONS], TARGET, strict=True)]


def _lookup(values: list, state: Column, action: Column) -> Column:
    return F.element_at(F.lit(values), state * len(ACTIONS) + action + 1)


def transitions(events: DataFrame, seconds: int = 6 * 3600) -> DataFrame:
    """job, event_id, at (microseconds), action, before, after, accepted of ``events`` (job, event_id, ts, action), in order of ts, then event_id.

    ``seconds`` is the width of a block.  Rows without a job, a time or a known action are left out, further columns ignored; a repeated
    row is an event of its own.  An empty table gives none.
    """
    number = F.array_position(F.lit(ACTIONS), F.col("action")).cast("int") - 1
    rows = events.where(F.col("job").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin(ACTIONS))
    rows = rows.select("job", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)).alias("block"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", number.alias("action")).alias("event"))
    blocks = rows.groupBy("job", "block").agg(F.array_sort(F.collect_list("event")).alias("events"))
    own = F.lit(list(range(len(CODES))))
    through = F.aggregate("events", own, lambda m, e: F.transform(m, lambda s: _lookup(STEP, s, e["action"])))
    chained = blocks.select("job", F.struct("block", through.alias("through")).alias("x")).groupBy("job").agg(F.array_sort(F.collect_list("x")).alias("all"))
    opening = F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("all", opening, lambda a, x: F.struct(F.get(x["through"], a["state"]).alias("state"), F.array_append(a["starts"], a["state"]).alias("starts")), lambda a: a["starts"])
    starts = chained.select("job", F.explode(F.arrays_zip(F.transform("all", lambda x: x["block"]).alias("block"), starts.alias("start"))).alias("z")).select("job", "z.*")
    replay = F.aggregate(
        "events", F.struct(F.col("start").alias("state"), F.array().cast("array<int>").alias("out")),
        lambda a, e: F.struct(_lookup(STEP, a["state"], e["action"]).alias("state"), F.array_append(a["out"], a["state"]).alias("out")), lambda a: a["out"],
    )
    each = blocks.join(starts, ["job", "block"]).select("job", F.explode(F.arrays_zip("events", replay.alias("state"))).alias("z")).select("job", "z.events.event_id", F.col("z.events.us").alias("at"), "z.events.action", "z.state")
    name = lambda code: F.element_at(F.lit([s for s, _ in CODES]), code + 1)
    refused = F.lit([to is None for to in TARGET])
    return each.select(
        "job", "event_id", "at", F.element_at(F.lit(ACTIONS), F.col("action") + 1).alias("action"), name(F.col("state")).alias("before"), name(_lookup(STEP, F.col("state"), F.col("action"))).alias("after"),
        (~F.element_at(refused, F.col("state") * len(ACTIONS) + F.col("action") + 1)).alias("accepted"),
    )
