"""Reminder state per session: a running counter with resets, exact for sessions of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .skew import range_slices

# Fixed value: finished turns before a reminder.
REMINDER_TURNS = 5


def reminder_state(
    events: DataFrame, turns: int = REMINDER_TURNS, slices: int | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """state(session_id, seq, ts, counter, observed, emit) for every event.

    events(session_id, seq, ts, action): action is session_start, compact, turn, retry, closed
    or observe. A turn counts; retry (will be retried) and closed (no corpus applies) do not.
    session_start resets the counter and the observed flag, compact only the counter. A
    counted turn emits once the counter reaches `turns` and nothing was observed.

    Running values are taken per (session, slice) and completed with what earlier slices of
    the session carry over, so a long session spreads over many tasks. initial(session_id,
    counter, observed) is the state sessions start from.
    """
    action = F.col("action")
    marked = events.select(
        "session_id", "seq", "ts", "action",
        action.isin("session_start", "compact").cast("int").alias("reset"),
        (action == "session_start").cast("int").alias("start"),
        (action == "turn").cast("int").alias("turn"),
        (action == "observe").cast("int").alias("observe"),
    )
    sliced = range_slices(marked, [F.col("session_id"), F.col("ts"), F.col("seq")], slices)
    here = Window.partitionBy("session_id", "_slice").orderBy("ts", "seq")
    local = (
        sliced.withColumn("resets", F.sum("reset").over(here))
        .withColumn("starts", F.sum("start").over(here))
    )
    run = Window.partitionBy("session_id", "_slice", "resets").orderBy("ts", "seq")
    seen = Window.partitionBy("session_id", "_slice", "starts").orderBy("ts", "seq")
    local = local.withColumn("turns", F.sum("turn").over(run)).withColumn("seen", F.max("observe").over(seen))
    # What a slice leaves behind: its last running values, and whether it reset them.
    tail = local.groupBy("session_id", "_slice").agg(
        F.max("resets").alias("resets"), F.max("starts").alias("starts"),
        F.max_by("turns", F.struct("ts", "seq")).alias("turns"),
        F.max_by("seen", F.struct("ts", "seq")).alias("seen"),
    )
    before = Window.partitionBy("session_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("session_id").orderBy("_slice")
    # Group slices by how many resets happened up to them; a group's first slice holds the reset.
    carried = (
        tail.withColumn("_rg", F.sum(F.col("resets").cast("boolean").cast("int")).over(upto))
        .withColumn("_sg", F.sum(F.col("starts").cast("boolean").cast("int")).over(upto))
    )
    in_run = Window.partitionBy("session_id", "_rg").orderBy("_slice")
    in_seen = Window.partitionBy("session_id", "_sg").orderBy("_slice")
    carried = (
        carried.withColumn("_turns", F.sum("turns").over(in_run))
        .withColumn("_seen", F.max("seen").over(in_seen))
        .withColumn("carry_turns", F.coalesce(F.last("_turns").over(before), F.lit(0)))
        .withColumn("carry_seen", F.coalesce(F.last("_seen").over(before), F.lit(0)))
    )
    if initial is not None:
        start = initial.select("session_id", F.col("counter").alias("_c"), F.col("observed").cast("int").alias("_o"))
        carried = carried.join(start, "session_id", "left")
        # Before the first reset (start) of these events the initial state still counts.
        no_reset = F.coalesce(F.sum("resets").over(before), F.lit(0)) == 0
        no_start = F.coalesce(F.sum("starts").over(before), F.lit(0)) == 0
        carried = carried.withColumns({
            "carry_turns": F.col("carry_turns") + F.when(no_reset, F.coalesce("_c", F.lit(0))).otherwise(0),
            "carry_seen": F.greatest("carry_seen", F.when(no_start, F.coalesce("_o", F.lit(0))).otherwise(0)),
        })
    carried = carried.select("session_id", "_slice", "carry_turns", "carry_seen")
    counter = F.col("turns") + F.when(F.col("resets") == 0, F.col("carry_turns")).otherwise(0)
    observed = F.greatest(
        F.col("seen"), F.when(F.col("starts") == 0, F.col("carry_seen")).otherwise(0)
    ) == 1
    return local.join(carried, ["session_id", "_slice"]).select(
        "session_id", "seq", "ts", counter.cast("bigint").alias("counter"), observed.alias("observed"),
        ((F.col("turn") == 1) & (counter >= turns) & ~observed).alias("emit"),
    )
