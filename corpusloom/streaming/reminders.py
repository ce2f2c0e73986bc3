"""Reminder state per session on a stream; operators.sessions is its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import REMINDER_TURNS, reminder_state
from ..plans.rebuild import Projections, publish, read_current, was_published
from ..session import materialise

_OUT = "session_id string, seq long, counter long, observed boolean, emit boolean"
_STATE = "counter long, observed boolean"


def reminder_stream(events: DataFrame, turns: int = REMINDER_TURNS, expire_days: int = 30) -> DataFrame:
    """state rows for a stream of events(session_id, seq, ts, action), append mode.

    A session's state is two values, kept until the session has been silent for expire_days. Rows of a micro-batch are put in (ts, seq) order; rows
    must not be later than an earlier batch's (the source delivers sessions in order). One
    session's rows of a batch meet in one task; reminder_batches has no such limit.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counter, observed = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for seq, action in zip(rows["seq"], rows["action"]):
            if action in ("session_start", "compact"):
                counter = 0
                observed = observed and action == "compact"
            elif action == "observe":
                observed = True
            elif action == "turn":
                counter += 1
            out.append((key[0], seq, counter, observed, action == "turn" and counter >= turns and not observed))
        state.update((counter, observed))
        state.setTimeoutDuration(expire_days * 86_400_000)
        yield pd.DataFrame(out, columns=["session_id", "seq", "counter", "observed", "emit"])

    return events.groupBy("session_id").applyInPandasWithState(
        step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def reminder_batch(
    events: DataFrame, epoch: int, root: str, turns: int = REMINDER_TURNS, source: str = "reminders"
) -> None:
    """One micro-batch with the batch operator: writes root/reminders/v<epoch> and the state.

    Sessions of any size spread over tasks. A batch that is repeated after its state was
    published is recognised by its epoch and changes nothing.
    """
    spark = events.sparkSession
    if was_published(spark, root, source, epoch):
        return
    state = read_current(spark, root, "session_state")
    own = materialise(events.select("session_id").distinct())
    mine = None if state is None else state.join(own, "session_id", "left_semi")
    rows = materialise(reminder_state(events, turns, initial=mine))
    rows.write.mode("overwrite").parquet(f"{root}/reminders/v{epoch}")
    last = rows.groupBy("session_id").agg(
        F.max_by(F.struct("counter", "observed"), F.struct("ts", "seq")).alias("s")
    ).select("session_id", "s.*")
    if state is not None:
        last = state.join(own, "session_id", "left_anti").select(last.columns).unionByName(last)
    publish(Projections(True, rows, {"session_state": last}), root, source=source, epoch=epoch)


def reminder_batches(events: DataFrame, root: str, checkpoint: str, turns: int = REMINDER_TURNS) -> StreamingQuery:
    """Run reminder_batch per micro-batch of streaming events, then stop."""
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, epoch: reminder_batch(df, epoch, root, turns))
        .trigger(availableNow=True).start()
    )
