"""Conversation state and job staleness over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.streaming.ingest import WATERMARK


def session_states(messages: DataFrame) -> DataFrame:
    """State of every session: first and last activity, turns, whether it was greeted.

    A plain streaming aggregate (update or complete mode): messages of one very
    busy session are combined where they are read, so only one row per task and
    session reaches the state store, and arrival order does not matter.
    """
    return messages.groupBy("session_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("last_activity_at"),
        F.count(F.lit(1)).alias("turns"),
        F.max((F.col("role") == "assistant").cast("int")).cast("boolean").alias("greeting_sent"),
    )


def flag_first_turns(batch: DataFrame, states: DataFrame) -> DataFrame:
    """Micro-batch messages with is_first_turn, given the session states *before* the batch."""
    from foliant.operators.conversation import first_turns

    known = states.select("session_id")
    return first_turns(batch, greeted=known, keys=("session_id",))


def session_activity(messages: DataFrame, idle: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Closed activity periods per session (append mode, state dropped behind the watermark)."""
    return messages.withWatermark("created_at", watermark).groupBy(
        F.session_window("created_at", idle).alias("w"), "session_id"
    ).agg(F.count(F.lit(1)).alias("turns")).select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "turns")


def stale_jobs(updates: DataFrame, quiet_ms: int = 12_000) -> DataFrame:
    """Emit a job when it has sent no update for ``quiet_ms`` while still running.

    ``updates``: job_id, status.  The timer follows processing time, so the query
    needs a recurring trigger (it never runs dry).
    """

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "is_stale": [True]})
            return
        ended = False
        for piece in pieces:
            ended = ended or bool((~piece["status"].isin(["running", "pending"])).any())
        if not ended:
            state.update((True,))
            state.setTimeoutDuration(quiet_ms)
        elif state.exists:
            state.remove()

    return updates.select("job_id", "status").groupBy("job_id").applyInPandasWithState(
        step, "job_id string, is_stale boolean", "running boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
