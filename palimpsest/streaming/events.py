"""Structured Streaming: windowed counts, outcome labels by interval join, latest state, session features."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in each window; windows close once the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def outcome_pairs(views: DataFrame, accesses: DataFrame, minutes: int = 120, late: str = "3 hours") -> DataFrame:
    """Stream-stream interval join, left outer: each view with the same user's later accesses, or alone once none can come.

    State is bounded by the watermarks; a view without an access comes out when both have passed its interval.
    """
    v = views.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("at")).withWatermark("at", late)
    a = accesses.select(F.col("user_id").alias("accessor"), F.col("ts").alias("access_at")).withWatermark("access_at", late)
    inside = (F.col("viewer") == F.col("accessor")) & (F.col("access_at") > F.col("at")) & (F.col("access_at") <= F.col("at") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return v.join(a, inside, "left_outer").select("log_id", "at", "access_at")


def outcomes(pairs: DataFrame) -> DataFrame:
    """(log_id, outcome) of joined pairs: 1 for a latest access within 30 minutes, 0.5 for a later one, 0 for none."""
    last = pairs.groupBy("log_id").agg(F.max("access_at").alias("last"), F.first("at").alias("at"))
    gap = F.col("last").cast("double") - F.col("at").cast("double")
    return last.select("log_id", F.when(gap <= 1800, 1.0).when(gap.isNotNull(), 0.5).otherwise(0.0).alias("outcome"))


def latest_state(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """The newest value of each key (update mode): the stream form of latest-wins tables."""
    return changes.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("v"), F.max("ts").alias("ts")).select("user_id", "v.*", "ts")


def session_counts(turns: DataFrame, idle: str | None = None) -> DataFrame:
    """(conv_id, turns, roles): running state of each conversation, kept across batches.

    With ``idle``, a time such as "10 minutes", turns have a time ``ts``, and a conversation's state is forgotten
    once the watermark is so far past its last turn: state doesn't grow with all conversations that ever were.
    """
    kept = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, roles = state.get if state.exists else (0, "")
        last = 0
        for pdf in batches:
            n += len(pdf)
            roles = ",".join(sorted({*(r for r in roles.split(",") if r), *pdf["role"]}))
            last = max(last, int(pdf["ts"].max().timestamp() * 1000)) if kept is not None else 0
        state.update((n, roles))
        if kept is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + kept)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "roles": [roles]})

    timed = turns if idle is None else turns.withWatermark("ts", idle)
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, turns long, roles string", "n long, roles string", "update", timeout)


def idle_periods(events: DataFrame, gap: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """(user_id, begin, end, n): bursts of activity; a user is idle from ``end`` on, ``gap`` after the last event."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, forgetting ids older than the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counters(accesses: DataFrame) -> DataFrame:
    """(user_id, event_type, n, last): running access counts, for update mode."""
    return accesses.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def expiring(values: DataFrame, ttl: str = "5 minutes", late: str = "5 minutes") -> DataFrame:
    """(key, begin, value): the newest value of each key in each period of ``ttl``: what a cache holds until the period ends.

    State of past periods goes once the watermark has passed them.
    """
    w = F.window("ts", ttl)
    return values.withWatermark("ts", late).groupBy("key", w.alias("w")).agg(F.max_by("value", "ts").alias("value")).select("key", F.col("w.start").alias("begin"), "value")


def near_duplicate_writer(path: str, distance: float = 0.05):
    """A ``foreachBatch`` function: rows (id, category, embedding) that repeat no stored row are appended to the table at ``path``.

    A batch is compared with the snapshot and, by exact vector, with itself.
    """
    from palimpsest.operators.vector import new_vectors

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(["category", "embedding"])
        try:
            stored = spark.read.parquet(path)
        except AnalysisException:  # nothing is stored yet
            once.write.mode("append").parquet(path)
            return
        fresh = new_vectors(once, stored, distance).where("duplicate_of is null").select("id")
        once.join(fresh, "id", "left_semi").write.mode("append").parquet(path)

    return write


def poll_overdue(commitments: DataFrame, at) -> DataFrame:
    """(id, owner, deadline) of new commitments that are overdue at a time: run with the availableNow trigger as often as needed."""
    return commitments.where(F.col("status").isin("open", "in_progress", "blocked") & (F.col("deadline") < at)).select("id", "owner", "deadline")
