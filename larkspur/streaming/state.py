"""Stateful behaviours as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_versions(captures: DataFrame, at: str = "fetched_at", delay: str = "30 days") -> DataFrame:
    """Captures whose (restaurant, content) was not seen within the watermark."""
    return captures.withWatermark(at, delay).dropDuplicatesWithinWatermark(["restaurant_id", "content_hash"])


def live_vote_changes(events: DataFrame) -> DataFrame:
    """(target, client_id, vote) whenever a client's live vote changes; a null vote withdraws.  Within a
    batch events go by (ts, id)."""

    def step(key, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held = state.get if state.exists else (None,)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        vote = rows["vote"].iloc[-1]
        vote = None if pd.isna(vote) else vote
        state.update((vote,))
        if vote != held[0]:
            yield pd.DataFrame({"target": [key[0]], "client_id": [key[1]], "vote": [vote]})

    return events.groupBy("target", "client_id").applyInPandasWithState(step, "target long, client_id string, vote string", "vote string", "update", GroupStateTimeout.NoTimeout)


def failure_counts(events: DataFrame) -> DataFrame:
    """(restaurant_id, failures): the failures since the last success, of rows (ts, id, ok)."""

    def step(key, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        n = state.get[0] if state.exists else 0
        for ok in pd.concat(list(batches)).sort_values(["ts", "id"])["ok"]:
            n = 0 if ok else n + 1
        state.update((n,))
        yield pd.DataFrame({"restaurant_id": [key[0]], "failures": [n]})

    return events.groupBy("restaurant_id").applyInPandasWithState(step, "restaurant_id long, failures long", "failures long", "update", GroupStateTimeout.NoTimeout)


def busy_users(comments: DataFrame, limit: int = 10, at: str = "ts") -> DataFrame:
    """Users with ``limit`` comments or more in an hour, by sliding windows."""
    return comments.withWatermark(at, "2 hours").groupBy(F.window(at, "1 hour", "5 minutes"), "user_id").count().where(F.col("count") >= limit)


def daily_counts(events: DataFrame, at: str = "ts") -> DataFrame:
    return events.withWatermark(at, "1 day").groupBy(F.window(at, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def write_changes(stream: DataFrame, step, checkpoint: str):
    """Each micro-batch through ``step(batch, id)``: merges and change logs by the batch operators."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
