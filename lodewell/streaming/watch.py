"""File events as streams: debounced change sets, throttled catch-up, and leases with expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, gap: str = "250 milliseconds", key: str = "workspace_id", ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """(key, started_at, settled_at, events, paths): bursts of events, closed by a quiet gap; works on streams and on tables.

    On streams, events later than `late` behind the newest are dropped by the watermark.
    """
    e = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.session_window(ts, gap)
    return e.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_set("path")).alias("paths")).select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("settled_at"), "events", "paths")


def throttle(events: DataFrame, seconds: float = 5.0, key: str = "workspace_id", ts: str = "ts") -> DataFrame:
    """The first event of each fixed interval of a key."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / int(seconds * 1e6))
    return events.withColumn("slot", slot).groupBy(key, "slot").agg(F.min(ts).alias("run_at"), F.count(F.lit(1)).alias("events"))


def watch(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hands each micro-batch of changes to on_batch, one run at a time; what arrives meanwhile is one next batch.

    The checkpoint folder makes a restarted query take up where the last finished batch ended.
    """
    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")).start()


LEASE = "workspace_id string, owner string, at timestamp, granted boolean"


def lease_stream(claims: DataFrame, seconds: float = 60.0) -> DataFrame:
    """(workspace_id, owner, at, granted) for each claim (workspace_id, owner, at) of a stream.

    A claim is granted if the lease is free, expired `seconds` after its last grant, or the claimant's own.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, until = state.get if state.exists else (None, 0.0)
        for f in frames:
            f = f.sort_values(["at", "owner"])
            out = []
            for o, at in zip(f["owner"], f["at"], strict=True):
                t = at.timestamp()
                good = owner is None or until <= t or owner == o
                if good:
                    owner, until = o, t + seconds
                out.append((key[0], o, at, good))
            yield pd.DataFrame(out, columns=["workspace_id", "owner", "at", "granted"])
        state.update((owner, until))

    return claims.groupBy("workspace_id").applyInPandasWithState(run, LEASE, "owner string, until double", "append", GroupStateTimeout.NoTimeout)
