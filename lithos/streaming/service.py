"""The service's state on streams: rate limits, content dedup, two-phase scans, growing libraries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(events: DataFrame, key: str = "client", ts: str = "ts", window: int = 60, limit: int = 30) -> DataFrame:
    """(key, ts, accepted) of a stream; the state is the accepted times within the window.

    A key that is silent for a window loses its state, so state follows the
    active keys.  Rows of one micro-batch are taken in order of their time.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for t in rows["ts"]:
            now = t.timestamp()
            kept = [x for x in kept if now - x <= window]
            out.append(limit <= 0 or len(kept) < limit)
            if out[-1]:
                kept.append(now)
        state.update((kept,))
        state.setTimeoutDuration(window * 1000)
        yield pd.DataFrame({"client": name[0], "ts": rows["ts"].to_numpy(), "accepted": out})

    rows = events.select(F.col(key).cast("string").alias("client"), F.col(ts).alias("ts"))
    return rows.groupBy("client").applyInPandasWithState(step, "client string, ts timestamp, accepted boolean", "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_submissions(stream: DataFrame, ts: str = "submitted_at", key: str = "sha256", late: str = "30 days") -> DataFrame:
    """The first submission of each content; the watermark bounds the state."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def two_phase(stream: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Writes the first phase of each micro-batch, then the second.

    Both are keyed by the batch, so a batch that is run again replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            one = first(batch)
            one.write.mode("overwrite").parquet(f"{path}/phase1/batch={number}")
            second(batch.sparkSession.read.parquet(f"{path}/phase1/batch={number}")).write.mode("overwrite").parquet(f"{path}/phase2/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def grown(library: DataFrame, scanned: DataFrame, hit: str = "hash_hit", values: tuple[str, ...] = ("sha256", "size", "name")) -> DataFrame:
    """The library after a batch: samples that a digest store knows are added after the search has used it."""
    from lithos.operators.stores import upsert

    return upsert(library, scanned.where(F.col(hit)), "tlsh", list(values))


def task_states(events: DataFrame, ttl: int = 600) -> DataFrame:
    """(task, state) of a stream of (task, ts, event): phase2 until done or error; expired after the time to live."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"task": [name[0]], "state": ["expired"]})
            return
        now = state.get[0] if state.exists else "phase2"
        for event in pd.concat(list(frames)).sort_values("ts", kind="stable")["event"]:
            now = event if now == "phase2" and event in ("done", "error") else now
        state.update((now,))
        state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame({"task": [name[0]], "state": [now]})

    return events.select(F.col("task").cast("string"), "ts", "event").groupBy("task").applyInPandasWithState(step, "task string, state string", "state string", "update", GroupStateTimeout.ProcessingTimeTimeout)
