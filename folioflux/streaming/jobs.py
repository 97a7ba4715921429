"""Jobs in a stream of stage events (§2.12.9, 2.6.17): state for each owner, stage times, failure on timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A job without a new stage for so long is over; stages after which it has succeeded.
TIMEOUT_MINUTES, FINAL = 30, ("purchase",)
SCHEMA = "user_id long, started_at timestamp, last_at timestamp, n_stages long, last_stage string, longest_seconds double, status string"


def job_states(events: DataFrame, timeout: int = TIMEOUT_MINUTES, final: tuple[str, ...] = FINAL, delay: str = "1 hour") -> DataFrame:
    """user_id, started_at, last_at, n_stages, last_stage, longest_seconds (of a stage) and status of every job: a user's stages
    (event_id, ts, event_type) with less than `timeout` minutes from one to the next. A job has succeeded if its last
    stage is a final one; else it has failed, for want of a next stage.

    The same on a table and on a stream. Repeated event ids count once. On a stream a job is told when the watermark,
    `delay` behind the newest event, is `timeout` past its last stage: then no event can belong to it any more. What is
    kept for a user are the stages of jobs that may still grow, not their history. Rows without user, time or id are left
    out; of stages at one time the smaller id comes first."""
    known = events.where("user_id is not null and ts is not null and event_id is not null").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    if known.isStreaming:
        return _streamed(known, timeout, final, delay)
    once = known.dropDuplicates(["event_id"])
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / 1e6
    staged = once.withColumn("gap", gap).withColumn("job", F.sum(F.when(F.col("gap") < timeout * 60, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    inside = F.when(F.col("gap") < timeout * 60, F.col("gap"))
    jobs = staged.groupBy("user_id", "job").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count("*").alias("n_stages"), last.alias("last_stage"), F.coalesce(F.max(inside), F.lit(0.0)).alias("longest_seconds"))
    return jobs.drop("job").withColumn("status", F.when(F.col("last_stage").isin(*final), "succeeded").otherwise("failed"))


def _streamed(known: DataFrame, timeout: int, final: tuple[str, ...], delay: str) -> DataFrame:
    apart = timeout * 60_000_000

    def told(key: tuple, jobs: list[list[tuple]]) -> pd.DataFrame:
        rows = []
        for job in jobs:
            times = [t for t, _, _ in job]
            longest = max((b - a for a, b in zip(times, times[1:], strict=False)), default=0) / 1e6
            rows.append((key[0], pd.Timestamp(times[0], unit="us"), pd.Timestamp(times[-1], unit="us"), len(job), job[-1][2], longest, "succeeded" if job[-1][2] in final else "failed"))
        return pd.DataFrame(rows, columns=["user_id", "started_at", "last_at", "n_stages", "last_stage", "longest_seconds", "status"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = set(zip(*state.get, strict=True)) if state.exists else set()
        for b in batches:
            kept |= set(zip(b["us"].tolist(), b["event_id"].tolist(), b["event_type"].tolist(), strict=True))
        jobs: list[list[tuple]] = []
        for stage in sorted(kept):
            if jobs and stage[0] - jobs[-1][-1][0] < apart:
                jobs[-1].append(stage)
            else:
                jobs.append([stage])
        past = state.getCurrentWatermarkMs() * 1000
        over = [j for j in jobs if j[-1][0] + apart <= past]
        rest = [s for j in jobs[len(over) :] for s in j]
        if rest:
            state.update(tuple(list(x) for x in zip(*rest, strict=True)))
            first_open = jobs[len(over)][-1][0] + apart
            state.setTimeoutTimestamp(max(first_open // 1000 + 1, past // 1000 + 1))
        elif state.exists:
            state.remove()
        yield told(key, over)

    stream = known.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).withColumn("us", F.unix_micros("ts"))
    return stream.groupBy("user_id").applyInPandasWithState(step, SCHEMA, "us array<long>, event_id array<long>, event_type array<string>", "append", GroupStateTimeout.EventTimeTimeout)
