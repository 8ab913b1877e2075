"""Path-dependent replays: rate limits, leases and retries, circuit breakers, event sequences.

Each step depends on all earlier decisions of its key, which no window frame expresses. Batch forms replay one key at a
time in order; streaming forms keep a small state per key.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: list[float], past: list[float], limit: int, window: float) -> tuple[list[tuple[bool, int]], list[float]]:
    """Decisions for ordered times after admitted ``past`` ones, and the admitted times that still count.

    Only admitted requests use up the limit; a refused one is told the whole seconds until the oldest leaves the window.
    """
    counted, out = deque(past), []
    for t in times:
        while counted and counted[0] <= t - window:
            counted.popleft()
        if len(counted) >= limit:
            out.append((False, max(1, math.ceil(window - (t - counted[0])))))
        else:
            counted.append(t)
            out.append((True, 0))
    return out, list(counted)


def rate_limit(requests: DataFrame, limit: int, window: int) -> DataFrame:
    """``key, seq, admitted, retry_after`` of ``requests(key, seq, t)`` with ``t`` in seconds; ties by ``seq``.

    A key's rows stream by in order and only ``limit`` times are held, so a hot key does not have to fit in memory.
    """
    if limit <= 0:
        return requests.select("key", "seq", F.lit(True).alias("admitted"), F.lit(0).alias("retry_after"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            out = []
            for k, part in pdf.groupby("key", sort=False):
                if k != key:
                    key, held = k, []
                decided, held = admit(part["t"].tolist(), held, limit, window)
                out.append(pd.DataFrame({"key": k, "seq": part["seq"].values, "admitted": [d[0] for d in decided], "retry_after": [d[1] for d in decided]}))
            if out:
                yield pd.concat(out)

    ordered = requests.select("key", "seq", F.col("t").cast("double")).repartition("key").sortWithinPartitions("key", "t", "seq")
    return ordered.mapInPandas(run, "key long, seq long, admitted boolean, retry_after int")


def rate_limit_stream(requests: DataFrame, limit: int, window: int) -> DataFrame:
    """The same as a stream: the state of a key is the admitted times that still count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        decided, held = admit(rows["t"].tolist(), list(state.get[0]) if state.exists else [], limit, window)
        state.update((held,))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].values, "admitted": [d[0] for d in decided], "retry_after": [d[1] for d in decided]})

    return requests.groupBy("key").applyInPandasWithState(step, "key long, seq long, admitted boolean, retry_after int", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def job_states(events: DataFrame, most_retries: int = 3, base: int = 2) -> DataFrame:
    """Replay of an ingestion queue: ``job, status, retries, delay`` after the events of each job.

    ``events(job, seq, event)``: ``claim``, ``succeed``, ``fail`` (may be retried), ``fatal``, ``expire``. A failed job is queued
    again with a doubling delay of at most 60 s until its retries are used up, then it is a dead letter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.job != job:
                    if job is not None:
                        out.append((job, *state))
                    job, state = r.job, ("queued", 0, 0)
                status, retries, _ = state
                if r.event == "claim" and status == "queued":
                    state = ("processing", retries + 1, 0)
                elif status == "processing" and r.event == "succeed":
                    state = ("succeeded", retries, 0)
                elif status == "processing" and r.event == "expire":
                    state = ("queued", retries, 0)
                elif status == "processing" and r.event == "fail" and retries < most_retries:
                    state = ("queued", retries, min(base * 2 ** max(retries - 1, 0), 60))
                elif status == "processing" and r.event in ("fail", "fatal"):
                    state = ("dead_letter", retries, 0)
            yield pd.DataFrame(out, columns=["job", "status", "retries", "delay"])
        if job is not None:
            yield pd.DataFrame([(job, *state)], columns=["job", "status", "retries", "delay"])

    ordered = events.select("job", "seq", "event").repartition("job").sortWithinPartitions("job", "seq")
    return ordered.mapInPandas(run, "job long, status string, retries int, delay int")


def circuit_breaker(calls: DataFrame, failures: int = 3, cooldown: float = 30.0) -> DataFrame:
    """``provider, seq, state, allowed`` of ``calls(provider, seq, t, ok)``: closed, open after failures in a row, half open after the cooldown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, bad, opened = None, 0, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.provider != provider:
                    provider, bad, opened = r.provider, 0, None
                state = "closed" if opened is None else "half_open" if r.t - opened >= cooldown else "open"
                out.append((r.provider, r.seq, state, state != "open"))
                if state == "open":
                    continue
                if r.ok:
                    bad, opened = 0, None
                else:
                    bad += 1
                    opened = r.t if state == "half_open" or bad >= failures else None
            yield pd.DataFrame(out, columns=["provider", "seq", "state", "allowed"])

    ordered = calls.select("provider", "seq", F.col("t").cast("double"), "ok").repartition("provider").sortWithinPartitions("provider", "t", "seq")
    return ordered.mapInPandas(run, "provider string, seq long, state string, allowed boolean")


def fair_permits(requests: DataFrame, permits: int, lease: float) -> DataFrame:
    """``pool, seq, granted_at`` in arrival order of ``requests(pool, seq, t, hold)``; a holder is dropped after ``lease`` seconds."""
    import heapq

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, ends = None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.pool != pool:
                    pool, ends = r.pool, []
                start = r.t
                if len(ends) >= permits:
                    start = max(start, heapq.heappop(ends))
                heapq.heappush(ends, start + min(r.hold, lease))
                out.append((r.pool, r.seq, start))
            yield pd.DataFrame(out, columns=["pool", "seq", "granted_at"])

    ordered = requests.select("pool", "seq", F.col("t").cast("double"), F.col("hold").cast("double")).repartition("pool").sortWithinPartitions("pool", "t", "seq")
    return ordered.mapInPandas(run, "pool long, seq long, granted_at double")


def sequence_gaps(events: DataFrame, key: str, number: str) -> DataFrame:
    """Places where an event stream's numbers do not go up by one."""
    before = F.lag(number).over(Window.partitionBy(key).orderBy(number))
    return events.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(number) != F.col("before") + 1)).select(key, F.col("before").alias("after_number"), F.col(number).alias("next_number"))


def envelope_status(events: DataFrame, version: int, terminal: list[str]) -> DataFrame:
    """Per request whether its events have one version, run from 1 without gaps, and end with a terminal event only."""
    per = events.groupBy("request").agg(F.bool_and(F.col("version") == version).alias("same"), F.count("*").alias("n"), F.countDistinct("sequence").alias("d"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.max_by("event", "sequence").alias("last"), F.count_if(F.col("event").isin(terminal)).alias("ends"))
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))
    return per.select("request", F.when(~F.col("same"), "wrong_version").when(~whole, "gap").when((F.col("ends") != 1) | ~F.col("last").isin(terminal), "open").otherwise("complete").alias("status"))


def heartbeat_status(beats: DataFrame, now: Column, most: int = 15) -> DataFrame:
    """Workers whose newest heartbeat is fresh and running. ``beats(worker, t, running)`` with ``t`` in seconds."""
    per = beats.groupBy("worker").agg(F.max_by("running", "t").alias("running"), F.max("t").alias("t"))
    return per.select("worker", (F.col("running") & (now - F.col("t") <= most)).alias("alive"))
