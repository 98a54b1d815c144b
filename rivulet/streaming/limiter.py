"""Sliding-window rate limiting and event-time aggregates, in batch and as streams."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_S = 60.0


def admit(times: list[float], held: deque, limit: int, window: float = WINDOW_S) -> list[tuple[bool, int]]:
    """(allowed, retry after seconds) of requests in time order; ``held`` keeps the admitted times.  Rejected requests use up nothing."""
    out = []
    for t in times:
        while held and held[0] <= t - window:
            held.popleft()
        if len(held) < limit:
            held.append(t)
            out.append((True, 0))
        else:
            out.append((False, max(1, math.ceil(window - (t - held[0])))))
    return out


def rate_limit(requests: DataFrame, limit: int, window: float = WINDOW_S) -> DataFrame:
    """``(client, request_id, ts, allowed, retry_after)`` of ``(client, request_id, ts)``, in order of (ts, request_id) per client.

    The state of a client is its last ``limit`` admitted times.  Requests of null clients or times are left out.
    """
    schema = "client string, request_id bigint, ts double, allowed boolean, retry_after int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by client and time: a client's state is all that is held
        client, held = None, deque()
        for b in batches:
            rows = []
            for c, i, t in zip(b.client, b.request_id, b.ts):
                if c != client:
                    client, held = c, deque()
                rows.append((c, i, t, *admit([t], held, limit, window)[0]))
            yield pd.DataFrame(rows, columns=["client", "request_id", "ts", "allowed", "retry_after"])

    ordered = requests.where("client IS NOT NULL AND ts IS NOT NULL").select(F.col("client").cast("string").alias("client"), "request_id", F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return ordered.repartition("client").sortWithinPartitions("client", "ts", "request_id").mapInPandas(run, schema)


def limit_stream(requests: DataFrame, limit: int, window: float = WINDOW_S) -> DataFrame:
    """The same on a stream of ``(client, request_id, ts)``: keyed state of admitted times, kept between micro-batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        out = [(key[0], i, t, *admit([t], held, limit, window)[0]) for i, t in zip(rows.request_id, rows.ts)]
        state.update((list(held),))
        yield pd.DataFrame(out, columns=["client", "request_id", "ts", "allowed", "retry_after"])

    schema = "client string, request_id bigint, ts double, allowed boolean, retry_after int"
    keyed = requests.select(F.col("client").cast("string").alias("client"), "request_id", F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return keyed.groupBy("client").applyInPandasWithState(run, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def feedback_totals(votes: DataFrame) -> DataFrame:
    """``(chunk_id, feedback)`` of votes ``(chunk_id, relevant)``: +1 and -1 added up; the same plan on a stream, in update mode."""
    return votes.groupBy("chunk_id").agg(F.sum(F.when(F.col("relevant"), 1.0).otherwise(-1.0)).alias("feedback"))


def tumbling_counts(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events per window and type by event time; with ``late`` a watermark bounds the state of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n_events", "total")
