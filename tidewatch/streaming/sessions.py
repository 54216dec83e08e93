"""Streaming sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import nonblank
from tidewatch.operators.sessions import GAP_SECONDS, LEAD
from tidewatch.streaming.ordered import fold_stream


def sessionize_stream(events: DataFrame, watermark: str = "1 hour", gap_s: int = GAP_SECONDS,
                      keys: list[str] | None = None) -> DataFrame:
    """Gap sessions with state per key; events later than the watermark are dropped.

    A session is emitted once the watermark has passed its end (append mode).  An
    event exactly ``gap_s`` after the previous one still joins, as in batch.
    Session state holds aggregates only, never the events.
    """
    keys = keys or ["employee_id"]
    grouped = events.withWatermark("ts", watermark).groupBy(*keys, F.session_window("ts", f"{gap_s} seconds").alias("w"))
    return grouped.agg(
        F.count("*").alias("n_events"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count_if((F.col("event_type") == "Login") & (F.col("status") == "FAILED")).alias("failed_login_count"),
        F.max(F.col("is_anomalous").cast("int")).alias("is_anomalous")).drop("w")


CARRY = "session_no bigint, last bigint, pos bigint, lead string"
PLACE = "session_no bigint, pos bigint, gap double, lead string"


def _fold_events(gap_us: int | None, lead_columns: list[str]):
    """A fold over events in order: session number, position, seconds since the event before in the session, and the session's first event."""
    def fold(carried: list[tuple], rows: list[tuple[int | None, dict]]) -> tuple[list[tuple], list[tuple]]:
        import json

        number, last, pos, lead = carried[0] if carried else (0, None, -1, None)
        out = []
        for t, row in rows:
            pos += 1
            fresh = number == 0 or gap_us is not None and (last is None or t is None or t - last > gap_us)
            if fresh:
                number, lead = number + 1, json.dumps({**{c: row[c] for c in lead_columns}, "pos": pos})
            gap = None if fresh or last is None or t is None else (t - last) / 1e6
            last = t
            out.append((number, pos, gap, lead))
        return [(number, last, pos, lead)], out

    return fold


def session_events_stream(events: DataFrame, keys: list[str] | None = None, gap_s: int = GAP_SECONDS, delay: str = "1 hour", grace: str = "3650 days",
                          idle: str | None = None, given: bool = False, tie: str = "event_id", buckets: int | None = None) -> DataFrame:
    """A log as a stream of placed events: the columns of the batch sessioniser (session_no, session_id, pos, gap, lead), with ``late``.

    Each session is a stateful object: its number, last time, position and first event stay in state; events are held back for ``delay`` and come out in order, so
    ordered features and sequences of the written events are those of the batch.  Events that come later than that, behind others of their key that are out, are
    returned with ``late`` set and without a place.  ``given``: events carry a ``session_id`` (blank: the employee's own session), and nothing is cut by gaps.
    ``buckets``: state entries that keys share.
    Without marks of first addresses and destinations: readers count those of a session themselves.
    """
    keys = keys or ["employee_id"]
    if given:
        events = events.withColumn("session_id", F.coalesce(nonblank("session_id"), F.concat(F.lit("SES-GEN-"), F.col("employee_id"))))
        keys, gap_us = ["session_id"], None
    else:
        events, gap_us = events.drop("session_id"), gap_s * 1_000_000
    lead = [c for c in LEAD if c in events.columns]
    out = fold_stream(events, keys, "ts", tie, _fold_events(gap_us, lead), CARRY, PLACE, delay, grace, idle, buckets)
    kinds = dict(events.dtypes)
    out = out.withColumn("lead", F.from_json("lead", ", ".join(f"{c} {kinds[c]}" for c in lead) + ", pos bigint"))
    if given:
        return out.drop("session_no")
    return out.withColumn("session_id", F.when(F.col("session_no").isNotNull(), F.concat_ws("-", *keys, F.concat(F.lit("S"), F.col("session_no")))))
