"""Streaming drift monitor: the window of accepted sessions as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.streaming.ordered import fold_stream

_FIELDS = ["loc", "dev", "br", "os", "hr", "mask"]
STATE = "loc string, dev string, br string, os string, hr double, mask bigint"
OUTPUT = ", ".join(f"{d} double" for d in dims.DEVIATIONS) + ", behaviour_score double, accepted boolean"


def score_session(window: list[tuple], s: tuple, alpha: float = dims.LAPLACE_ALPHA) -> tuple[list[float], float]:
    """Six deviations and the weighted score of one session (loc, dev, br, os, hr, mask)
    against at most ten accepted ones."""
    n = len(window)
    if n < dims.DRIFT_MIN_WINDOW:
        return [0.0] * 6, 0.0
    devs = [1 - sum(w[i] == s[i] for w in window) / n for i in range(4)]
    devs.append(min(abs(s[4] - sum(w[4] for w in window) / n) / 12, 1.0))
    bits = [b for b in range(len(dims.RESOURCES)) if s[5] >> b & 1]
    res = [1 - (sum(w[5] >> b & 1 for w in window) + alpha) / (n + alpha) for b in bits]
    devs.append(min(max(sum(res) / len(res), 0.0), 1.0) if res else 0.0)
    return devs, sum(d * w for d, w in zip(devs, dims.DEVIATIONS.values()))


def fold_sessions(window: list[tuple], rows: list[tuple[int | None, dict]]) -> tuple[list[tuple], list[tuple]]:
    """Scores sessions in order; an accepted one joins the window, which keeps the last ten."""
    out = []
    for _, row in rows:
        s = tuple(row[f] for f in _FIELDS)
        devs, score = score_session(window, s)
        accepted = score < dims.DRIFT_ACCEPT_BELOW
        if accepted:
            window = [*window, s][-dims.DRIFT_WINDOW:]
        out.append((*devs, score, accepted))
    return window, out


def drift_stream(sessions: DataFrame, delay: str = "1 day", idle: str | None = None, grace: str = "3650 days",
                 buckets: int | None = None) -> DataFrame:
    """Drift scores of a stream of session rows: employee_id, session_id, start_time, the deviations, behaviour_score, accepted, late.

    Sessions may come in any order within ``delay``; those that come later are returned with ``late`` set and without scores.  ``idle``: an entity
    without a session for so long starts anew (None: its window stays).  ``buckets``: state entries that entities share.
    """
    rows = sessions.select(
        "employee_id", "start_time", "session_id", F.col("office_location").alias("loc"), F.col("device_id").alias("dev"),
        F.col("browser").cast("string").alias("br"), F.col("operating_system").cast("string").alias("os"),
        F.coalesce(F.hour("start_time").cast("double"), F.lit(0.0)).alias("hr"), F.coalesce("resource_mask", F.lit(0).cast("long")).alias("mask"))
    return fold_stream(rows, ["employee_id"], "start_time", "session_id", fold_sessions, STATE, OUTPUT, delay, grace, idle, buckets).drop(*_FIELDS)
