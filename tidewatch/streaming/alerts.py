"""Live alerts: sessions are scored in the stream, gated, taken once, and written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewatch import dims
from tidewatch.operators import classify, risk, sequences, sessions


def score_stream(rows: DataFrame, emp: DataFrame, model: Model | None = None, names: list[str] | None = None) -> DataFrame:
    """A stream of session rows (event features, ``start_time``) with employee attributes, ``ts`` and ``risk_score``.

    The employee table is the static side of the join and is read anew for every micro-batch.  With a fitted classifier (raw features ``names``) its
    ``predicted_label``, ``confidence`` and ``top_predictions`` come along; fitting stays outside the stream.
    """
    out = risk.session_rule_risk(sessions.enrich_sessions(rows, emp), "risk_score").withColumn("ts", rows["start_time"])
    if model is not None:
        names = names or [c for c in dims.MODEL_FEATURES if c in rows.columns]
        out = classify.apply_model(sequences.clean_features(out, names), model, names)
    return out


def alert_stream(scored: DataFrame, threshold: float = dims.ALERT_THRESHOLD, watermark: str = "1 day") -> DataFrame:
    """Sessions at or above the alert threshold, each session id once.

    ``scored`` has ``session_id``, ``ts`` and ``risk_score``.
    """
    return (scored.where(f"risk_score >= {threshold}").withWatermark("ts", watermark)
            .dropDuplicatesWithinWatermark(["session_id"]))


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                 written: Callable[[int], None] | None = None) -> StreamingQuery:
    """Append alerts as Parquet, one folder a batch id: a batch that is repeated after a failure overwrites its own folder, so a
    restarted query writes no row twice.  ``written`` is called with the batch id once the batch is in place, before Spark commits it."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if written:
            written(batch_id)

    w = alerts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (w.trigger(availableNow=True) if available_now else w).start()
