"""End-to-end plans over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.risk import severity
from tidewatch.lineage import checkpointed
from tidewatch.operators import adapt, behavior, classify, explain, features, scoring, sequences, sessions, tree_explain


def session_table(log: DataFrame, emp: DataFrame, gap_s: int = sessions.GAP_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(sessionised events, enriched session rows with all event features)."""
    events = sessions.sessionize(log, ["employee_id"], gap_s=gap_s)
    return events, sessions.enrich_sessions(features.event_features(events, keys=["employee_id"]), emp)


def feature_table(log: DataFrame, emp: DataFrame, gap_s: int = sessions.GAP_SECONDS) -> DataFrame:
    """The full vector: sessions, event features, drift scores, fused risk.

    The session rows are stored once: drift and the final join both read them,
    and recomputing them would shuffle the whole log again.
    """
    _, rows = session_table(log, emp, gap_s)
    rows = checkpointed(rows)
    drift = behavior.drift_scores(behavior.number_sessions(rows))
    return features.fuse_risk(rows, drift)


def external_sessions(raw: DataFrame, emp: DataFrame | None = None, gap_s: int = sessions.GAP_SECONDS):
    """Raw log of unknown layout to (match, internal events, sessionised events, sessions)."""
    match = adapt.detect_schema(raw.columns)
    internal = adapt.to_internal(raw, match)
    events = sessions.sessionize_auto(internal, gap_s, given=None if match.raw("session_id") else False)
    rows = sessions.build_sessions(events)
    return match, internal, events, rows if emp is None else sessions.enrich_sessions(rows, emp)


def score_sessions(events: DataFrame, feats: DataFrame, k: int = 8) -> DataFrame:
    """Reconstruction error and anomaly score per session: split, scale, fit, score."""
    split = sequences.one_class_split(feats.select("session_id", "is_anomalous"))
    train = split.where("split = 'train'").select("session_id")
    v = sequences.event_vectors(events).where(F.col("step") < sequences.MAX_LEN)
    stats = sequences.fit_step_scaler(v, train)
    x = v.select("session_id", "step", sequences.scale_vector("vec", stats).alias("x"))
    model = scoring.fit_reconstructor(x.join(train, "session_id", "left_semi"), k)
    err = scoring.masked_error(scoring.reconstruct(x, model))
    return scoring.minmax_score(err)


def classify_sessions(feats: DataFrame, kind: str = "linear", names: list[str] | None = None):
    """(model, predictions on all rows) of a class-weighted classifier on raw features."""
    names = names or [c for c in dims.MODEL_FEATURES if c in feats.columns]
    data = sequences.clean_features(feats, names)
    model = classify.fit_classifier(data, names, kind=kind)
    return model, classify.apply_model(data, model, names)


def explain_sessions(pred: DataFrame, model, names: list[str]) -> DataFrame:
    """Explanation records of predictions made by a linear classifier or a forest."""
    rows = tree_explain.explain_model(pred, model, names)
    return explain.attach_context(explain.narrate(explain.explanations(rows, names)))


def severity_of(df: DataFrame) -> DataFrame:
    """Severity column from confidence, anomaly score and risk."""
    return df.withColumn("severity", severity("confidence", "anomaly_score", "risk_score"))
