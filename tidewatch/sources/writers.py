"""Writers.  Each has a ``*_layout`` function that shapes the rows (and can be
queried) and a ``write_*`` function that stores them as partitioned output."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims

_CSV = {"header": True, "escape": '"', "emptyValue": ""}
STAMP = "yyyy-MM-dd HH:mm:ss"


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def _json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _two(c: str) -> Column:
    return F.format_string("%.2f", F.col(c))


def _truth(c: str) -> Column:
    return F.when(F.col(c), "True").otherwise("False")


def dims_layout(emp: DataFrame, dev: DataFrame, res: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Employees, devices, resources as flat rows; lists joined by ``;``, profile as JSON."""
    hour = lambda c: F.format_string("%02d:00", F.col(c))
    e = emp.select("employee_uuid", "employee_id", "name", "department", "role", "office_location",
                   hour("work_start").alias("work_start_time"), hour("work_end").alias("work_end_time"),
                   F.concat_ws(";", "allowed_devices").alias("allowed_devices"), "preferred_browser", "preferred_os",
                   "vpn_probability", F.col("access_level") if "access_level" in emp.columns else F.lit(None).cast("string").alias("access_level"),
                   F.to_json(F.struct(F.array("work_start", "work_end").alias("working_hours"), "resource_probabilities")).alias("behavior_profile"))
    d = dev.select(*[c for c in ("device_uuid", "device_id", "device_type", "operating_system", "browser", "owner_id", "trusted") if c in dev.columns])
    r = res.withColumn("allowed_departments", F.concat_ws(";", "allowed_departments"))
    return e, d, r


def write_dims(emp: DataFrame, dev: DataFrame, res: DataFrame, path: str) -> None:
    for name, df in zip(("employees", "devices", "resources"), dims_layout(emp, dev, res)):
        _csv(df, f"{path}/{name}")


def sessions_layout(s: DataFrame) -> DataFrame:
    """19 text columns, numbers with two decimals."""
    return s.select("session_uuid", "session_id", "employee_uuid", "employee_id", "department", "role", "device_id", "browser",
                    "operating_system", "office_location", "login_method", _truth("remote_session").alias("remote_session"),
                    "day_of_week", F.date_format("start_time", STAMP).alias("start_time"), F.date_format("end_time", STAMP).alias("end_time"),
                    _two("duration_seconds").alias("duration_seconds"), _two("risk_score").alias("risk_score"),
                    _truth("is_anomalous").alias("is_anomalous"), "attack_type")


def write_sessions(s: DataFrame, path: str) -> None:
    _csv(sessions_layout(s), path)


def events_layout(e: DataFrame) -> DataFrame:
    """11 columns, the command list as JSON."""
    return e.select(F.col("employee_id").alias("entity_id"), "entity_type", F.date_format("ts", STAMP).alias("timestamp"),
                    F.col("ip_address").alias("source_ip"), "geo_location", F.coalesce("resource", F.lit("")).alias("resource_accessed"),
                    "auth_method", _two("session_duration").alias("session_duration"), F.to_json("command_sequence").alias("command_sequence"),
                    F.col("device_id").alias("device_fingerprint"), F.col("is_anomalous").cast("int").alias("label"))


def write_events(e: DataFrame, path: str) -> None:
    _csv(events_layout(e), path)


def features_layout(f: DataFrame) -> DataFrame:
    """Meta columns first."""
    return f.select(*dims.META_COLUMNS, *[c for c in f.columns if c not in dims.META_COLUMNS])


def write_features(raw: DataFrame, scaled: DataFrame, path: str) -> None:
    for name, df in (("tabular_features", raw), ("tabular_features_scaled", scaled)):
        _csv(features_layout(df), f"{path}/{name}")


def scores_layout(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reconstruction scores and binary predictions, rounded."""
    err, anom = F.round("reconstruction_error", 6).alias("reconstruction_error"), F.round("anomaly_score", 6).alias("anomaly_score")
    a = s.select("session_id", F.col("is_anomalous").cast("int").alias("is_anomalous"), "attack_type", F.round("risk_score", 4).alias("risk_score"),
                 err, anom, "predicted_label")
    b = s.select("session_id", "predicted_label", F.when(F.col("predicted_label") == 1, "Anomalous").otherwise("Normal").alias("prediction"), anom, err)
    return a, b


def write_scores(s: DataFrame, path: str) -> None:
    a, b = scores_layout(s)
    _csv(a, f"{path}/reconstruction_scores")
    _csv(b, f"{path}/anomaly_predictions")


def write_explanations(expl: DataFrame, path: str) -> None:
    """Nested records as JSON and the flat table as CSV."""
    from tidewatch.operators.explain import flatten_explanations

    _json(expl, f"{path}/session_explanations")
    _csv(flatten_explanations(expl), f"{path}/session_explanations_flat")


def campaigns_layout(camps: DataFrame, members: DataFrame, page_size: int = 1000) -> DataFrame:
    """Flat campaign rows; a campaign with more employees than a page gets one row per page."""
    from tidewatch.operators.campaigns import campaign_members

    m = campaign_members(members, "employee", page_size)
    return camps.join(m, "component").select(
        "campaign_id", "overall_severity", "session_count", "page", F.concat_ws(", ", "values").alias("affected_employees"),
        F.concat_ws(", ", "attack_types").alias("attack_types"), _truth("is_attack_chain").alias("is_attack_chain"))


def write_campaigns(camps: DataFrame, members: DataFrame, path: str, page_size: int = 1000) -> None:
    from tidewatch.operators.campaigns import attack_path, campaign_members

    ids = camps.select("component", "campaign_id")
    _json(camps, f"{path}/campaigns")
    for kind in ("employee", "ip", "device", "session"):
        _json(campaign_members(members, kind, page_size).join(ids, "component"), f"{path}/campaign_{kind}s")
    _json(attack_path(members, page_size).join(ids, "component"), f"{path}/campaign_paths")
    _csv(campaigns_layout(camps, members, page_size), f"{path}/campaign_summary")


def write_incidents(cards: DataFrame, sums: DataFrame, reports: DataFrame, path: str) -> None:
    """Cards and reports as JSON, executive summaries as CSV."""
    _json(cards, f"{path}/dashboard_cards")
    _csv(sums.select("session_id", "employee_id", "attack_type", "severity", "confidence", F.col("executive").alias("summary")), f"{path}/executive_summaries")
    _json(reports, f"{path}/incident_reports")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_stored(incidents: DataFrame, path: str, buckets: int = 64, key: str = "session_id") -> None:
    """Incidents as Parquet in one folder for each bucket of the key, the form that ``upsert_incidents`` changes."""
    rows = incidents.withColumn("bucket", _bucket(key, buckets))
    rows.repartitionByRange("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def upsert_incidents(live: DataFrame, path: str, order: str, buckets: int = 64, key: str = "session_id") -> None:
    """Puts live incidents into a table of ``write_stored`` (same ``buckets``): a live one replaces the stored one of its session,
    and of several live ones the first by ``order`` stays.

    Only buckets that live rows touch are read and replaced; files of the others stay.  The merged rows are checkpointed before the
    folders they come from are replaced.  One writer at a time.
    """
    if order not in live.columns:
        raise ValueError(f"live incidents lack the order column {order}")
    from tidewatch.lineage import checkpointed
    from tidewatch.operators.incidents import merge_live

    live = checkpointed(live.withColumn("bucket", _bucket(key, buckets)))
    touched = [r["bucket"] for r in live.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
    if not touched:
        return
    stored = live.sparkSession.read.parquet(path)
    merged = checkpointed(merge_live(live, stored.where(F.col("bucket").isin(touched)), key, order))
    extra = [order] if order not in stored.columns else []
    (merged.drop(*extra).repartitionByRange("bucket", key).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A metric, threshold or importance table."""
    _json(df, path) if fmt == "json" else _csv(df, path)


def write_merged(df: DataFrame, path: str) -> None:
    """The merged training set."""
    df.write.mode("overwrite").parquet(path)


def write_sequences(df: DataFrame, path: str) -> None:
    """Padded sequences with masks, keyed by session."""
    df.write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_scaler(spark, stats: dict[str, tuple[float, float]], path: str) -> None:
    from tidewatch.operators.sequences import scaler_table

    scaler_table(spark, stats).write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str) -> dict[str, tuple[float, float]]:
    """Scaler statistics: one row per feature, a bounded table."""
    return {r["feature"]: (r["mean"], r["sd"]) for r in spark.read.parquet(path).collect()}
