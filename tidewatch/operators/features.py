"""The per-session feature vector.

Every count, sum and ordered feature is an aggregate over the session's events,
so the whole vector needs one ``groupBy``.  Order-dependent features use the
position the sessioniser already assigned instead of another window, and sets
over bounded domains (24 resources, 15 event types) are bit masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.columns import (command_text, contains_any, nonblank, ordinal, ratio, seconds_between,
                                         suspicious_command)
from tidewatch.operators.sessions import destination, finish_sessions, session_aggs


def _is(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def _n(cond: Column, name: str) -> Column:
    return F.count_if(cond).cast("double").alias(name)


def _mask(c: str, values: list[str]) -> Column:
    """Bit mask with the bit of the value's ordinal set; 0 if unknown."""
    o = ordinal(c, values).cast("int")
    zero = F.lit(0).cast("long")
    return F.when(o >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), o)).otherwise(zero)


def _distinct(mark: str, value: Column, marks: set[str]) -> Column:
    """Distinct values of a session: a sum of first-occurrence marks if the
    sessioniser could set them, else a distinct count."""
    return (F.sum(mark) if mark in marks else F.countDistinct(value)).cast("double")


def event_aggs(dest: Column, marks: set[str]) -> list[Column]:
    """All aggregates of the vector; unused ones are pruned by the optimiser."""
    res, typ, pos = F.col("resource"), F.col("event_type"), F.col("pos")
    admin = res.isin(dims.ADMIN_RESOURCES)
    joined = command_text()
    cmd = F.when(joined != "", joined).otherwise(F.lower(F.coalesce("command_line", F.lit(""))))
    proc = F.when(joined != "", F.lower(F.coalesce(F.get("command_sequence", 0), F.lit("")))
                  ).otherwise(F.lower(F.coalesce("process_name", F.lit(""))))
    runs = (_is("ProcessStart") | (F.size("command_sequence") > 0)) & (cmd != "")
    malware = contains_any(cmd, dims.MALWARE_NAMES) | contains_any(proc, dims.MALWARE_NAMES)
    hits = sum([joined.contains(d).cast("int") for d in dims.C2_DOMAINS],
               F.coalesce(dest.isin(dims.C2_DOMAINS), F.lit(False)).cast("int"))
    up, down, wrote = F.col("bytes_transferred"), F.col("bytes_transferred"), F.col("bytes_written")
    return [
        # authentication
        _n(_is("Login") & (F.col("status") == "FAILED"), "failed_login_count"),
        _n(_is("Login") & (F.col("status") == "SUCCESS"), "successful_login_count"),
        # resources
        _n(res.isNotNull(), "total_resource_accesses"),
        F.bit_or(_mask("resource", dims.RESOURCES)).alias("resource_mask"),
        _n(admin, "admin_resource_accesses"),
        _n(res.isin(dims.SENSITIVE_RESOURCES), "sensitive_resource_accesses"),
        _n(res == "GitHub", "github_access_count"), _n(_is("DatabaseQuery"), "database_query_count"),
        _n(res == "Confluence", "confluence_access_count"), _n(res == "HRMS", "hrms_access_count"),
        _n(res == "ERP", "erp_access_count"),
        # files
        _n(_is("FileRead"), "files_read"), _n(_is("FileWrite"), "files_written"),
        _n(_is("FileUpload"), "files_uploaded"), _n(_is("FileDownload"), "files_downloaded"),
        F.sum(F.when(_is("FileUpload"), F.coalesce(up, F.lit(0.0))).when(
            _is("FileWrite"), F.coalesce(wrote, F.lit(0.0))).otherwise(0.0)).alias("total_upload_bytes"),
        F.sum(F.when(_is("FileDownload"), F.coalesce(down, F.lit(0.0))).otherwise(0.0)).alias("total_download_bytes"),
        # processes
        _n(_is("ProcessStart"), "processes_started"), _n(_is("ProcessStop"), "processes_stopped"),
        _n(runs & (cmd.contains("powershell") | proc.contains("powershell")), "powershell_executions"),
        _n(runs & suspicious_command(cmd, proc), "suspicious_process_count"),
        _n(runs & malware, "malware_execution_count"),
        # inputs of the rule risk
        _n(F.col("bytes_transferred") > dims.LARGE_TRANSFER_BYTES, "large_transfers"),
        _n(_is("ProcessStart") & suspicious_command(F.lower(F.coalesce("command_line", F.lit(""))),
                                                    F.lower(F.coalesce("process_name", F.lit("")))), "suspicious_starts"),
        # network; a C2 domain in both the command and the destination counts twice
        _n(_is("NetworkConnect", "NetworkDisconnect"), "network_connections"),
        _n(_is("VPNConnect"), "vpn_connections"), _n(_is("VPNDisconnect"), "vpn_disconnections"),
        _distinct("new_dest", dest, marks).alias("unique_destination_ips"),
        _distinct("new_ip", nonblank("ip_address"), marks).alias("unique_source_ips"),
        F.sum(hits).cast("double").alias("external_connections"),
        F.sum(F.when(_is("ApiCall"), hits).otherwise(0)).cast("double").alias("beaconing_event_count"),
        # timing
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("average_time_between_events"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("maximum_idle_time"),
        F.coalesce(F.min("gap"), F.lit(0.0)).alias("minimum_idle_time"),
        # mix
        F.bit_or(_mask("event_type", dims.EVENT_TYPES)).alias("type_mask"),
        _n(_is("Login", "Logout"), "_login"), _n(typ.startswith("File"), "_file"),
        _n(_is("ProcessStart", "ProcessStop"), "_proc"), _n(typ.contains("onnect"), "_net"),
        _n(_is("ResourceAccess"), "_res"),
        # order
        F.min_by(ordinal("event_type", dims.EVENT_TYPES), pos).alias("first_event_type"),
        F.max_by(ordinal("event_type", dims.EVENT_TYPES), pos).alias("last_event_type"),
        F.min(F.when(_is("ResourceAccess"), F.col("ts"))).alias("_first_access"),
        F.min(F.when(admin, pos)).alias("_p_admin"), F.min(F.when(_is("FileDownload"), pos)).alias("_p_down"),
        F.min(F.when(_is("ProcessStart"), pos)).alias("_p_proc"),
    ]


def session_features(s: DataFrame) -> DataFrame:
    """Attributes of the session row itself (10 features)."""
    day = F.weekday("start_time").cast("double")
    return (s.withColumn("session_duration", F.col("duration_seconds"))
            .withColumn("login_hour", F.hour("start_time").cast("double"))
            .withColumn("logout_hour", F.hour("end_time").cast("double"))
            .withColumn("day_of_week", day)
            .withColumn("weekend_flag", F.when(day >= 5, 1.0).otherwise(0.0))
            .withColumn("vpn_used", F.when(F.col("login_method") == "VPN", 1.0).otherwise(0.0))
            .withColumn("remote_session", F.col("remote_session").cast("double"))
            .withColumn("login_method", F.col("vpn_used"))
            .withColumn("browser", ordinal("browser", dims.BROWSERS))
            .withColumn("operating_system", ordinal("operating_system", dims.OPERATING_SYSTEMS))
            .withColumn("department", ordinal("department", dims.DEPARTMENTS)))


def _finish(s: DataFrame) -> DataFrame:
    n = F.col("n_events")
    minutes = F.greatest(F.lit(1.0), F.col("duration_seconds") / 60)
    hour = F.hour("start_time")

    def position(p: str) -> Column:
        return F.coalesce((F.col(p) - F.col("_p0")) / n, F.lit(-1.0))

    return (s.withColumn("authentication_attempts", F.col("failed_login_count") + F.col("successful_login_count"))
            .withColumn("failed_login_ratio", ratio("failed_login_count", "authentication_attempts"))
            .withColumn("unique_resources", F.bit_count("resource_mask").cast("double"))
            .withColumn("upload_download_ratio", ratio("total_upload_bytes", "total_download_bytes"))
            .withColumn("total_events", n.cast("double"))
            .withColumn("events_per_minute", n / minutes)
            .withColumn("off_hours_access", F.when((hour < 7) | (hour > 20), 1.0).otherwise(0.0))
            .withColumn("session_start_hour", hour.cast("double"))
            .withColumn("unique_event_types", F.bit_count("type_mask").cast("double"))
            .withColumn("login_event_ratio", F.col("_login") / n)
            .withColumn("file_event_ratio", F.col("_file") / n)
            .withColumn("process_event_ratio", F.col("_proc") / n)
            .withColumn("network_event_ratio", F.col("_net") / n)
            .withColumn("resource_event_ratio", F.col("_res") / n)
            .withColumn("event_sequence_length", n.cast("double"))
            .withColumn("login_to_first_resource_time",
                        F.coalesce(seconds_between("_first_access", "start_time"), F.lit(-1.0)))
            .withColumn("admin_access_position", position("_p_admin"))
            .withColumn("file_download_position", position("_p_down"))
            .withColumn("process_execution_position", position("_p_proc"))
            .drop("_login", "_file", "_proc", "_net", "_res", "_p0", "_first_access", "_p_admin", "_p_down",
                  "_p_proc", "type_mask"))


def event_features(events: DataFrame, floor_s: float | None = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Session rows plus every event-derived feature, one ``groupBy``.

    ``events`` is the output of a sessioniser (``session_id``, ``pos``, ``gap``, ``lead``).
    Name the sessioniser's ``keys``: grouping by them as well lets the aggregate
    use the partitioning the sessioniser left, so there is no second shuffle.
    """
    by = list(keys or [])
    agg = events.groupBy(*by, "session_id", "lead").agg(*session_aggs(), *event_aggs(destination(events), set(events.columns)))
    agg = agg.drop(*by).withColumn("_p0", F.col("lead.pos"))
    return _finish(finish_sessions(agg, floor_s))


def fuse_risk(features: DataFrame, drift: DataFrame) -> DataFrame:
    """Join drift scores, add the fused risk, order columns: the full vector."""
    from tidewatch.functions.risk import attack_severity, fused_risk

    f = features.join(drift.select("session_id", "behaviour_score", *dims.BEHAVIOUR_FEATURES), "session_id", "left")
    f = f.na.fill(0.0, [*dims.BEHAVIOUR_FEATURES, "behaviour_score"])
    sev = F.when(F.col("is_anomalous"), attack_severity("attack_type")).otherwise(0.0)
    f = f.withColumn("risk_score", fused_risk("behaviour_score", sev))
    f = session_features(f)
    return f.select("session_id", "employee_id", F.col("is_anomalous").cast("double").alias("is_anomalous"),
                    "attack_type", "risk_score", *dims.FEATURES)


def feature_catalogue(spark, documented: dict[str, tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """Category and description of every feature.

    Without an entry the description is the name with spaces and the category
    is ``Session``.  ``documented`` adds or overrides (category, description, fields).
    """
    cat = {f: c for c, fs in dims.FEATURE_CATEGORY.items() for f in fs}
    rows = []
    for i, f in enumerate(dims.MODEL_FEATURES):
        c, d, src = (documented or {}).get(f, (None, None, []))
        rows.append((i, f, c or cat.get(f, "Session"),
                     d or dims.FEATURE_DESCRIPTION.get(f, f.replace("_", " ")), list(src)))
    return spark.createDataFrame(rows, "feature_no int, feature string, category string, "
                                       "description string, source_fields array<string>")


def session_context(features: DataFrame, sessions: DataFrame) -> DataFrame:
    """Nested context record per session (event ids: :func:`session_event_ids`)."""
    s = sessions.select("session_id", "entity_type", "office_location", "device_id", "duration_seconds", "start_time")
    return features.join(s, "session_id").select(
        "session_id",
        F.struct(F.col("employee_id").alias("entity_id"), "entity_type", "office_location",
                 F.col("device_id").alias("device_fingerprint"), "duration_seconds",
                 F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time")).alias("session_context"),
        F.struct(F.col("risk_score").alias("integrated_risk_score"), "attack_type",
                 (F.col("is_anomalous") == 1.0).alias("is_anomalous")).alias("risk_metadata"),
        F.struct(*dims.BEHAVIOUR_FEATURES).alias("deviations"))


def session_event_ids(events: DataFrame, page_size: int = 1000) -> DataFrame:
    """Event ids of each session in order, in pages of bounded length."""
    from tidewatch.operators.ordering import paged_lists

    numbered = events.withColumn("_i", F.col("pos") - F.col("lead.pos"))
    return paged_lists(numbered, ["session_id"], "_i", "event_id", "event_ids", page_size)
