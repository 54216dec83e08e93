"""Registered queries: every operator on the test tables.

Each entry takes (spark, sf_dir) and reads the whole tables.  Doubles are
rounded so that two engines with different summation order agree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions import normalise as nz
from tidewatch.functions import risk as rf
from tidewatch.functions.columns import micros, uuid4_text
from tidewatch.lineage import checkpointed, work_folder
from tidewatch.operators import (adapt, behavior, campaigns, classify, explain, features, incidents, metrics, org, quality, risk,
                                 scoring, sequences, sessions, tree_explain)
from tidewatch.sources import demo_tables as demo
from tidewatch.sources import readers, writers
from tidewatch.sources.json_documents import write_json_documents

GAP = 21_600  # seconds; gives sessions of several events on the test log
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- shared inputs ---------------------------------------------------------------

def _log(s, d):
    return demo.activity_log(s, d)


def _emp(s, d):
    return demo.employees(s, d)


def _events(s, d):
    return sessions.sessionize(_log(s, d), ["employee_id"], gap_s=GAP)


def _rows(s, d):
    return sessions.enrich_sessions(features.event_features(_events(s, d), keys=["employee_id"]), _emp(s, d))


def _num(s, d):
    return behavior.number_sessions(_rows(s, d))


def _vector(s, d):
    from tidewatch.plans.pipeline import feature_table

    return feature_table(_log(s, d), _emp(s, d), GAP)


def _scored(s, d):
    """Session rows with rule risk, a rule-made prediction and scores."""
    return (risk.session_rule_risk(_rows(s, d), "risk_score")
            .withColumn("predicted_label", sequences.clean_label("attack_type"))
            .withColumn("confidence", F.round(0.5 + (F.col("n_events") % 10) * 0.05, 4))
            .withColumn("anomaly_score", F.round(F.least(F.lit(1.0), F.col("duration_seconds") / 86400), 4))
            .withColumn("severity", rf.severity("confidence", "anomaly_score", "risk_score")))


def _incidents(s, d):
    names = ["failed_login_count", "total_upload_bytes", "powershell_executions", "admin_resource_accesses"]
    feats = F.filter(F.array(*[F.when(F.col(n) > 0, F.struct(F.lit(n).alias("feature"))) for n in names]), lambda x: x.isNotNull())
    i = _scored(s, d).withColumn("positive_contributors", feats).withColumn("attack_type", F.col("predicted_label"))
    return i.select("session_id", "employee_id", "attack_type", "confidence", "anomaly_score", "risk_score", "severity",
                    "device_id", F.col("start_time").alias("ts"), "duration_seconds", "positive_contributors",
                    F.hour("start_time").alias("session_start_hour"))


def _linked(s, d):
    """Anomalous incidents with the IP of their last event, stored once: the table
    at this stage boundary is small and read many times."""
    ip = _events(s, d).groupBy("session_id").agg(F.max_by("ip_address", "pos").alias("source_ip"))
    return checkpointed(incidents.anomalous(_incidents(s, d)).join(ip, "session_id"))


def _members(s, d):
    inc = _linked(s, d)
    comp = campaigns.components(campaigns.runs(inc))
    return checkpointed(campaigns.drop_minor(inc.join(comp, "session_id")))


def _scores(s, d):
    li = table(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"),
                     (F.col("l_returnflag") == "R").cast("int").alias("label"))


NF, NC = 64, 10  # embedding dimensions, all used as features; classes
STEPS = 50       # steps of a sequence


def _emb(s, d):
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("int").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(NF)],
                    F.array(*[reduce(add, [F.col("embedding")[i].cast("double") for i in range(c, NF, NC)]) for c in range(NC)]).alias("probs"))


def _weights():
    """Fixed class weights of a linear score."""
    return [[((c * 7 + f * 3) % 11 - 5) / 10 for f in range(NF)] for c in range(NC)]


def _attr(s, d):
    e = _emb(s, d)
    names = [f"x{i}" for i in range(NF)]
    return explain.attribute(e, list(range(NC)), _weights(), names, explain.feature_means(e, names), key="vec_id")


# --- sources and sinks --------------------------------------------------------------

@query
def src_columns(s, d):
    return readers.read_cols(s, f"{d}/customer.parquet", ["c_custkey", "c_mktsegment", "no_such_column"])


@query
def src_alignment(s, d):
    rows = _rows(s, d)
    v = sequences.event_vectors(_events(s, d))  # one employee's sequences carry foreign ids
    odd = F.when(F.col("employee_id") == "EMP-0007", F.concat("session_id", F.lit("-X"))).otherwise(F.col("session_id"))
    seq = sequences.build_sequences(v.withColumn("session_id", odd))
    return sequences.sequence_alignment(rows, seq)


@query
def snk_dims(s, d):
    e, _, _ = writers.dims_layout(_emp(s, d), demo.devices(_log(s, d)), demo.resources(s))
    return e.select("employee_id", "employee_uuid", "work_start_time", "work_end_time", "allowed_devices", "department")


@query
def snk_sessions(s, d):
    rows = _rows(s, d).withColumn("risk_score", F.lit(0.0))
    return writers.sessions_layout(rows)


@query
def snk_events(s, d):
    e = _log(s, d).withColumn("session_duration", F.lit(0.0))
    return writers.events_layout(e).withColumn("source_ip", F.col("source_ip"))


@query
def snk_features(s, d):
    f = writers.features_layout(_vector(s, d))
    known = ["session_id", "employee_id", "attack_type"]
    return f.select(F.lit(len(f.columns)).cast("long").alias("n_columns"), F.lit(f.columns[4]).alias("fifth"), *known,
                    *[F.round(F.col(c) + 1.7e-8, 4).alias(c) for c in ["risk_score", *dims.FEATURES]])


@query
def snk_scores(s, d):
    x = _scored(s, d).withColumn("reconstruction_error", F.col("duration_seconds") / 1000)
    a, _ = writers.scores_layout(scoring.flag(x, 20.0))
    return a


@query
def snk_explanations(s, d):
    i = _incidents(s, d).withColumnRenamed("attack_type", "prediction").withColumn("true_label", F.col("prediction"))
    full = F.transform("positive_contributors", lambda c: F.struct(
        c["feature"].alias("feature"), F.lit(1.5).alias("value"), F.lit("Session").alias("category"),
        F.lit("Negligible").alias("impact"), F.lit(0.0).alias("attribution")))
    i = i.withColumn("positive_contributors", full).withColumn("negative_contributors", F.slice("positive_contributors", 1, 1))
    flat = explain.flatten_explanations(explain.attach_mitre(i))
    return flat.select("session_id", "prediction", "mitre_tactic", "mitre_technique_id", "top_pos_feature_1", "top_pos_value_1",
                       "top_pos_feature_2", "top_pos_feature_5", "top_neg_feature_1", "top_neg_feature_2")


@query
def snk_campaigns(s, d):
    m = _members(s, d)
    c = campaigns.assign_campaign_ids(campaigns.campaigns(m))
    return writers.campaigns_layout(c, m).withColumn("page", F.col("page").cast("long"))


# --- schema adaptation -----------------------------------------------------------------

def _texts(s, d):
    """Order dates as text in the nine layouts, epochs, ISO text and junk."""
    t = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    o = table(s, d, "orders").select("o_orderkey", t.alias("t"), (F.col("o_orderkey") % 14).alias("kind"))
    f = dims.TIMESTAMP_FORMATS
    case = None
    for i, p in enumerate(f):
        case = F.when(F.col("kind") == i, F.date_format("t", p)) if case is None else case.when(F.col("kind") == i, F.date_format("t", p))
    secs = F.floor(micros("t") / 1_000_000)
    case = (case.when(F.col("kind") == 9, secs.cast("string")).when(F.col("kind") == 10, (secs * 1000).cast("string"))
            .when(F.col("kind") == 11, F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
            .when(F.col("kind") == 12, F.lit("not a date")).otherwise(F.lit("")))
    return o.select("o_orderkey", case.alias("text"))


@query
def adp_timestamps(s, d):
    return _texts(s, d).select("o_orderkey", F.floor(micros(nz.normalize_ts("text")) / 1_000_000).alias("epoch_s"))


def _actions(s, d):
    words = ["user_login_success", "session_logoff", "data_exfil_push", "http_post", "file_access_read", "modify_file", "cmd_exec",
             "kill_proc", "sql_select", "vpn_connect", "api_call", "view_page", "zzz", ""]
    pick = F.array(*[F.lit(w) for w in words])
    return _log(s, d).select(
        "event_id", "k", F.get(pick, F.col("k") % len(words)).alias("action"),
        F.when(F.col("k") % 3 == 0, F.lit("orders_db")).when(F.col("k") % 3 == 1, F.lit("report.csv")).alias("res"),
        F.when(F.col("k") % 5 == 0, F.lit("C:/tool.EXE")).when(F.col("k") % 5 == 1, F.lit("ls")).alias("cmd"))


@query
def adp_event_types(s, d):
    return _actions(s, d).select("event_id", nz.normalize_event_type("action", "res", "cmd").alias("event_type"))


@query
def adp_status(s, d):
    words = F.array(*[F.lit(w) for w in ["failed", "FAILURE", "0", "False", "denied", "ok", "SUCCESS"]])
    return _log(s, d).select("event_id", nz.normalize_status(F.get(words, F.col("k") % 8)).alias("status"))


@query
def adp_internal(s, d):
    raw = table(s, d, "events")
    i = adapt.to_internal(raw, adapt.detect_schema(raw.columns))
    return i.select(F.col("extra")["event_id"].cast("long").alias("event_id"), "employee_id", "event_type", "device_id",
                    "ip_address", "geo_location", "auth_method", "status", "bytes_transferred", "resource",
                    F.map_contains_key("extra", F.lit("props")).alias("has_props"), micros("ts").alias("ts_us"))


@query
def adp_report(s, d):
    raw = table(s, d, "events")
    match = adapt.detect_schema(raw.columns)
    i = adapt.to_internal(raw, match)
    ev = sessions.sessionize(i, ["employee_id", "device_id"])
    built = sessions.build_sessions(ev)
    return adapt.adapter_report(raw, i, built, match, built).select(  # a session table without features: a warning
        "features_present", "features_ordered", "total_rows", "mapped_rows", "skipped_rows", "sessions_built", "unique_employees", "compatibility_score",
        "compatibility_level", "pipeline_status")


@query
def adp_skipped(s, d):
    """The report on a log where every seventh row has no readable time."""
    raw = table(s, d, "events").withColumn("ts", F.when(F.col("event_id") % 7 == 0, "no time").otherwise(F.col("ts").cast("string")))
    match = adapt.detect_schema(raw.columns)
    i = adapt.to_internal(raw, match)
    built = sessions.build_sessions(sessions.sessionize(i, ["employee_id", "device_id"]))
    return adapt.adapter_report(raw, i, built, match).select("total_rows", "mapped_rows", "skipped_rows", "sessions_built", "unique_employees", "pipeline_status")


def _export(s, d):
    """The log in the export layout with blanks in several alternative columns."""
    k = F.col("k")
    return _log(s, d).select(
        F.when(k % 4 == 0, F.lit("")).otherwise(F.col("employee_id")).alias("entity_id"),
        F.when(k % 8 != 0, F.col("employee_id")).alias("employee_id"), F.lit("USER-X").alias("user_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("ip_address")).alias("source_ip"),
        F.when(k % 2 == 0, F.lower(F.col("resource"))).otherwise(F.lit("Mystery")).alias("resource_accessed"),
        F.when(k % 5 == 0, F.lit("oops")).otherwise((k * 2).cast("string")).alias("session_duration"),
        F.when(k % 6 == 0, F.lit('["a b","c"]')).when(k % 6 == 1, F.lit("plain cmd")).when(k % 6 == 2, F.lit("  ")).alias("command_sequence"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.col("device_id")).alias("device_fingerprint"),
        F.when(k % 3 == 0, F.lit("Yes")).when(k % 3 == 1, F.lit("0")).alias("label"),
        F.when(k % 5 < 2, F.lit("")).when(k % 5 == 2, F.lit("Strange")).otherwise(F.col("event_type")).alias("event_type"),
        "status", F.col("event_id").cast("string").alias("event_uuid"))


@query
def adp_standardize(s, d):
    z = adapt.standardize(_export(s, d))
    return z.select(F.col("event_uuid").cast("long").alias("event_id"), "employee_id", "ip_address", "resource", "session_duration",
                    F.size("command_sequence").cast("long").alias("n_commands"), "device_id", "is_anomalous", "event_type", "status",
                    "geo_location", "auth_method", F.unix_timestamp("ts").alias("epoch_s"))


@query
def adp_labels(s, d):
    words = F.array(*[F.lit(w) for w in ["1", "TRUE", "yes", "Anomalous", "no", "0"]])
    return _log(s, d).select("event_id", nz.parse_label(F.get(words, F.col("k") % 7)).cast("long").alias("label"))


@query
def adp_commands(s, d):
    c = nz.parse_commands(F.col("command_sequence"))
    return _export(s, d).select(F.col("event_uuid").cast("long").alias("event_id"), F.size(c).cast("long").alias("n"),
                                F.get(c, 0).alias("first"))


@query
def adp_infer_type(s, d):
    c = nz.parse_commands(F.col("command_sequence"))
    return _export(s, d).select(F.col("event_uuid").cast("long").alias("event_id"),
                                nz.infer_event_type("event_type", c, "resource_accessed").alias("event_type"))


@query
def adp_enum(s, d):
    messy = (F.when(F.col("k") % 3 == 0, F.concat(F.lit("  "), F.upper("resource"))).when(F.col("k") % 3 == 1, F.lower("resource"))
             .otherwise(F.concat(F.col("resource"), F.lit("?"))))
    return _log(s, d).select("event_id", nz.coerce_enum(messy, dims.RESOURCES).alias("resource"))


# --- sessions ------------------------------------------------------------------------------

@query
def ses_gap(s, d):
    ev = sessions.sessionize(_log(s, d), ["employee_id"])
    return ev.select("event_id", "session_no", "pos", F.round("gap", 6).alias("gap"))


@query
def ses_hot_keys(s, d):
    """Sessions where a third of all rows has no employee and a third of all times are equal, through the sliced layout."""
    log = (_log(s, d).withColumn("employee_id", F.when(F.col("event_id") % 3 != 0, F.col("employee_id")))
           .withColumn("ts", F.when(F.col("event_id") % 6 < 2, F.to_timestamp(F.lit("2024-05-05 10:00:00"))).otherwise(F.col("ts"))))
    cut = sessions.sessionize(log, ["employee_id"], gap_s=GAP, min_rows=500)
    return cut.select("event_id", "employee_id", "pos", F.col("session_no").cast("long").alias("session_no"), F.col("new_ip").cast("long").alias("new_ip"))


@query
def ses_employee_device(s, d):
    return sessions.sessionize(_log(s, d), ["employee_id", "device_id"], gap_s=GAP).select("event_id", "session_id")


@query
def ses_given(s, d):
    sid = F.when(F.col("k") % 10 >= 3, F.concat(F.lit("G-"), F.col("employee_id"), F.lit("-"), F.col("k") % 7))
    return sessions.sessionize_auto(_log(s, d).withColumn("session_id", sid)).select("event_id", "session_id", "pos", r("gap"))


@query
def ses_build(s, d):
    b = sessions.build_sessions(_events(s, d))
    return b.select("session_id", "employee_id", "device_id", "office_location", "login_method", "remote_session", "day_of_week",
                    "n_events", r("duration_seconds"), micros("start_time").alias("start_us"))


@query
def ses_recorded_duration(s, d):
    ev = _events(s, d).withColumn("session_duration", F.when(F.col("k") % 2 == 0, F.col("value")).otherwise(0.0))
    return sessions.recorded_duration(ev).select("session_id", r("duration_seconds"))


@query
def ses_labels(s, d):
    return sessions.session_labels(_events(s, d).withColumn("risk_score", F.col("value"))).select(
        "session_id", "is_anomalous", "attack_type", r("risk_score"))


@query
def ses_numbers(s, d):
    ev = _events(s, d)
    rows = ev.groupBy("employee_id", "session_no", "session_id").agg(F.min("event_id").alias("first_event"))
    return sessions.assign_session_ids(rows, ["employee_id"]).select("session_id", "session_ref", "session_number")


def _unknown(emp, n: int) -> DataFrame:
    """Every n-th employee under another id, so that its sessions find no match."""
    return emp.withColumn("employee_id", F.when(F.col("employee_no") % n == 0, F.concat("employee_id", F.lit("-X"))).otherwise(F.col("employee_id")))


@query
def ses_enrich(s, d):
    b = sessions.build_sessions(_events(s, d))
    return sessions.enrich_sessions(b, _unknown(_emp(s, d), 9)).select("session_id", "department", "role", "browser", "operating_system")


def _hourly(s, d):
    return _events(s, d).withColumn("ts", F.date_trunc("hour", "ts"))


@query
def ses_dedup_timestamps(s, d):
    return sessions.dedup_timestamps(_hourly(s, d)).select("event_id", "session_id", "new_second")


@query
def ses_extended_bounds(s, d):
    return sessions.extended_bounds(sessions.dedup_timestamps(_hourly(s, d)))


@query
def ses_summary(s, d):
    x = sessions.run_summary(sessions.build_sessions(_events(s, d)))
    return x.select("sessions", "events", "employees", *[r(c) for c in ("avg_minutes", "office_share", "vpn_share", "anomaly_share",
                                                                       "sessions_per_employee", "events_per_session")])


# --- features -----------------------------------------------------------------------------------

def _part(names):
    def run(s, d):
        rows = features.session_features(_rows(s, d)) if names is dims.SESSION_FEATURES else _rows(s, d)
        if names is dims.AUTH_FEATURES:
            rows = rows.withColumn("login_method", F.when(F.col("login_method") == "VPN", 1.0).otherwise(0.0))
        # the nudge keeps means of microsecond values off exact rounding ties
        return rows.select("session_id", *[F.round(F.col(c) + 1.7e-8, 6).alias(c) for c in names])
    return run


for _name, _cols in {"fea_session": dims.SESSION_FEATURES, "fea_auth": dims.AUTH_FEATURES, "fea_resource": dims.RESOURCE_FEATURES,
                     "fea_file": dims.FILE_FEATURES, "fea_process": dims.PROCESS_FEATURES, "fea_network": dims.NETWORK_FEATURES,
                     "fea_temporal": dims.TEMPORAL_FEATURES, "fea_ratio": dims.RATIO_FEATURES, "fea_order": dims.ORDER_FEATURES}.items():
    QUERIES[_name] = _part(_cols)


@query
def fea_vector(s, d):
    return _vector(s, d).select("session_id", "employee_id", "is_anomalous", "attack_type",
                                *[F.round(F.col(c) + 1.7e-8, 4).alias(c) for c in ["risk_score", *dims.FEATURES]])


EVENT_FEATURES = [f for f in dims.FEATURES if f not in dims.SESSION_FEATURES + dims.BEHAVIOUR_FEATURES + ["login_method"]]


@query
def fea_catalogue(s, d):
    p = metrics.column_profile(_rows(s, d), EVENT_FEATURES).select(F.col("column").alias("feature"), r("mean", 3))
    return features.feature_catalogue(s).join(p, "feature", "left").select("feature", "category", "description", "mean")


@query
def fea_context(s, d):
    rows = _rows(s, d)
    return features.session_context(_vector(s, d), rows).select(
        "session_id", "session_context.entity_id", "session_context.device_fingerprint", "session_context.start_time",
        F.round("risk_metadata.integrated_risk_score", 4).alias("risk"), "risk_metadata.is_anomalous",
        F.round("deviations.device_deviation", 4).alias("device_deviation"))


@query
def fea_event_ids(s, d):
    return features.session_event_ids(_events(s, d), 3).select("session_id", "page", F.array_join("event_ids", ",").alias("event_ids"))


# --- behaviour --------------------------------------------------------------------------------------

@query
def beh_personal(s, d):
    b = behavior.personal_baseline(_rows(s, d))
    return b.select("employee_id", "sessions", "hour_min", "hour_max", "mean_actions", *[r(c) for c in (
        "weekend_share", "remote_share", "mean_minutes", "sd_minutes", "sd_actions")])


@query
def beh_shares(s, d):
    return behavior.baseline_shares(_rows(s, d), _events(s, d)).select("employee_id", "kind", "value", r("share"))


@query
def beh_asof(s, d):
    b = behavior.baseline_asof(_num(s, d))
    return b.select("session_id", "n_before", *[r(c, 4) for c in (
        "mean_hour", "weekend_share", "remote_share", "mean_minutes", "sd_minutes", "mean_actions", "sd_actions",
        "location_share", "device_share", "browser_share", "operating_system_share", "method_share")])


@query
def beh_history(s, d):
    return behavior.baseline_history(_num(s, d))


@query
def beh_department(s, d):
    return behavior.group_baseline(_emp(s, d), "department")


@query
def beh_department_resources(s, d):
    return behavior.department_resources_baseline(_emp(s, d)).select("department", "resource", r("probability"))


@query
def beh_role(s, d):
    return behavior.group_baseline(_emp(s, d), "role")


@query
def beh_organisation(s, d):
    return behavior.group_baseline(_emp(s, d))


@query
def beh_effective(s, d):
    return behavior.effective_baseline(_num(s, d), _emp(s, d))


@query
def beh_drift(s, d):
    return behavior.drift_scores(_num(s, d)).select("session_id", "n_before", "accepted", *[r(c) for c in dims.DEVIATIONS], r("behaviour_score"))


@query
def beh_window_deviations(s, d):
    return behavior.window_deviations(_num(s, d)).select("session_id", *[r(c) for c in dims.DEVIATIONS], r("behaviour_score"))


@query
def beh_novelty(s, d):
    return behavior.novelty_flags(_num(s, d)).select("session_id", *dims.DEVIATIONS)


@query
def beh_working_hours(s, d):
    e = _emp(s, d).select("employee_id", "work_start", "work_end")
    return _log(s, d).join(e, "employee_id").select(
        "event_id", rf.in_working_hours(F.hour("ts"), "work_start", "work_end").alias("in_hours"))


@query
def beh_access(s, d):
    return behavior.access_violations(_log(s, d), _emp(s, d), demo.resources(s))


# --- risk --------------------------------------------------------------------------------------------

@query
def rsk_rule(s, d):
    return risk.rule_risk(_events(s, d), _rows(s, d), _emp(s, d)).select("session_id", "attack_type", "rule_risk")


@query
def rsk_fused(s, d):
    x = _scored(s, d)
    sev = F.when(F.col("is_anomalous"), rf.attack_severity("attack_type")).otherwise(0.0)
    fused = rf.fused_risk("risk_score", sev, F.col("anomaly_score") * 100, F.col("confidence") * 100)
    return x.select("session_id", F.round(fused, 4).alias("fused_risk"))


@query
def rsk_severity(s, d):
    return _scored(s, d).select("session_id", "severity")


@query
def rsk_gate(s, d):
    x = _incidents(s, d).withColumn("top3", F.array(F.struct(F.col("attack_type").alias("attack"), F.col("confidence").alias("probability"))))
    x = explain.attach_mitre(x, "attack_type")
    g = risk.alert_gate(x)
    return g.select("session_id", "attack_type", "severity", F.coalesce("mitre.tactic", F.lit("")).alias("tactic"),
                    F.size("investigation_steps").cast("long").alias("n_steps"), F.size("top3").cast("long").alias("n_top"),
                    F.col("top3")[0]["attack"].alias("top_1"), F.round(F.col("top3")[0]["probability"], 4).alias("top_1_prob"))


@query
def rsk_worst_stage(s, d):
    return risk.worst_stage(_events(s, d).where("attack_type != 'None'"), ["session_id"])


@query
def rsk_bands(s, d):
    return _scored(s, d).select("session_id", rf.confidence_band(F.col("confidence") * 100).alias("confidence_band"),
                                rf.risk_band("risk_score").alias("risk_band"))


@query
def rsk_impact(s, d):
    return _emb(s, d).select("vec_id", *[rf.impact_label(f"x{i}").alias(f"impact_{i}") for i in range(NF)])


@query
def rsk_at_least(s, d):
    return risk.at_least(_scored(s, d), "medium").select("session_id", "severity")


@query
def rsk_severity_counts(s, d):
    return risk.severity_counts(_scored(s, d))


# --- sequences, scaling, splits, encodings ------------------------------------------------------------

@query
def seq_vectors(s, d):
    v = sequences.event_vectors(_events(s, d))
    return v.select("session_id", "step", F.posexplode("vec").alias("dim", "v")).where("v != 0").select("session_id", "step", "dim", r("v"))


def _padded(events):
    q = sequences.build_sequences(sequences.event_vectors(events), STEPS)
    total = F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, x: a + x)
    return q.select("session_id", F.size("seq").cast("long").alias("n_steps"), F.size("mask").cast("long").alias("n_mask"),
                    F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).alias("mask_sum"), F.round(total, 4).alias("total"),
                    F.round(F.element_at(F.element_at("seq", 2), 19), 6).alias("second_delta"))


@query
def seq_padded(s, d):
    return _padded(_events(s, d))


@query
def scl_features(s, d):
    x = _rows(s, d).select("session_id", "total_upload_bytes", "total_events", "processes_stopped", "events_per_minute")
    z = sequences.scale(x, sequences.fit_scaler(x, ["session_id"]))
    return z.select("session_id", *[r(c, 5) for c in z.columns if c != "session_id"])


@query
def scl_steps(s, d):
    ev = _events(s, d)
    v = sequences.event_vectors(ev)
    normal = sessions.session_labels(ev.withColumn("risk_score", F.lit(0.0))).where("not is_anomalous")
    stats = sequences.fit_step_scaler(v, normal)
    q = sequences.scale_steps(sequences.build_sequences(v, STEPS), stats)
    return q.select("session_id", *[F.round(F.col("seq")[i][j], 5).alias(f"s{i}_{j}") for i, j in ((0, 0), (0, 18), (1, 2), (1, 17), (49, 0), (49, 20))],
                    F.round(F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query
def spl_stratified(s, d):
    return sequences.stratified_split(_rows(s, d).select("session_id", "attack_type"), "attack_type")


@query
def spl_one_class(s, d):
    return sequences.one_class_split(_rows(s, d).select("session_id", "is_anomalous"))


@query
def enc_ordinal(s, d):
    return sequences.encode_ordinal(_log(s, d).select("event_id", "resource"), "resource").select("event_id", F.col("resource_code").cast("long").alias("code"))


@query
def enc_clean(s, d):
    x = table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_linenumber") == 2, float("inf"))
        .when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_quantity")).alias("q"),
        F.when(F.col("l_linenumber") == 4, "none").when(F.col("l_linenumber") == 5, "None").otherwise(F.col("l_returnflag")).alias("attack_type"))
    return sequences.clean_features(x, ["q"])


@query
def enc_weights(s, d):
    return sequences.class_weights(_rows(s, d).select("session_id", "attack_type"), "attack_type").select("session_id", r("weight"))


@query
def enc_vector(s, d):
    from pyspark.ml.functions import vector_to_array

    v = sequences.feature_vector(_rows(s, d).select("session_id", "total_events", "files_read"), ["total_events", "absent", "files_read"])
    a = vector_to_array("features")
    return v.select("session_id", a[0].alias("f0"), a[1].alias("f1"), a[2].alias("f2"))


# --- reconstruction scoring and thresholds ---------------------------------------------------------------

def _steps(s, d):
    """Scaled steps with the mean step (zero) as their reconstruction."""
    v = sequences.event_vectors(_events(s, d)).where(F.col("step") < sequences.MAX_LEN)
    stats = sequences.fit_step_scaler(v)
    zero = F.array(*[F.lit(0.0)] * sequences.VECTOR_DIMS)
    return v.select("session_id", "step", sequences.scale_vector("vec", stats).alias("x")).withColumn("xhat", zero)


def _masked(loss):
    def run(s, d):
        return scoring.masked_error(_steps(s, d), loss=loss).select("session_id", r("reconstruction_error", 5))
    return run


for _loss in ("mse", "mae", "huber"):
    QUERIES[f"sco_masked_{_loss}"] = _masked(_loss)


@query
def sco_reconstruct(s, d):
    """Scaler and model fitted on the normal training sessions, all sessions scored."""
    from tidewatch.plans.pipeline import score_sessions

    return score_sessions(_events(s, d), _rows(s, d)).select("session_id", r("reconstruction_error"), r("anomaly_score"))


def _order(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, steps of the normal training sessions, split)."""
    steps = checkpointed(scoring.transitions(_events(s, d)))
    split = checkpointed(sequences.one_class_split(_rows(s, d).select("session_id", "is_anomalous")))
    return steps, steps.join(split.where("split = 'train'"), "session_id", "left_semi"), split


@query
def sco_transitions(s, d):
    """Cost of the order of events, by transitions of normal training sessions; all sessions."""
    steps, train, _ = _order(s, d)
    return scoring.transition_error(steps, scoring.fit_transitions(train)).select("session_id", r("order_error"))


@query
def sco_order_auc(s, d):
    """Ranking of the held-out sessions by order of events, and by types alone."""
    steps, train, split = _order(s, d)
    test = split.where("split = 'test'").select("session_id", F.col("is_anomalous").cast("int").alias("label"))
    order = scoring.transition_error(steps, scoring.fit_transitions(train))
    single = scoring.transition_error(steps, scoring.fit_types(train), ["after"])
    parts = [metrics.roc_auc(x.join(test, "session_id").select(F.round("order_error", 7).alias("e"), "label"), "e", "label").select(F.lit(n).alias("by"), r("roc_auc"))
             for n, x in (("order", order), ("types", single))]
    return parts[0].unionByName(parts[1])


@query
def sco_all_components(s, d):
    """With as many components as dimensions nothing is lost."""
    v = sequences.event_vectors(_events(s, d)).where(F.col("step") < sequences.MAX_LEN)
    x = v.select("session_id", "step", sequences.scale_vector("vec", sequences.fit_step_scaler(v)).alias("x"))
    err = scoring.masked_error(scoring.reconstruct(x, scoring.fit_reconstructor(x, 21)))
    return err.select("session_id", F.abs(F.round("reconstruction_error", 5)).alias("reconstruction_error"))


def _errors(s, d):
    return _rows(s, d).select("session_id", "is_anomalous", (F.col("duration_seconds") / 1000).alias("reconstruction_error"))


@query
def sco_minmax(s, d):
    return scoring.minmax_score(_errors(s, d)).select("session_id", r("anomaly_score"))


@query
def sco_calibrated(s, d):
    return _errors(s, d).select("session_id", F.round(scoring.calibrated_score("reconstruction_error", 1.0, 30.0, 20.0), 6).alias("score"),
                                scoring.calibrated_score("reconstruction_error", 1.0, 1.0, 20.0).alias("degenerate"))


@query
def sco_flag(s, d):
    return scoring.flag(_errors(s, d), 20.0).select("session_id", F.col("predicted_label").cast("long").alias("predicted_label"), "prediction")


@query
def sco_merge(s, d):
    e = scoring.minmax_score(_errors(s, d)).withColumn("session_id", F.when(F.col("is_anomalous"), F.col("session_id")).otherwise(F.concat("session_id", F.lit("-X"))))
    return scoring.merge_scores(_rows(s, d).select("session_id", "total_events"), e).select(
        "session_id", "total_events", r("reconstruction_error", 5), r("anomaly_score", 5))


@query
def thr_f1(s, d):
    return metrics.f1_threshold(_scores(s, d), "score", "label").select("threshold", r("f1", 8))


@query
def thr_youden(s, d):
    return metrics.youden_threshold(_scores(s, d), "score", "label").select("threshold", r("youden", 8))


@query
def thr_percentile(s, d):
    return metrics.percentile_threshold(_scores(s, d).where("label = 0"), "score").select(r("threshold", 4))


@query
def thr_compare(s, d):
    x = _scores(s, d)
    return metrics.compare_thresholds(x.where("label = 0"), x, "score", "label").select(
        "method", r("threshold", 4), r("f1"), r("precision"), r("recall"))


@query
def thr_composite(s, d):
    x = _scores(s, d)
    f1, auc = metrics.f1_threshold(x, "score", "label").select("f1"), metrics.roc_auc(x, "score", "label")
    return f1.crossJoin(auc).select(F.round(rf.composite("f1", "roc_auc"), 6).alias("composite"))  # one row each


# --- metrics -------------------------------------------------------------------------------------------------

@query
def met_binary(s, d):
    x = _scores(s, d).withColumn("pred", (F.col("score") > 40000).cast("int"))
    return metrics.binary_metrics(x, "pred", "label").select("tn", "fp", "fn", "tp", r("precision"), r("recall"), r("f1"))


@query
def met_roc(s, d):
    return metrics.roc_curve(_scores(s, d), "score", "label").select("threshold", r("fpr"), r("tpr"))


@query
def met_roc_auc(s, d):
    return metrics.roc_auc(_scores(s, d), "score", "label").select(r("roc_auc"))


@query
def met_pr(s, d):
    return metrics.pr_curve(_scores(s, d), "score", "label").select("threshold", r("precision"), r("recall"))


@query
def met_pr_auc(s, d):
    return metrics.pr_auc(_scores(s, d), "score", "label").select(r("pr_auc"))


def _pred(s, d):
    return classify.predict(_emb(s, d), list(range(NC))).withColumn("predicted_label", F.col("predicted_label").cast("int"))


@query
def met_confusion(s, d):
    return metrics.confusion(_pred(s, d), "predicted_label", "label")


@query
def met_normalised(s, d):
    return metrics.normalised_confusion(metrics.confusion(_pred(s, d), "predicted_label", "label")).select("true_label", "predicted_label", r("share"))


@query
def met_class_report(s, d):
    return metrics.class_report(_pred(s, d), "predicted_label", "label").select("class", "support", r("precision"), r("recall"), r("f1"))


@query
def met_averages(s, d):
    a = metrics.averages(metrics.class_report(_pred(s, d), "predicted_label", "label"))
    return a.select(*[r(c) for c in a.columns])


@query
def met_ovr_auc(s, d):
    return metrics.ovr_auc(_emb(s, d), "probs", "label").select("class", r("roc_auc"))


@query
def met_ovr_pr(s, d):
    x = metrics.explode_classes(_emb(s, d), "probs", "label")
    return metrics.pr_auc(x, "score", "hit", "class").select("class", r("pr_auc"))


@query
def met_histogram(s, d):
    return metrics.histogram(_scores(s, d), "score", 60, "label").select("label", "bin", "n", r("left_edge", 4), r("right_edge", 4))


@query
def met_histogram_density(s, d):
    return metrics.histogram(_scores(s, d), "score", 50, density=True).select("bin", "n", F.round(F.col("density") * 1e6, 5).alias("density"))


@query
def met_moving_average(s, d):
    x = table(s, d, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("total"))
    m = metrics.moving_average(x, "total", micros("o_orderdate"), [], 5)
    return m.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), r("moving_avg", 3))


@query
def met_distribution(s, d):
    return metrics.class_distribution(_rows(s, d), "attack_type")


@query
def met_profile(s, d):
    cols = ["session_duration", "total_upload_bytes", "total_events", "failed_login_ratio"]
    p = metrics.column_profile(_rows(s, d).withColumn("session_duration", F.col("duration_seconds")), cols)
    return p.select("column", "rows", "nulls", "infinite", r("mean", 3), r("sd", 3), r("min", 3), r("max", 3))


def _fused(s, d):
    x = _scored(s, d)
    return x.select("session_id", "employee_id", F.col("is_anomalous").cast("int").alias("is_anomalous"), "attack_type", "risk_score")


@query
def met_risk_by_attack(s, d):
    return metrics.risk_by_attack(_fused(s, d)).select("attack_type", "n", r("mean_risk"), "min_risk", "max_risk")


@query
def met_risk_by_label(s, d):
    return metrics.risk_by_label(_fused(s, d)).select("is_anomalous", "n", r("mean_risk"))


@query
def met_normal_with_risk(s, d):
    return metrics.normal_with_risk(_fused(s, d), 10)


# --- classification -----------------------------------------------------------------------------------------------

@query
def cls_top_k(s, d):
    p = classify.predict(_emb(s, d), list(range(NC)))
    return p.select("vec_id", F.posexplode("top_predictions").alias("place", "t")).select(
        "vec_id", "place", F.col("t.attack").cast("int").alias("class"), F.round("t.probability", 4).alias("probability"))


@query
def cls_table(s, d):
    p = classify.predict(_emb(s, d), [str(i) for i in range(NC)]).withColumn("truth", F.col("label").cast("string"))
    t = classify.prediction_table(p, "truth", "vec_id")
    return t.withColumn("correct", F.col("correct").cast("long"))


def _model_rows(s, d):
    f = _rows(s, d).withColumn("session_duration", F.col("duration_seconds"))
    return f.select("session_id", sequences.clean_label("attack_type").alias("attack_type"), *EVENT_FEATURES)


@query
def cls_fit_predict(s, d):
    """Fitted on the training split, applied to the others."""
    data = checkpointed(_model_rows(s, d))
    split = checkpointed(sequences.stratified_split(data.select("session_id", "attack_type"), "attack_type").select("session_id", "split"))
    train = data.join(split.where("split = 'train'"), "session_id", "left_semi")
    model = classify.fit_classifier(train, EVENT_FEATURES, kind="forest", params={"numTrees": 20})
    rest = data.join(split.where("split != 'train'"), "session_id", "left_semi")
    return classify.prediction_table(classify.apply_model(rest, model, EVENT_FEATURES))


@query
def cls_importance(s, d):
    data = checkpointed(_model_rows(s, d))
    model = classify.fit_classifier(data, EVENT_FEATURES, kind="forest", params={"numTrees": 20})
    return classify.importance(model, EVENT_FEATURES, 20)


@query
def cls_fit_summary(s, d):
    split = checkpointed(sequences.stratified_split(checkpointed(_model_rows(s, d)), "attack_type"))
    train, val = split.where("split = 'train'"), split.where("split = 'val'")
    model = classify.fit_classifier(train, EVENT_FEATURES, kind="forest", params={"numTrees": 20})
    return classify.fit_summary(classify.apply_model(train, model, EVENT_FEATURES), classify.apply_model(val, model, EVENT_FEATURES))


# --- attribution ---------------------------------------------------------------------------------------------------

@query
def exp_attribution(s, d):
    return _attr(s, d).select("vec_id", "class", "feature", r("phi"))


@query
def exp_forest(s, d):
    """Forest fitted on all sessions; how far the attributions of a session's classes are from prediction less expectation, and how many features they name."""
    from pyspark.ml.functions import vector_to_array

    data = checkpointed(_model_rows(s, d))
    model = classify.fit_classifier(data, EVENT_FEATURES, kind="forest", params={"numTrees": 20})
    classes = classify.class_names(model)
    forest = tree_explain.read_forest(model, len(classes))
    sums = tree_explain.attribute(data, forest, classes, EVENT_FEATURES).groupBy("session_id", "class").agg(F.sum("phi").alias("phi"), F.count("feature").alias("n"))
    scored = model.stages[-1].transform(sequences.feature_vector(data, EVENT_FEATURES)).select("session_id", vector_to_array("probability").alias("p"))
    table = F.array(*[F.struct(F.lit(c).alias("class"), (F.get("p", F.lit(i)) - forest.expected[i]).alias("rest")) for i, c in enumerate(classes)])
    both = scored.select("session_id", F.inline(table)).join(sums, ["session_id", "class"], "left")
    return both.groupBy("session_id").agg(F.round(F.max(F.abs(F.coalesce("phi", F.lit(0.0)) - F.col("rest"))), 9).alias("off"), (F.max("n") > 0).alias("explained"))


@query
def exp_join(s, d):
    x = _rows(s, d).select("session_id", "attack_type")
    p = _scored(s, d).select(F.when(F.col("n_events") > 1, F.col("session_id")).otherwise(F.concat("session_id", F.lit("-X"))).alias("session_id"), "predicted_label", "confidence")
    return explain.join_predictions(x, p)


@query
def exp_global(s, d):
    return explain.global_importance(_attr(s, d)).select("feature", r("mean_abs_phi"), F.col("rank").cast("long").alias("rank"))


@query
def exp_class(s, d):
    c = explain.class_importance(_attr(s, d), list(range(NC)))
    return c.select("feature", F.col("rank").cast("long").alias("rank"), *[F.round(F.col(str(i)), 6).alias(f"class_{i}") for i in range(NC)])


@query
def exp_moments(s, d):
    e = _emb(s, d)
    names = [f"x{i}" for i in range(NF)]
    m = explain.importance_from_moments(e, list(range(NC)), _weights(), names, explain.feature_means(e, names))
    return m.select("class", "feature", r("mean_abs_phi"))


@query
def exp_contributors(s, d):
    e = _pred(s, d)
    names = [f"x{i}" for i in range(NF)]
    a = explain.attribute_predicted(e, list(range(NC)), _weights(), names, explain.feature_means(e, names))
    c = explain.contributors(a, names, 10)
    one = lambda n: c.select("vec_id", F.lit(n).alias("side"), F.posexplode(f"{n}_contributors").alias("place", "c"))
    return one("positive").unionByName(one("negative")).select(
        "vec_id", "side", "place", "c.feature", "c.description", "c.category", F.round("c.value", 3).alias("value"),
        F.round("c.attribution", 3).alias("attribution"))


@query
def exp_most(s, d):
    return explain.most_attributed(_attr(s, d), "vec_id").select("vec_id", r("mean_abs_phi"))


@query
def exp_one(s, d):
    return explain.explain_session(_scored(s, d).select("session_id", "severity", "risk_score"), "EMP-0003-S2")


@query
def exp_mitre(s, d):
    x = explain.attach_mitre(_scored(s, d), "predicted_label")
    return x.select("session_id", F.col("mitre.technique_id").alias("technique_id"), F.size("investigation_steps").cast("long").alias("n_steps"),
                    F.col("investigation_steps")[0].alias("first_step"))


def _explained(s, d):
    from tidewatch.plans.pipeline import explain_sessions

    # model columns and scores of a session come from one pass over the log
    scores = ["anomaly_score", "risk_score"]
    rows = checkpointed(_scored(s, d).withColumn("session_duration", F.col("duration_seconds"))
                        .select("session_id", sequences.clean_label("attack_type").alias("attack_type"), *EVENT_FEATURES, *scores))
    data = rows.drop(*scores)
    model = classify.fit_classifier(data, EVENT_FEATURES, kind="linear")
    if rows.groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1 OR session_id IS NULL").isEmpty():
        pred = classify.apply_model(rows, model, EVENT_FEATURES)
    else:   # a session with several rows has each of its predictions with each of its scores
        pred = classify.apply_model(data, model, EVENT_FEATURES).join(rows.select("session_id", *scores), "session_id")
    return explain_sessions(pred, model, EVENT_FEATURES)


@query
def exp_pipeline(s, d):
    """Fit a linear classifier, attribute and explain every session."""
    return _explained(s, d).select("session_id", "prediction", "nl_explanation", "summary", "context.top_features")


def _records(s, d):
    """Explanation-like records whose contributors come from a rule, not a model."""
    def full(side):
        return F.transform(side, lambda c: F.struct(
            c["feature"].alias("feature"), F.replace(c["feature"], F.lit("_"), F.lit(" ")).alias("description"), F.lit("Session").alias("category"),
            F.lit(2.5).alias("value"), F.lit(0.2).alias("attribution"), F.lit("Medium Positive").alias("impact")))
    i = _incidents(s, d).withColumn("positive_contributors", full("positive_contributors"))
    return explain.attach_mitre(i.withColumn("negative_contributors", F.slice("positive_contributors", 1, 1)), "attack_type")


@query
def exp_narrate(s, d):
    x = explain.narrate(_records(s, d).withColumnRenamed("attack_type", "prediction"))
    return explain.attach_context(x).select("session_id", "nl_explanation", "summary", "context.mitre_tactic",
                                            F.array_join("context.top_features", ",").alias("top_features"))


# --- incidents ----------------------------------------------------------------------------------------------------------

def _wide(s, d):
    x = _scored(s, d)
    return x.select("session_id", F.col("predicted_label").alias("top_1"), F.col("confidence").alias("top_1_prob"),
                    F.when(F.col("n_events") % 2 == 0, "").otherwise("Brute Force").alias("top_2"), F.lit(0.125).alias("top_2_prob"),
                    F.lit(None).cast("string").alias("top_3"), F.lit(None).cast("double").alias("top_3_prob"))


def _built(s, d):
    expl = _incidents(s, d).withColumnRenamed("attack_type", "prediction").select(
        "session_id", "prediction", "confidence", "severity", "risk_score", "anomaly_score", "positive_contributors")
    feats = _rows(s, d).select(
        F.when(F.col("n_events") != 3, F.col("session_id")).otherwise(F.concat("session_id", F.lit("-X"))).alias("session_id"), "employee_id", F.when(F.col("n_events") > 1, 12.5).otherwise(0.0).alias("risk_score"), "session_start_hour",
        F.col("duration_seconds").alias("session_duration"))
    return incidents.build_incidents(expl, _wide(s, d), feats)


@query
def inc_build(s, d):
    return _built(s, d).select("session_id", "employee_id", "attack_type", "severity", "risk_score", F.size("top3").cast("long").alias("n_top"),
                               F.col("session_start_hour").cast("long").alias("session_start_hour"), r("session_duration_minutes", 4))


@query
def inc_lookup(s, d):
    ids = _rows(s, d).select(F.when(F.col("n_events") == 1, F.concat("session_id", F.lit("-X"))).otherwise(F.col("session_id")).alias("session_id"))
    return incidents.lookup(_incidents(s, d), ids).select("session_id", "employee_id", "attack_type", "confidence", "severity", "risk_score")


@query
def inc_top3(s, d):
    w = _wide(s, d)
    return w.select("session_id", F.inline(incidents.top3(w)))


@query
def inc_anomalous(s, d):
    return incidents.anomalous(_incidents(s, d)).select("session_id", "attack_type")


@query
def inc_by_severity(s, d):
    return incidents.by_severity(_incidents(s, d), "HIGH").select("session_id", "severity")


@query
def inc_high_critical(s, d):
    return incidents.high_critical(_incidents(s, d)).select("session_id", "severity")


@query
def inc_merge_live(s, d):
    i = _incidents(s, d).select("session_id", "attack_type", "severity", "risk_score")
    live = i.where("attack_type = 'Beaconing C2'").withColumn("severity", F.lit("Critical"))
    return incidents.merge_live(live, i)


def _recommended(s, d):
    return incidents.recommend(_incidents(s, d), incidents.default_playbooks(s))


@query
def inc_recommend(s, d):
    x = _recommended(s, d)
    return x.select("session_id", F.size("immediate_containment").cast("long").alias("n_contain"), F.size("investigation").cast("long").alias("n_investigate"),
                    F.col("immediate_containment")[0].alias("first_step"), F.element_at("investigation", -1).alias("last_check"),
                    F.col("remediation")[0].alias("remediation"), "estimated_impact")


@query
def inc_priority(s, d):
    return _recommended(s, d).select("session_id", "priority_action")


@query
def inc_cards(s, d):
    x = explain.attach_mitre(_recommended(s, d), "attack_type")
    full = F.transform("positive_contributors", lambda c: F.struct(c["feature"].alias("feature"), F.lit(1.0).alias("value"), F.lit("Low Positive").alias("impact")))
    x = x.withColumn("positive_contributors", full)
    c = incidents.cards(x, incidents.summaries(x))
    return c.select("session_id", "employee", "attack_type", "severity", "confidence", "risk_score", "recommended_action",
                    "mitre_tactic", "mitre_technique", F.size("top_features").cast("long").alias("n_features"))


def _full(s, d):
    x = _records(s, d).withColumn("session_duration_minutes", F.col("duration_seconds") / 60)
    x = x.withColumn("top3", F.array(F.struct(F.col("attack_type").alias("attack"), F.col("confidence").alias("probability"))))
    return incidents.recommend(x, incidents.default_playbooks(s))


@query
def inc_summaries(s, d):
    return incidents.summaries(_full(s, d)).select("session_id", "dashboard", "executive", "soc", "email")


@query
def inc_report_sections(s, d):
    x = incidents.split_sections(incidents.report(_full(s, d)))
    return x.select("session_id", F.size("sections").cast("long").alias("n_sections"), *[
        F.col("sections")[k].alias(k) for k in ("incident_overview", "severity_assessment", "mitre_att&ck_mapping".replace("&", "and"),
                                                "key_shap_evidence", "containment_actions", "potential_business_impact")])


@query
def inc_serialise(s, d):
    x = _incidents(s, d)
    return x.select("session_id", F.get_json_object(incidents.serialise(x.drop("positive_contributors")), "$.severity").alias("severity"))


# --- campaigns -----------------------------------------------------------------------------------------------------------

@query
def cor_fill(s, d):
    i = _incidents(s, d)
    x = i.select("session_id", "employee_id", F.lit("").alias("source_ip"), F.when(F.col("risk_score") > 50, F.col("device_id")).alias("device_id"),
                 F.when(F.col("risk_score") > 50, F.col("ts")).alias("ts"), "session_start_hour")
    return campaigns.fill_keys(x).select("session_id", "source_ip", "device_id", micros("ts").alias("ts_us"))


@query
def cor_links(s, d):
    return campaigns.links(_linked(s, d))


@query
def cor_components(s, d):
    return campaigns.components(campaigns.runs(_linked(s, d)))


@query
def cor_drop_minor(s, d):
    return _members(s, d).select("session_id", "component")


@query
def cor_campaigns(s, d):
    c = campaigns.campaigns(_members(s, d))
    return c.select("component", "session_count", "n_employees", "n_ips", "n_devices", "overall_severity", "is_attack_chain",
                    F.array_join("attack_types", ",").alias("attack_types"), F.array_join("mitre_tactics", ",").alias("mitre_tactics"),
                    micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"),
                    F.array_join("detection_basis", ",").alias("detection_basis"))


CHAINS = [["Malware Execution", "Beaconing C2"], ["Brute Force", "Data Exfiltration", "Malware Execution"],
          ["Suspicious PowerShell", "Lateral Movement"]]


@query
def cor_chain(s, d):
    return campaigns.attack_chains(_members(s, d), CHAINS).select("component", F.col("chain_no").cast("long").alias("chain_no"))


@query
def cor_path(s, d):
    return campaigns.attack_path(_members(s, d)).select("component", F.array_join("path", " > ").alias("path"))


@query
def cor_members(s, d):
    m = _members(s, d)
    parts = [campaigns.campaign_members(m, k, 5).select("component", F.lit(k).alias("kind"), "page", F.array_join("values", ",").alias("values"))
             for k in ("employee", "ip", "device", "session")]
    return quality.union_rules(*parts)


@query
def cor_ids(s, d):
    m = _members(s, d)
    first = m.groupBy("component").agg(F.min("ts").alias("first_seen"))
    return campaigns.assign_campaign_ids(first).select("component", "campaign_id")


@query
def cor_first_values(s, d):
    return campaigns.first_values(_members(s, d), "device_id").select("component", F.array_join("first_device_id", ",").alias("first_devices"))


@query
def cor_text(s, d):
    m = _members(s, d)
    c = campaigns.campaign_text(campaigns.assign_campaign_ids(campaigns.campaigns(m)), m)
    return c.select("campaign_id", "summary", F.array_join("recommended_actions", "\n").alias("actions"))


# --- data quality ----------------------------------------------------------------------------------------------------------

@query
def dq_session_keys(s, d):
    rows = _rows(s, d).withColumn("session_uuid", F.when(F.col("n_events") == 4, "bad").otherwise(F.col("session_uuid")))
    return quality.check_session_keys(rows, _unknown(_emp(s, d), 10))


@query
def dq_work_hours(s, d):
    return quality.check_work_hours(_rows(s, d), _emp(s, d))


@query
def dq_session_values(s, d):
    x = _rows(s, d).withColumn("browser", F.when(F.col("n_events") == 2, "Netscape").otherwise(F.col("browser")))
    return quality.check_session_values(x)


@query
def dq_overlap(s, d):
    x = _rows(s, d).withColumn("input_no", F.floor(F.col("duration_seconds")))
    return quality.check_overlap(x)


@query
def dq_event_shape(s, d):
    return quality.check_event_shape(_events(s, d), _rows(s, d))


@query
def dq_events(s, d):
    ev = _events(s, d).withColumn("input_no", F.col("event_id").bitwiseXOR(F.lit(1))).withColumn(
        "event_uuid", F.when(F.col("event_id") % 97 == 0, "bad").otherwise(uuid4_text("event_id")))
    return quality.check_events(ev, _rows(s, d), "input_no")


def _labelled(s, d):
    ev = _events(s, d).withColumn("risk_score", F.when(F.col("is_anomalous"), 50.0).otherwise(F.when(F.col("k") == 1, 3.0).otherwise(0.0)))
    rows = _rows(s, d).withColumn("risk_score", F.when(F.col("is_anomalous"), 50.0).otherwise(F.when(F.col("n_events") == 5, 7.0).otherwise(0.0)))
    return ev, rows


@query
def dq_labels(s, d):
    return quality.check_labels(*_labelled(s, d))


@query
def dq_risk(s, d):
    ev, rows = _labelled(s, d)
    return quality.check_risk(ev, rows, _emp(s, d))


@query
def dq_organisation(s, d):
    emp = _emp(s, d).withColumn("office_location", F.when(F.col("employee_no") % 50 == 0, "Moon").otherwise(F.col("office_location")))
    return quality.check_organisation(emp, demo.devices(_log(s, d)), demo.resources(s), [f"Office-{i}" for i in range(5)])


@query
def dq_features(s, d):
    x = _rows(s, d).select("session_id", "employee_id", "attack_type", F.col("duration_seconds").alias("session_duration"),
                           F.when(F.col("n_events") == 3, float("nan")).otherwise(F.col("failed_login_ratio")).alias("failed_login_ratio"),
                           F.when(F.col("n_events") == 2, -0.5).otherwise(F.col("admin_access_position")).alias("admin_access_position"),
                           F.when(F.col("n_events") == 4, "many").otherwise("1").alias("files_read"))
    return quality.check_features(x)


@query
def dq_merged(s, d):
    x = _rows(s, d).select("session_id", "attack_type", "is_anomalous", "total_events",
                           F.when(F.col("n_events") == 3, float("nan")).otherwise(1.0).alias("reconstruction_error"),
                           F.when(F.col("n_events") == 4, float("inf")).otherwise(1.0).alias("anomaly_score"))
    return quality.check_merged(x.unionByName(x.where("n_events = 6")), ["total_events", "reconstruction_error", "anomaly_score"]).select(
        "n_rows", "n_nan", "n_inf", "n_duplicate_sessions", "n_classes", "passed")


@query
def dq_label_gaps(s, d):
    x = _fused(s, d).withColumn("attack_type", F.when(F.col("risk_score") > 90, "none").otherwise(F.col("attack_type"))).withColumn(
        "risk_score", F.when(F.col("risk_score") < 85, 0.0).otherwise(F.col("risk_score")))
    return quality.check_label_gaps(x)


# --- organisation -----------------------------------------------------------------------------------------------------------

@query
def dim_employee(s, d):
    e = _emp(s, d)
    keys = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("U-"), F.md5(F.col("user_id").cast("string"))))
                                        .when(F.col("event_id") % 3 == 1, F.format_string("EMP-%04d", F.col("user_id"))).otherwise("nobody").alias("key"))
    return org.get_employee(keys, e).select("event_id", "employee_id", "department")


@query
def dim_devices(s, d):
    return org.devices_of(_emp(s, d), demo.devices(_log(s, d))).select("employee_id", "device_no", "device_id", "device_type", "trusted")


@query
def dim_devices_of_one(s, d):
    return org.devices_of(_emp(s, d), demo.devices(_log(s, d)), "EMP-0003").select("employee_id", "device_no", "device_id")


@query
def dim_members(s, d):
    return org.department_members(_emp(s, d))


@query
def dim_managers(s, d):
    return org.managers(_emp(s, d))


@query
def dim_department_resources(s, d):
    """Accesses per department allowed to use the resource."""
    b = org.department_resources(demo.resources(s))
    use = _log(s, d).where("resource IS NOT NULL").groupBy(F.col("resource").alias("resource_name")).agg(F.count("*").alias("n"))
    return b.join(use, "resource_name").select("department", "resource_name", "n")


@query
def dim_resources(s, d):
    use = _log(s, d).where("resource IS NOT NULL").groupBy(F.col("resource").alias("resource_name")).agg(F.count("*").alias("n"))
    return org.all_resources(demo.resources(s)).join(use, "resource_name", "left").select("resource_name", "resource_type", "sensitivity_level", "n")


@query
def dim_policy(s, d):
    hours = behavior.group_baseline(_emp(s, d), "department")
    return org.department_policy(hours, "IT")


@query
def dim_primary_device(s, d):
    return _emp(s, d).select("employee_id", org.primary_device().alias("primary_device"))


# --- written and read again -----------------------------------------------------------------------------------------------------

@query
def io_events(s, d):
    path = work_folder(s, "events")
    writers.write_events(_log(s, d).withColumn("session_duration", F.lit(0.0)), path)
    e = readers.read_events(s, path)
    return e.select("entity_id", "entity_type", "timestamp", "source_ip", "geo_location", F.coalesce("resource_accessed", F.lit("")).alias("resource_accessed"),
                    "auth_method", "session_duration", "command_sequence", "device_fingerprint", F.col("label").cast("int").alias("label"))


@query
def io_external(s, d):
    """The raw log as JSON lines, all columns as text."""
    path = f"{work_folder(s, 'log')}/log.jsonl"
    table(s, d, "events").select("event_id", "user_id", "event_type").write.json(path)
    return readers.read_external(s, path).select("event_id", "user_id", "event_type")


@query
def io_documents(s, d):
    """The raw log as arrays in JSON documents, all columns, read back in pieces."""
    path = f"{work_folder(s, 'log')}/log.json"
    e = table(s, d, "events")
    write_json_documents(e.select([F.col(c).cast("string").alias(c) for c in ("event_id", "user_id", "event_type", "props")]
                                  + [micros("ts").cast("string").alias("us"), F.round(F.col("value") * 100).cast("long").cast("string").alias("cents")])
                         .repartition(max(3, -(-e.count() // 1_000_000)), "event_id"), path)   # documents of about a million records
    return readers.read_external(s, path)


@query
def io_employees(s, d):
    path = work_folder(s, "dims")
    writers.write_dims(_emp(s, d), demo.devices(_log(s, d)), demo.resources(s), path)
    e = readers.read_employees(s, f"{path}/employees")
    return e.select("employee_id", "employee_uuid", "department", F.col("work_start").cast("long").alias("work_start"), F.col("work_end").cast("long").alias("work_end"),
                    F.array_join("allowed_devices", ";").alias("allowed_devices"))


@query
def io_features(s, d):
    path = work_folder(s, "features")
    v = _vector(s, d)
    writers.write_features(v, v, path)
    f = readers.read_features(s, f"{path}/tabular_features", [c for c in v.columns if c not in dims.META_COLUMNS])
    return f.select("session_id", "employee_id", "attack_type", *[F.round(F.col(c) + 1.7e-8, 4).alias(c) for c in ["risk_score", *dims.FEATURES]])


@query
def io_sequences(s, d):
    path = work_folder(s, "sequences")
    writers.write_sequences(sequences.build_sequences(sequences.event_vectors(_events(s, d)), STEPS), path)
    q = readers.read_sequences(s, path)
    return q.select("session_id", F.size("seq").cast("long").alias("n_steps"), F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).alias("mask_sum"))


@query
def io_incidents(s, d):
    """Cards, summaries and reports; the summaries come back from CSV, the cards from JSON."""
    path = work_folder(s, "incidents")
    x = _incidents(s, d).withColumn("executive", F.concat(F.lit('Case "'), F.col("session_id"), F.lit('", '), F.col("severity")))
    writers.write_incidents(x.select("session_id", "severity"), x, x.select("session_id", "attack_type"), path)
    sums = s.read.options(header=True, escape='"').csv(f"{path}/executive_summaries").select("session_id", "attack_type", "summary")
    return sums.join(s.read.json(f"{path}/dashboard_cards"), "session_id").join(
        s.read.json(f"{path}/incident_reports").withColumnRenamed("attack_type", "report"), "session_id")


@query
def io_metrics(s, d):
    path = work_folder(s, "metrics")
    writers.write_metrics(_scores(s, d).groupBy("label").agg(F.count("*").alias("n")), path)
    return s.read.json(path).select(F.col("label").cast("int").alias("label"), "n")


# --- streaming -----------------------------------------------------------------------------------------------------------------

def _drain(s, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to the end of its source and return the written rows."""
    base = work_folder(s, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{base}/out")


def _stream(s, df: DataFrame, name: str, by: str = "ts", files: int = 4, closing: DataFrame | None = None, mixed: bool = False) -> DataFrame:
    """A batch table as a stream of time ranges, one range a trigger; rows without a time are in the first.

    Ranges are written one after the other, because the file source takes files by age, each as equally many files of about a million rows.  ``df`` is read for
    each of them: callers store it.  ``mixed``: every other row comes a range later than its time.  ``closing`` rows make one more trigger at the end.
    """
    base = f"{work_folder(s, name)}/in"
    t = micros(by)
    rows, quantiles = df.agg(F.count("*"), F.percentile_approx(t, [i / files for i in range(1, files)], 10_000)).first()
    cuts = sorted(set(quantiles or []))
    part = sum(((t > c).cast("int") for c in cuts), F.lit(0))
    if mixed:
        part = part + F.pmod(F.xxhash64(*df.columns), F.lit(2))
    each, ranges = -(-rows // (files * 1_000_000)) or 1, df.withColumn("_part", F.coalesce(part, F.lit(0)))
    for k in range(len(cuts) + 1 + mixed):
        ranges.where(F.col("_part") == k).drop("_part").repartition(each).write.mode("append").parquet(base)
    if closing is not None:
        closing.repartition(each).write.mode("append").parquet(base)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(base)


def _end(df: DataFrame, by: str, key: str = "employee_id") -> DataFrame:
    """A row far in the future, which moves the watermark past all that is held."""
    last = df.agg((F.max(by) + F.expr("INTERVAL 7300 DAYS")).alias(by))
    return last.select(*[F.col(c) if c == by else F.lit("~end").cast(df.schema[c].dataType).alias(c) if c == key else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def _delay(df: DataFrame, by: str, files: int = 4) -> str:
    """As long as rows of a mixed stream come late: the span of two neighbouring ranges at most."""
    q = df.agg(F.percentile_approx(micros(by), [i / files for i in range(files + 1)], 10_000).alias("q")).first()["q"] or [0]
    spans = [b - a for a, b in zip(q, q[2:])] or [0]
    return f"{-(-max(spans) // 1_000_000) + 1} seconds"


def _buckets(df: DataFrame) -> int:
    """State entries for a stream of these rows: about 10,000 rows for each, of which it holds half at a time."""
    return max(64, df.count() // 10_000)


@query
def str_sessions(s, d):
    from tidewatch.streaming.sessions import sessionize_stream

    log = checkpointed(_log(s, d).select("ts", "employee_id", "event_type", "status", "is_anomalous"))
    out = _drain(s, sessionize_stream(_stream(s, log, "events", closing=_end(log, "ts"))), "sessions")
    return out.where("employee_id != '~end'").select("employee_id", "n_events", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"), "failed_login_count",
                      F.col("is_anomalous").cast("long").alias("is_anomalous"))


@query
def str_drift(s, d):
    """Sessions come mixed over neighbouring ranges and are put in order by the stream."""
    from tidewatch.streaming.drift import drift_stream

    rows = checkpointed(_rows(s, d).select("employee_id", "session_id", "start_time", "office_location", "device_id", "browser", "operating_system", "resource_mask"))
    stream = _stream(s, rows, "rows", "start_time", closing=_end(rows, "start_time"), mixed=True)
    out = _drain(s, drift_stream(stream, _delay(rows, "start_time"), buckets=_buckets(rows)), "drift")
    return out.where("employee_id != '~end'").select("session_id", "accepted", *[r(c) for c in dims.DEVIATIONS], r("behaviour_score"))


def _placed(s, d) -> DataFrame:
    """Events of the log, mixed over neighbouring ranges, as the stream places them in sessions."""
    from tidewatch.streaming.sessions import session_events_stream

    log = checkpointed(_log(s, d))
    stream = _stream(s, log, "log", closing=_end(log, "ts"), mixed=True)
    out = _drain(s, session_events_stream(stream, gap_s=GAP, delay=_delay(log, "ts"), buckets=_buckets(log)), "placed")
    return out.where("employee_id != '~end' AND NOT late")


@query
def str_order(s, d):
    """Ordered features of sessions that the stream made."""
    f = features.event_features(_placed(s, d), keys=["employee_id"])
    return f.select("session_id", *[F.round(F.col(c) + 1.7e-8, 6).alias(c) for c in dims.ORDER_FEATURES])


@query
def str_padded(s, d):
    """Padded sequences of sessions that the stream made."""
    return _padded(_placed(s, d))


@query
def str_alerts(s, d):
    """Every session row comes twice; scored, gated and taken once in the stream, and written by batch."""
    from tidewatch.streaming.alerts import alert_stream, score_stream, write_alerts

    x = features.event_features(_events(s, d), keys=["employee_id"]).drop("event_ids")
    x = checkpointed(x)
    stream = _stream(s, x.unionByName(x), "sessions", "start_time")
    alerts = alert_stream(score_stream(stream, _emp(s, d))).select("session_id", "risk_score")
    base = work_folder(s, "alerts")
    write_alerts(alerts, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return s.read.schema(alerts.schema).parquet(f"{base}/out").select("session_id", "risk_score")
