"""Data-quality rules.  Each check returns rows (rule_id, key, detail).

Row rules of one table are evaluated in a single pass as an array of hits;
duplicate rules are keyed counts, which combine map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.columns import clamp, micros, seconds_between
from tidewatch.functions.risk import attack_severity
from tidewatch.operators import ordering as od
from tidewatch.operators.risk import rule_points

UUID4 = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
BUFFER_MINUTES = 120


def _hits(df: DataFrame, key, rules: list[tuple[str, Column, Column | str]]) -> DataFrame:
    """One row per broken rule and row of ``df``; a NULL condition is not a hit."""
    found = F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(r).alias("rule_id"), (F.lit(d) if isinstance(d, str) else d.cast("string")).alias("detail")))
        for r, c, d in rules]))
    return df.select(F.col(key).cast("string").alias("key"), F.inline(found)).select("rule_id", "key", "detail")


def _duplicates(df: DataFrame, column: str, rule: str) -> DataFrame:
    """Values that occur more than once; detail is the number of rows."""
    g = df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
    return g.select(F.lit(rule).alias("rule_id"), F.col(column).cast("string").alias("key"), F.col("n").cast("string").alias("detail"))


def union_rules(*checks: DataFrame) -> DataFrame:
    """All findings in one table."""
    return reduce(DataFrame.unionByName, checks)


# --- sessions -------------------------------------------------------------------

def check_session_keys(sessions: DataFrame, emp: DataFrame) -> DataFrame:
    """Duplicate ids, malformed uuid, unknown employee, uuid mismatch, unowned device."""
    e = emp.select("employee_id", F.col("employee_uuid").alias("_uuid"), "allowed_devices", F.lit(True).alias("_known"))
    j = sessions.join(e, "employee_id", "left")
    known = F.coalesce("_known", F.lit(False))
    rows = _hits(j, "session_id", [
        ("session_uuid_format", ~F.coalesce(F.col("session_uuid").rlike(UUID4), F.lit(False)), F.col("session_uuid")),
        ("session_unknown_employee", ~known, F.col("employee_id")),
        ("session_employee_uuid", known & ~F.col("_uuid").eqNullSafe(F.col("employee_uuid")), F.col("employee_id")),
        ("session_unowned_device", known & (F.col("device_id") != "UNKNOWN")
         & ~F.array_contains("allowed_devices", F.col("device_id")), F.col("device_id")),
    ])
    return union_rules(rows, _duplicates(sessions, "session_id", "session_duplicate_id"),
                       _duplicates(sessions, "session_uuid", "session_duplicate_uuid"))


def in_work_window(start="start_time", end="end_time", s="work_start", e="work_end", buffer_min: int = BUFFER_MINUTES) -> Column:
    """Session inside the working hours plus a buffer, also across midnight and with
    an end hour of 24."""
    day = 86_400_000_000
    hour = 3_600_000_000
    buf = buffer_min * 60_000_000
    t0, t1 = micros(start), micros(end)
    midnight = t0 - F.pmod(t0, F.lit(day))
    ws, we = F.col(s).cast("long") * hour, F.col(e).cast("long") * hour
    h = F.hour(start)
    within = lambda a, b: (midnight + a - buf <= t0) & (t1 <= midnight + b + buf)
    return (F.when(F.col(s) <= F.col(e), within(ws, we))
            .when(h >= F.col(s), within(ws, we + day))
            .when(h < F.col(e), within(ws - day, we)).otherwise(False))


def check_work_hours(sessions: DataFrame, emp: DataFrame, buffer_min: int = BUFFER_MINUTES) -> DataFrame:
    """Sessions outside the employee's hours."""
    j = sessions.join(emp.select("employee_id", "work_start", "work_end"), "employee_id")
    return _hits(j, "session_id", [("session_outside_hours", ~in_work_window(buffer_min=buffer_min), F.col("employee_id"))])


def check_session_values(sessions: DataFrame) -> DataFrame:
    """Duration, day name and enum membership."""
    return _hits(sessions, "session_id", [
        ("session_duration_mismatch", F.abs(F.col("duration_seconds") - seconds_between("end_time", "start_time")) > 1e-3, ""),
        ("session_duration_positive", F.col("duration_seconds") <= 0, ""),
        ("session_day_name", F.col("day_of_week") != F.date_format("start_time", "EEEE"), F.col("day_of_week")),
        ("session_browser", ~F.coalesce(F.col("browser").isin(dims.BROWSERS), F.lit(False)), F.col("browser")),
        ("session_department", ~F.coalesce(F.col("department").isin(dims.DEPARTMENTS), F.lit(False)), F.col("department")),
    ])


def check_overlap(sessions: DataFrame, order: str = "input_no", min_rows: int = od.HOT_ROWS, check: bool = True) -> DataFrame:
    """Consecutive sessions of an employee, in input order: out of order or overlapping."""
    d, o = od.order_by(sessions, ["employee_id"], F.col(order), ["session_id"], min_rows, check)
    d = od.done(od.position_and_lag(d, o, "_p", {"_id": "session_id", "_start": "start_time", "_end": "end_time"}))
    d = d.where(F.col("_id").isNotNull())
    return _hits(d, "_id", [
        ("session_order", F.col("_start") > F.col("start_time"), F.col("session_id")),
        ("session_overlap", F.col("_end") > F.col("start_time"), F.col("session_id")),
    ])


# --- events ----------------------------------------------------------------------

def check_event_shape(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """First Login, last Logout, connect pattern at the second and penultimate event
    (four or more events), sessions without events.

    ``events`` comes from a sessioniser.  Edge positions are keyed minima and
    maxima, so no session is sorted.
    """
    t = F.col("event_type")
    i = F.col("pos") - F.col("lead.pos")
    g = events.groupBy("session_id").agg(
        F.count("*").alias("n"), F.min_by(t, "pos").alias("first"), F.max_by(t, "pos").alias("last"),
        F.max(F.when(i == 1, t)).alias("second"),
        F.max("pos").alias("_last"))
    # penultimate: the event one before the session's last position
    ends = g.select("session_id", (F.col("_last") - 1).alias("pos"))
    pen = events.select("session_id", "pos", F.col("event_type").alias("penultimate")).join(ends, ["session_id", "pos"]).drop("pos")
    j = (sessions.select("session_id", "remote_session").join(g, "session_id", "left").join(pen, "session_id", "left"))
    many, remote = F.col("n") >= 4, F.col("remote_session")
    return _hits(j, "session_id", [
        ("event_none", F.col("n").isNull(), ""),
        ("event_first_login", F.col("first") != "Login", F.col("first")),
        ("event_last_logout", F.col("last") != "Logout", F.col("last")),
        ("event_second_connect", many & (F.col("second") != F.when(remote, "VPNConnect").otherwise("NetworkConnect")), F.col("second")),
        ("event_penultimate_disconnect", many & (F.col("penultimate") != F.when(remote, "VPNDisconnect").otherwise("NetworkDisconnect")),
         F.col("penultimate")),
    ])


def check_events(events: DataFrame, sessions: DataFrame, order: str | None = None, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Duplicate id, uuid format (column ``event_uuid``, if there), parent mismatches, bounds, strictly
    increasing and unique timestamps, enum membership.

    ``order`` names the input position: an event must be strictly later than the
    one before it in the input.  Without it the frame's own time order counts,
    where a timestamp that does not increase is a gap of 0.
    """
    s = sessions.select("session_id", F.col("employee_id").alias("_emp"), F.col("device_id").alias("_dev"), "start_time", "end_time")
    late = F.col("gap") <= 0
    if order:
        events, o = od.order_by(events, ["session_id"], F.col(order), ["event_id"], min_rows)
        events = od.done(od.position_and_lag(events, o, "_p", {"_before": "ts"}))
        late = F.col("ts") <= F.col("_before")
    j = events.join(s, "session_id", "left")
    rules = [
        ("event_no_session", F.col("_emp").isNull(), F.col("session_id")),
        ("event_employee", F.col("employee_id") != F.col("_emp"), F.col("employee_id")),
        ("event_device", F.col("device_id") != F.col("_dev"), F.col("device_id")),
        ("event_bounds", (F.col("ts") < F.col("start_time")) | (F.col("ts") > F.col("end_time")), ""),
        ("event_not_increasing", late, ""),
        ("event_type", ~F.coalesce(F.col("event_type").isin(dims.EVENT_TYPES), F.lit(False)), F.col("event_type")),
        ("event_status", ~F.coalesce(F.col("status").isin("SUCCESS", "FAILED"), F.lit(False)), F.col("status")),
        ("event_attack", ~F.coalesce(F.col("attack_type").isin(dims.ATTACK_TYPES), F.lit(False)), F.col("attack_type")),
        ("event_resource", ~F.col("resource").isin(dims.RESOURCES), F.col("resource")),
    ]
    if "event_uuid" in events.columns:
        rules.append(("event_uuid_format", ~F.coalesce(F.col("event_uuid").rlike(UUID4), F.lit(False)), F.col("event_uuid")))
    rows = _hits(j, "event_id", rules)
    dup_ts = (events.groupBy("session_id", "ts").agg(F.count("*").alias("n")).where("n > 1")
              .select(F.lit("event_duplicate_ts").alias("rule_id"), F.col("session_id").alias("key"), F.col("n").cast("string").alias("detail")))
    return union_rules(rows, _duplicates(events, "event_id", "event_duplicate_id"), dup_ts)


def check_labels(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Label consistency within sessions and between a session and its events."""
    s = _hits(sessions, "session_id", [
        ("label_session_attack", F.col("is_anomalous") & (F.col("attack_type") == "None"), ""),
        ("label_session_risk", F.col("is_anomalous") & ~((F.col("risk_score") > 0) & (F.col("risk_score") <= 100)), F.round("risk_score", 2)),
        ("label_session_normal_attack", ~F.col("is_anomalous") & (F.col("attack_type") != "None"), F.col("attack_type")),
        ("label_session_normal_risk", ~F.col("is_anomalous") & (F.col("risk_score") != 0), F.round("risk_score", 2)),
    ])
    p = sessions.select("session_id", F.col("is_anomalous").alias("_anom"), F.col("risk_score").alias("_risk"))
    j = events.join(p, "session_id")
    a = F.col("is_anomalous")
    e = _hits(j, "event_id", [
        ("label_event_session", a != F.col("_anom"), ""),
        ("label_event_attack", a & (F.col("attack_type") == "None"), ""),
        ("label_event_risk", a & (F.col("risk_score") != F.col("_risk")), ""),
        ("label_event_normal_attack", ~a & (F.col("attack_type") != "None"), F.col("attack_type")),
        ("label_event_normal_risk", ~a & (F.col("risk_score") != 0), ""),
    ])
    return union_rules(s, e)


def check_risk(events: DataFrame, sessions: DataFrame, emp: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Anomalous sessions whose stored risk differs from the recomputed rule risk."""
    pts = rule_points(events, emp).groupBy("session_id").agg(F.sum("points").alias("_pts"))
    j = sessions.where("is_anomalous").join(pts, "session_id", "left")
    again = clamp(attack_severity("attack_type") + F.coalesce("_pts", F.lit(0.0)), 0.0, 100.0)
    return _hits(j, "session_id", [("risk_mismatch", F.abs(F.col("risk_score") - again) > tolerance, F.round(again, 2))])


# --- organisation -------------------------------------------------------------------

def check_organisation(emp: DataFrame, dev: DataFrame, res: DataFrame, offices: list[str],
                       departments: list[str] | None = None) -> DataFrame:
    """Duplicate ids, device counts, unknown offices and departments, orphan devices
    in both directions, resource departments."""
    departments = departments or dims.DEPARTMENTS
    n = F.size("allowed_devices")
    e = _hits(emp, "employee_id", [
        ("employee_location", ~F.coalesce(F.col("office_location").isin(offices), F.lit(False)), F.col("office_location")),
        ("employee_browser", ~F.coalesce(F.col("preferred_browser").isin(dims.BROWSERS), F.lit(False)), F.col("preferred_browser")),
        ("employee_os", ~F.coalesce(F.col("preferred_os").isin(dims.OPERATING_SYSTEMS), F.lit(False)), F.col("preferred_os")),
        ("employee_no_device", n < 1, ""), ("employee_many_devices", n > 3, n),
        ("employee_department", ~F.coalesce(F.col("department").isin(departments), F.lit(False)), F.col("department")),
    ])
    owner = emp.select(F.col("employee_id").alias("owner_id"), "allowed_devices", F.lit(True).alias("_known"))
    d = _hits(dev.join(owner, "owner_id", "left"), "device_id", [
        ("device_type", ~F.coalesce(F.col("device_type").isin(dims.DEVICE_TYPES), F.lit(False)), F.col("device_type")),
        ("device_owner", F.col("_known").isNull(), F.col("owner_id")),
        ("device_not_listed", ~F.array_contains("allowed_devices", F.col("device_id")), F.col("owner_id")),
    ])
    listed = emp.select("employee_id", F.explode("allowed_devices").alias("device_id"))
    ghost = (listed.join(dev.select("device_id"), "device_id", "left_anti")
             .select(F.lit("employee_unknown_device").alias("rule_id"), F.col("employee_id").alias("key"), F.col("device_id").alias("detail")))
    r = _hits(res, "resource_name", [
        ("resource_sensitivity", ~F.coalesce(F.col("sensitivity_level").isin(dims.SENSITIVITY), F.lit(False)), F.col("sensitivity_level")),
        ("resource_no_department", F.size("allowed_departments") == 0, ""),
        ("resource_department", F.size(F.array_except("allowed_departments", F.array(*[F.lit(x) for x in departments]))) > 0, ""),
    ])
    return union_rules(e, d, ghost, r, _duplicates(emp, "employee_id", "employee_duplicate_id"),
                       _duplicates(emp, "employee_uuid", "employee_duplicate_uuid"), _duplicates(dev, "device_id", "device_duplicate_id"))


# --- features -------------------------------------------------------------------------

def check_features(features: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Missing and duplicate ids, NULL / NaN / non-numeric values, ranges, row count."""
    num = [c for c in features.columns if c not in ("session_id", "employee_id", "attack_type")]
    kinds = dict(features.dtypes)

    def value(c: str) -> Column:
        return F.col(c).try_cast("double") if kinds[c] == "string" else F.col(c).cast("double")
    rules = [("feature_missing_id", F.col("session_id").isNull(), "")]
    for c in num:
        missing = F.col(c).isNull() | (F.isnan(value(c)) if kinds[c] != "string" else F.lit(False))
        rules.append(("feature_missing", missing, c))
        if kinds[c] == "string":
            rules.append(("feature_not_numeric", F.col(c).isNotNull() & value(c).isNull(), c))
    have = set(features.columns)
    for c in ("session_duration", "failed_login_count"):
        if c in have:
            rules.append(("feature_negative", value(c) < 0, c))
    if "failed_login_ratio" in have:
        rules.append(("feature_ratio", (value("failed_login_ratio") < 0) | (value("failed_login_ratio") > 1), "failed_login_ratio"))
    if "weekend_flag" in have:
        rules.append(("feature_flag", ~value("weekend_flag").isin(0.0, 1.0), "weekend_flag"))
    for c in ("admin_access_position", "file_download_position"):
        if c in have:
            rules.append(("feature_position", (value(c) != -1.0) & ((value(c) < 0) | (value(c) > 1)), c))
    out = union_rules(_hits(features, "session_id", rules), _duplicates(features.where(F.col("session_id").isNotNull()), "session_id", "feature_duplicate_id"))
    if expected_rows is not None:
        n = features.agg(F.count("*").alias("n")).where(F.col("n") != expected_rows)
        out = out.unionByName(n.select(F.lit("feature_row_count").alias("rule_id"), F.lit(None).cast("string").alias("key"), F.col("n").cast("string").alias("detail")))
    return out


def check_merged(df: DataFrame, names: list[str], label: str = "attack_type") -> DataFrame:
    """Summary row of the merged training set: counts, missing columns, verdict."""
    kinds = dict(df.dtypes)
    have = [c for c in names if c in kinds]
    text = [c for c in have if kinds[c] == "string"]
    num = [c for c in have if kinds[c] != "string"]
    missing = sorted({"session_id", "attack_type", "is_anomalous", *dims.SCORE_FEATURES} - set(df.columns))
    nan = sum((F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0) for c in num), F.lit(0))
    inf = sum((F.when(F.abs(F.col(c).cast("double")) == float("inf"), 1).otherwise(0) for c in num), F.lit(0))
    a = df.agg(F.count("*").alias("n_rows"), F.sum(nan).alias("n_nan"), F.sum(inf).alias("n_inf"),
               F.countDistinct("session_id").alias("_ids"), F.count("session_id").alias("_with_id"), F.countDistinct(label).alias("n_classes"))
    a = a.withColumn("n_duplicate_sessions", F.col("_with_id") - F.col("_ids"))
    ok = ((F.col("n_nan") == 0) & (F.col("n_inf") == 0) & (F.col("n_duplicate_sessions") == 0) & (F.col("n_classes") >= 2)
          & F.lit(not missing) & F.lit(not text))
    return a.select("n_rows", F.lit(len(names)).alias("n_features"), "n_nan", "n_inf", "n_duplicate_sessions", "n_classes",
                    F.lit(",".join(missing)).alias("missing_columns"), F.lit(",".join(text)).alias("text_features"), ok.alias("passed"))


def check_label_gaps(features: DataFrame) -> DataFrame:
    """Anomalous rows without an attack or without risk; one row of counts."""
    a = F.col("is_anomalous").cast("int") == 1
    none = F.col("attack_type").isNull() | F.lower("attack_type").isin("none", "normal")
    return features.agg(F.count_if(a).alias("anomalous"), F.count_if(a & none).alias("without_attack"),
                        F.count_if(a & (F.col("risk_score") <= 0)).alias("without_risk"))
