"""Cutting an activity log into sessions and rolling sessions up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.columns import micros, nonblank, ordinal, seconds_between, uuid4_text
from tidewatch.operators import ordering as od

GAP_SECONDS = 1800


LEAD = ["employee_id", "device_id", "geo_location", "auth_method", "entity_type"]


def _lead(events: DataFrame) -> Column:
    """Attributes a session takes from its first event, and that event's position."""
    return F.struct(*[c for c in LEAD if c in events.columns], F.col("pos"))


def destination(events: DataFrame) -> Column:
    """Destination domain, else destination, lower case; NULL if blank."""
    cols = [nonblank(c) for c in ("destination_domain", "destination") if c in events.columns]
    return F.lower(F.coalesce(*cols)) if cols else F.lit(None).cast("string")


def _mark_first(df: DataFrame, o: od.Order, within: str) -> DataFrame:
    """``new_ip`` / ``new_dest``: first event of the session with that value.

    A reader that does not use the marks does not pay for them: the optimiser
    prunes the windows.
    """
    df = od.first_of(df, o, within, "new_dest", destination(df))
    return od.first_of(df, o, within, "new_ip", nonblank("ip_address")) if "ip_address" in df.columns else df


def sessionize(events: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id",
               gap_s: int = GAP_SECONDS, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Gap sessions: a new one starts when the gap is *longer* than ``gap_s``.

    Adds ``session_no`` (1-based per key), ``session_id``, ``pos`` (position
    within the key), ``gap`` (seconds to the previous event of the session, NULL
    for its first event) and ``lead`` (attributes of the session's first event).
    One shuffle by key; hot keys are sliced.
    """
    df, o = od.order_by(events, keys, micros(ts), [tie], min_rows)
    df = od.position_and_lag(df, o, "pos", {"_prev": ts})
    new = F.col("_prev").isNull() | (micros(ts) - micros("_prev") > gap_s * 1_000_000)
    df = df.withColumn("_new", F.when(new, 1).otherwise(0))
    df = od.running_sum(df, o, {"session_no": "_new"})
    df = od.carry_last(df, o, "lead", F.when(F.col("_new") == 1, _lead(events)))
    df = _mark_first(df, o, "session_no")
    return od.done(
        df.withColumn("gap", F.when(F.col("_new") == 0, seconds_between(ts, "_prev")))
        .withColumn("session_id", F.concat_ws("-", *keys, F.concat(F.lit("S"), F.col("session_no"))))
        .drop("_prev", "_new"))


def number_events(events: DataFrame, ts: str = "ts", tie: str = "event_id",
                  min_rows: int = od.HOT_ROWS) -> DataFrame:
    """``pos`` and ``gap`` for events that already carry a session id."""
    df, o = od.order_by(events, ["session_id"], micros(ts), [tie], min_rows)
    df = od.position_and_lag(df, o, "pos", {"_prev": ts})
    df = od.carry_last(df, o, "lead", F.when(F.col("pos") == 0, _lead(events)))
    df = _mark_first(df, o, "session_id")
    return od.done(df.withColumn("gap", seconds_between(ts, "_prev")).drop("_prev"))


def sessionize_auto(events: DataFrame, gap_s: int = GAP_SECONDS, given: bool | None = None,
                    min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Given session ids if any row has one, else gap sessions per employee and device.

    Rows without an id go to ``SES-GEN-<employee>``.  ``given`` skips the look.
    """
    if given is None:
        given = bool(events.agg(F.max(nonblank("session_id").isNotNull())).first()[0])
    if given:
        sid = F.coalesce(nonblank("session_id"), F.concat(F.lit("SES-GEN-"), F.col("employee_id")))
        return number_events(events.withColumn("session_id", sid), min_rows=min_rows)
    return sessionize(events.drop("session_id"), ["employee_id", "device_id"], gap_s=gap_s, min_rows=min_rows)


def _first(c: str) -> Column:
    return F.min_by(c, F.struct("ts", "event_id"))


def session_aggs() -> list[Column]:
    """Aggregates that make one session row out of its events.

    Buffers hold numbers only (the attack is its ordinal, first-event attributes
    ride in the grouping key ``lead``), so Spark can hash-aggregate map-side.
    """
    attack = ordinal("attack_type", dims.ATTACK_TYPES)
    return [
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count("*").alias("n_events"),
        F.max("is_anomalous").alias("is_anomalous"),
        F.max_by(F.when(attack > 0, attack), F.when(attack > 0, F.col("pos"))).alias("_attack"),
    ]


def finish_sessions(agg: DataFrame, floor_s: float | None = 1.0) -> DataFrame:
    """Session columns from :func:`session_aggs`.

    ``floor_s`` is the least duration (1 s for adapted logs, None for none).
    """
    span = seconds_between("end_time", "start_time")
    vpn = F.lower(F.col("lead.auth_method")).contains("vpn")
    return (agg
            .withColumn("employee_id", F.col("lead.employee_id"))
            .withColumn("device_id", F.col("lead.device_id"))
            .withColumn("office_location", F.col("lead.geo_location"))
            .withColumn("entity_type", F.col("lead.entity_type"))
            .withColumn("login_method", F.when(vpn, "VPN").otherwise("Office"))
            .withColumn("remote_session", F.coalesce(vpn, F.lit(False)))
            .withColumn("duration_seconds", span if floor_s is None else F.greatest(F.lit(floor_s), span))
            .withColumn("day_of_week", F.date_format("start_time", "EEEE"))
            .withColumn("attack_type", F.coalesce(
                F.get(F.array(*[F.lit(a) for a in dims.ATTACK_TYPES]), F.col("_attack").cast("int")), F.lit("None")))
            .withColumn("session_status", F.lit("Completed"))
            .withColumn("session_uuid", uuid4_text("session_id"))
            .drop("lead", "_attack"))


def build_sessions(events: DataFrame, floor_s: float | None = 1.0) -> DataFrame:
    """One row per session: bounds, duration, first-event attributes, labels."""
    return finish_sessions(events.groupBy("session_id", "lead").agg(*session_aggs()), floor_s)


def recorded_duration(events: DataFrame) -> DataFrame:
    """Session duration where a positive duration on the first event wins."""
    agg = events.groupBy("session_id").agg(
        _first("session_duration").alias("_rec"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return agg.withColumn(
        "duration_seconds",
        F.when(F.col("_rec") > 0, F.col("_rec")).otherwise(seconds_between("end_time", "start_time"))).drop("_rec")


def session_labels(events: DataFrame) -> DataFrame:
    """Any event label, last valid attack other than None, highest risk."""
    valid = F.col("attack_type").isin(dims.ATTACK_TYPES[1:])
    return events.groupBy("session_id").agg(
        F.max("is_anomalous").alias("is_anomalous"),
        F.coalesce(F.max_by(F.when(valid, F.col("attack_type")),
                            F.when(valid, F.struct("ts", "event_id"))), F.lit("None")).alias("attack_type"),
        F.max("risk_score").alias("risk_score"))


def assign_session_ids(sessions: DataFrame, groups: list[str], first_seen: str = "first_event",
                       order: str = "session_no", prefix: str = "SES-AD-",
                       min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Sequential ids over all groups, groups in order of first appearance.

    Counts per group, a running sum over the groups (sliced by value when large)
    and a join back: no task ever sees all sessions.
    """
    per = sessions.groupBy(*groups).agg(F.count("*").alias("_n"), F.min(first_seen).alias("_seen"))
    per, o = od.order_by(per, [], F.col("_seen"), groups, min_rows)
    per = od.done(od.running_sum(per, o, {"_upto": "_n"}))
    offs = per.select(*groups, (F.col("_upto") - F.col("_n")).alias("_off"))
    num = F.col("_off") + F.col(order)
    # the running number within a group comes from the sessioniser itself
    return (sessions.join(offs, groups)
            .withColumn("session_number", num)
            .withColumn("session_ref", F.concat(F.lit(prefix), F.when(
                num < 1_000_000, F.lpad(num.cast("string"), 6, "0")).otherwise(num.cast("string"))))
            .drop("_off"))


def enrich_sessions(sessions: DataFrame, emp: DataFrame) -> DataFrame:
    """Department, role, browser, OS from the employee table, with defaults.

    The employee table grows with the data, so the join strategy is left to the
    optimiser's size check; no hint.
    """
    e = emp.select("employee_id", "employee_uuid", "department", "role", "preferred_browser", "preferred_os")
    d = dims.EMPLOYEE_DEFAULTS
    return (sessions.join(e, "employee_id", "left")
            .withColumn("department", F.coalesce("department", F.lit(d["department"])))
            .withColumn("role", F.coalesce("role", F.lit(d["role"])))
            .withColumn("browser", F.coalesce("preferred_browser", F.lit(d["preferred_browser"])))
            .withColumn("operating_system", F.coalesce("preferred_os", F.lit(d["preferred_os"])))
            .drop("preferred_browser", "preferred_os"))


def dedup_timestamps(events: DataFrame, ts: str = "ts", tie: str = "event_id",
                     min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Strictly increasing whole-second timestamps per session.

    t'(i) = max(floor t(i), t'(i-1) + 1) has the closed form
    max over j <= i of (floor t(j) - j), plus i: one running maximum.
    """
    df, o = od.order_by(events, ["session_id"], micros(ts), [tie], min_rows)
    df = od.position_and_lag(df, o, "pos")
    df = df.withColumn("_base", F.floor(micros(ts) / 1_000_000) - F.col("pos"))
    df = od.running_max(df, o, "_peak", "_base")
    return od.done(df.withColumn("new_second", F.col("_peak") + F.col("pos"))
                   .withColumn("new_ts", F.timestamp_seconds(F.col("_peak") + F.col("pos")))
                   .drop("_base", "_peak"))


def extended_bounds(deduped: DataFrame) -> DataFrame:
    """Session end moved so that it still covers every shifted event."""
    sec = F.floor(micros("ts") / 1_000_000)
    return deduped.groupBy("session_id").agg(
        F.min(sec).alias("start_second"),
        F.greatest(F.max(sec), F.max("new_second")).alias("end_second")).withColumn(
        "duration_seconds", (F.col("end_second") - F.col("start_second")).cast("double"))


def run_summary(sessions: DataFrame) -> DataFrame:
    """Counts, averages and shares over all sessions; one row."""
    return sessions.agg(
        F.count("*").alias("sessions"), F.sum("n_events").alias("events"),
        F.countDistinct("employee_id").alias("employees"),
        F.avg(F.col("duration_seconds") / 60).alias("avg_minutes"),
        F.avg(F.when(F.col("login_method") == "Office", 1.0).otherwise(0.0)).alias("office_share"),
        F.avg(F.when(F.col("login_method") == "VPN", 1.0).otherwise(0.0)).alias("vpn_share"),
        F.avg(F.col("is_anomalous").cast("double")).alias("anomaly_share"),
    ).withColumn("sessions_per_employee", F.col("sessions") / F.col("employees")).withColumn(
        "events_per_session", F.col("events") / F.col("sessions"))
