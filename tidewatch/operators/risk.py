"""Rule risk, alert gate and severity roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.columns import clamp, suspicious_command
from tidewatch.functions.risk import attack_severity, severity_rank

BASELINE_TEXT = ("No significant anomalies were detected. "
                 "The session conforms to the user's established baseline.")


def rule_points(events: DataFrame, emp: DataFrame) -> DataFrame:
    """Risk points of every event; unauthorised admin access looks at the
    department of the event's own employee."""
    e = emp.select("employee_id", "department")
    cmd, proc = F.lower(F.coalesce("command_line", F.lit(""))), F.lower(F.coalesce("process_name", F.lit("")))
    p = dims.RISK_POINTS
    points = [
        ((F.col("event_type") == "Login") & (F.col("status") == "FAILED"), p["failed_login"]),
        ((F.col("department") != "IT") & F.col("resource").isin(dims.ADMIN_RESOURCES), p["unauthorized_admin"]),
        (F.col("bytes_transferred") > dims.LARGE_TRANSFER_BYTES, p["large_transfer"]),
        ((F.col("event_type") == "ProcessStart") & suspicious_command(cmd, proc), p["suspicious_cli"]),
    ]
    total = sum((F.when(c, v).otherwise(0.0) for c, v in points), F.lit(0.0))
    return events.join(e, "employee_id", "left").withColumn("points", total)


def rule_risk(events: DataFrame, sessions: DataFrame, emp: DataFrame) -> DataFrame:
    """Base severity of the session's attack plus the points of its events, 0..100."""
    pts = rule_points(events, emp).groupBy("session_id").agg(F.sum("points").alias("points"))
    return (sessions.select("session_id", "employee_id", "attack_type", "is_anomalous").join(pts, "session_id", "left")
            .withColumn("rule_risk", clamp(attack_severity("attack_type") + F.coalesce("points", F.lit(0.0)), 0.0, 100.0))
            .drop("points"))


def session_rule_risk(rows: DataFrame, out: str = "rule_risk") -> DataFrame:
    """Rule risk from the counts of an enriched session row, without reading the
    events again.  Equals :func:`rule_risk` where all events of a session belong to
    the session's employee; a session without a known employee counts as IT."""
    p = dims.RISK_POINTS
    admin = F.when(F.col("department") != "IT", F.col("admin_resource_accesses")).otherwise(0.0)
    pts = (p["failed_login"] * F.col("failed_login_count") + p["unauthorized_admin"] * admin
           + p["large_transfer"] * F.col("large_transfers") + p["suspicious_cli"] * F.col("suspicious_starts"))
    return rows.withColumn(out, clamp(attack_severity("attack_type") + pts, 0.0, 100.0))


def alert_gate(df: DataFrame, threshold: float = dims.ALERT_THRESHOLD) -> DataFrame:
    """Below the threshold an incident is rewritten as normal."""
    low = F.col("risk_score") < threshold
    new = {
        "attack_type": F.when(low, "Normal").otherwise(F.col("attack_type")),
        "severity": F.when(low, "Low").otherwise(F.col("severity")),
    }
    if "mitre" in df.columns:
        new["mitre"] = F.when(~low, F.col("mitre"))
    if "investigation_steps" in df.columns:
        new["investigation_steps"] = F.when(low, F.array().cast("array<string>")).otherwise(F.col("investigation_steps"))
    for text in ("nl_explanation", "summary"):
        if text in df.columns:
            new[text] = F.when(low, BASELINE_TEXT).otherwise(F.col(text))
    if "top3" in df.columns:
        fixed = [("Normal", F.round("confidence", 4)), ("Device Spoofing", F.lit(0.0)), ("Lateral Movement", F.lit(0.0))]
        new["top3"] = F.when(low, F.array(*[F.struct(F.lit(a).alias("attack"), p.alias("probability"))
                                            for a, p in fixed])).otherwise(F.col("top3"))
    return df.withColumns(new)


def worst_stage(df: DataFrame, by: list[str], stage: str = "attack_type", order: str = "pos") -> DataFrame:
    """Stage with the highest base severity; the first in order on ties."""
    return df.groupBy(*by).agg(
        F.max_by(stage, F.struct(attack_severity(stage).alias("s"), (-F.col(order)).alias("o"))).alias("worst_stage"))


def at_least(df: DataFrame, level: str, column: str = "severity") -> DataFrame:
    """Rows of at least the given severity."""
    return df.where(severity_rank(column) >= dims.SEVERITY_RANK[level.capitalize()])


def severity_counts(df: DataFrame, column: str = "severity") -> DataFrame:
    """Rows per severity."""
    return df.groupBy(F.col(column).alias("severity")).agg(F.count("*").alias("n"))
