"""Mapping logs of unknown layout onto the event model.

Schema detection works on column *names* only, so it runs on the driver and
yields a plain ``select``; the rows themselves never leave Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions import normalise as nz
from tidewatch.functions.columns import nonblank, uuid4_text


@dataclass
class SchemaMatch:
    """canonical field -> (raw column, confidence), plus what did not match."""

    mapped: dict[str, tuple[str, float]] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)
    unused: list[str] = field(default_factory=list)
    fields: int = len(dims.COLUMN_SYNONYMS)
    core: tuple[str, ...] = tuple(dims.CORE_FIELDS)

    def raw(self, name: str) -> str | None:
        return self.mapped[name][0] if name in self.mapped else None

    @property
    def score(self) -> float:
        core = sum(f in self.mapped for f in self.core) / max(1, len(self.core))
        return round((core * 0.7 + len(self.mapped) / max(1, self.fields) * 0.3) * 100.0, 1)

    @property
    def level(self) -> str:
        return "FULL" if self.score >= 90 else "PARTIAL" if self.score >= 70 else "DEGRADED"

    @property
    def warnings(self) -> list[str]:
        out = []
        if self.score < 70:
            out.append("schema mapping confidence below 70 %")
        if any(f not in self.mapped for f in self.core):
            out.append("core field missing, defaults applied")
        return out


def _confidence(raw: str, synonyms: list[str]) -> float:
    name = raw.strip().lower()
    if name in synonyms:
        return 1.0 if name == synonyms[0] else 0.95
    return 0.85 if any(s in name or name in s for s in synonyms) else 0.0


def detect_schema(columns: list[str], synonyms: dict[str, list[str]] | None = None,
                  core: list[str] | None = None, least: float = 0.70) -> SchemaMatch:
    """Best unused column for each field, in field order.

    A column named like the field wins; else the highest confidence, the first
    column on ties.
    """
    synonyms = synonyms or dims.COLUMN_SYNONYMS
    match = SchemaMatch(fields=len(synonyms), core=tuple(core or dims.CORE_FIELDS))
    free = list(columns)
    for name, words in synonyms.items():
        words = [w.lower() for w in words]
        same = [c for c in free if c.strip().lower() == name]
        rated = [(1.0, c) for c in same] or [(_confidence(c, words), c) for c in free]
        best = max(rated, key=lambda r: r[0], default=(0.0, None))
        if best[1] is not None and best[0] >= least:
            match.mapped[name] = (best[1], best[0])
            free.remove(best[1])
        else:
            match.missing.append(name)
    match.unused = free
    return match


def compatibility(match: SchemaMatch) -> tuple[float, str]:
    """Score 0..100 and FULL / PARTIAL / DEGRADED."""
    return match.score, match.level


def column_coverage(columns: list[str], match: SchemaMatch) -> dict[str, list[str]]:
    """Unused raw columns, missing fields, fields whose value is inferred."""
    used = {raw for raw, _ in match.mapped.values()}
    return {"unused": [c for c in columns if c not in used], "missing": list(match.missing),
            "inferred": [f for f in match.missing]}


def to_internal(df: DataFrame, match: SchemaMatch, default_ts: Column | None = None) -> DataFrame:
    """One projection from the raw layout to the event model.

    NULL and NaN take the field's default, bytes that are no number become 0,
    an unknown resource becomes NULL (its text stays in ``extra``), unmapped
    columns go to ``extra``.
    """
    types = dict(df.dtypes)

    def get(name: str, default: str | None = None) -> Column:
        raw = match.raw(name)
        if raw is None:
            return F.lit(default).cast("string")
        v = F.col(f"`{raw}`")
        if types[raw] in ("double", "float"):
            v = F.when(~F.isnan(v), v)
        v = v.cast("string")
        return v if default is None else F.coalesce(v, F.lit(default))

    d = dims.FIELD_DEFAULTS
    resource, command = nonblank(get("resource")), nonblank(get("command_line"))
    known = F.when(resource.isin(dims.RESOURCES), resource)
    ts_raw = match.raw("event_timestamp")
    if ts_raw is None:
        ts = default_ts if default_ts is not None else F.lit(None).cast("timestamp")
    elif types[ts_raw].startswith("timestamp"):
        ts = F.col(f"`{ts_raw}`").cast("timestamp")
    else:
        ts = nz.normalize_ts(F.col(f"`{ts_raw}`"), default_ts)
    rest = [c for c in match.unused]
    extra = [x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    extra += [F.lit("resource"), F.when(known.isNull(), resource)]
    return df.select(
        uuid4_text(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in df.columns]).alias("event_uuid"),
        nonblank(get("session_id")).alias("session_id"),
        ts.alias("ts"),
        nz.normalize_event_type(get("event_type", "RESOURCE_ACCESS"), resource, command).alias("event_type"),
        get("employee_id", d["employee_id"]).alias("employee_id"),
        get("device_id", d["device_id"]).alias("device_id"),
        get("source_ip", d["source_ip"]).alias("ip_address"),
        nonblank(get("destination_ip")).alias("destination_ip"),
        known.alias("resource"),
        nz.normalize_status(get("status", d["status"])).alias("status"),
        get("location", d["location"]).alias("geo_location"),
        get("auth_method", d["auth_method"]).alias("auth_method"),
        F.coalesce(get("bytes_transferred").try_cast("double"), F.lit(0.0)).alias("bytes_transferred"),
        nonblank(get("process_name")).alias("process_name"),
        command.alias("command_line"),
        F.map_filter(F.create_map(*extra), lambda k, v: v.isNotNull()).alias("extra"),
    ).withColumns({  # fields an outside log has no column for
        "event_id": F.col("event_uuid"), "entity_type": F.lit("user"), "attack_type": F.lit("None"),
        "is_anomalous": F.lit(False), "risk_score": F.lit(0.0), "bytes_written": F.lit(0.0),
        "command_sequence": F.array().cast("array<string>"), "destination_domain": F.lit(None).cast("string"),
    })


def standardize(df: DataFrame) -> DataFrame:
    """Resolve the alternative names of the export layout; '' counts as missing."""
    have = set(df.columns)

    def pick(*names: str, default: str | None = None) -> Column:
        cols = [n for n in names if n in have]
        return nz.first_nonblank(*cols, default=default) if cols else F.lit(default).cast("string")

    number = lambda *n: F.coalesce(pick(*n).try_cast("double"), F.lit(0.0))
    commands = nz.parse_commands(pick("command_sequence"))
    resource = pick("resource_accessed", "resource")
    # a label of 0 is "missing" to the alias chain, the outcome is the same: not anomalous
    label = F.greatest(*[nz.parse_label(c) for c in ("label", "is_anomalous") if c in have] or [F.lit(0)], F.lit(0))
    return df.select(
        pick("entity_id", "employee_id", "user_id", default="UNKNOWN_ENTITY").alias("employee_id"),
        pick("entity_type", default="user").alias("entity_type"),
        nz.normalize_ts("timestamp").alias("ts") if "timestamp" in have else F.col("ts"),
        pick("source_ip", "ip_address", default="127.0.0.1").alias("ip_address"),
        pick("geo_location", "office_location", default="Office").alias("geo_location"),
        nz.coerce_enum(resource, dims.RESOURCES).alias("resource"),
        pick("auth_method", "login_method", default="Password").alias("auth_method"),
        number("session_duration", "duration_seconds").alias("session_duration"),
        commands.alias("command_sequence"),
        pick("device_fingerprint", "device_id", default="UNKNOWN_DEVICE").alias("device_id"),
        (label == 1).alias("is_anomalous"),
        pick("session_id").alias("session_id"),
        F.coalesce(pick("event_uuid"), uuid4_text(*df.columns)).alias("event_uuid"),
        nz.infer_event_type(pick("event_type"), commands, resource).alias("event_type"),
        F.when(pick("status", default="SUCCESS") == "FAILED", "FAILED").otherwise("SUCCESS").alias("status"),
        pick("attack_type", default="None").alias("attack_type"),
        number("risk_score").alias("risk_score"))


def adapter_report(raw: DataFrame, internal: DataFrame, sessions: DataFrame, match: SchemaMatch,
                   features: DataFrame | None = None) -> DataFrame:
    """One row: totals, sessions, employees, score, level, warnings, status.

    Rows whose time cannot be read are skipped: they count in ``total_rows`` and
    ``skipped_rows`` and form no session of the report.  Adapting keeps every row, so
    one pass over ``internal`` gives the totals and ``raw`` is not read again.
    ``features`` is checked against the model's features: EMPTY without sessions,
    WARNING if features are missing or in another order, else READY.
    """
    a = internal.agg(F.count("*").alias("total_rows"), F.count("ts").alias("mapped_rows"))
    c = sessions.where(F.col("start_time").isNotNull()).agg(F.count("*").alias("sessions_built"), F.countDistinct("employee_id").alias("unique_employees"))
    present, ordered = (True, True) if features is None else check_feature_schema(features)
    warnings = [*match.warnings, *([] if present else ["features are missing"]), *([] if ordered or not present else ["features are in another order"])]
    return a.crossJoin(c).select(  # two one-row frames
        "total_rows", "mapped_rows", (F.col("total_rows") - F.col("mapped_rows")).alias("skipped_rows"),
        "sessions_built", "unique_employees",
        F.lit(len(match.mapped)).alias("mapped_columns"), F.lit(len(match.missing)).alias("missing_columns"),
        F.lit(match.score).alias("compatibility_score"), F.lit(match.level).alias("compatibility_level"),
        F.lit(present).alias("features_present"), F.lit(ordered).alias("features_ordered"),
        F.lit("; ".join(warnings)).alias("warnings"),
        F.when(F.col("sessions_built") == 0, "EMPTY").when(F.lit(present and ordered), "READY").otherwise("WARNING").alias("pipeline_status"))


def check_feature_schema(df: DataFrame, expected: list[str] | None = None) -> tuple[bool, bool]:
    """(all expected features present, present in the same order)."""
    expected = expected or dims.MODEL_FEATURES
    found = [c for c in df.columns if c in set(expected)]
    return sorted(found) == sorted(expected), found == list(expected)
