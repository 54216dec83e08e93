"""Normalising raw log fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.columns import col, contains_any, lookup, nonblank


def normalize_ts(c, default: Column | None = None) -> Column:
    """Timestamp from epoch seconds or milliseconds, one of nine layouts or ISO text.

    Anything else becomes ``default`` (NULL without one).
    """
    text = F.trim(col(c).cast("string"))
    number = F.when(text.rlike("^\\d{1,18}$"), text.cast("long"))
    epoch = (F.when(number > 100_000_000_000, F.timestamp_millis(number))
             .when(number.isNotNull(), F.timestamp_seconds(number)))
    layouts = [F.try_to_timestamp(text, F.lit(f)) for f in dims.TIMESTAMP_FORMATS]
    iso = text.try_cast("timestamp")
    out = F.coalesce(epoch, F.when(~text.rlike("^\\d+$"), F.coalesce(*layouts, iso)))
    return out if default is None else F.coalesce(out, default)


def normalize_event_type(action, resource=None, command=None) -> Column:
    """First matching pattern of the ordered list, else hints from the command,
    then from the resource, else ResourceAccess."""
    text = F.lower(F.trim(F.coalesce(col(action).cast("string"), F.lit(""))))
    out = None
    for pattern, event_type in dims.EVENT_TYPE_PATTERNS:
        out = F.when(text.rlike(pattern), event_type) if out is None else out.when(text.rlike(pattern), event_type)
    if command is not None:
        cmd = F.lower(F.coalesce(col(command).cast("string"), F.lit("")))
        out = out.when(contains_any(cmd, ["cmd", "powershell", "exe", "exec"]), "ProcessStart")
    if resource is not None:
        res = F.lower(F.coalesce(col(resource).cast("string"), F.lit("")))
        out = out.when(contains_any(res, ["db", "sql", "table"]), "DatabaseQuery")
        out = out.when(contains_any(res, [".csv", ".pdf", ".zip", "file"]), "FileRead")
    return out.otherwise("ResourceAccess")


def normalize_status(c) -> Column:
    """FAILED for the failure words, SUCCESS for everything else."""
    failed = F.upper(col(c).cast("string")).isin("FAILED", "FAILURE", "0", "FALSE", "DENIED")
    return F.when(failed, "FAILED").otherwise("SUCCESS")


def parse_label(c) -> Column:
    """1 for 1 / true / yes / anomalous, else 0."""
    return F.when(F.lower(col(c).cast("string")).isin("1", "true", "yes", "anomalous"), 1).otherwise(0)


def parse_commands(c) -> Column:
    """JSON list of texts; other non-blank text as a single command; else empty."""
    text = col(c).cast("string")
    as_list = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
    return F.coalesce(as_list, F.when(F.trim(text) != "", F.array(text)), F.array().cast("array<string>"))


def infer_event_type(event_type, commands, resource) -> Column:
    """Known type as is, unknown text ResourceAccess; blank is inferred from the
    presence of commands and of a resource."""
    t = nonblank(event_type)
    known = t.isin(dims.EVENT_TYPES)
    return (F.when(known, t).when(t.isNotNull(), "ResourceAccess")
            .when(F.size(col(commands)) > 0, "ProcessStart")
            .when(nonblank(resource).isNull(), "Login").otherwise("ResourceAccess"))


def coerce_enum(c, values: list[str], default=None) -> Column:
    """Canonical spelling of an enum text, matched without case or outer blanks."""
    return lookup(F.lower(F.trim(col(c).cast("string"))), {v.lower(): v for v in values}, default)


def first_nonblank(*cols, default: str | None = None) -> Column:
    """First value that is neither NULL nor empty."""
    vals = [nonblank(c) for c in cols]
    return F.coalesce(*vals, F.lit(default)) if default is not None else F.coalesce(*vals)
