"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import dims


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since the epoch; keeps fractions of a second."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def ordinal(c, values: list[str], unknown: float = -1.0) -> Column:
    """Position of a text in a fixed list as a double."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, float(i))])
    return F.coalesce(table[col(c)], F.lit(unknown))


def lookup(c, mapping: dict, default=None) -> Column:
    """Literal lookup table; ``default`` for unknown keys."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    got = table[col(c)]
    return got if default is None else F.coalesce(got, F.lit(default))


def contains_any(text, needles: list[str]) -> Column:
    return reduce(or_, [col(text).contains(n) for n in needles])


def nonblank(c) -> Column:
    """NULL for NULL and for the empty text."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def clamp(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def ratio(num, den) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(0.0))


def uuid4_text(*keys) -> Column:
    """A UUID of version-4 shape that depends only on the given keys."""
    h = F.md5(F.concat_ws("\u0001", *[col(k).cast("string") for k in keys]))
    return F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-a$4-$5")


def command_text() -> Column:
    """Joined command sequence, lower case."""
    return F.lower(F.coalesce(F.array_join("command_sequence", " "), F.lit("")))


def suspicious_command(cmd: Column, proc: Column) -> Column:
    """Known malware name or an evasion flag in the command."""
    malware = contains_any(cmd, dims.MALWARE_NAMES) | contains_any(proc, dims.MALWARE_NAMES)
    return malware | contains_any(cmd, dims.SUSPICIOUS_FLAGS)
