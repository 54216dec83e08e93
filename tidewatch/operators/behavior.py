"""Personal and group baselines, drift scores, novelty flags.

Rows are session rows with ``employee_id``, ``session_id``, ``start_time``,
``office_location``, ``device_id``, ``browser``, ``operating_system`` and
``resource_mask`` (bit i = resource i touched).  Sessions of one entity are
numbered once (``number_sessions``); every operator then works on blocks of
that numbering, so no task holds the whole history of an entity.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.columns import clamp, micros
from tidewatch.lineage import checkpointed
from tidewatch.operators import ordering as od

BLOCK = 512
KINDS = {"location": "office_location", "device": "device_id", "browser": "browser",
         "operating_system": "operating_system", "method": "login_method"}


def number_sessions(sessions: DataFrame, min_rows: int = od.HOT_ROWS, check: bool = True) -> DataFrame:
    """0-based ``n_before``: how many earlier sessions the entity has.

    Gap sessions of an entity are at least the gap apart, so their number is
    bounded by the time span and needs no look for hot keys; set ``check`` for
    sessions with given ids.
    """
    df, o = od.order_by(sessions, ["employee_id"], micros("start_time"), ["session_id"], min_rows, check)
    return od.done(od.position_and_lag(df, o, "n_before"))


# --- baselines -----------------------------------------------------------

def personal_baseline(sessions: DataFrame) -> DataFrame:
    """Scalar part of the baseline over the whole history, one row per entity."""
    hour, n = F.hour("start_time"), F.count("*")
    return sessions.groupBy("employee_id").agg(
        n.alias("sessions"), F.min(hour).alias("hour_min"), F.max(hour).alias("hour_max"),
        F.avg(F.when(F.weekday("start_time") >= 5, 1.0).otherwise(0.0)).alias("weekend_share"),
        F.avg(F.col("remote_session").cast("double")).alias("remote_share"),
        (F.avg("duration_seconds") / 60).alias("mean_minutes"),
        F.when(n > 1, F.stddev_pop("duration_seconds") / 60).otherwise(10.0 / 60).alias("sd_minutes"),
        F.floor(F.avg("n_events")).alias("mean_actions"),
        F.when(n > 1, F.stddev_pop("n_events")).otherwise(3.0).alias("sd_actions"))


def baseline_shares(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Distribution part, long form: (entity, kind, value, share of sessions).

    Resources count events per session, so their share can exceed 1.
    """
    total = sessions.groupBy("employee_id").agg(F.count("*").alias("_n"))
    vals = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in KINDS.items()],
                   F.struct(F.lit("hour").alias("kind"), F.hour("start_time").cast("string").alias("value")))
    s = (sessions.select("employee_id", F.inline(vals))
         .groupBy("employee_id", "kind", "value").agg(F.count("*").alias("_c")))
    r = (events.where(F.col("resource").isNotNull())
         .groupBy("employee_id", F.lit("resource").alias("kind"), F.col("resource").alias("value"))
         .agg(F.count("*").alias("_c")))
    return s.unionByName(r).join(total, "employee_id").select(
        "employee_id", "kind", "value", (F.col("_c") / F.col("_n")).alias("share"))


def baseline_maps(shares: DataFrame) -> DataFrame:
    """Long shares as one map column per kind (bounded kinds only: hour, method,
    browser, OS, resource; locations and devices stay in long form)."""
    small = ["hour", "method", "browser", "operating_system", "resource"]
    return shares.where(F.col("kind").isin(small)).groupBy("employee_id").agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("kind") == k, F.struct("value", "share"))))).alias(f"{k}_shares") for k in small])


def baseline_asof(numbered: DataFrame, min_rows: int = od.HOT_ROWS, check: bool = True) -> DataFrame:
    """Baseline of the earlier sessions only, at every session.

    Scalars are running moments of centred values; for each kind the share is that of
    the session's own value among the earlier sessions (``change log`` of all values:
    :func:`baseline_history`).  One layout by entity serves them all.
    """
    n, own = F.col("n_before"), numbered.columns
    out = (numbered.withColumn("_hour", F.hour("start_time").cast("double"))
           .withColumn("_weekend", F.when(F.weekday("start_time") >= 5, 1.0).otherwise(0.0))
           .withColumn("_remote", F.col("remote_session").cast("double")))
    out, o = od.order_by(out, ["employee_id"], n, [], min_rows, check)
    out = od.running_moments(out, o, {"_h": "_hour", "_w": "_weekend", "_r": "_remote", "_d": "duration_seconds", "_a": "n_events"})
    out = od.done(od.count_before(out, o, {f"_seen_{kind}": c for kind, c in KINDS.items()}))
    return out.select(
        *own, F.col("_h_mean").alias("mean_hour"), F.col("_w_mean").alias("weekend_share"),
        F.col("_r_mean").alias("remote_share"), (F.col("_d_mean") / 60).alias("mean_minutes"),
        F.when(n > 1, F.col("_d_sd") / 60).alias("sd_minutes"), F.col("_a_mean").alias("mean_actions"),
        F.when(n > 1, F.col("_a_sd")).alias("sd_actions"),
        *[F.when(n > 0, F.col(f"_seen_{kind}") / n).alias(f"{kind}_share") for kind in KINDS])


def baseline_history(numbered: DataFrame, min_rows: int = od.HOT_ROWS, check: bool = True) -> DataFrame:
    """Change log of every value's running count: the distribution as of any
    session is, per value, the latest row with ``valid_from`` <= ``n_before``."""
    vals = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in KINDS.items()])
    long = numbered.select("employee_id", "n_before", F.inline(vals))
    d, o = od.order_by(long, ["employee_id", "kind", "value"], F.col("n_before"), [], min_rows, check)
    return od.done(od.position_and_lag(d, o, "_seen")).select(
        "employee_id", "kind", "value", (F.col("n_before") + 1).alias("valid_from"),
        (F.col("_seen") + 1).alias("count"))


def group_baseline(emp: DataFrame, by: str | None = None) -> DataFrame:
    """Truncated mean working hours per department, role or (no ``by``) overall."""
    aggs = [F.count("*").alias("members"),
            F.avg("work_start").cast("int").alias("work_start"), F.avg("work_end").cast("int").alias("work_end")]
    return emp.groupBy(by).agg(*aggs) if by else emp.agg(*aggs)


def department_resources_baseline(emp: DataFrame) -> DataFrame:
    """Merged resource probabilities of a department: sum of p / members."""
    n = emp.groupBy("department").agg(F.count("*").alias("_n"))
    long = emp.select("department", F.explode("resource_probabilities").alias("resource", "p"))
    return (long.groupBy("department", "resource").agg(F.sum("p").alias("_p"))
            .join(n, "department")
            .select("department", "resource", (F.col("_p") / F.col("_n")).alias("probability")))


def effective_baseline(numbered: DataFrame, emp: DataFrame, min_history: int = 3,
                       min_rows: int = od.HOT_ROWS, check: bool = True) -> DataFrame:
    """Which baseline applies at each session and its working hours.

    At least ``min_history`` earlier sessions: personal; else role, department,
    organisation, the first that exists.
    """
    out, o = od.order_by(numbered.withColumn("_hour", F.hour("start_time")), ["employee_id"],
                         F.col("n_before"), [], min_rows, check)
    out = od.position_and_lag(out, o, "_p", {"_before": "_hour"})
    out = od.running_max(out, o, "_hi", "_before")
    out = od.running_max(out.withColumn("_minus", -F.col("_before")), o, "_lo", "_minus")
    out = od.done(out.withColumn("_lo", -F.col("_lo")))
    role = group_baseline(emp.where(F.col("role").isNotNull()), "role").select(
        F.col("role").alias("_role"), F.struct("work_start", "work_end").alias("_r"))
    dept = group_baseline(emp.where(F.col("department").isNotNull()), "department").select(
        F.col("department").alias("_dept"), F.struct("work_start", "work_end").alias("_d"))
    org = group_baseline(emp).select(F.struct("work_start", "work_end").alias("_o"))
    e = emp.select("employee_id", F.col("role").alias("_role"), F.col("department").alias("_dept"))
    out = (out.join(e, "employee_id", "left").join(role, "_role", "left")
           .join(dept, "_dept", "left").crossJoin(F.broadcast(org)))  # org is one row
    own = F.col("n_before") >= min_history
    pick = F.coalesce("_r", "_d", "_o")
    return out.select(
        "session_id", "employee_id", "n_before",
        F.when(own, "personal").when(F.col("_r").isNotNull(), "role")
        .when(F.col("_d").isNotNull(), "department").otherwise("organisation").alias("source"),
        F.when(own, F.col("_lo")).otherwise(pick["work_start"]).alias("work_start"),
        F.when(own, F.col("_hi")).otherwise(pick["work_end"]).alias("work_end"))


# --- deviations against a fixed window of earlier sessions ----------------

def categorical_deviation(value, window) -> Column:
    """1 - share of ``value`` in the array ``window``; 0 for an empty window."""
    v, w = F.col(value), F.col(window)
    return F.when(F.size(w) > 0, 1 - F.size(F.filter(w, lambda x: x.eqNullSafe(v))) / F.size(w)).otherwise(0.0)


def hour_deviation(hour, mean) -> Column:
    """Distance from the mean hour, 12 h or more is 1; 0 without earlier sessions."""
    return F.when(F.col(mean).isNull(), 0.0).otherwise(F.least(F.abs(F.col(hour) - F.col(mean)) / 12, F.lit(1.0)))


def resource_bits(mask: str = "resource_mask") -> Column:
    """The set bits of a mask as single-bit longs."""
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(len(dims.RESOURCES))])
    m = F.coalesce(F.col(mask), F.lit(0).cast("long"))
    return F.filter(bits, lambda b: b.bitwiseAND(m) != 0)


def resource_deviation(bits, window, alpha: float = dims.LAPLACE_ALPHA) -> Column:
    """Mean over touched resources of 1 - (f + alpha) / (n + alpha), where f is the
    number of window sessions (masks) touching the resource; 0 without resources."""
    cur, w = F.col(bits), F.col(window)
    n = F.size(w)
    dev = F.transform(cur, lambda b: 1 - (F.size(F.filter(w, lambda m: m.bitwiseAND(b) != 0)) + alpha) / (n + alpha))
    mean = F.aggregate(dev, F.lit(0.0), lambda a, x: a + x) / F.size(cur)
    return F.when((n > 0) & (F.size(cur) > 0), clamp(mean, 0.0, 1.0)).otherwise(0.0)


def behaviour_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the six deviations, 0..100."""
    return sum((F.col(d) * w for d, w in (weights or dims.DEVIATIONS).items()), F.lit(0.0))


def window_deviations(numbered: DataFrame, size: int = dims.DRIFT_WINDOW, block: int = BLOCK) -> DataFrame:
    """Six deviations against the last ``size`` sessions, whatever their scores.

    Trailing windows run per block with a halo, never per whole entity.
    """
    b = od.blocks_with_halo(numbered, "n_before", block, size)
    w = Window.partitionBy("employee_id", "block").orderBy("n_before").rowsBetween(-size, -1)
    b = b.withColumn("_hour", F.hour("start_time").cast("double")).withColumn("_bits", resource_bits())
    names = {"office_location": "location_deviation", "device_id": "device_deviation",
             "browser": "browser_deviation", "operating_system": "operating_system_deviation"}
    for c in [*names, "resource_mask"]:
        # structs, because collect_list leaves NULLs out and a missing value counts in the window's size
        b = b.withColumn(f"_w_{c}", F.transform(F.collect_list(F.struct(F.col(c).alias("v"))).over(w), lambda x: x["v"]))
    b = b.withColumn("_mean", F.avg("_hour").over(w))
    for c, d in names.items():
        b = b.withColumn(d, categorical_deviation(c, f"_w_{c}"))
    b = (b.withColumn("working_hours_deviation", hour_deviation("_hour", "_mean"))
         .withColumn("resource_access_deviation", resource_deviation("_bits", "_w_resource_mask"))
         .withColumn("behaviour_score", behaviour_score()))
    return b.where(~F.col("is_halo")).select(
        "session_id", "employee_id", "n_before", *dims.DEVIATIONS, "behaviour_score")


# --- the drift monitor ------------------------------------------------------

SLICE = 1_000_000   # sessions of one entity that one task folds
SPECULATIVE = 3     # rounds in which every slice with a new start is folded again

_WINDOW = "array<struct<loc:string,dev:string,br:string,os:string,hr:double,mask:bigint>>"
_ROW = ["loc", "dev", "br", "os", "hr", "mask"]
_ARROW_WINDOW = pa.list_(pa.struct([*((c, pa.string()) for c in _ROW[:4]), ("hr", pa.float64()), ("mask", pa.int64())]))
_FOLDED = ("employee_id string, slice bigint, n_before bigint, session_id string, loc string, dev string, br string, os string, hr double, mask bigint, "
           + ", ".join(f"{d} double" for d in dims.DEVIATIONS) + f", behaviour_score double, accepted boolean, end {_WINDOW}")


class _Window:
    """The last accepted sessions with their counts, so that a score costs no walk over them."""

    def __init__(self, size: int, alpha: float, rows=()):
        self.size, self.alpha, self.rows, self.hours = size, alpha, deque(), 0.0
        self.counts, self.bits = [{}, {}, {}, {}], {}
        for r in rows:
            self.add(r)

    def _count(self, row: tuple, by: int) -> None:
        for counts, v in zip(self.counts, row):
            counts[v] = counts.get(v, 0) + by
            if not counts[v]:
                del counts[v]
        self.hours += by * row[4]
        m = row[5]
        while m:
            b = m & -m
            self.bits[b] = self.bits.get(b, 0) + by
            m ^= b

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self._count(row, 1)
        if len(self.rows) > self.size:
            self._count(self.rows.popleft(), -1)

    def deviations(self, row: tuple) -> list[float]:
        n = len(self.rows)
        if n < dims.DRIFT_MIN_WINDOW:
            return [0.0] * 6
        out = [1 - counts.get(v, 0) / n for counts, v in zip(self.counts, row)]
        out.append(min(abs(row[4] - self.hours / n) / 12, 1.0))
        total, touched, m = 0.0, 0, row[5]
        while m:
            b = m & -m
            total, touched, m = total + 1 - (self.bits.get(b, 0) + self.alpha) / (n + self.alpha), touched + 1, m ^ b
        out.append(min(max(total / touched, 0.0), 1.0) if touched else 0.0)
        return out


def _fold(rows: DataFrame, starts: DataFrame | None, size: int, accept: float, alpha: float, block: int) -> DataFrame:
    """Folds each slice in the order of its sessions, from the window in ``starts`` (empty if none).

    Tasks stream sorted rows: only the window of the slice at hand lives from batch to batch.  The last row of a full
    slice carries the window in ``end``.  A start is a row of its own, placed before the slice's first session.
    """
    weights = list(dims.DEVIATIONS.values())
    given = rows.withColumn("start", F.lit(None).cast(_WINDOW))
    if starts is not None:
        given = given.unionByName(starts.withColumn("n_before", F.lit(-1).cast("long")), allowMissingColumns=True)
    columns = ["employee_id", "slice", "n_before", "session_id", *_ROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window = None, None
        for batch in batches:
            out = [[] for _ in range(9)]
            own = []
            cols = [batch.column(c).to_pylist() for c in ("employee_id", "slice", "n_before", *_ROW, "start")]
            for i, (who, part, pos, loc, dev, br, os_, hr, mask, start) in enumerate(zip(*cols)):
                if (who, part) != key:
                    key, window = (who, part), _Window(size, alpha)
                if pos < 0:
                    window = _Window(size, alpha, [tuple(r[c] for c in _ROW) for r in start])
                    continue
                row = (loc, dev, br, os_, hr, mask)
                devs = window.deviations(row)
                score = 0.0
                for d, w in zip(devs, weights):
                    score += d * w
                if score < accept:
                    window.add(row)
                own.append(i)
                for col, v in zip(out, (*devs, score, score < accept, [dict(zip(_ROW, r)) for r in window.rows] if (pos + 1) % block == 0 else None)):
                    col.append(v)
            kept = batch.select(columns).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, pa.float64()) for c in out[:7]), pa.array(out[7], pa.bool_()), pa.array(out[8], _ARROW_WINDOW)],
                                             [*columns, *dims.DEVIATIONS, "behaviour_score", "accepted", "end"])

    keyed = given.repartition("employee_id", "slice").sortWithinPartitions("employee_id", "slice", "n_before")
    return keyed.select(*columns, "start").mapInArrow(run, _FOLDED)


def drift_scores(numbered: DataFrame, size: int = dims.DRIFT_WINDOW, accept: float = dims.DRIFT_ACCEPT_BELOW,
                 alpha: float = dims.LAPLACE_ALPHA, block: int = SLICE) -> DataFrame:
    """Sequential drift monitor per entity.

    A session's score decides whether it enters the window that scores the next ones, so this is a fold: one pass
    over sorted rows, linear in the sessions.  Only entities with more than ``block`` sessions are cut into slices.
    Slices start from the end window of the slice before, folded again until no start changes; at that fixpoint
    every slice started from the true window.  For a few rounds all slices with a new start are folded, after that
    only the first one of each entity, so the work stays linear even if an entity is rejected for good.
    A session without a start time counts as hour 0, one without resources as touching none.
    """
    rows = numbered.select(
        "employee_id", F.floor(F.col("n_before") / block).cast("long").alias("slice"), F.col("n_before").cast("long").alias("n_before"), "session_id",
        F.col("office_location").alias("loc"), F.col("device_id").alias("dev"), F.col("browser").cast("string").alias("br"),
        F.col("operating_system").cast("string").alias("os"), F.coalesce(F.hour("start_time").cast("double"), F.lit(0.0)).alias("hr"),
        F.coalesce("resource_mask", F.lit(0)).cast("long").alias("mask"))
    folded = checkpointed(_fold(rows, None, size, accept, alpha, block))
    result = ["employee_id", "session_id", "n_before", *dims.DEVIATIONS, "behaviour_score", "accepted"]
    later = folded.where(F.col("slice") > 0)
    if not later.limit(1).count():
        return folded.select(*result)
    again = later.select("employee_id", "slice", "n_before", "session_id", *_ROW)
    key = F.struct(F.col("employee_id").alias("k"), F.col("slice").alias("b"))   # a struct, so that a NULL entity joins too
    ends = folded.where(F.col("end").isNotNull()).select(key.alias("key"), "end")
    starts = checkpointed(later.groupBy("employee_id", "slice").agg(F.expr(f"cast(array() AS {_WINDOW})").alias("start")).select(key.alias("key"), "start"))
    turn = 0
    while True:
        before = ends.select(F.struct(F.col("key.k").alias("k"), (F.col("key.b") + 1).alias("b")).alias("_key"), F.col("end").alias("next"))
        joined = checkpointed(starts.join(before, F.col("key").eqNullSafe(F.col("_key"))).select("key", "start", "next", (F.col("next") != F.col("start")).alias("changed")))
        changed = joined.where("changed")
        if not changed.limit(1).count():
            break
        if turn >= SPECULATIVE:
            first = changed.groupBy(F.struct("key.k").alias("_of")).agg(F.min("key.b").alias("_b"))
            changed = changed.join(first, F.struct("key.k").eqNullSafe(F.col("_of")) & (F.col("key.b") == F.col("_b")))
        fresh = checkpointed(changed.select("key", F.col("next").alias("start")))
        begin = fresh.select(F.col("key.k").alias("employee_id"), F.col("key.b").alias("slice"), "start")
        mine = again.join(begin.select(key.alias("key")), key.eqNullSafe(F.col("key")), "left_semi")
        new = _fold(mine, begin, size, accept, alpha, block).where(F.col("end").isNotNull()).select(key.alias("_new"), F.col("end").alias("_end"))
        ends = checkpointed(ends.join(new, F.col("key").eqNullSafe(F.col("_new")), "left").select("key", F.coalesce("_end", "end").alias("end")))
        starts = checkpointed(starts.join(fresh.select(F.col("key").alias("_key"), F.col("start").alias("_start")), F.col("key").eqNullSafe(F.col("_key")), "left")
                              .select("key", F.coalesce("_start", "start").alias("start")))
        turn += 1
    begin = starts.select(F.col("key.k").alias("employee_id"), F.col("key.b").alias("slice"), "start")
    return folded.where(F.col("slice") == 0).select(*result).unionByName(_fold(again, begin, size, accept, alpha, block).select(*result))


# --- novelty ---------------------------------------------------------------

def novelty_flags(numbered: DataFrame, min_rows: int = od.HOT_ROWS, check: bool = True) -> DataFrame:
    """0/1 flags: value never seen in an earlier session of the entity; hour more
    than two standard deviations off with three or more earlier sessions.  All zero
    for the first session.

    A flagged session is the entity's first one with the value.  One layout by entity
    serves all flags: counts of earlier equal values, the union of earlier resource
    masks and running moments of the hour; nothing is joined back.
    """
    names = {"location_deviation": "office_location", "device_deviation": "device_id",
             "browser_deviation": "browser", "operating_system_deviation": "operating_system"}
    n = F.col("n_before")
    h = (numbered.withColumn("_hour", F.hour("start_time").cast("double"))
         .withColumn("_mask", F.coalesce("resource_mask", F.lit(0).cast("long")).bitwiseAND((1 << len(dims.RESOURCES)) - 1)))
    h, o = od.order_by(h, ["employee_id"], n, [], min_rows, check)
    h = od.running_mask(od.running_moments(h, o, {"_h": "_hour"}), o, "_had", "_mask")
    h = od.done(od.count_before(h, o, {f"_seen_{d}": c for d, c in names.items()}))
    odd = {d: F.col(f"_seen_{d}") == 0 for d in names}
    odd["resource_access_deviation"] = F.col("_mask").bitwiseAND(F.bitwise_not("_had")) != 0
    odd["working_hours_deviation"] = (n >= 3) & (F.col("_h_sd") > 0.1) & (F.abs(F.col("_hour") - F.col("_h_mean")) > 2 * F.col("_h_sd"))
    return h.select("session_id", "employee_id", "n_before",
                    *[F.when((n > 0) & odd[d], 1.0).otherwise(0.0).alias(d) for d in dims.DEVIATIONS])


# --- access checks -----------------------------------------------------------

def access_violations(events: DataFrame, emp: DataFrame, res: DataFrame) -> DataFrame:
    """Events on a resource the employee's department may not use, or from a
    device the employee does not own."""
    e = emp.select("employee_id", "department", "allowed_devices")
    r = F.broadcast(res.select(F.col("resource_name").alias("resource"), "allowed_departments"))  # 24 rows
    j = events.select("event_id", "employee_id", "device_id", "resource").join(e, "employee_id").join(r, "resource", "left")
    bad_res = F.col("resource").isNotNull() & ~F.array_contains("allowed_departments", F.col("department"))
    bad_dev = ~F.array_contains("allowed_devices", F.col("device_id"))
    return (j.withColumn("resource_denied", F.coalesce(bad_res, F.lit(False)))
            .withColumn("device_denied", bad_dev)
            .where("resource_denied OR device_denied")
            .select("event_id", "employee_id", "resource_denied", "device_denied"))
