"""Keyed streams folded in event-time order.

Rows of a key are held back in state until the horizon (largest time seen less ``delay``) has passed them, then released in order of (time, tie) and
folded over what the key carries.  So the order across micro-batches is made, not assumed: any input whose rows come at most ``delay`` late gives the
rows of the batch operator.  A row that comes when later rows of its key are out already can't be put in order; it is returned with ``late`` set, not dropped.

State of a key: its held rows, what the fold carries, the time up to which it is released; event-time timers release rows.  With ``idle`` set, a row that
comes after a longer break than that is folded without what was carried, and a timer clears the state of a key that has had no row for so long.  Rows without a time come first, as soon as they arrive.

With ``buckets`` the keys share so many state entries by hash: one call takes the rows of many keys, held rows are stored as a block for each call, and a timer releases all rows of the entry that
the horizon has passed.  Order, carried rows and marks stay those of each key.  A call costs milliseconds however few rows it has, so streams of many keys need this.

The watermark itself trails by ``grace``, so that Spark's own filter lets late rows through to the operator.  Rows later than that are
dropped and counted by Spark (``numRowsDroppedByWatermark``).  ``grace`` must be less than the time from 1970 to the data.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.columns import micros

DAY_MS = 86_400_000
NO_TIME = -(1 << 63)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}

#: (carried rows, [(time in microseconds or None, row as a dictionary)]) -> (carried rows, an output row for each)
Fold = Callable[[list[tuple], list[tuple[int | None, dict]]], tuple[list[tuple], list[tuple]]]


_HELD = pa.schema([("entity", pa.string()), ("t", pa.int64()), ("tie", pa.string()), ("row", pa.string())])


def _pack(held: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as w:
        w.write_table(held)
    return sink.getvalue().to_pybytes()


class Ordered(StatefulProcessor):
    """Holds, releases in order and folds the rows of the keys of one state entry."""

    def __init__(self, fold: Fold, carry: str, tie: str, out: list[str], lead_ms: int, idle_ms: int | None):
        self.fold, self.carry_schema, self.out, self.lead_ms, self.idle_ms = fold, carry, out, lead_ms, idle_ms
        self.tie = int if tie == "bigint" else str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.carry = handle.getListState("carry", f"entity string, {self.carry_schema}")
        self.mark = handle.getListState("mark", "entity string, t bigint")
        self.released: set[tuple] = set()   # a watermark may pass several timers of a key; the first releases all

    def _frame(self, rows: list[str], late: bool, more: list[tuple]) -> pd.DataFrame:
        data = [(row, late, *(more[i] if more else [None] * len(self.out))) for i, row in enumerate(rows)]
        return pd.DataFrame(data, columns=["row", "late", *self.out], dtype=object)

    def _timer(self, t: int) -> int:
        """When the watermark stands here, the horizon has reached ``t``."""
        return max(-(-t // 1000) - self.lead_ms, 1)

    def _runs(self, mark: int, ready: list[tuple]) -> Iterator[tuple[bool, list[tuple]]]:
        """Ordered rows cut where the key was idle for longer than it may; whether such a break leads."""
        begin, broken = 0, False
        for i, (_, t, *_) in enumerate(ready):
            if self.idle_ms is not None and mark != NO_TIME and t - mark > self.idle_ms * 1000:
                if i > begin:
                    yield broken, ready[begin:i]
                begin, broken = i, True
            mark = max(mark, t)
        yield broken, ready[begin:]

    def _marks(self) -> dict[str, int]:
        return dict(self.mark.get()) if self.mark.exists() else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        marks = self._marks()
        last = None
        for pdf in rows:
            t = pdf["t"].to_numpy(dtype=np.int64)
            keep = (t == NO_TIME) | (t > np.array([marks.get(e, NO_TIME) for e in pdf["entity"]], dtype=np.int64))
            if keep.any():
                self.held.appendValue((_pack(pa.Table.from_pandas(pdf.loc[keep, _HELD.names], _HELD, preserve_index=False)),))
                newest = int(t[keep].max())
                last = newest if last is None else max(last, newest)
            if not keep.all():
                yield self._frame(pdf["row"][~keep].tolist(), True, [])
        if last is not None:
            self.handle.registerTimer(self._timer(last))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.released:
            return
        self.released.add(key)
        now = timerValues.getCurrentWatermarkInMs()
        horizon = (now + self.lead_ms) * 1000
        held = pa.concat_tables([_HELD.empty_table(), *(pa.ipc.open_stream(b).read_all() for (b,) in (self.held.get() if self.held.exists() else []))])
        due = held["t"].to_numpy() <= horizon
        ready, rest, marks = held.filter(pa.array(due)), held.filter(pa.array(~due)), self._marks()
        gone: set[str] = set()
        carried: dict[str, list[tuple]] = {}
        for e, *c in self.carry.get() if self.carry.exists() else []:
            carried.setdefault(e, []).append(tuple(c))
        if ready.num_rows:
            ties = [None if x is None else self.tie(x) for x in ready["tie"].to_pylist()]
            ordered = sorted(zip(ready["entity"].to_pylist(), ready["t"].to_pylist(), ties, ready["row"].to_pylist()), key=lambda r: (r[0], r[1], r[2] is not None, r[2]))
            out: list[tuple] = []
            for e, own in groupby(ordered, key=lambda r: r[0]):
                own, mark = list(own), marks.get(e, NO_TIME)
                for after_break, run in self._runs(mark, own):
                    carried[e], more = self.fold([] if after_break else carried.get(e, []), [(None if t == NO_TIME else t, json.loads(row)) for _, t, _, row in run])
                    out += more
                marks[e] = max(mark, own[-1][1])
            self.held.clear()
            if rest.num_rows:
                self.held.appendValue((_pack(rest),))
            yield self._frame([r[3] for r in ordered], False, out)
        next_at = [self._timer(int(rest["t"].to_numpy().min()))] if rest.num_rows else []
        if self.idle_ms is not None:
            waiting = set(rest["entity"].to_pylist())
            ends = {e: t + (self.idle_ms + 1) * 1000 for e, t in marks.items() if t != NO_TIME and e not in waiting}
            gone = {e for e, end in ends.items() if end <= horizon}
            next_at += [self._timer(min(end for e, end in ends.items() if e not in gone))] if len(gone) < len(ends) else []
        if gone or ready.num_rows:
            for state, entries in ((self.carry, [(e, *c) for e, cs in carried.items() if e not in gone for c in cs]), (self.mark, [(e, t) for e, t in marks.items() if e not in gone])):
                state.clear()
                if entries:
                    state.put(entries)
        if next_at:
            self.handle.registerTimer(max(min(next_at), now + 1))

    def close(self) -> None:
        pass


def _ms(interval: str) -> int:
    """Milliseconds of "2 hours", "30 minutes", "1 day" and the like."""
    number, unit = interval.split()
    return int(float(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS}[unit.removesuffix("s")])


def fold_stream(rows: DataFrame, keys: list[str], time: str, tie: str, fold: Fold, carry: str, out: str, delay: str, grace: str = "3650 days", idle: str | None = None,
                buckets: int | None = None) -> DataFrame:
    """The rows of a stream with ``late`` and the fold's columns ``out`` (null for late rows), each once, in order within a key.

    ``carry``: schema of what a key carries between rows (few rows of bounded size).  ``tie``: a string or long column that orders equal times.  ``buckets``: state entries that
    keys share (None: one for each key); with so many that the rows of one held at once fit in a task's memory, and the same number after a restart.
    """
    spark = rows.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKS:  # list state and timers need this store
        spark.conf.set(_PROVIDER, _ROCKS)
    lead, kinds = _ms(grace) - _ms(delay), dict(rows.dtypes)
    if lead < 0:
        raise ValueError("grace: delay at least")
    tie_kind = "string" if kinds[tie] == "string" else "bigint"
    names = [f.split()[0] for f in out.split(", ")]
    held = rows.withColumn("_at", F.col(time)).withWatermark("_at", grace).select(
        "_at", F.to_json(F.struct(*keys), _JSON).alias("entity"), F.coalesce(micros("_at"), F.lit(NO_TIME)).alias("t"), F.col(tie).cast("string").alias("tie"), F.to_json(F.struct(*rows.columns), _JSON).alias("row")).withColumn(
        "_key", F.col("entity") if buckets is None else F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("string"))
    idle_ms = None if idle is None else _ms(idle)
    done = held.groupBy("_key").transformWithStateInPandas(Ordered(fold, carry, tie_kind, names, lead, idle_ms), f"row string, late boolean, {out}", "append", "eventTime")
    return done.select(F.from_json("row", rows.schema, _JSON).alias("_r"), "late", *names).select("_r.*", "late", *names)
