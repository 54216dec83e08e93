"""Ordered computations per key that survive hot keys.

A plain ``Window.partitionBy(key)`` puts one key into one task.  Keys with more
rows than ``HOT_ROWS`` are therefore dealt by ranges of (key, order, ties): a
range is a slice, windowed on its own, and slice totals carry position, previous
row and running sums across the cuts.  Ranges are cut on the ties as well, so
rows with one equal order value are spread too, and there are as many as the
rows need.  Every row has the value of the plain window and every path gives the
same columns; only the layout changes.  Keys may be NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.lineage import checkpointed

HOT_ROWS = 2_000_000   # rows that one window partition takes
TASK_ROWS = 100_000    # rows of cold keys that a task gets on large frames

_SLICE, _HOT, _BY, _TOTAL = "_slice", "_hot", "_by", "_total"


@dataclass(frozen=True)
class Order:
    keys: tuple[str, ...]
    ties: tuple[str, ...]
    sliced: bool

    def window(self) -> Window:
        part = list(self.keys) + ([_SLICE] if self.sliced else [])
        return Window.partitionBy(*part).orderBy(_BY, *self.ties)


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on equal or both NULL; the columns of ``on`` come from the left."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[f"_r_{c}"]) for c in on])
    return left.join(right, same, how).drop(*[f"_r_{c}" for c in on])


def order_by(df: DataFrame, keys: list[str], by: Column, ties: list[str],
             min_rows: int = HOT_ROWS, check: bool = True) -> tuple[DataFrame, Order]:
    """Prepare ``df`` for ordered work per ``keys``.

    ``check=False`` skips the look for hot keys where the group size is bounded
    by construction.  Without keys the whole frame is one group.  The rows of hot
    keys are stored once (a checkpoint), so that all totals see the same slices;
    no row and no key reaches the driver.
    """
    df = df.withColumn(_BY, by)
    plain = df, Order(tuple(keys), tuple(ties), False)
    if not check:
        return plain
    every = df.groupBy(*keys).agg(F.count("*").alias(_TOTAL))
    sizes = every.where(F.col(_TOTAL) > min_rows)
    rows, hot_rows = every.agg(F.sum(_TOTAL), F.sum(F.when(F.col(_TOTAL) > min_rows, F.col(_TOTAL)))).first()
    if not hot_rows:
        # a task's memory is that of its rows: their number must not grow with the frame
        return plain if not keys or rows is None or rows <= 8 * TASK_ROWS else (df.repartition(-(-rows // TASK_ROWS), *keys), plain[1])
    hot, cold = df, None
    if keys:
        hot = _join(df, sizes, list(keys), "left_semi")
        cold = _join(df, sizes, list(keys), "left_anti")
    n = -(-hot_rows // min(min_rows, TASK_ROWS)) + 1
    hot = hot.repartitionByRange(n, *keys, _BY, *ties)
    hot = checkpointed(hot.withColumn(_SLICE, F.spark_partition_id()).withColumn(_HOT, F.lit(True)))
    if cold is not None:
        hot = hot.unionByName(cold.withColumn(_SLICE, F.lit(0)).withColumn(_HOT, F.lit(False)))
    return hot, Order(tuple(keys), tuple(ties), True)


def _totals(df: DataFrame, o: Order, aggs: list[Column]) -> DataFrame:
    return df.where(_HOT).groupBy(*o.keys, _SLICE).agg(*aggs)


def _attach(df: DataFrame, totals: DataFrame, o: Order) -> DataFrame:
    """Totals by key and slice; cold keys get none."""
    return _join(df, totals.withColumn("_of_hot", F.lit(True)), [*o.keys, _SLICE]).drop("_of_hot")


def position_and_lag(df: DataFrame, o: Order, pos: str = "pos",
                     lag: dict[str, str] | None = None) -> DataFrame:
    """0-based position within the key and the previous row's columns.

    ``lag`` maps a new column name to the column whose previous value it holds.
    """
    lag = lag or {}
    w = o.window()
    out = df.withColumn(pos, (F.row_number().over(w) - 1).cast("long"))
    for name, src in lag.items():
        out = out.withColumn(name, F.lag(src).over(w))
    if not o.sliced:
        return out
    tail = F.struct(*[F.col(c).alias(n) for n, c in lag.items()], F.lit(1).alias("_x"))
    tot = _totals(df, o, [F.count("*").alias("_n"),
                          F.max_by(tail, F.struct(_BY, *o.ties)).alias("_tail")])
    wt = Window.partitionBy(*o.keys).orderBy(_SLICE)
    tot = tot.select(*o.keys, _SLICE,
                     F.coalesce(F.sum("_n").over(wt.rowsBetween(Window.unboundedPreceding, -1)),
                                F.lit(0)).alias("_off"),
                     F.lag("_tail").over(wt).alias("_tail"))
    out = _attach(out, tot, o)
    for name in lag:
        out = out.withColumn(name, F.when(F.col(pos) == 0, F.col("_tail")[name]).otherwise(F.col(name)))
    return (out.withColumn(pos, F.col(pos) + F.coalesce("_off", F.lit(0))).drop("_off", "_tail"))


def running_sum(df: DataFrame, o: Order, sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums; ``sums`` maps a new name to the summed column."""
    w = o.window().rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for name, src in sums.items():
        out = out.withColumn(name, F.sum(src).over(w))
    if not o.sliced:
        return out
    tot = _totals(df, o, [F.sum(s).alias(f"_t_{n}") for n, s in sums.items()])
    wt = Window.partitionBy(*o.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*o.keys, _SLICE, *[F.sum(f"_t_{n}").over(wt).alias(f"_o_{n}") for n in sums])
    out = _attach(out, tot, o)
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(f"_o_{n}", F.lit(0))).drop(f"_o_{n}")
    return out


def running_max(df: DataFrame, o: Order, name: str, src: str) -> DataFrame:
    """Inclusive running maximum."""
    out = df.withColumn(name, F.max(src).over(o.window().rowsBetween(Window.unboundedPreceding, 0)))
    if not o.sliced:
        return out
    wt = Window.partitionBy(*o.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    tot = _totals(df, o, [F.max(src).alias("_m")]).select(
        *o.keys, _SLICE, F.max("_m").over(wt).alias("_pm"))
    return _attach(out, tot, o).withColumn(name, F.greatest(name, "_pm")).drop("_pm")


def running_moments(df: DataFrame, o: Order, moments: dict[str, str]) -> DataFrame:
    """Count, mean and population deviation of the earlier rows' non-NULL values.

    ``moments`` maps a name to the source column; ``{name}_n``, ``{name}_mean`` and
    ``{name}_sd`` are added (mean and deviation NULL without earlier values).  Squares
    are centred, so large values with a small spread keep their digits: inside a slice
    by Spark's central moments, across slices around the mean of the whole key.
    """
    w = o.window().rowsBetween(Window.unboundedPreceding, -1)
    v = {name: F.col(src).cast("double") for name, src in moments.items()}
    out = df.withColumns({f"{name}_{part}": fn(x).over(w) for name, x in v.items()
                          for part, fn in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))})
    if not o.sliced:
        return out
    zero = F.lit(0.0)
    tot = _totals(df, o, [c for name, x in v.items() for c in (
        F.count(x).alias(f"_n_{name}"), F.coalesce(F.avg(x), zero).alias(f"_m_{name}"), F.coalesce(F.var_pop(x), zero).alias(f"_v_{name}"))])
    every = Window.partitionBy(*o.keys)
    wt = every.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    for name in moments:
        n, m = F.col(f"_n_{name}"), F.col(f"_m_{name}")
        tot = tot.withColumn(f"_r_{name}", F.coalesce(F.sum(n * m).over(every) / F.nullif(F.sum(n).over(every), F.lit(0)), zero))
        off = m - F.col(f"_r_{name}")
        tot = (tot.withColumn(f"_p_{name}", F.coalesce(F.sum(n).over(wt), F.lit(0)))
               .withColumn(f"_s_{name}", F.coalesce(F.sum(n * off).over(wt), zero))
               .withColumn(f"_t_{name}", F.coalesce(F.sum(n * (F.col(f"_v_{name}") + off * off)).over(wt), zero)))
    out = _attach(out, tot.select(*o.keys, _SLICE, *[f"_{x}_{name}" for name in moments for x in "rpst"]), o)
    for name in moments:
        n, mean, sd = (F.col(f"{name}_{x}") for x in ("n", "mean", "sd"))
        before, a = F.col(f"_p_{name}"), F.col(f"_s_{name}")
        both, mean0 = n + before, F.col(f"_r_{name}") + a / before
        gap = mean - mean0
        square = F.greatest(F.col(f"_t_{name}") - a * a / before, zero) + n * F.coalesce(sd, zero) ** 2 + F.coalesce(gap * gap * n * before / both, zero)
        led = F.coalesce(before, F.lit(0)) > 0
        out = out.withColumns({f"{name}_n": F.when(led, both).otherwise(n),
                               f"{name}_mean": F.when(led, F.coalesce(mean0 + gap * n / both, mean0)).otherwise(mean),
                               f"{name}_sd": F.when(led, F.sqrt(square / both)).otherwise(sd)})
    return out.drop(*[f"_{x}_{name}" for name in moments for x in "rpst"])


def running_mask(df: DataFrame, o: Order, name: str, src: str) -> DataFrame:
    """Union of the bits of ``src`` in the earlier rows; 0 without any."""
    out = df.withColumn(name, F.coalesce(F.bit_or(src).over(o.window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if not o.sliced:
        return out
    wt = Window.partitionBy(*o.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    tot = _totals(df, o, [F.bit_or(src).alias("_m")]).select(*o.keys, _SLICE, F.bit_or("_m").over(wt).alias("_pm"))
    return _attach(out, tot, o).withColumn(name, F.col(name).bitwiseOR(F.coalesce("_pm", F.lit(0)))).drop("_pm")


def count_before(df: DataFrame, o: Order, values: dict[str, str]) -> DataFrame:
    """How many earlier rows of the key have the row's own value (NULL is a value); ``values`` maps a new name to the column.

    Costs a sort for each column but no shuffle on plain frames.
    """
    part = [*o.keys, *([_SLICE] if o.sliced else [])]
    out = df
    for name, src in values.items():
        w = Window.partitionBy(*part, src).orderBy(_BY, *o.ties)
        out = out.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    if not o.sliced:
        return out
    for name, src in values.items():
        wt = Window.partitionBy(*o.keys, src).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        tot = df.where(_HOT).groupBy(*o.keys, _SLICE, src).agg(F.count("*").alias("_c"))
        tot = tot.select(*o.keys, _SLICE, src, F.sum("_c").over(wt).alias("_off"))
        out = _join(out, tot, [*o.keys, _SLICE, src]).withColumn(name, F.col(name) + F.coalesce("_off", F.lit(0))).drop("_off")
    return out


def carry_last(df: DataFrame, o: Order, name: str, value: Column) -> DataFrame:
    """Last non-NULL ``value`` up to and including each row."""
    df = df.withColumn("_value", value)
    w = o.window().rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn(name, F.last("_value", ignorenulls=True).over(w))
    if o.sliced:
        at = F.when(F.col("_value").isNotNull(), F.struct(_BY, *o.ties))
        wt = Window.partitionBy(*o.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        tot = _totals(df, o, [F.max_by("_value", at).alias("_m")]).select(
            *o.keys, _SLICE, F.last("_m", ignorenulls=True).over(wt).alias("_pm"))
        out = _attach(out, tot, o).withColumn(name, F.coalesce(name, "_pm")).drop("_pm")
    return out.drop("_value")


def first_of(df: DataFrame, o: Order, within: str, name: str, value: Column) -> DataFrame:
    """``name`` = 1 on the first row of each distinct ``value`` within ``within``
    (a column that the keys and the order determine), 0 elsewhere and for NULL.

    Costs a sort but no shuffle on plain frames, because the rows are already
    partitioned by the keys; summing it replaces a distinct count.  On sliced
    frames a row is first if it is first in its slice and no earlier slice has
    the value.
    """
    df = df.withColumn("_value", value)
    more = [within] if within not in o.keys else []
    w = Window.partitionBy(*o.keys, *([_SLICE] if o.sliced else []), *more, "_value").orderBy(_BY, *o.ties)
    first = F.col("_value").isNotNull() & (F.row_number().over(w) == 1)
    if not o.sliced:
        return df.withColumn(name, F.when(first, 1).otherwise(0)).drop("_value")
    lead = df.where(F.col(_HOT) & F.col("_value").isNotNull()).groupBy(*o.keys, *more, "_value").agg(F.min(_SLICE).alias("_lead"))
    out = _join(df.withColumn("_first", first), lead, [*o.keys, *more, "_value"])
    here = F.coalesce(F.col("_lead") == F.col(_SLICE), F.lit(True)) | ~F.col(_HOT)
    return out.withColumn(name, F.when(F.col("_first") & here, 1).otherwise(0)).drop("_value", "_first", "_lead")


def done(df: DataFrame) -> DataFrame:
    """Drop the helper columns of ``order_by``."""
    return df.drop(_BY, _SLICE, _HOT)


def blocks_with_halo(df: DataFrame, pos: str, block: int, halo: int) -> DataFrame:
    """Cut keyed rows into blocks of ``block`` positions, each led by the last
    ``halo`` rows of the block before (``is_halo``), so a trailing window of up
    to ``halo`` rows can run per block instead of per key."""
    own = (F.col(pos) / block).cast("long")
    nxt = F.when(F.col(pos) % block >= block - halo, own + 1)
    copies = F.array_compact(F.array(own, nxt))
    return (df.withColumn("_copies", copies).withColumn("block", F.explode("_copies")).drop("_copies")
            .withColumn("is_halo", F.col("block") != own))


def paged_lists(df: DataFrame, keys: list[str], pos: str, value: str, name: str,
                page_size: int = 1000) -> DataFrame:
    """Ordered values of a key as array pages of at most ``page_size`` entries.

    ``pos`` is a 0-based position within the key.  No group exceeds one page.
    """
    return (df.withColumn("page", (F.col(pos) / page_size).cast("long"))
            .groupBy(*keys, "page")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"),
                                                                  F.col(value).alias("v")))),
                             lambda s: s["v"]).alias(name)))
