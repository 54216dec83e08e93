"""Reconstruction scoring: a linear autoencoder fitted with Spark ML; likelihood of the order of events."""

from __future__ import annotations

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.columns import clamp, col
from tidewatch.operators import ordering as od


def fit_reconstructor(steps: DataFrame, k: int = 8, vec: str = "x") -> PCAModel:
    """Principal components of the (scaled, hence centred) normal training steps."""
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(steps.select(array_to_vector(vec).alias("_v")))


def reconstruct(steps: DataFrame, model: PCAModel, vec: str = "x", out: str = "xhat") -> DataFrame:
    """Projection of each step onto the components and back: P P' x."""
    p = model.pc.toArray()          # dims x k, a model-sized constant
    m = p @ p.T
    rows = [sum((F.col(vec)[j] * float(m[i, j]) for j in range(len(m))), F.lit(0.0)) for i in range(len(m))]
    return steps.withColumn(out, F.array(*rows))


def step_loss(x: str, xhat: str, loss: str = "mse", delta: float = 1.0) -> Column:
    """Loss summed over the dimensions of one step."""
    def one(a: Column, b: Column) -> Column:
        d = F.abs(a - b)
        if loss == "mae":
            return d
        if loss == "huber":
            return F.when(d < delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))
        return d * d
    return F.aggregate(F.zip_with(col(x), col(xhat), one), F.lit(0.0), lambda s, v: s + v)


def masked_error(steps: DataFrame, x: str = "x", xhat: str = "xhat", mask: str | None = None,
                 loss: str = "mse", delta: float = 1.0) -> DataFrame:
    """Mean loss per session over unmasked elements (denominator at least 1).

    Long form: one row per step, so padding needs no rows at all.
    """
    w = F.lit(1.0) if mask is None else F.col(mask)
    return steps.groupBy("session_id").agg(
        (F.sum(w * step_loss(x, xhat, loss, delta)) / F.greatest(F.sum(w * F.size(x)), F.lit(1.0)))
        .alias("reconstruction_error"))


def minmax_score(df: DataFrame, err: str = "reconstruction_error", out: str = "anomaly_score") -> DataFrame:
    """Errors scaled to 0..1 over the scored set."""
    r = df.agg(F.min(err).alias("_lo"), F.max(err).alias("_hi"))
    return (df.crossJoin(F.broadcast(r))  # one row
            .withColumn(out, (F.col(err) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9)))
            .drop("_lo", "_hi"))


def calibrated_score(err, lo: float, hi: float, thr: float) -> Column:
    """Error scaled by a stored range, clipped; a degenerate range decides by threshold."""
    if hi - lo < 1e-9:
        return F.when(col(err) > thr, 1.0).otherwise(0.0)
    return clamp((col(err) - lo) / (hi - lo), 0.0, 1.0)


def flag(df: DataFrame, thr, err: str = "reconstruction_error") -> DataFrame:
    """``predicted_label`` 1 and ``prediction`` Anomalous where the error exceeds the threshold."""
    hit = F.col(err) > (thr if isinstance(thr, Column) else F.lit(float(thr)))
    return df.withColumn("predicted_label", hit.cast("int")).withColumn(
        "prediction", F.when(hit, "Anomalous").otherwise("Normal"))


def merge_scores(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Features with their scores; sessions without one get 0."""
    s = scores.select("session_id", "reconstruction_error", "anomaly_score")
    return features.join(s, "session_id", "left").na.fill(0.0, ["reconstruction_error", "anomaly_score"])


# --- order -----------------------------------------------------------------------

#: What stands before a session's first event, and any type outside the catalogue.
START, OTHER = "^", "~"


def transitions(events: DataFrame, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """(session_id, before, after): the event types of neighbours in every session of a sessionised log, START before the first."""
    kind = F.when(F.col("event_type").isin(dims.EVENT_TYPES), F.col("event_type")).otherwise(OTHER)
    d, o = od.order_by(events.select("session_id", "pos", kind.alias("after")), ["session_id"], F.col("pos"), [], min_rows)
    return od.done(od.position_and_lag(d, o, "_p", {"before": "after"})).select("session_id", F.coalesce("before", F.lit(START)).alias("before"), "after")


def fit_transitions(steps: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(before, after, cost): minus the logarithm of the smoothed probability of each type after each other; 17 x 16 rows, unseen ones too.

    Counts add up over any number of rows; the table's size is that of the catalogue.
    """
    kinds = [*dims.EVENT_TYPES, OTHER]
    spark = steps.sparkSession
    every = spark.createDataFrame([(a, b) for a in [START, *kinds] for b in kinds], "before string, after string")
    counts = steps.groupBy("before", "after").agg(F.count("*").alias("n"))
    whole = steps.groupBy("before").agg(F.count("*").alias("all"))
    n = F.coalesce("n", F.lit(0))
    cost = -F.log((n + alpha) / (F.coalesce("all", F.lit(0)) + alpha * len(kinds)))
    return every.join(counts, ["before", "after"], "left").join(whole, "before", "left").select("before", "after", cost.alias("cost"))


def fit_types(steps: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The same without order: every type costs its own smoothed share, whatever is before it."""
    return fit_transitions(steps.withColumn("before", F.lit(START)), alpha).where(F.col("before") == START).select("after", "cost")


def transition_error(steps: DataFrame, costs: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(session_id, order_error): mean cost of a session's steps."""
    on = on or ["before", "after"]
    return steps.join(F.broadcast(costs), on).groupBy("session_id").agg(F.avg("cost").alias("order_error"))  # a row for each pair of types
