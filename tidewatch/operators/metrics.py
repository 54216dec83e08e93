"""Curves, thresholds, confusion matrices, histograms.

Curves first reduce to distinct scores (a hot score collapses map-side), then
take a running sum that is sliced by value, so no step runs in one task over
all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import ordering as od


def _by(by: str | list[str] | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def score_curve(df: DataFrame, score: str, label: str, by=None, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Counts at every distinct threshold "score >= t", highest first.

    Columns: the group, ``threshold``, ``tp``, ``fp``, ``pos``, ``neg`` (totals)
    and the previous point's ``ptp``, ``pfp`` (0 at the start).
    """
    keys = _by(by)
    d = df.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_n"))
    d, o = od.order_by(d, keys, -F.col("threshold"), [], min_rows)
    d = od.done(od.running_sum(d, o, {"tp": "_p", "fp": "_n"}))
    tot = df.groupBy(*keys).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                                F.sum(1 - F.col(label).cast("long")).alias("neg"))
    d = d.join(tot, keys) if keys else d.crossJoin(F.broadcast(tot))  # the one-row frame alone is hinted
    return d.select(*keys, "threshold", "tp", "fp", "pos", "neg",
                    (F.col("tp") - F.col("_p")).alias("ptp"), (F.col("fp") - F.col("_n")).alias("pfp"))


def roc_curve(df: DataFrame, score: str, label: str, by=None, **kw) -> DataFrame:
    """False and true positive rate at every distinct threshold."""
    c = score_curve(df, score, label, by, **kw)
    return c.select(*_by(by), "threshold", (F.col("fp") / F.col("neg")).alias("fpr"),
                    (F.col("tp") / F.col("pos")).alias("tpr"))


def roc_auc(df: DataFrame, score: str, label: str, by=None, **kw) -> DataFrame:
    """Area under the ROC curve; ties share a trapezoid."""
    c = score_curve(df, score, label, by, **kw)
    area = (F.col("fp") - F.col("pfp")).cast("double") * (F.col("tp") + F.col("ptp")) / 2
    return c.groupBy(*_by(by)).agg((F.sum(area) / (F.max("pos").cast("double") * F.max("neg"))).alias("roc_auc"))


def pr_curve(df: DataFrame, score: str, label: str, by=None, **kw) -> DataFrame:
    """Precision and recall at every distinct threshold."""
    c = score_curve(df, score, label, by, **kw)
    return c.select(*_by(by), "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.col("pos")).alias("recall"))


def pr_auc(df: DataFrame, score: str, label: str, by=None, **kw) -> DataFrame:
    """Trapezoid area under precision over recall, from (recall 0, precision 1)."""
    c = score_curve(df, score, label, by, **kw)
    prev = F.when(F.col("ptp") + F.col("pfp") > 0, F.col("ptp") / (F.col("ptp") + F.col("pfp"))).otherwise(1.0)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = (F.col("tp") - F.col("ptp")) / F.col("pos") * (prec + prev) / 2
    return c.groupBy(*_by(by)).agg(F.sum(area).alias("pr_auc"))


# --- thresholds -------------------------------------------------------------

def f1_threshold(df: DataFrame, score: str, label: str, **kw) -> DataFrame:
    """Threshold with the highest F1 (score >= t); the lowest one on ties."""
    p, r = F.col("precision"), F.col("recall")
    c = pr_curve(df, score, label, **kw).withColumn("f1", 2 * p * r / (p + r + 1e-9))
    return c.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


def youden_threshold(df: DataFrame, score: str, label: str, **kw) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one on ties, +inf if none
    beats flagging nothing."""
    c = roc_curve(df, score, label, **kw).withColumn("j", F.col("tpr") - F.col("fpr"))
    b = c.agg(F.max_by(F.struct("threshold", "j"), F.struct("j", "threshold")).alias("b")).select("b.*")
    ok = F.col("j") > 0
    return b.select(F.when(ok, F.col("threshold")).otherwise(float("inf")).alias("threshold"),
                    F.when(ok, F.col("j")).otherwise(0.0).alias("youden"))


def percentile_threshold(df: DataFrame, column: str, p: float = 0.95, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Exact percentile with linear interpolation between ranks.

    Counts of distinct values and a sliced running sum replace one buffer that
    would have to hold every value.
    """
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("_c"))
    v, o = od.order_by(v, [], F.col("v"), [], min_rows)
    v = od.done(od.running_sum(v, o, {"_upto": "_c"}))
    n = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("_n"))
    at = (F.col("_n") - 1) * F.lit(p)
    v = v.crossJoin(F.broadcast(n)).withColumn("_lo", F.floor(at)).withColumn("_hi", F.ceil(at)).withColumn("_w", at - F.floor(at))
    return v.agg(F.min(F.when(F.col("_upto") > F.col("_lo"), F.col("v"))).alias("a"),
                 F.min(F.when(F.col("_upto") > F.col("_hi"), F.col("v"))).alias("b"),
                 F.max("_w").alias("w")).select((F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("threshold"))


def compare_thresholds(val: DataFrame, test: DataFrame, score: str, label: str, p: float = 0.95) -> DataFrame:
    """F1-optimal, Youden and percentile thresholds with F1, precision, recall on
    ``test`` (score > t).  The percentile comes from ``val``; without positives in
    ``test`` it stands in for the other two."""
    pct = percentile_threshold(val, score, p).select(F.lit("percentile_95").alias("method"), F.col("threshold"),
                                                     F.lit(None).cast("double").alias("f1_at"))
    f1 = f1_threshold(test, score, label).select(F.lit("f1_optimal").alias("method"), "threshold", F.col("f1").alias("f1_at"))
    yd = youden_threshold(test, score, label).select(F.lit("youden_index").alias("method"), "threshold",
                                                     F.lit(None).cast("double").alias("f1_at"))
    any_pos = test.agg((F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)) > 0).alias("_any"))
    fall = pct.select(F.col("threshold").alias("_pct"))
    t = f1.unionByName(yd).unionByName(pct).crossJoin(any_pos).crossJoin(fall)  # three rows
    t = t.select("method", "f1_at", F.when(F.col("_any"), F.col("threshold")).otherwise(F.col("_pct")).alias("threshold"))
    hit = (F.col(score) > F.col("threshold"))
    y = F.col(label).cast("int") == 1
    g = test.crossJoin(F.broadcast(t)).groupBy("method", "threshold", "f1_at").agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    pr, rc = _div(F.col("tp"), F.col("tp") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    f = _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return g.select("method", "threshold", F.coalesce("f1_at", f).alias("f1"), pr.alias("precision"), rc.alias("recall"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


# --- classification counts ------------------------------------------------------

def binary_metrics(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Confusion counts, precision, recall, F1; 0 where undefined."""
    p, y = F.col(pred).cast("int") == 1, F.col(label).cast("int") == 1
    c = df.agg(F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"),
               F.count_if(~p & y).alias("fn"), F.count_if(p & y).alias("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumn("precision", _div(tp, tp + fp)).withColumn("recall", _div(tp, tp + fn)).withColumn(
        "f1", _div(2 * tp, 2 * tp + fp + fn))


def confusion(df: DataFrame, pred: str, label: str) -> DataFrame:
    """k x k counts with zero cells over all classes seen on either side."""
    counts = df.groupBy(F.col(label).alias("true_label"), F.col(pred).alias("predicted_label")).agg(F.count("*").alias("n"))
    classes = counts.select(F.col("true_label").alias("c")).union(counts.select("predicted_label")).distinct()
    grid = classes.select(F.col("c").alias("true_label")).crossJoin(classes.select(F.col("c").alias("predicted_label")))
    return grid.join(counts, ["true_label", "predicted_label"], "left").na.fill(0, ["n"])


def normalised_confusion(cm: DataFrame) -> DataFrame:
    """Confusion as shares of the true class (a row total of 0 counts as 1)."""
    w = Window.partitionBy("true_label")  # k rows per class
    return cm.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(w), F.lit(1)))


def class_report(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    cm = df.groupBy(F.col(label).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    both = cm.select(F.inline(F.array(
        F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted")))))
    g = both.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    tp, s, q = F.col("tp"), F.col("support"), F.col("predicted")
    return g.select("class", _div(tp, q).alias("precision"), _div(tp, s).alias("recall"),
                    _div(2 * tp, s + q).alias("f1"), "support", "tp")


def averages(report: DataFrame) -> DataFrame:
    """Accuracy, macro and support-weighted averages of a class report; one row."""
    n = F.sum("support")
    out = [(F.sum("tp") / n).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        out += [F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * F.col("support")) / n).alias(f"{m}_weighted")]
    return report.agg(*out)


def explode_classes(df: DataFrame, probs: str, label: str, classes: list[str] | None = None) -> DataFrame:
    """(class, score, hit) rows from a probability array."""
    long = df.select(F.col(label).alias("_y"), F.posexplode(probs).alias("class_no", "score"))
    if classes:
        long = long.withColumn("class", F.array(*[F.lit(c) for c in classes])[F.col("class_no")])
        return long.select("class", "score", (F.col("_y") == F.col("class")).cast("int").alias("hit"))
    return long.select(F.col("class_no").alias("class"), "score", (F.col("_y") == F.col("class_no")).cast("int").alias("hit"))


def ovr_auc(df: DataFrame, probs: str, label: str, classes: list[str] | None = None, **kw) -> DataFrame:
    """ROC-AUC of each class against the rest; its plain mean is the macro value."""
    return roc_auc(explode_classes(df, probs, label, classes), "score", "hit", "class", **kw)


# --- distributions -----------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int, by: str | None = None, density: bool = False) -> DataFrame:
    """Equal-width bins over the range of the whole column; the last bin is closed."""
    r = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    v = F.col(column).cast("double")
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    keys = _by(by)
    g = (df.where(v.isNotNull()).crossJoin(F.broadcast(r))
         .groupBy(*keys, b.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n")))
    out = g.withColumn("left_edge", F.col("_lo") + F.col("bin") * width).withColumn(
        "right_edge", F.col("_lo") + (F.col("bin") + 1) * width)
    if density:
        tot = g.groupBy(*keys).agg(F.sum("n").alias("_t"))
        out = (out.join(tot, keys) if keys else out.crossJoin(F.broadcast(tot))).withColumn(
            "density", F.col("n") / (F.col("_t") * F.when(width > 0, width).otherwise(1.0))).drop("_t")
    return out.drop("_lo", "_hi")


def moving_average(df: DataFrame, column: str, order: Column, ties: list[str], w: int = 5,
                   by: list[str] | None = None, block: int = 1_000_000, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Trailing mean over the last ``w`` rows (fewer at the head).

    Rows are numbered once, then averaged per block with a halo of w - 1 rows.
    """
    by = by or []
    d, o = od.order_by(df, by, order, ties, min_rows)
    d = od.done(od.position_and_lag(d, o, "_pos"))
    d = od.blocks_with_halo(d, "_pos", block, w - 1)
    win = Window.partitionBy(*by, "block").orderBy("_pos").rowsBetween(-(w - 1), 0)
    return (d.withColumn("moving_avg", F.avg(column).over(win)).where(~F.col("is_halo"))
            .drop("block", "is_halo", "_pos"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))


# --- data-set profile -----------------------------------------------------------------

def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: rows, NULLs, infinities, mean, deviation, min, max.  One pass."""
    def stats(c: str) -> Column:
        v = F.col(c).cast("double")
        ok = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        return F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(v.isNull() | F.isnan(v)).alias("nulls"),
                        F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.avg(ok).alias("mean"),
                        F.stddev_samp(ok).alias("sd"), F.min(ok).alias("min"), F.max(ok).alias("max"))
    return df.agg(F.array(*[stats(c) for c in cols]).alias("s")).select(F.inline("s"))


def risk_by_attack(features: DataFrame) -> DataFrame:
    """Count, mean, min, max risk per attack, highest mean first."""
    return (features.groupBy("attack_type").agg(
        F.count("*").alias("n"), F.avg("risk_score").alias("mean_risk"),
        F.min("risk_score").alias("min_risk"), F.max("risk_score").alias("max_risk"))
        .orderBy(F.desc("mean_risk"), "attack_type"))


def risk_by_label(features: DataFrame) -> DataFrame:
    """Mean risk of normal and anomalous sessions."""
    return features.groupBy("is_anomalous").agg(F.count("*").alias("n"), F.avg("risk_score").alias("mean_risk"))


def normal_with_risk(features: DataFrame, n: int = 10) -> DataFrame:
    """Normal sessions with a positive risk, highest first (a top-n report)."""
    return (features.where((F.col("is_anomalous") == 0) & (F.col("risk_score") > 0))
            .select("session_id", "employee_id", "risk_score")
            .orderBy(F.desc("risk_score"), "session_id").limit(n))
