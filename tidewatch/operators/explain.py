"""Attribution of linear class scores and explanation records.

For a linear score the exact Shapley value of feature f for class c is
w[c][f] * (x[f] - E[x[f]]) when features are independent (Lundberg and Lee,
2017).  Everything per session is array arithmetic in the row; nothing is
exploded unless the long form itself is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims, texts
from tidewatch.functions.risk import impact_label, severity


def linear_weights(model) -> tuple[list[str], list[list[float]]]:
    """(classes, weights per class) of a fitted linear classifier pipeline."""
    lr = model.stages[-1]
    classes = list(model.stages[0].labels)
    return classes, [[float(v) for v in row] for row in lr.coefficientMatrix.toArray()][:len(classes)]


def feature_means(df: DataFrame, names: list[str]) -> list[float]:
    """E[x] per feature; one aggregate, one row."""
    row = df.agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names]).first()
    return [row[n] or 0.0 for n in names]


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def centred(names: list[str], means: list[float]) -> Column:
    return F.array(*[F.col(n).cast("double") - F.lit(m) for n, m in zip(names, means)])


def attribute(df: DataFrame, classes: list, weights: list[list[float]], names: list[str], means: list[float],
              key: str = "session_id") -> DataFrame:
    """Long form: (key, class, feature, phi) for every class and feature."""
    table = F.array(*[F.struct(F.lit(c).alias("class"), _array(w).alias("w")) for c, w in zip(classes, weights)])
    per_class = df.select(key, centred(names, means).alias("_d"), F.inline(table))
    return per_class.select(
        key, "class", F.inline(F.arrays_zip(_array(names).alias("feature"), F.zip_with(
            "w", "_d", lambda w, d: w * d).alias("phi"))))


def attribute_predicted(df: DataFrame, classes: list, weights: list[list[float]], names: list[str],
                        means: list[float], predicted: str = "predicted_label") -> DataFrame:
    """``phi`` and ``x`` arrays for the predicted class only (unknown class: the first)."""
    table = F.create_map(*[v for c, w in zip(classes, weights) for v in (F.lit(c), _array(w))])
    w = F.coalesce(table[F.col(predicted)], _array(weights[0]))
    return (df.withColumn("_d", centred(names, means))
            .withColumn("phi", F.zip_with(w, F.col("_d"), lambda a, d: a * d))
            .withColumn("x", F.array(*[F.col(n).cast("double") for n in names])).drop("_d"))


def join_predictions(df: DataFrame, pred: DataFrame, key: str = "session_id") -> DataFrame:
    """Predictions onto the data set; without one the label is the attack type, confidence .5."""
    p = pred.select(key, "predicted_label", "confidence")
    return (df.join(p, key, "left")
            .withColumn("predicted_label", F.coalesce("predicted_label", "attack_type"))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.5))))


def global_importance(attr: DataFrame) -> DataFrame:
    """Mean |phi| over rows and classes, ranked (one row per feature)."""
    from pyspark.sql import Window

    g = attr.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    # one row per feature: the ranking window is bounded by the model's width
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_phi"), "feature")))


def class_importance(attr: DataFrame, classes: list) -> DataFrame:
    """Mean |phi| per feature with one column per class, in global rank order."""
    wide = attr.groupBy("feature").pivot("class", classes).agg(F.avg(F.abs("phi")))
    return wide.join(global_importance(attr).select("feature", "rank"), "feature").orderBy("rank")


def importance_from_moments(df: DataFrame, classes: list, weights: list[list[float]], names: list[str],
                            means: list[float]) -> DataFrame:
    """Same numbers as the long form without exploding it: mean |phi| of class c and
    feature f is |w[c][f]| times the mean of |x[f] - E[x[f]]|, one aggregate."""
    mads = df.agg(F.array(*[F.avg(F.abs(F.col(n).cast("double") - F.lit(m))) for n, m in zip(names, means)]).alias("_m"))
    table = F.array(*[F.struct(F.lit(c).alias("class"), _array([abs(v) for v in w]).alias("w")) for c, w in zip(classes, weights)])
    return mads.select("_m", F.inline(table)).select(
        "class", F.inline(F.arrays_zip(_array(names).alias("feature"),
                                       F.zip_with("w", "_m", lambda w, m: w * m).alias("mean_abs_phi"))))


def _lookup(c: Column, mapping: dict, default: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(table[c], default)


def _largest(names: list[str], top_n: int):
    """A function of ``phi`` arrays: places of the ``top_n`` largest |phi| above zero (NaN too), and of the others; equal ones by name, NULL nowhere."""
    by_name, m = np.argsort(np.array(names), kind="stable"), len(names)

    @F.arrow_udf("struct<up: array<int>, down: array<int>>")
    def places(phi: pa.Array) -> pa.Array:
        if phi.null_count or (pc.list_value_length(phi).to_numpy() != m).any():   # short or missing arrays: as if padded with NULL
            phi = pa.array([[*(v or []), *[None] * m][:m] for v in phi.to_pylist()], pa.list_(pa.float64()))
        flat = phi.flatten()
        p = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, m)[:, by_name]
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, m)[:, by_name]
        order = np.argsort(-np.abs(p), axis=1, kind="stable")
        p, known, place = np.take_along_axis(p, order, 1), np.take_along_axis(known, order, 1), by_name[order].astype(np.int32)
        up, lists = ~(p <= 0), []
        for keep in (known & up, known & ~up):
            keep &= np.cumsum(keep, 1) <= top_n
            lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep.sum(1))].astype(np.int32)), pa.array(place[keep])))
        return pa.StructArray.from_arrays(lists, ["up", "down"])

    return places


def contributors(df: DataFrame, names: list[str], top_n: int = 10) -> DataFrame:
    """``positive_contributors`` and ``negative_contributors`` of the predicted class.

    The largest |phi| first, at most ``top_n`` each; zero counts as negative.  Whole batches are ranked at once; entries are made for the places taken only.
    """
    cat = {f: c for c, fs in dims.FEATURE_CATEGORY.items() for f in fs}
    described, category = [dims.FEATURE_DESCRIPTION.get(f, f.replace("_", " ")) for f in names], [cat.get(f, "Session") for f in names]

    def entry(i: Column) -> Column:
        p = F.get("phi", i)
        return F.struct(
            F.get(_array(names), i).alias("feature"), F.get(_array(described), i).alias("description"), F.get(_array(category), i).alias("category"),
            F.round(F.get("x", i), 4).alias("value"), F.round(p, 4).alias("attribution"), impact_label(p).alias("impact"))

    df = df.withColumn("_r", _largest(names, top_n)("phi"))
    return df.withColumns({"positive_contributors": F.transform("_r.up", entry), "negative_contributors": F.transform("_r.down", entry)}).drop("_r")


def attach_mitre(df: DataFrame, attack: str = "prediction", steps: dict[str, list[str]] | None = None) -> DataFrame:
    """MITRE struct (NULL for Normal) and investigation steps (those of Normal if unknown)."""
    steps = steps or texts.INVESTIGATION_STEPS
    m = F.create_map(*[v for a, (t, i, q) in dims.MITRE.items() for v in (F.lit(a), F.struct(
        F.lit(t).alias("tactic"), F.lit(i).alias("technique_id"), F.lit(q).alias("technique")))])
    s = F.create_map(*[v for a, x in steps.items() for v in (F.lit(a), _array(x))])
    return (df.withColumn("mitre", m[F.col(attack)])
            .withColumn("investigation_steps", F.coalesce(s[F.col(attack)], _array(steps["Normal"]))))


def explanations(df: DataFrame, names: list[str], top_n: int = 10) -> DataFrame:
    """Explanation records from rows that carry ``phi``, ``x``, the prediction and scores."""
    d = contributors(df, names, top_n).select(
        "session_id", F.col("predicted_label").alias("prediction"), F.col("attack_type").alias("true_label"),
        F.round("confidence", 4).alias("confidence"), F.round("anomaly_score", 4).alias("anomaly_score"),
        F.round("risk_score", 4).alias("risk_score"),
        severity("confidence", "anomaly_score", "risk_score").alias("severity"),
        "positive_contributors", "negative_contributors")
    return attach_mitre(d)


def explain_session(expl: DataFrame, session_id: str) -> DataFrame:
    """The explanation of one session; empty for an unknown id."""
    return expl.where(F.col("session_id") == session_id)


def most_attributed(attr: DataFrame, key: str = "session_id") -> DataFrame:
    """The row with the largest mean |phi|."""
    g = attr.groupBy(key).agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    return g.orderBy(F.desc("mean_abs_phi"), key).limit(1)


# --- texts ---------------------------------------------------------------------

def percent(c, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", (F.col(c) if isinstance(c, str) else c) * 100)


def _bullets(contribs: str, n: int) -> Column:
    def one(c: Column) -> Column:
        v = F.when(c["value"] == F.floor(c["value"]), F.format_string("%d", c["value"].cast("long"))).otherwise(
            F.format_string("%.2f", c["value"]))
        return F.concat(F.lit("- "), c["description"], F.lit(" (value: "), v, F.lit("), "), F.lower(c["impact"]),
                        F.lit(" ["), c["category"], F.lit("]"))
    return F.transform(F.slice(contribs, 1, n), one)


def narrate(expl: DataFrame, narrative: dict[str, str] | None = None) -> DataFrame:
    """``nl_explanation`` (paragraphs) and ``summary`` (at most two sentences)."""
    narrative = narrative or texts.ATTACK_NARRATIVE
    story = _lookup(F.col("prediction"), narrative, F.lit(""))
    normal = F.col("prediction") == "Normal"
    head = F.concat(F.lit("The model classified this session as **"), F.col("prediction"), F.lit("** with "),
                    percent("confidence"), F.lit(" confidence ("), F.col("severity"), F.lit(" severity)."))
    mitre = F.concat(F.lit("MITRE tactic **"), F.col("mitre.tactic"), F.lit("** ("), F.col("mitre.technique_id"),
                     F.lit(", "), F.col("mitre.technique"), F.lit(")."))
    score = F.when(F.col("anomaly_score") > 0.01, F.concat(
        F.lit("The anomaly score of the session is "), F.format_string("%.4f", F.col("anomaly_score")), F.lit(".")))

    def section(title: str, c: str, n: int) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(_bullets(c, n), "\n\n")))
    parts = [head, F.nullif(story, F.lit("")), mitre, score,
             section("Indicators that raised the prediction:\n\n", "positive_contributors", 5),
             section("Factors that lowered it:\n\n", "negative_contributors", 3),
             F.when(~normal, F.concat(F.lit("Together they resemble earlier **"), F.col("prediction"), F.lit("** sessions.")))]
    top = F.transform(F.slice("positive_contributors", 1, 3), lambda c: c["description"])
    lead = F.when(F.size("positive_contributors") > 0, F.array_join(top, ", ")).otherwise("behavioural anomalies")
    first = F.concat(F.upper(F.substring(lead, 1, 1)), F.substr(lead, F.lit(2)), F.lit(" point to **"), F.col("prediction"),
                     F.lit("** ("), F.col("severity"), F.lit(" severity, "), percent("confidence"), F.lit(" confidence)."))
    second = F.when(story != "", F.concat(F.substring_index(story, ".", 1), F.lit(".")))
    return (expl.withColumn("nl_explanation", F.concat_ws("\n\n", *parts))
            .withColumn("summary", F.when(normal, texts.ATTACK_NARRATIVE["Normal"]).otherwise(F.concat_ws(" ", first, second))))


def attach_context(expl: DataFrame) -> DataFrame:
    """Struct with the facts a later stage needs."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return expl.withColumn("context", F.struct(
        F.col("prediction").alias("attack_type"), "confidence", "severity", "risk_score", "anomaly_score",
        blank("mitre.tactic").alias("mitre_tactic"), blank("mitre.technique_id").alias("mitre_technique_id"),
        blank("mitre.technique").alias("mitre_technique"),
        F.transform(F.slice("positive_contributors", 1, 5), lambda c: c["feature"]).alias("top_features"),
        "investigation_steps", F.col("summary").alias("incident_summary")))


def flatten_explanations(expl: DataFrame) -> DataFrame:
    """Flat table: metadata, MITRE, five positive and three negative contributors."""
    def at(arr: str, i: int, f: str, alias: str) -> Column:
        return F.coalesce(F.get(arr, i)[f].cast("string"), F.lit("")).alias(alias)
    pos = [at("positive_contributors", i, f, f"top_pos_{n}_{i + 1}") for i in range(5)
           for f, n in (("feature", "feature"), ("value", "value"), ("category", "category"), ("impact", "impact"))]
    neg = [at("negative_contributors", i, f, f"top_neg_{n}_{i + 1}") for i in range(3)
           for f, n in (("feature", "feature"), ("attribution", "shap"))]
    meta = ["session_id", "prediction", "true_label", "confidence", "anomaly_score", "risk_score", "severity"]
    mitre = [F.coalesce(F.col(f"mitre.{f}"), F.lit("")).alias(f"mitre_{f}") for f in ("tactic", "technique_id", "technique")]
    text = [c for c in ("nl_explanation", "summary") if c in expl.columns]
    return expl.select(*meta, *mitre, *pos, *neg, *text)
