"""Event sequences, scaling, splits and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.columns import command_text, contains_any
from tidewatch.operators import ordering as od

MAX_LEN = 50
VECTOR_DIMS = len(dims.EVENT_TYPES) + 6


# --- sequences ---------------------------------------------------------------

def event_vectors(events: DataFrame) -> DataFrame:
    """21 numbers per event: type one-hot (15), sensitivity, admin flag, success,
    clipped time delta, PowerShell flag, malware flag.

    ``events`` comes from a sessioniser; the first event's delta is 0 because a
    session starts with it.  A negative delta is not clipped.
    """
    sens = {r: float(dims.SENSITIVITY.index(s)) for r, (_, s, _) in dims.RESOURCE_DIM.items()}
    typ = F.when(F.col("event_type").isin(dims.EVENT_TYPES), F.col("event_type")).otherwise("ResourceAccess")
    cmd = command_text()

    def flag(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    table = F.create_map(*[F.lit(x) for kv in sens.items() for x in kv])
    vec = [flag(typ == t) for t in dims.EVENT_TYPES] + [
        F.coalesce(table[F.col("resource")], F.lit(0.0)),
        flag(F.col("resource").isin(dims.ADMIN_RESOURCES)),
        flag(F.col("status") == "SUCCESS"),
        F.least(F.lit(1.0), F.coalesce("gap", F.lit(0.0)) / 300),
        flag(cmd.contains("powershell")),
        flag(contains_any(cmd, dims.MALWARE_NAMES)),
    ]
    return events.select("session_id", "employee_id", (F.col("pos") - F.col("lead.pos")).cast("int").alias("step"),
                         F.array(*vec).alias("vec"))


def build_sequences(vectors: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """First ``max_len`` vectors of each session, zero-padded, with a 0/1 mask.

    Steps are cut before they are collected, so a group never exceeds ``max_len``.
    """
    zero = F.array(*[F.lit(0.0)] * VECTOR_DIMS)
    g = (vectors.where(F.col("step") < max_len).groupBy("session_id")
         .agg(F.array_sort(F.collect_list(F.struct("step", "vec"))).alias("_s")))
    steps = F.transform("_s", lambda s: s["vec"])
    return g.select(
        "session_id",
        F.slice(F.concat(steps, F.array_repeat(zero, max_len)), 1, max_len).alias("seq"),
        F.slice(F.concat(F.transform("_s", lambda s: F.lit(1.0)), F.array_repeat(F.lit(0.0), max_len)),
                1, max_len).alias("mask"))


def sequence_alignment(features: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sessions that only one of the two tables has; empty when aligned."""
    f = features.select("session_id", F.lit(1).alias("_f"))
    s = sequences.select("session_id", F.lit(1).alias("_s"))
    return (f.join(s, "session_id", "full_outer").where(F.col("_f").isNull() | F.col("_s").isNull())
            .select("session_id", F.when(F.col("_f").isNull(), "features").otherwise("sequences").alias("missing_in")))


# --- scaling -------------------------------------------------------------------

def _numeric(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    v = F.col(c).try_cast("double") if kind == "string" else F.col(c).cast("double")
    return F.coalesce(v, F.lit(0.0))


def fit_scaler(df: DataFrame, ignore: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; one aggregate, one row.

    A deviation of at most 1e-9 counts as 1; what is not a number counts as 0.
    """
    cols = [c for c in df.columns if c not in (ignore or dims.META_COLUMNS)]
    aggs = [a for c in cols for a in (F.avg(_numeric(df, c)).alias(f"m_{c}"),
                                      F.stddev_pop(_numeric(df, c)).alias(f"s_{c}"))]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        mean, sd = row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0
        out[c] = (mean, sd if sd > 1e-9 else 1.0)
    return out


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardise the fitted columns; all others stay as they are."""
    return df.select(*[((_numeric(df, c) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c)
                       if c in stats else F.col(c) for c in df.columns])


def scaler_table(spark, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Scaler statistics as a table, for saving."""
    return spark.createDataFrame([(c, m, s) for c, (m, s) in stats.items()], "feature string, mean double, sd double")


def fit_step_scaler(vectors: DataFrame, train_ids: DataFrame | None = None) -> list[tuple[float, float]]:
    """Mean and deviation per vector position over the real steps of the training
    sessions (padding never enters, the long form has none)."""
    v = vectors if train_ids is None else vectors.join(train_ids.select("session_id"), "session_id", "left_semi")
    aggs = [a for i in range(VECTOR_DIMS) for a in (F.avg(F.col("vec")[i]).alias(f"m{i}"),
                                                    F.stddev_pop(F.col("vec")[i]).alias(f"s{i}"))]
    row = v.agg(*aggs).first()
    return [(row[f"m{i}"] or 0.0, row[f"s{i}"] if (row[f"s{i}"] or 0.0) > 1e-9 else 1.0) for i in range(VECTOR_DIMS)]


def scale_vector(vec: str, stats: list[tuple[float, float]]) -> Column:
    """Standardised vector."""
    return F.array(*[(F.col(vec)[i] - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(stats)])


def scale_steps(sequences: DataFrame, stats: list[tuple[float, float]]) -> DataFrame:
    """Scale every step of padded sequences, padding included."""
    m, s = F.array(*[F.lit(a) for a, _ in stats]), F.array(*[F.lit(b) for _, b in stats])
    centre = lambda v: F.zip_with(F.zip_with(v, m, lambda x, y: x - y), s, lambda x, y: x / y)
    return sequences.withColumn("seq", F.transform("seq", centre))


# --- splits ----------------------------------------------------------------------

def stratified_split(df: DataFrame, label: str, key: str = "session_id", train: float = 0.7,
                     val: float = 0.15, seed: int = 42, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """``split`` = train / val / test with the class shares kept.

    Rows are ranked per class by a hash of key and seed, so the split depends on
    nothing but the data; a class may hold most rows, the rank is sliced by hash.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    ranked = df.withColumn("_h", h)
    by = F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")
    ranked, o = od.order_by(ranked, [label], by, ["_h", key], min_rows)
    ranked = od.done(od.position_and_lag(ranked, o, "_rank"))
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))  # one row per class
    n, r = F.col("_n"), F.col("_rank") + 1
    upto = round(train + val, 10)
    return (ranked.join(F.broadcast(sizes), label)
            .withColumn("split", F.when(r <= F.ceil(n * train), "train").when(r <= F.ceil(n * upto), "val").otherwise("test"))
            .drop("_h", "_rank", "_n"))


def one_class_split(df: DataFrame, label: str = "is_anomalous", key: str = "session_id", train: float = 0.7,
                    val: float = 0.15, seed: int = 42, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Test rows of both classes; training and validation rows only normal ones."""
    s = stratified_split(df, label, key, train, val, seed, min_rows)
    return s.where((F.col("split") == "test") | (F.col(label).cast("int") == 0))


# --- encodings ---------------------------------------------------------------------

def encode_ordinal(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Ordinal of the value among the sorted distinct values; -1 for NULL."""
    name = name or f"{column}_code"
    vals = df.where(F.col(column).isNotNull()).select(column).distinct()
    vals, o = od.order_by(vals, [], F.lit(0), [column])
    vals = od.done(od.position_and_lag(vals, o, name))
    return df.join(vals, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)).cast("int"))


def clean_label(c: str = "attack_type") -> Column:
    """None, none and NULL are Normal."""
    return F.when(F.col(c).isNull() | F.col(c).isin("None", "none"), "Normal").otherwise(F.col(c))


def clean_features(df: DataFrame, cols: list[str] | None = None, label: str = "attack_type") -> DataFrame:
    """NaN and infinite features become 0, the label is normalised."""
    def finite(c: str) -> Column:
        v = F.col(c)
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)

    new = {c: finite(c) for c in (cols or [c for c in dims.MODEL_FEATURES if c in df.columns])}
    return df.withColumns(new).withColumn(label, clean_label(label))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) for every row's class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    w = sizes.crossJoin(whole).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(w), label)   # one row a class


def feature_vector(df: DataFrame, names: list[str] | None = None, out: str = "features") -> DataFrame:
    """ML vector of the named features; absent ones and non-finite values are 0."""
    from pyspark.ml.feature import VectorAssembler

    names = names or dims.MODEL_FEATURES
    absent = {c: F.lit(0.0) for c in names if c not in df.columns}
    df = df.withColumns(absent) if absent else df
    fixed = df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                                      | (F.abs(F.col(c).cast("double")) == float("inf")), 0.0)
                           .otherwise(F.col(c).cast("double")) for c in names})
    return VectorAssembler(inputCols=names, outputCol=out).transform(fixed)

