"""Readers.  Every reader returns a lazy DataFrame with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.sources.json_documents import read_json_documents

EVENT_SCHEMA = ("entity_id string, entity_type string, timestamp string, source_ip string, geo_location string, "
                "resource_accessed string, auth_method string, session_duration string, command_sequence string, "
                "device_fingerprint string, label string")
EMPLOYEE_SCHEMA = ("employee_uuid string, employee_id string, name string, department string, role string, "
                   "office_location string, work_start_time string, work_end_time string, allowed_devices string, "
                   "preferred_browser string, preferred_os string, vpn_probability double, access_level string, "
                   "behavior_profile string")
_CSV = {"header": True, "escape": '"', "multiLine": False}


def read_events(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None) -> DataFrame:
    """Event log: the 11-column CSV layout, or Parquet with the full model."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.options(**_CSV).schema(schema or EVENT_SCHEMA).csv(path)


def read_external(spark: SparkSession, src, multi_line: bool | None = None) -> DataFrame:
    """Log of unknown layout: path (json / jsonl / anything else as CSV), frame or rows.

    Text columns stay text; the adapter does the typing, so CSV needs no schema
    inference pass.  ``.json`` holds documents of any size, cut at record borders
    and read by many tasks; ``.jsonl`` has one record per line.  ``multi_line`` makes
    Spark's reader take each file as one document (True) or by lines (False).
    """
    if isinstance(src, DataFrame):
        return src
    if isinstance(src, str):
        if src.endswith(".json") and multi_line is None:
            return read_json_documents(spark, src)
        if src.endswith((".json", ".jsonl")):
            return spark.read.option("multiLine", bool(multi_line)).option("primitivesAsString", True).json(src)
        return spark.read.options(**_CSV).csv(src)
    if hasattr(src, "to_dict"):  # a pandas frame
        return spark.createDataFrame(src)
    rows = list(src)
    names = list(dict.fromkeys(k for r in rows for k in r))
    data = [tuple(None if r.get(n) is None else str(r.get(n)) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def read_employees(spark: SparkSession, path: str) -> DataFrame:
    """Employee lookup with typed hours, devices and resource probabilities."""
    e = spark.read.options(**_CSV).schema(EMPLOYEE_SCHEMA).csv(path)
    hour = lambda c: F.substring_index(c, ":", 1).try_cast("int")
    profile = F.from_json("behavior_profile", "struct<resource_probabilities: map<string, double>>")
    return (e.withColumn("allowed_devices", F.when(F.coalesce("allowed_devices", F.lit("")) == "", F.array().cast("array<string>"))
                         .otherwise(F.split("allowed_devices", ";")))
            .withColumn("work_start", hour("work_start_time")).withColumn("work_end", hour("work_end_time"))
            .withColumn("resource_probabilities", profile["resource_probabilities"])
            .drop("work_start_time", "work_end_time"))


def read_features(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Tabular features without the rows that are blank in every column."""
    schema = ("session_id string, employee_id string, is_anomalous double, attack_type string, risk_score double, "
              + ", ".join(f"{n} double" for n in (names or dims.FEATURES)))
    return spark.read.options(**_CSV).schema(schema).csv(path).dropna(how="all")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequence table keyed by session; missing columns are an error."""
    df = spark.read.parquet(path)
    lost = {"session_id", "seq", "mask"} - set(df.columns)
    if lost:
        raise ValueError(f"sequence table lacks {sorted(lost)}")
    return df


def read_cols(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Only the wanted columns that exist (the scan reads no others)."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in cols if c in df.columns])
