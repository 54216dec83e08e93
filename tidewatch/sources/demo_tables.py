"""Projection of the generic test tables onto the event model.

``events`` becomes an activity log, ``customer`` the employee dimension, the
distinct devices of the log the device dimension.  Each expression has a twin in
``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import dims


def _sql_list(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_BYPASS = "powershell.exe -ExecutionPolicy Bypass -WindowStyle Hidden -EncodedCommand QQ=="
_MIB = 1048576


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table of the model, one row per row of ``events``."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value",
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    typed = raw.selectExpr(
        "*",
        """CASE kind
             WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'Login' ELSE 'VPNConnect' END
             WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'ResourceAccess' WHEN 1 THEN 'DatabaseQuery' ELSE 'ApiCall' END
             WHEN 'view' THEN CASE WHEN k % 4 = 0 THEN 'FileWrite' ELSE 'FileRead' END
             WHEN 'purchase' THEN CASE WHEN k % 2 = 1 THEN 'FileUpload' ELSE 'FileDownload' END
             ELSE CASE WHEN k % 2 = 0 THEN 'Login' ELSE 'ProcessStart' END END AS event_type""",
        "CASE WHEN kind = 'error' AND k % 2 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status")
    filled = typed.selectExpr(
        "event_id", "ts", "format_string('EMP-%04d', user_id) AS employee_id", "event_type", "status",
        f"""CASE WHEN event_type NOT IN ('Login', 'VPNConnect', 'ProcessStart')
                 THEN {_sql_list(dims.RESOURCES)}[k % 24] END AS resource""",
        f"CASE WHEN event_type IN ('FileUpload', 'FileDownload') THEN value * {_MIB} ELSE 0.0D END AS bytes_transferred",
        "CASE WHEN event_type = 'FileWrite' THEN value * 1024 ELSE 0.0D END AS bytes_written",
        "concat('DEV-', user_id * 3 + k % 3) AS device_id",
        "concat('10.10.', user_id % 256, '.', k) AS ip_address",
        "concat('Office-', (user_id + CASE WHEN k >= 90 THEN 1 ELSE 0 END) % 5) AS geo_location",
        f"""CASE WHEN event_type = 'ProcessStart' THEN
              CASE k % 10 WHEN 1 THEN '{_BYPASS}'
                          WHEN 3 THEN concat('run ', {_sql_list(dims.MALWARE_NAMES)}[k % 6])
                          WHEN 5 THEN concat('curl http://', {_sql_list(dims.C2_DOMAINS)}[k % 4], '/beat')
                          ELSE 'bash' END END AS command_line""",
        "CASE WHEN event_type = 'ProcessStart' THEN 'shell' END AS process_name",
        f"""CASE WHEN event_type = 'ApiCall' AND k % 7 = 0 THEN {_sql_list(dims.C2_DOMAINS)}[k % 4]
                 WHEN event_type = 'ApiCall' THEN concat('svc-', k % 5, '.internal') END AS destination_domain""",
        "CASE WHEN k % 5 = 0 THEN 'VPN - MFA' ELSE 'Password' END AS auth_method",
        "k", "value")
    return filled.selectExpr(
        "*",
        # half of the process rows carry the command as a sequence, half only as a line
        "CASE WHEN command_line IS NOT NULL AND k < 50 THEN array(command_line) "
        "ELSE cast(array() AS array<string>) END AS command_sequence",
        f"""CASE WHEN event_type = 'ProcessStart' AND k % 10 = 1 THEN 'Suspicious PowerShell'
                 WHEN event_type = 'ProcessStart' AND k % 10 = 3 THEN 'Malware Execution'
                 WHEN event_type = 'ProcessStart' AND k % 10 = 5 THEN 'Beaconing C2'
                 WHEN event_type = 'FileUpload' AND bytes_transferred > {100 * _MIB} THEN 'Data Exfiltration'
                 WHEN event_type = 'Login' AND status = 'FAILED' AND k < 10 THEN 'Brute Force'
                 WHEN event_type = 'ResourceAccess' AND k >= 90 THEN 'Privilege Escalation'
                 WHEN event_type = 'DatabaseQuery' AND k >= 95 THEN 'Lateral Movement'
                 ELSE 'None' END AS attack_type""").withColumn(
        "is_anomalous", F.col("attack_type") != "None").withColumn("entity_type", F.lit("user"))


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The employee dimension, one row per customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    base = c.selectExpr(
        "c_custkey AS employee_no", "format_string('EMP-%04d', c_custkey) AS employee_id",
        "concat('U-', md5(cast(c_custkey AS string))) AS employee_uuid", "c_name AS name",
        """CASE WHEN c_custkey % 11 = 0 THEN 'Marketing'
                ELSE CASE c_mktsegment WHEN 'MACHINERY' THEN 'Engineering' WHEN 'FURNITURE' THEN 'Sales'
                     WHEN 'BUILDING' THEN 'IT' WHEN 'AUTOMOBILE' THEN 'Finance' ELSE 'HR' END END AS department""",
        "array('Analyst', 'Team Manager', 'Director', 'Specialist')[c_custkey % 4] AS role",
        "concat('Office-', c_nationkey % 5) AS office_location",
        f"{_sql_list(dims.OPERATING_SYSTEMS)}[c_custkey % 5] AS preferred_os",
        f"{_sql_list(dims.BROWSERS)}[c_custkey % 4] AS preferred_browser",
        "abs(c_acctbal) / 10000 AS vpn_probability",
        """CASE WHEN c_custkey % 7 = 0 THEN array(concat('DEV-', c_custkey * 3), concat('DEV-', c_custkey * 3 + 1))
                ELSE array(concat('DEV-', c_custkey * 3), concat('DEV-', c_custkey * 3 + 1),
                           concat('DEV-', c_custkey * 3 + 2)) END AS allowed_devices""",
        f"""map({_sql_list(dims.RESOURCES)}[c_custkey % 24], 0.5D,
                {_sql_list(dims.RESOURCES)}[(c_custkey + 5) % 24], 0.25D) AS resource_probabilities""")
    hours = F.create_map(*[F.lit(x) for d, (s, _) in dims.WORK_HOURS.items() for x in (d, s)])
    ends = F.create_map(*[F.lit(x) for d, (_, e) in dims.WORK_HOURS.items() for x in (d, e)])
    night = F.col("employee_no") % 17 == 0
    return (base.withColumn("work_start", F.when(night, 22).otherwise(hours[F.col("department")]))
            .withColumn("work_end", F.when(night, 6).otherwise(ends[F.col("department")])))


def devices(log: DataFrame) -> DataFrame:
    """The device dimension: distinct devices seen in the log."""
    n = F.regexp_extract("device_id", "(\\d+)$", 1).cast("long")
    types = F.array(*[F.lit(x) for x in dims.DEVICE_TYPES])
    systems = F.array(*[F.lit(x) for x in dims.OPERATING_SYSTEMS])
    browsers = F.array(*[F.lit(x) for x in dims.BROWSERS])
    return (log.select("device_id", F.col("employee_id").alias("owner_id")).distinct()
            .withColumn("device_type", types[(n % 3).cast("int")])
            .withColumn("operating_system", systems[(n % 5).cast("int")])
            .withColumn("browser", browsers[(n % 4).cast("int")])
            .withColumn("trusted", n % 9 != 0))


def resources(spark: SparkSession) -> DataFrame:
    """The fixed resource dimension (24 rows)."""
    rows = [(r, t, s, list(d)) for r, (t, s, d) in dims.RESOURCE_DIM.items()]
    return spark.createDataFrame(
        rows, "resource_name string, resource_type string, sensitivity_level string, "
              "allowed_departments array<string>")
