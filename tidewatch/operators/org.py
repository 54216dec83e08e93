"""Employees, devices, departments, resources: lookups and bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get_employee(keys: DataFrame, emp: DataFrame, key: str = "key") -> DataFrame:
    """Employee of each key: by employee id, else by uuid; unknown keys stay with NULLs."""
    cols = [c for c in emp.columns if c != "employee_id"]
    by_id = emp.select(F.col("employee_id").alias(key), F.struct("employee_id", *cols).alias("_a"))
    by_uuid = emp.select(F.col("employee_uuid").alias(key), F.struct("employee_id", *cols).alias("_b"))
    out = keys.join(by_id, key, "left").join(by_uuid, key, "left")
    return out.withColumn("_e", F.coalesce("_a", "_b")).select(*keys.columns, "_e.*")


def devices_of(emp: DataFrame, dev: DataFrame, employee_id: str | None = None) -> DataFrame:
    """Known devices of one employee (in allowed order) or of all."""
    e = emp if employee_id is None else emp.where((F.col("employee_id") == employee_id) | (F.col("employee_uuid") == employee_id))
    listed = e.select("employee_id", F.posexplode("allowed_devices").alias("device_no", "device_id"))
    return listed.join(dev, "device_id")


def department_members(emp: DataFrame) -> DataFrame:
    """(department, employee_id)."""
    return emp.select("department", "employee_id")


def managers(emp: DataFrame, order: str = "employee_no") -> DataFrame:
    """First Director or Manager of each department in input order."""
    boss = emp.where(F.col("role").rlike("Director|Manager"))
    return boss.groupBy("department").agg(F.min_by(F.struct("employee_id", "role"), order).alias("m")).select(
        "department", F.col("m.employee_id").alias("manager_id"), F.col("m.role").alias("manager_role"))


def department_resources(res: DataFrame) -> DataFrame:
    """(department, resource_name) bridge."""
    return res.select(F.explode("allowed_departments").alias("department"), "resource_name")


def all_resources(res: DataFrame) -> DataFrame:
    """Every resource."""
    return res.select("resource_name", "resource_type", "sensitivity_level", "allowed_departments")


def department_policy(policies: DataFrame, department: str) -> DataFrame:
    """Policy row of a department; empty if it has none."""
    return policies.where(F.col("department") == department)


def primary_device(c: str = "allowed_devices") -> Column:
    """First allowed device, NULL without any."""
    return F.get(F.col(c), 0)
