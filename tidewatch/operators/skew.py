"""Joins against a unique-key side when some keys are hot on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.operators import ordering as od


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
              min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Join ``left`` to ``right`` on ``key``; ``right`` has each key once.

    Each right row is small, so adaptive execution can split a hot key's left
    rows over tasks and read its right row in each of them.  ``min_rows`` is kept for
    callers that pass one threshold to several operators.
    """
    return left.join(right, key, how)
