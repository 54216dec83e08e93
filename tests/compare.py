"""Run registered queries against their SQL twins: ``python tests/compare.py DIR [query ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _text(v):
    if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, int, np.integer)):
        f = float(v)
        return repr(f + 0.0) if f != 0 else "0.0"
    return str(v)


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_text(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    a = fn(spark, sf_dir).toPandas()
    b = con.execute(sql).fetchdf()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    x, y = normal(a), normal(b)
    if len(x) != len(y):
        return f"rows {len(x)} != {len(y)}; only spark {sorted(set(x) - set(y))[:2]}; only sql {sorted(set(y) - set(x))[:2]}"
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    return "" if not bad else f"{len(bad)} of {len(x)} rows differ, e.g. {bad[0]}"


if __name__ == "__main__":
    from tidewatch.session import build

    import __spark_entry__ as entry

    spark = build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                 "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in names or list(qs):
        t = time.time()
        if n not in sqls:
            continue
        try:
            msg = compare(spark, con, n, qs[n], sqls[n], sf)
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(msg)
        if msg or names or time.time() - t > 6:
            print(n, msg or "ok", f"{time.time() - t:.1f}s", flush=True)
    print("bad:", bad, "of", len(names or sqls), "; without sql:", sorted(set(qs) - set(sqls)), "; orphans:", sorted(set(sqls) - set(qs)))
