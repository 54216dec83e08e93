"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs twice into a ``noop`` sink (every row and column is produced)
and the faster run counts, so code generation and class loading are not timed.
``build`` is the part of it that passes before the query's own job starts.
"""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = {  # query -> input table whose rows give the rate
    "ses_gap": "events", "ses_build": "events", "fea_process": "events", "fea_vector": "events", "beh_drift": "events",
    "beh_window_deviations": "events", "beh_novelty": "events", "seq_padded": "events", "scl_features": "events",
    "rsk_rule": "events", "thr_f1": "lineitem", "met_roc_auc": "lineitem", "met_histogram": "lineitem", "spl_stratified": "events",
    "exp_attribution": "embeddings", "inc_recommend": "events", "cor_components": "events", "cor_campaigns": "events",
    "dq_events": "events", "adp_internal": "events", "sco_reconstruct": "events", "cls_fit_predict": "events",
    "inc_summaries": "events", "snk_events": "events", "str_sessions": "events",
}


def main() -> None:
    from tidewatch.plans.queries import QUERIES
    from tidewatch.session import build

    spark = build(f"local[{CPUS}]", "bench", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
                                                "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    rows = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in set(HEADLINE.values())}
    secs, rate, build_secs = {}, {}, {}
    for name, source in HEADLINE.items():
        runs = []
        for _ in range(2):
            t = time.perf_counter()
            df = QUERIES[name](spark, SF_DIR)
            built = time.perf_counter() - t
            df.write.format("noop").mode("overwrite").save()
            runs.append((time.perf_counter() - t, built))
        secs[name], build_secs[name] = (round(x, 3) for x in min(runs))
        rate[name] = round(rows[source] / min(runs)[0])
    print(json.dumps({"metric": "total_seconds", "value": round(sum(secs.values()), 3), "unit": "sec", "queries": secs,
                      "build": build_secs, "rows_per_sec": rate, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cores": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
