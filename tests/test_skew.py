"""Sliced layouts for hot keys must give the same rows as the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.columns import micros
from tidewatch.operators import behavior, campaigns, features, metrics, ordering, sequences, sessions
from tidewatch.operators.skew import skew_join
from tidewatch.plans import queries as q

SF = "/root/testdata/sf0.001"


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    x, y = (sorted(map(str, d.select(*cols).collect())) for d in (a, b))
    assert x == y


@pytest.fixture(scope="module")
def hot_log(spark):
    """A log where a third of all rows has no employee, and a third of all times are equal."""
    log = q._log(spark, SF)
    return (log.withColumn("employee_id", F.when(F.col("event_id") % 3 != 0, F.col("employee_id")))
            .withColumn("ts", F.when(F.col("event_id") % 6 < 2, F.to_timestamp(F.lit("2024-05-05 10:00:00"))).otherwise(F.col("ts"))))


def test_sessionize(spark, hot_log):
    cut = sessions.sessionize(hot_log, ["employee_id"], min_rows=100)
    plain = sessions.sessionize(hot_log, ["employee_id"])
    same(cut, plain)
    assert {"new_ip", "new_dest"} <= set(cut.columns)
    f1 = features.event_features(cut, keys=["employee_id"]).select("session_id", "unique_source_ips", "unique_destination_ips", "maximum_idle_time", "first_event_type", "admin_access_position")
    f2 = features.event_features(plain, keys=["employee_id"]).select(*f1.columns)
    same(f1, f2)


def test_running(spark, hot_log):
    def run(min_rows):
        d, o = ordering.order_by(hot_log, ["employee_id"], micros("ts"), ["event_id"], min_rows)
        assert o.sliced == (min_rows < 1000)
        d = ordering.running_sum(d, o, {"s": "k"})
        d = ordering.running_max(d, o, "m", "value")
        return ordering.done(d).select("event_id", "s", "m")
    same(run(100), run(10**9))


def test_moments_masks_and_counts(spark):
    """Equal to two passes over the earlier values, near 1e9 too, whatever the layout."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 5}", i, None if i % 11 == 0 else 1e9 + rng.random(), 1 << rng.randrange(6), rng.choice("abc") if i % 7 else None)
            for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, x double, mask long, v string")
    for n in (20, 10**9):
        d, o = ordering.order_by(df, ["k"], F.col("i"), [], n)
        assert o.sliced == (n == 20)
        d = ordering.count_before(ordering.running_mask(ordering.running_moments(d, o, {"m": "x"}), o, "had", "mask"), o, {"seen": "v"})
        got = {r["i"]: r for r in ordering.done(d).collect()}
        assert len(got) == len(rows)
        for k, i, _, _, v in rows:
            past = [r for r in rows[:i] if r[0] == k]
            xs = [r[2] for r in past if r[2] is not None]
            g, had = got[i], 0
            for r in past:
                had |= r[3]
            assert (g["had"], g["seen"], g["m_n"]) == (had, sum(r[4] == v for r in past), len(xs))
            if not xs:
                assert g["m_mean"] is None and g["m_sd"] is None
                continue
            mean = sum(x - 1e9 for x in xs) / len(xs)
            sd = (sum((x - 1e9 - mean) ** 2 for x in xs) / len(xs)) ** 0.5
            assert abs(g["m_mean"] - 1e9 - mean) < 1e-6 and abs(g["m_sd"] - sd) < 1e-6


def test_baselines_and_novelty(spark):
    numbered = q._num(spark, SF)
    same(behavior.novelty_flags(numbered, min_rows=20), behavior.novelty_flags(numbered))
    a, b = (behavior.baseline_asof(numbered, min_rows=n) for n in (20, 10**9))
    fine = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes]
    same(a.select(fine), b.select(fine))


def test_dedup(spark, hot_log):
    e = hot_log.withColumn("session_id", F.col("employee_id")).withColumn("ts", F.date_trunc("hour", "ts"))
    a, b = (sessions.dedup_timestamps(e, min_rows=n).select("event_id", "new_second") for n in (50, 10**9))
    same(a, b)


def test_curves_and_split(spark):
    x = q._scores(spark, SF)
    for fn in (metrics.roc_curve, metrics.pr_curve):
        same(fn(x, "score", "label", min_rows=100), fn(x, "score", "label"))
    assert metrics.percentile_threshold(x, "score", min_rows=100).first() == metrics.percentile_threshold(x, "score").first()
    e = q._emb(spark, SF)
    same(metrics.ovr_auc(e, "probs", "label", min_rows=50).select("class", F.round("roc_auc", 9)), metrics.ovr_auc(e, "probs", "label").select("class", F.round("roc_auc", 9)))
    y = x.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("session_id"), "label").distinct()
    same(sequences.stratified_split(y, "label", min_rows=200), sequences.stratified_split(y, "label"))


def test_moving_average_blocks(spark):
    x = spark.range(500).select("id", (F.col("id") * 37 % 101).cast("double").alias("v"))
    same(metrics.moving_average(x, "v", F.col("id"), [], 5, block=20), metrics.moving_average(x, "v", F.col("id"), [], 5))


def test_skew_join(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string").alias("k"))
    right = spark.range(0, 900, 2).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        same(skew_join(left, right, "k", how, min_rows=50), left.join(right, "k", how))


def test_components_random(spark):
    """Run components equal a union-find over all pairs within the window, in any row order."""
    from datetime import datetime, timedelta

    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    rows = [(f"S{i:03d}", f"e{rng.randrange(40)}", f"ip{rng.randrange(3 if i % 3 == 0 else 60)}", f"d{rng.randrange(50)}", t0 + timedelta(hours=rng.randrange(900)))
            for i in range(150)]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in rows:
        for b in rows:
            if a[0] < b[0] and abs(a[4] - b[4]) <= timedelta(hours=24) and any(a[c] == b[c] for c in (1, 2, 3)):
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    want = {s: find(s) for s in parent}
    for order in (rows, rows[::-1]):
        inc = spark.createDataFrame(order, "session_id string, employee_id string, source_ip string, device_id string, ts timestamp")
        for n, finish in ((10**9, 10**6), (20, 15)):
            got = campaigns.components(campaigns.runs(inc, min_rows=n), finish)
            assert dict(map(tuple, got.select("session_id", "component").collect())) == want


def test_components_of_a_long_path(spark):
    """A path of 10,000 incidents in order is contracted in few rounds of falling size."""
    runs = spark.range(10_000).select("id", F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("i")).selectExpr("lpad(string(i), 6, '0') session_id", "string(id) run")
    sizes = []
    got = campaigns.components(runs, finish=0, sizes=sizes).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [("000000", 10_001)]
    assert len(sizes) <= 20 and sizes == sorted(set(sizes), reverse=True)


def test_paged_lists(spark):
    d = spark.range(25).select(F.lit("a").alias("g"), F.col("id").alias("p"), F.col("id").cast("string").alias("v"))
    got = ordering.paged_lists(d, ["g"], "p", "v", "vs", 10).orderBy("page").collect()
    assert [len(r["vs"]) for r in got] == [10, 10, 5] and [v for r in got for v in r["vs"]] == [str(i) for i in range(25)]


def _history(spark, n, rejected):
    """Sessions of three entities, one of them NULL; from the fourth session on ``rejected`` entities differ in every value."""
    x = spark.range(n).select(F.col("id"), F.explode(F.array(F.lit("A"), F.lit("B"), F.lit(None))).alias("employee_id"))
    odd = F.col("id") >= 3 if rejected else F.xxhash64("id", "employee_id") % 5 == 0
    v = F.when(odd, F.concat(F.lit("v"), (F.xxhash64("id") % 7).cast("string"))).otherwise("home")
    return x.select("employee_id", F.concat(F.coalesce("employee_id", F.lit("-")), F.lit("-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("session_id"),
                    F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7200 + F.when(odd, F.col("id") % 12 * 300).otherwise(0)).alias("start_time"),
                    v.alias("office_location"), v.alias("device_id"), v.alias("browser"), v.alias("operating_system"),
                    F.when(odd, F.col("id") % 64).otherwise(1).alias("resource_mask"), F.col("id").alias("n_before"))


@pytest.mark.parametrize("rejected", [False, True])
def test_drift_in_slices(spark, rejected):
    """Slices chained through their end windows equal one fold, with more slices than speculative rounds."""
    h = _history(spark, 120, rejected)
    whole = behavior.drift_scores(h)
    same(behavior.drift_scores(h, block=13), whole)
    assert whole.count() == 360
    if rejected:
        assert whole.where("NOT accepted").count() > 300


def test_drift_is_linear(spark):
    """100,000 sessions of an entity that is rejected for good: one pass."""
    import time

    h = _history(spark, 100_000, True)
    began = time.time()
    assert behavior.drift_scores(h).where("NOT accepted").count() > 250_000
    assert time.time() - began < 60


def test_drift_of_nothing(spark):
    assert behavior.drift_scores(_history(spark, 0, False)).count() == 0


def test_tasks_of_large_frames_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidewatch.operators import ordering as od

    df = spark.range(2000).select((F.col("id") % 97).alias("k"), F.col("id"))
    plain, o = od.order_by(df, ["k"], F.col("id"), ["id"])
    monkeypatch.setattr(od, "TASK_ROWS", 50)
    cut, p = od.order_by(df, ["k"], F.col("id"), ["id"])
    assert p == o and cut.rdd.getNumPartitions() == 40
    want, got = (sorted(map(tuple, od.done(od.position_and_lag(x, o)).select("k", "id", "pos").collect())) for x in (plain, cut))
    assert got == want and len(got) == 2000


def test_a_fit_reads_its_rows_from_one_stored_table(spark, monkeypatch):
    from tidewatch.operators import classify, sequences

    kept = []
    monkeypatch.setattr(classify, "checkpointed", lambda df: kept.append(df) or df)
    df = spark.createDataFrame([(float(i % 5), "ab"[i % 5 > 2]) for i in range(40)] + [(1.0, None)], "x double, attack_type string")
    classify.fit_classifier(df, ["x"], params={"numTrees": 2})
    assert [d.columns for d in kept] == [["attack_type", "weight", "features"]]
    # rows are not dealt by class, which would put nearly all of them into one task
    plan = sequences.class_weights(df, "attack_type")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
