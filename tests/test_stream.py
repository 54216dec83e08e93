"""Streams give the batch result."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tidewatch.operators import behavior
from tidewatch.plans import queries as q
from tidewatch.streaming.alerts import alert_stream, write_alerts

SF = "/root/testdata/sf0.001"


def test_drift_over_micro_batches(spark):
    rows = q._rows(spark, SF).select("employee_id", "session_id", "start_time", "office_location", "device_id", "browser", "operating_system", "resource_mask")
    from tidewatch.streaming.drift import drift_stream

    out = q._drain(spark, drift_stream(q._stream(spark, rows, "rows", "start_time", closing=q._end(rows, "start_time"))), "drift").where("employee_id != '~end'")
    want = behavior.drift_scores(behavior.number_sessions(rows))
    cols = ["session_id", "accepted", F.round("behaviour_score", 9).alias("b")]
    assert sorted(out.select(cols).collect()) == sorted(want.select(cols).collect())


def test_alerts_written_once(spark, tmp_path):
    x = q._scored(spark, SF).select("session_id", F.col("start_time").alias("ts"), "risk_score")
    twice = x.unionByName(x)
    twice.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a restart with nothing new adds nothing
        stream = spark.readStream.schema(twice.schema).parquet(f"{tmp_path}/in")
        write_alerts(alert_stream(stream), f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("session_id").distinct().count() == x.where("risk_score >= 35").count() > 0


def test_sessions_over_micro_batches(spark):
    """Several batches, state carried between them, and every session comes out at the end."""
    from tidewatch.operators import sessions as ss
    from tidewatch.streaming.sessions import sessionize_stream

    log = q._log(spark, SF).select("ts", "employee_id", "event_type", "status", "is_anomalous", "event_id")
    stream = sessionize_stream(q._stream(spark, log, "events"))
    query = stream.writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) > 2
    got = {(r["employee_id"], r["n_events"], r["start_us"], r["end_us"]) for r in q.str_sessions(spark, SF).collect()}
    batch = ss.sessionize(log, ["employee_id"]).groupBy("employee_id", "session_no").agg(
        F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b"))
    assert got == {(r["employee_id"], r["n"], r["a"], r["b"]) for r in batch.collect()}


def _events(n=60, seed=3):
    """(event_id, employee_id, ts, session_id) over some days: gaps around the limit, equal times, a key with most rows."""
    r = random.Random(seed)
    t, out = dict.fromkeys("abc", 1_700_000_000), []
    for i in range(n):
        k = r.choice("aaaabc")
        t[k] += r.choice([0, 5, 600, 1800, 1801, 7200])
        out.append((i, k, dt.datetime.fromtimestamp(t[k], dt.timezone.utc), r.choice(["s1", "s2", " ", None]), "ip"))
    return out


EVENTS = "event_id long, employee_id string, ts timestamp, session_id string, ip_address string"
END = (10**6, "~end", dt.datetime(2060, 1, 1, tzinfo=dt.timezone.utc), "~end", None)


def _feed(spark, folder, batches, schema):
    """One file a batch, in this order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _run(spark, stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), query


def test_events_are_placed_in_order_whatever_their_batch(spark, tmp_path):
    from tidewatch.operators import sessions as ss
    from tidewatch.streaming.sessions import session_events_stream

    rows = _events()
    mixed = random.Random(1).sample(rows, len(rows))
    cols = ["event_id", "session_id", "pos", "gap"]
    for given in (False, True):
        folder = f"{tmp_path}/{given}"
        out, _ = _run(spark, session_events_stream(_feed(spark, folder, [mixed[:20], mixed[20:45], mixed[45:], [END]], EVENTS), delay="30 days", given=given), folder)
        out = out.where("employee_id != '~end'")
        table = spark.createDataFrame(rows, EVENTS)
        batch = ss.sessionize_auto(table, given=True) if given else ss.sessionize(table.drop("session_id"), ["employee_id"])
        assert not out.where("late").count()
        assert sorted(out.select(cols).collect(), key=str) == sorted(batch.select(cols).collect(), key=str)
        lead = out.where("pos = lead.pos").selectExpr("session_id", "lead.employee_id").collect()
        assert len(lead) == batch.select("session_id").distinct().count()


def test_late_events_are_returned_and_counted(spark, tmp_path):
    from tidewatch.streaming.sessions import session_events_stream

    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    def event(i, hours):
        return (i, "a", at + dt.timedelta(hours=hours), None, None)

    batches = [[event(1, 0), event(2, 1)], [event(3, 30)], [event(4, 31)], [event(5, 0.5), event(6, 29), (7, "a", None, None, None)], [END]]
    out, query = _run(spark, session_events_stream(_feed(spark, tmp_path, batches, EVENTS), delay="2 hours"), tmp_path)
    got = {r["event_id"]: (r["late"], r["session_no"], r["pos"]) for r in out.where("employee_id = 'a'").collect()}
    # 5 comes after 1 and 2 are out; 6 still finds its place before 3; a row without a time is placed when it comes
    assert got[5] == (True, None, None) and not any(late for i, (late, *_) in got.items() if i != 5)
    assert len(got) == 7 and got[6][2] < got[3][2] < got[4][2]
    assert out.where("late").count() == 1


def test_state_of_an_idle_entity_goes(spark, tmp_path):
    from tidewatch.streaming.drift import drift_stream

    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "employee_id string, session_id string, start_time timestamp, office_location string, device_id string, browser string, operating_system string, resource_mask long"

    def session(k, day):
        return (k, f"{k}{day}", at + dt.timedelta(days=day), "X" if day < 40 else "Y", "d", "b", "o", 1)

    batches = [[session("a", i) for i in range(5)] + [session("b", i) for i in range(5)], [session("b", 20)], [session("b", 39), session("c", 39)], [session("a", 50), session("b", 50)]]
    for idle, fresh in (("25 days", True), (None, False)):
        folder = f"{tmp_path}/{fresh}"
        out, _ = _run(spark, drift_stream(_feed(spark, folder, [*batches, [(*END[1:2], "~end", END[2], *[None] * 5)]], schema), "1 day", idle=idle), folder)
        got = {r["session_id"]: r["location_deviation"] for r in out.collect()}
        assert got["b50"] == 1.0 and got["a50"] == (0.0 if fresh else 1.0)
        state = spark.read.format("statestore").option("stateVarName", "carry").load(f"{folder}/ck")
        left = {r["key"][0] for r in state.select("key").collect()}
        assert any('"a"' in k or '"b"' in k for k in left) == (not fresh)


def test_alerts_once_after_a_failure_between_write_and_commit(spark, tmp_path):
    from tidewatch.operators import classify, features
    from tidewatch.streaming.alerts import score_stream

    rows = features.event_features(q._events(spark, SF), keys=["employee_id"]).drop("event_ids").withColumn("attack_type", F.coalesce("attack_type", F.lit("None")))
    names = ["total_upload_bytes", "total_events", "failed_login_count"]
    model = classify.fit_classifier(rows, names, kind="linear")
    rows = rows.cache()
    twice = rows.unionByName(rows)
    for part in (twice.where("hash(session_id) % 2 = 0"), twice.where("hash(session_id) % 2 != 0")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def fail(batch_id):
        seen.append(batch_id)
        if len(seen) == 2:
            raise RuntimeError("stopped after the write")

    def start(written):
        stream = spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        alerts = alert_stream(score_stream(stream, q._emp(spark, SF), model, names), watermark="9000 days").select("session_id", "risk_score", "predicted_label")
        return write_alerts(alerts, f"{tmp_path}/out", f"{tmp_path}/ck", True, written)

    query = start(fail)
    with pytest.raises(Exception):
        query.awaitTermination()
    assert seen == [0, 1]
    start(seen.append).awaitTermination()
    assert seen[2] == 1  # the batch that had been written is repeated
    got = [r["session_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    want = [r["session_id"] for r in q._scored(spark, SF).where("risk_score >= 35").collect()]
    assert sorted(got) == sorted(want)
    rows.unpersist()


def test_keys_share_state_entries(spark, tmp_path):
    """Many keys in few entries: the rows of the batch, no more entries than asked for, also without times and order columns."""
    from tidewatch.operators import sessions as ss
    from tidewatch.streaming.sessions import session_events_stream

    rows = [(i, f"{k}{i % 7}", *more) for i, k, *more in _events(200)]
    mixed = random.Random(2).sample(rows, len(rows))
    out, _ = _run(spark, session_events_stream(_feed(spark, tmp_path, [mixed[:70], mixed[70:], [END]], EVENTS), delay="30 days", buckets=3), tmp_path)
    cols = ["event_id", "session_id", "pos", "gap"]
    batch = ss.sessionize(spark.createDataFrame(rows, EVENTS).drop("session_id"), ["employee_id"])
    assert sorted(out.where("employee_id != '~end'").select(cols).collect(), key=str) == sorted(batch.select(cols).collect(), key=str)
    state = spark.read.format("statestore").option("stateVarName", "carry").load(f"{tmp_path}/ck")
    assert state.select("key").distinct().count() <= 3 < len({k for _, k, *_ in rows})


def test_entries_are_late_and_idle_by_key(spark, tmp_path):
    """Keys of one entry: a row is late behind rows of its own key only, and only an idle key starts anew."""
    from tidewatch.streaming.sessions import session_events_stream

    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    def event(i, k, hours):
        return (i, k, at + dt.timedelta(hours=hours), None, None)

    batches = [[event(1, "a", 0), (2, "b", None, None, None), (None, "b", None, None, None)], [event(3, "a", 30), event(4, "c", 40)], [event(6, "b", 39)],
               [event(5, "a", -1), event(7, "a", 39), event(8, "b", 60)], [END]]
    out, _ = _run(spark, session_events_stream(_feed(spark, tmp_path, batches, EVENTS), delay="2 hours", idle="25 hours", buckets=1), tmp_path)
    got = {(r["employee_id"], r["event_id"]): (r["late"], r["session_no"], r["pos"]) for r in out.where("employee_id != '~end'").collect()}
    assert got["a", 5] == (True, None, None) and sum(late for late, *_ in got.values()) == 1
    assert got["b", None] == (False, 1, 0) and got["b", 2] == (False, 2, 1) and got["b", 6] == (False, 3, 2)
    assert got["a", 1][1:] == (1, 0) and got["a", 3][1:] == (1, 0) and got["a", 7][1:] == (2, 1) and got["c", 4][1:] == (1, 0)
    state = spark.read.format("statestore").option("stateVarName", "mark").load(f"{tmp_path}/ck")
    assert state.select("key").distinct().count() <= 1


def test_alerts_compute_the_sessions_once(spark, monkeypatch):
    plans = []
    whole = q._stream
    monkeypatch.setattr(q, "_stream", lambda s, df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(s, df, *more))
    got = [r["session_id"] for r in q.str_alerts(spark, SF).collect()]
    assert "FileScan" not in plans[0] and sorted(got) == sorted(r["session_id"] for r in q._scored(spark, SF).where("risk_score >= 35").collect())
