"""Readers and writers round-trip; model persistence; checks that need files."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch import dims, texts
from tidewatch.operators import adapt, campaigns, classify, explain, features, incidents, quality, sequences
from tidewatch.plans import queries as q
from tidewatch.sources import demo_tables as demo
from tidewatch.sources import readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vector(spark):
    return q._vector(spark, SF).cache()


def test_events_round_trip(spark, tmp_path):
    log = q._log(spark, SF).withColumn("session_duration", F.lit(60.0))
    writers.write_events(log, f"{tmp_path}/events")
    back = readers.read_events(spark, f"{tmp_path}/events")
    assert back.columns == writers.events_layout(log).columns and len(back.columns) == 11
    std = adapt.standardize(back)
    assert std.count() == log.count()
    assert std.where(F.size("command_sequence") > 0).count() == log.where(F.size("command_sequence") > 0).count()
    assert std.where("is_anomalous").count() == log.where("is_anomalous").count()


def test_sessions_and_features(spark, tmp_path, vector):
    rows = q._rows(spark, SF).withColumn("risk_score", F.lit(1.234))
    writers.write_sessions(rows, f"{tmp_path}/s")
    s = spark.read.option("header", True).csv(f"{tmp_path}/s")
    assert len(s.columns) == 19 and s.count() == rows.count() and s.first()["risk_score"] == "1.23"
    stats = sequences.fit_scaler(vector)
    writers.write_features(vector, sequences.scale(vector, stats), f"{tmp_path}/f")
    back = readers.read_features(spark, f"{tmp_path}/f/tabular_features")
    assert back.columns[:5] == dims.META_COLUMNS and back.count() == vector.count()
    assert abs(back.agg(F.sum("total_events")).first()[0] - vector.agg(F.sum("total_events")).first()[0]) < 1e-6
    writers.save_scaler(spark, stats, f"{tmp_path}/scaler")
    assert writers.load_scaler(spark, f"{tmp_path}/scaler") == stats


def test_dims_round_trip(spark, tmp_path):
    emp = q._emp(spark, SF)
    writers.write_dims(emp, demo.devices(q._log(spark, SF)), demo.resources(spark), f"{tmp_path}/d")
    back = readers.read_employees(spark, f"{tmp_path}/d/employees")
    cols = ["employee_id", "department", "work_start", "work_end", "allowed_devices", "resource_probabilities"]
    key = lambda d: sorted(map(str, d.select(cols).collect()))
    assert key(back) == key(emp)
    assert spark.read.option("header", True).csv(f"{tmp_path}/d/resources").count() == 24


def test_external_formats(spark, tmp_path):
    rows = [{"user": "a", "time": "2024-01-01 00:00:00", "action": "login", "bytes": 5}, {"user": "b", "time": "1704067200", "action": "zip", "bytes": None}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "x.csv").write_text("user,time,action,bytes\na,2024-01-01 00:00:00,login,5\nb,1704067200,zip,\n")
    frames = [readers.read_external(spark, f"{tmp_path}/x.{e}") for e in ("json", "jsonl", "csv")] + [readers.read_external(spark, rows)]
    for f in frames:
        i = adapt.to_internal(f, adapt.detect_schema(f.columns)).orderBy("employee_id").collect()
        assert [r["employee_id"] for r in i] == ["a", "b"] and i[0]["ts"] == i[1]["ts"] and [r["bytes_transferred"] for r in i] == [5.0, 0.0]


def test_sequences_and_columns(spark, tmp_path):
    s = sequences.build_sequences(sequences.event_vectors(q._events(spark, SF)))
    writers.write_sequences(s, f"{tmp_path}/seq")
    back = readers.read_sequences(spark, f"{tmp_path}/seq")
    bad = back.where((F.size("seq") != 50) | (F.size("mask") != 50)).count()
    assert bad == 0 and sequences.sequence_alignment(q._rows(spark, SF), back).count() == 0
    plan = readers.read_cols(spark, f"{tmp_path}/seq", ["session_id", "nope"])._jdf.queryExecution().executedPlan().toString()
    assert "seq:" not in plan
    with pytest.raises(ValueError):
        readers.read_sequences(spark, f"{SF}/orders.parquet")


def test_campaign_files(spark, tmp_path):
    m = q._members(spark, SF)
    c = campaigns.campaign_text(campaigns.assign_campaign_ids(campaigns.campaigns(m)), m)
    writers.write_campaigns(c, m, f"{tmp_path}/c")
    flat = spark.read.option("header", True).csv(f"{tmp_path}/c/campaign_summary")
    assert flat.count() == c.count() and spark.read.json(f"{tmp_path}/c/campaigns").count() == c.count()
    assert spark.read.json(f"{tmp_path}/c/campaign_sessions").agg(F.sum(F.size("values"))).first()[0] == m.count()


def test_incident_files(spark, tmp_path):
    x = q._full(spark, SF)
    sums = incidents.summaries(x)
    rep = incidents.split_sections(incidents.report(x))
    writers.write_incidents(incidents.cards(x, sums), sums, rep.select("session_id", "report_text", "sections"), f"{tmp_path}/i")
    assert rep.where(F.size("sections") != 15).count() == 0
    assert spark.read.json(f"{tmp_path}/i/dashboard_cards").count() == x.count()
    plain = spark.createDataFrame([("no heading",)], "report_text string")
    assert incidents.split_sections(plain).first()["sections"] == {"full_text": "no heading"}


def test_upsert_incidents(spark, tmp_path):
    """First live row of a session wins, new sessions are added, untouched buckets keep their files."""
    path = f"{tmp_path}/inc"
    old = spark.range(200).select(F.format_string("S%03d", "id").alias("session_id"), F.lit("Low").alias("severity"), F.array("id").alias("steps"))
    writers.write_stored(old, path, 16)

    def files():
        return {str(f.relative_to(path)) for f in (tmp_path / "inc").rglob("*.parquet")}
    before = files()
    rows = [("S001", "High", [1], 2), ("S001", "Critical", [2], 1), ("S777", "Medium", [3], 5), ("S777", "High", [4], 6)]
    for turn in (rows, rows[::-1]):
        live = spark.createDataFrame(turn, "session_id string, severity string, steps array<long>, seen long")
        writers.upsert_incidents(live, path, "seen", 16)
    back = {r["session_id"]: (r["severity"], r["steps"]) for r in spark.read.parquet(path).collect()}
    want = {f"S{i:03d}": ("Low", [i]) for i in range(200)} | {"S001": ("Critical", [2]), "S777": ("Medium", [3])}
    assert back == want and spark.read.parquet(path).count() == 201
    assert set(spark.read.parquet(path).columns) == {"session_id", "severity", "steps", "bucket"}
    touched = {f"bucket={r[0]}" for r in live.select(F.pmod(F.xxhash64("session_id"), F.lit(16))).distinct().collect()}
    assert {f for f in before if f.split("/")[0] not in touched} == {f for f in files() if f.split("/")[0] not in touched}
    writers.upsert_incidents(live.limit(0), path, "seen", 16)
    assert spark.read.parquet(path).count() == 201
    with pytest.raises(ValueError):
        writers.upsert_incidents(live.drop("seen"), path, "seen", 16)


def test_playbook_file(spark, tmp_path):
    book = {a: {t: [f"{a} {t}"] for t in incidents.TIERS} for a in ("Normal", "Brute Force")}
    (tmp_path / "p.json").write_text(json.dumps(book, indent=1))
    pb = incidents.read_playbooks(spark, f"{tmp_path}/p.json")
    inc = spark.createDataFrame([("s", "Brute Force", "Critical", [("total_upload_bytes",)]), ("t", "Unheard", "Low", [])],
                                "session_id string, attack_type string, severity string, positive_contributors array<struct<feature:string>>")
    got = {r["session_id"]: r for r in incidents.recommend(inc, pb).collect()}
    assert got["s"]["immediate_containment"][0] == incidents.ISOLATE and len(got["s"]["immediate_containment"]) == 3
    assert got["s"]["priority_action"] == texts.ACTION["outgoing"] and got["t"]["recovery"] == ["Normal recovery"]


def test_models(spark, tmp_path, vector):
    from tidewatch.plans.pipeline import classify_sessions, score_sessions

    names = q.EVENT_FEATURES
    model, pred = classify_sessions(vector, "linear", names)
    writers.save_model(model, f"{tmp_path}/m")
    again = classify.apply_model(sequences.clean_features(vector, names), writers.load_model(f"{tmp_path}/m"), names)
    cols = ["session_id", "predicted_label", "confidence"]
    assert sorted(pred.select(cols).collect()) == sorted(again.select(cols).collect())
    # additivity: sum of attributions = score difference to the mean row
    classes, w = explain.linear_weights(model)
    means = explain.feature_means(vector, names)
    a = explain.attribute(vector, classes, w, names, means).groupBy("session_id", "class").agg(F.sum("phi").alias("s"))
    f = sum((F.col(n) * F.lit(w[1][i]) for i, n in enumerate(names)), F.lit(0.0)) - F.lit(sum(x * m for x, m in zip(w[1], means)))
    j = vector.select("session_id", f.alias("want")).join(a.where(F.col("class") == classes[1]), "session_id")
    assert j.where(F.abs(F.col("s") - F.col("want")) > 1e-6 * (1 + F.abs("want"))).count() == 0
    s = score_sessions(q._events(spark, SF), vector)
    r = s.agg(F.min("anomaly_score"), F.max("anomaly_score"), F.count("*")).first()
    assert r[0] == 0 and r[1] == 1 and r[2] == vector.count()
    full = score_sessions(q._events(spark, SF), vector, 21).agg(F.max("reconstruction_error")).first()[0]
    assert full < 1e-12  # all components: perfect reconstruction


def test_tune_and_importance(spark, vector):
    names = ["failed_login_count", "total_upload_bytes", "processes_started", "powershell_executions"]
    data = sequences.clean_features(vector, names)
    best, score = classify.tune(data, names, space={"numTrees": [5], "maxDepth": [2, 4]}, n_iter=5, folds=3)
    assert best["numTrees"] == 5 and 0 <= score <= 1
    m = classify.fit_classifier(data, names, params=best)
    imp = classify.importance(m, names)
    assert imp.count() == 4 and abs(imp.agg(F.sum("importance")).first()[0] - 1) < 1e-9


def test_feature_schema(vector):
    assert len(dims.FEATURES) == 69 and len(dims.MODEL_FEATURES) == 71
    assert adapt.check_feature_schema(vector, dims.FEATURES) == (True, True)
    assert adapt.check_feature_schema(vector.drop("browser"), dims.FEATURES) == (False, False)
    assert quality.check_features(vector, vector.count()).count() == 0
    assert quality.check_features(vector, 1).count() == 1


def test_catalogue_and_context(spark, vector):
    assert features.feature_catalogue(spark).count() == 71
    c = features.session_context(vector, q._rows(spark, SF))
    assert c.count() == vector.count()


@pytest.mark.parametrize("min_rows", [20, 500_000])
def test_json_documents_in_pieces(spark, tmp_path, min_rows):
    """Braces, quotes and escapes in strings, nested objects and arrays, files that are cut anywhere: the rows of Python's reader."""
    import random

    from tidewatch.sources.json_documents import json_records, read_json_documents

    rng = random.Random(5)
    odd = ["}", "{", '"', "\\", '\\"', "}{", "},{", "[", "]", "\n", "é", "a", "\\\\", ", ", "😀"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(9)))
    rows = [{"id": i, "a": text(), text() + "k": None, "n": {"x": [text(), {"y": {}}], "z": {"w": text()}}} for i in range(300)]
    one, two, three = ([r for r in rows if r["id"] % 3 == k] for k in range(3))
    folder = tmp_path / "logs.json"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps(one))
    (folder / "2.json").write_text(json.dumps(two, indent=2, ensure_ascii=False))
    (folder / "3.json").write_text("\n".join(map(json.dumps, three)))
    (folder / "4.json").write_text("[]")
    (folder / "5.json").write_text("")
    (folder / "6.json").write_text('[{"id": "never closed')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.option("lineSep", "}").text(str(folder)).rdd.getNumPartitions() > 8
        got = json_records(spark, str(folder), min_rows).collect()
        back = read_json_documents(spark, str(folder), ["id", "a", "n"], min_rows).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((json.loads(r["record"]) for r in got), key=lambda r: r["id"]) == rows
    ones = sorted((r["number"], json.loads(r["record"])["id"]) for r in got if r["file"].endswith("1.json"))
    assert ones == [(i, r["id"]) for i, r in enumerate(one)]
    assert sorted((int(r["id"]), r["a"], json.dumps(json.loads(r["n"]))) for r in back) == [(r["id"], r["a"], json.dumps(r["n"])) for r in rows]


def test_json_documents_round_trip(spark, tmp_path):
    from tidewatch.sources.json_documents import read_json_documents, write_json_documents

    df = spark.createDataFrame([("1", None, "}"), ("2", '{"x": "\\""}', None)], "id string, a.b string, c string".replace("a.b", "`a.b`"))
    write_json_documents(df.repartition(3, "id"), f"{tmp_path}/x.json")
    assert all(isinstance(json.loads(p.read_text()), list) for p in (tmp_path / "x.json").glob("part-*"))
    back = read_json_documents(spark, f"{tmp_path}/x.json")
    assert back.columns == ["a.b", "c", "id"] and sorted(map(tuple, back.collect()), key=str) == sorted([(None, "}", "1"), ('{"x": "\\""}', None, "2")], key=str)


def test_json_documents_are_not_shuffled(spark, tmp_path):
    """Only the text that splits of a file share is grouped; the rest is put together where it is read."""
    from tidewatch.sources.json_documents import json_records

    (tmp_path / "x.json").write_text(json.dumps([{"i": i, "t": "}{" * (i % 5)} for i in range(400)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = json_records(spark, f"{tmp_path}/x.json", 20)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["number"], json.loads(r["record"])["i"]) for r in got.collect()) == [(i, i) for i in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan text" in line)
    above = [line for line in lines[:scan] if "Exchange" in line and "BroadcastExchange" not in line and line.index("Exchange") < lines[scan].index("FileScan")]
    assert not above and "Window" not in plan
