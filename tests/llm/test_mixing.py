import numpy as np
from helpers import SCHEMA, documents, table

from tidewatch.llm import mixing


def rows(n, sizes):
    return [(i, "t", None, s) for i, s in enumerate(x for s, k in sizes.items() for x in [s] * k)]


def test_period_stays_within_one_block():
    shares = mixing.parts({"a": 5, "b": 3, "c": 1.5, "d": 0.01}, 997)
    assert sum(shares.values()) == 997 and min(shares.values()) >= 1
    slots = mixing.period(shares)
    assert sorted(np.concatenate(list(slots.values())).tolist()) == list(range(997))
    for s, x in slots.items():
        for k, t in enumerate(x.tolist()):
            assert k * 997 // shares[s] <= t < -(-(k + 1) * 997 // shares[s])


def test_positions_and_deviation(spark):
    df = spark.createDataFrame(rows(0, {"a": 900, "b": 300, "c": 40, None: 25}), SCHEMA).repartition(3)
    got = mixing.interleave(df, weights={"a": 2, "b": 1, "c": 1}, block=4).toPandas().sort_values("position")
    assert got["position"].tolist() == list(range(1265))
    assert sorted(got["doc_id"]) == list(range(1265))
    got["source"] = got["source"].fillna("null")
    blocks = got.drop_duplicates("slot")
    for _, p in blocks.groupby("phase"):
        for s, x in p.groupby("source"):
            placed = (p["source"] == s).cumsum().to_numpy()
            assert np.abs(placed - x["share"].iloc[0] * np.arange(1, len(p) + 1)).max() < 1


def test_slices_give_the_same_order(spark, monkeypatch):
    df = spark.createDataFrame(rows(0, {"a": 500, "b": 60}), SCHEMA)
    plain = {r["doc_id"]: r["position"] for r in mixing.interleave(df).collect()}
    monkeypatch.setattr(mixing, "SLICE", 7)
    sliced = [r["position"] for r in mixing.interleave(df).collect()]
    assert sorted(sliced) == sorted(plain.values()) == list(range(560))


def test_odd_rows_and_columns_stay(spark):
    out = mixing.mixed(table(spark))
    assert out.columns == table(spark).columns and out.count() == len(documents())
    assert mixing.interleave(spark.createDataFrame([], SCHEMA)).count() == 0
