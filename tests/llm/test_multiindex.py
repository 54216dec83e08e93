import math

import numpy as np

from tidewatch.llm import multiindex

SCHEMA = "vec_id long, embedding array<float>, id string, raw int"


def brute(rows, k=10):
    ok = [(i, np.array(v, dtype=float)) for i, v, *_ in rows if v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in {(i, tuple(v)) for i, v in ok}:
        if q % 100 == 0:
            best = {}
            for i, v in ok:
                if i != q:
                    d = math.sqrt(((v - np.array(x)) ** 2).sum())
                    best[i] = min(d, best.get(i, math.inf))
            out |= {(q, r, i, round(d, 9)) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1)}
    return out


def data():
    r = np.random.default_rng(3)
    rows = [(i, np.round(r.normal(size=6), 3).astype(np.float32).tolist(), "x", 1) for i in range(600)]
    same = rows[5][1]
    rows += [(i, same, "x", 1) for i in range(1000, 1040)] + [(1100, same, "x", 1), (1100, same, "x", 1)]
    rows += [(2000, None, "", 1), (2100, [0.0] * 6, "", 1), (2200, [None, 1.0, 1.0, 1.0, 1.0, 1.0], "", 1), (2300, [float("nan")] + [1.0] * 5, "", 1), (2400, [float("inf")] + [1.0] * 5, "", 1),
             (2500, [1.0, 2.0], "", 1), (2600, [], "", 1)]
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in multiindex.search(df, df.filter("vec_id % 100 = 0"), **options).collect()}


def test_all_candidates_is_exact(spark):
    assert found(spark, data()) == brute(data())


def test_blocks_and_teams_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 3)
    assert found(spark, data()) == brute(data())


def test_recall_with_fewer_candidates(spark):
    got, want = found(spark, data(), candidates=250), brute(data())
    assert len({x[::2] for x in got} & {x[::2] for x in want}) >= 0.7 * len(want)


def test_walk_follows_the_sums():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    cells = multiindex.walk(a, b, np.ones(6, dtype=int), 6)
    sums = [a[c // 2] + b[c % 2] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == list(range(6))


def test_few_and_no_vectors(spark):
    two = [(0, [1.0] * 6, "", 1), (100, [2.0] * 6, "", 1)]
    assert found(spark, two) == brute(two)
    assert found(spark, [(0, None, "", 1)]) == set()
    assert found(spark, [(0, [1.0] * 6, "", 1)]) == set()


def test_walks_grow_with_the_table(spark):
    r = np.random.default_rng(11)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist(), "x", 1) for i in range(6_000)]
    got, want = found(spark, rows, candidates=60), brute(rows)
    assert len({x[::2] for x in got} & {x[::2] for x in want}) >= 0.9 * len(want)
    few, recall = found(spark, rows, candidates=60, recall=0.01), 0.9 * len(want)
    assert len({x[::2] for x in few} & {x[::2] for x in want}) < recall


def test_repeated_rows_push_nothing_out(spark):
    for times in (2, 12):
        assert found(spark, data() * times) == brute(data())
    r = np.random.default_rng(4)
    near = [(7, np.round(r.normal(size=6) / 100 + 1, 3).astype(np.float32).tolist(), "x", 1) for _ in range(40)]
    assert found(spark, data() + near + [(5000, [1.0] * 6, "x", 1)]) == brute(data() + near + [(5000, [1.0] * 6, "x", 1)])


def test_queries_with_a_common_divisor_use_every_team():
    for split in (2, 4, 5, 10, 25, 50):
        n = np.bincount(multiindex.teams(list(range(0, 400_000, 100)), split), minlength=split)
        # about 4,000 / split each, give or take a random spread
        assert len(n) == split and abs(n - n.mean()).max() < 5 * n.mean() ** 0.5
    assert set(multiindex.teams([-100, 0, 2**62], 1)) == {0}
