import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import whitening


def brute(vectors):
    """Covariance, falling eigenvalues and vectors, exact deviations, of the vectors as whole numbers."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    c = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x])
    values, q = np.linalg.eigh(c.T @ c / n)
    return c, values[::-1], q[:, ::-1], deviation


def vectors(n=400, d=60, seed=1):
    return (np.random.default_rng(seed).standard_normal((n, d)) * np.linspace(1, 3, d)).astype(np.float32)


def test_filtered_iteration_equals_eigenvectors(spark):
    v = vectors()
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    rows = whitening.prepared(df.withColumn("x", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("c", F.lit(2)))
    f = whitening.fit(rows, components=12, guards=4)
    c, values, q, deviation = brute(v)
    assert f.n == 400 and f.passes > 30  # the filter has run: 16 of 60 dimensions
    assert np.allclose(f.values, values[:12], rtol=1e-12) and np.allclose(f.trace, values.sum(), rtol=1e-12)
    assert np.allclose(np.abs((f.vectors * q[:, :12]).sum(0)), 1, atol=1e-12)
    assert whitening.identity_error(rows, f) < 1e-10
    got = {r["vec_id"]: r for r in whitening.whiten(rows, f).collect()}
    assert [got[i]["deviation"] for i in range(400)] == deviation
    want = c @ q[:, :12] / np.sqrt(values[:12]) * np.sign((f.vectors * q[:, :12]).sum(0))
    assert np.allclose([got[i]["whitened"] for i in range(400)], want, atol=1e-9)


def test_many_tasks_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FEW", 2)
    v = vectors(90, 7, 3)
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(9)
    f = whitening.fit(whitening.prepared(df))
    assert np.allclose(f.values, brute(v)[1], rtol=1e-12)


def test_equal_eigenvalues_beyond_the_guards(spark):
    """Twelve equal eigenvalues, three wanted, one guard: any of their vectors will do."""
    v = np.vstack([np.eye(12), -np.eye(12)]) * 3
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = whitening.prepared(df)
    f = whitening.fit(rows, components=3, guards=1)
    assert len(f.values) == 3 and whitening.identity_error(rows, f) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.5, -2.0]), (6, [0.5, -2.0]), (None, [-3.0, 0.25]), (8, [1.0, 2.0, 3.0]), (9, []), (10, [0.0, 1e300])]
    kept = [(1, [1.0, 2.0]), (6, [0.5, -2.0]), (6, [0.5, -2.0]), (None, [-3.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(3)).withColumn("component", F.lit("a"))
    got = whitening.digest(df).collect()
    c, values, q, deviation = brute([v for _, v in kept])
    assert sorted((str(r["vec_id"]), r["component"], r["deviation"]) for r in got) == sorted((str(k), j, x) for (k, _), x in zip(kept, deviation) for j in (1, 2))
    assert {r["n"] for r in got} == {4} and all(abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12 for r in got)
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_no_spread_gives_no_rows(spark, rows):
    assert whitening.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0
