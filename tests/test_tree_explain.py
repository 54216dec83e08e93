"""Shapley values of forests against all subsets of features."""

import itertools
import math
import random

import pytest

from tidewatch.operators import classify, tree_explain

NAMES = [f"x{i}" for i in range(8)]


@pytest.fixture(scope="module")
def fitted(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        x = [float(r.randint(0, 9)) for _ in NAMES]
        rows.append((f"s{i}", "abc"[(x[0] > 4) + (x[1] * x[2] > 20)], *x))
    rows += [("odd", "a", *[None] * 4, float("nan"), float("inf"), 1e30, -1.0)]
    df = spark.createDataFrame(rows, "session_id string, attack_type string, " + ", ".join(f"{n} double" for n in NAMES))
    return df, classify.fit_classifier(df, NAMES, kind="forest", params={"numTrees": 5, "maxDepth": 5})


def expectation(nodes, x, known, c, at=0):
    """Value of a tree where only the ``known`` features are the row's."""
    n = nodes[at]
    if n["left"] < 0:
        return n["stats"][c] / sum(n["stats"])
    if n["feature"] in known:
        return expectation(nodes, x, known, c, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
    return sum(sum(nodes[n[side]]["stats"]) / sum(n["stats"]) * expectation(nodes, x, known, c, n[side]) for side in ("left", "right"))


def brute(trees, x, c):
    m = len(x)
    value = {s: sum(expectation(t, x, s, c) for t in trees) / len(trees) for k in range(m + 1) for s in map(frozenset, itertools.combinations(range(m), k))}
    weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    return [sum(weight[len(s)] * (value[s | {f}] - v) for s, v in value.items() if f not in s) for f in range(m)], value[frozenset()]


def test_values_equal_all_subsets(spark, fitted):
    df, model = fitted
    classes = classify.class_names(model)
    forest = tree_explain.read_forest(model, len(classes))
    trees = {}
    for r in tree_explain.forest_nodes(model).collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    some = df.where("session_id IN ('s1', 's2', 's3', 's77', 'odd')")
    got = {(r["session_id"], r["class"], r["feature"]): r["phi"] for r in tree_explain.attribute(some, forest, classes, NAMES).collect()}
    for row in some.collect():
        x = [0.0 if row[n] is None or not math.isfinite(row[n]) else row[n] for n in NAMES]
        for c, name in enumerate(classes):
            want, base = brute(list(trees.values()), x, c)
            assert abs(base - forest.expected[c]) < 1e-12
            for f, phi in enumerate(want):
                assert abs(got.get((row["session_id"], name, NAMES[f]), 0.0) - phi) < 1e-12


def test_values_sum_to_prediction_less_expectation(spark, fitted):
    df, model = fitted
    classes = classify.class_names(model)
    forest = tree_explain.read_forest(model, len(classes))
    pred = classify.apply_model(df, model, NAMES)
    got = tree_explain.attribute_predicted(pred, forest, classes, NAMES).collect()
    assert len(got) == df.count()
    for r in got:
        c = classes.index(r["predicted_label"])
        assert len(r["phi"]) == len(r["x"]) == 8
        assert abs(sum(r["phi"]) - (r["probs"][c] - forest.expected[c])) < 1e-9


def test_leaf_without_conditions_and_empty_frame(spark, fitted):
    df, _ = fitted
    forest = tree_explain.Forest([[({}, [0.25, 0.75])]], [0.25, 0.75])
    assert tree_explain.attribute(df, forest, ["a", "b"], NAMES).count() == 0
    got = tree_explain.attribute_predicted(df.limit(2), forest, ["a", "b"], NAMES, predicted="attack_type").collect()
    assert [r["phi"] for r in got] == [[0.0] * 8] * 2
    assert tree_explain.attribute(df.limit(0), forest, ["a", "b"], NAMES).count() == 0


def test_explanations_of_a_forest(spark, fitted):
    df, model = fitted
    pred = classify.apply_model(df, model, NAMES)
    assert tree_explain.explain_model(pred, model, NAMES).where("size(phi) = 8").count() == df.count()


def test_rows_are_shuffled_by_key_only_and_repeated_keys_add_up(spark, fitted):
    df, model = fitted
    classes = classify.class_names(model)
    forest = tree_explain.read_forest(model, len(classes))
    some = df.where("session_id IN ('s1', 's2', 's3')")
    mixed = some.unionByName(some.where("session_id = 's1'")).selectExpr("CASE WHEN session_id != 's3' THEN session_id END AS session_id", *NAMES)
    one, twice = ({(r["session_id"], r["class"], r["feature"]): r["phi"] for r in tree_explain.attribute(x, forest, classes, NAMES).collect()} for x in (some, mixed))
    assert {k[0] for k in twice} == {"s1", "s2", None} and len(twice) == len(one)
    assert all(abs(v - {"s1": 2, "s2": 1, None: 1}[k[0]] * one[(k[0] or "s3", *k[1:])]) < 1e-12 for k, v in twice.items())
    plan = tree_explain.attribute(df, forest, classes, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan   # no row for each tree or leaf
