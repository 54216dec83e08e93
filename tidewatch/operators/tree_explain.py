"""Shapley values of forests, path-dependent.

The value of a set S of features for a tree is its expectation when the features of S are those of the row and all other splits are taken in proportion to
their training weight.  One leaf with m different features on its path is a product game: feature f gives o(f) (1 where the row satisfies all of the
leaf's conditions on f, else 0) if it is in S, and z(f), the product of its weight shares, if not.  The Shapley values of such a game depend only on which
conditions hold, so each leaf has a table of 2^m rows of m weights, made once from the model.  A row then looks up one row of it per leaf:

    phi(row, class, f) = sum over trees and leaves of weight(leaf, conditions held, f) * value(leaf, class) / trees

in each task for whole batches of rows.  Only the rows themselves are shuffled, by key; the tables' size depends on the model only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import dims
from tidewatch.lineage import work_folder

#: Rows that are looked up at once.
CHUNK = 1_000


@dataclass
class Forest:
    """Leaves of every tree: (conditions {feature: (low, high, z)}, values per class); ``expected`` per class."""

    leaves: list[list[tuple[dict[int, tuple[float, float, float]], list[float]]]]
    expected: list[float]


def forest_nodes(model: Model) -> DataFrame:
    """The nodes of a fitted forest as a table: tree, node, left, right, feature, threshold, stats (weight per class)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = work_folder(spark, "forest")
    model.stages[-1].write().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        n["split"]["numCategories"].alias("categories"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"), n["impurityStats"].alias("stats"))


def read_forest(model: Model, classes: int) -> Forest:
    """Conditions and values of all leaves.  The node table is as large as the model, which the driver holds anyway."""
    trees: dict[int, dict[int, object]] = {}
    for r in forest_nodes(model).collect():
        if r["left"] >= 0 and r["categories"] > 0:
            raise ValueError("splits on categories are not explained")
        trees.setdefault(r["tree"], {})[r["node"]] = r

    def share(stats: list[float]) -> list[float]:
        return [v / sum(stats) for v in stats[:classes]]

    leaves = []
    for _, nodes in sorted(trees.items()):
        own: list = []
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            at, held = stack.pop()
            r = nodes[at]
            if r["left"] < 0:
                own.append((held, share(r["stats"])))
                continue
            low, high, z = held.get(r["feature"], (-math.inf, math.inf, 1.0))
            whole = sum(r["stats"])
            stack.append((r["left"], {**held, r["feature"]: (low, min(high, r["threshold"]), z * sum(nodes[r["left"]]["stats"]) / whole)}))
            stack.append((r["right"], {**held, r["feature"]: (max(low, r["threshold"]), high, z * sum(nodes[r["right"]]["stats"]) / whole)}))
        leaves.append(own)
    roots = [share(nodes[0]["stats"]) for nodes in trees.values()]
    return Forest(leaves, [float(np.mean([r[c] for r in roots])) for c in range(classes)])


def leaf_weights(z: list[float]) -> np.ndarray:
    """Shapley values of the product game of one leaf with value 1, for every set of conditions held (row: bits, first feature lowest) and feature."""
    m = len(z)
    held = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    size = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
    out = np.zeros((1 << m, m))
    for f in range(m):
        sums = np.zeros((1 << m, m))  # by size of S: products over the others
        sums[:, 0] = 1
        for g in range(m):
            if g != f:
                taken = np.zeros_like(sums)
                taken[:, 1:] = sums[:, :-1] * held[:, g:g + 1]
                sums = sums * z[g] + taken
        out[:, f] = (held[:, f] - z[f]) * (sums @ size)
    return out


@dataclass
class _Tree:
    """One tree as arrays: its distinct conditions, and an entry for each condition of each leaf, entries in order of their features."""

    conditions: tuple[np.ndarray, np.ndarray, np.ndarray]   # feature, low, high
    powers: np.ndarray    # conditions x leaves: the bit of a condition in a leaf's mask
    leaf: np.ndarray      # by entry: its leaf
    first: np.ndarray     # by entry: where its weight for mask 0 stands in ``weights``
    step: np.ndarray      # by entry: distance to its weight for the next mask
    weights: np.ndarray
    values: np.ndarray    # entries x classes
    ranges: list[tuple[int, int, int]]   # place of a feature among the used ones, first entry, end


def _trees(forest: Forest, used: list[int]) -> list[_Tree]:
    place, out = {f: i for i, f in enumerate(used)}, []
    for own in forest.leaves:
        leaves = [(sorted(held), held, values) for held, values in own if held]
        if not leaves:
            continue
        numbers = {c: i for i, c in enumerate(sorted({(f, *held[f][:2]) for _, held, _ in leaves for f in held}))}
        powers, tables, entries, at = np.zeros((len(numbers), len(leaves))), [], [], 0
        for i, (fs, held, values) in enumerate(leaves):
            w = leaf_weights([held[f][2] for f in fs]).ravel()
            for j, f in enumerate(fs):
                powers[numbers[(f, *held[f][:2])], i] = 1 << j
                entries.append((place[f], i, at + j, len(fs), values))
            tables.append(w)
            at += len(w)
        entries.sort(key=lambda e: e[0])
        of = np.array([e[0] for e in entries])
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        f, low, high = zip(*numbers)
        out.append(_Tree((np.array(f), np.array(low), np.array(high)), powers, *(np.array([e[k] for e in entries]) for k in (1, 2, 3)), np.concatenate(tables),
                         np.array([e[4] for e in entries], dtype=float), [(int(of[x]), x, y) for x, y in zip(cuts, cuts[1:])]))
    return out


def _values(trees: list[_Tree], x: np.ndarray, used: int, classes: int, count: int) -> np.ndarray:
    """Rows x used features x classes."""
    out = np.zeros((len(x), used, classes))
    for t in trees:
        f, low, high = t.conditions
        v = x[:, f]
        masks = (((v > low) & (v <= high)).astype(float) @ t.powers).astype(np.int64)
        w = t.weights[masks[:, t.leaf] * t.step + t.first]
        for f, a, b in t.ranges:
            out[:, f] += w[:, a:b] @ t.values[a:b]
    return out / count


def _sums(df: DataFrame, forest: Forest, classes: int, names: list[str], key: str, of_class: Column | None = None) -> tuple[DataFrame, list[int]]:
    """(key, ``_phi``: flat, by used feature and class, or by used feature for the class numbered ``of_class``), and the used features.

    Rows are dealt and sorted by key and summed as they come, so a key has one row however often it occurs, and no task holds more than a batch.
    """
    used = sorted({f for own in forest.leaves for held, _ in own for f in held})
    trees, count = _trees(forest, used), len(forest.leaves)
    one, wide = of_class is not None, len(used) * (classes if of_class is None else 1)
    rows = df.select(F.col(key), _features(names).alias("_x"), (F.lit(0) if of_class is None else of_class).cast("int").alias("_class"))

    def phis(b: pa.RecordBatch) -> np.ndarray:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(names))
        phi = _values(trees, x, len(used), classes, count)
        return phi[np.arange(b.num_rows), :, b.column(2).to_numpy()] if one else phi.reshape(b.num_rows, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[list, np.ndarray] | None = None   # the key that may go on, its sum so far
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                phi, keys = phis(b), b.column(0).to_pylist()
                begins = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
                phi, keys = np.add.reduceat(phi, begins) if len(begins) < len(keys) else phi, [keys[i] for i in begins]
                if last is not None and last[0][0] == keys[0]:
                    phi[0] += last[1]
                elif last is not None:
                    keys, phi = [*last[0], *keys], np.vstack([last[1], phi])
                last = [keys[-1]], phi[-1].copy()
                if len(keys) > 1:
                    yield out(keys[:-1], phi[:-1], b.schema.field(0).type)
        if last is not None:
            yield out(last[0], last[1].reshape(1, wide), b.schema.field(0).type)

    def out(keys: list, phi: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        ends = np.arange(len(keys) + 1, dtype=np.int32) * wide
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.ListArray.from_arrays(pa.array(ends), pa.array(phi.ravel()))], [key, "_phi"])

    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("_phi", T.ArrayType(T.DoubleType()))])
    return rows.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema), used


def _features(names: list[str]) -> Column:
    def finite(n: str) -> Column:
        x = F.col(n).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.array(*[finite(n) for n in names])


def attribute(df: DataFrame, forest: Forest, classes: list, names: list[str], key: str = "session_id") -> DataFrame:
    """Long form: (key, class, feature, phi) of every class and every feature that the forest uses.  The rows of a repeated key are added up."""
    sums, used = _sums(df, forest, len(classes), names, key)
    at, n = F.col("_at"), len(classes)
    feature = F.get(F.array(*[F.lit(names[f]) for f in used]).cast("array<string>"), (at / n).cast("int"))
    return sums.select(key, F.posexplode("_phi").alias("_at", "phi")).select(key, F.get(F.array(*[F.lit(c) for c in classes]), at % n).alias("class"), feature.alias("feature"), "phi")


def attribute_predicted(df: DataFrame, forest: Forest, classes: list, names: list[str], predicted: str = "predicted_label", key: str = "session_id") -> DataFrame:
    """``phi`` and ``x`` arrays for the predicted class only (unknown class: the first), as for linear scores."""
    number = F.create_map(*[v for i, c in enumerate(classes) for v in (F.lit(c), F.lit(i))])
    sums, used = _sums(df, forest, len(classes), names, key, F.coalesce(number[F.col(predicted)], F.lit(0)))
    place = {f: i for i, f in enumerate(used)}
    phi = F.array(*[F.get("_phi", F.lit(place[f])) if f in place else F.lit(0.0) for f in range(len(names))])
    return df.join(sums, key, "left").withColumn("phi", F.when(F.col("_phi").isNull(), F.array_repeat(F.lit(0.0), len(names))).otherwise(phi)).withColumn(
        "x", F.array(*[F.col(n).cast("double") for n in names])).drop("_phi")


def explain_model(df: DataFrame, model: Model, names: list[str] | None = None, predicted: str = "predicted_label", key: str = "session_id") -> DataFrame:
    """``phi`` and ``x`` of predictions by either kind of classifier."""
    from tidewatch.operators import classify, explain

    names = names or dims.MODEL_FEATURES
    if hasattr(model.stages[-1], "trees"):
        classes = classify.class_names(model)
        return attribute_predicted(df, read_forest(model, len(classes)), classes, names, predicted, key)
    classes, weights = explain.linear_weights(model)
    return explain.attribute_predicted(df, classes, weights, names, explain.feature_means(df, names), predicted)
