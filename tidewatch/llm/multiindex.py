"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, each with its own k-means centroids (fitted on a bounded sample); a vector's cell is its pair of nearest centroids.  A query
walks the pairs in the order of the summed squared distances with a heap, until their cells hold the wanted number of vectors, and the vectors there are ranked by
their exact Euclidean distance in double precision.  That number follows the table: a fixed-size set of the queries is compared with all entries, block by block, and
the walk is made as long as it takes to reach ``RECALL`` of their true neighbours, and ``CANDIDATES`` at least.

Equal vectors are one entry with their smallest ids (one more than neighbours asked for), so a vector that very many rows share costs one comparison.
Neighbouring cells share a shelf of bounded size, where a query's nearest entries of all its cells are found at once; a cell that is larger is dealt over
parts, and the queries that visit a shelf over teams.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than the most frequent.  Ties go to the smaller id.
Rows that repeat an id and vector are one; an id with several vectors is found by each of them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .common import mix, stored

#: Vectors the centroids are fitted on at most (smallest id hashes), entries in a cell aimed at, centroids of a half at most.
SAMPLE, CELL, CENTROIDS = 20_000, 48, 1_024
#: Entries that a query looks at, at least (whole cells).
CANDIDATES = 26_000
#: The recall that the walks' length is measured for (0.9 is wanted; the rest is a margin for the sample), and queries it is measured with at most (smallest hashes).
RECALL, PROBES = 0.94, 256
BLOCK = 4_096
ROUNDS = 12


def kmeans(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from distinct random rows; an empty centroid moves to the row farthest from its own."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        d = _squares(x, c)
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for i in np.flatnonzero(n == 0):
            c[i] = x[d.min(1).argmax()]
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ c.T + (c ** 2).sum(1), 0)


def teams(ids: list[int], split: int) -> list[int]:
    """The team of each query, by a hash: ids asked for often have a divisor in common."""
    return (mix(np.array(ids, dtype=np.int64).view(np.uint64)) % np.uint64(split)).tolist()


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells (i * number of second centroids + j) in the order of first[i] + second[j], until they hold ``want`` entries or all are seen.

    ``first`` and ``second``: a query's squared distances to the centroids of either half.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def shelves(counts: np.ndarray) -> np.ndarray:
    """A shelf for each cell: neighbouring cells with about BLOCK entries together; cells of more than BLOCK entries stand alone."""
    out, shelf, held = np.zeros(len(counts), dtype=np.int64), 0, 0
    for c, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK:
            shelf, held = shelf + 1, 0
        out[c], held = shelf, held + n
    return out


def vectors(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(id, size, raw): valid vectors as little-endian doubles."""
    v = F.col(column).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.array(x, dtype="<f8") + 0.0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "size", "raw"])

    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(ok).mapInArrow(run, "id long, size int, raw binary")


def needed(index: DataFrame, probes: list[tuple[int, bytes]], books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, neighbours: int, recall: float) -> int:
    """Entries that a walk must want so that it comes to ``recall`` of the probes' true neighbours.

    Each task keeps the nearest entries of every probe; a neighbour at cell c is found by a walk that wants more entries than the cells before c hold.  One
    number for each probe and neighbour reaches the driver.
    """
    spark = index.sparkSession
    asked, top = np.stack([np.frombuffer(raw, "<f8") for _, raw in probes]), neighbours + 1
    half = books[0].shape[1]
    sent = spark.sparkContext.broadcast((asked, [q for q, _ in probes], books, counts))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value[0]
        best, cells, ids = np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int32), np.zeros((len(x), 0), object)
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                part = b.slice(lo, BLOCK)
                n, own = len(part), np.frombuffer(b"".join(part.column(0).to_pylist()), "<f8").reshape(-1, x.shape[1])
                names = np.empty(n, object)
                names[:] = part.column(1).to_pylist()
                best = np.concatenate([best, _squares(x, own)], axis=1)
                cells, ids = (np.concatenate([old, np.broadcast_to(new, (len(x), n))], axis=1) for old, new in ((cells, part.column(2).to_numpy()), (ids, names)))
                if best.shape[1] > top:
                    at = np.argpartition(best, top - 1, axis=1)[:, :top]
                    best, cells, ids = (np.take_along_axis(y, at, axis=1) for y in (best, cells, ids))
        out = [(i, v, d, c) for i, q in enumerate(sent.value[1]) for d, c, own in zip(best[i].tolist(), cells[i].tolist(), ids[i]) for v in own if v != q]
        yield pa.RecordBatch.from_pylist([dict(zip(("probe", "vec_id", "score", "cell"), o)) for o in out],
                                         pa.schema([("probe", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()), ("cell", pa.int32())]))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, _, (one, two), n = sent.value
        for b in batches:
            want = []
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums = (_squares(x[i:i + 1, :half], one)[0][:, None] + _squares(x[i:i + 1, half:], two)[0]).ravel()
                want.append(int(n[sums <= sums[c]].sum() - n[c]) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(want, pa.int64())], ["want"])

    found = index.select("raw", "ids", "cell").mapInArrow(nearest, "probe int, vec_id long, score double, cell int")
    once = found.groupBy("probe", "vec_id").agg(F.min(F.struct("score", "cell")).alias("m")).select("probe", "vec_id", "m.*")
    best = Window.partitionBy("probe").orderBy("score", "vec_id")
    true = once.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= neighbours)
    wants = sorted(r["want"] for r in true.select("probe", "cell").mapInArrow(held, "want long").collect())
    return wants[math.ceil(recall * len(wants)) - 1] if wants else 1


def search(rows: DataFrame, queries: DataFrame, neighbours: int = 10, candidates: int = CANDIDATES, key: str = "vec_id", column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest ``neighbours`` of each query among all other rows.  ``queries``: rows of the same columns.

    A walk wants ``candidates`` entries, or as many more as a sample of the queries needs for ``recall``.
    """
    spark = rows.sparkSession
    every = stored(vectors(rows, key, column), "vectors")
    asked = vectors(queries, key, column)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = every.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return empty
    width = common["size"]
    every, asked = every.filter(F.col("size") == width), asked.filter(F.col("size") == width)
    own = Window.partitionBy("raw").orderBy("id")
    few = every.select("id", "raw").distinct().withColumn("r", F.row_number().over(own)).filter(F.col("r") <= neighbours + 1)
    entries = stored(few.groupBy("raw").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    total = entries.count()
    sample = np.stack([np.frombuffer(r["raw"], "<f8") for r in entries.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).collect()])
    half = max(1, width // 2)
    k = max(1, min(CENTROIDS, math.ceil(math.sqrt(total / CELL))))
    books = kmeans(sample[:, :half], k), kmeans(sample[:, half:], k) if width > half else np.zeros((1, 0))
    sent = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sent.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<f8").reshape(-1, width)
            cell = _squares(x[:, :half], one).argmin(1) * len(two) + _squares(x[:, half:], two).argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], ["raw", "ids", "cell"])

    index = stored(entries.select("raw", "ids").mapInArrow(place, "raw binary, ids array<long>, cell int"), "index")
    counts = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    if candidates < total:
        probes = asked.select("id", "raw").distinct().orderBy(F.xxhash64("id", "raw"), "id", "raw").limit(PROBES).collect()
        candidates = max(candidates, needed(index, [(r["id"], r["raw"]) for r in probes], books, counts, neighbours, recall)) if probes else candidates
    blocks = spark.sparkContext.broadcast((counts, -(-counts // BLOCK), shelves(counts)))
    split = max(1, math.ceil(asked.count() * min(1, candidates / total) / BLOCK))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sent.value
        held, parts, shelf = blocks.value
        for b in batches:
            raws = b.column(1).to_pylist()
            x = np.frombuffer(b"".join(raws), "<f8").reshape(-1, width)
            first, second = (_squares(x[:, :half], one), _squares(x[:, half:], two)) if len(x) else ((), ())
            ids = b.column(0).to_pylist()
            for i, (q, raw, own) in enumerate(zip(ids, raws, teams(ids, split))):
                on: dict[tuple[int, int], list[int]] = {}
                for c in walk(first[i], second[i], held, candidates):
                    for p in range(parts[c]):
                        on.setdefault((int(shelf[c]), p), []).append(c)
                n = len(on)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in on], pa.int32()), pa.array([p for _, p in on], pa.int32()), pa.array([own] * n, pa.int32()),
                                                  pa.array([q] * n, pa.int64()), pa.array([raw] * n, pa.binary()), pa.array(list(on.values()), pa.list_(pa.int32()))],
                                                 ["shelf", "part", "team", "query_id", "raw", "cells"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts, shelf = blocks.value
        for b in batches:
            cell, h = b.column(2).to_numpy(), b.column(3).to_numpy()
            part = (h & 0x7FFFFFFF) % parts[cell]
            n, team = len(cell), np.tile(np.arange(split), len(cell))
            back = pa.array(np.repeat(np.arange(n), split))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shelf[cell], split), pa.int32()), pa.array(np.repeat(part, split), pa.int32()), pa.array(team, pa.int32()),
                                              b.column(0).take(back), b.column(1).take(back), b.column(2).take(back)], ["shelf", "part", "team", "raw", "ids", "cell"])

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            every, ids, cell = np.frombuffer(b"".join(right["raw"]), "<f8").reshape(-1, width), right["ids"].to_numpy(), right["cell"].to_numpy()
            for q, raw, cells in zip(left["query_id"], left["raw"], left["cells"]):
                mine = np.flatnonzero(np.isin(cell, cells))
                d = np.sqrt(((every[mine] - np.frombuffer(raw, "<f8")) ** 2).sum(1))
                top = neighbours + 1
                while True:
                    near = np.flatnonzero(d <= np.partition(d, top - 1)[top - 1]) if len(d) > top else range(len(d))
                    once: dict[int, float] = {}
                    for s, x in sorted((d[i], x) for i in near for x in ids[mine[i]] if x != q):
                        once.setdefault(x, s)
                    if len(once) >= neighbours or len(near) == len(d):
                        break
                    top *= 4  # the nearest entries belong to too few ids
                out += [(q, x, s) for x, s in list(once.items())[:neighbours]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    placed = index.select("raw", "ids", "cell", F.xxhash64("raw").alias("h")).mapInArrow(deal, "shelf int, part int, team int, raw binary, ids array<long>, cell int")
    visited = asked.select("id", "raw").distinct().mapInArrow(visits, "shelf int, part int, team int, query_id long, raw binary, cells array<int>")
    by = ["shelf", "part", "team"]
    found = visited.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def digest(rows: DataFrame) -> DataFrame:
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0))
