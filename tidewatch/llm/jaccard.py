"""Exact Jaccard join of documents on word n-grams, size-aware.

A document is the set of its distinct word n-grams (hashed to 64 bits).  Two documents link when their sets' intersection is at least the given
percentage of the union.  Documents with equal sets are one class; only classes are compared, and copies are never expanded.

All n-grams are ordered by a corpus-wide count (a counter array of fixed size, summed over every document), rare ones first.  Linked sets of n
n-grams share at least ceil(t n), so they share at least k of the first n - ceil(t n) + k.

* Small (light) sets list all 2-subsets of that prefix with k = 2; two small sets that link have a subset in common.
* Large (heavy) sets scan the inverted lists of single n-grams of the prefix with k = 1; the lists hold all sets large enough to link with one.
* The boundary is the size for which the estimated cost (subsets listed, against entries scanned) is least, over the sizes of all documents.

Sets of about one size under one key are first compared with the smallest class only, and components are formed.  Then, wherever a key still
holds several components, every pair across components whose sizes and places allow a link is compared.  Keys that very many classes share (a
large group of near copies around the threshold) list no pairs: their classes are dealt over tiles, and whole sets meet tile by tile.  No link between components is
missed, and no group's pairs are listed.

Null and empty texts, and texts without words, have no n-grams and link with nothing.  Repeated rows are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import CELLS, M64, MIX, byte_hashes, cells, components, enter, give_back, in_cells, long_batches, merged, mix, shingle_hashes, stored, word_spans

#: Counters of the n-gram order: a fixed array whatever the corpus; it decides the order only, never a result.
COUNTERS, BLOCK = 1 << 21, 1 << 15
#: Sets of this size and more are always heavy (their subsets would be too many).
LARGEST_LIGHT = 256
#: Keys of more classes than DENSE are compared in blocks of about TILE sets.
DENSE, TILE = 128, 384
_SLICE = 1 << 19
#: Buckets of the histogram of a set's hashes, and hashes that a task gathers before it counts them.
BUCKETS, GATHERED = 64, 1 << 21


def shingle_sets(texts: pa.Array, width: int, lower: bool) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; of fewer than ``width`` words the whole sequence is one n-gram."""
    data, start, end, bound = word_spans(texts, lower)
    words = byte_hashes(data, start, end)
    every = shingle_hashes(words, width)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a >= width:
            x = np.sort(every[a:b - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(shingle_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def _class(x: np.ndarray) -> int | None:
    """An id of a set by its elements (64 bits); null for the empty set."""
    return int(mix(np.array([int(mix(x).sum()) + len(x) * MIX[0] & M64], dtype=np.uint64)).view(np.int64)[0]) if len(x) else None


def _slices(batches: Iterator[pa.RecordBatch], width: int, lower: bool) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    enter("hashes")
    for whole in batches:
        for b in long_batches(whole, "text", _SLICE):
            yield b, shingle_sets(b.column(1), width, lower)
    give_back()


def signatures(docs: DataFrame, width: int, lower: bool, key: str, text: str) -> DataFrame:
    """Stored: (key, n, class, histogram) of each document, and rows with only ``block`` and ``counts``: each task's counters.

    histogram: how many of the set's hashes fall into each of BUCKETS equal ranges.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "class", "histogram", "block", "counts"]
        counts, waiting, held = np.zeros(COUNTERS, dtype=np.uint32), [], 0

        def count() -> None:
            if waiting:
                cell, n = np.unique(np.concatenate(waiting), return_counts=True)
                counts[cell] += n.astype(np.uint32)
                waiting.clear()

        for b, sets in _slices(batches, width, lower):
            for x in sets:
                waiting.append((x & np.uint64(COUNTERS - 1)).astype(np.int32))
                held += len(x)
            if held > GATHERED:
                count()
                held = 0
            n = len(sets)
            shape = [np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=BUCKETS).astype("<u4").tobytes() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_class(x) for x in sets], pa.int64()), pa.array(shape, pa.binary()),
                                              pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        count()
        for k in range(COUNTERS // BLOCK):
            own = counts[k * BLOCK:(k + 1) * BLOCK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()),
                                                  pa.array([np.minimum(own, 0xFFFF).astype("<u2").tobytes()], pa.binary())], names)

    return stored(_narrow(docs, key, text).mapInArrow(run, "key long, n long, class long, histogram binary, block int, counts binary"), "signatures")


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def least_shared(n, percent: int):
    """ceil(percent / 100 * n), in whole numbers."""
    return -(-percent * n // 100)


def boundary(sizes: dict[int, int], scan: float, percent: int, largest: int = LARGEST_LIGHT) -> int:
    """Sets smaller than this are light.  ``sizes``: number of sets of each size below ``largest``; ``scan``: entries read for each entry listed."""
    def light(n: int) -> float:
        p = n - least_shared(n, percent) + 2
        return p * (p - 1) / 2

    def heavy(n: int) -> float:
        return (n - least_shared(n, percent) + 1) * scan

    # sets from `largest` on cost the same for every boundary up to it, but for the lists of their smaller partners
    def cost(x: int) -> float:
        return sum(c * (light(n) if n < x else 0.0) + c * (heavy(n) if n >= least_shared(x, percent) else 0.0) for n, c in sizes.items())

    return min(range(1, largest + 1), key=lambda x: (cost(x), x))


def postings(docs: DataFrame, counts: np.ndarray, edge: int, percent: int, width: int, lower: bool, key: str, text: str) -> DataFrame:
    """Stored (k, class, n, i): the keys of each class, once in each task: 2-subsets for light sets, single n-grams for the inverted lists.

    i: the place of the (first) n-gram in the order of its set.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 0xFFFF).astype(np.uint16))
    partner = least_shared(edge, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = sent.value, set()
        for b, sets in _slices(batches, width, lower):
            keys, owners, sizes, places = [], [], [], []
            for x in sets:
                own = _class(x)
                if own is None or own in seen:
                    continue
                seen.add(own)
                n = len(x)
                rank = order[(x & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | x >> np.uint64(16)
                p = n - least_shared(n, percent)
                first = np.sort(np.partition(rank, p + 1)[:p + 2]) if n > p + 2 else np.sort(rank)
                found, at = [], []
                if n < edge:
                    i, j = np.triu_indices(len(first), 1)
                    found.append(mix(first[i] * np.uint64(MIX[2]) + first[j]))
                    at.append(i)
                if n >= partner:
                    found.append(mix(first[:p + 1]))
                    at.append(np.arange(len(found[-1])))
                got = np.concatenate(found)
                places.append(np.concatenate(at))
                keys.append(got)
                owners.append(np.full(len(got), own, dtype=np.int64))
                sizes.append(np.full(len(got), n, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes), pa.int32()),
                                                  pa.array(np.concatenate(places), pa.int32())], ["k", "class", "n", "i"])

    return stored(_narrow(docs, key, text).mapInArrow(run, "k long, class long, n int, i int"), "postings")


def _shared(posted: DataFrame) -> DataFrame:
    """The postings under keys of two classes or more, one for each key and class.  A bitmap of fixed size keeps most others out of the shuffle."""
    keys = stored(posted.groupBy("k").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("k"), "keys")
    sent = posted.sparkSession.sparkContext.broadcast(cells(keys, "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.filter(pa.array(in_cells(sent.value, b.column(4).to_numpy())))
            yield pa.RecordBatch.from_arrays(kept.columns[:4], kept.schema.names[:4])

    cell = F.pmod(F.xxhash64("k"), F.lit(CELLS)).alias("cell")
    passed = posted.select("k", "class", "n", "i", cell).mapInArrow(run, "k long, class long, n int, i int")
    return passed.join(keys, "k", "left_semi").groupBy("k", "class").agg(F.min("n").alias("n"), F.min("i").alias("i"))


def _possible(percent: int):
    """Sizes n and m that can link, when the first n-gram that both sets have stands at i in one and at j in the other.

    Where it is not the first, the pair meets under the first as well; so this drops no link.
    """
    need = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent) - 1e-9)
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("n") - F.col("i") >= need) & (F.col("m") - F.col("j") >= need)


def _sets(docs: DataFrame, involved: DataFrame, width: int, lower: bool, key: str, text: str) -> DataFrame:
    """(class, members) of the documents ``involved`` (key, class): only texts whose key passes a bitmap of fixed size are read further and shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(cells(involved, "key"))
    cell = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(CELLS)).alias("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen():
            for b in batches:
                yield b.filter(pa.array(in_cells(sent.value, b.column(2).to_numpy())))

        for b, sets in _slices(chosen(), width, lower):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_class(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "class", "members"])

    got = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), cell).mapInArrow(run, "key long, class long, members binary")
    return got.join(involved, ["key", "class"], "left_semi").select("class", "members")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int, lower: bool, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes that link, by whole sets; the sets are made again for the classes in the pairs, from a document of each.

    Two sets share no more than the sum of the smaller counts of their histograms, bucket by bucket; pairs that can't reach the wanted overlap
    go before any set is made.
    """
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("")
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").reshape(-1, BUCKETS).astype(np.int64) for i in (2, 3))
            most = np.minimum(x, y).sum(1)
            keep = 100 * most >= percent * (x.sum(1) + y.sum(1) - most)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    shapes = classes.select("class", "histogram")
    met = pairs.join(shapes.select(F.col("class").alias("a"), F.col("histogram").alias("x")), "a").join(shapes.select(F.col("class").alias("b"), F.col("histogram").alias("y")), "b")
    pairs = stored(met.select("a", "b", "x", "y").mapInArrow(reach, "a long, b long"), "reachable")
    involved = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    involved = stored(classes.join(involved, "class", "left_semi").select("key", "class"), "involved")
    sets = stored(_sets(docs, involved, width, lower, key, text), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("class").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _tiled(dense: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int, lower: bool, key: str, text: str) -> DataFrame:
    """Links (a, b) within the groups of classes that dense keys connect: (k, class, component).

    A group's classes are dealt over tiles; every two tiles meet in one task, which returns only links that join components (a
    spanning forest at most).
    """
    low = dense.groupBy("k").agg(F.min("class").alias("low"))
    group = components(dense.join(low, "k").select(F.col("low").alias("a"), F.col("class").alias("b")).distinct())
    member = stored(dense.select("class", "component").distinct().join(group.select(F.col("node").alias("class"), F.col("component").alias("team")), "class"), "dense")
    tiles = member.groupBy("team").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    sets = _sets(docs, classes.join(member.select("class"), "class", "left_semi").select("key", "class"), width, lower, key, text).dropDuplicates(["class"])
    own = member.join(tiles, "team").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")).join(sets, "class")
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "team", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "class", "component", "members")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        enter("")
        x = [np.frombuffer(m, np.uint64) for m in part["members"]]
        ids, size, first = part["class"].to_numpy(), np.array([len(m) for m in x]), (part["tile"] == part["one"]).to_numpy()
        owner = np.repeat(np.arange(len(x)), size)
        column = np.unique(np.concatenate(x), return_inverse=True)[1] if len(x) else owner
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        same = np.zeros((len(x), len(x)), dtype=np.float32)
        at, width_ = 0, 4096
        while at < len(column):
            to = int(np.searchsorted(column, column[at] + width_))
            grid = np.zeros((len(x), width_), dtype=np.float32)
            grid[owner[at:to], column[at:to] - column[at]] = 1
            same += grid @ grid.T
            at = to
        same = same.round().astype(np.int64)
        linked = 100 * same >= percent * (size[:, None] + size[None, :] - same)
        parent = {c: c for c in part["component"]}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out, placed = [], part["component"].to_numpy()
        for i, j in np.argwhere(np.triu(linked, 1)):
            if part["one"].iat[0] != part["two"].iat[0] and first[i] == first[j]:
                continue
            r, t = root(placed[i]), root(placed[j])
            if r != t:
                parent[max(r, t)] = min(r, t)
                out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return met.groupBy("team", "one", "two").applyInPandas(compare, "a long, b long")


def join(docs: DataFrame, percent: int = 85, width: int = 4, lower: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_shingles (size of its set), component_id (smallest key reachable by links, its own included)."""
    signed = signatures(docs, width, lower, key, text)
    rows = signed.filter(F.col("block").isNull()).select("key", "n", "class", "histogram")
    counts = merged(signed.filter(F.col("block").isNotNull()), "block", "counts")
    if counts is None:
        return rows.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    shapes = rows.filter(F.col("class").isNotNull()).select("class", "histogram").dropDuplicates(["class"])
    classes = stored(rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("key").alias("key"), F.min("n").alias("n")).join(shapes, "class"), "classes")
    sizes = {r["n"]: r["count"] for r in classes.filter(F.col("n") < LARGEST_LIGHT).groupBy("n").count().collect()}
    rare = counts[counts <= np.quantile(counts, 0.9)].astype(np.float64)
    scan = max(2.0, 1 + float((rare ** 2).sum() / max(rare.sum(), 1) - rare.mean()))
    posted = postings(docs, counts, boundary(sizes, scan, percent), percent, width, lower, key, text)
    hits = stored(_shared(posted), "hits")
    # first against the smallest class of about the same size under each key
    bucket = F.floor(F.log("n") / math.log(100 / percent)).alias("bucket")
    sized = hits.select("*", bucket)
    lows = sized.groupBy("k", "bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("k", "bucket", "low")
    others = sized.join(lows, ["k", "bucket"])
    low = others.filter(F.col("class") == F.col("low")).select("k", "bucket", F.col("n").alias("m"), F.col("i").alias("j"))
    near = others.filter("class > low").join(low, ["k", "bucket"]).filter(_possible(percent)).select(F.col("low").alias("a"), F.col("class").alias("b")).distinct()
    near = stored(near, "near")
    links = stored(_verified(near, docs, classes, percent, width, lower, key, text), "links")
    label = components(links)
    # then, where a key still holds several components, all pairs across them
    placed = hits.join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = placed.groupBy("k").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("classes")).filter("x < y").select("k", "classes")
    placed = stored(placed.join(mixed, "k").select("k", "class", "n", "i", "component", "classes"), "mixed")
    dense = placed.filter(F.col("classes") > DENSE).select("k", "class", "component")
    if dense.limit(1).count():
        links = stored(links.unionByName(_tiled(dense, docs, classes, percent, width, lower, key, text)), "links")
    placed = placed.filter(F.col("classes") <= DENSE)
    other = placed.select("k", F.col("class").alias("second"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("component").alias("third"))
    across = placed.join(other, "k").filter((F.col("class") < F.col("second")) & (F.col("component") != F.col("third")) & _possible(percent))
    far = stored(across.select(F.col("class").alias("a"), F.col("second").alias("b")).distinct().join(near, ["a", "b"], "left_anti"), "far")
    more = stored(_verified(far, docs, classes, percent, width, lower, key, text), "links")
    label = components(links.unionByName(more))
    named = stored(rows.drop("histogram").join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "named")
    smallest = named.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("key").alias("component_id"))
    return named.join(smallest, "component", "left").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest id of their group (rows that repeat it are the same document and stay).  The columns of ``docs``."""
    key = options.get("key", "doc_id")
    found = join(docs, **options)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, key, "left_anti").select(*docs.columns)
