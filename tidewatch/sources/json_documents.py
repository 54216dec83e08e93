"""Large JSON documents, read in parallel.

A document is cut at every ``}`` by the splittable text reader, so the pieces of one file come from many tasks, a split of the file to each, in order.  Whether
such a brace stands inside a string, and how deep it is, follows from running sums of quotes and braces over the pieces of
the file; a brace that brings the depth back to zero ends a record.

The text itself is never shuffled.  One pass over the file sums up each split, for both ways it may begin (in a string or not); running sums over these few
rows tell how each split begins.  A second pass takes the text before the first and after the last end of each split, which neighbours complete; a
third joins the pieces of all other records where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.lineage import checkpointed

PIECES = 500_000


def _signs(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By piece: whether an odd number of quotes stands up to its end, and how it changes the depth if the first piece begins outside, or inside a string."""
    values, n = values.cast(pa.large_string()), len(values)
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + n + 1]
    text = values.buffers()[2]
    data = np.frombuffer(text, np.uint8)[off[0]:off[-1]] if text is not None and len(text) else np.zeros(0, np.uint8)
    off = off - off[0]

    def piece(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(off, at, "right") - 1

    quote, brace, slash = data == ord('"'), data == ord("{"), np.flatnonzero(data == ord("\\"))
    if len(slash):   # after an odd run of backslashes a sign counts for nothing
        of = piece(slash)
        begin = np.flatnonzero(np.r_[True, (np.diff(slash) != 1) | (np.diff(of) != 0)])
        end = np.r_[begin[1:], len(slash)] - 1
        odd = end[(end - begin) % 2 == 0]
        after, of = slash[odd] + 1, of[odd]
        after = after[after < off[of + 1]]
        quote[after] = brace[after] = False
    quotes, braces = np.flatnonzero(quote), np.flatnonzero(brace)
    odd = np.cumsum(np.bincount(piece(quotes), minlength=n)) % 2
    inside, of = np.searchsorted(quotes, braces) % 2, piece(braces)
    return odd, np.bincount(of[inside == 0], minlength=n) - (odd == 0), np.bincount(of[inside == 1], minlength=n) - (odd == 1)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of batches that belong to one split of a file, with its name and place."""
    for b in batches:
        if b.num_rows:
            of = b.column("_of").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                yield (b.column("file")[x].as_py(), b.column("block")[x].as_py()), b.slice(x, y - x)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each split changes parity of quotes and depth."""
    last, odd, plain, quoted = None, 0, 0, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*last, odd, plain, quoted), (pa.string(), *[pa.int64()] * 4))], ["file", "block", "quotes", "plain", "quoted"])

    for split, b in _splits(batches):
        if split != last:
            if last is not None:
                yield out()
            last, odd, plain, quoted = split, 0, 0, 0
        ends, step, other = _signs(b.column("value"))
        if odd:
            step, other = other, step
        odd, plain, quoted = int(odd ^ ends[-1]), plain + int(step.sum()), quoted + int(other.sum())
    if last is not None:
        yield out()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], str | None]]:
    """(split, texts that end in this batch, text left open at the end of the split, if it is its end)."""
    last, odd, depth, held = None, 0, 0, []
    for split, b in _splits(batches):
        if split != last:
            if last is not None:
                yield last, [], "".join(held)
            last, odd, depth, held = split, b.column("odd")[0].as_py(), b.column("depth")[0].as_py(), []
        ends, plain, quoted = _signs(b.column("value"))
        depths = depth + np.cumsum(quoted if odd else plain)
        at = np.flatnonzero((ends == odd) & (depths <= 0)).tolist()
        odd, depth = int(odd ^ ends[-1]), int(depths[-1])
        values, begin, texts = b.column("value").to_pylist(), 0, []
        for i in at:
            texts.append("}".join(values[begin:i + 1]) + "}")
            begin = i + 1
        if texts:
            texts[0], held = "".join([*held, texts[0]]), []
        held += [f"{v}}}" for v in values[begin:]]
        yield split, texts, None
    if last is not None:
        yield last, [], "".join(held)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: how many records end in it, the text up to the first end and after the last."""
    count, head = 0, None
    for split, texts, tail in _records(batches):
        if texts and not count:
            head = texts[0]
        count += len(texts)
        if tail is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*split, count, head, tail), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             ["file", "block", "ends", "head", "tail"])
            count, head = 0, None


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split after the first that ends there, numbered within the split."""
    count = 0
    for split, texts, tail in _records(batches):
        own = texts[0 if count else 1:]
        first, count = max(count, 1), count + len(texts)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([split[0]] * len(own), pa.string()), pa.array([split[1]] * len(own), pa.int64()),
                                              pa.array(range(first, count), pa.int64()), pa.array(own, pa.string())], ["file", "block", "number", "record"])
        if tail is not None:
            count = 0


def json_records(spark: SparkSession, path: str, min_rows: int = PIECES) -> DataFrame:
    """The outermost objects of JSON documents as text: columns ``file``, ``number`` (of the record, from 0) and ``record``.

    A document is an array of objects, one object, or objects one after another; commas, brackets and white space
    between them are left out, an object that never closes is no record.  ``min_rows`` is kept for callers; no window takes the pieces of a file any more.
    """
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    piece = spark.read.option("lineSep", "}").text(path).select(file.alias("file"), block.alias("block"), F.xxhash64(file, block).alias("_of"), "value")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)   # a row for each split
    none = F.lit(0)
    start = piece.mapInArrow(_sums, "file string, block long, quotes long, plain long, quoted long").withColumn("odd", F.coalesce(F.sum("quotes").over(before), none) % 2)
    start = start.withColumn("depth", F.coalesce(F.sum(F.when(F.col("odd") == 1, F.col("quoted")).otherwise(F.col("plain"))).over(before), none))
    placed = piece.join(F.broadcast(checkpointed(start.select("file", "block", "odd", "depth"))), ["file", "block"])
    edge = checkpointed(placed.mapInArrow(_edges, "file string, block long, ends long, head string, tail string").withColumn("first", F.coalesce(F.sum("ends").over(before), none)))
    inner = (placed.mapInArrow(_inner, "file string, block long, number long, record string").join(F.broadcast(edge.select("file", "block", "first")), ["file", "block"])
             .select("file", (F.col("first") + F.col("number")).alias("number"), "record"))
    parts = edge.select("file", "block", F.explode(F.array(F.struct(F.col("first").alias("number"), F.col("head").alias("text"), F.lit(True).alias("ends")),
                                                           F.struct((F.col("first") + F.col("ends")).alias("number"), F.col("tail").alias("text"), F.lit(False).alias("ends")))).alias("p"))
    across = (parts.select("file", "block", "p.*").where("text IS NOT NULL").groupBy("file", "number")
              .agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"), F.max("ends").alias("whole")).where("whole")
              .select("file", "number", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("record")))
    bare = F.regexp_replace("record", r"^[\s\[\],﻿]+", "")
    return inner.unionByName(across).select("file", "number", bare.alias("record")).where(F.startswith("record", F.lit("{")))


def read_json_documents(spark: SparkSession, path: str, columns: list[str] | None = None, min_rows: int = PIECES) -> DataFrame:
    """Records of large JSON documents with text columns; nested values stay JSON text, a malformed record is a row of NULLs.

    ``columns`` spares the pass that collects the names found in any record (sorted).
    """
    fields = json_records(spark, path, min_rows).select(F.from_json("record", "map<string,string>").alias("m"))
    if columns is None:
        columns = sorted(r["k"] for r in fields.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect())   # the names of columns
    return fields.select(*[F.try_element_at("m", F.lit(c)).alias(c) for c in columns])


def write_json_documents(df: DataFrame, path: str) -> None:
    """One JSON array for each partition, a record to a line; NULL fields are kept as ``null``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([f"{lead if i == 0 else ','}{r}" for i, r in enumerate(b.column(0).to_pylist())], pa.string())], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"], pa.string())], ["value"])

    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(text.alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)
