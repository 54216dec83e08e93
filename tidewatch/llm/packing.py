"""Packing token ids into sequences of fixed length, in document order.

All documents stand in a row, in ascending order of their key.  A cut may stand at a document's end (free), after a sentence (``SENTENCE``), or, where a sentence is
long, every ``2 * STEP`` ids in it (``ANYWHERE``).  The windows between neighbouring cuts are the sequences.  A window costs its padding: what it lacks to the full length, or
nothing where its length is a power of two from ``SHORTEST`` on; and ``SEQUENCE``, so that sequences are few.  The cuts minimise the sum:

    cost(j) = penalty(j) + SEQUENCE + min( min over i with p(j) - p(i) <= length of cost(i) + length - (p(j) - p(i)),  min over k of cost(i) with p(j) - p(i) = 2^k )

The first minimum is that of cost(i) + p(i) over a sliding window, kept in a monotone queue, so a transition takes constant time; the second looks at most at one i for each k.

The row is dealt to tasks as ranges of the key, one pass of the ids through a shuffle.  A task reads its range in order and solves it in blocks of about ``BLOCK`` ids
(memory, not result, is bounded by it: the last sequences of a block are left open and go on with the next one).  The last block of a range may have shorter
sequences too, down to one id, so that a range's end needs hardly any padding.
Sequences are numbered over all ranges from the ranges' totals, one row each.

Null texts count as empty (the end id only).  Rows that repeat a key stay, next to each other.  A null key stands first.  No rows give no pieces.  Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .common import enter, long_batches, partitions, stored
from .tokens import END_ID, SLICE, coder, encoded

LENGTH = 2048
#: Penalties of cuts, in ids of padding that they are worth, and ids between possible cuts in a document (sentence ends closer than that: the last of them).
SENTENCE, ANYWHERE, STEP = 4, 16, 8
#: The least power of two that a sequence is cut to for want of padding.
SHORTEST = 256
#: What each sequence costs beside its padding, so that there are few.
SEQUENCE = 8
#: Ids solved at once.
BLOCK = 1 << 20
#: Characters one of which ends a sentence, in a token without letters or digits.
STOPS = ".!?。！？…"


def stop_ids(path: str) -> np.ndarray:
    """For each id of the vocabulary, whether its token ends a sentence."""
    t = coder(path).tokenizer
    out = np.zeros(t.get_vocab_size(), dtype=bool)
    plain = {"".join(x for x, _ in t.pre_tokenizer.pre_tokenize_str(c)): c for c in STOPS} if t.pre_tokenizer else {c: c for c in STOPS}
    for token, i in t.get_vocab().items():
        token = token.removesuffix("</w>")
        out[i] = any(c in token for c in plain) and not any(c.isascii() and c.isalnum() for c in token) and not token.startswith("<|")
    return out


def possible_cuts(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places where a row of documents may be cut and their penalties; ``ends`` are the documents' ends.  The first place is 0, the last one the end of the row."""
    sentence = np.flatnonzero(stops[ids]) + 1
    cell = sentence // step
    sentence = sentence[np.append(cell[1:] != cell[:-1], True)] if len(sentence) else sentence
    fixed = np.union1d(np.append(ends, 0), sentence)
    more = (np.diff(fixed) - 1) // (2 * step)
    extra = np.repeat(fixed[:-1], more) + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1) * (2 * step)
    at = np.union1d(fixed, extra)
    penalty = np.full(len(at), ANYWHERE, dtype=np.int64)
    penalty[np.searchsorted(at, sentence)] = SENTENCE
    penalty[np.searchsorted(at, np.append(ends, 0))] = 0
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH, shortest: int = SHORTEST) -> tuple[list[int], int]:
    """Indices of the chosen cuts (the first and last place among them) and their cost.  ``at``: ascending places, neighbours at most ``length`` apart."""
    m = len(at)
    hits: dict[int, list[int]] = {}
    size = shortest
    while size < length:
        i = np.minimum(np.searchsorted(at, at - size), m - 1)
        there = np.flatnonzero(at[i] == at - size)
        for j, k in zip(there.tolist(), i[there].tolist()):
            hits.setdefault(j, []).append(k)
        size *= 2
    place = at.tolist()
    cost, parent = [0] * m, [0] * m
    queue, level = deque([0]), deque([place[0]])  # level: cost + place
    front, head = level[0], 0
    for j, (p, extra) in enumerate(zip(place, (penalty + SEQUENCE).tolist())):
        if not j:
            continue
        while place[head] < p - length:
            queue.popleft()
            level.popleft()
            head, front = queue[0], level[0]
        best, i = front + length - p, head
        if j in hits:
            for k in hits[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        best += extra
        cost[j], parent[j] = best, i
        x = best + p
        while level and level[-1] >= x:
            level.pop()
            queue.pop()
        if not level:
            head, front = j, x
        level.append(x)
        queue.append(j)
    chosen, j = [m - 1], m - 1
    while j:
        j = parent[j]
        chosen.append(j)
    return chosen[::-1], cost[-1]


class _Row:
    """Documents of one range in a row, solved block by block."""

    def __init__(self, stops: np.ndarray, length: int):
        self.stops, self.length = stops, length
        self.key: list = []
        self.total: list[int] = []  # ids of the whole document
        self.begin: list[int] = []  # of these ids, where the part that is still open begins
        self.ids: list[np.ndarray] = []
        self.open = self.sequence = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.key.append(key)
        self.total.append(len(ids))
        self.begin.append(0)
        self.ids.append(ids)
        self.open += len(ids)

    def solve(self, last: bool) -> dict[str, list]:
        """Pieces of the closed sequences.  Unless it is the last block, the last two sequences stay open."""
        out: dict[str, list] = {k: [] for k in ("key", "start", "length", "doc_tokens", "sequence", "offset", "ids")}
        if not self.ids:
            return out
        ids = np.concatenate(self.ids)
        ends = np.cumsum([len(x) for x in self.ids])
        at, penalty = possible_cuts(ids, ends, self.stops)
        if last:  # the end of the row may be cut into powers of two, so that it needs hardly any padding
            more = len(ids) - np.append(np.arange(SHORTEST, 2 * self.length, SHORTEST), np.arange(1, SHORTEST))
            more = more[more > 0]
            both = np.union1d(at, more)
            wide = np.full(len(both), ANYWHERE, dtype=np.int64)
            wide[np.searchsorted(both, at)] = penalty
            at, penalty = both, wide
        cuts = at[best_cuts(at, penalty, self.length, 1 if last else SHORTEST)[0]]
        if not last:
            cuts = cuts[:-2]
        if len(cuts) < 2:
            return out
        stop = int(cuts[-1])
        first = np.concatenate([[0], ends[:-1]])
        edges = np.union1d(cuts, first[first < stop])
        doc = np.searchsorted(ends, edges[:-1], side="right")
        window = np.searchsorted(cuts, edges[:-1], side="right") - 1
        begin = np.array(self.begin)
        out["key"] = [self.key[d] for d in doc.tolist()]
        out["start"] = (edges[:-1] - first[doc] + begin[doc]).tolist()
        out["length"] = np.diff(edges).tolist()
        out["doc_tokens"] = [self.total[d] for d in doc.tolist()]
        out["sequence"] = (window + self.sequence).tolist()
        out["offset"] = (edges[:-1] - cuts[window]).tolist()
        raw = ids.astype("<u4")
        out["ids"] = [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        self.sequence += len(cuts) - 1
        d = int(np.searchsorted(ends, stop, side="right"))
        if d < len(self.ids):
            rest = self.ids[d][stop - int(first[d]):]
            self.begin[d] += stop - int(first[d])
            self.ids[d] = rest
        self.key, self.total, self.begin, self.ids = self.key[d:], self.total[d:], self.begin[d:], self.ids[d:]
        self.open -= stop
        return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: ``key``, start (ids of its document before it), length, doc_tokens, sequence_id, offset (in its sequence), ids_crc32, and ids (array of int) if asked for.

    ``length``: 2 at least.  A sequence's padding is what it lacks to ``length``; one whose ids are a power of two needs none.
    """
    if length < 2:
        raise ValueError("length: 2 at least")
    spark = docs.sparkSession
    n = partitions(spark)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    low = -(1 << 63)
    quantiles = source.select(F.coalesce("key", F.lit(low)).alias("key")).agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    cuts = np.array(sorted(quantiles) if n > 1 else [], dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        code, dealt = coder(path), 0
        kind = np.dtype("<u2" if code.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        for whole in batches:
            for b in long_batches(whole, "text", SLICE):
                _, ids = encoded(code, b.column(1), end_id, kind)
                keys = b.column(0).fill_null(low).to_numpy(zero_copy_only=False)
                # a key that fills whole ranges by itself is dealt to all of them in turn
                left, right = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
                turn = dealt + np.arange(len(keys))
                dealt += len(keys)
                bucket = np.where(right - left > 1, left + 1 + turn % np.maximum(right - left, 1), right)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), b.column(0), pa.array(np.full(len(keys), kind.itemsize), pa.int32()), ids], ["bucket", "key", "width", "ids"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        stops = stop_ids(path)
        stops = np.append(stops, np.zeros(max(end_id + 1 - len(stops), 0), dtype=bool))
        bucket, row = None, _Row(stops, length)

        def batch(pieces: dict[str, list]) -> pa.RecordBatch:
            m = len(pieces["key"])
            crc = [zlib.crc32(x.data) for x in pieces["ids"]]
            lists = pa.array([x.astype(np.int32) for x in pieces["ids"]] if with_ids else [None] * m, pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([bucket] * m, pa.int32()), *(pa.array(pieces[k], pa.int64()) for k in ("key", "start", "length", "doc_tokens", "sequence", "offset")),
                                               pa.array(crc, pa.int64()), lists], ["bucket", "key", "start", "length", "doc_tokens", "sequence", "offset", "ids_crc32", "ids"])

        for whole in batches:
            for b in long_batches(whole, "ids"):
                for at, k, w, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                    if at != bucket:
                        if bucket is not None:
                            yield batch(row.solve(True))
                        bucket, row = at, _Row(stops, length)
                    row.add(k, np.frombuffer(x.as_buffer(), dtype=f"<u{w}"))
                    if row.open >= BLOCK:
                        yield batch(row.solve(False))
        if bucket is not None:
            yield batch(row.solve(True))

    dealt = source.mapInArrow(deal, "bucket int, key long, width int, ids binary")
    ranges = dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket", F.col("key").asc_nulls_first())
    made = stored(ranges.mapInArrow(fold, "bucket int, key long, start long, length long, doc_tokens long, sequence long, offset long, ids_crc32 long, ids array<int>"), "pieces")
    per = made.groupBy("bucket").agg((F.max("sequence") + 1).alias("total"))
    before = per.select("bucket", F.coalesce(F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = made.join(before, "bucket").select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("before")).alias("sequence_id"), "offset", "ids")
    return out if with_ids else out.drop("ids")


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, filled, padding of every sequence."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    return filled.withColumn("padding", F.when(power, 0).otherwise(length - F.col("filled")))


def digest(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    return pack(docs, path, length, with_ids=False)
