"""Repeated passages, located with Aho-Corasick automata.

A word goes if a window of ``WINDOW`` consecutive words that covers it starts earlier too: in a document with a smaller id, or earlier in the same one.

1. Every window has an anchor: the least hash of its 8-word runs.  Equal windows have equal anchors, and neighbouring windows mostly share one,
   so anchors are few.  Anchors at two places or more of different texts are counted over all documents.
2. Windows with such an anchor are candidates.  They are confirmed by grouping: a window in two documents or more is a phrase, and the document with the
   smallest id has it first.  (Windows that repeat inside one document are found while it is read.)
3. Phrases are compiled into automata, one for each shard of anchors, of bounded size; an anchor that very many places share
   gets several copies of its shard.  The candidate stretches of all documents stream past the automaton of their shard: those with the hash of one of its
   phrases are read by it, word by word, which finds every occurrence of every phrase (the others hold none: equal windows have equal hashes).
4. Documents with findings are read again, and the words that are left are joined.

A document whose words all equal those of one with a smaller id is wholly repeated and needs no search.  Null and empty texts have no words.  Rows that repeat an
id are taken as the same document: they don't count as earlier for each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import CELLS, MIX, byte_hashes, cells, in_cells, long_batches, mix, partitions, shingle_hashes, stored, word_spans

WINDOW, RUN = 20, 8
#: Windows in one stretch at most (as many runs as a window has).
STRETCH = WINDOW - RUN + 1
#: Windows compiled into one automaton, about; stretches of one anchor that one copy of its shard takes, about.
SHARD, SPLIT = 40_000, 200_000
#: Anchors that may be split: those with at least this share of all places, so at most so many.
SPLITTABLE = 10_000
_SLICE = 2 << 20
#: Cells of the anchor bitmap: a fixed size whatever the number of anchors.
ANCHOR_CELLS = 1 << 27


class _Windows:
    """Windows of a slice of texts: valid starts, their documents, anchors and (on demand) hashes."""

    def __init__(self, texts: pa.Array):
        self.data, self.start, self.end, self.bound = word_spans(texts)
        self.words = byte_hashes(self.data, self.start, self.end)
        count = np.diff(self.bound)
        self.doc = np.repeat(np.arange(len(count)), np.maximum(count - WINDOW + 1, 0))
        first = np.repeat(self.bound[:-1], np.maximum(count - WINDOW + 1, 0))
        inside = np.arange(len(self.doc)) - np.repeat(np.cumsum(np.maximum(count - WINDOW + 1, 0)) - np.maximum(count - WINDOW + 1, 0), np.maximum(count - WINDOW + 1, 0))
        self.at, self.place = first + inside, inside
        self.counts = count

    @cached_property
    def anchor(self) -> np.ndarray:
        runs = shingle_hashes(self.words, RUN)
        if not len(self.at):
            return runs[:0]
        low = np.minimum(runs[:-1], runs[1:])
        low = np.minimum(low[:-2], low[2:])
        low = np.minimum(low[:-4], low[4:])
        low = np.minimum(low[:-(STRETCH - 8)], low[STRETCH - 8:])
        return low[self.at]

    def hashes(self) -> np.ndarray:
        return shingle_hashes(self.words, WINDOW)[self.at] if len(self.at) else self.words[:0]

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of windows of one document and anchor, STRETCH at most: index of the first window, number."""
        n = len(self.at)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])])
        begin = np.flatnonzero(new)
        since = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        begin = np.flatnonzero(since % STRETCH == 0)
        return begin, np.diff(np.append(begin, n))

    def classes(self) -> np.ndarray:
        """An id of each text by its words (64 bits)."""
        position = np.arange(len(self.words), dtype=np.uint64) - np.repeat(self.bound[:-1], self.counts).astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.words + position * np.uint64(MIX[2])))])
        return mix(sums[self.bound[1:]] - sums[self.bound[:-1]] + self.counts.astype(np.uint64))


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Windows]]:
    for whole in batches:
        for b in long_batches(whole, "text", _SLICE):
            yield b, _Windows(b.column(1))


def _joined(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def profiles(docs: DataFrame) -> DataFrame:
    """Stored (doc, n_words, class, sha256 of all words joined)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, w in _slices(batches):
            sha = [hashlib.sha256(b" ".join(_joined(t))).hexdigest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.counts, pa.int64()), pa.array(w.classes().view(np.int64)), pa.array(sha)], ["doc", "n_words", "class", "sha"])

    return stored(docs.mapInArrow(run, "doc long, n_words long, class long, sha string"), "profiles")


def anchors(docs: DataFrame) -> DataFrame:
    """Stored (g, n): anchors at two places or more (equal texts count once), and their number of stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b, w in _slices(batches):
            own = w.classes()
            fresh = np.zeros(len(own), dtype=bool)
            for i, c in enumerate(own.tolist()):
                if c not in seen:
                    seen.add(c)
                    fresh[i] = True
            begin, _ = w.stretches()
            begin = begin[fresh[w.doc[begin]]] if len(begin) else begin
            place = mix(own[w.doc[begin]] + w.place[begin].astype(np.uint64) * np.uint64(MIX[0]))
            yield pa.RecordBatch.from_arrays([pa.array(w.anchor[begin].view(np.int64)), pa.array(place.view(np.int64))], ["g", "place"])

    places = docs.mapInArrow(run, "g long, place long")
    found = places.groupBy("g").agg(F.min("place").alias("x"), F.max("place").alias("y"), F.count(F.lit(1)).alias("n"))
    return stored(found.filter("x < y").select("g", "n"), "anchors")


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """One bit for each anchor, by its lowest bits (anchors are hashes); ANCHOR_CELLS / 8 bytes."""
    c = F.col("g").bitwiseAND(ANCHOR_CELLS - 1)
    rows = anchors.select((c + 1).alias("c")).groupBy(F.bitmap_bucket_number("c").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
    out = np.zeros(ANCHOR_CELLS // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        at = (r["b"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


FRAGMENT = "g long, copies int, copy int, doc long, start long, n int, again int, recurs boolean, words binary"


def stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Stored FRAGMENT rows: stretches of windows that may recur, with their words; ``again``: bits of the windows that the document has had before."""
    sc = docs.sparkSession.sparkContext
    total = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = {r["g"]: -(-r["n"] // SPLIT) for r in found.filter(F.col("n") > max(SPLIT, total // SPLITTABLE)).collect()}
    bits, hot = sc.broadcast(_bitmap(found)), sc.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b, w in _slices(batches):
            if not len(w.at):
                continue
            ids = b.column(0).to_pylist()
            fresh = np.zeros(len(ids), dtype=bool)
            for i, (c, d) in enumerate(zip(w.classes().tolist(), ids)):
                if d is not None and (c not in seen or d < seen[c]):
                    seen[c] = d
                    fresh[i] = True
            h = w.hashes()
            recurs = in_cells(bits.value, (w.anchor & np.uint64(ANCHOR_CELLS - 1)).astype(np.int64))
            again = np.zeros(len(h), dtype=bool)
            for d in range(1, STRETCH):
                again[d:] |= (h[d:] == h[:-d]) & (w.doc[d:] == w.doc[:-d])
            maybe = np.flatnonzero(recurs)
            own = mix(h[maybe] + w.doc[maybe].astype(np.uint64) * np.uint64(MIX[1]))
            order = np.argsort(own, kind="stable")
            same = np.concatenate([[False], own[order][1:] == own[order][:-1]]) if len(order) else np.zeros(0, bool)
            again[maybe[order[same]]] = True
            begin, n = w.stretches()
            shifted = again.astype(np.int32) << (np.arange(len(h)) - np.repeat(begin, n)).astype(np.int32)
            mask = np.add.reduceat(shifted, begin)
            keep = np.flatnonzero((recurs[begin] | (mask > 0)) & fresh[w.doc[begin]])
            if not len(keep):
                continue
            begin, n, mask = begin[keep], n[keep], mask[keep]
            raw = w.data.tobytes()
            left, right = w.start[w.at[begin]], w.end[w.at[begin] + n + WINDOW - 2]
            g = w.anchor[begin].view(np.int64)
            copies = np.array([hot.value.get(x, 1) for x in g.tolist()], dtype=np.int32)
            doc = np.array(ids, dtype=object)[w.doc[begin]].astype(np.int64)
            copy = (mix(doc.view(np.uint64)) % copies.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(copies), pa.array(copy), pa.array(doc), pa.array(w.place[begin], pa.int64()), pa.array(n, pa.int32()),
                                              pa.array(mask, pa.int32()), pa.array(recurs[begin]), pa.array([raw[x:y] for x, y in zip(left.tolist(), right.tolist())], pa.binary())],
                                             [x.split()[0] for x in FRAGMENT.split(", ")])

    return stored(docs.mapInArrow(run, FRAGMENT), "stretches")


def confirmed(fragments: DataFrame) -> DataFrame:
    """(doc, start, mask): the stretches where phrases are first, with a bit for each window that some later document has too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _Windows(b.column(3).cast(pa.string()))
            again = b.column(2).to_numpy()[w.doc] >> w.place & 1
            pick = np.flatnonzero(again == 0)
            doc, start = b.column(0).to_numpy()[w.doc[pick]], b.column(1).to_numpy()[w.doc[pick]]
            yield pa.RecordBatch.from_arrays([pa.array(w.hashes()[pick].view(np.int64)), pa.array(doc), pa.array(start * 16 + w.place[pick])], ["w", "doc", "place"])

    rows = fragments.filter("recurs").select("doc", "start", "again", "words").mapInArrow(run, "w long, doc long, place long")
    first = rows.groupBy("w").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.min_by("place", "doc").alias("place")).filter("doc < last")
    bit = F.call_function("shiftleft", F.lit(1), F.col("place").bitwiseAND(15).cast("int"))
    return first.groupBy("doc", F.shiftright("place", 4).alias("start")).agg(F.bit_or(bit).alias("mask"))


def occurrences(fragments: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc, start, mask): windows that start earlier, as bits of their stretches.  Phrases and stretches meet in the shard of their anchor."""
    spark = fragments.sparkSession
    compiled = stored(fragments.select("g", "copies", "doc", "start", "words").join(phrases, ["doc", "start"])
                      .select("g", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "doc", "start", "mask", "words"), "phrases")
    size = compiled.agg(F.sum(F.bit_count("mask")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // SHARD))
    shard = F.pmod(F.xxhash64("g"), F.lit(shards)).alias("shard")
    both = compiled.select(shard, "copy", F.lit(0).alias("kind"), "doc", "start", "mask", "words").unionByName(
        fragments.filter("recurs").select(shard, "copy", F.lit(1).alias("kind"), "doc", "start", F.col("again").alias("mask"), "words"))
    dealt = both.repartition(partitions(spark), "shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        now = None
        for b in batches:
            at = [b.column(i).to_numpy() for i in range(3)]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
            docs, starts, masks = [b.column(i).to_numpy() for i in (3, 4)] + [b.column(5).to_numpy().copy()]
            found = np.zeros(b.num_rows, dtype=bool)
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                if (at[0][x], at[1][x]) != now:
                    now = (at[0][x], at[1][x])
                    automaton, letters, ready, known = ahocorasick.Automaton(), {}, False, []
                words, w = b.column(6).slice(x, y - x), _Windows(b.column(6).slice(x, y - x).cast(pa.string()))
                h = w.hashes()
                if at[2][x] == 0:
                    known.append(h[masks[x:y][w.doc] >> w.place & 1 == 1])
                    # one character for each word of the shard's phrases; surrogates are left out
                    for doc, mask, phrase in zip(docs[x:y].tolist(), masks[x:y].tolist(), words.to_pylist()):
                        split = phrase.split()
                        text = "".join([letters.setdefault(x, chr(len(letters) + 1 + 0x800 * (len(letters) >= 0xD7FF))) for x in split])
                        for k in range(len(split) - WINDOW + 1):
                            if mask >> k & 1:
                                automaton.add_word(text[k:k + WINDOW], doc)
                    continue
                found[x:y] = masks[x:y] != 0
                if not ready:
                    automaton.make_automaton()
                    ready, known = True, [np.unique(np.concatenate(known))] if known else []
                if not len(automaton):
                    continue
                # a stretch without the hash of any phrase of the shard holds none of them
                likely = np.unique(w.doc[known[0][np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)] == h])
                for i, phrase in zip((x + likely).tolist(), words.take(pa.array(likely)).to_pylist()):
                    for end, owner in automaton.iter("".join([letters.get(x, "\0") for x in phrase.split()])):
                        if owner != docs[i]:
                            masks[i] |= 1 << (end - WINDOW + 1)
                            found[i] = True
            yield pa.RecordBatch.from_arrays([pa.array(docs[found], pa.int64()), pa.array(starts[found], pa.int64()), pa.array(masks[found], pa.int32())], ["doc", "start", "mask"])

    found = dealt.select("shard", "copy", "kind", "doc", "start", "mask", "words").mapInArrow(run, "doc long, start long, mask int")
    return found.unionByName(fragments.filter("NOT recurs").select("doc", "start", F.col("again").alias("mask")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; ``with_text`` adds the kept words joined by one space."""
    spark = docs.sparkSession
    own = _narrow(docs, key, text)
    rows = profiles(own)
    first = rows.filter(F.col("n_words") >= WINDOW).groupBy("class").agg(F.min("doc").alias("first"))
    rows = rows.join(first, "class", "left").withColumn("copied", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)))
    fragments = stretches(own, anchors(own))
    found = occurrences(fragments, confirmed(fragments)).groupBy("doc").agg(F.collect_list(F.struct("start", "mask")).alias("found"))
    found = stored(found, "found")
    bits = spark.sparkContext.broadcast(cells(found, "doc"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b.filter(pa.array(in_cells(bits.value, b.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], ["doc", "text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, sha, left = [], [], []
            for t, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = _joined(t)
                step = np.zeros(len(words) + 1, dtype=np.int32)
                for m in marks:
                    k, mask = m["start"], m["mask"]
                    while mask:
                        if mask & 1 and k + WINDOW <= len(words):
                            step[k] += 1
                            step[k + WINDOW] -= 1
                        mask >>= 1
                        k += 1
                gone = step.cumsum()[:-1] > 0
                kept = b" ".join(x for x, g in zip(words, gone.tolist()) if not g)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode("utf-8", "surrogatepass") if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], ["doc", "n_removed", "kept", "left"])

    cell = F.pmod(F.xxhash64("doc"), F.lit(CELLS)).alias("cell")
    again = own.select("doc", "text", cell).mapInArrow(chosen, "doc long, text string").join(found, "doc").select("doc", "text", "found")
    marked = again.mapInArrow(finish, "doc long, n_removed long, kept string, left string")
    if with_text:
        every = own.select(F.col("doc"), F.col("text"))
        rows = rows.join(every.dropDuplicates(["doc"]), "doc", "left")
    marked = marked.dropDuplicates(["doc"])
    out = rows.join(marked, "doc", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    result = out.select(F.col("doc").alias("doc_id"), "n_words",
                        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
                        F.when(F.col("copied"), nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
                        *([F.when(F.col("copied"), "").otherwise(F.coalesce("left", F.array_join(F.filter(F.split("text", "[ \\t-\\r]+"), lambda x: x != ""), " "), F.lit(""))).alias("kept_text")] if with_text else []))
    return result
