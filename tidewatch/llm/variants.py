"""Spelling variants: words one inserted, deleted or replaced code point apart, by search schemes over a bidirectional FM-index.

1. Words are counted over all documents, in each task first.
2. If two words differ by one edit, the first half of one of them or its second half stands unchanged at the same end of the other.  So every word, as a query, goes to two
   shards: that of its first half and that of its second half.  As an entry it goes to the shards of all beginnings and ends that can be such a half: two or three
   lengths each.  Shards have about ``SHARD`` entries and follow the number of words; a half with more than ``SPLIT`` entries gets shards of its own, with the entries dealt over
   them and the queries sent to each.
3. A shard's entries are joined with delimiters, and the text is indexed in both directions (``Index``).  All queries of a shard run side by side as ranges of suffix ranks: one
   half, with its delimiter, is matched exactly; then the range is extended across the other half allowing one error, up to the other delimiter.  Such a range is one entry.
4. A task reports one row a query: the number of near words, and the best of them by count.  Pairs never leave the task.  The two schemes don't overlap: the second one drops what keeps the
   first half.
5. Forms are followed to their roots by pointer doubling; counts grow at least fivefold a step, so the rounds are few.

Null texts have no words; rows that repeat count again (each is an occurrence); a null key counts as an empty one in the check sum.  Other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import long_batches, partitions, stored

LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: One in so many occurrences loses a code point.
DAMAGED = 199
#: Entries of a shard, about; entries of one half beyond which it is split; queries that run side by side.
SHARD, SPLIT, SIDE_BY_SIDE = 40_000, 40_000, 20_000
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Fixed value: runs of letters in UTF-8, A to Z in lower case already: [a-z] and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


# ---------------------------------------------------------------- words

def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """Stored (word, n): distinct words of at least ``least_length`` code points and ``least_count`` occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) - w.count(b"\xc3") >= least_length]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for whole in batches:
            for b in long_batches(whole, "text"):
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if not t:
                        continue
                    # bytes.lower() changes A to Z only
                    own = Counter(_RUN.findall(t.encode().lower()))
                    seed = zlib.crc32(f"{'' if k is None else k}:".encode())
                    for w, n in own.items():
                        h = zlib.crc32(w, seed)
                        if h % damaged == 0:
                            letters = w.decode()
                            at = h % len(letters)
                            w = (letters[:at] + letters[at + 1:]).encode()
                        counts[w] += n
                    if len(counts) >= HELD:
                        yield out()
        yield out()

    narrow = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    counted = narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.filter(F.col("n") >= least_count), "words")


# ---------------------------------------------------------------- the index

class _Side:
    """Ranks over the characters that stand before the suffixes of a text: for each character c, how many of the first i are smaller than c.

    A bit vector for every c with counts before each 64 positions.
    """

    def __init__(self, before: np.ndarray, size: int):
        n = len(before)
        blocks = n // 64 + 1
        padded = np.full(blocks * 64, size, dtype=np.int16)
        padded[:n] = before
        self.bits = np.zeros((blocks, size + 1), dtype=np.uint64)
        self.sums = np.zeros((blocks, size + 1), dtype=np.int64)
        for c in range(size + 1):
            self.bits[:, c] = np.packbits(padded < c, bitorder="little").view("<u8")
            self.sums[1:, c] = np.cumsum(np.bitwise_count(self.bits[:-1, c]))

    def less(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.sums[block, c] + np.bitwise_count(self.bits[block, c] & ((np.uint64(1) << bit) - np.uint64(1)))

    def less_all(self, i: np.ndarray) -> np.ndarray:
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.sums[block] + np.bitwise_count(self.bits[block] & ((np.uint64(1) << bit) - np.uint64(1))[:, None])


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text in order, by doubling: ranks by 1, 2, 4 ... characters until all differ."""
    n = len(text)
    rank, width = text.astype(np.int64), 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:n - width] = rank[width:] + 1
        both = rank * (int(rank.max()) + 2) + second
        order = np.argsort(both, kind="stable")
        step = np.concatenate([[0], np.diff(both[order]) != 0]).cumsum()
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        width *= 2
        if step[-1] == n - 1 or width >= n:
            return order


class Index:
    """Bidirectional FM-index of distinct words, sorted, between delimiters.

    A pattern P is a range [low, low + size) of the ranks of suffixes that start with P, and a range [back, back + size) of those of the reversed text that start with P
    reversed.  ``extend`` gives those of cP or Pc.  Characters are numbered from 1; 0 is the delimiter.
    """

    def __init__(self, entries: list[str]):
        points = np.frombuffer("\0".join(["", *entries, ""]).encode("utf-32-le"), dtype="<u4")
        self.letters = np.unique(points)
        text = np.searchsorted(self.letters, points).astype(np.int16)
        self.size, self.length = len(self.letters), len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))]).astype(np.int64)
        # a circular text: every suffix has a character before it
        self.forward, self.backward = (_Side(t[(suffix_ranks(t) - 1) % len(t)], self.size) for t in (text, text[::-1].copy()))

    def codes(self, word: str) -> list[int]:
        """Numbers of a word's characters; -1 for one that no entry has."""
        points = np.frombuffer(word.encode("utf-32-le"), dtype="<u4")
        at = np.minimum(np.searchsorted(self.letters, points), self.size - 1)
        return np.where(self.letters[at] == points, at, -1).tolist()

    def _step(self, side: _Side, low: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = np.maximum(c, 0)
        a, b = side.less(known, low), side.less(known, low + size)
        inner_a, inner_b = side.less(known + 1, low), side.less(known + 1, low + size)
        return self.first[known] + inner_a - a, other + b - a, np.where(c < 0, 0, inner_b - b - inner_a + a)

    def extend(self, state: tuple, c: np.ndarray, right: bool) -> tuple:
        """Ranges (low, back, size) after one more character on the right or the left."""
        low, back, size = state
        if right:
            back, low, size = self._step(self.backward, back, low, size, c)
        else:
            low, back, size = self._step(self.forward, low, back, size, c)
        return low, back, size

    def extend_all(self, state: tuple, right: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
        """All extensions by a letter that aren't empty: which state, which letter, ranges."""
        low, back, size = state
        side, main, other = (self.backward, back, low) if right else (self.forward, low, back)
        a, b = side.less_all(main), side.less_all(main + size)
        width = np.diff(b, axis=1) - np.diff(a, axis=1)
        width[:, 0] = 0
        which, c = np.nonzero(width)
        new_main = self.first[c] + a[which, c + 1] - a[which, c]
        new_other = other[which] + b[which, c] - a[which, c]
        return which, c, (new_other, new_main, width[which, c]) if right else (new_main, new_other, width[which, c])

    def near(self, codes: np.ndarray, lengths: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of all entries one edit away from a query whose first half (``right``) or second half they keep.  Pairs may repeat.

        ``codes``: a row a query, filled up with -1.  Entries count in sorted order.
        """
        m = len(lengths)
        half = lengths // 2 if right else lengths - lengths // 2
        # the row in reading order of the scheme: the half that is kept comes first
        if not right:
            at = lengths[:, None] - 1 - np.arange(codes.shape[1])
            codes = np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), axis=1), -1)
        query = np.arange(m)
        start = np.zeros(m, dtype=np.int64)
        state = (start, start, np.full(m, self.length, dtype=np.int64))
        state = self.extend(state, start, right)  # the delimiter
        # query and state: without an error so far; wrong: with one, at the same place of the query; ahead: with one, a letter further on
        wrong: tuple[np.ndarray, tuple] = (query[:0], tuple(x[:0] for x in state))
        found_q, found_low = [], []

        def part(states: tuple, keep: np.ndarray) -> tuple:
            return tuple(x[keep] for x in states)

        def joined(*pairs: tuple[np.ndarray, tuple]) -> tuple[np.ndarray, tuple]:
            return np.concatenate([q for q, _ in pairs]), tuple(np.concatenate([s[i] for _, s in pairs]) for i in range(3))

        ahead = wrong
        for place in range(int(lengths.max(initial=0)) + 1):
            wrong, ahead = joined(wrong, ahead), (query[:0], part(state, np.zeros(len(query), bool)))
            # an error here: only past the kept half (at its end, an inserted letter is one)
            free = place >= half[query]
            q, s = query[free], part(state, free)
            which, c, s_all = self.extend_all(s, right)
            inserted = (q[which], s_all)
            done = place >= lengths[q]
            same = np.where(place < lengths[q], codes[q, np.minimum(place, codes.shape[1] - 1)], -1)
            other = ~done[which] & (c != same[which])
            replaced = (q[which][other], part(s_all, other))
            deleted = (q[~done], part(s, ~done))
            # words that end here take the delimiter
            stop = place >= lengths[wrong[0]]
            past = place >= lengths[inserted[0]]
            ends = joined((wrong[0][stop], part(wrong[1], stop)), (inserted[0][past], part(inserted[1], past)))
            last = self.extend(ends[1], np.zeros(len(ends[0]), dtype=np.int64), right)
            hit = last[2] > 0
            found_q.append(ends[0][hit])
            found_low.append(last[0][hit])
            # all others read the query's next letter
            going = joined((wrong[0][~stop], part(wrong[1], ~stop)), (inserted[0][~past], part(inserted[1], ~past)))
            moved = self.extend(going[1], codes[going[0], place] if len(going[0]) else going[0], right)
            hit = moved[2] > 0
            wrong = (going[0][hit], part(moved, hit))
            ahead = joined(replaced, deleted)
            open_ = place < lengths[query]
            query, state = query[open_], part(state, open_)
            state = self.extend(state, codes[query, place] if len(query) else query, right)
            hit = state[2] > 0
            query, state = query[hit], part(state, hit)
        # suffixes that start with a delimiter are ranked as the entries are, after the empty one at the end of the text
        return np.concatenate(found_q), np.concatenate(found_low) - 1


def search(entries: list[str], counts: np.ndarray, queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """For every query: near words among distinct sorted ``entries`` that keep its first half (``right``), or its second half but not the first; the largest count; its word (ties: smallest)."""
    index = Index(entries)
    number, best, form = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), [None] * len(queries)
    by_length = sorted(range(len(queries)), key=lambda i: len(queries[i]))
    for at in range(0, len(by_length), SIDE_BY_SIDE):
        chunk = by_length[at:at + SIDE_BY_SIDE]
        lengths = np.array([len(queries[i]) for i in chunk])
        codes = np.full((len(chunk), int(lengths.max())), -1, dtype=np.int64)
        flat = np.array(index.codes("".join(queries[i] for i in chunk)))
        codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
        q, e = index.near(codes, lengths, right)
        pairs = np.unique(q * len(entries) + e)
        q, e = pairs // len(entries), pairs % len(entries)
        if not right:
            keep = np.array([not entries[y].startswith(queries[chunk[x]][:len(queries[chunk[x]]) // 2]) for x, y in zip(q.tolist(), e.tolist())], dtype=bool)
            q, e = q[keep], e[keep]
        order = np.lexsort([e, -counts[e], q])
        q, e = q[order], e[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        for x, y, n in zip(q[first].tolist(), e[first].tolist(), np.diff(np.append(first, len(q))).tolist()):
            number[chunk[x]], best[chunk[x]], form[chunk[x]] = n, counts[y], entries[y]
    return number, best, form


# ---------------------------------------------------------------- the jobs

def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best): of every word its near words, counted, and the one of largest count (ties: smallest word); 0 and null without any."""
    spark = vocabulary.sparkSession
    length = F.length("word")
    halves = F.array(F.struct(F.lit(True).alias("right"), F.substring("word", F.lit(1), F.floor(length / 2).cast("int")).alias("half")),
                     F.struct(F.lit(False).alias("right"), F.expr("right(word, length(word) - length(word) div 2)").alias("half")))
    starts = F.array_distinct(F.array(*(F.expr(f"left(word, (length(word) + {k}) div 2)") for k in (-1, 0, 1))))
    ends = F.array_distinct(F.array(*(F.expr(f"right(word, (length(word) + {k}) div 2)") for k in (0, 1, 2))))
    both = F.concat(F.transform(starts, lambda h: F.struct(F.lit(True).alias("right"), h.alias("half"))), F.transform(ends, lambda h: F.struct(F.lit(False).alias("right"), h.alias("half"))))
    queries = vocabulary.select("word", "n", F.inline(halves))
    entries = vocabulary.select("word", "n", F.inline(both))
    total = vocabulary.count()
    shards = max(1, -(-4 * total // SHARD))

    # halves with very many entries: at most one for every SPLIT entries
    hot = stored(entries.groupBy("right", "half").count().filter(F.col("count") > SPLIT).select("right", "half", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")), "halves")
    usual = F.pmod(F.xxhash64("right", "half"), F.lit(shards))
    if hot.isEmpty():
        entries, queries = entries.withColumn("shard", usual), queries.withColumn("shard", usual)
    else:
        own = lambda part: F.xxhash64("right", "half", part).bitwiseOR(F.lit(-(1 << 63)))  # noqa: E731  (negative: no usual shard)
        entries = entries.join(hot, ["right", "half"], "left").withColumn("shard", F.when(F.col("parts").isNull(), usual).otherwise(own(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))).drop("parts")
        queries = queries.join(hot, ["right", "half"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
        queries = queries.withColumn("shard", F.when(F.col("parts").isNull(), usual).otherwise(own(F.col("part")))).drop("part", "parts")

    def run(shard: pa.Table) -> pa.Table:
        out = []
        for right in (True, False):
            side = shard.filter(pc.equal(shard.column("right"), right))
            asks = side.filter(side.column("query"))
            if not asks.num_rows:
                continue
            held = dict(zip(*(side.filter(pc.invert(side.column("query"))).column(c).to_pylist() for c in ("word", "n"))))
            known = sorted(held)  # Python sorts by code points
            queries = asks.column("word").to_pylist()
            number, best, form = search(known, np.array([held[w] for w in known], dtype=np.int64), queries, right) if known else ([0] * len(queries), [0] * len(queries), [None] * len(queries))
            out.append(pa.table([pa.array(queries, pa.string()), pa.array(asks.column("n")), pa.array(number, pa.int64()), pa.array(best, pa.int64()), pa.array(form, pa.string())], ["word", "n", "number", "best_n", "best"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())], ["word", "n", "number", "best_n", "best"])

    rows = entries.select("shard", "right", "word", "n", F.lit(False).alias("query")).unionByName(queries.select("shard", "right", "word", "n", F.lit(True).alias("query")))
    parts = rows.repartition(max(partitions(spark), min(shards, 100_000)), "shard").groupBy("shard").applyInArrow(run, "word string, n long, number long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    found = parts.groupBy("word").agg(F.first("n").alias("n"), F.sum("number").alias("n_near"), best.alias("b"))
    return found.select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Follows (word, form) to the last form: (word, root).  Stored rounds of pointer doubling."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return now


def variants(vocabulary: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of (word, n), words distinct.  A form needs ``factor`` (over 1) times the word's count."""
    found = neighbours(vocabulary)
    chosen = F.col("best_n") >= factor * F.col("n")
    found = stored(found.select("word", F.when(chosen, F.col("best")).alias("form"), "n", "n_near", F.when(chosen, F.col("best_n")).alias("form_n")), "forms")
    last = roots(found.filter(F.col("form").isNotNull()))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(words(docs))
