"""Benchmark items that leaked into documents, in DataFrame functions only.

Texts are lower-cased words (runs of letters and digits); shingles are five words, or the whole item where it has fewer.  For an item of m shingles the
windows of a document with m shingles (the whole document where it is shorter) are compared:

1. A window that shares no shingle with the item has similarity 0, so windows are listed only around places where a chain of shingles of the item begins.
2. Windows and items get 64-bit SimHash fingerprints (each bit by the majority of the shingles' hashes, repeated shingles counted as often as they occur).
3. Fingerprints within ``RADIUS`` agree in one of eight 8-bit blocks up to two bits.  The items' blocks are indexed with all their variants of up to
   two bits, so a join on (size, block, value) finds every pair within the radius.
4. Pairs within the radius are verified: sum of the smaller over sum of the larger shingle counts, at least ``LEAST``.

A window of similarity 0.8 differs in about ten bits; 23 is more than four standard deviations away.  Null and empty texts, and items without words, match nothing.
Repeated rows count once.  The item tables are broadcast only below ``BROADCAST_ROWS`` rows, and joined by shuffle beyond.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import stored

WIDTH, LEAST, RADIUS, BLOCKS = 5, 0.8, 23, 8
BROADCAST_ROWS = 500_000
#: All masks of at most RADIUS // BLOCKS bits of a block.
VARIANTS = [m for m in range(256) if m.bit_count() <= RADIUS // BLOCKS]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words (none if there are fewer).  The words are bound by an outer function, so that they are split once for
    each text and not once for each run, wherever the optimiser moves the expression."""
    def runs(w: Column) -> Column:
        one = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
        return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), one)).otherwise(F.array().cast("array<bigint>"))

    return _bound(words, runs)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(hashes: Column, lane: int) -> Column:
    """The majority of each of the 64 bits of an array of hashes.

    Bits are counted in lanes of ``lane`` bits: long j has the counts of the bits j, j + lane, j + 2 lane and so on.
    """
    ones, zero = F.lit(sum(1 << lane * k for k in range(64 // lane))), F.lit(0).cast("long")

    def counted(h: Column, j: int) -> Column:
        return F.aggregate(h, zero, lambda a, x: a + F.shiftrightunsigned(x, j).bitwiseAND(ones))

    def bits(h: Column, counts: Column) -> Column:
        def bit(n: Column) -> Column:
            count = F.call_function("shiftrightunsigned", F.get(counts, n % lane), (n / lane).cast("int") * lane).bitwiseAND(F.lit((1 << lane) - 1))
            return F.when(2 * count > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), n)).otherwise(zero)

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), zero, lambda a, x: a.bitwiseOR(x))

    return _bound(hashes, lambda h: _bound(F.array(*(counted(h, j) for j in range(lane))), lambda counts: bits(h, counts)))


def _block(value: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, k * 8).bitwiseAND(255)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find(docs: DataFrame, items: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start): each document and item with a window of at least ``least``; the best window's first word (the
    earliest of the best)."""
    own = items.select(F.col(item).alias("item"), _words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    found = None
    for width in sorted(r["k"] for r in own.select(F.least(F.size("w"), F.lit(WIDTH)).alias("k")).distinct().collect()):
        mine = own.filter(F.size("w") >= WIDTH if width == WIDTH else F.size("w") == width)
        mine = stored(mine.select("item", _hashes(F.col("w"), width).alias("h")).withColumn("m", F.size("h")), "items")
        lane = 16 if (mine.agg(F.max("m").alias("m")).first()["m"] or 0) < 1 << 16 else 32
        part = _matches(docs.select(F.col(key).alias("doc"), _hashes(_words(F.col(text)), width).alias("h")), mine, lane, least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select(F.col(key).alias("doc"), F.lit(None).cast(items.schema[item].dataType).alias("item"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start")).limit(0)
    best = found.groupBy("doc", "item").agg(F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start"))
    return best.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "similarity", F.col("start").cast("long").alias("start"))


def _matches(docs: DataFrame, items: DataFrame, lane: int, least: float) -> DataFrame:
    at = items.select("item", "m", F.posexplode("h").alias("i", "x"), "h").withColumn("before", F.get("h", F.col("i") - 1)).select("m", "x", "before").distinct()
    starts = _small(stored(at, "starts"))
    # the outer form: no filter on the array is derived, which would hash every text twice
    hits = docs.select("doc", "h", F.posexplode_outer("h").alias("p", "x")).join(starts, "x")
    chains = hits.filter((F.col("p") == 0) | F.col("before").isNull() | (F.get("h", F.col("p") - 1) != F.col("before")))
    n = F.least("m", F.size("h"))
    low, high = F.greatest(F.col("p") - n + 1, F.lit(0)), F.least(F.col("p") + n - 1, F.size("h") - n)
    around = chains.select("doc", "m", n.alias("n"), low.alias("low"), high.alias("high"), F.slice("h", low + 1, high - low + n).alias("near"))
    around = stored(around.groupBy("doc", "m", "n", "low", "high").agg(F.first("near").alias("near")), "chains")
    windows = around.select("doc", "m", "n", "low", "near", F.explode(F.sequence("low", "high")).alias("start"))
    window = F.slice("near", F.col("start") - F.col("low") + 1, F.col("n"))
    windows = windows.select("doc", "m", "start", window.alias("window"), fingerprint(window, lane).alias("print"))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: F.struct(k.alias("block"), _block(F.col("print"), k).alias("value")))
    index = items.withColumn("print", fingerprint(F.col("h"), lane)).withColumn("b", F.explode_outer(blocks)).withColumn("mask", F.explode(F.array(*map(F.lit, VARIANTS)))).select(
        "item", "m", "h", F.col("print").alias("item_print"), F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("mask")).alias("value"))
    index = _small(stored(index, "index"))
    near = windows.withColumn("b", F.explode_outer(blocks)).select("doc", "m", "start", "window", "print", F.col("b.block").alias("block"), F.col("b.value").alias("value")).join(index, ["m", "block", "value"])
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    agree = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: F.bit_count(_block(apart, k)) <= RADIUS // BLOCKS), F.lit(True)) - 1
    close = near.filter((F.bit_count(apart) <= RADIUS) & (agree == F.col("block")))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    same = F.aggregate(F.array_distinct("h"), F.lit(0), lambda a, x: a + F.least(count(F.col("window"), x), count(F.col("h"), x)))
    similarity = _bound(same, lambda n: n / (F.size("window") + F.size("h") - n))
    return close.select("doc", "item", similarity.alias("similarity"), "start").filter(F.col("similarity") >= least)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item is found; the columns of ``docs``."""
    key = options.get("key", "doc_id")
    bad = find(docs, items, **options).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, key, "left_anti").select(*docs.columns)
