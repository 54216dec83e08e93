"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put in the order of their key's hash and cut into blocks.  Block k (from 0) of a source with weight w may not start before slot
floor(k / w) and must be placed by slot ceil((k + 1) / w); in every slot the released block with the earliest deadline goes next.  So at every slot each
source is less than one block away from its share.

Weights are whole parts of ``RESOLUTION``, so the schedule repeats after that many slots: only one period is computed, and the slot of any block follows from
it.  When a source has no block left, the others share its weight and a new phase begins; there are as many phases as sources at most.  No row is
dropped or repeated.

Defaults: a source's weight is its number of documents to the power 0.5.  Null sources are a source of their own.  Rows that repeat a key keep a place each.  Sources named in
the weights that have no rows are ignored; sources without a given weight get the smallest given one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .common import partitions, stored

RESOLUTION, BLOCK = 1_000, 32
#: Rows of one source that one window takes, about.
SLICE = 200_000


def parts(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Whole parts, one at least, that add up to the resolution (largest remainders; ties by name)."""
    names = sorted(weights)
    resolution = max(resolution, 4 * len(names))
    total = sum(weights.values())
    exact = {s: weights[s] / total * (resolution - len(names)) for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], s))[:resolution - sum(out.values())]:
        out[s] += 1
    return out


def period(shares: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source's blocks in one period: earliest deadline first among the released (ties by name)."""
    q = sum(shares.values())
    release = [(0, s, 0) for s in sorted(shares)]
    heapq.heapify(release)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for t in range(q):
        while release and release[0][0] <= t:
            _, s, k = heapq.heappop(release)
            heapq.heappush(ready, (-(-(k + 1) * q // shares[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(t)
        if k + 1 < shares[s]:
            heapq.heappush(release, ((k + 1) * q // shares[s], s, k + 1))
    return {s: np.array(x, dtype=np.int64) for s, x in slots.items()}


def plan(blocks: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """The phases: for each its first slot, period, and by source the first block, number of blocks and slots in a period."""
    left, done, first, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        shares = parts({s: weights[s] for s in left})
        slots, q = period(shares), sum(shares.values())
        length = min((n - 1) // shares[s] * q + int(slots[s][(n - 1) % shares[s]]) + 1 for s, n in left.items())
        phase = {"slot": first, "period": q, "sources": {}}
        for s in list(left):
            n = length // q * shares[s] + int(np.searchsorted(slots[s], length % q))
            phase["sources"][s] = (done[s], n, slots[s], shares[s])
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        first += length
        out.append(phase)
    return out


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block: int = BLOCK, key: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """All columns of ``docs`` and ``phase``, ``slot`` (of the row's block), ``position`` (0 to the number of rows less one) and ``share`` (the source's target in the phase).

    One row for each source and slice of its hashes reaches the driver's plan as counts: sources are as many as weights, slices as total / SLICE.
    """
    spark = docs.sparkSession
    kept = docs.drop("phase", "slot", "position", "share")
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    keyed = kept.withColumn("_source", name).withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    sizes = {r["_source"]: r["n"] for r in keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    given = {"=" + k: float(v) for k, v in (weights or {}).items() if v > 0}
    target = {s: given.get(s, min(given.values())) if given else n ** power for s, n in sizes.items()}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    phases = plan(blocks, target)
    # a source's last block may be short; rows after it move up
    last = {s: (p["slot"], p) for p in phases for s, (a, n, _, _) in p["sources"].items() if a + n == blocks[s] and n}
    short = sorted((_slots(p, s, np.array([blocks[s] - 1]))[0], blocks[s] * block - sizes[s]) for s, (_, p) in last.items())
    sent = spark.sparkContext.broadcast((phases, np.array([x for x, _ in short], dtype=np.int64), np.array([0, *np.cumsum([m for _, m in short])], dtype=np.int64)))

    # hashes are even, so the slices of a hot source are as well; at least as many as there are tasks
    slices = 1 << max(max(sizes.values(), default=0) // SLICE, partitions(spark) - 1).bit_length()
    cut = F.pmod(F.shiftright("_hash", 40), F.lit(slices)).cast("int")
    counted = keyed.groupBy("_source", cut.alias("_cut")).agg(F.count(F.lit(1)).alias("_n"))
    before = counted.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = keyed.withColumn("_cut", cut).withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_cut").orderBy("_hash", key)))
    numbered = ranked.join(before, ["_source", "_cut"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1).drop("_cut", "_before", "_hash")
    at = numbered.columns.index("_source"), numbered.columns.index("_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ends, missing = sent.value
        for b in batches:
            names, rank = np.array(b.column(at[0]).to_pylist(), dtype=object), b.column(at[1]).to_numpy()
            phase, slot, share = np.zeros(len(rank), np.int32), np.zeros(len(rank), np.int64), np.zeros(len(rank))
            for s in set(names):
                mine = np.flatnonzero(names == s)
                k = rank[mine] // block
                for i, p in enumerate(own):
                    a, n, _, q = p["sources"].get(s, (0, 0, None, 0))
                    sel = (k >= a) & (k < a + n)
                    if sel.any():
                        phase[mine[sel]], slot[mine[sel]], share[mine[sel]] = i, _slots(p, s, k[sel]), q / p["period"]
            position = slot * block + rank % block - missing[np.searchsorted(ends, slot, side="left")]
            cols = [c for i, c in enumerate(b.columns) if i not in at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(phase), pa.array(slot), pa.array(position), pa.array(share)],
                                             [*(n for i, n in enumerate(b.schema.names) if i not in at), "phase", "slot", "position", "share"])

    return numbered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for i, f in enumerate(numbered.schema.fields) if i not in at)
                               + ", phase int, slot long, position long, share double")


def _slots(phase: dict, source: str, k: np.ndarray) -> np.ndarray:
    a, _, slots, q = phase["sources"][source]
    return phase["slot"] + (k - a) // q * phase["period"] + slots[(k - a) % q]


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mix: the partitions are ranges of positions, sorted.  The columns of ``docs``."""
    placed = stored(interleave(docs, **options), "mixed")
    return placed.repartitionByRange(partitions(docs.sparkSession), "position").sortWithinPartitions("position").select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return interleave(docs.select("doc_id", "source"))
