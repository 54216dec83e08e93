"""What the corpus operators share: stored intermediate tables, table reading, word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
#: Fixed odd multipliers for mixing 64-bit words (the splitmix64 finaliser).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset, as in tests, a temporary folder that goes at exit; only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts the lineage and survives lost executors.

    Compressed with zstd; ``partitions`` become folders.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_file_order(docs: DataFrame, name: str) -> DataFrame:
    """Adds a column ``name`` (long) that ascends with the rows of a table read from Spark's part files: by part number, file name and row in the file.

    A writer's partitions become parts in their order, so rows keep the order they were written in.  One row for each file is numbered.
    """
    whole = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    part = F.coalesce(F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    files = docs.select(F.col("_metadata.file_name").alias("file")).distinct()
    numbered = files.select("file", (F.row_number().over(Window.orderBy(part, "file")) - 1).cast("long").alias("_part"))
    return whole.join(F.broadcast(numbered), F.col("_file") == F.col("file")).withColumn(name, F.shiftleft("_part", 40) + F.col("_row")).drop("_file", "_row", "file", "_part")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What operators keep in a Python worker between tasks: a function for each operator that lets go of it.
KEPT: dict[str, object] = {}


def enter(operator: str) -> None:
    """At the start of a task: a worker process serves all operators in turn, so what others have kept goes, and freed memory returns to the system."""
    for name, forget in KEPT.items():
        if name != operator:
            forget()
    give_back()


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: memory stays with the worker
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}
KEPT["hashes"] = _POWERS.clear


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, kept between calls in a worker."""
    if base not in _POWERS or len(_POWERS[base]) <= n:
        x = np.full(max(n, 1 << 16) + 1, base, dtype=np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of one buffer, all at once.

    A polynomial with an odd base modulo 2^64 over table-scrambled bytes from prefix sums; the factor of the start is divided out.
    """
    base = 0x5851F42D4C957F2D
    n = len(data)
    scrambled = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX[2]))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(scrambled[data] * _powers(base, n)[:n], out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), n)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(MIX[2]))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words (given by their hashes); len(words) - width + 1 of them."""
    n = max(len(words) - width + 1, 0)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(MIX[2])
        out += words[k:n + k]
    return mix(out + np.uint64(width))


def word_spans(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: the bytes, each word's start and end in them, and for each text the number
    of words before it (one more entry than texts).  Null texts have no words; ``lower`` turns A-Z to a-z."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0]:bounds[-1]] if raw is not None and len(bounds) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    finish = inside.copy()
    if len(data):
        edges = np.zeros(len(data) + 1, dtype=bool)
        edges[bounds] = True
        begins[1:] &= ~inside[:-1] | edges[1:-1]
        finish[:-1] &= ~inside[1:] | edges[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return data, starts, ends, np.searchsorted(starts, bounds)


def long_batches(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch of about ``most`` bytes in a text column (one row at least), so that memory stays bounded with long texts."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)).cumsum()
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def merged(parts: DataFrame, block: str, counts: str, kind: str = "<u2") -> np.ndarray | None:
    """Sums blocks of counters (binary, of one length) over all rows; blocks stream through, one accumulator each.

    The result, blocks times block length, is of a size that the caller fixes.
    """
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(raw.as_buffer(), dtype=kind).astype(np.uint64)
                total[k] = total[k] + x if k in total else x
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], ["k", "x"])

    rows = parts.select(block, counts).repartition(block).mapInArrow(run, "k int, x binary").collect()
    if not rows:
        return None
    size = len(rows[0]["x"]) // 4
    out = np.zeros((max(r["k"] for r in rows) + 1) * size, dtype=np.uint32)
    for r in rows:
        out[r["k"] * size:(r["k"] + 1) * size] = np.frombuffer(r["x"], dtype="<u4")
    return out


#: Cells of a membership bitmap, a power of two: a fixed size whatever the number of keys.
CELLS = 1 << 24


def cells(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of CELLS bits in which the cell of every key is set; with very many keys it lets everything pass, which costs time but no result."""
    import pyspark.sql.functions as F

    c = F.pmod(F.xxhash64(F.col(key)), F.lit(CELLS))
    rows = keys.select((c + 1).alias("c")).groupBy(F.bitmap_bucket_number("c").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits")).collect()
    out = np.zeros(CELLS // 8, dtype=np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def in_cells(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (cell & 7)) & 1 == 1


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the links; component: its smallest node.

    Alternating large-star and small-star rounds over the edges, which end when the edges are stars (a logarithmic number of rounds in
    practice).  Every round is stored; a hot node only takes part in grouped minima, combined before the shuffle, and in joins that can be split.
    """
    import pyspark.sql.functions as F

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = stored(large, "edges")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = stored(small, "edges")
        before, now = now, state(edges)
        if now == before:
            break
    top = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top.select("node", F.col("node").alias("component")))
