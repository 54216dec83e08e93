"""Token ids as files: frequency-ranked ids, byte-aligned variable-length coding with separate control bytes.

A document is one row of two byte strings.  Ids are replaced by their rank in the corpus (the most frequent is 0), so nearly all take one byte.
``control`` has two bits per id, four ids to a byte, first id lowest: the number of bytes less one.  ``data`` has the bytes,
low byte first.  The decoder looks lengths and offsets of four ids up in tables of 256 rows.

The vocabulary is bounded (one row for each id of the tokenizer), which bounds the rank table that is sent to all tasks.
"""

from __future__ import annotations

import itertools
import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, enter, long_batches, partitions, stored

END_ID = 1
#: Pieces kept with their ids in a Python worker; beyond that the store starts anew (this bounds memory, not the result).
CACHED_PIECES = 1_000_000
#: The normaliser and splitter of the tokenizer whose texts ``Coder`` cuts itself.  Any other file gets whole texts.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Bytes of text cut up at once, about: small enough for a core's own cache.
SLICE = 1 << 20
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of single bytes, and whether a byte after 0xC3 ends a Latin letter."""
    kind = np.full(256, ODD, np.uint8)
    for x in range(33, 127):
        kind[x] = LETTER if chr(x).isalpha() else DIGIT if chr(x).isdigit() else OTHER
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[ord("'")] = ODD
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    latin = np.zeros(256, bool)
    latin[0x80:0xC0] = True
    latin[[0x97, 0xB7]] = False
    return kind, low, latin


_KIND, _LOW, _LATIN = _tables()


class Items:
    """Texts cut into items for a tokenizer of the known kind: pieces of plain words (lower case, printable ASCII and Latin letters with accents), and odd words as they are.

    All items of all texts, in order: ``raw`` (Arrow dictionary of byte strings), ``odd`` for each distinct one, and ``bounds``, the number of items before each text.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        edge = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[edge[0]:edge[-1]] if body is not None else np.zeros(0, np.uint8)
        edge = edge - edge[0]
        n = len(data)
        kind, low = _KIND[data], _LOW[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_LATIN[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] |= 0x20  # capital letters with accents are 32 below their small ones
        low[lead[data[lead + 1] == 0x9F] + 1] = 0x9F  # sharp s is small already
        angle = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        kind[angle] = ODD
        inside = kind != SPACE
        fresh = np.ones(n + 1, bool)  # a text starts here
        fresh[1:n] = False
        fresh[edge] = True
        word = inside.copy()
        word[1:] &= ~inside[:-1] | fresh[1:n]
        number = np.cumsum(word, dtype=np.int32) - 1
        oddness = np.zeros(number[-1] + 1 if n else 0, bool)
        oddness[number[kind == ODD]] = True
        strange = inside & oddness[number] if n else inside
        begin = word.copy()
        begin[1:] |= inside[1:] & ~strange[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        starts = np.flatnonzero(begin)
        kept = np.cumsum(inside, dtype=np.int64)
        offsets = np.append(kept[starts] - 1, kept[-1:])
        low[strange] = data[strange]
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]
        self.raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        self.odd = np.zeros(len(self.raw.dictionary), bool)
        self.odd[self.raw.indices.to_numpy()[strange[starts]]] = True
        self.bounds = np.searchsorted(starts, edge)


class Coder:
    """Ids of whole texts.  The known kind of tokenizer never joins what white space or its splitter separates, so pieces are looked up and only new ones
    go to its model; odd words go through its whole pipeline.  Texts of any other tokenizer go through its pipeline whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        own = json.loads(self.tokenizer.to_str())
        plain = own["model"].get("type") == "BPE" and not own["model"].get("dropout") and not own["post_processor"] and not own["truncation"] and not own["padding"]
        # an added token is known by its "<|"; any other kind could stand inside a plain word
        self.known = plain and all(own[k] == v for k, v in KNOWN.items()) and all(t["content"].startswith("<|") for t in own["added_tokens"])
        mark = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.known else None
        self.letters = {i: "".join(x for x, _ in mark(chr(i))) for i in [*range(33, 127), *range(0xC0, 0x100)]} if self.known else {}
        self.pieces: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _ids(self, raw: list[bytes], odd: np.ndarray) -> list[bytes]:
        """Ids of distinct items.  What is not asked for while half the store fills goes."""
        if len(self.pieces) > CACHED_PIECES // 2:
            self.before, self.pieces = self.pieces, {}
        kept, before, tokenize, letters = self.pieces, self.before, self.model.tokenize, self.letters
        strange = []
        for w in [w for w in raw if w not in kept]:
            if w in before:
                kept[w] = before[w]
            else:
                strange.append(w)
        if strange:
            whole = set(itertools.compress(raw, odd.tolist()))
            odd_new = [w for w in strange if w in whole]
            for w in strange:
                if w not in whole:
                    kept[w] = array("I", [t.id for t in tokenize(w.decode().translate(letters))]).tobytes()
            for w, e in zip(odd_new, self.tokenizer.encode_batch_fast([w.decode() for w in odd_new], add_special_tokens=False)) if odd_new else ():
                kept[w] = array("I", e.ids).tobytes()
        return [kept[w] for w in raw]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: none), and the number of ids before each text (one entry more than texts)."""
        if not self.known:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)] if len(texts) else []
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
            return np.fromiter((i for x in lists for i in x), np.uint32, int(ends[-1])), ends
        items = Items(texts)
        raw, at = items.raw.dictionary.to_pylist(), items.raw.indices.to_numpy()
        got = self._ids(raw, items.odd)
        # a slice of texts has fewer than 2^31 ids
        size = np.fromiter(map(len, got), np.int32, len(got)) // 4
        ids = np.frombuffer(b"".join(got), dtype="<u4")
        begin = np.cumsum(size, dtype=np.int32) - size
        count = size[at]
        ends = np.zeros(len(at) + 1, dtype=np.int32)
        np.cumsum(count, out=ends[1:])
        return ids[np.arange(ends[-1], dtype=np.int32) + np.repeat(begin[at] - ends[:-1], count)], ends[items.bounds].astype(np.int64)


_CODERS: dict[str, Coder] = {}
KEPT["tokens"] = _CODERS.clear


def coder(path: str) -> Coder:
    """One for each worker process and vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


# ---------------------------------------------------------------- the coding

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_OFFSETS = np.concatenate([np.zeros((256, 1), int), _LENGTHS.cumsum(1)[:, :3]], axis=1)
_TOTALS = _LENGTHS.sum(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(values, dtype="<u4")
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[:len(v)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    kept = np.arange(4) < length[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again, four at a time from the tables.  Raises ValueError on bytes that don't fit together."""
    c = np.frombuffer(control, dtype=np.uint8)
    if len(c) != -(-n // 4):
        raise ValueError("wrong number of control bytes")
    start = np.zeros(len(c), dtype=np.int64)
    np.cumsum(_TOTALS[c][:-1], out=start[1:])
    at = (start[:, None] + _OFFSETS[c]).ravel()[:n]
    length = _LENGTHS[c].ravel()[:n]
    if n and at[-1] + length[-1] != len(data) or not n and data:
        raise ValueError("wrong number of data bytes")
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# ---------------------------------------------------------------- the jobs

def encoded(code: Coder, texts: pa.Array, end_id: int, kind: np.dtype) -> tuple[np.ndarray, pa.Array]:
    """Number of ids and ids (bytes, ``kind`` each) of every text, with the end id."""
    flat, ends = code.flat(texts)
    ids = np.insert(flat.astype(kind), ends[1:], end_id)
    ends = ends + np.arange(len(ends))
    return np.diff(ends), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends * kind.itemsize), pa.py_buffer(ids)]).cast(pa.binary())


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """(key, n_tokens, ids): little-endian ids of each whole text with the end id; a null text counts as empty.  Other columns are left out, but for
    ``order`` (long), as ``place``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        code = coder(path)
        kind = np.dtype("<u2" if code.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        for whole in batches:
            for b in long_batches(whole, "text", SLICE):
                n, lists = encoded(code, b.column(1), end_id, kind)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.full(len(n), kind.itemsize), pa.int32()), lists, *b.columns[2:]],
                                                 ["key", "n_tokens", "width", "ids", *b.schema.names[2:]])

    place = [F.col(order).cast("long").alias("place")] if order else []
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *place).mapInArrow(
        run, "key long, n_tokens long, width int, ids binary" + ", place long" * len(place))


def ranks(tokens: DataFrame, floor: tuple[int, ...] = (END_ID,)) -> list[int]:
    """All ids of the corpus, most frequent first (ties: smaller id).  One row for each id reaches the driver: bounded by the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for whole in batches:
            for b in long_batches(whole, "ids"):
                for width in set(b.column(0).to_pylist()):
                    rows = b.column(1).filter(pc.equal(b.column(0), width))
                    # all ids of the slice at once: a count of its own for each document would be as long as the vocabulary
                    c = np.bincount(np.frombuffer(b"".join(x.as_buffer() for x in rows), dtype=f"<u{width}"))
                    if len(c) > len(counts):
                        counts = np.pad(counts, (0, len(c) - len(counts)))
                    counts[:len(c)] += c
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    rows = tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    return [r["id"] for r in rows] or list(floor)


@dataclass
class TokenFiles:
    """``documents``: bucket, key, n_tokens, control, data, and place where an order was given; buckets and the keys (or places) in them ascend.
    ``order``: the id of each rank."""

    documents: DataFrame
    order: list[int]


def write_files(docs: DataFrame, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", order_by: str | None = None) -> TokenFiles:
    """Tokenizes all documents once, ranks the ids by their counts over all of them, and writes the coded documents in ascending order of the key, or
    of the column ``order_by`` (long).

    One shuffle, of coded bytes.  Buckets are quantile ranges of the key or that column (null keys: the first bucket, first in it); a bucket is a folder with one
    sorted file.  Rows that repeat a key stay, next to each other.  No rows: empty files.
    """
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, path, end_id, key, text, order_by), "ids")
    by, more = ("place", ["place"]) if order_by else ("key", [])
    order = ranks(tokens, (end_id,))
    n = partitions(spark)
    cuts = tokens.agg(F.percentile_approx(by, [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    cuts = np.array(sorted(set(cuts)), dtype=np.int64) if n > 1 else np.zeros(0, np.int64)
    place = np.zeros(max(order) + 1, dtype=np.uint32)
    place[order] = np.arange(len(order))
    sent = spark.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in long_batches(whole, "ids"):
                out = [pack(sent.value[np.frombuffer(x.as_buffer(), dtype=f"<u{w}")]) for w, x in zip(b.column(2).to_pylist(), b.column(3))]
                bucket = np.searchsorted(cuts, b.column(by).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), b.column(0), b.column(1), pa.array([c for c, _ in out], pa.binary()),
                                                  pa.array([d for _, d in out], pa.binary()), *b.columns[4:]], ["bucket", "key", "n_tokens", "control", "data", *more])

    coded = tokens.select("key", "n_tokens", "width", "ids", *more).mapInArrow(run, "bucket int, key long, n_tokens long, control binary, data binary" + ", place long" * len(more))
    files = coded.repartition(n, "bucket").sortWithinPartitions("bucket", F.col(by).asc_nulls_first())
    return TokenFiles(stored(files, "tokens", "bucket"), order)


def read_files(files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """Decodes the files: bucket, key, n_tokens, ids_crc32, the ids themselves (array of int) if asked for, and place where the files have it."""
    spark = files.documents.sparkSession
    sent = spark.sparkContext.broadcast(np.array(files.order, dtype="<u4"))
    more = [c for c in files.documents.columns if c == "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in long_batches(whole, "data"):
                crc, lists = [], []
                for n, c, d in zip(b.column(2).to_pylist(), b.column(3), b.column(4)):
                    ids = sent.value[unpack(c.as_py(), d.as_py(), n)]
                    crc.append(zlib.crc32(ids.tobytes()))
                    lists.append(ids.astype(np.int32) if with_ids else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64()), pa.array(lists, pa.list_(pa.int32())), *b.columns[5:]],
                                                 ["bucket", "key", "n_tokens", "ids_crc32", "ids", *more])

    got = files.documents.select("bucket", "key", "n_tokens", "control", "data", *more).mapInArrow(
        run, "bucket int, key long, n_tokens long, ids_crc32 long, ids array<int>" + ", place long" * len(more))
    return got if with_ids else got.drop("ids")


def starts(read: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all rows before, in (bucket, key) order, or (bucket, place) where there is one.  A running sum in each bucket and an offset from the bucket totals
    (one row for each bucket); nulls first, repeated keys in the order of their checksum."""
    per = read.groupBy("bucket").agg(F.sum("n_tokens").alias("total"))
    before = per.select("bucket", F.coalesce(F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("bucket").orderBy(*([F.col("place").asc_nulls_first()] if "place" in read.columns else []), F.col("key").asc_nulls_first(), "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return read.withColumn("inner", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(before, "bucket").withColumn("start", F.col("inner") + F.col("before")).drop("inner", "before")


def digest(docs: DataFrame, path: str, end_id: int = END_ID, order_by: str | None = None) -> DataFrame:
    """Writes the files, reads them back, and gives doc_id, start, n_tokens, ids_crc32 of every document."""
    read = stored(read_files(write_files(docs, path, end_id, order_by=order_by)), "decoded")
    return starts(read).select(F.col("key").alias("doc_id"), F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")
