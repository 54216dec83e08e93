"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  Three letters in a row (a run of other characters counts as one gap symbol) are bound:
the first vector permuted twice, the second once, the third not, multiplied.  A document is the bundle (sum) of its n-gram vectors; a
language's prototype is the bundle of the unit vectors of labelled documents.  A document gets the language with the largest cosine.

Null texts, and texts without a letter, get ``und`` and score 0.  Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, M64, MIX, enter, long_batches, mix

DIMENSIONS = 1024
#: Labelled documents that the prototypes are bundled from, at most (those with the smallest id hashes).
TRAINING_DOCUMENTS = 20_000
#: Documents of chance that may pass as some language, and as the language of their own label (shares).
CHANCE, CHANCE_LABELLED = 1e-5, 0.01
UNKNOWN = "und"
GAP = 32


class _Letters:
    """Folding of code points and the letters' vectors; one for each worker process."""

    def __init__(self, dimensions: int):
        self.d = dimensions
        self.fold = np.full(0x110000, GAP, dtype=np.int32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                self.fold[c] = ord(low) if len(low) == 1 else c
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            bits = mix(np.arange(self.d, dtype=np.uint64) + np.uint64((code + 1 << 20) * MIX[2] & M64)) & np.uint64(1)
            self.vectors[code] = (bits.astype(np.int8) * 2 - 1)
        return self.vectors[code]


_LETTERS: dict[int, _Letters] = {}
KEPT["language"] = _LETTERS.clear


def _letters(dimensions: int) -> _Letters:
    if dimensions not in _LETTERS:
        _LETTERS[dimensions] = _Letters(dimensions)
    return _LETTERS[dimensions]


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row for each text: the sum of the vectors of all its n-grams (all zero without a letter)."""
    own = _letters(dimensions)
    codes, doc = [], []
    for i, t in enumerate(texts):
        x = own.fold[np.frombuffer(f" {t or ''} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        x = x[np.concatenate([[True], (x[1:] != GAP) | (x[:-1] != GAP)])]
        codes.append(x)
        doc.append(np.full(len(x), i, dtype=np.int64))
    x, doc = np.concatenate(codes or [np.zeros(0, np.int32)]), np.concatenate(doc or [np.zeros(0, np.int64)])
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    whole = np.flatnonzero(doc[2:] == doc[:-2]) if len(x) > 2 else np.zeros(0, np.int64)
    if not len(whole):
        return out
    letters, own_id = np.unique(x, return_inverse=True)
    n = len(letters)
    grams = (own_id[whole].astype(np.int64) * n + own_id[whole + 1]) * n + own_id[whole + 2]
    if n ** 3 <= 4_000_000:
        used = np.flatnonzero(np.bincount(grams, minlength=1))
        place = np.zeros(n ** 3, dtype=np.int64)
        place[used] = np.arange(len(used))
        at = place[grams]
    else:
        used, at = np.unique(grams, return_inverse=True)
    third = np.stack([own.vector(int(c)) for c in letters])
    first, second = np.roll(third, 2, axis=1), np.roll(third, 1, axis=1)
    counts = np.bincount(doc[whole] * len(used) + at, minlength=len(texts) * len(used)).reshape(len(texts), len(used)).astype(np.float32)
    for lo in range(0, len(used), 8192):
        part = used[lo:lo + 8192]
        bound = first[part // (n * n)] * second[part // n % n] * third[part % n]
        out += counts[:, lo:lo + 8192] @ bound.astype(np.float32)
    return out


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of about 128 KB of text, with the bundles of their texts and their lengths as vectors."""
    enter("language")
    for whole in batches:
        for b in long_batches(whole, whole.schema.names[text], 128 << 10):
            v = bundles(b.column(text).to_pylist())
            yield b, v


def learn(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", most: int = TRAINING_DOCUMENTS) -> dict[str, np.ndarray]:
    """A unit prototype for each label, from at most ``most`` labelled documents with text, chosen by the hash of the key.

    One vector for each label and task is summed on the executors; the labels' vectors reach the driver.
    """
    known = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.xxhash64(F.col(key)).alias("h"), F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    chosen = known.select("h").orderBy("h").limit(most).agg(F.max("h").alias("top")).first()["top"]
    if chosen is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b, v in _slices(batches, 1):
            unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            names = np.array(b.column(0).to_pylist(), dtype=object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + unit[names == name].sum(0, dtype=np.float64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["label", "total"])

    parts = known.filter(F.col("h") <= chosen).select("label", "text").mapInArrow(run, "label string, total array<double>")
    summed = parts.select("label", F.posexplode("total").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy("label").collect()
    out = {}
    for r in rows:
        v = np.array([x["x"] for x in r["v"]])
        if (size := np.linalg.norm(v)) > 0:
            out[r["label"]] = (v / size).astype(np.float32)
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the language and its cosine (0 at least)."""
    spark = docs.sparkSession
    names = sorted(prototypes)
    sent = spark.sparkContext.broadcast(np.stack([prototypes[x] for x in names]) if names else np.zeros((0, DIMENSIONS), np.float32))
    kept = docs.drop(name, score)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, v in _slices(batches, at):
            size = np.linalg.norm(v, axis=1)
            lettered = size > 0
            if names:
                cosine = (v @ sent.value.T) / np.maximum(size, 1e-9)[:, None]
                best = cosine.argmax(1)
                top = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                picked = [names[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
            else:
                top, picked = np.zeros(len(size)), [UNKNOWN] * len(size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(picked, pa.string()), pa.array(top.astype(np.float64))], [*b.schema.names, name, score])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{name}` string, `{score}` double")


def remainder(key: str, by: int):
    """crc32 of the key as text, modulo ``by``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def digest(docs: DataFrame) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    found = learn(docs.filter(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")), found).drop("text")


def chance_level(prototypes: int, share: float, dimensions: int = DIMENSIONS) -> float:
    """The cosine that the best of so many prototypes exceeds by chance in a share of texts: each cosine is normal with a deviation of 1 / sqrt(dimensions)."""
    return NormalDist().inv_cdf(1 - share / max(prototypes, 1)) / dimensions ** 0.5


def kept_languages(docs: DataFrame, label: str = "lang") -> DataFrame:
    """The documents nearer to a language than chance; the columns of ``docs``.

    A document whose label is the language found needs to be nearer than chance to that one only; short texts of a language are not far above it.
    """
    found = learn(docs, label)
    tagged = identify(docs.select("*"), found, name="_language", score="_cosine")
    own = F.coalesce(F.col(label).cast("string") == F.col("_language"), F.lit(False))
    least = F.when(own, chance_level(1, CHANCE_LABELLED)).otherwise(chance_level(len(found), CHANCE))
    return tagged.filter((F.col("_language") != UNKNOWN) & (F.col("_cosine") >= least)).select(*docs.columns)
