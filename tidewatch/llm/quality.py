"""Quality by compression: two zstandard dictionaries, one from good and one from bad labelled text.

Text is cut into pieces of equal size and every piece is compressed with either dictionary, so that the dictionaries count as much at
the end of a long text as at its start.  The evidence is the difference of the two sizes over their sum, and beside it the logarithm of
their sum over the text's size, which tells text that repeats itself (it shrinks alike with either).  A logistic curve fitted on
labelled documents that the dictionaries have not seen turns both into a score.  Null and empty texts have evidence 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_batches
from .language import remainder

#: Labelled documents of each label that are used at most (smallest id hashes), and the longest text, in bytes, that may be among them.
#: Together they bound what the driver gets.
TRAINING_DOCUMENTS, TRAINING_BYTES = 2_500, 20_000
PIECE, DICTIONARY, LEVEL = 2_048, 64 << 10, 3


def _pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


class Compressor:
    """Evidence of texts, for two dictionaries (bytes)."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.tools = []
        for raw in (good, bad):
            own = zstandard.ZstdCompressionDict(raw)
            own.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False))

    def evidence(self, text: str | None) -> tuple[float, float]:
        pieces = _pieces(text)
        good, bad = (sum(len(t.compress(p)) for p in pieces) for t in self.tools)
        return ((bad - good) / (bad + good), math.log((bad + good) / (2 * sum(map(len, pieces))))) if pieces else (0.0, 0.0)


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or, of too little text for training, its last bytes as they are."""
    import zstandard

    samples = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Slopes and, last, the intercept by Newton steps, with a small penalty on the slopes."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.concatenate([x / scale, np.ones((len(x), 1))], axis=1)
    penalty = np.array([1e-2] * x.shape[1] + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        w = w - np.linalg.solve(h, a.T @ (p - y) + penalty * w)
    return np.append(w[:-1] / scale, w[-1])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """Dictionaries and curve.  At most TRAINING_DOCUMENTS texts of each label, none longer than TRAINING_BYTES, reach the driver.

    Of these, half train the dictionaries and half the curve, then the other way round.  Without both labels there is no evidence: every score is the share of label 1 (0.5 without labels).
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    have = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull() & (F.octet_length("text") <= TRAINING_BYTES))
    pairs = have.select("key").join(known, "key").withColumn("h", F.xxhash64("key"))
    tops = []
    for value in (0, 1):
        top = pairs.filter(F.col("label") == value).select("h").orderBy("h").limit(TRAINING_DOCUMENTS).agg(F.max("h").alias("top")).first()["top"]
        tops.append(top)
    keep = F.lit(False)
    for value, top in enumerate(tops):
        if top is not None:
            keep = keep | ((F.col("label") == value) & (F.col("h") <= top))
    rows = have.join(pairs.filter(keep).dropDuplicates(["key"]), "key").orderBy("h").limit(4 * TRAINING_DOCUMENTS).select("label", "text", "h").collect()
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return {"dictionaries": None, "curve": np.zeros(3), "prior": float(y.mean()) if len(y) else 0.5}
    half = np.array([r["h"] & 1 for r in rows])

    def trained(part: np.ndarray) -> tuple[bytes, bytes]:
        return tuple(dictionary([r["text"] for r, ok, v in zip(rows, part, y) if ok and v == want]) for want in (1, 0))

    x = np.zeros((len(y), 2))
    for side in (0, 1):
        tool = Compressor(*trained(half != side))
        for i in np.flatnonzero(half == side):
            x[i] = tool.evidence(rows[i]["text"])
    return {"dictionaries": trained(np.ones(len(y), dtype=bool)), "curve": logistic(x, y), "prior": float(y.mean())}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, ``evidence``, ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("evidence", "score", "predicted")
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        tool = Compressor(*m["dictionaries"]) if m["dictionaries"] else None
        for whole in batches:
            for b in long_batches(whole, text):
                x = np.array([tool.evidence(t) if tool else (0.0, 0.0) for t in b.column(at).to_pylist()]).reshape(-1, 2)
                p = 1 / (1 + np.exp(-np.clip(x @ m["curve"][:2] + m["curve"][2], -500, 500))) if tool else np.full(len(x), m["prior"])
                cols = [c for i, c in enumerate(b.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(x[:, 0]), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                                 [*(n for i, n in enumerate(b.schema.names) if i != at), "evidence", "score", "predicted"])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text)
                           + ", evidence double, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = learn(docs.filter(~held), labels.filter(~held))
    return score(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")), model).drop("evidence")
