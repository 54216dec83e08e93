import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, table
from pyspark.sql import functions as F

from tidewatch.llm import variants


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {word}


def brute(counts, factor=5):
    letters = sorted({c for w in counts for c in w})
    near = {w: sorted(edits(w, letters) & counts.keys()) for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def brute_words(rows, least_length=6, least_count=5, damaged=199):
    counts = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % damaged == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def vocabulary(seed=1, n=400):
    """Words over few letters, so that most have neighbours; ties in counts; a common beginning and end; very long words."""
    r = random.Random(seed)
    words = {"".join(r.choice("abé") for _ in range(r.randint(6, 8))) for _ in range(n)}
    words |= {"gemein" + "".join(r.choice("abc") for _ in range(3)) for _ in range(30)} | {"".join(r.choice("ab") for _ in range(3)) + "schaft" for _ in range(6)}
    long = "".join(r.choice("abcdefgh") for _ in range(3000))
    words |= {long, long[:-1], long[1:], long[:1500] + "z" + long[1500:], "a" * 90, "a" * 91, "a" * 92}
    return {w: r.choice([5, 5, 6, 25, 26, 125, 130, 700]) for w in words}


def test_suffix_ranks():
    r = random.Random(2)
    for n in (1, 2, 5, 60, 300):
        text = np.array([r.randint(0, 2) for _ in range(n)])
        assert variants.suffix_ranks(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_ranges_of_patterns():
    words = sorted(vocabulary(3, 60))[:60]
    index, text = variants.Index(words), "\0" + "\0".join(words) + "\0"
    for pattern in ("\0", "a", "ab", "\0a", "b\0", "\0" + words[7] + "\0", "zzz"):
        state = tuple(np.array([x]) for x in (0, 0, index.length))
        for i, c in enumerate(index.codes(pattern)):
            state = index.extend(state, np.array([c]), right=True)
        other = tuple(np.array([x]) for x in (0, 0, index.length))
        for c in reversed(index.codes(pattern)):
            other = index.extend(other, np.array([c]), right=False)
        assert state[2][0] == other[2][0] == sum(text.startswith(pattern, i) for i in range(len(text)))
        if state[2][0]:
            assert state[0][0] == other[0][0] and state[1][0] == other[1][0]


@pytest.mark.parametrize("shard, split", [(40_000, 40_000), (60, 20)])
def test_variants_equal_brute_force(spark, monkeypatch, shard, split):
    """Also with many small shards, and halves that are split."""
    monkeypatch.setattr(variants, "SHARD", shard)
    monkeypatch.setattr(variants, "SPLIT", split)
    monkeypatch.setattr(variants, "SIDE_BY_SIDE", 150)
    counts = vocabulary()
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(counts)


def test_words_and_digest(spark):
    r = random.Random(4)
    stock = list(vocabulary(5, 60)) + ["ÉCOLE×s", "Straße", "STRASSEN", "naïveté", "short"]
    rows = [(i, " ".join(r.choice(["{}", "{},", "«{}»", "{}7"]).format(r.choice(stock[:20]) if r.random() < 0.7 else r.choice(stock)) for _ in range(60)), None, None) for i in range(150)]
    rows += [(None, rows[0][1], None, None), (3, rows[3][1], None, None), (500, None, None, None), (501, "", None, None), (502, "12 -- 3", None, None)]
    counts = brute_words(rows)
    assert len(counts) > 40
    got = variants.digest(table(spark, rows).withColumn("word", F.lit("x")))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(counts)


def test_empty(spark):
    assert variants.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.digest(spark.createDataFrame([(1, "one", None, None)], SCHEMA)).count() == 0
