import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, documents, table
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import packing
from tidewatch.llm.queries import vocabulary


def padding(n, length, shortest=1):
    return 0 if n & (n - 1) == 0 and n >= shortest else length - n


def brute(at, penalty, length, shortest):
    """Least cost over all cuts, looking at every pair of places."""
    cost = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        sizes = ((at[j] - at[i], cost[i]) for i in range(j))
        cost[j] = min(c + padding(n, length, shortest) for n, c in sizes if n <= length) + penalty[j] + packing.SEQUENCE
    return cost[-1]


@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from([0, 4, 16])), min_size=1, max_size=60), st.sampled_from([12, 16, 21, 64]), st.sampled_from([1, 4]))
@settings(max_examples=300, deadline=None)
def test_cuts_have_least_cost(steps, length, shortest):
    at, penalty = np.array([0, *np.cumsum([n for n, _ in steps])]), np.array([0, *(p for _, p in steps)])
    chosen, cost = packing.best_cuts(at, penalty, length, shortest)
    assert cost == brute(at.tolist(), penalty.tolist(), length, shortest)
    sizes = np.diff(at[chosen])
    assert chosen[0] == 0 and chosen[-1] == len(at) - 1 and (sizes > 0).all() and (sizes <= length).all()
    assert cost == sum(padding(n, length, shortest) for n in sizes.tolist()) + penalty[chosen].sum() + packing.SEQUENCE * len(sizes)


def test_cuts_stand_at_ends_sentences_and_in_long_sentences():
    stops = np.zeros(10, dtype=bool)
    stops[9] = True
    ids = np.array([1, 2, 9, 3] + [4] * 10 + [9] + [4] * 100 + [9, 9, 1])
    at, penalty = packing.possible_cuts(ids, np.array([4, 118]), stops, step=24)
    # of 3 and 15, in one step, the last stays; of 116 and 117 too
    assert dict(zip(at.tolist(), penalty.tolist())) == {0: 0, 4: 0, 15: packing.SENTENCE, 63: packing.ANYWHERE, 111: packing.ANYWHERE, 117: packing.SENTENCE, 118: 0}


def check(rows, pieces, length):
    """Every id in exactly one piece, sequences gapless and in document order; returns the share of padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    want = sorted(([] if k is None else [k], [*t.encode(text or "", add_special_tokens=False).ids, 1]) for k, text, *_ in rows)
    pieces = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    assert sorted({r["sequence_id"] for r in pieces}) == list(range(len({r["sequence_id"] for r in pieces})))
    got, filled = [], {}
    for r in pieces:
        assert r["offset"] == filled.get(r["sequence_id"], 0) and r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        filled[r["sequence_id"]] = r["offset"] + r["length"]
        if r["start"] == 0:
            got.append(([] if r["doc_id"] is None else [r["doc_id"]], []))
        assert r["start"] == len(got[-1][1])
        got[-1][1].extend(r["ids"])
        if r["start"] + r["length"] == r["doc_tokens"]:
            assert len(got[-1][1]) == r["doc_tokens"]
    assert [k for k, _ in got] == sorted(k for k, _ in got)
    assert sorted(got) == want
    assert max(filled.values()) <= length
    return sum(padding(n, length) for n in filled.values()) / sum(filled.values())


@pytest.mark.parametrize("length, block", [(2048, 1 << 20), (64, 300)])
def test_pieces_rebuild_all_documents(spark, monkeypatch, length, block):
    """Nulls, empty and very long texts, rows that repeat, a null key; blocks smaller than documents."""
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "SHORTEST", min(256, length // 8))
    rows = documents() + [(None, "no key here.", None, None)]
    share = check(rows, packing.pack(table(spark, rows), vocabulary(), length).collect(), length)
    assert share < 0.1


def test_one_key_holds_most_rows(spark):
    """Rows that repeat one key are dealt over ranges; other keys stay in order around them."""
    r = random.Random(5)
    rows = [(7, " ".join(f"w{r.randint(0, 99)}." for _ in range(40)), None, None) for _ in range(200)] + [(i, f"text {i}", None, None) for i in range(15)]
    df = table(spark, rows)
    pieces = packing.pack(df, vocabulary()).collect()
    assert check(rows, pieces, 2048) < 0.1  # four short ranges, each with a short end


def test_empty_table(spark):
    assert packing.digest(spark.createDataFrame([], SCHEMA), vocabulary()).count() == 0
