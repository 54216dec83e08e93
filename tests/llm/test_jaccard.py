import random

import pytest
from helpers import SCHEMA, documents, table

from tidewatch.llm import jaccard


def brute(rows, percent, width):
    sets, parent = {}, {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent,width", [(85, 4), (80, 5), (50, 2), (100, 3)])
def test_equals_brute_force(spark, percent, width):
    got = jaccard.join(table(spark), percent=percent, width=width).collect()
    want = brute(documents(), percent, width)
    assert len(got) == len(documents())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("edge", [1, 20, 256])
def test_boundary_never_changes_the_result(spark, monkeypatch, edge):
    monkeypatch.setattr(jaccard, "boundary", lambda *a, **k: edge)
    got = jaccard.join(table(spark)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(documents(), 85, 4)


def test_boundary_follows_cost():
    assert jaccard.boundary({5: 10, 200: 10}, 2.0, 85) <= 200
    assert jaccard.boundary({10: 100}, 50.0, 85) > 10


def test_chain_reaches_across_documents(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i:i + 30]), "en", "a") for i in range(12)]
    got = jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_representatives_and_empty_table(spark):
    kept = {r["doc_id"] for r in jaccard.representatives(table(spark)).collect()}
    assert kept == {i for i, (_, c) in brute(documents(), 85, 4).items() if i == c}
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dense,tile", [(1, 3), (2, 100)])
def test_tiles_give_the_same(spark, monkeypatch, dense, tile):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "TILE", tile)
    r = random.Random(8)
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{i}" if r.random() < 0.012 else w for w in base), "en", "a") for i in range(60)] + [(100 + d[0], *d[1:]) for d in documents()]
    got = jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 85, 4)
