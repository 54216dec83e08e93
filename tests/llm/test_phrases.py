import hashlib

from helpers import SCHEMA, documents, prose, table

from tidewatch.llm import phrases


def brute(rows):
    seen, out = {}, {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j:j + 20])
            if seen.setdefault(k, (i, j)) != (i, j):
                gone[j:j + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, df=None):
    got = phrases.remove_repeats(df if df is not None else spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_equals_brute_force(spark):
    check(spark, documents(), table(spark))


def test_overlaps_periods_and_shared_passages(spark):
    p, q = prose(50, 45), prose(51, 25)
    w = p.split()
    rows = [(1, "a b c " * 30, None, None), (2, p + " " + q, None, None), (3, " ".join(w[5:33]) + " " + q + " tail", None, None), (4, "a b c " * 12 + " ".join(w[20:45]), None, None),
            (5, " ".join(w[10:29]), None, None), (6, " ".join(w[10:30]), None, None), (7, q + " " + q + " " + p, None, None)]
    check(spark, rows)


def test_shards_and_split_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 3)
    monkeypatch.setattr(phrases, "SPLIT", 2)
    monkeypatch.setattr(phrases, "SPLITTABLE", 10**9)
    check(spark, documents(), table(spark))


def test_kept_text(spark):
    got = {r["doc_id"]: r["kept_text"] for r in phrases.remove_repeats(table(spark), with_text=True).collect()}
    for i, (_, _, sha) in brute(documents()).items():
        assert hashlib.sha256(got[i].encode()).hexdigest() == sha


def test_empty_table(spark):
    assert phrases.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
