from collections import Counter

import regex
from helpers import SCHEMA, prose

from tidewatch.llm import leaks

ITEMS = "item_id long, text string, doc long, m int"


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for item, text, *_ in items:
        w = words(text)
        width = min(5, len(w))
        if not w:
            continue
        mine = [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]
        for doc, body, *_ in docs:
            d = words(body)
            h = [tuple(d[i:i + width]) for i in range(len(d) - width + 1)]
            n = min(len(mine), len(h))
            for s in range(len(h) - n + 1 if n else 0):
                same = sum((Counter(h[s:s + n]) & Counter(mine)).values())
                v = same / (n + len(mine) - same)
                if v >= 0.8 and v > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (v, s)
    return out


def test_equals_brute_force(spark):
    a, b, c = prose(1, 30), prose(2, 60), prose(3, 45)
    wb = b.split()
    items = [(1, a, 0, 0), (2, b, 0, 0), (3, None, 0, 0), (4, "", 0, 0), (5, "unique pair", 0, 0), (6, a, 0, 0), (7, "ha " * 30, 0, 0)]
    docs = [(1, prose(10, 40) + " " + a.upper() + ", " + prose(11, 9), "en", "s"), (2, " ".join(wb[:58]), None, None), (3, " ".join(wb[:50] + ["other"] + wb[51:]), None, None),
            (4, c, None, None), (5, None, None, None), (6, "", None, None), (7, "a unique pair here", None, None), (8, prose(12, 3000) + " " + b, None, None), (9, "ha " * 80, None, None),
            (10, " ".join(wb[:20] + ["x", "y"] + wb[20:]), None, None), (11, " ".join(wb[30:]), None, None), (12, b + " " + b, None, None), (1, prose(10, 40) + " " + a.upper() + ", " + prose(11, 9), "en", "s")]
    got = leaks.find(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in got} == brute(docs, items)
    kept = {r["doc_id"] for r in leaks.clean(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()}
    assert kept == {d[0] for d in docs} - {d for d, _ in brute(docs, items)}


def test_blocks_reach_every_fingerprint_within_the_radius():
    import random

    r = random.Random(4)
    for _ in range(300):
        x, flips = r.getrandbits(64), r.sample(range(64), leaks.RADIUS)
        y = x
        for f in flips:
            y ^= 1 << f
        assert any((((x ^ y) >> 8 * k) & 255) in leaks.VARIANTS for k in range(leaks.BLOCKS))


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, prose(1, 30), "en", "s")], SCHEMA)
    plan = leaks.find(docs, spark.createDataFrame([(1, prose(1, 30), 0, 0)], ITEMS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, prose(1, 30), "en", "s")], SCHEMA), spark.createDataFrame([], ITEMS)
    assert leaks.find(docs, none).count() == 0
    assert leaks.clean(docs, none).count() == 1
    assert leaks.find(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b c d e f", 0, 0)], ITEMS)).count() == 0
