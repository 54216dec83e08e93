"""Small tables for the corpus tests."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "tru", "sen", "vo", "bar") for b in ("n", "sta", "ri", "pel", "od", "quo")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents():
    """(doc_id, text, lang, source): nulls, empty and white-space texts, copies, near copies, a very long text, repeated passages and repeated rows."""
    base, passage = prose(1, 80), prose(2, 30)
    words = base.split()
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(words[:40] + ["changed"] + words[41:]), "en", "b"), (4, None, "en", "a"), (5, "", "en", None), (6, " \n\t ", None, "a"),
            (7, "one two", "en", "a"), (8, "ONE  two", "en", "a"), (9, prose(3, 60) + " " + passage + " " + prose(4, 20), "en", "a"), (10, passage + " " + prose(5, 50), "en", "c"),
            (11, passage + " x " + passage, "de", "a"), (12, prose(6, 6000), "en", "a"), (13, "was " * 90, "en", "a"), (14, "mail me: a.b@c.de or +49 (30) 123-4567, 10.0.0.255, 4111 1111 1111 1111!", "en", "a"),
            (15, "Ä ö ü ß — ’ 　 naïve café's 12½ <|endoftext|> é", "de", "b"), (16, "12 34 !!", None, "b"), (7, "one two", "en", "a")]
    rows += [(20 + i, " ".join(words[:i] + [f"w{i}"] + words[i + 1:]), "en", "a") for i in range(0, 12)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark, rows=None):
    """The rows in several partitions, with extra columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumn("n", F.lit(7)).withColumn("key", F.lit("k")).withColumn("class", F.lit(None).cast("string")).withColumn("start", F.lit(1.5))
