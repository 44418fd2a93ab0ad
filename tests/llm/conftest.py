import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("markbook.llm")

#: Columns that operators must carry along or leave alone, named like their own.
CLASHING = {
    "size": "'s'", "rank": "1", "score": "0.5", "group": "'g'", "key": "2", "c": "3", "a": "4", "b": "5", "n": "6",
    "s": "'t'", "x": "7", "step": "8", "block": "9", "copies": "10", "held_out": "'no'", "predicted": "11",
    "component_id": "12", "kept": "false", "digest": "'d'", "bands": "13", "ids": "14", "spans": "'p'", "dim": "15",
    "target": "16", "taken": "17", "chunk": "18", "train": "'x'", "floor": "19", "v": "20",
}


def with_clashes(df):
    return df.withColumns({k: F.expr(v) for k, v in CLASHING.items() if k not in df.columns})


WORDS = "the of and a to in is that for it as with on by at from und der die le la les por una ciel".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty, blank and long texts, repeated rows, near copies, odd characters."""
    base = [
        (1, "Mail jo.doe@mail.example.com or call +1 (509) 555-6973 now", "en", "s1"),
        (2, None, "en", "s1"),
        (3, "", None, "s2"),
        (4, " \t\n ", "fr", None),
        (5, prose(5, 60), "de", "s2"),
        (6, prose(5, 60) + " more", "de", "s2"),
        (7, prose(7, 40_000), "en", None),
        (8, "Card 4539578763621486, 10.0.0.1 and 300.1.1.1 \U0001f600 é", None, None),
        (9, "Card 4539578763621486, 10.0.0.1 and 300.1.1.1 \U0001f600 é", "es", "s3"),
        (5, prose(5, 60), "de", "s2"),
        (5, prose(5, 60), "de", "s2"),
        (None, "no id here", "en", "s3"),
        (None, None, None, None),
        (10, "one two", "en", "s3"),
    ]
    rows = base + [(100 + i, prose(100 + i % 17, 30 + i % 5), "en", f"s{i % 4}") for i in range(120)]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("long"))
    return with_clashes(df).cache()


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def vectors(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) * (1 + i % 7) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(40)]
    rows += [
        (400, None),
        (401, [0.0] * 8),
        (402, [float("nan")] + [1.0] * 7),
        (403, [float("inf")] + [1.0] * 7),
        (404, [None] + [1.0] * 7),
        (500, [1.0, 2.0]),
        (501, [2.0, 1.0]),
        (None, [1.0] * 8),
        (7, rows[7][1]),
    ]
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
