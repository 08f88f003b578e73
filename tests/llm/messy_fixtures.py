from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, shard int, spans string, node long"


def words(n: int, seed: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


def document(doc_id, text, source="a"):
    """A row with columns whose names clash with those of results."""
    return (doc_id, text, "en", source, len(text or ""), -1, -2, -3, "own", -4)


@pytest.fixture(scope="session")
def messy_rows():
    """NULLs, empty and blank texts, very short and very long texts, copies, near copies, repeated rows, NULL ids, ties."""
    base, long = words(120, 1), words(30000, 2)
    near = base.split()
    near[60] = "changed"
    return [
        document(1, None), document(2, ""), document(3, " \n\t "), document(4, "one"), document(5, "One, two; THREE four"),
        document(6, base), document(7, base), document(8, " ".join(near), "b"), document(9, base.upper(), None),
        document(10, long, "b"), document(11, long + " tail", "c"), document(12, words(50, 3) + " " + base),
        document(13, "é" * 50 + " ß 中文 \U0001f600 " + words(40, 4)), document(14, words(34, 5)), document(14, words(34, 5)),
        document(14, words(35, 6)), document(14, words(35, 6)), document(None, words(60, 7), None), document(None, None, None),
        document(15, "x " * 200, "d"), document(16, "!!! ??? ..."),
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
