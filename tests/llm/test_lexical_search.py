"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from messy_fixtures import messy, messy_rows, nothing, words  # noqa: F401

from cohortline.llm import lexical_search
from cohortline.llm.lexical_search import Block, Terms, best_documents, search
from cohortline.llm.text import ALNUM, chunks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_Z = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(A_Z))


def ranking(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * len(held) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i, score))
        scored.sort(key=lambda s: s[:2] + ((s[2],) if s[2] is not None else ()))
        out += [(item, rank, s[2], s[3]) for rank, s in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(messy_rows):
    base = messy_rows[5][1].split()
    return [(1, " ".join(base[20:60])), (2, "one"), (3, "three FOUR x"), (None, " ".join(base[:9])), (4, None), (5, ""), (1, "中文"), (6, messy_rows[9][1][-900:]), (2, "one"), (7, "absent")]


@pytest.mark.parametrize("block_terms", [lexical_search.BLOCK_TERMS, 40])
def test_ranking_equals_brute_force(spark, messy, messy_rows, items, block_terms):
    found = search(messy, spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms)
    assert rows(found) == ranking([r[:2] for r in messy_rows], items)


def test_many_blocks_and_copies(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(900)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)]  # many copies: ties are ordered by id
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=12))) for i in range(25)] + [(99, docs[7][1])]
    found = search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == ranking(docs, items)


def test_ids_and_names_of_other_kinds(spark):
    docs = spark.createDataFrame([("b", "alpha beta", 1, 2.0), ("a", "alpha beta", 3, 4.0), (None, "alpha", 5, 6.0)], "id string, body string, rank int, score double")
    items = spark.createDataFrame([("q", "BETA"), ("p", "alpha")], "q string, text string")
    found = search(docs, items, k=2, doc_id="id", text="body", item="q")
    assert found.columns == ["q", "rank", "id", "score"]
    assert [(r["q"], r["rank"], r["id"]) for r in found.orderBy("q", "rank").collect()][-2:] == [("q", 1, "a"), ("q", 2, "b")]


def test_empty_tables(spark, messy, nothing, items):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    assert search(messy, none).count() == search(nothing, some).count() == search(nothing, none).count() == 0


def test_accumulators_end_when_the_rest_cannot_win():
    """One rare term decides: the common term's documents get no accumulators, and the survivors' scores are exact."""
    texts = ["rare common"] * 12 + [f"common filler{i}" for i in range(500)]
    chunk = next(chunks(pa.array(texts), ALNUM, lower=True))
    hashes = np.unique(chunk.word_hashes()[:2])
    rare = int(np.flatnonzero(hashes == chunk.word_hashes()[0])[0])
    block = Block(Terms(hashes, [], 512, 1024, np.where(np.arange(2) == rare, 9000, 1)), chunk)
    docs, scores, created = best_documents(block, np.array([rare, 1 - rare]), np.zeros(0, np.int64), 10)
    assert created == 12 and docs.tolist() == list(range(12))
    assert set(scores.tolist()) == {int(block.of(rare)[1][0] + block.of(1 - rare)[1][0])}
