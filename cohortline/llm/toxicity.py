"""Toxicity by a classifier chain: linear models in sequence, each fed with the probabilities of those before it.

Categories are label columns in a fixed order; the query uses ``low_quality`` and then ``toxic``, the two that the labels
have. A model sees the presence of words and word beginnings (hashes, no dictionary), four shares of the text, and the
log-odds of the earlier categories. For training those come from out-of-fold models, so a later model learns from
predictions as good as it will meet; the models in use are fitted on all training rows.

Fitting takes at most ``PER_CLASS`` labelled documents of each value of the last category, first by hash of the id and the
text; the intercepts are then corrected to the shares among all labels. Scoring covers every word of every document.

Defined results: texts without words are not toxic; labels that are NULL are left out of their category; a category with
only one value is constant; with no labels at all every probability is 0; rows with equal id, text and labels count once in
the fit, so an id that is repeated very often neither outweighs the others nor fills the driver; an empty table gives no
rows; input columns with the name of a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.frames import append_columns, without
from cohortline.llm.text import _BASE, _BYTE_CODES, ALNUM, Chunk, chunks, prefix_sums, run_hashes, signed
from cohortline.session import cut_lineage

PER_CLASS = 4000
FOLDS = 5
FEATURES = 256
LEAST = 5
RIDGE = 0.1
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.5


def _presence(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all words and word beginnings (in bytes), with repeats."""
    sums = prefix_sums(_BYTE_CODES[chunk.data], _BASE)
    rows = chunk.row_of_word()
    out_rows, out = [rows], [run_hashes(sums, chunk.starts, chunk.ends, _BASE)]
    for length in BEGINNINGS:
        longer = chunk.ends - chunk.starts > length
        start = chunk.starts[longer]
        out_rows.append(rows[longer])
        out.append(run_hashes(sums, start, start + length, _BASE) ^ np.uint64(length))
    return np.concatenate(out_rows), np.concatenate(out)


def _shares(chunk: Chunk, raw: np.ndarray) -> np.ndarray:
    """Symbols and capitals per byte, bytes per word, and the logarithm of the number of words."""
    at = chunk.offsets
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    size = np.maximum(np.diff(at), 1)
    words = np.maximum(chunk.counts, 1)
    inside = ALNUM[chunk.data]
    space = (raw <= 32) & ~inside
    return np.stack([total(~inside & ~space) / size, total((raw >= 65) & (raw <= 90)) / size, total(inside) / words / 10, np.log1p(chunk.counts) / 5], 1)


def _features(column: pa.Array):
    """Per chunk: number of rows, rows and hashes of features, shares."""
    plain = chunks(column, ALNUM)
    for chunk, raw in zip(chunks(column, ALNUM, lower=True), plain):
        rows, hashes = _presence(chunk)
        yield chunk, rows, hashes, _shares(chunk, raw.data)


@dataclass(frozen=True)
class Link:
    """One model of the chain: weights of hashes (sorted), of the shares and of earlier log-odds, and the intercept."""

    name: str
    hashes: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    intercept: float

    def log_odds(self, n: int, rows: np.ndarray, hashes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = dense @ self.dense + self.intercept
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            pair = np.unique(rows[hit].astype(np.int64) * len(self.hashes) + at[hit])
            out += np.bincount(pair // len(self.hashes), self.weights[pair % len(self.hashes)], n)
        return out


def _choose(rows: np.ndarray, codes: np.ndarray, y: np.ndarray, kinds: int) -> np.ndarray:
    """Features whose presence differs most between the classes (two-proportion z score)."""
    n = np.bincount(codes, minlength=kinds)
    pos = np.bincount(codes[y[rows] > 0], minlength=kinds)
    share = y.mean()
    z = (pos - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    z[n < LEAST] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    return np.sort(best[z[best] != 0])


def _matrix(kept: np.ndarray, n: int, rows: np.ndarray, codes: np.ndarray, dense: np.ndarray, kinds: int) -> np.ndarray:
    x = np.zeros((n, len(kept)))
    place = np.full(kinds + 1, -1, np.int32)
    place[kept] = np.arange(len(kept))
    at = place[codes]
    hit = at >= 0
    x[rows[hit], at[hit]] = 1
    return np.hstack([x, dense, np.ones((n, 1))])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept (last column) is free."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit_one(name: str, n: int, rows: np.ndarray, codes: np.ndarray, dense: np.ndarray, y: np.ndarray, kinds: int) -> Link:
    """A model whose features are codes; ``fit_chain`` turns them into hashes."""
    if len(y) == 0 or y.min() == y.max():
        return Link(name, np.zeros(0, np.int64), np.zeros(0), np.zeros(dense.shape[1]), 30.0 if len(y) and y.max() == 1 else -30.0)
    kept = _choose(rows, codes, y, kinds)
    w = _logistic(_matrix(kept, n, rows, codes, dense, kinds), y)
    return Link(name, kept, w[: len(kept)], w[len(kept) : -1], float(w[-1]))


def _part(mask: np.ndarray, rows: np.ndarray, codes: np.ndarray, dense: np.ndarray) -> tuple:
    place = (np.cumsum(mask) - 1).astype(np.int32)
    inside = mask[rows]
    return int(mask.sum()), place[rows[inside]], codes[inside], dense[mask]


def fit_chain(
    names: list[str], labels: np.ndarray, odds: list[float | None], rows: np.ndarray, codes: np.ndarray, kinds: np.ndarray, shares: np.ndarray
) -> list[Link]:
    """``labels``: one column per category, NaN where unknown. ``odds``: log-odds of each category among all labels.
    ``codes``: places in ``kinds``, the sorted hashes of all features that may be chosen."""
    n = len(labels)
    fold = np.arange(n) % FOLDS
    dense, chain = shares, []
    for k, name in enumerate(names):
        y = labels[:, k]
        known = ~np.isnan(y)
        # Out-of-fold log-odds of this category for the models after it.
        seen = np.zeros(n)
        for f in range(FOLDS):
            train = known & (fold != f)
            link = _fit_one(name, *_part(train, rows, codes, dense), y[train], len(kinds))
            size, *rest = _part(fold == f, rows, codes, dense)
            seen[fold == f] = link.log_odds(size, *rest)
        link = _fit_one(name, *_part(known, rows, codes, dense), y[known], len(kinds))
        share = y[known].mean() if known.any() else 0
        shift = odds[k] - np.log(share / (1 - share)) if 0 < share < 1 and odds[k] is not None else 0.0
        chain.append(Link(name, kinds[link.hashes], link.weights, link.dense, link.intercept + shift))
        dense = np.hstack([dense, np.clip(seen + shift, -10, 10)[:, None] / 5])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], per_class: int = PER_CLASS, id: str = "doc_id", text: str = "text") -> list[Link]:
    """Fit the chain on a bounded hash sample of labelled documents."""
    names = list(categories)
    named = labels.select(F.col(id).alias("_id"), *[c.cast("double").alias(n) for n, c in categories.items()])
    picked = [
        named.where(F.col(names[-1]) == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for value in (0, 1)
    ]
    sample = picked[0].unionByName(picked[1])
    counts = named.agg(*[F.avg(n).alias(n) for n in names]).first()
    odds = [float(np.log(s / (1 - s))) if (s := counts[n]) is not None and 0 < s < 1 else None for n in names]
    # Both broadcasts hold at most 2 * per_class rows of an id and a few numbers; so many rows of documents are fitted.
    keyed = docs.select(F.col(id).alias("_id"), F.col(text).alias("text")).withColumn("_text", F.xxhash64("text"))
    pairs = cut_lineage(keyed.drop("text").join(F.broadcast(sample), "_id").distinct())
    rows = [
        pairs.where(F.col(names[-1]) == value).orderBy(F.xxhash64("_id"), "_id", "_text", *names).limit(per_class) for value in (0, 1)
    ]
    rows = rows[0].unionByName(rows[1])
    texts = cut_lineage(keyed.join(F.broadcast(rows), ["_id", "_text"]).dropDuplicates(["_id", "_text", *names]).drop("_text"))

    def distinct(chunk: Chunk, rows: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(chunk.rows + 1))
        return [np.unique(hashes[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]

    def spread(batches):
        for batch in batches:
            for chunk, rows, hashes, _ in _features(batch.column("text")):
                every = np.concatenate(distinct(chunk, rows, hashes))
                yield pa.RecordBatch.from_arrays([pa.array(signed(every))], names=["hash"])

    # Features that too few rows of the sample have are never chosen; they stay out of the driver.
    counted = texts.select("text").mapInArrow(spread, "hash long").groupBy("hash").agg(F.count("*").alias("n"))
    often = counted.where(F.col("n") >= LEAST).select("hash").toArrow().column("hash").to_numpy()
    often = docs.sparkSession.sparkContext.broadcast(np.sort(often.astype(np.int64).view(np.uint64)))

    def run(batches):
        for batch in batches:
            for chunk, rows, hashes, shares in _features(batch.column("text")):
                own = batch.slice(chunk.first, chunk.rows)
                known = often.value
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                kept = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                sets = [x.tobytes() for x in distinct(chunk, rows[kept], at[kept].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [own.column("_id"), *(own.column(n) for n in names), pa.array(sets, pa.binary()), pa.array([s.tobytes() for s in shares], pa.binary())],
                    names=["_id", *names, "codes", "shares"],
                )

    kind = docs.schema[id].dataType.simpleString()
    ddl = f"_id {kind}, " + ", ".join(f"{n} double" for n in names) + ", codes binary, shares binary"
    found = texts.select("_id", *names, "text").mapInArrow(run, ddl).collect()
    missing = lambda v: (v is None, v if v is not None else 0)
    found.sort(key=lambda r: tuple(missing(v) for v in r[: 1 + len(names)]))  # the order of the rows is that of the folds
    sets = [np.frombuffer(r["codes"], np.int32) for r in found]
    rows = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    codes = np.concatenate([np.zeros(0, np.int32), *sets])
    shares = np.array([np.frombuffer(r["shares"]) for r in found]).reshape(-1, 4)
    known = np.array([[np.nan if r[n] is None else r[n] for n in names] for r in found], np.float64).reshape(-1, len(names))
    del found, sets
    return fit_chain(names, known, odds, rows, codes, often.value, shares)


def score(docs: DataFrame, chain: list[Link], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with ``p_<category>`` for each category and ``<last category>`` as a decision."""
    handle = docs.sparkSession.sparkContext.broadcast(chain)
    last = chain[-1].name

    def compute(batches):
        for batch in batches:
            parts = []
            for chunk, rows, hashes, dense in _features(batch.column(text)):
                p = np.zeros((chunk.rows, len(chain) + 1))
                for k, link in enumerate(handle.value):
                    z = link.log_odds(chunk.rows, rows, hashes, dense)
                    p[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    dense = np.hstack([dense, np.clip(z, -10, 10)[:, None] / 5])
                p[:, -1] = (p[:, -2] >= threshold) & (chunk.counts > 0)
                parts.append(p)
            p = np.concatenate([np.zeros((0, len(chain) + 1)), *parts])
            yield [*(pa.array(p[:, k]) for k in range(len(chain))), pa.array(p[:, -1] > 0)]

    ddl = ", ".join(f"p_{link.name} double" for link in chain) + f", {last} boolean"
    return append_columns(without(docs, [last, *(f"p_{x.name}" for x in chain)]), ddl, compute)


def categories() -> dict[str, F.Column]:
    """The chain over the given labels, in order."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels, categories()))
