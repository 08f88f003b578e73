"""Ranked lexical search: term at a time over blocks of documents, with a limited set of accumulators.

Every task reads its documents in blocks. The postings of a block (which documents hold a query term, and what the term adds
to their scores) are built once and serve all items. An item's terms are taken rarest first. A document gets an accumulator
when a term first adds to it; as soon as all terms still to come cannot lift a new document to the kth partial score, no
accumulator is created any more, and the remaining terms only update the ones that exist, exactly. The k best so far go on
to the next block of the task, so the kth score rises and accumulators end earlier. A task returns at most k documents per
item; two windows merge them, the first over parts of the tasks.

Document counts, lengths and term frequencies are those of all documents (one earlier scan). Items are dealt into blocks of
about ``BLOCK_TERMS`` pairs of item and term, each block a pass of its own, so that what the driver and a task hold of the
items is bounded by that (or by the terms of one item, if that alone has more) and not by their number.

Defined results: NULL texts and texts without a term are in no ranking; rows of one item id are one item with the terms of
all; an item without terms, or without a document above 0, has no rows; repeated documents are ranked as rows of their own;
equal scores are ordered by the id, NULL last; empty tables give no rows; other columns of the tables are not read. Terms
are compared by hashes of 64 bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.text import ALNUM, chunks, signed

TOP = 10
BLOCK_TERMS = 1 << 18
DOC_BLOCK = 2 << 20
#: Parts of the tasks whose best documents are merged before the last window.
PARTS = 256


@dataclass
class Terms:
    """The terms of a block of items: sorted hashes with document frequencies, and each item's terms as positions."""

    hashes: np.ndarray
    items: list[np.ndarray]
    documents: int = 0
    length: int = 0
    weight: np.ndarray | None = None


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, term)``: the different terms of each item id, as hashes."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), ALNUM, lower=True):
                rows = chunk.first + chunk.row_of_word()
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows)), pa.array(signed(chunk.word_hashes()))], names=["item", "term"])

    named = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([named.schema["item"], T.StructField("term", T.LongType())])
    return named.mapInArrow(run, schema).distinct()


def _positions(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are known, and the positions of those."""
    if not len(sorted_hashes):
        return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    known = sorted_hashes[at] == hashes
    return known, at[known]


def _frequencies(docs: DataFrame, handle) -> DataFrame:
    """``(term, n)``: documents per term position; -1 counts documents with terms, -2 their terms."""

    def run(batches):
        hashes = handle.value
        df = np.zeros(len(hashes), np.int64)
        documents = length = 0
        for batch in batches:
            for chunk in chunks(batch.column("text"), ALNUM, lower=True, size=DOC_BLOCK):
                documents += int((chunk.counts > 0).sum())
                length += int(chunk.counts.sum())
                known, at = _positions(hashes, chunk.word_hashes())
                pairs = np.unique(at * chunk.rows + chunk.row_of_word()[known])
                df += np.bincount(pairs // chunk.rows, minlength=len(hashes))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], seen]).astype(np.int64)), pa.array(np.concatenate([[documents, length], df[seen]]).astype(np.int64))],
            names=["term", "n"],
        )

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Block:
    """Postings of one block of documents: for each term the documents, ascending, and what it adds to their scores."""

    def __init__(self, terms: Terms, chunk):
        self.documents = chunk.rows
        known, at = _positions(terms.hashes, chunk.word_hashes())
        pairs, tf = np.unique(at * chunk.rows + chunk.row_of_word()[known], return_counts=True)
        term, self.docs = pairs // chunk.rows, pairs % chunk.rows
        longer = 10 + (90 * chunk.counts * terms.documents) // max(terms.length, 1)
        self.gains = terms.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * longer[self.docs]))
        self.begin = np.searchsorted(term, np.arange(len(terms.hashes) + 1))
        self.most = np.zeros(len(terms.hashes), np.int64)
        if len(term):
            np.maximum.at(self.most, term, self.gains)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begin[term], self.begin[term + 1]
        return self.docs[a:b], self.gains[a:b]


def best_documents(block: Block, terms: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(documents, scores, accumulators)`` of a block that can be among the k best, scores exact.

    ``terms`` come rarest first; ``before`` has the best scores of earlier blocks.
    """
    present = terms[block.most[terms] > 0]
    to_come = np.cumsum(block.most[present][::-1])[::-1]
    scores = np.zeros(block.documents, np.int64)
    kept = None
    for term, rest in zip(present.tolist(), to_come.tolist()):
        docs, gains = block.of(term)
        if kept is None:
            partial = np.concatenate([before, scores[scores > 0]])
            # A document without accumulator gets ``rest`` at most; at equality its id may still win.
            if len(partial) >= k and rest < np.partition(partial, len(partial) - k)[len(partial) - k]:
                kept = np.flatnonzero(scores)
        if kept is None:
            scores[docs] += gains
        elif len(kept):
            at = np.minimum(np.searchsorted(docs, kept), len(docs) - 1)
            there = docs[at] == kept
            scores[kept[there]] += gains[at[there]]
    found = np.flatnonzero(scores) if kept is None else kept
    return found, scores[found], len(found)


class Ranking:
    """The k best documents of every item so far."""

    def __init__(self, terms: Terms, k: int, kind: pa.DataType):
        self.terms, self.k = terms, k
        self.ids = pa.array([], kind)
        self.at = [np.zeros(0, np.int64)] * len(terms.items)
        self.scores = [np.zeros(0, np.int64)] * len(terms.items)

    def add(self, chunk, ids: pa.Array) -> None:
        block = Block(self.terms, chunk)
        ids = pa.concat_arrays([self.ids, ids])
        order = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        earlier = len(self.ids)
        for i, own in enumerate(self.terms.items):
            docs, scores, _ = best_documents(block, own, self.scores[i], self.k)
            at = np.concatenate([self.at[i], docs + earlier])
            scores = np.concatenate([self.scores[i], scores])
            if len(scores) > self.k:
                least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                at, scores = at[scores >= least], scores[scores >= least]
            best = np.lexsort((place[at], -scores))[: self.k]
            self.at[i], self.scores[i] = at[best], scores[best]
        used = np.unique(np.concatenate([*self.at, np.zeros(0, np.int64)]))
        self.ids = ids.take(pa.array(used))
        self.at = [np.searchsorted(used, a) for a in self.at]

    def rows(self, names: list[str], part: int) -> pa.RecordBatch:
        sizes = [len(a) for a in self.at]
        at = np.concatenate([*self.at, np.zeros(0, np.int64)])
        columns = [
            pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
            self.ids.take(pa.array(at)),
            pa.array(np.concatenate([*self.scores, np.zeros(0, np.int64)])),
            pa.array(np.full(len(at), part, np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item over all tasks; the first window bounds what the second gets of an item."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    for group in (["number", "part"], ["number"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
    return found.drop("part")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``(item, rank, doc_id, score)``, the first and third named as in the tables: each item's k best documents."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    wanted = item_terms(items, item, item_text)
    number_type = wanted.schema["item"].dataType
    blocks = max(1, -(-wanted.count() // block_terms))
    out = None
    for b in range(blocks):
        # One block of items: about block_terms rows, whatever the number of items.
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = own.groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        part = _search_block(plain, [r["terms"] for r in rows], k)
        numbers = spark.createDataFrame(
            [(i, r["item"]) for i, r in enumerate(rows)], T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item", number_type)])
        )
        named = part.join(numbers, "number").select(F.col("item").alias(item), "rank", F.col("doc").alias(doc_id), "score")
        out = named if out is None else out.unionByName(named)
    return out


def _search_block(plain: DataFrame, terms_of: list[list[int]], k: int) -> DataFrame:
    context = plain.sparkSession.sparkContext
    lists = [np.array(t, np.int64).view(np.uint64) for t in terms_of]
    hashes = np.unique(np.concatenate([*lists, np.zeros(0, np.uint64)]))
    counted = dict(map(tuple, _frequencies(plain, context.broadcast(hashes)).collect()))  # two rows and one per term
    documents, length = counted.pop(-1, 0), counted.pop(-2, 0)
    df = np.zeros(len(hashes), np.int64)
    df[list(counted)] = list(counted.values())
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    order = np.lexsort((hashes, df))
    rarity = np.empty(len(hashes), np.int64)
    rarity[order] = np.arange(len(hashes))
    own = [np.searchsorted(hashes, t) for t in lists]
    items = [t[np.argsort(rarity[t])] for t in (t[df[t] > 0] for t in own)]
    handle = context.broadcast(Terms(hashes, items, documents, length, weight))
    names = ["number", "doc", "score", "part"]

    def run(batches):
        found = None
        for batch in batches:
            if found is None:
                found = Ranking(handle.value, k, batch.schema.field("doc").type)
            for chunk in chunks(batch.column("text"), ALNUM, lower=True, size=DOC_BLOCK):
                found.add(chunk, batch.column("doc").slice(chunk.first, chunk.rows))
        if found is not None:
            yield found.rows(names, TaskContext.get().partitionId() % PARTS)

    schema = T.StructType(
        [T.StructField("number", T.IntegerType()), plain.schema["doc"], T.StructField("score", T.LongType()), T.StructField("part", T.IntegerType())]
    )
    return _merged(plain.mapInArrow(run, schema), k)
