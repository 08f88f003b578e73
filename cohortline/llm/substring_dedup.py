"""Substring de-duplication by relative Lempel-Ziv parsing against indexed reference blocks.

Reference blocks are cut by content: of every window of 35 words, the smallest hash among its 24 runs of 12 words is an
anchor, and the stretch covered by the windows of one anchor is a block. Equal windows have equal anchors, whatever
surrounds them, so one index of anchors (about one word in twelve) covers every possible repeat in the corpus.

A document is then factored from left to right. Blocks that occur elsewhere as a whole extend the current factor. Where
the anchor is known but the block differs, a factor may begin or end inside the block: there, and only there, each window
is checked against all windows of the same anchor in the corpus. A factor of 35 words or more is a duplicate span.

The index holds hashes and counts, combined before the shuffle, so a passage in a third of all documents is one entry;
a text's own blocks are the only rows that are gathered. Equal texts of a batch are parsed once. Hashes have 64 bits.

Defined results: a NULL text has no words; a text of fewer than 35 words keeps them all; equal rows repeat each other and
lose all words of such texts; an empty table gives no rows; input columns with the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.frames import append_columns, without
from cohortline.llm.text import VISIBLE, Chunk, Runs, chunks, mix, raw_text, signed, window_starts
from cohortline.session import cut_lineage

WINDOW = 35
GRAM = 12


class Blocks:
    """Anchors and blocks of the rows of a chunk, with word positions counted in the chunk."""

    def __init__(self, chunk: Chunk, window: int, gram: int):
        self.runs = Runs(chunk.word_hashes())
        starts, rows = window_starts(chunk.word_offsets, window)
        span = window - gram + 1
        if len(starts) == 0:
            self.row = self.first = self.last = self.anchor = np.zeros(0, np.int64)
        else:
            words = len(chunk.starts)
            grams = self.runs.of(np.arange(words - gram + 1), np.arange(gram, words + 1))
            anchors = starts + np.lib.stride_tricks.sliding_window_view(grams, span)[starts].argmin(1)
            new = np.flatnonzero(np.diff(anchors, prepend=-1) != 0)
            self.anchor, self.row = anchors[new], rows[new]
            self.first = starts[new]
            self.last = starts[np.append(new[1:], len(starts)) - 1]
        self.chunk, self.window, self.gram = chunk, window, gram

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        h1 = self.runs.of(self.anchor, self.anchor + self.gram)
        shape = ((self.anchor - self.first) * 64 + (self.last - self.first)).astype(np.uint64)
        return h1, mix(self.runs.of(self.first, self.last + self.window) + shape)


def _once(batch: pa.RecordBatch, key: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows with different keys of a batch, and how often each occurs in it: equal texts are parsed once."""
    _, first, times = np.unique(batch.column(key).to_numpy(), return_index=True, return_counts=True)
    return batch.take(pa.array(first)), times


def _blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``key``, ``first`` and ``n`` (windows of the block in its text), ``h1`` (anchor), ``h2`` (whole block) and ``times``
    (equal texts in the batch)."""

    def run(batches):
        for batch in batches:
            batch, times = _once(batch, "key")
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text"), VISIBLE):
                found = Blocks(chunk, window, gram)
                h1, h2 = found.hashes()
                first = found.first - chunk.word_offsets[found.row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (keys[chunk.first + found.row], first.astype(np.int32), (found.last - found.first + 1).astype(np.int32), signed(h1), signed(h2), times[chunk.first + found.row])],
                    names=["key", "first", "n", "h1", "h2", "times"],
                )

    return docs.select("key", "text").mapInArrow(run, "key long, first int, n int, h1 long, h2 long, times long")


def _boundary_windows(matched: DataFrame, text: str, window: int) -> DataFrame:
    """``key``, ``pos``, ``hash`` of every window in the blocks of ``_check``, from rows with ``_key`` and ``text``."""

    def run(batches):
        for batch in batches:
            batch, _ = _once(batch, "_key")
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            wanted = batch.column("_check").to_pylist()
            for chunk in chunks(batch.column(text), VISIBLE):
                runs = Runs(chunk.word_hashes())
                rows, at = [], []
                for r in range(chunk.rows):
                    for b in wanted[chunk.first + r]:
                        at.append(np.arange(b["first"], b["first"] + b["n"]))
                        rows.append(np.full(b["n"], r))
                if not at:
                    continue
                row, pos = np.concatenate(rows), np.concatenate(at)
                start = chunk.word_offsets[row] + pos
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[chunk.first + row]), pa.array(pos.astype(np.int32)), pa.array(signed(runs.of(start, start + window)))], names=["key", "pos", "hash"]
                )

    return matched.mapInArrow(run, "key long, pos int, hash long")


def _factors(blocks: list[dict] | None, windows: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Greedy left-to-right parse: the longest stretches of words covered by repeated windows."""
    starts = sorted([(b["first"], b["first"] + b["n"] - 1) for b in blocks or ()] + [(w, w) for w in windows or ()])
    out: list[list[int]] = []
    for a, b in starts:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + window)
        else:
            out.append([a, b + window])
    return [(a, b) for a, b in out]





def find_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``n_removed``, ``spans`` (repeated stretches as word ranges, end exclusive)
    and ``kept_text`` (the other words joined by one blank)."""
    docs = without(docs, ["n_words", "n_removed", "spans", "kept_text", "_key", "_same", "_repeated"])
    # Documents with equal texts share a key: they have the same repeats.
    keyed = docs.withColumn("_key", F.xxhash64(text))
    rows = keyed.select(F.col("_key").alias("key"), F.col(text).alias("text"))
    blocks = _blocks(rows, window, gram)

    # Aggregates are written, or dealt anew, before they are joined to the rows: so both sides of a join are plain
    # exchanges, of which Spark splits the parts that hold a very common passage.
    index = blocks.groupBy("h1").agg(F.sum("times").alias("n1"), F.min("h2").alias("low"), F.max("h2").alias("high")).where("n1 > 1")
    index = cut_lineage(index.select("h1", (F.col("low") != F.col("high")).alias("mixed")))
    known = cut_lineage(blocks.join(index, "h1"))
    # Anchors whose blocks are all equal are settled. Of the others, the blocks that repeat as a whole are, too; one of each
    # goes on to the boundary check together with those that occur once.
    mixed = known.where("mixed")
    whole = cut_lineage(mixed.groupBy("h1", "h2").agg(F.sum("times").alias("n2"), F.min(F.struct("key", "first")).alias("one")))
    told = mixed.join(whole, ["h1", "h2"]).select(
        "key", "first", "n", (F.col("n2") > 1).alias("same"), ((F.col("n2") == 1) | (F.struct("key", "first") == F.col("one"))).alias("check")
    )
    settled = known.where(~F.col("mixed")).select("key", "first", "n", F.lit(True).alias("same"), F.lit(False).alias("check"))
    block = F.struct("first", "n")
    found = cut_lineage(
        settled.union(told).groupBy("key").agg(F.collect_set(F.when(F.col("same"), block)).alias("_same"), F.collect_set(F.when(F.col("check"), block)).alias("_check"))
    ).withColumnRenamed("key", "_key")

    # All columns pass through the boundary check, so its exchange of texts is the one that the parse below reads.
    checked = keyed.join(found.where(F.size("_check") > 0).select("_key", "_check"), "_key")
    windows = _boundary_windows(checked, text, window)
    repeated = windows.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash").hint("rebalance")
    edges = windows.join(repeated, "hash").groupBy("key").agg(F.collect_set("pos").alias("_repeated"))

    marks = found.where(F.size("_same") > 0).select("_key", "_same")
    marks = marks.join(edges.withColumnRenamed("key", "_key"), "_key", "full").hint("rebalance")
    whole_rows = keyed.join(marks, "_key", "left")

    def compute(batches):
        for batch in batches:
            data, at = raw_text(batch.column(text))
            out = []
            for a, b, same, repeated in zip(at[:-1], at[1:], batch.column("_same").to_pylist(), batch.column("_repeated").to_pylist()):
                words = data[a:b].tobytes().split()
                spans = _factors(same, repeated, window) if same or repeated else []
                kept, last = [], 0
                for s, e in spans:
                    kept += words[last:s]
                    last = e
                kept += words[last:]
                out.append((len(words), len(words) - len(kept), spans, b" ".join(kept)))
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield [
                pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in r[2]] for r in out], pa.list_(span)),
                pa.array([r[3] for r in out], pa.binary()).cast(pa.string()),
            ]

    ddl = "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    return append_columns(whole_rows, ddl, compute, hidden=("_key", "_same", "_repeated"))
