"""Mixing sources to target weights by the cube method.

Every document of a source is wanted ``target / source_size`` times. The whole part is taken for all; the fraction is an
inclusion probability, settled by balanced sampling: a flight phase moves the probabilities of three documents at a time
along the one direction that keeps both the number of documents and the number of words, until one of them is 0 or 1.
Blocks of a source fly independently and hand on what they could not settle; these remainders meet in fewer blocks, and so
on, until one block is left per source. Its landing problem has at most sixteen documents and is solved outright.

A source with a third of all rows is many blocks; no group is larger than ``BLOCK`` rows. Only two sums per resharing round
reach the driver.

Defined results: a NULL text has size 0; a NULL source is a source of its own and sorts last; equal rows are units of
their own; a source without words has target 0; an empty table gives no rows; input columns with the name of a result
column are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.llm.frames import append_columns, apart_if_hot, without
from cohortline.llm.text import VISIBLE, chunks
from cohortline.operators.ordering import running_totals
from cohortline.session import cut_lineage

BLOCK = 4096
#: Documents kept back from the flight, the largest of a block: the landing needs them to meet the total closely.
HELD = 14
WEIGHTS = (5.0, 2.0, 1.0)


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``size``: the number of words between white space."""

    def compute(batches):
        for batch in batches:
            counts = [np.zeros(0, np.int64), *(c.counts for c in chunks(batch.column(text), VISIBLE))]
            yield [pa.array(np.concatenate(counts), pa.int64())]

    return append_columns(docs, "size long", compute)


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size``, ``n_docs``, ``target`` from rows of ``source`` and ``size``.

    Sources in code-point order, NULL last, take the weights in turn and share ``share`` of all words. A target stops at
    ``cap`` times its source; what is above is shared out again by weight until no target is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = totals.select("*", F.col("source").isNull().alias("_last"), F.coalesce("source", F.lit("")).alias("_name"), F.lit(1).alias("one"))
    ranked = running_totals(named, ["_last", "_name"], ["one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("one_before"), F.lit(len(weights))) + 1).cast("int"))
    ranked = cut_lineage(ranked.select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * cap).alias("most")))
    whole = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:  # every round caps at least one more source
        capped = F.col("most") <= F.col("weight") * level
        row = ranked.agg(
            F.sum(F.when(capped, F.col("most"))).alias("capped"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count(F.when(capped, 1)).alias("n")
        ).first()
        if row["n"] == full or not row["open"]:
            break
        level, full = max(0.0, whole - (row["capped"] or 0.0)) / row["open"], row["n"]
    # With every source at its most, the level no longer matters.
    target = F.least(F.col("most"), F.col("weight") * level) if row["open"] else F.col("most")
    return ranked.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _flight(pi: list[float], size: list[float], rng: np.random.Generator) -> list[int]:
    """Settle ``pi`` in place, keeping its sum and its sum weighted by size; returns the (at most two) open positions."""
    draws = iter(())
    active: list[int] = []
    for i in range(len(pi)):
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = np.inf
            for j, v in zip(active, u):
                if v > 0:
                    up, down = min(up, (1 - pi[j]) / v), min(down, pi[j] / v)
                elif v < 0:
                    up, down = min(up, -pi[j] / v), min(down, (pi[j] - 1) / v)
            draw = next(draws, None)
            if draw is None:
                draws = iter(rng.random(1024).tolist())
                draw = next(draws)
            step = up if draw * (up + down) < down else -down
            for j, v in zip(active, u):
                pi[j] = _snapped(pi[j] + step * v)
            active = [j for j in active if 0.0 < pi[j] < 1.0]
    return active


def _snapped(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """0 or 1 for at most 16 documents: the words closest to their expectation, then the number of documents."""
    bits = ((np.arange(1 << len(pi))[:, None] >> np.arange(len(pi))) & 1).astype(np.float64)
    words = np.abs(bits @ size - pi @ size)
    count = np.abs(bits.sum(1) - pi.sum())
    return bits[np.lexsort((count, np.round(words, 6)))[0]]


def _settle(block: pd.DataFrame) -> pd.DataFrame:
    """One block: hold the largest documents back, fly the others, land if the source has no other block."""
    block = block.sort_values(["size", "key1", "key2", "copy"], ascending=[False, True, True, True], kind="stable")
    pi, size = block["pi"].to_numpy(np.float64).copy(), block["size"].to_numpy(np.float64)
    seed = zlib.crc32(f"{block['key1'].iloc[0]}:{block['key2'].iloc[-1]}:{len(block)}".encode())
    rest = np.flatnonzero((pi > 0) & (pi < 1))
    held, rest = rest[:HELD], rest[HELD:]
    flown = pi[rest].tolist()
    left = _flight(flown, size[rest].tolist(), np.random.default_rng(seed))
    pi[rest] = flown
    if block["blocks"].iloc[0] == 1:
        last = np.concatenate([held, rest[left]]).astype(int)
        pi[last] = _landing(pi[last], size[last])
    return block.assign(pi=pi).drop(columns="blocks")


def cube_sample(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Settle ``pi`` of ``units(stratum, n_docs, key1, key2, copy, size, pi)`` to 0 or 1, balanced within every stratum.

    ``n_docs`` is the size of the stratum; it deals out the first blocks without another shuffle by stratum.
    """
    settled, open_ = [], units.withColumn("blocks", F.ceil(F.col("n_docs") / block)).drop("n_docs")
    while True:
        dealt = open_.withColumn("_block", F.pmod(F.xxhash64("key1", "key2", "copy", "blocks"), F.col("blocks")))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.drop("blocks").schema.fields)
        done = cut_lineage(dealt.groupBy("stratum", "_block").applyInPandas(_settle, schema).drop("_block"))
        fraction = (F.col("pi") > 0) & (F.col("pi") < 1)
        settled.append(done.where(~fraction))
        open_ = done.where(fraction)
        if open_.isEmpty():
            break
        # What is left is a few units per block.
        open_ = open_.join(open_.groupBy("stratum").agg(F.ceil(F.count("*") / block).alias("blocks")), "stratum")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _keys(text: str) -> list[Column]:
    whole = [F.col("doc_id"), F.col("source"), F.col(text)]
    return [F.xxhash64(*whole).alias("key1"), F.xxhash64(F.lit(7), *whole).alias("key2")]


def mix_units(docs: DataFrame, text: str = "text", share: float = 1.5, cap: float = 2.0, block: int = BLOCK) -> DataFrame:
    """One row per document without its text: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``,
    and ``key1``, ``key2``, ``copy`` to find it again (equal rows are counted first, then numbered)."""
    sized = with_size(docs.select("doc_id", "source", F.col(text).alias("text"))).select("doc_id", "source", "size", *_keys("text"))
    counted = cut_lineage(sized.groupBy("doc_id", "source", "size", "key1", "key2").agg(F.count("*").alias("n")))
    units = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    targets = cut_lineage(source_targets(units.select("source", "size"), share, cap))
    wanted = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    times = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    near = F.round(times)
    times = F.when(F.abs(times - near) < 1e-9, near).otherwise(times)
    wanted = wanted.withColumns({"whole": F.floor(times), "pi": times - F.floor(times)}).withColumn(
        "stratum", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    )
    drawn = cube_sample(wanted, block)
    return drawn.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("pi")).cast("long").alias("copies"), "key1", "key2", "copy")


def mix(docs: DataFrame, text: str = "text", share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixture itself: rows of ``docs`` as often as they are taken (0, 1 or 2 times with the defaults)."""
    units = mix_units(docs, text, share, cap).where("copies > 0").select("key1", "key2", "copy", "copies")
    names = [f"_{c}" for c in units.columns]
    plain = without(docs, [*names, "_row", "_lane"])
    keyed = plain.withColumns({"_key1": _keys(text)[0], "_key2": _keys(text)[1]}).withColumn("_row", F.xxhash64("_key1", "_key2"))
    # Numbers only have to tell equal rows apart as often as ``mix_units`` counted them; a frequent row is numbered in parts.
    keyed, often = apart_if_hot(keyed, "_row", "_copy")
    keyed = keyed.withColumn("_copy", F.row_number().over(W.partitionBy("_key1", "_key2").orderBy("_key1")).cast("long"))
    if often is not None:
        keyed = keyed.unionByName(often.withColumn("_copy", F.col("_copy") + 1))
    taken = keyed.join(units.toDF(*names), names[:3])
    return taken.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*[f"`{c}`" for c in plain.columns])
