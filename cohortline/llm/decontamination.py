"""Benchmark decontamination: one Aho-Corasick automaton over normalised test windows, one scan of every text.

Texts become lower-case words. Every window of 13 words of a benchmark item (all words of a shorter item) is a pattern
of word numbers with three digits, so a window has 39 nodes and a match starts and ends with whole words. The automaton
reports all matches in one pass; the words that they cover are turned back into offsets of the original.

The patterns are cut into blocks of at most ``BLOCK_BYTES`` by hash, a word counting as ``WORD_BYTES`` and its letters. A
benchmark of usual size is one block; a larger one is scanned block after block. Each pass but the last writes its hits, not
the texts, before the next begins, so neither the driver nor a worker ever holds more than one block.

Defined results: NULL or wordless texts have no words and no hits; items without words have no window; equal items and
repeated rows all count; a NULL item id is the empty text; an empty benchmark or table gives no hits or no rows; input
columns with the name of a result column are replaced.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.frames import append_columns, shared_folder, without
from cohortline.llm.text import ALNUM, LOWER, raw_text
from cohortline.session import cut_lineage

WINDOW = 13
BLOCK_BYTES = 32 << 20
#: A block has at most BLOCK_BYTES / WORD_BYTES different words, fewer than three digits can number.
WORD_BYTES = 32
BASE = 102
UNKNOWN = "\0\0\0"

_TABLE = bytes(LOWER[i] if ALNUM[LOWER[i]] else 32 for i in range(256))


def normalised(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_TABLE).split())


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per different window: ``words`` (normalised bytes), ``items`` (the texts of the ids that hold it)."""

    def run(batches):
        for batch in batches:
            data, at = raw_text(batch.column("text"))
            items, windows = [], []
            for name, a, b in zip(batch.column("item").to_pylist(), at[:-1], at[1:]):
                words = normalised(data[a:b].tobytes()).split()
                own = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
                windows += own
                items += [name] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary())], names=["item", "words"])

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    rows = named.mapInArrow(run, "item string, words binary")
    return rows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _codes(words: set[bytes]) -> dict[bytes, str]:
    """Each word as three digits. Every place has an alphabet of its own, so a match begins and ends with whole words; nodes
    have few children, which the automaton searches one by one."""
    digit = lambda place, n: chr(1 + place * BASE + n % BASE)
    return {w: digit(0, n // BASE**2) + digit(1, n // BASE) + digit(2, n) for n, w in enumerate(sorted(words))}


@lru_cache(maxsize=1)
def _automaton(handle: Broadcast) -> tuple[ahocorasick.Automaton, dict[bytes, str]] | None:
    """The automaton and the codes of its words, built once per worker process and block."""
    codes = _codes({w for words, _ in handle.value for w in words.split()})
    found = ahocorasick.Automaton()
    for words, items in handle.value:
        own = words.split()
        found.add_word("".join(map(codes.get, own)), (len(own), items))
    found.make_automaton()
    return (found, codes) if len(found) else None


def _matches(built, text: bytes) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges covered by matches, and the items they belong to."""
    spans, items = [], set()
    if built is not None and text:
        automaton, codes = built
        symbols = "".join(map(codes.get, text.split(), repeat(UNKNOWN)))
        for end, (length, names) in automaton.iter(symbols):
            last = end // 3 + 1
            spans.append((last - length, last))
            items.update(names)
    return spans, items


def _offsets(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code-point offsets of the words of one text."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ALNUM[LOWER[raw]]
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edges = np.diff(inside.astype(np.int8))
    return points[np.flatnonzero(edges == 1)], points[np.flatnonzero(edges == -1)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as text), ``spans`` (hit
    stretches as code-point offsets of the original text) and ``contaminated`` (some hit, and a twentieth of all words)."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item, text, window).withColumn(
        "weight",
        F.octet_length("words")
        + WORD_BYTES * (F.octet_length("words") - F.octet_length(F.expr("replace(decode(words, 'ISO-8859-1'), ' ', '')")) + 1)
        + F.aggregate("items", F.lit(0), lambda n, s: n + F.octet_length(s) + 8),
    )
    windows = cut_lineage(windows)  # read once per block
    total = windows.agg(F.sum("weight")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = without(docs, ["n_words", "n_hit", "n_items", "items", "spans", "contaminated", "_key", "_before"])
    keyed, path = out.withColumn("_key", F.xxhash64(text)), shared_folder(spark, "hits")
    for number in range(blocks):
        # The part of one block is bounded by block_bytes, whatever the size of the benchmark.
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == number).select("words", "items").collect()
        handle = spark.sparkContext.broadcast([(bytes(r["words"]), list(r["items"])) for r in part])
        if number < blocks - 1:
            _hits(keyed.select("_key", F.col(text).alias("text")), handle).write.mode("append").parquet(path)
            handle.destroy()
    if blocks == 1:
        return _scan(out, text, handle, ())
    # Hits belong to a text, so equal texts share them, and one row per text and block is joined back.
    before = spark.read.schema(HITS).parquet(path).groupBy("_key").agg(F.collect_set(F.struct("spans", "items")).alias("_before"))
    return _scan(keyed.join(before, "_key", "left"), text, handle, ("_key", "_before"))


HITS = "_key long, spans array<int>, items array<string>"
RESULT = (
    "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"
)


def _hits(texts: DataFrame, handle: Broadcast) -> DataFrame:
    """Texts with a match in one block: their ``_key``, word ranges and items."""

    def run(batches):
        built = _automaton(handle)
        for batch in batches:
            data, at = raw_text(batch.column("text"))
            keys, rows = [], []
            for key, a, b in zip(batch.column("_key").to_pylist(), at[:-1], at[1:]):
                spans, items = _matches(built, normalised(data[a:b].tobytes()))
                if spans:
                    keys.append(key)
                    rows.append(([x for s in _merged(spans) for x in s], sorted(items)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.string()))],
                names=["_key", "spans", "items"],
            )

    return texts.mapInArrow(run, HITS)


def _scan(docs: DataFrame, text: str, handle: Broadcast, hidden: tuple[str, ...]) -> DataFrame:
    def compute(batches):
        built = _automaton(handle)
        for batch in batches:
            data, at = raw_text(batch.column(text))
            before = batch.column("_before").to_pylist() if hidden else [None] * batch.num_rows
            rows = []
            for a, b, earlier in zip(at[:-1], at[1:], before):
                raw = data[a:b]
                words = normalised(raw.tobytes())
                spans, items = _matches(built, words)
                for hits in earlier or ():
                    spans += list(zip(hits["spans"][::2], hits["spans"][1::2]))
                    items |= set(hits["items"])
                rows.append(_result(raw, words, spans, items))
            yield _result_columns(rows)

    return append_columns(docs, RESULT, compute, hidden=hidden)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _result(raw: np.ndarray, words: bytes, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    n_words = words.count(b" ") + 1 if words else 0
    if not spans:
        return n_words, 0, [], []
    merged = _merged(spans)
    starts, ends = _offsets(raw)
    return n_words, sum(b - a for a, b in merged), sorted(items), [(int(starts[a]), int(ends[b - 1])) for a, b in merged]


def _result_columns(rows: list[tuple]) -> list[pa.Array]:
    n_words = np.array([r[0] for r in rows], np.int64)
    n_hit = np.array([r[1] for r in rows], np.int64)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return [
        pa.array(n_words),
        pa.array(n_hit),
        pa.array(np.array([len(r[2]) for r in rows], np.int64)),
        pa.array([r[2] for r in rows], pa.list_(pa.string())),
        pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows], pa.list_(span)),
        pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
    ]
