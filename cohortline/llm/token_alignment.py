"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece BPE with byte fallback (B) cover the same bytes.

A reads a space and the text, B the text (it adds the space itself), so both cover the same bytes. The character offsets of
tokenizer A and the spans in B's token messages are the coarse cuts. Where the span of a token is as long as the token's own
bytes, its end is settled; the others (parts of a multibyte character, byte-fallback tokens, whose spans repeat or are
empty) are placed by their decoded bytes behind the last settled end. Offsets where tokens of both end cut the text into
groups; every A token of a group is linked to every B token of it.

Neither tokenizer joins bytes across a blank that follows a visible character (A cuts there before merging; B's vocabulary
has no piece with a blank after another character, which is checked on loading, otherwise texts are not cut). So texts are
cut there into segments, a worker aligns each different segment once, many joined into one call, and everything a document
needs is a sum or a chain over its segments. The store of segments of a worker is emptied when it is large.

Corpus-wide counts: the documents of a chunk of about ``CHUNK_TEXT`` bytes number their different id pairs, and each document
keeps the numbers with how often it holds the pair. The chunk's pairs with their document counts are summed over the
corpus, and each chunk gets back the sums of its own pairs, so no table of all pairs is sent to anyone. Documents and their
keys are written to the shared folder before, and read again for the second half.

Defined results: a NULL or empty text, and one whose joined token bytes differ from the space and the text, has no tokens:
zeros and empty results; repeated rows are documents of their own; an empty table gives no rows; input columns with the name
of a result column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.frames import fields, shared_folder, without
from cohortline.session import cut_lineage

FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
CHUNK_TEXT = 2 << 20
#: Segments a worker keeps, and segments joined into one call of the tokenizers.
STORED = 600_000
JOINED = 200
#: Links of a group from which its pairs are counted by different ids.
LARGE_GROUP = 4096

#: A blank and what follows it up to the next blank after a visible character; the last one has all white space at the end.
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*(?:\s+\Z)?")
BLANK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class ByteTable:
    """Bytes of all tokens of a vocabulary in one array."""

    flat: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> ByteTable:
        sizes = np.array([len(t) for t in tokens], np.int64)
        return ByteTable(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.begin[ids + 1] - self.begin[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths(ids)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return self.flat[np.repeat(self.begin[ids], sizes) + at]


def settled_ends(coarse_begin: np.ndarray, coarse_end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse ones where the span has the token's length, else by length behind the last of those."""
    total = np.cumsum(lengths)
    fits = coarse_end - coarse_begin == lengths
    last = np.maximum.accumulate(np.where(fits, np.arange(len(lengths)), -1))
    return np.where(last >= 0, coarse_end[last] - total[last] + total, total)


class Tokenizers:
    """Both tokenizers, built from the bytes of their files."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        alphabet = byte_alphabet()
        names = {i: s for s, i in json.loads(byte_bpe)["model"]["vocab"].items()}
        size = max([*names, self.a.get_vocab_size() - 1]) + 1
        self.a_bytes = ByteTable.of([bytes(alphabet[c] for c in names.get(i, "") if c in alphabet) for i in range(size)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        decoded = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.b_bytes = ByteTable.of(decoded)
        #: Texts of ids in a group: those of A inside and at its end, then those of B.
        self.written = [f"{i}{mark}" for n, marks in ((size, ",|"), (len(pieces), ",;")) for mark in marks for i in range(n)]
        #: Whether B's merges stop at a blank after another character.
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(" " + text) if self.cuts else [" " + text]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, ...]]:
        """For each text, which starts with a blank: bytes, ids and byte ends of A, ids and byte ends of B."""
        out = []
        for text, one, two in zip(texts, self.a.encode_batch(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)):
            raw = np.frombuffer(text.encode(), np.uint8)
            at = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])  # of characters
            spans = at[np.fromiter(chain.from_iterable(one.offsets), np.int64).reshape(-1, 2)]
            a = np.array(one.ids, np.int64)
            pieces = [(p.id, p.end) for p in two.pieces]  # a message is built anew whenever it is read
            b, ends = np.fromiter(chain.from_iterable(pieces), np.int64).reshape(-1, 2).T
            ends = ends + 1  # B's blank is not in its spans
            begins = np.concatenate([[0], ends[:-1]])
            out.append((raw, a, settled_ends(spans[:, 0], spans[:, 1], self.a_bytes.lengths(a)), b, settled_ends(begins, ends, self.b_bytes.lengths(b))))
        return out

    def whole(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
        return all(np.array_equal(table.joined(ids), raw) for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))


def _linked(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, code, times)`` of all links; a code has the A id above and the B id below 32 bits."""
    a_begin, b_begin = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    links = a_sizes * b_sizes
    small = np.flatnonzero(links < LARGE_GROUP)
    group = np.repeat(small, links[small])
    within = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    wide = b_sizes[group]
    code = (a[a_begin[group] + within // wide] << 32) | b[b_begin[group] + within % wide]
    parts = [(group, code, np.ones(len(code), np.int64))]
    for g in np.flatnonzero(links >= LARGE_GROUP):
        x, m = np.unique(a[a_begin[g] : a_begin[g] + a_sizes[g]], return_counts=True)
        y, n = np.unique(b[b_begin[g] : b_begin[g] + b_sizes[g]], return_counts=True)
        parts.append((np.full(len(x) * len(y), g), ((x[:, None] << 32) | y[None]).ravel(), (m[:, None] * n[None]).ravel()))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


class SegmentStore:
    """What documents need of every different segment: counts, group text, numbered id pairs with their occurrences."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.pair_at: dict[int, int] = {}
        self.codes = np.zeros(0, np.int64)
        #: Columns whole, n_a, n_b, n_groups, n_links, and the number of different pairs.
        self.facts = np.zeros((0, 6), np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)

    def add(self, segments: list[str]) -> None:
        """Align new segments. One that ends in white space would hide the next cut and goes alone."""
        alone = [s for s in segments if s[-1].isspace() or len(s) > 10_000]
        rest = [s for s in segments if not s[-1].isspace() and len(s) <= 10_000]
        calls = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)] + [[s] for s in alone]
        found = []
        for i in range(0, len(calls), 50):
            found += self._aligned(calls[i : i + 50])
        self._keep(found)

    def _aligned(self, calls: list[list[str]]) -> list[tuple]:
        out = []
        for own, (raw, a, a_ends, b, b_ends) in zip(calls, self.tokenizers.encoded(["".join(c) for c in calls])):
            if self.tokenizers.whole(raw, a, b):
                out.append(self._grouped(own, a, a_ends, b, b_ends))
            elif len(own) > 1:
                out += self._aligned([[s] for s in own])
            else:
                none = np.zeros(0, np.int64)
                out.append((own, np.zeros((1, 5), np.int64), [""], none, none, none))
        return out

    def _grouped(self, own: list[str], a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple:
        ends = np.cumsum([len(s.encode()) for s in own])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        sizes = [np.diff(np.searchsorted(e, cuts, "right"), prepend=0) for e in (a_ends, b_ends)]
        segment = np.searchsorted(ends, cuts)
        per = lambda x: np.bincount(segment, x, minlength=len(own)).astype(np.int64)
        facts = np.stack([np.ones(len(own), np.int64), per(sizes[0]), per(sizes[1]), per(np.ones(len(cuts))), per(sizes[0] * sizes[1])], 1)
        # The ids of a group are A's, then B's; the last of each side has the mark that ends it.
        last = [np.cumsum(n) for n in sizes]
        words = np.empty(len(a) + len(b), np.int64)
        in_a, in_b = (np.repeat(np.arange(len(cuts)), n) for n in sizes)
        a_table, b_table = len(self.tokenizers.a_bytes.begin) - 1, len(self.tokenizers.b_bytes.begin) - 1
        a_word, b_word = a.copy(), b + 2 * a_table
        a_word[last[0] - 1] += a_table
        b_word[last[1] - 1] += b_table
        words[np.arange(len(a)) + (last[1] - sizes[1])[in_a]] = a_word
        words[np.arange(len(b)) + last[0][in_b]] = b_word
        flat = list(map(self.tokenizers.written.__getitem__, words.tolist()))
        ids = np.concatenate([[0], np.cumsum(per(sizes[0] + sizes[1]))]).tolist()
        lines = ["".join(flat[i:j])[:-1] for i, j in zip(ids, ids[1:])]
        group, code, times = _linked(a, b, *sizes)
        return own, facts, lines, segment[group], code, times

    def _keep(self, found: list[tuple]) -> None:
        if not found:
            return
        first = len(self.groups)
        for own, _, lines, *_ in found:
            for s in own:
                self.at[s] = len(self.at)
            self.groups += lines
        shift = np.cumsum([0, *(len(f[0]) for f in found)])
        segment = np.concatenate([f[3] + n for f, n in zip(found, shift)])
        codes, number = np.unique(np.concatenate([f[4] for f in found]), return_inverse=True)
        fresh = [c for c in codes.tolist() if c not in self.pair_at]
        self.pair_at.update((c, len(self.codes) + i) for i, c in enumerate(fresh))
        self.codes = np.concatenate([self.codes, np.array(fresh, np.int64)])
        numbers = np.array([self.pair_at[c] for c in codes.tolist()], np.int64)
        key, back = np.unique(segment * max(len(codes), 1) + number, return_inverse=True)
        times = np.bincount(back, np.concatenate([f[5] for f in found]), minlength=len(key)).astype(np.int64)
        segments = len(self.groups) - first
        size = np.bincount(key // max(len(codes), 1), minlength=segments)
        facts = np.concatenate([f[1] for f in found])
        self.facts = np.concatenate([self.facts, np.column_stack([facts, size])])
        self.pairs = np.concatenate([self.pairs, numbers[key % max(len(codes), 1)] if len(key) else key])
        self.times = np.concatenate([self.times, times])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all segments of the texts, and where each text's begin."""
        if len(self.at) > STORED:
            self.clear()
        parts = [self.tokenizers.segments(t) if t else [] for t in texts]
        every = list(chain.from_iterable(parts))
        fresh = [s for s in dict.fromkeys(every) if s not in self.at]
        if fresh:
            self.add(fresh)
        at = np.fromiter(map(self.at.__getitem__, every), np.int64, len(every))
        return at, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


@lru_cache(maxsize=1)
def _store(handle: Broadcast) -> SegmentStore:
    """Built once per worker process."""
    return SegmentStore(Tokenizers(*handle.value))


def read_tokenizers(spark, folder: str = FOLDER, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> Broadcast:
    """The two vocabulary files (a few MB) for all workers; the folder need exist on the driver only."""
    contents = []
    for name in (byte_bpe, piece_bpe):
        with open(os.path.join(folder, name), "rb") as file:
            contents.append(file.read())
    return spark.sparkContext.broadcast(tuple(contents))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "groups array<struct<a:array<int>,b:array<int>>>"


def _packed(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers as differences, then occurrences, compressed."""
    both = np.concatenate([np.diff(numbers, prepend=0), times]).astype(np.uint32 if times.max(initial=0) < 2**32 else np.uint64)
    return zstandard.compress(both.tobytes(), 1) + bytes([both.itemsize])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(data[:-1]), np.uint32 if data[-1] == 4 else np.uint64).astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _chunk_columns(store: SegmentStore, texts: list[str | None]) -> tuple[list, bytes | None]:
    """Columns of the documents of a chunk, and the chunk's id pairs with document counts."""
    at, begin = store.of(texts)
    sizes = np.diff(begin)
    document = np.repeat(np.arange(len(texts)), sizes)
    broken = np.bincount(document, store.facts[at, 0] == 0, minlength=len(texts)) > 0
    live = ~broken & (sizes > 0)
    numbers = [np.where(live, np.bincount(document, store.facts[at, k], minlength=len(texts)), 0).astype(np.int64) for k in (1, 2, 3, 4)]
    listed = at.tolist()
    digests = [
        hashlib.sha256(";".join(map(store.groups.__getitem__, listed[a:b])).encode()).hexdigest() if ok else ""
        for a, b, ok in zip(begin[:-1].tolist(), begin[1:].tolist(), live.tolist())
    ]
    own = live[document]
    seen, again = np.unique(document[own] * len(store.groups) + at[own], return_counts=True)
    document, segment = seen // len(store.groups), seen % len(store.groups)
    size = store.facts[segment, 5]
    places = np.repeat(store.begin[segment], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    used = np.zeros(len(store.codes), bool)
    used[store.pairs[places]] = True
    number = np.cumsum(used) - 1
    total = max(int(used.sum()), 1)
    key, back = np.unique(np.repeat(document, size) * total + number[store.pairs[places]], return_inverse=True)
    times = np.bincount(back, store.times[places] * np.repeat(again, size), minlength=len(key)).astype(np.int64)
    document, pair = key // total, key % total
    cut = np.searchsorted(document, np.arange(len(texts) + 1)).tolist()
    blobs = [_packed(pair[a:b], times[a:b]) if b > a else None for a, b in zip(cut, cut[1:])]
    counts = np.bincount(pair, minlength=total).astype(np.int64)
    table = np.concatenate([store.codes[used], counts[: used.sum()]]).tobytes() if used.any() else None
    return [*map(pa.array, numbers), pa.array(digests, pa.string()), pa.array(blobs, pa.binary())], table


def _aligned_rows(docs: DataFrame, text: str, handle: Broadcast, chunk_text: int) -> DataFrame:
    """Documents with their numbers, digest, packed pairs, and chunk; the first row of a chunk has the chunk's pairs."""
    kept = [f.name for f in docs.schema.fields if f.name != "_text"]
    ddl = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _own binary, _chunk long, _pairs binary"
    names = [*kept, *(f.name for f in fields(ddl))]

    def run(batches):
        store, number = _store(handle), 0
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            ends = np.cumsum([len(t or "") for t in texts])
            first = 0
            while first < len(texts):
                limit = (ends[first - 1] if first else 0) + chunk_text
                last = max(first + 1, int(np.searchsorted(ends, limit, "right")))
                columns, table = _chunk_columns(store, texts[first:last])
                key = np.full(last - first, (TaskContext.get().partitionId() << 32) | number, np.int64)
                number += 1
                pairs = pa.array([table, *[None] * (last - first - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in kept), *columns, pa.array(key), pairs], names=names)
                first = last

    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema.fields if f.name != "_text"), *fields(ddl)]))


def _pair_rows(aligned: DataFrame) -> DataFrame:
    """``(chunk, number, a, b, documents)``: a row per chunk and id pair."""

    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column("_chunk").to_pylist(), batch.column("_pairs").to_pylist()):
                both = np.frombuffer(data, np.int64)
                code, documents = both[: len(both) // 2], both[len(both) // 2 :]
                columns = [np.full(len(code), chunk, np.int64), np.arange(len(code), dtype=np.int32), (code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32), documents]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["chunk", "number", "a", "b", "documents"])

    return aligned.where("_pairs IS NOT NULL").select("_chunk", "_pairs").mapInArrow(run, "chunk long, number int, a int, b int, documents long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: documents that hold the ids linked, and whether no other B id has more with this A id."""
    counts = cut_lineage(pairs.groupBy("a", "b").agg(F.sum("documents").alias("count")))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # an A id has at most as many rows as B has ids
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, text: str = "text", tokenizers: Broadcast | None = None, chunk_text: int = CHUNK_TEXT, with_groups: bool = False) -> DataFrame:
    """All rows of ``docs`` with the numbers of tokens, groups, links, best links, the sum of their counts, and the digest of
    the groups; with ``with_groups`` also the groups themselves (``a`` and ``b``: ids in order)."""
    spark = docs.sparkSession
    handle = tokenizers or read_tokenizers(spark)
    plain = without(docs, [f.name for f in fields(RESULT)] + ["_own", "_chunk", "_pairs", "_text", "groups"])
    path = shared_folder(spark, "aligned")
    read = docs.select(*[F.col(f"`{c}`") for c in plain.columns], F.col(f"`{text}`").alias("_text"))
    _aligned_rows(read, text, handle, chunk_text).write.parquet(path)
    aligned = spark.read.parquet(path)
    pairs = _pair_rows(aligned)
    # The sums are a written table, so the join below is one of two plain exchanges, and Spark may split a common pair.
    scored = cut_lineage(pair_counts(pairs))
    back = pairs.drop("documents").join(scored, ["a", "b"]).select("chunk", "number", "count", "best")
    rows = aligned.drop("_pairs")
    names = [*plain.columns, *(f.name for f in fields(RESULT))]
    schema = T.StructType([*plain.schema.fields, *fields(RESULT)])

    def summed(own: pa.Table, sums: pa.Table) -> pa.Table:
        count = np.zeros(sums.num_rows, np.int64)
        best = np.zeros(sums.num_rows, np.int64)
        number = sums.column("number").to_numpy()
        count[number] = sums.column("count").to_numpy()
        best[number] = sums.column("best").to_numpy()
        n_best, total = [], []
        for data in own.column("_own").to_pylist():
            pair, times = _unpacked(data) if data else (np.zeros(0, np.int64),) * 2
            n_best.append(int((best[pair] * times).sum()))
            total.append(int((count[pair] * times).sum()))
        added = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table([added.get(n, own.column(n) if n not in added else None) for n in names], names=names)

    out = rows.groupBy("_chunk").cogroup(back.groupBy("chunk")).applyInArrow(summed, schema)
    return token_groups(out, text, handle) if with_groups else out


def token_groups(docs: DataFrame, text: str = "text", tokenizers: Broadcast | None = None) -> DataFrame:
    """All rows of ``docs`` with ``groups``: the A and B ids of each group of the text, in order."""
    handle = tokenizers or read_tokenizers(docs.sparkSession)
    plain = without(docs, ["groups"])
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches):
        store = _store(handle)
        for batch in batches:
            out = []
            for value in batch.column(text).to_pylist():
                at, _ = store.of([value])
                found = bool(len(at)) and bool((store.facts[at, 0] == 1).all())
                sides = [g.split("|") for i in at for g in store.groups[i].split(";")] if found else []
                out.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in sides])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "groups"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *fields(GROUPS)]))
