"""Line de-duplication by a segment-partition edit join.

Lines of the whole corpus are similar if they differ by at most ``edits`` insertions, deletions or replacements of code
points, and by at most one in ten of the shorter line (lines of fewer than ten code points have to be equal). A line that
may differ by t is cut into t + 1 segments; t edits leave one of them whole, so similar lines share a segment of the
indexed line at nearly the same place. Each line is indexed under its own segments, and probes, for every length that a
similar line can have, only those substrings that the positions of t edits allow. Lines that meet are verified with a
banded bit-parallel edit distance, many pairs at a time.

Only the first line of a class (by document id, then line number) stays; a class is what links connect. Blank lines are no
lines. Equal lines are one entry with a first place, so a line in a third of all documents is a few rows; keys that many
different lines share are cut into tiles, and no pair leaves a task unless it is a verified link.

Defined results: a NULL text has no lines; ids sort with NULL last; of equal rows the lines of one stay; an empty table
gives no rows; input columns with the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.frames import append_columns, components, dealt_by, star_roots, tiled, without
from cohortline.llm.text import _BASE, _BYTE_CODES, VISIBLE, chunks, mix, prefix_sums, raw_text, run_hashes, signed
from cohortline.session import cut_lineage

EDITS = 2
TILE = 64


def allowed(length: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Edits that the shorter of two lines allows."""
    return np.minimum(edits, length // 10)


class Lines:
    """Non-blank lines of a chunk: row, number in the row, byte range and hash; with ``points`` also code points."""

    def __init__(self, chunk, points: bool = False):
        data, at = chunk.data, chunk.offsets
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
        starts = starts[starts < len(data)]
        self.row = np.searchsorted(at, starts, "right") - 1
        ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], at[self.row + 1])
        # The number of a line is the number of breaks before it in its text.
        self.number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, at[self.row])
        # A line and its break reach up to the next line.
        some = np.logical_or.reduceat(VISIBLE[data], starts) if len(starts) else np.zeros(0, bool)
        self.row, self.number, self.start, self.end = self.row[some], self.number[some], starts[some], ends[some]
        if points:
            self.lead = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
            self.point = np.searchsorted(self.lead, self.start)
            self.length = np.searchsorted(self.lead, self.end) - self.point
        self.sums = prefix_sums(_BYTE_CODES[data], _BASE)
        self.hash = run_hashes(self.sums, self.start, self.end, _BASE) ^ mix((self.end - self.start).astype(np.uint64))
        self.data = data

    def pick(self, at: np.ndarray) -> None:
        for name in ("row", "number", "start", "end", "point", "length", "hash"):
            if hasattr(self, name):
                setattr(self, name, getattr(self, name)[at])

    def piece(self, which: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of substrings given in code points of the lines."""
        first = self.point[which] + begin
        return run_hashes(self.sums, self.lead[first], self.lead[first + size], _BASE)


def segment(length: np.ndarray, edits: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``number`` (from 0) of lines of this length; the last segments take the remainder."""
    base, longer = length // (edits + 1), length % (edits + 1)
    short = edits + 1 - longer
    return number * base + np.maximum(0, number - short), base + (number >= short)


def signatures(lines: Lines, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, line positions, and 0 for an own segment (the index) or 1 for a substring that only probes: what similar lines
    of the same or smaller length index."""
    keys, which, probes = [], [], []
    for gap in range(edits + 1):
        for t in range(max(1, gap), edits + 1):
            own = np.flatnonzero((lines.length > gap) & (allowed(lines.length - gap, edits) == t))
            if not len(own):
                continue
            short = lines.length[own] - gap
            for i in range(t + 1):
                start, size = segment(short, t, i)
                # An edit script of at most t steps shifts segment i by no more than i steps before and t - i after it.
                low = np.maximum(np.maximum(start - i, start + gap - (t - i)), 0)
                high = np.minimum(np.minimum(start + i, start + gap + (t - i)), short + gap - size)
                for step in range(2 * t + 1):
                    ok = low + step <= high
                    if not ok.any():
                        break
                    at = own[ok]
                    piece = lines.piece(at, (low + step)[ok], size[ok])
                    code = (short[ok] * 64 + t * 8 + i).astype(np.uint64)
                    keys.append(mix(piece ^ mix(code + np.uint64(1))))
                    which.append(at)
                    probes.append(((low + step)[ok] != start[ok]) | (gap > 0))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    return np.concatenate(keys), np.concatenate(which), np.concatenate(probes).astype(np.int8)


def _parsed(docs: DataFrame, text: str) -> DataFrame:
    """Rows of ``docs`` without ``text``, with ``n_lines`` and ``_lines``: number and hash of every line."""

    def compute(batches):
        for batch in batches:
            sizes, number, line = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for chunk in chunks(batch.column(text), VISIBLE):
                lines = Lines(chunk)
                sizes.append(np.bincount(lines.row, minlength=chunk.rows))
                number.append(lines.number.astype(np.int32))
                line.append(signed(lines.hash))
            sizes = np.concatenate(sizes).astype(np.int64)
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(number)), pa.array(np.concatenate(line))], names=["number", "line"])
            yield [pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), each)]

    return append_columns(docs, "n_lines long, _lines array<struct<number:int,line:long>>", compute, hidden=(text,))


def _places(parsed: DataFrame, id: str) -> DataFrame:
    """``doc``, ``key``, ``number``, ``line`` (hash) of every line."""
    return parsed.select(F.col(id).alias("doc"), F.col("_key").alias("key"), F.inline("_lines"))


def _index(docs: DataFrame, edits: int) -> DataFrame:
    """``(segment, line, probe)``, each line once per chunk."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), VISIBLE):
                lines = Lines(chunk, points=True)
                lines.pick(np.unique(lines.hash, return_index=True)[1])
                keys, which, probes = signatures(lines, edits)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(signed(lines.hash[which])), pa.array(probes)], names=["segment", "line", "probe"])

    return docs.select("text").mapInArrow(run, "segment long, line long, probe byte")


def _texts(docs: DataFrame) -> DataFrame:
    """``(line, content)``, each line once per chunk."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), VISIBLE):
                lines = Lines(chunk)
                lines.pick(np.unique(lines.hash, return_index=True)[1])
                raw = lines.data.tobytes()
                content = [raw[a:b] for a, b in zip(lines.start.tolist(), lines.end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(signed(lines.hash)), pa.array(content, pa.binary())], names=["line", "content"])

    return docs.select("text").mapInArrow(run, "line long, content binary")


def shared_segments(index: DataFrame) -> DataFrame:
    """Rows of ``(segment, line, probe)`` whose segment more than one line has, a line once, as index if it is that.

    One exchange of all rows, sorted by segment alone, which Spark does by radix. Runs of equal segments pass by; of a run
    that goes on in the next batch only its first line is held, until another line follows. What is left is few rows, of
    which those that came in different batches are united.
    """
    names = ["segment", "line", "probe"]

    def run(batches):
        held = None  # the open run while it has one line: segment, line, least probe
        passed = None  # the segment of the open run once it has more lines
        for batch in batches:
            seg, line, probe = (batch.column(c).to_numpy() for c in names)
            if held is not None:
                seg, line, probe = np.append(held[0], seg), np.append(held[1], line), np.append(held[2], probe)
                held = None
            if not len(seg):
                continue
            first = np.append(True, seg[1:] != seg[:-1])
            run_ = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            shared = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
            if passed is not None and passed == seg[0]:
                shared[0] = True
            passed = seg[-1] if shared[-1] else None
            if not shared[-1]:
                own = slice(starts[-1], len(seg))
                held = seg[own][:1], line[own][:1], probe[own].min(keepdims=True)
            keep = shared[run_]
            if keep.any():
                seg, line, probe = seg[keep], line[keep], probe[keep]
                order = np.lexsort((probe, line, seg))
                seg, line, probe = seg[order], line[order], probe[order]
                once = np.append(True, (seg[1:] != seg[:-1]) | (line[1:] != line[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (seg, line, probe)], names=names)

    passed = dealt_by(index, "segment").mapInArrow(run, "segment long, line long, probe byte")
    return passed.groupBy("segment", "line").agg(F.min("probe").alias("probe"))


def within_edits(a: list[np.ndarray], b: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its limit, by banded bit vectors over all pairs at once.

    Bit 63 of a vector is the cell ``limit`` places above the diagonal; the band moves down one place per code point.
    """
    n = len(a)
    out = np.zeros(n, bool)
    swap = [len(x) > len(y) for x, y in zip(a, b)]
    x = [q if s else p for p, q, s in zip(a, b, swap)]  # the shorter one
    y = [p if s else q for p, q, s in zip(a, b, swap)]
    lx, ly = np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64)
    out[ly == 0] = True
    alive = np.flatnonzero((ly > 0) & (ly - lx <= limit))
    width = int(limit.max(initial=0))
    fx, fy = np.concatenate([*x, np.zeros(1, np.uint32)]), np.concatenate([*y, np.zeros(1, np.uint32)])
    sx, sy = np.concatenate([[0], np.cumsum(lx)])[:-1], np.concatenate([[0], np.cumsum(ly)])[:-1]
    k = limit.astype(np.int64)
    one = np.uint64(1)
    full = np.uint64(2**64 - 1)
    vp = full << (63 - k).astype(np.uint64)
    vn = np.zeros(n, np.uint64)
    score = np.minimum(k, lx)
    top = np.uint64(1) << np.uint64(63)
    step = 0
    while len(alive):
        j = np.full(len(alive), step)
        p = alive
        char = fy[sy[p] + j]
        match = np.zeros(len(p), np.uint64)
        for d in range(-width, width + 1):  # row step + d of the shorter line sits at bit 63 - k + d
            row = j + d
            inside = (np.abs(d) <= k[p]) & (row >= 0) & (row < lx[p])
            hit = inside & (fx[np.where(inside, sx[p] + row, 0)] == char)
            match |= np.where(hit, one << (63 - k[p] + np.minimum(d, k[p])).astype(np.uint64), np.uint64(0))
        v, w = vp[p], vn[p]
        d0 = (((match & v) + v) ^ v) | match | w
        hp = w | ~(d0 | v)
        hn = d0 & v
        diagonal = step < lx[p] - k[p]
        # Along the lower edge of the band first, then along the last row of the shorter line.
        place = np.where(diagonal, 0, step - (lx[p] - k[p]) + 1)
        mark = top >> np.minimum(place, 63).astype(np.uint64)
        add = np.where(diagonal, (d0 & top) == 0, (hp & mark) != 0).astype(np.int64)
        take = np.where(diagonal, 0, (hn & mark) != 0).astype(np.int64)
        score[p] += add - take
        d1 = d0 >> one
        vp[p] = hn | ~(d1 | hp)
        vn[p] = d1 & hp
        step += 1
        done = step >= ly[p]
        out[p[done]] = score[p[done]] <= limit[p[done]]
        # A score can still fall by one for each column along the last row, and by no more than the band is wide.
        hopeless = score[p] - np.minimum(np.maximum(ly[p] - step, 0), 2 * k[p]) > limit[p]
        alive = p[~done & ~hopeless]
    return out


def _verify(batches, edits: int):
    """Links ``(a, b)`` from rows sorted by ``tile_pair``; all pairs of many tiles are verified in one go."""

    def links(part: pa.Table):
        tile, side, probe = (part.column(c).to_numpy() for c in ("tile_pair", "side", "probe"))
        names = part.column("line").to_numpy()
        content = [np.frombuffer(c.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for c in part.column("content").to_pylist()]
        length = np.array([len(c) for c in content])
        limit = allowed(length, edits)
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(tile) != 0)), len(tile))
        left, right = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a == 2:
                if (side[a] != side[a + 1] or side[a] == 2) and not (probe[a] and probe[a + 1]):
                    left.append(np.array([a]))
                    right.append(np.array([a + 1]))
                continue
            i, j = np.triu_indices(b - a, 1)
            use = ((side[a + i] != side[a + j]) | (side[a + i] == 2)) & ((probe[a + i] & probe[a + j]) == 0)
            left.append(a + i[use])
            right.append(a + j[use])
        i, j = (np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (left, right))
        most = np.minimum(limit[i], limit[j])
        near = (names[i] != names[j]) & (np.abs(length[i] - length[j]) <= most)
        i, j, most = i[near], j[near], most[near]
        for a in range(0, len(i), 20000):
            p, q = i[a : a + 20000], j[a : a + 20000]
            ok = within_edits([content[x] for x in p], [content[x] for x in q], most[a : a + 20000])
            root = star_roots(names, p[ok], q[ok])
            linked = root != names
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(root[linked])], names=["a", "b"])

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*rest, batch]).combine_chunks()
        tile = whole.column("tile_pair").to_numpy()
        cut = int(np.searchsorted(np.cumsum(tile[::-1] != tile[-1]) > 0, True)) if len(tile) else 0
        keep = len(tile) - cut
        rest = whole.slice(keep).to_batches()
        for a in _windows(tile[:keep], 4000):
            yield from links(whole.slice(*a))
    if rest:
        yield from links(pa.Table.from_batches(rest))


def _windows(tile: np.ndarray, rows: int):
    """Cut sorted keys into stretches of whole tiles of about ``rows`` rows."""
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(tile) != 0)), len(tile)) if len(tile) else np.array([0])
    begin = 0
    while begin < len(tile):
        end = int(cuts[min(np.searchsorted(cuts, begin + rows), len(cuts) - 1)])
        yield begin, end - begin
        begin = end


def line_links(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Verified links ``(a, b)`` between hashes of different lines that connect all similar lines."""
    shared = cut_lineage(shared_segments(_index(docs, edits)))
    # A segment that lines only probe has no pair of index and probe. Buckets with the same lines in the same parts meet once.
    buckets = shared.groupBy("segment").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("line", "probe")).alias("members"), F.min("probe").alias("least")
    ).where("least = 0")
    once = buckets.groupBy("size", "members").agg(F.min("segment").alias("segment"))
    members = shared.join(once.select("segment", "size"), "segment")
    dealt = cut_lineage(tiled(members, "segment", "size", TILE, node="line").select("tile_pair", "side", "line", "probe"))
    texts = _texts(docs).join(dealt.select("line").distinct(), "line").groupBy("line").agg(F.any_value("content").alias("content"))
    rows = dealt_by(dealt.join(texts, "line"), "tile_pair")
    return rows.mapInArrow(lambda batches: _verify(batches, edits), "a long, b long")


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """``key``, ``removed`` (sorted numbers of the lines that go) and ``known`` (of all lines that also occur elsewhere) of
    every row with such lines; ``key`` is a hash of id and text. Equal rows are one: ``removed`` is that of the first copy,
    and of the others all lines go, which are ``known``."""
    parsed = cut_lineage(_parsed(docs.select(F.col(id).alias("doc"), F.xxhash64(id, text).alias("_key"), F.col(text).alias("text")), "text"))
    return _repeated(_places(parsed, "doc"), docs.select(F.col(text).alias("text")), edits)


def _repeated(places: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "key", "number")
    firsts = places.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    classes = components(line_links(texts, edits)).toDF("line", "class")
    known = cut_lineage(firsts.join(classes, "line", "left").where((F.col("times") > 1) | F.col("class").isNotNull()))
    first = known.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("first").alias("class_first"))
    known = known.join(first, "class", "left").select("line", F.coalesce("class_first", "first").alias("first"))
    found = places.join(known, "line").withColumn("goes", ~place.eqNullSafe(F.col("first")))
    gone = F.collect_set(F.when(F.col("goes"), F.col("number")))
    return found.groupBy("key").agg(F.sort_array(gone).alias("removed"), F.sort_array(F.collect_set("number")).alias("known"))


def deduplicate_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, with_text: bool = True) -> DataFrame:
    """All rows of ``docs`` with ``n_lines``, ``n_removed``, ``removed`` (line numbers from 0) and, if wanted, ``kept_text``."""
    plain = without(docs, ["n_lines", "n_removed", "removed", "kept_text", "_key", "_lines", "_removed", "_row"])
    keyed = plain.withColumn("_key", F.xxhash64(id, text))
    if not with_text:
        # Lines are counted and their places taken in one pass over the text; the text itself is not moved.
        keyed = _parsed(keyed, text)
    # Numbers of rows have to be the same wherever they are read.
    numbered = cut_lineage(keyed.withColumn("_row", F.monotonically_increasing_id()))
    stays = numbered.groupBy("_key").agg(F.count("*").alias("copies"), F.min("_row").alias("stays")).where("copies > 1").select("_key", "stays")
    if with_text:
        found = repeated_lines(plain, id, text, edits)
    else:
        found = _repeated(_places(numbered, id), plain.select(F.col(text).alias("text")), edits)
        numbered, keyed = numbered.drop("_lines"), keyed.drop("_lines")
    cuts = found.withColumnRenamed("key", "_key").join(stays, "_key", "left")
    # Exchanged again, so that Spark may split the join if a row has very many copies; one by the key itself is dropped.
    cuts = cuts.repartition(F.xxhash64("_key"))
    own = F.when(F.col("_row") != F.col("stays"), F.col("known")).otherwise(F.col("removed"))
    marked = numbered.join(cuts, "_key", "left").withColumn("_removed", F.coalesce(own, F.array().cast("array<int>")))
    marked = marked.select(*[f"`{c}`" for c in keyed.columns if c != "_key"], "_removed")
    if not with_text:
        return marked.withColumnRenamed("_removed", "removed").withColumn("n_removed", F.size("removed").cast("long"))

    def compute(batches):
        for batch in batches:
            data, at = raw_text(batch.column(text))
            n, gone, kept = [], [], []
            for a, b, cut in zip(at[:-1], at[1:], batch.column("_removed").to_pylist()):
                lines = data[a:b].tobytes().split(b"\n")
                n.append(sum(1 for x in lines if x.strip()))
                gone.append(cut)
                drop = set(cut)
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop))
            yield [
                pa.array(n, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string()),
            ]

    ddl = "n_lines long, n_removed long, removed array<int>, kept_text string"
    return append_columns(marked, ddl, compute, hidden=("_removed",))
