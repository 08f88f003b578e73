"""Set-similarity join of documents on word shingles by chosen paths.

Every set is embedded as 128 min-wise tokens. A run starts with all sets in one bucket and splits buckets recursively: a
bucket samples two token positions, and sets with the same token at a sampled position go to the same child. Two sets of
similarity s stay together in a child with probability 1 - (1 - s)^2 per level; the chance to stay together down to any
depth solves p = 1 - (1 - s p)^2, which is 0.9375 at s = 0.8. Runs repeat until the chance that all of them part a pair is
below ``1 - recall``. Small buckets are compared outright, by their tokens; so is a bucket that does not shrink, since its
members are alike: what agrees with the bucket's most frequent tokens is linked, and the rest is compared with everyone in
tiles.

Candidates meet the truth afterwards: inside every group connected by candidate links, all pairs are decided on their whole
shingle sets. So links are counted exactly, however often or seldom the paths brought a pair together, and a group needs
only one surviving path between its members. Documents with the same words are one set with a weight.

A group of up to ``TILE`` sets and ``TILE_BYTES`` is one tile. A larger one gets a centre, the shingles that most of a
sample of its members have, and four shells of distance from it. Jaccard distance is a metric, so two shells whose outer
distances add up to no more than what is allowed are linked wholesale; only pairs of the other shells are compared, tile by
tile. The sample decides how much is compared, never what is found.

Defined results: words are lower-case runs of letters, digits and non-ASCII characters; a text of 1 to 4 words has itself
as its only shingle; NULL and wordless texts link with nothing; repeated rows link with each other; a NULL id is kept, and
the class id is the smallest non-NULL id; an empty table gives no rows; input columns named like result columns are
replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.frames import components, map_sorted_groups, star_roots, tiled, tiled_around, without
from cohortline.llm.text import ALNUM, Chunk, Runs, chunks, mix, signed
from cohortline.session import cut_lineage

SHINGLE = 5
TOKENS = 128
BRANCH = 2
LEAF = 128
#: Most members of a tile (signatures have 512 bytes each), and about how many bytes of shingles.
TILE = 4096
TILE_BYTES = 8 << 20
DEPTH = 8
#: About how many members of a large group its centre is taken from, and shells around it.
CENTRE = 256
SHELLS = 4

_MULTIPLIERS = np.random.default_rng(128).integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def survival(similarity: float, branch: int = BRANCH) -> float:
    """Chance that a pair stays together down to any depth of one run."""
    p = 1.0
    for _ in range(1000):
        p = 1 - (1 - similarity * p) ** branch
    return p


def runs_needed(similarity: float, recall: float, branch: int = BRANCH) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, branch))))


def _shingles(chunk: Chunk, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in a row, and the offsets of the rows; a short text is one shingle."""
    counts = chunk.counts
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    rows = np.repeat(np.arange(chunk.rows), n)
    start = chunk.word_offsets[:-1][rows] + np.arange(at[-1]) - at[:-1][rows]
    end = np.minimum(start + SHINGLE, chunk.word_offsets[1:][rows])
    return Runs(hashes).of(start, end), at


def _prepare(docs: DataFrame) -> DataFrame:
    """``key``, ``id``, ``node`` (NULL without words) and ``sig`` of every row of ``docs(key, id, text)``."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), ALNUM, lower=True):
                hashes = chunk.word_hashes()
                shingles, at = _shingles(chunk, hashes)
                has = np.diff(at) > 0
                starts = at[:-1][has]
                sig = np.zeros((len(starts), TOKENS), np.uint32)
                if len(starts):
                    for i, a in enumerate(_MULTIPLIERS):
                        sig[:, i] = np.minimum.reduceat(shingles * a, starts) >> np.uint64(32)
                a, b = chunk.word_offsets[:-1], chunk.word_offsets[1:]
                node = mix(Runs(hashes).of(a, b) ^ (Runs(mix(hashes + np.uint64(1))).of(a, b) * np.uint64(3)) ^ (b - a).astype(np.uint64))
                rows = batch.slice(chunk.first, chunk.rows)
                found = np.full(chunk.rows, -1)
                found[has] = np.arange(has.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("key"),
                        rows.column("id"),
                        pa.array(signed(node), mask=~has),
                        pa.array([sig[i].tobytes() if i >= 0 else None for i in found], pa.binary()),
                    ],
                    names=["key", "id", "node", "sig"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("key", "id", "text").mapInArrow(run, f"key long, id {kind}, node long, sig binary")


def _token(at) -> F.Column:
    """Token number ``at`` of a signature."""
    return F.substring("sig", at * 4 + 1, F.lit(4))


def _children(parents: DataFrame) -> DataFrame:
    """``(path, node, size)`` to ``(path, node, parent_size)``: both sampled positions of a bucket follow from its path."""
    draws = F.explode(F.sequence(F.lit(1), F.lit(BRANCH))).alias("draw")
    drawn = parents.select("node", "sig", F.col("size").alias("parent_size"), "path", draws)
    at = F.pmod(F.xxhash64("path", "draw"), F.lit(TOKENS)).cast("int")
    return drawn.withColumn("at", at).select(F.xxhash64("path", "draw", _token(F.col("at"))).alias("path"), "node", "parent_size")


def chosen_path_buckets(sets: DataFrame, similarity: float, recall: float, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Final buckets ``(path, node, size)`` of all runs over ``sets(node, sig)``; of equal final buckets one is kept."""
    runs = F.explode(F.array(*[F.lit(r) for r in range(runs_needed(similarity, recall))])).alias("run")
    level = sets.select("node", "sig", runs).select("node", "sig", F.lit(None).cast("long").alias("size"), F.xxhash64("run").alias("path"))
    leaves = []
    for step in range(1, depth + 1):
        split = cut_lineage(_children(level))
        buckets = split.groupBy("path").agg(
            F.count("*").alias("size"), F.max("parent_size").alias("parent_size"), F.bit_xor(F.xxhash64("node")).alias("members")
        ).where("size > 1")
        stuck = F.col("parent_size").isNotNull() & (F.col("size") * 2 > F.col("parent_size"))
        done = (F.col("size") <= leaf) | stuck if step < depth else F.lit(True)
        alike = buckets.withColumn("final", done).groupBy("size", "members").agg(F.max("final").alias("final"), F.collect_list("path").alias("paths"))
        # Buckets with the same members would be compared for the same result. Those that are split again are not merged:
        # the chance to find a pair counts on each of their paths.
        paths = F.explode(F.when(F.col("final"), F.array(F.array_min("paths"))).otherwise(F.col("paths")))
        placed = cut_lineage(split.select("path", "node").join(alike.select(paths.alias("path"), "size", "final"), "path"))
        leaves.append(placed.where("final").select("path", "node", "size"))
        open_ = placed.where("NOT final").select("path", "node", "size")
        if open_.isEmpty():
            break
        level = open_.join(sets, "node")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def _pairs(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(side == 2)
    if len(own):
        return own, own
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _around_centres(members: DataFrame, group: str, payload: str, centre, shells) -> DataFrame:
    """Rows of ``members`` (with ``size``, the members of the group) and ``shell``, from a centre of the group's own.

    ``centre`` makes a payload of the sample's; ``shells`` gets the payloads of members of one group and the centre's.
    """
    sample = members.where(F.pmod(F.xxhash64("node", F.lit("centre")), F.col("size")) < CENTRE).select(group, "node", payload)

    def made(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        return pa.table({group: part.column(group)[:1], "_centre": pa.array([centre(part.column(payload).to_pylist())], pa.binary())})

    centres = sample.groupBy(group).applyInArrow(made, f"{group} long, _centre binary")
    both = members.join(centres, group, "left").sortWithinPartitions(group)
    kept = [f for f in members.schema.fields]

    def run(batches):
        for batch in batches:
            keys = batch.column(group).to_numpy(zero_copy_only=False)
            out = np.full(len(keys), SHELLS - 1, np.int32)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                point = batch.column("_centre")[a].as_py() if b > a else None
                if point is not None:
                    out[a:b] = shells(batch.column(payload).slice(a, b - a).to_pylist(), point)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out)], names=[*(f.name for f in kept), "shell"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return both.mapInArrow(run, f"{ddl}, shell int")


def _common_tokens(signatures: list[bytes]) -> bytes:
    """The most frequent token of every position."""
    own = np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, TOKENS)
    out = np.empty(TOKENS, np.uint32)
    for i in range(TOKENS):
        values, times = np.unique(own[:, i], return_counts=True)
        out[i] = values[times.argmax()]
    return out.tobytes()


def _common_shingles(sets: list[bytes]) -> bytes:
    """The shingles of more than half of the sets, sorted."""
    values, times = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in sets]), return_counts=True)
    return values[2 * times > len(sets)].tobytes()


def candidate_links(buckets: DataFrame, sets: DataFrame, similarity: float, leaf: int = LEAF) -> DataFrame:
    """Links ``(a, b)`` that connect what the tokens call similar (four standard errors are allowed): every bucket gives
    at most one link per member, to the smallest member it reaches."""
    floor = max(0.0, similarity - 4 * math.sqrt(similarity * (1 - similarity) / TOKENS)) * TOKENS

    def work(part: pa.Table):
        nodes = part.column("node").to_numpy()
        left, right = _pairs(part.column("side").to_numpy())
        if len(left) < 1 or len(right) < 1:
            return None
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, TOKENS)
        la, lb = [], []
        for i in range(0, len(left), 16):
            rows, cols = np.nonzero((sig[left[i : i + 16], None, :] == sig[None, right, :]).sum(2) >= floor)
            la.append(left[i + rows])
            lb.append(right[cols])
        root = star_roots(nodes, np.concatenate(la), np.concatenate(lb))
        linked = root != nodes
        return [nodes[linked], root[linked]]

    def agreeing(members: list[bytes], centre: bytes) -> np.ndarray:
        own = np.frombuffer(b"".join(members), np.uint32).reshape(-1, TOKENS)
        return np.where((own == np.frombuffer(centre, np.uint32)).sum(1) >= floor, 0, 1)

    # In a large bucket, members that agree with its centre are linked to each other; candidates may be too many, never too
    # few, so it does not matter that two of them need not agree. Only the others meet everyone.
    large = buckets.where(F.col("size") > leaf).join(sets, "node")
    placed = cut_lineage(_around_centres(large, "path", "sig", _common_tokens, agreeing).select("path", "node", (F.col("shell") == 0).alias("near")))
    pivots = placed.where("near").groupBy("path").agg(F.min("node").alias("pivot"))
    through = placed.where("near").join(pivots, "path").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    marked = placed
    small = tiled(buckets.where(F.col("size") <= leaf), "path", "size", leaf).select("tile_pair", "side", "node")
    dealt = small.union(tiled_around(marked, "path", TILE).select("tile_pair", "side", "node"))
    return map_sorted_groups(dealt.join(sets, "node"), "tile_pair", "a long, b long", work).union(through)


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """``sets(key, node, ...)`` with ``shingles``: sorted distinct 64-bit hashes as bytes."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), ALNUM, lower=True):
                shingles, at = _shingles(chunk, chunk.word_hashes())
                rows = batch.slice(chunk.first, chunk.rows)
                sets = [np.unique(shingles[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), pa.array(sets, pa.binary())], names=[*(f.name for f in kept), "shingles"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{ddl}, shingles binary")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets. Only shingles that two sets share take part."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left], np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 1024
    for begin in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [begin, begin + width])
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[a:b], token[a:b] - begin] = 1
        out += grid[left] @ grid[right].T
    return out


def verified_links(members: DataFrame, similarity: float, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``node``, ``links`` (weight of its similar sets, in parts) and ``root`` (smallest set reached) over
    ``members(component, size, node, weight, shingles)``."""
    step = (1 - similarity) / SHELLS

    def work(part: pa.Table):
        left, right = _pairs(part.column("side").to_numpy())
        if len(left) < 1 or len(right) < 1:
            return None
        nodes, weight = part.column("node").to_numpy(), part.column("weight").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in part.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        overlaps = _overlaps(sets, left, right)
        same = left is right
        links, root = np.zeros(len(nodes), np.int64), nodes
        for i in range(0, len(left), 256):
            own, both = left[i : i + 256], overlaps[i : i + 256].astype(np.int64)
            similar = both >= similarity * (sizes[own][:, None] + sizes[right][None, :] - both) - 1e-9
            if same:
                similar[np.arange(len(own)), np.arange(i, i + len(own))] = False
            links[own] += similar @ weight[right]
            if not same:
                links[right] += similar.T @ weight[own]
            rows, cols = np.nonzero(similar)
            root = star_roots(root, own[rows], right[cols])
        return [nodes, links, root]

    def shells(sets: list[bytes], centre: bytes) -> np.ndarray:
        own = [np.frombuffer(s, np.uint64) for s in sets]
        point = np.frombuffer(centre, np.uint64)
        sizes = np.array([len(s) for s in own])
        every = np.concatenate(own)
        at = np.minimum(np.searchsorted(point, every), max(len(point) - 1, 0))
        held = point[at] == every if len(point) else np.zeros(len(every), bool)
        both = np.add.reduceat(held, np.cumsum(sizes) - sizes)
        union = sizes + len(point) - both
        distance = (union - both + 1e-9 * union) / union
        return np.minimum(np.ceil(distance / step) - 1, SHELLS - 1)

    members = cut_lineage(members.withColumn("bytes", F.octet_length("shingles")))
    totals = members.groupBy("component").agg(F.sum("bytes").alias("all_bytes"))
    sized = members.join(totals, "component").withColumn("large", (F.col("size") > tile) | (F.col("all_bytes") > tile_bytes))
    small = sized.where("NOT large").select(F.col("component").alias("tile_pair"), F.lit(2).alias("side"), "node", "weight", "shingles")
    large = sized.where("large").select("component", "size", "node", "weight", "bytes", "shingles")
    placed = cut_lineage(_around_centres(large, "component", "shingles", _common_shingles, shells).drop("shingles"))
    inside, pairs = _shell_pairs(placed, tile, tile_bytes)
    across = pairs.join(members.select("node", "weight", "shingles"), "node").select("tile_pair", "side", "node", "weight", "shingles")
    return map_sorted_groups(small.union(across), "tile_pair", "node long, links long, root long", work).union(inside)


def _linked_shells(s: int) -> list[int]:
    """Shells whose members are all within the allowed distance of those of shell ``s``."""
    return [u for u in range(SHELLS - 1) if s < SHELLS - 1 and s + u + 2 <= SHELLS]


def _shell_pairs(placed: DataFrame, tile: int, tile_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Of ``placed(component, node, weight, bytes, shell)``: what is linked wholesale (``node``, ``links``, ``root``), and
    ``(tile_pair, side, node)`` of what must be compared: every pair of members of two undecided shells meets once."""
    counts = placed.groupBy("component", "shell").agg(
        F.sum("weight").alias("w"), F.min("node").alias("low"), F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("bytes") / tile_bytes)).cast("int").alias("tiles")
    )
    of = lambda name, s, none: F.coalesce(F.max(F.when(F.col("shell") == s, F.col(name))), F.lit(none))
    columns = [of(name, s, none).alias(f"{name}{s}") for name, none in (("w", 0), ("tiles", 0), ("low", None)) for s in range(SHELLS)]
    dealt = placed.join(counts.groupBy("component").agg(*columns), "component")

    def by_shell(value) -> F.Column:
        out = F.lit(None)
        for s in range(SHELLS):
            out = F.when(F.col("shell") == s, value(s)).otherwise(out)
        return out

    total = by_shell(lambda s: sum((F.col(f"w{u}") for u in _linked_shells(s)), F.lit(0)) - (F.col("weight") if s in _linked_shells(s) else F.lit(0)))
    root = by_shell(lambda s: F.array_min(F.array(F.col("node"), *(F.col(f"low{u}") for u in _linked_shells(s)))))
    inside = dealt.select("node", total.cast("long").alias("links"), root.cast("long").alias("root"))

    own = F.pmod(F.xxhash64("node"), by_shell(lambda s: F.col(f"tiles{s}"))).cast("int")
    place = lambda s, t: F.lit(s << 40).cast("long") + t

    def tiles_of(u: int) -> F.Column:
        tiles = F.col(f"tiles{u}")
        every = F.filter(F.sequence(F.lit(0), F.greatest(tiles, F.lit(1)) - 1), lambda v: v < tiles)
        return F.transform(every, lambda v: place(u, v))

    def goals(s: int) -> F.Column:
        here = place(s, F.col("_t"))
        return F.transform(
            F.concat(*[tiles_of(u) for u in range(SHELLS) if u not in _linked_shells(s)]),
            lambda there: F.struct(
                F.xxhash64("component", F.least(here, there), F.greatest(here, there)).alias("tile_pair"),
                F.when(here == there, 2).when(here < there, 0).otherwise(1).alias("side"),
            ),
        )

    sent = dealt.withColumn("_t", own).select("node", F.explode(by_shell(goals)).alias("_g"))
    return inside, sent.select("_g.tile_pair", "_g.side", "node")


def similar_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = 0.8, recall: float = 0.9999, tile: int = TILE, tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """``key``, ``id``, ``class_id``, ``n_links`` and ``chosen`` (key of the document that stands for the class) of every
    row; ``key`` is a hash of id and text."""
    keyed = docs.select(F.xxhash64(id, text).alias("key"), F.col(id).alias("id"), F.col(text).alias("text"))
    prepared = cut_lineage(_prepare(keyed))
    sets = cut_lineage(
        prepared.where(F.col("node").isNotNull()).groupBy("node").agg(
            F.count("*").alias("weight"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first"), F.any_value("sig").alias("sig")
        )
    )
    signed_sets = sets.select("node", "sig")
    candidates = components(candidate_links(chosen_path_buckets(signed_sets, similarity, recall), signed_sets, similarity))
    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"))
    wanted = candidates.join(sizes, "component").join(sets.select("node", "weight", "first.key"), "node")
    whole = wanted.join(keyed.select("key", "text"), "key").select("node", "component", "size", "weight", "text")
    # Equal rows share a key; their sets are equal, and one is enough.
    once = _shingle_sets(whole).dropDuplicates(["node"])
    checked = cut_lineage(verified_links(once, similarity, tile, tile_bytes))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = sets.select("node", "weight", "first").join(links, "node", "left").join(classes, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    first = placed.groupBy("component").agg(F.min("first").alias("first"))
    named = placed.drop("first").join(first, "component").select(
        "node", F.col("first.id").alias("class_id"), F.col("first.key").alias("chosen"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return prepared.select("key", "id", "node").join(named, "node", "left").select(
        "key", "id",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("chosen", "key").alias("chosen"),
    )


def one_of_each_class(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of every class the document with the smallest id; wordless texts stay."""
    found = similar_documents(docs, id, text, similarity, recall)
    kept = found.where("key = chosen").select(F.col("key").alias("_key")).distinct()
    plain = without(docs, ["_key"])
    # Rows without words link with nothing, so equal ones all stay. Of other equal rows one is kept, before they are exchanged.
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[0-9A-Za-z\x80-\x{10FFFF}]")
    once = plain.where(~wordless).withColumn("_key", F.xxhash64(id, text)).dropDuplicates(["_key"])
    columns = [f"`{c}`" for c in plain.columns]
    return once.join(kept, "_key").select(*columns).unionByName(plain.where(wordless).select(*columns))
