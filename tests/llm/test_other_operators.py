"""Archive, vectors, mixing, sharding and the pipeline."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from messy_fixtures import messy, messy_rows, nothing  # noqa: F401

from pyspark.sql import functions as F

import corpus_pipeline
from cohortline.llm import embedding_forest, frames, mixing, sharding, warc_store
from cohortline.session import cut_lineage
from test_text_operators import contamination, jaccard_classes

SMALL = "/root/testdata/sf0.001"

# --- archive


PAGES = [
    (3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (4, "http://c/\r\nx", ""), (5, "http://d/", "z" * 100000), (5, "http://d/", "z" * 100000),
    (None, "http://e/", "<p>é</p>"), (None, "http://f/", "alone"), (7, "http://g/", "line\r\n\r\nbreak"),
]


@pytest.fixture(scope="module")
def archive(spark):
    path = frames.shared_folder(spark, "archive")
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, header string")
    warc_store.write_archive(pages, path)
    return path


def test_archive_round_trip(spark, archive):
    rows = warc_store.read_records(spark, archive).collect()
    assert Counter((r["page_id"], r["payload_bytes"]) for r in rows) == Counter((p, len((h or "").encode())) for p, _, h in PAGES)
    digests = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in PAGES}
    assert {r["payload_digest"] for r in rows} == digests and all(r["digest_matches"] for r in rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in rows)
    assert kinds == Counter({
        (1, "response", None): 1, (3, "revisit", 1): 1, (None, "revisit", 1): 1, (2, "response", None): 1, (4, "revisit", 2): 1,
        (5, "response", None): 1, (5, "revisit", 5): 1, (None, "response", None): 1, (7, "response", None): 1,
    })
    assert spark.read.parquet(f"{archive}/payloads").count() == len({h or "" for _, _, h in PAGES})


def test_records_hold_header_and_payload(spark, archive):
    for r in warc_store.reconstruct(spark, archive).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert block == (bytes(r["payload"]) if r["record_type"] == "response" else b"") + b"\r\n\r\n" and len(block) == length + 4


def test_small_payloads_are_never_revisits(spark):
    path = frames.shared_folder(spark, "archive")
    warc_store.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path, revisit_from=9)
    kinds = Counter(r["record_type"] for r in warc_store.read_records(spark, path).where("payload_bytes < 9").collect())
    assert kinds == {"response": 3}


def test_damaged_payload_is_noticed(spark, archive):
    path = frames.shared_folder(spark, "archive")
    broken = spark.read.parquet(f"{archive}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    broken.write.parquet(f"{path}/payloads")
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{path}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc_store.read_records(spark, path).collect()


def test_empty_archive(spark):
    path = frames.shared_folder(spark, "archive")
    warc_store.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_store.read_records(spark, path).count() == 0


# --- vectors


def linked(vectors, floor=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None for (_, v), ok in zip(vectors, good)]
    n = len(vectors)
    link = [[i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= floor for j in range(n)] for i in range(n)]
    label = list(range(n))
    for i in range(n):
        for j in range(n):
            if link[i][j] and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    lowest = {g: min(vectors[i][0] for i in range(n) if label[i] == g) for g in set(label)}
    return Counter((vectors[i][0], sum(link[i]), lowest[label[i]]) for i in range(n))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_equal_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(0, None), (1, []), (2, [0.0] * 8), (3, [1.0] * 7 + [None]), (4, [float("nan")] + [1.0] * 7), (5, [float("inf")] * 8), (6, [1.0] * 4), (7, [2.0] * 4)]
    centres = rng.standard_normal((6, 8))
    for i in range(400):  # six clouds, some larger than a leaf, and strangers
        v = centres[i % 6] + rng.standard_normal(8) * (0.02, 0.1, 0.25, 0.4, 1.0, 2.0)[i % 6]
        rows.append((10 + i, np.float32(v).astype(float).tolist()))
    rows += [(1000, rows[20][1]), (1000, rows[20][1]), (1001, rows[20][1])]
    frame = spark.createDataFrame([(i, v, "extra") for i, v in rows], f"vec_id long, embedding array<{kind}>, node string").repartition(3)
    found = embedding_forest.near_duplicates(frame, leaf=32).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == linked(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    angle = np.arccos(0.951)
    twin = np.cos(angle) * base + np.sin(angle) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, twin]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = embedding_forest.near_duplicates(frame)
    assert found.agg(F.sum("n_links")).first()[0] >= 0.999 * 3000


def test_no_vectors(spark):
    assert embedding_forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- mixing


def wanted_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * level >= 2 * sizes[s]]
        if not above:
            return full | {s: weight[s] * level for s in open_}
        full |= {s: 2.0 * sizes[s] for s in above}


@pytest.mark.parametrize("block", [mixing.BLOCK, 64])
def test_mix_comes_near_its_targets(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, "s%d" % (0 if i % 3 == 0 else i % 11) if i % 50 else None, " w" * int(rng.lognormal(4, 1))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    units = mixing.mix_units(docs, block=block).collect()
    sizes, taken = Counter(), Counter()
    for _, s, t in rows:
        sizes[s] += len(t) // 2
    for u in units:
        taken[u["source"]] += u["copies"] * u["size"]
        assert 0 <= u["copies"] <= 2
    want = wanted_targets(sizes)
    for u in units:
        assert u["source_size"] == sizes[u["source"]] and abs(u["target"] - want[u["source"]]) < 1e-6 * max(1, want[u["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2, s
    again = mixing.mix_units(docs.repartition(2), block=block)
    assert Counter((u["doc_id"], u["copies"]) for u in units) == Counter((u["doc_id"], u["copies"]) for u in again.collect())


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 100, 500).astype(float).tolist()
    pi = [0.3] * 500
    left = mixing._flight(pi, size, rng)
    assert len(left) <= 2 and sum(0 < p < 1 for p in pi) <= 2
    assert abs(sum(pi) - 150) < 1e-6 and abs(np.dot(pi, size) - 0.3 * sum(size)) < 1e-4


def test_flight_is_fair():
    """Every document is taken as often as its probability says."""
    size = [float(s) for s in (1, 2, 3, 5, 8, 13, 21, 3, 3, 3)]
    times = np.zeros(10)
    for seed in range(3000):
        pi = [0.4] * 10
        mixing._flight(pi, size, np.random.default_rng(seed))
        times += pi
    assert np.abs(times / 3000 - 0.4).max() < 0.04


def test_mix_of_messy_rows(messy, messy_rows, nothing):
    units = mixing.mix_units(messy).collect()
    assert Counter(u["doc_id"] for u in units) == Counter(r[0] for r in messy_rows)
    mixed = mixing.mix(messy)
    assert mixed.columns == messy.columns
    copies = Counter()
    for u in units:
        copies[u["doc_id"]] += u["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert mixing.mix_units(nothing).count() == 0 and mixing.mix(nothing).count() == 0


# --- sharding


def test_shards_hold_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = sharding.with_positions(sharding.shard_records(docs, 16), ["doc_id"]).collect()
    loads, rows = Counter(), Counter()
    for r in placed:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        loads[r["shard"]] += r["size"]
        rows[r["shard"]] += 1
    assert len(loads) == 16 and max(loads.values()) <= 1.01 * min(loads.values())
    for s in loads:
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(rows[s]))


def test_messy_rows_are_all_placed(messy, messy_rows, nothing):
    placed = sharding.with_positions(sharding.shard_records(messy, 4), ["doc_id", "size"]).collect()
    assert Counter(r["doc_id"] for r in placed) == Counter(r[0] for r in messy_rows)
    assert all(r["text_crc32"] == 0 and r["size"] == 1 for r in placed if not r["text"])
    assert sharding.with_positions(sharding.shard_records(nothing, 4), ["doc_id"]).count() == 0


def test_map_versions(spark):
    slots = 64
    first = sharding.first_map(spark, 4, slots)
    totals = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") * F.col("id") + 1).alias("bytes"))
    second = sharding.edited_map(first, totals, 4)
    grown = sharding.edited_map(second, totals, 5)
    path = frames.shared_folder(spark, "map")
    for version in (first, second, grown):
        sharding.store_map(version, path)
    stored = sharding.stored_map(spark, path)
    assert stored.groupBy("version").count().count() == 3 and sharding.latest(stored).where("version = 3").count() == slots
    shard = {v: {r["virtual_slot"]: r["shard"] for r in stored.where(f"version = {v}").collect()} for v in (1, 2, 3)}
    size = {r["virtual_slot"]: r["bytes"] for r in totals.collect()}
    for v, n in ((2, 4), (3, 5)):
        loads = Counter()
        for s, k in shard[v].items():
            loads[k] += size[s]
        assert len(loads) == n and max(loads.values()) - min(loads.values()) <= max(size.values())
    moved = [s for s in shard[2] if shard[2][s] != shard[3][s]]
    # An edit moves little more than what the new shard has to hold.
    assert sum(size[s] for s in moved) <= 0.45 * sum(size.values())


# --- components and the pipeline


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 900), (902, 902)]
    found = {r["node"]: r["component"] for r in frames.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(101)}, **{i: 500 for i in range(500, 560)}, 900: 900, 901: 900}


def test_components_that_are_stars_need_no_round(spark, monkeypatch):
    edges = [(i % 7, 100 + i) for i in range(50)]
    cuts = []
    monkeypatch.setattr(frames, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    found = {r["node"]: r["component"] for r in frames.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{100 + i: i % 7 for i in range(50)}, **{i: i for i in range(7)}}
    assert len(cuts) == 1
    assert frames.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = frames.shared_folder(spark, name)
        stage(spark, before, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        if name != "mixing":
            assert 0 < after.count() < before.count() and after.exceptAll(before).count() == 0
        before = after
    sharded = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert sharded.select(*docs.columns).exceptAll(before).count() == 0 and sharded.count() == before.count()
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter(r["doc_id"] for r in sharded.collect())


def test_pipeline_stages_equal_brute_force(spark):
    """Which documents the second and third stage keep, on what the stage before kept; what the last two promise."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = frames.cut_lineage(stages["toxicity"](spark, docs, SMALL))
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    classes = {i: c for (i, c, _), n in jaccard_classes(rows).items() for _ in range(n)}
    single = frames.cut_lineage(stages["near_duplicates"](spark, kept, SMALL))
    ids = {r["doc_id"] for r in single.collect()}
    assert ids == set(classes.values()) and single.count() == len(ids)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    judged = contamination([r for r in rows if r[0] in ids], items)
    clean = frames.cut_lineage(stages["decontamination"](spark, single, SMALL))
    assert {r["doc_id"] for r in clean.collect()} == {key[0] for key in judged if key[-1] == "False"}
    mixed = frames.cut_lineage(stages["mixing"](spark, clean, SMALL))
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= {r["doc_id"] for r in clean.collect()} and max(times.values()) <= 2
    placed = stages["sharding"](spark, mixed, SMALL).collect()
    loads, places = Counter(), {}
    for r in placed:
        loads[r["shard"]] += len((r["text"] or "").encode()) + 1
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert Counter(r["doc_id"] for r in placed) == times


def test_pipeline_keeps_columns_that_clash(spark, messy, nothing):
    """Columns named like results, with dots, in another case; NULLs, empty and long texts, repeated rows; an empty table."""
    names = [*messy.columns, "toxic", "contaminated", "a.b", "TEXT_crc32", "_sum"]
    for rows in (messy, nothing):
        docs = rows.select("*", F.lit("mine").alias("toxic"), F.lit(7).alias("contaminated"), F.lit("dot").alias("a.b"), F.lit(1).alias("TEXT_crc32"), F.lit(2).alias("_sum"))
        assert docs.columns == names
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = frames.cut_lineage(stage(spark, docs, SMALL))
            assert docs.columns == names
        assert docs.where("toxic <> 'mine' OR contaminated <> 7 OR `a.b` <> 'dot' OR size <> -1").isEmpty()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert last.count() == docs.count() and len({c.lower() for c in last.columns}) == len(last.columns)


def test_shards_follow_the_stored_map(spark):
    path = frames.shared_folder(spark, "map")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    placed = sharding.shard_records(docs, 8, path=path)
    stored = sharding.stored_map(spark, path)
    assert {r["version"]: r["count"] for r in stored.groupBy("version").count().collect()} == {1: sharding.SLOTS, 2: sharding.SLOTS}
    shard = {r["virtual_slot"]: r["shard"] for r in stored.where("version = 2").collect()}
    rows = placed.collect()
    assert all(shard[r["virtual_slot"]] == r["shard"] for r in rows)
    import zlib

    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)


def test_page_ids_may_be_texts(spark):
    path = frames.shared_folder(spark, "named")
    pages = spark.createDataFrame([("b", "u", "x"), ("a", "u", "x"), ("c", "u", None)], "page_id string, url string, html string")
    warc_store.write_archive(pages, path)
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc_store.read_records(spark, path, "string").collect()}
    assert found == {"a": ("response", None, 1), "b": ("revisit", "a", 1), "c": ("response", None, 0)}


def test_rows_repeated_very_often_are_spread(spark):
    """A row that is ingested thousands of times fills neither one slot nor one shard; its copies are numbered without a gap."""
    from pyspark.sql import functions as F

    docs = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text")).withColumnRenamed("id", "doc_id")
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    placed = frames.cut_lineage(sharding.with_positions(sharding.shard_records(docs.unionByName(hot).repartition(5), 16), ["doc_id", "size"]))
    loads = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and placed.count() == 6000 and max(loads) <= 1.05 * min(loads)
    assert placed.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap")).where("gap <> 0").isEmpty()
    rare, often = frames.apart_if_hot(docs.unionByName(hot).withColumn("_row", F.xxhash64("doc_id", "text")), "_row", "n")
    assert rare.count() == 3000 and sorted(r["n"] for r in often.collect()) == list(range(3000))


def test_mixture_of_a_row_repeated_very_often(spark):
    from pyspark.sql import functions as F

    hot = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("a").alias("source"))
    rest = spark.range(500).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), F.lit("b").alias("source"))
    docs = frames.cut_lineage(hot.unionByName(rest).repartition(3))
    units = mixing.mix_units(docs)
    want = Counter({r["doc_id"]: r["n"] for r in units.groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()})
    assert Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == want and want[1] > 500
