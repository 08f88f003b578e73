"""Operators on texts against brute force, on messy rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from messy_fixtures import messy, messy_rows, nothing  # noqa: F401

from pyspark.sql import functions as F

from cohortline.llm import decontamination, jaccard_join, line_dedup, personal_data, substring_dedup, toxicity
from cohortline.llm.text import mix

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = {c: c + 32 for c in range(65, 91)}


def normal(text):
    return WORD.findall((text or "").translate(A_Z))


def by_text(df, *columns):
    return Counter((r["doc_id"], r["text"], *(str(r[c]) for c in columns)) for r in df.collect())


# --- decontamination


def contamination(rows, items):
    windows = {}
    for item, text in items:
        w = normal(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("" if item is None else str(item))
    out = Counter()
    for row in rows:
        w, hit, found = normal(row[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        bad = len(hit) > 0 and 20 * len(hit) >= len(w)
        out[(row[0], row[1], str(len(w)), str(len(hit)), str(sorted(found)), str(bad))] += 1
    return out


@pytest.fixture(scope="module")
def items(messy_rows):
    base = messy_rows[5][1].split()
    return [(1, " ".join(base[20:60])), (2, "one"), (3, "three FOUR"), (None, " ".join(base[100:113])), (4, None), (5, ""), (1, "中文"), (6, messy_rows[9][1][-300:])]


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 400])
def test_contamination_equals_brute_force(spark, messy, messy_rows, items, block_bytes):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(messy, benchmark, block_bytes=block_bytes)
    assert by_text(found, "n_words", "n_hit", "items", "contaminated") == contamination(messy_rows, items)


def test_spans_are_offsets_of_the_original(spark):
    text = "Zwölf: ALPHA, beta!no gamma -- délta"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "alpha beta"), (2, "gamma délta")], "item_id long, text string")
    row = decontamination.find_contamination(docs, benchmark).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["ALPHA, beta", "gamma -- délta"]


def test_contamination_of_nothing(spark, messy, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(messy, none).where("n_hit > 0 OR contaminated").count() == 0
    assert decontamination.find_contamination(nothing, none).count() == 0


# --- n-gram Jaccard join


def jaccard_classes(rows):
    sets = []
    for row in rows:
        w = normal(row[1])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    link = [[i != j and a and b and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in range(len(rows)):
                if link[todo[-1]][j] and j not in seen:
                    seen.add(j)
                    todo.insert(0, j)
            todo.pop()
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, sum(map(bool, link[i]))))
    return Counter(out)


def test_jaccard_join_equals_brute_force(messy, messy_rows):
    found = jaccard_join.similar_documents(messy).collect()
    assert Counter((r["id"], r["class_id"], r["n_links"]) for r in found) == jaccard_classes(messy_rows)


def test_dense_group_larger_than_a_tile(spark):
    """Near copies of one text, a chain of drifting texts, and strangers: counted exactly although tiles are cut."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(180):
        text = list(base)
        for at in rng.integers(0, 80, i % 4):
            text[at] = f"x{i}"
        rows.append((i, " ".join(text)))
    drift = [f"d{i}" for i in range(120)]
    for i in range(40):
        drift[3 * i % 120] = f"y{i}"
        rows.append((1000 + i, " ".join(drift)))
    rows += [(2000 + i, " ".join(f"s{rng.integers(10**6)}" for _ in range(60))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard_join.similar_documents(docs).collect()
    assert Counter((r["id"], r["class_id"], r["n_links"]) for r in found) == jaccard_classes(rows)


def near_copies(n, length=150, seed=6):
    """One text with up to four words changed, many of them further from each other than similar ones may be."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = [f"b{k}" for k in range(length)]
        for at in rng.integers(0, length, i % 5):
            text[at] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("tile, tile_bytes", [(4096, 1 << 30), (20, 1 << 30), (4096, 20_000)])
def test_shells_decide_like_brute_force(spark, tile, tile_bytes):
    rows = near_copies(260) + [(1000 + i, t.replace("b7", "c7").replace("b1", "d1")) for i, t in near_copies(140, seed=9)]
    found = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tile=tile, tile_bytes=tile_bytes).collect()
    assert Counter((r["id"], r["class_id"], r["n_links"]) for r in found) == jaccard_classes(rows)


def test_shells_far_apart_in_length_are_linked_rightly():
    assert [jaccard_join._linked_shells(s) for s in range(4)] == [[0, 1, 2], [0, 1], [0], []]


def test_compared_rows_grow_with_the_group(spark, monkeypatch):
    """Rows sent to be compared: as many as members, whether a group has a thousand or four thousand."""
    sent = {}
    compare = jaccard_join.map_sorted_groups
    for n in (1000, 4000):
        counts = []

        def counted(df, key, ddl, work, counts=counts):
            counts.append(df.count())
            return compare(df, key, ddl, work)

        monkeypatch.setattr(jaccard_join, "map_sorted_groups", counted)
        docs = spark.createDataFrame(near_copies(n), "doc_id long, text string").dropDuplicates(["text"])
        sent[docs.count()] = (counts, jaccard_join.similar_documents(docs).count())[0]
    (few, first), (many, second) = sorted(sent.items())
    assert second[-1] <= 1.1 * first[-1] * many / few  # on whole sets
    # Candidates: at most one row for every path of the two levels at which a bucket of alike members ends, and few besides.
    paths = jaccard_join.runs_needed(0.8, 0.9999) * jaccard_join.BRANCH**2
    assert first[0] <= 1.25 * paths * few and second[0] <= 1.25 * paths * many


def test_one_of_each_class_stays(messy, messy_rows, nothing):
    kept = jaccard_join.one_of_each_class(messy)
    assert kept.columns == messy.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    # 6, 7, 8, 9 are copies and near copies; 10 and 11 near copies; of the repeated rows 14 one of each text stays.
    assert ids == Counter([1, 2, 3, 4, 5, 6, 10, 12, 13, 14, 14, 15, 16, None, None])
    assert jaccard_join.one_of_each_class(nothing).count() == 0


def test_recall_of_the_paths():
    assert abs(jaccard_join.survival(0.8) - 0.9375) < 1e-6
    assert (1 - 0.9375) ** jaccard_join.runs_needed(0.8, 0.9999) <= 1e-4


def test_open_buckets_keep_their_paths(spark):
    """Two versions of each of 300 templates: whole buckets are equal on every path, and each path counts."""
    rng = np.random.default_rng(11)
    rows = []
    for template in range(300):
        one = rng.integers(0, 2**32, 128, dtype=np.uint32)
        two = np.where(rng.permutation(128) < 102, one, ~one)
        rows += [(template * 100 + version * 50 + i, sig.tobytes()) for version, sig in enumerate((one, two)) for i in range(10)]
    sets = spark.createDataFrame(rows, "node long, sig binary")
    together = jaccard_join.chosen_path_buckets(sets, 0.8, 0.9999, leaf=12).groupBy("path", F.expr("node div 100").alias("template"))
    found = together.agg(F.countDistinct(F.expr("node div 50")).alias("versions")).where("versions = 2").select("template").distinct().count()
    assert found == 300


# --- substrings


def repeats(rows, length=35):
    texts = [VISIBLE.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = Counter()
    for row, w in zip(rows, texts):
        gone = {k for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for k in range(i, i + length)}
        out[(row[0], row[1], str(len(w)), str(len(gone)), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def test_repeats_equal_brute_force(messy, messy_rows):
    found = substring_dedup.find_repeats(messy)
    assert by_text(found, "n_words", "n_removed", "kept_text") == repeats(messy_rows)


def test_passages_cut_at_every_offset(spark):
    """Shared passages of 33 to 40 words between random ones, so factors begin and end inside blocks."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(200)]
    rows = []
    for i in range(60):
        a = int(rng.integers(0, 150))
        text = [f"u{rng.integers(10**9)}" for _ in range(rng.integers(0, 40))] + passage[a : a + 33 + i % 8]
        rows.append((i, " ".join(text + [f"v{rng.integers(10**9)}" for _ in range(rng.integers(0, 40))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_text(substring_dedup.find_repeats(docs), "n_words", "n_removed", "kept_text") == repeats(rows)


def test_repeats_of_nothing(nothing):
    assert substring_dedup.find_repeats(nothing).count() == 0


# --- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_vectors_equal_the_table():
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(1500):
        a = rng.integers(1, 4, rng.integers(0, 25)).tolist()
        b = list(a)
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = [int(rng.integers(1, 4))] * int(rng.integers(0, 2))
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32), int(rng.integers(0, 4))))
    got = line_dedup.within_edits([p[0] for p in pairs], [p[1] for p in pairs], np.array([p[2] for p in pairs]))
    assert got.tolist() == [distance(a.tolist(), b.tolist()) <= k for a, b, k in pairs]


def removed_lines(rows):
    places = {}
    for i, row in enumerate(rows):
        for n, line in enumerate((row[1] or "").split("\n")):
            if line.strip(" \t\n\r\x0b\x0c"):
                places.setdefault(line, []).append((row[0] is None, row[0] or 0, n, i))
    lines = list(places)
    group = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            b = lines[j]
            most = min(2, min(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = {i: [] for i in range(len(rows))}
    for g in set(group):
        every = sorted(p for line, own in zip(lines, group) if own == g for p in places[line])
        for p in every[1:]:
            out[p[3]].append(p[2])
    return Counter((rows[i][0], str(sorted(v))) for i, v in out.items())


def test_lines_equal_brute_force(spark):
    line = "the quick brown fox jumps over the lazy dog again"
    rows = [
        (1, None), (2, ""), (3, "\n \n\t"), (4, line), (5, f"first\n{line}"), (6, f"{line}\n\n{line[1:]}x"), (7, line[:20] + "é" + line[21:]),
        (8, line.replace("o", "0")), (9, "short\nshort\nshore\r"), (10, f"{line[2:]}\ntail"), (11, "page 1 of 20\npage 2 of 20\npage 12 of 20"),
        (None, f"{line}\nonly here, in a row without an id"), (12, "中文字符的一行文字在这里写\n中文字符的一行文字在那里写"), (13, "a" * 5000 + "b"), (14, "a" * 5000 + "c"),
    ]
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdef "))
    for i in range(60):
        a = rng.choice(letters, rng.integers(8, 40)).tolist()
        b = list(a)
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(b)))
            b[at : at + int(rng.integers(0, 2))] = [str(rng.choice(letters))] * int(rng.integers(0, 2))
        rows.append((100 + i, "".join(a) + "\n" + "".join(b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = line_dedup.deduplicate_lines(docs).collect()
    assert Counter((r["doc_id"], str(r["removed"])) for r in found) == removed_lines(rows)
    for r in found:
        lines = (r["text"] or "").split("\n")
        assert r["kept_text"] == "\n".join(x for i, x in enumerate(lines) if i not in r["removed"])
    slim = line_dedup.deduplicate_lines(docs, with_text=False)
    assert Counter((r["doc_id"], str(r["removed"]), r["n_lines"]) for r in slim.collect()) == Counter((r["doc_id"], str(r["removed"]), r["n_lines"]) for r in found)


def test_lines_of_messy_rows(messy, nothing):
    found = line_dedup.deduplicate_lines(messy)
    assert found.count() == messy.count()
    assert set(messy.columns) <= set(found.columns)
    assert line_dedup.deduplicate_lines(nothing).count() == 0


def test_lines_of_repeated_rows(spark, messy, messy_rows):
    """Of equal rows the lines of one stay, whatever else has the lines."""
    line = "the quick brown fox jumps over the lazy dog again"
    rows = [
        *[(1, f"{line}\n\nonly here\nonly here")] * 50, (2, line[1:]), *[(3, "alone in its row")] * 2, *[(None, f"no id\n{line}x")] * 3,
        *[(4, None)] * 2, *[(5, " \n")] * 2, (6, "no id"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for given, own in ((docs, rows), (messy, messy_rows)):
        found = line_dedup.deduplicate_lines(given).collect()
        assert Counter((r["doc_id"], str(r["removed"])) for r in found) == removed_lines(own)
        for r in found:
            assert r["kept_text"] == "\n".join(x for i, x in enumerate((r["text"] or "").split("\n")) if i not in r["removed"])
        slim = line_dedup.deduplicate_lines(given, with_text=False)
        assert Counter((r["doc_id"], str(r["removed"])) for r in slim.collect()) == removed_lines(own)


def test_shared_segments_across_batches(spark, tmp_path):
    """Runs of a segment that go on in further batches; a line that occurs often shares nothing with itself."""
    rows = [(1, 7, 1)] * 30 + [(2, 8, 1)] * 20 + [(2, 9, 1)] * 3 + [(2, 9, 0)] + [(3, i % 11, i % 2) for i in range(44)] + [(4, 1, 0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = spark.createDataFrame(rows, "segment long, line long, probe byte").repartition(3)
    try:
        for size in (1, 3, 16, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            got = [tuple(r) for r in line_dedup.shared_segments(index).collect()]
            assert sorted(got) == [(2, 8, 1), (2, 9, 0), *((3, i, 0) for i in range(11))]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_text_is_read_three_times_for_lines(spark, monkeypatch):
    """One pass parses lines, their places and their number; two more make the index and the contents."""
    made = []
    map_in_arrow = type(spark.range(1)).mapInArrow

    def noted(self, func, *args, **kwargs):
        made.extend(["text"] * ("text" in self.columns))
        return map_in_arrow(self, func, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", noted)
    docs = spark.createDataFrame([(1, "one line here\nand one more"), (2, "one line here")], "doc_id long, text string")
    found = line_dedup.deduplicate_lines(docs, with_text=False).collect()
    assert sorted((r["doc_id"], r["n_lines"], str(r["removed"])) for r in found) == [(1, 2, "[]"), (2, 1, "[0]")]
    assert made == ["text"] * 3


# --- personal data


def reference_spans(text):
    out = []
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for k, p in enumerate((personal_data.EMAIL, plain, personal_data.CARD, personal_data.PHONE)):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2 and not (14 <= len(d) <= 19 and personal_data.luhn(d)):
                continue
            if k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


PII = [
    "mail a.b+c@x-y.example.com, a@b.c@d.e or @nobody.org", "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5 and 001.02.3.255", "4111 1111 1111 1111 ok",
    "4111111111111112 bad", "call +1 (375) 555-4393 now", "+12 34", "é +49.30.1234567 中 a@b.de", "", None, "no digits here", "12@3.4 5@6.7.8.9",
    "0 4111-1111-1111-1111", "x" * 300 + " u@v.w " + "y" * 300,
]


def test_base_spans_equal_the_patterns(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(PII)], "doc_id long, text string, spans string")
    for r in personal_data.find_personal_data(docs).collect():
        want = [(personal_data.KINDS[k], s, e) for s, k, e in reference_spans(r["text"])]
        assert [tuple(s) for s in r["base_spans"]] == want
        assert set(want) <= {tuple(s) for s in r["spans"]}


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(12)
    signs = np.array(list("aB1290..@@+-_ ()%\né"))
    for _ in range(20000):
        text = "".join(rng.choice(signs, rng.integers(0, 40)))
        assert personal_data.base_spans(text) == reference_spans(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "a@" * 150_000, "0" * 10_000 + ".1.2.3"):
        personal_data.base_spans(text)


def test_base_spans_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = personal_data.find_personal_data(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert [(s["start"], personal_data.KINDS.index(s["kind"]), s["end"]) for s in r["base_spans"]] == reference_spans(r["text"])


def test_personal_data_query(spark):
    from cohortline.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = queries.QUERIES["op5_personal_data"](spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        own = reference_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[1] == i for s in own) for i in range(4)]
        listed = [f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in own]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) | {""}
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in found) > 0


def test_tagger_learns_held_out_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    windows = personal_data.training_windows(docs.select("text"))
    held = windows[::5]
    model = personal_data.train([w for i, w in enumerate(windows) if i % 5])
    found = personal_data.proposals(model, [t for t, _ in held])
    gold = sum(len(s) for _, s in held)
    right = sum(len(set(p) & set(s)) for p, (_, s) in zip(found, held))
    assert gold > 20
    assert right >= 0.6 * gold
    assert right >= 0.8 * sum(map(len, found))


def test_gradients_of_the_tagger():
    from cohortline.llm.char_tagger import Tagger

    rng = np.random.default_rng(0)
    model = Tagger.fresh(5, 1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    codes, tags = rng.integers(0, 100, (6, 3)), rng.integers(0, 5, (6, 3))
    _, grads = model._step(codes, tags)
    for name in ("hf", "xb", "out", "move", "cb"):
        at = tuple(int(rng.integers(0, s)) for s in model.weights[name].shape)
        losses = []
        for step in (1e-3, -1e-3):
            model.weights[name][at] += step
            losses.append(model._step(codes, tags)[0])
            model.weights[name][at] -= step
        assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][at]) < 2e-3, name


def test_reconciling_windows():
    assert personal_data.reconcile([(5.0, 0, 0, 10), (1.0, 8, 1, 12), (5.0, 0, 0, 10), (3.0, 20, 3, 30)]) == [(0, 0, 10), (20, 3, 30)]
    assert personal_data._window_starts("a" * 1000) == []
    text = "a" * 500 + "7" + "a" * 500
    assert all(b <= 500 < b + personal_data.SIZE for b in personal_data._window_starts(text))
    assert personal_data._window_starts("short 1") == [0]


# --- toxicity


def test_chain_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    chain = toxicity.train(docs, labels.where(~held), toxicity.categories())
    assert [c.name for c in chain] == ["low_quality", "toxic"]
    assert len(chain[1].dense) == len(chain[0].dense) + 1
    scored = toxicity.score(docs, chain).join(labels.where(held).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    counts = {(r["label"], r["toxic"]): r["count"] for r in scored.groupBy("label", "toxic").count().collect()}
    assert counts.get((1, True), 0) >= 0.85 * (counts.get((1, True), 0) + counts.get((1, False), 0))
    assert counts.get((0, True), 0) <= 0.01 * (counts[(0, False)] + counts.get((0, True), 0))


def test_chain_on_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(6, 1, 0), (8, None, 1), (10, 0, 0), (12, 1, None), (12, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.classified(messy, labels)
    assert found.count() == messy.count()
    assert found.where("text IS NULL OR trim(text) IN ('', '!!! ??? ...')").where("toxic").count() == 0
    assert toxicity.classified(nothing, labels).count() == 0
    none = toxicity.classified(messy, labels.limit(0))
    assert none.where("toxic OR p_toxic > 1e-9").count() == 0


def test_hash_mixing_is_a_bijection_on_a_sample():
    x = np.arange(100000, dtype=np.uint64)
    assert len(np.unique(mix(x))) == len(x)
    assert hashlib.sha256(mix(x).tobytes()).hexdigest() == hashlib.sha256(mix(x.copy()).tobytes()).hexdigest()


def test_one_id_does_not_fill_the_fit(spark):
    """A labelled id that is repeated thousands of times is one row of the fit, whatever it adds elsewhere."""
    rows = [(1, f"good words number {i % 7}") for i in range(3000)] + [(i, f"{'bad' if i % 2 else 'good'} words {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, i % 2 if i > 1 else 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    seen = []
    plain, toxicity.fit_chain = toxicity.fit_chain, lambda names, known, *rest: seen.append(len(known)) or plain(names, known, *rest)
    try:
        toxicity.train(docs, labels, toxicity.categories(), per_class=50)
        toxicity.train(docs, labels, toxicity.categories(), per_class=5)
    finally:
        toxicity.fit_chain = plain
    assert seen == [7 + 58, 10]


def test_chain_equals_a_plain_computation(spark):
    """Probabilities by hand: presence of words and word beginnings, the four shares, and the log-odds of the category before."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), toxicity.categories())
    found = toxicity.score(docs, chain).select("text", "p_low_quality", "p_toxic", "toxic").collect()
    import pyarrow as pa

    for r in found[:40]:
        words = normal(r["text"])
        own = pa.array([r["text"]], pa.string())
        (chunk, _, hashes, dense), *_ = toxicity._features(own)
        seen = {int(h) for h in hashes}
        z = None
        for link, p in zip(chain, (r["p_low_quality"], r["p_toxic"])):
            z = link.intercept + float(dense[0] @ link.dense) + sum(w for h, w in zip(link.hashes.tolist(), link.weights.tolist()) if h in seen)
            assert abs(1 / (1 + np.exp(-z)) - p) < 1e-9
            dense = np.hstack([dense, np.clip([[z]], -10, 10) / 5])
        assert chunk.counts[0] == len(words) and r["toxic"] == (p >= 0.5 and bool(words))


def test_spans_longer_than_the_overlap_are_joined():
    pieces = [(5.0, 10, 0, 96, False, True), (4.0, 48, 0, 130, True, False), (6.0, 140, 1, 150, False, False), (6.0, 180, 2, 192, False, True), (6.0, 192, 2, 196, True, False)]
    assert personal_data.stitched(pieces) == [(6.0, 140, 1, 150), (4.0, 10, 0, 130)]
    tags = np.array([2, 2, 0, 1, 2])
    assert [s[1:] for s in personal_data._spans_of(tags, np.ones(5), 100, 5, True, True)] == [(100, 0, 102, True, False), (103, 0, 105, False, True)]


def test_personal_data_of_messy_rows(spark, messy, messy_rows, nothing):
    extra = [(20, "call +49 30 1234567 or x@y.de", "en", "a", 1, 1, 1, 1, "own", 1)] * 3
    docs = messy.unionByName(spark.createDataFrame(extra, messy.schema))
    rows = personal_data.find_personal_data(docs).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in [*messy_rows, *extra])
    for r in rows:
        want = [(personal_data.KINDS[k], s, e) for s, k, e in reference_spans(r["text"] or "")]
        assert [(s["kind"], s["start"], s["end"]) for s in r["base_spans"]] == want and set(map(tuple, r["base_spans"])) <= set(map(tuple, r["spans"]))
    assert personal_data.find_personal_data(nothing).count() == 0


def test_batches_are_read_in_slices(spark):
    """However many texts a batch has, few bytes of them are Python strings at once; nothing is lost, texts may stay behind."""
    texts = [None, "a" * 30, "", "ö" * 10, "b" * 500, None, "c" * 40, "d" * 41]
    parts = personal_data.sliced(pa.array(texts), 60)
    assert [t for p in parts for t in p.to_pylist()] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 60 for p in parts) and len(parts) == 4
    assert personal_data.sliced(pa.array([], pa.string())) == []
    docs = spark.createDataFrame([(i, "write to a@b.example or +49 30 1234567" if i % 3 else None) for i in range(20)], "doc_id long, text string")
    found = personal_data.find_personal_data(docs, keep_text=False)
    assert found.columns == ["doc_id", "base_spans", "spans"]
    assert {r["doc_id"]: len(r["base_spans"]) for r in found.collect()} == {i: 2 if i % 3 else 0 for i in range(20)}


def test_plain_numbers_do_not_crowd_out_the_spans(spark):
    rows = [(f"line {i} " + "z" * 60,) for i in range(3000)] + [(f"write to user{i}@mail.example now",) for i in range(30)]
    windows = personal_data.training_windows(spark.createDataFrame(rows, "text string"), 200)
    assert sum(bool(s) for _, s in windows) == 30 and sum(not s for _, s in windows) == 40


def test_patterns_are_sequences_of_words():
    """Three nodes a word, however long it is, and no more words than three digits can number."""
    windows = [(" ".join(f"{'long' * 20}{i}x{j}" for j in range(13)).encode(), ["1"]) for i in range(50)]

    class Handle:
        value = windows

    automaton, codes = decontamination._automaton.__wrapped__(Handle)
    assert automaton.get_stats()["nodes_count"] <= 39 * 50 + 1 and len(set(codes.values())) == len(codes) == 650
    assert decontamination.BLOCK_BYTES // decontamination.WORD_BYTES <= decontamination.BASE**3
    assert decontamination._matches((automaton, codes), b"x " + windows[3][0] + b" y") == ([(1, 14)], {"1"})
