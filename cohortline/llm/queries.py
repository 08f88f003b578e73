"""The operators applied to the given tables, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import (
    decontamination,
    embedding_forest,
    jaccard_join,
    lexical_search,
    line_dedup,
    mixing,
    personal_data,
    secret_scan,
    sharding,
    substring_dedup,
    token_alignment,
    toxicity,
    warc_store,
)
from cohortline.llm.frames import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def _span_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL} AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0) s, unnest(range(1, len(w) - n + 2)) AS u(i)
),
lengths AS (SELECT DISTINCT n FROM pattern),
hit AS (
  SELECT doc_id, i, pattern.n, item
  FROM (SELECT doc_id, lengths.n, i, array_to_string(w[i:i + lengths.n - 1], ' ') AS p
        FROM d, lengths, unnest(range(1, len(w) - lengths.n + 2)) AS u(i)) x
  JOIN pattern ON x.p = pattern.p AND x.n = pattern.n
),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.find_contamination(docs.select("doc_id", "text"), items)
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query()
def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_low_quality", "p_toxic", "toxic")


@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT * FROM d WHERE len(w) > 0) x, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)
),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT doc_id, (SELECT min(y) FROM reach WHERE reach.x = doc_id) AS class_id, (SELECT count(*) FROM link WHERE link.x = doc_id) AS n_links,
  (SELECT min(y) FROM reach WHERE reach.x = doc_id) = doc_id AS kept
FROM d
"""
)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", (F.col("id") == F.col("class_id")).alias("kept"))


_BASE32_SQL = "concat(" + ", ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v // {}) % 32 AS INTEGER), 1)".format(32**k).replace("v ", f"CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) ")
    for i in range(8) for k in (3, 2, 1, 0)
) + ")"


@query(
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
x AS (SELECT page_id, first_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p JOIN f USING (html))
SELECT page_id, payload_bytes, {_BASE32_SQL} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM x
"""
)
def op4_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc_store.write_archive(pages, path, revisit_from=0)
    read = warc_store.read_records(spark, path, pages.schema["page_id"].dataType.simpleString())
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return _span_columns(found, personal_data.KINDS)


@query(
    """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.x = vec_id) AS n_links, (SELECT min(y) FROM reach WHERE reach.x = vec_id) AS component_id,
  (SELECT min(y) FROM reach WHERE reach.x = vec_id) = vec_id AS kept
FROM embeddings
"""
)
def op6_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op7_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.mix_units(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return units.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.deduplicate_lines(docs, with_text=False)
    return found.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))


@query()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.with_positions(sharding.shard_records(docs, shards=16).drop("text"), order=["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


@query(
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w FROM d WHERE len(w) >= 35) s, unnest(range(1, len(w) - 33)) AS u(i)
),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, k FROM windows SEMI JOIN again USING (h), unnest(range(i, i + 35)) AS u(k)),
words AS (SELECT doc_id, k, w[k] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(k)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _span_columns(found, secret_scan.KINDS)


TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {TERMS_SQL} AS w FROM documents),
held AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM held),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark)),
counted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM held) SEMI JOIN wanted USING (term) GROUP BY r, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus
),
gain AS (
  SELECT r, doc_id, term, weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS g
  FROM counted JOIN weight USING (term) JOIN held USING (r), corpus
),
scored AS (SELECT item_id, r, doc_id, CAST(sum(g) AS BIGINT) AS score FROM wanted JOIN gain USING (term) GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scored WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 10
"""
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
