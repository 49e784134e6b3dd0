"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import audit, fingerprint, forest, langid, mixing, pieces, quality, simhash, substring, tokencount, tokenfile, urlfilter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_hash(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_crc32", "round_trip")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenfile.new_folder(spark)
    tokenfile.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return tokenfile.digest_token_files(spark, path)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicate_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").filter(_id_hash(5) != 0)
    scored = quality.classify_quality(docs, labels, threshold=0.3)
    return scored.select(
        "doc_id", (_id_hash(5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify_languages(docs.select("doc_id", "text"), docs.filter(_id_hash(3) != 1))
    return found.select("doc_id", (_id_hash(3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, radius=3, shingle=3, seed=42)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.filter_audit(audit.failure_cells(docs, _table(spark, sf_dir, "labels")))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, window=50).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.component_rows(whitening.whiten(vectors, components=8))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_url_filter": op2_url_filter,
    "op3_fingerprints": op3_fingerprints,
    "op4_token_files": op4_token_files,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_source_mix": op8_source_mix,
    "op9_language_id": op9_language_id,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_whitening": op13_whitening,
}

OP5_SQL = """
WITH RECURSIVE sound AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u),
component AS (SELECT u, min(w) AS c FROM reach GROUP BY u)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM embeddings v JOIN component c ON v.vec_id = c.u LEFT JOIN degree d ON v.vec_id = d.u
"""

#: Seats are dealt one by one here, in the order of their quotients.
OP8_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
known AS (SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM known),
weighed AS (SELECT *, [3.0, 1.0, 2.0][k % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
settled AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS common FROM levels),
targets AS (SELECT *, least(cap, coalesce(common * weight, cap)) AS target, ceil(docs / 2000.0)::INT AS shards FROM settled),
seats AS (SELECT *, round(sum(target) OVER () / 32)::BIGINT AS seats FROM targets),
bids AS (SELECT k, seats, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, k, i) AS place
  FROM (SELECT k, seats, target, unnest(range(ceil(source_size * 2 / 32.0)::BIGINT)) AS i FROM seats WHERE target > 0)),
won AS (SELECT k, count(*) AS quota FROM bids WHERE place <= seats GROUP BY k),
sources AS (SELECT s.*, coalesce(w.quota, 0) AS source_quota FROM seats s LEFT JOIN won w USING (k)),
dealt AS (SELECT d.doc_id, d.size, s.k, s.source_size, s.target, s.source_quota, substr(md5('42' || coalesce(':' || d.doc_id, '')), 1, 16) AS draw, s.shards
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
placed AS (SELECT *, (('0x' || substr(draw, 1, 8))::BIGINT % shards)::INT AS shard FROM dealt),
words AS (SELECT k, shard, source_quota, sum(size)::BIGINT AS words, greatest(1, round(sum(size) / 32.0))::BIGINT AS blocks FROM placed GROUP BY k, shard, source_quota),
shard_bids AS (SELECT k, shard, source_quota, row_number() OVER (PARTITION BY k ORDER BY words::DOUBLE / (2 * i + 1) DESC, shard, i) AS place
  FROM (SELECT *, unnest(range(blocks * 2)) AS i FROM words WHERE words > 0)),
shard_won AS (SELECT k, shard, count(*) AS quota FROM shard_bids WHERE place <= source_quota GROUP BY k, shard),
line AS (SELECT p.*, w.words, w.blocks, coalesce(q.quota, 0) AS quota,
    (sum(size) OVER (PARTITION BY p.k, p.shard ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
  FROM placed p JOIN words w ON p.k = w.k AND p.shard = w.shard LEFT JOIN shard_won q ON p.k = q.k AND p.shard = q.shard),
ready AS (SELECT *, stop - size AS start, quota % blocks AS rest, quota // blocks AS passes,
    ('0x' || substr(md5('42:phase:' || k || ':' || shard), 1, 8))::BIGINT % blocks AS phase FROM line),
ends AS (SELECT *, least(stop * blocks // greatest(words, 1), blocks - 1) AS b1, least(start * blocks // greatest(words, 1), blocks - 1) AS b0 FROM ready),
sums AS (SELECT *,
    ((b1 * rest + phase) // blocks) * words + (((b1 + 1) * rest + phase) // blocks - (b1 * rest + phase) // blocks) * (stop * blocks - b1 * words) AS g1,
    ((b0 * rest + phase) // blocks) * words + (((b0 + 1) * rest + phase) // blocks - (b0 * rest + phase) // blocks) * (start * blocks - b0 * words) AS g0 FROM ends)
SELECT doc_id, size, source_size, target, (passes * size + (2 * g1 + blocks) // (2 * blocks) - (2 * g0 + blocks) // (2 * blocks))::BIGINT AS taken FROM sums
"""

#: Every order is evaluated step by step over the masks, without stored subsets.
OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts),
failed AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic FROM worded w),
cells AS (SELECT part, mask, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT o, n::INT AS step, l.bit, coalesce((SELECT sum(p.bit) FROM letters p WHERE strpos(left(o, n - 1), p.f) > 0), 0)::INT AS before
  FROM orders, range(1, 6) r(n), letters l WHERE l.f = substr(o, n, 1)),
counted AS (SELECT part, o, step, bit, sum(docs) FILTER (mask & (before | bit) = 0) AS kept, sum(docs) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
    sum(docs) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(docs) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM cells, steps GROUP BY part, o, step, bit)
SELECT part, o AS filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""

#: Windows are compared as texts; words never hold a space.
OP12_SQL = r"""
WITH worded AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, doc_id, s, array_to_string(ws[s:s + 49], ' ') AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM worded)),
repeated AS (SELECT r, s FROM (SELECT r, s, doc_id, min(doc_id) OVER (PARTITION BY k) AS earliest FROM windows) WHERE doc_id > earliest),
covered AS (SELECT DISTINCT r, unnest(range(s, s + 50)) AS p FROM repeated),
words AS (SELECT r, ws[p] AS word, p FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM worded)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words w WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.r = w.r AND c.p = w.p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM worded LEFT JOIN kept USING (r)
"""

ORACLES: dict[str, str] = {"op5_embedding_dedup": OP5_SQL, "op8_source_mix": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_substring_dedup": OP12_SQL}
