"""One query per corpus operator on the given tables, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import materialise, new_folder
from . import (
    bpe, chunks, decontaminate, filter_audit, fingerprint, importance, language, mixing, ngram_join, quality, sharding,
    url_filter, warc,
)
from .registry import QUERIES, SQL, held_out, table

SHARDS = 8
GOOD = 0.3
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
TOKENIZER = "word_bpe_49k.json"
MIX = {"exponent": 0.5, "epochs": 1.0}


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages"), "page_id", "url", "html"), folder)
    return warc.read_records(index, folder).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


DECONTAMINATION_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS n, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents)
  UNION ALL SELECT 'i', item_id, 0, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
lengths AS (SELECT DISTINCT least(len(w), 5) AS l FROM words WHERE side = 'i' AND len(w) > 0),
shingles AS (
  SELECT DISTINCT side, id, n, unnest(CASE WHEN len(w) >= l
    THEN list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' ')) ELSE [] END) AS s
  FROM words JOIN lengths ON side = 'd' OR l = least(len(w), 5)),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM shingles d JOIN shingles i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' JOIN sizes ON sizes.id = i.id
GROUP BY d.id, d.n, i.id HAVING 5 * count(*) >= 4 * any_value(n_item)
"""


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(quality.labelled_sample(docs, labels, ~held_out(F.col("doc_id"))))
    return quality.score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"))


def rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [(s, 1.0) for s in range(SHARDS)]
    placed = sharding.shard_records(table(spark, sf_dir, "documents"), shards, grown=[*shards, (SHARDS, 1.0)])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES)).select(
        "page_id", "host", "path", "rule", "verdict")


URL_SQL = f"""
WITH rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages)
SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path,
  arg_max(h || p, length(h || p)) FILTER (h IS NOT NULL) AS rule,
  coalesce(arg_max(verdict, length(h || p)) FILTER (h IS NOT NULL), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
"""


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = mixing.source_rates(docs, MIX["exponent"], MIX["epochs"])
    return mixing.mix_sources(docs, rates).select("doc_id", "source", "copy", "order_key", "text")


MIX_SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0) + 1) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size ** {MIX["exponent"]}) AS powers, sum(size) AS total FROM sizes),
rates AS (SELECT source, size ** {MIX["exponent"]} / powers * total * {MIX["epochs"]} / size AS rate FROM sizes, totals),
parts AS (
  SELECT d.*, ceil(rate / {mixing.PART_MEAN})::INT AS parts, rate / greatest(ceil(rate / {mixing.PART_MEAN}), 1) AS mean
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
cdf AS (
  SELECT mean, k, sum(exp(-mean) * mean ** k / factorial(k::INT)) OVER (PARTITION BY mean ORDER BY k) AS p
  FROM (SELECT DISTINCT mean FROM parts), range(0, 30) t(k)),
draws AS (
  SELECT doc_id, mean, n, (('0x' || substr(md5('mix:' || i || ':' || doc_id), 1, 13))::BIGINT + 0.5) / 2.0 ** 52 AS u
  FROM (SELECT *, row_number() OVER () AS n FROM parts), range(1, 200) s(i) WHERE i <= parts),
counts AS (
  SELECT n, sum(least_k) AS copies FROM (
    SELECT n, u, draws.mean, min(k) AS least_k FROM draws JOIN cdf ON cdf.mean = draws.mean AND cdf.p >= u GROUP BY ALL)
  GROUP BY n)
SELECT doc_id, source, copy::INT AS copy, ('0x' || substr(md5('mix:order:' || copy || ':' || doc_id), 1, 15))::BIGINT AS order_key,
  text
FROM (SELECT *, row_number() OVER () AS n FROM parts) JOIN counts USING (n), range(0, 400) c(copy) WHERE copy < copies
"""

def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language.learn_languages(docs, ~held_out(F.col("doc_id")))
    return language.predict_language(docs.select("doc_id", "text"), prototypes).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = importance.importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


FILTERS = [
    ("A", "n_words < 200"), ("B", "100 * n_distinct < 50 * n_words"), ("C", "100 * n_upper > 2 * n_chars"),
    ("D", "n_symbols > 0"), ("E", None),
]


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), FILTERS)
    return filter_audit.audit_orders(materialise(counts, "masks"), "".join(letter for letter, _ in FILTERS))


# Every order is walked through, document group by document group.
AUDIT_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM words GROUP BY text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > least, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words JOIN least USING (text) LEFT JOIN marks USING (doc_id)),
masks AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
    CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
walk AS (
  SELECT part, o, step, substr(o, step, 1) AS x, failed, n, good, toxic, contains(failed, substr(o, step, 1)) AS fail,
    len(list_filter(range(1, step), lambda k: contains(failed, substr(o, k, 1)))) > 0 AS gone
  FROM masks, orders, range(1, 6) t(step)),
rows AS (
  SELECT part, o AS filter_order, step::INT AS step, x,
    sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fail AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fail AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM walk GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM rows
"""


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    config = bpe.tokenizer_config(path(TOKENIZER))
    decoded = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents"), config), config)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES |= {
    "op1_warc": warc_round_trip,
    "op2_benchmark_decontamination": benchmark_decontamination,
    "op3_quality": quality_scores,
    "op4_sharding": rendezvous_sharding,
    "op5_ngram_join": ngram_components,
    "op6_url_filters": url_filters,
    "op7_fingerprints": document_fingerprints,
    "op8_mixing": source_mixing,
    "op9_language": language_id,
    "op10_substring_dedup": substring_dedup,
    "op11_importance_resampling": importance_resampling,
    "op12_filter_audit": filter_interactions,
    "op13_bpe": bpe_round_trip,
}
SQL |= {
    "op2_benchmark_decontamination": DECONTAMINATION_SQL,
    "op6_url_filters": URL_SQL,
    "op8_mixing": MIX_SQL,
    "op12_filter_audit": AUDIT_SQL,
}
