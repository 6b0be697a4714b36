"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import language_id, mixing, neighbours, order_minhash, packing, quality_rules, token_counts, toxicity, url_filter, warc
from veilscan.llm.common import crc_bucket, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_bucket("doc_id", 4) != 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = order_minhash.near_classes(table(spark, sf_dir, "documents"))
    return classes


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_id.train(docs.where(crc_bucket("doc_id", 3) != 1))
    return language_id.identify(docs, dictionaries).select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_url_filter, op3_warc, op4_mixing, op5_quality_rules, op6_token_counts, op7_packing, op8_order_minhash, op9_language_id, op10_neighbours)
    return {f.__name__: f for f in own} | {"pipeline": _pipeline}


_URL_SQL = """
WITH split AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
fits AS (
  SELECT s.page_id, max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := verdict)) AS best
  FROM split s JOIN rules r ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
  GROUP BY s.page_id)
SELECT s.page_id, s.host, s.path, f.best.rule AS rule,
       CASE WHEN f.best IS NOT NULL THEN f.best.verdict
            WHEN EXISTS (SELECT 1 FROM (VALUES {blocked}) AS b(bhost) WHERE s.host = bhost OR ends_with(s.host, '.' || bhost)) THEN 'block'
            ELSE 'allow' END AS verdict
FROM split s LEFT JOIN fits f USING (page_id)
"""
_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT body, max(page_id) AS origin FROM p WHERE n >= 1000 GROUP BY body)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN g.origin IS NULL OR g.origin = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.origin <> p.page_id THEN g.origin END AS refers_to,
       CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN g ON p.body = g.body AND p.n >= 1000
"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in url_filter.RULES)
    blocked = ", ".join(f"('{h}')" for h in url_filter.BLOCKED_HOSTS)
    return {"op2_url_filter": _URL_SQL.format(rules=rules, blocked=blocked), "op3_warc": _WARC_SQL}
