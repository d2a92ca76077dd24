"""The queries opN_<name> of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, media, packing, secrets, sharding, simhash, suffix_dedup, toxicity, warc
from .common import fresh_path, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in two lots, each is compacted, and the newest version is read back."""
    store = sharding.ShardStore(spark, fresh_path(spark, "shards"))
    docs = table(spark, sf_dir, "documents")
    late = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(8)) == 7
    for part in (~late, late):
        store.append(docs.filter(part))
        store.compact()
        store.vacuum(keep=1)
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"), "lang", "source", "n_chars")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), path_col="source")
    return found.withColumn("secret", F.sha2("secret", 256))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", toxicity.held_out())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_warc": op2_warc,
    "op3_sharding": op3_sharding,
    "op4_media": op4_media,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}

ORACLE: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        q AS (SELECT page_id, d, n, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS f FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f <> page_id THEN f END AS refers_to
        FROM q""",
    "op3_sharding": """
        SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
               md5(coalesce(text, '')) AS text_md5, lang, source, n_chars
        FROM documents""",
}
