"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import bpe, exact_dedup, huffman, langid, media, mixing, quality, simhash, url_filter, warc
from knotwork.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_query(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents")).drop("content_hash")


def op4_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprints(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.save(spark, langid.train(docs))
    return langid.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark)).drop("url")


def op10_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.archive_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_warc_bundles, op3_exact_dedup, op4_media_fingerprints, op5_byte_bpe, op6_simhash, op7_language_mixture, op8_source_mixing, op9_url_filter, op10_token_archive)}
ORACLES = {"op2_warc_bundles": warc.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op8_source_mixing": mixing.ORACLE, "op9_url_filter": url_filter.ORACLE}
