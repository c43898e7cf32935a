"""The corpus pipeline: each stage takes whole documents that its predecessor kept.

STAGES are applied in order; between two stages the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import bpe, exact_dedup, mixing, quality, simhash
from knotwork.llm.common import materialize, table
from knotwork.sources.graph import remove, rounds


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule ensemble, fitted to the labels of these documents, does not reject.

    Null texts are judged as empty ones and rows that repeat alike; of repeated ids one is learned from. Without labels, or
    with labels of one kind, all documents have one score and all or none stay. An empty table stays empty.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the document with the largest id.

    Null counts as the empty text; a null id loses to any other; of rows that repeat one stays. An empty table stays empty.
    """
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 of their five-word shingles the document with the smallest id.

    Null, empty and blank texts are one group; null ids lose to any other; ties are decided by the text's digest, and of rows
    that repeat one stays. Texts without a near copy stay whatever ids they share. An empty table stays empty.
    """
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most three times.

    Documents without words are taken in whole epochs only; a null source is a source; null ids draw one key, and of rows
    equal in id, source and size as many are taken as fit. An empty table stays empty.
    """
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix the number of its token ids and digests of them and of the bytes decoded from them.

    Null and empty texts have no ids; rows and ids that repeat each give a row. An empty table gives none.
    """
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: Fitting, shingle similarity and byte-pair merges are not SQL: the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table; what a stage has read and written on the way is deleted when its result is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with rounds() as keep:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep)
        if before is not None:
            remove(spark, before)
        (before,) = keep
    return STAGES[-1][1](spark, docs, sf_dir)
