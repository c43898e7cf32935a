"""Exact dedup with DataFrame functions only: 128-bit hashes first, bytes for those that meet, then one row stays.

1. One scan makes a narrow table (id, 128-bit hash, SHA-256), written to the shared folder.
2. It is counted per hash; the count is pre-aggregated in each map task, so a group that holds a third of all rows
   reaches its reducer as one row per task.
3. Only texts whose hash occurs more than once are read again and grouped by (hash, bytes), again pre-aggregated: a
   map task sends each distinct text once. Hashes under which two different byte strings meet (collisions) are resolved
   by the bytes; without any, the hash alone decides.
Texts of single documents are never shuffled while the hashes that repeat fit BROADCAST_HASHES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import fold_ascii, materialize, without
from knotwork.sources.graph import rounds

#: The hashes that repeat are sent to all executors up to this many (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_HASHES = 250_000


def md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", content_hash=md5_128, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, content_hash.

    Texts are equal when they are identical after lower-casing A-Z. Null counts as the empty text, so null and empty
    texts form one group. Of a group the row with the largest id stays (keep="max") or the smallest (keep="min"); a null
    id loses to any other. Where rows repeat the id that stays, exactly one of them is kept. Other columns of docs are
    not read and may have any names; an empty table gives an empty result.
    """
    best = F.max if keep == "max" else F.min
    norm = fold_ascii(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    keyed = rows.select("id", content_hash(F.col("norm")).alias("h"), "norm")
    ids = materialize(keyed.select("id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "hashes")
    groups = ids.groupBy("h").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"))
    groups = materialize(groups, "groups")
    repeated = groups.filter("n > 1").select("h")
    found = repeated.count()
    if found:
        repeated = F.broadcast(repeated) if found <= broadcast_hashes else repeated
        variants = keyed.join(repeated, "h", "left_semi").groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"))
        several = variants.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows")).filter("k > 1").select("h")
        several = materialize(several, "collisions")
        if not several.isEmpty():
            clean = ids.join(several, "h", "left_anti").join(groups, "h")
            apart = keyed.join(several, "h", "left_semi").withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
            apart = apart.join(variants.join(several, "h", "left_semi"), ["h", "norm"]).select("h", "id", "sha", "n", "keep_id")
            return _decide(clean.unionByName(apart), id_col)
    return _decide(ids.join(groups, "h"), id_col)


def _decide(joined: DataFrame, id_col: str) -> DataFrame:
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    turn = F.row_number().over(Window.partitionBy("sha", "id").orderBy("n"))
    return joined.withColumn("turn", turn).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").cast("long").alias("group_size"), (stays & (F.col("turn") == 1)).alias("kept"), F.col("sha").alias("text_sha256"), F.col("h").alias("content_hash")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs with its own columns, one row for each group of equal texts; see duplicate_groups for the rules."""
    with rounds() as kept:
        groups = duplicate_groups(docs, id_col, text_col, keep).filter("group_size > 1")
        told = groups.groupBy(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays"))
        told = materialize(told, "told", kept)
    return without(docs, F.col(id_col), F.unhex(F.sha2(fold_ascii(F.col(text_col)).cast("binary"), 256)), told)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
