"""Bulk import of nodes and edges from CSV files (also .csv.gz) with a header row.

Ids are numbered from 1 in the order of the file. The order is the position in the file, so numbers are given by a range
partition and per-partition offsets rather than by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.sources.graph import FieldDef, cut


def typed(df: DataFrame, fields: list[FieldDef], keep: list[str]) -> DataFrame:
    """Cells by declared type: empty is null; what does not fit is null, and its text is in the map `rejected`."""
    columns, rejected = [], []
    for f in fields:
        text = F.when(F.col(f"`{f.name}`") != "", F.col(f"`{f.name}`")) if f.name in df.columns else F.lit(None).cast("string")
        value = text.try_cast(f.stored)
        columns.append(value.alias(f.name))
        rejected.append(F.struct(F.lit(f.name).alias("k"), F.when(value.isNull(), text).alias("v")))
    bad = F.map_from_entries(F.filter(F.array(*rejected), lambda x: x["v"].isNotNull())) if rejected else F.lit(None).cast("map<string,string>")
    return df.select(*keep, *columns, bad.alias("rejected"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with n = 1, 2, ... in the order of the columns, without bringing all rows into one task."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_part").withColumn("n", (within + F.col("_before")).cast("long")).drop("_part", "_before")


def load_nodes(spark: SparkSession, path: str, fields: list[FieldDef], strict: bool = False) -> DataFrame:
    """(vid, id, fields..., rejected): of rows with one id the first stays; with strict they are an error."""
    raw = spark.read.option("header", True).csv(path)
    if "id" not in raw.columns:
        raise QueryError("a node file has a column id")
    placed = raw.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    first = Window.partitionBy("id").orderBy("_file", "_at")
    placed = cut(placed.withColumn("_n", F.row_number().over(first)))
    if strict and not placed.filter("_n > 1").isEmpty():
        raise QueryError("an id occurs twice")
    rows = numbered(placed.filter("_n = 1"), ["_file", "_at"]).withColumnRenamed("n", "vid")
    return typed(rows, fields, ["vid", "id"])


def load_edges(spark: SparkSession, path: str, ids: DataFrame, fields: list[FieldDef], rank_column: str | None = None, strict: bool = False) -> DataFrame:
    """(src, dst, rank, fields..., rejected): ends are looked up in ids (vid, id); edges without both are left out."""
    raw = spark.read.option("header", True).csv(path)
    if not {"src", "dst"} <= set(raw.columns):
        raise QueryError("an edge file has columns src and dst")
    rank = F.coalesce(F.col(rank_column).try_cast("long"), F.lit(0)) if rank_column else F.lit(0)
    rows = raw.withColumn("_rank", rank.cast("long")).withColumnsRenamed({"src": "_src", "dst": "_dst"})
    both = rows.join(ids.select(F.col("id").alias("_src"), F.col("vid").alias("src")), "_src", "left").join(ids.select(F.col("id").alias("_dst"), F.col("vid").alias("dst")), "_dst", "left")
    if strict and not both.filter("src is null or dst is null").isEmpty():
        raise QueryError("an edge has an unknown end")
    kept = both.filter("src is not null and dst is not null").drop("_src", "_dst").withColumnRenamed("_rank", "rank")
    return typed(kept, fields, ["src", "dst", "rank"])
