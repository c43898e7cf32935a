"""Backups: a space's tables as Parquet beside a manifest of its declarations, row counts and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.sources.graph import Space
from knotwork.sources.manifest import declared, put_table, read_json, read_table, tables, undeclared, write_json

VERSION = 2


def _sum(df: DataFrame) -> list:
    """Rows and an order-free checksum; maps have none and are taken as their entries."""
    plain = [F.map_entries(f"`{n}`") if t.startswith("map<") else F.col(f"`{n}`") for n, t in df.dtypes]
    r = df.select(F.xxhash64(*plain).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return [r["n"], r["s"]]


def create(space: Space, folder: str) -> dict:
    """Writes all tables of a space below folder and returns the manifest, which is written last."""
    sums = {}
    for name, df in tables(space).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        sums[name] = [*_sum(space.spark.read.schema(df.schema).parquet(f"{folder}/{name}")), df._jdf.schema().json()]
    manifest = {"version": VERSION, "tables": sums, "space": declared(space)}
    write_json(space.spark, manifest, f"{folder}/manifest")
    return manifest


def manifest_of(spark: SparkSession, folder: str) -> dict:
    found = read_json(spark, f"{folder}/manifest")
    if found["version"] != VERSION:
        raise QueryError("the backup has another version")
    return found


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """table, rows, status: what is there against the manifest."""
    rows = []
    for name, (n, total, schema) in manifest_of(spark, folder)["tables"].items():
        now = _sum(read_table(spark, f"{folder}/{name}", schema))
        rows.append((name, now[0], "ok" if now == [n, total] else "damaged"))
    return spark.createDataFrame(rows, "table string, rows long, status string")


def restore(spark: SparkSession, folder: str) -> Space:
    """The space that was backed up, with its shapes, derived facts and proofs; an error if a table differs."""
    m = manifest_of(spark, folder)
    if m["tables"] and not verify(spark, folder).filter("status <> 'ok'").isEmpty():
        raise QueryError("the backup is damaged")
    space = undeclared(spark, m["space"])
    for name, (_, _, schema) in m["tables"].items():
        put_table(space, name, read_table(spark, f"{folder}/{name}", schema))
    return space
