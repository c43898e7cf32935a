"""What the operators share: the shared folder, written intermediate tables, file access on executors.

Intermediate results that cut lineage are Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``; every executor sees it, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.sources.graph import _written, scratch_dir

#: White space for words: the space and the control characters 9 to 13.
WORD = r"[^ \t-\r]+"

#: ASCII capitals and their lower-case forms; the only letters that exact and near dedup fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_ROWS = 250_000

#: Bytes of an Arrow batch, and the session's setting for them.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; deleted when the driver ends."""
    path = posixpath.join(scratch_dir(spark), f"knotwork-{uuid.uuid4().hex}", name)
    _written.append((spark, posixpath.dirname(path)))
    return path


def materialize(df: DataFrame, name: str, keep: list | None = None) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back: computed once, with a short lineage.

    With `keep`, the list of an enclosing rounds(), the table outlives it; all others written inside are deleted at its end.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    if keep is not None:
        keep.append(posixpath.dirname(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES, where the session sets no other number of bytes.

    The batches of texts that the JVM and the worker hold at a time are then small whatever the texts' lengths; a batch
    has one row at least.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def filesystem(uri: str):
    """(file system, path) for executors' own files: local paths, hdfs, s3, gs as pyarrow knows them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, data_writer) -> None:
    """Calls data_writer(stream) on a temporary name, then moves it to uri: repeated tasks replace whole files."""
    where, path = filesystem(uri)
    where.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(draft) as out:
        data_writer(out)
    where.move(draft, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the folds of labelled rows. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sent(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast while it has at most BROADCAST_ROWS rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def without(docs: DataFrame, key: Column, digest: Column, told: DataFrame) -> DataFrame:
    """docs without the rows that `told` (id, sha, n, stays; each pair once) does not let stay; of n rows that do, one is kept."""
    names = docs.columns
    marked = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), key.alias("_id"), digest.alias("_sha"))
    pair = lambda t: t.select(F.col("id").alias("_gone_id"), F.col("sha").alias("_gone_sha"))
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_sha") == F.col("_gone_sha"))
    gone, twice = told.filter("not stays"), told.filter("stays and n > 1")
    if not twice.isEmpty():
        # pre-aggregated where the rows are, so a row that repeats very often reaches its reducer once a task
        once = marked.join(sent(pair(twice)), same, "left_semi").groupBy("_id", "_sha").agg(F.first("_row").alias("_row"))
        rest = marked.join(sent(pair(gone.unionByName(twice))), same, "left_anti")
        return rest.select("_row.*").unionByName(once.select("_row.*")).select(*[F.col(f"`{c}`") for c in names])
    return marked.join(sent(pair(gone)), same, "left_anti").select("_row.*")
