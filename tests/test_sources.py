import gzip

import pytest

from knotwork.errors import QueryError
from knotwork.operators.schema import partition_of
from knotwork.session import Session
from knotwork.sources import backup, csv_import
from knotwork.sources.graph import FieldDef
from knotwork.streaming import ingest


def test_csv(spark, tmp_path):
    nodes, edges = tmp_path / "sku.csv.gz", tmp_path / "same.csv"
    nodes.write_bytes(gzip.compress(b"id,price\nS1,100\nS2,x\nS1,7\nS3,\n"))
    edges.write_text("src,dst,r\nS1,S2,3\nS2,S9,\n")
    got = csv_import.load_nodes(spark, str(nodes), [FieldDef("price", "INT64")]).orderBy("vid").collect()
    assert [(r.vid, r.id, r.price, r.rejected) for r in got] == [(1, "S1", 100, {}), (2, "S2", None, {"price": "x"}), (3, "S3", None, {})]
    ids = spark.createDataFrame([(r.vid, r.id) for r in got], "vid long, id string")
    assert [tuple(r)[:3] for r in csv_import.load_edges(spark, str(edges), ids, [], "r").collect()] == [(1, 2, 3)]
    with pytest.raises(QueryError):
        csv_import.load_nodes(spark, str(nodes), [], strict=True)
    with pytest.raises(QueryError):
        csv_import.load_edges(spark, str(edges), ids, [], strict=True)


def test_backup(spark, tmp_path):
    db = Session(spark)
    db.execute('CREATE SPACE g; USE g; CREATE TAG t(a INT64); CREATE EDGE e(w DOUBLE) SYMMETRIC; INSERT VERTEX t(a) VALUES 1:(5); INSERT EDGE e(w) VALUES 1->2:(0.5)')
    folder = f"file://{tmp_path}/b"
    backup.create(db.space, folder)
    assert {r.status for r in backup.verify(spark, folder).collect()} == {"ok"}
    again = Session(spark, {"g": backup.restore(spark, folder)})
    assert sorted(tuple(r) for r in again.execute("GO FROM 1, 2 OVER e").collect()) == [(1, 2), (2, 1)]
    spark.createDataFrame([(1, 6)], "vid long, a long").write.mode("overwrite").parquet(f"{folder}/tag/t")
    with pytest.raises(QueryError):
        backup.restore(spark, folder)


def test_partitions(spark):
    vids = spark.createDataFrame([(-5,), (0,), (5,), (20,)], "vid long")
    parts = lambda *a: [r.part for r in partition_of(vids, 4, *a).orderBy("vid").collect()]
    assert parts("MODULO") == [2, 1, 2, 1] and parts("RANGE", (0, 10)) == [1, 2, 2, 3]
    assert all(1 <= p <= 4 for p in parts())


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "u long, t long, body string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("u long, t long, body string").parquet(f"{tmp_path}/in")
    query = ingest.ingest(ingest.versions(stream, F.col("u"), F.col("t"), {"body": F.col("body")}), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert query.awaitTermination(120)
    assert ingest.history(spark, f"{tmp_path}/out").count() == 2


def test_entry_points():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
