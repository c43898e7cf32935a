"""State: refused statements, plans that do not grow, merged ids, limits, backups, stored spaces and vector indexes."""

import json

import pytest

from knotwork.errors import QueryError
from knotwork.operators import vector_index
from knotwork.operators.closure import needed_types, only_rules
from knotwork.session import Session
from knotwork.sources import backup
from knotwork.sources.store import Store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def db(spark):
    session = Session(spark)
    session.execute("CREATE SPACE g; USE g")
    return session


def test_a_refused_statement_changes_nothing(db):
    db.execute("CREATE TAG t(a INT64, e STRING); CREATE EDGE r(w DOUBLE)")
    for bad in ('INSERT VERTEX t(a) VALUES 1:([1.0, 2.0]), 2:("bad")', 'INSERT VERTEX t(a) VALUES 1:(1), 2:("bad")', 'INSERT VERTEX t(e) VALUES 1:("x"), 2:([1.0])', "INSERT EDGE r(w) VALUES 1->2:(1.0), 2->3:(true)", 'INSERT VERTEX t(a) VALUES 1:(1), "s":(2)'):
        with pytest.raises(QueryError):
            db.execute(bad)
    assert [f.kind for f in db.space.tags["t"].fields] == ["INT64", "STRING"] and rows(db.space.tag("t")) == [] and rows(db.space.edge("r")) == []
    db.execute('INSERT VERTEX t(a, e) VALUES 1:(1, [0.5, 1.0]), 2:(2, NULL)')
    assert [f.kind for f in db.space.tags["t"].fields] == ["INT64", "VECTOR"] and rows(db.space.tag("t")) == [(1, 1, [0.5, 1.0]), (2, 2, None)]
    with pytest.raises(QueryError):
        db.execute('UPDATE VERTEX ON t 1 SET e = "x"')
    with pytest.raises(QueryError):
        db.execute("UPDATE VERTEX ON t 1 SET a = [1.0]")
    assert rows(db.space.tag("t")) == [(1, 1, [0.5, 1.0]), (2, 2, None)]


def test_plans_do_not_grow_with_statements(db):
    db.execute("CREATE TAG t(a INT64); CREATE EDGE e(w INT64); CREATE TAG u(b INT64)")
    size = lambda: len(db.space.tag("t")._jdf.queryExecution().analyzed().toString().splitlines()) + len(db.space.edge("e")._jdf.queryExecution().analyzed().toString().splitlines())
    sizes = []
    for k in range(24):
        db.execute(f"INSERT VERTEX t(a) VALUES {k % 10}:({k}); INSERT EDGE e(w) VALUES {k % 10}->{k}:({k})")
        sizes.append(size())
    assert max(sizes[16:]) <= max(sizes[:16]) < 400
    last = {k % 10: k for k in range(24)}
    assert rows(db.space.tag("t")) == sorted(last.items(), key=repr) and db.space.edge("e").count() == 24
    assert len(rows(db.execute(f"FETCH PROP ON t 0 AS OF {db.last_tx}"))) == 1


def test_merged_ids_stand_for_each_other(db):
    db.execute("CREATE TAG t(n STRING); CREATE EDGE e(w INT64); CREATE EDGE has()")
    db.execute('INSERT VERTEX t(n) VALUES 2:("a"), 5:("b"), 9:("c"); INSERT EDGE e(w) VALUES 5->9:(1); INSERT EDGE has() VALUES 5->100:(), 9->100:(); INSERT EDGE sameAs() VALUES 5->2:()')
    for same in (2, 5):
        assert rows(db.execute(f"MATCH (x:t)-[:e]->(y) WHERE id(x) == {same} RETURN id(x) AS x, id(y) AS y")) == [(2, 9)]
        assert rows(db.execute(f"MATCH (x:t) WHERE id(x) IN [{same}, 9] AND NOT (id(x) == 9) RETURN id(x) AS x")) == [(2,)]
        assert [r.vid for r in db.execute(f"RECOMMEND SIMILAR TO {same} OVER has").collect()] == [9]
    assert rows(db.execute("UPDATE EDGE ON e 5->9 SET w = 7")) == [(1,)] and rows(db.space.edge("e").select("src", "w")) == [(2, 7)]
    assert rows(db.execute("DELETE EDGE e 5->9")) == [(1,)] and db.space.edge("e").count() == 0


def test_limits(spark):
    db = Session(spark, scan_limit=3, work_limit=4)
    db.execute("CREATE SPACE g; USE g; CREATE TAG t(); CREATE EDGE e()")
    db.execute("INSERT VERTEX t() VALUES " + ", ".join(f"{k}:()" for k in range(4)) + "; INSERT EDGE e() VALUES " + ", ".join(f"{k}->{k + 1}:()" for k in range(8)))
    with pytest.raises(QueryError, match="scans more than 3"):
        db.execute("MATCH (x) RETURN id(x) AS v")
    assert db.execute("MATCH (x:t) RETURN id(x) AS v").count() == 4
    for kind in ("SHORTEST PATH", "ALL SHORTEST PATHS"):
        assert [r.path for r in db.execute(f"FIND {kind} FROM 0 TO 3 OVER e").collect()] == [[0, 1, 2, 3]]
        with pytest.raises(QueryError, match="reaches more than 4"):
            db.execute(f"FIND {kind} FROM 0 TO 7 OVER e")
    db.scan_limit = None
    assert db.execute("MATCH (x) RETURN id(x) AS v").count() == 4


def test_all_paths_through_many_levels(db):
    """Five diamonds in a row: 32 shortest paths of 10 steps; of them the smallest, and an error beyond the most."""
    db.execute("CREATE EDGE e()")
    edges = [(3 * k, 3 * k + x) for k in range(5) for x in (1, 2)] + [(3 * k + x, 3 * k + 3) for k in range(5) for x in (1, 2)]
    db.execute("INSERT EDGE e() VALUES " + ", ".join(f"{a}->{b}:()" for a, b in edges))
    found = [r.path for r in db.execute("FIND ALL SHORTEST PATHS FROM 0 TO 15 OVER e UPTO 10 STEPS").collect()]
    assert len(found) == len(set(map(tuple, found))) == 32 and all(len(p) == 11 for p in found)
    assert [r.path for r in db.execute("FIND SHORTEST PATH FROM 0 TO 15 OVER e UPTO 10 STEPS").collect()] == [min(found)]
    assert db.execute("FIND ALL SHORTEST PATHS FROM 0 TO 15 OVER e UPTO 9 STEPS").count() == 0


def test_alter_and_discovery(db):
    db.execute("CREATE TAG t(a INT64)")
    with pytest.raises(QueryError, match="NULL or a DEFAULT"):
        db.execute("ALTER TAG t ADD (b INT64 NOT NULL)")
    db.execute("ALTER TAG t ADD (b INT64 NOT NULL DEFAULT 3)")
    found = json.loads(db.discover())
    assert found["contract_version"] == "1" and found["limits"]["max_tags"] == 256
    assert [(p["name"], p["nullable"], p["has_default"]) for p in found["schema"]["tags"][0]["properties"]] == [("a", True, False), ("b", False, True)]
    db.execute("CREATE TAG wide(" + ", ".join(f"p{k} INT64" for k in range(129)) + ")")
    with pytest.raises(QueryError, match="more than 128 properties"):
        db.discover()
    with pytest.raises(QueryError):
        db.discover("nowhere")


def test_profile_names_operators(db):
    db.execute("CREATE TAG t(a INT64); INSERT VERTEX t(a) VALUES 1:(1), 2:(2), 3:(3)")
    found = db.execute("PROFILE MATCH (x:t) WHERE x.a > 1 RETURN id(x) AS v").collect()
    assert found[0].operator == "TagScan" and any(r.access == "spark" and r.rows is not None for r in found)
    plan = db.execute("EXPLAIN LOOKUP ON t WHERE a == 1").collect()[-1]
    assert plan.operator == "Plan" and "AdaptiveSparkPlan" in plan.detail


MAKE = "CREATE SPACE g; USE g; CREATE CLASS animal(name STRING); CREATE CLASS dog(name STRING) SUBCLASS OF animal; CREATE EDGE anc() TRANSITIVE; CREATE EDGE owns(since INT64) RANGE dog; CREATE SHAPE s ON animal (name STRING REQUIRED, name CHECK length(name) > 1); CREATE TAG INDEX i ON dog(name)"
FILL = 'INSERT VERTEX dog(name) VALUES 1:("rex"), 2:("ace"); INSERT EDGE anc() VALUES 1->2:(), 2->3:(); INSERT EDGE owns(since) VALUES 7->1:(5); INSERT EDGE sameAs() VALUES 2->12:()'


def state_of(db):
    why = rows(db.execute("WHY 1 -> 3 OVER anc"))
    with pytest.raises(QueryError, match="breaks s"):
        db.execute('INSERT VERTEX dog(name) VALUES 8:("x")')
    return why, rows(db.space.tag("dog")), rows(db.space.edge("anc")), rows(db.space.edge("owns")), rows(db.execute('MATCH (x) WHERE is_a(x, "animal") RETURN id(x) AS v')), db.space.shapes, db.space.indexes, db.space.partition_by


def test_backup_keeps_everything(spark, tmp_path):
    db = Session(spark)
    db.execute(MAKE + "; " + FILL)
    before = state_of(db)
    backup.create(db.space, f"file://{tmp_path}/b")
    again = Session(spark, {"g": backup.restore(spark, f"file://{tmp_path}/b")})
    assert state_of(again) == before and before[0][0][2] == "inferred"
    again.execute("INSERT EDGE anc() VALUES 3->4:()")
    assert (1, 4) in {(r.src, r.dst) for r in again.space.edge("anc").collect()}


def test_store_commits_every_statement(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    made = Session(spark)
    made.execute(MAKE)
    Store(spark, folder).commit(made.space)
    db = Session(spark, stores={"g": Store(spark, folder)})
    db.execute(FILL)
    before = state_of(db)
    opened = Session(spark, {"g": Store(spark, folder).open()})
    assert state_of(opened) == before
    first = Store(spark, folder).open(1)
    assert first.tag("dog").count() == 0 and len(Store(spark, folder).numbers()) == 5
    moment = db.last_tx
    db.execute("DELETE VERTEX 1; UPDATE VERTEX ON dog 2 SET name = next")
    store = Store(spark, folder)
    compact = Session(spark, {"g": store.compact()})
    assert rows(compact.space.tag("dog")) == [(2, "next")] and rows(compact.execute(f"FETCH PROP ON dog 1 AS OF {moment}")) == [(1, '{"name":"rex"}')]
    assert store.vacuum() > 0 and len(store.numbers()) == 1
    assert rows(Store(spark, folder).open().tag("dog")) == [(2, "next")]
    with pytest.raises(QueryError):
        Store(spark, f"file://{tmp_path}/nothing").open()


def test_rules_that_a_type_needs(db):
    db.execute("CREATE EDGE a(); CREATE EDGE b() SUBPROPERTY OF a; CREATE EDGE c() INVERSE OF b; CREATE EDGE x() TRANSITIVE; CREATE EDGE q() CHAIN x, b")
    assert needed_types(db.space, ["a"]) == {"a", "b", "c"} and needed_types(db.space, ["q"]) == {"q", "x", "b", "c"} and needed_types(db.space, ["x"]) == {"x"}
    fewer = only_rules(db.space, ["x"])
    assert fewer.edges["x"].transitive and not fewer.edges["b"].sub and fewer.edges["c"].inverse is None and db.space.edges["b"].sub == ("a",)


def test_vector_index(db):
    db.execute("CREATE TAG t(e STRING)")
    db.execute("INSERT VERTEX t(e) VALUES " + ", ".join(f"{k}:([{k % 10}.0, {k // 10}.5])" for k in range(100)) + ", 200:([1.0]), 201:([0.0, 0.0]), 202:(NULL)")
    index = vector_index.build(db.space, "e", cells=8)
    assert index.cells.count() == 100 and index.search([1.0], 3).count() == 0
    exact = [r.vid for r in db.execute("RECOMMEND SIMILAR TO 37 BY EMBEDDING e LIMIT 8").collect()]
    assert [r.vid for r in index.search([7.0, 3.5], 8, 37, probed=1.0).collect()] == exact
    found = index.search_all(db.space.tag("t").select("vid", db.space.tag("t")["e"].alias("vector")), 3)
    assert found.groupBy("query").count().filter("count = 3").count() == 100
    db.execute("CREATE TAG none(v STRING)")
    assert vector_index.build(db.space, "v").search([1.0], 3).count() == 0


def test_grouping_keys_are_finite(db):
    db.execute("CREATE TAG t(a DOUBLE, b DOUBLE); INSERT VERTEX t(a, b) VALUES 1:(1.0, 0.0), 2:(1.0, -0.0), 3:(NULL, 2.0)")
    assert rows(db.execute("MATCH (x:t) RETURN x.a AS a, COUNT(*) AS n")) == [(1.0, 2), (None, 1)]
    assert [n for _, n in rows(db.execute("MATCH (x:t) RETURN x.b AS b, COUNT(*) AS n"))] == [2, 1]
    db.space.tag_frames["t"] = db.space.tag("t").withColumn("a", db.space.tag("t")["a"] * float("inf"))
    with pytest.raises(Exception, match="not finite"):
        db.execute("MATCH (x:t) RETURN x.a AS a, COUNT(*) AS n").collect()


def test_pairs_of_unrelated_patterns(db):
    db.execute("CREATE TAG t(); CREATE TAG u(); INSERT VERTEX t() VALUES 1:(), 2:(); INSERT VERTEX u() VALUES 3:(), 4:()")
    pairs = "MATCH (x:t), (y:u) RETURN id(x) AS x, id(y) AS y"
    assert rows(db.execute(pairs)) == [(1, 3), (1, 4), (2, 3), (2, 4)]
    db.scan_limit = 3
    with pytest.raises(QueryError, match="more than 3 pairs"):
        db.execute(pairs)


def test_rounds_are_deleted(db):
    """What FIND and the identity merge write on the way is gone when they are done."""
    from knotwork.sources.graph import _written

    db.execute("CREATE TAG t(); CREATE EDGE e(); INSERT EDGE e() VALUES 1->2:(), 2->3:(), 3->4:()")
    before = len(_written)
    assert [r.path for r in db.execute("FIND SHORTEST PATH FROM 1 TO 4 OVER e").collect()] == [[1, 2, 3, 4]]
    assert len(db.execute("FIND ALL SHORTEST PATHS FROM 1 TO 4 OVER e").collect()) == 1 and len(_written) == before
    db.execute("INSERT EDGE sameAs() VALUES 2->1:()")
    assert len(_written) == before + 1 and rows(db.execute("GO FROM 1 OVER e")) == [(1, 1), (1, 3)]


def test_nearest_vectors_by_tiles(spark, monkeypatch):
    """Tiles give what the plain expression gives over all pairs, with copies, several lengths, and numbers that are none."""
    from random import Random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from knotwork.operators import nearest
    from knotwork.operators.recommend import cosine

    draw = Random(5)
    vectors = [[float(draw.randint(-9, 9)) / 7 for _ in range(draw.choice((3, 3, 6)))] for _ in range(200)]
    vectors += [[1.0, 2.0, 3.0]] * 60 + [[2.0, 4.0, 6.0], [0.0, 0.0, 0.0], [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], None]
    draw.shuffle(vectors)
    for kind in ("long", "string"):
        table = spark.createDataFrame([(k if kind == "long" else f"v{k}", v) for k, v in enumerate(vectors)] + [(None, [1.0, 1.0, 1.0])], f"vid {kind}, vector array<float>")
        queries = table.filter(F.pmod(F.xxhash64("vid"), F.lit(4)) == 0)
        pairs = queries.select(F.col("vid").alias("query"), F.col("vector").alias("own")).crossJoin(table).filter("query <> vid and own <> array(0f, 0f, 0f) and vector <> array(0f, 0f, 0f)").select("query", "vid", cosine(F.col("own"), F.col("vector")).alias("score")).filter("score is not null")
        wanted = pairs.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vid"))).filter("n <= 7").drop("n")
        monkeypatch.setattr(nearest, "QUERY_BYTES", 4000)
        monkeypatch.setattr(nearest, "LEAST_VECTORS", 40)
        found = nearest.nearest_of_all(queries, table, 7)
        plain = lambda df: rows(df.withColumn("score", F.nanvl("score", F.lit(9.0))))
        assert plain(found) == plain(wanted) and len(rows(found)) > 300
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_index_compares_no_pairs_as_rows(db):
    """A search of many queries joins vectors with nothing but the cells' places, and is exact when it takes all cells."""
    from knotwork.operators import nearest

    db.execute("CREATE TAG t(e STRING)")
    db.execute("INSERT VERTEX t(e) VALUES " + ", ".join(f"{k}:([{k % 10}.0, {k // 10}.5])" for k in range(100)))
    index, vectors = vector_index.build(db.space, "e", cells=8), vector_index.vectors_of(db.space, "e")
    found = index.search_all(vectors, 5, probed=1.0)
    assert rows(found) == rows(nearest.nearest_of_all(vectors, vectors, 5))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    few = index.search_all(vectors, 5, probed=0.2)
    assert {r.query: r.vid for r in few.collect() if r.query == 37}.keys() == {37}
    own = index.search(vectors.filter("vid = 37").first()["vector"], 5, 37, probed=0.2)
    assert rows(few.filter("query = 37").select("vid")) == rows(own.select("vid"))
