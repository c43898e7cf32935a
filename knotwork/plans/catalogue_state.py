"""Registered queries about state: changes, identities, imports, stored spaces, metadata and what rules and vectors add."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.operators import closure, identity, schema, vector_index
from knotwork.operators.nearest import nearest_of_all
from knotwork.operators.recommend import vectors_of
from knotwork.plans.catalogue import COSINE, ORACLES, QUERIES, add, plain_names, register, rounded, same_pairs, v
from knotwork.session import Session
from knotwork.sources import backup, csv_import
from knotwork.sources.graph import FieldDef, Space, _written, scratch_dir
from knotwork.sources.sample import sample_space, semantic_space, tagged_space
from knotwork.sources.store import Store
from knotwork.streaming import ingest


def folder(spark) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/registered-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def session(spark, sf_dir, space=sample_space, **options) -> Session:
    return Session(spark, {"sample": space(spark, sf_dir)}, **options)


def after(text: str, then, space=sample_space):
    """A query that runs a script and then takes something of the session."""
    return lambda spark, sf_dir: then((db := session(spark, sf_dir, space)).execute(text), db)


# --- changes --------------------------------------------------------------------------------------------------------

edges_now = lambda name, *columns: lambda _, db: db.space.edge(name).select("src", "dst", "rank", *columns)
register("insert_edge", after("INSERT EDGE supp_in() VALUES 4000000001->2000000003:(), 4000000001->2000000003@5:(), 4999999999->2000000001:(); INSERT EDGE supplies(n_lines) VALUES 1->2:(7); INSERT EDGE supp_in() VALUES 4000000001->2000000003:()", edges_now("supp_in")), "SELECT src, dst, 0::BIGINT AS rank FROM supp_in UNION SELECT 4000000001, 2000000003, 0 UNION SELECT 4000000001, 2000000003, 5 UNION SELECT 4999999999, 2000000001, 0")


def first_order(spark, sf_dir) -> tuple[int, int]:
    r = spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey").select("o_custkey", "o_orderkey").first()
    return 3 * 10**9 + r[0], 6 * 10**9 + r[1]


def update_edge(spark, sf_dir):
    a, b = first_order(spark, sf_dir)
    db = session(spark, sf_dir)
    db.execute(f"UPDATE EDGE ON placed {a}->{b} SET o_totalprice = 1.5 WHEN placed.o_totalprice > 1.5; UPDATE EDGE ON placed {a}->{b}@3 SET o_totalprice = 2.5")
    return db.space.edge("placed").select("src", "dst", "rank", "o_totalprice")


def delete_edge(spark, sf_dir):
    a, b = first_order(spark, sf_dir)
    db = session(spark, sf_dir)
    n = db.execute(f"DELETE EDGE placed {a}->{b}, {a}->{b}@1, 1->2").first()[0]
    return db.space.edge("placed").select("src", "dst").withColumn("n", F.lit(n))


register("update_edge", update_edge, "SELECT src, dst, 0::BIGINT AS rank, CASE WHEN dst = (SELECT min(dst) FROM placed) AND o_totalprice > 1.5 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM placed")
register("delete_edge", delete_edge, "SELECT src, dst, 1::BIGINT AS n FROM placed WHERE dst <> (SELECT min(dst) FROM placed)")
register("delete_vertex_where", after('DELETE VERTEX 2000000001, 2000000002, 2000000003 WHERE n_name != "NATION_2"', lambda _, db: db.space.tag("nation").select("vid", "n_name")), f"SELECT {v(2, 'n_nationkey')} AS vid, n_name FROM nation WHERE n_nationkey NOT IN (1, 3)")
register("update_upsert", after("UPDATE VERTEX ON region 1000000077 SET r_name = new", lambda n, db: db.space.tag("region").select("vid", "r_name").withColumn("n", F.lit(n.first()[0]))), f"SELECT {v(1, 'r_regionkey')} AS vid, r_name, 1::BIGINT AS n FROM region UNION ALL SELECT 1000000077, 'new', 1")
register("insert_replaces_all_tags", after("INSERT VERTEX vip(tier) VALUES 3000000001:(99)", lambda _, db: db.execute("MATCH (x:customer|vip) RETURN id(x) AS vid, x.vip.tier AS tier, x.customer.c_name AS name"), tagged_space), f"SELECT {v(3, 'c_custkey')} AS vid, CASE WHEN c_custkey = 1 THEN 99 WHEN c_acctbal > 5000 THEN floor(c_acctbal / 1000)::BIGINT END AS tier, CASE WHEN c_custkey <> 1 THEN c_name END AS name FROM customer")
register("match_missing_endpoint", after("DELETE VERTEX 2000000003; GO FROM 2000000003 OVER supp_in REVERSELY", lambda gone, db: db.execute("MATCH (s:supplier)-[:supp_in]->(n) RETURN id(s) AS src, id(n) AS dst").withColumn("kind", F.lit("match")).unionByName(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("go").alias("kind")))), "SELECT src, dst, 'match' AS kind FROM supp_in WHERE dst <> 2000000003 UNION ALL SELECT src, dst, 'go' FROM supp_in WHERE dst = 2000000003")


def history_of_changes(spark, sf_dir):
    """What a vertex was at each of four moments: inserted at 100, updated at 200 and deleted at 300."""
    ticks = iter((100, 200, 300))
    db = session(spark, sf_dir, clock=lambda: next(ticks))
    db.execute('INSERT VERTEX region(r_name) VALUES 1000000500:("first"); UPDATE VERTEX ON region 1000000500 SET r_name = "second"; DELETE VERTEX 1000000500')
    found = [db.execute(f"FETCH PROP ON region 1000000500 AS OF {t}").select(F.lit(t).cast("long").alias("moment"), F.get_json_object("region", "$.r_name").alias("name")) for t in (50, 100, 250, 300)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


register("history_of_changes", history_of_changes, "SELECT 100::BIGINT AS moment, 'first' AS name UNION ALL SELECT 250, 'second'")


def many_changes(spark, sf_dir):
    """Forty statements on one tag; changes are written out on the way."""
    db = session(spark, sf_dir)
    for k in range(40):
        db.execute(f'INSERT VERTEX region(r_name) VALUES {1000000003 + k % 20}:("r{k}")' if k % 4 else f"DELETE VERTEX {1000000003 + k % 20}")
    return db.space.tag("region").select("vid", "r_name")


register("many_changes", many_changes, f"SELECT {v(1, 'r_regionkey')} AS vid, r_name FROM region WHERE r_regionkey < 3 UNION ALL SELECT 1000000003 + k - 20, 'r' || k FROM range(20, 40) t(k) WHERE k % 4 <> 0")

# --- identities -----------------------------------------------------------------------------------------------------


def merged(spark, sf_dir) -> Space:
    return identity.merge(sample_space(spark, sf_dir), same_pairs(spark, sf_dir))


SAME = f"same AS (SELECT c_custkey, {v(3, 'c_custkey')} AS vid, min({v(3, 'c_custkey')}) OVER (PARTITION BY floor(c_acctbal / 100)) AS rep FROM customer)"


def greatest_member(space: Space) -> int:
    return space.same.filter("vid <> rep").agg(F.max("vid")).first()[0]


def match_merged_id(spark, sf_dir):
    """A pattern that names a vertex by an id that has been merged into another."""
    space = merged(spark, sf_dir)
    return Session(spark, {"sample": space}).execute(f"MATCH (c:customer)-[:placed]->(o:order_) WHERE id(c) == {greatest_member(space)} RETURN id(c) AS c, id(o) AS o")


TOP = "top AS (SELECT rep FROM same WHERE vid = (SELECT max(vid) FROM same WHERE vid <> rep))"
register("sameas_match_id", match_merged_id, f", {SAME}, {TOP} SELECT rep AS c, {v(6, 'o_orderkey')} AS o FROM orders JOIN same ON c_custkey = o_custkey WHERE rep = (SELECT rep FROM top)")
register("sameas_members", lambda spark, sf_dir: identity.members(space := merged(spark, sf_dir), greatest_member(space)), f", {SAME}, {TOP} SELECT vid FROM same WHERE rep = (SELECT rep FROM top)")


def delete_merged_edge(spark, sf_dir):
    """Deletes an edge that is named by merged ids."""
    space = merged(spark, sf_dir)
    top = greatest_member(space)
    db = Session(spark, {"sample": space})
    one = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(F.col("c_custkey") == top - 3 * 10**9).first()["c_nationkey"]
    db.execute(f"DELETE EDGE cust_in {top}->{2 * 10**9 + one}")
    return db.space.edge("cust_in").select("src", "dst")


register("sameas_delete_edge", delete_merged_edge, f", {SAME}, {TOP} SELECT DISTINCT rep AS src, {v(2, 'c_nationkey')} AS dst FROM customer JOIN same USING (c_custkey) EXCEPT SELECT (SELECT rep FROM top), {v(2, 'c_nationkey')} FROM customer WHERE {v(3, 'c_custkey')} = (SELECT max(vid) FROM same WHERE vid <> rep)")

# --- imports, backups and stores ------------------------------------------------------------------------------------


def csv_folder(spark, sf_dir) -> str:
    """The customers as CSV: ids in order, a column with cells that are no numbers, and repeated ids."""
    path = folder(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    price = F.when(F.col("c_custkey") % 7 == 0, F.lit("")).when(F.col("c_custkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("c_custkey").cast("string"))
    rows = c.select(F.col("c_custkey").alias("at"), F.concat(F.lit("C"), F.col("c_custkey") % 1000).alias("id"), F.col("c_name").alias("name"), price.alias("price"))
    rows.coalesce(1).sortWithinPartitions("at").drop("at").write.option("header", True).csv(f"{path}/nodes")
    edges = c.select("c_custkey", F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("C"), F.col("c_custkey") + 1).alias("dst"), (F.col("c_custkey") % 3).alias("r"))
    edges.coalesce(1).sortWithinPartitions("c_custkey").drop("c_custkey").write.option("header", True).option("compression", "gzip").csv(f"{path}/edges")
    return path


def csv_nodes(spark, sf_dir) -> DataFrame:
    found = csv_import.load_nodes(spark, f"{csv_folder(spark, sf_dir)}/nodes", [FieldDef("name", "STRING"), FieldDef("price", "INT64")])
    return found.select("vid", "id", "name", "price", F.col("rejected")["price"].alias("rejected"))


def csv_edges(spark, sf_dir) -> DataFrame:
    path = csv_folder(spark, sf_dir)
    ids = csv_import.load_nodes(spark, f"{path}/nodes", []).select("vid", "id")
    return csv_import.load_edges(spark, f"{path}/edges", ids, [], "r").select("src", "dst", "rank")


register("csv_nodes", csv_nodes, "SELECT row_number() OVER (ORDER BY k) AS vid, 'C' || k AS id, c_name AS name, CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN k END AS price, CASE WHEN k % 7 <> 0 AND k % 5 = 0 THEN 'n/a' END AS rejected FROM (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey < 1000)")
register("csv_edges", csv_edges, "SELECT a.c_custkey + 1 AS src, a.c_custkey + 2 AS dst, a.c_custkey % 3 AS rank FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE b.c_custkey < 1000")


def small_semantics(spark, sf_dir) -> Space:
    """Places with rules and a shape, small enough to be written several times."""
    space = semantic_space(spark, sf_dir)
    for group in (space.tags, space.tag_frames):
        for name in [n for n in group if n not in ("region", "nation")]:
            del group[name]
    for group in (space.edges, space.edge_frames):
        for name in [n for n in group if n not in ("in_region", "located_in", "partner")]:
            del group[name]
    space.tag_history, space.edge_history, space.classes = {}, {}, {n: c for n, c in space.classes.items() if n == "party"}
    db = Session(spark, {"sample": space})
    db.execute("CREATE SHAPE named ON nation (n_name STRING REQUIRED); REPAIR INFERENCE")
    return db.space


def restored(spark, sf_dir):
    """A proof and the shapes of a space that was backed up and restored."""
    path = folder(spark)
    backup.create(small_semantics(spark, sf_dir), path)
    db = Session(spark, {"sample": backup.restore(spark, path)})
    why = db.execute("WHY 2000000001 -> 1000000001 OVER located_in").select(F.concat_ws(" ", "depth", "status", "rule").alias("told"))
    return why.unionByName(spark.createDataFrame([(f"shape {s.name} on {s.on}: {s.rules[0][0]}",) for s in db.space.shapes.values()], "told string"))


register("backup_restore_why", restored, "SELECT '0 inferred subproperty' AS told FROM in_region WHERE src = 2000000001 AND dst = 1000000001 UNION ALL SELECT '1 asserted —' FROM in_region WHERE src = 2000000001 AND dst = 1000000001 UNION ALL SELECT '0 not found —' WHERE NOT EXISTS (SELECT 1 FROM in_region WHERE src = 2000000001 AND dst = 1000000001) UNION ALL SELECT 'shape named on nation: n_name'")


def backup_verify(spark, sf_dir):
    path = folder(spark)
    backup.create(small_semantics(spark, sf_dir), path)
    return backup.verify(spark, path).filter("table like 'tag/%' or table like 'edge/%' or table like 'derived/%'").select(F.col("table").alias("name"), "rows", "status")


register("backup_verify", backup_verify, "SELECT 'tag/nation' AS name, (SELECT count(*) FROM nation) AS rows, 'ok' AS status UNION ALL SELECT 'tag/region', (SELECT count(*) FROM region), 'ok' UNION ALL SELECT 'edge/in_region', (SELECT count(*) FROM nation), 'ok' UNION ALL SELECT 'edge/partner', (SELECT count(*) FROM nation), 'ok' UNION ALL SELECT 'edge/located_in', 0, 'ok' UNION ALL SELECT 'derived/located_in', (SELECT count(*) FROM nation), 'ok' UNION ALL SELECT 'derived/partner', (SELECT count(*) FROM nation), 'ok'")


def store_reopened(spark, sf_dir):
    """Statements committed one by one, then the space opened again from its folder, before and after compaction."""
    path = folder(spark)
    Store(spark, path).commit(small_semantics(spark, sf_dir))
    db = Session(spark, stores={"sample": Store(spark, path)})
    db.execute('INSERT VERTEX nation(n_name) VALUES 2000000001:("one"), 2000000999:("new"); DELETE VERTEX 2000000002; INSERT EDGE in_region() VALUES 2000000999->1000000001:()')
    again = Store(spark, path).open()
    rows = lambda space, told: space.tag("nation").select("vid", "n_name").withColumn("told", F.lit(told)).unionByName(space.edge("located_in").filter("src = 2000000999").select(F.col("dst").alias("vid"), F.lit("derived").alias("n_name"), F.lit(told).alias("told")))
    before = rows(again, "open")
    store = Store(spark, path)
    return before.unionByName(rows(store.compact(), "compact"))


register("store_reopened", store_reopened, f"SELECT vid, n_name, told FROM (SELECT {v(2, 'n_nationkey')} AS vid, CASE WHEN n_nationkey = 1 THEN 'one' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT 2000000999, 'new' UNION ALL SELECT 1000000001, 'derived'), (VALUES ('open'), ('compact')) t(told)")


def streamed(spark, sf_dir):
    """Events taken in as a stream of versions, then read as of a moment."""
    path = folder(spark)
    schema_of = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a stream reads folders or globs: the name ends in one, so that the table may be a file or a folder
    source = spark.readStream.schema(schema_of).parquet(f"{sf_dir}/events.parque[t]")
    found = ingest.versions(source, F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")), {"event_id": F.col("event_id"), "event_type": F.col("event_type")})
    ingest.ingest(found, f"{path}/versions", f"{path}/checkpoint").awaitTermination()
    from knotwork.operators.temporal import versions_as_of

    return versions_as_of(ingest.history(spark, f"{path}/versions"), ["vid"], 1705276800000000).select("vid", "event_id", "event_type")


register("stream_as_of", streamed, "SELECT user_id AS vid, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE epoch_us(ts) <= 1705276800000000) WHERE n = 1")

# --- metadata -------------------------------------------------------------------------------------------------------

add("describe_tag", "DESCRIBE TAG part", "SELECT * FROM (VALUES ('p_name', 'STRING', 'YES', NULL::VARCHAR), ('p_brand', 'STRING', 'YES', NULL), ('p_type', 'STRING', 'YES', NULL), ('p_size', 'INT64', 'YES', NULL), ('p_retailprice', 'DOUBLE', 'YES', NULL)) t(\"Field\", \"Type\", \"Null\", \"Default\")")
add("describe_edge", "DESCRIBE EDGE placed", "SELECT * FROM (VALUES ('o_orderdate', 'TIMESTAMP', 'YES', NULL::VARCHAR), ('o_totalprice', 'DOUBLE', 'YES', NULL)) t(\"Field\", \"Type\", \"Null\", \"Default\")")
add("describe_space", "DESCRIBE SPACE sample", "SELECT 'sample' AS \"Name\", '100' AS \"Partition_Number\", '1' AS \"Replica_Factor\", 'INT64' AS \"Vid_Type\"", plain_names)
add("show_tags", "SHOW TAGS", "SELECT * FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('order_'), ('account'), ('item'), ('doc')) t(\"Name\")")
add("show_edges", "SHOW EDGES", "SELECT * FROM (VALUES ('in_region'), ('cust_in'), ('supp_in'), ('placed'), ('contains'), ('supplied_by'), ('supplies')) t(\"Name\")")
add("show_classes", "SHOW CLASSES", "SELECT * FROM (VALUES ('party', '', '', ''), ('customer', 'party', '', ''), ('supplier', 'party', '', ''), ('buyer', 'party', '', ''), ('deal', '', '', 'party'), ('big', '', '', 'customer')) t(\"Name\", \"Parents\", \"Equivalent\", \"Disjoint\")", space=semantic_space)
add("show_indexes", "CREATE TAG INDEX by_size ON part(p_size, p_brand); CREATE EDGE INDEX by_price ON placed(o_totalprice); SHOW TAG INDEXES", "SELECT 'by_size' AS \"Index_Name\", 'part' AS \"On\", 'p_size, p_brand' AS \"Fields\"", plain_names)
add("show_create_edge", "SHOW CREATE EDGE home_region", "SELECT 'home_region' AS \"Name\", 'CREATE EDGE home_region () CHAIN cust_in, in_region' AS \"Statement\"", space=semantic_space)
add("show_parts", "SHOW PARTS", "SELECT k::INT AS \"Partition_ID\" FROM range(1, 101) t(k)", plain_names)
add("alter_tag", "ALTER TAG region ADD (population INT64 NULL); UPDATE VERTEX ON region 1000000001 SET population = 7; ALTER TAG region DROP (r_name); MATCH (r:region) RETURN id(r) AS vid, r.population AS p, r.r_name AS n", f"SELECT {v(1, 'r_regionkey')} AS vid, CASE WHEN r_regionkey = 1 THEN 7 END::BIGINT AS p, NULL::VARCHAR AS n FROM region", lambda df: df.withColumn("n", F.col("n").cast("string")))
add("check_inference", "CHECK INFERENCE", "SELECT 'sample' AS space, 'complete' AS status")
add("explain_steps", "EXPLAIN MATCH (c:customer)-[:cust_in]->(n:nation) WHERE c.c_acctbal > 0 RETURN n.n_name AS name, COUNT(*) AS n ORDER BY n DESC LIMIT 3", "SELECT * FROM (VALUES (0, 'TagScan'), (1, 'Expand'), (2, 'Filter'), (3, 'Aggregate'), (4, 'Project'), (5, 'Sort'), (6, 'Limit'), (7, 'Plan')) t(id, operator)", lambda df: df.select("id", "operator"))
add("profile_rows", "PROFILE LOOKUP ON part WHERE p_size >= 25", "SELECT 0 AS id, 'TagScan' AS operator, (SELECT count(*) FROM part WHERE p_size >= 25) AS rows", lambda df: df.filter("id = 0").select("id", "operator", "rows"))
register("profile_operators", after("PROFILE MATCH (p:part) WHERE p.p_size > 30 RETURN id(p) AS vid", lambda df, db: df.filter("access = 'spark' and rows is not null").agg(F.min("rows").alias("least"), F.max("rows").alias("most"))), "SELECT (SELECT count(*) FROM part WHERE p_size > 30) AS least, (SELECT count(*) FROM part) AS most")


def discovered(spark, sf_dir):
    found = json.loads(session(spark, sf_dir).discover())["schema"]
    return spark.createDataFrame([(kind, x["name"], len(x["properties"])) for kind in ("tags", "edges") for x in found[kind]], "kind string, name string, n int")


register("discovery", discovered, "SELECT kind, name, n::INT AS n FROM (VALUES ('tags', 'region', 1), ('tags', 'nation', 1), ('tags', 'customer', 3), ('tags', 'supplier', 2), ('tags', 'part', 5), ('tags', 'order_', 4), ('tags', 'account', 1), ('tags', 'item', 2), ('tags', 'doc', 3), ('edges', 'in_region', 0), ('edges', 'cust_in', 0), ('edges', 'supp_in', 0), ('edges', 'placed', 2), ('edges', 'contains', 4), ('edges', 'supplied_by', 1), ('edges', 'supplies', 1)) t(kind, name, n)")
register("partition_range", lambda spark, sf_dir: schema.partition_of(sample_space(spark, sf_dir).tag("customer").select("vid"), 3, "RANGE", (3000000100, 3000000700)).groupBy("part").agg(F.count(F.lit(1)).alias("n")), "SELECT 1 + (c_custkey >= 100)::BIGINT + (c_custkey >= 700)::BIGINT AS part, count(*) AS n FROM customer GROUP BY 1")
register("partition_hash", lambda spark, sf_dir: schema.partition_of(sample_space(spark, sf_dir).tag("customer").select("vid"), 16).agg(F.count(F.lit(1)).alias("n"), (F.min("part") >= 1).alias("low"), (F.max("part") <= 16).alias("high")), "SELECT count(*) AS n, true AS low, true AS high FROM customer")

# --- vectors and classes --------------------------------------------------------------------------------------------

BLEND = f"SELECT {v(8, 'e.vec_id')} AS vid, greatest({COSINE}, 0) AS c, {COSINE} AS emb, (e.label = s.label)::INT::DOUBLE AS struct FROM embeddings e, (SELECT embedding, label FROM embeddings WHERE vec_id = 3) s WHERE e.vec_id <> 3"
add("recommend_blend_vectors", "RECOMMEND SIMILAR TO 8000000003 BLEND EMBEDDING embedding 0.3 OVER labelled 0.7 LIMIT 25", f"SELECT vid, round(0.3 * c + 0.7 * struct, 4) AS score, round(emb, 4) AS emb, struct FROM ({BLEND}) ORDER BY 0.3 * c + 0.7 * struct DESC, vid LIMIT 25", rounded("score", "emb"), tagged_space)
add("recommend_is_a", 'RECOMMEND SIMILAR TO 3000000001 OVER cust_in WHERE is_a("party") LIMIT 30', f"SELECT src AS vid, 1.0::DOUBLE AS score, 1::BIGINT AS shared FROM cust_in WHERE dst = (SELECT dst FROM cust_in WHERE src = 3000000001) AND src <> 3000000001 ORDER BY vid LIMIT 30", space=semantic_space)
add("match_is_a_inferred", 'MATCH (c:customer) WHERE is_a(c, "buyer") RETURN id(c) AS vid', f"SELECT DISTINCT src AS vid FROM placed JOIN customer ON src = {v(3, 'c_custkey')}", space=lambda spark, sf_dir: closure.materialize_rules(closure.only_rules(semantic_space(spark, sf_dir), ("placed",))))



def index_recall(spark, sf_dir) -> DataFrame:
    """Every fiftieth vector searched in the index for its ten nearest, against exact search: the number, and whether nine in ten are found."""
    space = sample_space(spark, sf_dir)
    index, vectors = vector_index.build(space, "embedding"), vectors_of(space, "embedding")
    queries = vectors.filter("vid % 50 = 0")
    found = index.search_all(queries, 10)
    exact = nearest_of_all(queries, vectors, 10)
    hits = exact.join(found.select("query", "vid", F.lit(1).alias("hit")), ["query", "vid"], "left")
    return hits.agg(F.countDistinct("query").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


register("vector_index_recall", index_recall, "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")


def index_search(spark, sf_dir) -> DataFrame:
    """The index with all cells taken gives what exact search gives."""
    space = sample_space(spark, sf_dir)
    seed = vectors_of(space, "embedding").filter("vid = 8000000003").first()["vector"]
    return vector_index.build(space, "embedding").search(seed, 15, 8000000003, 1.0).select("vid", F.round("score", 4).alias("score"))


register("vector_index_search", index_search, f"SELECT {v(8, 'e.vec_id')} AS vid, round({COSINE}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) s WHERE e.vec_id <> 3 ORDER BY {COSINE} DESC, vid LIMIT 15")

# --- declarations and what is refused -------------------------------------------------------------------------------


def declared(spark, sf_dir) -> DataFrame:
    """A space declared, filled and asked by statements alone; the rows come from a table."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    db = Session(spark)
    db.execute("CREATE SPACE world (partition_num = 8, vid_type = FIXED_STRING(16)); USE world")
    db.execute("CREATE TAG region(name STRING); CREATE TAG nation(name STRING, code INT64); CREATE EDGE in_region(); CREATE EDGE holds() INVERSE OF in_region; CREATE TAG INDEX by_code ON nation(code)")
    db.execute("INSERT VERTEX region(name) VALUES " + ", ".join(f'"r{r[0]}":("{r[1]}")' for r in regions))
    db.execute("INSERT VERTEX nation(name, code) VALUES " + ", ".join(f'"n{n[0]}":("{n[1]}", {n[0]})' for n in nations))
    db.execute("INSERT EDGE in_region() VALUES " + ", ".join(f'"n{n[0]}"->"r{n[2]}":()' for n in nations))
    return db.execute("MATCH (r:region)-[:holds]->(n:nation) WHERE n.code >= 3 RETURN id(r) AS r, r.name AS region, COUNT(n) AS n, MIN(n.code) AS least GROUP BY r.name")


register("declared_by_statements", declared, "SELECT 'r' || r_regionkey AS r, r_name AS region, count(*) AS n, min(n_nationkey)::BIGINT AS least FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 3 GROUP BY ALL")
add("match_group_first", "MATCH (c:customer)-[:cust_in]->(n:nation) RETURN n.n_name AS name, id(n) AS nation, COUNT(c) AS n GROUP BY n.n_name", f"SELECT n_name AS name, {v(2, 'n_nationkey')} AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
add("shape_by_statement", "CREATE SHAPE rich ON party (c_acctbal DOUBLE REQUIRED, c_acctbal CHECK c_acctbal >= 100); CHECK SHAPE", f"SELECT {v(4, 's_suppkey')} AS vid, 'rich' AS shape, 'c_acctbal' AS property, x AS constraint FROM supplier, (VALUES ('REQUIRED'), ('CHECK')) t(x) UNION ALL SELECT {v(3, 'c_custkey')}, 'rich', 'c_acctbal', 'CHECK' FROM customer WHERE c_acctbal < 100", space=semantic_space)
add("consistency_by_statement", "CREATE CLASS rich() DISJOINT WITH customer; INSERT VERTEX rich(), customer(c_name) VALUES 3000000001:(\"x\"), 3000000002:(\"y\"); CHECK CONSISTENCY", "SELECT 3000000000 + k AS vid, 'customer' AS class_a, 'rich' AS class_b FROM range(1, 3) t(k)", space=sample_space)

#: Statements that are refused, with what must come before them.
REFUSED = {
    "steps of GO": "GO 21 STEPS FROM 1 OVER placed", "steps in wrong order": "GO 3..2 STEPS FROM 1 OVER placed", "destination in WHERE": "GO FROM 1 OVER placed WHERE $$.order_.o_totalprice > 1",
    "unknown column of a variable": "$a = GO FROM 1 OVER placed YIELD dst AS d; GO FROM $a.x OVER placed", "unknown variable": "GO FROM $b.x OVER placed",
    "empty range": "MATCH (a:nation)-[:in_region*0..0]->(b) RETURN id(b) AS b", "range in wrong order": "MATCH (a:nation)-[:in_region*3..2]->(b) RETURN id(b) AS b", "long range": "MATCH (a:nation)-[:in_region*1..21]->(b) RETURN id(b) AS b",
    "variable of a range": "MATCH (a:nation)-[e:in_region*1..2]->(b) RETURN id(b) AS b", "aggregate in WHERE": "MATCH (a:nation) WHERE COUNT(a) > 1 RETURN id(a) AS a", "aggregate of an aggregate": "MATCH (a:nation) RETURN SUM(COUNT(a)) AS n",
    "collect": "MATCH (a:nation) RETURN COLLECT(a) AS n", "unknown function": "MATCH (a:nation) WHERE frobnicate(a.n_name) RETURN id(a) AS a", "order by what is not returned": "MATCH (a:nation) RETURN id(a) AS a ORDER BY a.n_name",
    "arithmetic in RETURN": "MATCH (a:part) RETURN a.p_size + 1 AS x", "steps of FIND": "FIND SHORTEST PATH FROM 1 TO 2 OVER * UPTO 21", "weight both ways": "FIND SHORTEST PATH FROM 1 TO 2 OVER placed BIDIRECT WEIGHT BY o_totalprice",
    "weight of all paths": "FIND ALL SHORTEST PATHS FROM 1 TO 2 OVER placed WEIGHT BY o_totalprice", "FIND with WHERE": "FIND SHORTEST PATH FROM 1 TO 2 OVER placed WHERE 1 == 1", "LOOKUP with arithmetic": "LOOKUP ON part WHERE p_size + 1 == 2",
    "unknown tag": "LOOKUP ON nothing", "a value of another type": 'INSERT VERTEX part(p_size) VALUES 1:("x")', "an id of another type": 'INSERT VERTEX part(p_size) VALUES "a":(1)', "unknown property": "INSERT VERTEX part(nothing) VALUES 1:(1)",
    "parting the merged": "DELETE EDGE sameAs 1->2", "a merged vertex": "INSERT EDGE sameAs() VALUES 5->2:(); DELETE VERTEX 5", "a class in use": "CREATE CLASS a(); CREATE CLASS b() SUBCLASS OF a; DROP CLASS a",
    "a property without a default": "ALTER TAG part ADD (x INT64 NOT NULL)", "breaking a shape": 'CREATE SHAPE s ON part (p_name STRING REQUIRED); INSERT VERTEX part(p_size) VALUES 5999999999:(1)',
    "too many derived facts": "CREATE EDGE t() TRANSITIVE; INSERT EDGE t() VALUES 1->2:(), 2->3:(), 3->4:(), 4->5:()", "reading what is incomplete": "GO FROM 1 OVER placed", "users": "GRANT ROLE USER TO x", "balance": "BALANCE DATA",
}
WRITES = ("INSERT VERTEX region(r_name) VALUES 1:(\"x\")", "GO FROM 1 OVER placed; DELETE VERTEX 1", "PROFILE DELETE VERTEX 1", "CREATE TAG t()", "REPAIR INFERENCE")


def refused(spark, sf_dir) -> DataFrame:
    """What the engine refuses, each in its own words, and statements that a reading session refuses."""
    found, db = [], None
    for name, text in REFUSED.items():
        if name != "reading what is incomplete":
            db = session(spark, sf_dir, derived_budget=3)
        try:
            db.execute(text).take(1)
            found.append((name, False))
        except QueryError:
            found.append((name, True))
    for k, text in enumerate(WRITES):
        try:
            session(spark, sf_dir).execute(text, read_only=True)
            found.append((f"writing {k}", False))
        except QueryError:
            found.append((f"writing {k}", True))
    return spark.createDataFrame(found, "what string, refused boolean")


register("refused_statements", refused, "SELECT what, true AS refused FROM (VALUES " + ", ".join(f"('{n}')" for n in [*REFUSED, *(f"writing {k}" for k in range(len(WRITES)))]) + ") t(what)")

__all__ = ["ORACLES", "QUERIES"]
