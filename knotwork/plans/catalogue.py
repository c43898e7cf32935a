"""The graph engine's registered queries, each with DuckDB SQL over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import closure, identity, schema, validation
from knotwork.operators.mutation import delete_vertices, insert_vertices, update
from knotwork.operators.paths import weighted
from knotwork.plans.parser import parse
from knotwork.session import Session
from knotwork.sources.graph import ShapeDef
from knotwork.sources.sample import sample_space, semantic_space, tagged_space

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def v(kind: int, key: str) -> str:
    return f"({kind}000000000::BIGINT + {key}::BIGINT)"


EDGES = f"""
in_region AS (SELECT {v(2, 'n_nationkey')} AS src, {v(1, 'n_regionkey')} AS dst FROM nation),
cust_in AS (SELECT {v(3, 'c_custkey')} AS src, {v(2, 'c_nationkey')} AS dst FROM customer),
supp_in AS (SELECT {v(4, 's_suppkey')} AS src, {v(2, 's_nationkey')} AS dst FROM supplier),
placed AS (SELECT {v(3, 'o_custkey')} AS src, {v(6, 'o_orderkey')} AS dst, epoch_us(o_orderdate) AS o_orderdate, o_totalprice FROM orders),
contains AS (SELECT {v(6, 'l_orderkey')} AS src, {v(5, 'l_partkey')} AS dst, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS rank, l_quantity AS qty, l_extendedprice AS price, l_discount AS discount, l_returnflag AS returnflag FROM lineitem),
supplied_by AS (SELECT {v(6, 'l_orderkey')} AS src, {v(4, 'l_suppkey')} AS dst, l_quantity AS qty FROM lineitem),
supplies AS (SELECT {v(4, 'l_suppkey')} AS src, {v(5, 'l_partkey')} AS dst, count(*) AS n_lines FROM lineitem GROUP BY ALL),
places AS (SELECT src, dst FROM in_region UNION ALL SELECT src, dst FROM cust_in UNION ALL SELECT src, dst FROM supp_in)
"""


def add(name: str, text: str, sql: str, then: Callable[[DataFrame], DataFrame] = lambda df: df, space=sample_space) -> None:
    """Registers a query of the language; `then` only rounds or renames its columns."""
    QUERIES[name] = lambda spark, sf_dir: then(Session(spark, {"sample": space(spark, sf_dir)}).execute(text))
    ORACLES[name] = sql if sql.lstrip().upper().startswith("WITH RECURSIVE") else f"WITH {EDGES} {sql}"


def plain_names(df: DataFrame) -> DataFrame:
    """df with display names such as a.b and f(x) written with underscores."""
    return df.toDF(*[re.sub(r"\W+", "_", c).strip("_") for c in df.columns])


def rounded(*columns: str):
    return lambda df: df.withColumns({c: F.round(c, 4) for c in columns})


FLAGSHIP = """MATCH (c:customer)-[:cust_in]->(n:nation) WHERE c.customer.c_acctbal > 0
RETURN n.nation.n_name AS name, COUNT(*) AS cnt, AVG(c.customer.c_acctbal) AS avg_bal ORDER BY cnt DESC, name LIMIT 10"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["match_flagship"](spark, sf_dir)


# --- MATCH ----------------------------------------------------------------------------------------------------------

add("match_flagship", FLAGSHIP, "SELECT n_name AS name, count(*) AS cnt, round(avg(c_acctbal), 4) AS avg_bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name ORDER BY cnt DESC, name LIMIT 10", rounded("avg_bal"))
add("match_node_filter", "MATCH (p:part) WHERE p.part.p_size > 30 AND p.part.p_retailprice < 1500 RETURN id(p) AS vid, p.part.p_name AS name", f"SELECT {v(5, 'p_partkey')} AS vid, p_name AS name FROM part WHERE p_size > 30 AND p_retailprice < 1500")
add("match_prop_map", 'MATCH (c:customer {c_mktsegment: "BUILDING"}) RETURN id(c) AS vid, c.c_name AS name', f"SELECT {v(3, 'c_custkey')} AS vid, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
add("match_label_any", "MATCH (x:customer|supplier) RETURN id(x) AS vid", f"SELECT {v(3, 'c_custkey')} AS vid FROM customer UNION SELECT {v(4, 's_suppkey')} FROM supplier")
add("match_label_all", "MATCH (x:customer:vip) RETURN id(x) AS vid, x.vip.tier AS tier, x.c_name AS name", f"SELECT {v(3, 'c_custkey')} AS vid, floor(c_acctbal / 1000)::BIGINT AS tier, c_name AS name FROM customer WHERE c_acctbal > 5000", space=tagged_space)
add("match_one_hop", "MATCH (c:customer)-[:placed]->(o:order_) WHERE o.order_.o_totalprice > 100000 RETURN id(c) AS c, id(o) AS o, o.o_orderstatus AS status", f"SELECT {v(3, 'o_custkey')} AS c, {v(6, 'o_orderkey')} AS o, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000")
add("match_two_hop", "MATCH (c:customer)-[:cust_in]->(n:nation)-[:in_region]->(r:region) RETURN id(c) AS c, n.n_name AS nation, r.r_name AS region", f"SELECT {v(3, 'c_custkey')} AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("match_incoming", "MATCH (n:nation)<-[:supp_in]-(s:supplier) RETURN n.n_name AS nation, s.s_name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey")
add("match_undirected", "MATCH (n:nation)-[e:in_region|supp_in]-(x) RETURN id(n) AS n, id(x) AS x, src(e) AS s, dst(e) AS d", "SELECT src AS n, dst AS x, src AS s, dst AS d FROM in_region UNION ALL SELECT dst AS n, src AS x, src AS s, dst AS d FROM supp_in")
add("match_edge_alternation", "MATCH (x)-[e:cust_in|supp_in]->(n:nation) RETURN id(x) AS x, type(e) AS kind, n.n_name AS nation", f"SELECT src AS x, kind, n_name AS nation FROM (SELECT *, 'cust_in' AS kind FROM cust_in UNION ALL SELECT *, 'supp_in' FROM supp_in) e JOIN nation ON dst = {v(2, 'n_nationkey')}")
add("match_edge_props", 'MATCH (o:order_)-[e:contains {returnflag: "R"}]->(p:part) WHERE e.qty >= 45 RETURN id(o) AS o, id(p) AS p, e.price AS price', "SELECT src AS o, dst AS p, price FROM contains WHERE returnflag = 'R' AND qty >= 45")
add("match_rank_accessors", "MATCH (o:order_)-[e:contains]->(p:part) WHERE rank(e) > 0 RETURN src(e) AS s, dst(e) AS d, type(e) AS t, rank(e) AS r", "SELECT src AS s, dst AS d, 'contains' AS t, rank AS r FROM contains WHERE rank > 0")
add("match_multi_pattern", "MATCH (c:customer)-[:cust_in]->(n:nation), (s:supplier)-[:supp_in]->(n) WHERE c.c_acctbal > 9000 RETURN id(c) AS c, id(s) AS s, n.n_name AS nation", f"SELECT {v(3, 'c_custkey')} AS c, {v(4, 's_suppkey')} AS s, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > 9000")
add("match_optional", "MATCH (c:customer) OPTIONAL MATCH (c)-[e:placed]->(o:order_ {o_orderstatus: \"P\"}) RETURN id(c) AS c, coalesce(id(o), 0) AS o, e.o_totalprice AS price", f"SELECT {v(3, 'c_custkey')} AS c, coalesce({v(6, 'o_orderkey')}, 0) AS o, o_totalprice AS price FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
add("match_cyclic_var", "MATCH (c:customer)-[:placed]->(o:order_)-[:supplied_by]->(s:supplier)-[:supp_in]->(n:nation)<-[:cust_in]-(c) RETURN id(c) AS c, id(o) AS o, id(s) AS s", f"SELECT {v(3, 'c_custkey')} AS c, {v(6, 'o_orderkey')} AS o, {v(4, 's_suppkey')} AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey")
add("match_group_by", "MATCH (c:customer) RETURN c.c_mktsegment AS seg, COUNT(c) AS n, MIN(c.c_acctbal) AS low, MAX(c.c_acctbal) AS high GROUP BY c.c_mktsegment", "SELECT c_mktsegment AS seg, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1")
add("match_implicit_group", "MATCH (o:order_)-[e:contains]->(p:part) RETURN p.p_brand AS brand, SUM(e.qty) AS qty, AVG(e.price) AS price", f"SELECT p_brand AS brand, sum(qty) AS qty, round(avg(price), 4) AS price FROM contains JOIN part ON dst = {v(5, 'p_partkey')} GROUP BY 1", rounded("qty", "price"))
add("match_sum_empty_zero", "MATCH (p:part) WHERE p.p_size > 1000 RETURN SUM(p.p_size) AS total, COUNT(*) AS n, AVG(p.p_size) AS mean", "SELECT coalesce(sum(p_size), 0)::BIGINT AS total, count(*) AS n, avg(p_size) AS mean FROM part WHERE p_size > 1000")
add("match_min_max", "MATCH (o:order_) RETURN MIN(o.o_orderdate) AS first, MAX(o.o_orderdate) AS last, COUNT(*) AS n", "SELECT min(epoch_us(o_orderdate)) AS first, max(epoch_us(o_orderdate)) AS last, count(*) AS n FROM orders")
add("match_order_nulls", 'MATCH (c:customer) OPTIONAL MATCH (c)-[:placed]->(o:order_ {o_orderstatus: "P"}) RETURN id(c) AS c, o.o_totalprice AS o ORDER BY o DESC, c LIMIT 100', f"SELECT {v(3, 'c_custkey')} AS c, o_totalprice AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey ORDER BY o DESC NULLS FIRST, c LIMIT 100")
add("match_offset_limit", "MATCH (p:part) RETURN id(p) AS vid, p.p_name AS name ORDER BY vid LIMIT 20 OFFSET 30", f"SELECT {v(5, 'p_partkey')} AS vid, p_name AS name FROM part ORDER BY vid LIMIT 20 OFFSET 30")
add("match_string_ops", "MATCH (p:part) WHERE p.p_name CONTAINS 'in' AND p.p_brand STARTS WITH 'Brand#1' AND p.p_name ENDS WITH 'g' AND NOT (p.p_name STARTS WITH 'red') RETURN id(p) AS vid", f"SELECT {v(5, 'p_partkey')} AS vid FROM part WHERE contains(p_name, 'in') AND starts_with(p_brand, 'Brand#1') AND ends_with(p_name, 'g') AND NOT starts_with(p_name, 'red')")
add("match_string_calls", "MATCH (p:part) WHERE contains(p.p_name, 'ed') AND startsWith(p.p_brand, 'Brand#2') OR ends_with(p.p_name, 'widget') AND p.p_name NOT CONTAINS 'small' RETURN id(p) AS vid", f"SELECT {v(5, 'p_partkey')} AS vid FROM part WHERE contains(p_name, 'ed') AND starts_with(p_brand, 'Brand#2') OR ends_with(p_name, 'widget') AND NOT contains(p_name, 'small')")
add("match_display_names", "MATCH (n:nation)-[:in_region]->(r:region) RETURN n.nation.n_name, r.r_name, id(n)", f"SELECT n_name AS n_nation_n_name, r_name AS r_r_name, {v(2, 'n_nationkey')} AS value FROM nation JOIN region ON n_regionkey = r_regionkey", plain_names)
add("match_bare_limit", "MATCH (p:part) RETURN id(p) AS vid LIMIT 7", "SELECT 7::BIGINT AS n", lambda df: df.agg(F.count(F.lit(1)).alias("n")))
add("match_single_hop_range", "MATCH (n:nation)-[:in_region*2]->(r) RETURN id(n) AS n, id(r) AS r", "SELECT src AS n, dst AS r FROM in_region")
add("match_regex", "MATCH (c:customer) WHERE c.c_name =~ '[0-9]*5[0-3]$' RETURN id(c) AS vid", f"SELECT {v(3, 'c_custkey')} AS vid FROM customer WHERE regexp_matches(c_name, '[0-9]*5[0-3]$')")
add("match_in_list", "MATCH (p:part) WHERE p.p_size IN [1, 5, 9, NULL] RETURN id(p) AS vid, p.p_size AS size", f"SELECT {v(5, 'p_partkey')} AS vid, p_size::BIGINT AS size FROM part WHERE p_size IN (1, 5, 9)")
add("match_functions", "MATCH (c:customer) RETURN id(c) AS vid, toUpper(c.c_name) AS up, length(c.c_mktsegment) AS len, round(c.c_acctbal) AS r, floor(c.c_acctbal) AS f, ceil(c.c_acctbal) AS ce, abs(c.c_acctbal) AS a, coalesce(c.nothing, c.c_name) AS co", f"SELECT {v(3, 'c_custkey')} AS vid, upper(c_name) AS up, strlen(c_mktsegment) AS len, round(c_acctbal)::BIGINT AS r, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS ce, abs(c_acctbal) AS a, c_name AS co FROM customer")
add("match_null_compare", 'MATCH (c:customer) OPTIONAL MATCH (c)-[:placed]->(o:order_ {o_orderstatus: "P"}) WHERE o.o_totalprice != NULL OR o.o_orderstatus == NULL OR o.o_totalprice NOT IN [1] RETURN id(c) AS c, is_null(o.o_totalprice) AS none', f"SELECT {v(3, 'c_custkey')} AS c, o_totalprice IS NULL AS none FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
add("match_id_filter", "MATCH (c:customer)-[:cust_in]->(n:nation) WHERE id(n) == 2000000003 RETURN id(c) AS c", "SELECT src AS c FROM cust_in WHERE dst = 2000000003")
add("match_no_return", "MATCH (s:supplier)-[:supp_in]->(n:nation)", "SELECT src AS s, dst AS n FROM supp_in")
add("match_tags_properties", "MATCH (n:nation) RETURN id(n) AS vid, tags(n) AS t, properties(n) AS p", f"SELECT {v(2, 'n_nationkey')} AS vid, 'nation' AS t, n_name AS p FROM nation", lambda df: df.withColumns({"t": F.array_join("t", ","), "p": F.col("p")["n_name"]}))

# --- variable length ------------------------------------------------------------------------------------------------

WALK = "WITH RECURSIVE {edges}, w(a, b, path) AS (SELECT {start}, dst, [src, dst] FROM {e} WHERE {cond} AND src <> dst UNION ALL SELECT a, dst, list_append(path, dst) FROM w JOIN {e} ON b = src WHERE len(path) <= {high} AND NOT list_contains(path, dst)) "
add("varlen_1_3", "MATCH (c:customer)-[:cust_in|in_region*1..3]->(x) RETURN id(c) AS c, id(x) AS x", WALK.format(edges=EDGES, start="src", e="places", cond=f"src BETWEEN {v(3, '0')} AND {v(3, '999999999')}", high=3) + "SELECT DISTINCT a AS c, b AS x FROM w")
add("varlen_2_3", "MATCH (n:nation {n_name: \"NATION_3\"})-[:cust_in|in_region*2..3]-(x) RETURN id(n) AS n, id(x) AS x", f"WITH RECURSIVE {EDGES}, both_ways AS (SELECT src, dst FROM cust_in UNION ALL SELECT dst, src FROM cust_in UNION ALL SELECT src, dst FROM in_region UNION ALL SELECT dst, src FROM in_region), w(a, b, path) AS (SELECT src, dst, [src, dst] FROM both_ways JOIN nation ON src = {v(2, 'n_nationkey')} WHERE n_name = 'NATION_3' UNION ALL SELECT a, dst, list_append(path, dst) FROM w JOIN both_ways ON b = src WHERE len(path) <= 3 AND NOT list_contains(path, dst)) SELECT DISTINCT a AS n, b AS x FROM w WHERE len(path) >= 3")

# --- GO -------------------------------------------------------------------------------------------------------------

add("go_1", "GO FROM 3000000001, 3000000002, 3000000001 OVER placed", "SELECT src, dst FROM placed WHERE src IN (3000000001, 3000000002) UNION ALL SELECT src, dst FROM placed WHERE src = 3000000001")
add("go_2", "GO 2 STEPS FROM 3000000001, 3000000007 OVER placed, contains YIELD dst(edge) AS part, contains.qty AS qty, rank(edge) AS r", "SELECT dst AS part, qty, rank AS r FROM (SELECT c.*, p.src AS start, row_number() OVER (PARTITION BY p.src, c.dst, c.rank ORDER BY c.src) AS n FROM placed p JOIN contains c ON c.src = p.dst WHERE p.src IN (3000000001, 3000000007)) WHERE n = 1")
add("go_range_1_3", "GO 1..3 STEPS FROM 3000000005 OVER placed, supplied_by, supp_in", "SELECT 3000000005 AS src, dst FROM (SELECT dst FROM placed WHERE src = 3000000005 UNION ALL SELECT dst FROM (SELECT DISTINCT s.dst, row_number() OVER (PARTITION BY s.src, s.dst) AS n FROM placed p JOIN supplied_by s ON s.src = p.dst WHERE p.src = 3000000005) UNION ALL SELECT DISTINCT n.dst FROM placed p JOIN supplied_by s ON s.src = p.dst JOIN supp_in n ON n.src = s.dst WHERE p.src = 3000000005)")
add("go_reversely", "GO FROM 2000000004 OVER supp_in, cust_in REVERSELY YIELD src(edge) AS who, type(edge) AS kind", "SELECT src AS who, 'supp_in' AS kind FROM supp_in WHERE dst = 2000000004 UNION ALL SELECT src, 'cust_in' FROM cust_in WHERE dst = 2000000004")
add("go_bidirect", "GO FROM 2000000004 OVER supp_in, in_region BIDIRECT YIELD dst AS other, edge AS e", "SELECT src AS other, src::VARCHAR || '>' || dst AS e FROM supp_in WHERE dst = 2000000004 UNION ALL SELECT dst, src::VARCHAR || '>' || dst FROM in_region WHERE src = 2000000004", lambda df: df.withColumn("e", F.concat_ws(">", F.get_json_object("e", "$.src"), F.get_json_object("e", "$.dst"))))
add("go_where", "GO FROM 3000000001, 3000000002 OVER placed WHERE placed.o_totalprice / 2 + 1 > 50000 YIELD dst AS o, placed.o_totalprice AS price", "SELECT dst AS o, o_totalprice AS price FROM placed WHERE src IN (3000000001, 3000000002) AND o_totalprice / 2 + 1 > 50000")
add("go_dst_props", "GO FROM 3000000001, 3000000002 OVER placed YIELD dst AS o, $$.order_.o_orderpriority AS priority", f"SELECT {v(6, 'o_orderkey')} AS o, o_orderpriority AS priority FROM orders WHERE o_custkey IN (1, 2)")
add("go_zero_min", "GO 0..1 STEPS FROM 3000000001 OVER cust_in", "SELECT 3000000001::BIGINT AS src, 3000000001::BIGINT AS dst UNION ALL SELECT src, dst FROM cust_in WHERE src = 3000000001")
add("go_compound_var", "$a = GO FROM 2000000004 OVER supp_in REVERSELY YIELD src(edge) AS vid; GO FROM $a.vid OVER supplies YIELD src AS s, dst AS p, supplies.n_lines AS n", "SELECT s.src AS s, s.dst AS p, n_lines AS n FROM supp_in i JOIN supplies s ON s.src = i.src WHERE i.dst = 2000000004")

add("go_display_names", "GO FROM 3000000001, 3000000002 OVER placed YIELD placed.o_totalprice, $$.order_.o_orderpriority, type(edge)", f"SELECT o_totalprice AS placed_o_totalprice, o_orderpriority AS order__o_orderpriority, 'placed' AS type_edge FROM orders WHERE o_custkey IN (1, 2)", plain_names)
add("go_arithmetic", "GO FROM 4000000001 OVER supplies WHERE supplies.n_lines % 2 == 1 AND -supplies.n_lines < 0 YIELD dst AS p, supplies.n_lines AS n", "SELECT dst AS p, n_lines AS n FROM supplies WHERE src = 4000000001 AND n_lines % 2 = 1 AND -n_lines < 0")
# --- LOOKUP and FETCH -----------------------------------------------------------------------------------------------

bare = lambda column: lambda df: df.select(F.col(f"`{column}`").alias("vid"))
add("lookup_eq", 'LOOKUP ON customer WHERE customer.c_mktsegment == "MACHINERY"', f"SELECT {v(3, 'c_custkey')} AS vid FROM customer WHERE c_mktsegment = 'MACHINERY'", bare("customer.vid"))
add("lookup_range", "LOOKUP ON part WHERE part.p_size >= 10 AND part.p_size < 12", f"SELECT {v(5, 'p_partkey')} AS vid FROM part WHERE p_size >= 10 AND p_size < 12", bare("part.vid"))
add("lookup_and_or_not", 'LOOKUP ON order_ WHERE (o_orderstatus == "F" OR o_totalprice > 400000.0) AND NOT (o_totalprice < 200000.0)', f"SELECT {v(6, 'o_orderkey')} AS vid FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND NOT o_totalprice < 200000", bare("order_.vid"))
add("lookup_in", "LOOKUP ON part WHERE p_size IN [3, 4] AND p_size != 4.0", f"SELECT {v(5, 'p_partkey')} AS vid FROM part WHERE p_size IN (3, 4)", bare("part.vid"))
add("lookup_edge", "LOOKUP ON EDGE contains WHERE contains.qty == 50.0 AND discount >= 0.05", "SELECT src, dst, rank FROM contains WHERE qty = 50 AND discount >= 0.05", lambda df: df.toDF("src", "dst", "rank"))
add("lookup_json", "LOOKUP ON nation WHERE n_name != 'x'", f"SELECT {v(2, 'n_nationkey')} AS vid, n_name AS name FROM nation", lambda df: df.select(F.col("`nation.vid`").alias("vid"), F.get_json_object("`nation.*`", "$.tags[0].props.n_name").alias("name")))
add("fetch_tag", "FETCH PROP ON nation, region 2000000001, 1000000002, 3000000001", f"SELECT {v(2, 'n_nationkey')} AS vid, n_name AS n, NULL::VARCHAR AS r FROM nation WHERE n_nationkey = 1 UNION ALL SELECT {v(1, 'r_regionkey')}, NULL, r_name FROM region WHERE r_regionkey = 2", lambda df: df.select(F.col("VertexID").alias("vid"), F.get_json_object("nation", "$.n_name").alias("n"), F.get_json_object("region", "$.r_name").alias("r")))
add("fetch_as_of", "FETCH PROP ON account 7000000001, 7000000002, 7000000003, 7000000004, 7000000005 AS OF 1705276800000000", f"SELECT {v(7, 'user_id')} AS vid, event_id AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE epoch_us(ts) <= 1705276800000000 AND user_id BETWEEN 1 AND 5) WHERE n = 1 AND event_type <> 'error'", lambda df: df.select(F.col("VertexID").alias("vid"), F.get_json_object("account", "$.n_events").cast("long").alias("e")))


def refs(spark, sf_dir, low: int, high: int) -> str:
    """Edge references of the lines of some orders, as text of the language."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(f"l_orderkey between {low} and {high}").select("l_orderkey", "l_partkey").distinct().orderBy("l_orderkey", "l_partkey").collect()
    return ", ".join(f"{6000000000 + o}->{5000000000 + p}" for o, p in rows)


def fetch_edges(suffix: str):
    def run(spark, sf_dir):
        named = refs(spark, sf_dir, 1, 20)
        text = ", ".join(r + suffix for r in named.split(", "))
        return Session(spark, {"sample": sample_space(spark, sf_dir)}).execute(f"FETCH PROP ON contains {text}").select("src", "dst", "rank", F.get_json_object("properties", "$.qty").cast("double").alias("qty"))

    return run


QUERIES["fetch_edge_ranks"] = fetch_edges("")
ORACLES["fetch_edge_ranks"] = f"WITH {EDGES} SELECT src, dst, rank, qty FROM contains WHERE src BETWEEN 6000000001 AND 6000000020"
QUERIES["fetch_edge_rank"] = fetch_edges("@0")
ORACLES["fetch_edge_rank"] = f"WITH {EDGES} SELECT src, dst, rank, qty FROM contains WHERE rank = 0 AND src BETWEEN 6000000001 AND 6000000020"


def fetch_edge_all_ranks(spark, sf_dir):
    """Edges of the pairs of order and part that have several lines, named without a rank."""
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_partkey").count().filter("count > 1").orderBy("l_orderkey", "l_partkey").limit(20).collect()
    text = ", ".join(f"{6000000000 + r['l_orderkey']}->{5000000000 + r['l_partkey']}" for r in pairs) or "6000000001->5000000001"
    return Session(spark, {"sample": sample_space(spark, sf_dir)}).execute(f"FETCH PROP ON contains {text}").select("src", "dst", "rank", F.get_json_object("properties", "$.price").cast("double").alias("price"))


QUERIES["fetch_edge_all_ranks"] = fetch_edge_all_ranks
ORACLES["fetch_edge_all_ranks"] = f"WITH {EDGES}, two AS (SELECT src, dst FROM contains GROUP BY src, dst HAVING count(*) > 1 ORDER BY src, dst LIMIT 20) SELECT c.src, c.dst, c.rank, c.price FROM contains c JOIN two ON c.src = two.src AND c.dst = two.dst"


def fetch_edge_as_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey between 1 and 40").select("o_custkey", "o_orderkey").collect()
    text = ", ".join(f"{3000000000 + c}->{6000000000 + o}" for c, o in rows)
    found = Session(spark, {"sample": sample_space(spark, sf_dir)}).execute(f"FETCH PROP ON placed {text} AS OF 852076800000000")
    return found.select("src", "dst", F.get_json_object("properties", "$.o_totalprice").cast("double").alias("price"))


QUERIES["fetch_edge_as_of"] = fetch_edge_as_of
ORACLES["fetch_edge_as_of"] = f"WITH {EDGES} SELECT src, dst, o_totalprice AS price FROM placed WHERE dst BETWEEN 6000000001 AND 6000000040 AND o_orderdate <= 852076800000000"

# --- FIND -----------------------------------------------------------------------------------------------------------

BFS = "WITH RECURSIVE {edges}, e AS (SELECT DISTINCT src, dst FROM ({e})), w(b, path) AS (SELECT 3000000001::BIGINT, [3000000001::BIGINT] UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN e ON b = src WHERE len(path) <= {most} AND NOT list_contains(path, dst)), t AS (SELECT path FROM w WHERE b = {target}) "
EVERY = " UNION ALL ".join(f"SELECT src, dst FROM {e}" for e in ("places", "placed", "contains", "supplied_by", "supplies"))
joined = lambda df: df.select(F.array_join("path", "->").alias("path"))
add("find_shortest_len", "FIND SHORTEST PATH FROM 3000000001 TO 1000000000 OVER *", BFS.format(edges=EDGES, e=EVERY, most=4, target="1000000000") + "SELECT array_to_string(path, '->') AS path FROM t ORDER BY len(path), path LIMIT 1", joined)


def find(text: str, ends: Callable):
    """FIND between two ids that `ends` takes from the tables."""

    def run(spark, sf_dir):
        source, target = ends(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        return joined(Session(spark, {"sample": sample_space(spark, sf_dir)}).execute(text.format(source, target)))

    return run


def compatriots(read) -> tuple[int, int]:
    """The first two customers of the first nation that has two."""
    c = read("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("a")).filter("n > 1").orderBy("c_nationkey").limit(1)
    first = c.first()
    second = read("customer").filter((F.col("c_nationkey") == first["c_nationkey"]) & (F.col("c_custkey") > first["a"])).agg(F.min("c_custkey")).first()[0]
    return 3 * 10**9 + first["a"], 3 * 10**9 + second


def supplier_region(read) -> tuple[int, int]:
    """The first supplier and its region."""
    s = read("supplier").orderBy("s_suppkey").first()
    n = read("nation").filter(F.col("n_nationkey") == s["s_nationkey"]).first()
    return 4 * 10**9 + s["s_suppkey"], 10**9 + n["n_regionkey"]


QUERIES["find_path_bidirect"] = find("FIND SHORTEST PATH FROM {} TO {} OVER cust_in BIDIRECT UPTO 4 STEPS", compatriots)
ORACLES["find_path_bidirect"] = f"WITH {EDGES}, two AS (SELECT src, dst, row_number() OVER (ORDER BY src) AS n FROM cust_in WHERE dst = (SELECT min(dst) FROM (SELECT dst FROM cust_in GROUP BY dst HAVING count(*) > 1))) SELECT concat_ws('->', a.src, a.dst, b.src) AS path FROM two a, two b WHERE a.n = 1 AND b.n = 2"
QUERIES["find_all_shortest"] = find("FIND ALL SHORTEST PATHS FROM {} TO {} OVER * UPTO 5 STEPS", supplier_region)
ORACLES["find_all_shortest"] = f"WITH {EDGES} SELECT concat_ws('->', s.src, s.dst, r.dst) AS path FROM supp_in s JOIN in_region r ON r.src = s.dst WHERE s.src = (SELECT min(src) FROM supp_in)"


QUERIES["find_path"] = find("FIND PATH FROM {} TO {} OVER * UPTO 5 STEPS", supplier_region)
ORACLES["find_path"] = ORACLES["find_all_shortest"]


def find_weighted(spark, sf_dir):
    space = sample_space(spark, sf_dir)
    target = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey = 2").first()["c_nationkey"]
    ((_, q),) = parse(f"FIND SHORTEST PATH FROM 3000000001 TO {2 * 10**9 + target} OVER * WEIGHT BY qty UPTO 3").clauses
    return weighted(space, q).select(F.round("cost", 4).alias("cost"))


QUERIES["find_weighted_cost"] = find_weighted
ORACLES["find_weighted_cost"] = f"WITH {EDGES} SELECT round(min(c), 4) AS cost FROM (SELECT 1 + s.qty + 1 AS c FROM placed p JOIN supplied_by s ON s.src = p.dst JOIN supp_in n ON n.src = s.dst WHERE p.src = 3000000001 AND n.dst = (SELECT dst FROM cust_in WHERE src = 3000000002) UNION ALL SELECT 1.0 FROM cust_in WHERE src = 3000000001 AND dst = (SELECT dst FROM cust_in WHERE src = 3000000002)) HAVING min(c) IS NOT NULL"

# --- RECOMMEND ------------------------------------------------------------------------------------------------------

JACCARD = "j AS (SELECT a.src AS vid, count(*) AS shared, count(*)::DOUBLE / ((SELECT count(*) FROM supplies x WHERE x.src = a.src) + (SELECT count(*) FROM supplies WHERE src = 4000000001) - count(*)) AS score FROM supplies a WHERE a.src <> 4000000001 AND a.dst IN (SELECT dst FROM supplies WHERE src = 4000000001) GROUP BY a.src)"
add("recommend_jaccard", "RECOMMEND SIMILAR TO 4000000001 OVER supplies LIMIT 20", f", {JACCARD} SELECT vid, round(score, 4) AS score, shared FROM j ORDER BY j.score DESC, shared DESC, vid LIMIT 20", rounded("score"))
COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[])"
add("recommend_embedding", "RECOMMEND SIMILAR TO 8000000003 BY EMBEDDING embedding LIMIT 15", f"SELECT {v(8, 'e.vec_id')} AS vid, round({COSINE}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) s WHERE e.vec_id <> 3 ORDER BY {COSINE} DESC, vid LIMIT 15", rounded("score"))
add("recommend_filter", "RECOMMEND SIMILAR TO 8000000003 BY EMBEDDING embedding WHERE label != seed.label LIMIT 15", f"SELECT {v(8, 'e.vec_id')} AS vid, round({COSINE}, 4) AS score FROM embeddings e, (SELECT embedding, label FROM embeddings WHERE vec_id = 3) s WHERE e.vec_id <> 3 AND e.label <> s.label ORDER BY {COSINE} DESC, vid LIMIT 15", rounded("score"))
add("recommend_blend", "RECOMMEND SIMILAR TO 4000000001 BLEND EMBEDDING embedding 0.3 OVER supplies 0.7 LIMIT 20", f", {JACCARD} SELECT vid, round(0.7 * score, 4) AS score, 0.0::DOUBLE AS emb, round(score, 4) AS struct FROM j ORDER BY j.score DESC, vid LIMIT 20", rounded("score", "emb", "struct"))
# --- rules ----------------------------------------------------------------------------------------------------------


def derived(name: str, sql: str, edge: str) -> None:
    """The closed edges of one type, as pairs with whether they are derived."""

    def run(spark, sf_dir):
        space = closure.materialize_rules(closure.only_rules(semantic_space(spark, sf_dir), (edge,)))
        return space.edge(edge).select("src", "dst", "inferred")

    QUERIES[name], ORACLES[name] = run, f"WITH {EDGES} {sql}"


derived("infer_symmetric", "SELECT src, dst, bool_and(inferred) AS inferred FROM (SELECT 2000000000::BIGINT + n_nationkey AS src, 2000000000::BIGINT + (n_nationkey + 1) % 25 AS dst, false AS inferred FROM nation UNION ALL SELECT 2000000000::BIGINT + (n_nationkey + 1) % 25, 2000000000::BIGINT + n_nationkey, true FROM nation) GROUP BY src, dst", "partner")
derived("infer_inverse", "SELECT dst AS src, src AS dst, true AS inferred FROM cust_in", "has_customer")
derived("infer_transitive", "SELECT DISTINCT src, dst, true AS inferred FROM (SELECT * FROM places UNION ALL SELECT a.src, b.dst FROM places a JOIN places b ON a.dst = b.src)", "located_in")
derived("infer_equivalent", "SELECT src, dst, true AS inferred FROM supp_in", "based_in")
derived("infer_chain", "SELECT DISTINCT a.src, b.dst, true AS inferred FROM cust_in a JOIN in_region b ON a.dst = b.src", "home_region")


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, f"WITH {EDGES} {sql}"


def provenance(spark, sf_dir):
    space = closure.materialize_rules(semantic_space(spark, sf_dir))
    return space.provenance.groupBy("rule", "p").agg(F.count(F.lit(1)).alias("n"))


register("infer_domain_range", lambda spark, sf_dir: closure.materialize_rules(closure.only_rules(semantic_space(spark, sf_dir), ("placed",))).inferred_types, "SELECT DISTINCT src AS vid, 'buyer' AS class FROM placed UNION SELECT DISTINCT dst, 'deal' FROM placed")
register(
    "infer_provenance", provenance,
    "SELECT rule, p, n FROM (SELECT 'subproperty' AS rule, 'located_in' AS p, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM places)) AS n UNION ALL SELECT 'symmetric', 'partner', 50 UNION ALL SELECT 'inverse', 'has_customer', (SELECT count(*) FROM cust_in) UNION ALL SELECT 'inverse', 'cust_in', (SELECT count(*) FROM cust_in) UNION ALL SELECT 'equivalent', 'based_in', (SELECT count(*) FROM supp_in) UNION ALL SELECT 'equivalent', 'supp_in', (SELECT count(*) FROM supp_in) UNION ALL SELECT 'chain', 'home_region', (SELECT count(*) FROM cust_in a JOIN in_region b ON a.dst = b.src) UNION ALL SELECT 'transitive', 'located_in', (SELECT count(*) FROM (SELECT DISTINCT a.src, a.dst AS x, b.dst FROM places a JOIN places b ON a.dst = b.src)))",
)


def why(spark, sf_dir):
    space = closure.materialize_rules(semantic_space(spark, sf_dir))
    return closure.explain_fact(space, 2000000001, 1000000001, "located_in").select("depth", "fact", "status", "rule")


register("why_fact", why, "SELECT depth, fact, status, rule FROM (SELECT 0 AS depth, src || ' -located_in-> ' || dst AS fact, 'inferred' AS status, 'subproperty' AS rule FROM in_region WHERE src = 2000000001 AND dst = 1000000001 UNION ALL SELECT 1, src || ' -in_region-> ' || dst, 'asserted', '—' FROM in_region WHERE src = 2000000001 AND dst = 1000000001 UNION ALL SELECT 0, '2000000001 -located_in-> 1000000001', 'not found', '—' WHERE NOT EXISTS (SELECT 1 FROM in_region WHERE src = 2000000001 AND dst = 1000000001))")
register("is_a_membership", lambda spark, sf_dir: Session(spark, {"sample": semantic_space(spark, sf_dir)}).execute('MATCH (x) WHERE is_a(x, "party") RETURN id(x) AS vid'), f"SELECT {v(3, 'c_custkey')} AS vid FROM customer UNION ALL SELECT {v(4, 's_suppkey')} FROM supplier")


def consistency(spark, sf_dir):
    space = semantic_space(spark, sf_dir)
    rich = space.tag("customer").filter("c_acctbal > 9500").select("vid")
    space.inferred_types = rich.select("vid", F.lit("big").alias("class")).unionByName(rich.select("vid", F.lit("deal").alias("class")))
    return validation.check_consistency(space)


register("check_consistency", consistency, f"SELECT {v(3, 'c_custkey')} AS vid, 'big' AS class_a, 'customer' AS class_b FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT {v(3, 'c_custkey')}, 'deal', 'party' FROM customer WHERE c_acctbal > 9500")


def shapes(spark, sf_dir):
    space = semantic_space(spark, sf_dir)
    ((_, q),) = parse("CREATE SHAPE s ON party (c_acctbal DOUBLE REQUIRED, c_acctbal CHECK c_acctbal >= 0)").clauses
    space.shapes["s"] = ShapeDef("s", "party", q.fields)
    return validation.check_shapes(space)


register("check_shape", shapes, f"SELECT {v(4, 's_suppkey')} AS vid, 's' AS shape, 'c_acctbal' AS property, 'REQUIRED' AS constraint FROM supplier UNION ALL SELECT {v(4, 's_suppkey')}, 's', 'c_acctbal', 'CHECK' FROM supplier UNION ALL SELECT {v(3, 'c_custkey')}, 's', 'c_acctbal', 'CHECK' FROM customer WHERE c_acctbal < 0")

# --- identity, changes, metadata ------------------------------------------------------------------------------------


def same_pairs(spark, sf_dir):
    """Customers of the same hundred of balance, chained to the next such customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(F.col("c_acctbal") / 100).alias("k"), (F.lit(3 * 10**9) + F.col("c_custkey")).cast("long").alias("b"))
    return c.join(c.groupBy("k").agg(F.min("b").alias("a")), "k").filter("a <> b").select("a", "b")


register("sameas_components", lambda spark, sf_dir: identity.representatives(same_pairs(spark, sf_dir)), f"SELECT vid, rep FROM (SELECT {v(3, 'c_custkey')} AS vid, min({v(3, 'c_custkey')}) OVER (PARTITION BY floor(c_acctbal / 100)) AS rep, count(*) OVER (PARTITION BY floor(c_acctbal / 100)) AS n FROM customer) WHERE n > 1")


def rewired(spark, sf_dir):
    space = identity.merge(sample_space(spark, sf_dir), same_pairs(spark, sf_dir))
    return space.edge("placed").groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(space.tag("customer").select(F.col("vid").alias("src"), "c_name"), "src")


register("sameas_rewire", rewired, f"SELECT rep AS src, count(*) AS n, any_value(c_name) AS c_name FROM (SELECT c_custkey, {v(3, 'first_value(c_custkey) OVER w')} AS rep, first_value(c_name) OVER w AS c_name FROM customer WINDOW w AS (PARTITION BY floor(c_acctbal / 100) ORDER BY c_custkey)) JOIN orders ON o_custkey = c_custkey GROUP BY rep")


def changed(apply, text: str, tag: str, *columns: str):
    def run(spark, sf_dir):
        ((_, q),) = parse(text).clauses
        made, _ = apply(sample_space(spark, sf_dir), q, 1)
        return made.tag(tag).select("vid", *columns)

    return run


register("insert_upsert", changed(insert_vertices, 'INSERT VERTEX nation(n_name) VALUES 2000000001:("one"), 2000000099:("new"), 2000000099:("newer")', "nation", "n_name"), f"SELECT {v(2, 'n_nationkey')} AS vid, CASE WHEN n_nationkey = 1 THEN 'one' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 2000000099, 'newer'")
register("update_when", changed(update, "UPDATE VERTEX ON part 5000000001 SET p_size = 99 WHEN p_size < 1000 AND p_retailprice > 0.0", "part", "p_size"), f"SELECT {v(5, 'p_partkey')} AS vid, CASE WHEN p_partkey = 1 AND p_size < 1000 AND p_retailprice > 0 THEN 99 ELSE p_size END::BIGINT AS p_size FROM part")
register("delete_vertex", changed(delete_vertices, "DELETE VERTEX 2000000001, 2000000002", "nation", "n_name"), f"SELECT {v(2, 'n_nationkey')} AS vid, n_name FROM nation WHERE n_nationkey NOT IN (1, 2)")
register(
    "show_stats", lambda spark, sf_dir: Session(spark, {"sample": sample_space(spark, sf_dir)}).execute("SHOW STATS"),
    "SELECT * FROM (SELECT 'Tag' AS Type, 'region' AS Name, (SELECT count(*) FROM region) AS Count UNION ALL SELECT 'Tag', 'nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'Tag', 'customer', (SELECT count(*) FROM customer) UNION ALL SELECT 'Tag', 'supplier', (SELECT count(*) FROM supplier) UNION ALL SELECT 'Tag', 'part', (SELECT count(*) FROM part) UNION ALL SELECT 'Tag', 'order_', (SELECT count(*) FROM orders) UNION ALL SELECT 'Tag', 'account', (SELECT count(DISTINCT user_id) FROM events) UNION ALL SELECT 'Tag', 'item', (SELECT count(*) FROM embeddings) UNION ALL SELECT 'Tag', 'doc', (SELECT count(*) FROM documents)"
    " UNION ALL SELECT 'Edge', 'in_region', (SELECT count(*) FROM nation) UNION ALL SELECT 'Edge', 'cust_in', (SELECT count(*) FROM customer) UNION ALL SELECT 'Edge', 'supp_in', (SELECT count(*) FROM supplier) UNION ALL SELECT 'Edge', 'placed', (SELECT count(*) FROM orders) UNION ALL SELECT 'Edge', 'contains', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'Edge', 'supplied_by', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'Edge', 'supplies', (SELECT count(*) FROM supplies)"
    " UNION ALL SELECT 'Total', 'vertices', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM documents)"
    " UNION ALL SELECT 'Total', 'edges', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM supplies))",
)
register("partition_modulo", lambda spark, sf_dir: schema.partition_of(sample_space(spark, sf_dir).tag("customer").select("vid"), 16, "MODULO").groupBy("part").agg(F.count(F.lit(1)).alias("n")), f"SELECT {v(3, 'c_custkey')} % 16 + 1 AS part, count(*) AS n FROM customer GROUP BY 1")
DEGREES = " UNION ALL ".join(f"SELECT '{e}' AS type, dst AS vid, count(*) AS degree FROM {e} GROUP BY dst" for e in ("in_region", "cust_in", "supp_in", "placed", "contains", "supplied_by", "supplies"))
register("degree_counts", lambda spark, sf_dir: schema.degrees(sample_space(spark, sf_dir)), DEGREES)
register("degree_counts_out", lambda spark, sf_dir: schema.degrees(sample_space(spark, sf_dir), "out"), DEGREES.replace("dst", "src"))
