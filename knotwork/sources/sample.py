"""A property graph over the relational and event tables of one folder.

A vertex id is kind * 10**9 + key. Frames are made only when a query asks for them, so a query reads the tables it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.operators.temporal import FOREVER
from knotwork.sources.graph import ClassDef, EdgeDef, FieldDef, Space, TagDef

KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order_": 6, "account": 7, "item": 8, "doc": 9}
TAGS = {
    "region": "r_name STRING",
    "nation": "n_name STRING",
    "customer": "c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_name STRING, s_acctbal DOUBLE",
    "part": "p_name STRING, p_brand STRING, p_type STRING, p_size INT64, p_retailprice DOUBLE",
    "order_": "o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
    "account": "n_events INT64",
    "item": "embedding VECTOR, label INT64",
    "doc": "lang STRING, source STRING, n_chars INT64",
}
EDGES = {
    "in_region": "", "cust_in": "", "supp_in": "", "placed": "o_orderdate TIMESTAMP, o_totalprice DOUBLE", "contains": "qty DOUBLE, price DOUBLE, discount DOUBLE, returnflag STRING",
    "supplied_by": "qty DOUBLE", "supplies": "n_lines INT64",
}


def fields(text: str) -> list[FieldDef]:
    return [FieldDef(*f.split()) for f in text.split(", ") if f]


def vid(kind: str, key: str):
    return (F.lit(KINDS[kind] * 10**9).cast("long") + F.col(key).cast("long")).cast("long")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def sample_space(spark: SparkSession, sf_dir: str) -> Space:
    read: Callable[[str], DataFrame] = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    space = Space("sample", spark)
    space.tags = {t: TagDef(t, fields(f)) for t, f in TAGS.items()}
    space.edges = {e: EdgeDef(e, fields(f)) for e, f in EDGES.items()}
    space.spans = {t: (k * 10**9, (k + 1) * 10**9 - 1) for t, k in KINDS.items()}

    def tag(name: str, table: str, key: str, **renamed):
        def made() -> DataFrame:
            own = [renamed.get(f.name, F.col(f.name)).cast(f.stored).alias(f.name) for f in space.tags[name].fields]
            return read(table).select(vid(name, key).alias("vid"), *own)

        space.tag_frames[name] = made

    tag("region", "region", "r_regionkey")
    tag("nation", "nation", "n_nationkey")
    tag("customer", "customer", "c_custkey")
    tag("supplier", "supplier", "s_suppkey")
    tag("part", "part", "p_partkey")
    tag("order_", "orders", "o_orderkey", o_orderdate=micros("o_orderdate"))
    tag("item", "embeddings", "vec_id")
    tag("doc", "documents", "doc_id")
    space.tag_frames["account"] = lambda: read("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events")).select(vid("account", "user_id").alias("vid"), "n_events")

    def edge(name: str, make: Callable[[], DataFrame]):
        def made() -> DataFrame:
            frame = make()
            rank = F.col("rank").cast("long") if "rank" in frame.columns else F.lit(0).cast("long")
            return frame.select("src", "dst", rank.alias("rank"), F.lit(False).alias("inferred"), *[F.col(f.name).cast(f.stored).alias(f.name) for f in space.edges[name].fields])

        space.edge_frames[name] = made

    edge("in_region", lambda: read("nation").select(vid("nation", "n_nationkey").alias("src"), vid("region", "n_regionkey").alias("dst")))
    edge("cust_in", lambda: read("customer").select(vid("customer", "c_custkey").alias("src"), vid("nation", "c_nationkey").alias("dst")))
    edge("supp_in", lambda: read("supplier").select(vid("supplier", "s_suppkey").alias("src"), vid("nation", "s_nationkey").alias("dst")))
    edge("placed", lambda: read("orders").select(vid("customer", "o_custkey").alias("src"), vid("order_", "o_orderkey").alias("dst"), micros("o_orderdate").alias("o_orderdate"), "o_totalprice"))
    # lines of one order and part differ by rank: their place in the order of all their columns
    line = ["l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    place = lambda *keys, order=line: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    edge("contains", lambda: read("lineitem").select(vid("order_", "l_orderkey").alias("src"), vid("part", "l_partkey").alias("dst"), place("l_orderkey", "l_partkey").alias("rank"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag")))
    by_supplier = ["l_linenumber", "l_partkey", *line[2:]]
    edge("supplied_by", lambda: read("lineitem").select(vid("order_", "l_orderkey").alias("src"), vid("supplier", "l_suppkey").alias("dst"), place("l_orderkey", "l_suppkey", order=by_supplier).alias("rank"), F.col("l_quantity").alias("qty")))
    edge("supplies", lambda: read("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n_lines")).select(vid("supplier", "l_suppkey").alias("src"), vid("part", "l_partkey").alias("dst"), "n_lines"))
    space.tag_history["account"] = lambda: read("events").select(vid("account", "user_id").alias("vid"), F.col("event_id").alias("n_events"), "event_type", micros("ts").alias("valid_from"), F.lit(FOREVER).cast("long").alias("valid_to"), micros("ts").alias("tx"), (F.col("event_type") == "error").alias("deleted"))
    space.edge_history["placed"] = lambda: read("orders").select(vid("customer", "o_custkey").alias("src"), vid("order_", "o_orderkey").alias("dst"), F.lit(0).cast("long").alias("rank"), micros("o_orderdate").alias("o_orderdate"), "o_totalprice", micros("o_orderdate").alias("valid_from"), F.lit(FOREVER).cast("long").alias("valid_to"), micros("o_orderdate").alias("tx"), F.lit(False).alias("deleted"))
    return space


def tagged_space(spark: SparkSession, sf_dir: str) -> Space:
    """The sample graph with a second tag on rich customers and edges from vectors to their labels."""
    space = sample_space(spark, sf_dir)
    space.tags["vip"] = TagDef("vip", fields("tier INT64"))
    space.tag_frames["vip"] = lambda: space.tag("customer").filter("c_acctbal > 5000").select("vid", F.floor(F.col("c_acctbal") / 1000).cast("long").alias("tier"))
    space.spans["vip"] = space.spans["customer"]
    space.edges["labelled"] = EdgeDef("labelled", [])
    space.edge_frames["labelled"] = lambda: space.tag("item").filter("label is not null").select(F.col("vid").alias("src"), (F.lit(10**10) + F.col("label")).alias("dst"), F.lit(0).cast("long").alias("rank"), F.lit(False).alias("inferred"))
    return space


def semantic_space(spark: SparkSession, sf_dir: str) -> Space:
    """The sample graph with rules: places nest, neighbours of a nation's customers are symmetric, and classes."""
    space = sample_space(spark, sf_dir)
    space.edges["located_in"] = EdgeDef("located_in", [], transitive=True)
    for e in ("in_region", "cust_in", "supp_in"):
        space.edges[e].sub = ("located_in",)
    space.edges["has_customer"] = EdgeDef("has_customer", [], inverse="cust_in")
    space.edges["based_in"] = EdgeDef("based_in", [], equivalent=("supp_in",))
    space.edges["partner"] = EdgeDef("partner", [], symmetric=True)
    space.edges["home_region"] = EdgeDef("home_region", [], chain=("cust_in", "in_region"))
    space.edges["placed"].domain, space.edges["placed"].range = "buyer", "deal"
    space.edge_frames["partner"] = lambda: spark.read.parquet(f"{sf_dir}/nation.parquet").select(vid("nation", "n_nationkey").alias("src"), (F.lit(2 * 10**9) + (F.col("n_nationkey").cast("long") + 1) % 25).cast("long").alias("dst"), F.lit(0).cast("long").alias("rank"), F.lit(False).alias("inferred"))
    space.classes = {c.name: c for c in (ClassDef("party"), ClassDef("customer", ("party",)), ClassDef("supplier", ("party",)), ClassDef("buyer", ("party",)), ClassDef("deal", (), (), ("party",)), ClassDef("big", (), (), ("customer",)))}
    return space
