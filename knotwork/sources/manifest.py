"""A space's declarations as JSON, and back: what backups and stored spaces keep beside their tables."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from knotwork.errors import QueryError
from knotwork.operators.temporal import known
from knotwork.plans import syntax
from knotwork.sources.graph import ClassDef, EdgeDef, FieldDef, IndexDef, ShapeDef, Space, TagDef

PLAIN = ("name", "vid_type", "vid_length", "partition_num", "replica_factor", "partition_by", "dirty")


def packed(x):
    """Expressions, tuples and plain values as JSON can hold them."""
    if is_dataclass(x):
        return {"node": type(x).__name__, "of": {f.name: packed(getattr(x, f.name)) for f in fields(x)}}
    if isinstance(x, tuple | list):
        return {"tuple" if isinstance(x, tuple) else "list": [packed(v) for v in x]}
    return x


def unpacked(x):
    if not isinstance(x, dict):
        return x
    if "node" in x:
        kind = getattr(syntax, x["node"], None)
        if not is_dataclass(kind):
            raise QueryError(f"{x['node']} is no expression")
        return kind(**{k: unpacked(v) for k, v in x["of"].items()})
    return tuple(map(unpacked, x["tuple"])) if "tuple" in x else [unpacked(v) for v in x["list"]]


def declared(space: Space) -> dict:
    """Everything of a space but its tables."""
    return {
        **{n: getattr(space, n) for n in PLAIN}, "boundaries": list(space.boundaries),
        "tags": [asdict(x) for x in space.tags.values()], "edges": [asdict(x) for x in space.edges.values()],
        "classes": [asdict(x) for x in space.classes.values()], "indexes": [asdict(x) for x in space.indexes.values()],
        "shapes": [{"name": x.name, "on": x.on, "rules": packed(tuple(x.rules))} for x in space.shapes.values()],
    }


def undeclared(spark: SparkSession, m: dict) -> Space:
    """A space of these declarations, without tables."""
    space = Space(m["name"], spark, **{n: m[n] for n in PLAIN if n != "name"}, boundaries=tuple(m["boundaries"]))
    own = lambda d: {**d, "fields": [FieldDef(**f) for f in d["fields"]]}
    space.tags = {d["name"]: TagDef(**own(d)) for d in m["tags"]}
    space.edges = {d["name"]: EdgeDef(**own({**d, "sub": tuple(d["sub"]), "equivalent": tuple(d["equivalent"]), "chain": tuple(d["chain"]) if d["chain"] else None})) for d in m["edges"]}
    space.classes = {d["name"]: ClassDef(d["name"], tuple(d["parents"]), tuple(d["equivalent"]), tuple(d["disjoint"])) for d in m["classes"]}
    space.indexes = {d["name"]: IndexDef(d["name"], d["kind"], d["on"], tuple(d["fields"])) for d in m["indexes"]}
    space.shapes = {d["name"]: ShapeDef(d["name"], d["on"], unpacked(d["rules"])) for d in m["shapes"]}
    return space


def tables(space: Space) -> dict[str, DataFrame]:
    """All tables of a space by name: tags, edges as asserted, derived edges, histories, identities, types and proofs."""
    found = {f"tag/{t}": space.tag(t) for t in space.tags} | {f"edge/{e}": space.asserted(e) for e in space.edges}
    found |= {f"derived/{e}": df for e, df in space.derived.items()}
    for kind, group in (("tag", space.tag_history), ("edge", space.edge_history)):
        found |= {f"history/{kind}/{n}": known(h) for n, h in group.items()}
    return found | {n: getattr(space, n) for n in ("same", "inferred_types", "provenance") if getattr(space, n) is not None}


def put_table(space: Space, name: str, df: DataFrame) -> None:
    """The inverse of tables(), for one of them."""
    kind, _, rest = name.partition("/")
    if kind == "history":
        of, _, n = rest.partition("/")
        (space.tag_history if of == "tag" else space.edge_history)[n] = df
    elif rest:
        {"tag": space.tag_frames, "edge": space.edge_frames, "derived": space.derived}[kind][rest] = df
    else:
        setattr(space, kind, df)


def write_json(spark: SparkSession, found: dict, folder: str) -> None:
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def read_json(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(folder).first()["value"])


def read_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(folder)
