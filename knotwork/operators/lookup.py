"""LOOKUP and FETCH: reads by predicate and by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions.expressions import Compiler, Mode, Typed, kind_of
from knotwork.operators.go import start_vids, vertex_json
from knotwork.operators.temporal import as_of
from knotwork.plans import syntax as s
from knotwork.sources.graph import Space, union_all


def field_names(frame: DataFrame, owner: str):
    """Fields, bare or qualified by the tag or type; any other owner is an error."""
    kinds = {f.name: kind_of(f.dataType) for f in frame.schema.fields}

    def known(e):
        if isinstance(e, s.Prop) and e.owner.lower() != owner.lower():
            raise QueryError(f"{e.owner} is not what is looked up")
        if isinstance(e, s.Prop | s.Name):
            # a property the schema does not have compares false
            return Typed(F.col(f"`{e.name}`"), kinds[e.name]) if e.name in kinds else Typed(F.lit(None), "missing")
        return None

    return known


def check_predicate(e) -> None:
    """Fields against literals, joined by AND, OR and NOT; all else is refused."""
    field, value = (s.Prop, s.Name), (s.Lit, s.ListOf)
    if isinstance(e, s.Bin) and e.op in ("AND", "OR"):
        check_predicate(e.left)
        check_predicate(e.right)
    elif isinstance(e, s.Un) and e.op == "NOT":
        check_predicate(e.arg)
    elif isinstance(e, s.Bin) and e.op in ("==", "!=", "<", "<=", ">", ">=") and (isinstance(e.left, field) and isinstance(e.right, s.Lit) or isinstance(e.right, field) and isinstance(e.left, s.Lit)):
        return
    elif isinstance(e, s.Bin) and e.op in ("IN", "NOT IN") and isinstance(e.left, field) and isinstance(e.right, value):
        return
    elif isinstance(e, s.Call) and e.name.lower() in ("is_null", "isnull", "is_not_null", "isnotnull") and len(e.args) == 1 and isinstance(e.args[0], field):
        return
    elif isinstance(e, s.Lit) and isinstance(e.value, bool):
        return
    else:
        raise QueryError("LOOKUP takes comparisons of a field with literals")


def run_lookup(space: Space, query: s.Lookup) -> DataFrame:
    tag = None if query.edge else space.tag_name(query.name)
    edge = next((n for n in space.edges if n.lower() == query.name.lower()), None)
    if tag is None and edge is None:
        raise QueryError(f"there is no tag or edge {query.name}")
    frame = space.tag(tag) if tag else space.edge(edge)
    if query.where is not None:
        check_predicate(query.where)
        frame = frame.filter(LookupCompiler(Mode.LOOKUP, field_names(frame, tag or edge)).filter(query.where))
    if tag:
        result = vertex_json(space, (tag, frame)).select(F.col("vid").alias(f"{tag}.vid"), F.col("vertex").alias(f"{tag}.*"))
    else:
        result = frame.select(*[F.col(c).alias(f"{edge}.{c}") for c in ("src", "dst", "rank")])
    if query.offset:
        result = result.offset(query.offset)
    return result if query.limit is None else result.limit(query.limit)


class LookupCompiler(Compiler):
    def compare(self, op, left, right):
        if "missing" in (left.kind, right.kind):
            return F.lit(False)
        return super().compare(op, left, right)


def run_fetch(space: Space, query: s.Fetch, variables: dict | None = None) -> DataFrame:
    return fetch_edges(space, query) if query.edge else fetch_vertices(space, query, variables)


def fetch_vertices(space: Space, query: s.Fetch, variables) -> DataFrame:
    """VertexID and one JSON column per tag, in the order asked for; ids without any of the tags give no row."""
    tags = list(space.tags) if query.names is None else [space.tag_name(n) or n for n in query.names]
    for t in tags:
        if t not in space.tags:
            raise QueryError(f"there is no tag {t}")
    wanted = space.representative(start_vids(space, query.refs, variables), "vid")
    for t in tags:
        frame = space.tag(t) if query.as_of is None else as_of(space, "tag", t, query.as_of)
        own = frame.select("vid", F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in space.tags[t].fields])).alias(f"_t_{t}"))
        wanted = wanted.join(own, "vid", "left")
    some = F.lit(False)
    for t in tags:
        some = some | F.col(f"_t_{t}").isNotNull()
    return wanted.filter(some).orderBy("pos").select(F.col("vid").alias("VertexID"), *[F.col(f"_t_{t}").alias(t) for t in tags])


def fetch_edges(space: Space, query: s.Fetch) -> DataFrame:
    """src, dst, rank and properties as JSON; a reference without a rank means every rank."""
    for n in query.names or ():
        if n not in space.edges:
            raise QueryError(f"there is no edge {n}")
    refs = space.spark.createDataFrame([(k, a, b, r) for k, (a, b, r) in enumerate(query.refs)], f"pos long, _a {space.vid_sql}, _b {space.vid_sql}, _rank long")
    frames = []
    for n in space.edge_names(query.names):
        frame = space.edge(n) if query.as_of is None else as_of(space, "edge", n, query.as_of)
        frames.append(frame.select("src", "dst", "rank", F.lit(n).alias("type"), F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in space.edges[n].fields])).alias("properties")) if space.edges[n].fields else frame.select("src", "dst", "rank", F.lit(n).alias("type"), F.lit("{}").alias("properties")))
    edges = union_all(frames)
    hit = (F.col("_a") == F.col("src")) & (F.col("_b") == F.col("dst")) & (F.col("_rank").isNull() | (F.col("_rank") == F.col("rank")))
    return refs.join(edges, hit).orderBy("pos", "type", "rank").select("src", "dst", "rank", "properties")
