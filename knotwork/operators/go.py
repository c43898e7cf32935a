"""GO: breadth-first traversal from each start.

A hop expands the vertices first reached by the hop before. Every edge met is a row, also one that leads back to a
visited vertex; of rows from one start that agree in end, type and rank the first hop's stays, and of one hop the one with
the smallest source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions.expressions import Compiler, Mode, Typed, kind_of
from knotwork.plans import syntax as s
from knotwork.sources.graph import Space, cut, union_all

MAX_STEPS = 20
MARKS = {"_src": "src", "_dst": "dst", "_type": "type", "_rank": "rank", "src_id": "src", "dst_id": "dst"}


def item_name(e) -> str:
    if isinstance(e, s.Name):
        return e.name
    if isinstance(e, s.Prop):
        return f"{e.owner}.{e.name}"
    if isinstance(e, s.DstProp):
        return f"{e.tag}.{e.name}"
    if isinstance(e, s.Call):
        return f"{e.name}({', '.join(item_name(a) for a in e.args)})"
    return str(e.value) if isinstance(e, s.Lit) else "value"


def oriented(space: Space, over, direction: str, columns) -> DataFrame:
    """(at, to, src, dst, rank, type, columns...): edges as they are walked."""
    edges = space.edges_of(over, columns)
    out = edges.withColumns({"at": F.col("src"), "to": F.col("dst")})
    if direction == "out":
        return out
    back = edges.withColumns({"at": F.col("dst"), "to": F.col("src")})
    return back if direction == "in" else out.unionByName(back)


def traverse(starts: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """(pos, start, to, src, dst, rank, type, ...): the rows of GO; starts are (pos, vid)."""
    frontier = starts.select("pos", F.col("vid").alias("start"), F.col("vid").alias("here"))
    visited, found = [frontier], []
    for hop in range(1, high + 1):
        met = frontier.join(edges, F.col("here") == F.col("at")).withColumn("hop", F.lit(hop))
        if hop >= low:
            found.append(met.drop("here", "at"))
        if hop == high:
            break
        new = met.select("pos", "start", F.col("to").alias("here")).distinct()
        # read by the next hop, by the visited test of all later ones and by this hop's rows: written once
        frontier = cut(new.join(union_all(visited), ["pos", "start", "here"], "left_anti"))
        if hop > 1 and frontier.isEmpty():
            break
        visited.append(frontier)
    rows = union_all(found)
    first = Window.partitionBy("pos", "to", "type", "rank").orderBy("hop", "src", "dst")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "hop")


def run_go(space: Space, query: s.Go, variables: dict | None = None) -> DataFrame:
    if query.high > MAX_STEPS:
        raise QueryError(f"GO takes at most {MAX_STEPS} steps")
    if query.low > query.high:
        raise QueryError("the steps run from few to many")
    starts = space.representative(start_vids(space, query.start, variables), "vid")
    exprs = [i.expr for i in query.items] + ([query.where] if query.where is not None else [])
    asked = {x.name for e in exprs for x in s.walk(e) if isinstance(x, s.Prop) and x.name not in MARKS}
    asked |= {x.name for x in s.walk(query.where) if isinstance(x, s.Name)} if query.where is not None else set()
    declared = {f.name for n in space.edge_names(query.over) for f in space.edges[n].fields}
    columns = sorted(asked & declared)
    edges = oriented(space, query.over, query.direction, [])
    if columns:
        edges = oriented(space, query.over, query.direction, columns).select("at", "to", "src", "dst", "rank", "type", *[F.col(f"`{c}`").alias(f"_p_{c}") for c in columns])
    low = max(query.low, 1)
    rows = traverse(starts, edges, low, query.high) if query.high >= 1 else traverse(starts, edges, 1, 1).limit(0)
    if query.low == 0:
        rows = rows.unionByName(starts.select("pos", F.col("vid").alias("start"), F.col("vid").alias("to")), allowMissingColumns=True)
    if query.where is not None:
        rows = rows.filter(Compiler(Mode.EVAL, condition_names(rows, query.over)).condition(query.where))
    if not query.items:
        return rows.select(F.col("start").alias("src"), F.col("to").alias("dst"))
    rows = with_destinations(space, rows, exprs)
    names = yield_names(space, rows)
    compiler = Compiler(Mode.EVAL, names)
    return rows.select(*[compiler(i.expr).col.alias(i.alias or item_name(i.expr)) for i in query.items])


def start_vids(space: Space, start, variables: dict | None) -> DataFrame:
    """(pos, vid) of a list of ids or of a variable's column; ids that repeat start once each time."""
    if isinstance(start, s.VarCol):
        frame = (variables or {}).get(start.var)
        if frame is None:
            raise QueryError(f"unknown variable: ${start.var}")
        if start.column not in frame.columns:
            raise QueryError(f"${start.var} has no column {start.column}")
        vids = frame.select(F.col(f"`{start.column}`").cast(space.vid_sql).alias("vid")).filter("vid is not null")
        # rows that repeat an id give the same rows again: positions only need to differ
        return vids.groupBy("vid").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("pos"), "vid").select(F.concat_ws(":", "vid", "pos").alias("pos"), "vid")
    return space.vids(start)


def condition_names(rows: DataFrame, over):
    kinds = {f.name: kind_of(f.dataType) for f in rows.schema.fields}

    def known(e):
        if isinstance(e, s.DstProp):
            raise QueryError("WHERE does not read destination properties")
        if isinstance(e, s.Prop) and e.name in MARKS:
            return Typed(F.col(MARKS[e.name]), kinds[MARKS[e.name]])
        if isinstance(e, s.Prop | s.Name) and f"_p_{e.name}" in kinds:
            return Typed(F.col(f"`_p_{e.name}`"), kinds[f"_p_{e.name}"])
        if isinstance(e, s.Call) and e.name.lower() in ("src", "dst", "type", "rank"):
            return Typed(F.col(e.name.lower()), kinds[e.name.lower()])
        return None

    return known


def with_destinations(space: Space, rows: DataFrame, exprs) -> DataFrame:
    """rows with the destination properties asked for, each tag joined once."""
    wanted: dict[str, set[str]] = {}
    for e in exprs:
        for x in s.walk(e):
            if isinstance(x, s.DstProp) and (t := space.tag_name(x.tag)) and any(f.name == x.name for f in space.tags[t].fields):
                wanted.setdefault(t, set()).add(x.name)
    for t, props in wanted.items():
        other = space.tag(t).select(F.col("vid").alias("_vid"), *[F.col(f"`{p}`").alias(f"_d_{t}_{p}") for p in sorted(props)])
        rows = rows.join(other, F.col("to") == F.col("_vid"), "left").drop("_vid")
    if any(isinstance(x, s.Name) and x.name == "vertex" for e in exprs for x in s.walk(e)):
        rows = rows.join(vertex_json(space).select(F.col("vid").alias("_vid"), "vertex"), F.col("to") == F.col("_vid"), "left").drop("_vid")
    return rows


def tag_part(space: Space, tag: str, frame: DataFrame) -> DataFrame:
    """(vid, part): a tag's rows as what vertex_json() puts together."""
    at = list(space.tags).index(tag)
    props = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in space.tags[tag].fields])) if space.tags[tag].fields else F.lit("{}")
    return frame.select("vid", F.struct(F.lit(at).alias("at"), F.lit(tag).alias("tag"), props.alias("props")).alias("part"))


def vertex_json(space: Space, own: tuple[str, DataFrame] | None = None) -> DataFrame:
    """(vid, vertex): all tags of each vertex as JSON.

    With own, a tag and rows of its frame, only of these vertices: other tags are joined where they may share a vertex
    with that one.
    """
    if own is None:
        parts = [tag_part(space, t, space.tag(t)) for t in space.tags]
    else:
        tag, frame = own
        parts = [tag_part(space, tag, frame)]
        parts += [tag_part(space, t, space.tag(t).join(frame.select("vid"), "vid", "left_semi")) for t in space.tags if t != tag and not space.apart(t, tag)]
    if not parts:
        return space.spark.createDataFrame([], f"vid {space.vid_sql}, vertex string")
    grouped = union_all(parts).groupBy("vid").agg(F.sort_array(F.collect_list("part")).alias("parts")) if len(parts) > 1 else parts[0].select("vid", F.array("part").alias("parts"))
    tags = F.array_join(F.transform("parts", lambda p: F.concat(F.lit('{"name":"'), p["tag"], F.lit('","props":'), p["props"], F.lit("}"))), ",")
    vid = F.col("vid").cast("string") if space.vid_type == "INT64" else F.concat(F.lit('"'), "vid", F.lit('"'))
    return grouped.select("vid", F.concat(F.lit('{"vid":'), vid, F.lit(',"tags":['), tags, F.lit("]}")).alias("vertex"))


def yield_names(space: Space, rows: DataFrame):
    kinds = {f.name: kind_of(f.dataType) for f in rows.schema.fields}
    null = Typed(F.lit(None), "null")

    def column(name: str) -> Typed:
        return Typed(F.col(f"`{name}`"), kinds[name]) if name in kinds else null

    def known(e):
        if isinstance(e, s.Lit):
            return None
        if isinstance(e, s.Name):
            if e.name in ("src", "_src_vid"):
                return column("start")
            if e.name in ("dst", "_dst_vid"):
                return column("to")
            if e.name == "vertex":
                return column("vertex")
            if e.name == "edge":
                return Typed(F.when(F.col("type").isNotNull(), F.to_json(F.struct("src", "dst", "type", "rank"))), "string")
            return null
        if isinstance(e, s.Prop):
            return column(MARKS[e.name]) if e.name in MARKS else column(f"_p_{e.name}")
        if isinstance(e, s.DstProp):
            return column(f"_d_{space.tag_name(e.tag)}_{e.name}")
        if isinstance(e, s.Call) and e.name.lower() in ("src", "dst", "type", "rank"):
            return column(e.name.lower())
        return null

    return known
