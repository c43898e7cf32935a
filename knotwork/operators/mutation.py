"""INSERT, UPDATE and DELETE: changes beside the frames they change; each returns the changed space and a count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions.expressions import Compiler, Mode, Typed, kind_of
from knotwork.operators.temporal import append
from knotwork.operators.validation import check_shapes
from knotwork.plans import syntax as s
from knotwork.sources.graph import Space

SAME = "sameas"


def assignable(kind: str, value) -> bool:
    """Whether a value may stand in a field of a declared type; lists only stand in vectors, see widen()."""
    if value is None:
        return True
    if kind == "VECTOR" or isinstance(value, list):
        return kind == "VECTOR" and isinstance(value, list)
    if isinstance(value, bool):
        return kind == "BOOL"
    if isinstance(value, int):
        return kind.startswith("INT") or kind in ("FLOAT", "DOUBLE", "TIMESTAMP", "DATE", "TIME", "DATETIME")
    if isinstance(value, float):
        return kind in ("FLOAT", "DOUBLE")
    return kind in ("STRING", "TIMESTAMP", "DATE", "TIME", "DATETIME")


def stored(field, value):
    """value as the field's column holds it."""
    if value is None:
        return None
    if field.stored == "double":
        return float(value)
    if field.stored == "string" and not isinstance(value, str):
        return str(value)
    if field.stored == "long" and isinstance(value, str):
        raise QueryError(f"{field.name} takes a number")
    return [float(x) for x in value] if isinstance(value, list) else value


def rows_of(space: Space, fields, names, values) -> dict:
    by = {f.name: f for f in fields}
    if len(names) != len(values):
        raise QueryError("there are as many values as names")
    found = dict.fromkeys(by)
    for n, v in zip(names, values, strict=True):
        if n not in by:
            raise QueryError(f"there is no property {n}")
        if not assignable(by[n].kind, v):
            raise QueryError(f"{n} does not take {v!r}")
        found[n] = stored(by[n], v)
    return found


def widen(fields, names, values, old: DataFrame) -> None:
    """A property that is given a list holds vectors from then on, if it has held nothing yet."""
    by = {f.name: f for f in fields}
    for n, v in zip(names, values, strict=False):
        if isinstance(v, list) and n in by and by[n].kind != "VECTOR":
            if n in old.columns and not old.filter(F.col(f"`{n}`").isNotNull()).isEmpty():
                raise QueryError(f"{n} holds values that are no vectors")
            by[n].kind = "VECTOR"


def retyped(frame: DataFrame, fields) -> DataFrame:
    """frame with its columns in the types that the fields now have."""
    kinds = {n: "long" if t == "bigint" else t for n, t in frame.dtypes}
    # a column that became a vector held nothing, see widen()
    changed = {f.name: F.lit(None).cast(f.stored) if f.name not in kinds or f.stored == "array<float>" else F.col(f"`{f.name}`").cast(f.stored) for f in fields if kinds.get(f.name) != f.stored}
    return frame.withColumns(changed) if changed else frame


def keep_types(made: Space, kind: str, name: str) -> None:
    """Puts a frame of which a column has another type by now in the place of the old one."""
    frame = made.tag(name) if kind == "tag" else made.asserted(name)
    now = retyped(frame, (made.tags if kind == "tag" else made.edges)[name].fields)
    if now is not frame:
        (made.tag_frames if kind == "tag" else made.edge_frames)[name] = now


def insert_vertices(space: Space, q: s.InsertVertex, tx: int) -> tuple[Space, int]:
    """Each row replaces the whole vertex, all tags; of rows for one id the last stays. The count is of rows given.

    Every row is checked before anything is made, so a statement that is refused changes nothing.
    """
    made = space.copy()
    last: dict = {}
    width = sum(len(names) for _, names in q.tags)
    for name, _ in q.tags:
        if name not in space.tags:
            raise QueryError(f"there is no tag {name}")
    for vid, values in q.rows:
        space.vids([vid])
        if len(values) != width:
            raise QueryError("there are as many values as names")
        at = 0
        for name, names in q.tags:
            widen(made.tags[name].fields, names, values[at : at + len(names)], space.tag(name))
            at += len(names)
    for vid, values in q.rows:
        at, props = 0, {}
        for name, names in q.tags:
            props[name] = rows_of(space, made.tags[name].fields, names, values[at : at + len(names)])
            at += len(names)
        last[vid] = props
    gone = space.vids(list(last)).select("vid")
    if space.same is not None:
        gone = space.representative(gone, "vid")
    for t, tag in made.tags.items():
        new = [(vid, *props[t].values()) for vid, props in last.items() if t in props]
        if not new and (t not in space.tag_frames or not made.may_hold(t, last)):
            continue
        keep_types(made, "tag", t)
        if new:
            schema = ", ".join([f"vid {space.vid_sql}", *(f"`{f.name}` {f.stored}" for f in tag.fields)])
            rows = space.spark.createDataFrame(new, schema)
            if space.same is not None:
                rows = space.representative(rows, "vid").dropDuplicates(["vid"])
            made.tag_history[t] = append(space.tag_history.get(t), rows, tx, False)
            made.change("tag", t, None, rows)
            made.widen_span(t, last)
        else:
            if space.tag_history.get(t) is not None:
                made.tag_history[t] = append(space.tag_history.get(t), made.tag(t).join(gone, "vid", "left_semi"), tx, True)
            made.change("tag", t, gone)
    guard_shapes(made, gone)
    return made, len(q.rows)


def guard_shapes(space: Space, vids: DataFrame) -> None:
    if space.shapes:
        broken = check_shapes(space, vids, declared_only=True).limit(1).collect()
        if broken:
            r = broken[0]
            raise QueryError(f"{r['vid']} breaks {r['shape']}: {r['property']} {r['constraint']}")


def insert_edges(space: Space, q: s.InsertEdge, tx: int) -> tuple[Space, int]:
    """Rows replace edges of the same ends and rank; ends need not exist. Edges of the identity type merge their ends."""
    if q.name.lower() == SAME:
        from knotwork.operators.identity import merge

        pairs = space.spark.createDataFrame([(a, b) for a, b, _, _ in q.rows], f"a {space.vid_sql}, b {space.vid_sql}")
        return merge(space, pairs), len(q.rows)
    if q.name not in space.edges:
        raise QueryError(f"there is no edge {q.name}")
    made = space.copy()
    fields, last = made.edges[q.name].fields, {}
    for src, dst, _, values in q.rows:
        space.vids([src, dst])
        widen(fields, q.props, values, space.asserted(q.name))
    for src, dst, rank, values in q.rows:
        last[src, dst, rank] = rows_of(space, fields, q.props, values)
    keep_types(made, "edge", q.name)
    schema = ", ".join([f"src {space.vid_sql}, dst {space.vid_sql}, rank long, inferred boolean", *(f"`{f.name}` {f.stored}" for f in fields)])
    rows = space.spark.createDataFrame([(*k, False, *v.values()) for k, v in last.items()], schema)
    if space.same is not None:
        rows = space.representative(rows, "src", "dst").dropDuplicates(["src", "dst", "rank"])
    made.change("edge", q.name, None, rows)
    made.edge_history[q.name] = append(space.edge_history.get(q.name), rows.drop("inferred"), tx, False)
    return made, len(q.rows)


def update(space: Space, q: s.Update, tx: int) -> tuple[Space, int]:
    """Sets literals. A vertex without the tag is given it unless there is a WHEN; an edge must exist."""
    made = space.copy()
    if q.edge:
        if q.name not in space.edges:
            raise QueryError(f"there is no edge {q.name}")
        fields, frame = made.edges[q.name].fields, made.edge(q.name)
        src, dst, rank = q.ref
        space.vids([src, dst])
        stands = space.standing([src, dst])
        src, dst = stands[src], stands[dst]
        hit = (F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst)) & (F.col("rank") == F.lit(rank or 0))
    else:
        if q.name not in space.tags:
            raise QueryError(f"there is no tag {q.name}")
        fields, frame = made.tags[q.name].fields, made.tag(q.name)
        vid = space.representative(space.vids([q.ref]), "vid").first()["vid"]
        hit = F.col("vid") == F.lit(vid)
    names, values = [n for n, _ in q.changes], [v for _, v in q.changes]
    widen(fields, names, values, frame)
    changes = rows_of(space, fields, names, values)
    changes = {n: changes[n] for n in names}
    keep_types(made, "edge" if q.edge else "tag", q.name)
    frame = retyped(frame, fields)
    kinds = {f.name: kind_of(f.dataType) for f in frame.schema.fields}

    def known(e):
        if isinstance(e, s.Name | s.Prop) and e.name in kinds and (isinstance(e, s.Name) or e.owner == q.name):
            return Typed(F.col(f"`{e.name}`"), kinds[e.name])
        return None

    old = frame.filter(hit)
    exists = not old.isEmpty()
    chosen = old if q.when is None else old.filter(Compiler(Mode.EVAL, known).condition(q.when))
    if chosen.isEmpty():
        if q.edge or q.when is not None or exists:
            return space, 0
        schema = ", ".join([f"vid {space.vid_sql}", *(f"`{f.name}` {f.stored}" for f in fields)])
        new = space.spark.createDataFrame([(vid, *({f.name: None for f in fields} | changes).values())], schema)
    else:
        by = {f.name: f for f in fields}
        new = chosen.withColumns({n: (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).cast(by[n].stored) for n, v in changes.items()})
    if q.edge:
        new = new.withColumn("inferred", F.lit(False))
        made.change("edge", q.name, None, new)
        made.edge_history[q.name] = append(space.edge_history.get(q.name), new.drop("inferred"), tx, False)
    else:
        made.change("tag", q.name, None, new)
        made.widen_span(q.name, [vid])
        made.tag_history[q.name] = append(space.tag_history.get(q.name), new, tx, False)
        guard_shapes(made, space.vids([vid]).select("vid"))
    return made, 1


def delete_vertices(space: Space, q: s.DeleteVertex, tx: int) -> tuple[Space, int]:
    """Deletes vertices and leaves their edges; merged vertices are refused."""
    made = space.copy()
    gone = space.vids(q.vids).select("vid").distinct()
    if space.same is not None and not space.same.join(gone, "vid", "left_semi").isEmpty():
        raise QueryError("a merged vertex cannot be deleted")
    gone = gone.join(space.vertices(once=False, among=q.vids), "vid", "left_semi")
    if q.where is not None:
        keep = None
        for t in space.tags:
            frame = space.tag(t).join(gone, "vid", "left_semi")
            kinds = {f.name: kind_of(f.dataType) for f in frame.schema.fields}

            def known(e, kinds=kinds, t=t):
                if isinstance(e, s.Name | s.Prop) and e.name in kinds and (isinstance(e, s.Name) or e.owner == t):
                    return Typed(F.col(f"`{e.name}`"), kinds[e.name])
                return None

            try:
                fits = frame.filter(Compiler(Mode.EVAL, known).condition(q.where)).select("vid")
            except QueryError:
                continue
            keep = fits if keep is None else keep.unionByName(fits)
        gone = gone.limit(0) if keep is None else gone.join(keep.distinct(), "vid", "left_semi")
    # at most the ids named; as literals they leave no trace of this statement's reads in later plans
    found = [r["vid"] for r in gone.collect()]
    n, gone = len(found), space.spark.createDataFrame([(v,) for v in found], f"vid {space.vid_sql}")
    if not n:
        return space, 0
    for t in space.tags:
        if t in space.tag_frames and space.may_hold(t, found):
            lost = space.tag(t).join(gone, "vid", "left_semi")
            made.tag_history[t] = append(space.tag_history.get(t), lost, tx, True)
            made.change("tag", t, gone)
    return made, n


def delete_edges(space: Space, q: s.DeleteEdge, tx: int) -> tuple[Space, int]:
    """Deletes asserted edges of exactly the given rank (0 without one)."""
    if q.name.lower() == SAME:
        raise QueryError("merged identities cannot be parted")
    if q.name not in space.edges:
        raise QueryError(f"there is no edge {q.name}")
    made = space.copy()
    stands = space.standing({x for a, b, _ in q.refs for x in (a, b)})
    refs = space.spark.createDataFrame([(stands[a], stands[b], r or 0) for a, b, r in q.refs], f"src {space.vid_sql}, dst {space.vid_sql}, rank long").distinct()
    hit = space.edge(q.name).join(refs, ["src", "dst", "rank"], "left_semi")
    found = hit.select("src", "dst", "rank", "inferred").collect()
    if any(r["inferred"] for r in found):
        raise QueryError("a derived edge cannot be deleted")
    if not found:
        return space, 0
    gone = space.spark.createDataFrame([tuple(r)[:3] for r in found], f"src {space.vid_sql}, dst {space.vid_sql}, rank long")
    made.edge_history[q.name] = append(space.edge_history.get(q.name), hit.drop("inferred"), tx, True)
    made.change("edge", q.name, gone)
    return made, len(found)
