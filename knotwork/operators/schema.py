"""Schema statements: CREATE, ALTER, DROP, SHOW, DESCRIBE and statistics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.plans import syntax as s
from knotwork.sources.graph import ClassDef, EdgeDef, FieldDef, IndexDef, ShapeDef, Space, TagDef, retyped_field, union_all


def fields_of(given) -> list[FieldDef]:
    names = [f[0] for f in given]
    if len(set(names)) < len(names):
        raise QueryError("a property is declared twice")
    return [FieldDef(*f) for f in given]


def create(space: Space, q: s.Create) -> Space:
    made, options = space.copy(), q.options
    group = {"tag": made.tags, "edge": made.edges, "class": made.classes, "shape": made.shapes}.get(q.kind, made.indexes)
    if q.name in group:
        if q.quiet:
            return space
        raise QueryError(f"{q.kind} {q.name} exists")
    if q.kind == "tag":
        made.tags[q.name] = TagDef(q.name, fields_of(q.fields))
    elif q.kind == "edge":
        if q.name.lower() == "sameas":
            raise QueryError("the identity type is built in")
        one = lambda k: (options[k],) if k in options else ()
        for k in ("inverse", "sub"):
            if k in options and options[k] not in made.edges:
                raise QueryError(f"there is no edge {options[k]}")
        for p in (*options.get("equivalent", ()), *(options.get("chain") or ())):
            if p not in made.edges and p != q.name:
                raise QueryError(f"there is no edge {p}")
        made.edges[q.name] = EdgeDef(q.name, fields_of(q.fields), "symmetric" in options, "transitive" in options, options.get("inverse"), one("sub"), options.get("equivalent", ()), options.get("chain"), options.get("domain"), options.get("range"))
    elif q.kind == "class":
        for p in (*options.get("parents", ()), *options.get("equivalent", ()), *options.get("disjoint", ())):
            if p not in made.classes and p not in made.tags:
                raise QueryError(f"there is no class {p}")
        made.classes[q.name] = ClassDef(q.name, options.get("parents", ()), options.get("equivalent", ()), options.get("disjoint", ()))
        made.tags.setdefault(q.name, TagDef(q.name, fields_of(q.fields)))
    elif q.kind == "shape":
        made.shapes[q.name] = ShapeDef(q.name, options["on"], q.fields)
    else:
        kind = q.kind.split()[0]
        on = (made.tags if kind == "tag" else made.edges).get(options["on"])
        if on is None:
            raise QueryError(f"there is no {kind} {options['on']}")
        for f in options["fields"]:
            if all(x.name != f for x in on.fields):
                raise QueryError(f"there is no property {f}")
        made.indexes[q.name] = IndexDef(q.name, kind, options["on"], options["fields"])
    return made


def alter(space: Space, q: s.Alter) -> Space:
    """Changes the declaration; values of dropped properties are no longer seen, new ones are null."""
    made = space.copy()
    group = made.tags if q.kind == "tag" else made.edges
    old = group.get(q.name)
    if old is None:
        raise QueryError(f"there is no {q.kind} {q.name}")
    fields = {f.name: f for f in old.fields}
    for given in q.fields:
        name = given if q.action == "DROP" else given[0]
        if (name in fields) == (q.action == "ADD"):
            raise QueryError(f"property {name} {'exists' if q.action == 'ADD' else 'does not exist'}")
        if q.action == "ADD" and not FieldDef(*given).nullable and FieldDef(*given).default is None:
            raise QueryError(f"property {name} takes NULL or a DEFAULT, as vertices without it exist")
        if q.action == "DROP":
            del fields[name]
        else:
            fields[name] = FieldDef(*given)
    group[q.name] = type(old)(**{**old.__dict__, "fields": list(fields.values()), "version": old.version + 1})
    frames, key = (made.tag_frames, ["vid"]) if q.kind == "tag" else (made.edge_frames, ["src", "dst", "rank", "inferred"])
    if q.name in frames:
        frame = space.tag(q.name) if q.kind == "tag" else space.asserted(q.name)
        frames[q.name] = frame.select(*key, *[retyped_field(frame, f) for f in fields.values()])
    return made


def drop(space: Space, q: s.Drop) -> Space:
    made = space.copy()
    group = {"tag": made.tags, "edge": made.edges, "class": made.classes, "shape": made.shapes, "tag index": made.indexes, "edge index": made.indexes}.get(q.kind)
    if group is None:
        raise QueryError(f"DROP {q.kind.upper()} is not supported")
    if q.name not in group:
        if q.quiet:
            return space
        raise QueryError(f"there is no {q.kind} {q.name}")
    if q.kind == "class":
        users = [c.name for c in made.classes.values() if q.name in (*c.parents, *c.equivalent, *c.disjoint)] + [x.name for x in made.shapes.values() if x.on == q.name] + [e.name for e in made.edges.values() if q.name in (e.domain, e.range)]
        if users:
            raise QueryError(f"class {q.name} is used by {users[0]}")
        made.tags.pop(q.name, None)
        made.tag_frames.pop(q.name, None)
    if q.kind == "edge":
        users = [e.name for e in made.edges.values() if e.name != q.name and q.name in (e.inverse, *e.sub, *e.equivalent, *(e.chain or ()))]
        if users:
            raise QueryError(f"edge {q.name} is used by {users[0]}")
    del group[q.name]
    {"tag": made.tag_frames, "edge": made.edge_frames}.get(q.kind, {}).pop(q.name, None)
    return made


def table(space: Space, columns: str, rows) -> DataFrame:
    return space.spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in columns.split(",")))


def stats(space: Space) -> DataFrame:
    """Type, Name, Count: vertices by their first tag, edges by type, and both totals; types without rows count 0."""
    # a vertex counts for its first tag; tags that share no vertex with another are counted as they are
    alone = [t for t in space.tags if all(space.apart(t, x) for x in space.tags if x != t)]
    counts = [space.tag(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tag"), "n") for t in alone]
    if len(alone) < len(space.tags):
        first = space.vertex_tags([t for t in space.tags if t not in alone]).groupBy("vid").agg(F.min_by("tag", "at").alias("tag"))
        counts.append(first.groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
    first = union_all(counts) if counts else space.spark.createDataFrame([], "tag string, n long")
    names = space.spark.createDataFrame([("Tag", t) for t in space.tags] + [("Edge", e) for e in space.edges], "Type string, Name string")
    edges = space.edges_of(None).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    counts = first.select(F.lit("Tag").alias("Type"), F.col("tag").alias("Name"), "n").unionByName(edges.select(F.lit("Edge").alias("Type"), F.col("type").alias("Name"), "n"))
    listed = names.join(counts, ["Type", "Name"], "left").select("Type", "Name", F.coalesce("n", F.lit(0)).cast("long").alias("Count"))
    totals = listed.groupBy(F.when(F.col("Type") == "Tag", "vertices").otherwise("edges").alias("Name")).agg(F.sum("Count").alias("Count"))
    both = space.spark.createDataFrame([("vertices",), ("edges",)], "Name string").join(totals, "Name", "left")
    return listed.unionByName(both.select(F.lit("Total").alias("Type"), "Name", F.coalesce("Count", F.lit(0)).cast("long").alias("Count")))


def degrees(space: Space, direction: str = "in") -> DataFrame:
    """(type, vid, degree) of all ends of edges."""
    end = "dst" if direction == "in" else "src"
    return space.edges_of(None).groupBy("type", F.col(end).alias("vid")).agg(F.count(F.lit(1)).alias("degree"))


def show(space: Space | None, spaces: dict, q: s.Show, spark) -> DataFrame:
    what = q.what
    if what == "SPACES":
        return spark.createDataFrame([(n,) for n in sorted(spaces)], "Name string")
    if what in ("USERS", "ROLES", "SESSIONS", "HOSTS"):
        raise QueryError(f"SHOW {what} belongs to a server; this engine has none")
    if space is None:
        raise QueryError("no space is in use")
    if what == "TAGS":
        return table(space, "Name", [(t,) for t in space.tags])
    if what == "EDGES":
        return table(space, "Name", [(e,) for e in space.edges])
    if what == "CLASSES":
        return table(space, "Name,Parents,Equivalent,Disjoint", [(c.name, ", ".join(c.parents), ", ".join(c.equivalent), ", ".join(c.disjoint)) for c in space.classes.values()])
    if what in ("TAG INDEXES", "EDGE INDEXES", "INDEXES"):
        return table(space, "Index Name,On,Fields", [(i.name, i.on, ", ".join(i.fields)) for i in space.indexes.values() if what == "INDEXES" or i.kind == what.split()[0].lower()])
    if what.endswith("INDEX STATUS"):
        return table(space, "Name,Status", [(i.name, "FINISHED") for i in space.indexes.values() if i.kind == what.split()[0].lower()])
    if what == "STATS":
        return stats(space)
    if what == "PARTS":
        return spark.createDataFrame([(k,) for k in range(1, space.partition_num + 1)], "`Partition ID` int")
    if what.startswith("CREATE "):
        return table(space, "Name,Statement", [(q.name, statement_of(space, what.split()[1].lower(), q.name))])
    raise QueryError(f"SHOW {what} is not known")


def statement_of(space: Space, kind: str, name: str) -> str:
    if kind == "space":
        vid = space.vid_type if space.vid_length is None else f"{space.vid_type}({space.vid_length})"
        return f"CREATE SPACE {space.name} (partition_num = {space.partition_num}, replica_factor = {space.replica_factor}, vid_type = {vid})"
    found = (space.tags if kind == "tag" else space.edges).get(name)
    if found is None:
        raise QueryError(f"there is no {kind} {name}")
    fields = ", ".join(f"{f.name} {f.kind} {'NULL' if f.nullable else 'NOT NULL'}" + (f" DEFAULT {json.dumps(f.default)}" if f.default is not None else "") for f in found.fields)
    clauses = ""
    if kind == "edge":
        clauses = " TRANSITIVE" * found.transitive + " SYMMETRIC" * found.symmetric + "".join(f" {word} {value}" for word, value in (("INVERSE OF", found.inverse), *(("SUBPROPERTY OF", x) for x in found.sub), ("EQUIVALENT TO", ", ".join(found.equivalent)), ("CHAIN", ", ".join(found.chain or ())), ("DOMAIN", found.domain), ("RANGE", found.range)) if value)
    return f"CREATE {kind.upper()} {name} ({fields}){clauses}"


def describe(space: Space, spaces: dict, q: s.Describe) -> DataFrame:
    if q.kind == "space":
        found = spaces.get(q.name)
        if found is None:
            raise QueryError(f"there is no space {q.name}")
        vid = found.vid_type if found.vid_length is None else f"{found.vid_type}({found.vid_length})"
        return table(found, "Name,Partition Number,Replica Factor,Vid Type", [(found.name, str(found.partition_num), str(found.replica_factor), vid)])
    if q.kind in ("tag", "edge"):
        found = (space.tags if q.kind == "tag" else space.edges).get(q.name)
        if found is None:
            raise QueryError(f"there is no {q.kind} {q.name}")
        return table(space, "Field,Type,Null,Default", [(f.name, f.kind, "YES" if f.nullable else "NO", None if f.default is None else str(f.default)) for f in found.fields])
    if q.kind == "class":
        c = space.classes.get(q.name)
        if c is None:
            raise QueryError(f"there is no class {q.name}")
        return table(space, "Name,Parents,Equivalent,Disjoint", [(c.name, ", ".join(c.parents), ", ".join(c.equivalent), ", ".join(c.disjoint))])
    i = space.indexes.get(q.name)
    if i is None:
        raise QueryError(f"there is no index {q.name}")
    on = (space.tags if i.kind == "tag" else space.edges)[i.on]
    return table(space, "Field,Type", [(f, next(x.kind for x in on.fields if x.name == f)) for f in i.fields])


#: What a description of a schema may hold at most; beyond it is an error, not a part of the schema.
DISCOVERY_LIMITS = {"max_tags": 256, "max_edges": 256, "max_properties_per_type": 128, "max_metadata_bytes": 256 * 1024}


def discovery(space: Space) -> str:
    """The schema as JSON, for programs: types and properties by name, what is available, and the limits kept."""
    prop = lambda f: {"name": f.name, "data_type": f.kind, "nullable": f.nullable, "has_default": f.default is not None}
    own = lambda group: [{"name": x.name, "properties": sorted(map(prop, x.fields), key=lambda p: p["name"])} for x in sorted(group.values(), key=lambda x: x.name)]
    found = {"space": space.name, "vid": {"kind": space.vid_type, "max_utf8_bytes": space.vid_length}, "tags": own(space.tags), "edges": own(space.edges)}
    for kind in ("tags", "edges"):
        if len(found[kind]) > DISCOVERY_LIMITS[f"max_{kind}"]:
            raise QueryError(f"the space has more than {DISCOVERY_LIMITS[f'max_{kind}']} {kind}")
        if any(len(x["properties"]) > DISCOVERY_LIMITS["max_properties_per_type"] for x in found[kind]):
            raise QueryError(f"a type has more than {DISCOVERY_LIMITS['max_properties_per_type']} properties")
    if len(json.dumps(found).encode()) > DISCOVERY_LIMITS["max_metadata_bytes"]:
        raise QueryError(f"the schema takes more than {DISCOVERY_LIMITS['max_metadata_bytes']} bytes")
    available = {"schema_discovery": True, "text_query": True, "request_read_only": True, "parameter_binding": False, "snapshot_pagination": False, "mutation_preview": False}
    return json.dumps({
        "contract_version": "1", "consistency": "live_reads_no_snapshot", "limits": DISCOVERY_LIMITS, "schema": found,
        "capabilities": [{"name": n, "status": "available" if ok else "unsupported"} for n, ok in sorted(available.items())],
    })


def partition_of(vids: DataFrame, parts: int, by: str = "HASH", boundaries=()) -> DataFrame:
    """vids with part, from 1: by hash, by remainder, or by ranges (below the first boundary: 1)."""
    if by == "MODULO":
        part = F.pmod(F.abs("vid"), F.lit(parts)) + 1
    elif by == "RANGE":
        part = sum((F.when(F.col("vid") >= b, 1).otherwise(0) for b in boundaries), F.lit(1))
    else:
        part = F.pmod(F.xxhash64("vid"), F.lit(parts)) + 1
    return vids.withColumn("part", part.cast("long"))


__all__ = ["alter", "create", "degrees", "describe", "discovery", "drop", "partition_of", "show", "stats", "union_all"]
