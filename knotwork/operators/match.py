"""MATCH: patterns to joins.

A pattern becomes one DataFrame of bindings: for a node variable its id and the properties the query asks for, for an
edge variable its identity and properties. Frames are joined in pattern order and the condition is put on top; Catalyst
pushes filters into the scans and picks the join strategies. A labelled node is read from its tag's frame together with
its properties, so no second join fetches them.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions.expressions import AGGREGATES, Compiler, Mode, Typed, has_aggregate, is_aggregate, kind_of, literal
from knotwork.operators.aggregate import aggregate
from knotwork.operators.varlength import reachable
from knotwork.plans import syntax as s
from knotwork.sources.graph import Space, cut, union_all

EDGE_CALLS = {"src": "src", "dst": "dst", "type": "type", "rank": "rank", "ranking": "rank"}
MAX_HOPS = 20
#: Pairs that one task makes of two sides of a join, about.
TASK_PAIRS = 1 << 22


def columns_of(e) -> str:
    """The display name of a RETURN item without an alias."""
    if isinstance(e, s.Name):
        return e.name
    if isinstance(e, s.Prop):
        return f"{e.owner}.{e.name}"
    if isinstance(e, s.TagProp):
        return f"{e.owner}.{e.tag}.{e.name}"
    return "value"


def with_standing_ids(space: Space, e):
    """An expression with the ids that id(v) is compared with replaced by those that stand for them."""
    def_id = lambda x: isinstance(x, s.Call) and x.name.lower() == "id"
    below = lambda x: x.items if isinstance(x, s.ListOf) else (x,)
    compared = [x for x in s.walk(e) if isinstance(x, s.Bin) and x.op in ("==", "!=", "IN", "NOT IN") and (def_id(x.left) or def_id(x.right))]
    literals = [v.value for x in compared for side in (x.left, x.right) for v in below(side) if isinstance(v, s.Lit) and isinstance(v.value, int if space.vid_type == "INT64" else str)]
    stands = space.standing(literals)

    def made(x):
        if isinstance(x, s.ListOf):
            return replace(x, items=tuple(map(made, x.items)))
        return s.Lit(stands.get(x.value, x.value)) if isinstance(x, s.Lit) and not isinstance(x.value, bool | None) else x

    def walked(x):
        if isinstance(x, s.Bin):
            return replace(x, left=made(x.left), right=made(x.right)) if x in compared else replace(x, left=walked(x.left), right=walked(x.right))
        return replace(x, arg=walked(x.arg)) if isinstance(x, s.Un) else x

    return walked(e) if literals else e


class Matcher:
    def __init__(self, space: Space, query: s.Match):
        if space.same is not None and query.where is not None:
            query = replace(query, where=with_standing_ids(space, query.where))
        self.space, self.query = space, query
        self.nodes: dict[str, list[s.NodePat]] = {}
        self.edges: dict[str, s.EdgePat] = {}
        for p in (*query.patterns, *query.optional):
            for n in p.nodes:
                self.nodes.setdefault(n.var, []).append(n)
            for e in p.edges:
                if e.var in self.edges and not e.named:
                    raise QueryError("an edge is bound twice")
                self.edges[e.var] = e
        if clash := set(self.nodes) & set(self.edges):
            raise QueryError(f"{clash.pop()} is a node and an edge")
        exprs = [i.expr for i in query.items] + [e for e, _ in query.order] + list(query.group or ()) + ([query.where] if query.where is not None else [])
        self.wanted: dict[str, set[tuple[str | None, str]]] = {}
        self.whole: set[str] = set()
        aliases = {i.alias for i in query.items}
        for e in exprs:
            for x in s.walk(e):
                if isinstance(x, s.TagProp):
                    self.wanted.setdefault(x.owner, set()).add((x.tag, x.name))
                elif isinstance(x, s.Prop):
                    self.wanted.setdefault(x.owner, set()).add((None, x.name))
                elif isinstance(x, s.Call) and x.name.lower() in ("properties", "tags", "labels") and x.args and isinstance(x.args[0], s.Name):
                    self.whole.add(x.args[0].name)
                elif isinstance(x, s.Name) and x.name in self.nodes and (x.name not in aliases or any(i.expr == x for i in query.items)):
                    self.whole.add(x.name)
        # functions take whole variables without needing their properties
        for e in exprs:
            for x in s.walk(e):
                if isinstance(x, s.Call) and x.name.lower() in ("id", "is_a", "isa", *EDGE_CALLS, "count") and x.args and isinstance(x.args[0], s.Name):
                    self._only_in_calls(x.args[0].name, exprs)
        self.check()

    def _only_in_calls(self, var: str, exprs) -> None:
        def bare(e, inside: bool) -> bool:
            if isinstance(e, s.Name):
                return e.name == var and not inside
            if isinstance(e, s.Call):
                return any(bare(a, e.name.lower() in ("id", "is_a", "isa", *EDGE_CALLS, "count")) for a in e.args)
            if isinstance(e, s.Bin):
                return bare(e.left, False) or bare(e.right, False)
            if isinstance(e, s.Un):
                return bare(e.arg, False)
            return isinstance(e, s.ListOf) and any(bare(x, False) for x in e.items)

        if not any(bare(e, False) for e in exprs):
            self.whole.discard(var)

    def check(self) -> None:
        """What can be refused before any data is read."""
        q = self.query
        if q.where is not None and has_aggregate(q.where):
            raise QueryError("WHERE has no aggregates")
        for e in q.group or ():
            if has_aggregate(e):
                raise QueryError("GROUP BY has no aggregates")
        for i in q.items:
            for x in s.walk(i.expr):
                if is_aggregate(x) and any(has_aggregate(a) for a in x.args):
                    raise QueryError("aggregates do not nest")
                if isinstance(x, s.Call) and x.name.lower() == "collect":
                    raise QueryError("there is no COLLECT")
            if has_aggregate(i.expr) and not is_aggregate(i.expr):
                raise QueryError("an aggregate stands alone in its column")
        names = [i.alias or columns_of(i.expr) for i in q.items]
        for e, _ in q.order:
            fits = [n for n, i in zip(names, q.items, strict=True) if (isinstance(e, s.Name) and i.alias == e.name)] or [n for n, i in zip(names, q.items, strict=True) if i.expr == e]
            if q.items and len(fits) != 1:
                raise QueryError("ORDER BY takes an alias or an expression of RETURN")
        for e in self.edges.values():
            if e.span:
                low, high = e.span
                if e.named:
                    raise QueryError("a variable-length edge takes no variable")
                if high == 0 or low > high:
                    raise QueryError(f"*{low}..{high} is no range")
                if high > MAX_HOPS:
                    raise QueryError(f"*{low}..{high} is more than {MAX_HOPS} steps")

    # --- nodes and edges ---

    def node_frame(self, var: str) -> DataFrame:
        """(var__vid, wanted properties): vertices that fit all mentions of the variable."""
        space, pats = self.space, self.nodes[var]
        labels = [(lab, n.any_label) for n in pats for lab in [n.labels] if lab]
        wanted = {(t, p) for t, p in self.wanted.get(var, ())}
        wanted |= {(None, p) for n in pats for p, _ in n.props}
        all_of = {space.tag_name(x) for lab, either in labels if not either or len(lab) == 1 for x in lab}
        if None in all_of:
            return self._attach(space.spark.createDataFrame([], f"vid {space.vid_sql}"), var, wanted, None, pats)
        base_tag = next((t for t in space.tags if t in all_of), None)
        if base_tag is not None:
            base = space.tag(base_tag)
        else:
            either = next((lab for lab, e in labels if e), None)
            tags = [t for t in (space.tag_name(x) for x in either) if t] if either else list(space.tags)
            base = union_all([space.tag(t).select("vid") for t in tags]).distinct() if tags else space.spark.createDataFrame([], f"vid {space.vid_sql}")
        for t in all_of - {base_tag}:
            base = base.join(space.tag(t).select("vid"), "vid", "left_semi")
        for lab, either in labels:
            tags = [t for t in (space.tag_name(x) for x in lab) if t]
            if either and len(lab) > 1 and base_tag is not None and base_tag not in tags:
                fits = union_all([space.tag(t).select("vid") for t in tags]).distinct() if tags else base.limit(0).select("vid")
                base = base.join(fits, "vid", "left_semi")
        return self._attach(base, var, wanted, base_tag, pats)

    def _attach(self, base: DataFrame, var: str, wanted, base_tag: str | None, pats) -> DataFrame:
        space = self.space
        made: dict[tuple, Column] = {}
        needed: dict[str, set[str]] = {}
        for tag, prop in wanted:
            for t in [space.tag_name(tag)] if tag else [t for t in space.tags if any(f.name == prop for f in space.tags[t].fields)]:
                if t is not None and any(f.name == prop for f in space.tags[t].fields):
                    needed.setdefault(t, set()).add(prop)
        if var in self.whole:
            for t in space.tags:
                needed.setdefault(t, set()).update(f.name for f in space.tags[t].fields)
        columns = [F.col("vid").alias(f"{var}__vid")]
        if base_tag is not None:
            columns += [F.col(f"`{p}`").alias(f"{var}__{base_tag}__{p}") for p in sorted(needed.get(base_tag, ()))]
            if var in self.whole:
                columns.append(F.lit(True).alias(f"{var}__is__{base_tag}"))
        frame = base.select(*columns)
        for t, props in needed.items():
            if t == base_tag:
                continue
            other = space.tag(t).select(F.col("vid").alias("_vid"), *[F.col(f"`{p}`").alias(f"{var}__{t}__{p}") for p in sorted(props)], *([F.lit(True).alias(f"{var}__is__{t}")] if var in self.whole else []))
            frame = frame.join(other, F.col(f"{var}__vid") == F.col("_vid"), "left").drop("_vid")
        for tag, prop in wanted:
            tags = [t for t in ([space.tag_name(tag)] if tag else space.tags) if t in needed and prop in needed[t]]
            if tags:
                made[(tag, prop)] = F.coalesce(*[F.col(f"{var}__{t}__{prop}") for t in tags]) if len({space.property_kind([space.tags[t].fields], prop) for t in tags}) == 1 else F.coalesce(*[F.col(f"{var}__{t}__{prop}").cast("string") for t in tags])
        for n in pats:
            for prop, value in n.props:
                tags = [t for t in space.tags if t in needed and prop in needed[t]]
                fits = [self._literal_equal(F.col(f"{var}__{t}__{prop}"), value) for t in tags]
                frame = frame.filter(reduce(or_, fits)) if fits else frame.limit(0)
        keep = [f"{var}__vid"]
        if var in self.whole:
            entries = [F.when(F.col(f"{var}__is__{t}"), F.lit(t)) for t in space.tags if f"{var}__is__{t}" in frame.columns]
            tags = F.filter(F.array(*entries), lambda x: x.isNotNull()) if entries else F.array().cast("array<string>")
            many = F.size(tags) > 1
            pairs = [F.struct(F.when(many, F.lit(f"{t}.{f.name}")).otherwise(F.lit(f.name)).alias("k"), F.col(f"{var}__{t}__{f.name}").cast("string").alias("v")) for t in space.tags for f in space.tags[t].fields]
            props = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull())) if pairs else F.lit(None).cast("map<string,string>")
            frame = frame.withColumns({f"{var}__tags": tags, f"{var}__properties": props})
            keep += [f"{var}__tags", f"{var}__properties"]
        return frame.select(*keep, *[c.alias(f"{var}__p__{t or ''}__{p}") for (t, p), c in sorted(made.items(), key=lambda kv: (kv[0][0] or "", kv[0][1]))])

    @staticmethod
    def _literal_equal(col: Column, value) -> Column:
        return col.isNull() if value is None else col == literal(value).col

    def edge_frame(self, var: str) -> DataFrame:
        """(_from, _to, var__src, var__dst, var__rank, var__type, wanted properties), turned as the pattern asks."""
        e, space = self.edges[var], self.space
        wanted = sorted({p for _, p in self.wanted.get(var, ())} | {p for p, _ in e.props})
        known = [p for p in wanted if any(f.name == p for n in space.edge_names(e.types) for f in space.edges[n].fields)]
        frame = space.edges_of(e.types, known)
        for p, value in e.props:
            frame = frame.filter(self._literal_equal(F.col(f"`{p}`"), value)) if p in known else frame.limit(0)
        own = frame.select(*[F.col(c).alias(f"{var}__{c}") for c in ("src", "dst", "rank", "type")], *[F.col(f"`{p}`").alias(f"{var}__p____{p}") for p in known])
        out = own.withColumns({"_from": F.col(f"{var}__src"), "_to": F.col(f"{var}__dst")})
        if e.direction == "out":
            return out
        back = own.withColumns({"_from": F.col(f"{var}__dst"), "_to": F.col(f"{var}__src")})
        return back if e.direction == "in" else out.unionByName(back.filter("_from <> _to"))

    def bindings(self, pattern: s.Pattern) -> DataFrame:
        first = pattern.nodes[0].var
        bound, seen = self.node_frame(first), {first}
        limit = self.space.scan_limit
        if limit is not None and not any(n.labels for n in self.nodes[first]) and self.space.vertices().limit(limit + 1).count() > limit:
            raise QueryError(f"a pattern without a label scans more than {limit} vertices")
        before = None
        for e, node in zip(pattern.edges, pattern.nodes[1:], strict=True):
            left = pattern.nodes[pattern.edges.index(e)].var
            # a vertex that edges enter from both sides, or leave to both, may have many on each
            turned, before = before is not None and (before.direction != e.direction or e.direction not in ("out", "in")), e
            if e.span:
                frame = self.ranged(bound.select(F.col(f"{left}__vid").alias("vid")).distinct(), e)
            else:
                frame = self.edge_frame(e.var)
            again = e.var in seen
            if again:
                keys = ("src", "dst", "rank", "type")
                frame = frame.select("_from", "_to", *[F.col(f"{e.var}__{k}").alias(f"_{k}") for k in keys])
                same = [F.col(f"{e.var}__{k}") == F.col(f"_{k}") for k in keys]
                bound = bound.join(frame, [F.col(f"{left}__vid") == F.col("_from"), *same]).drop("_from", *[f"_{k}" for k in keys])
            elif turned and node.var not in seen:
                bound = self._met(bound, frame, [(f"{left}__vid", "_from")]).drop("_from")
            else:
                bound = bound.join(frame, F.col(f"{left}__vid") == F.col("_from")).drop("_from")
            seen.add(e.var)
            if node.var in seen:
                bound = bound.filter(F.col("_to") == F.col(f"{node.var}__vid")).drop("_to")
            else:
                bound = bound.join(self.node_frame(node.var), F.col("_to") == F.col(f"{node.var}__vid")).drop("_to")
                seen.add(node.var)
        return bound

    def ranged(self, starts: DataFrame, e: s.EdgePat) -> DataFrame:
        steps = self.edge_frame(e.var).select("_from", "_to").distinct()
        # an edge to a missing vertex leads nowhere
        steps = steps.join(self.space.vertices(once=False).withColumnRenamed("vid", "_to"), "_to", "left_semi").select("_from", "_to")
        return reachable(starts, steps, *e.span)

    # --- the query ---

    def frame(self) -> DataFrame:
        bound, edges = None, False
        for p, how in [*((p, "inner") for p in self.query.patterns), *((p, "left") for p in self.query.optional)]:
            own = self.bindings(p)
            bound = own if bound is None else self._joined(bound, own, how, edges and bool(p.edges))
            edges = edges or bool(p.edges)
        return bound

    def _joined(self, left: DataFrame, right: DataFrame, how: str, many: bool) -> DataFrame:
        """left with the bindings of another pattern; with `many` both may have several of a shared variable."""
        shared = [c for c in right.columns if c in left.columns]
        keys = [c for c in shared if c.endswith("__vid") or c.split("__", 1)[-1] in ("src", "dst", "rank", "type")]
        right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns if c in keys or c not in shared])
        if not keys:
            # patterns without a shared variable pair all their bindings, as the language says; a limit of scans bounds this too
            limit = self.space.scan_limit
            if limit is not None and left.limit(limit + 1).count() * right.limit(limit + 1).count() > limit:
                raise QueryError(f"patterns without a shared variable have more than {limit} pairs")
            return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
        met = [(c, f"_r_{c}") for c in keys]
        joined = self._met(left, right, met, how) if many else left.join(right, [F.col(a) == F.col(b) for a, b in met], how)
        return joined.drop(*[b for _, b in met])

    def _met(self, left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
        """left joined with right, each pair of keys equal, where a key may have many rows on both sides.

        Two small sides can have very many pairs, and AQE sizes tasks by what they read. So the pairs are counted first, key by
        key: beyond TASK_PAIRS they are dealt to tasks of about that many, and the rows of a key with more are cut into tiles.
        """
        on = [F.col(a) == F.col(b) for a, b in keys]
        a, b = self.narrowed(left), self.narrowed(right) if how == "inner" else right
        counts = a.groupBy(*[x for x, _ in keys]).agg(F.count(F.lit(1)).alias("_n")).join(b.groupBy(*[y for _, y in keys]).agg(F.count(F.lit(1)).alias("_m")), on)
        pairs = F.col("_n").cast("double") * F.col("_m")
        found = counts.agg(F.sum(pairs).alias("all"), F.max(pairs).alias("most")).first()
        if not found["all"] or found["all"] <= TASK_PAIRS:
            return left.join(right, on, how)
        parts = max(int(self.space.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(found["all"] / TASK_PAIRS))
        if found["most"] > TASK_PAIRS:
            side = math.isqrt(TASK_PAIRS)
            cuts = lambda own, other: F.ceil(F.col(own) * F.least(F.col(other), F.lit(side)).cast("double") / TASK_PAIRS).cast("int")
            heavy = cut(counts.filter(pairs > TASK_PAIRS).select(*[F.col(x).alias(f"_h{k}") for k, (x, _) in enumerate(keys)], cuts("_n", "_m").alias("_across"), cuts("_m", "_n").alias("_down")))
        else:
            heavy = None
        l_tiles = self._tiles(left, [x for x, _ in keys], heavy, "_across", "_down").repartition(parts, *[F.col(x) for x, _ in keys], "_own", "_other")
        r_tiles = self._tiles(right, [y for _, y in keys], heavy, "_down", "_across").withColumnsRenamed({"_own": "_r_other", "_other": "_r_own"})
        r_tiles = r_tiles.repartition(parts, *[F.col(y) for _, y in keys], "_r_own", "_r_other")
        inner = l_tiles.join(r_tiles, [*on, F.col("_own") == F.col("_r_own"), F.col("_other") == F.col("_r_other")]).drop("_own", "_other", "_r_own", "_r_other")
        if how == "inner":
            return inner
        # a row without a partner would be one in each of its tiles
        alone = left.join(right.select(*[y for _, y in keys]), on, "left_anti")
        return inner.unionByName(alone.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]))

    def _tiles(self, rows: DataFrame, keys: list[str], heavy: DataFrame | None, own: str, other: str) -> DataFrame:
        """rows with _own, their part of their key, once for each part _other of the rows that they meet."""
        if heavy is None:
            return rows.withColumns({"_own": F.lit(0), "_other": F.lit(0)})
        names = {f"{v}__vid" for v in self.nodes} | {f"{e}__{k}" for e in self.edges for k in ("src", "dst", "rank", "type")}
        ids = [F.col(c) for c in rows.columns if c.removeprefix("_r_") in names]
        told = rows.join(heavy.select(*[f"_h{k}" for k in range(len(keys))], F.col(own).alias("_own_n"), F.col(other).alias("_other_n")), [F.col(c) == F.col(f"_h{k}") for k, c in enumerate(keys)], "left")
        one = F.lit(1)
        return told.select(*rows.columns, F.pmod(F.xxhash64(*ids), F.coalesce("_own_n", one)).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.coalesce("_other_n", one) - 1)).alias("_other"))

    def narrowed(self, frame: DataFrame) -> DataFrame:
        """frame, to be counted, with the conditions of WHERE that can be told by it alone."""
        e, parts = self.query.where, []
        while isinstance(e, s.Bin) and e.op == "AND":
            parts, e = [*parts, e.right], e.left
        held = {v for v in (*self.nodes, *self.edges) if f"{v}__vid" in frame.columns or f"{v}__src" in frame.columns}
        for x in [*parts, e] if e is not None else []:
            owners = {y.owner if isinstance(y, s.Prop | s.TagProp) else y.name for y in s.walk(x) if isinstance(y, s.Prop | s.TagProp | s.Name)}
            if owners and owners <= held and not any(isinstance(y, s.Call) and y.name.lower() in ("is_a", "isa") for y in s.walk(x)):
                frame = frame.filter(Compiler(Mode.MATCH, self.resolve(frame)).filter(x))
        return frame

    def resolve(self, frame: DataFrame):
        kinds = {f.name: kind_of(f.dataType) for f in frame.schema.fields}

        def column(name: str) -> Typed:
            return Typed(F.col(f"`{name}`"), kinds[name]) if name in kinds else Typed(F.lit(None), "null")

        def known(e):
            if isinstance(e, s.TagProp):
                self.variable(e.owner)
                return column(f"{e.owner}__p__{e.tag}__{e.name}")
            if isinstance(e, s.Prop):
                self.variable(e.owner)
                if e.owner in self.edges and e.name in ("_src", "_dst", "_type", "_rank"):
                    return column(f"{e.owner}__{e.name[1:]}")
                return column(f"{e.owner}__p____{e.name}")
            if isinstance(e, s.Name) and e.name in self.nodes:
                if f"{e.name}__tags" not in kinds:
                    return column(f"{e.name}__vid")
                v = e.name
                return Typed(F.when(F.col(f"{v}__vid").isNotNull(), F.struct(F.col(f"{v}__vid").alias("vid"), F.col(f"{v}__tags").alias("tags"), F.col(f"{v}__properties").alias("properties"))), "any")
            if isinstance(e, s.Name) and e.name in self.edges:
                return Typed(F.when(F.col(f"{e.name}__type").isNotNull(), F.struct(*[F.col(f"{e.name}__{k}").alias(k) for k in ("src", "dst", "type", "rank")])), "any")
            if isinstance(e, s.Call) and e.args and isinstance(e.args[0], s.Name):
                var, fn = e.args[0].name, e.name.lower()
                if fn == "id":
                    self.variable(var)
                    return column(f"{var}__vid") if var in self.nodes else Typed(F.lit(None), "null")
                if fn in EDGE_CALLS:
                    self.variable(var)
                    return column(f"{var}__{EDGE_CALLS[fn]}") if var in self.edges else Typed(F.lit(None), "null")
                if fn == "properties":
                    return Typed(F.col(f"{var}__properties"), "any") if f"{var}__properties" in kinds else Typed(F.lit(None), "null")
                if fn in ("tags", "labels"):
                    return Typed(F.col(f"{var}__tags"), "list") if f"{var}__tags" in kinds else Typed(F.lit(None), "null")
                if fn in ("is_a", "isa") and len(e.args) == 2 and isinstance(e.args[1], s.Lit):
                    return Typed(F.coalesce(F.col(is_a_column(var, e.args[1].value)), F.lit(False)), "bool")
            return None

        return known

    def variable(self, name: str) -> None:
        if name not in self.nodes and name not in self.edges:
            raise QueryError(f"unknown variable: {name}")

    def with_classes(self, frame: DataFrame) -> DataFrame:
        """frame with a flag for each is_a test of the query."""
        exprs = [i.expr for i in self.query.items] + ([self.query.where] if self.query.where is not None else []) + list(self.query.group or ())
        tests = {(x.args[0].name, x.args[1].value) for e in exprs for x in s.walk(e) if isinstance(x, s.Call) and x.name.lower() in ("is_a", "isa") and len(x.args) == 2}
        for var, name in sorted(tests):
            self.variable(var)
            members = self.space.class_set().filter(F.col("class") == name).select(F.col("vid").alias("_member"), F.lit(True).alias(is_a_column(var, name)))
            frame = frame.join(members, F.col(f"{var}__vid") == F.col("_member"), "left").drop("_member")
        return frame

    def run(self) -> DataFrame:
        q = self.query
        frame = self.with_classes(self.frame())
        compiler = Compiler(Mode.MATCH, self.resolve(frame))
        if q.where is not None:
            frame = frame.filter(compiler.filter(q.where))
        if not q.items:
            shown = sorted(v for v in (*self.nodes, *self.edges) if not v.startswith("__anon"))
            result = frame.select(*[F.col(f"{v}__vid").alias(v) if v in self.nodes else compiler(s.Name(v)).col.alias(v) for v in shown])
        elif q.group is not None or any(has_aggregate(i.expr) for i in q.items):
            result = aggregate(frame, compiler, q, columns_of, self.identity)
        else:
            result = frame.select(*[compiler(i.expr).col.alias(i.alias or columns_of(i.expr)) for i in q.items])
        if q.order:
            names = [i.alias or columns_of(i.expr) for i in q.items]
            keys = []
            for e, down in q.order:
                at = next((n for n, i in zip(names, q.items, strict=True) if isinstance(e, s.Name) and i.alias == e.name), None) or next(n for n, i in zip(names, q.items, strict=True) if i.expr == e)
                keys.append(F.col(f"`{at}`").desc_nulls_first() if down else F.col(f"`{at}`").asc_nulls_last())
            result = result.orderBy(*keys)
        if q.offset:
            result = result.offset(q.offset)
        return result if q.limit is None else result.limit(q.limit)

    def identity(self, e) -> Column | None:
        """What a grouping key compares by: a vertex by its id, an edge by its identity."""
        if isinstance(e, s.Name) and e.name in self.nodes:
            return F.col(f"{e.name}__vid")
        return None


def is_a_column(var: str, name: str) -> str:
    return f"{var}__isa__{name}"


def run_match(space: Space, query: s.Match) -> DataFrame:
    return Matcher(space, query).run()


__all__ = ["AGGREGATES", "Matcher", "run_match"]
