"""Sessions: text in, DataFrame out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from knotwork.errors import QueryError
from knotwork.operators import closure, mutation, schema, validation
from knotwork.operators.explain import explain
from knotwork.operators.go import run_go
from knotwork.operators.lookup import run_fetch, run_lookup
from knotwork.operators.match import run_match
from knotwork.operators.paths import run_find
from knotwork.operators.recommend import run_recommend
from knotwork.plans import syntax as s
from knotwork.plans.parser import parse
from knotwork.sources.graph import Space

READS = (s.Match, s.Go, s.Fetch, s.Lookup, s.Find, s.Recommend, s.Why, s.Show, s.Describe, s.Use)
MUTATIONS = {s.InsertVertex: (mutation.insert_vertices, "Inserted"), s.InsertEdge: (mutation.insert_edges, "Inserted"), s.Update: (mutation.update, "Updated"), s.DeleteVertex: (mutation.delete_vertices, "Deleted"), s.DeleteEdge: (mutation.delete_edges, "Deleted")}
DERIVED_BUDGET = 100_000


class Session:
    """Spaces by name and the one in use. Statements of one script run in order; the last result is returned.

    A space with a store (see sources.store) is committed to it by every statement that changes the space. scan_limit and
    work_limit bound the vertices that a pattern without a label may scan and that FIND may reach; None sets no bound.
    """

    def __init__(
        self, spark: SparkSession, spaces: dict[str, Space] | None = None, use: str | None = None, clock=lambda: int(time.time() * 1000),
        derived_budget: int | None = DERIVED_BUDGET, scan_limit: int | None = None, work_limit: int | None = None, stores: dict | None = None,
    ):
        self.spark, self.spaces, self.clock, self.derived_budget = spark, dict(spaces or {}), clock, derived_budget
        self.scan_limit, self.work_limit, self.stores = scan_limit, work_limit, dict(stores or {})
        for name, store in self.stores.items():
            if name not in self.spaces:
                self.spaces[name] = store.open()
        self.current = use or next(iter(self.spaces), None)
        self.last_tx = 0

    @property
    def space(self) -> Space:
        if self.current not in self.spaces:
            raise QueryError("no space is in use")
        space = self.spaces[self.current]
        space.scan_limit, space.work_limit = self.scan_limit, self.work_limit
        return space

    def execute(self, text: str, read_only: bool = False) -> DataFrame:
        """Runs a script. With read_only a script with any clause that changes something is refused as a whole."""
        script = parse(text)
        if read_only:
            for _, q in script.clauses:
                inner = q.statement if isinstance(q, s.Explain) else q
                if not isinstance(inner, READS) and not (isinstance(inner, s.Check) and inner.what != "REPAIR"):
                    raise QueryError("the session may only read")
        variables: dict[str, DataFrame] = {}
        result = None
        for var, q in script.clauses:
            found = self.run(q, variables)
            if var is None:
                result = found
            else:
                variables[var] = found
        return result if result is not None else found

    def run(self, q, variables: dict[str, DataFrame]) -> DataFrame:
        if isinstance(q, s.Unsupported):
            raise QueryError(f"{q.what} is not supported")
        if isinstance(q, s.Use):
            if q.name not in self.spaces:
                raise QueryError(f"there is no space {q.name}")
            self.current = q.name
            return self.status("Used")
        if isinstance(q, s.Create) and q.kind == "space":
            return self.create_space(q)
        if isinstance(q, s.Drop) and q.kind == "space":
            if q.name not in self.spaces and not q.quiet:
                raise QueryError(f"there is no space {q.name}")
            self.spaces.pop(q.name, None)
            return self.status("Dropped")
        if isinstance(q, s.Show):
            return schema.show(self.spaces.get(self.current), self.spaces, q, self.spark)
        space = self.space
        if isinstance(q, s.Check):
            return self.check(q)
        if isinstance(q, s.Describe):
            return schema.describe(space, self.spaces, q)
        if isinstance(q, s.Explain):
            plain = isinstance(q.statement, s.Match | s.Lookup | s.Fetch)
            inner = self.run(q.statement, variables) if q.profile or plain else None
            return explain(space, q.statement, inner, q.profile)
        if type(q) in MUTATIONS:
            apply, word = MUTATIONS[type(q)]
            made, n = apply(space, q, self.tick())
            # derived facts follow from edges alone
            self.put(made, derive=isinstance(q, s.InsertEdge | s.DeleteEdge) or isinstance(q, s.Update) and q.edge)
            return self.spark.createDataFrame([(n,)], f"{word} long")
        for kind, apply in ((s.Create, schema.create), (s.Alter, schema.alter), (s.Drop, schema.drop)):
            if isinstance(q, kind):
                self.put(apply(space, q), derive=q.kind == "edge" and bool(space.edge_frames))
                return self.status("Done")
        if space.dirty:
            raise QueryError("derived facts are incomplete; REPAIR INFERENCE first")
        if isinstance(q, s.Match):
            return run_match(space, q)
        if isinstance(q, s.Go):
            return run_go(space, q, variables)
        if isinstance(q, s.Fetch):
            return run_fetch(space, q, variables)
        if isinstance(q, s.Lookup):
            return run_lookup(space, q)
        if isinstance(q, s.Find):
            return run_find(space, q)
        if isinstance(q, s.Recommend):
            return run_recommend(space, q)
        if isinstance(q, s.Why):
            return closure.explain_fact(space, q.source, q.target, q.over)
        raise QueryError(f"{type(q).__name__} is not supported")

    def discover(self, name: str | None = None) -> str:
        """The schema of a space (of that in use) as JSON for programs, within fixed limits."""
        name = name or self.current
        if name not in self.spaces:
            raise QueryError(f"there is no space {name}")
        return schema.discovery(self.spaces[name])

    def tick(self) -> int:
        """A time later than that of any change before."""
        self.last_tx = max(self.last_tx + 1, self.clock())
        return self.last_tx

    def put(self, space: Space, derive: bool = True) -> None:
        """The changed space takes the old one's place; with derive, what its rules entail is made anew."""
        try:
            self.spaces[space.name] = closure.materialize_rules(space, self.derived_budget) if derive else space
        except QueryError:
            space.dirty = True
            self.spaces[space.name] = space
            raise
        finally:
            store = self.stores.get(space.name)
            if store is not None:
                self.spaces[space.name] = store.commit(self.spaces[space.name])

    def check(self, q: s.Check) -> DataFrame:
        space = self.space
        if q.what == "CONSISTENCY":
            return validation.check_consistency(space)
        if q.what == "SHAPE":
            return validation.check_shapes(space)
        if q.what == "REPAIR":
            self.put(space)
        elif q.what != "INFERENCE":
            raise QueryError(f"CHECK {q.what} is not known")
        return self.spark.createDataFrame([(space.name, "incomplete" if self.space.dirty else "complete")], "space string, status string")

    def create_space(self, q: s.Create) -> DataFrame:
        if q.name in self.spaces:
            if q.quiet:
                return self.status("Exists")
            raise QueryError(f"space {q.name} exists")
        o = q.options
        self.spaces[q.name] = Space(q.name, self.spark, o.get("vid_type", "INT64"), o.get("vid_length"), o.get("partition_num", 100), o.get("replica_factor", 1), o.get("partition_by", "HASH"), tuple(o.get("boundaries", ())))
        self.current = self.current or q.name
        return self.status("Created")

    def status(self, word: str) -> DataFrame:
        return self.spark.createDataFrame([(word,)], "Result string")
