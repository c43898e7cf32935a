"""Property graphs as DataFrames: one frame per tag and per edge type, and the schema that describes them.

A space holds its frames lazily: a frame may be given as a function and is only made when a query needs it. A space is
changed by putting new frames in the place of old ones, so a statement that fails leaves it as it was. Changes of a frame
are kept beside it (see Layered) and written out now and then, so its plan does not grow with the number of statements.
"""

from __future__ import annotations

import atexit
import contextlib
import copy
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.errors import QueryError

#: Declared types and how they are stored; whole numbers have one width, temporal values are kept as given.
STORED = {
    "BOOL": "boolean", "INT8": "long", "INT16": "long", "INT32": "long", "INT64": "long", "INT": "long", "FLOAT": "double", "DOUBLE": "double",
    "STRING": "string", "TIMESTAMP": "long", "DATE": "string", "TIME": "string", "DATETIME": "string", "VECTOR": "array<float>",
}
EDGE_KEY = ("src", "dst", "rank")


@dataclass
class FieldDef:
    name: str
    kind: str
    nullable: bool = True
    default: object = None

    @property
    def stored(self) -> str:
        return STORED[self.kind]


@dataclass
class TagDef:
    name: str
    fields: list[FieldDef]
    version: int = 0


@dataclass
class EdgeDef:
    name: str
    fields: list[FieldDef]
    symmetric: bool = False
    transitive: bool = False
    inverse: str | None = None
    sub: tuple = ()
    equivalent: tuple = ()
    chain: tuple | None = None
    domain: str | None = None
    range: str | None = None
    version: int = 0


@dataclass
class ClassDef:
    name: str
    parents: tuple = ()
    equivalent: tuple = ()
    disjoint: tuple = ()


@dataclass
class ShapeDef:
    name: str
    on: str
    rules: tuple = ()


@dataclass
class IndexDef:
    name: str
    kind: str
    on: str
    fields: tuple


def scratch_dir(spark: SparkSession) -> str:
    """The URI of the folder that the driver and all executors share; a folder of this machine's own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise QueryError("spark.checkpoint.dir names no folder that the executors share")
        found = "file:///tmp/checkpoints"
    return (found if "://" in found else f"file://{found}").rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def drop_rounds(since: int = 0) -> None:
    """Deletes what cut() has written, or only what it wrote after `since` others; frames that still read it stop working."""
    while len(_written) > since:
        remove(*_written.pop())


@contextlib.contextmanager
def rounds():
    """Deletes what cut() wrote inside, but for the paths that the caller takes out of the list given."""
    since, kept = len(_written), []
    try:
        yield kept
    finally:
        own = _written[since:]
        del _written[since:]
        for spark, path in own:
            if path in kept:
                _written.append((spark, path))
            else:
                remove(spark, path)


def cut(df: DataFrame, keep: list | None = None) -> DataFrame:
    """df written to the shared folder and read back: what a loop goes on with, without the rounds that made it.

    With `keep`, the list of an enclosing rounds(), the folder outlives it.
    """
    path = f"{scratch_dir(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Changes after which they are written out, and the rows of changes at which a frame is written anew with them.
CUT_STEPS, MERGE_ROWS = 8, 1_000_000
UNION_SETTING = "spark.sql.unionOutputPartitioning"


@dataclass
class Layered:
    """A frame with later changes: the rows of base whose key has no change, and the changes that are no deletions."""

    base: DataFrame
    changes: DataFrame
    keys: tuple
    steps: int = 1

    def frame(self) -> DataFrame:
        kept = self.base.join(self.changes.select(*self.keys), list(self.keys), "left_anti")
        return kept.unionByName(self.changes.filter("not _gone").drop("_gone")).select(*[F.col(f"`{c}`") for c in self.base.columns])

    def changed(self, latest: DataFrame) -> Layered:
        keys = list(self.keys)
        changes = latest if self.changes is None else self.changes.join(latest.select(*keys), keys, "left_anti").unionByName(latest)
        made = Layered(self.base, changes, self.keys, self.steps + 1)
        if made.steps < CUT_STEPS:
            return made
        made.changes, made.steps = cut(changes), 0
        if made.changes.count() > MERGE_ROWS:
            made.base, made.changes = cut(made.frame()), made.changes.limit(0)
        return made


@dataclass
class Space:
    """A graph: schema, frames, derived types, identities and history."""

    name: str
    spark: SparkSession
    vid_type: str = "INT64"
    vid_length: int | None = None
    partition_num: int = 100
    replica_factor: int = 1
    partition_by: str = "HASH"
    boundaries: tuple = ()
    tags: dict[str, TagDef] = field(default_factory=dict)
    edges: dict[str, EdgeDef] = field(default_factory=dict)
    classes: dict[str, ClassDef] = field(default_factory=dict)
    shapes: dict[str, ShapeDef] = field(default_factory=dict)
    indexes: dict[str, IndexDef] = field(default_factory=dict)
    tag_frames: dict[str, DataFrame | Callable] = field(default_factory=dict)
    edge_frames: dict[str, DataFrame | Callable] = field(default_factory=dict)
    tag_history: dict[str, DataFrame | Callable] = field(default_factory=dict)
    edge_history: dict[str, DataFrame | Callable] = field(default_factory=dict)
    derived: dict[str, DataFrame] = field(default_factory=dict)
    same: DataFrame | None = None
    inferred_types: DataFrame | None = None
    provenance: DataFrame | None = None
    dirty: bool = False
    #: By tag the least and greatest id that its vertices may have, where it is known.
    spans: dict[str, tuple] = field(default_factory=dict)
    #: Vertices that a scan without a label may read and that FIND may reach; None sets no limit.
    scan_limit: int | None = None
    work_limit: int | None = None

    def __post_init__(self):
        # a union that takes over its inputs' partitioning fails where AQE has given them different numbers of partitions
        # ("Can't zip RDDs", Spark 4.1), as it does for frames with changes
        if self.spark.conf.get(UNION_SETTING, None) is None:
            self.spark.conf.set(UNION_SETTING, "false")

    @property
    def vid_sql(self) -> str:
        return "long" if self.vid_type == "INT64" else "string"

    def copy(self) -> Space:
        """A space that shares all frames, for a statement to work on."""
        made = Space(**self.__dict__)
        for name, value in self.__dict__.items():
            if name in ("tags", "edges"):
                setattr(made, name, copy.deepcopy(value))  # a statement may change declarations and then fail
            elif isinstance(value, dict):
                setattr(made, name, dict(value))
        return made

    # --- names ---

    def tag_name(self, name: str) -> str | None:
        """The declared tag of this name; labels are matched without regard to case."""
        return name if name in self.tags else next((t for t in self.tags if t.lower() == name.lower()), None)

    def edge_names(self, wanted) -> list[str]:
        """The declared types of OVER or a pattern; undeclared ones have no edges."""
        return list(self.edges) if not wanted else [e for e in self.edges if e in wanted]

    # --- frames ---

    def tag(self, name: str) -> DataFrame:
        """(vid, properties...) of a tag."""
        return self._frame(self.tag_frames, name, f"vid {self.vid_sql}", self.tags[name].fields)

    def asserted(self, name: str) -> DataFrame:
        """edge(name) without derived edges."""
        return self._frame(self.edge_frames, name, f"src {self.vid_sql}, dst {self.vid_sql}, rank long, inferred boolean", self.edges[name].fields)

    def edge(self, name: str) -> DataFrame:
        """(src, dst, rank, inferred, properties...) of an edge type; derived edges have rank 0 and no properties."""
        own = self.asserted(name)
        if name not in self.derived:
            return own
        return own.unionByName(self.derived[name].select("src", "dst", F.lit(0).cast("long").alias("rank"), F.lit(True).alias("inferred")), allowMissingColumns=True)

    def _frame(self, frames: dict, name: str, key: str, fields: list[FieldDef]) -> DataFrame:
        found = frames.get(name)
        if isinstance(found, Layered):
            return found.frame()
        if callable(found):
            found = frames[name] = found()
        if found is None:
            found = frames[name] = self.spark.createDataFrame([], ", ".join([key, *(f"`{f.name}` {f.stored}" for f in fields)]))
        return found

    def change(self, kind: str, name: str, gone: DataFrame | None, rows: DataFrame | None = None) -> None:
        """Takes the keys in `gone` out of a tag's or edge type's frame, or puts `rows` in, which replace those of their keys."""
        frames, keys = (self.tag_frames, ("vid",)) if kind == "tag" else (self.edge_frames, EDGE_KEY)
        view = self.tag(name) if kind == "tag" else self.asserted(name)
        if rows is None:
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in view.schema.fields if f.name not in keys]
            latest = gone.select(*keys).distinct().select(*keys, *blank, F.lit(True).alias("_gone"))
        else:
            latest = rows.withColumn("_gone", F.lit(False))
        found = frames.get(name)
        frames[name] = (found if isinstance(found, Layered) else Layered(view, None, keys, 0)).changed(latest)

    def may_hold(self, tag: str, vids) -> bool:
        """Whether a tag may have any of these vertices, by what is known of its ids."""
        span = self.spans.get(tag)
        return span is None or any(span[0] <= v <= span[1] for v in vids)

    def widen_span(self, tag: str, vids) -> None:
        """What is known of a tag's ids, with vertices added."""
        if tag in self.spans:
            low, high = self.spans[tag]
            self.spans[tag] = (min(low, *vids), max(high, *vids))

    def apart(self, a: str, b: str) -> bool:
        """Whether two tags surely share no vertex, by what is known of their ids."""
        x, y = self.spans.get(a), self.spans.get(b)
        return x is not None and y is not None and (x[1] < y[0] or y[1] < x[0])

    def vertices(self, once: bool = True, among=None) -> DataFrame:
        """(vid): all vertices; with once=False those of several tags may repeat, as a semi-join allows.

        With `among`, listed ids, only tags that may hold one of them are read.
        """
        names = [t for t in self.tags if among is None or self.may_hold(t, among)]
        if not names:
            return self.spark.createDataFrame([], f"vid {self.vid_sql}")
        every = union_all([self.tag(t).select("vid") for t in names])
        known_once = all(self.apart(a, b) for k, a in enumerate(names) for b in names[:k])
        return every.distinct() if once and not known_once else every

    def vertex_tags(self, names=None) -> DataFrame:
        """(vid, tag, at): the tags of each vertex, or those of `names`, and their order in the schema."""
        if not self.tags:
            return self.spark.createDataFrame([], f"vid {self.vid_sql}, tag string, at int")
        return union_all([self.tag(t).select("vid", F.lit(t).alias("tag"), F.lit(k).alias("at")) for k, t in enumerate(self.tags) if names is None or t in names])

    def edges_of(self, wanted, columns=(), asserted_only: bool = False) -> DataFrame:
        """(src, dst, rank, type, columns...) of the edge types wanted; a type without a column has null in it."""
        frames = []
        kinds = {c: self.property_kind([self.edges[n].fields for n in self.edge_names(wanted)], c) for c in columns}
        for name in self.edge_names(wanted):
            frame = self.asserted(name) if asserted_only else self.edge(name)
            own = {f.name for f in self.edges[name].fields}
            frames.append(frame.select(*EDGE_KEY, F.lit(name).alias("type"), *[(F.col(f"`{c}`") if c in own else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]))
        if not frames:
            return self.spark.createDataFrame([], f"src {self.vid_sql}, dst {self.vid_sql}, rank long, type string" + "".join(f", `{c}` string" for c in columns))
        return union_all(frames)

    @staticmethod
    def property_kind(fields: list[list[FieldDef]], name: str) -> str:
        """The stored type in which declarations of one property meet."""
        found = {f.stored for own in fields for f in own if f.name == name}
        return found.pop() if len(found) == 1 else "double" if found == {"long", "double"} else "string"

    def representative(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with the ids of merged vertices replaced by those that stand for them."""
        if self.same is None:
            return df
        for c in columns:
            mapped = self.same.select(F.col("vid").alias("_vid"), F.col("rep").alias("_rep"))
            df = df.join(mapped, df[c] == F.col("_vid"), "left").withColumn(c, F.coalesce("_rep", c)).drop("_vid", "_rep")
        return df

    def standing(self, values) -> dict:
        """{id: the id that stands for it} of listed ids."""
        found = {v: v for v in values}
        if self.same is not None and found:
            wanted = self.spark.createDataFrame([(v,) for v in found], f"vid {self.vid_sql}")
            found |= {r["vid"]: r["rep"] for r in self.same.join(F.broadcast(wanted), "vid", "left_semi").collect()}
        return found

    # --- classes ---

    def ancestors(self) -> dict[str, set[str]]:
        """Each class with all it is part of, itself included; the schema is small, so this is closed on the driver."""
        up: dict[str, set[str]] = {}
        for name in {*self.tags, *self.classes}:
            seen, todo = {name}, [name]
            while todo:
                c = self.classes.get(todo.pop())
                for n in (*c.parents, *c.equivalent) if c else ():
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
                for other in self.classes.values():
                    if other.name not in seen and set(other.equivalent) & seen:
                        seen.add(other.name)
                        todo.append(other.name)
            up[name] = seen
        return up

    def class_set(self, declared_only: bool = False) -> DataFrame:
        """(vid, class): tags and inferred types of each vertex with all ancestors, each once."""
        own = self.vertex_tags().select("vid", F.col("tag").alias("class"))
        if self.inferred_types is not None and not declared_only:
            own = own.unionByName(self.inferred_types.select("vid", "class"))
        pairs = [(c, a) for c, all_ in self.ancestors().items() for a in all_]
        if not pairs:
            return own
        closed = self.spark.createDataFrame(pairs, "class string, ancestor string")
        # the schema's closure is as small as the schema itself
        return own.join(F.broadcast(closed), "class", "left").select("vid", F.coalesce("ancestor", "class").alias("class")).distinct()

    def vids(self, values) -> DataFrame:
        """(pos, vid) of listed ids, which must be of the space's kind."""
        for v in values:
            if isinstance(v, str) == (self.vid_type == "INT64"):
                raise QueryError(f"{v!r} is no vertex id of this space")
            if isinstance(v, str) and self.vid_length and len(v.encode()) > self.vid_length:
                raise QueryError(f"{v!r} is longer than {self.vid_length} bytes")
        return self.spark.createDataFrame(list(enumerate(values)), f"pos long, vid {self.vid_sql}")


def require(found, what: str):
    if not found:
        raise QueryError(what)
    return found


def retyped_field(frame: DataFrame, f: FieldDef):
    """The field's column of frame in its declared type; null where the frame has none or the value does not fit."""
    if f.name not in frame.columns:
        return F.lit(None).cast(f.stored).alias(f.name)
    return F.col(f"`{f.name}`").try_cast(f.stored).alias(f.name)
