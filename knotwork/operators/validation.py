"""CHECK CONSISTENCY and CHECK SHAPE: vertices that break what the schema says of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions.expressions import Compiler, Mode, Typed, kind_of
from knotwork.plans import syntax as s
from knotwork.sources.graph import STORED, Space, union_all


def check_consistency(space: Space) -> DataFrame:
    """vid, class_a, class_b: vertices in two classes declared disjoint; the names in order, each pair once."""
    pairs = {tuple(sorted((c.name, d))) for c in space.classes.values() for d in c.disjoint}
    schema = f"vid {space.vid_sql}, class_a string, class_b string"
    if not pairs:
        return space.spark.createDataFrame([], schema)
    disjoint = F.broadcast(space.spark.createDataFrame(sorted(pairs), "class_a string, class_b string"))  # as small as the schema
    of = space.class_set()
    first = of.withColumnRenamed("class", "class_a").join(disjoint, "class_a")
    return first.join(of.withColumnRenamed("class", "class_b"), ["vid", "class_b"]).select("vid", "class_a", "class_b")


def shape_names(kinds: dict, on: str):
    def known(e):
        if isinstance(e, s.Name | s.Prop) and (isinstance(e, s.Name) or e.owner == on):
            return Typed(F.col(f"`{e.name}`"), kinds[e.name]) if e.name in kinds else Typed(F.lit(None), "null")
        return None

    return known


def check_shapes(space: Space, only: DataFrame | None = None, declared_only: bool = False) -> DataFrame:
    """vid, shape, property, constraint: what members of a shape's class lack or have wrong.

    A property is read from any tag of the vertex that declares it. A missing property breaks REQUIRED and CHECK, not the
    type; a check that cannot be evaluated counts as broken.
    """
    found = [space.spark.createDataFrame([], f"vid {space.vid_sql}, shape string, property string, constraint string")]
    for shape in space.shapes.values():
        names = {r[0] for r in shape.rules} | {x.name for r in shape.rules if r[1] == "check" for x in s.walk(r[2]) if isinstance(x, s.Name | s.Prop)}
        frame = space.class_set(declared_only).filter(F.col("class") == shape.on).select("vid")
        if only is not None:
            frame = frame.join(only, "vid", "left_semi")
        for name in sorted(names):
            tags = [t for t in space.tags if any(f.name == name for f in space.tags[t].fields)]
            if not tags:
                frame = frame.withColumn(name, F.lit(None).cast("string"))
                continue
            kind = space.property_kind([space.tags[t].fields for t in tags], name)
            values = union_all([space.tag(t).select(F.col("vid").alias("_vid"), F.col(f"`{name}`").cast(kind).alias(name)) for t in tags]).groupBy("_vid").agg(F.first(name, ignorenulls=True).alias(name))
            frame = frame.join(values, F.col("vid") == F.col("_vid"), "left").drop("_vid")
        kinds = {f.name: kind_of(f.dataType) for f in frame.schema.fields}
        for rule in shape.rules:
            name, value = rule[0], F.col(f"`{rule[0]}`")
            if rule[1] == "check":
                needed = [F.col(f"`{x.name}`").isNotNull() for x in s.walk(rule[2]) if isinstance(x, s.Name | s.Prop)]
                try:
                    holds = Compiler(Mode.EVAL, shape_names(kinds, shape.on)).condition(rule[2])
                    for n in needed:
                        holds = holds & n
                except QueryError:
                    holds = F.lit(False)
                found.append(violation(frame.filter(~holds), shape.name, name, "CHECK"))
                continue
            if rule[2]:
                found.append(violation(frame.filter(value.isNull()), shape.name, name, "REQUIRED"))
            if rule[1]:
                wanted = {"long": "int", "double": "float", "string": "string", "boolean": "bool"}[STORED[rule[1]]]
                fits = kinds[name] == wanted or (wanted == "float" and kinds[name] == "int")
                if not fits:
                    found.append(violation(frame.filter(value.isNotNull()), shape.name, name, rule[1]))
    return union_all(found)


def violation(rows: DataFrame, shape: str, prop: str, constraint: str) -> DataFrame:
    return rows.select("vid", F.lit(shape).alias("shape"), F.lit(prop).alias("property"), F.lit(constraint).alias("constraint"))
