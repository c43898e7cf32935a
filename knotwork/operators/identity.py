"""Identity merge: vertices declared the same become one, named by the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.sources.graph import Space, cut, rounds

MAX_ROUNDS = 60


def representatives(pairs: DataFrame) -> DataFrame:
    """(vid, rep) for all ids in pairs (a, b): rep is the smallest id reachable.

    Star contraction by turns: every edge is drawn to the smallest neighbour of its ends until only stars are left, which
    takes rounds in the order of the logarithm of the longest chain.
    """
    with rounds() as keep:
        return cut(settled(pairs), keep)


def settled(pairs: DataFrame) -> DataFrame:
    e = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("t"))
        e = cut(small.select(F.col("t.x").alias("u"), F.col("t.m").alias("v")).filter("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            return e.select(F.col("u").alias("vid"), F.col("v").alias("rep")).unionByName(e.select(F.col("v").alias("vid"), F.col("v").alias("rep")).distinct())
        before = now
    raise QueryError("the identities did not settle")


def merge(space: Space, pairs: DataFrame) -> Space:
    """space with the vertices of pairs (a, b) merged into those merged before.

    Of each property the representative's own value stays; where it has none, the smallest member that has one gives it.
    Edges are drawn to the representatives, and of those that then coincide one stays; what rules derive is made anew.
    """
    made = space.copy()
    if space.same is not None:
        pairs = pairs.unionByName(space.same.select(F.col("vid").alias("a"), F.col("rep").alias("b")))
    made.same, made.spans = representatives(pairs), {}
    mapped = made.same.select(F.col("vid").alias("_vid"), F.col("rep").alias("_rep"))
    for t, tag in made.tags.items():
        frame = made.tag(t).join(mapped, F.col("vid") == F.col("_vid"), "left").withColumn("_rep", F.coalesce("_rep", "vid"))
        values = [F.min_by(F.col(f"`{f.name}`"), F.when(F.col(f"`{f.name}`").isNotNull(), F.col("vid"))).alias(f.name) for f in tag.fields]
        grouped = frame.groupBy("_rep").agg(*values, F.count(F.lit(1)).alias("_n"))
        made.tag_frames[t] = grouped.select(F.col("_rep").alias("vid"), *[F.col(f"`{f.name}`") for f in tag.fields])
    for n, edge in made.edges.items():
        frame = made.representative(made.asserted(n), "src", "dst")
        first = Window.partitionBy("src", "dst", "rank").orderBy(F.lit(0), *[F.col(f"`{f.name}`").asc_nulls_last() for f in edge.fields])
        made.edge_frames[n] = frame.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return made


def members(space: Space, vid) -> DataFrame:
    """(vid): all ids merged with this one, itself included."""
    if space.same is None:
        return space.vids([vid]).select("vid")
    rep = space.same.filter(F.col("vid") == F.lit(vid)).select("rep")
    found = space.same.join(rep, "rep", "left_semi").select("vid")
    return found.unionByName(space.vids([vid]).select("vid")).distinct()
