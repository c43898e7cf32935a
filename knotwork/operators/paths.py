"""FIND: shortest paths, all shortest paths and weighted paths, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.plans import syntax as s
from knotwork.sources.graph import Space, cut, rounds, union_all

DEFAULT_STEPS, MAX_STEPS, MAX_PATHS = 10, 20, 1024
MAX_ROUNDS = 10_000


def steps_of(space: Space, query: s.Find) -> DataFrame:
    """(a, b): the steps of the edge types, both ways for BIDIRECT; parallel edges repeat a step."""
    edges = space.edges_of((query.over,) if query.over else None).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if query.both:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges


def run_find(space: Space, query: s.Find) -> DataFrame:
    """One row per path, in the column path."""
    if query.weight and (query.both or query.every):
        raise QueryError("WEIGHT goes neither with BIDIRECT nor with ALL")
    if query.upto is not None and query.upto > MAX_STEPS:
        raise QueryError(f"FIND takes at most {MAX_STEPS} steps")
    space.vids([query.source, query.target])
    spark = space.spark
    if query.source == query.target:
        return spark.createDataFrame([([query.source],)], f"path array<{space.vid_sql}>")
    with rounds():
        # one row, or at most MAX_PATHS: they outlive the rounds that found them
        found = [(r["path"],) for r in paths_of(space, query).collect()]
    return spark.createDataFrame(found, f"path array<{space.vid_sql}>")


def paths_of(space: Space, query: s.Find) -> DataFrame:
    spark = space.spark
    if query.weight:
        return weighted(space, query).select("path")
    most = DEFAULT_STEPS if query.upto is None else query.upto
    steps = steps_of(space, query)
    if not query.every:
        return smallest(space, steps, query.source, query.target, most)
    levels, hops = search(space, steps, query.source, query.target, most)
    if hops is None:
        return spark.createDataFrame([], f"path array<{space.vid_sql}>")
    return trace(levels, steps, query.target, hops)


def expand(space: Space, level: DataFrame, steps: DataFrame, seen: DataFrame, made, target, spent: int):
    """(the next level, whether the target is in it, vertices reached so far); a level is written once."""
    new = cut(made(level.join(steps, F.col("v") == F.col("a"))).join(seen.select("v"), "v", "left_anti"))
    n, hit = new.agg(F.count(F.lit(1)), F.max(F.col("v") == F.lit(target))).first()
    spent += n
    if space.work_limit is not None and spent > space.work_limit:
        raise QueryError(f"FIND reaches more than {space.work_limit} vertices")
    return new, n, bool(hit), spent


def smallest(space: Space, steps: DataFrame, source, target, most: int) -> DataFrame:
    """(path): of several shortest paths the smallest by its vertices, which each vertex reached carries along."""
    spark, vid = space.spark, space.vid_sql
    level = spark.createDataFrame([(source, [source])], f"v {vid}, path array<{vid}>")
    seen, spent = [level.select("v")], 1
    onward = lambda met: met.groupBy(F.col("b").alias("v")).agg(F.min("path").alias("path")).select("v", F.concat("path", F.array("v")).alias("path"))
    for _ in range(most):
        level, n, hit, spent = expand(space, level, steps, union_all(seen), onward, target, spent)
        if hit:
            return level.filter(F.col("v") == F.lit(target)).select("path")
        if not n:
            break
        seen.append(level.select("v"))
    return spark.createDataFrame([], f"path array<{vid}>")


def search(space: Space, steps: DataFrame, source, target, most: int):
    """Breadth-first levels from source: ([frames (v)], hops to the target or None)."""
    level = space.spark.createDataFrame([(source,)], f"v {space.vid_sql}")
    levels, spent = [level], 1
    for hop in range(1, most + 1):
        level, n, hit, spent = expand(space, level, steps, union_all(levels), lambda met: met.select(F.col("b").alias("v")).distinct(), target, spent)
        levels.append(level)
        if hit:
            return levels, hop
        if not n:
            break
    return levels, None


def trace(levels: list[DataFrame], steps: DataFrame, target, hops: int) -> DataFrame:
    """(path): all ways back from the target through the levels, which are cut down to such ways hop by hop.

    Every way back goes on to the source, so there are never more of them than shortest paths.
    """
    paths = levels[hops].filter(F.col("v") == F.lit(target)).select(F.array("v").alias("path"))
    for k in range(hops - 1, -1, -1):
        heads = paths.select(F.col("path")[0].alias("b")).distinct()
        # the heads are at most MAX_PATHS
        back = steps.join(F.broadcast(heads), "b").select("a", "b").distinct().join(levels[k], F.col("a") == F.col("v")).select("v", "b")
        paths = cut(paths.join(back, F.col("path")[0] == F.col("b")).select(F.concat(F.array("v"), F.col("path")).alias("path")))
        if paths.limit(MAX_PATHS + 1).count() > MAX_PATHS:
            raise QueryError(f"there are more than {MAX_PATHS} shortest paths")
    return paths


def weighted(space: Space, query: s.Find) -> DataFrame:
    """(cost, path) of the cheapest path: rounds of relaxation over the vertices that the round before improved.

    A missing weight counts 1. Negative or endless weights on reached edges are an error. With UPTO a vertex is kept once
    for each number of hops, as a dearer but shorter way may still be needed.
    """
    spark, vid = space.spark, space.vid_sql
    edges = space.edges_of((query.over,) if query.over else None, (query.weight,) if any(f.name == query.weight for n in space.edge_names((query.over,) if query.over else None) for f in space.edges[n].fields) else ())
    cost = F.coalesce(F.col(f"`{query.weight}`").try_cast("double"), F.lit(1.0)) if query.weight in edges.columns else F.lit(1.0)
    edges = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), cost.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"), F.max(F.when(F.isnan("w") | (F.abs("w") == float("inf")), F.col("w"))).alias("bad")))
    start = spark.createDataFrame([(query.source, 0.0, [query.source], 0)], f"v {vid}, cost double, path array<{vid}>, hops int")
    best = frontier = start
    keys = ["v", "hops"] if query.upto is not None else ["v"]
    for hop in range(1, (query.upto or MAX_ROUNDS) + 1):
        met = frontier.join(edges, F.col("v") == F.col("a"))
        if not met.filter((F.col("w") < 0) | F.col("bad").isNotNull()).isEmpty():
            raise QueryError("a weight is negative or not finite")
        new = met.filter(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("v"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("b")).alias("path"), F.lit(hop).alias("hops"))
        new = new.groupBy(*keys).agg(F.min(F.struct("cost", "path")).alias("m"), *([] if "hops" in keys else [F.lit(hop).alias("hops")])).select("v", "m.cost", "m.path", "hops")
        old = best.groupBy("v").agg(F.min("cost").alias("old"))
        frontier = cut(new.join(old, "v", "left").filter("old is null or cost < old").drop("old"))
        if frontier.isEmpty():
            break
        rank = Window.partitionBy("v").orderBy("cost", "path")
        best = cut(best.unionByName(frontier).withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n"))
    return best.filter(F.col("v") == F.lit(query.target)).select("cost", "path")
