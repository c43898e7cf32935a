"""RECOMMEND: similar vertices by shared neighbours, by embeddings, or by both."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions.expressions import Compiler, Mode, Typed, kind_of
from knotwork.plans import syntax as s
from knotwork.sources.graph import Space, union_all


def jaccard(space: Space, seed: int, over) -> DataFrame:
    """(vid, score, shared): vertices that share a neighbour with the seed, over the union of the edge types.

    The seed's neighbours meet the edges on their end, so only edges into them are counted, and the degrees are taken of
    the candidates alone.
    """
    pairs = space.edges_of(over).select("src", "dst").distinct()
    own = pairs.filter(F.col("src") == seed).select("dst")
    shared = pairs.filter(F.col("src") != seed).join(own, "dst", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("shared"))
    degrees = pairs.join(shared.select("src"), "src", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    seed_degree = own.agg(F.count(F.lit(1)).alias("own"))
    # the seed's degree is one row
    joined = shared.join(degrees, "src").crossJoin(F.broadcast(seed_degree))
    return joined.select(F.col("src").alias("vid"), (F.col("shared") / (F.col("degree") + F.col("own") - F.col("shared"))).alias("score"), "shared")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers of equal length; null where the lengths differ or one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def vectors_of(space: Space, prop: str) -> DataFrame:
    """(vid, vector) of all vertices that have this property."""
    tags = [t for t in space.tags if any(f.name == prop for f in space.tags[t].fields)]
    if not tags:
        raise QueryError(f"there is no property {prop}")
    # a property that is not declared as a vector, and was given none, holds none
    frames = [f for f in (space.tag(t).select("vid", F.col(f"`{prop}`").alias("vector")) for t in tags) if dict(f.dtypes)["vector"].startswith("array")]
    if not frames:
        return space.spark.createDataFrame([], f"vid {space.vid_sql}, vector array<float>")
    return union_all([f.withColumn("vector", F.col("vector").cast("array<float>")) for f in frames]).filter("vector is not null")


def embedding_scores(space: Space, seed: int, prop: str) -> DataFrame:
    """(vid, score) of all vertices with a vector of the seed's length; nothing if the seed has none.

    Exact, by a scan of the vectors; operators.vector_index searches a part of them.
    """
    vectors = vectors_of(space, prop)
    own = vectors.filter(F.col("vid") == seed).select(F.col("vector").alias("own")).limit(1)
    # the seed's vector is one row
    return vectors.filter(F.col("vid") != seed).crossJoin(F.broadcast(own)).select("vid", cosine(F.col("vector"), F.col("own")).alias("score")).filter("score is not null")


def run_recommend(space: Space, q: s.Recommend) -> DataFrame:
    if space.vid_type != "INT64":
        raise QueryError("RECOMMEND needs integer ids")
    q = replace(q, seed=space.standing([q.seed])[q.seed])
    if q.embedding and q.structural:
        near = embedding_scores(space, q.seed, q.embedding).withColumnRenamed("score", "emb")
        alike = jaccard(space, q.seed, q.over).select("vid", F.col("score").alias("struct"))
        rows = near.join(alike, "vid", "full").select("vid", F.coalesce("emb", F.lit(0.0)).alias("emb"), F.coalesce("struct", F.lit(0.0)).alias("struct"))
        score = q.embedding_weight * F.greatest(F.col("emb"), F.lit(0.0)) + q.over_weight * F.col("struct")
        rows, order = rows.select("vid", score.alias("score"), "emb", "struct"), [F.col("score").desc(), F.col("vid").asc()]
    elif q.embedding:
        rows, order = embedding_scores(space, q.seed, q.embedding), [F.col("score").desc(), F.col("vid").asc()]
    else:
        rows, order = jaccard(space, q.seed, q.over), [F.col("score").desc(), F.col("shared").desc(), F.col("vid").asc()]
    shown = rows.columns
    if q.where is not None:
        rows = filtered(space, rows, q)
    return rows.orderBy(*order).limit(q.limit).select(*shown)


def filtered(space: Space, rows: DataFrame, q: s.Recommend) -> DataFrame:
    """rows whose candidate fits WHERE; what cannot be evaluated does not fit."""
    names = {x.name for x in s.walk(q.where) if isinstance(x, s.Name | s.Prop)}
    known: dict[str, list[str]] = {n: [t for t in space.tags if any(f.name == n for f in space.tags[t].fields)] for n in names}
    for prefix, only in (("_c_", None), ("_s_", q.seed)):
        for t in space.tags:
            props = sorted(n for n in names if t in known[n])
            if not props:
                continue
            own = space.tag(t).select(F.col("vid").alias("_vid"), *[F.col(f"`{p}`").alias(f"{prefix}{t}_{p}") for p in props])
            if only is None:
                rows = rows.join(own, rows["vid"] == F.col("_vid"), "left").drop("_vid")
            else:
                # the seed's properties are one row
                one = own.filter(F.col("_vid") == only).drop("_vid").limit(1)
                rows = rows.join(F.broadcast(one), F.lit(True), "left")
    tests = {x.args[0].value for x in s.walk(q.where) if isinstance(x, s.Call) and x.name.lower() in ("is_a", "isa") and len(x.args) == 1}
    for name in sorted(tests):
        members = space.class_set().filter(F.col("class") == name).select(F.col("vid").alias("_vid"), F.lit(True).alias(f"_isa_{name}"))
        rows = rows.join(members, rows["vid"] == F.col("_vid"), "left").drop("_vid")
    kinds = {f.name: kind_of(f.dataType) for f in rows.schema.fields}

    def resolve(e):
        if isinstance(e, s.Call) and e.name.lower() in ("is_a", "isa") and len(e.args) == 1:
            return Typed(F.coalesce(F.col(f"_isa_{e.args[0].value}"), F.lit(False)), "bool")
        if isinstance(e, s.Name | s.Prop):
            seed = isinstance(e, s.Prop) and e.owner == "seed"
            tags = known[e.name] if isinstance(e, s.Name) or seed else [t for t in known[e.name] if t == space.tag_name(e.owner)]
            if not tags:
                return Typed(F.lit(None), "null")
            cols = [f"{'_s_' if seed else '_c_'}{t}_{e.name}" for t in tags]
            return Typed(F.coalesce(*[F.col(f"`{c}`") for c in cols]), kinds[cols[0]])
        return None

    # a candidate that lacks a property named in WHERE cannot be evaluated
    for x in s.walk(q.where):
        if isinstance(x, s.Name) or isinstance(x, s.Prop) and x.owner != "seed":
            rows = rows.filter(resolve(x).col.isNotNull())
    try:
        return rows.filter(Compiler(Mode.EVAL, resolve).condition(q.where))
    except QueryError:
        return rows.limit(0)
