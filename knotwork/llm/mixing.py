"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions.

Each document draws the exponential key -ln(u) / quality, u from a hash of its id, so reruns agree. A source whose target
is m times its size plus a rest gives every document m times (complete epochs); the rest goes to the documents with the
smallest keys, prefix-summed until the budget. The prefix sum of a source never runs in one task: sizes are summed in
stretches of the logarithm of the key, the stretch in which the budget ends is cut again until it holds few rows or equal
keys alone, and only that one is ordered row by row. Rows equal in key, id and size are counted, not ordered, so no
stretch is long whatever the weights and however often a row repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import WORD, materialize
from knotwork.sources.graph import rounds

#: No document is taken more often than this, and so no source gives more than this times its size.
MOST_EPOCHS = 3
#: Rows that a source's last stretch of keys may hold, and the stretches into which one is cut.
STRETCH_ROWS, STRETCHES = 2_000, 256
#: Groups of equal rows in last stretches that are sent to all executors; with more of them they are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_length_quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: 1 where the mean word has 5 characters, less the further it is from that; 1 for no words."""
    mean = F.length(text) / size - 1
    return F.when(size > 0, 1 / (1 + F.abs(F.coalesce(mean, F.lit(5.0)) - 5) / 5)).otherwise(F.lit(1.0))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the id."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, cycle: int = 3, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source, source_size) with target: the whole size shared by weight, none above most times its source.

    Sources in code point order, null last, weigh 1, 2, ..., cycle, repeating. A source is held at its cap when cap / weight
    is at most the level to which water would rise, so one pass over the sources in that order replaces the rounds of
    resharing. The table has one row per source; both windows run over that table alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("level", left / weights).withColumn("free", F.col("level") < F.col("cap") / F.col("weight"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)
    target = F.when(F.col("free"), F.col("weight") * level["level"]).otherwise(F.col("cap"))
    return t.select("source", "source_size", target.alias("target"))


def drawn(docs: DataFrame, id_col: str, source_col: str, text_col: str, quality, seed: int) -> DataFrame:
    """docs with _mix_id, _mix_source, _mix_size, _mix_key and _mix_place, the logarithm of the key."""
    size = word_count(docs[text_col])
    key = -F.log(uniform(docs[id_col], seed)) / F.greatest(quality(docs[text_col], size), F.lit(1e-6))
    rows = docs.withColumns({"_mix_id": docs[id_col], "_mix_source": docs[source_col], "_mix_size": size, "_mix_key": key})
    return rows.withColumn("_mix_place", F.log("_mix_key"))


def last_stretches(rows: DataFrame, plan: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """plan with low, high and before: the places of the stretch in which each source's rest ends, and the sizes below it.

    A round cuts each stretch in STRETCHES of equal width and goes on with one; its ends are then those of the rows in it,
    so a stretch whose keys differ gets smaller in every round. Sources without a rest have nulls.
    """
    keyed = rows.select("_mix_source", "_mix_size", "_mix_place")
    ends = plan.filter("rest > 0").select(F.col("source").alias("_source"), "rest")
    own = F.col("_mix_source").eqNullSafe(F.col("_source"))
    # one row per source in every round, so these joins are broadcast while the sources fit the session's threshold
    state = keyed.join(ends, own).groupBy("_source", "rest").agg(F.min("_mix_place").alias("low"), F.max("_mix_place").alias("high"), F.count(F.lit(1)).alias("n"))
    state = materialize(state.withColumn("before", F.lit(0).cast("long")), "stretches")
    done, n = [], 0
    while True:
        done.append(state.filter(f"n <= {stretch_rows} or low >= high"))
        open_ = state.filter(f"n > {stretch_rows} and low < high")
        if open_.isEmpty():
            break
        at = F.least(F.floor((F.col("_mix_place") - F.col("low")) / (F.col("high") - F.col("low")) * STRETCHES), F.lit(STRETCHES - 1))
        inside = keyed.join(open_.drop("n"), own & F.col("_mix_place").between(F.col("low"), F.col("high")))
        sums = inside.groupBy("_source", "rest", "before", at.alias("at")).agg(F.sum("_mix_size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("_mix_place").alias("low"), F.max("_mix_place").alias("high"))
        # STRETCHES rows per source
        upto = Window.partitionBy("_source").orderBy("at")
        sums = sums.withColumn("upto", F.col("before") + F.sum("size").over(upto))
        last = F.min(F.when(F.col("upto") >= F.col("rest"), F.col("at"))).over(Window.partitionBy("_source"))
        sums = sums.withColumn("last", F.coalesce(last, F.max("at").over(Window.partitionBy("_source")))).filter("at = last")
        n += 1
        state = materialize(sums.select("_source", "rest", "low", "high", "n", (F.col("upto") - F.col("size")).alias("before")), f"stretches-{n}")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return plan.join(found.drop("rest", "n"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def taken_groups(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(g_source, g_key, g_id, g_size, n, k): groups of equal rows in last stretches of which k > 0 of n are taken once more."""
    edge = rows.join(plan, F.col("_mix_source").eqNullSafe(F.col("source"))).filter("_mix_place between low and high")
    groups = edge.groupBy("_mix_source", "_mix_key", "_mix_id", "_mix_size", "rest", "before").agg(F.count(F.lit(1)).alias("n"))
    prefix = Window.partitionBy("_mix_source").orderBy("_mix_key", "_mix_id", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("_mix_size") * F.col("n")).over(prefix), F.lit(0)))
    fits = lambda j: F.col("at") + j * F.col("_mix_size") + F.col("_mix_size") / 2 <= F.col("rest")
    guess = F.floor((F.col("rest") - F.col("at") - F.col("_mix_size") / 2) / F.col("_mix_size"))
    # the guess may be one off for rounding: of rows 0, 1, ... all up to the last that fits are taken
    last = F.when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(guess - 1)
    k = F.when(F.col("_mix_size") > 0, F.greatest(F.least(last + 1, F.col("n")), F.lit(0))).otherwise(F.lit(0)).cast("long")
    return groups.select(F.col("_mix_source").alias("g_source"), F.col("_mix_key").alias("g_key"), F.col("_mix_id").alias("g_id"), F.col("_mix_size").alias("g_size"), "n", k.alias("k")).filter("k > 0")


def with_copies(rows: DataFrame, plan: DataFrame, groups: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """rows of drawn() with the columns of plan and _mix_copies, how often each is taken."""
    found = groups.count()
    groups = F.broadcast(groups) if found <= broadcast_groups else groups
    rows = rows.withColumn("_mix_file", F.input_file_name()).join(plan, F.col("_mix_source").eqNullSafe(F.col("source")))
    same = F.col("_mix_source").eqNullSafe(F.col("g_source")) & (F.col("_mix_key") == F.col("g_key")) & F.col("_mix_id").eqNullSafe(F.col("g_id")) & (F.col("_mix_size") == F.col("g_size"))
    inside = F.col("_mix_place").between(F.col("low"), F.col("high"))
    rows = rows.join(groups, inside & same, "left")
    extra = F.when(inside, F.coalesce(F.col("k") >= F.col("n"), F.lit(False))).otherwise(F.coalesce(F.col("_mix_place") < F.col("low"), F.lit(False)))
    part = "n is not null and k < n"
    if not groups.filter(part).isEmpty():
        # equal rows of which some are taken: numbered in each file, behind the rows of the files before
        cut = rows.filter(part)
        key = ["g_source", "g_key", "g_id", "g_size"]
        files = cut.groupBy(*key, "_mix_file").agg(F.count(F.lit(1)).alias("_in_file"))
        files = files.withColumn("_before", F.coalesce(F.sum("_in_file").over(Window.partitionBy(*key).orderBy("_mix_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        number = F.row_number().over(Window.partitionBy(*key, "_mix_file").orderBy(F.lit(1)))
        cut = cut.withColumn("_number", number).alias("c").join(files.alias("f"), [F.col(f"c.{x}").eqNullSafe(F.col(f"f.{x}")) for x in (*key, "_mix_file")])
        cut = cut.select("c.*", (F.col("_number") + F.col("_before") <= F.col("k")).alias("_extra")).drop("_number")
        rows = rows.filter(f"not coalesce({part}, false)").withColumn("_extra", extra).unionByName(cut)
    else:
        rows = rows.withColumn("_extra", extra)
    more = F.col("_extra") & (F.col("_mix_size") > 0) & (F.col("epochs") < MOST_EPOCHS)
    return rows.withColumn("_mix_copies", F.col("epochs") + more.cast("long"))


def planned(rows: DataFrame, stretch_rows: int = STRETCH_ROWS, keep: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, groups) for rows of drawn(): per source its size, target, epochs and last stretch; see taken_groups()."""
    sizes = rows.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("_mix_size").alias("source_size"))
    plan = targets(sizes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    plan = plan.withColumn("epochs", F.least(whole, F.lit(MOST_EPOCHS)).cast("long"))
    plan = materialize(plan.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))), "plan")
    plan = materialize(last_stretches(rows, plan, stretch_rows), "ends", keep)
    return plan, materialize(taken_groups(rows, plan), "groups", keep)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality=word_length_quality, seed: int = 42, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, target, copies, taken = copies * size.

    size is the number of words; null text: 0. A null source is a source of its own. Documents without words are given
    whole epochs only. A document joins the rest when the middle of its stretch in the prefix sum lies within the budget,
    so a source misses its target by at most half a document. Equal keys are ordered by id and size; rows equal in both
    are interchangeable. An empty table gives an empty result; other columns are not read.
    """
    names = ["_mix_id", "_mix_source", "_mix_size", "_mix_key", "_mix_place"]
    with rounds() as keep:
        rows = materialize(drawn(docs, id_col, source_col, text_col, quality, seed).select(*names), "sizes", keep)
        plan, groups = planned(rows, stretch_rows, keep)
    out = with_copies(rows, plan, groups)
    out = out.select(F.col("_mix_id").alias(id_col), F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), F.col("_mix_copies").alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality=word_length_quality, seed: int = 42, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """docs with its own columns, each row as often as mix() takes it; the texts are not shuffled.

    Null texts, null ids and sources, ties, repeated rows and empty tables are as in mix(); columns of docs may have any
    names but those that begin with _mix_.
    """
    names = ["_mix_id", "_mix_source", "_mix_size", "_mix_key", "_mix_place"]
    made = lambda frame: drawn(frame, id_col, source_col, text_col, quality, seed)
    with rounds() as keep:
        plan, groups = planned(materialize(made(docs).select(*names), "sizes"), stretch_rows, keep)
    packed = made(docs).select(F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row"), *names)
    out = with_copies(packed, plan, groups).filter("_mix_copies > 0")
    return out.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*[F.col(f"_mix_row.`{c}`") for c in docs.columns])


#: The same mix with one prefix sum per source; levels and targets are computed in the same order.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(text) AS n FROM documents
), k AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
         / greatest(CASE WHEN size > 0 THEN 1 / (1 + abs(n::DOUBLE / size - 1 - 5) / 5) ELSE 1.0 END, 1e-6) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(size)::DOUBLE * 3 AS cap FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, level < cap / weight AS free FROM l),
t AS (
  SELECT source, source_size, CASE WHEN free THEN weight * (SELECT arg_min(level, cap / weight) FROM f WHERE free) ELSE cap END AS target FROM f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 1 END::BIGINT AS epochs FROM t
), x AS (
  SELECT k.*, source_size, target, epochs, greatest(target - epochs * source_size, 0) AS rest,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2 AS middle
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
), c AS (SELECT *, epochs + (rest > 0 AND middle <= rest AND size > 0 AND epochs < 3)::BIGINT AS copies FROM x)
SELECT doc_id, source, size, source_size, target::DOUBLE AS target, copies, size * copies AS taken FROM c
"""
