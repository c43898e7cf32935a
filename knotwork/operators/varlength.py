"""Variable-length expansion: the distinct ends of simple paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.sources.graph import cut, union_all

def reachable(starts: DataFrame, steps: DataFrame, low: int, high: int) -> DataFrame:
    """(_from, _to): ends of simple paths of low to high steps; a path never returns to its start.

    With low at most 1 the ends are what breadth-first search finds, so no path is kept; above, paths are. The steps are
    written once where more than one round reads them; what a round finds is written once and never again.
    """
    if high > 1:
        steps = cut(steps)
    steps = steps.select(F.col("_from").alias("_a"), F.col("_to").alias("_b"))
    if low <= 1:
        frontier = starts.select(F.col("vid").alias("_from"), F.col("vid").alias("_to"))
        seen = [frontier]
        for n in range(1, high + 1):
            new = frontier.join(steps, F.col("_to") == F.col("_a")).select("_from", F.col("_b").alias("_to")).distinct()
            frontier = new.join(union_all(seen), ["_from", "_to"], "left_anti")
            if n < high:
                frontier = cut(frontier)
                if frontier.isEmpty():
                    break
            seen.append(frontier)
        return union_all(seen).filter("_from <> _to")
    paths = starts.select(F.col("vid").alias("_from"), F.col("vid").alias("_to"), F.array("vid").alias("path"))
    ends = []
    for n in range(1, high + 1):
        paths = paths.join(steps, (F.col("_to") == F.col("_a")) & ~F.array_contains("path", F.col("_b")))
        paths = paths.select("_from", F.col("_b").alias("_to"), F.concat("path", F.array("_b")).alias("path"))
        if n < high:
            paths = cut(paths)
            if paths.isEmpty():
                break
        if n >= low:
            ends.append(paths.select("_from", "_to"))
    return union_all(ends).distinct() if ends else paths.select("_from", "_to").limit(0)
