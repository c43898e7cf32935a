"""Point-in-time reads from an append-only history of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.sources.graph import CUT_STEPS, Space, cut

#: The end of validity of a version that no later one has ended.
FOREVER = 9223372036854775807


def versions_as_of(history: DataFrame, keys, moment: int) -> DataFrame:
    """Of each key the version valid and known at the moment: the latest by (valid_from, tx), unless it is a deletion."""
    seen = history.filter((F.col("tx") <= moment) & (F.col("valid_from") <= moment) & (F.col("valid_to") > moment))
    latest = Window.partitionBy(*keys).orderBy(F.col("valid_from").desc(), F.col("tx").desc())
    return seen.withColumn("_n", F.row_number().over(latest)).filter("_n = 1 and not deleted").drop("_n")


def as_of(space: Space, kind: str, name: str, moment: int) -> DataFrame:
    """The tag's or edge type's frame as it was at the moment."""
    histories, keys = (space.tag_history, ["vid"]) if kind == "tag" else (space.edge_history, ["src", "dst", "rank"])
    found = known(histories.get(name))
    if found is None:
        return (space.tag(name) if kind == "tag" else space.edge(name)).limit(0)
    return versions_as_of(found, keys, moment)


class Grown:
    """A history with the versions that statements have added to it; these are written out now and then."""

    def __init__(self, base: DataFrame | None, added: DataFrame, steps: int = 1):
        self.base, self.added, self.steps = base, added, steps

    def frame(self) -> DataFrame:
        return self.added if self.base is None else self.base.unionByName(self.added, allowMissingColumns=True)


def known(history) -> DataFrame | None:
    """The versions of a history, which may be a function or have been added to."""
    return history.frame() if isinstance(history, Grown) else history() if callable(history) else history


def append(history, rows: DataFrame, tx: int, deleted: bool) -> Grown:
    """history with rows as versions valid from tx on."""
    new = rows.withColumns({"valid_from": F.lit(tx).cast("long"), "valid_to": F.lit(FOREVER).cast("long"), "tx": F.lit(tx).cast("long"), "deleted": F.lit(deleted)})
    if not isinstance(history, Grown):
        return Grown(known(history), new)
    added = history.added.unionByName(new, allowMissingColumns=True)
    return Grown(history.base, added, history.steps + 1) if history.steps < CUT_STEPS else Grown(history.base, cut(added))
