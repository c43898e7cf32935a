"""The k nearest vectors of many queries, by comparing every query with every vector in tiles.

A tile is a block of queries and a block of vectors. Its queries are held in memory while its vectors stream past; of each
query only the k best are kept, so no pair becomes a row. A matrix product in single precision finds the pairs that may be
among the k best within its error bound; their cosines are then computed as `recommend.cosine` does, in the same order of
additions, so scores and ties are those of the plain expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the queries of a tile and what is kept of them, and vectors of a tile at most and, where cores are left, at least.
QUERY_BYTES, MOST_VECTORS, LEAST_VECTORS = 32 << 20, 16_384, 1_024
#: Vectors compared at a time, and scores held at a time.
CHUNK, SCORES = 2_048, 4 << 20


def comparable(vectors: DataFrame) -> DataFrame:
    """Rows of (vid, vector, ...) that cosines exist for: with an id, whole, and of some length."""
    squares = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return vectors.filter(F.col("vid").isNotNull() & (squares > 0))


def vector_blocks(df: DataFrame, rows: int) -> int:
    """The number of blocks that so many vectors are cut into."""
    return max(1, math.ceil(rows / MOST_VECTORS), min(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / LEAST_VECTORS)))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, blocks: int, block: Column, routes: Callable | None = None, n_cells: int = 0) -> DataFrame:
    """(query, vid, score): of each query (vid, vector) the k of `vectors` (vid, vector, cell) nearest by cosine, itself left out.

    `block` deals the vectors to `blocks` blocks. With `routes`, a function of an array of queries to an array of flags by
    query and cell, a query is compared only with the vectors of its cells.
    """
    kind = dict(vectors.dtypes)["vid"]
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("numbers")).first()
    held = 12 * (size["numbers"] or 0) + size["n"] * (16 * k + n_cells)
    query_blocks = max(1, math.ceil(held / QUERY_BYTES))
    vector = F.col("vector").cast("array<float>").alias("vector")
    own = queries.select(F.pmod(F.xxhash64("vid"), F.lit(query_blocks)).alias("_at"), "vid", vector)
    own = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_to"), "_at", "vid", "vector").select((F.col("_at") * blocks + F.col("_to")).cast("int").alias("tile"), F.lit(0).alias("side"), "vid", "vector", F.lit(0).alias("cell"))
    others = vectors.select(block.alias("_to"), "vid", vector, "cell")
    others = others.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_at"), "_to", "vid", "vector", "cell").select((F.col("_at") * blocks + F.col("_to")).cast("int").alias("tile"), F.lit(1).alias("side"), "vid", "vector", "cell")
    dealt = own.unionByName(others).repartitionById(query_blocks * blocks, F.col("tile")).sortWithinPartitions("tile", "side", "cell")
    found = dealt.mapInArrow(lambda batches: compared(batches, k, routes), f"query {kind}, vid {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vid")
    return found.withColumn("n", F.row_number().over(best)).filter(f"n <= {int(k)}").drop("n")


def nearest_of_all(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, vid, score): of each query (vid, vector) the k nearest other vectors, compared with all of them."""
    vectors = comparable(vectors.select("vid", "vector"))
    blocks = vector_blocks(vectors, vectors.count())
    return nearest(comparable(queries), vectors.withColumn("cell", F.lit(0)), k, blocks, F.pmod(F.xxhash64("vid"), F.lit(blocks)))


def compared(batches: Iterator, k: int, routes: Callable | None) -> Iterator:
    """The k best of each query of each tile; rows come by tile, queries before vectors."""
    import numpy as np

    tile, held = None, None
    for batch in batches:
        tiles, sides = batch.column("tile").to_numpy(), batch.column("side").to_numpy()
        cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(sides) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if tiles[a] != tile:
                if held is not None:
                    yield from held.best()
                tile, held = tiles[a], Tile(k, routes)
            (held.meet if sides[a] else held.hold)(batch.slice(a, b - a))
    if held is not None:
        yield from held.best()


def by_length(batch) -> dict:
    """{dimension: (places, vectors)} of the rows of a batch."""
    import numpy as np

    column = batch.column("vector")
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    ends = np.cumsum(sizes)
    found = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        found[d] = at, flat.reshape(-1, d) if len(at) == len(sizes) else flat[(ends[at] - d)[:, None] + np.arange(d)]
    return found


def ids_of(column):
    """Ids as whole numbers, or as objects where they are strings."""
    import numpy as np
    import pyarrow as pa

    return column.to_numpy() if pa.types.is_integer(column.type) else np.array([*column.to_pylist(), None], object)[:-1]


def rank(ids):
    """Numbers in the order of the ids."""
    import numpy as np

    return ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]


class Tile:
    """The queries of a tile by dimension, and what is best of the vectors that they have met."""

    def __init__(self, k: int, routes: Callable | None):
        self.k, self.routes, self.parts, self.groups, self.kind = k, routes, {}, None, None

    def hold(self, batch) -> None:
        ids, self.kind = ids_of(batch.column("vid")), batch.column("vid").type
        for d, (at, x) in by_length(batch).items():
            self.parts.setdefault(d, []).append((ids[at], x))

    def meet(self, batch) -> None:
        import numpy as np

        if self.groups is None:
            self.groups = {d: Group(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), self.k, self.routes) for d, parts in self.parts.items()}
            self.parts = {}
        ids, cells = ids_of(batch.column("vid")), batch.column("cell").to_numpy()
        for d, (at, x) in by_length(batch).items():
            if d in self.groups:
                for a in range(0, len(at), CHUNK):
                    some = at[a : a + CHUNK]
                    self.groups[d].meet(ids[some], x[a : a + CHUNK], cells[some])

    def best(self) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for group in (self.groups or {}).values():
            row, place = np.nonzero(group.score > -np.inf)
            score = group.score[row, place]
            yield pa.RecordBatch.from_arrays([pa.array(group.ids[row], self.kind), pa.array(group.vid[row, place], self.kind), pa.array(np.where(score == np.inf, np.nan, score))], names=["query", "vid", "score"])


def unit(x):
    """(lengths, vectors of length 1 in single precision)."""
    import numpy as np

    total = np.zeros(len(x))
    for column in x.T:
        total += column * column
    length = np.sqrt(total)
    with np.errstate(invalid="ignore"):
        return length, (x / length[:, None]).astype(np.float32)


class Group:
    """Queries of one dimension with their k best: scores from the greatest, -inf where there is none; one that is not a number counts as inf."""

    def __init__(self, ids, x, k: int, routes: Callable | None):
        import numpy as np

        self.k, self.ids, self.x = k, ids, np.asfortranarray(x, np.float64)
        self.length, self.unit = unit(self.x)
        self.cells = None if routes is None else routes(self.x)
        self.score, self.vid = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), ids.dtype)
        # what a product of vectors of length 1 may be off in single precision, with room
        self.off = (x.shape[1] + 16) * 2.0**-22
        self.places = {}
        for row, own in enumerate(ids.tolist()):
            self.places.setdefault(own, []).append(row)

    def meet(self, ids, x, cells) -> None:
        import numpy as np

        keep = self.few_copies(ids, x, cells)
        ids, x, cells = ids[keep], np.asfortranarray(x[keep], np.float64), cells[keep]
        length, units = unit(x)
        own = np.array([(row, j) for j, v in enumerate(ids.tolist()) for row in self.places.get(v, ())], np.int64).reshape(-1, 2)
        rows = np.arange(len(self.ids)) if self.cells is None else np.flatnonzero(self.cells[:, np.unique(cells)].any(1))
        step = max(1, SCORES // len(ids))
        for some in (rows[a : a + step] for a in range(0, len(rows), step)):
            self.compare(some, ids, x, cells, length, units, own)

    def few_copies(self, ids, x, cells):
        """Places of the vectors without those of equal ones that have more than k smaller ids before them."""
        import numpy as np

        bits = np.ascontiguousarray(np.column_stack([np.ascontiguousarray(x, np.float32).view(np.int32), cells.astype(np.int32)]))
        _, code = np.unique(bits.view(np.dtype((np.void, bits.shape[1] * 4))).ravel(), return_inverse=True)
        if code.max() == len(code) - 1:
            return slice(None)
        number = rank(ids)
        order = np.lexsort((number, code))
        code, number = code[order], number[order]
        first = np.r_[True, code[1:] != code[:-1]]
        before = np.cumsum(first | np.r_[True, number[1:] != number[:-1]])
        return np.sort(order[before - before[first][np.cumsum(first) - 1] <= self.k])

    def compare(self, rows, ids, x, cells, length, units, own) -> None:
        import numpy as np

        near = self.unit[rows] @ units.T
        if not (np.isfinite(length).all() and np.isfinite(self.length[rows]).all()):
            near[np.isnan(near)] = np.inf
        if self.cells is not None:
            near[~self.cells[rows][:, cells]] = -np.inf
        at = np.searchsorted(rows, own[:, 0])
        here = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == own[:, 0])
        near[at[here], own[here, 1]] = -np.inf
        least = np.maximum(self.score[rows, -1] - self.off, -2.0)
        fits = near >= least.astype(np.float32)[:, None]
        if near.shape[1] > self.k and np.count_nonzero(fits) > 3 * self.k * len(rows):
            top = np.partition(near, near.shape[1] - self.k, axis=1)[:, -self.k]
            fits = near >= np.maximum(least, top - 2 * self.off).astype(np.float32)[:, None]
        row, other = np.nonzero(fits)
        if not len(row):
            return
        dot, place = np.zeros(len(row)), rows[row]
        for p, q in zip(self.x.T, x.T, strict=True):
            dot += p[place] * q[other]
        with np.errstate(invalid="ignore"):
            score = dot / (self.length[place] * length[other])
        self.take(place, np.where(np.isnan(score), np.inf, score), ids[other])

    def take(self, row, score, vid) -> None:
        """Puts pairs among the best of their rows: by score from the greatest, then by id."""
        import numpy as np

        touched, at = np.unique(row, return_inverse=True)
        at = np.r_[np.repeat(np.arange(len(touched)), self.k), at]
        score, vid = np.r_[self.score[touched].ravel(), score], np.r_[self.vid[touched].ravel(), vid]
        some = score > -np.inf
        at, score, vid = at[some], score[some], vid[some]
        order = np.lexsort((rank(vid), -score, at))
        at, score, vid = at[order], score[order], vid[order]
        first = np.r_[True, at[1:] != at[:-1]]
        place = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = place < self.k
        self.score[touched] = -np.inf
        self.score[touched[at[kept]], place[kept]], self.vid[touched[at[kept]], place[kept]] = score[kept], vid[kept]
