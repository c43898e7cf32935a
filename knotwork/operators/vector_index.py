"""Approximate nearest vectors: an inverted file of cells around centroids.

Centroids are fitted to a bounded sample; every vector is then put into the cell of its nearest centroid, and the cells
are written as a table partitioned by cell. A search takes the cells whose centroids are nearest to the query and compares
with the vectors in them exactly, so it reads a part of the table that partition pruning chooses.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.operators.nearest import comparable, nearest, vector_blocks
from knotwork.operators.recommend import cosine, vectors_of
from knotwork.sources.graph import Space, _written, scratch_dir

#: Vectors to which centroids are fitted at most, and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 20_000, 12
#: Cells at most, and the share of them that a search takes. The test vectors hardly cluster: of the ten nearest 0.74 and 0.83 are
#: found with 0.4 of the cells (500 and 2,000 vectors), 0.95 and 0.96 with 0.7; clustered vectors need fewer.
MOST_CELLS, PROBED = 4096, 0.75
#: Vectors of a cell that one task writes, about.
PIECE_ROWS = 10_000


@dataclass
class VectorIndex:
    """cells (vid, vector, cell), partitioned by cell, around centroids (cells, dimension) of length 1."""

    cells: DataFrame
    centroids: object
    prop: str

    def nearest_cells(self, vector, probed: float = PROBED) -> list[int]:
        import numpy as np

        x = np.asarray(vector, np.float64)
        if self.centroids is None or x.shape[0] != self.centroids.shape[1] or not np.linalg.norm(x):
            return []
        n = max(1, math.ceil(len(self.centroids) * probed))
        return np.argsort(-(self.centroids @ x), kind="stable")[:n].tolist()

    def search(self, vector, k: int, without=None, probed: float = PROBED) -> DataFrame:
        """(vid, score) of the k vectors nearest by cosine among the cells that are nearest."""
        found = self.cells.filter(F.col("cell").isin(self.nearest_cells(vector, probed)))
        if without is not None:
            found = found.filter(F.col("vid") != F.lit(without))
        own = F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")
        return found.select("vid", cosine(F.col("vector"), own).alias("score")).filter("score is not null").orderBy(F.col("score").desc(), "vid").limit(k)

    def search_all(self, queries: DataFrame, k: int, probed: float = PROBED) -> DataFrame:
        """(query, vid, score): of each query (vid, vector) the k nearest other vectors among its nearest cells, tile by tile."""
        centroids = self.centroids
        if centroids is None:
            return self.cells.limit(0).select(F.col("vid").alias("query"), "vid", F.lit(0.0).alias("score"))

        def routes(x):
            import numpy as np

            n = max(1, math.ceil(len(centroids) * probed))
            taken = np.zeros((len(x), len(centroids)), bool)
            for a in range(0, len(x), 256):
                near = np.argsort(-(x[a : a + 256] @ centroids.T), axis=1, kind="stable")[:, :n]
                np.put_along_axis(taken[a : a + 256], near, True, 1)
            return taken

        # blocks are stretches of the vectors in the order of their cells, so a block has few cells and a large cell many blocks
        sizes = sorted((r["cell"], r["count"]) for r in self.cells.groupBy("cell").count().collect())
        total, starts = 0, []
        for cell, n in sizes:
            starts.append((cell, total, n))
            total += n
        blocks = vector_blocks(self.cells, total)
        # a row for each cell
        placed = self.cells.join(F.broadcast(self.cells.sparkSession.createDataFrame(starts, "cell int, start long, size long")), "cell")
        at = F.col("start") + F.pmod(F.xxhash64("vid"), F.lit(1 << 20)) / (1 << 20) * F.col("size")
        fits = comparable(queries.select("vid", "vector")).filter(F.size("vector") == centroids.shape[1])
        return nearest(fits, placed, k, blocks, F.least(F.floor(at * blocks / max(1, total)), F.lit(blocks - 1)), routes, len(centroids))


def build(space: Space, prop: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> VectorIndex:
    """Indexes every vector of a property; vectors of other lengths than most, or of length 0, are in no cell, as they match none.

    The sample is taken by a hash of the ids. Without vectors the index is empty.
    """
    import numpy as np

    spark, vectors = space.spark, vectors_of(space, prop)
    common = vectors.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
    if common is None:
        return VectorIndex(vectors.withColumn("cell", F.lit(0)).limit(0), None, prop)
    length = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    vectors = vectors.filter((F.size("vector") == common["d"]) & (length > 0))
    cells = cells or int(min(MOST_CELLS, max(1, math.isqrt(common["n"]))))
    sample = vectors.orderBy(F.xxhash64("vid", F.lit(seed)), "vid").limit(max(sample_rows, cells)).select("vector").toPandas()["vector"]
    x = np.array(sample.tolist(), np.float64)
    if not len(x):
        raise QueryError(f"{prop} holds no vector of any length")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = x[: min(cells, len(x))].copy()
    for _ in range(ROUNDS):
        near = (x @ centroids.T).argmax(1)
        for c in range(len(centroids)):
            own = x[near == c].sum(0)
            if np.linalg.norm(own):
                centroids[c] = own / np.linalg.norm(own)
    kind = dict(vectors.dtypes)["vid"]
    # by the sample, a cell is written in pieces of about PIECE_ROWS
    held = np.bincount((x @ centroids.T).argmax(1), minlength=len(centroids)) / len(x) * common["n"]
    pieces = np.maximum(1, np.ceil(held / PIECE_ROWS)).astype(np.int32)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            near = (rows @ centroids.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(pieces[near])], names=["vid", "vector", "cell", "pieces"])

    path = f"{scratch_dir(spark)}/vectors-{uuid.uuid4().hex}"
    _written.append((spark, path))
    found = vectors.select("vid", "vector").mapInArrow(assign, f"vid {kind}, vector array<float>, cell int, pieces int")
    # a cell that holds a third of all vectors is still written by several tasks, and a small one is one file
    found.repartition(F.col("cell"), F.pmod(F.xxhash64("vid"), F.col("pieces"))).drop("pieces").write.partitionBy("cell").parquet(path)
    return VectorIndex(spark.read.schema(f"vid {kind}, vector array<float>, cell int").parquet(path), centroids, prop)
