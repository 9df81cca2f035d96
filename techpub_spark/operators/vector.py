"""Exact nearest neighbours: a stated query set against all vectors, in blocks of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_K = 400
#: Queries and queries x places that a task holds, vectors that it reads, queries and vectors of one product: fixed sizes, whatever the data.
BLOCK_QUERIES, HELD, TASK_VECTORS, TILE_QUERIES, TILE_VECTORS = 1 << 14, 1 << 18, 1 << 20, 256, 2048


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of ``column`` as rows of length one; a zero vector stays zero."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class _Best:
    """The best ``k`` of all vectors seen so far for each query of a block: score descending, then id."""

    def __init__(self, k: int):
        self.k, self.q, self.names, self.found, self.waiting = k, [], [], [], 0
        self.bar = np.zeros(0)

    def ask(self, names: pa.Array, vectors: pa.Array) -> None:
        self.names += names.to_pylist()
        self.q.append(_matrix(vectors))
        self.bar = np.full(len(self.names), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if len(self.q) > 1:
            self.q = [np.concatenate(self.q)]
        for at in range(0, len(self.names), TILE_QUERIES):
            s = self.q[0][at : at + TILE_QUERIES] @ vectors.T
            bar = self.bar[at : at + TILE_QUERIES]
            if s.shape[1] > self.k and np.isinf(bar).any():
                bar = np.maximum(bar, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
            row, col = np.nonzero(s >= bar[:, None] - 2e-6)  # what rounding could still lift to the bar
            self.found.append((row + at, np.round(s[row, col], 6), ids[col]))
            self.waiting += len(row)
            if self.waiting > 2 * HELD:
                self.settle()
        if np.isinf(self.bar).any():
            self.settle()

    def settle(self) -> None:
        """Keep the best of what was found; a query with ``k`` of them lets in only what is as good as its last."""
        if not self.found:
            return
        row, score, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order, full = order[place < self.k], row[place == self.k - 1]
        self.bar[full] = score[order][place[place < self.k] == self.k - 1]
        self.found, self.waiting = [(row[place < self.k], score[order], ids[order])], 0


def _nearest(k: int):
    def out(best: _Best, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        best.settle()
        for row, score, ids in best.found:
            cols = [pa.array([best.names[i] for i in row], kinds[0]), pa.array(score, pa.float64()), pa.array(ids.tolist(), kinds[1])]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, kinds = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(2).type, batch.column(3).type]
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if cell != key[a] // 2:
                    if best is not None:
                        yield from out(best, kinds)
                    cell, best = key[a] // 2, _Best(k)
                part = batch.slice(a, b - a)
                if key[a] % 2 == 0:
                    best.ask(part.column(2), part.column(4))
                    continue
                for at in range(0, b - a, TILE_VECTORS):
                    some = part.slice(at, TILE_VECTORS)
                    best.meet(some.column(3).to_numpy(zero_copy_only=False), _matrix(some.column(4)))
        if best is not None:
            yield from out(best, kinds)

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", where: str | None = None) -> DataFrame:
    """Top ``k`` vectors by cosine per query: query_id, rank, score, id (k is held in 1..400; ties: smaller id).

    ``where`` is applied below the scoring, so that a filtered row never takes a place.  Queries and vectors
    are dealt over cells, each a block of queries by a share of the vectors: a task holds its block and its
    best k and streams the vectors past them in tiles, so its memory has a fixed bound, and neither side
    passes through the driver.  The last shuffle carries shares x queries x k rows, not all scores.
    """
    k = max(1, min(k, MOST_K))
    side = (vectors.where(where) if where else vectors).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("v is not null")
    asked = queries.select("query_id", F.col(vec_col).alias("v")).where("v is not null")
    if asked.schema["v"].dataType != side.schema["v"].dataType:
        asked, side = (x.withColumn("v", F.col("v").cast("array<double>")) for x in (asked, side))
    names, ids = (x.schema[c].dataType.simpleString() for x, c in ((asked, "query_id"), (side, "id")))
    blocks = max(1, -(-asked.count() // min(BLOCK_QUERIES, HELD // k)))
    shares = max(1, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // blocks), -(-side.count() // TASK_VECTORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block, share = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), F.pmod(F.xxhash64("id"), F.lit(shares))
    asked = asked.select("query_id", "v", block.alias("block"), every(shares).alias("share")).select((F.col("block") * shares + F.col("share")).cast("long").alias("cell"), F.lit(0).alias("kind"), "query_id", F.lit(None).cast(ids).alias("id"), "v")
    side = side.select("id", "v", share.alias("share"), every(blocks).alias("block")).select((F.col("block") * shares + F.col("share")).cast("long").alias("cell"), F.lit(1).alias("kind"), F.lit(None).cast(names).alias("query_id"), "id", "v")
    dealt = asked.unionAll(side).repartition(blocks * shares, "cell").sortWithinPartitions("cell", "kind")
    out = dealt.mapInArrow(_nearest(k), f"query_id {names}, score double, id {ids}")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "score", "id")
