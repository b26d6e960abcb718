"""Exact top-k inner products by multi-resolution segment statistics.

Of a vector cut in segments, the mean and the deviation of each segment bound how near another
vector can be: |a - b|^2 >= sum of w ((mean_a - mean_b)^2 + (dev_a - dev_b)^2) over segments of w
components (Hwang et al., "Fast nearest neighbor search by multi-resolution segment statistics",
2012). With a.b = (|a|^2 + |b|^2 - |a - b|^2) / 2 a lower bound of the distance is an upper bound
of the product, sum of w (mean_a mean_b + dev_a dev_b). Pairs pass from few segments to many; those
that a bound puts below the k-th best product so far end there, and only survivors are multiplied
out, exactly, in integers.

Queries and candidates are dealt to cells of a bounded number of rows each. A cell reads its
queries first and then streams its candidates, by ascending id, so its memory does not grow with
the data; hot vectors are spread by their ids. The cells' answers are ranked once more at the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most query rows, and most candidate rows, of a cell on average.
CELL_ROWS = 65_536
#: Segments at each level, coarse to fine; levels with segments of under four components are left out.
LEVELS = (1, 4, 16, 64, 256)
#: Queries and candidates that are compared at a time.
TILE_QUERIES, TILE_ROWS = 1024, 2048
#: Below this, sums of products of integers are exact as doubles.
_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def levels_of(size: int) -> list[int]:
    return [n for n in LEVELS if 4 * n <= size]


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(w) mean and sqrt(w) deviation of each segment: their inner products are the bounds."""
    edges = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
    width = np.diff(edges).astype(float)
    sums = np.add.reduceat(vectors, edges[:-1], axis=1)
    means = sums / width
    spread = np.add.reduceat(np.square(vectors - np.repeat(means, np.diff(edges), axis=1)), edges[:-1], axis=1)
    return np.concatenate([sums / np.sqrt(width), np.sqrt(spread)], axis=1)


def quantized(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), whole numbers as doubles."""
    return np.floor(vectors * scale)


class Cell:
    """The k best candidates of each query of a cell, of all candidates offered so far by ascending id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = levels_of(vectors.shape[1])
        self.statistics = [segment_statistics(vectors, n) for n in self.levels]
        self.norm = float(np.sqrt(np.square(vectors).sum(1)).max(initial=0))
        self.scores = np.full((len(ids), k), -np.inf, object if self.norm * self.norm >= _EXACT else float)
        self.found = np.full((len(ids), k), -1, np.int64)
        #: Pairs offered, pairs multiplied out.
        self.pairs = self.products = 0

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norm = float(np.sqrt(np.square(vectors).sum(1)).max(initial=0))
        exact = self.norm * norm < _EXACT
        if not exact and self.scores.dtype != object:
            self.scores = self.scores.astype(object)
        statistics = [segment_statistics(vectors, n) for n in self.levels]
        for at in range(0, len(self.ids), TILE_QUERIES):
            self._tile(slice(at, at + TILE_QUERIES), ids, vectors, statistics, exact, 1e-9 * self.norm * norm)

    def _tile(self, queries: slice, ids: np.ndarray, vectors: np.ndarray, statistics: list[np.ndarray], exact: bool, slack: float) -> None:
        least = self.scores[queries, -1].astype(float)
        rows, columns = np.arange(len(least)), np.arange(len(ids))
        alive = np.ones((len(rows), len(columns)), bool)
        self.pairs += alive.size
        for mine, theirs in zip(self.statistics, statistics):
            bounds = mine[queries][rows] @ theirs[columns].T
            alive &= bounds + slack >= least[rows, None]
            some, any_row = alive.any(0), alive.any(1)
            if not (some.all() and any_row.all()):  # later levels see only what is left
                rows, columns, alive = rows[any_row], columns[some], alive[any_row][:, some]
            if not alive.size:
                return
        alive &= self.ids[queries][rows, None] != ids[columns]
        products = self._products(self.vectors[queries][rows], vectors[columns], alive, exact)
        self._merge(queries.start + rows, ids[columns], products)

    def _products(self, mine: np.ndarray, theirs: np.ndarray, alive: np.ndarray, exact: bool) -> np.ndarray:
        """Products of the pairs alive, minus infinity for others."""
        self.products += int(alive.sum())
        out = np.full(alive.shape, -np.inf, float if exact else object)
        if not exact:  # sums that a double may not hold
            a, b = ([[int(x) for x in row] for row in side.tolist()] for side in (mine, theirs))
            for i, j in zip(*np.nonzero(alive)):
                out[i, j] = sum(x * y for x, y in zip(a[i], b[j]))
        elif 8 * alive.sum() < alive.size:
            i, j = np.nonzero(alive)
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                out[p, q] = np.einsum("ij,ij->i", mine[p], theirs[q])
        else:
            np.copyto(out, mine @ theirs.T, where=alive)
        return out

    def _merge(self, queries: np.ndarray, ids: np.ndarray, products: np.ndarray) -> None:
        """Take the best of ``products`` in; among equal ones the first, as ids ascend."""
        better = (products > self.scores[queries, -1][:, None]).any(1)
        queries, products = queries[better], products[better]
        if not len(queries):
            return
        every = np.arange(len(queries))
        scores, found = [self.scores[queries]], [self.found[queries]]
        for _ in range(min(self.k, len(ids))):
            best = products.argmax(1)
            scores.append(products[every, best][:, None])
            found.append(ids[best][:, None])
            products[every, best] = -np.inf
        scores, found = np.concatenate(scores, 1), np.concatenate(found, 1)
        order = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.scores[queries] = np.take_along_axis(scores, order, 1)
        self.found[queries] = np.take_along_axis(found, order, 1)

    def answers(self) -> Iterator[tuple[int, int, int]]:
        """(number of the query, id, product); products beyond a long are cut to its ends."""
        low, high = _LONG
        for i, (scores, found) in enumerate(zip(self.scores.tolist(), self.found.tolist())):
            for score, j in zip(scores, found):
                if score != -math.inf:
                    yield i, j, min(max(int(score), low), high)


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), float)
    return quantized(flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0)), scale)


def _cells(k: int, scale: int):
    """Rows sorted by cell, queries before candidates, ids ascending, to (query, digest of its vector, id, product)."""

    def answers(cell: Cell | None) -> Iterator[pa.RecordBatch]:
        if cell is None:
            return
        digests = [hashlib.md5(v.tobytes()).digest() for v in cell.vectors]
        rows = [(int(cell.ids[i]), digests[i], j, score) for i, j, score in cell.answers()]
        for at in range(0, len(rows), 50_000):
            columns = list(zip(*rows[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT)], names=["query_id", "digest", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        ids, vectors = [], []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in range(3)], 1)
            kinds = np.asarray(batch.column(3))
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if tuple(keys[a]) != key:
                    yield from answers(cell)
                    key, cell, ids, vectors = tuple(keys[a]), None, [], []
                some, them = np.asarray(batch.column(4))[a:b], _matrix(batch.column(5).slice(a, b - a), scale)
                if kinds[a] == 0:
                    ids.append(some)
                    vectors.append(them)
                    continue
                if cell is None and ids:
                    cell = _distinct(np.concatenate(ids), np.concatenate(vectors), k)
                    ids, vectors = [], []
                if cell is not None:
                    for at in range(0, len(some), TILE_ROWS):
                        cell.offer(some[at : at + TILE_ROWS], them[at : at + TILE_ROWS])
        yield from answers(cell)

    return run


_OUT = (pa.int64(), pa.binary(), pa.int64(), pa.int64())


def _distinct(ids: np.ndarray, vectors: np.ndarray, k: int) -> Cell:
    """A cell of the queries, of which rows with one id and one vector are one."""
    seen = {(i, v.tobytes()): n for n, (i, v) in enumerate(zip(ids.tolist(), vectors))}
    kept = sorted(seen.values())
    return Cell(ids[kept], vectors[kept], k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows with the highest products, all if fewer.

    Components are taken as floor(scale * x), x as double; the score is the integer inner product,
    ties go to the smaller id. Every row but the query's own, told by its id, is a candidate; ids
    are whole numbers.

    Cases: null vectors, vectors with a null or a component that is not finite (before or after it
    is scaled) and rows with a null id take no part. Vectors of different lengths are not compared;
    empty ones have product 0. Rows that repeat an id are candidates each; as queries, those with
    one id and one vector are one, others are answered each. Scores beyond a long are cut to its
    ends. No rows, or no queries, give no rows. Extra columns are ignored.
    """
    embedding = F.col(vector_col).cast("array<double>")
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("size"), is_query.alias("asks")
    )
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    spark = vectors.sparkSession
    blocks = max(1, math.ceil(n_queries / cell_rows))
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / cell_rows))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    slot = F.pmod(F.xxhash64("id", F.lit("slot")), F.lit(slots)).cast("int")

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = rows.filter("asks").select("size", mine.alias("block"), numbers(slots).alias("slot"), F.lit(0).alias("kind"), "id", "vector")
    offered = rows.select("size", numbers(blocks).alias("block"), slot.alias("slot"), F.lit(1).alias("kind"), "id", "vector")
    cell = ["size", "block", "slot"]
    dealt = asked.unionAll(offered).repartition(blocks * slots, *cell).sortWithinPartitions(*cell, "kind", "id")
    found = dealt.mapInArrow(_cells(k, scale), "query_id bigint, digest binary, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "digest").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
