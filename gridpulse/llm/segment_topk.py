"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are quantised to integers and packed into blocks. Each vector's means and deviations over 1,
2, 4, 8 and 16 segments bound its product with a query from above (equally, its distance from below:
d2 = |x|2 + |y|2 - 2xy); a block's vectors are dropped level by level, coarse to fine, once their bound
falls under the query's k-th best score so far. Survivors get the exact integer product. A block has an envelope, too: the
ranges of its vectors' means and its largest deviations bound all its products with a query at once, so a block that can't
reach a query's k-th best isn't looked into.

Candidates aren't shuffled: queries are sent to them in turns of at most TURN bytes, each one pass over the
candidates; each task passes on only k rows a query, which one window merges.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; vectors of
other lengths than the query's aren't compared with it; an empty vector's products are 0; a candidate row
repeated under its vec_id counts each time; of query rows that share a vec_id the smallest vector is the
query; ties go to the smaller vec_id. Products are summed in 64-bit integers, modulo 2^64 where components are so large
that a product leaves their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import durable, lean

LEVELS = (1, 2, 4, 8, 16)
ROWS, QUERY_ROWS = 4096, 4096
#: Bytes of the queries that are broadcast at once.
TURN = 64 << 20
SCALE = 1024


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def quantise(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) for each length of vector in columns (id, vector)."""
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    dims = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(dims)])
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), ids[at], flat[starts[at][:, None] + np.arange(dim)].reshape(len(at), dim)


def blocks(batches: Iterator[pa.RecordBatch], size: int = ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of up to so many rows, by ascending id."""
    held: dict[int, list] = {}

    def out(dim: int) -> tuple[int, np.ndarray, np.ndarray]:
        ids, values = (np.concatenate(x) for x in zip(*held.pop(dim)))
        order = np.argsort(ids, kind="stable")
        return dim, ids[order], values[order]

    for batch in batches:
        for dim, ids, values in _by_length(batch):
            for i in range(0, len(ids), size):
                held.setdefault(dim, []).append((ids[i : i + size], values[i : i + size]))
                if sum(len(x[0]) for x in held[dim]) >= size:
                    yield out(dim)
    for dim in list(held):
        yield out(dim)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, each times the root of the segment's length: their product bounds x's."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    root = [np.sqrt(p.shape[1]) for p in parts]
    return np.concatenate([np.stack([p.mean(1) * r if p.shape[1] else p.sum(1) for p, r in zip(parts, root)], 1), np.stack([p.std(1) * r if p.shape[1] else p.sum(1) for p, r in zip(parts, root)], 1)], 1)


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By floats where every partial sum is below 2^53, and so exact; else by integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q @ c.T


class Search:
    """Running top-k of one block of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.levels = [statistics(q.astype(np.float64), s) for s in LEVELS]
        self.best = [np.zeros((0,), np.int64)] * len(ids), [np.zeros((0,), np.int64)] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def envelope(self, s: np.ndarray) -> np.ndarray:
        """What no product of a query with a block exceeds, from the block's statistics: the ranges of the means, the most of the deviations."""
        own, half = self.levels[-1], s.shape[1] // 2
        low, high = s.min(0), s.max(0)
        means = np.maximum(own[:, :half], 0) @ high[:half] + np.minimum(own[:, :half], 0) @ low[:half]
        bound = means + own[:, half:] @ high[half:]
        return bound + 1e-9 * np.abs(bound) + 1e-3

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        f = c.astype(np.float64)
        alive = np.ones((len(self.ids), len(ids)), bool)
        if np.isfinite(self.floor).any():
            alive &= (self.envelope(statistics(f, LEVELS[-1])) >= self.floor)[:, None]
            for own, segments in zip(self.levels, LEVELS):
                cols, rows = np.flatnonzero(alive.any(0)), np.flatnonzero(alive.any(1))
                if not len(cols):
                    return
                bound = own[rows] @ statistics(f[cols], segments).T
                bound += 1e-9 * np.abs(bound) + 1e-3
                alive[np.ix_(rows, cols)] &= bound >= self.floor[rows, None]
        cols, rows = np.flatnonzero(alive.any(0)), np.flatnonzero(alive.any(1))
        if not len(cols):
            return
        scores = exact_products(self.q[rows], c[cols])
        for i, row in enumerate(rows):
            at = np.flatnonzero(alive[row, cols] & (ids[cols] != self.ids[row]) & (scores[i] >= self.floor[row]))
            if not len(at):
                continue
            s, v = np.concatenate([self.best[0][row], scores[i, at]]), np.concatenate([self.best[1][row], ids[cols[at]]])
            if len(s) > 4 * self.k:
                cut = np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, v = s[keep := s >= cut], v[keep]
            order = np.lexsort((v, -s))[: self.k]
            self.best[0][row], self.best[1][row] = s[order], v[order]
            if len(order) == self.k:
                self.floor[row] = s[order[-1]]


def top_k(rows: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose id is divisible by every."""
    used = rows.where(usable(F.col(vector))).select(
        F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector)).alias("v")
    ).where(F.col("vec_id").isNotNull())
    asked = durable(used.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0)).alias("words")).first()
    turns = max(1, -(-size["words"] * 8 // TURN))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    narrow = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = None
    for t in range(turns):
        part, queries = _turn(used, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(turns)) == t), k)
        if turns > 1:  # what a turn finds is written and its queries are dropped everywhere before the next begins
            part = durable(narrow(part).drop("rank"), "turn")
            queries.destroy()
        found = part if found is None else found.unionByName(part)
    return narrow(found).select("query_id", "rank", "vec_id", "score")


def _turn(used: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """(query_id, vec_id, score), each task's best for the queries of one turn; and these queries, whose bytes are bounded."""
    table = asked.select("vec_id", "v").toArrow().combine_chunks()
    own: dict[int, list] = {}
    for dim, ids, q in blocks(iter(table.to_batches()), QUERY_ROWS):
        own.setdefault(dim, []).append((ids, q))
    queries = used.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Search]] = {}
        for dim, ids, c in blocks(batches):
            if dim in queries.value:
                if dim not in held:
                    held[dim] = [Search(*q, k) for q in queries.value[dim]]
                for s in held[dim]:
                    s.meet(ids, c)
        for s in (s for own in held.values() for s in own):
            n = [len(x) for x in s.best[1]]
            if sum(n):
                data = np.repeat(s.ids, n), np.concatenate(s.best[1]), np.concatenate(s.best[0])
                yield pa.RecordBatch.from_arrays(list(map(pa.array, data)), names=["query_id", "vec_id", "score"])

    return used.mapInArrow(lean(run), "query_id long, vec_id long, score long"), queries
