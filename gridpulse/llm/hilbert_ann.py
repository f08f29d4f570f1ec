"""Approximate nearest neighbours by several Hilbert orderings of projected vectors.

Each curve turns and projects the unit vectors by a random rotation of its own, shifts them within the
cube and orders them along a Hilbert curve. Bounds from a sample cut each ordering into cells of about equal size, and
Spark range-partitions the vectors by curve and cell. A query goes to the cells within d of its own on every
curve; what it finds there is merged and ranked by the exact cosine on the original vectors.

What is shuffled for each curve is not a vector but its direction in one byte a component; twice as many as asked for
are taken of a cell, and four times as many are ranked exactly, which covers the rounding.

The cells' width and d are fitted on a bounded sample of queries, whose true neighbours one pass over all rows gives: with d,
`target` of them lie within reach on some curve. The width follows the reach, so a query visits about five cells of a
curve at any size of table; only where a cell would hold more than CELL rows it is narrower. The rule is the same at
every size; the projection's scale, the bounds, the width and d come from samples (SAMPLE rows, PROBES queries), and
every row is indexed.

Rows with equal vectors are one entry of the index, with their k + 1 smallest ids, which is all that a
result of k rows can hold of them; so a vector however common fills one place. Vectors are told apart by two 64-bit
hashes, and only these and the ids are shuffled to find equal ones.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part; vectors of
different lengths aren't compared, and a length that neither sample holds is searched whole; rows that share id and vector count once; an id that has several vectors asks
with each and is told the best of all; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import durable, first_by_hash, lean, partitions
from gridpulse.llm.segment_topk import usable

CURVES, DIMS, BITS = 10, 8, 7
SAMPLE, PROBES, TARGET = 16384, 512, 0.96
#: Rows of a cell at most, and cells within the reach that the probes need.
CELL, REACH = 1 << 20, 2


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (rows of coordinates below 2^bits)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess work of each level
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(flip, low, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> bit) & 1)
    return key


class Curves:
    """The orderings of vectors of one length: their rotations follow from that length, scale and bounds from a sample."""

    def __init__(self, unit: np.ndarray):
        dim = unit.shape[1]
        self.centre, self.spread = unit.mean(0), max(float(unit.std(0).mean()), 1e-6)
        self.axes, self.shifts = [], []
        for c in range(CURVES):
            rng = np.random.default_rng([dim, c])
            self.axes.append(np.linalg.qr(rng.standard_normal((dim, min(DIMS, dim))))[0])
            self.shifts.append(rng.random(self.axes[-1].shape[1]))
        self.sorted = [np.sort(self.keys(unit, c)) for c in range(CURVES)]
        self.cells = 1

    def keys(self, unit: np.ndarray, c: int) -> np.ndarray:
        at = ((unit - self.centre) @ self.axes[c] / (4 * self.spread) + 1 + self.shifts[c]) / 3
        return hilbert_keys(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1), BITS)

    def share(self, unit: np.ndarray, c: int) -> np.ndarray:
        """What share of the sample comes before each vector on a curve."""
        return np.searchsorted(self.sorted[c], self.keys(unit, c)) / len(self.sorted[c])

    def cell(self, unit: np.ndarray, c: int) -> np.ndarray:
        return np.minimum((self.share(unit, c) * self.cells).astype(np.int64), self.cells - 1)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length of vector in columns (id, vector)."""
    lists = batch.column(1)
    dims = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(dims)])
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, flat[starts[at][:, None] + np.arange(dim)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(found: DataFrame, key: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _codes(unit: np.ndarray) -> np.ndarray:
    """Directions as whole numbers up to 127, in bytes."""
    return np.rint(unit * (127 / np.abs(unit).max(1, keepdims=True))).astype(np.int8)


def neighbours(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by every."""
    spark = rows.sparkSession
    used = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(
        F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    )
    # cid names a vector, second makes sure
    used = used.select("vec_id", F.xxhash64("v").alias("cid"), F.xxhash64(F.lit(1), "v").alias("second"), "v")
    same = ["cid", "second"]
    named = durable(used.select("vec_id", *same).distinct(), "named")
    few = Window.partitionBy(*same).orderBy("vec_id")
    first = named.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1)
    ids = first.groupBy(*same).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asks = named.groupBy(*same).agg(F.max(F.col("vec_id") % every == 0).alias("asks"))
    ids = durable(ids.join(asks, same).select(*same, F.get("ids", F.lit(0)).alias("vec_id"), "ids", "asks"), "ids")
    asked = named.where(F.col("vec_id") % every == 0).select("vec_id", "cid")
    # of the rows that share id and vector any one will do; only what repeats is looked for twice
    again = used.select("vec_id", *same).groupBy("vec_id", *same).count().where("count > 1")
    held = used.join(ids.select("vec_id", *same, "asks"), ["vec_id", *same])
    once = held.join(again, ["vec_id", *same], "left_anti")
    more = held.join(again.drop("count"), ["vec_id", *same], "left_semi").dropDuplicates(["vec_id", *same])
    vectors = durable(once.unionByName(more).select("cid", "v", "asks"), "vectors")

    curves, d = fitted(vectors, k, target)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for dim, at, x in _groups(batch):
                x, own = _unit(x), curves.get(dim)
                codes = pa.array(map(bytes, _codes(x)), pa.binary())
                for c in range(CURVES if own else 1):
                    cell, last = (own.cell(x, c), own.cells - 1) if own else (np.zeros(len(at), np.int64), 0)
                    data = cid[at], np.full(len(at), dim * CURVES + c), cell, np.full(len(at), last), asks[at]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, data), codes], names=["cid", "curve", "cell", "last", "asks", "code"])

    n = partitions(spark)
    keys = vectors.mapInArrow(lean(key), "cid long, curve long, cell long, last long, asks boolean, code binary")
    visits = F.sequence(F.greatest(F.col("cell") - d, F.lit(0)), F.least(F.col("cell") + d, F.col("last")))
    where = lambda c, a: F.struct(c.alias("cell"), F.lit(a).alias("asks"))
    dealt = keys.select("curve", "cid", "code", F.explode(F.concat(
        F.array(where(F.col("cell"), False)), F.when(F.col("asks"), F.transform(visits, lambda c: where(c, True))).otherwise(F.array().cast("array<struct<cell:long,asks:boolean>>"))
    )).alias("at")).select("curve", "at.*", "cid", "code")
    dealt = dealt.repartitionByRange(n, "curve", "cell").sortWithinPartitions("curve", "cell", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            curve, cell, asks, cid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(curve) != 0) | (np.diff(cell) != 0) | (asks[1:] != asks[:-1])) + 1, [len(cid)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held != (curve[a], cell[a]):
                    held, parts = (curve[a], cell[a]), []
                code = np.frombuffer(b"".join(batch.column(4).slice(a, b - a).to_pylist()), np.int8).reshape(b - a, -1)
                if not asks[a]:
                    parts.append((cid[a:b], code))
                elif parts:
                    if len(parts) > 1:
                        parts = [tuple(np.concatenate(x) for x in zip(*parts))]
                    yield nearest(cid[a:b], code, *parts[0], 2 * (k + 1))

    met = dealt.mapInArrow(lean(search), "asker long, cid long, score float")
    met = _best(met.groupBy("asker", "cid").agg(F.max("score").alias("score")), "asker", 4 * (k + 1), "cid").select("asker", "cid")
    side = vectors.select("cid", "v")
    full = met.join(side, "cid").join(ids.select("cid", "ids"), "cid").join(side.select(F.col("cid").alias("asker"), F.col("v").alias("q")), "asker")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 1))
            score = [cosine(np.asarray(a, np.float64), np.asarray(b, np.float64)) for a, b in zip(q, c)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64())], names=["asker", "ids", "score"])

    scored = full.select("asker", "v", "ids", "q").mapInArrow(lean(rerank), "asker long, ids array<long>, score double")
    scored = _best(scored.withColumn("_i", F.get("ids", F.lit(0))), "asker", k + 1, "_i")
    out = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("asker")).join(
        scored.select("asker", F.explode("ids").alias("vec_id"), "score"), "asker"
    )
    out = out.where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _best(out, "query_id", k, "vec_id").select("query_id", "rank", "vec_id", "score")


def nearest(asker: np.ndarray, q: np.ndarray, cid: np.ndarray, code: np.ndarray, take: int) -> pa.RecordBatch:
    """The `take` candidates nearest to each query, by their codes, block by block."""
    unit = lambda x: x / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    q = unit(q)
    best, found = np.full((len(q), take), -2, np.float32), np.full((len(q), take), -1, np.int64)
    for i in range(0, len(cid), 4096):
        score = np.concatenate([best, q @ unit(code[i : i + 4096]).T], 1)
        near = np.argpartition(-score, take - 1, axis=1)[:, :take]
        best = np.take_along_axis(score, near, 1)
        own = np.concatenate([found, np.broadcast_to(cid[i : i + 4096], (len(q), score.shape[1] - take))], 1)
        found = np.take_along_axis(own, near, 1)
    row, nth = np.nonzero(best > -2)
    return pa.RecordBatch.from_arrays([pa.array(asker[row]), pa.array(found[row, nth]), pa.array(best[row, nth])], names=["asker", "cid", "score"])


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of vectors so large or small that their products leave the doubles' range, after scaling."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        aa, bb = a @ a, b @ b
        if not (1e-280 < aa < 1e300 and 1e-280 < bb < 1e300):
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            aa, bb = a @ a, b @ b
        return float(a @ b / (np.sqrt(aa) * np.sqrt(bb)))


def fitted(vectors: DataFrame, k: int, target: float) -> tuple[dict[int, Curves], int]:
    """The curves by length of vector, with their number of cells, and how many cells away a query looks."""
    n = vectors.count()
    sample = first_by_hash(vectors.select("cid", "v"), "cid", SAMPLE, n).toArrow().combine_chunks()
    curves = {dim: Curves(_unit(x)) for batch in sample.to_batches() for dim, _, x in _groups(batch)}
    asked = vectors.where("asks").select("cid", "v")
    probes = first_by_hash(asked, "cid", PROBES, asked.count()).toArrow().combine_chunks()
    by_dim = {dim: (batch.column(0).to_numpy()[at], _unit(x)) for batch in probes.to_batches() for dim, at, x in _groups(batch)}
    for dim, own in by_dim.items():
        curves.setdefault(dim, Curves(own[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column(0).to_numpy()
            for dim, at, x in _groups(batch):
                if dim in by_dim:
                    ids, q = by_dim[dim]
                    x = _unit(x)
                    score = q @ x.T
                    score[ids[:, None] == cid[at]] = -2
                    take = min(k, len(at))
                    near = np.argpartition(-score, take - 1, axis=1)[:, :take]
                    found = near.ravel()
                    data = np.repeat(ids, take), cid[at][found], np.take_along_axis(score, near, 1).ravel()
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * dim), pa.array(x[found].ravel()))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, data), v], names=["asker", "cid", "score", "v"])

    true = vectors.select("cid", "v").mapInArrow(lean(run), "asker long, cid long, score double, v array<double>").where("score > -2")
    # a batch's nearest are narrowed to the task's before they are shuffled; at most PROBES x k rows come back
    true = _best(true, "asker", k, "cid").select("asker", "v").toArrow().combine_chunks()
    pairs = []
    for batch in true.to_batches():
        asker = batch.column(0).to_numpy()
        for dim, at, x in _groups(batch):
            ids, q = by_dim[dim]
            order = np.argsort(ids)
            mine = q[order[np.searchsorted(ids, asker[at], sorter=order)]]
            pairs.append((dim, mine, x))
    least = lambda f: np.concatenate([np.min([np.abs(f(dim, a, c) - f(dim, b, c)) for c in range(CURVES)], axis=0) for dim, a, b in pairs])
    at = lambda x: np.sort(x)[min(len(x) - 1, int(target * len(x)))]
    reach = float(at(least(lambda dim, x, c: curves[dim].share(x, c)))) if pairs else 1.0
    cells = max(1, -(-n // CELL), int(min(REACH / max(reach, 1e-9), SAMPLE // 8, n)))
    for c in curves.values():
        c.cells = cells
    d = int(at(least(lambda dim, x, c: curves[dim].cell(x, c)))) if pairs else 0
    return curves, max(1, d)
