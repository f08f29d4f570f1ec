"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Lengths are whole numbers up to the capacity, so packing needs only how many pieces there are of each
length: a table of at most `capacity` rows, whatever the size of the corpus. The driver packs that
table: a bin is filled greedily, each time with the longest piece that fits; then its smallest piece is
replaced by two unpacked pieces that fill the gap more tightly. The same bin is repeated as often as
the counts allow. Each piece then finds its place by its number among the pieces of its length; the
numbers come from counts by task and length, so no length, however common, meets in one task.

Defined results: a null or empty text is a piece with the end token alone; repeated rows are packed
each for itself; an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.bpe_codec import codec
from gridpulse.llm.common import bounded_batches, durable, lean

CAPACITY = 2048


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, rows: int = 256) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, and part and nth, the writing task and the place there among its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        with codec(path) as c:
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    batch, out = whole.slice(at, rows), []
                    for doc, ids in zip(batch.column(0).to_pylist(), c.ids(batch.column(1).to_pylist())):
                        ids += end
                        for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                            part_ids = ids[start : start + 4 * capacity]
                            n = len(part_ids) // 4
                            out.append((doc, piece, start // 4, n, zlib.crc32(part_ids), part, nth[n]))
                            nth[n] += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col, kind) for col, kind in zip(zip(*out), _KINDS)], names=_NAMES
                    )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(
        lean(run, "codec"), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    )


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order, how many such bins), which together use every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while left.any():
        held = np.flatnonzero(left)
        used: list[int] = []
        gap = capacity
        free = left.copy()

        def take(n: int) -> None:
            nonlocal gap, held
            used.append(n)
            gap -= n
            free[n] -= 1
            if not free[n]:
                held = held[held != n]

        while len(held) and (k := int(np.searchsorted(held, gap, "right"))):
            take(int(held[k - 1]))
        if gap and len(used) > 1 and len(held):
            small = min(used)
            room = gap + small
            partner = np.searchsorted(held, room - held, "right") - 1
            ok = partner >= 0
            a, b = held[ok], held[partner[ok]]
            ok = (a != b) | (free[a] > 1)
            a, b = np.append(a[ok], 0), np.append(b[ok], 0)
            best = int(np.argmax(a + b))
            if a[best] + b[best] > small:
                used.remove(small)
                free[small] += 1
                used += [int(a[best]), int(b[best])]
        lengths, times = np.unique(used, return_counts=True)
        repeat = int((left[lengths] // times).min())
        left[lengths] -= times * repeat
        bins.append((used, repeat))
    return bins


def places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first number of each run of slots, and that run's first bin and offset; slot k of a run is in bin first + k."""
    found: dict[int, list[list[int]]] = {}
    base = 0
    for used, repeat in bins:
        offset = 0
        for n in used:
            runs = found.setdefault(n, [[0], [], []])
            runs[1].append(base)
            runs[2].append(offset)
            runs[0].append(runs[0][-1] + repeat)
            offset += n
        base += repeat
    return {n: tuple(np.array(x, np.int64) for x in runs) for n, runs in found.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a written table, as the numbers in it must not change.

    The counts collected have at most `capacity` rows; so, up to a small factor, has the table of slots sent out.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = places(best_two_fit(counts, capacity))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = pieces.join(base, ["length", "part"]).select(*names, (F.col("base") + F.col("nth")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                firsts, bins, offsets = slots[int(n)]
                k = np.searchsorted(firsts, number[at], "right") - 1
                seq[at], offset[at] = bins[k] + number[at] - firsts[k], offsets[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(lean(run), kinds)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(durable(cut(docs, path, capacity), "pieces"), capacity)
