"""Many decisions on a row as the bits of a few longs: they are made and counted array-wise, and scanned by Spark as numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a word, and rows that are unpacked at once.
WORD, ROWS = 64, 4096
#: Groups that a task holds sums of before it gives them away.
HELD = 1024


def words(n: int) -> int:
    return max(1, -(-n // WORD))


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def struct_of(k: int) -> str:
    return "struct<" + ", ".join(f"w{i}: long" for i in range(k)) + ">"


def packed(on: np.ndarray) -> pa.Array:
    """A matrix with a row for each decision, as a struct of words for each of its columns."""
    raw = np.zeros((words(len(on)) * WORD // 8, on.shape[1]), np.uint8)
    raw[: -(-len(on) // 8)] = np.packbits(on, axis=0, bitorder="little")
    w = np.ascontiguousarray(raw.T).view("<i8")
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(w[:, i])) for i in range(w.shape[1])], names("w", w.shape[1]))


def booleans(lists: pa.Array, n: int) -> np.ndarray:
    """A matrix with a row for each place of arrays of n booleans; missing ones are False."""
    return lists.flatten().fill_null(False).to_numpy(zero_copy_only=False).reshape(-1, n).T


def pack(on: Column, n: int) -> Column:
    """An array of n booleans as a struct of words."""

    def run(lists: pa.Array) -> pa.Array:
        return packed(booleans(lists, n))

    return F.arrow_udf(_typed(run, 1), struct_of(words(n)))(on)


def _typed(run: Callable, arguments: int) -> Callable:
    """run, with the types that tell Spark what kind of function it is."""
    run.__annotations__ = {**{name: pa.Array for name in run.__code__.co_varnames[:arguments]}, "return": pa.Array}
    return run


def places(df: DataFrame, by: Sequence[str], kinds: Sequence[tuple[Sequence[str], Column | None]]) -> DataFrame:
    """(by, _kind, _lead, place, _k): of each kind, how many rows have a bit, by group and, if the kind has one, by a number.

    kinds: the columns of a kind's words, and that number. Sums are made by task, so what is shuffled are counts.
    """
    k = len(kinds[0][0])
    number = [F.lit(None).cast("double") if lead is None else lead.cast("double") for _, lead in kinds]
    rows = df.select(*by, *[x.alias(f"_lead{i}") for i, x in enumerate(number)], *[F.col(c).alias(f"_{i}w{j}") for i, (w, _) in enumerate(kinds) for j, c in enumerate(w)])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    m, apart = len(by), [lead is not None for _, lead in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def given_away() -> pa.RecordBatch:
            keys, out = list(sums), np.stack(list(sums.values())) if sums else np.zeros((0, WORD * k), np.int64)
            at, place = np.nonzero(out)
            data = [pa.array([x[i] for x in keys], fields[i]).take(pa.array(at)) for i in range(m + 2)] if keys else [pa.array([], t) for t in fields]
            return pa.RecordBatch.from_arrays([*data, pa.array(place.astype(np.int32)), pa.array(out[at, place])], names=[*by, "_kind", "_lead", "place", "_k"])

        fields = None
        for whole in batches:
            fields = [*[whole.schema.field(i).type for i in range(m)], pa.int32(), pa.float64()]
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                for i, own in enumerate(apart):
                    w = np.stack([b.column(m + len(apart) + i * k + j).to_numpy(zero_copy_only=False) for j in range(k)], 1)
                    some = np.flatnonzero(w.any(1))
                    if not len(some):
                        continue
                    used = [*range(m), *([m + i] if own else [])]
                    told = [b.column(c).take(pa.array(some)).dictionary_encode(null_encoding="encode") for c in used]
                    code = np.zeros(len(some), np.int64)
                    for d in told:
                        code = code * len(d.dictionary) + d.indices.to_numpy()
                    order = np.argsort(code, kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
                    bits = np.unpackbits(np.ascontiguousarray(w[some[order]]).view(np.uint8), axis=1, bitorder="little")
                    values = [d.dictionary.to_pylist() for d in told]
                    for at, end in zip(starts, [*starts[1:], len(order)]):
                        key = [v[d.indices[int(order[at])].as_py()] for v, d in zip(values, told)]
                        key = (*key[:m], i, key[m] if own else None)
                        n = bits[at:end].sum(0, dtype=np.int64)
                        if key in sums:
                            sums[key] += n
                        else:
                            sums[key] = n
                    if len(sums) > HELD:
                        yield given_away()
                        sums.clear()
        if sums:
            yield given_away()

    out = "".join(f"{x}, " for x in [types] if x) + "_kind int, _lead double, place int, _k long"
    counts = rows.mapInArrow(run, out)
    return counts.groupBy(*by, "_kind", "_lead", "place").agg(F.sum("_k").alias("_k"))
