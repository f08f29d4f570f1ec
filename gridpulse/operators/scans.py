"""Running values along a stream: the last value so far, the value before, sums and extremes, the next value to come.

All of them are prefix scans, so a stream need not be one task's work. With a width the stream is cut in segments, ranges
of its first order column; each segment is reduced to a row (its sum, its extreme, its last or first value), the
rows are scanned, and what a segment starts from enters it as one more row, before its own or, for scans that run
backwards, behind them. A window then runs over each segment. Nothing is shuffled but each row once, and a row a segment. Without
a width a stream is one window, which is less work where no stream is long.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.schema import Channel, Cut


@dataclass(frozen=True)
class Scan:
    """What runs: kind, over which values, up to a row or only before it."""

    kind: str
    value: Column
    upto: bool = False


def greatest_before(value: Column) -> Scan:
    """The greatest present value of the rows before."""
    return Scan("max", value)


def last_before(value: Column) -> Scan:
    """The last present value of the rows before."""
    return Scan("last", value)


def last_upto(value: Column) -> Scan:
    """The row's own value, or the last present one before it."""
    return Scan("last", value, True)


def previous(value: Column) -> Scan:
    """The value of the row before, present or not."""
    return Scan("lag", value)


def sum_upto(value: Column) -> Scan:
    """The sum of a value that is always present, the row's own included."""
    return Scan("sum", value, True)


def next_present(value: Column) -> Scan:
    """The first present value of the rows behind."""
    return Scan("next", value)


def bits_before(value: Column) -> Scan:
    """The bits that are set in any row before."""
    return Scan("or", value)


def common_upto(value: Column) -> Scan:
    """The bits that are set in all rows so far, the row's own included."""
    return Scan("and", value, True)


def position(df: DataFrame, column: str) -> Column:
    """An order column as a number: times in minutes."""
    return exprs.minutes(column) if dict(df.dtypes)[column].startswith("timestamp") else F.col(column).cast("double")


def _windows(keys: Sequence[str], order: Sequence[str | Column]) -> tuple:
    """(forwards, backwards) over the rows of keys; a backwards scan reads the rows in reverse, as frames that follow start anew at each row."""
    down = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    return Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*down)


def _running(s: Scan, value: Column, forwards, backwards) -> Column:
    before = (Window.unboundedPreceding, 0 if s.upto else -1)
    return {
        "max": lambda: F.max(value).over(forwards.rowsBetween(*before)), "sum": lambda: F.sum(value).over(forwards.rowsBetween(*before)),
        "last": lambda: F.last(value, ignorenulls=True).over(forwards.rowsBetween(*before)), "lag": lambda: F.lag(value).over(forwards),
        "next": lambda: F.last(value, ignorenulls=True).over(backwards.rowsBetween(*before)),
        "or": lambda: F.bit_or(value).over(forwards.rowsBetween(*before)), "and": lambda: F.bit_and(value).over(forwards.rowsBetween(*before)),
    }[s.kind]()


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], wanted: Mapping[str, Scan], width: float | None = None) -> DataFrame:
    """df with a column for each name of wanted; order: the stream's order, first the column that a width cuts."""
    if width is None:
        forwards, backwards = _windows(keys, order)
        return df.select("*", *[_running(s, s.value, forwards, backwards).alias(name) for name, s in wanted.items()])
    if not isinstance(order[0], str):
        raise ValueError("a stream is cut by its first order column, so that must be a column's name")
    places = {name: f"_v{k}" for k, name in enumerate(wanted)}
    # rows without a time come first, as in an order; a value that may be missing is boxed where missing counts
    segment = F.coalesce(F.floor(position(df, order[0]) / width), F.lit(-(1 << 62))).cast("long")
    boxed = {name: F.struct(s.value.alias("x")) if s.kind == "lag" else s.value for name, s in wanted.items()}
    rows = df.select("*", segment.alias("_segment"), F.lit(1).alias("_kind"), *[boxed[name].alias(p) for name, p in places.items()])
    where = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(order)])
    there = lambda p: F.when(F.col(p).isNotNull(), where)
    total = {
        "max": lambda p: F.max(p), "sum": lambda p: F.sum(p), "last": lambda p: F.max_by(p, there(p)), "lag": lambda p: F.max_by(p, where),
        "next": lambda p: F.min_by(p, there(p)), "or": lambda p: F.bit_or(p), "and": lambda p: F.bit_and(p),
    }
    ends = rows.groupBy(*keys, "_segment").agg(*[total[s.kind](places[name]).alias(places[name]) for name, s in wanted.items()])
    forwards, backwards = _windows(keys, ["_segment"])
    starts = []
    for kind, names in ((0, [n for n, s in wanted.items() if s.kind != "next"]), (2, [n for n, s in wanted.items() if s.kind == "next"])):
        if names:
            carried = [_running(replace(wanted[n], upto=False), F.col(places[n]), forwards, backwards).alias(places[n]) for n in names]
            starts.append(ends.select(*keys, "_segment", F.lit(kind).alias("_kind"), *carried).where(" OR ".join(f"{places[n]} IS NOT NULL" for n in names)))
    for s in starts:
        rows = rows.unionByName(s, allowMissingColumns=True)
    forwards, backwards = _windows([*keys, "_segment"], ["_kind", *order])
    # sums begin at nothing where a segment is its stream's first
    out = rows.select(*df.columns, "_kind", *[_running(s, F.col(places[n]), forwards, backwards).alias(places[n]) for n, s in wanted.items()]).where("_kind = 1")
    named = [(F.col(places[n])["x"] if s.kind == "lag" else F.col(places[n])).alias(n) for n, s in wanted.items()]
    return out.select(*df.columns, *named)


def fitted(df: DataFrame, channel: Channel, rows: int = 1 << 18, ts: str | None = None) -> Channel:
    """channel, with segments that hold about so many rows of all streams together; one pass tells the spans."""
    ts, order = position(df, ts or channel.ts), position(df, channel.order)
    one = df.agg(F.count("*"), F.max(ts) - F.min(ts), F.max(order) - F.min(order)).first()
    parts = max(1, math.ceil(one[0] / rows))
    return replace(channel, cut=Cut(*[max(x or 0.0, 1e-9) / parts * (1 + 1e-9) for x in one[1:]]))
