"""Exact quantiles and running sums over many values: no task holds or orders all distinct values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges between a power of two and the next, and cells of a range.
STEPS, CELLS = 256, 1024
#: Of an approximate quantile: 1 / its relative error of rank, and how much of all ranks is searched on either side of it.
ACCURACY, MARGIN = 100_000, 4e-5
#: So many values are ordered without a search; beyond, MARGIN is more than two ranks.
FEW = 1 << 16


def magnitude(v: Column) -> Column:
    """A whole number that never falls as v grows: ranges of relative width 2^(1/STEPS), at most about a million of them."""
    size = F.floor((F.log2(F.abs(v)) + 1100) * STEPS).cast("long")
    return F.when(v == 0, F.lit(0).cast("long")).when(F.isnan(v), F.lit(1 << 40)).when(v > 0, size).otherwise(-size)


def celled(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """df with _b, the range of a value's size, and _s, its cell in it: equal parts between the range's least and greatest value.

    Cells follow where the values are, so values close together are not one cell.
    """
    v = F.col(value).cast("double")
    rows = df.withColumn("_b", magnitude(v))
    ends = rows.groupBy(*by, "_b").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    part = (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(part), F.lit(CELLS - 1))).otherwise(F.lit(0))
    return rows.join(ends, [*by, "_b"]).withColumn("_s", F.coalesce(cell, F.lit(0)).cast("long")).drop("_lo", "_hi")


def quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, float]], by: Sequence[str] = (), also: Sequence[Column] = (), few: bool = False) -> DataFrame:
    """by, also, and for each name of wanted its column's exact quantile with linear interpolation; missing values don't count.

    also: aggregates to compute in the first pass. It finds approximate quantiles a little below and above each wanted one, which
    are known to enclose it; the second counts the values below, and by value those between, which are a share of MARGIN on
    either side, or all if there are FEW; only these are ordered. few: there are few groups, whatever the input, so what the first
    pass finds is broadcast to the second. Without by there is one row, with NULLs where a column has no
    value; with by, groups without any value have no row, unless also asks for one.
    """
    columns: list[Column] = []
    place: dict[str, int] = {}
    specs = []
    for name, (c, p) in wanted.items():
        k = place.setdefault(str(c), len(columns))
        if k == len(columns):
            columns.append(c.cast("double"))
        specs.append((k, float(p), name))
    top = F.lit(float("inf"))
    whole = lambda c: F.nanvl(c, top)  # noqa: E731  NaN is as great as can be
    edges = {k: sorted({e for c, p, _ in specs if c == k for e in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))}) for k in range(len(columns))}
    about = [F.percentile_approx(whole(c), edges[k], ACCURACY).alias(f"_a{k}") for k, c in enumerate(columns)]
    first = df.groupBy(*by).agg(*also, *[F.count(c).alias(f"_n{k}") for k, c in enumerate(columns)], *about)
    drop = [f"_{x}{k}" for k in range(len(columns)) for x in "na"]
    told = first.select(*by, *drop)
    values = df.select(*by, *[c.alias(f"_x{k}") for k, c in enumerate(columns)])
    rows = values.join(F.broadcast(told) if few else told, list(by)) if by else values.crossJoin(F.broadcast(told))  # one row

    def entry(i: int, k: int, p: float) -> Column:
        """The value as an entry of the i-th quantile: itself if it lies between the edges, NULL if below."""
        x, n = whole(F.col(f"_x{k}")), F.col(f"_n{k}")
        edge = lambda q: F.get(f"_a{k}", F.lit(edges[k].index(q)))
        low = F.when((n > FEW) & F.lit(p > MARGIN), edge(max(p - MARGIN, 0.0))).otherwise(F.lit(float("-inf")))
        high = F.when((n > FEW) & F.lit(p < 1 - MARGIN), edge(min(p + MARGIN, 1.0))).otherwise(top)
        return F.when(x <= high, F.struct(F.lit(i).alias("i"), n.alias("n"), F.lit(p).alias("p"), F.when(x >= low, F.col(f"_x{k}")).alias("v")))

    entries = F.array_compact(F.array(*[entry(i, k, p) for i, (k, p, _) in enumerate(specs)]))
    each = rows.select(*by, F.explode(entries).alias("_e")).select(*by, F.col("_e.i").alias("_i"), F.col("_e.v").alias("_v"), F.col("_e.n").alias("_all"), F.col("_e.p").alias("_p"))
    counts = each.groupBy(*by, "_i", "_v").agg(F.count("*").alias("_n"), F.max("_all").alias("_all"), F.max("_p").alias("_p"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_upto", upto).withColumn("_at", (F.col("_all") - 1) * F.col("_p"))
    at = lambda r: F.max(F.when((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")), F.col("_v")))
    found = counts.groupBy(*by, "_i").agg(at(F.floor("_at")).alias("_lo"), at(F.ceil("_at")).alias("_hi"), F.max("_at").alias("_at"))
    up, lost = F.col("_at") - F.floor("_at"), F.raise_error(F.lit("a quantile lies beyond its approximate edges")).cast("double")
    value = F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), lost).when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((1 - up) * F.col("_lo") + up * F.col("_hi"))
    last = found.withColumn("_q", value).groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, (_, _, name) in enumerate(specs)])
    if not also:
        return last
    out = first.drop(*drop)
    return out.join(last, list(by), "left") if by else out.crossJoin(last)  # one row each


def counted_quantiles(df: DataFrame, value: str, wanted: Mapping[str, float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """by and the wanted quantiles of one column, of a table whose rows are dear to compute or stand for many: one pass counts them by value.

    weight: how often a row counts. Sums of the counts by range of size tell the range that holds a rank, and only its values are
    ordered; for events and the like, of which a range holds few, as all of a range's different values meet in one task. Without by
    there is one row; with by, groups without any value have no row.
    """
    n = F.col(weight).cast("long") if weight else F.lit(1)
    counts = df.select(*by, F.col(value).cast("double").alias("_v"), n.alias("_n")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.sum("_n").alias("_n"))
    counts = counts.withColumn("_b", magnitude(F.col("_v")))

    def holding(d: DataFrame, parts: list[str], order: str) -> DataFrame:
        """Those rows of d within which the _k-th value of their part lies; _k then counts from the row's own first."""
        upto = F.sum("_n").over(Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        d = d.withColumn("_last", upto).where("_k < _last AND _k >= _last - _n")
        return d.withColumn("_k", F.col("_k") - F.col("_last") + F.col("_n")).drop("_n", "_last")

    ranges = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_n"))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(wanted.values())]))
    ranges = ranges.withColumn("_all", F.sum("_n").over(Window.partitionBy(*by))).withColumn("_q", places)
    ranges = ranges.select(*by, "_b", "_n", F.col("_q.i").alias("_i"), ((F.col("_all") - 1) * F.col("_q.p")).alias("_at"))
    ranges = ranges.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).withColumn("_k", F.col("_r"))
    held = counts.join(holding(ranges, [*by, "_i", "_r"], "_b"), [*by, "_b"])
    each = holding(held, [*by, "_i", "_r"], "_v").groupBy(*by, "_i").agg(F.min_by("_v", "_r").alias("_lo"), F.max_by("_v", "_r").alias("_hi"), F.max("_at").alias("_at"))
    up = F.col("_at") - F.floor("_at")
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((1 - up) * F.col("_lo") + up * F.col("_hi"))
    return each.withColumn("_q", value).groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(wanted)])


def running(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """df, which has a row for each value of a group, with up_to_<c>, the sum of c over the group's rows up to it, and all_<c>.

    Ranges of values and their cells are summed first, so a window meets the ranges, a range's cells, or a cell's rows.
    """
    rows = celled(df, value, by)
    add = lambda d, on: d.groupBy(*by, *on).agg(*[F.sum(c).alias(c) for c in sums])
    before = lambda c, on, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by, *on).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = add(rows, ["_b", "_s"])
    ranges = add(cells, ["_b"])
    all_ = Window.partitionBy(*by)
    ranges = ranges.select(*by, "_b", *[before(c, [], "_b").alias(f"_r_{c}") for c in sums], *[F.sum(c).over(all_).alias(f"all_{c}") for c in sums])
    cells = cells.select(*by, "_b", "_s", *[before(c, ["_b"], "_s").alias(f"_c_{c}") for c in sums]).join(ranges, [*by, "_b"])
    own = Window.partitionBy(*by, "_b", "_s").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(cells, [*by, "_b", "_s"])
    rows = reduce(lambda d, c: d.withColumn(f"up_to_{c}", F.col(f"_r_{c}") + F.col(f"_c_{c}") + F.sum(c).over(own)), sums, rows)
    return rows.drop("_b", "_s", *[f"_{x}_{c}" for c in sums for x in "rc"])
