"""Whether two tables tell the same: rows found by key, columns compared one by one, numbers within a relative tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "(rows)"


def agrees(a: Column, b: Column, kind: str, tolerance: float) -> Column:
    """Equal, missing and NaN included; floating numbers may differ by tolerance times the larger, or by it if both are below 1."""
    if kind not in ("double", "float"):
        return a.eqNullSafe(b)
    near = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return a.eqNullSafe(b) | F.coalesce(near & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def compare(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """A row for each column, and one named (rows): n_compared, n_different, n_left_missing, n_right_missing, max_difference, first_difference.

    Both tables are dealt by key once, and a key's rows are reduced before they are, so repeated keys don't gather; a key that a
    table has several times counts as different under (rows). Missing under (rows) are keys that only the other
    table has; under a column, values missing where the other table has one. first_difference is the smallest key, as JSON.
    """
    columns = [c for c in left.columns if c not in on] if columns is None else list(columns)
    kinds = dict(left.dtypes)
    both = [f.select(*on, F.struct(*columns).alias("_v"), F.lit(k).alias("_side")) for k, f in enumerate((left, right))]
    side = lambda k: F.col("_side") == k
    keys = both[0].unionByName(both[1]).groupBy(*on).agg(
        F.max(F.when(side(0), F.col("_v"))).alias("l"), F.max(F.when(side(1), F.col("_v"))).alias("r"), F.count_if(side(0)).alias("_l"), F.count_if(side(1)).alias("_r")
    )
    met = (F.col("_l") > 0) & (F.col("_r") > 0)
    key = F.struct(*on)

    def told(name: str, among: Column, wrong: Column, no_left: Column, no_right: Column, gap: Column) -> Column:
        return F.struct(
            F.lit(name).alias("column"), F.count_if(among).alias("n_compared"), F.count_if(wrong).alias("n_different"), F.count_if(no_left).alias("n_left_missing"),
            F.count_if(no_right).alias("n_right_missing"), F.max(gap).alias("max_difference"), F.to_json(F.min(F.when(wrong, key))).alias("first_difference"),
        )

    none = F.lit(None).cast("double")
    lone = ~met | (F.col("_l") > 1) | (F.col("_r") > 1)
    rows = [told(ROWS, F.lit(True), lone, F.col("_l") == 0, F.col("_r") == 0, none)]
    for c in columns:
        a, b = F.col("l")[c], F.col("r")[c]
        gap = F.when(met, F.abs(a - b)) if kinds[c] in ("double", "float") else none
        rows.append(told(c, met, met & ~agrees(a, b, kinds[c], tolerance), met & a.isNull() & b.isNotNull(), met & b.isNull() & a.isNotNull(), gap))
    return keys.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
