"""Joins along time: within a window, nearest in time, shared times."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.operators import ranks


def within(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, width_minutes: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows with |right_ts - left_ts| <= width, as an equi-join on time slots; a left row of no pair appears too.

    Each left row meets the three slots that its window can touch; the exact condition is part of the join. Slots are
    as wide as the window, so a row meets about three windows' worth of the other side, never the whole. A left row
    appears without a partner for each slot in which it has none, so count partners, not rows. Columns of the two
    sides must differ, but for the keys.
    """
    slot = lambda ts: F.floor(exprs.minutes(ts) / width_minutes).cast("long")
    a = left.withColumn("_slot", F.explode(F.sequence(slot(left_ts) - 1, slot(left_ts) + 1))).alias("a")
    b = right.withColumn("_slot", slot(right_ts)).alias("b")
    near = F.abs(exprs.between_minutes(F.col(f"a.{left_ts}"), F.col(f"b.{right_ts}"))) <= width_minutes
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "_slot")]
    named = [F.col(f"a.{c}") for c in left.columns] + [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, reduce(lambda x, y: x & y, [*same, near]), "left").select(*named)


def context(onsets: DataFrame, other: DataFrame, onset_ts: str, ts: str, width: float, aggregates: Sequence[Column], by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates of the other table's rows within so many minutes of each onset, with their count and least distance."""
    joined = within(onsets, other, onset_ts, ts, width, keys)
    return joined.groupBy(*by).agg(
        F.count(ts).alias("n_rows_in_window"), F.min(F.abs(exprs.between_minutes(onset_ts, ts))).alias("nearest_delta_minutes"), *aggregates
    )


def nearest_times(times: DataFrame, source: str, ts: str, keys: Sequence[str] = (), span_minutes: float = 1440.0) -> DataFrame:
    """For each ordered pair of sources a < b and each distinct time of a, the distance to b's nearest time, in minutes.

    Each time goes to the pairs its source is in, by an equi-join with the table of sources. A pair is dealt in spans of
    time; b's last time before a span and its first after it come from a table with a row for each pair and span, so a
    window holds one span. Distances are cut to whole seconds.
    """
    t = times.select(*keys, F.col(source).alias("s"), F.col(ts).alias("t")).distinct()
    names = t.agg(F.array_sort(F.collect_set("s")).alias("all")).select(F.explode("all").alias("s"), "all")
    other = F.explode(F.filter("all", lambda x: x != F.col("s")))
    pairs = names.select("s", other.alias("o")).select(
        "s", F.least("s", "o").alias("file_a"), F.greatest("s", "o").alias("file_b"), (F.col("s") < F.col("o")).alias("is_a")
    )
    by = [*keys, "file_a", "file_b"]
    tagged = t.join(F.broadcast(pairs), "s").withColumn("_span", F.floor(exprs.minutes("t") / span_minutes).cast("long"))  # a row for any two sources
    tagged = tagged.withColumn("_b", F.when(~F.col("is_a"), F.col("t")))
    spans = tagged.groupBy(*by, "_span").agg(F.min("_b").alias("_first"), F.max("_b").alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*by, "_span", F.max("_last").over(earlier).alias("_earlier"), F.min("_first").over(later).alias("_later"))
    # RANGE frames take in the row of b at the same time
    up = Window.partitionBy(*by, "_span").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*by, "_span").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = tagged.select(*by, "_span", "t", "is_a", F.max("_b").over(up).alias("_p"), F.min("_b").over(down).alias("_n")).join(spans, [*by, "_span"])
    secs = lambda x: F.floor(F.abs(F.timestamp_diff("MICROSECOND", F.col("t"), x)) / 1_000_000)
    before, after = F.coalesce("_p", "_earlier"), F.coalesce("_n", "_later")
    return near.select(*by, "t", "is_a", (F.least(secs(before), secs(after)) / 60.0).alias("delta"))


def cross_alignment(times: DataFrame, source: str, ts: str, tolerance: float = 15.0) -> DataFrame:
    d = nearest_times(times, source, ts)
    mine = F.when(F.col("is_a"), F.col("delta"))
    by = ["file_a", "file_b"]
    middle = ranks.quantiles(d, {"nearest_delta_median_minutes": (mine, 0.5), "nearest_delta_p95_minutes": (mine, 0.95)}, by)
    out = d.groupBy(*by).agg(
        F.count_if("is_a").alias("n_timestamps_a"), F.count_if(~F.col("is_a")).alias("n_timestamps_b"), F.count_if(mine == 0).alias("exact_matches"),
        F.count_if(mine <= tolerance).alias(f"matches_within_{tolerance:g}min"), F.min(mine).alias("nearest_delta_min_minutes"), F.max(mine).alias("nearest_delta_max_minutes"),
    )
    return out.join(middle, by, "left")


def nearest_label(points: DataFrame, samples: DataFrame, at: str, label: Column, ts: str, order: str, keys: Sequence[str] = (), name: str = "label") -> DataFrame:
    """points with the label of the sample at the time `at`, the first of several; NULL without one.

    The times asked for are times of samples, so the nearest sample is an equal one.
    """
    named = samples.groupBy(*keys, F.col(ts).alias("_at")).agg(F.min_by(label, order).alias(name))
    asked = points.withColumn("_at", F.col(at))
    return asked.join(named, [*keys, "_at"], "left").drop("_at")


def shared_by_all(times: DataFrame, source: str, ts: str) -> DataFrame:
    """How many times every source has."""
    n = times.agg(F.count_distinct(source).alias("n_sources"))
    per = times.groupBy(ts).agg(F.count_distinct(source).alias("k"))
    return per.crossJoin(F.broadcast(n)).agg(F.max("n_sources").alias("n_sources"), F.count_if(F.col("k") == F.col("n_sources")).alias("n_shared_timestamps"))


def shared_repeats(times: DataFrame, source: str, ts: str) -> DataFrame:
    """For each pair of sources, how many repeated times either has and both have."""
    rep = times.groupBy(source, ts).count().where("count > 1").select(F.col(source).alias("s"), F.col(ts).alias("t"))
    n = rep.groupBy("s").agg(F.count("*").alias("n"))
    a = rep.select(F.col("s").alias("file_a"), "t").join(rep.select(F.col("s").alias("file_b"), "t"), "t").where("file_a < file_b")
    both = a.groupBy("file_a", "file_b").agg(F.count("*").alias("shared_repeated_timestamps"))
    pairs = n.select(F.col("s").alias("file_a"), F.col("n").alias("repeated_groups_a")).join(
        n.select(F.col("s").alias("file_b"), F.col("n").alias("repeated_groups_b")), F.col("file_a") < F.col("file_b")
    )
    return pairs.join(both, ["file_a", "file_b"], "left").select(
        "file_a", "file_b", "repeated_groups_a", "repeated_groups_b", F.coalesce("shared_repeated_timestamps", F.lit(0)).alias("shared_repeated_timestamps")
    )
