"""Operators along time: intervals, onsets, rates, gaps of values, separability, autocorrelation, windows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.operators import ranks, scans
from gridpulse.operators.policies import apply_policy
from gridpulse.schema import Channel, Cut, holds

LONG_GAPS = (30, 60, 1440)


def interval_summary(df: DataFrame, channel: Channel = Channel()) -> DataFrame:
    rows = scans.scan(df.select(*channel.keys, channel.ts, channel.order), channel.keys, [channel.ts, channel.order], {"_p": scans.previous(F.col(channel.ts))}, channel.cut.minutes)
    d = rows.select(exprs.between_minutes("_p", channel.ts).alias("dt")).where("dt IS NOT NULL")
    pos = F.when(F.col("dt") > 0, F.col("dt"))
    counts = [
        F.count("*").alias("n_intervals"), F.count_if(F.col("dt") <= 0).alias("n_nonpositive_intervals"), F.count_if(F.col("dt") == 0).alias("n_zero_intervals"),
        F.min(pos).alias("min_minutes"), F.max(pos).alias("max_minutes"), F.avg(pos).alias("mean_minutes"),
        *[F.count_if(F.col("dt") > g).alias(f"n_intervals_gt_{g}min") for g in LONG_GAPS],
    ]
    return ranks.quantiles(d, {"median_minutes": (pos, 0.5), "p95_minutes": (pos, 0.95), "p99_minutes": (pos, 0.99)}, also=counts)


def onset_counts(df: DataFrame, flag: str, channel: Channel = Channel(), policy: str = "P2_first") -> DataFrame:
    rows = apply_policy(df, policy, channel)
    rows = scans.scan(rows, channel.keys, [channel.ts, channel.order], {"_p": scans.previous(F.col(flag))}, channel.cut.minutes)
    out = rows.select(F.col(flag).alias("f"), F.col("_p").alias("p")).agg(
        F.count_if(F.col("f") == 1).alias("n_active_rows"), F.count_if((F.col("p") == 0) & (F.col("f") == 1)).alias("onsets_0_to_1"),
        F.count_if((F.col("p") == 1) & (F.col("f") == 0)).alias("offsets_1_to_0"),
    )
    return out.select(F.lit(flag).alias("flag"), F.lit(policy).alias("duplicate_policy"), "*")


def onset_sensitivity(df: DataFrame, flag: str, channel: Channel = Channel(), policies: Sequence[str] = ("P2_first", "P3_last", "P4_identical")) -> DataFrame:
    parts = [onset_counts(df, flag, channel, p) for p in policies]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flag_transitions(df: DataFrame, flag: str, channel: Channel = Channel()) -> DataFrame:
    rows = df.select(*channel.keys, channel.ts, channel.order, F.col(flag).alias("f"))
    wanted = {"_p": scans.previous(F.struct("f", channel.ts)), "_n": scans.next_present(F.struct(channel.ts))}
    rows = scans.scan(rows, channel.keys, [channel.ts, channel.order], wanted, channel.cut.minutes).withColumn("p", F.col("_p.f"))
    return rows.where("f <> p").select(
        *channel.keys, F.lit(flag).alias("flag"), exprs.time_text(channel.ts).alias("timestamp"), exprs.transition_label(F.col("p"), F.col("f")).alias("transition"),
        exprs.between_minutes(F.col("_p")[channel.ts], channel.ts).alias("interval_before_minutes"), exprs.between_minutes(channel.ts, F.col("_n")[channel.ts]).alias("interval_after_minutes"),
    )


def rates(df: DataFrame, value: str, channel: Channel = Channel(), high: Column | None = None) -> DataFrame:
    """Rows with the step to the one before: dt, prev, rate (NULL where time does not pass), and whether either end is high."""
    rows = df.select(*channel.keys, channel.ts, channel.order, F.col(value).alias("value"), *([holds(high).alias("_high")] if high is not None else []))
    before = F.struct("value", channel.ts, channel.order, *(["_high"] if high is not None else []))
    rows = scans.scan(rows, channel.keys, [channel.ts, channel.order], {"_p": scans.previous(before)}, channel.cut.minutes)
    dt, prev = exprs.between_minutes(F.col("_p")[channel.ts], channel.ts), F.col("_p.value")
    return rows.select(
        *channel.keys, channel.ts, channel.order, "value", dt.alias("dt_minutes"), prev.alias("prev_value"),
        F.col("_p")[channel.ts].alias("prev_ts"), F.col("_p")[channel.order].alias("prev_order"), exprs.safe_rate(F.col("value") - prev, dt).alias("rate_per_min"),
        *(["_high", (F.col("_high") | F.coalesce("_p._high", F.lit(False))).alias("excursion")] if high is not None else []),
    )


def rate_summary(df: DataFrame, value: str, high: Column, channel: Channel = Channel(), policy: str = "P2_first") -> DataFrame:
    r = rates(apply_policy(df, policy, channel), value, channel, high).where("dt_minutes IS NOT NULL")
    rate, a = F.col("rate_per_min"), F.abs("rate_per_min")
    normal, exc = F.when(~F.col("excursion"), a), F.when(F.col("excursion"), a)
    counts = [
        F.count(rate).alias("n_rates_computed"), F.count_if(rate.isNull()).alias("n_intervals_excluded_nonpositive_or_missing"),
        F.min(rate).alias("rate_min_per_min"), F.max(rate).alias("rate_max_per_min"), F.min(a).alias("rate_min_abs_per_min"),
        F.count(normal).alias("normal_mode_n_rates"), F.max(normal).alias("normal_mode_max_abs_per_min"),
        F.count(exc).alias("excursion_mode_n_rates"), F.max(exc).alias("excursion_mode_max_abs_per_min"),
    ]
    out = ranks.quantiles(r, {
        "rate_median_per_min": (rate, 0.5), "rate_p95_abs_per_min": (a, 0.95), "rate_p99_abs_per_min": (a, 0.99), "normal_mode_p99_abs_per_min": (normal, 0.99),
    }, also=counts)
    return out.select(F.lit(value).alias("value_column"), "*")


def top_rate_transitions(df: DataFrame, value: str, n: int = 30, threshold: float = 1.0, channel: Channel = Channel(), policy: str = "P2_first") -> DataFrame:
    r = rates(apply_policy(df, policy, channel), value, channel).where(F.abs("rate_per_min") > threshold)
    return r.orderBy(F.abs("rate_per_min").desc(), channel.ts, channel.order).limit(n).select(
        *channel.keys, exprs.time_text(channel.ts).alias("timestamp"), exprs.time_text("prev_ts").alias("prev_timestamp"), "dt_minutes", "prev_value", "value",
        "rate_per_min", F.col(channel.order).alias("raw_line"), F.col("prev_order").alias("prev_raw_line"),
    )


def autocorrelation(df: DataFrame, value: str, lags: Sequence[int], channel: Channel = Channel(), cadence: int = 15) -> DataFrame:
    """Pearson correlation of the series with itself k rows before, for all lags in one pass."""
    w = channel.window()
    lagged = df.select(F.col(value).alias("v"), *[F.lag(value, k).over(w).alias(f"l{k}") for k in lags])
    one = lagged.agg(*[F.struct(F.corr("v", f"l{k}").alias("r"), F.count_if(F.col(f"l{k}").isNotNull() & F.col("v").isNotNull()).alias("n")).alias(f"c{k}") for k in lags])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("lag_samples"), F.col(f"c{k}.r").alias("autocorrelation"), F.col(f"c{k}.n").alias("n_pairs")) for k in lags])
    out = one.select(F.explode(rows).alias("x")).select("x.*")
    return out.select(
        F.lit(value).alias("column"), "lag_samples", (F.col("lag_samples") * cadence).alias("approx_time_if_15min_cadence_minutes"), "autocorrelation", "n_pairs"
    )


def value_gaps(df: DataFrame, value: str, min_gap: float) -> DataFrame:
    """Neighbouring distinct values further apart than min_gap, widest first.

    Values are put in ranges by their size, and in cells of these. Only the values of a cell, the ends of a range's cells, and the
    ends of the ranges, whose number is bounded whatever the values, meet in one ordering.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL").distinct()
    own = ranks.celled(v, "v")
    cells = own.groupBy("_b", "_s").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranges = cells.groupBy("_b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    steps = [
        own.select("v", F.lead("v").over(Window.partitionBy("_b", "_s").orderBy("v")).alias("next")),
        cells.select(F.col("hi").alias("v"), F.lead("lo").over(Window.partitionBy("_b").orderBy("_s")).alias("next")),
        ranges.select(F.col("hi").alias("v"), F.lead("lo").over(Window.orderBy("_b")).alias("next")),
    ]
    found = reduce(DataFrame.unionByName, steps).where(F.col("next") - F.col("v") > min_gap)
    return found.select(
        F.col("v").alias("lower_observed_value"), F.col("next").alias("upper_observed_value"), (F.col("next") - F.col("v")).alias("gap_size"),
        F.lit(0).cast("long").alias("n_values_in_between_observed"),
    ).orderBy(F.desc("gap_size"), "lower_observed_value")


def separability(df: DataFrame, value: str, flags: Sequence[str]) -> DataFrame:
    """The threshold and direction that best tell a flag from a value: cumulative counts give every threshold's accuracy.

    The first best wins, by ascending threshold, >= before <=. Windows run over ranges of values, and over the distinct
    values of a range.
    """
    long = df.select(F.col(value).cast("double").alias("v"), *[F.col(f).cast("double").alias(f) for f in flags]).unpivot(["v"], list(flags), "flag", "f")
    counts = long.where("v IS NOT NULL AND f IS NOT NULL").groupBy("flag", "v").agg(F.count_if(F.col("f") == 1).alias("n1"), F.count_if(F.col("f") != 1).alias("n0"))
    c = ranks.running(counts, "v", ("n1", "n0"), ["flag"]).selectExpr("flag", "v", "n1", "n0", "up_to_n1 AS c1", "up_to_n0 AS c0", "all_n1 AS t1", "all_n0 AS t0")
    c = c.where("t1 > 0 AND t0 > 0")
    n = F.col("t1") + F.col("t0")
    ge = (F.col("t1") - F.col("c1") + F.col("n1") + F.col("c0") - F.col("n0")) / n
    le = (F.col("c1") + F.col("t0") - F.col("c0")) / n
    tried = c.withColumn("x", F.explode(F.array(F.struct(ge.alias("acc"), F.lit(1).alias("up")), F.struct(le.alias("acc"), F.lit(0).alias("up")))))
    best = F.max_by(F.struct("v", "x"), F.struct(F.col("x.acc"), -F.col("v"), F.col("x.up")))
    on, off = F.when(F.col("n1") > 0, F.col("v")), F.when(F.col("n0") > 0, F.col("v"))
    got = tried.groupBy("flag").agg(
        F.max("t1").alias("n_flag_1"), F.min(on).alias("lo1"), F.max(on).alias("hi1"), F.max("t0").alias("n_flag_0"), F.min(off).alias("lo0"), F.max(off).alias("hi0"), best.alias("b")
    )
    return got.select(
        F.lit(value).alias("value_column"), "flag", "n_flag_1", "lo1", "hi1", "n_flag_0", "lo0", "hi0",
        ((F.col("lo1") <= F.col("hi0")) & (F.col("lo0") <= F.col("hi1"))).alias("classes_overlap"), F.col("b.v").alias("best_threshold"),
        F.when(F.col("b.x.up") == 1, ">=").otherwise("<=").alias("best_threshold_direction"), F.col("b.x.acc").alias("threshold_rule_accuracy"),
    )


def band_transitions(df: DataFrame, value: str, band: float = 100.0, channel: Channel = Channel()) -> DataFrame:
    """Rows at which the value crosses the band, upwards or downwards, while time passes."""
    r = rates(df, value, channel).where("dt_minutes > 0")
    up, down = (F.col("prev_value") < band) & (F.col("value") >= band), (F.col("prev_value") >= band) & (F.col("value") < band)
    return r.where(up | down).withColumn("direction", F.when(up, "rise").otherwise("fall"))


def valid_pairs(df: DataFrame, value: str, channel: Channel = Channel(), longest: float = 60.0) -> DataFrame:
    """Steps between neighbouring rows that are no longer than so many minutes, with both values: |change| and |change| a minute."""
    r = rates(df, value, channel).where((F.col("dt_minutes") > 0) & (F.col("dt_minutes") <= longest) & F.col("value").isNotNull() & F.col("prev_value").isNotNull())
    return r.select(*channel.keys, channel.ts, F.abs("rate_per_min").alias("rate"), F.abs(F.col("value") - F.col("prev_value")).alias("jump"))


def sliding_windows(df: DataFrame, length: float, step: float = 60.0, ts_min: str = "ts_min", keys: Sequence[str] = ()) -> DataFrame:
    """Each row once for every window start t0 + k * step with start <= t < start + length <= last t, by stream."""
    span = df.groupBy(*keys).agg(F.min(ts_min).alias("_t0"), F.max(ts_min).alias("_t1"))
    rows = df.join(span, list(keys)) if keys else df.crossJoin(F.broadcast(span))  # one row
    t = F.col(ts_min) - F.col("_t0")
    last = F.least(F.floor(t / step), F.floor((F.col("_t1") - F.col("_t0") - length) / step))
    first = F.greatest(F.lit(0), F.floor((t - length) / step) + 1)
    starts = F.when(last >= first, F.sequence(first.cast("long"), last.cast("long")))
    return rows.withColumn("_k", F.explode(starts)).withColumn("window_start", F.col("_t0") + F.col("_k") * step).drop("_k", "_t0", "_t1")


def horizon_features(windowed: DataFrame, value: str, by: Sequence[str], ts_min: str = "ts_min", cadence: float = 15.0) -> DataFrame:
    """Last, maximum, mean, slope, spread, longest gap and missing share of each window's samples."""
    gap = F.col(ts_min) - F.lag(ts_min).over(Window.partitionBy(*by).orderBy(ts_min))
    w = windowed.withColumn("_gap", gap)
    span = F.max(ts_min) - F.min(ts_min)
    rise = F.max_by(value, ts_min) - F.min_by(value, ts_min)
    return w.groupBy(*by).agg(
        F.max_by(value, ts_min).alias("last"), F.max(value).alias("maximum"), F.avg(value).alias("mean"),
        F.when(span > 0, rise / span).otherwise(F.lit(0.0)).alias("slope_per_min"), F.stddev_pop(value).alias("variability"),
        F.coalesce(F.max("_gap"), F.lit(0.0)).alias("max_gap_min"), F.greatest(F.lit(0.0), 1 - F.count("*") / (span / cadence + 1)).alias("missing_frac"),
    )


def pane_features(df: DataFrame, value: str, lengths: Sequence[float], step: float = 60.0, ts_min: str = "ts_min", keys: Sequence[str] = (), cadence: float = 15.0, cut: Cut = Cut()) -> DataFrame:
    """horizon_features() of all sliding_windows() of several lengths: keys, length, window_start and the features.

    Rows are reduced once to panes, which every window is made of whole: their first and last sample, extremes, sums, and longest
    gap inside and before. What goes to each window that holds it is a pane, not its rows.
    """
    parts = [Fraction(x).limit_denominator(10**6) for x in (step, *lengths)]
    pane = reduce(lambda a, b: Fraction(math.gcd(a.numerator * b.denominator, b.numerator * a.denominator), a.denominator * b.denominator), parts)
    every, width = int(parts[0] / pane), float(pane)
    span = df.groupBy(*keys).agg(F.min(ts_min).alias("_t0"), F.max(ts_min).alias("_t1"), F.avg(value).alias("_c"))
    rows = df.select(*keys, F.col(ts_min).alias("_t"), F.col(value).cast("double").alias("_v"))
    rows = rows.join(span, list(keys)) if keys else rows.crossJoin(F.broadcast(span))  # one row
    rows = rows.withColumn("_j", F.floor((F.col("_t") - F.col("_t0")) / width).cast("long"))
    own = [*keys, "_t0", "_t1", "_j"]
    rows = scans.scan(rows, keys, ["_t"], {"_p": scans.previous(F.struct("_t", "_j"))}, cut.minutes)
    gap, same = F.col("_t") - F.col("_p._t"), F.col("_p._j") == F.col("_j")
    off = F.col("_v") - F.col("_c")  # sums of squares are taken around the stream's mean
    panes = rows.groupBy(*own).agg(
        F.count("*").alias("_n"), F.count("_v").alias("_k"), F.sum("_v").alias("_sum"), F.sum(off).alias("_s"), F.sum(off * off).alias("_q"), F.max("_v").alias("_hi"),
        F.min("_v").alias("_lo"), F.min(F.struct("_t", "_v")).alias("_first"), F.max(F.struct("_t", "_v")).alias("_last"), F.max(F.when(same, gap)).alias("_gap"), F.max(F.when(~same, gap)).alias("_before"),
        F.max(F.when(~same, F.col("_p._j"))).alias("_behind"),
    ).withColumns({"_t": F.col("_first._t"), "_u": F.col("_last._t"), "_x": F.col("_first._v"), "_y": F.col("_last._v")})
    starts = []
    for length, part in zip(lengths, parts[1:]):
        m = int(part / pane)
        low = F.greatest(F.lit(0), F.ceil((F.col("_j") - m + 1) / every)).cast("long")
        high = F.least(F.floor(F.col("_j") / every), F.floor((F.col("_t1") - F.col("_t0") - float(length)) / step)).cast("long")
        known = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
        named = F.lit(float(length)).alias("length")
        starts.append(F.transform(known, lambda k: F.struct(named, k.alias("k"))))  # noqa: B023
    held = panes.withColumn("_w", F.explode(F.concat(*starts))).select("*", F.col("_w.length").alias("length"), F.col("_w.k").alias("_at"))
    w = held.groupBy(*keys, "_t0", "length", "_at").agg(
        *[F.sum(c).alias(c) for c in ("_n", "_k", "_sum", "_s", "_q")], F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"), F.min("_t").alias("_t"), F.max("_u").alias("_u"),
        F.min_by("_x", "_t").alias("_x"), F.max_by("_y", "_u").alias("_y"), F.max("_gap").alias("_gap"),
        # the gap before a pane is the window's own if the sample before lies in it: so all sums are numbers, and no window's panes are listed
        F.max(F.when(F.col("_behind") >= F.col("_at") * every, F.col("_before"))).alias("_across"),
    )
    length_, rise = F.col("_u") - F.col("_t"), F.col("_y") - F.col("_x")
    spread = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_k") - F.pow(F.col("_s") / F.col("_k"), 2))))
    return w.select(
        *keys, "length", (F.col("_t0") + F.col("_at") * step).alias("window_start"), F.col("_y").alias("last"), F.col("_hi").alias("maximum"), (F.col("_sum") / F.col("_k")).alias("mean"),
        F.when(length_ > 0, rise / length_).otherwise(F.lit(0.0)).alias("slope_per_min"), F.when(F.col("_k") > 0, spread).alias("variability"),
        F.coalesce(F.greatest("_gap", "_across"), F.lit(0.0)).alias("max_gap_min"), F.greatest(F.lit(0.0), 1 - F.col("_n") / (length_ / cadence + 1)).alias("missing_frac"),
    )
