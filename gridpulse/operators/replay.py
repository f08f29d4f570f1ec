"""Leakage-controlled calibration and replay, persistence of alerts, and confidence intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.operators import evaluate, quality, ranks, scans, timeseries
from gridpulse.operators.islands import islands
from gridpulse.operators.timeseries import valid_pairs
from gridpulse.schema import Channel, Cut, holds
from gridpulse.sources.scratch import written

#: Quantiles of the calibration's primary and sensitivity thresholds; None is the maximum.
CAL_RULES = {
    "F1_rate": ("rate", {"primary": 0.999, "sensitivity:q:0.99": 0.99, "sensitivity:q:0.9999": 0.9999, "sensitivity:max": None}),
    "F2_upper": ("value", {"primary": None, "sensitivity:q:0.99": 0.99, "sensitivity:q:0.999": 0.999}),
    "F4_jump": ("jump", {"primary": 0.999, "sensitivity:q:0.99": 0.99, "sensitivity:q:0.9999": 0.9999, "sensitivity:max": None}),
}


def split_chronological(df: DataFrame, cutoff: float, ts_min: str = "ts_min") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(ts_min) < cutoff), df.where(F.col(ts_min) >= cutoff)


def guard_no_test_leakage(df: DataFrame, cutoff: float, ts_min: str = "ts_min") -> DataFrame:
    """df, whose run fails at a row that isn't before the cutoff; checked as rows pass, without a run of its own."""
    late = F.col(ts_min) >= cutoff
    return df.where(F.when(late, F.raise_error(F.lit("a row of the test period is in the calibration")).cast("boolean")).otherwise(True))


def calibrate(df: DataFrame, value: str, cutoff: float, ts_min: str, channel: Channel, excluded: float = 0.0) -> DataFrame:
    """(rule, variant, threshold) from the rows before the cutoff, with n_records and n_valid_pairs.

    excluded: the last minutes before the cutoff that are left out, for the sensitivity to what already belongs to an alarm.
    """
    df = df.where(F.col(ts_min) < cutoff - excluded)
    cal = guard_no_test_leakage(split_chronological(df, cutoff, ts_min)[0], cutoff, ts_min)
    pairs = valid_pairs(cal, value, channel)

    def limits(df: DataFrame, rules: dict, count: str) -> DataFrame:
        named = {f"{rule}|{variant}".replace(".", "_"): (column, q) for rule, (column, variants) in rules.items() for variant, q in variants.items()}
        most = [F.count("*").alias(count), *[F.max(c).alias(name) for name, (c, q) in named.items() if q is None]]
        return ranks.quantiles(df, {name: (F.col(c), q) for name, (c, q) in named.items() if q is not None}, also=most)

    steps = limits(pairs, {rule: x for rule, x in CAL_RULES.items() if x[0] != "value"}, "n_valid_pairs")
    values = limits(cal, {"F2_upper": (value, CAL_RULES["F2_upper"][1])}, "n_records")
    one = values.crossJoin(steps)  # one row each
    names = [c for c in one.columns if "|" in c]
    long = one.unpivot(["n_records", "n_valid_pairs"], names, "name", "threshold")
    part = lambda k: F.get(F.split("name", r"\|"), F.lit(k))
    return long.select(part(0).alias("rule"), F.replace(part(1), F.lit("0_"), F.lit("0.")).alias("variant"), F.bround("threshold", 4).alias("threshold"), "n_records", "n_valid_pairs")


def sustained_alerts(df: DataFrame, ks: Sequence[int], keys: Sequence[str], flagged: str = "flagged", valid: str = "valid", ts_min: str = "ts_min", order: str = "idx", cut: Cut = Cut()) -> DataFrame:
    """By stream, for each k the first time that completes k flagged and valid samples in a row: k rows behind the last that isn't."""
    on = scans.scan(df.withColumn("_on", holds(F.col(flagged) & F.col(valid))), keys, [order], {"_nth": scans.sum_upto(F.lit(1))}, cut.steps)
    on = scans.scan(on, keys, [order], {"_off": scans.last_upto(F.when(~F.col("_on"), F.col("_nth")))}, cut.steps)
    run = F.col("_nth") - F.coalesce("_off", F.lit(0))
    return on.where("_on").groupBy(*keys).agg(*[F.min(F.when(run >= k, F.col(ts_min))).alias(f"sustained_k{k}_ts_min") for k in ks])


def pre_window_stats(flagged: DataFrame, zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By event: whether it was flagged in (zone start, crossing], first when, and on what share of its valid samples."""
    inside = flagged.where(F.col("event_id").isNotNull() & (F.col("ts_min") <= F.col("crossing_ts")) & F.col("value").isNotNull())
    on = holds(F.col("flagged"))
    got = inside.groupBy(*keys, "event_id").agg(
        F.min(F.when(on, F.col("ts_min"))).alias("first_alert_ts"), F.avg(on.cast("double")).alias("duty_cycle"), F.count("*").alias("n_valid_samples")
    )
    return zones.select(*keys, "event_id").join(got, [*keys, "event_id"], "left").select(
        *keys, "event_id", F.col("first_alert_ts").isNotNull().alias("window_hit"), "first_alert_ts", "duty_cycle", F.coalesce("n_valid_samples", F.lit(0)).alias("n_valid_samples")
    )


def replay_episodes(flagged: DataFrame, keys: Sequence[str], cut: Cut = Cut()) -> DataFrame:
    """Runs of rows that are flagged and outside all zones, by their first row; every other row ends a run.

    Unlike in evaluate.false_alarm_episodes, a flagged run that passes through a zone is two.
    """
    rows = islands(flagged, holds(F.col("flagged")) & F.col("event_id").isNull(), F.lit(False), Channel("ts_min", "idx", tuple(keys), cut))
    return rows.groupBy(*keys, "island").agg(F.min("ts_min").alias("start")).drop("island")


def episodes_by_day(episodes: DataFrame, flagged: DataFrame) -> DataFrame:
    """False-alarm episodes by day of their first row, with the days that have normal samples and none."""
    days = flagged.where(F.col("event_id").isNull()).select(exprs.epoch_day(F.col("ts_min")).alias("day")).distinct()
    got = episodes.groupBy(exprs.epoch_day(F.col("start")).alias("day")).agg(F.count("*").alias("n"))
    return days.join(got, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n_episodes"))


def horizon_thresholds(features: DataFrame, names: Sequence[str], q: float = 0.99) -> DataFrame:
    return ranks.quantiles(features, {c: (F.col(c), q) for c in names})


#: The study's features of a window, and its windows' lengths in minutes.
FEATURES = ("last", "maximum", "mean", "slope_per_min", "variability", "max_gap_min", "missing_frac")
HORIZONS = (60.0, 360.0, 1440.0)


def horizon_study(samples: DataFrame, cutoff: float, keys: Sequence[str], horizons: Sequence[float] = HORIZONS, q: float = 0.99) -> DataFrame:
    """By horizon and feature: the calibration windows' quantile, and how many event and normal windows exceed it.

    samples: keys, idx, ts_min, value. Windows of the calibration lie before the cutoff, those of an event in [crossing - horizon,
    crossing), normal ones on the rows from the cutoff on outside all zones of the events from then on. An event window
    without samples exceeds nothing.
    """
    early, late = split_chronological(samples, cutoff)
    early = guard_no_test_leakage(early, cutoff)
    # zones are cut at the event before among those from the cutoff on, as in the reference
    zones = evaluate.event_zones(evaluate.rising_crossings(samples, keys).where(F.col("crossing_ts") >= cutoff), keys)
    normal = evaluate.zone_index(late, zones, keys).where(F.col("event_id").isNull()).select(*samples.columns)
    n_events = zones.agg(F.count("*").alias("n_events"))
    long = lambda found: found.unpivot(["length"], list(FEATURES), "feature", "x")
    cal = timeseries.pane_features(early, "value", horizons, keys=keys)
    by = ["length", "feature"]
    # windows are many and made anew from panes for little, so they are passed twice and not shuffled by value
    limits = ranks.quantiles(cal, {c: (F.col(c), q) for c in FEATURES}, ["length"], few=True).unpivot(["length"], list(FEATURES), "feature", "threshold")
    limits = written(limits.where("threshold IS NOT NULL"), "limits")  # a row for each length and feature
    met = lambda found: long(found).join(F.broadcast(limits), by).groupBy(*by)
    before = timeseries.horizon_features(_event_windows(samples, zones, keys, horizons), "value", (*keys, "event_id", "length"), "ts_min")
    hits = met(before).agg(F.count_if(F.col("x") > F.col("threshold")).alias("hits"))
    found = met(timeseries.pane_features(normal, "value", horizons, keys=keys)).agg(F.count_if(F.col("x") > F.col("threshold")).alias("over"), F.count("*").alias("windows"))
    return limits.join(hits, by, "left").join(found, by, "left").crossJoin(n_events).select(  # one row
        F.col("length").alias("horizon_min"), "feature", F.round("threshold", 4).alias("calibration_q99_threshold"),
        F.coalesce("hits", F.lit(0)).alias("event_windows_flagged"), "n_events", F.round(F.col("over") / F.col("windows"), 4).alias("normal_windows_flagged_frac"),
        F.coalesce("windows", F.lit(0)).alias("n_normal_windows"),
    )


def _event_windows(samples: DataFrame, zones: DataFrame, keys: Sequence[str], lengths: Sequence[float]) -> DataFrame:
    """The samples in [crossing - length, crossing) with event_id and length, by one equi-join on slots of the greatest length."""
    widest = max(lengths)
    slot = lambda t: F.floor(t / widest)
    at = zones.select(*keys, "event_id", F.col("crossing_ts").alias("_c")).withColumn("_slot", F.explode(F.array(slot(F.col("_c")), slot(F.col("_c")) - 1)))
    rows = samples.withColumn("_slot", slot(F.col("ts_min"))).join(at, [*keys, "_slot"]).where(F.col("ts_min") < F.col("_c"))
    held = F.filter(F.array(*[F.lit(float(h)) for h in lengths]), lambda h: F.col("ts_min") >= F.col("_c") - h)
    return rows.withColumn("length", F.explode(held)).drop("_slot", "_c")


#: Parameters beyond which the beta distribution's share is an integral over its peak, and the nodes of that integral.
LARGE, NODES, WEIGHTS = 3000.0, *np.polynomial.legendre.leggauss(64)


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The beta distribution's share below x, 0 < x < 1, for a, b > 0: by continued fractions, or by an integral where both are large.

    Time doesn't grow with the parameters: the fraction takes some hundred steps at most up to LARGE.
    """
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges on the other side
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    norm = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
    out = np.zeros(len(x))
    large = (a > LARGE) & (b > LARGE)
    if large.any():
        out[large] = _integral(x[large], a[large], b[large])
    if not large.all():
        p, q, y = a[~large], b[~large], x[~large]
        with np.errstate(divide="ignore"):
            out[~large] = np.exp(norm[~large] + p * np.log(y) + q * np.log1p(-y)) * _fraction(y, p, q) / p
    return np.clip(np.where(swap, 1 - out, out), 0.0, 1.0)


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The incomplete beta function's continued fraction, from its front: every step adds an even and an odd term."""
    tiny = 1e-300
    sure = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones(len(x)), 1 / sure(1 - (a + b) * x / (a + 1))
    f = d.copy()
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / sure(1 + term * d)
            c = sure(1 + term / c)
            step = c * d
            f = f * step
        if (np.abs(step - 1) < 1e-13).all():
            break
    return f


def _integral(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share below x, left of the peak, from twelve deviations below it on: what lies further off is nothing."""
    mean = a / (a + b)
    width = np.sqrt(mean * (1 - mean) / (a + b + 1))
    low = np.maximum(np.minimum(x, mean) - 12 * width, 0.0)
    t = low[:, None] + (x - low)[:, None] * (NODES + 1) / 2
    # the density's logarithm, from its value at the mean, where Stirling's series is exact enough
    p, q = (a - 1)[:, None], (b - 1)[:, None]
    with np.errstate(divide="ignore"):
        log = p * np.log1p((t - mean[:, None]) / mean[:, None]) + q * np.log1p(-(t - mean[:, None]) / (1 - mean[:, None]))
    n = a + b
    peak = 0.5 * np.log(n / (2 * np.pi)) - 0.5 * np.log(mean * (1 - mean)) + 1 / (12 * n) - 1 / (12 * a) - 1 / (12 * b)
    return np.exp(peak) * (x - low) / 2 * (np.exp(log) @ WEIGHTS)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By halving, to 2^-42, for arrays of parameters; 0 and 1 at their ends."""
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    inner = np.flatnonzero((a > 0) & (b > 0))
    for _ in range(42):
        if len(inner):
            mid = (lo[inner] + hi[inner]) / 2
            low = beta_share(mid, a[inner], b[inner]) < q
            lo[inner], hi[inner] = np.where(low, mid, lo[inner]), np.where(low, hi[inner], mid)
    return np.where(a <= 0, 0.0, np.where(b <= 0, 1.0, (lo + hi) / 2))


def exact_interval(hits: Column, trials: Column, alpha: float = 0.05) -> Column:
    """The exact interval (low, high) of a binomial share, to four places, by quantiles of the beta distribution; NULL without trials."""

    @F.pandas_udf("low double, high double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        k, n = k.to_numpy(np.float64), n.to_numpy(np.float64)
        found = pd.DataFrame({"low": beta_quantile(alpha / 2, k, n - k + 1), "high": beta_quantile(1 - alpha / 2, k + 1, n - k)}).round(4)
        found[n <= 0] = np.nan
        return found

    ok = trials > 0
    one = interval(F.coalesce(hits, F.lit(0)).cast("double"), F.coalesce(trials, F.lit(0)).cast("double"))
    return F.when(ok, one)


def day_bootstrap(days: DataFrame, times: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """One row (mean, low, high) of episodes a day: whole days are drawn anew, `times` as many days as there are.

    days: day, n_episodes, a row for each calendar day. The draw of each place follows from seed, resample and place, so
    a task that runs again draws the same days. The bounds are the means at the places alpha / 2 and 1 - alpha / 2 of their order.
    """
    place = F.row_number().over(Window.orderBy("day")) - 1  # as many rows as days
    numbered = days.select(place.alias("pick"), F.col("n_episodes").alias("n"))
    size = days.agg(F.count("*").alias("size"), F.avg("n_episodes").alias("mean"))
    draws = days.sparkSession.range(times).withColumnRenamed("id", "resample").crossJoin(F.broadcast(size)).where("size > 0")  # one row
    draws = draws.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    pick = F.floor(exprs.draw(seed, F.col("resample"), F.col("place")) * F.col("size")).cast("int")
    means = draws.withColumn("pick", pick).join(numbered, "pick").groupBy("resample").agg(F.avg("n").alias("m"))
    ranked = means.withColumn("r", F.row_number().over(Window.orderBy("m", "resample")) - 1)  # as many rows as resamples
    at = lambda q: F.max(F.when(F.col("r") == min(times - 1, int(q * times)), F.round("m", 6)))
    bounds = ranked.agg(at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))
    return size.select(F.round("mean", 6).alias("mean")).crossJoin(bounds)  # one row each


def denominators(flagged: DataFrame) -> DataFrame:
    """What rates of a replay are counted against: rows in and outside zones, normal days, the time spanned, flagged rows a day of it."""
    on = F.count_if(holds(F.col("flagged")))
    out = F.col("event_id").isNull()
    span = (F.max("ts_min") - F.min("ts_min")) / 1440.0
    return flagged.agg(
        F.count_if(out).alias("monitored_rows_normal_zones"), F.count_if(~out).alias("excluded_rows_event_zones"),
        F.count_distinct(F.when(out, exprs.epoch_day(F.col("ts_min")))).alias("normal_day_blocks"), span.alias("test_days"),
        F.when(span > 0, on / span).alias("flagged_samples_per_test_day"),
    )


def replay_metrics(flagged: DataFrame, zones: DataFrame, keys: Sequence[str], high: Column) -> DataFrame:
    """One row of a frozen replay: events detected with their exact interval, the confusion of rows, delays, episodes a day and denominators."""
    events = evaluate.per_event(flagged, zones, keys).agg(
        F.count_if("detected").alias("events_detected"), F.count("*").alias("events_total"), F.avg(-F.col("lead_min")).alias("mean_detection_delay_min")
    )
    share = exact_interval(F.col("events_detected"), F.col("events_total"))
    events = events.withColumn("event_recall", F.try_divide("events_detected", "events_total")).withColumn("_i", share)
    events = events.select("*", F.col("_i.low").alias("event_recall_low"), F.col("_i.high").alias("event_recall_high")).drop("_i")
    rows = quality.confusion(flagged, F.col("flagged"), high)
    days = episodes_by_day(replay_episodes(flagged, keys), flagged)
    alarms = days.agg(F.sum("n_episodes").alias("fa_episodes_total"), F.avg("n_episodes").alias("fa_rate_per_day"))
    return events.crossJoin(rows).crossJoin(alarms).crossJoin(denominators(flagged))  # one row each
