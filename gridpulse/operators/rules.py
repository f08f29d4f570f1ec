"""Causal plausibility rules as window expressions.

The rules keep two values of a stream, the last accepted reading and its time. A reading is accepted when it is present
and its time exceeds all earlier accepted times, so both values are running maxima and carries over the rows before, and
no threshold takes part in them: they are computed once, however many configurations are evaluated. A long stream is
scanned in segments, if its channel tells how wide.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.operators import bits, ranks, scans
from gridpulse.schema import Channel, holds

FILTER_TYPES = ("rate", "range", "combined", "jump")
NEEDS = {"rate": ("rate",), "range": ("upper",), "combined": ("rate", "upper"), "jump": ("jump",)}


@dataclass(frozen=True)
class Rule:
    """One configuration; bounds are compared strictly."""

    filter_type: str
    thresholds: dict[str, float] = field(default_factory=dict)
    gap_minutes: float = 60.0
    gap_behavior: str = "reset"

    def __post_init__(self):
        if self.filter_type not in FILTER_TYPES:
            raise ValueError(f"unknown filter type {self.filter_type!r}")
        if self.gap_behavior not in ("reset", "continue"):
            raise ValueError(f"unknown gap behaviour {self.gap_behavior!r}")
        for name in NEEDS[self.filter_type]:
            if name not in self.thresholds:
                raise ValueError(f"{self.filter_type} needs the threshold {name}")
        if self.filter_type in ("rate", "jump") and {"upper", "lower"} & set(self.thresholds):
            raise ValueError("bounds belong to the types range and combined")
        for name, x in self.thresholds.items():
            if not (float("-inf") < float(x) < float("inf")):
                raise ValueError(f"threshold {name} must be finite")


def state(df: DataFrame, value: str, ts_min: str, channel: Channel) -> DataFrame:
    """df with prev_v, prev_t: the rules' state before each row, in order of arrival.

    The last accepted row is the first of those with the greatest time so far, so the state is one running maximum.
    """
    v, t = F.col(value), F.col(ts_min)
    held = F.when(v.isNotNull() & t.isNotNull(), F.struct(t.alias("t"), (-F.col(channel.order)).alias("o"), v.alias("v")))
    out = scans.scan(df, channel.keys, [channel.order], {"_state": scans.greatest_before(held)}, channel.cut.steps)
    return out.select(*df.columns, F.col("_state.v").alias("prev_v"), F.col("_state.t").alias("prev_t"))


def decide(value: Column, t: Column, prev_v: Column, prev_t: Column, kind: Column, gap: Column, resets: Column, rate_thr: Column, upper: Column, lower: Column, jump_thr: Column) -> Column:
    """The decision as a struct: flagged, reason, rate, jump, data_anomaly, state_updated, note."""
    dt = t - prev_t
    missing, first = value.isNull(), prev_t.isNull()
    late, gapped = ~first & (dt <= 0), ~first & (dt > gap) & resets
    ranged = F.when(holds(value > upper), "upper").when(holds(value < lower), "lower")
    steady = ~missing & ~first & ~late & ~gapped
    rate = F.when(steady & kind.isin("rate", "combined"), F.abs(value - prev_v) / F.when(dt > 0, dt))
    jump = F.when(steady & (kind == "jump"), F.abs(value - prev_v))
    fast, jumped = holds(rate > rate_thr), holds(jump > jump_thr)
    reason = (
        F.when(missing, F.lit(None).cast("string"))
        .when(first | late | gapped | (kind == "range"), ranged)
        .when(kind == "rate", F.when(fast, "rate"))
        .when(kind == "jump", F.when(jumped, "jump"))
        .otherwise(F.when(fast & ranged.isNotNull(), F.concat(F.lit("rate+"), ranged)).when(fast, "rate").otherwise(ranged))
    )
    note = F.when(missing, "missing").when(first, "first").when(late, "nonpositive_dt").when(gapped, "gap_reset").otherwise("")
    return F.struct(
        reason.isNotNull().alias("flagged"), F.coalesce(reason, F.lit("")).alias("reason"), rate.alias("rate"), jump.alias("jump"),
        (missing | holds(late)).alias("data_anomaly"), (~missing & ~holds(late)).alias("state_updated"), note.alias("note"),
    )


def apply_rule(df: DataFrame, rule: Rule, value: str, ts_min: str, channel: Channel) -> DataFrame:
    """df with the columns of the rule's decision on each row."""
    s = state(df, value, ts_min, channel)
    x = lambda name: F.lit(rule.thresholds.get(name)).cast("double")
    d = decide(
        F.col(value), F.col(ts_min), F.col("prev_v"), F.col("prev_t"), F.lit(rule.filter_type), F.lit(float(rule.gap_minutes)),
        F.lit(rule.gap_behavior == "reset"), x("rate"), x("upper"), x("lower"), x("jump"),
    )
    return s.withColumn("_d", d).select(*df.columns, "_d.*")


@dataclass(frozen=True)
class Config:
    """One configuration of a sweep: a rule's numbers, of which those that don't belong to it are missing."""

    config_id: str
    filter_type: str
    gap_behavior: str = "reset"
    gap_minutes: float = 60.0
    rate: float | None = None
    upper: float | None = None
    lower: float | None = None
    jump: float | None = None


def decision_of(c: Config, value: Column, dt: Column, change: Column, rate: Column) -> Column:
    """Whether a configuration flags a row: a value out of bounds, or, where no gap has reset the state, too fast or too far a change.

    dt, change and rate are NULL where there is no state or time does not pass.
    """
    out = [value > c.upper] if c.upper is not None else []
    out += [value < c.lower] if c.lower is not None else []
    moved = ([rate > c.rate] if c.rate is not None else []) + ([change > c.jump] if c.jump is not None else [])
    known = [holds(m & (dt <= c.gap_minutes)) if c.gap_behavior == "reset" else holds(m) for m in moved]
    return reduce(lambda a, b: a | b, [*map(holds, out), *known], F.lit(False)) & value.isNotNull()


def sweep(df: DataFrame, configs: Sequence[Config], value: str, ts_min: str, channel: Channel) -> DataFrame:
    """df with on, an array of every configuration's decision in their order, and data_anomaly, which no threshold takes part in.

    Every decision is an expression of its own, so the array is built in generated code.
    """
    s = state(df, value, ts_min, channel)
    v, t, before = F.col(value), F.col(ts_min), F.col("prev_t")
    anomaly = v.isNull() | holds(before.isNotNull() & (t - before <= 0))
    s = s.select(*df.columns, anomaly.alias("data_anomaly"), F.when(t > before, t - before).alias("_dt"), F.when(t > before, F.abs(v - F.col("prev_v"))).alias("_change"))
    s = s.withColumn("_rate", F.col("_change") / F.col("_dt"))
    on = F.array(*[decision_of(c, v, F.col("_dt"), F.col("_change"), F.col("_rate")) for c in configs])
    return s.select(*df.columns, on.alias("on"), "data_anomaly")


#: Bits before the decisions of a packed sweep: every row's, and an anomaly's.
LEADING = 2


def packed_sweep(df: DataFrame, configs: Sequence[Config], value: str, ts_min: str, channel: Channel, also: Sequence[Column] = ()) -> DataFrame:
    """sweep() with bits in place of on: every decision as a bit of a few numbers, made array-wise, and data_anomaly. also: decisions to follow the configurations'."""
    s = state(df, value, ts_min, channel)
    v, t, before = F.col(value).cast("double"), F.col(ts_min), F.col("prev_t")
    anomaly = v.isNull() | holds(before.isNotNull() & (t - before <= 0))
    dt, change = F.when(t > before, t - before).cast("double"), F.when(t > before, F.abs(v - F.col("prev_v"))).cast("double")
    more, n = len(also), len(configs)

    def run(v: pa.Array, dt: pa.Array, change: pa.Array, flags: pa.Array) -> pa.Array:
        on = np.zeros((LEADING + n + more, len(v)), bool)
        on[0] = True
        flags = bits.booleans(flags, 1 + more)
        on[1], on[LEADING + n :] = flags[0], flags[1:]
        decide_all(configs, *[x.to_numpy(zero_copy_only=False) for x in (v, dt, change)], *[~np.asarray(x.is_null()) for x in (v, dt, change)], out=on[LEADING : LEADING + n])
        return bits.packed(on)

    run.__annotations__ = {**dict.fromkeys(("v", "dt", "change", "flags"), pa.Array), "return": pa.Array}
    pack = F.arrow_udf(run, bits.struct_of(bits.words(LEADING + n + more)))
    s = s.select(*df.columns, anomaly.alias("data_anomaly"), dt.alias("_dt"), change.alias("_change"))
    flags = F.array(F.col("data_anomaly"), *map(holds, also))
    return s.select(*df.columns, pack(v, F.col("_dt"), F.col("_change"), flags).alias("bits"), "data_anomaly")


def decide_all(configs: Sequence[Config], v: np.ndarray, dt: np.ndarray, change: np.ndarray, known: np.ndarray, timed: np.ndarray, moved: np.ndarray, out: np.ndarray) -> None:
    """decision_of() for all configurations, on arrays; a number that isn't one is greater than any, as in Spark."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        rate, rated = change / dt, moved & timed
        tests: dict[tuple, np.ndarray] = {}

        def test(name: str, limit: float) -> np.ndarray:
            if (name, limit) not in tests:
                x, there = {"upper": (v, known), "lower": (v, known), "rate": (rate, rated), "jump": (change, moved), "gap": (dt, timed)}[name]
                tests[name, limit] = there & {"lower": lambda: x < limit, "gap": lambda: x <= limit}.get(name, lambda: (x > limit) | np.isnan(x))()
            return tests[name, limit]

        for c, on in zip(configs, out):
            for name in ("rate", "jump"):
                if (limit := getattr(c, name)) is not None:
                    on |= test(name, limit)
            if c.gap_behavior == "reset":
                on &= test("gap", c.gap_minutes)
            for name in ("upper", "lower"):
                if (limit := getattr(c, name)) is not None:
                    on |= test(name, limit)
            on &= known


def b1_threshold(value: Column, threshold: float) -> Column:
    return holds(value >= threshold)


def b2_random(p: float, seed: int, *row: Column) -> Column:
    """Independent draws that follow from the seed and what tells a row apart; equal to other generators in distribution only."""
    return exprs.draw(seed, *row) < p


def b3_percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """df with flagged: above the stream's whole percentile. Looks ahead, so it is a bound and no rule."""
    cut = ranks.quantiles(df, {"_cut": (F.col(value), p / 100)})
    return df.crossJoin(F.broadcast(cut)).withColumn("flagged", holds(F.col(value) > F.col("_cut"))).drop("_cut")  # one row
