"""Scalar functions as Column expressions; missing is NULL, and no expression raises on data unless it says so."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the one accepted shape of a timestamp: date, T or space, minutes, and seconds with a fraction if any.
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def parse_timestamp(text: Column | str, strict: bool = False) -> Column:
    """TIMESTAMP_NTZ of a text of the accepted shape; else NULL, or an error if strict."""
    t = F.trim(_c(text))
    ok = t.rlike(TIMESTAMP)
    parsed = F.when(ok, t.try_cast("timestamp_ntz"))
    if not strict:
        return parsed
    return F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("not a timestamp: "), F.coalesce(t, F.lit("null")))).cast("timestamp_ntz")
    )


def minutes(ts: Column | str) -> Column:
    """Minutes since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _c(ts)) / F.lit(60_000_000.0)


def between_minutes(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(60_000_000.0)


def safe_rate(dv: Column, dt: Column) -> Column:
    return F.when(dt > 0, dv / dt)


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def apparent_power_per_phase(v: list[Column], i: list[Column]) -> Column:
    """Sum of V x I in kVA; missing if a phase is."""
    return sum((a * b for a, b in zip(v[1:], i[1:])), v[0] * i[0]) / 1000


def mean_of_present(cols: list[Column]) -> Column:
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def apparent_power_line(v_line: list[Column], i: list[Column]) -> Column:
    return math.sqrt(3.0) * mean_of_present(v_line) * mean_of_present(i) / 1000


def absolute_error_pct(estimate: Column, truth: Column) -> Column:
    return F.when(truth > 0, F.abs(estimate - truth) / truth * 100)


def energy_kj(kw: Column, dt_min: Column) -> Column:
    return F.when(dt_min >= 0, kw * dt_min * 60)


def critical_mass_kg(kj: Column, heat: Column, rise: Column) -> Column:
    return F.when((heat > 0) & (rise > 0), kj / (heat * rise))


def required_power_kw(mass: Column, heat: Column, rise: Column, dt_min: Column) -> Column:
    return F.when(dt_min > 0, mass * heat * rise / (dt_min * 60))


def achievable_rise(kw: Column, mass: Column, heat: Column, dt_min: Column) -> Column:
    return F.when((mass > 0) & (heat > 0), kw * dt_min * 60 / (mass * heat))


def time_constant_minutes(t0: Column, t1: Column, ambient: Column, dt_min: Column) -> Column:
    """-dt / ln((t1 - ta) / (t0 - ta)) where that ratio lies strictly between 0 and 1 and time passes."""
    ratio = F.try_divide(t1 - ambient, t0 - ambient)
    return F.when((ratio > 0) & (ratio < 1) & (dt_min > 0), -dt_min / F.ln(ratio))


def time_constant_status(t0: Column, t1: Column, ambient: Column) -> Column:
    """Whether a pair of readings is a decay towards ambient; the labels are fixed values."""
    return (
        F.when(t0 - ambient <= 0, "start not above ambient")
        .when(t1 - ambient <= 0, "end at or below ambient")
        .when((t1 - ambient) / (t0 - ambient) >= 1, "not decaying (end excess >= start excess)")
        .otherwise("valid")
    )


def alert_class(alert: Column, crossing: Column) -> Column:
    return F.when(alert.isNull(), "none").when(alert < crossing, "before").when(alert == crossing, "at").otherwise("after")


def transition_label(before: Column, after: Column) -> Column:
    return F.concat(before.cast("int").cast("string"), F.lit("->"), after.cast("int").cast("string"))


def month_tag(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def time_text(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def first_number(label: Column | str) -> Column:
    return F.regexp_extract(_c(label), "([0-9.]+)", 1).try_cast("double")


def epoch_day(ts_min: Column) -> Column:
    return F.floor(ts_min / 1440).cast("long")


def draw(seed: int | Column, *parts: Column) -> Column:
    """A number in [0, 1) that follows from seed and parts alone: a row computed anew draws the same."""
    text = F.concat_ws("/", F.lit(seed) if isinstance(seed, int) else seed, *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def general(x: Column | str) -> Column:
    """A number as text with six significant digits: plain from 1e-4 to below 1e6, else with an exponent; no zeros at its end."""
    told = F.format_string("%.5e", _c(x).cast("double"))
    digits = F.replace(F.regexp_extract(told, r"^-?([0-9.]+)e", 1), F.lit("."), F.lit(""))
    e = F.regexp_extract(told, r"e([+-][0-9]+)$", 1).try_cast("int")
    sign = F.when(told.startswith("-"), "-").otherwise("")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    left = lambda n: F.substring(digits, F.lit(1), n)
    rest = lambda n: F.substring(digits, n + 1, F.lit(6))
    large = bare(F.concat(left(e + 1), F.lit("."), rest(e + 1)))
    small = bare(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
    power = F.concat(bare(F.concat(left(F.lit(1)), F.lit("."), rest(F.lit(1)))), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    power = F.when(F.abs(e) > 99, F.concat(bare(F.concat(left(F.lit(1)), F.lit("."), rest(F.lit(1)))), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))).otherwise(power)
    plain = F.when((e < -4) | (e >= 6), power).when(e >= 0, large).otherwise(small)
    odd = F.when(F.isnan(_c(x)), "nan").when(_c(x) == float("inf"), "inf").when(_c(x) == float("-inf"), "-inf")
    return F.when(_c(x).isNotNull(), F.coalesce(odd, F.concat(sign, plain)))
