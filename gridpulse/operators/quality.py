"""Data-quality summaries: inventories, repeats, conflicts, distributions, bands and approximation errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.operators import ranks
from gridpulse.schema import Channel, holds


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def inventory(df: DataFrame, sensors: Sequence[str], channel: Channel = Channel(), raw_ts: str | None = None) -> DataFrame:
    """Rows, times, repeats, span and missing values of one table."""
    whole = F.struct(F.col(raw_ts or channel.ts), *sensors)
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in sensors])
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(channel.ts).alias("n_unique_timestamps"),
        (F.count("*") - F.count_distinct(channel.ts)).alias("n_duplicate_timestamp_rows"),
        (F.count("*") - F.count_distinct(whole)).alias("n_exact_duplicate_rows"),
        exprs.time_text(F.min(channel.ts)).alias("timestamp_min"),
        exprs.time_text(F.max(channel.ts)).alias("timestamp_max"),
        missing.alias("missing_values_total"),
    )


def coercion_failures(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Missing readings by sensor, of those that have any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in sensors])
    return counts.unpivot([], list(sensors), "column", "n_missing").where("n_missing > 0")


def repeated_groups(df: DataFrame, sensors: Sequence[str], channel: Channel = Channel(), flags: Sequence[str] = ()) -> DataFrame:
    """One row for each time with several records: which sensors disagree, how far, and where the records lie."""
    spread = {c: F.max(c) - F.min(c) for c in sensors}
    # extremes tell whether values differ, a count whether only some are missing: no distinct values are gathered
    differs = {c: F.coalesce(F.min(c) != F.max(c), F.lit(False)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))) for c in sensors}
    lines = F.array_sort(F.collect_list(channel.order))
    out = df.groupBy(*channel.instant()).agg(
        F.count("*").alias("n_records"), lines.alias("_lines"), (F.max(channel.order) - F.min(channel.order)).alias("raw_line_span"),
        *[differs[c].alias(f"_d_{c}") for c in sensors], *[spread[c].alias(f"_s_{c}") for c in sensors],
        *[F.concat(F.lit(f"{c}="), F.min(c).cast("string"), F.lit(".."), F.max(c).cast("string")).alias(f"_t_{c}") for c in sensors],
    ).where("n_records > 1")
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"_d_{c}"), F.lit(c)) for c in sensors]))
    sized = [F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) for c in sensors]
    most = F.greatest(*sized) if len(sized) > 1 else sized[0]
    flagged = _any([F.col(f"_d_{c}") for c in flags]) if flags else F.lit(False)
    return out.select(
        *channel.keys, exprs.time_text(channel.ts).alias("timestamp"), exprs.month_tag(channel.ts).alias("month"), "n_records",
        F.array_join(F.transform("_lines", lambda x: x.cast("string")), ",").alias("raw_lines"), "raw_line_span",
        (F.col("raw_line_span") == F.col("n_records") - 1).alias("raw_lines_adjacent"),
        (F.size(conflicts) == 0).alias("identical_group"), F.size(conflicts).cast("long").alias("n_conflicting_columns"),
        F.array_join(conflicts, ",").alias("conflicting_columns"),
        F.array_join(F.array(*[F.when(F.col(f"_d_{c}"), F.col(f"_t_{c}")) for c in sensors]), ";").alias("conflicting_value_spreads"), most.alias("max_conflict_magnitude"), flagged.alias("flags_conflict"),
    )


def conflict_summary(groups: DataFrame) -> DataFrame:
    counts = [
        F.count("*").alias("repeated_groups"), F.count_if("identical_group").alias("identical_groups"),
        F.count_if(~F.col("identical_group")).alias("conflicting_groups"), F.count_if("flags_conflict").alias("groups_with_flag_conflicts"),
        F.max("max_conflict_magnitude").alias("max_conflict_magnitude"), F.bool_and("raw_lines_adjacent").alias("all_groups_raw_line_adjacent"),
    ]
    return ranks.quantiles(groups, {"median_max_conflict_magnitude": (F.col("max_conflict_magnitude"), 0.5)}, also=counts)


def duplicate_summary(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Repeats by source: groups, how many agree, the largest, and all sensors that ever disagree."""
    named = groups.select(*by, "identical_group", "n_records", F.split("conflicting_columns", ",").alias("c"))
    return named.groupBy(*by).agg(
        F.count("*").alias("duplicate_timestamp_groups"), F.count_if("identical_group").alias("identical_groups"),
        F.count_if(~F.col("identical_group")).alias("conflicting_groups"), F.max("n_records").alias("max_records_per_timestamp"),
        F.array_join(F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_set("c"))), "")), ",").alias("conflicting_columns_seen"),
    )


def value_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column: distinct values, quantiles, a behaviour class and the five most frequent values (ties: smaller first)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "v").where("v IS NOT NULL")
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "v"))
    top = counts.withColumn("r", rank).where("r <= 5").groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v", "n"))), lambda x: F.format_string("%.4f:%d", x["v"], x["n"])), ";").alias("top_values")
    )
    shape = counts.groupBy("column").agg(F.count("*").alias("n_unique"), F.bool_and(F.col("v").isin(0.0, 1.0)).alias("_zero_one"))
    quarters = ranks.counted_quantiles(counts, "v", {"p25": 0.25, "median": 0.5, "p75": 0.75}, ["column"], "n")
    stats = long.groupBy("column").agg(F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max")).join(quarters, "column")
    kind = F.when(F.col("_zero_one") & (F.col("n_unique") == 2), "binary").when(F.col("n_unique") <= 30, "categorical").otherwise("continuous")
    return stats.join(shape, "column").join(top, "column").select("column", "n_unique", "min", "p25", "median", "mean", "p75", "max", kind.alias("behaviour"), "top_values")


def multiplicity(df: DataFrame, channel: Channel = Channel()) -> DataFrame:
    per = df.groupBy(*channel.instant()).agg(F.count("*").alias("records_per_timestamp"))
    hist = per.groupBy("records_per_timestamp").agg(F.count("*").alias("n_timestamps"))
    total = F.sum("n_timestamps").over(Window.partitionBy())  # a handful of rows
    return hist.select("records_per_timestamp", "n_timestamps", F.bround(F.col("n_timestamps") / total * 100, 3).alias("share_of_timestamps_pct"))


def flag_consistency(df: DataFrame, value: str, flag: str, threshold: float) -> DataFrame:
    """How often (value >= threshold) agrees with (flag == 1); a missing side counts as False."""
    agree = holds(F.col(value) >= threshold) == holds(F.col(flag) == 1)
    return df.agg(F.count_if(agree).alias("rule_ok"), F.count_if(~agree).alias("violations"), F.count("*").alias("n_records"))


def high_in_repeated(df: DataFrame, value: str, threshold: float, channel: Channel = Channel()) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*channel.instant()))
    high = df.select(F.col(value).alias("v"), n.alias("n")).where(F.col("v") >= threshold)
    return high.agg(
        F.count("*").alias("n_high_records"), F.count_if(F.col("n") > 1).alias("n_high_records_in_repeated_groups")
    ).withColumn("threshold", F.lit(float(threshold)))


def band_unimodality(df: DataFrame, value: str, above: float = 50.0) -> DataFrame:
    """Values above a floor, by decade: how many bands hold over 0.5 %, in how many runs, and which is largest."""
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v") > above)
    middle = {"p01": (F.col("v"), 0.01), "median": (F.col("v"), 0.5), "p99": (F.col("v"), 0.99)}
    stats = ranks.quantiles(v, middle, also=[F.count("*").alias("n_values")])
    bands = v.groupBy(F.bround("v", -1).alias("band")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    kept = bands.withColumn("share", share)
    order = Window.orderBy("band")  # as many rows as decades
    runs = kept.where("share > 0.005").withColumn("gap", F.col("band") - F.lag("band").over(order))
    counted = runs.agg(F.count("*").alias("n_populated_decade_bands"), F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 10), 1).otherwise(0)).alias("n_contiguous_band_clusters"))
    most = kept.agg(F.max_by("band", F.struct("n", -F.col("band"))).alias("dominant_decade_band"))
    return stats.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(counted)).withColumn("column", F.lit(value))  # one row each


def neighbour_fit(df: DataFrame, value: str, channel: Channel = Channel()) -> DataFrame:
    """Whether the first or last record of a conflicting time lies closer to the nearest single records around it."""
    per = df.groupBy(*channel.instant()).agg(
        F.count("*").alias("n"), F.min_by(value, channel.order).alias("first"), F.max_by(value, channel.order).alias("last"),
        F.count_distinct(value).alias("u"),
    )
    w, back = Window.partitionBy(*channel.keys).orderBy(channel.ts), Window.partitionBy(*channel.keys).orderBy(F.desc(channel.ts))
    single = F.when(F.col("n") == 1, F.col("first"))
    per = per.select(
        "n", "first", "last", "u",
        F.last(single, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
        F.last(single, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("next"),
    ).where("n > 1 AND u > 1 AND prev IS NOT NULL AND next IS NOT NULL")
    fit = lambda c: F.avg(F.abs(F.col(c) - F.col("prev")) + F.abs(F.col(c) - F.col("next")))
    return per.agg(
        F.count("*").alias("n_conflicting_groups_with_neighbors"), F.bround(fit("first"), 2).alias("mean_fit_error_first_branch"),
        F.bround(fit("last"), 2).alias("mean_fit_error_last_branch"), (fit("first") < fit("last")).alias("first_fits_better"),
    )


def power_approximation_errors(voltage: DataFrame, power: DataFrame, on: Sequence[str], v: Sequence[str], i: Sequence[str], v_line: Sequence[str], kva: str) -> DataFrame:
    """Errors of two estimates of apparent power against the metered one, over the times both tables have."""
    both = voltage.join(power, list(on)).where((F.col(v_line[0]) > 0) & (F.col(kva) > 0))
    cols = lambda names: [F.col(c) for c in names]
    err = both.select(
        exprs.absolute_error_pct(exprs.apparent_power_per_phase(cols(v), cols(i)), F.col(kva)).alias("a"),
        exprs.absolute_error_pct(exprs.apparent_power_line(cols(v_line), cols(i)), F.col(kva)).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return ranks.quantiles(err, {
        "per_phase_sum_median_abs_err_pct": (a, 0.5), "per_phase_sum_p95_abs_err_pct": (a, 0.95), "sqrt3_median_abs_err_pct": (b, 0.5), "sqrt3_p95_abs_err_pct": (b, 0.95),
    }, also=[F.count("*").alias("n_compared")])


def correlation(df: DataFrame, a: str, b: str, normal: Column) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr_all"), F.corr(F.when(normal, F.col(a)), F.when(normal, F.col(b))).alias("corr_normal"))


def monthly_groups(groups: DataFrame) -> DataFrame:
    return groups.groupBy("month").agg(F.count("*").alias("repeated_groups")).orderBy("month")


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    p, a = holds(predicted), holds(actual)
    out = df.agg(F.count_if(p & a).alias("row_tp"), F.count_if(p & ~a).alias("row_fp"), F.count_if(~p & a).alias("row_fn"))
    tp, fp, fn = F.col("row_tp"), F.col("row_fp"), F.col("row_fn")
    return out.select(
        "*", F.try_divide(tp, tp + fp).alias("row_precision"), F.try_divide(tp, tp + fn).alias("row_recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("row_f1"),
    )
