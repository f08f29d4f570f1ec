"""Event-based evaluation: crossings of a band, detection zones, leads, false-alarm episodes, frontiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.operators import bits, ranks, rules, scans
from gridpulse.schema import Cut, holds
from gridpulse.sources.scratch import written

BAND, PRE_WINDOW = 100.0, 60.0


def _w(keys: Sequence[str], order: str = "idx"):
    return Window.partitionBy(*keys).orderBy(order)


def index_samples(df: DataFrame, keys: Sequence[str], ts_min: str, order: str, value: str, cut: Cut = Cut()) -> DataFrame:
    """Samples in time order: keys, idx (from 0), ts_min, value."""
    rows = scans.scan(df, keys, [ts_min, order], {"_n": scans.sum_upto(F.lit(1))}, cut.minutes)
    return rows.select(*keys, (F.col("_n") - 1).cast("long").alias("idx"), F.col(ts_min).alias("ts_min"), F.col(value).alias("value"))


def rising_crossings(samples: DataFrame, keys: Sequence[str], band: float = BAND, cut: Cut = Cut()) -> DataFrame:
    """Rows where the value comes to the band from below, later than the row before, and the first later row below it."""
    rows = scans.scan(samples.select(*keys, "idx", "ts_min", "value"), keys, ["idx"], {"_p": scans.previous(F.struct("value", "ts_min"))}, cut.steps)
    below, was = holds(F.col("value") < band), holds(F.col("_p.value") < band)
    crosses = holds((F.col("ts_min") > F.col("_p.ts_min")) & (F.col("value") >= band)) & was
    # the first later row below the band has none below it before, so only crossings and such rows are searched
    rows = rows.where(crosses | (below & ~was)).select(*keys, "idx", "ts_min", crosses.alias("_up"))
    rows = scans.scan(rows, keys, ["idx"], {"r": scans.next_present(F.when(~F.col("_up"), F.struct("idx", "ts_min")))}, cut.steps).where("_up")
    rows = scans.scan(rows, keys, ["idx"], {"_n": scans.sum_upto(F.lit(1))}, cut.steps)
    return rows.select(
        *keys, F.col("_n").cast("long").alias("event_id"), F.col("idx").alias("crossing_index"), F.col("ts_min").alias("crossing_ts"),
        F.col("r.idx").alias("recovery_index"), F.col("r.ts_min").alias("recovery_ts"),
    )


def event_zones(crossings: DataFrame, keys: Sequence[str], pre: float = PRE_WINDOW) -> DataFrame:
    """crossings with zone_start, later than which a flag detects; the zone ends with the recovery, or never."""
    prev = F.lag("recovery_ts").over(_w(keys, "event_id"))
    return crossings.withColumn("zone_start", F.greatest(F.col("crossing_ts") - pre, prev))


def normal_zones(samples: DataFrame, zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(span_start, span_end): the stream's time outside all zones, spans of positive length."""
    span = samples.groupBy(*keys).agg(F.min("ts_min").alias("t0"), F.max("ts_min").alias("t1"))
    events = zones.join(span, list(keys)).select(*keys, "event_id", "zone_start", F.coalesce("recovery_ts", "t1").alias("zone_end"), "t0")
    w = _w(keys, "event_id")
    before = events.select(*keys, F.coalesce(F.lag("zone_end").over(w), F.col("t0")).alias("span_start"), F.col("zone_start").alias("span_end"))
    last = events.groupBy(*keys).agg(F.max("zone_end").alias("e"))
    after = span.join(last, list(keys), "left").select(*keys, F.coalesce("e", "t0").alias("span_start"), F.col("t1").alias("span_end"))
    return before.unionByName(after).where("span_end > span_start")


def zone_index(samples: DataFrame, zones: DataFrame, keys: Sequence[str], cut: Cut = Cut()) -> DataFrame:
    """samples with event_id of the zone (start, recovery] they lie in, or NULL, and the zone's crossing_ts.

    Zones of a stream don't overlap and come in order, so the last zone that starts before a sample is the only one that can
    hold it: starts and samples are merged and carried forward, with no range join.
    """
    marks = zones.select(
        *keys, F.col("zone_start").alias("ts_min"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("idx"),
        F.struct("event_id", "crossing_ts", "recovery_ts").alias("_z"),
    )
    rows = samples.withColumn("_kind", F.lit(0))
    # a sample at a zone's very start lies outside, so samples come before marks of the same time
    merged = rows.unionByName(marks, allowMissingColumns=True).withColumnsRenamed({"_kind": "_mark", "_z": "_opened"})
    order = ["ts_min", "_mark", F.coalesce("idx", F.col("_opened.event_id"))]
    merged = scans.scan(merged, keys, order, {"_z": scans.last_upto(F.col("_opened"))}, cut.minutes).where("_mark = 0")
    inside = F.col("_z").isNotNull() & (F.col("_z.recovery_ts").isNull() | (F.col("ts_min") <= F.col("_z.recovery_ts")))
    pick = lambda c: F.when(inside, F.col(f"_z.{c}")).alias(c)
    return merged.select(*samples.columns, pick("event_id"), pick("crossing_ts"))


def per_event(flagged: DataFrame, zones: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each event with its first flag in the zone and its lead; flagged: zone-indexed samples with flagged, by configuration."""
    on = [*by, *keys, "event_id"]
    hit = flagged.where(F.col("event_id").isNotNull() & holds(F.col("flagged"))).groupBy(*on).agg(
        F.min("ts_min").alias("first_flag_ts"), F.min(F.when(F.col("ts_min") <= F.col("crossing_ts"), F.col("ts_min"))).alias("_pre")
    )
    all_ = zones
    if by:
        all_ = zones.crossJoin(F.broadcast(flagged.select(*by).distinct()))  # the configurations
    return all_.join(hit, on, "left").select(
        *on, "crossing_index", "crossing_ts", F.col("_pre").isNotNull().alias("detected"), F.col("first_flag_ts").isNotNull().alias("detected_in_zone"),
        "first_flag_ts", (F.col("crossing_ts") - F.col("first_flag_ts")).alias("lead_min"), holds(F.col("_pre") < F.col("crossing_ts")).alias("first_flag_pre_crossing"),
    )


def false_alarm_episodes(flagged: DataFrame, keys: Sequence[str], by: Sequence[str] = (), cut: Cut = Cut()) -> DataFrame:
    """Runs of flagged rows, of those that hold a row outside all zones: episodes begin there.

    A run that passes through a zone is one episode, as only an unflagged row ends it.
    """
    stream = [*by, *keys]
    f = scans.scan(flagged.withColumn("_on", holds(F.col("flagged"))), stream, ["idx"], {"_was": scans.previous(F.col("_on"))}, cut.steps)
    fresh = F.col("_on") & ~F.coalesce("_was", F.lit(False))
    f = scans.scan(f, stream, ["idx"], {"_run": scans.sum_upto(fresh.cast("int"))}, cut.steps)
    out = f.where(F.col("_on") & F.col("event_id").isNull())
    return out.groupBy(*stream, "_run").agg(F.min("ts_min").alias("start")).drop("_run")


def evaluate(flagged: DataFrame, samples: DataFrame, zones: DataFrame, keys: Sequence[str], by: Sequence[str] = (), cut: Cut = Cut()) -> DataFrame:
    """Totals over all streams, by configuration: events detected, leads, false-alarm episodes and their rate."""
    lead = F.when(F.col("detected"), F.col("lead_min"))
    found = per_event(flagged, zones, keys, by).groupBy(*by, lead.alias("_lead")).agg(F.count("*").alias("_k"), F.count_if("detected_in_zone").alias("_z"))
    events = _leads(found, by, F.sum("_k").alias("events_total"), F.sum(F.when(F.col("_lead").isNotNull(), F.col("_k")).otherwise(0)).alias("events_detected"), F.sum("_z").alias("events_detected_in_zone"))
    rows = flagged.groupBy(*by).agg(F.count_if(holds(F.col("flagged"))).alias("total_flagged_rows"), F.count_if(holds(F.col("data_anomaly"))).alias("data_anomaly_rows"))
    episodes = false_alarm_episodes(flagged, keys, by, cut).groupBy(*by).agg(F.count("*").alias("false_alarm_episodes"))
    days = normal_zones(samples, zones, keys).agg((F.sum(F.col("span_end") - F.col("span_start")) / 1440.0).alias("normal_days"))
    if by:
        out = rows.join(events, list(by), "left").join(episodes, list(by), "left")
    else:
        out = rows.crossJoin(events).crossJoin(episodes)  # one row each
    out = out.crossJoin(F.broadcast(days)).withColumn("false_alarm_episodes", F.coalesce("false_alarm_episodes", F.lit(0)))
    return out.withColumn("false_alarm_rate_per_day", F.when(F.col("normal_days") > 0, F.col("false_alarm_episodes") / F.col("normal_days")))


def _leads(found: DataFrame, by: Sequence[str], *counts: Column) -> DataFrame:
    """By group: counts, and the mean and median of _lead, of a table in which a row stands for _k events."""
    n, total = F.sum(F.when(F.col("_lead").isNotNull(), F.col("_k"))), F.sum(F.col("_lead") * F.col("_k"))
    sums = found.groupBy(*by).agg(*counts, F.bround(total / n, 3).alias("mean_lead_time_min"))
    middle = ranks.counted_quantiles(found, "_lead", {"_m": 0.5}, by, "_k").withColumn("median_lead_time_min", F.bround("_m", 3)).drop("_m")
    return sums.join(middle, list(by), "left") if by else sums.crossJoin(middle)  # one row each


def sweep_totals(flagged: DataFrame, samples: DataFrame, zones: DataFrame, keys: Sequence[str], configs: DataFrame, by: Sequence[str] = (), cut: Cut = Cut()) -> DataFrame:
    """evaluate() of many configurations at once, by view (by) and config_id.

    flagged: zone-indexed samples with data_anomaly and on, an array of decisions, or bits, which rules.packed_sweep gives; configs:
    (place among the decisions, config_id, and what else is to be told), of bounded size. A row's decisions are bits of a few numbers,
    so what runs along a stream runs for all configurations at once, and rows are never unrolled: tasks count bits.

    An episode begins at a row outside all zones that is flagged, unless the flagged run that it belongs to already held such a
    row: _c has the bits of that row and all rows of the zones behind it.
    """
    stream = [*by, *keys]
    inside, ts = F.col("event_id").isNotNull(), F.col("ts_min")
    if "bits" not in flagged.columns:
        n = (configs.agg(F.max("place")).first()[0] or 0) + 1
        on = F.concat(F.array(F.lit(True), holds(F.col("data_anomaly"))), F.slice("on", 1, n))
        flagged = flagged.withColumn("bits", bits.pack(on, n + rules.LEADING))
    k = len(flagged.schema["bits"].dataType)
    w, c, seen = (bits.names(p, k) for p in ("_w", "_c", "_s"))
    rows = flagged.select(*stream, "idx", "ts_min", "event_id", "crossing_ts", *[F.col("bits")[f"w{i}"].alias(x) for i, x in enumerate(w)])
    rows = scans.scan(rows, stream, ["idx"], {"_block": scans.sum_upto((~inside).cast("int"))}, cut.steps)
    rows = scans.scan(rows, [*stream, "_block"], ["idx"], {y: scans.common_upto(F.col(x)) for x, y in zip(w, c)}, cut.steps)
    held = F.when(F.col("_block") > 0, F.struct(*c))
    rows = scans.scan(rows.withColumn("_held", held), stream, ["idx"], {"_p": scans.previous(F.col("_held"))}, cut.steps)
    rows = scans.scan(rows, [*stream, "event_id"], ["idx"], {y: scans.bits_before(F.col(x)) for x, y in zip(w, seen)}, cut.steps)
    zero = F.lit(0).cast("long")
    without = lambda x, y: F.col(x).bitwiseAND(F.bitwise_not(F.coalesce(y, zero)))
    rows = rows.select(
        *by, F.when(ts <= F.col("crossing_ts"), F.col("crossing_ts") - ts).alias("_lead"), *w,
        *[F.when(~inside, without(x, F.col("_p")[y])).otherwise(zero).alias(f"_begin{i}") for i, (x, y) in enumerate(zip(w, c))],
        *[F.when(inside, without(x, F.col(y))).otherwise(zero).alias(f"_first{i}") for i, (x, y) in enumerate(zip(w, seen))],
    )
    counts = bits.places(rows, by, [(w, None), (bits.names("_begin", k), None), (bits.names("_first", k), F.col("_lead"))])
    counts = written(counts, "sweep-counts").withColumn("place", F.col("place") - rules.LEADING)
    sum_of = lambda kind: F.sum(F.when(F.col("_kind") == kind, F.col("_k")))
    rows_of = counts.groupBy(*by, "place").agg(sum_of(0).alias("total_flagged_rows"), sum_of(1).alias("false_alarm_episodes"))
    found = counts.where("_kind = 2 AND place >= 0").select(*by, "place", "_lead", "_k")
    events = _leads(found, [*by, "place"], F.sum(F.when(F.col("_lead").isNotNull(), F.col("_k"))).alias("events_detected"), F.sum("_k").alias("events_detected_in_zone"))
    # of the leading bits the first is every row's, the second tells an anomaly
    leading = counts.where("_kind = 0 AND place < 0").groupBy(*by)
    anomalies = leading.agg(F.coalesce(F.sum(F.when(F.col("place") == 1 - rules.LEADING, F.col("_k"))), F.lit(0)).alias("data_anomaly_rows"))
    views = _views(anomalies, samples, zones, keys, by)
    out = views.crossJoin(F.broadcast(configs)).join(rows_of, [*by, "place"], "left").join(events, [*by, "place"], "left")  # views x configurations
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        *by, *[c for c in configs.columns if c not in ("place", "causal")], zero("total_flagged_rows"),
        F.when(F.col("causal"), F.col("data_anomaly_rows")).otherwise(F.lit(0)).alias("data_anomaly_rows") if "causal" in configs.columns else F.col("data_anomaly_rows"),
        "events_total", zero("events_detected"), zero("events_detected_in_zone"), "mean_lead_time_min", "median_lead_time_min", zero("false_alarm_episodes"), "normal_days",
        F.when(F.col("normal_days") > 0, F.coalesce("false_alarm_episodes", F.lit(0)) / F.col("normal_days")).alias("false_alarm_rate_per_day"),
    )


def _views(anomalies: DataFrame, samples: DataFrame, zones: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A row for each view: its anomalies, events and normal days."""
    stream = [*by, *keys]
    events = zones.groupBy(*by).agg(F.count("*").alias("events_total"))
    days = normal_zones(samples, zones, stream).groupBy(*by).agg((F.sum(F.col("span_end") - F.col("span_start")) / 1440.0).alias("normal_days"))
    if not by:
        return anomalies.crossJoin(events).crossJoin(days)  # one row each
    return anomalies.join(events, list(by), "left").join(days, list(by), "left").withColumn("events_total", F.coalesce("events_total", F.lit(0)))


def sweep_summary(totals: DataFrame, detected: str = "events_detected", alarms: str = "false_alarm_episodes", causal: Column | None = None) -> DataFrame:
    """One row: configurations, views, the longest mean lead, and the configurations on the frontier of those that are causal."""
    real = totals if causal is None else totals.where(causal)
    front = pareto_frontier(real, detected, alarms).agg(F.count("*").alias("pareto_points"))
    return totals.agg(F.count("*").alias("n_configs"), F.max("mean_lead_time_min").alias("max_lead_time_min_over_all_filters")).crossJoin(front)  # one row each


def notable(totals: DataFrame, view: Column, labels: Sequence[str]) -> DataFrame:
    """The named configurations of one view."""
    return totals.where(view & F.col("threshold").isin(*labels)).select(
        "filter_type", "threshold", F.col("events_detected").alias("detected"), F.col("mean_lead_time_min").alias("mean_lead_min"), F.col("false_alarm_rate_per_day").alias("fa_per_day")
    )


def pareto_frontier(df: DataFrame, detected: str, alarms: str) -> DataFrame:
    """Rows that no other beats: none with as many detections and as few alarms, and better in one. Ties stay.

    A row is beaten if a row with fewer alarms detects as many, or one with equal alarms detects more: windows over
    the distinct alarm counts of a range of counts, and over the ranges, instead of all pairs.
    """
    best = df.groupBy(alarms).agg(F.max(detected).alias("_best")).withColumn("_range", ranks.magnitude(F.col(alarms).cast("double")))
    ranges = best.groupBy("_range").agg(F.max("_best").alias("_most"))
    lower = F.max("_most").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max("_best").over(Window.partitionBy("_range").orderBy(alarms).rowsBetween(Window.unboundedPreceding, -1))
    best = best.join(ranges.select("_range", lower.alias("_lower")), "_range").select(alarms, "_best", F.greatest(inside, "_lower").alias("_before"))
    kept = df.join(best, alarms).where((F.col(detected) == F.col("_best")) & (F.col("_before").isNull() | (F.col(detected) > F.col("_before"))))
    return kept.drop("_best", "_before").orderBy(F.desc(detected), alarms)


def roc_series(df: DataFrame, kind: str, detected: str, alarms: str) -> DataFrame:
    return df.where(F.col("filter_type") == kind).select(detected, alarms).orderBy(alarms, detected)


def lead_histogram(events: DataFrame, bins: int = 20, lo: float = -60.0, hi: float = 60.0) -> DataFrame:
    leads = events.where("detected").select(F.width_bucket("lead_min", F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin"))
    return leads.groupBy("bin").agg(F.count("*").alias("n"))


def alert_classes(events: DataFrame) -> DataFrame:
    return events.groupBy(exprs.alert_class(F.col("first_flag_ts"), F.col("crossing_ts")).alias("first_alert_class")).agg(F.count("*").alias("n_events"))
