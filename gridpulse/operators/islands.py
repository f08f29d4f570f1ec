"""Gaps and islands: runs of rows, events made of them, and their sensitivity to tolerances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.operators import ranks, scans
from gridpulse.operators.policies import apply_policy
from gridpulse.schema import Channel, holds


def islands(df: DataFrame, active: Column, breaks: Column, channel: Channel, name: str = "island") -> DataFrame:
    """Active rows with the number of their run in the stream: a run ends at an inactive row, or before a row that breaks."""
    order, cut = [channel.ts, channel.order], channel.cut.minutes
    marked = scans.scan(df.withColumn("_on", holds(active)), channel.keys, order, {"_was": scans.previous(F.col("_on"))}, cut)
    fresh = F.col("_on") & (~F.coalesce("_was", F.lit(False)) | holds(breaks))
    marked = marked.withColumn("_fresh", fresh).drop("_was")
    return scans.scan(marked, channel.keys, order, {name: scans.sum_upto(F.col("_fresh").cast("int"))}, cut).where("_on").drop("_on")


def primitive_events(df: DataFrame, flag: str, gap_minutes: float = 30.0, channel: Channel = Channel()) -> DataFrame:
    """Runs of flag == 1 on the first record of each time, with no step longer than the gap."""
    rows = apply_policy(df, "P2_first", channel).select(*channel.keys, channel.ts, channel.order, F.col(flag).alias("_flag"))
    rows = scans.scan(rows, channel.keys, [channel.ts, channel.order], {"_before": scans.previous(F.col(channel.ts))}, channel.cut.minutes)
    rows = rows.withColumn("_dt", exprs.between_minutes("_before", channel.ts)).drop("_before")
    runs = islands(rows, F.col("_flag") == 1, F.col("_dt") > gap_minutes, channel)
    return runs.groupBy(*channel.keys, "island").agg(
        F.min(channel.ts).alias("start"), F.max(channel.ts).alias("end"), F.count("*").alias("n_samples"),
        F.coalesce(F.max(F.when(~F.col("_fresh"), F.col("_dt"))), F.lit(0.0)).alias("max_intra_event_gap_minutes"),
    ).select(
        *channel.keys, F.lit(flag).alias("flag"), "start", "end", "n_samples",
        exprs.between_minutes("start", "end").alias("duration_minutes"), "max_intra_event_gap_minutes",
        F.lit(float(gap_minutes)).alias("continuity_gap_definition_minutes"),
    )


def merge_events(events: DataFrame, tolerance_minutes: float, keys: Sequence[str] = ()) -> DataFrame:
    """Events joined while the next starts within the tolerance of the last one's end."""
    by = [*keys, "flag"]
    w = Window.partitionBy(*by).orderBy("start")
    apart = exprs.between_minutes(F.lag("end").over(w), "start")
    marked = events.withColumn("_fresh", (apart.isNull() | (apart > tolerance_minutes)).cast("int"))
    marked = marked.withColumn("_group", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_samples").alias("n_samples"), F.count("*").alias("n_primitive_events"),
    ).select(*by, "start", "end", "n_samples", "n_primitive_events", exprs.between_minutes("start", "end").alias("duration_minutes"))


def atoms(df: DataFrame, flags: Sequence[str], gap: float, channel: Channel) -> DataFrame:
    """The leaves of the tree of events: keys, flag, start, end, n, and the link to the leaf before: adjacent, apart.

    A leaf is a run of active rows, on the first record of each time, without a step longer than the gap. adjacent: no inactive row lies
    between it and the leaf before, which ended apart minutes earlier; NULL if it is the first.
    """
    order, cut = [channel.ts, channel.order], channel.cut.minutes
    rows = apply_policy(df, "P2_first", channel).select(*channel.keys, channel.ts, channel.order, *[holds(F.col(f) == 1).alias(f"_on{i}") for i, f in enumerate(flags)])
    on = [f"_on{i}" for i in range(len(flags))]
    rows = scans.scan(rows, channel.keys, order, {"_p": scans.previous(F.struct(*on)), **{f"_t{i}": scans.last_before(F.when(F.col(c), F.col(channel.ts))) for i, c in enumerate(on)}}, cut)
    active = F.array_compact(F.array(*[F.when(F.col(c), F.struct(F.lit(f).alias("flag"), F.col("_p")[c].alias("adjacent"), F.col(f"_t{i}").alias("before"))) for i, (c, f) in enumerate(zip(on, flags))]))
    steps = rows.select(*channel.keys, channel.ts, channel.order, F.explode(active).alias("_a")).select(*channel.keys, channel.ts, channel.order, "_a.*")
    steps = steps.withColumn("apart", exprs.between_minutes("before", channel.ts))
    steps = steps.withColumn("_fresh", F.col("apart").isNull() | ~F.col("adjacent") | (F.col("apart") > gap))
    runs = scans.scan(steps, (*channel.keys, "flag"), order, {"leaf": scans.sum_upto(F.col("_fresh").cast("int"))}, cut)
    first = lambda c: F.max(F.when(F.col("_fresh"), F.col(c))).alias(c)
    return runs.groupBy(*channel.keys, "flag", "leaf").agg(F.min(channel.ts).alias("start"), F.max(channel.ts).alias("end"), F.count("*").alias("n"), first("adjacent"), first("apart"))


def event_sensitivity(df: DataFrame, flags: Sequence[str], gaps: Sequence[float], tolerances: Sequence[float], channel: Channel = Channel()) -> DataFrame:
    """Counts and durations of events for each flag, gap and tolerance; a tolerance of 0 or less leaves events unmerged.

    Rows are read once, whatever the grid: they make the leaves of a tree in which runs join at the time between them, and each gap
    and tolerance is a cut of it. A link holds events apart if it is longer than the gap or has inactive rows in it, and longer than
    the tolerance.
    """
    grid = [(float(g), float(t)) for g in gaps for t in tolerances]
    leaves = atoms(df, flags, min(map(float, gaps)), channel)
    primitive = lambda adjacent, apart, g: apart.isNull() | ~adjacent | (apart > g)
    cuts = lambda adjacent, apart, g, t: primitive(adjacent, apart, g) if t <= 0 else apart.isNull() | ((apart > t) & primitive(adjacent, apart, g))
    own = F.col("adjacent"), F.col("apart")
    after = F.col("_next.adjacent"), F.col("_next.apart")
    wanted = {f"_s{c}": scans.last_upto(F.when(cuts(*own, g, t), F.col("start"))) for c, (g, t) in enumerate(grid)}
    ends = scans.scan(leaves, (*channel.keys, "flag"), ["start", "leaf"], {**wanted, "_next": scans.next_present(F.struct("adjacent", "apart"))}, channel.cut.minutes)
    over = [F.when(F.col("_next").isNull() | cuts(*after, g, t), F.struct(F.lit(c).alias("cell"), F.col(f"_s{c}").alias("start"))) for c, (g, t) in enumerate(grid)]
    events = ends.select("flag", "end", F.explode(F.array_compact(F.array(*over))).alias("_e"))
    events = events.select("flag", F.col("_e.cell").alias("cell"), exprs.between_minutes("_e.start", "end").alias("d"))
    counts = events.groupBy("flag", "cell", "d").agg(F.count("*").alias("n"))
    told = counts.groupBy("flag", "cell").agg(F.sum("n").alias("n_events_after_merge"), F.max("d").alias("max_event_duration_minutes"))
    told = told.join(ranks.counted_quantiles(counts, "d", {"median_event_duration_minutes": 0.5}, ["flag", "cell"], "n"), ["flag", "cell"])
    whole = leaves.groupBy("flag").agg(F.sum("n").alias("total_active_samples"), F.array(*[F.count_if(primitive(*own, float(g))) for g in gaps]).alias("_n"))
    at = lambda k: F.get(F.array(*[F.lit(x[k]) for x in grid]), F.col("cell"))
    return told.join(whole, "flag").select(  # a row for each flag
        "flag", at(0).alias("continuity_gap_minutes"), at(1).alias("merge_tolerance_minutes"),
        F.get("_n", F.floor(F.col("cell") / len(tolerances)).cast("int")).alias("n_primitive_events"), "n_events_after_merge", "total_active_samples",
        "median_event_duration_minutes", "max_event_duration_minutes",
    )
