"""Queries over the driver's tables, one or more for each operator; oracles.py has the SQL of the same names.

The events table stands for telemetry: a stream for each user, event_id as the raw order. Doubles that
come out of sums or divisions are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.operators import alignment, evaluate, islands, parity, physics, policies, quality, ranks, replay, rules, scans, timeseries
from gridpulse.schema import Channel
from gridpulse.sources import telemetry
from gridpulse.sources.scratch import new_folder
from gridpulse.sources.sequences import SequenceSource
from gridpulse.streaming.rules import state_of, stream_rule

KEYS = ("user_id",)
CH = Channel("ts", "event_id", KEYS)
#: Times cut to the hour repeat within a stream.
HOURLY = Channel("ts_h", "event_id", KEYS)
SENSORS = ("value", "error", "high")
CUTOFF = 28_404_000.0  # minutes since 1970: 2024-01-03 00:00 plus ten days

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(
        "user_id", "event_id", "ts", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts_h"), "value", "event_type",
        (F.col("event_type") == "error").cast("double").alias("error"), (F.col("value") >= 100).cast("double").alias("high"), exprs.minutes("ts").alias("t"),
    )


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.index_samples(_events(spark, d), KEYS, "t", "event_id", "value")


def _zones(samples: DataFrame) -> DataFrame:
    return evaluate.event_zones(evaluate.rising_crossings(samples, KEYS), KEYS)


IDX = Channel("ts_min", "idx", KEYS)


@query
def inventory(spark, d):
    return quality.inventory(_events(spark, d), SENSORS, HOURLY)


@query
def coercion_failures(spark, d):
    e = _events(spark, d).select(F.when(F.col("value") >= 1, F.col("value")).alias("value"), F.when(F.col("high") == 1, 1.0).alias("high"), "error")
    return quality.coercion_failures(e, SENSORS)


@query
def repeated_groups(spark, d):
    return rounded(quality.repeated_groups(_events(spark, d), SENSORS, HOURLY, ("error", "high")))


@query
def conflict_summary(spark, d):
    return rounded(quality.conflict_summary(quality.repeated_groups(_events(spark, d), SENSORS, HOURLY, ("error", "high"))))


@query
def duplicate_summary(spark, d):
    by_type = Channel("ts_h", "event_id", ("event_type",))
    return quality.duplicate_summary(quality.repeated_groups(_events(spark, d), ("value", "high"), by_type), ["event_type"])


@query
def value_distribution(spark, d):
    return rounded(quality.value_distribution(_table(spark, d, "lineitem"), ("l_quantity", "l_discount", "l_tax", "l_linenumber")))


@query
def multiplicity(spark, d):
    return quality.multiplicity(_events(spark, d), HOURLY)


@query
def flag_consistency(spark, d):
    return quality.flag_consistency(_events(spark, d), "value", "error", 100.0)


@query
def high_in_repeated(spark, d):
    return quality.high_in_repeated(_events(spark, d), "value", 100.0, HOURLY)


@query
def band_unimodality(spark, d):
    return rounded(quality.band_unimodality(_table(spark, d, "events"), "value"))


@query
def neighbour_fit(spark, d):
    return quality.neighbour_fit(_events(spark, d), "value", HOURLY)


def _pivot(spark, d):
    """Hourly means of each type of event: an electrical table of its kind."""
    of = lambda kind: F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6)
    return _events(spark, d).groupBy("ts_h").agg(*[of(k).alias(k) for k in ("click", "view", "signup", "purchase", "error")], F.round(F.sum("value") / 100, 6).alias("kva"))


@query
def power_approximation_errors(spark, d):
    p = _pivot(spark, d)
    three = ("click", "view", "signup")
    return rounded(quality.power_approximation_errors(p.drop("kva"), p.select("ts_h", "kva"), ["ts_h"], three, ("purchase", "error", "view"), three, "kva"), 4)


@query
def correlation(spark, d):
    return rounded(quality.correlation(_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", F.col("l_discount") < 0.05))


@query
def monthly_repeated_groups(spark, d):
    return quality.monthly_groups(quality.repeated_groups(_table(spark, d, "orders"), ("o_totalprice",), Channel("o_orderdate", "o_orderkey")))


@query
def row_confusion(spark, d):
    return rounded(quality.confusion(_events(spark, d), F.col("value") >= 100, F.col("error") == 1))


@query
def headline_scalars(spark, d):
    on, v = F.col("error") == 1, F.col("value")
    return _events(spark, d).agg(
        F.max(F.when(on, v)).alias("max_error_value"), F.min(F.when(on, v)).alias("min_error_value"), F.count_if(on & (v >= 100)).alias("n_high_errors"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"),
    )


@query
def quantiles(spark, d):
    price = F.col("l_extendedprice")
    return rounded(ranks.quantiles(_table(spark, d, "lineitem"), {f"q{i}": (price, p) for i, p in enumerate((0.01, 0.5, 0.99, 0.999))}, ["l_returnflag"], few=True))


@query
def interval_summary(spark, d):
    return rounded(timeseries.interval_summary(_events(spark, d), CH))


@query
def onset_counts(spark, d):
    return timeseries.onset_sensitivity(_events(spark, d).drop("ts", "t"), "high", HOURLY)


@query
def flag_transitions(spark, d):
    return rounded(timeseries.flag_transitions(_events(spark, d), "high", CH))


@query
def rate_summary(spark, d):
    return rounded(timeseries.rate_summary(_events(spark, d), "value", F.col("value") >= 100, CH))


@query
def top_rate_transitions(spark, d):
    return rounded(timeseries.top_rate_transitions(_events(spark, d), "value", 30, 1.0, CH))


@query
def autocorrelation(spark, d):
    return rounded(timeseries.autocorrelation(_events(spark, d), "value", (1, 2, 4, 8), CH))


@query
def value_gaps(spark, d):
    return rounded(timeseries.value_gaps(_table(spark, d, "events"), "value", 1.0))


@query
def threshold_separability(spark, d):
    return rounded(timeseries.separability(_events(spark, d), "value", ("error", "high")))


@query
def band_transitions(spark, d):
    r = timeseries.band_transitions(_events(spark, d), "value", 100.0, CH)
    return rounded(r.select("user_id", "event_id", "direction", "dt_minutes", "prev_value", "value"))


@query
def policy_metrics(spark, d):
    views = policies.policy_views(_events(spark, d).drop("ts", "t"), HOURLY, sensors=SENSORS)
    keyed = Channel("ts_h", "event_id", ("policy", "user_id"))
    r = timeseries.rates(views, "value", keyed).groupBy("policy").agg(
        F.count("*").alias("n_records"), F.max("rate_per_min").alias("max_positive_rate_per_min"), F.min("rate_per_min").alias("max_negative_rate_per_min"),
        F.count_if((F.col("dt_minutes") > 0) & (F.col("prev_value") < 100) & (F.col("value") >= 100)).alias("high_rising_transitions"),
        F.count_if(F.col("dt_minutes") <= 0).alias("n_intervals_excluded_nonpositive"),
    )
    u = views.groupBy("policy").agg(
        F.count_distinct(F.struct("user_id", "ts_h")).alias("n_unique_timestamps"),
        F.avg(((F.col("value") >= 236) == (F.col("error") == 1)).cast("double")).alias("rule_accuracy"),
    )
    return rounded(r.join(u, "policy"))


@query
def policy_rows(spark, d):
    views = policies.policy_views(_events(spark, d).drop("ts", "t"), HOURLY, sensors=SENSORS)
    return views.select("policy", "user_id", "event_id", "value")


@query
def policy_mean(spark, d):
    return rounded(policies.canonicalize(_events(spark, d), "mean", HOURLY, ("value", "high")))


@query
def occurrence_report(spark, d):
    return policies.occurrence_report(_events(spark, d), HOURLY)


@query
def occurrence_stream(spark, d):
    return policies.occurrence_stream(_events(spark, d), HOURLY, 2).select("user_id", "ts_h", "event_id", "occurrence")


@query
def first_record(spark, d):
    """The first record of the whole table by time."""
    return _events(spark, d).orderBy("ts", "event_id").limit(1).select("event_id", "user_id", "value")


@query
def valid_pairs(spark, d):
    p = timeseries.valid_pairs(_events(spark, d), "value", CH, 600.0)
    one = p.agg(F.count("*").alias("n"), F.max("rate").alias("max_rate"), F.max("jump").alias("max_jump"))
    return rounded(one.crossJoin(ranks.quantiles(p, {"q99_jump": (F.col("jump"), 0.99)})))  # one row each


@query
def primitive_events(spark, d):
    return rounded(islands.primitive_events(_events(spark, d), "high", 1440.0, CH))


@query
def merged_events(spark, d):
    return rounded(islands.merge_events(islands.primitive_events(_events(spark, d), "high", 1440.0, CH), 2880.0, KEYS))


@query
def event_sensitivity(spark, d):
    return rounded(islands.event_sensitivity(_events(spark, d), ("high", "error"), (60, 720, 1440), (0, 720, 2880), CH))


@query
def electrical_context(spark, d):
    e = _events(spark, d)
    onsets = e.where("value >= 236").select("user_id", F.col("event_id").alias("onset_id"), F.col("ts").alias("onset_ts"))
    other = e.select("user_id", "ts", F.col("value").alias("v"))
    return rounded(
        alignment.context(onsets, other, "onset_ts", "ts", 720.0, [F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_avg")], ["user_id", "onset_id"], KEYS)
    )


@query
def local_maximum(spark, d):
    e = _events(spark, d)
    rises = timeseries.band_transitions(e, "value", 100.0, CH).where("direction = 'rise'").select("user_id", "event_id", F.col("ts").alias("rise_ts"))
    other = e.select("user_id", "ts", F.col("value").alias("v"))
    return alignment.context(rises, other, "rise_ts", "ts", 30.0, [F.max("v").alias("local_max")], ["user_id", "event_id"], KEYS).drop("nearest_delta_minutes")


@query
def cross_alignment(spark, d):
    return rounded(alignment.cross_alignment(_events(spark, d), "event_type", "ts"))


@query
def shared_by_all(spark, d):
    return alignment.shared_by_all(_events(spark, d), "event_type", "ts_h")


@query
def shared_repeats(spark, d):
    return alignment.shared_repeats(_events(spark, d), "event_type", "ts_h")


@query
def set_intersection(spark, d):
    e = _events(spark, d)
    both = e.where("event_type = 'error'").select("ts_h").intersect(e.where("event_type = 'click'").select("ts_h"))
    return both.agg(F.count("*").alias("n_shared"))


@query
def rising_crossings(spark, d):
    return rounded(evaluate.rising_crossings(_samples(spark, d), KEYS))


@query
def event_zones(spark, d):
    return rounded(_zones(_samples(spark, d)).select("user_id", "event_id", "zone_start", "recovery_ts"))


@query
def normal_zones(spark, d):
    s = _samples(spark, d)
    return rounded(evaluate.normal_zones(s, _zones(s), KEYS))


@query
def zone_index(spark, d):
    s = _samples(spark, d)
    return evaluate.zone_index(s, _zones(s), KEYS).select("user_id", "idx", "event_id")


def _flagged(spark, d, rule: rules.Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = _samples(spark, d)
    z = _zones(s)
    f = rules.apply_rule(s, rule, "value", "ts_min", IDX).select("user_id", "idx", "ts_min", "value", "flagged", "data_anomaly")
    return evaluate.zone_index(f, z, KEYS), s, z


def _decisions(kind: str, thresholds: dict, behaviour: str):
    def run(spark, d):
        # in order of arrival, with times cut to the hour and some readings missing
        e = _events(spark, d).select("user_id", "event_id", exprs.minutes("ts_h").alias("th"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("v"))
        out = rules.apply_rule(e, rules.Rule(kind, thresholds, 1440.0, behaviour), "v", "th", Channel("th", "event_id", KEYS))
        return rounded(out.drop("th", "v"))

    return run


for _kind, _thresholds in (("rate", {"rate": 0.2}), ("range", {"upper": 100.0, "lower": 1.0}), ("combined", {"rate": 0.2, "upper": 100.0}), ("jump", {"jump": 60.0})):
    for _behaviour in ("reset", "continue"):
        QUERIES[f"rule_{_kind}_{_behaviour}"] = _decisions(_kind, _thresholds, _behaviour)


@query
def per_event_metrics(spark, d):
    f, s, z = _flagged(spark, d, rules.Rule("jump", {"jump": 60.0}))
    return rounded(evaluate.per_event(f, z, KEYS))


@query
def evaluate_flags(spark, d):
    f, s, z = _flagged(spark, d, rules.Rule("combined", {"rate": 0.2, "upper": 80.0}))
    return rounded(evaluate.evaluate(f, s, z, KEYS), 3)


@query
def baseline_threshold(spark, d):
    return _events(spark, d).agg(F.count_if(rules.b1_threshold(F.col("value"), 90.0)).alias("n_flagged"), F.count("*").alias("n"))


@query
def baseline_percentile(spark, d):
    return rules.b3_percentile(_events(spark, d), "value", 99.0).agg(F.count_if("flagged").alias("n_flagged"))


RATES, UPPERS, JUMPS = (0.02, 0.1, 0.5, 2.0), (80.0, 120.0, 200.0), (40.0, 80.0, 160.0)


def _configs() -> list[rules.Config]:
    rows = []
    for behaviour in ("reset", "continue"):
        rows += [("rate", behaviour, r, None, None) for r in RATES]
        rows += [("jump", behaviour, None, None, j) for j in JUMPS]
        rows += [("combined", behaviour, r, u, None) for r in RATES for u in UPPERS]
    rows += [("range", "reset", None, u, None) for u in UPPERS]
    return [rules.Config(f"{k}/{b}/{r}/{u}/{j}", k, b, 1440.0, r, u, None, j) for k, b, r, u, j in rows]


def _sweep(spark, d) -> DataFrame:
    s = _samples(spark, d)
    z = _zones(s)
    configs = _configs()
    f = rules.packed_sweep(evaluate.zone_index(s, z, KEYS), configs, "value", "ts_min", IDX)
    named = spark.createDataFrame([(i, c.config_id) for i, c in enumerate(configs)], "place int, config_id string")
    return evaluate.sweep_totals(f, s, z, KEYS, named)


@query
def filter_sweep(spark, d):
    return rounded(_sweep(spark, d), 3)


#: The whole sweep: values as many as the study's, on this data's scale; its baselines beside the rules.
SWEEP_RATES = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0)
SWEEP_UPPERS = (45.0, 48.0, 50.0, 52.0, 54.0, 60.0, 70.0, 80.0, 90.0, 100.0, 150.0, 200.0, 236.0)
SWEEP_JUMPS = (5.0, 10.0, 20.0, 30.0, 50.0, 100.0, 150.0)
PERCENTS, CHANCES, SEEDS = (95.0, 99.0, 99.5, 99.9), (1e-5, 1e-4, 5e-4, 1e-3, 5e-3, 1e-2, 5e-2), (42, 43, 44)
TRIVIAL = 236.0


def sweep_configs() -> list[tuple]:
    """(filter_type, threshold, gap_policy, seed, rate, upper, jump) of the rules, in the order of their decisions."""
    out = []
    for gap in ("reset", "continue"):
        out += [("F1_rate", f"rate>{r:g}", gap, None, r, None, None) for r in SWEEP_RATES]
        out += [("F2_range", f"OTI>{u:g}", gap, None, None, u, None) for u in SWEEP_UPPERS]
        out += [("F4_jump", f"|dOTI|>{j:g}", gap, None, None, None, j) for j in SWEEP_JUMPS]
        out += [("F3_combined", f"rate>{r:g};OTI>{u:g}", gap, None, r, u, None) for r in SWEEP_RATES for u in SWEEP_UPPERS]
    return out


def sweep_baselines() -> list[tuple]:
    """(filter_type, threshold, gap_policy, seed) of the baselines, whose decisions follow the rules'."""
    out = [("B1_trivial", f"OTI>={TRIVIAL:g}", "not_applicable", None)] + [("B3_percentile", f">p{x:g}", "not_applicable", None) for x in PERCENTS]
    return out + [("B2_random", f"p={p:g}", "not_applicable", seed) for p in CHANCES for seed in SEEDS]


def _policy_sweep(spark, d) -> DataFrame:
    """1,160 configurations: four record policies, and for each the rules in two gap behaviours and three baselines."""
    by, keys = ("policy",), ("policy", *KEYS)
    views = policies.policy_views(_events(spark, d).drop("ts", "t"), HOURLY, sensors=SENSORS).withColumn("t", exprs.minutes("ts_h"))
    s = evaluate.index_samples(views, keys, "t", "event_id", "value")
    z = evaluate.event_zones(evaluate.rising_crossings(s, keys), keys)
    causal = [rules.Config("", "", gap, 1440.0, rate, upper, None, jump) for _, _, gap, _, rate, upper, jump in sweep_configs()]
    cuts = ranks.quantiles(s, {f"p{i}": (F.col("value"), p / 100) for i, p in enumerate(PERCENTS)}, by, few=True)
    f = evaluate.zone_index(s, z, keys).join(F.broadcast(cuts), list(by))  # a row for each policy
    v = F.col("value")
    fixed = [rules.b1_threshold(v, TRIVIAL), *[v > F.col(f"p{i}") for i in range(len(PERCENTS))]]
    drawn = [rules.b2_random(p, seed, *[F.col(k) for k in keys], F.col("idx")) for p in CHANCES for seed in SEEDS]
    f = rules.packed_sweep(f, causal, "value", "ts_min", Channel("ts_min", "idx", keys), [*fixed, *drawn])
    named = [(i, *x[:4], True) for i, x in enumerate(sweep_configs())]
    named += [(len(named) + i, *x, False) for i, x in enumerate(sweep_baselines())]
    configs = spark.createDataFrame(named, "place int, filter_type string, threshold string, gap_policy string, seed long, causal boolean")
    return evaluate.sweep_totals(f, s, z, KEYS, configs, by)


@query
def policy_sweep(spark, d):
    return rounded(_policy_sweep(spark, d), 3)


@query
def sweep_summary(spark, d):
    return rounded(evaluate.sweep_summary(_policy_sweep(spark, d), causal=F.col("filter_type").startswith("F")), 3)


@query
def notable_configurations(spark, d):
    labels = ["rate>0.2", "rate>0.5", "rate>1", "|dOTI|>50", "OTI>50", "OTI>52", "OTI>54", "OTI>236", "rate>0.2;OTI>50", "rate>0.5;OTI>50", "OTI>=236", ">p95", ">p99", ">p99.5", ">p99.9"]
    view = (F.col("policy") == "P2_first") & F.col("gap_policy").isin("reset", "not_applicable")
    return rounded(evaluate.notable(_policy_sweep(spark, d), view, labels), 3)


@query
def baseline_random(spark, d):
    row = (F.col("user_id"), F.col("event_id"))
    draws = [F.count_if(rules.b2_random(p, seed, *row)).alias(f"n_{i}_{seed}") for i, p in enumerate((0.001, 0.05)) for seed in SEEDS]
    return _events(spark, d).agg(*draws)


@query
def per_event_detail(spark, d):
    """Each event with the times of its crossing and first flag as text, told by the samples there."""
    f, s, z = _flagged(spark, d, rules.Rule("jump", {"jump": 60.0}))
    told = s.join(_events(spark, d).select("user_id", F.col("t").alias("ts_min"), exprs.time_text("ts").alias("iso")).distinct(), ["user_id", "ts_min"])
    out = alignment.nearest_label(evaluate.per_event(f, z, KEYS), told, "crossing_ts", F.col("iso"), "ts_min", "idx", KEYS, "event_crossing_time")
    out = alignment.nearest_label(out, told, "first_flag_ts", F.col("iso"), "ts_min", "idx", KEYS, "first_flag_time")
    return out.select("user_id", "event_id", "event_crossing_time", "detected", "detected_in_zone", F.coalesce("first_flag_time", F.lit("")).alias("first_flag_time"), F.round("lead_min", 3).alias("lead_time_min"))


@query
def pareto_frontier(spark, d):
    # accounts by balance and number of orders: many detections, few alarms
    o = _table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("detected"), F.floor(F.sum("o_totalprice") / 1000).alias("alarms"))
    return evaluate.pareto_frontier(o, "detected", "alarms")


@query
def roc_series(spark, d):
    o = _table(spark, d, "events").groupBy(F.col("event_type").alias("filter_type"), "user_id").agg(F.count_if(F.col("value") > 100).alias("detected"), F.count("*").alias("alarms"))
    return evaluate.roc_series(o, "error", "detected", "alarms")


@query
def lead_histogram(spark, d):
    f, s, z = _flagged(spark, d, rules.Rule("jump", {"jump": 60.0}))
    return evaluate.lead_histogram(evaluate.per_event(f, z, KEYS))


@query
def first_alert_classes(spark, d):
    f, s, z = _flagged(spark, d, rules.Rule("jump", {"jump": 60.0}))
    return evaluate.alert_classes(evaluate.per_event(f, z, KEYS))


@query
def calibration(spark, d):
    return replay.calibrate(_events(spark, d), "value", CUTOFF, "t", CH)


@query
def calibration_alarm_excluded(spark, d):
    return replay.calibrate(_events(spark, d), "value", CUTOFF, "t", CH, 60.0)


def _late(spark, d, rule: rules.Rule) -> tuple[DataFrame, DataFrame]:
    """The rows and events from the cutoff on, of a rule that ran over each whole stream."""
    f, s, z = _flagged(spark, d, rule)
    return f.where(F.col("ts_min") >= CUTOFF), z.where(F.col("crossing_ts") >= CUTOFF)


@query
def replay_metrics(spark, d):
    f, z = _late(spark, d, rules.Rule("range", {"upper": 120.0}))
    return rounded(replay.replay_metrics(f, z, KEYS, F.col("value") >= 100))


@query
def replay_denominators(spark, d):
    return rounded(replay.denominators(_late(spark, d, rules.Rule("jump", {"jump": 60.0}))[0]))


@query
def exact_intervals(spark, d):
    e = _events(spark, d).groupBy("event_type").agg(F.count_if(F.col("event_id") % 97 == 0).alias("k"), F.count_if(F.col("event_id") % 89 == 0).alias("n"))
    e = e.select("event_type", F.least("k", "n").alias("k"), "n")
    return e.withColumn("i", replay.exact_interval(F.col("k"), F.col("n"))).select("event_type", "k", "n", "i.low", "i.high")


@query
def episode_bootstrap(spark, d):
    f, s, z = _flagged(spark, d, rules.Rule("jump", {"jump": 60.0}))
    return replay.day_bootstrap(replay.episodes_by_day(replay.replay_episodes(f, KEYS), f), 200)


@query
def chronological_split(spark, d):
    a, b = replay.split_chronological(_events(spark, d), CUTOFF, "t")
    return a.agg(F.count("*").alias("n_calibration")).crossJoin(b.agg(F.count("*").alias("n_test")))  # one row each


@query
def frozen_replay(spark, d):
    """The rule runs over each whole stream; what is evaluated are the rows and events from the cutoff on."""
    f, s, z = _flagged(spark, d, rules.Rule("range", {"upper": 120.0}))
    late = z.where(F.col("crossing_ts") >= CUTOFF)
    return rounded(evaluate.per_event(f.where(F.col("ts_min") >= CUTOFF), late, KEYS))


@query
def sustained_alerts(spark, d):
    f = _samples(spark, d).withColumn("flagged", F.col("value") > 60).withColumn("valid", F.col("value") >= 1)
    return rounded(replay.sustained_alerts(f, (1, 2, 3), KEYS))


@query
def persistence_in_zone(spark, d):
    f, s, z = _flagged(spark, d, rules.Rule("range", {"upper": 60.0}))
    inside = f.where("event_id IS NOT NULL").withColumn("valid", F.col("value").isNotNull())
    return rounded(replay.sustained_alerts(inside, (1, 2), (*KEYS, "event_id")))


@query
def pre_window_stats(spark, d):
    f, s, z = _flagged(spark, d, rules.Rule("range", {"upper": 60.0}))
    return rounded(replay.pre_window_stats(f, z, KEYS))


@query
def episodes_by_day(spark, d):
    f, s, z = _flagged(spark, d, rules.Rule("jump", {"jump": 60.0}))
    return replay.episodes_by_day(evaluate.false_alarm_episodes(f, KEYS), f)


@query
def replay_episodes_by_day(spark, d):
    f, s, z = _flagged(spark, d, rules.Rule("jump", {"jump": 60.0}))
    return replay.episodes_by_day(replay.replay_episodes(f, KEYS), f)


def _horizons(spark, d) -> DataFrame:
    return timeseries.pane_features(_events(spark, d).select("user_id", "t", "value"), "value", [2880.0], 1440.0, "t", KEYS).drop("length")


@query
def horizon_features(spark, d):
    return rounded(_horizons(spark, d))


@query
def horizon_thresholds(spark, d):
    return rounded(replay.horizon_thresholds(_horizons(spark, d), ("last", "maximum", "mean", "variability")), 4)


@query
def horizon_study(spark, d):
    return replay.horizon_study(_samples(spark, d), CUTOFF, KEYS)


def _decays(spark, d):
    r = timeseries.band_transitions(_events(spark, d), "value", 100.0, CH)
    return r.select("user_id", "event_id", F.col("prev_value").alias("t0"), F.col("value").alias("t1"), F.lit(20.0).alias("ta"), "dt_minutes")


@query
def tau_sensitivity(spark, d):
    t = physics.tau_sensitivity(_decays(spark, d), "t0", "t1", "ta", "dt_minutes", (-10, -5, 0, 5, 10), (0.5, 1, 2))
    return rounded(t.drop("ta", "dt_minutes"), 4)


@query
def mass_sensitivity(spark, d):
    r = _decays(spark, d).where("t1 > t0").select("user_id", "event_id", "dt_minutes", (F.col("t1") - F.col("t0")).alias("rise"))
    return rounded(physics.mass_sensitivity(r, (5, 20, 60, 120), (1.67, 2.2)))


@query
def power_curves(spark, d):
    r = _decays(spark, d).where("t1 > t0").select("user_id", "event_id", "dt_minutes", (F.col("t1") - F.col("t0")).alias("rise"))
    return rounded(physics.power_curves(r, (10, 100, 1000), 40.0, 2.0), 8)


def _rises(spark, d):
    """Rising transitions with the greatest value within 30 minutes, which stands for the local power."""
    e = _events(spark, d)
    up = timeseries.band_transitions(e, "value", 100.0, CH).where("direction = 'rise'")
    up = up.select("user_id", "event_id", F.col("ts").alias("rise_ts"), "dt_minutes", (F.col("value") - F.col("prev_value")).alias("rise"))
    near = alignment.context(up, e.select("user_id", "ts", F.col("value").alias("v")), "rise_ts", "ts", 30.0, [F.max("v").alias("local_max_kw_30min")], ["user_id", "event_id"], KEYS)
    return up.join(near.select("user_id", "event_id", "local_max_kw_30min"), ["user_id", "event_id"])


@query
def transitions_table(spark, d):
    time = exprs.time_text("rise_ts").alias("rise_timestamp")
    rises = _rises(spark, d).select("user_id", time, "dt_minutes", F.col("rise").alias("dT_units"), "local_max_kw_30min")
    down = timeseries.band_transitions(_events(spark, d), "value", 100.0, CH).where("direction = 'fall'")
    falls = down.select("user_id", exprs.time_text("ts").alias("fall_timestamp"), F.col("prev_value").alias("T0"), F.col("value").alias("T1"), F.lit(20.0).alias("Ta_used_ATI"), "dt_minutes")
    return rounded(physics.transitions(rises, falls, KEYS))


@query
def physics_sensitivity(spark, d):
    """Rises by four power scenarios, one of them the whole table's greatest value, and two heat capacities."""
    most = _events(spark, d).agg(F.max("value").alias("global_max_kw"))
    rises = _rises(spark, d).crossJoin(F.broadcast(most))  # one row
    powers = [physics.power(c, F.col(c)) for c in ("local_max_kw_30min", "global_max_kw")] + [physics.power(f"parameterized_{p}kw", F.lit(float(p))) for p in (500, 1500)]
    out = physics.scenarios(rises, powers, {"low": 1.67, "high": 2.2})
    return rounded(out.drop("rise_ts", "local_max_kw_30min", "global_max_kw"))


@query
def median_rise(spark, d):
    return rounded(ranks.quantiles(_rises(spark, d), {"median_rise": (F.col("rise"), 0.5), "median_dt": (F.col("dt_minutes"), 0.5)}))


@query
def cost_table(spark, d):
    return physics.cost_table(spark)


@query
def timestamp_parsing(spark, d):
    """Texts of many shapes, of which one kind is a timestamp."""
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm")
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, F.concat_ws("T", day, clock)).when(k == 1, F.concat_ws(" ", day, F.date_format("ts", "HH:mm:ss"))).when(k == 2, day)
        .when(k == 3, clock).when(k == 4, F.concat(F.lit(" "), day, F.lit("T"), clock, F.lit(" "))).otherwise(F.concat(day, F.lit("x")))
    )
    return _table(spark, d, "events").select("event_id", exprs.time_text(exprs.parse_timestamp(text)).alias("parsed"))


@query
def label_numbers(spark, d):
    e = _table(spark, d, "part")
    return e.select("p_partkey", exprs.first_number("p_brand").alias("brand_number"), F.col("p_type").rlike("^(ECO|PRO|STA)").alias("listed"))


@query
def decade_rounding(spark, d):
    v = _table(spark, d, "part").select(F.bround(F.col("p_size").cast("double"), -1).alias("band"))
    return v.groupBy("band").agg(F.count("*").alias("n"))


@query
def json_configs(spark, d):
    p = F.get_json_object("props", "$.k").cast("long")
    return _table(spark, d, "events").select("event_id", p.alias("k"), F.to_json(F.struct(p.alias("k"), F.col("event_type").alias("e"))).alias("config"))


@query
def calendar_buckets(spark, d):
    e = _events(spark, d)
    return e.groupBy(exprs.month_tag("ts").alias("month"), exprs.epoch_day(F.col("t")).alias("day")).agg(F.count("*").alias("n"))


@query
def filtered_projection(spark, d):
    e = _table(spark, d, "events").where(F.col("event_type").isin("error", "click") & (F.col("value") >= 100))
    return e.select("event_id", F.col("value").alias("reading"), F.lit("telemetry").alias("kind"))


@query
def file_hashes(spark, d):
    h = telemetry.hash_files(spark, f"{d}/events.parquet")
    return h.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "size_bytes", "sha256")


@query
def distinct_union(spark, d):
    e = _table(spark, d, "events")
    return e.where("value > 200").select("user_id").distinct().unionByName(e.where("value > 300").select("user_id"))


@query
def column_types(spark, d):
    return telemetry.column_types(spark, _table(spark, d, "events"))


#: Rows of a segment of the table as one stream.
SEGMENT = 1 << 16


def _one_stream(spark, d, ts: str = "t") -> tuple[DataFrame, Channel]:
    """All events as a single stream, and how it is cut."""
    e = _events(spark, d)
    return e, scans.fitted(e, Channel(ts, "event_id"), SEGMENT)


@query
def long_stream_decisions(spark, d):
    e, ch = _one_stream(spark, d)
    out = rules.apply_rule(e.select("event_id", "t", "value"), rules.Rule("combined", {"rate": 0.2, "upper": 100.0}, 60.0), "value", "t", ch)
    return rounded(out.drop("t", "value", "jump"))


@query
def long_stream_events(spark, d):
    e, ch = _one_stream(spark, d, "ts")
    return rounded(islands.primitive_events(e, "high", 30.0, ch))


@query
def long_stream_rates(spark, d):
    e, ch = _one_stream(spark, d, "ts")
    return rounded(timeseries.rate_summary(e, "value", F.col("value") >= 100, ch))


@query
def long_stream_zones(spark, d):
    e, ch = _one_stream(spark, d)
    s = evaluate.index_samples(e, (), "t", "event_id", "value", ch.cut)
    z = evaluate.event_zones(evaluate.rising_crossings(s, (), cut=ch.cut), ())
    return evaluate.zone_index(s, z, (), ch.cut).select("idx", "event_id")


@query
def number_labels(spark, d):
    price = exprs.general(F.col("p_retailprice"))
    return _table(spark, d, "part").select("p_partkey", price.alias("price"), F.concat(F.lit("price>"), price).alias("label"))


HEADER = "DeviceTimeStamp,value"


def _telemetry_files(spark, d) -> str:
    """A telemetry file for each type of event, in the order of event_id, under a header; returns their folder."""
    e = _events(spark, d)
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), exprs.general(F.col("value")))
    rows = e.select("event_type", "event_id", line.alias("line")).unionByName(e.select("event_type", F.lit(None).cast("long").alias("event_id"), F.lit(HEADER).alias("line")).distinct())
    path = new_folder(spark, "telemetry")
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "line").write.partitionBy("event_type").text(path)
    return f"{path}/*"


def _type_of(path: str) -> Column:
    return F.regexp_extract(path, "event_type=([^/]+)", 1).alias("event_type")


@query
def numbered_lines(spark, d):
    lines = telemetry.text_lines(spark, _telemetry_files(spark, d))
    return lines.select(_type_of("path"), F.col("_raw_line").alias("raw_line"), "line")


@query
def line_lookup(spark, d):
    """The raw lines of readings of 236 and more, found again by their numbers."""
    lines = telemetry.text_lines(spark, _telemetry_files(spark, d))
    read = lines.where("_raw_line > 1").select("path", "_raw_line", F.from_csv("line", "ts string, value double").alias("r"))
    found = telemetry.lookup_lines(lines, read.where("r.value >= 236"))
    return found.select(_type_of("path"), F.col("_raw_line").alias("raw_line"), "line")


@query
def file_manifest(spark, d):
    path = _telemetry_files(spark, d)
    manifest = telemetry.build_manifest(spark, path, kind="telemetry")
    state = telemetry.verify_files(spark, manifest, path)
    there = telemetry.hash_files(spark, path).select(_type_of("path"), telemetry.file_name(path).alias("filename"), "size_bytes", "sha256")
    return there.join(state, "filename").drop("filename")


@query
def sequence_files(spark, d):
    """Readings written as sequences by type and read back; those under 1 are missing."""
    w = F.row_number().over(Channel("event_id", "event_id", ("event_type",)).window())
    e = _events(spark, d).select(F.col("event_type").alias("key"), (w - 1).alias("idx"), F.when(F.col("value") >= 1, F.col("value")).alias("value"), F.col("t").alias("ts_min"))
    path = new_folder(spark, "sequences")
    telemetry.write_sequence(e, path, ["key"])
    spark.dataSource.register(SequenceSource)
    back = spark.read.format("sequence").load(path)
    return rounded(back.select("key", F.col("seq").bitwiseAND((1 << 32) - 1).alias("idx"), "value", "ts_min"))


STREAMED = rules.Rule("combined", {"rate": 0.2, "upper": 100.0, "lower": 1.0}, 1440.0)


def _streamed(spark, d) -> tuple[DataFrame, DataFrame, str]:
    """Readings by type of event as a table, the decisions of a stream over them, and its checkpoint."""
    readings = _events(spark, d).select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("value") >= 2, F.col("value")).alias("value"), exprs.minutes("ts_h").alias("ts_min"))
    folder = new_folder(spark, "streamed")
    readings.write.parquet(f"{folder}/in")
    stream = stream_rule(spark.readStream.schema(readings.schema).parquet(f"{folder}/in"), STREAMED)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/in"), spark.read.parquet(f"{folder}/out"), f"{folder}/state"


@query
def decision_parity(spark, d):
    """The rule on a table and on a stream of the same readings, compared decision by decision."""
    readings, decisions, _ = _streamed(spark, d)
    batch = rules.apply_rule(readings, STREAMED, "value", "ts_min", Channel("ts_min", "seq", ("key",)))
    columns = ["flagged", "reason", "rate", "jump", "data_anomaly", "state_updated", "note"]
    return parity.compare(batch, decisions, ["key", "seq"], columns)


@query
def stream_state(spark, d):
    return rounded(state_of(spark, _streamed(spark, d)[2]))


@query
def workload_cost(spark, d):
    """What the rules and models would cost on the readings of each type, a stream for each user."""
    e = _events(spark, d).select("event_type", "user_id", F.when(F.col("value") >= 1, F.col("value")).alias("value"))
    return physics.workload(e, "value", ["event_type"], KEYS)


@query
def column_profile(spark, d):
    return telemetry.column_profile(_table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
