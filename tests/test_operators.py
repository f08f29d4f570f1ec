"""Small hand-made streams with known answers."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.operators import alignment, evaluate, islands, physics, policies, quality, ranks, replay, rules, timeseries
from gridpulse.schema import Channel

CH = Channel("ts", "line", ())


@pytest.fixture(scope="module")
def table(spark):
    """Nine rows: an identical repeat, an excursion, a conflicting repeat."""
    rows = [
        (2, "2020-01-01 00:00", 30.0, 0.0), (3, "2020-01-01 00:15", 31.0, 0.0), (4, "2020-01-01 00:15", 31.0, 0.0), (5, "2020-01-01 00:30", 32.0, 0.0),
        (6, "2020-01-01 00:45", 240.0, 1.0), (7, "2020-01-01 01:00", 242.0, 1.0), (8, "2020-01-01 01:15", 33.0, 0.0), (9, "2020-01-01 01:15", 48.0, 0.0),
        (10, "2020-01-01 01:30", 34.0, 0.0),
    ]
    return spark.createDataFrame(rows, "line long, text string, v double, flag double").withColumn("ts", exprs.parse_timestamp("text", strict=True)).drop("text").cache()


@pytest.mark.parametrize(
    ("text", "ok"),
    [("2019-06-25T13:06", True), ("2019-06-25 13:06:07.5", True), (" 2019-06-25T13:06 ", True), ("2019-06-25", False), ("13:06", False), ("x", False), ("2019-13-25T13:06", False), (None, False)],
)
def test_only_whole_timestamps_parse(spark, text, ok):
    df = spark.createDataFrame([(text,)], "s string").select(exprs.parse_timestamp("s").alias("t"))
    assert (df.first()["t"] is not None) is ok


def test_policies_keep_what_they_name(table):
    sizes = {p: policies.apply_policy(table, p, CH, ("v", "flag")).count() for p in policies.POLICIES}
    assert sizes == {"P1_preserve": 9, "P2_first": 7, "P3_last": 7, "P4_identical": 8}
    assert policies.apply_policy(table, "last", CH).where("v = 48").count() == 1
    with pytest.raises(ValueError):
        policies.apply_policy(table, "none", CH)


def test_repeats_and_conflicts(table):
    g = quality.repeated_groups(table, ("v", "flag"), CH, ("flag",)).orderBy("timestamp").collect()
    assert [r["conflicting_value_spreads"] for r in g] == ["", "v=33.0..48.0"]
    assert [(r["raw_lines"], r["identical_group"], r["conflicting_columns"], r["max_conflict_magnitude"]) for r in g] == [("3,4", True, "", 0.0), ("8,9", False, "v", 15.0)]
    s = quality.conflict_summary(quality.repeated_groups(table, ("v", "flag"), CH)).first()
    assert (s["repeated_groups"], s["conflicting_groups"]) == (2, 1)


def test_events_break_at_inactive_rows_and_long_gaps(table):
    e = islands.primitive_events(table, "flag", 30, CH).collect()
    assert len(e) == 1 and e[0]["n_samples"] == 2 and e[0]["duration_minutes"] == 15.0
    assert islands.primitive_events(table, "flag", 10, CH).count() == 2
    merged = islands.merge_events(islands.primitive_events(table, "flag", 10, CH), 15).collect()
    assert len(merged) == 1 and merged[0]["n_primitive_events"] == 2
    assert islands.merge_events(islands.primitive_events(table, "flag", 10, CH), 14).count() == 2


def test_sensitivity_equals_single_runs(table):
    s = {(r["continuity_gap_minutes"], r["merge_tolerance_minutes"]): r["n_events_after_merge"] for r in islands.event_sensitivity(table, ("flag",), (10, 30), (0, 15), CH).collect()}
    assert s == {(10.0, 0.0): 2, (10.0, 15.0): 1, (30.0, 0.0): 1, (30.0, 15.0): 1}


def test_rates_skip_steps_without_time(table):
    r = timeseries.rate_summary(table, "v", F.col("v") >= 236, CH, "P1_preserve").first()
    assert r["n_intervals_excluded_nonpositive_or_missing"] == 2 and r["n_rates_computed"] == 6
    assert r["rate_max_per_min"] == pytest.approx(208 / 15)


def test_onsets_transitions_and_gaps(table):
    o = timeseries.onset_counts(table, "flag", CH).first()
    assert (o["n_active_rows"], o["onsets_0_to_1"], o["offsets_1_to_0"]) == (2, 1, 1)
    assert [r["transition"] for r in timeseries.flag_transitions(table, "flag", CH).orderBy("timestamp").collect()] == ["0->1", "1->0"]
    g = timeseries.value_gaps(table, "v", 5.0).collect()
    assert [(r["lower_observed_value"], r["upper_observed_value"]) for r in g] == [(48.0, 240.0), (34.0, 48.0)]


def test_separability_takes_the_first_best(table):
    s = timeseries.separability(table, "v", ("flag",)).first()
    assert (s["best_threshold"], s["best_threshold_direction"], s["threshold_rule_accuracy"], s["classes_overlap"]) == (240.0, ">=", 1.0, False)


def test_window_joins(spark, table):
    onsets = table.where("v >= 236").select(F.col("ts").alias("o"))
    other = table.select("ts", F.col("v").alias("w"))
    c = alignment.context(onsets, other, "o", "ts", 15, [F.max("w").alias("m")], ["o"]).orderBy("o").collect()
    assert [(r["n_rows_in_window"], r["nearest_delta_minutes"], r["m"]) for r in c] == [(3, 0.0, 242.0), (4, 0.0, 242.0)]
    far = onsets.select((F.col("o") + F.expr("INTERVAL 9 DAYS")).alias("o"))
    assert {r["n_rows_in_window"] for r in alignment.context(far, other, "o", "ts", 15, [], ["o"]).collect()} == {0}


def test_nearest_times_cut_to_seconds(spark):
    rows = [("a", "2020-01-01 00:00:00"), ("a", "2020-01-01 01:00:00"), ("b", "2020-01-01 00:04:00.9"), ("b", "2020-01-01 01:00:00")]
    t = spark.createDataFrame(rows, "s string, x string").select("s", F.col("x").cast("timestamp_ntz").alias("t"))
    r = alignment.cross_alignment(t, "s", "t").first()
    assert (r["n_timestamps_a"], r["exact_matches"], r["nearest_delta_max_minutes"]) == (2, 1, 4.0)


def _samples(spark, values, step=15.0):
    return spark.createDataFrame([("k", i, i * step, float(v)) for i, v in enumerate(values)], "k string, idx long, ts_min double, value double")


def test_zones_open_after_their_start_and_close_with_recovery(spark):
    s = _samples(spark, [50, 50, 50, 50, 50, 120, 130, 50, 50, 110, 50, 50], 15.0)
    z = evaluate.event_zones(evaluate.rising_crossings(s, ["k"]), ["k"])
    got = [(r["crossing_index"], r["recovery_index"], r["zone_start"]) for r in z.orderBy("event_id").collect()]
    assert got == [(5, 7, 15.0), (9, 10, 105.0)]  # the second start is clipped at the first recovery
    idx = [r["event_id"] for r in evaluate.zone_index(s, z, ["k"]).orderBy("idx").collect()]
    assert idx == [None, None, 1, 1, 1, 1, 1, 1, 2, 2, 2, None]
    spans = [(r["span_start"], r["span_end"]) for r in evaluate.normal_zones(s, z, ["k"]).orderBy("span_start").collect()]
    assert spans == [(0.0, 15.0), (150.0, 165.0)]


def test_a_run_through_a_zone_is_one_episode(spark):
    s = _samples(spark, [50, 50, 50, 120, 50, 50, 50], 30.0)
    z = evaluate.event_zones(evaluate.rising_crossings(s, ["k"]), ["k"])
    f = evaluate.zone_index(s, z, ["k"]).withColumn("flagged", F.lit(True)).withColumn("data_anomaly", F.lit(False))
    r = evaluate.evaluate(f, s, z, ["k"]).first()
    assert (r["events_detected"], r["false_alarm_episodes"], r["mean_lead_time_min"]) == (1, 1, 30.0)


def test_quantiles_by_rank_equal_the_aggregate(spark):
    r = random.Random(3)
    values = [None, 0.0, -0.0, 1e-300, -1e300, 1e300, float("inf"), *[r.choice([-1, 1]) * 10 ** r.uniform(-9, 9) for _ in range(400)], *[float(r.randint(-3, 3)) for _ in range(300)]]
    df = spark.createDataFrame([(r.choice("abc"), v) for v in values] + [("none", None)], "k string, v double")
    ps = (0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0)
    got = {x["k"]: tuple(x)[1:] for x in ranks.quantiles(df, {f"q{i}": (F.col("v"), p) for i, p in enumerate(ps)}, ["k"]).collect()}
    want = {x["k"]: tuple(x["q"]) for x in df.groupBy("k").agg(F.percentile("v", F.lit(list(ps))).alias("q")).collect() if x["q"]}
    assert got.keys() == want.keys() and all(a == pytest.approx(b, rel=1e-12, nan_ok=True) for k in got for a, b in zip(got[k], want[k]))
    assert ranks.quantiles(df.where("k = 'none'"), {"a": (F.col("v"), 0.5)}).first() == (None,)


def test_running_sums_by_ranges(spark):
    r = random.Random(4)
    rows = [(k, v, r.randint(0, 5)) for k in "ab" for v in {round(r.uniform(-50, 50), 1) for _ in range(200)}]
    got = ranks.running(spark.createDataFrame(rows, "k string, v double, n long"), "v", ["n"], ["k"]).collect()
    for x in got:
        assert x["up_to_n"] == sum(n for k, v, n in rows if k == x["k"] and v <= x["v"]) and x["all_n"] == sum(n for k, _, n in rows if k == x["k"])


def test_long_streams_take_linear_time(spark):
    """A frame that follows each row would read 10^10 rows here."""
    n = 100_000
    s = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("idx"), (F.col("id") * 15.0).alias("ts_min"), F.when(F.col("id") % 50000 < 20000, 120.0).otherwise(50.0).alias("value"))
    start = time.time()
    got = [(r["crossing_index"], r["recovery_index"]) for r in evaluate.rising_crossings(s, ["k"]).collect()]
    assert got == [(50000, 70000)] and time.time() - start < 30


def test_nearest_times_over_spans(spark):
    r = random.Random(6)
    rows = [(s, 86400 * r.choice([0, 1, 2, 9, 30]) + r.randint(0, 86399)) for s in "abc" for _ in range(40)]
    t = spark.createDataFrame(rows, "s string, x long").select("s", F.timestamp_seconds("x").cast("timestamp_ntz").alias("t"), "x")
    got = {(x["file_a"], x["file_b"], x["x"]): x["delta"] for x in alignment.nearest_times(t.drop("x"), "s", "t").where("is_a").withColumn("x", F.unix_timestamp("t")).collect()}
    at = {s: sorted({x for k, x in rows if k == s}) for s in "abc"}
    assert got == {(a, b, x): min(abs(x - y) for y in at[b]) / 60 for a, b in (("a", "b"), ("a", "c"), ("b", "c")) for x in at[a]}


def test_sweep_totals_equal_single_evaluations(spark):
    r = random.Random(11)
    rows = []
    for k in "ab":
        t = 0.0
        for i in range(160):
            t += r.choice([5.0, 15.0, 30.0, 90.0])
            rows.append((k, i, t, r.choice([None, *[float(r.randint(40, 130)) for _ in range(8)]])))
    s = spark.createDataFrame(rows, "k string, idx long, ts_min double, value double")
    z = evaluate.event_zones(evaluate.rising_crossings(s, ["k"]), ["k"])
    zi = evaluate.zone_index(s, z, ["k"])
    ch = Channel("ts_min", "idx", ("k",))
    kinds = [("rate", {"rate": 1.0}), ("range", {"upper": 80.0, "lower": 45.0}), ("combined", {"rate": 3.0, "upper": 95.0}), ("jump", {"jump": 30.0}), ("range", {"upper": 41.0}), ("range", {"upper": 500.0})]
    configs = [rules.Config(f"{i}/{b}", kind, b, 60.0, **x) for i, (kind, x) in enumerate(kinds) for b in ("reset", "continue")]
    named = spark.createDataFrame([(i, c.config_id) for i, c in enumerate(configs)], "place int, config_id string")
    got = {x["config_id"]: x.asDict() for x in evaluate.sweep_totals(rules.sweep(zi, configs, "value", "ts_min", ch), s, z, ["k"], named).collect()}
    for i, (kind, x) in enumerate(kinds):
        for b in ("reset", "continue"):
            f = rules.apply_rule(zi, rules.Rule(kind, x, 60.0, b), "value", "ts_min", ch)
            want = evaluate.evaluate(f, s, z, ["k"]).first().asDict()
            assert want == {c: got[f"{i}/{b}"][c] for c in want}, (kind, b)


def test_baselines_draw_by_row(spark):
    df = spark.range(20000)
    one = df.agg(F.avg(rules.b2_random(0.05, 42, F.col("id")).cast("double"))).first()[0]
    assert abs(one - 0.05) < 0.006 and df.where(rules.b2_random(0.05, 42, F.col("id")) & rules.b2_random(0.05, 43, F.col("id"))).count() < 120


def test_occurrences(table):
    assert [r["line"] for r in policies.occurrence_stream(table, CH, 2).orderBy("line").collect()] == [4, 9]


def test_pareto_keeps_ties(spark):
    df = spark.createDataFrame([("a", 5, 1.0), ("b", 5, 1.0), ("c", 4, 1.0), ("d", 6, 2.0), ("e", 6, 3.0)], "n string, det long, fa double")
    assert sorted(r["n"] for r in evaluate.pareto_frontier(df, "det", "fa").collect()) == ["a", "b", "d"]


@pytest.mark.parametrize("bad", [("nope", {}), ("rate", {}), ("rate", {"rate": math.inf}), ("jump", {"jump": 1.0, "upper": 2.0})])
def test_rules_are_checked(bad):
    with pytest.raises(ValueError):
        rules.Rule(*bad)


def test_calibration_uses_earlier_rows_only(spark):
    rows = [(i, i * 15.0, float(i % 7)) for i in range(50)] + [(99, 2000.0, 999.0)]
    df = spark.createDataFrame(rows, "line long, t double, v double").withColumn("ts", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, cast(t as int), 0)"))
    c = {(r["rule"], r["variant"]): r["threshold"] for r in replay.calibrate(df, "v", 1000.0, "t", CH).collect()}
    assert c["F2_upper", "primary"] == 6.0 and c["F4_jump", "sensitivity:max"] == 6.0
    with pytest.raises(Exception, match="test period"):
        replay.guard_no_test_leakage(df, 1000.0, "t").collect()


def test_sustained_runs(spark):
    s = _samples(spark, [1, 0, 1, 1, 0, 1, 1, 1]).withColumn("flagged", F.col("value") == 1).withColumn("valid", F.lit(True))
    r = replay.sustained_alerts(s, (1, 2, 3), ["k"]).first()
    assert (r["sustained_k1_ts_min"], r["sustained_k2_ts_min"], r["sustained_k3_ts_min"]) == (0.0, 45.0, 105.0)


def test_exact_intervals(spark):
    rows = [(10, 10), (5, 10), (0, 10), (9, 10), (0, 0), (None, 4)]
    df = spark.createDataFrame(rows, "k long, n long").select("k", "n", replay.exact_interval(F.col("k"), F.col("n")).alias("i"))
    got = {(r["k"], r["n"]): r["i"] and (r["i"]["low"], r["i"]["high"]) for r in df.collect()}
    assert got == {(10, 10): (0.6915, 1.0), (5, 10): (0.1871, 0.8129), (0, 10): (0.0, 0.3085), (9, 10): (0.555, 0.9975), (0, 0): None, (None, 4): (0.0, 0.6024)}


def test_bootstrap_repeats(spark):
    days = lambda rows: spark.createDataFrame(rows, "day long, n_episodes long")
    a = replay.day_bootstrap(days([(1, 0), (2, 3), (3, 1)])).first()
    assert a == replay.day_bootstrap(days([(3, 1), (1, 0), (2, 3)]).repartition(3)).first()
    assert a["low"] < a["mean"] == round(4 / 3, 6) < a["high"]
    assert replay.day_bootstrap(days([(1, 2)]), 50).first() == (2.0, 2.0, 2.0)
    assert replay.day_bootstrap(days([])).first() == (None, None, None)


def test_physics(spark):
    x = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    n = lambda v: F.lit(float(v))
    assert x(exprs.energy_kj(n(2), n(60))) == 7200.0
    assert x(exprs.critical_mass_kg(n(1000), n(2), n(100))) == 5.0 and x(exprs.critical_mass_kg(n(1), n(0), n(1))) is None
    assert x(exprs.time_constant_minutes(n(100), n(60), n(20), n(30))) == pytest.approx(30 / math.log(2))
    assert x(exprs.time_constant_minutes(n(20), n(60), n(20), n(30))) is None
    assert (physics.total_operations("F3_combined"), physics.estimated_cycles("F1_rate"), physics.estimated_cycles("F3_combined", "float")) == (11, 29, 291)
    assert physics.dense_price((28, 16, 8, 1)) == physics.Price(609, 3529, 61986, 2436) and physics.trees_price(100, 6, 12) == physics.Price(600, 3000, None, 152_400)
    both = physics.transitions(spark.sql("SELECT 1 k, 'a' rise_timestamp, 2.0D dt_minutes, 3.0D dT_units, 4.0D local_max_kw_30min"), spark.sql("SELECT 1 k, 'b' fall_timestamp, 5.0D T0, 6.0D T1, 7.0D Ta_used_ATI, 8.0D dt_minutes"), ["k"])
    assert {tuple(r) for r in both.collect()} == {(1, "a", 2.0, 3.0, 4.0, "rising", None, None, None), (1, "b", 8.0, None, None, "falling", 5.0, 6.0, 7.0)}
