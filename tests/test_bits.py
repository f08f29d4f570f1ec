"""Decisions as bits: they equal the decisions one by one, and their counts those of the rows."""

import numpy as np
from pyspark.sql import functions as F

from gridpulse.operators import bits, evaluate, quality, rules, timeseries
from gridpulse.plans import queries as plans
from gridpulse.schema import Channel


def test_packed_decisions_are_those_of_the_sweep(spark):
    nan = float("nan")
    values = [10.0, 90.0, None, nan, 50.0, 49.0, float("inf"), 3.0, 3.0, 120.0, None, 70.0]
    rows = [("a", i, t, v) for i, (t, v) in enumerate(zip([0.0, 5.0, 6.0, 7.0, 7.0, 90.0, 91.0, 400.0, 401.0, 402.0, 403.0, None], values))]
    df = spark.createDataFrame(rows, "k string, idx long, ts_min double, value double")
    configs = [rules.Config(f"{u}/{r}/{j}/{g}", "", g, 60.0, r, u, 20.0 if u else None, j) for g in ("reset", "continue") for u in (None, 45.0, 80.0) for r in (None, 0.5) for j in (None, 30.0)] * 6
    ch = Channel("ts_min", "idx", ("k",))
    want = {r["idx"]: [True, r["data_anomaly"], *r["on"], r["idx"] % 2 == 1] for r in rules.sweep(df, configs, "value", "ts_min", ch).collect()}
    got = rules.packed_sweep(df, configs, "value", "ts_min", ch, [F.col("idx") % 2 == 1]).collect()
    n = len(configs) + 3
    assert n > 2 * bits.WORD and len(got) == len(rows)
    for r in got:
        on = np.unpackbits(np.array(list(r["bits"]), "<i8").view(np.uint8), bitorder="little")[:n]
        assert on.astype(bool).tolist() == want[r["idx"]]


def test_places_are_counted_by_group_and_number(spark):
    df = spark.range(9000, numPartitions=3).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 4000).cast("double").alias("x"), F.array(F.col("id") >= 0, F.col("id") % 2 == 0, F.lit(None).cast("boolean")).alias("on")
    )
    rows = df.select("g", "x", bits.pack(F.col("on"), 3)["w0"].alias("w0"))
    got = bits.places(rows, ["g"], [(["w0"], None), (["w0"], F.col("x"))]).collect()
    assert sorted((str(r["g"]), r["place"], r["_k"]) for r in got if r["_kind"] == 0) == sorted((g, p, k) for g in ("None", "1", "2") for p, k in ((0, 3000), (1, 1500)))
    by = [r for r in got if r["_kind"] == 1]
    assert sum(r["_k"] for r in by) == 13500 and len({(r["g"], r["_lead"], r["place"]) for r in by}) == len(by) and max(r["_k"] for r in by) == 1


def test_repeats_are_told_without_gathering_distinct_values(spark):
    nan = float("nan")
    groups = {1: [1.0, 1.0], 2: [1.0, 2.0], 3: [None, None], 4: [None, 2.0], 5: [nan, nan], 6: [nan, 1.0], 7: [0.0, -0.0], 8: [5.0]}
    rows = [(g, i, v, 1.0) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, line long, v double, u double").selectExpr("timestamp_seconds(g) AS timestamp", "line", "v", "u")
    found = quality.repeated_groups(df, ("v", "u"), Channel("timestamp", "line"), ("u",))
    assert [r["identical_group"] for r in found.orderBy("timestamp").collect()] == [True, False, True, False, True, False, True]
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_groups_do_not_shuffle_their_values(spark):
    d = "/root/testdata/sf0.001"
    plan = plans.quantiles(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_only_crossings_and_falls_look_for_the_next_row_below(spark):
    values = [50.0, 120.0, None, 130.0, 80.0, 70.0, 101.0, 90.0, 105.0, None, 99.0, 100.0]
    s = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate(values)], "k string, idx long, ts_min double, value double")
    got = evaluate.rising_crossings(s, ["k"])
    assert [(r["crossing_index"], r["recovery_index"]) for r in got.orderBy("event_id").collect()] == [(1, 4), (6, 7), (8, 10), (11, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    lines = plan[plan.index("idx#") :].splitlines()
    back = next(i for i, x in enumerate(lines) if "Window" in x and "DESC" in x)
    after = next(i for i, x in enumerate(lines) if i > back and "Window" in x)
    assert any("Filter" in x for x in lines[back:after])


def test_windows_are_summed_without_lists_or_sorts(spark):
    rows = [("a", float(t), float(v)) for t, v in ((0, 1), (30, 5), (70, 2), (200, 9), (215, 3), (330, 4), (400, 4))]
    df = spark.createDataFrame(rows, "k string, ts_min double, value double")
    found = timeseries.pane_features(df, "value", (120.0, 240.0), keys=["k"])
    got = {(r["length"], r["window_start"]): (r["last"], r["max_gap_min"]) for r in found.collect()}
    assert got[120.0, 0.0] == (2.0, 40.0) and got[120.0, 180.0] == (3.0, 15.0) and got[240.0, 60.0] == (3.0, 130.0)
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "collect_list" not in plan and "_at" in plan
