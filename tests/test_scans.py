"""Streams cut in segments give what one window gives, and are the work of many tasks."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import evaluate, islands, replay, rules, scans, timeseries
from gridpulse.schema import Channel, Cut

SCHEMA = "key string, seq long, value double, t double"


def stream(n=700, seed=2, keys=("a", "b", None)):
    r = random.Random(seed)
    out, t = [], 0.0
    for i in range(n):
        t += r.choice([0, 0, 5, 15, 15, 59, 60, 61, 300, -20])
        out.append((r.choice(keys), i, r.choice([None, *[float(r.randint(0, 130)) for _ in range(9)]]), r.choice([t] * 20 + [None])))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(stream(), SCHEMA).repartition(3).cache()


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def kinds():
    return {
        "most": scans.greatest_before(F.col("value")), "last": scans.last_before(F.col("value")), "upto": scans.last_upto(F.col("value")), "prev": scans.previous(F.col("value")),
        "both": scans.previous(F.struct("value", "t")), "n": scans.sum_upto(F.lit(1)), "high": scans.sum_upto(F.coalesce((F.col("value") > 60).cast("int"), F.lit(0))),
        "next": scans.next_present(F.col("value")), "later": scans.next_present(F.when(F.col("value") < 20, F.struct("seq", "t"))),
    }


@pytest.mark.parametrize("width", [1.0, 7.0, 100.0, 1e9])
@pytest.mark.parametrize("order", [["seq"], ["t", "seq"]])
def test_every_kind_of_scan(rows, width, order):
    same(scans.scan(rows, ["key"], order, kinds(), width), scans.scan(rows, ["key"], order, kinds()))
    same(scans.scan(rows, [], order, kinds(), width), scans.scan(rows, [], order, kinds()))


def test_times_are_cut_in_minutes(spark):
    df = spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 97 % 5000).cast("timestamp_ntz").alias("ts"))
    wanted = {"p": scans.previous(F.col("id")), "n": scans.sum_upto(F.lit(1))}
    same(scans.scan(df, [], ["ts", "id"], wanted, 10.0), scans.scan(df, [], ["ts", "id"], wanted))
    with pytest.raises(ValueError, match="column's name"):
        scans.scan(df, [], [F.col("id") + 1], wanted, 10.0)


def test_empty_streams(rows):
    assert scans.scan(rows.limit(0), ["key"], ["seq"], kinds(), 5.0).count() == 0


@pytest.mark.parametrize("keys", [("key",), ()])
def test_operators_on_cut_streams(rows, keys):
    short = Channel("t", "seq", keys)
    long = replace(short, cut=Cut(333.0, 41.0))
    same(rules.state(rows, "value", "t", long), rules.state(rows, "value", "t", short))
    same(islands.islands(rows, F.col("value") > 40, F.col("seq") % 5 == 0, long), islands.islands(rows, F.col("value") > 40, F.col("seq") % 5 == 0, short))
    timed = rows.where("t IS NOT NULL")
    for rule in (rules.Rule("combined", {"rate": 1.0, "upper": 80.0}), rules.Rule("jump", {"jump": 20.0}, 60.0, "continue")):
        same(rules.apply_rule(timed, rule, "value", "t", long), rules.apply_rule(timed, rule, "value", "t", short))
    samples = evaluate.index_samples(timed, keys, "t", "seq", "value")
    same(evaluate.index_samples(timed, keys, "t", "seq", "value", long.cut), samples)
    crossings = evaluate.rising_crossings(samples, keys)
    assert crossings.count() > 20
    same(evaluate.rising_crossings(samples, keys, cut=long.cut), crossings)
    zones = evaluate.event_zones(crossings, keys)
    same(evaluate.zone_index(samples, zones, keys, long.cut), evaluate.zone_index(samples, zones, keys))
    flagged = evaluate.zone_index(rules.apply_rule(samples, rules.Rule("jump", {"jump": 30.0}), "value", "ts_min", Channel("ts_min", "idx", keys)), zones, keys).withColumn("valid", F.col("value") > 9)
    same(evaluate.false_alarm_episodes(flagged, keys, cut=long.cut), evaluate.false_alarm_episodes(flagged, keys))
    same(replay.replay_episodes(flagged, keys, long.cut), replay.replay_episodes(flagged, keys))
    same(replay.sustained_alerts(flagged, (1, 2, 3), keys, cut=long.cut), replay.sustained_alerts(flagged, (1, 2, 3), keys))
    stamped = timed.withColumn("ts", F.timestamp_seconds(F.col("t") * 60).cast("timestamp_ntz")).withColumn("flag", (F.col("value") > 50).cast("double"))
    short, long = replace(short, ts="ts"), replace(long, ts="ts")
    same(timeseries.rates(stamped, "value", long, F.col("value") > 100), timeseries.rates(stamped, "value", short, F.col("value") > 100))
    same(islands.primitive_events(stamped, "flag", 60.0, long), islands.primitive_events(stamped, "flag", 60.0, short))
    same(timeseries.interval_summary(stamped, long), timeseries.interval_summary(stamped, short))
    same(timeseries.flag_transitions(stamped, "flag", long), timeseries.flag_transitions(stamped, "flag", short))
    same(islands.event_sensitivity(stamped, ("flag",), (20, 60), (0, 90), long), islands.event_sensitivity(stamped, ("flag",), (20, 60), (0, 90), short))
    same(timeseries.onset_counts(stamped, "flag", long), timeseries.onset_counts(stamped, "flag", short))


def test_one_stream_is_the_work_of_many_tasks(spark):
    n, parts = 400_000, 16
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(n).select(F.col("id").alias("seq"), (F.col("id") * 5.0).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(130))).cast("double").alias("value"))
        channel = scans.fitted(df, Channel("t", "seq"), n // 64)
        out = rules.apply_rule(df, rules.Rule("jump", {"jump": 60.0}), "value", "t", channel)
        per = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("count"), F.max("note")).collect()
        whole = rules.apply_rule(df, rules.Rule("jump", {"jump": 60.0}), "value", "t", Channel("t", "seq"))
        told = lambda x: x.agg(F.count("*"), F.count_if("flagged"), F.sum("jump"), F.sum(F.xxhash64("seq", "flagged", "reason", "jump", "note") % 1000003)).first()
        assert len(per) >= 8 and max(r["count"] for r in per) < n / 4 and told(out) == told(whole)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
