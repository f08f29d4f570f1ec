"""The rules as window expressions against a sequential reading of the contract, and as a stream."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from gridpulse.operators import rules
from gridpulse.schema import Channel
from gridpulse.streaming.rules import columns, decide_array, state_of, step, stream_rule

CONFIGS = [
    rules.Rule(kind, x, 60.0, b)
    for kind, x in (("rate", {"rate": 1.0}), ("range", {"upper": 80.0, "lower": 5.0}), ("combined", {"rate": 1.0, "upper": 80.0}), ("jump", {"jump": 20.0}))
    for b in ("reset", "continue")
]


def _rows(n=400, seed=4):
    r = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += r.choice([0, 0, 5, 15, 15, 15, 59, 60, 61, 300, -20])
        out.append((r.choice("ab"), i, r.choice([None, *[float(r.randint(0, 100)) for _ in range(9)]]), t))
    return out


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a)))


def _sequential(rule, rows):
    held, out = {}, {}
    for key, seq, value, t in rows:
        out[seq], held[key] = step(rule, value, t, held.get(key))
    return out


@pytest.mark.parametrize("rule", CONFIGS, ids=lambda r: f"{r.filter_type}-{r.gap_behavior}")
def test_windows_equal_the_sequential_reading(spark, rule):
    rows = _rows()
    df = spark.createDataFrame(rows, "key string, seq long, value double, ts_min double")
    got = rules.apply_rule(df, rule, "value", "ts_min", Channel("ts_min", "seq", ("key",)))
    want = _sequential(rule, rows)
    for r in got.collect():
        d = tuple(r[c] for c in ("flagged", "reason", "rate", "jump", "data_anomaly", "state_updated", "note"))
        assert all(map(_same, d, want[r["seq"]])), (r, want[r["seq"]])


def test_stream_equals_the_sequential_reading(spark, tmp_path):
    rows = _rows(120)
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * (k + 1)], "key string, seq long, value double, ts_min double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rule = CONFIGS[4]
    source = spark.readStream.schema("key string, seq long, value double, ts_min double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_rule(source, rule).writeStream.format("memory").queryName("decisions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    want = _sequential(rule, rows)
    got = spark.table("decisions").collect()
    assert len(got) == 120
    for r in got:
        d = tuple(r[c] for c in ("flagged", "reason", "rate", "jump", "data_anomaly", "state_updated", "note"))
        assert all(_same(a, b) for a, b in zip(d[:2] + d[4:], want[r["seq"]][:2] + want[r["seq"]][4:])), (r, want[r["seq"]])


def test_sweep_decides_as_single_rules_do(spark):
    df = spark.createDataFrame(_rows(), "key string, seq long, value double, ts_min double")
    ch = Channel("ts_min", "seq", ("key",))
    configs = [rules.Config("", c.filter_type, c.gap_behavior, c.gap_minutes, **c.thresholds) for c in CONFIGS]
    got = {r["seq"]: (r["on"], r["data_anomaly"]) for r in rules.sweep(df, configs, "value", "ts_min", ch).collect()}
    for k, c in enumerate(CONFIGS):
        for r in rules.apply_rule(df, c, "value", "ts_min", ch).collect():
            assert (got[r["seq"]][0][k], got[r["seq"]][1]) == (r["flagged"], r["data_anomaly"])


#: Readings at, just over and just under thresholds; times that stand, go back, and leave gaps of exactly an hour and more.
EDGES = [(80.0, 0.0), (80.0, 15.0), (80.0 + 1e-9, 30.0), (5.0, 45.0), (5.0 - 1e-9, 60.0), (None, 61.0), (65.0, 120.0), (45.0, 120.0), (90.0, 100.0), (85.0, 180.0), (20.0, 241.0), (81.0, 302.5), (82.0, 303.5), (83.0 + 1e-9, 304.5), (63.0, 304.5), (103.0, 305.0), (None, 306.0), (None, 400.0), (80.0, 400.0), (60.0, 460.0), (80.0, 520.0), (100.0, 580.0 + 1e-9), (0.0, 580.1), (20.0, 600.1), (40.0 + 1e-9, 620.1)]


@pytest.mark.parametrize("rule", CONFIGS, ids=lambda r: f"{r.filter_type}-{r.gap_behavior}")
def test_boundaries(spark, rule):
    rows = [("a", i, v, t) for i, (v, t) in enumerate(EDGES)]
    assert len(rows) == 25
    want = _sequential(rule, rows)
    got = rules.apply_rule(spark.createDataFrame(rows, "key string, seq long, value double, ts_min double"), rule, "value", "ts_min", Channel("ts_min", "seq", ("key",)))
    for r in got.collect():
        assert all(map(_same, [r[c] for c in ("flagged", "reason", "rate", "jump", "data_anomaly", "state_updated", "note")], want[r["seq"]])), r["seq"]
    flagged = {k for k, d in want.items() if d[0]}
    if rule.filter_type == "range":
        assert {2, 4} <= flagged and not {0, 1, 3} & flagged  # bounds are compared strictly


def test_stream_is_reset_and_inspected(spark, tmp_path):
    schema = "key string, seq long, value double, ts_min double, reset boolean"
    rows = [("a", 0, 10.0, 0.0, False), ("a", 1, 90.0, 15.0, False), ("a", 2, 10.0, 30.0, True), ("b", 3, 1.0, 5.0, False), ("b", 4, None, 9.0, True)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_rule(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), rules.Rule("jump", {"jump": 20.0})).writeStream.format("memory").queryName("reset_rows").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert {r["seq"]: (r["flagged"], r["note"]) for r in spark.table("reset_rows").collect()} == {0: (False, "first"), 1: (True, ""), 2: (False, "first"), 3: (False, "first"), 4: (False, "missing")}
    assert [tuple(r) for r in state_of(spark, str(tmp_path / "cp")).collect()] == [("a", 10.0, 30.0)]


@pytest.mark.parametrize("rule", CONFIGS, ids=lambda r: f"{r.filter_type}-{r.gap_behavior}")
@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_arrays_decide_as_single_readings_do(rule, chunk):
    r = random.Random(8)
    rows = [(v, t, r.random() < 0.03) for _, _, v, t in _rows(500, 3)] + [(v, t, False) for v, t in EDGES]
    held, state = None, None
    for at in range(0, len(rows), chunk):
        some = pd.DataFrame([(k, *x) for k, x in enumerate(rows[at : at + chunk])], columns=["seq", "value", "ts_min", "reset"])
        _, value, t, reset = columns(some)
        out, held = decide_array(rule, value, t, reset, held)
        for k, (v, ts, clear) in enumerate(rows[at : at + chunk]):
            want, state = step(rule, v, ts, None if clear else state)
            assert all(map(_same, [out[c][k] for c in ("flagged", "reason", "rate", "jump", "data_anomaly", "state_updated", "note")], want)), (at + k, rows[at + k])
        assert held == state


def test_a_key_of_a_million_rows_in_one_batch():
    n = 1_000_000
    rng = np.random.default_rng(1)
    value, t = rng.integers(0, 130, n).astype(float), np.cumsum(rng.integers(0, 9, n)).astype(float)
    rule = rules.Rule("jump", {"jump": 60.0})
    start = time.time()
    whole, end = decide_array(rule, value, t, np.zeros(n, bool), None)
    assert time.time() - start < 20
    held, parts = None, []
    for at in range(0, n, 1 << 16):
        cut = slice(at, at + (1 << 16))
        out, held = decide_array(rule, value[cut], t[cut], np.zeros(len(value[cut]), bool), held)
        parts.append(out["flagged"])
    assert held == end and np.array_equal(np.concatenate(parts), whole["flagged"]) and whole["flagged"].sum() > 100_000
