"""Exact quantiles, running sums and gaps where values are many, close together, or mostly one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpulse.operators import ranks, timeseries

N = 150_000
PLACES = (0.0, 0.00001, 0.01, 0.25, 0.5, 0.9, 0.99, 0.9999, 1.0)


def shapes():
    rng = np.random.default_rng(3)
    close = 300 + rng.random(N)
    return {
        "close": close, "wide": np.exp(rng.normal(0, 30, N)) * rng.choice([-1, 1], N), "one": np.where(rng.random(N) < 0.6, 7.0, rng.normal(0, 1, N)), "few": rng.integers(0, 3, N).astype(float),
        "odd": np.where(rng.random(N) < 0.02, np.inf, np.where(rng.random(N) < 0.02, -np.inf, close)), "same": np.full(N, 2.5), "short": close[:40_000], "tiny": close[:3],
    }


@pytest.mark.parametrize("shape", sorted(shapes()))
def test_quantiles_of_many_values(spark, shape):
    v = shapes()[shape]
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(5)
    got = ranks.quantiles(df, {f"q{i}": (F.col("v"), p) for i, p in enumerate(PLACES)}, also=[F.count("*").alias("n")]).first()
    assert got["n"] == len(v)
    s = np.sort(v)
    for i, p in enumerate(PLACES):
        at = (len(s) - 1) * p
        lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
        up = at - np.floor(at)
        want = lo if lo == hi else (1 - up) * lo + up * hi
        assert got[f"q{i}"] == want or abs(got[f"q{i}"] - want) <= 1e-12 * abs(want), (p, got[f"q{i}"], want)
    weighed = df.groupBy("v").agg(F.count("*").alias("n"))
    again = ranks.counted_quantiles(weighed, "v", {f"q{i}": p for i, p in enumerate(PLACES)}, weight="n").first()
    assert [again[f"q{i}"] for i in range(len(PLACES))] == [got[f"q{i}"] for i in range(len(PLACES))]


def test_quantiles_by_group_with_missing_values(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], N, p=[0.6, 0.399, 0.001]), "v": rng.normal(0, 1, N), "w": rng.integers(0, 9, N).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("g") != "c", F.col("v"))).withColumn("w", F.when(F.col("w") > 0, F.col("w")))
    got = {r["g"]: r for r in ranks.quantiles(df, {"m": (F.col("v"), 0.5), "h": (F.col("w"), 0.9)}, ["g"], [F.count("v").alias("n")]).collect()}
    for g, own in pdf.groupby("g"):
        assert got[g]["h"] == np.quantile(own["w"][own["w"] > 0], 0.9)
        assert (got[g]["m"] is None and got[g]["n"] == 0) if g == "c" else abs(got[g]["m"] - np.quantile(own["v"], 0.5)) < 1e-12
    assert ranks.quantiles(df.where("g = 'c'"), {"m": (F.col("v"), 0.5)}, ["g"]).count() == 0
    assert ranks.quantiles(df.limit(0), {"m": (F.col("v"), 0.5)}).first()["m"] is None


def test_nan_is_the_greatest(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (None,), (2.0,)], "v double")
    got = ranks.quantiles(df, {"a": (F.col("v"), 0.0), "b": (F.col("v"), 1 / 3), "c": (F.col("v"), 2 / 3), "d": (F.col("v"), 1.0)}).first()
    assert (got["a"], got["b"], got["c"]) == (1.0, 2.0, float("inf")) and np.isnan(got["d"])


def test_running_sums_over_cells(spark):
    rng = np.random.default_rng(5)
    v = np.unique(np.concatenate([300 + rng.random(5000), np.exp(rng.normal(0, 20, 500)), -rng.random(300), [0.0]]))
    pdf = pd.DataFrame({"g": "x", "v": v, "n": rng.integers(0, 5, len(v))})
    got = ranks.running(spark.createDataFrame(pdf), "v", ["n"], ["g"]).toPandas().sort_values("v")
    assert got["up_to_n"].tolist() == pdf["n"].cumsum().tolist() and set(got["all_n"]) == {pdf["n"].sum()}
    cells = ranks.celled(spark.createDataFrame(pdf), "v").groupBy("_b", "_s").count().agg(F.max("count")).first()[0]
    assert cells < 40  # 5,000 values between 300 and 301 are in about two ranges


def test_gaps_between_values_in_one_range(spark):
    v = np.concatenate([300 + np.arange(2000) / 4000, [300.9, 300.95, 1.0, -4.0, 0.0]])
    got = [(r["lower_observed_value"], r["upper_observed_value"]) for r in timeseries.value_gaps(spark.createDataFrame(pd.DataFrame({"v": np.tile(v, 2)})), "v", 0.01).collect()]
    s = np.unique(v)
    want = [(a, b) for a, b in zip(s[:-1], s[1:]) if b - a > 0.01]
    assert sorted(got) == sorted(want)


def test_panes_equal_windows_of_rows(spark):
    rng = np.random.default_rng(6)
    t = np.cumsum(rng.choice([1.0, 15.0, 15.0, 40.0, 400.0], 400))
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400), "t": t, "v": rng.normal(50, 9, 400)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("t") % 7 != 0, F.col("v")))
    lengths, step = (60.0, 90.0, 360.0), 60.0
    got = timeseries.pane_features(df, "v", lengths, step, "t", ("k",))
    for length in lengths:
        windowed = timeseries.sliding_windows(df, length, step, "t", ("k",))
        want = timeseries.horizon_features(windowed, "v", ("k", "window_start"), "t").toPandas().sort_values(["k", "window_start"]).reset_index(drop=True)
        own = got.where(F.col("length") == length).drop("length").toPandas().sort_values(["k", "window_start"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(own[want.columns], want, check_exact=False, rtol=1e-9, atol=1e-9)
        assert len(own) > 50
