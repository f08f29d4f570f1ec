"""Conditional physics of a rise, and the price of the rules on a small processor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions import exprs

#: Operations a sample of each rule, and cycles of an operation on a core without a floating-point unit.
OPERATIONS = {
    "F1_rate": {"sub": 2, "cmp": 5, "mul": 1, "div": 0, "str": 2},
    "F2_range": {"sub": 0, "cmp": 1, "mul": 0, "div": 0, "str": 0},
    "F3_combined": {"sub": 2, "cmp": 6, "mul": 1, "div": 0, "str": 2},
    "F4_jump": {"sub": 2, "cmp": 5, "mul": 0, "div": 0, "str": 2},
    "B1_threshold": {"sub": 0, "cmp": 1, "mul": 0, "div": 0, "str": 0},
}
CYCLES = {
    "fixed": {"sub": 1, "cmp": 1, "mul": 1, "div": 0, "str": 2},
    "float": {"sub": 50, "cmp": 20, "mul": 50, "div": 140, "str": 2},
}
#: Cycles of a sample's four loads and three branches, and of one read.
LOADS, BRANCHES, MEMORY = 4 * 2, 3 * 3, 2


def total_operations(rule: str) -> int:
    return sum(OPERATIONS[rule].values())


def estimated_cycles(rule: str, arithmetic: str = "fixed") -> int:
    """Cycles of one sample: its operations, four loads and three branches."""
    if arithmetic not in CYCLES:
        raise ValueError(f"unknown arithmetic {arithmetic!r}")
    return sum(n * CYCLES[arithmetic][op] for op, n in OPERATIONS[rule].items()) + LOADS + BRANCHES


@dataclass(frozen=True)
class Price:
    """What one sample costs: operations, cycles on whole numbers and on emulated floats (None: has none), and bytes that are stored."""

    operations: int
    fixed: int
    emulated: int | None
    stored: int


def priced(work: Sequence[tuple[int, int, int | None]], operations: int, stored: int) -> Price:
    """Of work as (how often, cycles on whole numbers, cycles on emulated floats)."""
    floats = [n * f for n, _, f in work if f is not None]
    return Price(operations, sum(n * c for n, c, _ in work), sum(floats) if len(floats) == len(work) else None, stored)


def dense_price(widths: Sequence[int]) -> Price:
    """A dense network of four-byte weights: a product, a sum and two reads for each weight, a sum for each bias."""
    weights, biases = sum(map(mul, widths, widths[1:])), sum(widths[1:])
    f = CYCLES["float"]
    return priced([(weights, 2 + 2 * MEMORY, f["mul"] + f["sub"] + 2 * MEMORY), (biases, 1, f["sub"])], weights + biases, 4 * (weights + biases))


def trees_price(trees: int, depth: int, node_bytes: int) -> Price:
    """Full trees of a depth that is assumed: one compare with two reads for each level."""
    return priced([(trees * depth, 1 + 2 * MEMORY, None)], trees * depth, trees * (2 * 2**depth - 1) * node_bytes)


#: Bytes of state of each rule, as floats and as whole numbers.
STATE_BYTES = {"F1_rate": (12, 8), "F2_range": (4, 2), "F3_combined": (16, 10), "F4_jump": (12, 8), "B1_threshold": (2, 2)}


def cost_table(spark: SparkSession) -> DataFrame:
    rows = [(r, "rule", total_operations(r), *STATE_BYTES[r], STATE_BYTES[r][1], estimated_cycles(r), estimated_cycles(r, "float")) for r in OPERATIONS]
    for name, p in (("MLP_28_16_8_1", dense_price((28, 16, 8, 1))), ("GBDT_100_trees", trees_price(100, 6, 12))):
        rows.append((name, "model", p.operations, None, None, p.stored, p.fixed, p.emulated))
    kinds = ("total_ops_per_sample", "state_bytes_float32", "state_bytes_fixedpoint", "model_storage_bytes", "est_cycles_m0_fixedpoint", "est_cycles_m0_softfloat")
    return spark.createDataFrame(rows, "approach string, class string, " + ", ".join(f"{k} long" for k in kinds))


def workload(readings: DataFrame, value: str, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """What each approach costs on a table's readings, by group: operations and cycles of all present ones, bytes of state of all streams."""
    present = readings.where(F.col(value).isNotNull()).groupBy(*by, *keys).agg(F.count("*").alias("n"))
    groups = present.groupBy(*by).agg(F.sum("n").alias("n_readings"), F.count("*").alias("n_streams"))
    each = groups.crossJoin(F.broadcast(cost_table(readings.sparkSession)))  # as many rows as approaches
    per = lambda c, n: (F.col(c) * F.col(n)).alias(c.replace("_per_sample", "").replace("est_", "total_"))
    return each.select(
        *by, "approach", "n_readings", "n_streams", per("total_ops_per_sample", "n_readings"), per("est_cycles_m0_fixedpoint", "n_readings"),
        per("est_cycles_m0_softfloat", "n_readings"), per("state_bytes_fixedpoint", "n_streams"), "model_storage_bytes",
    )


def grid(df: DataFrame, **axes: Sequence[float]) -> DataFrame:
    """df once for each combination of the axes' values: a bounded explode of each row."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def tau_sensitivity(pairs: DataFrame, t0: str, t1: str, ambient: str, dt: str, offsets: Sequence[float], multipliers: Sequence[float]) -> DataFrame:
    """The apparent time constant of each pair for shifted ambients and stretched intervals."""
    g = grid(pairs, ta_offset_units=offsets, dt_multiplier=multipliers)
    ta, step = F.col(ambient) + F.col("ta_offset_units"), F.col(dt) * F.col("dt_multiplier")
    return g.select(
        *pairs.columns, "ta_offset_units", ta.alias("ta_used"), step.alias("dt_used_minutes"),
        exprs.time_constant_minutes(F.col(t0), F.col(t1), ta, step).alias("tau_minutes"), exprs.time_constant_status(F.col(t0), F.col(t1), ta).alias("domain_status"),
    )


def mass_sensitivity(rises: DataFrame, powers: Sequence[float], heats: Sequence[float]) -> DataFrame:
    """Energy and critical mass of each rise (dt_minutes, rise) under each power and heat capacity."""
    g = grid(rises, power_kw=powers, c_kj_per_kg_k=heats)
    g = g.withColumn("energy_kj", exprs.energy_kj(F.col("power_kw"), F.col("dt_minutes")))
    return g.withColumn("critical_mass_kg", exprs.critical_mass_kg(F.col("energy_kj"), F.col("c_kj_per_kg_k"), F.col("rise")))


def power_curves(rises: DataFrame, masses: Sequence[float], power: float, heat: float) -> DataFrame:
    g = grid(rises, mass_kg=masses)
    return g.withColumn("required_power_kw", exprs.required_power_kw(F.col("mass_kg"), F.lit(heat), F.col("rise"), F.col("dt_minutes"))).withColumn(
        "achievable_rise", exprs.achievable_rise(F.lit(power), F.col("mass_kg"), F.lit(heat), F.col("dt_minutes"))
    )


def scenarios(rises: DataFrame, powers: Sequence[Column], heats: dict[str, float]) -> DataFrame:
    """Energy and critical mass of each rise (dt_minutes, rise) for every power scenario, structs (label, kw), and heat capacity."""
    g = rises.withColumn("_p", F.explode(F.array(*powers)))
    g = g.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.lit(float(c)).alias("c")) for name, c in heats.items()])))
    energy = exprs.energy_kj(F.col("_p.kw"), F.col("dt_minutes"))
    return g.select(
        *rises.columns, F.col("_p.label").alias("power_scenario_kw"), F.col("_p.kw").alias("power_kw"), energy.alias("energy_kj"),
        F.col("_c.label").alias("c_oil_scenario"), F.col("_c.c").alias("c_kj_per_kg_k"), exprs.critical_mass_kg(energy, F.col("_c.c"), F.col("rise")).alias("critical_mass_kg"),
    )


def power(label: str, kw: Column) -> Column:
    """A power scenario."""
    return F.struct(F.lit(label).alias("label"), kw.cast("double").alias("kw"))


def transitions(rises: DataFrame, falls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rises (by, rise_timestamp, dt_minutes, dT_units, local_max_kw_30min) and falls (by, fall_timestamp, T0, T1, Ta_used_ATI, dt_minutes) in one table."""
    up = rises.withColumn("direction", F.lit("rising"))
    down = falls.withColumnRenamed("fall_timestamp", "rise_timestamp").withColumn("direction", F.lit("falling"))
    columns = [*by, "rise_timestamp", "dt_minutes", "dT_units", "local_max_kw_30min", "direction", "T0", "T1", "Ta_used_ATI"]
    return up.unionByName(down, allowMissingColumns=True).select(*columns)
