"""The plausibility rules on a stream: one value of state for each key, the last accepted reading and its time.

A key's rows of a batch are held as columns of numbers, put in order once, and decided array-wise, CHUNK rows at a time: running
maxima give each row's state, and what a chunk ends with is what the next begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridpulse.operators.rules import Rule

OUTPUT = "key string, seq long, flagged boolean, reason string, rate double, jump double, data_anomaly boolean, state_updated boolean, note string, value double, ts_min double"


#: Rows with this column set clear a key's state before they are decided on.
RESET = "reset"
#: Rows decided, and handed on, at once.
CHUNK = 1 << 16

Held = tuple[float, float] | None


class RuleProcessor(StatefulProcessor):
    """Decides on each row of a key, in order of seq within a batch; rows: key, seq, value, ts_min, and reset if there is one."""

    def __init__(self, rule: Rule, chunk: int = CHUNK):
        self.rule, self.chunk = rule, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("v", T.DoubleType()), T.StructField("t", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        parts = [columns(f) for f in rows]  # 25 bytes a row; a source's limit on a trigger bounds them
        seq, value, t, reset = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(seq, kind="stable")
        held = self.last.get() if self.last.exists() else None
        held = None if held is None else (held[0], held[1])
        for at in range(0, len(order), self.chunk):
            some = order[at : at + self.chunk]
            out, held = decide_array(self.rule, value[some], t[some], reset[some], held)
            yield pd.DataFrame({"key": key[0], "seq": seq[some], **out, "value": value[some], "ts_min": t[some]})
        if held is not None:
            self.last.update(held)
        elif self.last.exists():
            self.last.clear()

    def close(self) -> None:
        pass


def columns(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seq, value, ts_min, reset) as numbers; a missing value is NaN."""
    reset = frame[RESET].fillna(False).to_numpy(bool) if RESET in frame else np.zeros(len(frame), bool)
    return frame["seq"].to_numpy(np.int64), frame["value"].to_numpy(np.float64, na_value=np.nan), frame["ts_min"].to_numpy(np.float64), reset


def decide_array(rule: Rule, value: np.ndarray, t: np.ndarray, reset: np.ndarray, held: Held) -> tuple[dict[str, np.ndarray], Held]:
    """The decisions on rows in their order, by name, and the state after them; held: the state before."""
    n = len(value)
    there = ~np.isnan(value)
    # before a reset nothing counts: rows are scanned from reset to reset
    starts = np.unique(np.concatenate([[0], np.flatnonzero(reset)])) if n else np.zeros(0, np.int64)
    last_v, last_t = np.full(n, np.nan), np.full(n, -np.inf)
    for a, b in zip(starts, [*starts[1:], n]):
        first = None if reset[a] else held
        own = np.where(there[a:b], t[a:b], -np.inf)
        most = np.maximum.accumulate(np.concatenate([[first[1] if first else -np.inf], own]))
        # a row that exceeds the greatest time before it is accepted, and stays the state until the next one is
        took = np.flatnonzero(own > most[:-1])
        nth = np.searchsorted(took, np.arange(b - a + 1)) - 1
        v = np.concatenate([[first[0] if first else np.nan], value[a:b][took]])[nth + 1]
        last_v[a:b], last_t[a:b] = v[:-1], most[:-1]
        held = (float(v[-1]), float(most[-1])) if most[-1] > -np.inf else None
    known = last_t > -np.inf
    dt = np.where(known, t - np.where(known, last_t, 0), np.nan)
    late = there & known & ~(dt > 0)
    gapped = there & known & (dt > rule.gap_minutes) & (rule.gap_behavior == "reset")
    steady = there & known & ~late & ~gapped
    x = rule.thresholds
    change = np.where(steady, np.abs(value - np.where(steady, last_v, 0)), np.nan)
    rate = np.where(steady, change / np.where(steady, dt, 1), np.nan) if rule.filter_type in ("rate", "combined") else np.full(n, np.nan)
    jump = change if rule.filter_type == "jump" else np.full(n, np.nan)
    bound = np.select([there & (value > x.get("upper", np.inf)), there & (value < x.get("lower", -np.inf))], ["upper", "lower"], "").astype(object)
    fast = steady & (rate > x.get("rate", np.inf))
    moved = {
        "range": lambda: bound, "rate": lambda: np.where(fast, "rate", ""), "jump": lambda: np.where(steady & (jump > x.get("jump", np.inf)), "jump", ""),
        "combined": lambda: np.where(fast & (bound != ""), "rate+" + bound, np.where(fast, "rate", bound)),
    }[rule.filter_type]()
    reason = np.where(steady, moved, np.where(there, bound, "")).astype(object)
    missing = lambda v: np.where(np.isnan(v), None, v)
    note = np.select([~there, ~known, late, gapped], ["missing", "first", "nonpositive_dt", "gap_reset"], "").astype(object)
    out = {"flagged": reason != "", "reason": reason, "rate": missing(rate), "jump": missing(jump), "data_anomaly": ~there | late, "state_updated": there & ~late, "note": note}
    return out, held


def step(rule: Rule, value: float | None, t: float, held: tuple | None) -> tuple[tuple, tuple | None]:
    """One reading: (flagged, reason, rate, jump, data_anomaly, state_updated, note) and the state after it.

    What decide_array() does to one row; for readings that come one by one.
    """
    x = rule.thresholds
    if value is None:
        return (False, "", None, None, True, False, "missing"), held
    bound = "upper" if value > x.get("upper", float("inf")) else "lower" if value < x.get("lower", float("-inf")) else ""
    if held is None:
        return (bool(bound), bound, None, None, False, True, "first"), (value, t)
    dt, change = t - held[1], abs(value - held[0])
    if dt <= 0:
        return (bool(bound), bound, None, None, True, False, "nonpositive_dt"), held
    if dt > rule.gap_minutes and rule.gap_behavior == "reset":
        return (bool(bound), bound, None, None, False, True, "gap_reset"), (value, t)
    rate = change / dt if rule.filter_type in ("rate", "combined") else None
    jump = change if rule.filter_type == "jump" else None
    fast = rate is not None and rate > x["rate"]
    parts = {
        "range": [bound], "rate": ["rate" if fast else ""], "jump": ["jump" if jump is not None and jump > x["jump"] else ""],
        "combined": ["rate" if fast else "", bound],
    }[rule.filter_type]
    reason = "+".join(filter(None, parts))
    return (bool(reason), reason, rate, jump, False, True, ""), (value, t)


def stream_rule(stream: DataFrame, rule: Rule) -> DataFrame:
    """Decisions on a streaming DataFrame of key string, seq long, value double, ts_min double, and reset boolean if keys are to be reset."""
    # this kind of state needs the RocksDB store
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy("key").transformWithStateInPandas(RuleProcessor(rule), OUTPUT, "Append", "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, last_value, last_ts_min): what a stopped or running query holds, as of its last committed batch."""
    held = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return held.select(F.col("key.key").alias("key"), F.col("value.v").alias("last_value"), F.col("value.t").alias("last_ts_min"))
