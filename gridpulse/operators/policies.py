"""Record policies: which rows of a repeated timestamp make up a view of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.schema import META, RAW_TS, Channel, sensor_columns

POLICIES = ("P1_preserve", "P2_first", "P3_last", "P4_identical")
_NAMES = {"preserve": "P1_preserve", "first": "P2_first", "last": "P3_last", "identical": "P4_identical"}


def apply_policy(df: DataFrame, policy: str, channel: Channel = Channel(), sensors: Sequence[str] | None = None) -> DataFrame:
    """P1 all rows; P2, P3 the first or last row of each time by raw order; P4 one row of each distinct reading of a time.

    Equal missing values count as equal. The rows are dealt by key and time, so no global order is needed.
    """
    policy = _NAMES.get(policy, policy)
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {', '.join(POLICIES)}")
    if policy == "P1_preserve":
        return df
    by = channel.instant()
    order = F.col(channel.order).desc() if policy == "P3_last" else F.col(channel.order).asc()
    if policy == "P4_identical":
        named = sensors if sensors is not None else [c for c in sensor_columns(df, (*META, channel.order)) if c not in by]
        by = [*by, *named]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def canonicalize(df: DataFrame, policy: str = "first", channel: Channel = Channel(), sensors: Sequence[str] | None = None) -> DataFrame:
    """apply_policy, and the policy mean, which averages the sensors of a time (of no use for flags)."""
    if policy != "mean":
        return apply_policy(df, policy, channel, sensors)
    named = list(sensors) if sensors is not None else [c for c in sensor_columns(df) if c not in channel.instant()]
    text = [F.min_by(RAW_TS, channel.order).alias(RAW_TS)] if RAW_TS in df.columns else []
    return df.groupBy(*channel.instant()).agg(*[F.avg(c).alias(c) for c in named], *text, F.min(channel.order).alias(channel.order))


def policy_views(df: DataFrame, channel: Channel = Channel(), policies: Sequence[str] = POLICIES, sensors: Sequence[str] | None = None) -> DataFrame:
    """The views of several policies in one table, told apart by the column policy."""
    views = [apply_policy(df, p, channel, sensors).withColumn("policy", F.lit(p)) for p in policies]
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out


def occurrence_report(df: DataFrame, channel: Channel = Channel()) -> DataFrame:
    """Whether the n-th record of each time could be a stream of its own: only if nearly all times repeat."""
    per = df.groupBy(*channel.instant()).agg(F.count("*").alias("n"))
    share = F.avg((F.col("n") > 1).cast("double"))
    return per.agg(
        F.count("*").alias("n_timestamps"),
        F.bround(share, 4).alias("share_of_timestamps_with_repeats"),
        F.max("n").alias("max_records_per_timestamp"),
        (share > 0.9).alias("verdict_supports_stable_occurrence_streams"),
    )


def occurrence_stream(df: DataFrame, channel: Channel = Channel(), nth: int | None = None) -> DataFrame:
    """df with occurrence, the place of each record among those of its time from 1; only the n-th records if nth is given.

    A provisional reading of repeats: occurrence_report() tells whether it holds.
    """
    rank = F.row_number().over(Window.partitionBy(*channel.instant()).orderBy(channel.order))
    out = df.withColumn("occurrence", rank.cast("long"))
    return out if nth is None else out.where(F.col("occurrence") == nth)
