"""Helpers shared by the text and vector operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.sources.scratch import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation of the whole plan.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Characters of a plan's description, of which the driver keeps several for each query that has run.
TOLD = 1 << 14


def short_plans(spark: SparkSession) -> None:
    """Bounds the descriptions of plans, which for expressions in the thousands are megabytes; holds for the session, a lower bound stays."""
    name = "spark.sql.maxPlanStringLength"
    if int(spark.conf.get(name).rstrip("b")) > TOLD:
        spark.conf.set(name, str(TOLD))


#: What a Python worker gets at once: so many rows, and bytes (a longer row comes alone).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with batches for Python workers that are bounded by rows and by bytes: whole texts are long.

    Spark has no setting for one plan alone, so this holds for the session; a bound that is lower already stays.
    """
    conf = df.sparkSession.conf
    for name, most in BATCH.items():
        now = int(conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            conf.set(name, str(most))
    return df


def boxed(df: DataFrame, *without: str) -> tuple[Column, list[Column]]:
    """(row, columns): df's columns but those named, as one column named row, and what brings them back from it.

    What goes through Python so has no names that could meet those used there, whatever the input's columns are called.
    """
    keep = [c for c in df.columns if c not in without]
    row = F.struct(F.lit(True).alias("there"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    return row, [F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def first_by_hash(df: DataFrame, column: str, most: int, total: int) -> DataFrame:
    """The `most` rows with the least hashes of a column, of so many in all.

    Rows whose hash is beyond a bound that about twice as many stay under don't reach the one task that orders them.
    """
    share = min(1.0, (2 * most + 200) / max(1, total))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    h = F.xxhash64(column)
    return df.where(h <= F.lit(bound)).orderBy(h, column).limit(most)


Mapping = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: What a worker keeps from task to task, by name, and how it is dropped.
KEPT: dict[str, Callable[[], None]] = {}


def lean(run: Mapping, keeps: str = "") -> Mapping:
    """run, before which a worker drops what other operators' tasks kept, and after which it gives freed memory back.

    Workers stay, idle, beside those of the next plan, or go on with it.
    """

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def drop_others(keeps: str) -> None:
    for name, drop in KEPT.items():
        if name != keeps:
            drop()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)
