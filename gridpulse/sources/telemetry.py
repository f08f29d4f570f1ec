"""Readers, sinks and provenance of telemetry files."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpulse.functions import exprs
from gridpulse.schema import PARSED_TS, RAW_LINE, RAW_TS


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, _raw_line, line) of text files, byte for byte and numbered from 1, by file; a line's end is LF or CR LF.

    A file is read in as many splits as it has. Each split's lines are counted first; running sums of the counts tell the
    number of a split's first line, and a row's number in its task the rest. Both reads cut the files alike.
    """
    line = F.regexp_replace("value", "\r$", "")
    at = F.monotonically_increasing_id()  # consecutive within a split
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), at.alias("_at"), line.alias("line")
    )
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each split
    splits = splits.select("path", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(splits, ["path", "_split"]).select("path", (F.col("_at") + F.col("_shift")).cast("long").alias(RAW_LINE), "line")


def read_table(spark: SparkSession, path: str, sensors: Sequence[str], numbered: bool = True, strict: bool = True) -> DataFrame:
    """A telemetry CSV: text as it stands, strictly parsed times, sensors as numbers (missing if they aren't).

    numbered: with exact line numbers, by file, for which the files are read twice; else without line numbers.
    """
    schema = ", ".join(f"`{c}` string" for c in (RAW_TS, *sensors))
    if numbered:
        rows = text_lines(spark, path).where(f"{RAW_LINE} > 1").select(RAW_LINE, F.from_csv("line", schema).alias("r")).select("r.*", RAW_LINE)
    else:
        rows = spark.read.schema(schema).option("header", True).csv(path)
    parsed = exprs.parse_timestamp(RAW_TS, strict).alias(PARSED_TS)
    number = lambda c: F.nanvl(F.trim(F.col(c)).try_cast("double"), F.lit(None).cast("double")).alias(c)
    return rows.select(RAW_TS, *[number(c) for c in sensors], parsed, *([RAW_LINE] if numbered else []))


def lookup_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    return lines.join(wanted.select("path", RAW_LINE).distinct(), ["path", RAW_LINE])


#: Bytes of the largest file that Spark reads as one value; a larger one is hashed piece by piece.
WHOLE, PIECE = 1 << 30, 1 << 22


def hash_files(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, size_bytes, sha256) of files of any size, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path).withColumnRenamed("length", "size_bytes")
    small = files.where(F.col("size_bytes") <= whole).select("path", "size_bytes", F.sha2("content", 256).alias("sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for uri in b.column(0).to_pylist():
                store, name = pa_fs.FileSystem.from_uri(uri)
                h = hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while piece := f.read(PIECE):
                        h.update(piece)
                found.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=["path", "size_bytes", "sha256"])

    large = files.where(F.col("size_bytes") > whole).select("path", "size_bytes")
    return small.unionByName(large.mapInArrow(hashed, "path string, size_bytes long, sha256 string"))


def file_name(path: str) -> Column:
    """What names a file below a folder or pattern: its path from there on, so that files of several folders are told apart."""
    folder = urlparse(re.sub(r"[^/]*[*?\[{].*$", "", path)).path.rstrip("/") + "/"
    at = F.locate(folder, F.col("path"))
    return F.when(at > 0, F.substring("path", at + len(folder), F.lit(1 << 16))).otherwise(F.element_at(F.split("path", "/"), -1))


def build_manifest(spark: SparkSession, path: str, **facts: str) -> dict:
    files = hash_files(spark, path).select(file_name(path).alias("filename"), "size_bytes", "sha256").orderBy("filename").collect()
    return {**facts, "files": [r.asDict() for r in files]}


def save_manifest(manifest: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2, ensure_ascii=False)


def load_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def verify_files(spark: SparkSession, manifest: dict, path: str) -> DataFrame:
    """Each file of the manifest: OK, MISMATCH or MISSING."""
    listed = spark.createDataFrame([(f["filename"], f["size_bytes"], f["sha256"]) for f in manifest["files"]], "filename string, size long, hash string")
    there = hash_files(spark, path).select(file_name(path).alias("filename"), "size_bytes", "sha256")
    both = listed.join(there, "filename", "left")
    size_ok, hash_ok = F.coalesce(F.col("size") == F.col("size_bytes"), F.lit(False)), F.coalesce(F.col("hash") == F.col("sha256"), F.lit(False))
    status = F.when(F.col("sha256").isNull(), "MISSING").when(size_ok & hash_ok, "OK").otherwise("MISMATCH")
    return both.select("filename", size_ok.alias("size_ok"), hash_ok.alias("sha256_ok"), status.alias("status"))


@contextmanager
def gate(spark: SparkSession, manifest: dict, path: str) -> Iterator[None]:
    """Work that must find its files as listed, and leave them so."""

    def check() -> None:
        bad = [r["filename"] for r in verify_files(spark, manifest, path).where("status <> 'OK'").collect()]
        if bad:
            raise RuntimeError(f"files differ from the manifest: {', '.join(bad)}")

    check()
    yield
    check()


def write_report(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A report of bounded size as one file of the kind parquet, csv or json."""
    writer = df.coalesce(1).write.mode("overwrite")
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", True).csv(p), "json": writer.json}[kind](path)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Lines "value minutes valid" as (idx, value, ts_min); a reading that isn't valid is missing."""
    parts = F.split("line", r"\s+")
    rows = text_lines(spark, path).select((F.col(RAW_LINE) - 1).alias("idx"), *[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("v", "t", "ok"))])
    return rows.select("idx", F.when(F.col("ok") == "1", F.nanvl(F.col("v").try_cast("double"), F.lit(None).cast("double"))).alias("value"), F.col("t").cast("double").alias("ts_min"))


def write_sequence(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """(idx, value, ts_min) as lines "value minutes valid" in the order of idx, as read_sequence() takes them.

    Each of keys makes a folder of its own; the rows of one sequence are one file, as the lines' order tells their places.
    """
    line = F.concat_ws(" ", F.coalesce(F.col("value").cast("string"), F.lit("nan")), F.col("ts_min").cast("string"), F.col("value").isNotNull().cast("int").cast("string"))
    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    out = dealt.sortWithinPartitions(*keys, "idx").select(*keys, line.alias("line")).write.mode("overwrite")
    (out.partitionBy(*keys) if keys else out).text(path)


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def column_types(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame(df.dtypes, "column string, dtype string")


def column_profile(df: DataFrame) -> DataFrame:
    """Each column's type, how many rows have a value, and how many bytes the longest takes as text; one pass."""
    told = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count(c).alias("n_present"), F.max(F.octet_length(F.col(c).cast("string"))).cast("long").alias("longest_bytes")) for c, t in df.dtypes]
    return df.agg(F.array(*told).alias("x")).select(F.explode("x").alias("x")).select("x.*")
