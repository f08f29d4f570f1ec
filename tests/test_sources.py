import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from gridpulse.sources import telemetry


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "o.csv").write_bytes(b"DeviceTimeStamp,OTI,WTI\r\n2019-06-25T13:06,25,0\r\n2019-06-25T13:21,x,1\r\n2019-06-25T13:36,,0\r\n")
    return tmp_path / "raw"


def test_table_keeps_line_numbers_and_text(spark, raw):
    rows = telemetry.read_table(spark, str(raw / "o.csv"), ("OTI", "WTI")).orderBy("_raw_line").collect()
    assert [(r["DeviceTimeStamp"], r["OTI"], r["WTI"], r["_raw_line"]) for r in rows] == [("2019-06-25T13:06", 25.0, 0.0, 2), ("2019-06-25T13:21", None, 1.0, 3), ("2019-06-25T13:36", None, 0.0, 4)]
    plain = telemetry.read_table(spark, str(raw / "o.csv"), ("OTI", "WTI"), numbered=False)
    assert plain.count() == 3 and "_raw_line" not in plain.columns


def test_strict_times_raise(spark, raw):
    (raw / "bad.csv").write_text("DeviceTimeStamp,OTI\n2019-06-25,1\n")
    with pytest.raises(Exception, match="not a timestamp"):
        telemetry.read_table(spark, str(raw / "bad.csv"), ("OTI",)).collect()


def test_manifest_finds_changes(spark, raw, tmp_path):
    m = telemetry.build_manifest(spark, str(raw), dataset="x")
    telemetry.save_manifest(m, str(tmp_path / "m.json"))
    m = telemetry.load_manifest(str(tmp_path / "m.json"))
    assert {r["status"] for r in telemetry.verify_files(spark, m, str(raw)).collect()} == {"OK"}
    (raw / "o.csv").write_text("changed")
    with pytest.raises(RuntimeError), telemetry.gate(spark, m, str(raw)):
        pass
    m["files"].append({"filename": "gone.csv", "size_bytes": 1, "sha256": "0"})
    assert {r["filename"]: r["status"] for r in telemetry.verify_files(spark, m, str(raw)).collect()} == {"o.csv": "MISMATCH", "gone.csv": "MISSING"}


def test_sequence_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1.5 0 1\nnan 15 1\n3 30 0\n")
    assert [tuple(r) for r in telemetry.read_sequence(spark, str(tmp_path / "s.txt")).orderBy("idx").collect()] == [(0, 1.5, 0.0), (1, None, 15.0), (2, None, 30.0)]


def test_large_files_are_hashed_in_pieces(spark, raw, monkeypatch):
    (raw / "big.csv").write_bytes(bytes(range(256)) * 9000)
    want = {r["path"]: tuple(r)[1:] for r in telemetry.hash_files(spark, str(raw)).collect()}
    assert {p.split("/")[-1]: v[1] for p, v in want.items()}["big.csv"] == hashlib.sha256((raw / "big.csv").read_bytes()).hexdigest()
    assert {r["path"]: tuple(r)[1:] for r in telemetry.hash_files(spark, str(raw), 1000).collect()} == want


def test_sequences_come_back(spark, tmp_path):
    rows = [(0, 1.5, 0.0), (1, None, 15.25), (2, 3.0, 30.0)]
    df = spark.createDataFrame(rows, "idx long, value double, ts_min double").repartition(3)
    telemetry.write_sequence(df, str(tmp_path / "out"))
    assert [tuple(r) for r in telemetry.read_sequence(spark, str(tmp_path / "out")).orderBy("idx").collect()] == rows


def test_lines_are_looked_up(spark, raw):
    lines = telemetry.text_lines(spark, str(raw / "o.csv"))
    wanted = lines.where("_raw_line IN (1, 3)").select("path", "_raw_line")
    assert [r["line"] for r in telemetry.lookup_lines(lines, wanted.unionByName(wanted)).orderBy("_raw_line").collect()] == ["DeviceTimeStamp,OTI,WTI", "2019-06-25T13:21,x,1"]


def test_now_is_utc(spark):
    now = datetime.datetime.strptime(spark.range(1).select(telemetry.utc_now().alias("t")).first()["t"], "%Y-%m-%dT%H:%M:%SZ")
    assert abs((datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None) - now).total_seconds()) < 60


def test_reports(spark, tmp_path):
    for kind in ("csv", "json", "parquet"):
        telemetry.write_report(spark.range(3), str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_lines_are_numbered_across_splits(spark, tmp_path):
    import random

    r = random.Random(4)
    ends = {"a.txt": "\n", "b.txt": "\r\n"}
    texts = {}
    for name, end in ends.items():
        lines = ["x" * r.choice([0, 1, 5, 80, 2000]) + str(k) * r.choice([0, 1]) for k in range(3000)]
        texts[name] = lines
        (tmp_path / name).write_bytes((end.join(lines) + (end if name == "a.txt" else "")).encode())
    (tmp_path / "c.txt").write_bytes(b"")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10000")
    try:
        got = telemetry.text_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        for name, lines in texts.items():
            rows = got.where(F.col("path").endswith(name)).orderBy("_raw_line").collect()
            own = lines if name == "a.txt" or lines[-1] else lines[:-1]
            assert [(x["_raw_line"], x["line"]) for x in rows] == list(enumerate(own, 1))
        assert got.where(F.col("path").endswith("c.txt")).count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_manifests_tell_equal_names_apart(spark, tmp_path):
    for folder, text in (("k=1", "one"), ("k=2", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.txt").write_text(text)
    manifest = telemetry.build_manifest(spark, f"{tmp_path}/*")
    assert [f["filename"] for f in manifest["files"]] == ["k=1/part.txt", "k=2/part.txt"]
    (tmp_path / "k=2" / "part.txt").write_text("2")
    assert {r["filename"]: r["status"] for r in telemetry.verify_files(spark, manifest, f"{tmp_path}/*").collect()} == {"k=1/part.txt": "OK", "k=2/part.txt": "MISMATCH"}
