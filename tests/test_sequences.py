"""Sequences as a data source: read at rest, replayed as a stream through the rules, written once whatever restarts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import parity, rules
from gridpulse.schema import Channel
from gridpulse.sources import sequences
from gridpulse.sources.sequences import SequenceSource, SequenceStreamWriter, Written
from gridpulse.streaming.rules import step, stream_rule

RULE = rules.Rule("jump", {"jump": 20.0})


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(SequenceSource)


def readings(n, seed):
    r = random.Random(seed)
    t, out = 0.0, []
    for _ in range(n):
        t += r.choice([0.0, 5.0, 15.0, 61.0])
        out.append((r.choice([None, *[float(r.randint(0, 90)) for _ in range(6)]]), t))
    return out


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(f"{'nan' if v is None else v} {t} {int(v is not None)}\n" for v, t in rows))


def test_files_at_rest(spark, tmp_path):
    a, b = readings(40, 1), readings(30, 2)
    put(tmp_path / "key=x%2Fy", "000.txt", a)
    put(tmp_path, "b.txt", b)
    (tmp_path / "_done").mkdir()
    (tmp_path / "_done" / "0").write_text("none of it")
    got = spark.read.format("sequence").load(str(tmp_path)).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("x/y", k, v, t) for k, (v, t) in enumerate(a)] + [("b", (1 << 32) + k, v, t) for k, (v, t) in enumerate(b)]
    assert spark.read.format("sequence").load(f"file://{tmp_path}").count() == 70
    assert spark.read.format("sequence").load(str(tmp_path / "nothing")).count() == 0


def test_lines_of_all_kinds(tmp_path, monkeypatch):
    monkeypatch.setattr(sequences, "LINES", 2)
    (tmp_path / "a.txt").write_bytes(b"1 2 1\nx 3 1\n\n-1.5e3 4 0\r\n.5 5 1")
    rows = [tuple(r.values()) for b in sequences.lines_of(sequences.Part(str(tmp_path), "a.txt", 0)) for r in b.to_pylist()]
    assert rows == [("a", 0, 1.0, 2.0), ("a", 1, None, 3.0), ("a", 2, None, None), ("a", 3, None, 4.0), ("a", 4, 0.5, 5.0)]


def sequential(rows):
    held, out = None, []
    for v, t in rows:
        d, held = step(RULE, v, t, held)
        out.append(d[0])
    return out


def replay(spark, folder, out, checkpoint):
    stream = spark.readStream.format("sequence").load(str(folder))
    kept = stream_rule(stream, RULE).where("NOT flagged").select("key", "seq", "value", "ts_min")
    q = kept.writeStream.format("sequence").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None


def test_replay_goes_on_from_its_checkpoint(spark, tmp_path):
    own = {"a": [readings(60, 3), readings(50, 4)], "b": [readings(40, 5)]}
    folder, out = tmp_path / "in", tmp_path / "out"
    put(folder / "key=a", "000-a.txt", own["a"][0])
    put(folder / "key=b", "000-b.txt", own["b"][0])
    replay(spark, folder, out, tmp_path / "cp")
    first = spark.read.format("sequence").load(str(out)).count()
    last = own["a"][0][-1][1]
    own["a"][1] = [(v, t + last) for v, t in own["a"][1]]
    put(folder / "key=a", "001-a.txt", own["a"][1])
    replay(spark, folder, out, tmp_path / "cp")
    replay(spark, folder, out, tmp_path / "cp")  # nothing new
    got = spark.read.format("sequence").load(str(out))
    assert got.count() > first > 0
    for key, parts in own.items():
        rows = [x for p in parts for x in p]
        want = [x for x, flagged in zip(rows, sequential(rows)) if not flagged]
        assert [(r["value"], r["ts_min"]) for r in got.where(F.col("key") == key).orderBy("seq").collect()] == want


def test_a_batch_is_written_once(tmp_path):
    w = SequenceStreamWriter(str(tmp_path))
    rows = [{"key": "k", "seq": s, "value": v, "ts_min": float(s)} for s, v in ((2, None), (1, 1.5), (3, math.nan))]
    lost = w.write(iter(rows))  # its task's executor is lost, and nobody tells of it
    w.commit([None, w.write(iter(rows))], 4)
    text = (tmp_path / "key=k" / "000000000004-000000.txt").read_text()
    assert text == "1.5 1.0 1\nnan 2.0 0\nnan 3.0 0\n"
    w.commit([w.write(iter(rows))], 4)
    assert len(sequences.listed(str(tmp_path))) == 1
    (tmp_path / "_done" / "000000000004").unlink()  # the mark was not yet there
    w.commit([w.write(iter(rows[:1]))], 4)
    assert (tmp_path / "key=k" / "000000000004-000000.txt").read_text() == "nan 2.0 0\n"
    w.abort([w.write(iter(rows)), None, Written([])], 5)
    assert len(sequences.listed(str(tmp_path))) == 1 and len(lost.files) == 1


def test_parity_of_tables(spark):
    schema = "k string, n long, x double, s string"
    a = [("a", 1, 1.0, "p"), ("a", 2, None, "q"), (None, 3, float("nan"), None), ("b", 1, 1e12, "r"), ("c", 1, 5.0, "t"), ("c", 1, 5.0, "t")]
    b = [("a", 1, 1.0 + 1e-12, "p"), ("a", 2, 2.0, "q"), (None, 3, float("nan"), "z"), ("b", 1, 1e12 * (1 + 1e-6), "r"), ("d", 9, 1.0, "u")]
    got = {r["column"]: r for r in parity.compare(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k", "n"]).collect()}
    told = {c: tuple(r)[1:5] for c, r in got.items()}
    assert told == {"(rows)": (6, 2, 1, 1), "x": (4, 2, 1, 0), "s": (4, 1, 1, 0)}
    assert got["x"]["first_difference"] == '{"k":"a","n":2}' and got["s"]["first_difference"] == '{"n":3}' and got["(rows)"]["first_difference"] == '{"k":"c","n":1}'
    same = parity.compare(spark.createDataFrame(b, schema), spark.createDataFrame(b, schema), ["k", "n"]).collect()
    assert all(r["n_different"] == 0 and r["first_difference"] is None for r in same)
    loose = parity.compare(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k", "n"], ["x"], 1e-3).collect()
    assert [r["n_different"] for r in loose] == [2, 1]


def test_batch_and_stream_decide_alike(spark, tmp_path):
    put(tmp_path / "key=a", "0.txt", readings(200, 6))
    put(tmp_path / "key=b", "1.txt", readings(150, 7))
    rows = spark.read.format("sequence").load(str(tmp_path))
    q = stream_rule(spark.readStream.format("sequence").load(str(tmp_path)), RULE).writeStream.format("memory").queryName("alike").option("checkpointLocation", str(tmp_path / "_cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    batch = rules.apply_rule(rows, RULE, "value", "ts_min", Channel("ts_min", "seq", ("key",)))
    columns = ["flagged", "reason", "rate", "jump", "data_anomaly", "state_updated", "note"]
    got = parity.compare(batch, spark.table("alike"), ["key", "seq"], columns).collect()
    assert len(got) == 8 and all((r["n_compared"], r["n_different"]) == (350, 0) for r in got)
