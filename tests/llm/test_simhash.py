"""SimHash components against every pair of fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from gridpulse.llm import simhash

DATA = "/root/testdata/sf0.001"


def told(text):
    """A fingerprint by its definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, at = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if at:
                words.append(at)
            at = ""
        else:
            at += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def grouped(points):
    """By place the smallest place that is reachable, over all pairs."""
    label = list(range(len(points)))
    seen = set()
    for i in range(len(points)):
        if i in seen:
            continue
        todo = [i]
        seen.add(i)
        while todo:
            x = todo.pop()
            label[x] = i
            for y in range(len(points)):
                if y not in seen and bin(points[x] ^ points[y]).count("1") <= 2:
                    seen.add(y)
                    todo.append(y)
    return label


def expected(rows):
    prints = [told(t) for _, t in rows]
    out = []
    label = grouped(prints)
    for (i, _), p, g in zip(rows, prints, label):
        ids = [j for (j, _), k in zip(rows, label) if k == g and j is not None]
        out.append((i, f"{p:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def labels_of(points):
    points = np.unique(np.array(points, np.uint64))
    a, b = simhash.near_links(points)
    return points, simhash.connected(len(points), a, b).tolist()


def test_odd_texts(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " \n", "One", "one two", "One Two THREE", "É é É é", "one\x1ctwo three four", base, base.upper(), base + " end", base.replace("w7 ", "q7 "), "x " * 500, "y\xa0z a b", "a" * 5000]
    rows = [*enumerate(texts), (3, "One"), (None, base), (None, "nobody knows this one text"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in simhash.report(df).collect()), key=str) == expected(rows)


def test_hashes_are_those_of_the_engine(spark):
    got = spark.createDataFrame([("one two three",)], "s string").selectExpr("xxhash64(s)").first()[0]
    assert list(next(simhash.hashes(b"one two three")).view(np.int64)) == [got]


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "HASHES", 7)
    assert simhash.fingerprint(text) == whole == told(text)


@pytest.mark.parametrize("seed", range(4))
def test_trees_find_every_link(seed):
    r = random.Random(seed)
    points = [r.getrandbits(64) for _ in range(400)]
    for _ in range(600):  # chains of one to three bits
        p = r.choice(points)
        for _ in range(r.randint(1, 3)):
            p ^= 1 << r.randrange(64)
        points.append(p)
    points, label = labels_of(points)
    assert label == grouped(points.tolist())
    small = simhash.near_links(points, 4)
    assert simhash.connected(len(points), *small).tolist() == label


def test_points_that_nothing_parts():
    r = random.Random(9)
    centre = r.getrandbits(64)
    points = {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)} | {centre, centre ^ 0xFF00FF00}
    points = np.unique(np.array([*points], np.uint64))
    a, b = simhash.by_neighbours(points)
    assert simhash.connected(len(points), a, b).tolist() == grouped(points.tolist()) == labels_of(points)[1]


def test_keys_in_passes(monkeypatch):
    r = random.Random(3)
    points = np.unique(np.array([r.getrandbits(9) for _ in range(300)], np.uint64) << np.uint64(20))
    monkeypatch.setattr(simhash, "KEYS", 1000)
    a, b = simhash.by_neighbours(points)
    assert simhash.connected(len(points), a, b).tolist() == grouped(points.tolist())


def test_shards_share_their_boundaries(spark):
    r = random.Random(5)
    points = [r.getrandbits(64) for _ in range(900)]
    points += [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in points[:500]]
    points = np.unique(np.array(points, np.uint64))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long").repartition(3)
    top = simhash.Top(points, 1, 64)
    assert top.shards > 4
    routed = list(top.route(points))
    assert np.array_equal(np.unique(np.concatenate([x for _, x in routed])), points)
    got = simhash.linked_points(df, 64).collect()
    at = {int(p): k for k, p in enumerate(points.view(np.int64))}
    a, b = (np.array([at[x[k]] for x in got], np.int64) for k in (0, 1))
    assert simhash.connected(len(points), a, b).tolist() == grouped(points.tolist())


def test_the_whole_table(spark):
    from gridpulse.llm.queries import op11_simhash_vptree

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op11_simhash_vptree(spark, DATA).collect()), key=str) == expected(rows)


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", 2, 3, 4, 5)], ["doc_id", "text", "point", "row", "a.b", "fingerprint"])
    r = simhash.join_components(df).first()
    assert (r["point"], r["row"], r["a.b"], r["component_id"]) == (2, 3, 4, 1) and len(r["fingerprint"]) == 16
    none = simhash.report(df.select("doc_id", "text").limit(0))
    assert none.columns == ["doc_id", "fingerprint", "component_id"] and none.count() == 0
