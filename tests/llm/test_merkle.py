"""The Merkle manifest against a tree built in one place."""

import hashlib
import zlib

import pytest

from gridpulse.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def proofs(nodes):
    """(root, by node its siblings as (left, text))."""
    way, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for j, own in enumerate(owners[i : i + 2]):
                for k in own:
                    way[k].append([(o < j, x) for o, x in enumerate(run) if o != j])
            up.append(H("".join(run)))
            up_owners.append(sum(owners[i : i + 2], []))
        nodes, owners = up, up_owners
    return nodes[0], way


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    found, subs = [], []
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, way = proofs([leaf(r) for r in own])
        subs.append(sub)
        found.append((own, sub, way))
    root, top = proofs(subs)
    out = []
    for (own, sub, way), rest in zip(found, top):
        for r, w in zip(own, way):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                changed = (*r[:3], r[3] + 1, r[4])
            h = leaf(changed)
            for level in [*w, *rest]:
                for left, x in level:
                    h = H(x + h) if left else H(h + x)
                if not level:
                    h = H(h)
            proof = H("".join(x for level in [*w, *rest] for _, x in level))
            out.append((r[0], leaf(r), sub, root, proof, h, h == root))
    return sorted(out, key=str)


def rows_of(n, langs=("en", None, "de", "é")):
    return [(i, None if i % 5 == 0 else f"s{i % 3}", langs[i * i % len(langs)], None if i % 11 == 0 else i * 7, None if i % 13 == 0 else f"text é {i}") for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 700])
def test_tables_of_many_sizes(spark, n):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in merkle.report(df).collect()), key=str) == expected(rows)


@pytest.mark.parametrize("least", [0, 1, 3])
def test_blocks_of_any_size(spark, least):
    rows = rows_of(130, ("en", "en", "fr"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = merkle.manifest(df, least=least).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_blocks_grow_when_the_driver_may_hold_few(spark):
    rows = rows_of(300)
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(df, top=4, least=0).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    with pytest.raises(ValueError, match="langs"):
        merkle.manifest(df, top=1)


def test_null_and_repeated_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(None, "", "", 0, ""), (1, "s", "en", 2**63 - 1, "x")] + [(14, "s", "en", 5, "same")] * 4 + [(-3, "s", "en", 1, "x" * 100_000)]
    got = merkle.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows_of(9)], SCHEMA + ", leaf string, place int")
    assert sorted((tuple(r) for r in merkle.report(df).collect()), key=str) == expected(rows_of(9))
    assert merkle.report(df.limit(0)).count() == 0


def test_tampering_is_found(spark):
    got = merkle.manifest(spark.createDataFrame(rows_of(500), SCHEMA)).collect()
    for r in got:
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["doc_id"] % 11 != 0
        assert r["verified"] == (not tampered)
        assert hashlib.sha256(r["proof"].replace(",", "").encode()).hexdigest() == r["proof_sha256"]
    assert len(merkle.path([["a"]], 0)) == 0 and merkle.fold("a", []) == "a"
