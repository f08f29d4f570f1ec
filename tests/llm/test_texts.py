"""Scans, codec and packing against brute force, on awkward texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridpulse.llm import bpe_codec, licence_scan, packing, pii_scan, secret_scan
from gridpulse.llm.queries import vocabulary


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_pii(x):
    n = lambda m: len(re.sub("[^0-9]", "", m[0]))
    out = [("email", *m.span()) for m in EMAIL.finditer(x)]
    out += [("ip", *m.span()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(x) if 16 <= n(m) <= 19 and pii_scan.luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(x) if 8 <= n(m) <= 15]


def test_anchor_parsers_equal_the_grammars():
    r = random.Random(5)
    for k in range(20_000):
        x = "".join(r.choices("0123456789..@@+-- ()abZ_é\n" if k % 3 else "0123 -.+", k=r.randint(0, 60)))
        assert [s for s in pii_scan.scan(x) if s[0] in pii_scan.BASE] == base_pii(x), x


def test_anchors_add_urls_and_accounts():
    x = "see https://a.example/x?y=1. IBAN: DE44 5001 0517 5407 3249 31, account no"
    assert [(k, x[a:b]) for k, a, b in pii_scan.scan(x) if k not in pii_scan.BASE] == [("url", "https://a.example/x?y=1"), ("account", "DE44 5001 0517 5407 3249 31")]


def test_pii_of_awkward_rows(spark, docs, no_docs, awkward):
    rows = pii_scan.report(docs).collect()
    assert len(rows) == len(awkward) and all(r["n_email"] == 0 for r in rows)
    assert {r["base_sha256"] for r in rows} == {sha("")} and pii_scan.report(no_docs).count() == 0
    assert "lang" in pii_scan.find_personal_data(docs).columns


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.train(spark)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(x):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_equal_the_patterns(spark, model):
    r = random.Random(2)
    parts = ["token", "Secret", "API_KEY", "apikey", '"', "'", " ", ":", "=", "abc", "AKIA", "QWERTYUIOP12", "0123456789abcdef" * 2, "é", "\n", "\U0001f600", "x.y-z"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(1500)] + ["AKIA" + "A" * 11, "AKIA" + "A" * 12, "token = token : abcdefghij"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secret_scan.secret_report(df, model).collect():
        want = base_secrets(texts[row["doc_id"]])
        assert row["base_sha256"] == sha(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)), texts[row["doc_id"]]
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(s[1] == k for s in want) for k in range(3))


def test_markov_tells_random_from_ordinary(spark, model):
    random_, plain = "kJ8sQ2vX9mZp4LrT7wYb3NcD", "understandingInternationalization"
    df = spark.createDataFrame([(1, f"a {random_} b"), (2, f"a {plain} b"), (3, "of_the_configuration_parameter")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_report(df, model).collect()}
    assert got == {1: f"markov:2:{2 + len(random_)}", 2: "", 3: ""}


def test_redaction(spark, docs, no_docs, awkward, model):
    df = spark.createDataFrame([(1, "é token=abcdefgh1 x", 19), (2, "token=0123456789abcdef0123456789abcdef!", 39), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_scan.redact_secrets(df, model).collect()}
    assert got == {1: ("é [SECRET] x", 12), 2: ("[SECRET]!", 9), 3: (None, None)}
    same = secret_scan.redact_secrets(docs, model)
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert secret_scan.secret_report(no_docs, model).count() == 0


def test_licences(spark, docs, no_docs, awkward):
    x = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nReleased under the MIT License."
    df = spark.createDataFrame([(1, x), (2, "MIT")], "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"], r["n_licences"]) for r in licence_scan.find_licences(df).collect()}
    assert got == {1: ("<1><2><4>", "Apache-2.0,MIT", 2), 2: ("", "", 0)}
    assert licence_scan.find_licences(docs).where("n_licences = 0").count() == len(awkward) and licence_scan.find_licences(no_docs).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def test_codec_equals_the_library(spark, docs, no_docs, awkward, tokenizer):
    coded = bpe_codec.encode_decode(docs, vocabulary())
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in awkward}
    for r in coded.collect():
        assert r["ids"] == want[r["doc_id"]] and r["decoded"] == tokenizer.decode(r["ids"], skip_special_tokens=False)
    back = bpe_codec.decode(bpe_codec.encode(docs, vocabulary()), vocabulary()).collect()
    assert all(r["decoded"] == tokenizer.decode(want[r["doc_id"]], skip_special_tokens=False) for r in back)
    assert bpe_codec.encode_decode(no_docs, vocabulary()).count() == 0


def test_tree_concatenation_is_exact(tokenizer):
    codec, r = bpe_codec.Codec(vocabulary()), random.Random(3)
    for k in range(150):
        letters = r.choice(["ab", "ethran", "therandioshw'", "éaüß中a", "0123a!", "aaaaaaab"])
        text = "".join(r.choices(letters, k=r.randint(30, 300)))
        for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text)):
            assert codec.tree.encode(word, leaf=r.randint(1, 9)) == [t.id for t in tokenizer.model.tokenize(word)], word
    long = "".join(r.choices("ethran", k=9000)) + "<|endoftext|>" + "é" * 3000
    assert np.frombuffer(next(codec.ids([long])), "<i4").tolist() == tokenizer.encode(long, add_special_tokens=False).ids


def test_packing_is_gapless_and_close_to_the_bound(spark, docs, no_docs, awkward, tokenizer):
    rows = packing.pack_documents(docs, vocabulary(), 64).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in awkward}
    bins = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["start"] == 64 * r["piece"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in rows) == sum(len(ids[i]) for i, _ in awkward)
    assert packing.pack_documents(no_docs, vocabulary()).count() == 0


def test_best_two_fit_uses_every_piece_once():
    r = random.Random(1)
    for _ in range(40):
        counts = Counter(min(2048, int(r.expovariate(1 / 400)) + 1) for _ in range(r.randint(1, 3000)))
        bins = packing.best_two_fit(counts)
        used = Counter()
        for lengths, n in bins:
            assert sum(lengths) <= 2048
            for x in lengths:
                used[x] += n
        assert used == counts and sum(n for _, n in bins) <= 1.25 * sum(k * v for k, v in counts.items()) / 2048 + 2
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2, 4: 1}, 10)[0][0] != [6, 3]


def test_each_bin_is_the_best_of_its_kind():
    """Every bin against the definition: the longest that fits, again and again, then the best pair in the place of the smallest."""
    r = random.Random(7)
    for _ in range(150):
        capacity = r.randint(8, 60)
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 60))]
        left = Counter(items)
        for used, times in packing.best_two_fit(Counter(items), capacity):
            for _ in range(times):
                free, fill, gap = sorted(left.elements(), reverse=True), [], capacity
                for x in list(free):
                    if x <= gap:
                        fill.append(x)
                        free.remove(x)
                        gap -= x
                best = sum(fill)
                if gap and len(fill) > 1:
                    small = min(fill)
                    pairs = [a + b for i, a in enumerate(free) for b in free[i + 1 :] if a + b <= gap + small]
                    best = max(best, best - small + max(pairs, default=0))
                assert sum(used) == best <= capacity
                left.subtract(used)
        assert not +left


def test_sequences_are_close_to_the_lower_bound(spark, docs):
    rows = packing.pack_documents(docs, vocabulary(), 64).collect()
    assert len({x["sequence_id"] for x in rows}) <= 1.1 * -(-sum(x["length"] for x in rows) // 64) + 1


def test_spans_are_joined_as_if_never_cut(tokenizer):
    codec, r = bpe_codec.Codec(vocabulary()), random.Random(8)
    parts = ["a", "B", "é", "e\u0301", "<|endoftext|>", " ", "\n", "\x1c", "'ll", "中", "ß", "İ", "0", "...", "hello ", "\U0001f600"]
    for _ in range(1500):
        text = "".join(r.choices(parts, k=r.randint(0, 60)))
        ids = np.frombuffer(codec.encode(text, r.randint(1, 9)), "<i4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(np.array(ids, "<i4").tobytes()).decode() == tokenizer.decode(ids, skip_special_tokens=False)


def test_caches_are_bounded_by_bytes():
    codec = bpe_codec.Codec(vocabulary())
    codec.pieces.most = 20_000
    for k in range(300):
        codec.encode(" ".join(f"w{k}x{i}" for i in range(40)))
        held = len(codec.pieces.young) + len(codec.pieces.old)
    assert held * 180 < 60_000
