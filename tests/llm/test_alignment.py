"""The alignment of two tokenizers against a walk over every byte, and its counts against a walk over all documents."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridpulse.llm import token_alignment
from gridpulse.llm.queries import op13_token_alignment

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def letters():
    """The byte-level alphabet as it is published: printable characters for themselves, others in order from 256 on."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def walked(tokenizers, text):
    """(a ids, b ids, groups, links) of a text, byte by byte; None without tokens."""
    a, b = tokenizers
    if not text:
        return None
    own, raw = letters(), (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(own[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    of_a = [k for k, x in enumerate(bytes_a) for _ in x]
    of_b = [k for k, x in enumerate(bytes_b) for _ in x]
    links = sorted({(i, j) for i, j in zip(of_a, of_b)})
    groups, start_a, start_b = [], 0, 0
    for k in range(len(raw)):
        if k + 1 == len(raw) or (of_a[k + 1] != of_a[k] and of_b[k + 1] != of_b[k]):
            groups.append((ids_a[start_a : of_a[k] + 1], ids_b[start_b : of_b[k] + 1]))
            start_a, start_b = of_a[k] + 1, of_b[k] + 1
    return ids_a, ids_b, groups, [(ids_a[i], ids_b[j]) for i, j in links]


def expected(tokenizers, rows):
    all_ = [walked(tokenizers, t) for _, t in rows]
    count = Counter(p for w in all_ if w for p in set(w[3]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (i, _), w in zip(rows, all_):
        if w is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in w[2])
        best = sum(count[p] == most[p[0]] for p in w[3])
        out.append((i, len(w[0]), len(w[1]), len(w[2]), len(w[3]), best, sum(count[p] for p in w[3]), hashlib.sha256(text.encode()).hexdigest(), sum(len(a) * len(b) for a, b in w[2])))
    return sorted(out, key=str)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\tb\nc", "x ▁y", "▁", "a ▁ b", "It's the dog's 12,345.67!", "<|endoftext|> <s> </s> <unk> <0x41>", "éÉß ﬁ 全角　空白  nbsp  ls \x85 \x1c fs",
    "👍🏽 fam 👨‍👩‍👧 é", "\x00 null \x07", "ab" * 3000 + " end", "word " * 2000, "the the the", "the the the", "trailing newline\n\n", "mixed \t tabs  and   runs    of     spaces", "don't 'tis we'll I'M", "٣٤٥ ½ ⅷ", "zwj‍ zwsp​ b",
]


def test_odd_texts(spark, tokenizers):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(5, "a"), (5, "a"), (None, "the dog")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in token_alignment.report(df, *PATHS).collect()), key=str)
    assert got == expected(tokenizers, rows)


def test_pieces_are_tokenised_as_whole_texts_are(tokenizers):
    both = token_alignment.sides(*PATHS)
    assert both.cuts
    done = token_alignment.Block(both, ODD)
    for k, t in enumerate(ODD):
        w = walked(tokenizers, t)
        assert done.counts[k].tolist() == ([len(w[0]), len(w[1]), len(w[2]), len(w[3]), sum(len(a) * len(b) for a, b in w[2])] if w else [0] * 5)
        own = done.text == k
        links = Counter(dict(zip(done.pairs[done.number[own]].tolist(), done.times[own].tolist())))
        assert links == Counter(a << 32 | b for a, b in (w[3] if w else []))


def test_the_whole_table(spark, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op13_token_alignment(spark, DATA).collect()), key=str)
    assert got == expected(tokenizers, rows)


def test_blocks_of_any_size_give_the_same(spark, tokenizers, monkeypatch):
    rows = [(k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    both = token_alignment.sides(*PATHS)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 10)
    monkeypatch.setattr(token_alignment, "JOINED", 3)
    one = token_alignment.Block(both, ODD)
    assert [None if g is None else hashlib.sha256(g.encode()).hexdigest() for g in one.groups] == [r[7] or None for r in sorted(expected(tokenizers, rows), key=lambda r: r[0])]
    assert df.count() == len(rows)


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "the dog", 7, 8, 9)], ["doc_id", "text", "block", "a.b", "n_links"])
    r = token_alignment.align(df, *PATHS).first()
    assert (r["block"], r["a.b"], r["n_links"], r["n_a"]) == (7, 8, 2, 2)
    none = token_alignment.report(df.select("doc_id", "text").limit(0), *PATHS)
    assert none.count() == 0 and "groups_sha256" in none.columns


def test_groups_with_their_products(spark, tokenizers):
    texts = ["It's antidisestablishmentarianism", None, "x ▁y", "naïve façade"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_alignment.aligned_groups(df, *PATHS).collect():
        w = walked(tokenizers, texts[r["doc_id"]])
        assert [(g["a"], g["b"]) for g in r["groups"]] == ([(list(a), list(b)) for a, b in w[2]] if w else [])
        raw = (" " + (texts[r["doc_id"]] or "")).encode()
        at = 0
        for g in r["groups"]:
            assert g["start"] == at and [(p["a"], p["b"]) for p in g["products"]] == [(a, b) for a in g["a"] for b in g["b"]]
            at = g["end"]
        assert not r["groups"] or at == len(raw)


def test_intervals():
    ends, a, b, closes = token_alignment.intervals(np.array([2, 5, 9]), np.array([3, 5, 6, 9]))
    assert (ends.tolist(), a.tolist(), b.tolist(), closes.tolist()) == ([2, 3, 5, 6, 9], [0, 1, 1, 2, 2], [0, 0, 1, 2, 3], [False, False, True, False, True])
