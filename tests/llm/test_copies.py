"""Near copies, repeats, components, neighbours and quality against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridpulse.llm import fm_index, hilbert_ann, ngram_join, quality_mil, segment_topk, substring_dedup
from gridpulse.llm.components import components
from gridpulse.llm.fm_index import FMIndex, code_lengths, codes
from gridpulse.llm.queries import vocabulary


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [4, 512])
def test_join_equals_all_pairs(spark, docs, awkward, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(8)
    texts = dict(awkward)
    for family in range(4):
        base = [f"f{family}w{r.randint(0, 60)}" for _ in range(r.randint(8, 90))]
        for k in range(18):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = f"new{r.randint(0, 9)}"
            texts[100 * (family + 1) + k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join_components(df).collect()}
    assert got == brute_components(texts)


def test_join_of_awkward_rows(docs, no_docs, awkward):
    rows = ngram_join.join_components(docs).collect()
    assert len(rows) == len(awkward) and all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] < 3)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 5, 8, 9, 12}
    assert ngram_join.join_components(no_docs).count() == 0


@pytest.mark.parametrize("lots", [False, True])
def test_search_connects_what_is_linked_in_few_asks(lots, monkeypatch):
    r = np.random.default_rng(11)
    asked = []
    skip = ngram_join.divide_skip
    monkeypatch.setattr(ngram_join, "divide_skip", lambda lists, t: asked.append(t) or skip(lists, t))
    for near in (0, 4, 12):
        base = r.integers(0, 1 << 60, 100).astype(np.uint64)
        sets = []
        for k in range(300):
            own = base.copy()
            gone = r.choice(100, r.integers(0, 2 * near + 1), replace=False)
            own[gone] = r.integers(0, 1 << 60, len(gone))
            sets.append(np.unique(own))
        link = np.array([[ngram_join.linked(len(np.intersect1d(a, b)), len(a), len(b)) for b in sets] for a in sets[:40]])
        ids, asked[:] = np.arange(300), []
        if lots:  # as in the second search: the first group's sets don't ask, in this task nor in another
            main = ids % 3 == 0
            grp = np.where(main, 0, ids)
            found = [x for some in (ids % 3 == 1, ids % 3 == 2) for x in ngram_join.search(ids, sets, some, grp, main)] + [(0, int(i)) for i in ids[main]]
        else:
            found = ngram_join.search(ids, sets, np.ones(300, bool), ids)
            assert len(asked) < 150
        root = ids.copy()
        for _ in range(300):
            for a, b in found:
                root[a] = root[b] = min(root[a], root[b])
        assert all(root[i] == root[j] for i, j in zip(*np.nonzero(link)))


def test_long_lists_hold_no_set_whose_rest_is_too_little():
    # twenty sets of 100 share a shingle, for ten of which what follows it is under the 89 that two of this size must share
    key, cls, n = np.zeros(20, np.uint64), np.arange(20), np.full(20, 100)
    found, centre = ngram_join.stars(key, cls, n, np.repeat([11, 12], 10))
    assert sorted(found.tolist()) == list(range(10)) and set(centre.tolist()) == {0}
    # a smaller set needs less
    found, _ = ngram_join.stars(key, cls, np.where(cls == 0, 97, 100), np.where(cls == 0, 5, np.repeat([11, 12], 10)))
    assert sorted(found.tolist()) == list(range(20))


def test_join_of_large_families_whose_changes_some_share(spark):
    # the first shingle that two have in common is in a short list, what they share beyond in long ones
    r, texts = random.Random(5), {}
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(60)]
        for k in range(40):
            own = list(base)
            start = r.randrange(0, 50)
            own[start : start + r.randint(0, 3)] = [f"new{r.randint(0, 3)}" for _ in range(2)]
            if k % 8 == 0:
                own[-6 - k // 8 :] = [f"end{family}x{k // 16}"] * 3
            texts[100 * family + k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join_components(df).collect()}
    assert got == brute_components(texts)


def test_divide_skip_reaches_the_overlap():
    r = random.Random(4)
    for _ in range(200):
        lists = [np.array(sorted(r.sample(range(20), r.randint(1, 20)))) for _ in range(r.randint(1, 12))]
        t = r.randint(1, len(lists))
        got = {m for m, count, long in ngram_join.divide_skip(lists, t) if count + sum(m in lists[k] for k in long) >= t}
        assert got == {m for m in range(20) if sum(m in x for x in lists) >= t}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_index_finds_repeated_windows():
    r = np.random.default_rng(1)
    for _ in range(60):
        segments = [r.integers(0, r.integers(2, 7), r.integers(3, 60)).astype(np.uint64) for _ in range(r.integers(1, 30))]
        heavy = r.random(len(segments)) < 0.2
        size = int(r.integers(2, 9))
        counts = Counter()
        for s, several in zip(segments, heavy):
            for i in range(len(s) - size + 1):
                counts[tuple(s[i : i + size])] += 2 if several else 1
        asked = [*segments, r.integers(0, 9, 20).astype(np.uint64)]
        for s, m in zip(asked, FMIndex(segments, heavy).repeated(asked, size)):
            assert [counts[tuple(s[i : i + size])] > 1 for i in range(max(0, len(s) - size + 1))] == m.tolist()


def test_index_looks_a_single_suffix_up_once(monkeypatch):
    # both ends of an interval were looked up at every level, however narrow
    r = np.random.default_rng(6)
    segments = [r.integers(0, 1 << 60, 80).astype(np.uint64) for _ in range(200)]
    index, asked = FMIndex(segments, np.ones(200, bool)), []
    around = fm_index.Bits.around
    monkeypatch.setattr(fm_index.Bits, "around", lambda self, at: asked.append(len(at)) or around(self, at))
    assert all(m.all() for m in index.repeated(segments, 35))
    assert sum(asked) < 1.1 * 200 * 80 * index.wavelet.length.max()


def test_codes_are_free_of_prefixes_and_short_for_frequent_words():
    r = np.random.default_rng(2)
    for _ in range(30):
        counts = r.zipf(1.4, r.integers(1, 200))
        length = code_lengths(counts)
        code = codes(length)
        texts = [format(c, f"0{n}b") for c, n in zip(code.tolist(), length.tolist())]
        assert not any(a != b and b.startswith(a) for a in texts for b in texts) and len(set(texts)) == len(texts)
        share = counts / counts.sum()
        assert (share * length).sum() <= -(share * np.log2(share)).sum() + 1 + 1e-9


@pytest.mark.parametrize("hot", [1, 1 << 14])
def test_dedup_equals_counting_windows(spark, docs, no_docs, awkward, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    r = random.Random(6)
    rows = list(awkward)
    passage = [f"p{i}" for i in range(60)]
    for k in range(30):
        w = [f"u{k}x{r.randint(0, 500)}" for _ in range(r.randint(20, 120))]
        at = r.randrange(len(w))
        rows.append((100 + k, " ".join(w[:at] + passage[r.randint(0, 30) : r.randint(31, 60)] + w[at:])))
    rows.append((200, "again " * 90))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = [(i, (t or "").encode().split()) for i, t in rows]
    n = substring_dedup.SIZE
    counts = Counter(tuple(w[k : k + n]) for _, w in words for k in range(len(w) - n + 1))
    want = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if counts[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        want.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    got = [(x["doc_id"], x["kept_text"], x["n_words"], x["n_removed"]) for x in substring_dedup.drop_repeats(df).collect()]
    assert sorted(got) == sorted(want)
    assert substring_dedup.drop_repeats(no_docs).count() == 0
    clean = substring_dedup.without_repeats(docs)
    assert clean.columns == docs.columns and clean.where("doc_id = 0").first()["text"] is None


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 16))
    x[5] = x[7] = x[50] = x[100] = x[300]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows[20] = (20, None)
    rows[21] = (21, [1.0, None, *[0.0] * 14])
    rows[22] = (22, [float("nan"), *[0.0] * 15])
    rows[23] = (23, [0.0] * 16)
    rows[24] = (24, [1.0, 2.0])
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), rows


def test_top_k_is_exact(spark, vectors):
    df, rows = vectors
    q = {i: np.floor(1024 * np.array(v, float)).astype(np.int64) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    want = set()
    for i in (i for i in q if i % 100 == 0):
        found = sorted((-int(q[i] @ v), j) for j, v in q.items() if j != i and len(v) == len(q[i]))[:10]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(found)}
    assert {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in segment_topk.top_k(df).collect()} == want
    assert segment_topk.top_k(df.limit(0)).count() == 0


def test_neighbours_recall_and_ties(spark, vectors):
    df, rows = vectors
    u = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    got = {}
    for r in hilbert_ann.neighbours(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for i in (i for i in u if i % 50 == 0):
        cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
        want = sorted((-cos(u[i], v), j) for j, v in u.items() if j != i and len(v) == len(u[i]))[:5]
        hits += len({j for _, j in want} & {v for v, _ in got[i].values()})
        total += 5
        assert all(abs(s - cos(u[i], u[j])) < 1e-12 for j, s in got[i].values()) and sorted(got[i]) == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * total
    assert [got[300][k][0] for k in (1, 2, 3, 4)] == [5, 7, 50, 100]  # equal vectors by id
    assert hilbert_ann.neighbours(df.limit(0)).count() == 0


def test_quality_learns_from_the_learning_rows(spark, docs, no_docs, awkward):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        w = ["".join(r.choices("abcdefghijklmnopqrst", k=r.randint(2, 9))) for _ in range(r.randint(3, 200))]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_mil.report(df, lab).join(lab, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.97 * got.count()
    odd = quality_mil.report(docs, lab).collect()
    assert len(odd) == len(awkward) and all(0 <= x["score"] <= 1 for x in odd)
    assert {x["score"] for x in quality_mil.report(docs, lab.limit(0)).collect()} == {0.5}
    assert quality_mil.report(no_docs, lab).count() == 0 and quality_mil.keep_good(docs, lab).columns == docs.columns


def test_gradient_is_the_slope():
    r = np.random.default_rng(2)
    x = r.standard_normal((9, quality_mil.FEATURES)).astype(np.float32)
    starts, sizes = np.array([0, 4]), np.array([4, 5])
    label, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])
    m = quality_mil.AttentionMIL(np.zeros(x.shape[1], np.float32), np.ones(x.shape[1], np.float32))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}

    def loss():
        y = m.forward(x, starts, sizes)["y"]
        return float(-(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).mean())

    g = m.gradient(x, starts, sizes, label, weight)
    for k in m.p:
        flat = m.p[k].reshape(-1)
        old, flat[0] = flat[0], flat[0] + 1e-5
        up = loss()
        flat[0] = old - 1e-5
        slope = (up - loss()) / 2e-5
        flat[0] = old
        assert abs(slope - g[k].reshape(-1)[0]) < 1e-4


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    base = [" ".join(word() for _ in range(80)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[3], "en", "s", 1), (101, base[4].replace(base[4].split()[0], "changed", 1), "en", "s", 1), (102, base[5] + " password=abcdefgh12", "en", "s", 1)]
    rows += [(200 + i, t.upper().replace(" ", "!! "), "en", "s", 1) for i, t in enumerate(base)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 200)) for i, *_ in rows] + [(300, 1), (301, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    shared = [word() for _ in range(40)]
    extra = [(i, " ".join([word() for _ in range(30)] + shared + [word() for _ in range(30)]), "en", "s", 1) for i in (300, 301)]
    spark.createDataFrame(extra, docs.schema).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes, kept = [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        sizes.append({x["doc_id"] for x in docs.collect()})
        kept.append({x["doc_id"]: x["text"] for x in docs.collect()} if k < 4 else docs)
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean = {*range(40), 300, 301}
    assert sizes[0] == {i for i, q in labels if q} and sizes[1] == clean == sizes[2] == sizes[3] == sizes[4]
    # what the stages did to the texts that they kept: near copies none, repeats are cut out, secrets are marked
    assert kept[1] == {i: t for i, t, *_ in rows + extra if i in clean}
    assert kept[2] == {**kept[1], **{i: " ".join(t.split()[:30] + t.split()[-30:]) for i, t, *_ in extra}}
    assert kept[3] == kept[2] | {i: t.replace("password=abcdefgh12", "[SECRET]") for i, t in kept[2].items()}
    ids = Tokenizer.from_file(vocabulary())
    for x in kept[4].collect():
        own = [*ids.encode(kept[3][x["doc_id"]], add_special_tokens=False).ids, 0][x["start"] : x["start"] + x["length"]]
        assert x["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == x["length"]
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == sizes[4]


def test_pipeline_of_awkward_rows(spark, tmp_path):
    text = " ".join(f"wort{i} und" for i in range(60))
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, "token=abcdefgh12 " * 3 + text.replace("wort", "andere")), (5, "x" * 30_000), (None, None)]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [(x["doc_id"], x["piece"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # nothing to learn from: every document stays; of the copies the one with an id does
    assert {i for i, _ in got} == {1, 2, 3, 4, 5, None} and got.count((3, 0)) == 1
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
