"""Documents without ids, and different texts under one id."""

import random

from gridpulse.llm import ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, n_chars long"


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def test_null_and_shared_ids_keep_what_is_no_copy(spark):
    near = text(1) + " end"
    rows = [
        (None, text(0)), (None, None), (None, ""), (None, text(1)), (5, near), (None, near + " x"),  # a copy's id is not null if any isn't
        (7, text(2)), (7, text(3)), (3, text(3) + " y"), (None, text(4)), (None, text(4) + " z"), (8, text(5)), (9, text(6)), (8, text(6)),
    ]
    got = {(r["doc_id"], r["text"]) for r in ngram_join.keep_one(frame(spark, rows)).collect()}
    groups = [{rows[k] for k in g} for g in ((3, 4, 5), (7, 8), (9, 10), (12, 13))]
    want = set(rows) - set.union(*groups) | {(5, near), (3, text(3) + " y"), (8, text(6))}
    assert got - groups[2] == want and len(got & groups[2]) == 1


def test_links_of_null_and_shared_ids(spark):
    rows = [(7, text(2)), (7, text(3)), (9, text(3) + " y"), (4, text(2) + " y"), (None, text(8)), (20, text(8) + " y"), (None, text(9))]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.join_components(frame(spark, rows)).collect())
    assert got == [(0, 0), (0, 20), (4, 4), (7, 4), (7, 7), (9, 7), (20, 20)]


def test_repeats_of_null_ids_are_cut(spark):
    again = text(11, 60)
    rows = [(None, f"{text(12)} {again}"), (1, f"{again} {text(13)}"), (None, f"{text(14)} {again} end"), (None, None)]
    got = {r["text"]: r["n_chars"] for r in substring_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got == {t: t and len(t) for t in (text(12), text(13), text(14) + " end", None)}
