"""Secret scan: strict patterns, plus tokens that a character Markov model finds random.

Two first-order character models are trained, one on random strings and one on identifiers in real use. A long token
is reported when its mean log-likelihood ratio (random against ordinary, per transition) exceeds a threshold, which is
fitted on held-out samples. Every step, training included, is built from DataFrame and SQL functions, and the
scan is one narrow pass without a shuffle.

Time grows with a text's length and the number of its spans, not with their squares: places are running sums in two levels,
spans are looked up by binary search, a token is split once, and texts are put together chunk by chunk.

Defined results: null and empty texts have no spans; repeated rows are scanned each for itself; columns of the input
with the names of the output are replaced, others of any name are kept; a run of more than LONGEST characters
is scored in parts of that length, of which the last takes in a rest that is too short to be a token.
"""

from __future__ import annotations

import builtins
import keyword
import logging
import math
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass

import pyspark.sql.functions
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm.common import short_plans

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The greedy run and the length test of the last two kinds are one quantifier: a maximal run has one length.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
LEAST, LONGEST = 20, 4096
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},{LONGEST}}}(?:[A-Za-z0-9+/_=-]{{1,{LEAST - 1}}}(?![A-Za-z0-9+/_=-]))?"
#: Data that looks random and is no secret: identifiers of 128 bits, and encoded files, told by what introduces them or by how the
#: encoded signatures of file types begin. Encoded data is one token, however long.
UUID = "(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])"
SIGNATURES = ("iVBORw0KGgo", "/9j/4", "R0lGOD", "UklGR", "JVBERi0", "UEsDB", "H4sIA", "PHN2Zy", "PD94bWw", "d09GR", "T2dnUw", "SUkqA", "SUQz")
DATA = rf"(?:;base64,|(?<![A-Za-z0-9+/_=-])(?:{'|'.join(SIGNATURES)}))[A-Za-z0-9+/=]+"
#: Elements of a run of running sums, characters of a chunk of text.
RUN, CHUNK = 256, 4096
#: Ordinary held-out tokens of which one may be reported.
ONE_IN = 1000


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio of each transition, by (first, second) place in ALPHABET, the threshold of their mean, and how the
    two did on held-out samples: the share of random tokens found, and of ordinary ones reported."""

    ratios: tuple[float, ...]
    threshold: float
    recall: float
    false_share: float


def identifiers() -> list[str]:
    """Names in real use: Python's keywords, built-ins and modules, their parts, and Spark's SQL functions."""
    named = {*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names, *dir(pyspark.sql.functions), *dir(Column), *dir(DataFrame), *dir(SparkSession)}
    named |= {n for m in (str, dict, bytes, sys, re, math, logging) for n in dir(m)}
    return sorted(n for n in named if re.fullmatch("[A-Za-z][A-Za-z0-9_]{2,}", n))


def labelled_strings(spark: SparkSession, n: int = 12000) -> DataFrame:
    """The sample, (s, label): n random strings in three alphabets, and n ordinary ones: identifiers, alone and joined in five
    styles, paths with versions and dates, and serial numbers."""
    digest = lambda salt: F.sha2(F.concat_ws("/", F.lit(salt), F.col("id")), 256)
    words = F.split(F.lit(" ".join(identifiers())), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))
    some = F.slice(F.array(*[pick(k) for k in range(1, 7)]), F.lit(1), (F.pmod(F.xxhash64("id"), F.lit(4)) + 3).cast("int"))
    cap = F.transform(some, F.initcap)
    ids = spark.range(0, n, 1, 4)
    random = ids.select(
        F.when(F.col("id") % 4 < 2, F.base64(F.unhex(digest("a"))))
        .when(F.col("id") % 4 == 2, digest("b"))
        .otherwise(F.upper(F.translate(F.base64(F.unhex(digest("c"))), "+/=", "QX7")))
        .alias("s"),
        F.lit(1).alias("label"),
    )
    digits = lambda k, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**n)).cast("string"), n, "0")
    plain = ids.select(
        F.when(F.col("id") % 8 == 0, F.array_join(some, "_"))
        .when(F.col("id") % 8 == 1, F.array_join(cap, ""))
        .when(F.col("id") % 8 == 2, F.upper(F.array_join(some, "_")))
        .when(F.col("id") % 8 == 3, F.array_join(some, "-"))
        .when(F.col("id") % 8 == 4, F.array_join(some, "/"))
        .when(F.col("id") % 8 == 5, F.concat_ws("/", pick(1), F.concat(F.lit("v"), digits(11, 1)), pick(2), F.lit("2019"), digits(12, 2), F.concat_ws("-", pick(3), digits(13, 3))))
        .when(F.col("id") % 8 == 6, F.concat_ws("-", F.upper(F.substring(pick(1), 1, 3)), digits(11, 4), digits(12, 6), F.upper(F.substring(pick(2), 1, 2)), digits(13, 4)))
        .otherwise(F.array_join(some, ""))
        .alias("s"),
        F.lit(0).alias("label"),
    )
    return random.unionByName(plain)


def held_out() -> Column:
    return F.pmod(F.xxhash64("s"), F.lit(4)) == 0


def train(spark: SparkSession, samples: DataFrame | None = None) -> Markov:
    """The models from three quarters of the samples, the threshold from the rest: above all but one in ONE_IN ordinary tokens,
    and half way to the random ones where these lie apart."""
    short_plans(spark)
    samples = labelled_strings(spark) if samples is None else samples
    ratios = train_markov(samples.where(~held_out()))
    rest = samples.where(held_out() & (F.length("s") >= LEAST))
    score = let(table_of(ratios), lambda table: let(places(F.col("s")), lambda p: mean_ratio(p, table)))
    scored = rest.select("label", score.alias("x")).collect()  # of bounded size
    plain, random = (sorted(r["x"] for r in scored if r["label"] == k) for k in (0, 1))
    if not plain or not random:
        raise ValueError("both labels need held-out samples of a token's length")
    most, low = plain[-1 - len(plain) // ONE_IN], random[len(random) // 100]
    threshold = (most + low) / 2 if low > most else most
    return Markov(ratios, threshold, sum(x > threshold for x in random) / len(random), sum(x > threshold for x in plain) / len(plain))


def train_markov(samples: DataFrame, smoothing: float = 0.5) -> tuple[float, ...]:
    """Log-likelihood ratio of each transition, by (first, second) place in ALPHABET; place 0 is any other character.

    The statistics are counted by Spark; what comes back has at most 2 x 68 x 68 rows.
    """
    pairs = F.explode(let(places(F.col("s")), lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    counts = samples.where(F.length("s") > 1).select("label", pairs.alias("t")).groupBy("label", "t.a", "t.b").count().collect()
    seen = [[[smoothing] * SIZE for _ in range(SIZE)] for _ in range(2)]
    for r in counts:
        seen[r["label"]][r["a"]][r["b"]] += r["count"]
    logs = [[[math.log(x / sum(row)) for x in row] for row in side] for side in seen]
    return tuple(logs[1][i][j] - logs[0][i][j] for i in range(SIZE) for j in range(SIZE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: a lambda's variable is not put back into the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(token: Column) -> Column:
    """The characters' places in ALPHABET; the token is split once."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def table_of(ratios: tuple[float, ...]) -> Column:
    """The ratios as an array; bind it once with let(), or a plan holds it for each use."""
    return F.expr(f"cast(split('{','.join(f'{x:.5f}' for x in ratios)}', ',') AS array<double>)")


def mean_ratio(p: Column, table: Column) -> Column:
    """Mean over the transitions of log P(random) - log P(ordinary), of places and ratios that are already bound."""
    n = F.size(p) - 1
    each = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.get(table, a * SIZE + b))
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / n


def accumulated(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running results of merge over an array of whole numbers, by runs of RUN: an array only grows within a run."""
    none = F.array().cast("array<int>")
    last = lambda a: F.get(a, F.size(a) - 1)
    grow = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(merge(last(acc), x))))

    def of(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(v, k * RUN + 1, RUN), none, grow))
        join = lambda r: let(F.aggregate(F.transform(r, last), none, grow), lambda upto: F.flatten(
            F.transform(r, lambda run, k: F.when(k == 0, run).otherwise(F.transform(run, lambda x: merge(F.get(upto, k - 1), x))))
        ))
        return F.when(F.size(v) > 0, let(runs, join)).otherwise(none)

    return let(values, of)


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Matches in order as structs (start, kind, end, found): lengths between matches and of matches add up to places."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    ends = lambda found: accumulated(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.length(m)), lambda a, b: a + b)
    made = lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("found"))
    all_ = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(found, ends(found), made))
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,kind:int,end:int,found:string>>"
EDGES = "array<struct<start:int,end:int>>"


def merged(sorted_spans: Column) -> Column:
    """Spans that don't overlap, as (start, end), of spans in order of their starts; those that only touch stay two."""

    def of(s: Column) -> Column:
        far = accumulated(F.transform(s, lambda x: x["end"]), F.greatest)

        def join(m: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(m, i - 1)))
            return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(
                F.get(s, i)["start"].alias("start"), F.get(m, F.coalesce(F.get(b, k + 1), F.size(s)) - 1).alias("end")
            )))

        return F.when(F.size(s) > 0, let(far, join)).otherwise(F.array().cast(EDGES))

    return let(sorted_spans, of)


def first_place(s: Column, reached: Callable[[Column], Column]) -> Column:
    """The first place of an ordered array whose element is reached, or its size: by halving."""
    halve = lambda acc, _: let((acc["lo"] + acc["hi"]).cast("int") / 2, lambda mid: F.when(acc["lo"] >= acc["hi"], acc).otherwise(
        F.when(reached(F.get(s, F.floor(mid).cast("int"))), F.struct(acc["lo"].alias("lo"), F.floor(mid).cast("int").alias("hi")))
        .otherwise(F.struct((F.floor(mid).cast("int") + 1).alias("lo"), acc["hi"].alias("hi")))
    ))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(s) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(s).alias("hi")), halve, lambda acc: acc["lo"])


def outside(s: Column, edges: Column) -> Column:
    """The parts (start, end) of a span that merged spans leave, of two characters or more."""
    lo, hi = first_place(edges, lambda e: e["end"] > s["start"]), first_place(edges, lambda e: e["start"] >= s["end"])
    part = lambda k, b: F.struct(
        F.when(k == b["lo"], s["start"]).otherwise(F.get(edges, k - 1)["end"]).alias("start"), F.when(k == b["hi"], s["end"]).otherwise(F.get(edges, k)["start"]).alias("end")
    )
    bounds = F.struct(lo.alias("lo"), F.greatest(lo, hi).alias("hi"))
    return let(bounds, lambda b: F.filter(F.transform(F.sequence(b["lo"], b["hi"]), lambda k: part(k, b)), lambda p: p["end"] - p["start"] > 1))


def digest(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, model: Markov, text: str = "text", varied: int = 8) -> DataFrame:
    """docs with base_spans and markov_spans: sorted arrays of structs (start, kind, end, found).

    A random token has at least `varied` different characters; a short cycle, however odd, has few. Identifiers of 128 bits and
    encoded files are none. Of a Markov token that
    overlaps base spans, which already tell of what they cover, the parts outside them are scored. A part too short to be a
    token is reported if the whole token is random and the part's own mean exceeds the threshold too; a
    single character has no transition and is no part.
    """
    short_plans(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("base_spans", "markov_spans")]
    # the row is one column, so no name of its own can meet those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    body = F.col("body")
    strong = F.filter(spans(body, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 8)
    rows = rows.select("row", strong.alias("assign"), spans(body, ACCESS, 1).alias("access"), spans(body, HEX, 2).alias("hex"), spans(body, f"{DATA}|{TOKEN}", 3).alias("token"))
    rows = rows.withColumn("token", F.filter("token", lambda s: ~s["found"].rlike(f"^{DATA}")))
    rows = rows.select("row", "token", F.array_sort(F.concat("assign", "access", "hex")).alias("base"))
    rows = rows.select("row", "token", "base", F.when(F.size("token") > 0, merged(F.col("base"))).alias("edges"))

    none = F.array().cast(SPANS)

    def told(s: Column, table: Column) -> Column:
        likely = lambda p: mean_ratio(p, table) > model.threshold
        whole = lambda p: (F.size(F.array_distinct(p)) >= varied) & likely(p)

        def parts(p: Column) -> Column:
            own = lambda e: F.slice(p, e["start"] - s["start"] + 1, e["end"] - e["start"])
            good = lambda e: let(own(e), lambda q: F.when(F.size(q) >= LEAST, whole(q)).otherwise(likely(q) & whole(p)))
            named = lambda e: F.struct(
                e["start"].alias("start"), F.lit(3).alias("kind"), e["end"].alias("end"), F.substring(s["found"], e["start"] - s["start"] + 1, e["end"] - e["start"]).alias("found")
            )
            cut = lambda left: F.when(
                (F.size(left) == 1) & (F.get(left, F.lit(0))["end"] - F.get(left, F.lit(0))["start"] == F.length(s["found"])), F.when(whole(p), F.array(s)).otherwise(none)
            ).otherwise(F.transform(F.filter(left, good), named))
            return F.when(F.size("edges") == 0, F.when(whole(p), F.array(s)).otherwise(none)).otherwise(let(outside(s, F.col("edges")), cut))

        # a token with identifiers in it is scored by the rest
        rest = F.regexp_replace(s["found"], UUID, "")
        ordinary = s["found"].rlike(UUID) & ~let(places(rest), lambda p: (F.size(p) >= LEAST) & whole(p))
        return F.when(ordinary, none).otherwise(let(places(s["found"]), parts))

    each = let(table_of(model.ratios), lambda table: F.flatten(F.transform("token", lambda s: told(s, table))))
    markov = F.when(F.size("token") > 0, each).otherwise(none)
    rows = rows.select("row", F.struct(F.col("base").alias("base_spans"), markov.alias("markov_spans")).alias("out"))
    return rows.select("row.*", "out.*")


def secret_report(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans as text."""
    found = find_secrets(docs.select("doc_id", "text"), model or train(docs.sparkSession))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(digest(F.col("base_spans")), 256).alias("base_sha256"),
        digest(F.array_sort(F.concat("base_spans", "markov_spans"))).alias("spans"),
        F.size("markov_spans").cast("long").alias("n_markov"),
    )


def redact_secrets(docs: DataFrame, model: Markov | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by mark (overlapping spans by one) and n_chars, where it is, counted anew.

    Null texts stay null; rows without a span are passed on unchanged.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = find_secrets(row, model or train(docs.sparkSession))
    found = found.select("row", "text", F.array_sort(F.concat("base_spans", "markov_spans")).alias("all"))
    found = found.select("row", "text", F.when(F.size("all") > 0, merged(F.col("all"))).alias("edges"))
    clean = F.when(F.col("edges").isNotNull(), without(F.col("text"), F.col("edges"), mark)).otherwise(F.col("text"))
    out = found.select("row", clean.alias("clean"), F.col("edges").isNotNull().alias("changed"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("changed"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def without(text: Column, edges: Column, mark: str) -> Column:
    """text with mark for each of the merged spans, chunk by chunk, so that no place is counted from the text's beginning."""

    def cleaned(chunk: Column, k: Column) -> Column:
        begin = k * CHUNK
        end = begin + F.length(chunk)
        lo, hi = first_place(edges, lambda e: e["end"] > begin), first_place(edges, lambda e: e["start"] >= end)

        def piece(i: Column, b: Column) -> Column:
            a = F.when(i == b["lo"], begin).otherwise(F.get(edges, i - 1)["end"])
            z = F.when(i == b["hi"], end).otherwise(F.greatest(F.get(edges, i)["start"], begin))
            plain = F.substring(chunk, a - begin + 1, F.greatest(z - a, F.lit(0)))
            return F.when((i < b["hi"]) & (F.get(edges, i)["start"] >= begin), F.concat(plain, F.lit(mark))).otherwise(plain)

        bounds = F.struct(lo.alias("lo"), F.greatest(lo, hi).alias("hi"))
        return let(bounds, lambda b: F.array_join(F.transform(F.sequence(b["lo"], b["hi"]), lambda i: piece(i, b)), ""))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.array_join(F.transform(chunks, cleaned), "")
