"""Alignment of two tokenizers' tokens over the same bytes, by elementary intervals.

The ends of both sides' tokens, united and sorted (union1d), cut the bytes into elementary intervals. An interval lies in one
token of each side, which searchsorted finds by the interval's end, so each interval is one overlap, a link. An end
that both sides have closes a group.

A text is cut before single spaces between two characters that are no white space. Neither tokenizer has a token across such
a place, so both end there, and the piece behind it has the same tokens wherever it occurs: a block of texts aligns each of
its different pieces once, all in one array, and a text's result is put together from its pieces'.

1. A block (BLOCK bytes of texts, or one longer text) becomes one row of a written table: per text its counts and groups, and
   for the block its different id pairs, in how many texts each is linked, and which texts have which.
2. Counts of texts are summed by pair, from one row for each block and pair; the highest of each A id is a table as small as the
   vocabulary, which is broadcast.
3. Counts return to the blocks that have the pair, and each text sums over its links.

Defined results: null and empty texts, and texts of which either side's tokens do not join to the bytes of a space and the text
(as where one has U+2581), have no tokens: zeros and an empty digest; repeated rows count as documents of their own; other
columns of the input are passed on.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm.common import bounded_batches, durable, give_back, lean

#: Characters of the texts of a block; bytes of the different pieces that are tokenised at once, and pieces in one text of these.
BLOCK, AT_ONCE, JOINED = 4 << 20, 1 << 19, 256
#: Behind a token; behind a group's last token of A, and of B.
SIGNS = ",|;"
#: Where both tokenizers end a token; U+2581 stands for a space on one side.
CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
EMPTY = np.zeros(0, np.int64)


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of the byte-level alphabet: printable ones stand for themselves, the others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already take all cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)

    @cached_property
    def bytes_a(self) -> list[bytes]:
        letters, found = byte_alphabet(), {i: s for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        return [bytes(letters[c] for c in found.get(i, "") if c in letters) for i in range(max(found) + 1)]

    @cached_property
    def bytes_b(self) -> list[bytes]:
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        return [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]

    @cached_property
    def sizes_a(self) -> np.ndarray:
        return np.array(list(map(len, self.bytes_a)), np.int64)

    @cached_property
    def sizes_b(self) -> np.ndarray:
        return np.array(list(map(len, self.bytes_b)), np.int64)

    @cached_property
    def cuts(self) -> bool:
        """Whether no token of B goes on behind a space within it, as CUT needs."""
        return not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))

    def pieces(self, text: str) -> list[str]:
        """The text's pieces, each without the space before it."""
        return CUT.split(text) if self.cuts else [text]

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides for the bytes of a space and each text; nothing where a side's don't join to these bytes."""
        found = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for t, e, b in zip(texts, found, self.b.encode(texts, num_threads=1)):
            raw, a = b" " + t.encode(), e.ids
            same = b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
            yield (a, b) if same else ([], [])

    @cached_property
    def names(self) -> list[str]:
        """Each id before each sign, sign by sign."""
        return [f"{i}{sign}" for sign in SIGNS for i in range(self.n_ids)]

    @property
    def n_ids(self) -> int:
        return max(len(self.bytes_a), len(self.bytes_b))


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, a, b, closes): each elementary interval's end, its token on either side, and whether both end with it."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64)


class Aligned:
    """Alignments of different pieces: ok, whether both sides have a piece's bytes; counts of its tokens of A and B, groups, links
    and products of groups; its groups as text; and its links, as ranges of the arrays a and b that starts tells."""

    def __init__(self, both: Sides, pieces: list[str]):
        self.both, n = both, len(pieces)
        self.ok, self.counts, self.groups = np.zeros(n, bool), np.zeros((n, 5), np.int64), [""] * n
        self.sizes = np.array([1 + len(p.encode()) for p in pieces], np.int64)
        alone, plain = [], []
        for k, p in enumerate(pieces):
            (alone if "▁" in p or p[:1].isspace() or p[-1:].isspace() else plain).append(k)
        # pieces between which the text may be cut are tokenised together
        todo = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)] + [[k] for k in alone]
        left: list[np.ndarray] = []
        while todo:
            now, size = [], 0
            while todo and size < AT_ONCE:
                now.append(todo.pop())
                size += int(self.sizes[now[-1]].sum())
            found = list(both.tokens([" ".join([pieces[k] for k in ks]) for ks in now]))
            todo += [[k] for ks, (a, _) in zip(now, found) if not a and len(ks) > 1 for k in ks]
            good = [i for i, (a, _) in enumerate(found) if a]
            if good:
                at = flat([now[i] for i in good])
                left.append(self._put(at, flat([found[i][0] for i in good]), flat([found[i][1] for i in good])))
        links = np.concatenate(left) if left else np.zeros((0, 3), np.int64)
        links = links[np.argsort(links[:, 0], kind="stable")]
        self.starts = np.searchsorted(links[:, 0], np.arange(n + 1))
        self.a, self.b = links[:, 1], links[:, 2]

    def _put(self, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fills in the pieces at, whose tokens follow each other in a and b; returns (piece, a, b) of their links."""
        both, n = self.both, len(at)
        ends_a, ends_b = np.cumsum(both.sizes_a[a]), np.cumsum(both.sizes_b[b])
        ends, own_a, own_b, closes = intervals(ends_a, ends_b)
        shut = np.flatnonzero(closes)
        piece_ends = np.cumsum(self.sizes[at])
        piece, upto_a, upto_b, upto = (np.searchsorted(x, y) for x, y in ((piece_ends, ends), (ends_a, piece_ends), (ends_b, piece_ends), (ends[shut], piece_ends)))
        if not (ends[shut][upto] == piece_ends).all():
            raise ValueError("a token goes on behind a cut")
        last_a, last_b = own_a[shut], own_b[shut]
        k, m = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)  # tokens of each group
        n_a, n_b = np.diff(upto_a, prepend=-1), np.diff(upto_b, prepend=-1)
        products = np.bincount(piece[shut], k * m, n).astype(np.int64)
        self.counts[at] = np.stack([n_a, n_b, np.diff(upto, prepend=-1), np.bincount(piece, minlength=n), products], 1)
        self.ok[at] = True
        # a group's tokens of A stand before those of B; | and ; come behind a group's last ones
        order_a = np.arange(len(a)) + np.repeat(np.cumsum(m) - m, k)
        order_b = np.arange(len(b)) + np.repeat(np.cumsum(k), m)
        told = np.zeros(len(a) + len(b), np.int64)
        told[order_a], told[order_b] = a, b
        told[order_a[last_a]] += both.n_ids
        told[order_b[last_b]] += 2 * both.n_ids
        texts = list(map(both.names.__getitem__, told.tolist()))
        to = np.cumsum(n_a + n_b).tolist()
        for j, start, end in zip(at.tolist(), [0, *to], to):
            self.groups[j] = "".join(texts[start:end])
        return np.stack([at[piece], a[own_a], b[own_b]], 1)


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


class Numbers(dict):
    """Numbers keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Block:
    """The texts of a block: counts and groups by text, links by pair and text."""

    def __init__(self, both: Sides, texts: list[str | None]):
        known = Numbers()
        words = [np.fromiter(map(known.__getitem__, both.pieces(t)), np.int64) if t else EMPTY for t in texts]
        sizes = list(map(len, words))
        pieces = Aligned(both, list(known))
        n = len(texts)
        text, word = np.repeat(np.arange(n), sizes), np.concatenate([*words, EMPTY])
        good = np.array(sizes) > 0
        good[text[~pieces.ok[word]]] = False
        text, word = text[good[text]], word[good[text]]
        self.counts = np.zeros((n, 5), np.int64)
        for c in range(5):
            self.counts[:, c] = np.bincount(text, pieces.counts[word, c], n)
        self.groups = ["".join(map(pieces.groups.__getitem__, w.tolist()))[:-1] if ok else None for w, ok in zip(words, good)]
        # (text, piece) with how often, then (text, pair) with how often
        key, times = np.unique(text * len(known) + word, return_counts=True) if len(known) else (EMPTY, EMPTY)
        text, word = (key // len(known), key % len(known)) if len(known) else (EMPTY, EMPTY)
        pair = pieces.a << 32 | pieces.b
        self.pairs, number = np.unique(pair, return_inverse=True)
        start, end = pieces.starts[word], pieces.starts[word + 1] if len(word) else EMPTY
        text, times, number = np.repeat(text, end - start), np.repeat(times, end - start), number[spread(start, end)] if len(word) else EMPTY
        key, at = np.unique(text * max(1, len(self.pairs)) + number, return_inverse=True)
        self.times = np.bincount(at, times, len(key)).astype(np.int64)
        self.number, self.text = key % max(1, len(self.pairs)), key // max(1, len(self.pairs))
        self.holders = np.bincount(self.number, minlength=len(self.pairs))


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_products"]


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(block, row, sums, pairs, holders, number, times, ends): a row for each block, written.

    row, sums: by text its other columns and its result; pairs, holders: the block's id pairs (A id << 32 | B id) and how many
    texts link them; number, times: by text its pairs, as places in pairs, and how often it links them, up to ends.
    """
    keep = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(0).alias("c0"))
    named = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    own = T.ArrayType(named.schema["row"].dataType)
    sums = T._parse_datatype_string("array<struct<n_a:long,n_b:long,n_groups:long,n_links:long,n_products:long,groups_sha256:string>>")
    rest = "pairs array<long>, holders array<int>, number binary, times binary, ends array<long>"
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", own), T.StructField("sums", sums), *T._parse_datatype_string(rest)])
    names = schema.names

    def made(rows: list[pa.Array], texts: list[str | None], block: int) -> pa.RecordBatch:
        b = Block(sides(path_a, path_b), texts)
        told = [hashlib.sha256(g.encode()).hexdigest() if g is not None else "" for g in b.groups]
        parts = [*(pa.array(b.counts[:, c]) for c in range(5)), pa.array(told, pa.string())]
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        whole = pa.concat_arrays(rows)
        data = [
            pa.array([block]), listed(whole), listed(pa.StructArray.from_arrays(parts, names=[*FIELDS, "groups_sha256"])), listed(pa.array(b.pairs)),
            listed(pa.array(b.holders.astype(np.int32))), pa.array([b.number.astype("<u4").tobytes()]), pa.array([b.times.astype("<u4").tobytes()]),
            listed(pa.array(np.searchsorted(b.text, np.arange(1, len(texts) + 1)))),
        ]
        return pa.RecordBatch.from_arrays(data, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's number: the task, and the block's place in it
        block, rows, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            done = 0
            for i, t in enumerate(b.column(1).to_pylist()):
                texts.append(t)
                size += len(t) if t else 0
                if size >= BLOCK:
                    rows.append(b.column(0).slice(done, i + 1 - done))
                    yield made(rows, texts, block)
                    give_back()
                    block, rows, texts, size, done = block + 1, [], [], 0, i + 1
            if done < b.num_rows:
                rows.append(b.column(0).slice(done))
        if texts:
            yield made(rows, texts, block)

    return durable(bounded_batches(named).mapInArrow(lean(run), schema), "blocks")


def link_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents an id pair is linked, and whether no pair of its A id has more."""
    each = found.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.holders").alias("n"))
    counts = durable(each.groupBy("pair").agg(F.sum("n").alias("count")), "counts").withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, n_products, n_best, count_sum and groups_sha256."""
    new = [*FIELDS, "n_best", "count_sum", "groups_sha256"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    keep = [c for c in docs.columns if c != "text"]
    found = blocks(docs, path_a, path_b)
    asked = found.select("block", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(link_counts(found), "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("told"))
    both = found.select("block", "row", "sums", "number", "times", "ends").join(told, "block", "left")
    each = T._parse_datatype_string("array<struct<n_best:long,count_sum:long>>")
    schema = T.StructType([found.schema["row"], found.schema["sums"], T.StructField("links", each)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ends = np.array(b.column(4)[i].as_py(), np.int64)
                number, times = (np.frombuffer(b.column(c)[i].as_py(), "<u4").astype(np.int64) for c in (2, 3))
                own = b.column(5)[i].values
                n = 0 if own is None else len(own)
                count, best = np.zeros(n, np.int64), np.zeros(n, bool)
                if n:
                    at, told_count, told_best = (own.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    count[at], best[at] = told_count, told_best
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[number], times * count[number])]
                starts = np.concatenate([[0], ends[:-1]])
                made = pa.StructArray.from_arrays([pa.array(s[ends] - s[starts]) for s in sums], names=["n_best", "count_sum"])
                listed = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), made)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), listed], names=["row", "sums", "links"])

    order = ["row", "sums", "number", "times", "ends", "told"]
    done = both.select(*order).mapInArrow(lean(run), schema).select(F.explode(F.arrays_zip("row", "sums", "links")).alias("x"))
    result = [F.col(f"x.sums.{c}").alias(c) for c in FIELDS] + [F.col(f"x.links.{c}").alias(c) for c in ("n_best", "count_sum")]
    return done.select(*[F.col(f"x.row.c{i}").alias(c) for i, c in enumerate(keep)], *result, F.col("x.sums.groups_sha256").alias("groups_sha256"))


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs without text, with groups: an array of (start, end, a, b, products), the bytes and ids of each group.

    products: its A and B ids multiplied out, as pairs. Bytes are those of a space and the text.
    """
    keep = [c for c in docs.columns if c not in ("text", "groups")]
    kind = "array<struct<start:long,end:long,a:array<int>,b:array<int>>>"
    row = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    named = docs.select(row, F.col("text").cast("string").alias("text"))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        for b in batches:
            made = []
            for text in b.column(1).to_pylist():
                pieces = both.pieces(text) if text else []
                groups, at = [], 0
                done = Aligned(both, pieces)
                for p, told, ok in zip(pieces, done.groups, done.ok):
                    for g in told[:-1].split(";") if done.ok.all() else []:
                        a, c = ([int(x) for x in side.split(",")] for side in g.split("|"))
                        end = at + sum(len(both.bytes_a[x]) for x in a)
                        groups.append({"start": at, "end": end, "a": a, "b": c})
                        at = end
                made.append(groups)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, arrow)], names=["row", "groups"])

    schema = T.StructType([named.schema["row"], T.StructField("groups", T._parse_datatype_string(kind))])
    out = bounded_batches(named).mapInArrow(lean(run), schema)
    pairs = lambda g: F.flatten(F.transform(g["a"], lambda a: F.transform(g["b"], lambda b: F.struct(a.alias("a"), b.alias("b")))))
    groups = F.transform("groups", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), g["a"].alias("a"), g["b"].alias("b"), pairs(g).alias("products")))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], groups.alias("groups"))


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_products"]
    return align(docs.select("doc_id", "text"), path_a, path_b).select(*names)
