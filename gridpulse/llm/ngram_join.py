"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles; two link when 100 * |intersection| >= 80 * |union|.

1. A document is a doc_id, NULL too, with a text: both make its key. Documents with equal sets are one class, represented
   by its smallest key. Shingles are ordered, rare before frequent: by how often they occur in a sample of the documents
   that grows with their number (one in 64, and 1,024 at least), and then by a sketch of fixed size, in which the same pass
   counts all of them and which tells more the fewer they are. Any order gives the same links.
2. A set of n must share one of its n - ceil(0.8 n) + 1 rarest shingles with any set it links to. Postings of these
   meet by shingle. Pairs of classes in short lists are counted and dropped when what they share there is too little for
   the overlap; a list that is long has its smallest class as centre, instead of pairs, once for each pair of neighbouring
   ranges of size, as sets that link differ by one such range at most. A set whose place of the shingle is so late that
   what follows it is too little for the overlap with the least set of the list isn't put there.
3. The classes of a centre, in blocks of bounded size, are searched for links: each set asks the block's inverted
   lists for the sets that reach the overlap. The L longest lists are set aside, the short ones are counted by
   member, and what reaches T - L there is probed by binary search in the long ones (DivideSkip). Sets that are in the
   largest component by then don't ask: what they link to outside it asks itself. Only links
   that connect something new leave a task, never all pairs of a group.
4. Links become components. Where a centre had several blocks, its classes outside its largest component meet the
   other blocks in a second search, so no link between components is missed.

Defined results: null and empty texts and texts without words have an empty set and link with nothing; repeated rows
with one doc_id count as one document if their texts agree, else as several. A component is named by its smallest doc_id that
isn't NULL, and NULL if it has none: components that share an id may share a name, but keep_one tells them apart;
ties don't arise, as the measure is exact. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import bounded_batches, durable, lean, partitions
from gridpulse.llm.components import components
from gridpulse.llm.shingles import shingle_set

NUM, DEN = 80, 100
#: Cells of the sketch, and how many make a row of it.
SKETCH, CHUNK = 1 << 20, 1 << 14
#: One in SAMPLED documents is counted by shingle, but ORDERED at least; at most FREQUENT shingles are told apart by it.
SAMPLED, ORDERED, FREQUENT = 64, 1024, 1 << 20
#: Sets and shingles of a block at most, unless it is one set.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22
ROWS, MERGE_COST = 2048, 0.01
#: Lists of more classes have a centre; pairs within shorter ones are counted.
SHORT_LIST = 16


def least_overlap(n: int) -> int:
    return -(-NUM * n // DEN)


def linked(common: int, a: int, b: int) -> bool:
    return DEN * common >= NUM * (a + b - common)


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def summarise(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key, n, cls) for documents, and (chunk, counts) for the parts of each task's sketch."""
    names = ["doc_id", "key", "n", "cls", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        none = lambda k, kind: pa.nulls(k, kind)
        for b in batches:
            n, cls, cells, held = [], [], [], 0
            for text in b.column(2).to_pylist():
                s = shingle_set(text)
                cells.append((s >> np.uint64(44)).astype(np.int32))
                held += len(s)
                n.append(len(s))
                cls.append(class_of(s))
                if held > SKETCH:
                    sketch += np.bincount(np.concatenate(cells), minlength=SKETCH)
                    cells, held = [], 0
            if cells:
                sketch += np.bincount(np.concatenate(cells), minlength=SKETCH)
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), none(k, pa.int32()), none(k, pa.binary())], names=names)
        parts = [sketch[i : i + CHUNK].astype(np.uint32).tobytes() for i in range(0, SKETCH, CHUNK)]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([*[none(k, pa.int64())] * 4, pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.select("doc_id", "key", "text").mapInArrow(lean(run), "doc_id long, key long, n long, cls long, chunk int, counts binary")


def sketch_of(summary: DataFrame) -> np.ndarray:
    """Counts of SKETCH cells, whatever the input's size, as steps of a doubling count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw, np.uint32).astype(np.uint64)
                total[chunk] = total[chunk] + x if chunk in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    parts = summary.where("chunk IS NOT NULL").select("chunk", "counts").repartition(min(partitions(summary.sparkSession), SKETCH // CHUNK), "chunk")
    cells = np.zeros(SKETCH, np.uint64)
    for r in parts.mapInArrow(lean(add), "chunk int, counts binary").collect():
        cells[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint64)
    # steps of a fourth: cells of near-equal counts keep the order of their hashes
    return np.floor(4 * np.log2(cells.astype(np.float64) + 1)).astype(np.uint8)


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, steps): the most frequent of the sample, sorted, with a step of its count; FREQUENT at most, whatever the input."""
    every = max(1, min(SAMPLED, n // ORDERED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                seen, k = np.unique(np.concatenate([shingle_set(t) for t in b.column(0).to_pylist()]), return_counts=True)
                for i in range(0, len(seen), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(seen[part].view(np.int64)), pa.array(k[part])], names=["shingle", "k"])

    sample = docs.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("text").mapInArrow(lean(run), "shingle long, k long")
    # steps of a fourth: shingles of near-equal counts keep the order of their hashes
    step = F.floor(4 * F.log2("k")).cast("int")
    counts = sample.groupBy("shingle").agg(F.sum("k").alias("k")).where("k > 1").select("shingle", step.alias("step"))
    counts = durable(counts, "counts")
    held, least = 0, 1 << 20
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # a row for each step
        if held + r["count"] > FREQUENT:
            break
        held, least = held + r["count"], r["step"]
    got = counts.where(F.col("step") >= least).toArrow()
    shingle = got.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], got.column("step").to_numpy().astype(np.uint8)[order]


def rarest(s: np.ndarray, order: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which any linked set shares one, in the order of the sample and the sketch."""
    k = len(s) - least_overlap(len(s)) + 1
    known, step, cells = order
    rank = cells[(s >> np.uint64(44)).astype(np.int64)].astype(np.int32)
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        rank += 256 * np.where(known[at] == s, step[at], 0).astype(np.int32)
    return s[np.argsort(rank, kind="stable")[:k]]  # s is sorted, so ties keep the order of their hashes


def postings(docs: DataFrame, order: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(bucket, keys, owners, places, classes): the rare shingles of a batch of documents, packed by bucket of shingle.

    owners are places in classes, pairs of class and size; places are the shingles' places in their sets' order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)  # of FREQUENT shingles and SKETCH cells at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                keys, owners, places, held = [], [], [], []
                for text in whole.slice(at, ROWS).column(0).to_pylist():
                    s = shingle_set(text)
                    if len(s) and (cls := class_of(s)) not in seen:
                        if len(seen) < 1 << 16:
                            seen.add(cls)
                        k = rarest(s, shared.value)
                        keys.append(k)
                        owners.append(np.full(len(k), len(held), np.int64))
                        # a place beyond 16 bits is given too low, which only keeps more
                        places.append(np.minimum(np.arange(len(k)), 65535).astype("<u2"))
                        held.append((cls, len(s)))
                if not keys:
                    continue
                key, owner, place, classes = np.concatenate(keys), np.concatenate(owners), np.concatenate(places), np.array(held, "<i8")
                o = np.argsort(key, kind="stable")
                key, owner, place = key[o], owner[o], place[o]
                bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    near, index = np.unique(owner[a:b], return_inverse=True)  # at most ROWS, so 16 bits hold a place
                    rows.append((int(bucket[a]), key[a:b].tobytes(), index.astype("<u2").tobytes(), place[a:b].tobytes(), classes[near].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=_PACKED)

    return docs.select("text").mapInArrow(lean(run), "bucket int, keys binary, owners binary, places binary, classes binary")


_PACKED = ["bucket", "keys", "owners", "places", "classes"]


def may_link(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of n and m, whose first common shingle is at these places, can reach the overlap that links them."""
    least = -(-NUM * (n + m) // (DEN + NUM))
    return (NUM * np.maximum(n, m) <= DEN * np.minimum(n, m)) & (n - place >= least) & (m - other >= least)


def reach(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest set that may link with one of n whose first shingle in common has this place."""
    return (DEN + NUM) * (n - place) // NUM - n


def stars(key: np.ndarray, cls: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, centre) of the lists of some shingles, one for each pair of neighbouring ranges of size; linked sets are in one or in neighbouring ones.

    Of a list only those stay that can reach its least set, the first shingle in common being this one.
    """
    kept, centres = [cls[:0]], [cls[:0]]
    # a range's list holds the one below, too
    size = np.floor(np.log(n) / math.log(DEN / NUM)).astype(np.int64)  # below 256 for any number
    at = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) * 256 + size if len(key) else size
    code, of, own = np.concatenate([at, at + 1]), np.tile(np.arange(len(key)), 2), np.repeat([True, False], len(key))
    o = np.argsort(code, kind="stable")
    code, of, own = code[o], of[o], own[o]
    for last in (False, True):
        if not len(code):
            break
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        length = np.diff(np.append(starts, len(code)))
        stay = np.repeat(np.logical_or.reduceat(own, starts) & (length > 1), length)
        if last:
            kept, centres = [cls[of][stay]], [np.repeat(np.minimum.reduceat(cls[of], starts), length)[stay]]
        else:
            stay &= reach(n[of], place[of]) >= np.repeat(np.minimum.reduceat(n[of], starts), length)
        code, of, own = code[stay], of[stay], own[stay]
    found = np.unique(np.stack([kept[0], centres[0]]), axis=1)
    return found[0], found[1]


def shared_keys(packed: DataFrame, n: int) -> DataFrame:
    """Rows (cls, centre) of long lists, (cls, n) of how many of these a class is in, and (cls, other, n, m, first) for each pair of a
    short list whose sizes allow a link.

    first tells whether this shingle's places allow that it is the pair's first common one.
    """
    names = ["centre", "cls", "other", "n", "m", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, sizes, places = [], [], [], []
        for b in batches:
            for k, o, p, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                pairs = np.frombuffer(c, "<i8").reshape(-1, 2)[np.frombuffer(o, "<u2")]
                keys.append(np.frombuffer(k, np.uint64))
                owners.append(pairs[:, 0])
                sizes.append(pairs[:, 1])
                places.append(np.frombuffer(p, "<u2"))
        if not keys:
            return
        key, owner, size, place = (np.concatenate(x) for x in (keys, owners, sizes, places))
        o = np.lexsort((owner, key))
        key, owner, size, place = key[o], owner[o], size[o], place[o].astype(np.int64)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        key, owner, size, place = key[new], owner[new], size[new], place[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(starts, len(key)))
        long = np.repeat(length > SHORT_LIST, length)
        cls, centre = stars(*(x[long] for x in (key, owner, size, place)))
        has, count = np.unique(owner[long], return_counts=True)
        for i in range(0, max(len(cls), len(has)), 1 << 16):
            (a, b), (c, k) = ([x[i : i + (1 << 16)] for x in y] for y in ((cls, centre), (has, count)))
            none = [pa.nulls(len(a) + len(c), t) for t in (pa.int64(), pa.int64(), pa.bool_())]
            centre_, count_ = pa.concat_arrays([pa.array(b), none[0][: len(c)]]), pa.concat_arrays([none[0][: len(a)], pa.array(k)])
            yield pa.RecordBatch.from_arrays([centre_, pa.array(np.concatenate([a, c])), none[0], count_, *none[1:]], names=names)
        for k in range(2, SHORT_LIST + 1):
            at = starts[length == k]
            if not len(at):
                continue
            i, j = np.triu_indices(k, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            fits = NUM * np.maximum(size[a], size[b]) <= DEN * np.minimum(size[a], size[b])
            a, b = a[fits], b[fits]
            first = may_link(size[a], place[a], size[b], place[b])
            for i in range(0, len(a), 1 << 16):
                x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                data = [pa.nulls(len(x), pa.int64()), *map(pa.array, (owner[x], owner[y], size[x], size[y], first[i : i + (1 << 16)]))]
                yield pa.RecordBatch.from_arrays(data, names=names)

    return packed.repartition(n, "bucket").mapInArrow(lean(run), "centre long, cls long, other long, n long, m long, first boolean")


def candidates(keys: DataFrame) -> DataFrame:
    """(cls, centre): the classes of each centre; any two classes that link have a centre in common.

    A pair of short lists shares, in the rare parts of both sets, what the lists tell; what it can share beyond is at most
    the larger of the two rests, and in long lists the fewer that the two are in. Pairs that cannot reach the overlap so are dropped.
    """
    long = keys.where("centre IS NOT NULL").select("cls", "centre")
    rest = lambda c: F.ceil(F.lit(NUM) * F.col(c) / DEN) - 1
    least = F.ceil(F.lit(NUM) * (F.col("n") + F.col("m")) / (DEN + NUM))
    pairs = keys.where("other IS NOT NULL").groupBy("cls", "other", "n", "m").agg(F.count("*").alias("shared"), F.max("first").alias("first"))
    apart = keys.where("centre IS NULL AND other IS NULL").groupBy("cls").agg(F.sum("n").alias("apart"))
    pairs = pairs.where("first").join(apart, "cls", "left").join(apart.select(F.col("cls").alias("other"), F.col("apart").alias("apart_")), "other", "left")
    more = F.least(F.coalesce("apart", F.lit(0)), F.coalesce("apart_", F.lit(0)))
    pairs = pairs.where(F.col("shared") + more >= least - F.greatest(rest("n"), rest("m")))
    both = F.explode(F.array("cls", "other"))
    return long.unionByName(pairs.select(both.alias("cls"), F.col("cls").alias("centre"))).distinct()


def divide_skip(lists: list[np.ndarray], t: int) -> Iterator[tuple[int, int, list[int]]]:
    """(member, count so far, places of the lists still to probe) of members that reach t - L in the short lists."""
    size = np.array([len(x) for x in lists])
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=1))
    apart = max(0, min(t - 1, int(t / (MERGE_COST * np.log2(longest + 1) + 1))))
    long, short = order[:apart].tolist(), order[apart:].tolist()
    counts = np.bincount(np.concatenate([lists[k] for k in short]))
    for member in np.flatnonzero(counts >= t - apart).tolist():
        yield member, int(counts[member]), long


def search(ids: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, group: np.ndarray, main: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join different groups, each joining its groups: enough to connect whatever is linked.

    A set of the largest component doesn't ask, as those that it links to are in that component or ask themselves. Where they
    may do so in another search, which knows other components, main tells the sets of a group that counts as the largest in all.
    """
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    shingle, which = np.unique(flat, return_inverse=True)
    by = np.argsort(which, kind="stable")
    member = np.repeat(np.arange(len(sets)), n)[by]
    ends = np.searchsorted(which[by], np.arange(len(shingle) + 1))
    lengths = np.diff(ends)
    starts = np.concatenate([[0], np.cumsum(n)])
    parent = {g: g for g in group.tolist()}
    weight = dict(zip(*(x.tolist() for x in np.unique(group, return_counts=True))))
    spared = main is None or bool(main.any())
    if main is not None and spared:
        weight[int(group[np.argmax(main)])] += 2 * len(sets)
    large = max(weight, key=weight.get)

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    found = []

    def ask(q: int) -> None:
        nonlocal large
        own = which[starts[q] : starts[q + 1]]
        t = least_overlap(int(n[q]))
        own = own[lengths[own] > 1]  # a list of one holds the asking set alone
        if len(own) < t:
            return
        lists = [member[ends[k] : ends[k + 1]] for k in own.tolist()]
        for c, count, long in divide_skip(lists, t):
            here, there = root(int(group[q])), root(int(group[c]))
            if c == q or here == there or not NUM * max(n[q], n[c]) <= DEN * min(n[q], n[c]):
                continue
            probes = shingle[own[long]]
            at = np.searchsorted(sets[c], probes)
            count += int((sets[c][np.minimum(at, n[c] - 1)] == probes).sum())
            if linked(count, int(n[q]), int(n[c])):
                parent[there] = here
                weight[here] += weight[there]
                large = max(root(large), here, key=weight.get)
                found.append((int(ids[q]), int(ids[c])))

    later = []
    for q in np.flatnonzero(asks).tolist():
        if spared and root(int(group[q])) == large and weight[large] > 1:
            later.append(q)
        else:
            ask(q)
    # the largest component is another than before: what isn't in it asks after all
    for q in later:
        if root(int(group[q])) != root(large):
            ask(q)
    return found


class Bits:
    """A bitmap with a bit for each id; others may share it."""

    def __init__(self, log: int, bits: np.ndarray):
        self.log, self.bits = log, bits

    def at(self, ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.log)).astype(np.int64)

    def mark(self, ids: np.ndarray) -> None:
        at = self.at(ids)
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = self.at(ids)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


#: Least and greatest number of bits, as powers of two, and bytes of a part of the map.
LOGS, PART = (20, 29), 4096


def needed_bits(ids: DataFrame) -> Bits:
    """The map of a written table's ids, with 16 bits for each up to 64 MB in all; its parts are merged by many tasks."""
    log = min(LOGS[1], max(LOGS[0], (16 * max(1, ids.count()) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bits(log, np.zeros((1 << log) // 8, np.uint8))
        for b in batches:
            own.mark(b.column(0).to_numpy())
        part = np.flatnonzero(own.bits.reshape(-1, PART).any(1))
        for k in range(0, len(part), 256):
            some = part[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([own.bits[PART * i : PART * (i + 1)].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw, np.uint8)
                total[i] = total[i] | x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "bits"])

    kind = "part long, bits binary"
    parts = ids.mapInArrow(lean(run), kind).repartition(partitions(ids.sparkSession), "part").mapInArrow(lean(merge), kind)
    bits = np.zeros((1 << log) // 8, np.uint8)
    got = parts.toArrow()  # 64 MB at most
    for i, raw in zip(got.column("part").to_pylist(), got.column("bits").to_pylist()):
        bits[PART * i : PART * (i + 1)] = np.frombuffer(raw, np.uint8)
    return Bits(log, bits)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the asked documents, and of some others; texts of the rest aren't even cut into words."""
    shared = docs.sparkSession.sparkContext.broadcast(needed_bits(ids))  # 64 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                doc = b.column(0).to_numpy()
                want = np.flatnonzero(shared.value.has(doc))
                if len(want):
                    raw = [shingle_set(b.column(1)[int(i)].as_py()).tobytes() for i in want]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[want]), pa.array(raw, pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, shingles binary")


def _searched(groups: DataFrame, by: list[str], n: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        # repeated rows of a document come once
        t = t.take(pa.array(np.unique(t.column("doc_id").to_numpy(), return_index=True)[1]))
        asks = t.column("asks").to_numpy()
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        ids = t.column("doc_id").to_numpy()
        found = search(ids, raw, asks, t.column("grp").to_numpy(), t.column("main").to_numpy() if "main" in t.column_names else None) if len(ids) > 1 and asks.any() else []
        a, b = ([x[i] for x in found] for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # groups are few bytes for their work, so tasks aren't made of bytes
    return groups.repartition(n, *by).groupBy(*by).applyInArrow(run, "a long, b long")


def key_of() -> Column:
    """What tells documents apart: the doc_id, NULL too, with the text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, cls) for each row of docs; (cls, component, low) for each class, low being its smallest doc_id."""
    n = partitions(bounded_batches(docs).sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of().alias("key"), "text")
    summary = durable(summarise(docs), "summary")
    sizes = summary.where("chunk IS NULL").select("doc_id", "key", "n", "cls")
    classes = durable(sizes.where("n > 0").groupBy("cls").agg(F.min("key").alias("holder"), F.min("doc_id").alias("low"), F.max("n").alias("n")), "classes")
    # from here on doc_id is a key
    order = *frequent(docs, sizes.count()), sketch_of(summary)
    docs = docs.select(F.col("key").alias("doc_id"), "text")
    packed = postings(docs, order, 4 * n)
    keys = durable(shared_keys(packed, n), "keys")

    # every class with its centres; a centre is in its own group
    edges = durable(candidates(keys), "edges")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    edges = edges.join(classes, "cls")
    placed = edges.join(edges.groupBy("centre").agg(parts.alias("blocks")), "centre").select(
        "centre", "blocks", "n", F.col("holder").alias("doc_id"), (F.col("cls") == F.col("centre")).alias("is_centre"),
        F.pmod(F.xxhash64("cls", "centre"), "blocks").alias("block"),
    )
    placed = durable(placed, "placed")
    # the centre joins every block of its group
    everywhere = F.when(F.col("is_centre"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    sets = sets_of(docs, durable(placed.select("doc_id").distinct(), "wanted"))
    first = placed.withColumn("block", F.explode(everywhere)).join(sets, "doc_id").select(
        "centre", "block", "doc_id", "shingles", F.lit(True).alias("asks"), F.col("doc_id").alias("grp")
    )
    links = durable(_searched(first, ["centre", "block"], n), "found")
    labels = components(links)

    large = placed.where("blocks > 1")
    if not large.isEmpty():
        tagged = durable(
            large.join(labels, large.doc_id == labels.node, "left").select(
                "centre", "blocks", "n", "doc_id", "block", F.coalesce("label", "doc_id").alias("grp")
            ),
            "tagged",
        )
        count = tagged.groupBy("centre", "grp").agg(F.count("*").alias("k"))
        main = count.groupBy("centre").agg(F.max_by("grp", F.struct("k", "grp")).alias("main"))
        tagged = tagged.join(main, "centre").withColumn("main", F.col("grp") == F.col("main"))
        rest = tagged.where("NOT main")
        size = rest.groupBy("centre").agg(parts.alias("lots"))
        askers = rest.join(size, "centre").withColumn("lot", F.pmod(F.xxhash64("doc_id", F.lit(1)), "lots"))
        askers = askers.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        names = ["centre", "lot", "block", "doc_id", "grp", "main"]
        asked = tagged.join(size, "centre").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
        met = askers.select(*names, F.lit(True).alias("asks")).unionByName(asked.select(*names, F.lit(False).alias("asks")))
        # an asker that is also asked counts once, as an asker
        met = met.groupBy(*names).agg(F.max("asks").alias("asks"))
        met = durable(met, "met")
        sets = sets_of(docs, durable(met.select("doc_id").distinct(), "wanted"))
        more = durable(_searched(met.join(sets, "doc_id"), ["centre", "lot", "block"], n), "found")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    own = classes.join(labels, classes.holder == labels.node, "left").select("cls", F.coalesce("label", "holder").alias("component"), "low")
    return sizes, own


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    sizes, own = _classes(docs)
    own = durable(own, "own")
    names = own.groupBy("component").agg(F.min("low").alias("name"))
    return sizes.join(own.join(names, "component").select("cls", "name"), "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id, NULL last; documents without words all stay.

    Of repeated rows of the document that stays one does.
    """
    sizes, own = _classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    best = sizes.where("n > 0").groupBy("cls").agg(first.alias("at")).join(own, "cls")
    kept = best.groupBy("component").agg(F.min("at").alias("at")).select(F.col("at.key").alias("_key"))
    rows = sizes.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_rows"), F.max("n").alias("_n"))
    kept = rows.join(kept.withColumn("_kept", F.lit(True)), "_key", "left").where("_kept OR _n = 0")
    kept = durable(kept.select("_key", ((F.col("_rows") > 1) & (F.col("_n") > 0)).alias("_many")), "kept")
    # the row is one column, so no name of its own can meet those used here
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key_of().alias("_key"))
    one = named.join(kept.where("NOT _many").select("_key"), "_key", "left_semi")
    many = named.join(kept.where("_many").select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    return one.unionByName(many).select("_row.*")
