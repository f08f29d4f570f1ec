"""Near copies by SimHash, found with vantage-point trees over fingerprints.

A fingerprint has a bit for each bit of a 64-bit hash: set if it is set in over half the hashes of a text's word shingles.
Documents link where their fingerprints differ in NEAR bits at most; what is returned are components.

1. Equal fingerprints are one point; from here on only points move, 8 bytes each.
2. The driver builds the top of a vantage-point tree on a bounded sample of points: each node has a vantage point and a radius, and
   its two sides hold the points within the radius and those beyond. By the triangle inequality points that link differ
   by NEAR at most in their distance to the vantage point, so a pair on both sides of the radius has its inner point among those
   that lie less than NEAR within it: these go to both sides. Every pair that links so meets in a shard (a leaf of the
   top), and a shard sees, besides its own points, only such that overlap its boundary.
3. Each shard goes on with a tree of its own, prunes the same way, and compares the few points of a leaf one by one. It tells links
   that connect its points, never all pairs.
4. Points so close that no vantage point parts them (large groups of near copies) meet by their neighbours instead: two points
   differ in two bits at most if flipping one bit or none of each makes them equal. This is exact, and linear in the points.
5. Links become components over points.

Defined results: null and empty texts and texts without words have the fingerprint zero and link as any other; repeated rows have
one fingerprint and so one component; a component whose documents have no doc_id has NULL as its name; ties don't arise, as any
tree gives the same components; the other columns of the input are passed on, those named as results are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import bounded_batches, durable, lean
from gridpulse.llm.components import components

SHINGLE, SEED, NEAR = 3, 42, 2
#: Points that the top of the tree is built on, about; points of a shard; points of a leaf that are compared one by one.
SAMPLE, SHARD, LEAF = 1 << 16, 1 << 13, 256
#: A side with more than this share of a node's points doesn't part them; sample points that tell a split at least.
PARTED, TOLD = 0.85, 64
#: Vantage points tried for a node, hashes whose bits are counted at once, and keys of neighbours held at once.
TRIED, HASHES, KEYS = 8, 1 << 15, 1 << 22


def hashes(raw: bytes) -> Iterator[np.ndarray]:
    """The hashes of a lower-cased text's shingles, so many at once; with fewer words the whole sequence is one."""
    words = raw.split()
    if 0 < len(words) < SHINGLE:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    for at in range(0, max(0, len(words) - SHINGLE + 1), HASHES):
        some = words[at : at + HASHES + SHINGLE - 1]
        yield np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(some[k:] for k in range(SHINGLE)))], np.uint64)


def fingerprint(text: str | None) -> int:
    count, n = np.zeros(64, np.int64), 0
    # bytes.lower() lowers A-Z alone
    for h in hashes((text or "").encode().lower()):
        count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row, doc_id, point) of docs; row: all its columns but text, as one."""
    names = ["row", "doc_id", "point"]
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    named = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(points.view(np.int64))], names=names)

    schema = named.select("row", "doc_id").schema.add("point", "long")
    return bounded_batches(named).mapInArrow(lean(run), schema)


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part the points best: the larger side is least; None if nothing parts them."""
    best, least = None, PARTED * len(points)
    for v in rng.choice(points, min(TRIED, len(points)), replace=False):
        within = np.cumsum(np.bincount(distances(points, v), minlength=65))
        # within a radius m there are within[m]; beyond it, and less than NEAR within it, all but within[m - NEAR]
        beyond = len(points) - np.concatenate([np.zeros(NEAR, np.int64), within[: 65 - NEAR]])
        larger = np.maximum(within, beyond)
        m = int(np.argmin(larger))
        if larger[m] < least:
            best, least = (v, m), larger[m]
    return best


def sides(points: np.ndarray, vantage: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each point belongs within the radius, and whether beyond; the points that overlap do both."""
    d = distances(points, vantage)
    return d <= radius, d > radius - NEAR


class Top:
    """The top of the tree: nodes (vantage point, radius, node within, node beyond), where a node below zero is shard -1 - node."""

    def __init__(self, sample: np.ndarray, each: float, shard: int = SHARD):
        rng = np.random.default_rng(1)
        self.nodes: list[tuple] = []
        self.shards = 0
        self.root = self._build(sample, each, shard, rng)

    def _build(self, points: np.ndarray, each: float, shard: int, rng: np.random.Generator) -> int:
        """each: how many points a sampled one stands for."""
        cut = split(points, rng) if len(points) >= TOLD and len(points) * each > shard else None
        if cut is None:
            self.shards += 1
            return -self.shards
        inner, outer = sides(points, *cut)
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (*cut, self._build(points[inner], each, shard, rng), self._build(points[outer], each, shard, rng))
        return at

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, its points)."""
        todo = [(self.root, points)]
        while todo:
            at, held = todo.pop()
            if at < 0:
                yield -1 - at, held
            elif len(held):
                vantage, radius, within, beyond = self.nodes[at]
                inner, outer = sides(held, vantage, radius)
                todo += [(within, held[inner]), (beyond, held[outer])]


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n numbers that each is linked with, through others, too."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def mixed(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def by_neighbours(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect points two bits apart at most: chains of those that have a point less than two bits off in common."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    passes = -(-len(points) * len(flips) // KEYS)
    a, b = [], []
    for k in range(passes):
        keys, owners = [], []
        for f in flips:
            near = points ^ f
            own = np.flatnonzero(mixed(near) % np.uint64(passes) == k)
            keys.append(near[own])
            owners.append(own)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        # of all chains what connects is enough
        label = connected(len(points), owner[same], owner[same + 1])
        own = np.flatnonzero(label != np.arange(len(points)))
        a.append(own)
        b.append(label[own])
    return np.concatenate(a), np.concatenate(b)


def near_links(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in points) that connect whatever of the different points is connected by pairs NEAR bits apart at most."""
    rng = np.random.default_rng(2)
    todo, a, b = [np.arange(len(points))], [], []
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        own = points[at]
        cut = split(own, rng) if len(at) > leaf else None
        if cut is not None:
            inner, outer = sides(own, *cut)
            todo += [at[inner], at[outer]]
            continue
        if len(at) > leaf:
            x, y = by_neighbours(own)
        else:
            x, y = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own) <= NEAR, 1))
            label = connected(len(at), x, y)
            x = np.flatnonzero(label != np.arange(len(at)))
            y = label[x]
        a.append(at[x])
        b.append(at[y])
    none = np.zeros(0, np.int64)
    label = connected(len(points), np.concatenate([none, *a]), np.concatenate([none, *b]))
    own = np.flatnonzero(label != np.arange(len(points)))
    return own, label[own]


def linked_points(points: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect what is connected among a written table's different points."""
    every = max(1, points.count() // SAMPLE)
    sample = points.where(F.pmod(F.xxhash64("point"), F.lit(every)) == 0).toArrow()  # about SAMPLE to twice as many
    drawn = np.sort(sample.column("point").to_numpy().view(np.uint64))
    top = Top(drawn, every, shard)
    shared = points.sparkSession.sparkContext.broadcast(top)  # of fewer nodes than the sample has points

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, held in shared.value.route(b.column(0).to_numpy().view(np.uint64)):
                if len(held):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), k)), pa.array(held.view(np.int64))], names=["shard", "point"])

    def link(t: pa.Table) -> pa.Table:
        own = np.sort(t.column("point").to_numpy().view(np.uint64))
        a, b = near_links(own)
        return pa.table({"a": pa.array(own[a].view(np.int64)), "b": pa.array(own[b].view(np.int64))})

    dealt = points.select("point").mapInArrow(lean(route), "shard long, point long")
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long")


def join_components(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """docs without text, with fingerprint, as 16 hexadecimal digits, and component_id, its component's smallest doc_id."""
    keep = [c for c in docs.columns if c not in ("text", "fingerprint", "component_id")]
    prints = durable(fingerprints(docs), "prints")
    points = durable(prints.groupBy("point").agg(F.min("doc_id").alias("low")), "points")
    labels = components(durable(linked_points(points, shard), "near"))
    own = durable(points.join(labels, points.point == labels.node, "left").select("point", "low", F.coalesce("label", "point").alias("component")), "own")
    names = own.groupBy("component").agg(F.min("low").alias("name"))
    named = own.join(names, "component").select("point", "name")
    digits = F.lower(F.lpad(F.hex("point"), 16, "0"))
    return prints.join(named, "point").select(*[F.col(f"row.`{c}`").alias(c) for c in keep], digits.alias("fingerprint"), F.col("name").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return join_components(docs.select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")
