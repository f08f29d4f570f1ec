"""Merkle manifest of a table of documents: a leaf for each row, a tree for each lang, a tree over the langs' roots.

1. Leaves are hashed in SQL functions and dealt by range of (lang, doc_id, leaf); a row's place among its lang's rows is its
   number in its task plus the rows of the tasks before. No lang, however common, meets in one task.
2. Consecutive leaves are gathered in large blocks, 2^k of one lang each, and a task reduces a block to its node. k grows with
   the table, so that there are TOP nodes and a block of every lang at most.
3. The driver builds the trees above the blocks and over the langs, which is small, and broadcasts the path that is
   left for each block, its suffix.
4. Executors finish the proofs: the siblings within the block, then the suffix, and a fold of each row's own leaf (tampered
   with or not) with them up to a root.

Defined results: a row is a leaf, repeated rows, too; rows of a lang ascend by doc_id, NULL first, and ties by leaf, where
equal leaves may change places (which changes nothing but which of the equal rows has which proof); a NULL doc_id is
never tampered with; an empty table has no rows. Columns other than the hashed ones take no part. More than TOP langs
are refused, as the driver holds a node for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import bounded_batches, durable, lean, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that reach the driver at most (besides a last block of each lang), and the least size of a block, as a power of two.
TOP, LEAST = 1 << 17, 8
#: Rows of a batch of results.
ROWS = 4096


def H(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A field as it is hashed: its bytes' count, a colon and itself, or - if it is missing."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(lang, doc_id, leaf, tampered): tampered is the leaf with n_chars one more, where 7 divides the id's crc32, else NULL."""
    hashed = lambda cols: F.sha2(F.concat(*map(encoded, cols)), 256)
    own = [F.col(f"`{c}`") for c in fields]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(21,0)")
    other = [more if c == "n_chars" else F.col(f"`{c}`") for c in fields]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), hashed(own).alias("leaf"),
        F.when(chosen & F.col("n_chars").isNotNull(), hashed(other)).alias("tampered"),
    )


def numbered(found: DataFrame, n: int) -> DataFrame:
    """leaves() in their order, as a written table, with part, the task, and nth, the row's number among its lang's there."""
    names = ["lang", "doc_id", "leaf", "tampered", "part", "nth"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), object(), 0  # no lang equals the first
        for b in batches:
            nth = []
            for lang in b.column(0).to_pylist():
                at = at + 1 if lang == last else 0
                last = lang
                nth.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], names=names)

    # equal rows are told apart by where they were read, so they needn't meet in one task either
    keys = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("_at")]
    dealt = found.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_at")
    return durable(dealt.mapInArrow(lean(number), "lang string, doc_id long, leaf string, tampered string, part int, nth long"), "leaves")


def levels(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """The levels of a tree, leaves first: until one node remains, or so many levels above the leaves."""
    out = [nodes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        last = out[-1]
        out.append([H("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def path(tree: list[list[str]], at: int) -> list[tuple[str, bool]]:
    """(sibling, whether it stands left) of a leaf, level by level; a level at which it is alone gives ("", False)."""
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append((level[other], other < at) if other < len(level) else ("", False))
        at >>= 1
    return out


def fold(leaf: str, siblings: list[tuple[str, bool]]) -> str:
    for other, left in siblings:
        leaf = H(other + leaf if left else leaf + other)
    return leaf


def blocks_of(rows: DataFrame, by_part: DataFrame, k: int) -> DataFrame:
    """(lang, block, several, doc_ids, leaves, tampered, node): one row for each 2^k leaves; several: the lang has other blocks.

    by_part, (lang, part, n), has a row for each task and lang in it: as many as tasks and langs at most, so it is broadcast.
    """
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select(
        F.col("lang").alias("_lang"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy("lang")).alias("all"),
    )
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("part") == F.col("_part"))
    size = 1 << k
    cut = rows.join(F.broadcast(base), same).withColumn("place", F.col("base") + F.col("nth"))
    cut = cut.select("lang", "doc_id", "leaf", "tampered", "place", F.floor(F.col("place") / size).alias("block"), (F.col("all") > size).alias("several"))
    names = ["lang", "block", "several", "doc_ids", "leaves", "tampered", "node"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]

    def reduce(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        own = t.column("leaf").to_pylist()
        several = t.column("several")[0].as_py()
        node = levels(own, k if several else None)[-1][0]
        row = (t.column("lang")[0].as_py(), t.column("block")[0].as_py(), several, t.column("doc_id").to_pylist(), own, t.column("tampered").to_pylist(), node)
        return pa.table([pa.array([x], kind) for x, kind in zip(row, kinds)], names=names)

    schema = "lang string, block long, several boolean, doc_ids array<long>, leaves array<string>, tampered array<string>, node string"
    return durable(cut.groupBy("lang", "block").applyInArrow(reduce, schema), "blocks")


def upper(nodes: list[tuple[str | None, int, str]]) -> tuple[str, dict[tuple[str | None, int], tuple[str, list]]]:
    """The root, and for each block (lang, block) its lang's subroot and its suffix: the path from its node to the root."""
    by_lang: dict[str | None, list[str]] = {}
    # NULL first, then by the bytes of the name
    for lang, _, node in sorted(nodes, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1])):
        by_lang.setdefault(lang, []).append(node)
    trees = {lang: levels(own) for lang, own in by_lang.items()}
    top = levels([tree[-1][0] for tree in trees.values()])
    found = {}
    for i, (lang, tree) in enumerate(trees.items()):
        rest = path(top, i)
        for block in range(len(tree[0])):
            found[lang, block] = tree[-1][0], path(tree, block) + rest
    return top[-1][0], found


def manifest(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof (siblings from the leaf up, joined by a comma), proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    rows = numbered(leaves(docs), partitions(spark))
    by_part = durable(rows.groupBy("lang", "part").agg(F.count("*").alias("n")), "parts")
    n, langs = by_part.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct(F.struct("lang"))).first()
    if langs > top:
        raise ValueError(f"{langs} langs; the driver holds a node for each, {top} at most")
    k = max(least, (max(1, -(-n // top)) - 1).bit_length())
    blocks = blocks_of(rows, by_part, k)
    # n / 2^k nodes and one for each lang, so 2 * top + 1 at most
    nodes = [tuple(r) for r in blocks.select("lang", "block", "node").collect()]
    schema = "doc_id long, lang string, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    if not nodes:
        return spark.createDataFrame([], schema)
    root, suffixes = upper(nodes)
    shared = spark.sparkContext.broadcast(suffixes)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, block, several, ids, own, tampered in zip(*(b.column(i).to_pylist() for i in range(6))):
                subroot, rest = shared.value[lang, block]
                tree = levels(own, k if several else None)
                for start in range(0, len(own), ROWS):
                    out = []
                    for at in range(start, min(start + ROWS, len(own))):
                        siblings = path(tree, at) + rest
                        held = [s for s, _ in siblings if s]
                        folded = fold(tampered[at] or own[at], siblings)
                        out.append((ids[at], lang, own[at], subroot, root, ",".join(held), H("".join(held)), folded, folded == root))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *[pa.string()] * 7, pa.bool_()])], names=names)

    packed = blocks.select("lang", "block", "several", "doc_ids", "leaves", "tampered")
    return bounded_batches(packed).mapInArrow(lean(finish), schema)


def report(docs: DataFrame) -> DataFrame:
    return manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
