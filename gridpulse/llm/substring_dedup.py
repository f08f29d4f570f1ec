"""Substring dedup by compressed FM-indices, one per shard.

A window is SIZE consecutive words of one document; a word goes if a window that covers it has the words of a window
starting anywhere else. Windows are gathered into segments, the runs of windows with one minimizer (the least hash
of K words in the window), so that equal windows have equal minimizers and meet in one shard.

1. Segments whose minimizer no other segment has are done. Equal segments are one, which stands for its places; all that have
   several places, or share their minimizer with different ones, go on.
2. Each shard indexes its distinct segments once, and streams all of them against the index: backward search over a
   wavelet matrix gives how far each match that stands for several places reaches, and intervals of SIZE words or more are
   reported.
3. A minimizer that more than HOT different segments share would be one task's work: such segments are cut into their windows,
   which are dealt by their own words and then go the same way.
4. The reported intervals return to their documents, whose other words stay.

Texts move only where a document takes part, once to cut segments out and once to drop words.

Defined results: null and empty texts have no words; a repeated row is another place of all its windows; texts
shorter than a window stay whole; rows that share a doc_id are told apart by their texts; columns of the input with the
names of the output are replaced, others of any name are kept. Words and segments are
compared by 64-bit hashes up to the index, which compares word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm.common import bounded_batches, durable, lean, partitions
from gridpulse.llm.fm_index import FMIndex
from gridpulse.llm.ngram_join import Bits, needed_bits
from gridpulse.llm.shingles import FACTOR, Powers, inverse, mixed, runs, word_hashes

SIZE, K, MOST = 35, 8, 64
#: Words of an index, different segments of a minimizer, texts at once, and segments that are searched in step.
SHARD_WORDS, HOT, ROWS, TOGETHER = 1 << 19, 1 << 14, 1024, 1 << 14


def segments(words: np.ndarray, up: Powers, down: Powers) -> tuple[np.ndarray, ...]:
    """(minimizer, hash, start, windows, twice) of each segment; twice: a window occurs twice in the document."""
    n = len(words) - SIZE + 1
    least = runs(words, K)
    span = 1
    wide = SIZE - K + 1
    while 2 * span <= wide:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if wide > span:
        least = np.minimum(least[: n], least[wide - span : wide - span + n])
    new = np.concatenate([[True], least[1:] != least[:-1]])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    if length.max() > MOST:  # long runs, of repeated words, in parts
        parts = -(-length // MOST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, length = np.repeat(start, parts) + nth * MOST, np.minimum(np.repeat(length, parts) - nth * MOST, MOST)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up(len(words)))])
    back = down(len(words))
    whole = mixed((sums[start + length + SIZE - 1] - sums[start]) * back[start]) ^ length.astype(np.uint64)
    window = (sums[SIZE:] - sums[:-SIZE]) * back[:n]
    seen, count = np.unique(window, return_counts=True)
    if len(seen) < n:
        again = np.isin(window, seen[count > 1])
        twice = np.add.reduceat(again, start) > 0
    else:
        twice = np.zeros(len(start), bool)
    return least[start], whole, start, length, twice


def all_segments(docs: DataFrame) -> DataFrame:
    names = ["least", "whole", "doc_id", "th", "start", "windows", "twice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = Powers(FACTOR), Powers(inverse(FACTOR))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b, out = whole.slice(at, ROWS), []
                ids, hashes = (b.column(k).fill_null(0).to_numpy() for k in (0, 1))
                for i, text in enumerate(b.column(2).to_pylist()):
                    w = word_hashes((text or "").encode())
                    if len(w) >= SIZE:
                        least, seg, start, length, twice = segments(w, up, down)
                        k = len(start)
                        out.append((least.view(np.int64), seg.view(np.int64), np.full(k, ids[i]), np.full(k, hashes[i]), start.astype(np.int32), length.astype(np.int32), twice))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    return docs.mapInArrow(lean(run), "least long, whole long, doc_id long, th long, start int, windows int, twice boolean")


def windows_of(texts: DataFrame) -> DataFrame:
    """(window, least, whole, nth, places) of each window of the parts of texts: its hash, its segment, its place there."""
    names = ["window", "least", "whole", "nth", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = word_hashes(text.encode())
                for p in parts:
                    own = runs(w[p["start"] : p["start"] + p["windows"] + SIZE - 1], SIZE).view(np.int64)
                    k = len(own)
                    data = own, np.full(k, p["least"]), np.full(k, p["whole"]), np.arange(k, dtype=np.int32), np.full(k, p["places"])
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, data)), names=names)

    return texts.select("text", "parts").mapInArrow(lean(run), "window long, least long, whole long, nth int, places long")


def masks(found: DataFrame) -> DataFrame:
    """(least, whole, mask) from (least, whole, windows, nths): the places of a segment's repeated windows as packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for k, nths in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                on = np.zeros(k, bool)
                on[nths] = True
                made.append(np.packbits(on).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["least", "whole", "mask"])

    return found.select("least", "whole", "windows", "nths").mapInArrow(lean(run), "least long, whole long, mask binary")


def contents(texts: DataFrame) -> DataFrame:
    """(least, whole, places, words) cut from texts with parts: the list of their segments to index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = text.encode().split()
                for i in range(0, len(parts), ROWS):
                    rows = [(p["least"], p["whole"], p["places"], b" ".join(w[p["start"] : p["start"] + p["windows"] + SIZE - 1])) for p in parts[i : i + ROWS]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["least", "whole", "places", "words"])

    return texts.select("text", "parts").mapInArrow(lean(run), "least long, whole long, places long, words binary")


def search(contents_: DataFrame, n: int) -> DataFrame:
    """(least, whole, mask): the repeated windows of each segment that has any, as packed bits; NULL: all of them.

    A minimizer has at most HOT segments of MOST windows, so a shard ends at the next minimizer after SHARD_WORDS words.
    """

    def shard(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([r[3].count(b" ") + 1 for r in rows])
        texts = np.split(word_hashes(b" ".join([r[3] for r in rows])), ends[:-1])
        index = FMIndex(texts, np.array([r[2] > 1 for r in rows]))
        for i in range(0, len(rows), TOGETHER):
            marks = index.repeated(texts[i : i + TOGETHER], SIZE)
            found = [(r[0], r[1], None if m.all() else np.packbits(m).tobytes()) for r, m in zip(rows[i : i + TOGETHER], marks) if m.any()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary()))], names=["least", "whole", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if row[:2] == last:
                    continue
                if size >= SHARD_WORDS and row[0] != last[0]:
                    yield from shard(held)
                    held, size = [], 0
                held.append(row)
                size += row[3].count(b" ") + 2
                last = row[:2]
        if held:
            yield from shard(held)

    dealt = contents_.repartition(n, "least").sortWithinPartitions("least", "whole")
    return dealt.mapInArrow(lean(run), "least long, whole long, mask binary")


def _filtered(docs: DataFrame, bits: Bits) -> DataFrame:
    """Rows whose doc_id may be among those marked."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    at = docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.has(b.column(at).fill_null(0).to_numpy())))

    return docs.mapInArrow(lean(run), docs.schema)


PARTS = "array<struct<start:int,windows:int,mask:binary>>"


def repeated_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, parts): for documents with repeated windows, their segments; th is the text's hash."""
    n = partitions(bounded_batches(docs).sparkSession)
    named = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    rows = durable(all_segments(named), "rows")
    hits = durable(_meeting(rows), "hits")
    distinct = durable(_distinct(hits), "segments")
    kinds = distinct.groupBy("least").agg(F.count("*").alias("k"), F.max("twice").alias("any"))
    kinds = durable(distinct.join(kinds, "least"), "kinds")
    # a segment that is alone under its minimizer is looked up, too, if it has several places: the index stands for them all
    flags = search(contents(_cut(named, kinds.where(f"(k > 1 OR any OR places > 1) AND k <= {HOT}"))), 2 * n)
    hot = kinds.where(F.col("k") > HOT)
    if not hot.isEmpty():
        flags = flags.unionByName(_hot_flags(named, hot, 2 * n))
    marked = hits.join(flags, ["least", "whole"]).groupBy("doc_id", "th")
    # a set, as repeated rows of a document have the same segments in the same places
    return durable(marked.agg(F.collect_set(F.struct("start", "windows", "mask")).alias("parts")), "marked")


def _cut(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts that hold the wanted segments, with their parts (start, windows, least, whole, places)."""
    part = F.struct(F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), "least", "whole", "places")
    wanted = wanted.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th")).agg(F.collect_list(part).alias("parts"))
    wanted = durable(wanted, "wanted")
    # of rows that share id and text any one will do: their segments are cut once for each, and told once
    return _filtered(named, needed_bits(wanted.select("doc_id"))).join(wanted, ["doc_id", "th"])


def _hot_flags(named: DataFrame, hot: DataFrame, n: int) -> DataFrame:
    """search() for segments of hot minimizers, whose windows are indexed each under its own hash."""
    cut = durable(windows_of(_cut(named, hot)).distinct(), "windows")
    several = cut.groupBy("window").agg(F.sum("places").alias("places"), F.min(F.struct("least", "whole", "nth")).alias("one")).where("places > 1")
    own = several.select("window", "places", "one.*").join(hot.select("least", "whole", "at"), ["least", "whole"])
    at = F.struct(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th"), (F.col("at.start") + F.col("nth")).alias("start"), F.lit(1).alias("windows"))
    found = search(contents(_cut(named, own.select(F.col("window").alias("least"), F.col("window").alias("whole"), "places", at.alias("at")))), n)
    told = cut.join(found.select(F.col("whole").alias("window")), "window").groupBy("least", "whole").agg(F.collect_set("nth").alias("nths"))
    return masks(told.join(hot.select("least", "whole", F.col("at.windows").alias("windows")), ["least", "whole"]))


def _meeting(rows: DataFrame) -> DataFrame:
    """Those of the segments whose minimizer several have, or that hold a window twice."""
    several = rows.groupBy("least").agg(F.sum(F.lit(1) + F.col("twice").cast("int")).alias("c")).where("c > 1").select("least")
    return rows.join(several, "least")


def _distinct(hits: DataFrame) -> DataFrame:
    """Equal segments once, with one of their places and how many there are."""
    return hits.groupBy("least", "whole").agg(
        F.min(F.struct("doc_id", "th", "start", "windows")).alias("at"), F.count("*").alias("places"), F.max("twice").alias("twice")
    )


def covered(n: int, parts: list[dict]) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, np.int32)
    for p in parts:
        k = p["windows"]
        on = np.ones(k, bool) if p["mask"] is None else np.unpackbits(np.frombuffer(p["mask"], np.uint8), count=k).astype(bool)
        at = np.flatnonzero(on) + p["start"]
        edge[at] += 1
        edge[at + SIZE] -= 1
    return np.cumsum(edge[:-1]) > 0


def drop_repeats(docs: DataFrame) -> DataFrame:
    """All columns of docs, and kept_text (kept words joined by a space), n_words and n_removed."""
    parts = repeated_parts(docs)
    extra = {"kept_text": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType()}
    names = [c for c in docs.columns if c not in extra]
    # the other columns are one, so no name of their own can meet those used here; NULL ids are 0 in parts, and texts tell
    # them from a document 0
    others = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row")
    base = docs.select(others, "text", F.xxhash64("text").alias("th"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"))
    ids = parts.select("doc_id")
    bits = needed_bits(ids)
    names_ = ["row", "text", "parts", "doc_id"]
    free = base.withColumn("parts", F.lit(None).cast(PARTS)).select(*names_)
    held = _filtered(base, bits).join(parts, ["doc_id", "th"], "left").select(*names_)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType([*base.select("row", "text").schema, *(T.StructField(k, v) for k, v in extra.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b, kept, total, gone = whole.slice(at, ROWS), [], [], []
                for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    w = (text or "").encode().split()
                    total.append(len(w))
                    if own:
                        out = covered(len(w), own)
                        w = [x for x, o in zip(w, out.tolist()) if not o]
                    gone.append(total[-1] - len(w))
                    kept.append(b" ".join(w))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:2], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                    names=["row", "text", *extra],
                )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows that surely have no parts are chosen and done by one worker
        yield from run(b.filter(pa.array(~shared.value.has(b.column(3).to_numpy()))) for b in batches)

    done = held.mapInArrow(lean(run), schema).unionByName(free.mapInArrow(lean(rest), schema))
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names], *extra)


def report(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words gone from their texts; texts without any, and null texts, are unchanged."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")
    gone = F.col("n_removed") > 0
    new = {"text": F.when(gone, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(gone, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return drop_repeats(row).select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
