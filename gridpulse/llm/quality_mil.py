"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE bytes each, all of the text). A passage is encoded by hashed byte trigrams of its
lower-cased text, by how often classes of characters follow each other and by how much it repeats itself; a small network
maps that to a hidden vector, learned gated attention weighs the passages, and the weighted sum is classified. Only the
documents carry labels; which passages matter is learned.

The network is fitted on the driver on a bounded sample: up to PER_CLASS labelled documents of each label,
taken in the order of a hash of doc_id, and weighed so that each label counts as often as among all labelled
rows; of a document with more than BAG passages one of each of BAG equal stretches is learned from. Rows whose
crc32(doc_id as text) mod 3 is 1 are held out. Scoring is one narrow pass over all documents and all their passages, which
are encoded RUN at a time and meet in running sums of the attention, so memory doesn't grow with a text's bag.

Defined results: null and empty texts are one empty passage and get its score; with no labelled row of either
label every score is 0.5; of repeated labels of a doc_id the lowest counts, and of its repeated rows one is learned from; repeated
rows are scored each for itself; a NULL doc_id is not held out, and nothing is learned from it; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm.common import bounded_batches, boxed, first_by_hash, give_back, lean, quoted

PASSAGE, PER_CLASS, BAG = 256, 1500, 32
#: Passages that are encoded at once.
RUN = 2048
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 20, 64, 3e-3, 1e-4
#: Cells of hashed trigrams, what their inputs are divided by, as most cells tell nothing, and a fixed odd factor of the hash.
GRAMS, CALM, MIX = 64, 4, np.uint32(0x9E3779B1)

#: Classes of bytes; every byte outside ASCII is in one of two.
CLASSES = ("aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "$%&#*^~", "()[]{}<>", "\"'`", "-_/\\+=", "@:;")
N_CLASSES = len(CLASSES) + 3
FEATURES = N_CLASSES * (N_CLASSES + 1) + GRAMS + 3


def _class_of() -> np.ndarray:
    table = np.full(256, N_CLASSES - 3, np.int64)
    for k, chars in enumerate(CLASSES):
        for c in chars:
            table[ord(c)] = k
    table[128:192], table[192:] = N_CLASSES - 2, N_CLASSES - 1
    return table


BYTE_CLASS = _class_of()
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


def encode_passages(text: str | None) -> np.ndarray:
    """All passages of a text x FEATURES."""
    return np.concatenate(list(encoded((text or "").encode())))


def encoded(raw: bytes, run: int = RUN) -> Iterator[np.ndarray]:
    """Passages x FEATURES, so many at a time: shares of classes, of pairs of classes and of hashed trigrams, share of distinct
    4-grams and of letters, fill. What begins in a passage counts for it, whether or not it ends there."""
    for at in range(0, max(1, len(raw)), run * PASSAGE):
        yield _encoded(np.frombuffer(raw[at : at + run * PASSAGE + 3], np.uint8), min(run * PASSAGE, len(raw) - at))


def _encoded(raw: np.ndarray, held: int) -> np.ndarray:
    n = max(1, -(-held // PASSAGE))
    out = np.zeros((n, FEATURES), np.float32)
    if not held:
        return out
    cls = BYTE_CLASS[raw]
    at = np.arange(held) // PASSAGE
    size = np.bincount(at, minlength=n).astype(np.float32)[:, None]
    one = np.bincount(at * N_CLASSES + cls[:held], minlength=n * N_CLASSES).reshape(n, -1)
    out[:, :N_CLASSES] = one / size
    k = min(held, len(raw) - 1)
    two = np.bincount(at[:k] * N_CLASSES**2 + cls[:k] * N_CLASSES + cls[1 : k + 1], minlength=n * N_CLASSES**2).reshape(n, -1)
    end = N_CLASSES * (N_CLASSES + 1)
    out[:, N_CLASSES:end] = np.sqrt(two / size)
    w = raw.astype(np.uint32)
    if (k := min(held, len(raw) - 2)) > 0:
        low = LOWER[raw]
        cell = (((low[:k] << 16) | (low[1 : k + 1] << 8) | low[2 : k + 2]) * MIX) >> np.uint32(26)
        out[:, end : end + GRAMS] = np.sqrt(np.bincount(at[:k] * GRAMS + cell, minlength=n * GRAMS).reshape(n, -1) / size)
    out[:, -3] = 1
    if (k := min(held, len(raw) - 3)) > 0:
        grams = (w[:k] << 24) | (w[1 : k + 1] << 16) | (w[2 : k + 2] << 8) | w[3 : k + 3]
        keys = np.sort((at[:k].astype(np.uint64) << np.uint64(32)) | grams)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        seen = np.bincount((keys[new] >> np.uint64(32)).astype(np.int64), minlength=n)
        total = np.bincount(at[:k], minlength=n)
        out[:, -3] = np.where(total > 0, seen / np.maximum(total, 1), 1)
    out[:, -2] = (one[:, 0] + one[:, 1] + one[:, 2] + one[:, -2] + one[:, -1]) / size[:, 0]
    out[:, -1] = size[:, 0] / PASSAGE
    return out


def learned_from(raw: bytes, bag: int = BAG) -> bytes:
    """The whole text, or of a long one a passage of each of so many equal stretches, the middle one."""
    n = -(-len(raw) // PASSAGE)
    if n <= bag:
        return raw
    edges = np.linspace(0, n, bag + 1).astype(int)
    return b"".join(raw[m * PASSAGE : (m + 1) * PASSAGE] for m in (edges[:-1] + edges[1:]) // 2)


class AttentionMIL:
    """h = relu(xW), a = softmax over the bag of (tanh(hV) * sigmoid(hU)) w, score = sigmoid((sum of a h) c)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.p = {
            "W": draw(len(mean), HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
            "w": draw(GATE, 1), "c": draw(HIDDEN, 1), "d": np.zeros(1, np.float32),
        }

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """What each passage is to the network: its inputs, hidden vector, both gates, and its attention before the bag's share."""
        p = self.p
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.maximum(z @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        return z, h, t, g, (t * g) @ p["w"]

    def head(self, m: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(m @ self.p["c"] + self.p["d"], -30, 30))))[:, 0]

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        z, h, t, g, s = self.hidden(x)
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes, axis=0))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes, axis=0)
        m = np.add.reduceat(a * h, starts)
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "m": m, "y": self.head(m)}

    def gradient(self, x, starts, sizes, label, weight) -> dict:
        p, f = self.p, self.forward(x, starts, sizes)
        err = ((f["y"] - label) * weight / len(label))[:, None].astype(np.float32)
        dm = np.repeat(err @ p["c"].T, sizes, axis=0)
        da = (dm * f["h"]).sum(1, keepdims=True)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), sizes, axis=0))
        dtg = ds @ p["w"].T
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (dm * f["a"] + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {
            "W": f["z"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "w": (f["t"] * f["g"]).T @ ds, "c": f["m"].T @ err, "d": err.sum(0),
        }

    def fit(self, bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, seed: int = 11) -> AttentionMIL:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, EPOCHS * -(-len(bags) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                sizes = np.array([len(bags[k]) for k in part])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                grad = self.gradient(np.concatenate([bags[k] for k in part]), starts, sizes, label[part], weight[part])
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for k, g in grad.items():
                    g = g + DECAY * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Short texts meet in blocks of bags; a bag of more than RUN passages goes by itself, in running sums."""
        out = np.zeros(len(texts))
        held: list[np.ndarray] = []
        places: list[int] = []

        def flush() -> None:
            if held:
                sizes = np.array([len(x) for x in held])
                out[places] = self.forward(np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)["y"]
            held.clear()
            places.clear()

        for i, text in enumerate(texts):
            raw = (text or "").encode()
            if len(raw) > RUN * PASSAGE:
                out[i] = self.score_long(encoded(raw))
                continue
            held += encoded(raw)
            places.append(i)
            if sum(map(len, held)) > RUN:
                flush()
        flush()
        return out

    def score_long(self, runs: Iterator[np.ndarray]) -> float:
        """The score of one bag that comes in runs: the attention's sums are scaled by the largest exponent so far."""
        most, total, m = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in runs:
            _, h, _, _, s = self.hidden(x)
            top = max(most, float(s.max()))
            e, keep = np.exp(s - top), np.exp(most - top)
            most, total, m = top, total * keep + float(e.sum()), m * keep + (e * h).sum(0)
        return float(self.head((m / total)[None])[0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> AttentionMIL | None:
    """Fitted on at most 2 x per_class documents of BAG passages; None if a label has no document to learn from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(total) < 2:
        return None
    pick = lambda q: first_by_hash(known.where(F.col("quality") == q), "doc_id", per_class, total[q])
    sample = pick(0).unionByName(pick(1)).withColumnRenamed("doc_id", "_id")
    rows = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "quality", "text")

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [learned_from((t or "").encode()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["doc_id", "quality", "x"])

    # of rows that share a doc_id one is learned from, so 2 x per_class rows of BAG passages reach the driver at most
    one = rows.mapInArrow(lean(shortened), "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    got = one.toArrow().sort_by("doc_id")
    label = got.column("quality").to_numpy().astype(np.float32)
    if not (0 < label.sum() < len(label)):
        return None
    bags = [np.concatenate(list(encoded(x.as_buffer().to_pybytes()))) for x in got.column("x")]
    # moments by bag, so that a few very long texts don't set the scale
    mean = np.mean([x.mean(0) for x in bags], axis=0)
    scale = np.sqrt(np.mean([((x - mean) ** 2).mean(0) for x in bags], axis=0)) + 1e-3
    first = N_CLASSES * (N_CLASSES + 1)
    scale[first : first + GRAMS] *= CALM
    share = {q: total[q] / sum(total.values()) * len(label) / max(1, (label == q).sum()) for q in (0, 1)}
    weight = np.where(label == 1, share[1], share[0]).astype(np.float32)
    model = AttentionMIL(mean.astype(np.float32), scale.astype(np.float32)).fit(bags, label, weight)
    del bags, got
    give_back()  # some 150 MB of the driver's
    return model


def score(docs: DataFrame, model: AttentionMIL | None, text: str = "text", out: str = "score", rows: int = 512) -> DataFrame:
    """docs with the score of each text, between 0 and 1."""
    done, back = _scored(docs, (out,), model, text, rows)
    return done.select(*back, F.col("y").alias(out))


def _scored(docs: DataFrame, without: tuple[str, ...], model: AttentionMIL | None, text: str, rows: int) -> tuple[DataFrame, list[Column]]:
    """(row, y), and what makes docs of row, without some columns."""
    row, back = boxed(docs, *without)
    held = docs.select(row, F.col(quoted(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                y = model.score(b.column(1).to_pylist()) if model else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y, pa.float64())], names=["row", "y"])

    done = bounded_batches(held).mapInArrow(lean(run), T.StructType([held.schema["row"], T.StructField("y", T.DoubleType())]))
    return done, back


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a score of 0.5 or more."""
    scored, back = _scored(docs, (), train(docs, labels), "text", 512)
    return scored.where("y >= 0.5").select(*back)
