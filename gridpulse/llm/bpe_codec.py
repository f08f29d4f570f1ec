"""BPE encoding and decoding of whole texts, equal to the tokenizers library's result, by tree concatenation.

A text is cut into spans of SPAN bytes, wherever that falls, and the spans are encoded each for itself; then
neighbours are joined, pair by pair up a tree. A join re-encodes a window around the cut and lets it grow until its
outermost pieces (text between ASCII white space, which no token of these vocabularies crosses) are those that both sides
had there; what lies beyond is kept. A piece without white space that is longer than a span isn't cut there: its own
tree works on tokens. Leaves of it that the library encodes as one parallel batch are joined by encoding a growing window
around each join, until the window's outer tokens equal those of both sides. A sequence in which every pair of
neighbours is itself an encoding is the encoding of the whole, so agreement on both sides makes the join exact.

Within a span the ids of a piece come from caches of a worker, bounded by bytes. Ids are decoded one by one.

Defined results: null and empty texts have no tokens and decode to the empty text; repeated rows are
encoded each for itself; columns of the input other than the named ones are passed on.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from gridpulse.llm.common import KEPT, bounded_batches, boxed, lean, quoted

#: Bytes of a span; a join's first window has JOIN pieces of each side.
SPAN, JOIN = 1024, 2
#: Leaves of an unbroken piece have LEAF characters; its joins begin with WINDOW tokens, of which MARGIN must agree.
LEAF, WINDOW, MARGIN = 512, 8, 2
#: Bytes of a cache's younger half; pieces of more than SHORT bytes aren't kept in it.
CACHE_BYTES, SHORT = 64 << 20, 64
#: Pieces of printable ASCII and precomposed Latin letters: for them lower() is all that normalising does.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PLAIN_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class TreeEncoder:
    """Encodes one pre-token (in the vocabulary's byte alphabet) by tree concatenation."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.inner = Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0))
        self.final = Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0, end_of_word_suffix=self.suffix or None))
        self.strings = {i: s for s, i in vocab.items()}

    def _text(self, ids: list[int], last: bool) -> str:
        out = "".join(map(self.strings.__getitem__, ids))
        return out[: -len(self.suffix)] if last and self.suffix else out

    def _leaf(self, texts: list[str], last: bool) -> list[list[int]]:
        """One parallel batch; the last text ends the pre-token if last is set."""
        done = [e.ids for e in self.inner.encode_batch(texts[:-1] if last else texts, add_special_tokens=False)]
        return done + ([self.final.encode(texts[-1], add_special_tokens=False).ids] if last else [])

    def encode(self, word: str, leaf: int = LEAF) -> list[int]:
        parts = self._leaf([word[i : i + leaf] for i in range(0, len(word), leaf)], True)
        while len(parts) > 1:
            ends = len(parts) - 1
            parts = [
                self.join(parts[i], parts[i + 1], i + 1 == ends) if i < ends else parts[i] for i in range(0, len(parts), 2)
            ]
        return parts[0]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        n = WINDOW
        while True:
            a, b = min(n, len(left)), min(n, len(right))
            all_left, all_right = a == len(left), b == len(right)
            ends = last and all_right
            text = self._text(left[len(left) - a :] + right[:b], ends)
            new = self._leaf([text], ends)[0]
            m = MARGIN
            if (all_left or new[:m] == left[len(left) - a :][:m]) and (all_right or new[-m:] == right[:b][-m:]):
                return left[: len(left) - a] + new + right[b:]
            n *= 2


class Cache:
    """A map from texts to packed ids in two generations, each bounded by bytes: what is used survives, the rest goes."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.young, self.old, self.size = most, {}, {}, 0

    def put(self, key, value: bytes) -> None:
        self.young[key] = value
        self.size += len(key) + len(value) + 180  # two objects and a place in a dict

    def turn(self) -> None:
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0


class Codec:
    """A tokenizers file with bounded caches from pieces of text to their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = Cache()
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = dict(zip([b for b in range(256) if b not in kept], range(256, 512)))
        rules = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        #: Whether white space only separates, so that pieces between it are encoded each for itself.
        self.cuts = json.dumps(PLAIN_RULE)[1:-1] in rules and '"Removed"' in rules and not any(re.search(r"\s", t) for t in self.added)
        self.plain = self.cuts and '"Lowercase"' in rules and self.tokenizer.model.end_of_word_suffix

    def __enter__(self) -> Codec:
        return self

    def __exit__(self, *_) -> None:
        """A task's cache goes with it: a worker may be idle next, beside one that fills its own."""
        self.pieces = Cache(self.pieces.most)

    @cached_property
    def tree(self) -> TreeEncoder:
        with open(self.path, encoding="utf-8") as f:
            return TreeEncoder(json.load(f))

    @cached_property
    def names(self) -> list[bytes]:
        """What each id decodes to."""
        found = {i: s.encode() for s, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        return [found.get(i, b"") for i in range(max(found) + 1)]

    def _plain(self, piece: str) -> bytes:
        """Ids of a PLAIN piece, word by word; a word by itself is a piece, so one cache holds both."""
        out, young, old = [], self.pieces.young, self.pieces.old
        for word in PLAIN_WORDS.findall(piece.lower()):
            key = word.encode()
            ids = young.get(key)
            if ids is None:
                ids = old.get(key)
                if ids is None:
                    ids = self._word(key)
                if len(key) <= SHORT:
                    self.pieces.put(key, ids)
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _word(self, raw: bytes) -> bytes:
        """Ids of a lower-cased word, which the model takes in the vocabulary's byte alphabet."""
        text = raw.decode("ascii") if raw.isascii() else raw.decode("latin-1").translate(self.bytes)
        return _packed([t.id for t in self.tokenizer.model.tokenize(text)])

    def _long(self, piece: str) -> list[int]:
        ids: list[int] = []
        for part in re.split(f"({'|'.join(self.special)})", piece) if self.special else [piece]:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                part = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    ids += self.tree.encode(word) if len(word) > LEAF else [t.id for t in self.tokenizer.model.tokenize(word)]
        return ids

    def _ids(self, piece: bytes) -> bytes:
        if self.plain and piece.isalpha() and piece.islower() and len(piece) <= LEAF:  # of ASCII letters
            return self._word(piece)
        text = piece.decode()
        if len(piece) > LEAF:
            return _packed(self._long(text))
        if self.plain and PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _leaf(self, raw: bytes) -> tuple[list[bytes], list[bytes]]:
        """The pieces of a span and their ids."""
        pieces = raw.split()
        young, old = self.pieces.young, self.pieces.old
        found = list(map(young.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    p = pieces[i]
                    ids = old.get(p)
                    if ids is None:
                        ids = self._ids(p)
                    if len(p) <= SHORT:
                        self.pieces.put(p, ids)
                    found[i] = ids
            self.pieces.turn()
        return pieces, found

    def _join(self, left: tuple, right: tuple, apart: bool) -> tuple:
        """One node of two; apart: white space is at the cut."""
        n = JOIN
        while True:
            a, b = min(n, len(left[0])), min(n, len(right[0]))
            ends = len(left[0]) - a
            window = b" ".join(left[0][ends:]) + (b" " if apart else b"") + b" ".join(right[0][:b])
            pieces, ids = self._leaf(window)
            same_left = not ends or (pieces[0], ids[0]) == (left[0][ends], left[1][ends])
            same_right = b == len(right[0]) or (pieces[-1], ids[-1]) == (right[0][b - 1], right[1][b - 1])
            if same_left and same_right:
                return left[0][:ends] + pieces + right[0][b:], left[1][:ends] + ids + right[1][b:]
            n *= 2

    def encode(self, text: str | None, span: int = SPAN) -> bytes:
        """Ids of a whole text, as little-endian 32-bit numbers."""
        raw = text.encode() if text else b""
        if not self.cuts:
            return _packed(self.tokenizer.encode(text or "", add_special_tokens=False).ids)
        if len(raw) <= span:
            return b"".join(self._leaf(raw)[1])
        cuts = spans(raw, span)
        nodes = [self._leaf(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        apart = [raw[c - 1] in _SPACE or raw[c] in _SPACE for c in cuts[1:-1]]
        while len(nodes) > 1:
            last = len(nodes) - 1
            nodes = [self._join(nodes[i], nodes[i + 1], apart[i]) if i < last else nodes[i] for i in range(0, len(nodes), 2)]
            apart = apart[1::2]
        return b"".join(nodes[0][1])

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids, as little-endian 32-bit numbers."""
        return map(self.encode, texts)

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids, special tokens included."""
        numbers = struct.unpack(f"<{len(ids) // 4}i", ids)
        if self.tokenizer.decoder is None:  # then the library puts a space between tokens
            return b" ".join(map(self.names.__getitem__, numbers))
        return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()


_SPACE = b" \t\n\r\x0b\x0c"
_NEXT = re.compile(rb"[ \t-\r]")


def spans(raw: bytes, span: int = SPAN) -> list[int]:
    """Where raw is cut: every span bytes, before a character; not within a piece that goes on for longer than a span."""
    cuts, at = [0], span
    while at < len(raw):
        while raw[at] & 0xC0 == 0x80:
            at -= 1
        gap = _NEXT.search(raw, at)
        end = gap.start() if gap else len(raw)
        if end - at > span:  # the whole rest of an unbroken piece, from the white space before it
            if end >= len(raw):
                break
            at = end
        cuts.append(at)
        at += span
    return [*cuts, len(raw)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


KEPT["codec"] = codec.cache_clear


def _lists(raw: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in raw], dtype=np.int64)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raw))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", rows: int = 256) -> DataFrame:
    """docs without text, with ids: array of int. Narrow, in blocks of so many rows."""
    return _mapped(docs, path, text, rows, {ids: T.ArrayType(T.IntegerType())}, lambda c, t: [_lists(list(c.ids(t)))])


def encode_decode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", rows: int = 256
) -> DataFrame:
    """encode(), and beside the ids what they decode to: decode() of the ids in the same pass."""

    def both(c: Codec, texts: list[str | None]) -> list[pa.Array]:
        done = list(c.ids(texts))
        return [_lists(done), pa.array(map(c.decode, done), pa.binary()).cast(pa.string())]

    return _mapped(docs, path, text, rows, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, both)


def decode(coded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", rows: int = 256) -> DataFrame:
    """coded without ids, with the text that they decode to, special tokens included; null or no ids give the empty text."""

    def back(c: Codec, rows_: list[list[int] | None]) -> list[pa.Array]:
        return [pa.array([c.decode(_packed(x or [])) for x in rows_], pa.binary()).cast(pa.string())]

    return _mapped(coded, path, ids, rows, {decoded: T.StringType()}, back)


def _mapped(df: DataFrame, path: str, source: str, rows: int, new: dict[str, T.DataType], work) -> DataFrame:
    row, back = boxed(df, source, *new)
    held = df.select(F.col(quoted(source)).alias("source"), row)
    names = ["row", *(f"new{i}" for i in range(len(new)))]
    schema = T.StructType([held.schema["row"], *(T.StructField(f"new{i}", t) for i, t in enumerate(new.values()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path) as c:
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    batch = whole.slice(at, rows)
                    yield pa.RecordBatch.from_arrays([batch.column(1), *work(c, batch.column(0).to_pylist())], names=names)

    done = bounded_batches(held).mapInArrow(lean(run, "codec"), schema)
    return done.select(*back, *[F.col(f"new{i}").alias(c) for i, c in enumerate(new)])
