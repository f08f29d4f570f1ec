"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, schemes, plus signs, digits and cues of
identifiers. From each anchor a local parser reads the boundaries of an email, an address, a card, a phone
number or an account, and validates it. The base kinds (email, ip, card, phone) are the leftmost
non-overlapping readings of strict grammars; url and account are added by the anchors.

Defined results: null and empty texts have no spans; repeated rows are scanned each for itself; other
columns of the input are passed on. The pass is narrow: no shuffle, one text at a time in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm.common import bounded_batches, boxed, lean, quoted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUADS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'|]+")
#: Between a cue and what it tells of; numbers of accounts and documents, of social security, and of international accounts.
GAP = re.compile(r"[A-Za-z]{0,8}[ .:#=-]{1,4}")
NUMBER = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[A-Z0-9]){5,33}(?![A-Za-z0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for s in SCHEMES:
        for form in {s, s.upper(), s.capitalize()}:
            found.add_word(form, ("scheme", len(form)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _count(text: str) -> int:
    return sum(map(str.isdigit, text))


def iban(text: str, at: int) -> tuple[int, int] | None:
    """The longest reading from there whose check digits are right, up to a boundary."""
    if m := IBAN.match(text, at):
        for end in range(m.end(), at + 14, -1):
            if text[end - 1].isalnum() and not text[end : end + 1].isalnum():
                bare = text[at:end].replace(" ", "").replace("-", "")
                if len(bare) >= 15 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                    return at, end
    return None


def account(text: str, cue: str, at: int) -> tuple[int, int] | None:
    """What a cue tells of, validated: an IBAN by its check digits, a social security number by its parts, else six digits or more."""
    if cue == "ssn":
        m = SSN.match(text, at)
        return m.span() if m else None
    found = iban(text, at)
    if found or cue == "iban":
        return found
    m = NUMBER.match(text, at)
    return m.span() if m and _count(m[0]) >= 6 else None


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # where the next reading of a kind may begin; the end of a reading that failed validation counts, too
    free = dict.fromkeys(KINDS, 0)
    run_end = 0
    for last, (kind, size) in anchors().iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= free["ip"] and at >= run_end:
                if m := QUADS.match(text, at):
                    free["ip"] = m.end()
                    if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                        found["ip"].append(m.span())
                else:
                    run_end = DIGITS.match(text, at).end()
            if at >= free["card"] and (m := CARD.match(text, at)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif kind == "at":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                free["email"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == "plus":
            if at >= free["phone"] and (m := PHONE.match(text, at)):
                free["phone"] = m.end()
                if 8 <= _count(m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "scheme":
            if at >= free["url"] and (at == 0 or not text[at - 1].isalnum()) and (m := URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    free["url"] = end
                    found["url"].append((at, end))
        elif at >= free["account"] and (at == 0 or not text[at - 1].isalnum()) and (m := GAP.match(text, last + 1)):
            if span := account(text, text[at : last + 1].lower(), m.end()):
                free["account"] = span[1]
                found["account"].append(span)
    return [(k, a, b) for k in KINDS for a, b in found[k]]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_personal_data(docs: DataFrame, text: str = "text", spans: str = "spans", rows: int = 1024) -> DataFrame:
    """docs without text, with spans: array of (kind, start, end), in code points, end exclusive."""
    row, back = boxed(docs, text, spans)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = [
                    [{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] if t else []
                    for t in batch.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], names=["row", "found"])

    held = docs.select(row, F.col(quoted(text)).alias("text"))
    schema = T.StructType([held.schema["row"], T.StructField("found", T._parse_datatype_string(SPANS))])
    return bounded_batches(held).mapInArrow(lean(run), schema).select(*back, F.col("found").alias(spans))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
