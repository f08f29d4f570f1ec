"""A compressed full-text index over words, and the windows of streamed texts that it holds twice, by backward search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

class Bits:
    """A bit vector with rank, of under 2^32 bits: a 32-bit count for each word of 64."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)])[:-1].astype(np.uint32)
        self.zeros = len(bit) - int(np.count_nonzero(bit))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        return self.around(at)[0]

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each place, and the bit there as the lowest of a word."""
        word, within = at >> 6, (at & 63).astype(np.uint64)
        bits = self.words[word]
        below = bits & ((np.uint64(1) << within) - np.uint64(1))
        return self.ones[word].astype(np.int64) + np.bitwise_count(below), bits >> within


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's code: a frequent symbol's is short. Their powers of a half add up to 1 at most."""
    exact = -np.log2(counts / counts.sum())
    length = np.maximum(1, np.ceil(exact - 1e-9)).astype(np.int64)
    # what rounding up has left goes to those that it cost most
    order = np.argsort(exact - length, kind="stable")
    order = order[length[order] > 1]
    spent = np.cumsum(0.5 ** length[order])
    length[order[spent <= 1 - (0.5**length).sum() + 1e-12]] -= 1
    return length


def codes(length: np.ndarray) -> np.ndarray:
    """Prefix-free codes such that the symbols whose codes end at a level come last in that level's order of the matrix."""
    out = np.zeros(len(length), np.int64)
    nodes = np.zeros(1, np.int64)
    for level in range(1, int(length.max(initial=0)) + 1):
        nodes = np.concatenate([nodes << 1, (nodes << 1) | 1])
        ends = np.flatnonzero(length == level)
        longer = length[length > level]
        inner = int(np.ceil((0.5 ** (longer - level)).sum() - 1e-9)) if len(longer) else 0
        out[ends] = nodes[len(nodes) - len(ends) :]
        nodes = nodes[:inner]
    return out


class WaveletMatrix:
    """Rank of any symbol in a sequence, in as many levels as the symbol's code has bits."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        counts = np.bincount(symbols, minlength=alphabet)
        self.length = code_lengths(np.maximum(counts, 1))
        self.code = codes(self.length)
        self.levels: list[Bits] = []
        s = symbols
        for level in range(int(self.length.max(initial=0))):
            bit = (self.code[s] >> (self.length[s] - 1 - level)) & 1
            self.levels.append(Bits(bit))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
            s = s[self.length[s] > level + 1]  # those that end here are the last

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where places lead that follow the symbol's bits, and whether the symbol is at the place.

        A place's rank is how far it ends behind where 0 does.
        """
        code, left = self.code[symbol], self.length[symbol]
        out, there = np.empty(len(at), np.int64), np.empty(len(at), bool)
        live, same = np.arange(len(at)), np.ones(len(at), bool)
        for bits in self.levels:
            if not len(live):
                break
            left = left - 1
            want = (code >> left) & 1
            ones, bit = bits.around(at)
            at = np.where(want == 1, bits.zeros + ones, at - ones)
            same &= (bit & np.uint64(1)).astype(np.int64) == want
            more = left > 0
            if not more.all():
                end = live[~more]
                out[end], there[end] = at[~more], same[~more]
                live, code, left, at, same = live[more], code[more], left[more], at[more], same[more]
        return out, there


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes, each of which is compared up to the end of its segment only; ends differ from each other."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        key = rank * (n + len(ends) + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)  # equal keys get one rank
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, 2 * step


class FMIndex:
    """Segments of words, each closed by an end of its own, as the wavelet matrix of their Burrows-Wheeler transform.

    heavy tells which segments stand for several places. The text isn't kept: words are known by the sorted alphabet.
    """

    def __init__(self, segments: list[np.ndarray], heavy: np.ndarray | None = None):
        sizes = np.array([len(s) + 1 for s in segments])
        ends = np.cumsum(sizes) - 1
        self.n = int(sizes.sum())
        inside = np.ones(self.n, bool)
        inside[ends] = False
        self.alphabet, symbol = np.unique(np.concatenate(segments), return_inverse=True)
        text = np.zeros(self.n, np.int64)  # 0 closes a segment
        text[inside] = symbol + 1
        order = suffix_order(text, ends)
        many = np.zeros(len(segments), bool) if heavy is None else heavy
        self.heavy = np.packbits(np.repeat(many, sizes)[order], bitorder="little")
        n = len(self.alphabet) + 1
        self.wavelet = WaveletMatrix(text[order - 1], n)
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))[:-1]])
        symbols = np.arange(n)
        # a symbol's first suffix, less where its place 0 leads: added to where a place leads, this is the backward step
        self.shift = first - self.wavelet.descend(symbols, np.zeros(n, np.int64))[0]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The words' symbols, 0 of a word that the index doesn't hold."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffixes that begin with symbol and go on as those in [lo, hi) do."""
        wide = np.flatnonzero(hi - lo != 1)
        # one suffix goes on as one or as none
        to, there = self.wavelet.descend(np.concatenate([symbol, symbol[wide]]), np.concatenate([lo, hi[wide]]))
        a, b = to[: len(lo)], to[: len(lo)] + there[: len(lo)]
        b[wide] = to[len(lo) :]
        shift = self.shift[symbol]
        return shift + a, shift + b

    def several(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the suffixes in [lo, hi) stand for two places or more."""
        at = np.minimum(lo, self.n - 1)
        return (hi - lo >= 2) | ((hi - lo == 1) & ((self.heavy[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    def repeated(self, texts: list[np.ndarray], size: int) -> Iterator[np.ndarray]:
        """For each streamed text, which of its windows of so many words stand for several places of the index.

        A text is first read backward from its end as far as what is read does: all windows within do. Then, from its start,
        stretches that begin with a window are tried, each twice as long as the last that did; where one fails at a
        word, windows that hold the same words fail, too.
        """
        lengths = np.array([len(x) for x in texts])
        ends = np.cumsum(lengths)
        text = self.symbols(np.concatenate(texts)) if len(texts) else np.zeros(0, np.int64)
        begin, last = ends - lengths, ends - size  # of the windows
        marks = [np.zeros(max(0, n - size + 1), bool) for n in lengths.tolist()]
        lane = np.flatnonzero(last >= begin)
        # a lane reads from place `end` down to `stop`, the first window's start, for `stride` windows; goal -1 is the first reading
        end, stop, limit = ends[lane] - 1, begin[lane].copy(), last[lane].copy()
        goal, stride = np.full(len(lane), -1), np.ones(len(lane), np.int64)
        at, lo, hi = end.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64)
        while len(lane):
            lo, hi = self.extend(text[at], lo, hi)
            failed = ~self.several(lo, hi) | (text[at] == 0)
            done = failed | (at == stop)
            if done.any():
                keep = np.ones(len(lane), bool)
                for i in np.flatnonzero(done).tolist():
                    k, bad, first, x = lane[i], bool(failed[i]), int(begin[lane[i]]), int(at[i])
                    whole = x + 1 if bad else x  # from here to end it stands for several
                    if int(end[i]) - whole + 1 >= size:
                        marks[k][whole - first : int(end[i]) - size + 2 - first] = True
                    if goal[i] < 0:
                        limit[i] = min(limit[i], whole - 1)
                        follow, wide = first, 1
                    elif not bad:
                        follow, wide = int(goal[i] + stride[i]), int(2 * stride[i])
                    elif stride[i] > 1:
                        follow, wide = int(goal[i]), 1 if stride[i] == 2 else int(stride[i]) // 2
                    else:
                        follow, wide = x + 1, 1
                    if follow > limit[i]:
                        keep[i] = False
                    else:
                        wide = min(wide, int(limit[i]) - follow + 1)
                        goal[i], stop[i], stride[i], end[i] = follow, follow, wide, follow + size - 2 + wide
                        at[i], lo[i], hi[i] = end[i] + 1, 0, self.n
                if not keep.all():
                    lane, at, goal, stride, limit, stop, end, lo, hi = (y[keep] for y in (lane, at, goal, stride, limit, stop, end, lo, hi))
            at = at - 1
        yield from marks
