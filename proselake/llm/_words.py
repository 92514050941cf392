"""Words and word n-grams of whole texts as keyed fingerprints, vectorised over Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the regular
expression `[^\\x20\\x09-\\x0D]+`. Texts are taken in slices of about SLICE bytes, so memory stays
constant however large an Arrow batch is; a longer text is a slice of its own.

A word's fingerprint is multilinear: each byte is multiplied by the key of its place and the products
are added modulo 2**64. The keys are drawn from a secret that is new in every run (`new_secret`), so
two different words get one fingerprint with a probability of at most 2**-57, whatever the words are;
no pair of words can be built that collides always. A second lane has keys of its own.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import lru_cache
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BLOCK = 1 << 16  # bytes of a word that have keys of their own; blocks of longer words are chained
_rng = np.random.Generator(np.random.PCG64(20240531))
_COEF = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.arange(1, 257, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True


def new_secret() -> int:
    """Key of the fingerprints of one run; every task of the run gets the same."""
    return secrets.randbits(62)


@lru_cache(maxsize=8)
def _keys(secret: int, lane: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[secret, lane])).integers(0, 2**64, BLOCK + 1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _fingerprints(value: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray, secret: int, lane: int) -> np.ndarray:
    """Fingerprint of each word from the values and places of its bytes."""
    keys = _keys(secret, lane)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * keys[place], out=total[1:])
    size = end - begin
    h = total[end] - total[begin]
    for i in np.flatnonzero(size > BLOCK):  # few: each holds BLOCK bytes or more
        cut = np.r_[np.arange(begin[i], end[i], BLOCK), end[i]]
        chain = 0
        for part in (total[cut[1:]] - total[cut[:-1]]).tolist():
            chain = ((chain ^ part) * int(keys[BLOCK]) + part) % ((1 << 61) - 1)
        h[i] = chain
    return mix(h + size.astype(np.uint64) * _COEF[41])


@dataclass
class Slice:
    """Some whole texts: rows `lo` to `hi` of the batch, their words in text order."""

    lo: int
    hi: int
    word: np.ndarray  # fingerprint of each word
    begin: np.ndarray  # byte span of each word in `data`
    end: np.ndarray
    first: np.ndarray  # for each text, the index of its first word; one entry more at the end
    data: np.ndarray
    other: np.ndarray | None = None  # second, independent fingerprint of each word

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.count)

    def ngrams(self, k: int, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the k words from each word on, and which of them lie in one text."""
        word = self.word if word is None else word
        n, m = len(word), max(len(word) - k + 1, 0)
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h += word[j : j + m] * _COEF[j]
        last = np.repeat(self.first[1:], self.count)[:m]
        return mix(h), (np.arange(m) + k <= last) if n else np.zeros(0, bool)

    def _short(self, word: np.ndarray, short: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of the whole sequences of texts of fewer than k words."""
        s = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = self.count[short] > j
            s[has] += word[self.first[short][has] + j] * _COEF[j]
        return mix(s + self.count[short].astype(np.uint64) * _COEF[40])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Distinct k-word shingles: (text, fingerprint), sorted, and the second fingerprint. A text of fewer words has its whole sequence as one."""
        h, whole = self.ngrams(k)
        at = np.flatnonzero(whole)
        text, h = self.text_of[at], h[at]
        other = self.ngrams(k, self.other)[0][at] if self.other is not None else None
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            text, h = np.concatenate([text, short]), np.concatenate([h, self._short(self.word, short, k)])
            other = np.concatenate([other, self._short(self.other, short, k)]) if other is not None else None
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
        return text[new], h[new], other[order][new] if other is not None else None


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_string_view(col.type):
        col = col.cast(pa.string())
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def spans(offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def slices(col: pa.Array, lower: bool, secret: int, lanes: int = 1) -> Iterator[Slice]:
    offs, data = buffers(col)
    table = _LOWER if lower else _BYTE
    for lo, hi in spans(offs):
        base, top = int(offs[lo]), int(offs[hi])
        d, o = data[base:top], offs[lo : hi + 1] - base
        n = len(d)
        if not n:
            none = np.zeros(0, np.int64)
            empty = np.zeros(0, np.uint64)
            yield Slice(lo, hi, empty, none, none, np.zeros(hi - lo + 1, np.int64), d, empty if lanes > 1 else None)
            continue
        begin, end, lane = _words_of(d, o, table, secret, lanes)
        yield Slice(lo, hi, lane[0], begin, end, np.searchsorted(begin, o), d, lane[1] if lanes > 1 else None)


def _words_of(d: np.ndarray, o: np.ndarray, table: np.ndarray, secret: int, lanes: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Byte spans and fingerprints of the words of texts that start at o. A text of many slices is taken in pieces that end at a blank."""
    begins, ends, found, at = [], [], [], 0
    while at < len(d):
        to = len(d)
        if to - at > 2 * SLICE:
            to = at + SLICE
            while to < len(d) and not (blank := _WS[d[to : to + SLICE]]).any():
                to += SLICE
            to = min(len(d), to + int(blank.argmax())) if to < len(d) else len(d)
        begin, end, lane = _piece(d[at:to], o[(o >= at) & (o <= to)] - at, table, secret, lanes)
        begins.append(begin + at)
        ends.append(end + at)
        found.append(lane)
        at = to
    return np.concatenate(begins), np.concatenate(ends), [np.concatenate([x[i] for x in found]) for i in range(lanes)]


def _piece(d: np.ndarray, o: np.ndarray, table: np.ndarray, secret: int, lanes: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    n = len(d)
    ink = ~_WS[d]
    edge = np.ones(n + 1, bool)
    edge[1:n] = ~ink[:-1]
    edge[o[o < n]] = True
    begin = np.flatnonzero(ink & edge[:n])
    stop = np.ones(n, bool)
    stop[: n - 1] = ~ink[1:]
    last = o - 1
    stop[last[last >= 0]] = True
    end = np.flatnonzero(ink & stop) + 1
    since = np.zeros(n, np.int64)
    since[begin] = begin
    place = (np.arange(n) - np.maximum.accumulate(since)) & (BLOCK - 1)
    value = table[d]
    return begin, end, [_fingerprints(value, place, begin, end, secret, i) for i in range(lanes)]
