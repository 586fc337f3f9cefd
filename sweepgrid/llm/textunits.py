"""Texts of a batch as NumPy arrays: bytes, words, and prefix polynomial hashes."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Two bases, for two hashes that have nothing in common.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: A random value for each byte, so that the polynomial sees no structure of the code table.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[tuple[str, int], np.ndarray] = {}


def powers(n: int, kind: str = "up", which: int = 0) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kind down: of the inverse)."""
    have = _powers.get((kind, which))
    if have is None or len(have) < n:
        base = BASES[which] if kind == "up" else pow(BASES[which], -1, 1 << 64)
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= 1 << 22:
            _powers[kind, which] = have
    return have[:n]


def prefix_hashes(values: np.ndarray, which: int = 0) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i:j] times base**position.

    Modulo 2**64 such sums are equal for some pairs of sequences of 1,024 and more values, whatever the base:
    for spans of unbounded length, and for words, they only propose.
    """
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), which=which), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each span that depends on its content alone."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix), "down", which)[start]
    return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


#: Positions of a word whose byte values are kept in a table; those further on are worked out.
NEAR = 64
SALTS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


def _at_position(place: np.ndarray, byte: np.ndarray, salt: int) -> np.ndarray:
    """An independent random value for each byte at each position of a word."""
    return mix64(mix64((place.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)) + np.uint64(salt)) ^ np.uint64(salt))


NEAR_VALUES = [_at_position(np.repeat(np.arange(NEAR), 256), np.tile(np.arange(256), NEAR), salt) for salt in SALTS]


class Words:
    """The words of some texts: h (64-bit hashes), doc (index of the text), start, end (bytes in data).

    A hash is the sum of a random value for each of the word's bytes by their positions. No two positions
    have a value in common, so it has none of the collisions of polynomials on long words.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join(texts)
        if lower:
            self.data = self.data.lower()
        raw = np.frombuffer(self.data, np.uint8)
        space = (raw == 32) | (raw - np.uint8(9) <= 4)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
        self.start, self.end = edge[0::2], edge[1::2]
        self.n_docs = len(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_start = np.concatenate(([0], np.cumsum(size + 1)))
        first = np.searchsorted(self.start, self.doc_start)
        first[-1] = len(self.start)
        self.first = first  # of each text's words; n_docs + 1 values
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(first))
        self.h = self.hashes()

    def hashes(self, which: int = 0) -> np.ndarray:
        """One of two independent hashes of the words."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        before = np.cumsum(size) - size
        at = np.arange(int(size.sum()))
        place = at - np.repeat(before, size)
        byte = np.frombuffer(self.data, np.uint8)[place + np.repeat(self.start, size)]
        near = np.minimum(place, NEAR - 1) << 8 | byte
        value = NEAR_VALUES[which][near]
        if size.max() > NEAR:
            far = np.flatnonzero(place >= NEAR)
            value[far] = _at_position(place[far], byte[far], SALTS[which])
        return mix64(np.add.reduceat(value, before) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def as_listed(self, listed: np.ndarray) -> np.ndarray:
        """Whether each word has the bytes of the word listed for it (by index)."""
        size = self.end - self.start
        raw = np.frombuffer(self.data + bytes(8), np.uint8)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the bytes from each place on, as one number
        head = eight[self.start] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.maximum(8 - size, 0)).astype(np.uint64))
        out = (size == size[listed]) & (head == head[listed])
        some = np.flatnonzero(out & (size > 8) & (listed != np.arange(len(listed))))
        if len(some):
            rest = size[some] - 8
            before = np.cumsum(rest) - rest
            place = np.arange(int(rest.sum())) - np.repeat(before, rest) + 8
            differs = raw[place + np.repeat(self.start[some], rest)] != raw[place + np.repeat(self.start[listed[some]], rest)]
            out[some] = ~np.logical_or.reduceat(differs, before)
        return out


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of all runs of k words; a shorter text that has words is one run."""
    h, n = words.h, len(words.h)
    runs = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        runs += h[j : n - k + 1 + j] * np.uint64(2 * j * j + 6 * j + 0x51ED27 | 1)
    whole = words.doc[: max(n - k + 1, 0)] == words.doc[k - 1 :] if n >= k else np.zeros(0, bool)
    doc, hash_ = words.doc[: len(runs)][whole], mix64(runs[whole])
    length = np.diff(words.first)
    short = np.flatnonzero((length > 0) & (length < k))
    if len(short):
        some = [mix64(np.add.accumulate(h[words.first[d] : words.first[d + 1]] * np.arange(3, 3 + 2 * length[d], 2, dtype=np.uint64))[-1:]) for d in short]
        doc, hash_ = np.concatenate([doc, short]), np.concatenate([hash_, *some])
        order = np.argsort(doc, kind="stable")
        doc, hash_ = doc[order], hash_[order]
    return doc, hash_
