"""Words of many texts at once, as numpy arrays.

Texts are handled as UTF-8 bytes with A-Z lower-cased; a word class is a set of bytes,
so that it must treat all bytes from 0x80 alike. A word's hash is a polynomial over its
bytes modulo 2^64, taken from running sums, and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are joined up to so many bytes; a longer text is cut between words.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: [^\x20\x09-\x0D]+
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z have been lower-cased: digits, a-z, not ASCII
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        steps = np.full(max(n, CHUNK + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = got = np.multiply.accumulate(steps)
        if n > 4 * CHUNK:  # not kept: one word of that length is no normal case
            del _powers[kind]
    return got[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of consecutive texts: ``start``, ``end`` in ``data``, ``hash``, and ``first``.

    Text i has the words first[i] ... first[i + 1] - 1.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray, hashes: bool = True):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        raw = b"\n".join([*texts, b""]).lower()
        self.data = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = table[self.data]
        edge = np.diff(inside, append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.bounds)
        self.hash = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power("up", len(self.data)), out=self.sums[1:])
        return self.hash_to(self.end)

    def hash_to(self, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each word's start to ``end``."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return mix64((self.sums[end] - self.sums[self.start]) * _power("down", len(self.data))[self.start])

    def beginnings(self, n: int) -> np.ndarray:
        """Hashes of each word's first ``n`` bytes; other than those of words of n bytes."""
        return self.hash_to(np.minimum(self.start + n, self.end)) ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def to_bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def packs(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together, one text at least."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)
