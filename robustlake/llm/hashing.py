"""Vectorised hashes of words and substrings, in numpy.

A substring's hash is its polynomial modulo the prime 2^61 - 1: strings of n
symbols meet by chance with a probability of about n / 2^61, and no pattern of
symbols (as there is for powers of two) makes them meet always. ``Rolling`` is
the faster form modulo 2^64, for callers that compare the strings of every
match. Equal hashes are only candidates: operators compare the strings
themselves, or a cryptographic digest of them, before anything is linked or
removed.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

U = np.uint64
_P = (1 << 61) - 1
_LOW32, _LOW29, _PRIME = U((1 << 32) - 1), U((1 << 29) - 1), U(_P)
#: Two independent bases, fixed by the seed.
BASES = [int(x) % _P for x in np.random.default_rng(20_240_101).integers(1 << 58, 1 << 60, 2, dtype=np.uint64)]
#: Symbols between two stored prefix sums. Sums of symbols below 2^21 times half a power stay below 2^64.
CHUNK = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> U(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime."""
    ah, al, bh, bl = a >> U(32), a & _LOW32, b >> U(32), b & _LOW32
    low, middle = al * bl, al * bh + ah * bl
    return _reduced((low & _PRIME) + (low >> U(61)) + ((middle & _LOW29) << U(32)) + (middle >> U(29)) + ((ah * bh) << U(3)))


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low + high * 2^32 modulo the prime."""
    return _reduced((low & _PRIME) + (low >> U(61)) + ((high & _LOW29) << U(32)) + (high >> U(29)))


class _Powers:
    """Powers of a base up to a chunk, and of whole chunks as far as they were asked for."""

    def __init__(self, base: int):
        self._small, self._step = self._row(base, CHUNK), pow(base, CHUNK, _P)
        self._big = np.ones(1, np.uint64)

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        out, at = [], 1
        for _ in range(n):
            out.append(at)
            at = at * base % _P
        return np.array(out, np.uint64)

    def big(self, n: int) -> np.ndarray:
        if len(self._big) < n:
            self._big = self._row(self._step, n)
        return self._big

    def of(self, exponent: np.ndarray) -> np.ndarray:
        chunk = exponent // CHUNK
        big = self.big(int(chunk.max()) + 1 if len(chunk) else 1)
        return _times(self._small[exponent % CHUNK], big[chunk])


_families = [(_Powers(b), _Powers(pow(b, -1, _P))) for b in BASES]


class Substrings:
    """Hashes of substrings of one array of symbols (below 2^20.5): equal ones hash equally wherever they stand."""

    def __init__(self, symbols: np.ndarray, family: int = 0):
        self._powers, self._inverses = _families[family]
        n = len(symbols)
        chunks = n // CHUNK + 1
        grid = np.zeros(chunks * CHUNK, np.uint64)
        np.add(symbols, 1, out=grid[:n], casting="unsafe")  # no symbol is zero
        grid = grid.reshape(chunks, CHUNK)
        small = self._powers._small
        self._low = np.cumsum(grid * (small & _LOW32), axis=1).ravel()
        self._high = np.cumsum(grid * (small >> U(32)), axis=1).ravel()
        big, whole = self._powers.big(chunks), _joined(self._low[CHUNK - 1 :: CHUNK], self._high[CHUNK - 1 :: CHUNK])
        before, total = [], 0
        for x in _times(whole, big[:chunks]).tolist():
            before.append(total)
            total = (total + x) % _P
        self._before, self._big = np.array(before, np.uint64), big

    def _prefix(self, at: np.ndarray) -> np.ndarray:
        chunk = at // CHUNK
        inner = at % CHUNK
        last = np.maximum(at - 1, 0)
        own = np.where(inner > 0, _joined(self._low[last], self._high[last]), U(0))
        return _reduced(self._before[chunk] + _times(own, self._big[chunk]))

    def _plain(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        gap = self._prefix(end) + _PRIME - self._prefix(start)
        return _times(_reduced(gap), self._inverses.of(start))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self._plain(start, end) + (end - start).astype(np.uint64))

    def joined(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Hashes of the symbols a:b run together with the symbols c:d."""
        total = _reduced(self._plain(a, b) + _times(self._plain(c, d), self._powers.of(b - a)))
        return mix(total + (b - a + d - c).astype(np.uint64))


class Rolling:
    """Hashes of byte strings modulo 2^64. Some patterns of bytes always meet: only for matches that are compared."""

    BASE = 0x9E3779B97F4A7C15 | 1
    VALUES = np.random.default_rng(20_240_101).integers(1, 2**64, 256, dtype=np.uint64)

    _powers = _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._powers) <= n:  # as long as the longest step
            Rolling._powers, Rolling._inverses = self._row(self.BASE, n), self._row(pow(self.BASE, -1, 1 << 64), n)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.VALUES[data] * self._powers[:n], out=self._sums[1:])

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        row = np.full(n + 1, U(base))
        row[0] = 1
        return np.multiply.accumulate(row, out=row)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverses[start] + (end - start).astype(np.uint64))


#: Words whose hashes a worker keeps.
KEPT_WORDS = 100_000


class _Hashes(dict):
    """Hashes of words, made when a word is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxh3_64_intdigest(word)
        return found


_word_hashes = _Hashes()


def words_in(text: bytes) -> list[bytes]:
    """The blank-separated words of a text, A-Z lower-cased."""
    return text.lower().split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words; fewer words than a shingle are one, none are the empty set."""
    if len(_word_hashes) > KEPT_WORDS:
        _word_hashes.clear()
    own = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(own))
    if not n:
        return own
    rolled = np.full(len(own) - n + 1, U(n))
    for j in range(n):
        rolled = mix(rolled * U(0xD6E8FEB86659FD93) + own[j : len(own) - n + 1 + j])
    return np.unique(rolled)


def shared_shingles(a: bytes, b: bytes, words: int) -> tuple[int, int, int]:
    """(common, of a, of b): sizes of the shingle sets of two texts, by the words themselves and no hash.

    Words get numbers; the words of a shingle are folded from the left into the number of what they say.
    """
    number: dict[bytes, int] = {}
    both = [np.array([number.setdefault(w, len(number)) for w in words_in(t)], np.int64) for t in (a, b)]
    width = len(number) + 1
    sizes = [min(words, len(ids)) for ids in both]
    shingles = [ids[: len(ids) - n + 1] if n else ids for ids, n in zip(both, sizes)]
    if sizes[0] != sizes[1]:  # a text of fewer words than a shingle shares none with a longer one
        shingles = [np.unique(s) if n == 1 else _folded([ids], n, width)[0] for s, ids, n in zip(shingles, both, sizes)]
        return 0, len(shingles[0]), len(shingles[1])
    x, y = _folded(both, sizes[0], width)
    if not sizes[0]:
        return 0, 0, 0
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def _folded(texts: list[np.ndarray], n: int, width: int) -> list[np.ndarray]:
    """Sorted distinct numbers of the runs of n words of each text; equal runs have equal numbers."""
    if not n:
        return texts
    codes = [ids[: len(ids) - n + 1] for ids in texts]
    for j in range(1, n):
        codes = [c * width + ids[j : len(ids) - n + 1 + j] for c, ids in zip(codes, texts)]
        if j < n - 1:  # small numbers again, common to both
            _, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            codes = np.split(inverse.astype(np.int64), np.cumsum([len(c) for c in codes])[:-1])
    return [np.unique(c) for c in codes]
