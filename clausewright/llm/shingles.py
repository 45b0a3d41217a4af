"""Word shingles and their universal-hash minima, in numpy, for use inside tasks.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. All functions
work on whole texts; a null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text hashed at a time (a longer text is still taken whole).
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of many texts: a polynomial in the word's bytes, modulo 2^64, then mixed."""

    def __init__(self, blank: np.ndarray = _BLANK):
        """``blank`` says of each byte whether it stands between words."""
        self.blank = blank
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, CHUNK_BYTES) + 1
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("powers", _BASE), ("inverses", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in order, the first word of each text (and the end), and each word's first byte and end in the joined texts."""
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self._grow(len(joined) + 1)
        blank = self.blank[joined]
        edges = np.flatnonzero(np.diff(blank, prepend=True))
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((_LOWER[joined].astype(np.uint64) + np.uint64(1)) * self.powers[: len(joined)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return hashes, np.searchsorted(starts, begins), starts, ends


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8, about CHUNK_BYTES at a time, with the index of the first of each chunk."""
    begin, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        held.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words in order; of the whole sequence if it is shorter; none without words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    count = len(hashes) - size + 1
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + hashes[k : k + count]
    return mix(out + np.uint64(size))


def shingle_sets(texts: list[str | None], size: int, hasher: WordHasher) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text."""
    out = []
    for _, raw in chunks(texts):
        hashes, firsts, _, _ = hasher(raw)
        out += [np.unique(shingles(hashes[firsts[i] : firsts[i + 1]], size)) for i in range(len(raw))]
    return out


class Minima:
    """``count`` minima of strongly universal multiply-add-shift hashes (32-bit keys, 64-bit arithmetic)."""

    def __init__(self, count: int, seed: int = 20):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.factor = draw.integers(1, 2**64, count, dtype=np.uint64, endpoint=False) | np.uint64(1)
        self.offset = draw.integers(0, 2**64, count, dtype=np.uint64, endpoint=False)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima for each set, none of which is empty."""
        out = np.empty((len(sets), len(self.factor)), np.uint32)
        begin = 0
        while begin < len(sets):  # about 2^16 shingles at a time stay in the processor's cache
            end, total = begin, 0
            while end < len(sets) and (end == begin or total + len(sets[end]) <= 1 << 16):
                total += len(sets[end])
                end += 1
            keys = np.concatenate(sets[begin:end]) >> np.uint64(32)
            starts = np.cumsum([0, *map(len, sets[begin : end - 1])])
            for k in range(len(self.factor)):
                values = ((keys * self.factor[k] + self.offset[k]) >> np.uint64(32)).astype(np.uint32)
                out[begin:end, k] = np.minimum.reduceat(values, starts)
            begin = end
        return out


class Bands:
    """Keys of ``count`` bands; band j hashes ``rows`` of the minima, chosen for it once and for all."""

    def __init__(self, count: int, rows: int, minima: int, seed: int = 21):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.chosen = np.array([np.sort(draw.permutation(minima)[:rows]) for _ in range(count)])

    def of(self, minima: np.ndarray) -> np.ndarray:
        keys = np.zeros((len(minima), len(self.chosen)), np.uint64)
        for r in range(self.chosen.shape[1]):
            keys = mix(keys * _MULTIPLIER + minima[:, self.chosen[:, r]].astype(np.uint64))
        return mix(keys + np.arange(1, len(self.chosen) + 1, dtype=np.uint64))


def sketch(minima: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen to a signed 64-bit word: equal minima give equal nibbles."""
    nibbles = (mix(minima.astype(np.uint64)) & np.uint64(15)).reshape(len(minima), -1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
