"""Word shingles of many texts at once: as 128-bit hashes of their words' digests, or exactly, and fast similarity sketches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
_STEP = 0x9E3779B97F4A7C15
#: Bytes of text that are taken apart at once, and of words whose digests a worker remembers.
CHUNK_BYTES, MEMORY_BYTES = 1 << 19, 24 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit (splitmix64's finaliser)."""
    x = x + U(_STEP)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Numbers(dict):
    """Words by the order in which they were first met, from 1 on; 0 is no word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Digests:
    """Keyed 128-bit digests of words, remembered up to a number of bytes; two columns of 64 bits."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers, self.known, self.held = Numbers(), 1, 0
        self.values = np.zeros((1 << 14, 2), U)

    def update(self) -> np.ndarray:
        """The digests of all numbered words, by number."""
        new = list(self.numbers)[self.known - 1 :] if len(self.numbers) >= self.known else []
        if new:
            end = self.known + len(new)
            while end > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            raw = b"".join(hashlib.blake2b(w, digest_size=16, key=b"shingles").digest() for w in new)
            self.values[self.known : end] = np.frombuffer(raw, U).reshape(-1, 2)
            self.known, self.held = end, self.held + sum(map(len, new)) + 100 * len(new)
        return self.values


def _numbered(texts: list[bytes], numbers: Numbers, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers, text after text, and where each text begins (n+1).

    A-Z is lower-cased and words end at 0x20 and 0x09 to 0x0D: what bytes.lower and bytes.split do. A text with
    fewer than ``words`` words, but some, is filled up with 0, so that all of it is one shingle.
    """
    number, parts, begins = numbers.__getitem__, [], [0]
    for text in texts:
        found = text.lower().split()
        own = np.zeros(max(len(found), words if found else 0), np.int64)
        own[: len(found)] = np.fromiter(map(number, found), np.int64, len(found))
        parts.append(own)
        begins.append(begins[-1] + len(own))
    return np.concatenate(parts), np.array(begins)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= CHUNK_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def shingle_hashes(texts: list[bytes], words: int = 5, digests: Digests | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text two sorted arrays of its distinct shingles' 64-bit hashes, which are independent of one another.

    A hash is a mixed sum of the words' digests with a factor for each place; the digests aren't linear in the bytes.
    """
    digests = digests or Digests()
    factors = mix(np.arange(2 * words, dtype=U).reshape(2, words)) | U(1)
    for part in _chunks(texts):
        numbers, begins = _numbered(part, digests.numbers, words)
        values = digests.update()
        n = max(len(numbers) - words + 1, 0)
        lanes = []
        for lane in (0, 1):
            of, total = values[:, lane][numbers], np.zeros(n, U)
            for k in range(words):
                total += of[k : k + n] * factors[lane, k]
            lanes.append(mix(total))
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            own = slice(a, max(b - words + 1, a))
            yield np.unique(lanes[0][own]), np.unique(lanes[1][own])
        if digests.held > MEMORY_BYTES:
            digests.clear()


def exact_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers that are equal for equal words only: nothing is hashed."""
    if not texts:
        return []
    known = Numbers()
    numbers, begins = _numbered(texts, known, words)
    n, size = max(len(numbers) - words + 1, 0), len(known) + 1
    code, span = numbers[:n].copy(), size
    for k in range(1, words):
        if span > (1 << 62) // size:
            code = np.unique(code, return_inverse=True)[1]
            span = int(code.max(initial=0)) + 1
        code = code * size + numbers[k : k + n]
        span *= size
    return [np.unique(code[a : max(b - words + 1, a)]) for a, b in zip(begins[:-1], begins[1:], strict=True)]


@lru_cache(maxsize=4)
def _seeds(bins: int) -> np.ndarray:
    return mix(mix(np.arange(2 * bins, dtype=U) + U(0x5EED)))


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch: ``bins`` coordinates, two sets agreeing in each with probability of their similarity.

    In each of the first ``bins`` rounds every element falls into a hashed bin; round ``bins + k`` puts all into
    bin k, so every bin fills. A coordinate is the least (round, value) of its bin. Later rounds can't change a
    full bin, so as many rounds are taken at once as will most likely fill all.
    """
    n, seeds = len(shingles), _seeds(bins)
    out = np.full(bins, np.iinfo(U).max, U)
    first, balls = 0, int(bins * (np.log(bins) + 2.5))
    while first < 2 * bins:
        last = min(2 * bins, first + max(1, -(-balls // n)))
        h = mix(shingles[None, :] ^ seeds[first:last, None])
        rounds = np.arange(first, last)
        at = np.where((rounds < bins)[:, None], ((h & U(0xFFFFFFFF)) * U(bins) >> U(32)).astype(np.int64), (rounds - bins)[:, None])
        value = (rounds.astype(U)[:, None] << U(52)) | (mix(h) >> U(12))
        np.minimum.at(out, at.ravel(), value.ravel())
        if out.max() < np.iinfo(U).max:
            break
        first = last
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """One key per band of coordinates, different between bands, as signed words."""
    rows = mix(coordinates).reshape(bands, -1)
    factors = mix(np.arange(1, rows.shape[1] + 1, dtype=U)) | U(1)
    return mix((rows * factors).sum(axis=1) + np.arange(bands, dtype=U) * U(_STEP)).astype(np.int64)
