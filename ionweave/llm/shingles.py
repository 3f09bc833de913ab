"""Hashes of words and word shingles of whole texts, vectorised over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes hashed at once; longer texts are cut at white space.
PIECE = 1 << 21
U64 = np.uint64


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (odd multiplications and shifts)."""
    x = (x + U64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)) * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(31)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(29))


BYTES = _mix(np.arange(256, dtype=U64))
BYTES[65:91] = BYTES[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTES[SPACE] = 0
BASE = U64(0x100000001B3)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    text = np.frombuffer(raw, dtype=np.uint8)
    if not len(text):
        return np.empty(0, U64), np.empty(0, np.int64)
    space = SPACE[text]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, U64), starts
    lengths = np.diff(np.append(starts, len(text)))
    place = np.arange(starts[0], len(text), dtype=np.int64) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BASE, dtype=U64))
    return _mix(np.add.reduceat(BYTES[text[starts[0] :]] * powers[place], starts - starts[0])), starts


def word_hashes(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """The 64-bit hashes of the words of each text (UTF-8, A-Z lower-cased, cut at ASCII white space), in order."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            raw, parts = texts[at], []
            while raw:
                cut = len(raw)
                if cut > PIECE:
                    cut = next((i for i in range(PIECE, len(raw)) if SPACE[raw[i]]), len(raw))
                parts.append(_words(raw[:cut])[0])
                raw = raw[cut:]
            yield np.concatenate(parts)
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) < PIECE) and len(texts[end]) <= PIECE:
            size += len(texts[end]) + 1
            end += 1
        hashes, starts = _words(b" ".join(texts[at:end]))
        ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))
        at = end


WEIGHTS = _mix(np.arange(1, 65, dtype=U64), 7) | U64(1)


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of fewer words, one hash of them all; of none, empty."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    total = np.zeros(n - width + 1, dtype=U64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * WEIGHTS[k]
    return np.unique(_mix(total, width))


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    one, two = _mix(shingles, 11).sum(dtype=U64), _mix(shingles, 13).sum(dtype=U64)
    return int(np.int64(one.astype(np.int64))), int(np.int64(two.astype(np.int64)))


def minhashes(sets: Sequence[np.ndarray], count: int) -> np.ndarray:
    """(len(sets), count) 32-bit minimum hashes; no set may be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    flips, factors = _mix(np.arange(count, dtype=U64), 17), _mix(np.arange(count, dtype=U64), 19) | U64(1)
    out = np.empty((len(sets), count), dtype=np.int32)
    for k in range(count):
        low = np.minimum.reduceat((flat ^ flips[k]) * factors[k], starts)
        out[:, k] = (_mix(low, 23) >> U64(32)).astype(np.uint32).view(np.int32)
    return out
