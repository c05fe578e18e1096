"""Vectorised word hashing over whole texts (numpy, bounded blocks).

A word is a maximal run of bytes other than x20 and x09-x0D of the UTF-8 text.
Word hashes are 64-bit: sum of T[byte] * B**k over the word (T random, B odd),
finished with a mixer, so equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18  #: bytes worked on at once: some tens of arrays of it stay small
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_T = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 2**64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, BLOCK + (1 << 16))
        for base, at in ((_B, 0), (_BINV, 1)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            x = np.cumprod(x)
            if at:
                _inv = x
            else:
                _pow = x
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser on uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def batches(texts: Sequence[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about limit bytes each, one text at least."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def slices(it, rows: int = 1000):
    """Arrow batches in slices of few rows, so that a worker holds few texts as Python objects.
    At the end, what the allocators keep goes back: workers live on, next to other stages' tasks."""
    for batch in it:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def test_bits(packed: bytes, x: np.ndarray) -> np.ndarray:
    """Whether the numbers x are set in a bitmap of 8 * len(packed) bits."""
    at = (x & np.uint64(8 * len(packed) - 1)).astype(np.int64)
    return (np.frombuffer(packed, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer whose last byte is white space."""
    word = (~SPACE[buf]).view(np.int8)
    edge = np.diff(word, prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_T_WORD = np.where(SPACE, np.uint64(0), _T)


def hash_words(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """hash_spans of whole words: white space counts nothing, so sums run from start to start."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    pw, inv = _powers(len(buf) + 1)
    return mix(np.add.reduceat(_T_WORD[buf] * pw[: len(buf)], starts) * inv[starts])


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    pw, inv = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_T[buf] * pw[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts])


def _parts(text: bytes, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Bounds of the parts, of about size bytes each, of a long text; every cut is before white space."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not SPACE[text[cut]]:
            cut += 1
        yield at, cut
        at = cut
    yield at, len(text)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and bounds: text i has words bounds[i]:bounds[i+1]."""
    raw = b"\n".join(texts)
    starts, hashes = [], []
    for at, to in _parts(raw):  # one, but for a long text
        buf = np.frombuffer(raw[at:to] + b"\n", np.uint8)
        own, _ = spans(buf)
        starts.append(own + at)
        hashes.append(hash_words(buf, own))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def table(members: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_ALNUM = table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT = table(range(48, 58))
_NUMERIC = table([*range(48, 58), *b".,:/%-"])
_UPPER = table(range(65, 91))
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


class Words(NamedTuple):
    """Per word of a text: where it starts and ends, its hash, whether it has a digit, is a
    number, starts with its only capital letter, or is more than punctuation, its last byte, and
    the line that it is on."""

    starts: np.ndarray
    ends: np.ndarray
    hash: np.ndarray
    digit: np.ndarray
    number: np.ndarray
    capital: np.ndarray
    some: np.ndarray
    last: np.ndarray
    line: np.ndarray


def _held(places: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each of the spans, which are sorted and apart."""
    out = np.zeros(len(a), np.int64)
    if len(a):
        word = np.searchsorted(a, places, "right") - 1
        inside = (word >= 0) & (places < b[np.maximum(word, 0)])
        out += np.bincount(word[inside], minlength=len(a))
    return out


def scan(raw: bytes, bare: bool = False) -> Words:
    """Words of a text, which may be very long: what takes memory by the byte is done in parts.
    bare: hash words in lower case without outer punctuation, where anything else is left."""
    got, lines = [], 0
    for at, to in _parts(raw):
        buf = np.frombuffer(raw[at:to] + b"\n", np.uint8)
        starts, ends = spans(buf)
        a, b = starts, ends
        some = np.zeros(len(starts), bool)
        if bare and len(own := np.flatnonzero(_ALNUM[buf])):
            x = own[np.minimum(np.searchsorted(own, starts), len(own) - 1)]
            y = own[np.maximum(np.searchsorted(own, ends) - 1, 0)] + 1
            some = (x < ends) & (y > starts) & (x < y)
            a, b = np.where(some, x, starts), np.where(some, y, ends)
        breaks = np.flatnonzero(buf == 10)
        at_digits = np.flatnonzero(_DIGIT[buf])
        digit = _held(at_digits, a, b) > 0
        number, capital = np.zeros(len(a), bool), np.zeros(len(a), bool)
        if bare:
            own = np.flatnonzero(digit)
            size = b[own] - a[own]
            first = np.cumsum(size) - size
            if len(own):  # words with digits, byte by byte
                signs = _NUMERIC[buf[np.arange(int(size.sum())) + np.repeat(a[own] - first, size)]]
                number[own] = np.add.reduceat(signs.astype(np.int64), first) == size
            capital = _UPPER[buf[a]] & (_held(np.flatnonzero(_UPPER[buf]), a, b) == 1)
            hashed = hash_spans(_LOW[buf], a, b)
        else:
            hashed = hash_words(buf, starts)
        got.append((starts + at, ends + at, hashed, digit, number, capital, some, buf[ends - 1], np.searchsorted(breaks, starts) + lines))
        lines += len(breaks) - 1  # the last is not the text's
    return Words(*(np.concatenate(x) for x in zip(*got)))


_C = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i that has k words after it."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s += h[j : n + j] * _C[j]
    return mix(s)


def shingle_sets(texts: Sequence[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, one after another, and
    bounds. A text of fewer than k words has its whole sequence as one shingle; a
    text without words has none."""
    h, b = word_hashes(texts)
    s = windows(h, k)
    out = []
    for i in range(len(texts)):
        x, y = b[i], b[i + 1]
        if y - x >= k:
            d = np.sort(s[x : y - k + 1])
            out.append(d[np.concatenate(([True], d[1:] != d[:-1]))] if len(d) > 1 else d)
        elif y > x:
            out.append(mix((h[x:y] * _C[: y - x]).sum(keepdims=True, dtype=np.uint64) + np.uint64(y - x)))
        else:
            out.append(s[:0])
    bounds = np.cumsum([0, *map(len, out)])
    return (np.concatenate(out) if out else s[:0]), bounds
