"""Vectorised text kernels over Arrow string buffers.

Every kernel works on the UTF-8 bytes of a whole Arrow batch at once, so a batch of documents costs a handful of
numpy passes and no Python loop over words. Batches are cut into chunks of at most ``CHUNK_BYTES`` of text (a longer
text is a chunk of its own), which bounds the temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES, SEGMENT_BYTES = 1 << 17, 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: everything but space and \x09-\x0D.
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of letters and digits: 0-9, a-z and everything beyond ASCII (after lower-casing).
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[48:58] = ALNUM_BYTES[97:123] = ALNUM_BYTES[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, int64) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``most`` bytes, or of one longer row."""
    buf, offs = string_buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(low: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words in lower-cased bytes, and the offsets of each row's words among them."""
    w = inside[low]
    n = len(low)
    first = offs[:-1][offs[:-1] < offs[1:]]
    start = w.copy()
    start[1:] &= ~w[:-1]
    start[first] = w[first]
    end = w.copy()
    end[:-1] &= ~w[1:]
    last = first[first > 0] - 1
    end[last] = w[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, np.minimum(offs, n))


def span_hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e): polynomials over the bytes, shifted to a common origin and mixed."""
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(low)), out=total[1:])
    return mix((total[e] - total[s]) * powers(_INVERSE, len(low) + 1)[s] ^ (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray = TOKEN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the offsets of each row's words among them."""
    if len(offs) == 2 and len(buf) > SEGMENT_BYTES:  # a long text goes through in segments that end between words
        parts, at = [], 0
        while at < len(buf):
            end = min(at + SEGMENT_BYTES, len(buf))
            while end < len(buf) and inside[LOWER[buf[end]]]:
                end += 1
            parts.append(word_hashes(buf[at:end], np.array([0, 0, end - at]), inside)[0])
            at = end
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    low = LOWER[buf]
    s, e, rows = word_spans(low, offs, inside)
    return span_hashes(low, s, e), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles and their offsets; a row of fewer words (but one) has its whole sequence."""
    n = len(rows) - 1
    size = np.diff(rows)
    count = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    ext = np.concatenate([words, np.zeros(k, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    short = np.repeat(np.minimum(size, k), size)
    left = np.repeat(rows[1:], size) - np.arange(len(words))  # words from here to the row's end
    for j in range(k):
        h = np.where(j < short, mix(h * np.uint64(3) + ext[j : j + len(words)] + np.uint64(j + 1)), h)
    ok = (left >= k) | ((np.repeat(size, size) < k) & (np.repeat(rows[:-1], size) == np.arange(len(words))))
    h, doc = h[ok], np.repeat(np.arange(n), count)
    at = np.concatenate([[0], np.cumsum(count)])
    for i in range(n):
        h[at[i] : at[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
