"""Vectorised text kernels on Arrow string buffers.

A block of texts is one byte array with document offsets; words are byte ranges found with table
look-ups, and a word's 64-bit hash is the difference of two prefix sums of a polynomial in an odd
base modulo 2**64, passed through a finaliser.  Nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 1 << 20

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size, made = max(n, BLOCK + 1), []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if size > 8 * BLOCK:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block(NamedTuple):
    """Documents ``first`` to ``first + len(offsets) - 1`` of a batch as bytes."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Splits a string column into blocks of about ``limit`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield Block(at, data[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


#: The white space of words `[^\x20\x09-\x0D]+`.
SPACES = table(b" \t\n\v\f\r")
#: Bytes of word characters: ASCII letters and digits, and all bytes of other characters.
WORDY = table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Byte ranges of the words of a block, and each document's first word."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of len(offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes marked as inside; none crosses a document's end."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal ranges have equal hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    out = (total[end] - total[start]) * down[start]
    return mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_salts = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each document, and each document's first one.

    A document of fewer than n words gives its whole sequence as its one shingle, one without words none.
    """
    count = np.diff(first)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.zeros(len(first), np.int64)
    np.cumsum(many, out=at[1:])
    if len(h) >= n:
        wide = h[: len(h) - n + 1] * _salts[0]
        for k in range(1, n):
            wide += h[k : len(h) - n + 1 + k] * _salts[k]
        ok = np.ones(len(wide), bool)
        edge = first[1:-1]
        for k in range(1, n):
            bad = edge - k
            ok[bad[(bad >= 0) & (bad < len(ok))]] = False
    else:
        wide, ok = np.zeros(0, np.uint64), np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < n))
    out = np.zeros(at[-1], np.uint64)
    fill = np.ones(at[-1], bool)
    fill[at[short]] = False
    # windows that begin in a short document are never whole: each crosses that document's end
    out[fill] = wide[ok]
    for d in short:
        own = h[first[d] : first[d + 1]]
        out[at[d]] = (own * _salts[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), at


def words(block: Block, lower: bool = True) -> tuple[Words, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of a block and their hashes, with A-Z lower-cased if asked."""
    w = runs(~SPACES[block.data], block.offsets)
    return w, hashes(LOWER[block.data] if lower else block.data, w.start, w.end)
