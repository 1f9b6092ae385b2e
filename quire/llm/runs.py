"""Runs of repeated word sequences, by names of power-of-two windows.

The words of a text are numbered by equality.  A window of 2**k words gets as its name the rank of the pair of names of
its two halves, so windows are equal exactly where their names are; levels are made until all names of one
differ, beyond which nothing repeats.  The longest common extension of two places is found by descending
the levels and moving on wherever the names agree.

A run of period q and at least four periods has windows of q words that equal those q words on, at every
one of 2q neighbouring places; so places that are multiples of 2q are all the candidates of q, and those whose names
agree at the greatest level of at most q words are extended to both sides.  Nothing is hashed and no suffix is
sorted.  Of one stretch with several periods the smallest stays.

Everything happens in the row of a text: arrays of its words for each level, and candidates in
chunks of ``CHUNK``.  Null texts and texts without words have no runs; repeated rows and rows without an id are rows of
their own; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least words of a run, and the least number of its periods.
LEAST, TIMES = 6, 4
#: Candidates that are extended together.
CHUNK = 1 << 18


def coded(words: list[bytes]) -> np.ndarray:
    """Numbers of words: equal words, equal numbers."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return np.array(list(map(known.__getitem__, words)), np.int64)


def levels(codes: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words by start, up to the last level at which two windows are equal."""
    out, names, n, width = [], codes.astype(np.int64), len(codes), 1
    while len(names):
        kinds, names = np.unique(names, return_inverse=True)
        if len(kinds) == len(names):
            break
        out.append(names.astype(np.int32))
        if 2 * width > n:
            break
        names = names[: n - 2 * width + 1] * np.int64(len(kinds)) + names[width:]
        width *= 2
    return out


def forward(named: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from places i and j on are equal (i < j)."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(named) - 1, -1, -1):
        names = named[k]
        at = np.flatnonzero(j + out < len(names))
        at = at[names[i[at] + out[at]] == names[j[at] + out[at]]]
        out[at] += 1 << k
    return out


def backward(named: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before places i and j are equal (i < j)."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(named) - 1, -1, -1):
        names, width = named[k], 1 << k
        at = np.flatnonzero(i - out >= width)
        at = at[names[i[at] - out[at] - width] == names[j[at] - out[at] - width]]
        out[at] += width
    return out


def candidates(n: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and grid places of a text of n words, for periods up to ``top``, in chunks."""
    low = 1
    while low <= top:
        # as many periods as fit a chunk: period q has n / 2q places
        high = low
        size = -(-n // (2 * low))
        while high < top and size + -(-n // (2 * high + 2)) <= CHUNK:
            high += 1
            size += -(-n // (2 * high))
        q = np.arange(low, high + 1)
        many = -(-n // (2 * q))
        period = np.repeat(q, many)
        first = np.repeat(np.cumsum(many) - many, many)
        yield period, (np.arange(len(period)) - first) * 2 * period
        low = high + 1


def find_runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows of start, length, smallest period of the maximal runs, by start, then period; ``times`` is at least 3."""
    n, named = len(codes), levels(codes) if len(codes) >= least else []
    # a level without equal windows rules out longer periods
    top = min(n // times, (1 << len(named)) - 1)
    found = [np.zeros((0, 3), np.int64)]
    for q, i in candidates(n, top):
        hit = np.zeros(len(q), bool)
        for k in range(int(q[0]).bit_length() - 1, int(q[-1]).bit_length()):
            # periods of 2**k to 2**(k+1) - 1
            a, b = np.searchsorted(q, [1 << k, 2 << k])
            near, far = i[a:b], i[a:b] + q[a:b]
            inside = far < len(named[k])
            hit[a:b][inside] = named[k][near[inside]] == named[k][far[inside]]
        if not hit.any():
            continue
        q, i = q[hit], i[hit]
        start, end = i - backward(named, i, i + q), i + q + forward(named, i, i + q)
        long = end - start >= np.maximum(least, times * q)
        found.append(np.unique(np.stack([start, end - start, q], 1)[long], axis=0))
    rows = np.concatenate(found)
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, :2] == rows[:-1, :2]).all(1)
    rows = rows[np.concatenate([[True], ~same])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def steepest(rows: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length by period, compared exactly; the first start, then the smallest period, of equals."""
    best = None
    for start, length, q in rows.tolist():
        if best is None or length * best[2] > best[1] * q:
            best = start, length, q
    return best


def kept(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, or for one id in ten by its checksum those of which the tail repeats: the contract's planted periods."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = a + (np.arange(a, n) - a) % p
    return words[:a] + [words[i] for i in at.tolist()]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapsed(docs: DataFrame, planted: bool = False, with_text: bool = False) -> DataFrame:
    """Of each document the number of its runs, the steepest, hashes of all and of the text with each run cut to its first period; that text and the runs if asked.

    ``planted`` gives one id in ten a periodic tail first.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["runs", "collapsed"] * with_text
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.list_(pa.int64())), pa.string()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                words = periodic(words, doc_id) if planted else words
                rows = find_runs(coded(words))
                best = steepest(rows)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows.tolist()).encode()
                if best:
                    words = [w for w, k in zip(words, kept(len(words), rows).tolist(), strict=True) if k]
                text = b" ".join(words)
                out.append((doc_id, len(rows), *(best or (None, None, None)), best and 1000 * best[1] // best[2], _sha(listed), _sha(text), *[rows.tolist(), text.decode()] * with_text))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS + ", runs array<array<bigint>>, collapsed string" * with_text)
