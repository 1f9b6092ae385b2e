"""Similarity of texts to ranges of a page, without building a range's text.

An embedding that counts grams adds up: the vector of the text from one place to another is that of what lies
before its end less that of what lies before its start, plus what the two edges add.  So a start and an end have a vector
each, every range is the sum of two, and a page takes memory in proportion to its places and not to its ranges.

In a matching of m rows each row can do with its m best ranges: of these at most m - 1 are taken by others.
Ranges are therefore scored in chunks of starts, only each row's best stay, and a start is given up
where no longer range from it can reach a row's worst kept score.

No cosine is greater than 1.  So a row with a range of its very vector needs no scores, and where every row has a range
of greatest score that no other row wants, no matching has a greater total.  Such ranges are looked up by numbers that
add up as vectors do, one for each place.
"""

from __future__ import annotations

import heapq
from typing import Protocol

import numpy as np

#: Scores that are worked out together.
CHUNK = 1 << 21


class Composable(Protocol):
    """An embedding of texts by additive counts."""

    def counts(self, texts: list[str]) -> np.ndarray:
        """Vectors of whole texts."""
        ...

    def places(self, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of starts and of ends: the sum of one each is the vector of the text between them, where that has two characters or more."""
        ...


def best_ranges(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` ranges of greatest cosine for each row: (start, end, score) arrays of a row each; equal scores by start, then end; start -1 where there are fewer.

    ``rows`` are vectors of counts, ``starts`` and ``ends`` those of places; start i goes with ends ``first[i]`` to ``last[i]``.
    """
    m, n = len(rows), len(ends)
    size = np.sqrt((rows * rows).sum(1))
    unit = rows / np.where(size > 0, size, 1)[:, None]
    from_start, to_end, most = unit @ starts.T, unit @ ends.T, unit.max(1, initial=0.0)
    start_size, end_size = (starts * starts).sum(1), (ends * ends).sum(1)
    best = np.full((m, keep), -np.inf)
    at = np.full((m, keep), -1, np.int64)
    many = np.maximum(last - first + 1, 0)
    if max(int(many.sum()) * m, len(starts) * n) <= CHUNK:
        # few enough for all at once
        i = np.repeat(np.arange(len(starts)), many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]
        norm = np.sqrt(np.maximum(start_size[i] + end_size[j] + 2 * (starts @ ends.T)[i, j], 0))
        score = np.round((from_start[:, i] + to_end[:, j]) / np.where(norm > 0, norm, np.inf), 12)
        for r, own in enumerate(score):
            top = np.flatnonzero(own >= np.partition(own, -keep)[-keep]) if len(own) > keep else np.arange(len(own))
            top = top[np.argsort(-own[top], kind="stable")][:keep]
            best[r, : len(top)], at[r, : len(top)] = own[top], i[top] * n + j[top]
        return np.where(at >= 0, at // max(1, n), -1), np.where(at >= 0, at % max(1, n), -1), best
    step = max(1, CHUNK // max(1, m * 64))
    for i in range(len(starts)):
        j, stop = int(first[i]), int(last[i]) + 1
        while j < stop:
            to = min(stop, j + max(64, step))
            norm = np.sqrt(np.maximum(start_size[i] + end_size[j:to] + 2 * (ends[j:to] @ starts[i]), 0))
            dots = from_start[:, i, None] + to_end[:, j:to]
            score = np.where(norm > 0, dots / np.where(norm > 0, norm, 1), 0.0)
            # scores that differ by rounding alone are equal
            score = np.round(score, 12)
            ids = i * n + np.arange(j, to)
            for r in np.flatnonzero((score > best[:, -1:]).any(1)):
                new = np.flatnonzero(score[r] > best[r, -1])
                every, places = np.concatenate([best[r], score[r, new]]), np.concatenate([at[r], ids[new]])
                # what is kept came before what is new, so equal scores stay in order
                order = np.argsort(-every, kind="stable")[:keep]
                best[r], at[r] = every[order], places[order]
            j = to
            if j < stop:
                # counts grow with the end but for its edge, one gram: so much greater than the longest range's product, and so
                # much smaller than this range's norm, can those of the ranges between be
                reach = (from_start[:, i] + to_end[:, stop - 1] + most) / max(norm[-1] - 1, 1e-300)
                if norm[-1] > 1 and (reach < best[:, -1] - 1e-9).all():
                    break
    return np.where(at >= 0, at // max(1, n), -1), np.where(at >= 0, at % max(1, n), -1), best


def sparse_assignment(columns: list[np.ndarray], weights: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """Row, column and weight of a matching of all rows of greatest total weight, by shortest augmenting paths over each row's own columns.

    Rows that the given columns leave without a partner stay out.
    """
    price: dict[int, float] = {}
    owner: dict[int, int] = {}
    mine: list[int] = [-1] * len(columns)
    cost = [dict(zip(c.tolist(), (-w).tolist(), strict=True)) for c, w in zip(columns, weights, strict=True)]
    potential = [min(c.values(), default=0.0) for c in cost]
    for row in range(len(columns)):
        heap: list[tuple[float, int, int]] = []
        done: dict[int, float] = {}
        came: dict[int, int] = {}
        short: dict[int, float] = {}
        at, base, free = row, 0.0, -1
        while True:
            for c, w in cost[at].items():
                d = base + w - potential[at] - price.get(c, 0.0)
                if c not in done and d < short.get(c, np.inf):
                    short[c], came[c] = d, at
                    heapq.heappush(heap, (d, c, at))
            while heap and (heap[0][1] in done or heap[0][0] > short[heap[0][1]]):
                heapq.heappop(heap)
            if not heap:
                break
            base, c, _ = heapq.heappop(heap)
            done[c] = base
            if c not in owner:
                free = c
                break
            at = owner[c]
        if free < 0:
            continue
        potential[row] += base
        for c, d in done.items():
            if c != free:
                potential[owner[c]] += base - d
                price[c] = price.get(c, 0.0) - (base - d)
        c = free
        while True:
            r = came[c]
            owner[c] = r
            mine[r], c = c, mine[r]
            if r == row:
                break
    return [(r, c, -cost[r][c]) for r, c in enumerate(mine) if c >= 0]


def equal_ranges(texts: list[str], page: str, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, own: Composable, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int] | None]:
    """For each text a range of its length and vector: a range of the very text if there is one, else one that is left; of equal texts the first has the first by start and end, the next the next; None where there is none left.

    ``sums``: the numbers of texts, starts and ends.
    """
    wanted, by_start, by_end = sums
    number: dict[tuple[int, int], int] = {}
    of = [number.setdefault((w, len(t)), len(number)) for w, t in zip(wanted.tolist(), texts, strict=True)]
    sum_of, size = np.array([w for w, _ in number], np.uint64), np.array([n for _, n in number])
    base, n = starts[0], len(starts)
    # which end lies at a place; the last place stands for all beyond
    end_at = np.full(int(ends[-1] - base) + 2, -1)
    end_at[ends[::-1] - base] = np.arange(n - 1, -1, -1)
    hits: list[list[tuple[int, int]]] = [[] for _ in number]
    step = max(1, CHUNK // n)
    for k in range(0, len(number), step):
        j = end_at[np.minimum((starts - base) + size[k : k + step, None], len(end_at) - 1)]
        kind, i = ((j >= first) & (j <= last)).nonzero()
        j, kind = j[kind, i], kind + k
        # places have no vectors for a single character
        same = (by_start[i] + by_end[j] == sum_of[kind]) & (size[kind] > 1)
        for x in np.flatnonzero(size[kind] == 1).tolist():
            same[x] = own.text_sums([page[starts[i[x]] : ends[j[x]]]])[0] == sum_of[kind[x]]
        for x, a, b in zip(kind[same].tolist(), i[same].tolist(), j[same].tolist(), strict=True):
            hits[x].append((a, b))
    rows: list[list[int]] = [[] for _ in number]
    for r, k in enumerate(of):
        rows[k].append(r)
    out: list[tuple[int, int] | None] = [None] * len(texts)
    for mine, same_vector in zip(rows, hits, strict=True):
        # vectors are blind to case and to the order of parts, so a text takes its own ranges before others can
        wait: dict[str, list[int]] = {}
        for r in reversed(mine):
            wait.setdefault(texts[r], []).append(r)
        left, missing = [], len(mine)
        for a, b in same_vector:
            if not missing:
                break
            if same_text := wait.get(page[starts[a] : ends[b]]):
                out[same_text.pop()] = (a, b)
                missing -= 1
            else:
                left.append((a, b))
        for r, x in zip([r for r in mine if out[r] is None], left):
            out[r] = x
    for r, (text, x) in enumerate(zip(texts, out, strict=True)):
        if x is not None:
            found = page[starts[x[0]] : ends[x[1]]]
            # equal numbers of unequal vectors are as good as impossible; looked at all the same
            if found != text and not np.array_equal(*own.counts([found, text])):
                out[r] = None
    return out


def match_ranges(texts: list[str], page: str, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, own: Composable, threshold: float, sums: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, float]]:
    """(text, start, end, score) of texts matched to ranges of a page by greatest total cosine, those below the threshold left out afterwards.

    ``starts`` and ``ends`` are places of the page, in order; start i may end at places ``first[i]`` to ``last[i]``.  ``sums``: the
    numbers of texts, starts and ends, where they are known.
    """
    total = int(np.maximum(last - first + 1, 0).sum())
    if not texts or not total:
        return []
    keep, pairs = min(len(texts), total), []
    rest = list(range(len(texts)))
    if total >= len(texts) and hasattr(own, "place_sums"):
        sums = sums or (own.text_sums(texts), *own.place_sums(page, starts, ends))
        equal = equal_ranges(texts, page, starts, ends, first, last, own, sums)
        rest = [r for r, x in enumerate(equal) if x is None]
        pairs = [(r, *x, 1.0) for r, x in enumerate(equal) if x is not None]
    if pairs and rest:
        # others may have their best ranges beside those
        ids, weights = _ranked([texts[r] for r in rest], page, starts, ends, first, last, own, 1)
        pairs += [(r, int(c[0]) // len(ends), int(c[0]) % len(ends), float(w[0])) for r, c, w in zip(rest, ids, weights, strict=True)]
        rest = rest if len({x[1:3] for x in pairs}) < len(pairs) else []
    if not rest:
        return [x for x in sorted(pairs) if x[3] >= threshold]
    ids, weights = _ranked(texts, page, starts, ends, first, last, own, keep)
    if total >= len(texts):
        pairs = sparse_assignment(ids, weights)
    else:
        # fewer ranges than texts: every range is matched
        known = sorted({x for own_ids in ids for x in own_ids.tolist()})
        rows = [[(r, s) for r, (c, w) in enumerate(zip(ids, weights, strict=True)) for s in w[c == k]] for k in known]
        found = sparse_assignment([np.array([r for r, _ in x]) for x in rows], [np.array([s for _, s in x]) for x in rows])
        pairs = sorted((r, known[k], s) for k, r, s in found)
    return [(r, c // len(ends), c % len(ends), s) for r, c, s in pairs if s >= threshold]


def _ranked(texts: list[str], page: str, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, own: Composable, keep: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text its ``keep`` best ranges, as start times number of places plus end, and their scores."""
    # only the part of the page that holds the places is counted
    page, starts, ends = page[int(starts[0]) : int(ends[-1])], starts - starts[0], ends - starts[0]
    rows = own.counts(texts)
    # ranges of less than two characters have no vector of a start and an end
    from_ = np.maximum(first, np.searchsorted(ends, starts + 2))
    i, j, score = best_ranges(rows, *own.places(page, starts, ends), from_, last, keep)
    tiny = [(a, b) for a in np.flatnonzero(from_ > first).tolist() for b in range(int(first[a]), int(min(from_[a] - 1, last[a])) + 1)]
    if tiny:
        vectors = own.counts([page[starts[a] : ends[b]] for a, b in tiny])
        size = lambda v: np.maximum(np.linalg.norm(v, axis=1), 1e-300)
        more = np.round((rows @ vectors.T) / size(rows)[:, None] / size(vectors), 12)
        a, b = np.array(tiny).T
        i, j, score = np.hstack([i, np.tile(a, (len(rows), 1))]), np.hstack([j, np.tile(b, (len(rows), 1))]), np.hstack([score, more])
        order = np.lexsort((j, i, -score))[:, :keep]
        i, j, score = (np.take_along_axis(x, order, 1) for x in (i, j, score))
    ids = [a[a >= 0] * len(ends) + b[a >= 0] for a, b in zip(i, j, strict=True)]
    return ids, [s[a >= 0] for a, s in zip(i, score, strict=True)]
