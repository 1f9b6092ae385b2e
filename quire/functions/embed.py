"""Embedding providers: texts to vectors."""

from __future__ import annotations

from typing import Protocol

import numpy as np


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """Counts of hashed character n-grams, unit length; needs no model and is the same everywhere.

    A text is in lower case character by character, with a blank before and behind it.  Counts of ranges of a
    text are sums over places, so they need no texts of their own.
    """

    def __init__(self, width: int = 256, n: int = 3):
        self.width, self.n = width, n
        self.weights = np.random.default_rng(width).integers(0, 1 << 64, width, np.uint64)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def _buckets(self, codes: np.ndarray) -> np.ndarray:
        """The bucket of the gram that begins at each place; of a shorter text one for all of it."""
        gram = np.zeros(max(1, len(codes) - self.n + 1), np.uint64)
        for k in range(min(self.n, len(codes))):
            gram += codes[k : k + len(gram)]
            gram += np.uint64(1)
            gram *= np.uint64(0x9E3779B97F4A7C15)
        gram >>= np.uint64(33)
        gram %= np.uint64(self.width)
        return gram.view(np.int64)

    @staticmethod
    def _lower(text: str) -> str:
        """In lower case character by character: in a whole text only the capital sigma looks at what stands around it."""
        return text.replace("Σ", "σ").lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, t in zip(out, texts, strict=True):
            row += np.bincount(self._buckets(self._codes(f" {self._lower(t)} ")), minlength=self.width)
        return out

    def _grams(self, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """The buckets of a text's grams, how many of them begin before each start's and each end's, and the buckets of the edges."""
        lower, n = self._lower(text), self.n
        if len(lower) != len(text):
            before = self._codes(text)
            more = sum((before == ord(c)) * (len(c.lower()) - 1) for c in set(text) if len(c.lower()) > 1)
            shift = np.concatenate([[0], np.cumsum(more + 1)])
            starts, ends = shift[starts], shift[ends]
        codes = self._codes(lower)
        bucket = self._buckets(codes) if len(codes) >= n else np.zeros(0, np.int64)
        wide = np.concatenate([np.full(n, 32, np.uint64), codes, np.full(n, 32, np.uint64)])

        def edge(first: np.ndarray, blank: int) -> np.ndarray:
            """Buckets of grams of which one character is a blank."""
            gram = np.zeros(len(first), np.uint64)
            for k in range(n):
                code = np.uint64(32) if k == blank else wide[first + k]
                gram = (gram + code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            return ((gram >> np.uint64(33)) % np.uint64(self.width)).astype(np.int64)

        before = [np.clip(at, 0, len(bucket)) for at in (starts, ends - n + 1)]
        return bucket, *before, edge(starts + n - 1, 0), edge(ends + 1, n - 1)

    def places(self, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of starts and ends: their sums count the grams of the text between, where it has n - 1 characters or more."""
        width = self.width
        bucket, a, z, head, tail = self._grams(text, starts, ends)

        def before(at: np.ndarray) -> np.ndarray:
            """Counts of the grams that begin before each place."""
            order = np.argsort(at, kind="stable")
            part = np.searchsorted(at[order], np.arange(len(bucket)), "right")
            inside = part < len(at)
            steps = np.bincount(part[inside] * width + bucket[inside], minlength=len(at) * width).reshape(len(at), width)
            out = np.empty((len(at), width))
            out[order] = np.cumsum(steps, 0)
            return out

        from_, to = -before(a), before(z)
        from_[np.arange(len(a)), head] += 1
        to[np.arange(len(z)), tail] += 1
        return from_, to

    def text_sums(self, texts: list[str]) -> np.ndarray:
        """A number for each text, from its vector alone: the sum of the buckets' weights, modulo 2**64."""
        lower = [f" {self._lower(t)} " for t in texts]
        if min(map(len, lower), default=0) < self.n:
            return np.array([self.weights[self._buckets(self._codes(t))].sum() for t in lower], np.uint64)
        size = np.array([len(t) for t in lower])
        to = np.cumsum(size)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.weights[self._buckets(self._codes("".join(lower)))])])
        # grams that reach into the next text are left out
        return total[to - self.n + 1] - total[to - size]

    def place_sums(self, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of starts and ends that add up, modulo 2**64, to that of the text between, where ``places`` do."""
        bucket, a, z, head, tail = self._grams(text, starts, ends)
        weight = self.weights
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight[bucket])])
        return weight[head] - total[a], weight[tail] + total[z]

    def embed(self, texts: list[str]) -> np.ndarray:
        out = self.counts(texts)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


class SentenceModel:
    """A sentence-transformers model, where that library is installed; one per worker process."""

    _loaded: dict = {}

    def __init__(self, name: str = "all-MiniLM-L6-v2", batch: int = 256):
        self.name, self.batch = name, batch

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.name not in self._loaded:
            from sentence_transformers import SentenceTransformer

            self._loaded[self.name] = SentenceTransformer(self.name)
        return np.asarray(self._loaded[self.name].encode(texts, batch_size=self.batch))
