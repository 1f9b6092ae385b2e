"""Byte-level BPE ids of whole texts, with a cache of words.

The split pattern of the vocabulary never joins text across the white space before a word, as long
as no two white-space characters meet.  Such a text is a sequence of units, each a word with the
white-space character before it (and the one after the last word), and its ids are the ids of its
units in order.  Units are found and hashed by array operations, the distinct ones of a block are
looked up in a cache, and only new ones are encoded.  Texts with adjacent white space, with white space
that is not ASCII, or with the string of a special token, are encoded whole by the `tokenizers` library.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kernel

#: Distinct units a worker keeps.
CACHE = 250_000
_ENCODERS: dict = {}
_BLANK = frozenset(b" \t\n\v\f\r")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Ids (uint16) of texts under the 50k byte-level BPE vocabulary."""

    def __init__(self, vocabulary: str, ranks: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary)
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.length = np.array([len(k) for k, _ in sorted(table.items(), key=lambda kv: kv[1])], np.int64)
        self.clear()

    def clear(self) -> None:
        """Forgets all units."""
        self.known: dict[int, int] = {}
        self.begin, self.size, self.store, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint16), 0

    @classmethod
    def shared(cls, vocabulary: str | None = None, ranks: str | None = None) -> UnitEncoder:
        """One encoder for each worker process and vocabulary."""
        key = (vocabulary or tokenizer_path("byte_bpe_50k.json"), ranks or tokenizer_path("byte_bpe_50k.tiktoken"))
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(*key)
        return _ENCODERS[key]

    def slots(self, h: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, lead: bytes = b"") -> np.ndarray:
        """Where the ids of each distinct unit lie in the store; ``h`` are its hashes, ``lead`` goes before each."""
        if len(self.known) > CACHE:
            self.clear()
        keys = h.tolist()
        get = self.known.get
        out = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        found = [lead + raw[s:e] for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)]
        # units that begin with white space and do not end with it keep their ids side by side
        plain = np.array([u[0] in _BLANK and u[-1] not in _BLANK for u in found], bool)
        run = [u for u, p in zip(found, plain.tolist(), strict=True) if p]
        made = [np.array(self.fast.encode_ordinary(b"".join(run).decode()), np.uint16)]
        sizes = np.zeros(len(new), np.int64)
        to = np.cumsum(self.length[made[0]])
        sizes[plain] = np.diff(np.concatenate([[0], np.searchsorted(to, np.cumsum([len(u) for u in run]), "left") + 1])) if run else 0
        for u, p in zip(found, plain.tolist(), strict=True):
            if not p:
                made.append(np.array(self.fast.encode_ordinary(u.decode()), np.uint16))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        sizes[~plain] = [len(m) for m in made[1:]]
        ids, at = np.concatenate(made), len(self.known)
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while at + len(new) > len(self.begin):
            self.begin, self.size = (np.concatenate([v, np.zeros_like(v)]) for v in (self.begin, self.size))
        self.store[self.used : self.used + len(ids)] = ids
        self.size[at : at + len(new)] = sizes[order]
        self.begin[at : at + len(new)] = self.used + np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
        self.used += len(ids)
        slot = np.arange(at, at + len(new))
        out[new[order]] = slot
        self.known.update(zip(h[new[order]].tolist(), slot.tolist(), strict=True))
        return out

    def spread(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units in ``slots``, one after the other, and where each begins."""
        n = self.size[slots]
        to = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(n, out=to[1:])
        return self.store[np.repeat(self.begin[slots] - to[:-1], n) + np.arange(to[-1])], to

    def block(self, b: kernel.Block) -> list[np.ndarray]:
        """The ids of each document of a block."""
        data, off = b.data, b.offsets
        blank = kernel.SPACES[data]
        w = kernel.runs(~blank, off)
        docs = len(off) - 1
        start, end = w.start.copy(), w.end.copy()
        slow = odd(data, off, blank)
        slow |= (w.first[1:] == w.first[:-1]) & (off[1:] > off[:-1])
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                # a find that crosses a document's end costs that document only time
                slow[np.searchsorted(off, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        if len(start):
            doc = np.repeat(np.arange(docs), np.diff(w.first))
            start -= (start > off[:-1][doc]) & blank[np.maximum(start - 1, 0)]
            last = w.first[1:][w.first[1:] > w.first[:-1]] - 1
            end[last] += end[last] < off[1:][doc[last]]
            h = kernel.hashes(data, start, end)
            _, at, inv = np.unique(h, return_index=True, return_inverse=True)
            every, to = self.spread(self.slots(h[at], raw, start[at], end[at])[inv])
            cut = to[w.first]
        else:
            every, cut = np.zeros(0, np.uint16), np.zeros(docs + 1, np.int64)
        out = [every[cut[d] : cut[d + 1]] for d in range(docs)]
        for d in np.flatnonzero(slow).tolist():
            text = data[off[d] : off[d + 1]].tobytes().decode()
            out[d] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each block of a column: its first row and the ids of its documents."""
        for b in kernel.blocks(texts):
            yield b.first, self.block(b)


def odd(data: np.ndarray, off: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Documents in which two white-space characters meet or white space is not plain ASCII."""
    out = np.zeros(len(off) - 1, bool)
    if len(data) < 2:
        return out | np.array([bool(((d >= 0x1C) & (d <= 0x1F)).any()) for d in (data[a:b] for a, b in zip(off[:-1], off[1:], strict=True))], bool) if len(data) else out
    pair = blank[1:] & blank[:-1]
    a, b = data[:-1], data[1:]
    lead = np.flatnonzero(((a == 0xC2) & ((b == 0xA0) | (b == 0x85))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80)))
    wide = np.flatnonzero((a[:-1] == 0xE2) & ((b[:-1] == 0x80) | (b[:-1] == 0x81))) if len(data) > 2 else np.zeros(0, np.int64)
    third = data[wide + 2] if len(wide) else wide
    wide = wide[((data[wide + 1] == 0x80) & ((third <= 0x8F) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((data[wide + 1] == 0x81) & (third == 0x9F))] if len(wide) else wide
    meets = np.flatnonzero(pair)
    meets = meets[~np.isin(meets + 1, off)] if len(meets) else meets
    at = np.concatenate([meets, lead, wide, np.flatnonzero((data >= 0x1C) & (data <= 0x1F))])
    out[np.searchsorted(off, at, "right") - 1] = True
    return out
