"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The pieces of a public model lie in a double-array trie of bytes with log scores.  White space is
the marker U+2581, one more of it before the text.  The best path maximises the sum of scores; a
character that no piece covers costs ten more than the worst piece and becomes byte pieces.  No
piece of the vocabulary has the marker after another character, so the best path of a text is that
of its units, each a run of spaces with the word after it: distinct units of a block are searched
side by side in arrays and cached.  Vocabularies whose pieces cross words are searched whole.

Where a model has merge ranks in place of log scores (a BPE file), the piece of rank r has the
Zipfian probability proportional to 1 / (r + ``ZIPF``).

Null and empty texts have no ids and decode to an empty text; very long texts are encoded whole; an empty
table gives no rows.  Byte pieces that are no UTF-8 decode to U+FFFD.  Of paths of equal score the one
whose last piece is longest counts.  Repeated rows are encoded each; columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .tokens import tokenizer_path

MARK = "▁".encode()
ZIPF, UNKNOWN_PENALTY = 10.0, 10.0
#: Longest unit, in bytes, that is searched side by side with others; units a worker keeps.
WIDE, CACHE = 48, 400_000
_CODECS: dict = {}
_NEVER = -(1 << 62)


class DoubleArray:
    """A trie of byte strings in two arrays: from state s, byte c leads to base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        kids: list[dict[int, int]] = [{}]
        value = {}
        for k, v in zip(keys, values, strict=True):
            node = 0
            for c in k:
                node = kids[node].setdefault(c, len(kids))
                if node == len(kids):
                    kids.append({})
            value[node] = v
        size = 4 * len(kids) + 1024
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, todo = {0: 0}, [0]
        # where the search begins: it moves on once almost all places behind it are taken
        begin = 1
        for node in todo:
            own = kids[node]
            if not own:
                continue
            cs = sorted(own)
            at, taken = max(begin, cs[0] + 1) - 1, 0
            # the first place where all children fit
            while True:
                at += 1
                if at + 260 > len(used):
                    used.extend(bytes(len(used)))
                if used[at]:
                    taken += 1
                    continue
                b = at - cs[0] - 1
                if not any(used[b + c + 1] for c in cs):
                    break
            if taken >= 0.9 * (at - max(begin, cs[0] + 1) + 1) and at - begin > 16:
                begin = at
            while len(used) > len(self.base):
                self.base, self.check, self.value = (np.concatenate([v, np.full(len(v), fill, np.int32)]) for v, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
            s = place[node]
            self.base[s] = b
            for c in cs:
                t = b + c + 1
                used[t] = 1
                self.check[t] = s
                place[own[c]] = t
                self.value[t] = value.get(own[c], -1)
                todo.append(own[c])
        end = max(place.values()) + 258
        self.base, self.check, self.value = self.base[:end].copy(), self.check[:end].copy(), self.value[:end].copy()

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """States after byte c; -1 where the trie has none."""
        t = self.base[state] + c + 1
        return np.where(self.check[t] == state, t, -1)


class Codec:
    """Encodes and decodes texts under a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i).encode() for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = np.array([sp.get_score(i) for i in range(n)])
        ranks = bool((raw[normal] == np.round(raw[normal])).all())
        if ranks:
            p = 1 / (-raw[normal] + ZIPF)
            raw[normal] = np.log(p / p.sum())
        self.score = raw
        # fixed point: sums of the same scores are equal in any order, and of equal paths the first found stays
        self.fixed = np.round(raw * (1 << 32)).astype(np.int64)
        self.unknown = int(self.fixed[normal].min() - round(UNKNOWN_PENALTY * (1 << 32)))
        self.byte = np.full(256, -1, np.int64)  # of each byte
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(self.pieces[i][3:5], 16)] = i
        self.unk = sp.unk_id()
        self.trie = DoubleArray([self.pieces[i] for i in normal], normal)
        self.by_word = not any(MARK in self.pieces[i].lstrip(MARK) and MARK in self.pieces[i].replace(MARK, b"", 1) and not self.pieces[i].startswith(MARK * self.pieces[i].count(MARK)) or (MARK in self.pieces[i] and not self.pieces[i].startswith(MARK)) for i in normal)
        surface = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, b" ") for i, p in enumerate(self.pieces)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.length = np.array([len(s) for s in surface])
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.known: dict[int, bytes] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> Codec:
        path = path or tokenizer_path("piece_bpe_32k.model")
        if path not in _CODECS:
            _CODECS[path] = cls(path)
        return _CODECS[path]

    def one(self, s: bytes) -> list[int]:
        """The ids of a marked byte string, whatever its length."""
        n = len(s)
        best, back, piece = [_NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(n):
            if s[i] & 0xC0 == 0x80 or best[i] == _NEVER:
                continue
            state, single = 0, False
            wide = 1 if s[i] < 0x80 else 2 if s[i] < 0xE0 else 3 if s[i] < 0xF0 else 4
            for j in range(i, n):
                t = int(base[state]) + s[j] + 1
                if check[t] != state:
                    break
                state = t
                v = int(value[t])
                if v >= 0:
                    single |= j + 1 == i + wide
                    if best[i] + int(self.fixed[v]) > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = best[i] + int(self.fixed[v]), i, v
            j = min(i + wide, n)
            if not single and best[i] + self.unknown > best[j]:
                best[j], back[j], piece[j] = best[i] + self.unknown, i, -1
        out: list[int] = []
        while n > 0:
            i = back[n]
            out += [piece[n]] if piece[n] >= 0 else [self._byte(b) for b in reversed(s[i:n])]
            n = i
        return out[::-1]

    def _byte(self, b: int) -> int:
        return int(self.byte[b]) if self.byte[b] >= 0 else self.unk

    def many(self, units: list[bytes]) -> list[bytes]:
        """The ids of marked units, as bytes of uint16; short units are searched side by side."""
        out: list[bytes] = [b""] * len(units)
        size = np.array([len(u) for u in units])
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= WIDE]
        for k in np.flatnonzero(size > WIDE).tolist():
            out[k] = np.array(self.one(units[k]), np.uint16).tobytes()
        for at in range(0, len(order), 1 << 14):
            part = order[at : at + (1 << 14)]
            for k, ids in zip(part.tolist(), self._side([units[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _side(self, units: list[bytes]) -> list[bytes]:
        n, size = len(units), np.array([len(u) for u in units])
        width = int(size.max())
        text = np.frombuffer(b"".join(u.ljust(width + 1, b"\0") for u in units), np.uint8).reshape(n, width + 1).astype(np.int64)
        best = np.full((n, width + 5), _NEVER)
        back, piece = np.zeros((n, width + 5), np.int64), np.full((n, width + 5), -1, np.int64)
        best[:, 0] = 0
        for i in range(width):
            lane = np.flatnonzero((size > i) & ((text[:, i] & 0xC0) != 0x80) & (best[:, i] > _NEVER))
            if not len(lane):
                continue
            first = text[lane, i]
            wide = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            single = np.zeros(n, bool)
            live, state, j = lane, np.zeros(len(lane), np.int64), i
            stop = np.zeros(n, np.int64)
            stop[lane] = i + wide
            while len(live) and j < width:
                state = self.trie.step(state, text[live, j])
                ok = (state >= 0) & (size[live] > j)
                live, state = live[ok], state[ok]
                v = self.trie.value[state]
                end = v >= 0
                rows, ids = live[end], v[end]
                single[rows] |= stop[rows] == j + 1
                reach = best[rows, i] + self.fixed[ids]
                better = reach > best[rows, j + 1]
                rows = rows[better]
                best[rows, j + 1], back[rows, j + 1], piece[rows, j + 1] = reach[better], i, ids[better]
                j += 1
            rows = lane[~single[lane]]
            to = np.minimum(stop[rows], size[rows])
            reach = best[rows, i] + self.unknown
            better = reach > best[rows, to]
            rows, to = rows[better], to[better]
            # one unknown byte is its byte piece; longer characters are spelled out at the end
            spelled = np.where(to - i == 1, self.byte[text[rows, i]], -1)
            best[rows, to], back[rows, to], piece[rows, to] = reach[better], i, spelled
        # walk back from the ends of all units at once
        found, at, unknown = [], size.copy(), np.zeros(n, bool)
        lane = np.arange(n)
        while len(lane := lane[at[lane] > 0]):
            step = np.full(n, -2, np.int64)
            step[lane] = piece[lane, at[lane]]
            unknown |= step == -1
            found.append(step)
            at[lane] = back[lane, at[lane]]
        ids = np.array(found[::-1]).T
        return [np.array(self.one(units[k]), np.uint16).tobytes() if unknown[k] else row[row >= 0].astype(np.uint16).tobytes() for k, row in enumerate(ids)]

    def block(self, b: kernel.Block) -> list[np.ndarray]:
        """The ids (uint16) of each document of a block."""
        data, off = b.data, b.offsets
        docs = len(off) - 1
        w = kernel.runs(data != 32, off)
        count = np.diff(w.first)
        whole = np.zeros(docs, bool)
        # texts that hold the marker itself, that end in a space, or under a vocabulary that crosses words
        raw = data.tobytes()
        full = np.flatnonzero(off[1:] > off[:-1])
        whole[full] = (data[off[1:][full] - 1] == 32) | (not self.by_word)
        at = raw.find(MARK)
        while at >= 0:
            whole[np.searchsorted(off, at, "right") - 1] = True
            at = raw.find(MARK, at + 1)
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * docs
        if len(w.start):
            doc = np.repeat(np.arange(docs), count)
            before = np.concatenate([[0], w.end[:-1]])
            begins = np.zeros(len(doc), bool)
            begins[w.first[:-1][count > 0]] = True
            spaces = np.where(begins, w.start - off[:-1][doc] + 1, w.start - before)
            h = kernel.mix(kernel.hashes(data, w.start, w.end) + spaces.astype(np.uint64) * np.uint64(kernel.BASE))
            _, pick, inv = np.unique(h, return_index=True, return_inverse=True)
            if len(self.known) > CACHE:
                self.known.clear()
            keys = h[pick].tolist()
            new = [k for k, key in enumerate(keys) if key not in self.known]
            units = [MARK * int(spaces[pick[k]]) + raw[w.start[pick[k]] : w.end[pick[k]]] for k in new]
            self.known.update(zip((keys[k] for k in new), self.many(units), strict=True))
            ids = [self.known[k] for k in keys]
            flat = np.frombuffer(b"".join(ids), np.uint16)
            size = np.array([len(i) // 2 for i in ids])
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            n = size[inv]
            to = np.concatenate([[0], np.cumsum(n)])
            every = flat[np.repeat(begin[inv] - to[:-1], n) + np.arange(to[-1])]
            cut = to[w.first]
            out = [every[cut[d] : cut[d + 1]] for d in range(docs)]
        for d in np.flatnonzero(whole).tolist():
            out[d] = np.array(self.one(MARK + raw[off[d] : off[d + 1]].replace(b" ", MARK)), np.uint16)
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each block of a column: its first row and the ids of its documents."""
        for b in kernel.blocks(texts):
            yield b.first, self.block(b)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, markers as spaces, the first of them dropped."""
        n = self.length[ids]
        to = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        out = self.surface[np.repeat(self.begin[ids] - to[:-1], n) + np.arange(to[-1])].tobytes()
        return out.decode("utf-8", "replace").removeprefix(" ")


COLUMNS = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, score double, decoded_chars long, round_trip boolean"


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per document: its ids' number, byte pieces, checksum and log score, and whether decoding them gives the text again; the ids if asked."""
    names = [x.split()[0] for x in COLUMNS.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.shared(path)
        is_byte = np.zeros(len(codec.pieces), bool)
        is_byte[codec.byte[codec.byte >= 0]] = True
        # an unknown character counts once, in front of its bytes
        score = np.where(is_byte, 0.0, codec.score)
        for batch in batches:
            texts = batch.column(1)
            for first, ids in codec.encode(texts):
                part = texts.slice(first, len(ids)).to_pylist()
                back = [codec.decode(i) for i in ids]
                cols = [
                    batch.column(0).slice(first, len(ids)),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    pa.array([float(score[i].sum()) for i in ids], pa.float64()),
                    pa.array([len(t) for t in back], pa.int64()),
                    pa.array([(t or "").replace("▁", " ") == b for t, b in zip(part, back, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    cols.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COLUMNS + ", ids array<int>" * with_ids)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Columns doc_id, text from rows of doc_id, ids (array<int>); null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.shared(path)
        for batch in batches:
            texts = [codec.decode(np.array(i.as_py() or [], np.int64)) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
