"""Quality rules on tokeniser fertility.

Public vocabularies measure each document: characters per token and tokens per word under a 50k
byte-level BPE, the share of byte-fallback pieces under a 32k vocabulary with byte fallback, the entropy
of the document's tokens (Shannon's, in bits), and their peak entropy (of order infinity: minus the
logarithm of the most frequent token's share), which does not grow with length.  Each word is encoded by
itself, after a space.  A document is kept if it passes the base rules and every measure lies in the band
of its language or, for other and unknown languages, of its script; a measure at a band's edge is inside.

Null and empty texts have no words and fail the base rules; their measures are 0.  Very long texts are
read whole.  An empty table gives no rows.  Rows are independent: repeated rows and ties need no rule.
Other columns are passed through or ignored, whatever their names; results come in one struct column,
whose name the caller picks and the table must not have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .tokens import UnitEncoder, tokenizer_path

#: Bytes of `[#*$%&|<>]`.
SYMBOLS = kernel.table(b"#*$%&|<>")
LEAST_WORDS = 50
#: Words whose pieces a worker keeps.
CACHE = 150_000
#: Bands (lowest, highest) of a language or script.  Prose has 2 to 3.5 tokens a word in the languages
#: listed; words dressed with symbols have more.  No token of prose takes over an eighth of the whole, and
#: fifty words of it have more than 16 tokens' worth of entropy.
BANDS = {
    "en": {"tokens_per_word": (1.0, 3.15), "chars_per_token": (1.5, 8.0), "byte_share": (0.0, 0.15), "token_entropy": (4.0, 64.0), "peak_entropy": (3.05, 64.0)},
    "de": {"tokens_per_word": (1.0, 3.6), "chars_per_token": (1.4, 8.0), "byte_share": (0.0, 0.15), "token_entropy": (4.0, 64.0), "peak_entropy": (3.05, 64.0)},
    "fr": {"tokens_per_word": (1.0, 3.45), "chars_per_token": (1.3, 8.0), "byte_share": (0.0, 0.15), "token_entropy": (4.0, 64.0), "peak_entropy": (3.05, 64.0)},
    "es": {"tokens_per_word": (1.0, 3.9), "chars_per_token": (1.3, 8.0), "byte_share": (0.0, 0.15), "token_entropy": (4.0, 64.0), "peak_entropy": (3.05, 64.0)},
    "latin": {"tokens_per_word": (1.0, 3.9), "chars_per_token": (1.2, 8.0), "byte_share": (0.0, 0.2), "token_entropy": (4.0, 64.0), "peak_entropy": (3.05, 64.0)},
    "other": {"tokens_per_word": (1.0, 1e9), "chars_per_token": (0.2, 8.0), "byte_share": (0.0, 0.95), "token_entropy": (2.0, 64.0), "peak_entropy": (1.5, 64.0)},
}
#: Share of non-ASCII bytes above which a document's script is not Latin.
OTHER_SCRIPT = 0.4
MEASURES = "tokens_per_word double, chars_per_token double, byte_share double, token_entropy double, peak_entropy double, other_script boolean"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_NAMES = [x.split()[0] for x in f"{BASE}, {MEASURES}".split(", ")]
_TYPES = [pa.int64()] * 5 + [pa.float64()] * 5 + [pa.bool_()]
_PIECES: dict = {}


class Pieces:
    """How many pieces, and how many byte pieces, a word gives under the vocabulary with byte fallback."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.starts = np.array([self.model.id_to_piece(i).startswith("\u2581") for i in range(self.model.get_piece_size())])
        self.known: dict[int, int] = {}  # pieces, and byte pieces in the low bits

    @classmethod
    def shared(cls, model: str) -> Pieces:
        if model not in _PIECES:
            _PIECES[model] = cls(model)
        return _PIECES[model]

    def counts(self, h: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Pieces and byte pieces of each distinct word; ``h`` are the words' hashes."""
        if len(self.known) > CACHE:
            self.known.clear()
        keys = h.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            found = [words[i].decode() for i in new]
            # side by side, each word begins at the piece that has the white-space marker
            ids = np.array(self.model.encode(" ".join(found), num_threads=1), np.int64)
            word = np.cumsum(self.starts[ids]) - 1
            if len(ids) and word[-1] == len(found) - 1 and word[0] == 0:
                made = np.bincount(word, minlength=len(found)), np.bincount(word, self.is_byte[ids], len(found)).astype(np.int64)
            else:
                each = [np.array(x, np.int64) for x in self.model.encode(found, num_threads=1)]
                made = np.array([len(x) for x in each]), np.array([int(self.is_byte[x].sum()) for x in each])
            self.known.update(zip((keys[i] for i in new), ((made[0].astype(np.int64) << 32) + made[1]).tolist(), strict=True))
        both = np.array([self.known[k] for k in keys], np.int64)
        return np.stack([both >> 32, both & 0xFFFFFFFF], axis=1)


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the words' values in each document."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def base_counts(b: kernel.Block) -> tuple[kernel.Words, list[np.ndarray]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a block."""
    data, off = b.data, b.offsets
    w, h = kernel.words(b, lower=False)
    blank = kernel.SPACES[data]
    count = np.diff(w.first)
    docs = np.arange(len(count))
    chars = _per_doc(((data & 0xC0) != 0x80) & ~blank, off) if len(data) else np.zeros(len(count), np.int64)
    symbols = _per_doc(SYMBOLS[data].astype(np.int64), off)
    # lines with a word, by a hash of the line and its document
    lines = kernel.runs(data != 10, off)
    cut = np.searchsorted(w.start, lines.start), np.searchsorted(w.start, lines.end)
    full = cut[1] > cut[0]
    doc = np.repeat(docs, np.diff(lines.first))[full]
    own = kernel.mix(kernel.hashes(data, lines.start[full], lines.end[full]) ^ (doc.astype(np.uint64) * np.uint64(kernel.BASE)))
    _, kept = np.unique(own, return_index=True)
    dup = np.bincount(doc, minlength=len(count)) - np.bincount(doc[kept], minlength=len(count))
    # words in three-word windows that are found twice or more
    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        at = np.repeat(docs, count)
        begin = np.flatnonzero(at[2:] == at[:-2])
        window = h[begin] * kernel._salts[0] + h[begin + 1] * kernel._salts[1] + h[begin + 2] * kernel._salts[2]
        window = kernel.mix(window ^ (at[begin].astype(np.uint64) * np.uint64(kernel.BASE)))
        order = np.argsort(window, kind="stable")
        s = window[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = begin[order[twice]]
        for k in range(3):
            repeated[hit + k] = True
    return w, [count, chars, symbols, dup, _per_doc(repeated.astype(np.int64), w.first)]


def measures(b: kernel.Block, w: kernel.Words, chars: np.ndarray, bpe: UnitEncoder, pieces: Pieces) -> list[np.ndarray]:
    """The columns of MEASURES of each document of a block."""
    data, n = b.data, len(b.offsets) - 1
    count = np.diff(w.first)
    zero = np.zeros(n)
    wide = _per_doc((data >= 0x80).astype(np.int64), b.offsets)
    other = wide > OTHER_SCRIPT * np.maximum(np.diff(b.offsets), 1)
    if not len(w.start):
        return [zero, zero, zero, zero, zero, other]
    h = kernel.hashes(data, w.start, w.end)
    _, at, inv = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    distinct = [raw[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
    # the slots of a leading space and the word have hashes of their own
    own = kernel.mix(h[at] ^ np.uint64(0xA24BAED4963EE407))
    every, to = bpe.spread(bpe.slots(own, raw, w.start[at], w.end[at], b" ")[inv])
    tokens = to[w.first[1:]] - to[w.first[:-1]]
    # how often each document has each of its tokens
    key = np.sort((np.repeat(np.arange(n), tokens) << 17) | every)
    edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    times, of = np.diff(edge), key[edge[:-1]] >> 17
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, times)
    spread = np.bincount(of, times * np.log2(times), n)
    two = pieces.counts(h[at], distinct)[inv]
    made, byte = _per_doc(two[:, 0], w.first), _per_doc(two[:, 1], w.first)
    some = np.maximum(tokens, 1)
    return [
        tokens / np.maximum(count, 1),
        (chars + count) / some * (count > 0),
        byte / np.maximum(made, 1),
        np.maximum(np.log2(some) - spread / some, 0.0) * (count > 0),
        -np.log2(np.maximum(top, 1) / some) * (count > 0),
        other,
    ]


def measured(docs: DataFrame, name: str, vocabulary: str | None = None, ranks: str | None = None, model: str | None = None) -> DataFrame:
    """The documents with the base counts and the measures of each text as the struct column ``name``."""
    if name in docs.columns:
        raise ValueError(f"the table has a column {name}")

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':') for x in f'{BASE}, {MEASURES}'.split(', '))}>")
    def run(texts: pa.Array) -> pa.Array:
        bpe, pieces = UnitEncoder.shared(vocabulary, ranks), Pieces.shared(model or tokenizer_path("piece_bpe_32k.model"))
        parts = []
        for b in kernel.blocks(texts):
            w, base = base_counts(b)
            parts.append([c.astype(np.int64) for c in base] + measures(b, w, base[1], bpe, pieces))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)] if parts else [pa.array([], t) for t in _TYPES], names=_NAMES)

    return docs.withColumn(name, run(F.col("text")))


def judged(docs: DataFrame, name: str = "quality") -> DataFrame:
    """The documents with one more struct column ``name``: the base counts, the measures, base_failed and kept."""
    out = measured(docs, name)
    m = {c: F.col(name)[c] for c in _NAMES}
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    listed = [k for k in BANDS if k not in ("latin", "other")]
    unlisted = F.coalesce(~F.col("lang").isin(listed), F.lit(True))
    ok = F.lit(False)
    for band, limits in BANDS.items():
        here = m["other_script"] if band == "other" else ~m["other_script"] & (unlisted if band == "latin" else F.coalesce(F.col("lang") == band, F.lit(False)))
        inside = F.lit(True)
        for c, (low, high) in limits.items():
            inside &= m[c].between(low, high)
        ok |= here & inside
    return out.withColumn(name, F.struct(*[x.alias(c) for c, x in m.items()], failed.alias("base_failed"), (~failed & ok).alias("kept")))


def quality(docs: DataFrame) -> DataFrame:
    """Columns doc_id, the base counts, base_failed, kept, and the measures of each document."""
    m = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), "q")
    return m.select("doc_id", *[f"q.{c}" for c in (*_NAMES[:5], "base_failed", "kept", *_NAMES[5:10])])
