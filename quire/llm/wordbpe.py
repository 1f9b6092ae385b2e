"""Byte-pair encoding with word ends by tree concatenation, and its decoding.

The vocabulary is a public file with its merges in order, a split pattern, and special tokens.  White space
separates what is encoded, so a text is a sequence of units, and units split into words by the pattern.
A word that is not split any further may be long: its halves are encoded apart, down to ``HALF`` symbols, and
concatenated: a window around the join, at first one token of each side, is encoded again and grows on each side
until its outer tokens are those that the sides have there.  The result is exact: a sequence of tokens
is the encoding of its symbols when each two neighbours are the encoding of theirs, and every two neighbours
of the result stand side by side in one of the three encodings.

A text of up to ``LEAF`` code points is encoded in its row.  Longer ones, each distinct text once, are cut into
rows of about ``LEAF`` bytes, at white space or between words where they have any and else into halves of a word; the rows
are encoded in parallel by whatever tasks they are dealt to, and those of a text then meet in one row of ids, where halves
are concatenated as a tree.

Null texts are empty: no ids, the hash of nothing.  Repeated rows and rows without an id are rows of their own;
an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer_path

#: Code points of a text that one row takes; longer texts are spread over rows.
LEAF = 1 << 16
#: Symbols whose merges are found in one go; longer words are encoded by halves.
HALF = 24
#: Distinct units, and distinct words, that a worker keeps at least once it has seen as many, and bytes of the longest unit that is kept.
CACHE, LONG = 250_000, 64
_CODECS: dict = {}


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)]


class Codec:
    """Ids of units and words under a vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = dict(model["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: the rank of each pair of tokens that merges, and the token of each rank
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank, self.made = {a << 20 | b: r for r, (a, b, _) in enumerate(pairs)}, [c for _, _, c in pairs]
        chars = byte_chars()
        self.inner, self.last = [vocab[c] for c in chars], [vocab[c + end] for c in chars]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in (vocab | self.special).items():
            self.names[i] = name
        byte = {c: b for b, c in enumerate(chars)}
        self.end = end
        # the bytes of each token, and whether it ends a word
        self.ends = [n.endswith(end) for n in self.names]
        self.bytes = [n.encode() if n in self.special else bytes(byte[c] for c in n.removesuffix(end)) for n in self.names]
        self.shown = [n.encode() for n in self.names]
        # what was found since the cache was last full, and in the time before
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.before: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.word_ids: dict[bytes, list[int]] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> Codec:
        """One codec for each worker process and vocabulary."""
        path = path or tokenizer_path("word_bpe_49k.json")
        if path not in _CODECS:
            _CODECS[path] = cls(path)
        return _CODECS[path]

    def symbols(self, word: bytes, whole: bool = True) -> list[int]:
        """The first tokens of a word's bytes; the last one ends it unless the word goes on."""
        out = [self.inner[b] for b in word]
        if whole and word:
            out[-1] = self.last[word[-1]]
        return out

    def merged(self, tokens: list[int]) -> list[int]:
        """Merges neighbours by rank, the leftmost of a rank first, until none merge."""
        rank, made, none = self.rank.get, self.made, len(self.made)
        out = list(tokens)
        ranks = [rank(a << 20 | b, none) for a, b in zip(out, out[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            out[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(out[i - 1] << 20 | out[i], none)
            if i < len(ranks):
                ranks[i] = rank(out[i] << 20 | out[i + 1], none)
        return out

    def unfold(self, tokens: list[int]) -> list[int]:
        """The symbols that tokens were merged from."""
        return [s for t in tokens for s in self.symbols(self.bytes[t], self.ends[t])]

    def concatenated(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded halves together."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            lo, hi = max(0, len(left) - a), min(b, len(right))
            window = self.merged(self.unfold(left[lo:] + right[:hi]))
            agrees, follows = lo == 0 or window[0] == left[lo], hi == len(right) or window[-1] == right[hi - 1]
            if agrees and follows:
                return left[:lo] + window + right[hi:]
            a, b = a if agrees else 2 * a, b if follows else 2 * b

    def tree(self, parts: list[list[int]]) -> list[int]:
        """The encoding of neighbouring parts, joined two by two."""
        while len(parts) > 1:
            parts = [self.concatenated(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode_symbols(self, tokens: list[int]) -> list[int]:
        """The encoding of a word's symbols, by halves where it is long."""
        if len(tokens) <= HALF:
            return self.merged(tokens)
        mid = len(tokens) // 2
        return self.concatenated(self.encode_symbols(tokens[:mid]), self.encode_symbols(tokens[mid:]))

    def words(self, text: str) -> list[bytes]:
        """The words of a text without special tokens, normalised: composed, and lower case character by character."""
        lower = text.lower() if text.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        return [w.encode() for w in self.word.findall(lower)]

    def encode_words(self, words: list[bytes]) -> list[int]:
        out, known = [], self.word_ids
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self.encode_symbols(self.symbols(w))
                if len(w) <= HALF:
                    if len(known) >= CACHE:
                        known.clear()
                    known[w] = ids
            out += ids
        return out

    def parts(self, unit: str) -> list[str]:
        """A unit cut at its special tokens, which stay as parts of their own."""
        return [p for p in self.cut.split(unit) if p] if self.cut and self.cut.search(unit) else [unit]

    def encode_unit(self, unit: str) -> list[int]:
        return [i for p in self.parts(unit) for i in ([self.special[p]] if p in self.special else self.encode_words(self.words(p)))]

    def of(self, unit: bytes) -> tuple[int, bytes, bytes]:
        """Of a unit: its number of ids, these in decimal, and their tokens, both joined by blanks."""
        if len(self.known) >= CACHE:
            self.known, self.before = {}, self.known
        out = self.before.get(unit)
        if out is None:
            ids = self.encode_unit(unit.decode())
            out = (len(ids), *self.written(ids))
        if len(unit) <= LONG:
            self.known[unit] = out
        return out

    def written(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b" ".join(b"%d" % i for i in ids), b" ".join(self.shown[i] for i in ids)

    def digest(self, text: str) -> tuple[int, bytes, bytes]:
        """Of a text: its number of ids, these in decimal, and the library's decoding of them."""
        # the cache may be replaced on the way
        found = [self.known.get(u) or self.of(u) for u in text.encode().split()]
        found = [f for f in found if f[0]]
        return sum(f[0] for f in found), b" ".join([f[1] for f in found]), b" ".join([f[2] for f in found])

    def decode(self, ids) -> str:
        """Tokens joined by blanks, as the library decodes a vocabulary file that has no decoder; unknown ids give nothing."""
        return " ".join(self.names[i] for i in ids if 0 <= i < len(self.names))

    def text(self, ids) -> str:
        """The bytes of tokens joined, with a blank for each word's end."""
        return b"".join(self.bytes[i] + b" " * self.ends[i] for i in ids if 0 <= i < len(self.names)).decode("utf-8", "replace").removesuffix(" ")

    def rows(self, text: str, leaf: int) -> Iterator[tuple[str, bytes, bool, bool]]:
        """The rows that a long text is cut into: kind, data, whether it goes on with the word before, and whether its last word ends in it.

        Kind ``units`` is raw text between white space; kind ``words`` is words that need no splitting, with blanks between.
        """
        held: list[bytes] = []
        size = 0

        def flush(kind: str) -> Iterator[tuple[str, bytes, bool, bool]]:
            nonlocal held, size
            if held:
                yield kind, b" ".join(held), False, True
            held, size = [], 0

        for unit in text.encode().split():
            if len(unit) <= leaf:
                held.append(unit)
                size += len(unit) + 1
                if size >= leaf:
                    yield from flush("units")
                continue
            yield from flush("units")
            for part in self.parts(unit.decode()):
                if part in self.special:
                    yield "units", part.encode(), False, True
                    continue
                for word in self.words(part):
                    if len(word) <= leaf:
                        held.append(word)
                        size += len(word) + 1
                        if size >= leaf:
                            yield from flush("words")
                        continue
                    yield from flush("words")
                    pieces = halves(word, leaf)
                    for k, piece in enumerate(pieces):
                        yield "words", piece, k > 0, k == len(pieces) - 1
                yield from flush("words")
        yield from flush("units")

    def encode_row(self, kind: str, data: bytes, whole: bool) -> list[int]:
        if kind == "units":
            return [i for u in data.split() for i in self.encode_unit(u.decode())]
        words = data.split()
        return self.encode_words(words[:-1]) + self.encode_symbols(self.symbols(words[-1], whole))


def halves(word: bytes, leaf: int) -> list[bytes]:
    """A word cut in halves until each is of at most ``leaf`` bytes."""
    if len(word) <= leaf:
        return [word]
    mid = len(word) // 2
    return halves(word[:mid], leaf) + halves(word[mid:], leaf)


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def long_texts(texts: DataFrame, path: str | None = None, leaf: int = LEAF, with_ids: bool = False) -> DataFrame:
    """Of rows of key and text, one a key: key, and the result's columns; the rows a text is cut into are encoded in parallel."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.shared(path)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                for pos, (kind, data, joins, whole) in enumerate(codec.rows(text.as_py(), leaf)):
                    yield pa.RecordBatch.from_pylist([{"key": key.as_py(), "pos": pos, "kind": kind, "data": data, "joins": joins, "whole": whole}], cut_schema)

    cut_schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("kind", pa.string()), ("data", pa.binary()), ("joins", pa.bool_()), ("whole", pa.bool_())])
    rows = texts.select("key", "text").mapInArrow(cut, "key string, pos long, kind string, data binary, joins boolean, whole boolean")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.shared(path)
        for pdf in batches:
            ids = [np.array(codec.encode_row(k, d, w), "<u2").tobytes() for k, d, w in zip(pdf["kind"], pdf["data"], pdf["whole"], strict=True)]
            yield pdf[["key", "pos", "joins"]].assign(ids=ids)

    coded = rows.repartition("key", "pos").mapInPandas(encode, "key string, pos long, joins boolean, ids binary")

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        codec, done, open_ = Codec.shared(path), [], []
        for joins, ids in pdf.sort_values("pos")[["joins", "ids"]].itertuples(index=False):
            if not joins:
                done += codec.tree(open_)
                open_ = []
            open_.append(np.frombuffer(ids, "<u2").tolist())
        done += codec.tree(open_)
        shas = [_sha(b) for b in codec.written(done)]
        return pd.DataFrame({"key": [key[0]], "n_tokens": [len(done)], "ids_sha256": shas[:1], "decoded_sha256": shas[1:], "ids": [done]})

    out = coded.groupBy("key").applyInPandas(join, f"key string, {RESULT}, ids array<int>")
    return out if with_ids else out.drop("ids")


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = False, leaf: int = LEAF) -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, and its ids if asked."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    extra = ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.shared(path)
        for batch in batches:
            found = [(n, _sha(ids), _sha(back), ids) for n, ids, back in (codec.digest(t.as_py()) for t in batch.column(1))]
            cols = [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())]
            if with_ids:
                cols.append(pa.array([list(map(int, f[3].split())) for f in found], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    size = F.length("text")
    short = own.where(size <= leaf).mapInArrow(run, f"doc_id long, {RESULT}{extra}")
    long = own.where(size > leaf).withColumn("key", F.sha2("text", 256))
    once = long.groupBy("key").agg(F.first("text").alias("text"))
    made = long_texts(once, path, leaf, with_ids)
    # a text of nothing but white space has no rows
    none = F.sha2(F.lit("").cast("binary"), 256)
    back = long.select("doc_id", "key").join(made, "key", "left")
    filled = {"n_tokens": F.coalesce("n_tokens", F.lit(0)), "ids_sha256": F.coalesce("ids_sha256", none), "decoded_sha256": F.coalesce("decoded_sha256", none)}
    if with_ids:
        filled["ids"] = F.coalesce("ids", F.array().cast("array<int>"))
    return short.unionByName(back.withColumns(filled).select(*short.columns))


def decoded(rows: DataFrame, path: str | None = None, plain: bool = False) -> DataFrame:
    """Columns doc_id, text from rows of doc_id, ids: as the library decodes, or ``plain`` with blanks for word ends; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.shared(path)
        back = codec.text if plain else codec.decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([back(i.as_py() or []) for i in batch.column(1)], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
