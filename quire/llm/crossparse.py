"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of its labelled texts.  A text is
parsed against each automaton: from left to right, the longest match that the sample holds is one
phrase.  Phrases are normalised by the text's length and the logarithm of the sample's; the language
that needs least wins.  Letters count, in lower case; whatever stands between them is one gap.

Texts are parsed whole, in chunks side by side: each chunk is first parsed as if a phrase began with it,
then the phrase that crosses into it is carried on until a phrase begins where the chunk's own parse
begins one, from where both agree.  The few that never meet within a chunk are parsed from end to end.

Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing is
learned (no labelled row); an empty table gives no rows.  Ties go to the language first by name.
Repeated rows are scored each.  Columns other than doc_id, text and, to learn, lang are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The bounded sample: labelled rows of a language that are looked at, and characters of the whole texts taken of them.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 30_000
#: Characters of a chunk, and of the texts that are parsed side by side.
CHUNK, SIDE = 256, 1 << 20
_ALPHA: list[np.ndarray] = []
_MODELS: dict = {}


def alphabetic() -> np.ndarray:
    """Which code points are letters."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = now
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return to


class Model:
    """The automata of all languages in one table; symbol 0 is any letter that no sample has, 1 the gap between words."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s if c.isalpha()})
        self.symbol = np.where(alphabetic(), 0, 1).astype(np.uint16)
        for k, c in enumerate(letters):
            self.symbol[ord(c)] = k + 2
        self.width = len(letters) + 2
        tables, start, base = [], [], 0
        self.cost = []
        for lang in self.langs:
            s = self.squeeze(self.symbol[code_points(samples[lang])])
            made = suffix_automaton(s.tolist())
            t = np.full((len(made), self.width), -1, np.int32)
            for state, steps in enumerate(made):
                for c, q in steps.items():
                    t[state, c] = q + base
            tables.append(t)
            start.append(base)
            base += len(made)
            self.cost.append(math.log2(max(len(s), 2)))
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.start = np.array(start, np.int32)
        self.cost = np.array(self.cost)

    @staticmethod
    def squeeze(s: np.ndarray) -> np.ndarray:
        """Runs of gaps become one."""
        gap = s == 1
        return s[~(gap[1:] & gap[:-1])] if len(s) > 1 and len(s) == len(gap[1:]) else s[np.concatenate([[True], ~(gap[1:] & gap[:-1])])] if len(s) else s

    @classmethod
    def shared(cls, samples: dict[str, str]) -> Model:
        key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = cls(samples)
        return _MODELS[key]

    def _step(self, state: np.ndarray, start: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a phrase begins with each symbol, and the states after it."""
        now = self.table[state.astype(np.int64) * self.width + c]
        broken = now < 0
        again = self.table[start.astype(np.int64) * self.width + c]
        # a symbol that the sample lacks is a phrase by itself
        return broken | (state == start), np.where(broken, np.where(again < 0, start, again), now)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """The number of phrases of each text (symbols, none empty) under each language: rows of languages."""
        langs, docs = len(self.langs), len(texts)
        size = np.array([len(s) for s in texts])
        flat = np.concatenate(texts)
        first = np.concatenate([[0], np.cumsum(size)])
        # a lane is a chunk of a text; the longest come first
        many = -(-size // CHUNK)
        doc = np.repeat(np.arange(docs), many)
        at = np.repeat(first[:-1], many) + CHUNK * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
        end = np.minimum(at + CHUNK, first[1:][doc])
        order = np.argsort(at - end, kind="stable")
        begins = np.zeros((langs, len(flat)), bool)
        state = np.repeat(self.start, len(doc)).reshape(langs, -1)
        ranked, length = at[order], (end - at)[order]
        for j in range(int(length[0])):
            live = int(np.searchsorted(-length, -j, "left"))
            pos = ranked[:live] + j
            begins[:, pos], state[:, :live] = self._step(state[:, :live], self.start[:, None], flat[pos])
        last = np.empty_like(state)
        last[:, order] = state
        # the phrase that is open at a chunk's end goes on in the next one
        crosses = np.flatnonzero(doc[1:] == doc[:-1])
        meet = np.tile(at, (langs, 1))
        more = np.zeros((langs, docs), np.int64)
        never: set[tuple[int, int]] = set()
        lang, lane = np.repeat(np.arange(langs), len(crosses)), np.tile(crosses + 1, langs)
        now, pos = last[lang, lane - 1], at[lane]
        while len(lane):
            fresh, now = self._step(now, self.start[lang], flat[pos])
            met = fresh & begins[lang, pos]
            meet[lang[met], lane[met]] = pos[met]
            np.add.at(more, (lang[fresh & ~met], doc[lane[fresh & ~met]]), 1)
            pos = pos + 1
            out = ~met & (pos == end[lane])
            meet[lang[out], lane[out]] = end[lane[out]]
            open_end = out & (end[lane] < first[1:][doc[lane]])
            never |= set(zip(lang[open_end].tolist(), doc[lane[open_end]].tolist(), strict=True))
            on = ~met & ~out
            lang, lane, now, pos = lang[on], lane[on], now[on], pos[on]
        for k in range(langs):
            total = np.concatenate([[0], np.cumsum(begins[k], dtype=np.int64)])
            more[k] += np.bincount(doc, total[end] - total[meet[k]], docs).astype(np.int64)
        for k, d in never:
            more[k, d] = self._parse(k, texts[d])
        return more

    def _parse(self, lang: int, symbols: np.ndarray) -> int:
        """The number of phrases of a text, symbol by symbol."""
        table, width, start = memoryview(self.table), self.width, int(self.start[lang])
        state, count = start, 0
        for c in symbols.tolist():
            now = table[state * width + c]
            if now < 0 or state == start:
                count += 1
                now = table[start * width + c]
            state = start if now < 0 else now
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        langs: list[str] = ["und"] * len(texts)
        scores = [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        held: list[tuple[int, np.ndarray]] = []
        total = 0
        for i, t in enumerate(texts):
            s = self.squeeze(self.symbol[code_points((t or "").lower())])
            if not (s != 1).any():
                continue
            held.append((i, s))
            total += len(s)
            if total >= SIDE:
                self._settle(held, langs, scores)
                held, total = [], 0
        self._settle(held, langs, scores)
        return langs, scores

    def _settle(self, held: list[tuple[int, np.ndarray]], langs: list[str], scores: list[float]) -> None:
        if not held:
            return
        need = self.phrases([s for _, s in held])
        rate = need * self.cost[:, None] / np.array([len(s) for _, s in held])
        for k, (i, _) in enumerate(held):
            order = np.argsort(rate[:, k], kind="stable")
            langs[i] = self.langs[order[0]]
            scores[i] = float(1 - rate[order[0], k] / rate[order[1], k]) if len(order) > 1 else 1.0


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def samples(docs: DataFrame, train: Column) -> dict[str, str]:
    """The bounded sample of each language, from the rows that ``train`` allows.

    The number of a language's rows sets a bound on the hash of the id that keeps about SAMPLE_ROWS of
    them, so a language that holds most rows makes no task larger.  Of these, whole texts are taken in the
    order of the hash, a repeated one once, as long as they have SAMPLE_CHARS characters in all; of a
    language that has none as short, the shortest.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    bound = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))))])
    near = rows.where((F.col("h") < bound[F.col("lang")]) & (F.trim("text") != "")).groupBy("lang", "text").agg(F.min("h").alias("h")).withColumn("n", F.length("text"))
    short = F.col("n") <= SAMPLE_CHARS
    order = Window.partitionBy("lang").orderBy(F.when(short, -1).otherwise(F.col("n")), "h", "text")
    taken = near.withColumns({"total": F.sum("n").over(order), "rank": F.row_number().over(order)}).where((F.col("total") <= SAMPLE_CHARS) | (F.col("rank") == 1))
    out: dict[str, list[str]] = {}
    for r in taken.select("lang", "text", "rank").orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.text.lower())
    return {lang: " ".join(texts) for lang, texts in out.items()}


def identify(docs: DataFrame, learned: dict[str, str]) -> DataFrame:
    """Columns doc_id, lang_pred, score: the language of each text, from the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.shared(learned)
        for batch in batches:
            langs, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score: learned from the rows whose fold of 4 is not 2."""
    out = identify(docs, samples(docs, F.coalesce(fold(4) != 2, F.lit(False))))
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
