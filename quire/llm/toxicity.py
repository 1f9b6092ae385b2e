"""Toxicity by Levenshtein automata on a learned lexicon trie.

Learning, from a bounded sample of labelled rows: words, and prefixes that many words share, whose
contexts are toxic far more often than chance allows make the lexicon.  Support counts distinct
contexts (the words before and after), so copies of one document count once.  The lexicon is a trie;
its product with the automaton of at most one edit is made deterministic and finds every listed
word, stem and misspelling of them in one pass over the words of a text.  Around each hit a window of
characters tells quotation (quotation marks on both sides, or a word of reporting before) from abuse
(a second person nearby).  A logistic model over the counts, fitted on the same sample toward prior
weights, gives the score.

Null and empty texts score as texts without hits; very long texts are searched whole; an empty table
gives no rows.  Without a labelled row of each kind nothing is learned and every score is the prior's.
Repeated rows are scored each; a document labelled more than once is toxic if any label says so; of equal
evidence the term first by name comes first.  Other columns are passed through or ignored, whatever their
names; the score's column has the name that the caller picks, which the table must not have.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crossparse import alphabetic, code_points, fold
from .store import Scratch

#: Labelled rows in the sample.
SAMPLE_ROWS = 12_000
#: Lengths of the prefixes that can be stems (words have any length), shortest term with misspellings, most of a term's contexts that may be clean.
STEM, FUZZY, IMPURE = (3, 12), 5, 0.1
#: Characters of text that are searched at once, and of the window on either side of a hit.
SIDE, WINDOW = 1 << 20, 48

# Words that report speech, and words that address a reader.
REPORTS = frozenset("said says say called calls term word phrase wrote quoted quote sagte sagt wort nannte zitat dit mot appelé écrit dijo dice palabra llamó escribió".split())
ADDRESS = frozenset("you your you're yours u du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú ti tus usted ustedes".split())
QUOTES = re.compile("[\"“”„«»‹›‘]")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
#: Features: hits that are exact, misspelled, exact in quotation, misspelled in quotation, addressed; and the prior weights with the bias last.
PRIOR = np.array([2.5, 0.8, 0.3, 0.1, 0.5, -2.5])


class Lexicon:
    """The automaton of a lexicon: words and stems with at most one edit."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = sorted(set(words)), sorted(set(stems))
        chars = sorted({c for t in self.words + self.stems for c in t})
        # classes: 0 outside words, 1 a character of no term, then one for each character of a term
        word = alphabetic().copy()
        word[[*range(48, 58)]] = True
        self.classes = word.astype(np.uint16)
        for k, c in enumerate(chars):
            self.classes[ord(c)] = k + 2
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, set[str]] = {}
        depth = [0]
        for kind, terms in (("word", self.words), ("stem", self.stems)):
            for t in terms:
                node = 0
                for c in t:
                    k = int(self.classes[ord(c)])
                    if k not in trie[node]:
                        trie[node][k] = len(trie)
                        trie.append({})
                        depth.append(depth[node] + 1)
                    node = trie[node][k]
                ends.setdefault(node, set()).add(kind)
        self._determine(trie, ends, depth, len(chars) + 2)

    def _determine(self, trie: list, ends: dict, depth: list, width: int) -> None:
        """Subset construction over pairs of a trie node and the edits so far; -1 and -2 stand for a stem found without and with an edit."""

        def close(pairs: set) -> frozenset:
            out = set(pairs)
            for node, e in pairs:
                if node >= 0 and e == 0:
                    out |= {(child, 1) for child in trie[node].values()}
            for node, e in list(out):
                if node >= 0 and "stem" in ends.get(node, ()) and (e == 0 or depth[node] >= FUZZY):
                    out.add((-1 - e, e))
            return frozenset(p for p in out if not (p[1] == 1 and (p[0], 0) in out))

        def step(state: frozenset, c: int) -> frozenset:
            out = set()
            for node, e in state:
                if node < 0:
                    out.add((node, e))
                    continue
                if c in trie[node]:
                    out.add((trie[node][c], e))
                if e == 0:
                    out.add((node, 1))
                    out |= {(child, 1) for child in trie[node].values()}
            return close(out) if out else frozenset()

        first = close({(0, 0)})
        states = {frozenset(): 0, first: 1}
        table, todo = [[0] * width], [first]
        while todo:
            s = todo.pop(0)
            row = [0]
            other = None
            present = {c for node, _ in s if node >= 0 for c in trie[node]}
            for c in range(1, width):
                if c in present:
                    t = step(s, c)
                else:
                    t = other = step(s, 1) if other is None else other
                if t not in states:
                    states[t] = len(states)
                    todo.append(t)
                row.append(states[t])
            table.append(row)
        order = sorted(states, key=states.get)
        self.table = np.array(table, np.int32)
        self.accept = np.array([self._kind(s, ends, depth) for s in order], np.int8)

    @staticmethod
    def _kind(state: frozenset, ends: dict, depth: list) -> int:
        """1 for an exact hit, 2 for a misspelled one."""
        if any(node == -1 or e == 0 and node >= 0 and "word" in ends.get(node, ()) for node, e in state):
            return 1
        return 2 if any(node == -2 or e == 1 and node >= 0 and "word" in ends.get(node, ()) and depth[node] >= FUZZY for node, e in state) else 0

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and kind of the words of a text (code points, lower case) that the automaton accepts."""
        cls = self.classes[codes]
        inside = np.concatenate([[0], (cls > 0).view(np.int8), [0]])
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        state = np.ones(len(start), np.int32)
        live = np.arange(len(start))
        at = start.copy()
        while len(live):
            state[live] = self.table[state[live], cls[at[live]]]
            at[live] += 1
            live = live[(state[live] > 0) & (at[live] < end[live])]
        kind = self.accept[state] * (at == end)
        hit = np.flatnonzero(kind)
        return start[hit], end[hit], kind[hit]


_LEXICA: dict = {}


def lexicon(words: list[str], stems: list[str]) -> Lexicon:
    key = hashlib.sha256(repr((words, stems)).encode()).hexdigest()
    if key not in _LEXICA:
        _LEXICA.clear()
        _LEXICA[key] = Lexicon(words, stems)
    return _LEXICA[key]


def context(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a hit is quoted, and whether it is addressed to someone, by its window."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    last, said = before[-1:], WORD.findall(before)
    near = said[-3:] + WORD.findall(after)[:3]
    marks = (QUOTES.search(last) or len(QUOTES.findall(before)) % 2) and QUOTES.search(after)
    return bool(marks) or any(w in REPORTS for w in said[-3:]), any(w in ADDRESS for w in near)


def features(lex: Lexicon, texts: list[str | None]) -> np.ndarray:
    """The counts of the features of each text."""
    out = np.zeros((len(texts), len(PRIOR) - 1))
    held: list[tuple[int, str]] = []
    total = 0

    def settle() -> None:
        joined = "\n".join(t for _, t in held)
        cut = np.cumsum([0] + [len(t) + 1 for _, t in held])
        start, end, kind = lex.hits(code_points(joined))
        for s, e, k in zip(start.tolist(), end.tolist(), kind.tolist(), strict=True):
            at = int(np.searchsorted(cut, s, "right")) - 1
            i, t = held[at]
            quoted, addressed = context(t, s - int(cut[at]), e - int(cut[at]))
            out[i, (k - 1) + 2 * quoted] += 1
            out[i, 4] += addressed and not quoted

    for i, t in enumerate(texts):
        if t:
            held.append((i, t.lower()))
            total += len(t)
        if total >= SIDE:
            settle()
            held, total = [], 0
    if held:
        settle()
    return np.log1p(out) * 1.5


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights with a Gaussian prior around PRIOR, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 2.0 * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + 2.0 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return w


def learn_terms(sample: DataFrame, scratch: Scratch) -> tuple[list[str], list[str]]:
    """Words and stems whose contexts in a labelled sample (text, toxic) are toxic too often for chance."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    each = sample.select("toxic", words.alias("w")).select("toxic", F.expr("inline_outer(transform(sequence(1, greatest(size(w), 1)), i -> struct(get(w, i - 1) as word, xxhash64(get(w, i - 2), get(w, i)) as ctx)))"))
    each = each.where("word is not null").groupBy("word", "ctx").agg(F.min("toxic").alias("toxic"))
    by_word = scratch.keep(each.groupBy("word").agg(F.sum("toxic").cast("long").alias("k"), F.count(F.lit(1)).alias("n")), "words")
    stems = F.expr(f"transform(sequence(least({STEM[0]}, length(word)), least({STEM[1]}, length(word))), i -> substring(word, 1, i))")
    by_stem = by_word.select(F.explode(stems).alias("stem"), "word", "k", "n").groupBy("stem").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "n", "word")).alias("top"))
    whole = by_word.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms")).first()
    if not whole.n or not whole.k or whole.k == whole.n:
        return [], []
    rate = whole.k / whole.n
    # a term's clean contexts must be few; its toxic ones must be more than chance gives in any of all terms
    need = math.log(10.0 * whole.terms)
    k, n = F.col("k"), F.col("n")
    gain = k * F.log(k / n / rate) + F.when(n > k, (n - k) * F.log((n - k) / n / (1 - rate))).otherwise(0.0)
    # what passes is a part of the bounded sample's words
    rows = by_stem.withColumn("gain", gain).where((k >= 4) & (n - k <= IMPURE * n) & (F.col("gain") >= need)).orderBy(F.desc("gain"), "stem").collect()
    out_words: set[str] = set()
    out_stems: set[str] = set()
    begins: set[str] = set()  # what words and stems begin with
    # by evidence: a stem yields to a longer one, and to a word that makes most of it, only where those say more
    for r in rows:
        if r.stem in begins or any(r.stem[:i] in out_stems for i in range(1, len(r.stem) + 1)):
            continue
        if r.top.k >= 0.8 * r.k:
            if any(r.top.word[:i] in out_stems for i in range(1, STEM[1] + 1)):
                continue
            term = r.top.word
            out_words.add(term)
        elif len(r.stem) >= STEM[0]:
            term = r.stem
            out_stems.add(term)
        else:
            continue
        begins |= {term[:i] for i in range(1, STEM[1] + 1)}
    return sorted(out_words), sorted(out_stems)


class Scorer:
    """A learned lexicon with its weights."""

    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray):
        self.words, self.stems, self.weights = words, stems, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = features(lexicon(self.words, self.stems), texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Scorer:
    """A scorer from at most SAMPLE_ROWS labelled rows: those with the smallest hash of the id among the ones ``train`` allows."""
    ids = labels.where("toxic is not null and doc_id is not null")
    ids = ids if train is None else ids.where(train)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS rows of 12 bytes
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    sample = scratch.keep(sample.select("toxic", "text"), "sample")
    words, stems = learn_terms(sample, scratch)
    if not words and not stems:
        scratch.drop("")
        return Scorer([], [], PRIOR.copy())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(words, stems)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(lex, batch.column(1).to_pylist())), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(count, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    scratch.drop("")
    rows = sorted(rows, key=lambda r: (r.toxic, tuple(r.x)))
    x = np.repeat(np.array([r.x for r in rows]), [r.n for r in rows], axis=0)
    y = np.repeat(np.array([float(r.toxic) for r in rows]), [r.n for r in rows])
    return Scorer(words, stems, fit(x, y))


def scored(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """The documents with the score of each text in one more column, whose name the table must not have."""
    if name in docs.columns:
        raise ValueError(f"the table has a column {name}")
    words, stems, weights = scorer.words, scorer.stems, scorer.weights

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(Scorer(words, stems, weights).scores(texts.to_pylist()), pa.float64())

    return docs.withColumn(name, run(F.col("text")))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, score, predicted: learned from the labelled rows whose fold of 5 is not 0."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(own, learn(docs, labels, fold(5) != 0))
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
