"""Tree concatenation, periodic runs and importance resampling against the library and brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import pii, resample, runs, tagpaths, wordbpe

from .test_llm import EDGE, D, table


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(wordbpe.tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


# tree concatenation

ODD = [*"abcdefghij't's're <|>endoftext \n\t", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "é", "é", "̸", ">", "İ", "Σ", "ς", "ẞ", "中", "😀", " ", "\u0085", "​", "\x1c", " ", "　", "ﬁ", "١", "½", "Å", "'S", "\0", "K"]


def test_units_equal_the_library(library):
    r, codec = random.Random(5), wordbpe.Codec.shared()
    for _ in range(3000):
        t = "".join(r.choice(ODD) for _ in range(r.randint(0, 40)))
        n, ids, back = codec.digest(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert list(map(int, ids.split())) == want and n == len(want), t
        assert back.decode() == library.decode(want, skip_special_tokens=False)
        assert codec.decode(want) == back.decode()


@pytest.mark.parametrize("half", [1, 2, 5, 24])
def test_halves_equal_the_library(library, monkeypatch, half):
    monkeypatch.setattr(wordbpe, "HALF", half)
    r, codec = random.Random(half), wordbpe.Codec.shared()
    for k in range(400):
        w = "".join(r.choice("abehtinsr") for _ in range(r.randint(1, 300)))
        w = (w[:3] * 80 if k % 3 == 0 else w).encode()
        want = library.encode(w.decode(), add_special_tokens=False).ids
        assert codec.encode_words([w]) == want
        parts = wordbpe.halves(w, 7)
        assert b"".join(parts) == w
        assert codec.tree([codec.encode_symbols(codec.symbols(p, k == len(parts) - 1)) for k, p in enumerate(parts)]) == want


def test_a_window_grows_until_both_sides_agree():
    codec = wordbpe.Codec.shared()
    seen = []
    merged = codec.merged
    try:
        codec.merged = lambda tokens: seen.append(len(tokens)) or merged(tokens)
        word = b"internationalisation" * 3
        left, right = (merged(codec.symbols(p, k)) for k, p in enumerate((word[:31], word[31:])))
        assert codec.concatenated(left, right) == merged(codec.symbols(word))
        assert len(seen) > 1 and seen == sorted(seen) and seen[-1] < len(word)
    finally:
        codec.merged = merged


@pytest.mark.parametrize("leaf", [48, 1 << 16])
def test_documents_equal_the_library(spark, docs, library, leaf):
    """Nearly all texts are cut into rows of 48 bytes, then none."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r[1:] for r in wordbpe.encoded(docs, leaf=leaf).collect()}
    assert got == {d: by_library(library, t) for d, t in texts.items()}


def test_long_words_over_rows(spark, library):
    r = random.Random(2)
    unsplit = "".join(r.choice("etaoinshr") for _ in range(3000))
    mixed = "abc1" * 300 + "<|endoftext|>" + "É" * 500 + "don't" * 200 + " " + "x" * 999
    rows = [(1, unsplit), (2, unsplit), (3, mixed), (4, f"a {unsplit} b\n{mixed} c"), (5, " " * 400), (6, " " * 300), (7, None), (None, unsplit)]
    out = wordbpe.encoded(table(spark, rows), with_ids=True, leaf=64)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    assert got == sorted((d or 0, *by_library(library, t)) for d, t in rows)
    back = {r.doc_id: r.text for r in wordbpe.decoded(out.where("doc_id < 4"), plain=True).collect()}
    assert back[1] == unsplit
    listed = wordbpe.decoded(spark.createDataFrame([(1, None), (2, [0, 49407, 60000])], "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.text for r in listed} == {1: "", 2: "! <|endoftext|>"}


# runs


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_runs_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    r = random.Random(chunk)
    for k in range(1500):
        m = r.choice([1, 2, 2, 3, 5])
        w = [r.randint(0, m) for _ in range(r.randint(0, 70))]
        if k % 2:
            a = r.randint(0, len(w))
            w[a:a] = [r.randint(0, m) for _ in range(r.randint(1, 9))] * r.randint(3, 8)
        assert [tuple(x) for x in runs.find_runs(np.array(w, np.int64)).tolist()] == brute_runs(w)


def test_names_tell_equal_windows():
    codes = np.array([0, 1, 0, 1, 0, 1, 2, 0, 1])
    named = runs.levels(codes)
    for k, names in enumerate(named):
        windows = [tuple(codes[i : i + 2**k]) for i in range(len(names))]
        assert [[a == b for b in names] for a in names] == [[a == b for b in windows] for a in windows]
    i, j = np.array([0, 2, 0]), np.array([2, 4, 7])
    assert runs.forward(named, i, j).tolist() == [4, 2, 2] and runs.backward(named, i, j).tolist() == [0, 2, 0]


def test_a_word_a_million_times():
    rows = runs.find_runs(np.zeros(200_000, np.int64))
    assert rows.tolist() == [[0, 200_000, 1]] and runs.kept(200_000, rows).sum() == 1


def expected_runs(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), hashlib.sha256(rest).hexdigest())


def test_documents_equal_brute_force(spark, docs):
    small = docs.where(F.length("text") < 6000)
    got = {r.doc_id: r[1:] for r in runs.collapsed(small, planted=True).collect()}
    assert got == {r.doc_id: expected_runs(r.doc_id, r.text) for r in small.collect()}
    assert sum(v[0] > 0 for v in got.values()) >= 5


def test_runs_of_edge_rows(spark):
    rows = [(i, t if len(t or "") < 1000 else "a b " * 300 + "c") for i, t in EDGE] + [(20, "x " * 9), (21, "x x x x x"), (22, "a b c a b c a b c a b c z"), (22, "a b c a b c a b c a b c z")]
    out = runs.collapsed(table(spark, rows), planted=True, with_text=True)
    assert out.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    got = sorted((tuple(r)[:8] for r in out.collect()), key=key)
    assert got == sorted(((d, *expected_runs(d, t)) for d, t in rows), key=key)
    plain = {r.doc_id: (r.runs, r.collapsed) for r in runs.collapsed(table(spark, rows), with_text=True).collect()}
    assert plain[20] == ([[0, 9, 1]], "x") and plain[21] == ([], "x x x x x") and plain[22] == ([[0, 12, 3]], "a b c z")
    assert runs.collapsed(table(spark, []), planted=True).count() == 0 == wordbpe.encoded(table(spark, [])).count()


# importance resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return len(w), Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def brute_resample(docs, target, share=25, least=20, n_buckets=10_000):
    s, t, own = Counter(), Counter(), []
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    for side, rows in ((s, docs), (t, target)):
        for d, text in rows:
            n, f = features(text)
            for x, k in f.items():
                side[bucket(x)] += k
            if side is s:
                own.append((d, n, f))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + n_buckets) / ((s[b] + 1) * (total_t + n_buckets))))
    out = []
    for d, n, f in own:
        size = sum(f.values())
        weight = sum(k * gain(bucket(x)) for x, k in f.items()) // size if size else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: share * len(able) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize(("block", "part"), [(8 << 20, 16 << 20), (5000, 20_000)])
def test_draw_equals_brute_force(spark, docs, monkeypatch, block, part):
    """In one block and part, then in many of each."""
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "PART", part)
    target = spark.read.parquet(f"{D}/benchmark.parquet")
    got = sorted((tuple(r) for r in resample.resampled(docs, target).collect()), key=str)
    assert got == brute_resample([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in target.collect()])
    assert sum(r[4] is not None for r in got) > 20


def test_draw_of_edge_rows(spark):
    rows = [*EDGE, (12, "Ünïcode 中文 a1 B2 c3 " * 9), (13, "x " * 40), (13, "x " * 40), (14, "same words " * 30), (15, "same words " * 30)]
    target = [(1, "same words here"), (2, None), (None, "x y")]
    out = resample.resampled(table(spark, rows), table(spark, target), share=60)
    assert out.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted(map(tuple, out.collect()), key=str) == brute_resample(rows, target, share=60)
    assert resample.resampled(table(spark, []), table(spark, target)).count() == 0
    alone = resample.resampled(table(spark, rows), table(spark, []))
    assert sorted(map(tuple, alone.collect()), key=str) == brute_resample(rows, [])


def test_a_string_is_hashed_once(spark, docs, monkeypatch):
    """A part has each of its strings once for each block, and no string is in two parts."""
    monkeypatch.setattr(resample, "BLOCK", 20_000)
    rows = [r for r in resample.blocks(docs, 5, 0, True, ["the", "and"]).collect() if r.kind]
    strings = {(r.block, r.part): resample._raw(r.features).decode().split("\n") for r in rows}
    assert all(len(set(v)) == len(v) for v in strings.values()) and len({b for b, _ in strings}) > 3
    where = {}
    assert all(where.setdefault(f, p) == p for (_, p), v in strings.items() for f in v)
    total = Counter()
    for r in rows:
        for f, n in zip(strings[r.block, r.part], resample._unpack(r.counts, np.int32).tolist(), strict=True):
            total[f] += n
    want = Counter()
    for r in docs.collect():
        want += features(r.text)[1]
    assert total == want


# what earlier rounds lost


def test_letters_whose_lower_case_is_longer(spark):
    body = "Before the script stands a sentence, and another one. " * 4
    page = f"<html><body><article><p>{'İ' * 300} {body}</p><SCRIPT>var x = '</p>';</ScRiPt><p>After the script: {body}</p></article></body></html>"
    text = tagpaths.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text
    assert text == f"{'İ' * 300} {body.strip()}\nAfter the script: {body.strip()}"


def test_texts_of_one_id_are_judged_apart(spark):
    text = lambda seed: " ".join(random.Random(seed).choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(random.Random(seed * 1000 + k).randint(0, 99)) for k in range(80))
    near = lambda t: t.replace(t.split()[40], "changed", 1)
    a, b, c, x = text(1), text(2), text(3), text(4)
    rows = [(1, a), (5, a), (5, b), (7, c), (3, x), (8, near(x)), (8, text(5)), (8, text(5)), (9, near(text(5))), (None, a), (2, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, D).collect()]
    want = [(1, a), (5, b), (7, c), (3, x), (8, text(5)), (8, text(5)), (None, a), (2, None), (4, ""), (4, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def personal(n):
    """A text of n addresses, numbers and other words, with their spans."""
    text, spans, at = [], [], 0
    for k in range(n):
        kind, v = [("email", f"user{k}@mail{k % 7}.example"), ("ip", f"10.0.{k % 256}.{k // 256 % 256}"), ("phone", f"+49 30 {1000000 + k}")][k % 3]
        gap = f"é😀 {'x' * (k % 5)} "
        spans.append((kind, at + len(gap), at + len(gap) + len(v)))
        text.append(gap + v + ", ")
        at += len(text[-1])
    return "".join(text), spans


def test_spans_of_long_lists(spark):
    """Runs of spans give what one list would, and 100,000 spans in a text take seconds."""
    import time

    took = {}
    for n in (3, 127, 128, 129, 700, 10_000, 100_000):
        text, want = personal(n)
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        got = [(s.kind, s.start, s.end) for s in pii.base_spans(df).first().spans]
        took[n] = time.time() - began
        order = {k: i for i, k in enumerate(pii.KINDS)}
        assert got == sorted(want, key=lambda s: (order[s[0]], s[1]))
    assert took[100_000] < 60 and took[100_000] < 40 * took[10_000]


def by_hand(text, spans):
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_generalised_text(spark):
    r = random.Random(4)
    kind = "i int, text string, spans array<struct<kind:string,start:int,end:int,value:string>>, further string"
    rows = [(0, "﻿ab﻿cd", [("term", 1, 2, ""), ("ip", 3, 4, "")], "f"), (1, None, None, "f"), (2, "none", [], "f"), (3, "", [], "f"), (4, "all", [("email", 0, 3, "")], "f")]
    for i in range(5, 60):
        text = "".join(r.choice("ab é😀﻿\n") for _ in range(r.randint(1, 900)))
        spans = []
        for _ in range(r.randint(0, 300)):
            a = r.randint(0, len(text) - 1)
            spans.append((r.choice(["email", "term", "card"]), a, min(len(text), a + r.randint(1, 6)), "v"))
        rows.append((i, text, spans, "f"))
    got = pii.generalised(spark.createDataFrame(rows, kind), "text", "spans")
    assert got.columns == ["i", "text", "spans", "further"]
    assert {x.i: x.text for x in got.collect()} == {i: None if t is None else by_hand(t, [(a, b, k) for k, a, b, _ in s]) for i, t, s, _ in rows}


def test_sanitising_a_long_list(spark):
    text, _ = personal(20_000)
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "plain", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    found = pii.find(docs).where("doc_id = 1").first()
    spans = [(s.start, s.end, s.kind) for s in (*found.base, *found.terms)]
    assert len(found.base) == 20_000
    assert out[1].text == by_hand(text, spans) and out[1].n_chars == len(out[1].text) and out[2].text == "plain"


def test_a_block_of_features_takes_little_memory():
    """Pairs are told apart in slices: Arrow's share of the peak stays below nine bytes for each byte of text, and kinds are those of all at once."""
    r = np.random.default_rng(5)
    texts = pa.array([" ".join(map(str, r.zipf(1.2, 4000) % 50_000)) for _ in range(150)])
    own, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        made = resample.Counted(texts, 3, pa.array([], pa.large_string()))
    finally:
        pa.set_memory_pool(own)
    assert pool.max_memory() < 9 * texts.nbytes
    features = Counter(f for t in texts.to_pylist() for w in [t.split(" ")] for f in [*w, *map(" ".join, itertools.pairwise(w))])
    got = Counter()
    for _, strings, counts in made.rows:
        got.update(dict(zip(resample._raw(strings).decode().split("\n"), resample._unpack(counts, np.int32).tolist(), strict=True)))
    assert got == features


@pytest.mark.parametrize("weighed", [1, 7, 1 << 19])
def test_weights_do_not_depend_on_how_many_are_weighed_together(monkeypatch, weighed):
    monkeypatch.setattr(resample, "WEIGHED", weighed)
    places, times = [[0, 3, 4], [], [2], [1, 2, 3, 4, 5, 6, 7, 8, 9], []], [[1, 2, 1], [], [7], [1] * 9, []]
    bucket, gain = np.arange(10)[::-1].astype(np.uint16), np.arange(10) * 37 - 100
    held = np.concatenate([np.diff(p, prepend=0) for p in places]).astype(np.int32)
    n, weight = resample._sums(np.array([len(p) for p in places]), held, np.concatenate(times).astype(np.int32), bucket, gain)
    assert n.tolist() == [sum(t) for t in times]
    assert weight.tolist() == [sum(int(gain[bucket[p]]) * k for p, k in zip(ps, ts, strict=True)) // max(1, sum(ts)) for ps, ts in zip(places, times, strict=True)]
