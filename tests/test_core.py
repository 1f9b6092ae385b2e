"""Hand-worked cases, properties, and a sample of queries against their SQL."""

import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import queries as Q
from quire.functions import text as T
from quire.operators import align, corrupt, intervals, layout, scores, sequences
from quire.operators.layout import KEY
from quire.sources import pages as S

D = "/root/testdata/sf0.001"
PAGE = {"doc_id": 1, "page_id": 0}


def boxes(spark, rows, extra):
    cols = ["doc_id", "page_id", "node_id", "x0", "y0", "x1", "y1", *extra]
    return spark.createDataFrame([(1, 0, *r) for r in rows], cols)


def test_overlap_parent(spark):
    child = boxes(spark, [("a", 0, 0, 10, 10), ("t", 1, 1, 3, 3), ("z", 5, 5, 5, 5)], [])
    parents = boxes(spark, [("p", 0, 0, 7, 10, 0), ("q", 0, 0, 6, 10, 1)], ["pos"])
    got = {r.node_id: r.parent_id for r in layout.overlap_parent(child, parents).collect()}
    assert got == {"a": "p", "t": "p", "z": None}  # tolerance inclusive; first of equal ratios; no area, no parent


def test_labels_of_scores(spark):
    tree = spark.createDataFrame([(1, 0, "b", "block", None, ""), (1, 0, "l", "line", "b", "line"), (1, 0, "m", "line", None, "line")], "doc_id int, page_id int, node_id string, level_name string, parent_id string, label string")
    none = spark.createDataFrame([], "doc_id int, page_id int, node_id string, score double")
    assert scores.block_scores(tree, none).first().block_label == "unknown"
    assert {r.line_id: r.block_label for r in scores.line_scores(tree, none).collect()} == {"l": "", "m": "unknown"}


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_optimal(seed):
    r = np.random.default_rng(seed)
    m, n = r.integers(1, 6, 2)
    w = np.round(r.random((m, n)) - 0.3, 1)
    pairs = align.assignment(w)
    best = max(sum(w[i, j] for i, j in (zip(range(m), c) if m <= n else zip(c, range(n)))) for c in itertools.permutations(range(int(max(m, n))), int(min(m, n))))
    assert len(pairs) == min(m, n) and pairs == sorted(pairs)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    assert math.isclose(sum(w[i, j] for i, j in pairs), best, abs_tol=1e-9)


def test_assignment_cases():
    assert align.assignment(np.array([[0.9, 0.8, 0], [0.85, 0.1, 0]])) == [(0, 1), (1, 0)]
    w = np.array([[0.5, 0.4], [0.3, 0.1]])
    assert [(i, j) for i, j in align.assignment(w) if w[i, j] >= 0.35] == [(0, 1)]
    with pytest.raises(ValueError):
        align.assignment(np.array([[float("nan")]]))


def test_precision_recall_cases(spark):
    kinds = "doc_id int, page_id int, node_id string, parent_id string, ast_index_start int, char_start int, ast_index_end int, char_end int"
    gold = spark.createDataFrame([(1, 0, "a", "b", 0, 10, 0, 19), (1, 0, "c", "b", 0, 5, 0, 5), (1, 0, "d", "b", 0, 1, 0, 9), (1, 0, "e", "x", 0, 1, 0, 9)], kinds)
    noise = spark.createDataFrame([("1", 1, 0, "a", "b", 0, 13, 0, 22), ("1", 1, 0, "c", "b", 0, 5, 0, 5), ("1", 1, 0, "e", "x", 0, 1, 0, 9)], "noise string, " + kinds)
    gb = spark.createDataFrame([(1, 0, "b", 0, 0), (1, 0, "x", 0, 0)], "doc_id int, page_id int, node_id string, ast_start int, ast_end int")
    nb = spark.createDataFrame([("1", 1, 0, "b", 0, 0), ("1", 1, 0, "x", 0, 1)], "noise string, doc_id int, page_id int, node_id string, ast_start int, ast_end int")
    nodes = spark.createDataFrame([(1, 0, 0, 0)], "doc_id int, page_id int, ast_index int, start int")
    got = {r.line_id: (round(r.precision, 4), round(r.recall, 4), r.is_block_error) for r in scores.precision_recall(gold, gb, noise, nb, nodes).collect()}
    assert got == {"a": (0.6667, 0.6667, False), "c": (0.0, 0.0, False), "d": (0.0, 0.0, False), "e": (0.0, 0.0, True)}
    wide = {r.line_id: r.precision for r in scores.precision_recall(gold, gb, noise, nb, nodes, inclusive_end=True).collect()}
    assert wide["c"] == 1.0


def test_f1_is_averaged_by_row(spark):
    pr = spark.createDataFrame([("1", 1.0, 0.5, False), ("1", 0.5, 1.0, False)], "noise_level string, precision double, recall double, is_block_error boolean")
    assert round(scores.pr_summary(pr).first().f1, 4) == 0.6667


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.12345), ("b", 0.2)], "document string, score double")
    assert round(scores.mean_of_rounded(df, "document").first()["mean"], 4) == 0.1615
    tags = spark.createDataFrame([("A", "0"), ("A", "0.01"), ("A", "0.05"), ("B", "0"), ("B", "0.05")], "document string, noise string")
    assert {r.noise for r in scores.covered_tags(tags).collect()} == {"0", "0.05"}
    assert scores.covered_tags(tags, 1).count() == 3
    assert scores.even_positions(8) == [0, 1, 3, 4, 6, 7] and scores.even_positions(13) == [0, 2, 5, 7, 10, 12]
    h = spark.createDataFrame([("x", 0.0), ("x", 0.05), ("x", 1.0), ("x", 2.0)], "label string, score double")
    assert {r.bin: r.percent for r in scores.histogram(h, "label").collect()} == {0: 25.0, 1: 25.0, 19: 25.0}


def test_intervals(spark):
    i = spark.createDataFrame([(1, a, b) for a, b in [(0, 3), (3, 5), (7, 9), (8, 10)]], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in intervals.merge_intervals(i, ["k"]).collect()) == [(0, 5), (7, 10)]
    f = spark.createDataFrame([(1, n, n in (1, 2, 4)) for n in range(6)], "k int, n int, flag boolean")
    assert sorted((r.first, r.last) for r in intervals.run_segments(f, ["k"], "n", "flag").collect()) == [(0, 0), (1, 2), (3, 3), (4, 4), (5, 5)]
    r = spark.createDataFrame([(1, 0, "s", 1, 5, 3, 2)], "doc_id int, page_id int, node_id string, ast_index_start int, char_start int, ast_index_end int, char_end int")
    nodes = spark.createDataFrame([(1, 0, k, 10 * k, 10 * k + 10) for k in range(5)], "doc_id int, page_id int, ast_index int, start int, end int")
    assert sorted((x.ast_index, x.start, x.end) for x in intervals.char_ranges(r, nodes).collect()) == [(1, 5, 10), (2, 0, 10), (3, 0, 3)]


def test_highlights_and_images(spark):
    nodes = spark.createDataFrame([("d", 0, 0, "abcdefgh"), ("d", 0, 1, "plain"), ("d", 0, 2, "")], "doc_id string, page_id int, ast_index int, content string")
    ranges = spark.createDataFrame([("d", 0, 0, 4, 6), ("d", 0, 0, 1, 2), ("d", 0, 0, 2, 3), ("d", 0, 0, 5, 99)], "doc_id string, page_id int, ast_index int, start int, end int")
    got = {r.ast_index: r.content for r in intervals.highlighted_text(nodes, ranges, "<", ">").collect()}
    assert got == {0: "a<bc>d<efgh>", 1: "plain", 2: ""}
    row = spark.createDataFrame([("![a](b.png) ![c](http://x/y) ![r](/r) <IMG alt='q' SRC='z.png'>",)], "t string")
    out = row.select(T.image_urls(F.col("t"), "/p$1/").alias("u"), T.image_tags(F.col("t")).alias("g")).first()
    assert out.u == "![a](/p$1/b.png) ![c](http://x/y) ![r](/r) <IMG alt='q' SRC='/p$1/z.png'>"
    assert out.g.startswith('<img src="b.png" alt="a"> <img src="http://x/y" alt="c">')


def test_curve_order(spark):
    rows = spark.createDataFrame([("0.2", 1.0), ("0.05", 0.0), ("0.05", 1.0), ("b", 0.5), ("a", 0.5), ("10", 0.1)], "noise string, score double")
    got = [(r.curve, r.n, r.mean, r.std) for r in scores.curve_stats(rows, "noise").orderBy("pos").collect()]
    assert [g[0] for g in got] == ["0.05", "0.2", "10", "a", "b"] and got[0] == ("0.05", 2, 0.5, 0.5)


def test_parameters():
    assert T.noise_levels("1,2,5") == [0.02, 0.05, 1.0] and T.noise_levels("0.05,5") == [0.05]
    with pytest.raises(ValueError):
        T.noise_levels("120")
    assert T.page_numbers("0,2,5-8") == [0, 2, 5, 6, 7, 8]
    assert [T.noise_tag(v) for v in (0.05, 0.0, 1.0)] == ["0.05", "0", "1"]


def test_corruption():
    text = "0123456789 é and more text here"
    assert corrupt.corrupt_text(text, [(10, 20)], 0, 1) == text
    out = corrupt.corrupt_text(text, [(2, 12), (8, 20)], 0.5, 3)
    assert len(out) == len(text) and out[:2] == text[:2] and out[20:] == text[20:]
    assert sum(a != b for a, b in zip(text[2:12], out[2:12])) >= 5
    assert corrupt.corrupt_text(text, [(2, 12)], 0.5, 3) == corrupt.corrupt_text(text, [(2, 12)], 0.5, 3)
    assert sum(a != b for a, b in zip("x" * 5, corrupt.corrupt_text("x" * 5, [(0, 5)], 0.5, 1))) == 2


def test_markdown_and_words():
    md = "# A\n\npara\nmore\n\n- a\n- b\n\n1. x\n\n```\ncode\n\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\nlazy\n\nT\n===\n***\n[x]: http://e\n\n    code\n"
    nodes = T.markdown_nodes(md)
    assert [k for k, _, _ in nodes] == ["heading", "paragraph", "bullet_list", "ordered_list", "fence", "table", "blockquote", "heading", "hr", "code_block"]
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(nodes)) and md[nodes[1][1] : nodes[1][2]] == "para\nmore\n"
    assert T.markdown_nodes(None) == [] and T.markdown_nodes("\n\n") == []
    s = "They can't, don't (ok)."
    assert [s[a:b] for a, b in T.treebank_spans(s)] == ["They", "ca", "n't", ",", "do", "n't", "(", "ok", ")", "."]


def test_sequences():
    sim = lambda x, y: 1.0 if list(y) == [x] else 0.0
    assert sequences.greedy("ab", ["a", "b"], sim) == [(0, 1), (1, 2)] == sequences.optimal("ab", ["a", "b"], sim)
    # an empty part may score best, and is scored like others
    assert sequences.greedy(["x", "y"], "ab", lambda x, y: -len(y)) == [(0, 0), (0, 2)]
    assert sequences.optimal(["x", "y"], "ab", lambda x, y: 5.0 if not len(y) and x == "x" else -len(y) ** 2)[0] == (0, 0)
    assert sequences.match_strings(["ab"], "xaby", lambda p, t: float(p == t)) == [(1, 3)]
    assert sequences.match_strings(["ab", "zz", "y"], "xaby", sequences.Equal()) == slow_match(["ab", "zz", "y"], "xaby", sequences.Equal())


def slow_match(patterns, text, sim):
    """The best ordered parts, cell by cell."""
    rows = [[(0.0, None)] * (len(text) + 1)]
    for p in patterns:
        row = [(0.0, None)]
        for r in range(1, len(text) + 1):
            top, start = row[-1][0], None
            for left in range(r + 1):
                if rows[-1][left][0] + sim(p, text[left:r]) > top:
                    top, start = rows[-1][left][0] + sim(p, text[left:r]), left
            row.append((top, start))
        rows.append(row)
    out, r = [None] * len(patterns), len(text)
    for k in range(len(patterns), 0, -1):
        while r >= 0 and rows[k][r][1] is None:
            r -= 1
        if r < 0:
            break
        out[k - 1] = (rows[k][r][1], r)
        r = out[k - 1][0]
    return out


def test_sequences_by_arrays():
    r = np.random.default_rng(3)
    words = lambda x, y: sum(1.0 for w in y if w == x) - 0.1 * len(y)
    for _ in range(60):
        y = r.integers(0, 5, r.integers(0, 20))
        for f in (sequences.greedy, sequences.optimal):
            assert f(y[::3], y, sequences.WordCount()) == f(list(y[::3]), list(y), words)
    for _ in range(80):
        text = "".join(r.choice(list("abc"), r.integers(0, 14)))
        patterns = ["".join(r.choice(list("abc"), r.integers(1, 4))) for _ in range(r.integers(1, 4))]
        for sim in (sequences.Equal(), lambda p, t: len(set(p) & set(t)) - 0.4 * abs(len(p) - len(t))):
            assert sequences.match_strings(patterns, text, sim) == slow_match(patterns, text, sim)


def test_whole_texts_are_aligned(spark):
    words = {r.doc_id: len(r.text.split()) for r in spark.read.parquet(f"{D}/documents.parquet").where("text is not null").collect()}
    assert max(words.values()) > 100
    ends = {r.doc_id: (r.k, r.b) for r in Q.QUERIES["sequence_align"](spark, D).groupBy("doc_id").agg(F.max("k").alias("k"), F.max("b").alias("b")).collect()}
    assert ends == {d: ((n - 1) // 6, n) for d, n in words.items() if n}
    text = {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{D}/documents.parquet").where("text is not null").collect()}
    rows = Q.QUERIES["string_align"](spark, D).collect()
    assert len(rows) == sum(-(-len(line.split()) // 2) for lines in text.values() for line in lines)
    assert all(text[r.doc_id][r.line_index][r.start : r.end] == text[r.doc_id][r.line_index].split()[::2][r.k] for r in rows)


def test_corruption_draws_as_published():
    """Equal seeds give the texts that the published order of draws gives."""
    import random
    import string

    pool, text, spans = string.ascii_letters + string.digits + string.punctuation + " ", "The quick brown fox jumps over the lazy dog. " * 4, [(0, 40), (30, 90), (100, 170)]
    for seed in range(5):
        rng, chars, done = random.Random(seed), list(text), set()
        for a, b in spans:
            places = [i for i in range(a, b) if i not in done]
            for i in rng.sample(places, int(round(len(places) * 0.2))):
                c = rng.choice(pool)
                while c == chars[i]:
                    c = rng.choice(pool)
                chars[i] = c
                done.add(i)
        assert corrupt.corrupt_text(text, spans, 0.2, seed) == "".join(chars)
    assert corrupt.corrupt_text(text, spans, 0.0, 1) == text


def test_overlapping_spans_share_no_character(spark):

    text = spark.createDataFrame([(1, 0, "abcdefghij" * 5), (2, 0, "klmnopqrst" * 5)], "doc_id long, page_id int, markdown string")
    spans = [(1, 0, 0, 0, 20), (1, 0, 1, 10, 30), (1, 0, 2, 40, 40), (2, 0, 0, 0, 20), (2, 0, 1, 20, 50)]
    got = corrupt.corrupt_relational(text, spark.createDataFrame(spans, "doc_id long, page_id int, pos int, start int, end int"), 0.5, 3).collect()
    owner = {}
    for d, _, pos, a, b in spans:
        for i in range(a, b):
            owner.setdefault((d, i), pos)
    want = set()
    for d, _, pos, _, _ in spans:
        own = sorted((hashlib.md5(f"3:{d}:0:{i}".encode()).hexdigest(), i) for (e, i), q in owner.items() if (e, q) == (d, pos))
        want |= {(d, pos, i) for _, i in own[: round(len(own) * 0.5)]}
    assert {(r.doc_id, r.pos, r.char_index) for r in got} == want and len(got) == len(want)


def test_spans_of_a_pretrained_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, md = public.path("byte_bpe_50k.json"), "# Title\n\nSome words, naïve ones.\n"
    own = Tokenizer.from_file(path)
    rows = T.parse_pages(spark.createDataFrame([(1, 0, md)], "doc_id long, page_id int, markdown string"), T.pretrained_spans(path)).collect()
    assert [[(w.start, w.end) for w in r.words] for r in rows] == [own.encode(md[r.start : r.end], add_special_tokens=False).offsets for r in rows]


def test_places_by_all_line_breaks():
    md = "one\x0ctwo\n\nthree\n"
    assert [(a, b) for _, a, b in T.markdown_nodes(md)] == [(0, 8), (9, 15)]
    assert [(a, b) for _, a, b in T.markdown_nodes(md, all_breaks=True)] == [(0, 4), (8, 9)]


def test_files_are_written_once(spark, tmp_path):

    text = spark.createDataFrame([("a b", 0, "# one"), ("a b", 1, None), ("c", 0, "three")], "doc_id string, page_id int, markdown string")
    files = S.markdown_files(text)
    assert {r.status for r in S.write_files(files, str(tmp_path)).collect()} == {"written"}
    assert {r.status for r in S.write_files(files, str(tmp_path)).collect()} == {"kept"}
    assert {(r.doc_id, r.page_id, r.markdown) for r in S.read_markdown(spark, str(tmp_path)).collect()} >= {("a b", 0, "# one"), ("c", 0, "three")}
    figures = spark.createDataFrame([("c", 0, "x.png", bytearray(b"\x89PNG"))], "doc_id string, page_id int, name string, content binary")
    S.write_files(S.figure_files(figures), f"file://{tmp_path}").collect()
    assert [(r.doc_id, r.name, bytes(r.content)) for r in S.read_figures(spark, str(tmp_path)).collect()] == [("c", "x.png", b"\x89PNG")]
    S.write_files(S.page_images(figures), str(tmp_path)).collect()
    S.write_files(S.alignment_files(spark.createDataFrame([("c", 0, "block_0", 0, 1, 0.5)], "doc_id string, page_id int, node_id string, ast_start int, ast_end int, score double"), spark.createDataFrame([], "doc_id string, page_id int, node_id string, ast_index_start int, char_start int, ast_index_end int, char_end int, score double")), str(tmp_path)).collect()
    assert (tmp_path / "c" / "0" / "page.png").read_bytes() == b"\x89PNG" and S.read_alignments(spark, str(tmp_path)).first().alignment.block_alignments["block_0"].ast_end == 1
    assert not list(tmp_path.rglob("*.part"))


def test_jobs_from_pages_to_reports(spark, tmp_path):
    from quire import jobs
    from quire.plans.model import Pages

    p = Pages(spark, D)
    few = p.documents.where("length(text) between 30 and 700").orderBy("doc_id").limit(8).select("doc_id")
    store = jobs.Store(spark, f"file://{tmp_path}/s")
    made = {"text": p.pages, "nodes": p.nodes, "regions": p.regions, "blocks": p.blocks, "line_tokens": p.lines, "word_tokens": p.words}
    start = p.nodes.join(p.text, KEY)
    words = T.parse_pages(p.text, "whitespace").select(*KEY, "ast_index", "start", F.posexplode("words").alias("k", "w"))
    made["nodes"] = T.parse_pages(p.text, "whitespace").select(*KEY, "ast_index", "start", "end")
    made["words"] = words.select(*KEY, "ast_index", (F.col("ast_index") * 100000 + F.col("k")).alias("word_index"), (F.col("start") + F.col("w.start")).alias("start"), (F.col("start") + F.col("w.end")).alias("end"))
    for name, df in made.items():
        store.write(name, df.join(few, "doc_id", "left_semi"))
    jobs.build_layout_trees(store)
    with pytest.raises(ValueError):
        jobs.build_alignments(store, blocks_only=True, lines_only=True)
    jobs.build_alignments(store, blocks_only=True)
    jobs.build_alignments(store, lines_only=True)
    with pytest.raises(ValueError, match="only the clean"):
        jobs.precision_recall(store)
    n = store.read("line_alignments").count()
    jobs.build_alignments(store)  # keeps what is there
    assert store.read("line_alignments").count() == n > 0
    jobs.build_corruption(store, "20", seed=1)
    clean = {r.doc_id: r.markdown for r in store.read("text").collect()}
    for r in store.read("corrupted").collect():
        assert r.noise == "0.2" and len(r.markdown) == len(clean[r.doc_id]) and r.markdown != clean[r.doc_id]
    jobs.build_alignments(store, "0.2")
    jobs.benchmark(store)
    assert jobs.noise_benchmark(store, min_docs=1) == ["0", "0.2"] == jobs.comparable_tags(store, "20")
    jobs.precision_recall_benchmark(store)
    report = jobs.summary(store)
    assert {"line_scores_by_document", "noise_by_document", "precision_recall", "block_error_by_document"} <= set(report)
    pr = {r.noise_level: r for r in report["precision_recall"].collect()}
    assert pr["0"].block_error == 0 and pr["0"].recall >= pr["0.2"].recall
    labelled = jobs.Store(spark, store.root, pages="0", labels="text")
    assert {r.block_label for r in jobs.score_tables(labelled)[1].collect()} <= {"text"}
    page = jobs.load_pages(store).collect()
    assert [r.doc_id for r in page] == sorted(clean) and all(r.tree for r in page)


def test_search_meets_every_vector(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").collect()
    ids, label = np.array([r.vec_id for r in rows]), {r.vec_id: r.label for r in rows}
    e = np.array([r.embedding for r in rows], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    want = set()
    for a, v in zip(ids, e, strict=True):
        if a % 100 == 0:
            order = sorted((-s, b) for b, s in zip(ids, np.round(e @ v, 9), strict=True) if b != a)[:3]
            want |= {(int(a), int(b), k + 1) for k, (_, b) in enumerate(order)}
    got = {(r.a, r.b, r.rank) for r in Q.QUERIES["embedding_search"](spark, D).collect()}
    assert got == want and any(b < a for a, b, _ in got) and any(label[a] != label[b] for a, b, _ in got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [(r.a, r.b, r.rank) for r in align.nearest(few.repartition(3), F.col("vec_id") == 2, 3, 1).collect()] == [(2, 0, 1), (2, 1, 2)]


def test_rewrites_read_whole_texts(spark):
    texts = {r.doc_id: r.text + Q._CASES for r in spark.read.parquet(f"{D}/documents.parquet").where("text is not null").collect()}
    image = r"!\[([^\]]*)\]\(([^)]+)\)"

    def urls(t):
        t = re.sub(r"!\[([^\]]*)\]\((?!https?://|/)([^)]+)\)", r"![\1](/api/p/0/\2)", t)
        return re.sub(r"""(?i)(<img\s[^>]*src=)(["'])(?!https?://|/)([^"']+)\2""", r"\1\2/api/p/0/\3\2", t)

    want = {
        "page_image_urls": urls,
        "page_image_tags": lambda t: re.sub(image, r'<img src="\2" alt="\1">', t),
        "page_dollar_spacing": lambda t: "".join(" $" if c == "$" and k and t[k - 1] not in "$\\ \t\n\x0b\f\r" else c for k, c in enumerate(t)),
    }
    for name, f in want.items():
        got = {r.doc_id: r.markdown for r in Q.QUERIES[name](spark, D).collect()}
        assert got == {d: f(t) for d, t in texts.items()}, name
    assert any("$" in t.removesuffix(Q._CASES) for t in texts.values())


def test_page_store(spark, tmp_path):
    at = tmp_path / "doc a" / "3"
    (at / "markdown").mkdir(parents=True)
    (at / "markdown" / "markdown.md").write_text("# hi\n")
    (at / "alignment.json").write_text('{"block_alignments": {"block_0": {"ast_start": 0, "ast_end": 1, "score": 0.5}}, "line_alignments": {}}')
    (at / "alignment_0.05.json").write_text("{}")
    spark.createDataFrame([("line_0", 1)], "index string, x0 int").coalesce(1).toPandas().to_parquet(at / "regions.parquet")
    root = str(tmp_path)
    assert S.read_markdown(spark, root).first().markdown == "# hi\n"
    assert S.read_alignments(spark, root).first().alignment.block_alignments["block_0"].ast_end == 1
    found = S.discover(spark, root)
    assert [r.tag for r in S.noise_tags(found).collect()] == ["0", "0.05"]
    assert S.complete_pages(found, ("regions",)).first().page_id == 3 and S.complete_pages(found).isEmpty()
    assert S.read_table(spark, root, "regions").first().doc_id == "doc a"


def test_streaming_ingest(spark, tmp_path):
    from quire.streaming.ingest import ingest

    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "doc_id string, page_id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), df.schema, "lines", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "lines")).count() == 2


def plain(v):
    return "None" if v is None else f"{float(v):.6f}" if not isinstance(v, (bool, str, int)) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = Q.QUERIES[name](spark, D)
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    rows = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in rows) and got


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_merged_intervals_with_nulls_and_equal_rows(spark, tmp_path):
    """Rows without an interval open no range beside others, as in SQL; of equal rows the SQL leaves the order open, the union does not."""
    rows = [(1, None), (1, 3), (1, 28), (2, None), (2, None), (None, 7), (None, None)]
    spark.createDataFrame(rows, "user_id long, event_id long").withColumn("value", F.lit(0.0)).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = Q.QUERIES["merge_intervals"](spark, str(tmp_path)).select("user_id", "start", "end").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(Q.ORACLE_SQL["merge_intervals"]).fetchall()))
    many = spark.createDataFrame([(1, a, a + n) for a, n in [(0, 2), (4, 0), (6, 3), (9, 0)] for _ in range(500)], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in intervals.merge_intervals(many.repartition(8), ["k"]).collect()) == [(0, 2), (4, 4), (6, 9)]
