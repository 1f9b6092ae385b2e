"""Range vectors, sparse matching, bands and alignment against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import queries as Q
from quire.functions.embed import HashedNgrams
from quire.operators import align, ranges
from quire.operators.align import assignment

D = "/root/testdata/sf0.001"
WORDS = ["alpha", "Beta", "gamma", "dé", "eps", "zİta", "Σtaς", "theta", "io", "k"]
H = HashedNgrams()


@pytest.mark.parametrize("seed", range(30))
def test_vectors_of_places_add_up(seed):
    r = random.Random(seed)
    t = "".join(r.choice("ab cİΣdéF\n") for _ in range(r.randint(4, 60)))
    at = np.array(sorted(r.sample(range(len(t) + 1), min(len(t), 8))))
    starts, ends = H.places(t, at[:-1], at[1:])
    for i in range(len(starts)):
        for j in range(i, len(ends)):
            if at[j + 1] - at[i] >= 2:
                assert np.array_equal(starts[i] + ends[j], H.counts([t[at[i] : at[j + 1]]])[0])


@pytest.mark.parametrize("seed", range(40))
def test_sparse_assignment_equals_the_dense_one(seed):
    r = np.random.default_rng(seed)
    m = int(r.integers(1, 7))
    w = np.round(r.random((m, int(r.integers(m, 9)))) - 0.3, 1)
    columns = [np.argsort(-x, kind="stable")[:m] for x in w]
    found = ranges.sparse_assignment(columns, [x[c] for x, c in zip(w, columns, strict=True)])
    assert len({c for _, c, _ in found}) == m == len(found)
    assert np.isclose(sum(s for *_, s in found), sum(w[i, j] for i, j in assignment(w)))


def test_rows_without_a_partner_stay_out():
    found = ranges.sparse_assignment([np.array([3]), np.array([3]), np.array([], int)], [np.array([0.2]), np.array([0.9]), np.array([])])
    assert len(found) == 1 and found[0][1] == 3


def page_of(r, n):
    parts = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 5))) + "\n" for _ in range(n)]
    if n > 3:
        parts[1], parts[-1] = "x", "y"
    end = np.cumsum([len(p) for p in parts])
    return "".join(parts), end - np.array([len(p) for p in parts]), end


def cosines(texts, page, starts, ends, pairs):
    a, b = H.embed(texts), H.embed([page[starts[i] : ends[j]] for i, j in pairs])
    return a @ b.T


@pytest.mark.parametrize("chunk", [1, 1 << 21])
@pytest.mark.parametrize("seed", range(25))
def test_matching_of_ranges_equals_brute_force(monkeypatch, chunk, seed):
    monkeypatch.setattr(ranges, "CHUNK", chunk)
    r = random.Random(seed)
    page, s, e = page_of(r, r.randint(1, 12))
    texts, n = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 30))], len(s)
    first = np.arange(n)
    last = np.minimum(first + r.randint(0, n), n - 1)
    pairs = [(i, j) for i in range(n) for j in range(first[i], last[i] + 1)]
    w = cosines(texts, page, s, e, pairs)
    found = ranges.match_ranges(texts, page, s, e, first, last, H, -2)
    assert len(found) == min(len(texts), len(pairs)) == len({f[1:3] for f in found})
    assert all(abs(w[t, pairs.index((i, j))] - score) < 1e-9 for t, i, j, score in found)
    assert np.isclose(sum(f[3] for f in found), sum(w[i, j] for i, j in assignment(w)))
    assert ranges.match_ranges(texts, page, s, e, first, last, H, 0.5) == [f for f in found if f[3] >= 0.5]


@pytest.mark.parametrize("chunk", [1, 1 << 21])
def test_best_ranges_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(ranges, "CHUNK", chunk)
    page, s, e = page_of(random.Random(3), 14)
    s, e = s[2:], e[2:]
    texts = ["alpha dé", "k k k", "zİta", ""]
    n = len(s)
    i, j, score = ranges.best_ranges(H.counts(texts), *H.places(page, s, e), np.arange(n), np.full(n, n - 1), 5)
    pairs = [(a, b) for a in range(n) for b in range(a, n) if e[b] - s[a] > 1]
    for row, a, b, c in zip(np.round(cosines(texts, page, s, e, pairs), 12), i, j, score, strict=True):
        order = np.argsort(-row, kind="stable")[:5]
        assert np.allclose(c, row[order]) and set(zip(a.tolist(), b.tolist(), strict=True)) <= {p for p, x in zip(pairs, row, strict=True) if x >= row[order[-1]] - 1e-11}


def test_a_page_of_many_nodes():
    """Two million ranges of a page, of which no text is built."""
    r = random.Random(1)
    page, s, e = page_of(r, 2000)
    texts = [page[s[20 * k] : e[20 * k + 4]] for k in range(60)]

    class Counting(HashedNgrams):
        seen = 0

        def counts(self, texts):
            Counting.seen += len(texts)
            return super().counts(texts)

    found = ranges.match_ranges(texts, page, s, e, np.arange(2000), np.full(2000, 1999), Counting(), 0.2)
    assert sum(page[s[i] : e[j]] == texts[t] for t, i, j, _ in found) == 60 and Counting.seen < 70


@pytest.mark.parametrize("seed", range(25))
def test_matching_of_equal_ranges_equals_brute_force(monkeypatch, seed):
    """Rows that are ranges, copies of them, single characters and others beside them."""
    monkeypatch.setattr(ranges, "CHUNK", [1, 1 << 21][seed % 2])
    r = random.Random(seed)
    page = " ".join(r.choice([*WORDS, "a", "İ", "x"]) for _ in range(r.randint(2, 14)))
    at = [(m.start(), m.end()) for m in re.finditer(r"\S+", page)]
    s, e = np.array(at).T
    n = len(s)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    chosen = [page[s[i] : e[j]] for i, j in (r.choice(pairs) for _ in range(r.randint(1, 4)))]
    texts = chosen + r.choices(chosen, k=r.randint(0, 2)) + ["x"] * r.randint(0, 1) + [" ".join(r.choices(WORDS, k=3)) for _ in range(r.randint(0, 2))]
    w = cosines(texts, page, s, e, pairs)
    found = ranges.match_ranges(texts, page, s, e, np.arange(n), np.full(n, n - 1), H, -2)
    assert [f[0] for f in found] == list(range(len(texts)))[: len(pairs)] or len(texts) > len(pairs)
    assert len(found) == min(len(texts), len(pairs)) == len({f[1:3] for f in found})
    assert all(abs(w[t, pairs.index((i, j))] - score) < 1e-9 for t, i, j, score in found)
    assert np.isclose(sum(f[3] for f in found), sum(w[i, j] for i, j in assignment(w)))


def test_rows_that_are_ranges_are_not_scored():
    """Lines of thousands of words, each twice, and a character, found without a vector of any place."""

    class Unscored(HashedNgrams):
        def places(self, *args):
            raise AssertionError("places have no vectors here")

    r = random.Random(5)
    long = " ".join(r.choice(WORDS) for _ in range(6000))
    texts = [long, "k İ Σtaς", long.upper().replace("ΣTAΣ", "ΣTAς"), "}", "k İ Σtaς", "nobody else says this"]
    page = "\n".join(texts)
    s, e = np.array([(m.start(), m.end()) for m in re.finditer(r"\S+", page)]).T
    low, high = np.arange(len(s)), np.searchsorted(e, s + 2 * len(long), "right") - 1
    found = ranges.match_ranges(texts, page, s, e, low, high, Unscored(), 0.2)
    assert [f[0] for f in found] == list(range(6)) and {f[3] for f in found} == {1.0}
    assert [page[s[i] : e[j]].lower() for _, i, j, _ in found] == [t.lower() for t in texts] and len({f[1:3] for f in found}) == 6


def test_words_of_nodes_are_found_in_the_text(spark):
    tree, nodes, words, text, _ = small(spark)
    key = lambda df: sorted(map(tuple, df.collect()))
    blocks, lines = align.align_tree(tree, nodes, words, text)
    assert key(align.align_lines(tree, nodes, None, text, blocks)) == key(lines) and lines.count() == 3
    at, found = align._words_of("ab\tc  de f\n", np.array([0, 2, 4]), {k: np.array(v) for k, v in {"ast_index": [3, 4, 5, 7], "start": [0, 1, 1, 6], "end": [1, 1, 4, 9]}.items()})
    assert {k: v.tolist() for k, v in found.items()} == {"ast_index": [3, 5, 5, 7], "start": [0, 1, 3, 6], "end": [1, 2, 4, 8]} and at.tolist() == [0, 1, 4]


def test_texts_of_tree_alignment_are_shuffled_once(spark):
    """Lines are taken apart where their page's text lies; all uses read one exchange of texts."""
    plan = Q.QUERIES["tree_alignment"](spark, D)._jdf.queryExecution().executedPlan().toString().split("\n")
    apart = [k for k, x in enumerate(plan) if "Generate posexplode(split" in x]
    assert apart and not any("Exchange" in x for k in apart for x in plan[k - 2 : k])
    assert all(any("REPARTITION_BY_COL" in x for x in plan[k : k + 6]) for k in apart)


class Texts:
    """A provider whose vectors do not add up, as far as the operators know."""

    def embed(self, texts):
        return H.embed(texts)


def small(spark):
    page = "The first node has words.\nThe second one, too.\n\nA third node stands here.\n"
    nodes = spark.createDataFrame([("d", 0, 0, 0, 26), ("d", 0, 1, 26, 47), ("d", 0, 2, 48, 74)], "doc_id string, page_id int, ast_index int, start int, end int")
    words = [("d", 0, k, int(m.start() >= 26) + int(m.start() >= 48), m.start(), m.end()) for k, m in enumerate(__import__("re").finditer(r"\S+", page))]
    words = spark.createDataFrame(words, "doc_id string, page_id int, word_index int, ast_index int, start int, end int")
    text = spark.createDataFrame([("d", 0, page), ("e", 0, "no nodes")], "doc_id string, page_id int, markdown string")
    rows = [("d", 0, "b0", "block", None, "The first node has words. The second one, too."), ("d", 0, "b1", "block", None, "A third node"), ("e", 0, "b0", "block", None, "no nodes"), ("d", 0, "l0", "line", "b0", "The first node"), ("d", 0, "l1", "line", "b0", "second one, too."), ("d", 0, "l2", "line", "b1", "stands here."), ("d", 0, "l3", "line", None, "stray"), ("d", 0, "b2", "block", None, None)]
    tree = spark.createDataFrame(rows, "doc_id string, page_id int, node_id string, level_name string, parent_id string, content string")
    return tree, nodes, words, text, page


def test_alignment_by_vectors_equals_that_by_texts(spark):
    tree, nodes, words, text, page = small(spark)
    key = lambda df: sorted((r.node_id, *r[3:-1], round(r.score, 9)) for r in df.collect())
    blocks, lines = align.align_tree(tree, nodes, words, text)
    other_blocks, other_lines = align.align_tree(tree, nodes, words, text, provider=Texts())
    assert key(blocks) == key(other_blocks) and key(lines) == key(other_lines)
    assert {r.node_id: (r.ast_start, r.ast_end) for r in blocks.collect()}["b0"] == (0, 1)
    start = {0: 0, 1: 26, 2: 48}
    got = {r.node_id: page[start[r.ast_index_start] + r.char_start : start[r.ast_index_end] + r.char_end + 1] for r in lines.collect()}
    assert got == {"l0": "The first node", "l1": "second one, too.", "l2": "stands here."}


def test_bands_equal_all_pairs(spark):
    r = random.Random(7)
    words, spans = [], {}
    for d in range(3):
        at = 0
        for k in range(60):
            at += r.randint(1, 3)
            words.append((f"d{d}", 0, 10 * k, k // 7, at, at + r.randint(1, 9)))
            at = words[-1][-1]
    window = [("d0", 0, "a", 0, 3, 0, 0), ("d0", 0, "b", 2, 8, 5, 30), ("d1", 0, "a", 0, 8, 12, 12), ("d2", 0, "a", 4, 2, 0, 50), ("d2", 0, "b", 0, 0, 40, 10)]
    w = spark.createDataFrame(words, "doc_id string, page_id int, word_index int, ast_index int, start int, end int")
    b = spark.createDataFrame(window, "doc_id string, page_id int, parent_id string, ast_start int, ast_end int, least int, most int")
    for d, _, p, x, y, least, most in window:
        own = [q for q in words if q[0] == d and x <= q[3] <= y]
        spans |= {(d, p, own[i][2], own[j][2]): (own[i][3], own[j][3], own[i][4], own[j][5]) for i in range(len(own)) for j in range(i, len(own)) if least <= own[j][5] - own[i][4] <= most}
    got = {(q.doc_id, q.parent_id, q.i, q.j): (q.ast_index_start, q.ast_index_end, q.s, q.e) for q in align.word_ranges(w, b).collect()}
    assert got == spans
    plan = align.word_bands(w, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_later_maps_win(spark):
    rows = spark.createDataFrame([("d", 0, 1, "a", 5, 0.1), ("d", 0, 2, "a", 6, 0.2), ("d", 0, 1, "b", 7, 0.3), ("e", 0, 0, "a", 8, None)], "doc_id string, page_id int, part int, node_id string, char_start int, score double")
    assert sorted(map(tuple, align.merged_alignments(rows, "part").collect())) == [("d", 0, "a", 6, 0.2), ("d", 0, "b", 7, 0.3), ("e", 0, "a", 8, None)]


@pytest.mark.parametrize("name", ["word_bands", "block_alignment", "tree_alignment", "alignment_union", "word_ranges"])
def test_alignment_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = Q.QUERIES[name](spark, D)
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in df.select([F.col(c) for c in names]).collect())


@pytest.mark.parametrize("copies", [1, 3])
def test_ranges_of_a_text_come_before_others_of_its_vector(copies):
    """Vectors are blind to case and to the order of lines; of such ranges each text has its own, and what is left goes to texts without one."""
    texts = ["x\ny\nx\nx", "x\nx\ny\nx", "Some line", "SOME line", "a", "A"]
    assert np.array_equal(H.counts(texts)[::2], H.counts(texts)[1::2])
    page = "\n".join(texts * copies)
    s, e = np.array([(m.start(), m.end()) for m in re.finditer(r"[^\n]+", page)]).T
    n = len(s)
    wanted = (texts[::-1] + ["some LINE"]) * copies
    page, e = page + "\nSOME Line" * copies, np.concatenate([e, e[-1] + 10 * np.arange(1, copies + 1)])
    s = np.concatenate([s, e[n:] - 9])
    n = len(s)
    found = ranges.match_ranges(wanted, page, s, e, np.arange(n), np.full(n, n - 1), H, 0.2)
    assert len(found) == len(wanted) == len({f[1:3] for f in found}) and {f[3] for f in found} == {1.0}
    assert [page[s[i] : e[j]] for _, i, j, _ in found] == (texts[::-1] + ["SOME Line"]) * copies


def test_blocks_of_equal_vectors_keep_their_text(spark, tmp_path):
    """Pages whose blocks and ranges differ by case or by the order of lines alone."""
    r = random.Random(1)
    docs = ["x\ny\nx\nx\nx\nx\ny\nx", "Some line\nb\nc\nd\nSOME line\nb\nc\nd", "ΑΣ\nας\nΣ\nΑΣ\nΑσ\nας\nς", "", "\n\n", None]
    docs += ["\n".join(r.choice(["x", "y", "X", "", " ", "x y x", "The line", "the line"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(Q.ORACLE_SQL["block_alignment"])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(q)) for q in Q.QUERIES["block_alignment"](spark, str(tmp_path)).select(names).collect())


def test_pairs_of_vectors_by_blocks_equal_sql(spark, tmp_path, monkeypatch):
    """Groups of many blocks, copies, vectors of zeros and nulls; no pair is made by a join."""
    monkeypatch.setattr(align, "MEET", 7)
    r = random.Random(2)
    vectors = [[float(r.randint(-3, 3)) for _ in range(4)] for _ in range(12)] + [[0.0] * 4, None]
    rows = [(k, vectors[r.randrange(14)], r.choice([1, 1, 1, 2, 3, None])) for k in r.sample(range(1000), 80)] + [(None, vectors[0], 1), (2000, vectors[1], 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("embedding_cosine", "embedding_topk"):
        df = Q.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(Q.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        want = sorted(map(str, cur.fetchall()))
        assert sorted(str(tuple(r[c] for c in names)) for r in df.select(names).collect()) == want and len(want) > 100
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "SortMergeJoin" not in plan
