"""Table functions in SQL, and pages of a stream that wait for their tables."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quire import queries as Q
from quire.functions import table_functions
from quire.plans.model import Pages

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sql_markdown_blocks", "sql_node_ranges", "sql_word_windows", "job_replace", "noise_subtitles", "document_tags", "box_percent", "resolved_tags"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    df = Q.QUERIES[name](spark, D)
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    key = lambda v: f"{v:.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    assert sorted([key(v) for v in r] for r in cur.fetchall()) == sorted([key(r[c]) for c in names] for r in df.collect())


def test_table_functions(spark):
    table_functions.register(spark)
    spark.createDataFrame([("d", 1, "# a\n\nb\nc\n"), ("e", 1, None)], "doc_id string, page_id int, markdown string").createOrReplaceTempView("tf_pages")
    got = spark.sql("SELECT p.doc_id, b.* FROM tf_pages p, LATERAL markdown_blocks(p.markdown) b").collect()
    assert sorted(map(tuple, got)) == [("d", 0, "heading", 0, 4), ("d", 1, "paragraph", 5, 9)]
    nodes = [("d", p, k, 10 * k, 10 * k + 9) for p in (0, 1) for k in (0, 2, 3)]
    spark.createDataFrame(nodes, "doc_id string, page_id int, ast_index int, start int, end int").repartition(5).createOrReplaceTempView("tf_nodes")
    got = spark.sql("SELECT page_id, ast_start, ast_end, start, `end` FROM node_ranges(TABLE(tf_nodes)) WHERE page_id = 1").collect()
    assert sorted(map(tuple, got)) == [(1, a, b, 10 * a, 10 * b + 9) for a, b in [(0, 0), (0, 2), (0, 3), (2, 2), (2, 3), (3, 3)]]
    with pytest.raises(Exception, match="no column least"):
        spark.sql("SELECT * FROM word_windows(TABLE(SELECT *, 'b' AS parent_id, ast_index AS word_index FROM tf_nodes))").collect()


@pytest.mark.parametrize("seed", range(3))
def test_word_windows_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    words, at, least, most = [], 0, r.randint(0, 12), r.randint(8, 30)
    for k in range(50):
        at += r.randint(1, 3)
        words.append(("d", 0, "b", k, at, at + r.randint(1, 14), least, most))
        at = words[-1][5]
    table_functions.register(spark)
    spark.createDataFrame(words, "doc_id string, page_id int, parent_id string, word_index long, start int, end int, least int, most int").repartition(4).createOrReplaceTempView("tf_words")
    want = []
    for i, a in enumerate(words):
        ok = [j for j in range(i, 50) if least <= words[j][5] - a[4] <= most]
        if ok:
            want.append((i, ok[0], ok[-1]))
    assert sorted((x.word_index, x.first, x.last) for x in spark.sql("SELECT * FROM word_windows(TABLE(tf_words))").collect()) == want


def test_pages_wait_for_their_tables(spark, tmp_path):
    """Parts in any order over several runs of a query that is started anew each time."""
    from quire.streaming import complete as C

    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def arrive(*rows):
        spark.createDataFrame([(d, p, t, json.dumps([{"x": x}])) for d, p, t, x in rows], C.PART).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(C.PART).parquet(source)
        C.complete(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.doc_id, r.page_id) for r in spark.read.schema(C.PAGE).parquet(out).collect())

    arrive(("a", 0, "blocks", 1), ("b", 0, "regions", 2), ("a", 0, "word_tokens", 3), ("a", 0, "layout", 9))
    assert run() == []
    arrive(("a", 0, "regions", 4), ("a", 0, "regions", 5), ("b", 0, "blocks", 6))
    assert run() == []
    arrive(("a", 0, "line_tokens", 7), ("b", 0, "word_tokens", 8))
    assert run() == [("a", 0)]
    arrive(("a", 0, "blocks", 99), ("b", 0, "line_tokens", 10), *[("c", 1, t, 11) for t in C.REQUIRED])
    assert run() == [("a", 0), ("b", 0), ("c", 1)]
    assert run() == [("a", 0), ("b", 0), ("c", 1)]
    pages = spark.read.schema(C.PAGE).parquet(out)
    assert {(r.doc_id, r.x) for r in C.rows_of(pages, "blocks", "x:int").collect()} == {("a", 1), ("b", 6), ("c", 11)}
    lines = spark.createDataFrame([("a", 0, 5, None)], "doc_id string, page_id int, x int, y string")
    assert json.loads(C.parts(lines, "line_tokens").first().rows) == [{"x": 5, "y": None}]


def test_block_windows_equal_word_windows(spark, monkeypatch):
    """A row for each block gives what a row for each word does, in slices of any size; a block may be empty."""
    r = random.Random(4)
    words, blocks = [], [("e", 0, "b0", [], 0, 9)]
    for k in range(40):
        at, own, least, most = 0, [], r.randint(0, 12), r.randint(5, 30)
        for n in range(r.randint(0, 30)):
            at += r.randint(1, 3)
            own.append((10 * n, at, at + r.randint(1, 14)))
            at = own[-1][2]
        blocks.append((f"{k % 3}", 0, f"b{k}", own, least, most))
        words += [(f"{k % 3}", 0, f"b{k}", *w, least, most) for w in own]
    table_functions.register(spark)
    spark.createDataFrame(words, "doc_id string, page_id int, parent_id string, word_index long, start int, end int, least int, most int").createOrReplaceTempView("bw_words")
    frame = spark.createDataFrame(blocks, "doc_id string, page_id int, parent_id string, words array<struct<word_index:long,start:int,end:int>>, least int, most int")
    frame.withColumn("doc_id", F.col("doc_id").try_cast("long")).repartition(3).createOrReplaceTempView("bw_blocks")
    got = sorted(map(str, map(tuple, spark.sql("SELECT parent_id, word_index, first, last FROM block_windows(TABLE(bw_blocks))").collect())))
    assert got == sorted(map(str, map(tuple, spark.sql("SELECT parent_id, word_index, first, last FROM word_windows(TABLE(bw_words))").collect()))) and len(got) > 100
    batch = frame.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    handler = table_functions.BlockWindows.func()
    whole = sorted(map(str, (x for t in handler.eval(batch) for x in t.to_pylist())))
    monkeypatch.setattr(table_functions, "TOGETHER", 3)
    assert sorted(map(str, (x for t in handler.eval(batch) for x in t.to_pylist()))) == whole


def test_a_word_carries_no_other_words_of_its_line(spark, tmp_path):
    """A line of n words made n rows with n gaps each."""
    spark.createDataFrame([(1, " a  bb\t c \n\n" + "x " * 5000, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = Q._located(Pages(spark, str(tmp_path)))
    assert "gaps" not in df._jdf.queryExecution().optimizedPlan().toString()
    text = " a  bb\t c \n\n" + "x " * 5000
    assert sorted((r.start, r.end) for r in df.collect()) == [m.span() for m in re.finditer(r"[^ \t\n]+", text)]
