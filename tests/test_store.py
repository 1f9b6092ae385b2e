"""Tables of pages: skipping, replacing by page and tag, failed writes."""

import pytest
from pyspark.sql import functions as F

from quire import jobs
from quire.operators.layout import KEY
from quire.sources import tables

ROWS = "doc_id string, page_id int, noise string, v int"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/s"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_overwrite_of_a_tag_keeps_the_others(spark, root):
    first = [("a", 0, "0", 1), ("a", 0, "0.2", 2), ("b", 0, "0", 3), ("b", 0, "0.2", 4), ("b", 1, "0.2", 5)]
    tables.write(spark.createDataFrame(first, ROWS), root, "t", by=("noise",))
    new = spark.createDataFrame([("a", 0, "0.2", 7), ("a", 0, "0.2", 8), ("b", 0, "0.2", 9)], ROWS)
    tables.write(new, root, "t", True, ("noise",))
    want = sorted([("a", 0, "0", 1), ("a", 0, "0.2", 7), ("a", 0, "0.2", 8), ("b", 0, "0", 3), ("b", 0, "0.2", 9), ("b", 1, "0.2", 5)])
    assert rows(tables.read(spark, root, "t")) == want
    # without overwrite what is there stays, also after a replacement
    tables.write(spark.createDataFrame([("b", 0, "0.2", 99), ("c", 0, "0", 6)], ROWS), root, "t", by=("noise",))
    assert rows(tables.read(spark, root, "t")) == sorted([*want, ("c", 0, "0", 6)])
    tables.compact(spark, root, "t", "u")
    assert rows(tables.read(spark, root, "u")) == sorted([*want, ("c", 0, "0", 6)])


def test_a_limited_store_keeps_other_pages(spark, root):
    kind = "doc_id string, page_id int, v int"
    store = jobs.Store(spark, root)
    store.write("t", spark.createDataFrame([("a", p, p) for p in range(5)], kind))
    part = jobs.Store(spark, root, pages="1,3")
    part.write("t", part.read("t").withColumn("v", F.col("v") * 10), True)
    assert rows(store.read("t")) == [("a", 0, 0), ("a", 1, 10), ("a", 2, 2), ("a", 3, 30), ("a", 4, 4)]
    assert rows(part.read("t")) == [("a", 1, 10), ("a", 3, 30)]


def test_pages_without_rows_are_done(spark, root):
    kind = "doc_id string, page_id int, v int"
    store = jobs.Store(spark, root)
    store.write("source", spark.createDataFrame([("a", p, p) for p in range(3)], kind))
    todo = store.todo("source", "t")
    assert todo.count() == 3 and not store.has("t")
    store.write("t", spark.createDataFrame([("a", 0, 1)], kind), scope=todo)
    assert store.todo("source", "t").isEmpty() and store.has("t") and store.todo("source", "t", True).count() == 3
    # replaced by nothing
    store.write("t", spark.createDataFrame([], kind), True, scope=spark.createDataFrame([("a", 0)], "doc_id string, page_id int"))
    assert rows(store.read("t")) == [] and store.todo("source", "t").isEmpty()
    empty = jobs.Store(spark, root + "2")
    empty.write("t", spark.createDataFrame([], kind))
    assert empty.read("t").columns == [*KEY, "v"] and empty.read("t").isEmpty()
    empty.write("t", spark.createDataFrame([("z", 0, 1)], kind))
    assert rows(empty.read("t")) == [("z", 0, 1)]


def test_a_failed_write_changes_nothing(spark, root):
    kind = "doc_id string, page_id int, v int"
    tables.write(spark.createDataFrame([("a", p, p) for p in range(4)], kind), root, "t")
    before = rows(tables.read(spark, root, "t"))
    bad = spark.createDataFrame([("a", p, p) for p in range(4)], kind).repartition(4).withColumn("v", F.when(F.col("page_id") == 3, F.raise_error(F.lit("no")).cast("int")).otherwise(9))
    for overwrite in (True, False):
        with pytest.raises(Exception, match="no"):
            tables.write(bad.where("page_id > 1") if overwrite else bad.withColumn("doc_id", F.lit("n")), root, "t", overwrite)
        assert rows(tables.read(spark, root, "t")) == before
    # rows of a write that ended before its keys do not count, and the next write takes their place
    spark.createDataFrame([("x", 0, 1)], kind).write.parquet(f"{root}/t/store_version=1")
    assert rows(tables.read(spark, root, "t")) == before
    tables.write(spark.createDataFrame([("y", 0, 2)], kind), root, "t")
    assert rows(tables.read(spark, root, "t")) == [*before, ("y", 0, 2)]


def test_skipping_reads_only_keys(spark, root):
    kind = "doc_id string, page_id int, v int"
    tables.write(spark.createDataFrame([("a", 0, 1)], kind), root, "t")
    tables.write(spark.createDataFrame([("a", 0, 2), ("b", 0, 3)], kind), root, "t")
    assert all("/_keys/t/" in f for f in tables.keys(spark, root, "t").inputFiles())
    # two versions that only add are read without a join
    assert "Join" not in tables.read(spark, root, "t")._jdf.queryExecution().executedPlan().toString()
    assert rows(tables.read(spark, root, "t")) == [("a", 0, 1), ("b", 0, 3)]


def test_overwritten_jobs_keep_other_tags(spark, root):
    store = jobs.Store(spark, root)
    page = "First words here.\nAnd more words there.\n\nLast words.\n"
    text = spark.createDataFrame([("d", p, "doc", page) for p in range(3)], "doc_id string, page_id int, document string, markdown string")
    from quire.functions.text import parse_pages

    parsed = parse_pages(text, "whitespace")
    store.write("text", text)
    store.write("nodes", parsed.select(*KEY, "ast_index", "start", "end"))
    w = parsed.select(*KEY, "ast_index", "start", F.posexplode("words").alias("k", "w"))
    store.write("words", w.select(*KEY, "ast_index", (F.col("ast_index") * 1000 + F.col("k")).alias("word_index"), (F.col("start") + F.col("w.start")).alias("start"), (F.col("start") + F.col("w.end")).alias("end")))
    store.write("corrupted", text.where("page_id < 2").select(*KEY, F.lit("0.2").alias("noise"), F.translate("markdown", "e", "x").alias("markdown")), by=("noise",))
    tree = [("d", p, *r) for p in range(3) for r in [("block_0", "block", None, "First words here."), ("line_0", "line", "block_0", "First words here.")]]
    store.write("tree", spark.createDataFrame(tree, "doc_id string, page_id int, node_id string, level_name string, parent_id string, content string"))
    for tag in ("0", "0.2"):
        jobs.build_alignments(store, tag)
    before = rows(store.read("line_alignments"))
    assert [r[1] for r in before].count(2) == 1 and len(before) == 5
    jobs.build_alignments(jobs.Store(spark, root, pages="1"), "0.2", overwrite=True)
    assert rows(store.read("line_alignments")) == before and rows(store.read("block_alignments").select("page_id", "noise")) == [(0, "0"), (0, "0.2"), (1, "0"), (1, "0.2"), (2, "0")]
