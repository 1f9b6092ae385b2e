"""Page directories as a data source: what is planned, listed and read."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from quire.sources import directory
from quire.sources import pages as S


@pytest.fixture
def root(tmp_path):
    import pandas as pd

    for d, pages in {"a": [0, 1, 2, 10], "doc b": [3], "c%2Fd+e": [0], "empty": [], "summary": [0]}.items():
        (tmp_path / d / "notes").mkdir(parents=True)
        for p in pages:
            at = tmp_path / d / str(p)
            (at / "markdown").mkdir(parents=True)
            (at / "markdown" / "markdown.md").write_text(f"# {d} {p}\n")
            pd.DataFrame({"index": ["line_0", "line_1"], "x0": [p, p + 1]}).to_parquet(at / "line_tokens.parquet")
            if p:
                (at / "alignment.json").write_text("{}")
                (at / "alignment_0.05.json").write_text('{"block_alignments": {}}')
    (tmp_path / "a" / "file.txt").write_text("x")
    return str(tmp_path)


def test_rows_of_tables(spark, root):
    lines = directory.pages(spark, f"file://{root}", "line_tokens")
    assert lines.columns == ["doc_id", "page_id", "index", "x0"] and lines.count() == 14
    assert sorted((r.doc_id, r.page_id) for r in lines.where("x0 = page_id").select("doc_id", "page_id").collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 10), ("c/d e", 0), ("doc b", 3), ("summary", 0)]
    text = directory.pages(spark, root, "markdown")
    assert {r.markdown for r in text.where("doc_id = 'doc b' or page_id > 5").collect()} == {"# doc b 3\n", "# a 10\n"}
    assert directory.pages(spark, root, "alignment", "0.05").where("page_id in (1, 2)").count() == 2
    assert directory.pages(spark, root, "alignment", "0.2").isEmpty()
    with pytest.raises(Exception, match="no page has the table"):
        directory.pages(spark, root, "regions")
    assert directory.pages(spark, root, "regions", schema="doc_id string, page_id int, x int").isEmpty()


def test_listing_feeds_discovery(spark, root):
    found = directory.pages(spark, root)
    old = S.discover(spark, root)
    key = lambda df: sorted((r.doc_id, r.page_id, tuple(sorted(r.files))) for r in df.collect())
    assert key(found) == key(old)
    assert [r.tag for r in S.noise_tags(found).collect()] == ["0", "0.05"]
    assert S.complete_pages(found, ("line_tokens",)).count() == 7 and S.bench_pages(found).isEmpty()


def planned(root, *filters, table="line_tokens"):
    """The folders that a plan lists and the files that its tasks open."""
    source = directory.PageDirectory({"path": root, "table": table})
    from pyspark.sql.types import _parse_datatype_string  # noqa: F401

    schema = source.schema()
    reader = source.reader(schema)
    left = list(reader.pushFilters(list(filters)))
    listed, opened = [], []
    names, parquet = directory.names, directory.pq.ParquetFile
    try:
        directory.names = lambda fs, path: listed.append(path.removeprefix(root).strip("/")) or names(fs, path)
        directory.pq.ParquetFile = lambda f: opened.append(f) or parquet(f)
        parts = reader.partitions()
        planning = list(listed)
        rows = sum(len(b) for p in parts for b in reader.read(p))
    finally:
        directory.names, directory.pq.ParquetFile = names, parquet
    return left, planning, listed[len(planning) :], len(opened), rows


def test_predicates_leave_folders_out(spark, root):
    left, planning, read, opened, rows = planned(root)
    assert planning == [""] and set(read) == {"a", "doc b", "c%2Fd+e", "empty", "summary"} and opened == 7 and rows == 14
    # one document: its folder alone is listed, nothing is listed to plan
    assert planned(root, EqualTo(("doc_id",), "a"), EqualTo(("page_id",), 10)) == ([], [], ["a"], 1, 2)
    assert planned(root, EqualTo(("doc_id",), "c/d e")) == ([], [], ["c%2Fd+e"], 1, 2)
    assert planned(root, In(("doc_id",), ("a", "doc b", "none")), GreaterThan(("page_id",), 0), LessThanOrEqual(("page_id",), 3)) == ([], [], ["a", "doc b"], 3, 6)
    assert planned(root, In(("page_id",), (0, 3)), EqualTo(("x0",), 1))[0] == [EqualTo(("x0",), 1)]
    assert planned(root, EqualTo(("doc_id",), "../a"))[2:] == ([], 0, 0)


def test_load_in_one_call(spark, root):
    page = directory.load(spark, root, "a", 10)
    assert set(page) == {"line_tokens", "markdown", "alignment"} and page["line_tokens"].count() == 2
    assert page["markdown"].first().markdown == "# a 10\n"
    assert set(directory.load(spark, root, "a", 0)) == {"line_tokens", "markdown"}
    every = directory.load(spark, root, tag="0.05")
    assert set(every) == {"line_tokens", "alignment"} and every["alignment"].count() == 4
    assert directory.load(spark, root, "nowhere") == {}
    assert page["line_tokens"].groupBy("doc_id").agg(F.sum("x0").alias("s")).first().s == 21
