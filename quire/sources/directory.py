"""Page directories as a data source: ``format("page_directory")`` over ``<path>/<document>/<page>/``.

Option ``table`` says what a row is read from: nothing gives a row a page with the names in its folder (``files``); the name
of a Parquet table gives that table's rows; ``markdown`` and ``alignment`` give a page's text or JSON, of the noise tag in
``tag`` (0 without one).  Every row has ``doc_id`` and ``page_id``, from the path.

The planner lists the documents and nothing below them, or none at all where a predicate names them; a task lists the
pages of its documents, and opens those that the predicates on ``page_id`` leave.  Predicates are offered
where ``spark.sql.python.filterPushdown.enabled`` is true (``register`` sets it).  Documents and pages come in no order;
a page without the wanted file gives no row; folders whose name is no number are no pages.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from urllib.parse import quote_plus, unquote_plus, urlparse

import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

KEY = "doc_id string, page_id int"
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: Documents of a task.
DOCUMENTS = 16


def filesystem(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return pfs.LocalFileSystem(), (at.path or path).rstrip("/")
    fs, base = pfs.FileSystem.from_uri(path)
    return fs, base.rstrip("/")


def names(fs: pfs.FileSystem, path: str) -> list[pfs.FileInfo]:
    """What lies in a folder; nothing where there is none."""
    return fs.get_file_info(pfs.FileSelector(path, allow_not_found=True))


def file_of(table: str, tag: str) -> str:
    """The file of a page that has a table."""
    if table == "markdown":
        return "markdown/markdown.md" if tag == "0" else f"markdown_{tag}.md"
    if table == "alignment":
        return "alignment.json" if tag == "0" else f"alignment_{tag}.json"
    return f"{table}.parquet"


class Documents(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.tag = options["path"], options.get("table", ""), options.get("tag", "0")
        self.columns = [f.name for f in schema.fields]
        self.documents: set[str] | None = None
        self.tests: list[tuple[type, int]] = []
        self.pages: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "doc_id" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.documents = asked if self.documents is None else self.documents & asked
            elif column == "page_id" and isinstance(f, In):
                self.pages = set(f.value) if self.pages is None else self.pages & set(f.value)
            elif column == "page_id" and type(f) in COMPARE:
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, base = filesystem(self.path)
        if self.documents is None:
            folders = [x.base_name for x in names(fs, base) if x.type == pfs.FileType.Directory]
        else:
            # a document's folder has its name, as it is or encoded
            asked = {n for d in self.documents if d for n in (d, quote_plus(d)) if "/" not in n}
            folders = [x.base_name for x in fs.get_file_info([f"{base}/{n}" for n in asked]) if x.type == pfs.FileType.Directory]
            folders = [n for n in folders if unquote_plus(n) in self.documents]
        folders = sorted(folders)
        return [Documents(folders[k : k + DOCUMENTS]) for k in range(0, len(folders), DOCUMENTS)] or [Documents([])]

    def wanted(self, name: str) -> bool:
        if not name.isascii() or not name.isdigit():
            return False
        page = int(name)
        return (self.pages is None or page in self.pages) and all(COMPARE[t](page, v) for t, v in self.tests)

    def read(self, partition: Documents) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(self.path)
        for folder in partition.folders:
            for page in names(fs, f"{base}/{folder}"):
                if page.type == pfs.FileType.Directory and self.wanted(page.base_name):
                    yield from self._page(fs, page.path, unquote_plus(folder), int(page.base_name))

    def _page(self, fs: pfs.FileSystem, path: str, doc_id: str, page_id: int) -> Iterator[pa.RecordBatch]:
        if not self.table:
            found = sorted(x.base_name for x in names(fs, path))
            yield self._batch({"files": pa.array([found], pa.list_(pa.string()))}, 1, doc_id, page_id)
            return
        at = f"{path}/{file_of(self.table, self.tag)}"
        if fs.get_file_info(at).type != pfs.FileType.File:
            return
        if self.table in ("markdown", "alignment"):
            with fs.open_input_file(at) as f:
                text = f.read().decode()
            yield self._batch({"markdown" if self.table == "markdown" else "value": pa.array([text])}, 1, doc_id, page_id)
            return
        with fs.open_input_file(at) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=[c for c in self.columns if c not in ("doc_id", "page_id")]):
                yield self._batch(dict(zip(batch.schema.names, batch.columns, strict=True)), len(batch), doc_id, page_id)

    def _batch(self, own: dict, n: int, doc_id: str, page_id: int) -> pa.RecordBatch:
        own = own | {"doc_id": pa.array([doc_id] * n, pa.string()), "page_id": pa.array([page_id] * n, pa.int32())}
        return pa.RecordBatch.from_arrays([own[c] for c in self.columns], self.columns)


class PageDirectory(DataSource):
    """``format("page_directory")``."""

    @classmethod
    def name(cls) -> str:
        return "page_directory"

    def schema(self) -> str | StructType:
        table, tag = self.options.get("table", ""), self.options.get("tag", "0")
        if not table:
            return f"{KEY}, files array<string>"
        if table in ("markdown", "alignment"):
            return f"{KEY}, {'markdown' if table == 'markdown' else 'value'} string"
        from pyspark.sql.pandas.types import from_arrow_schema

        # the columns of the first page that has the table
        fs, base = filesystem(self.options["path"])
        for document in names(fs, base):
            for page in names(fs, document.path) if document.type == pfs.FileType.Directory else ():
                at = f"{page.path}/{file_of(table, tag)}"
                if page.base_name.isdigit() and fs.get_file_info(at).type == pfs.FileType.File:
                    with fs.open_input_file(at) as f:
                        own = [x for x in pq.read_schema(f) if x.name not in ("doc_id", "page_id")]
                    return from_arrow_schema(pa.schema([("doc_id", pa.string()), ("page_id", pa.int32()), *own]))
        raise FileNotFoundError(f"no page has the table {table}; give a schema")

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Registers the source and lets Spark offer it predicates."""
    spark.dataSource.register(PageDirectory)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def pages(spark: SparkSession, root: str, table: str = "", tag: str = "0", schema: str | StructType | None = None) -> DataFrame:
    """The rows of a table of all pages (of their names without one); predicates on ``doc_id`` and ``page_id`` leave folders out."""
    register(spark)
    reader = spark.read.format("page_directory").option("table", table).option("tag", tag)
    return (reader if schema is None else reader.schema(schema)).load(root)


# The tables of a page.
TABLES = ("line_tokens", "word_tokens", "regions", "layout", "blocks", "formulas")


def load(spark: SparkSession, root: str, doc_id: str | None = None, page_id: int | None = None, tag: str = "0") -> dict[str, DataFrame]:
    """What a page, a document or a whole folder has, by name: the tables that the chosen pages have, ``layout-tree``, ``markdown`` and ``alignment``."""

    def chosen(df: DataFrame) -> DataFrame:
        df = df if doc_id is None else df.where(df["doc_id"] == doc_id)
        return df if page_id is None else df.where(df["page_id"] == page_id)

    from pyspark.sql import functions as F

    there = chosen(pages(spark, root)).select(F.explode("files").alias("f")).distinct()
    # names of files, a handful
    files = {r.f for r in there.collect()}
    out = {t: chosen(pages(spark, root, t)) for t in (*TABLES, "layout-tree") if f"{t}.parquet" in files}
    if file_of("markdown", tag).split("/")[0] in files:
        out["markdown"] = chosen(pages(spark, root, "markdown", tag))
    if file_of("alignment", tag) in files:
        out["alignment"] = chosen(pages(spark, root, "alignment", tag))
    return out
