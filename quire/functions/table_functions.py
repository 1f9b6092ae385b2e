"""Table functions for SQL: the blocks of a text, the ranges of a page's nodes, and the windows of a block's words.

``register`` gives them to a session.  The first is lateral, the next two take a table of rows and say themselves how it is
partitioned and ordered, the last takes a row for each block and reads many of them as Arrow arrays at once::

    SELECT p.doc_id, b.* FROM pages p, LATERAL markdown_blocks(p.markdown) b
    SELECT * FROM node_ranges(TABLE(nodes))
    SELECT * FROM word_windows(TABLE(words))
    SELECT * FROM block_windows(TABLE(blocks))

A partition is a page (or a block of one); what is held of it is its nodes' places, or the words of one window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .markdown import markdown_nodes


@udtf(returnType="ast_index int, type string, start int, end int")
class MarkdownBlocks:
    """A row for each top-level block of a markdown text; a null text has none."""

    def eval(self, markdown: str) -> Iterator[tuple]:
        for k, (kind, start, end) in enumerate(markdown_nodes(markdown)):
            yield k, kind, start, end


def _schema(table: AnalyzeArgument, keys: list[str], needs: list[str]) -> StructType:
    """The key columns of a table argument, with their own types."""
    if not table.isTable:
        raise ValueError("the argument must be a table")
    there = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [c for c in [*keys, *needs] if c not in there]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    out = StructType()
    for k in keys:
        out.add(k, there[k])
    return out


@udtf
class NodeRanges:
    """All ranges ast_start..ast_end (inclusive) of a page's nodes with their places; takes doc_id, page_id, ast_index, start, end."""

    @staticmethod
    def analyze(nodes: AnalyzeArgument) -> AnalyzeResult:
        schema = _schema(nodes, ["doc_id", "page_id"], ["ast_index", "start", "end"])
        for c in ("ast_start", "ast_end", "start", "end"):
            schema.add(c, IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id"), PartitioningColumn("page_id")], orderBy=[OrderingColumn("ast_index")])

    def __init__(self) -> None:
        self.starts: list[tuple[int, int]] = []

    def eval(self, node: Row) -> Iterator[tuple]:
        # a node ends a range for each node up to it
        self.starts.append((node["ast_index"], node["start"]))
        for index, start in self.starts:
            yield node["doc_id"], node["page_id"], index, node["ast_index"], start, node["end"]


@udtf
class WordWindows:
    """For each word that begins a candidate, the first and last word that may end it.

    Takes doc_id, page_id, parent_id, word_index, start, end, and the least and most length of a candidate of the
    block; words are numbered from 0 within it.
    """

    @staticmethod
    def analyze(words: AnalyzeArgument) -> AnalyzeResult:
        keys = ["doc_id", "page_id", "parent_id"]
        schema = _schema(words, keys, ["word_index", "start", "end", "least", "most"]).add("word_index", LongType())
        for c in ("first", "last"):
            schema.add(c, IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(k) for k in keys], orderBy=[OrderingColumn("word_index")])

    def __init__(self) -> None:
        # starts whose window is still open: number, word, start, and the first end once one is long enough
        self.open: deque[list] = deque()
        self.n = 0
        self.key: tuple | None = None

    def eval(self, word: Row) -> Iterator[tuple]:
        self.key = (word["doc_id"], word["page_id"], word["parent_id"])
        while self.open and word["end"] - self.open[0][2] > word["most"]:
            yield from self._closed(self.open.popleft())
        self.open.append([self.n, word["word_index"], word["start"], None])
        for start in self.open:
            if start[3] is None and word["end"] - start[2] >= word["least"]:
                start[3] = self.n
        # a word longer than the window begins nothing
        if word["end"] - word["start"] > word["most"]:
            self.open.pop()
        self.n += 1

    def _closed(self, start: list) -> Iterator[tuple]:
        if start[3] is not None:
            yield *self.key, start[1], start[3], self.n - 1

    def terminate(self) -> Iterator[tuple]:
        for start in self.open:
            yield from self._closed(start)


#: Blocks whose windows are worked out together.
TOGETHER = 1000


@arrow_udtf(returnType="doc_id bigint, page_id int, parent_id string, word_index bigint, first int, last int")
class BlockWindows:
    """The rows of ``word_windows`` from a row for each block.

    Takes doc_id, page_id, parent_id, words (array of word_index, start and end, in order and apart), least and most; blocks are independent of each other.
    """

    def eval(self, blocks: pa.RecordBatch) -> Iterator[pa.Table]:
        for k in range(0, len(blocks), TOGETHER):
            some = blocks.slice(k, TOGETHER)
            words = some.column("words")
            size = np.array(words.value_lengths().fill_null(0), np.int64)
            index, start, end = (np.array(c, np.int64) for c in words.flatten().flatten())
            of = np.repeat(np.arange(len(some)), size)
            before = np.repeat(np.cumsum(size) - size, size)
            # places of one block lie beyond all of the one before it
            shift = of << 40
            least, most = (np.array(some.column(c), np.int64)[of] for c in ("least", "most"))
            first = np.maximum(np.searchsorted(shift + end, shift + start + least, "left"), np.arange(len(of))) - before
            last = np.searchsorted(shift + end, shift + start + most, "right") - 1 - before
            keep = np.flatnonzero(first <= last)
            keys = some.select(["doc_id", "page_id", "parent_id"]).take(pa.array(of[keep]))
            yield pa.table([*keys.columns, pa.array(index[keep]), pa.array(first[keep], pa.int32()), pa.array(last[keep], pa.int32())], names=[*keys.schema.names, "word_index", "first", "last"])


FUNCTIONS = {"markdown_blocks": MarkdownBlocks, "node_ranges": NodeRanges, "word_windows": WordWindows, "block_windows": BlockWindows}


def register(spark: SparkSession) -> None:
    """Registers the table functions."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
