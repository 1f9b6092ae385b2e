"""A page model derived from the ``documents`` table: one page per document, its source as the document.

Lines are the text's lines; a block is four lines, shifted a little on some pages so that some lines
fall out of it; three overlapping bands are regions.  Alignments are fixed arithmetic of the ids.
``SQL`` holds the same rules for DuckDB.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import layout
from ..operators.layout import KEY

TAGS = ["0", "0.01", "0.05", "0.2"]
LABELS = ["text", "paragraph_title", "table", "formula", ""]


#: Kinds of blocks that lines are written as in turn, what goes before and behind the line, and the blank lines that count as the block's.
MARKS = [
    ("heading", "# x ", "", 0),
    ("code_block", "    x ", "\n\n    y", 0),
    ("paragraph", "x ", "\nsecond \"quoted\" line, isn't it? (We cannot) say: they'll wanna go -- 'tis $5.30... the end.", 0),
    ("bullet_list", "- x ", "\n  more\n\n  again", 1),
    ("blockquote", "> x ", "\nlazy", 0),
    ("fence", "```\nx ", "\n\n- z\n```", 0),
    ("ordered_list", "1. x ", "\n2. y", 1),
    ("html_block", "<div>\nx ", "\n</div>", 0),
    ("table", "| a | b |\n|---|---|\n| x ", " |", 0),
    ("heading", "x ", "\n===", 0),
    ("", "[r]: /u 'x ", "'", 0),
]


class Pages:
    """The derived tables of one ``sf_dir``, each a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._derive(spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null"))

    def _derive(self, documents: DataFrame) -> None:
        self.documents = documents
        self.pages = self.documents.select(F.lit(0).alias("page_id"), "doc_id", F.col("source").alias("document"), F.col("text").alias("markdown"))

    def gathered(self) -> Pages:
        """The same tables for queries that take pages apart and join them again: texts are shuffled once, and all of a page stays where its text is."""
        out = copy.copy(self)
        out._derive(self.documents.repartition("doc_id"))
        return out

    @property
    def text(self) -> DataFrame:
        return self.pages.select(*KEY, "markdown")

    @property
    def lines(self) -> DataFrame:
        d = self.pages.select(*KEY, F.posexplode(F.split("markdown", "\n")).alias("line_index", "content"))
        w = Window.partitionBy(*KEY).orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
        size = F.length("content")
        return d.select(
            *KEY,
            "line_index",
            F.concat(F.lit("line_"), F.col("line_index").cast("string")).alias("node_id"),
            "content",
            F.coalesce(F.sum(size + 1).over(w), F.lit(0)).cast("int").alias("char_start"),
            F.expr("line_index div 4").cast("int").alias("block_index"),
            F.lit(0).alias("x0"),
            (F.col("line_index") * 12).alias("y0"),
            (F.least(size, F.lit(200)) * 8).alias("x1"),
            (F.col("line_index") * 12 + 10).alias("y1"),
        )

    @property
    def marked(self) -> DataFrame:
        """The pages' lines written as markdown blocks in turn, a blank line behind each."""
        each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for _, a, z, _ in MARKS])
        mark = F.element_at(each, (F.col("line_index") % len(MARKS) + 1).cast("int"))
        # a quote would end a definition's title
        bare = F.translate("content", "\r'", "  ")
        body = F.concat(mark["a"], bare, mark["z"], F.lit("\n\n"))
        page = self.lines.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("line_index", body.alias("body")))).alias("b"))
        return page.select(*KEY, F.array_join("b.body", "").alias("markdown"))

    @property
    def blocks(self) -> DataFrame:
        g = self.lines.groupBy(*KEY, "block_index").agg(F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("char_start").alias("start"), F.max(F.col("char_start") + F.length("content")).alias("end"))
        label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("block_index") % 5 + 1).cast("int"))
        return g.select(
            *KEY,
            "block_index",
            F.concat(F.lit("block_"), F.col("block_index").cast("string")).alias("node_id"),
            F.lit(0).alias("x0"),
            (F.col("y0") + F.col("doc_id") % 5 * 3).alias("y0"),
            "x1",
            F.col("y1").cast("long").alias("y1"),
            label.alias("label"),
            F.when(F.col("block_index") % 7 != 6, F.col("block_index")).alias("order"),
            F.lit("").alias("content"),
            "start",
            "end",
        )

    @property
    def regions(self) -> DataFrame:
        h = self.lines.groupBy(*KEY).agg(F.max("y1").alias("h")).withColumn("b", F.expr("(h + 2) div 3").cast("int"))
        bands = F.array(*[F.struct(F.lit(k).alias("k"), a.cast("int").alias("a"), b.cast("int").alias("z")) for k, (a, b) in enumerate([(F.lit(0), F.col("b")), (F.expr("b div 2"), F.expr("b div 2 + b")), (F.expr("2 * b"), F.expr("3 * b"))])])
        r = h.select(*KEY, F.explode(bands).alias("r"))
        return r.select(*KEY, F.col("r.k").alias("region_index"), F.concat(F.lit("region_"), F.col("r.k").cast("string")).alias("node_id"), F.lit(0).alias("x0"), F.col("r.a").alias("y0"), F.lit(1600).alias("x1"), F.col("r.z").alias("y1"), F.lit("band").alias("label"), F.lit("").alias("content"))

    @property
    def words(self) -> DataFrame:
        d = self.lines.select(*KEY, "line_index", F.posexplode(F.regexp_extract_all("content", F.lit("[^ \t]+"), F.lit(0))).alias("k", "content"))
        return d.select(
            *KEY,
            "line_index",
            "k",
            F.concat_ws("_", F.lit("word"), F.col("line_index").cast("string"), F.col("k").cast("string")).alias("node_id"),
            "content",
            (F.col("k") * 8).alias("x0"),
            (F.col("line_index") * 12).alias("y0"),
            (F.col("k") * 8 + 8).alias("x1"),
            (F.col("line_index") * 12 + 10).alias("y1"),
        )

    @property
    def nodes(self) -> DataFrame:
        """An AST node per block."""
        return self.blocks.select(*KEY, F.col("block_index").alias("ast_index"), "start", "end")

    @property
    def tree(self) -> DataFrame:
        return layout.layout_tree(self.regions, self.blocks, self.lines, self.words)

    @property
    def block_alignments(self) -> DataFrame:
        b = self.blocks.where("(doc_id + block_index) % 9 <> 0")
        return b.select(*KEY, "node_id", F.col("block_index").alias("ast_start"), F.col("block_index").alias("ast_end"), ((F.col("doc_id") * 31 + F.col("block_index") * 17) % 100 / 100.0).alias("score"))

    @property
    def gold_lines(self) -> DataFrame:
        b = self.nodes.select(*KEY, F.col("ast_index").alias("block_index"), "start")
        n = self.lines.where("length(content) > 0 and (doc_id + line_index) % 11 <> 3").join(b, [*KEY, "block_index"])
        rel = F.col("char_start") - F.col("start")
        return n.select(
            *KEY, "node_id", F.col("line_index").alias("pos"), F.concat(F.lit("block_"), F.col("block_index").cast("string")).alias("parent_id"), "line_index", "block_index",
            F.col("block_index").alias("ast_index_start"), rel.alias("char_start"), F.col("block_index").alias("ast_index_end"), (rel + F.length("content") - 1).alias("char_end"),
            ((F.col("doc_id") * 13 + F.col("line_index") * 7) % 101 / 100.0).alias("score"),
        )

    def _tagged(self, df: DataFrame) -> DataFrame:
        tags = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("noise")) for k, t in enumerate(TAGS)])
        return df.withColumn("t", F.explode(tags)).select("*", "t.k", "t.noise").drop("t")

    @property
    def noise_lines(self) -> DataFrame:
        n = self._tagged(self.gold_lines).where("k = 0 or (doc_id * 7 + line_index + k) % 11 <> 0")
        shift = F.expr("cast((doc_id * 7 + line_index) % 4 * k as int)")
        return n.withColumns({"char_start": F.col("char_start") + shift, "char_end": F.col("char_end") + shift, "score": F.col("score") * (5 - F.col("k")) / 5}).drop("k")

    @property
    def noise_blocks(self) -> DataFrame:
        b = self._tagged(self.block_alignments.withColumn("block_index", F.col("ast_start")))
        other = F.when((F.col("k") > 0) & (F.col("block_index") % 13 == 5), 1).otherwise(0)
        return b.withColumn("ast_end", F.col("ast_end") + other).drop("k", "block_index")

    @property
    def scored_lines(self) -> DataFrame:
        """Line scores of all tags with their document: the table that the reports read."""
        n = self.noise_lines.select(*KEY, "noise", F.col("node_id").alias("line_id"), "score", (F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("block_index") % 5 + 1).cast("int"))).alias("block_label"))
        return n.join(self.pages.select(*KEY, "document"), KEY)


def _text(value: str) -> str:
    """A SQL string, with line feeds by their code."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


#: The marked lines and the nodes that they must give, by how they are put together.
MARKED = f"""
, marks AS (SELECT unnest([{", ".join(f"{{'kind': {_text(k)}, 'a': {_text(a)}, 'z': {_text(z)}, 'more': {n}}}" for k, a, z, n in MARKS)}]) AS m, unnest(range({len(MARKS)})) AS i),
marked AS (SELECT doc_id, line_index, m.kind AS kind, m.a || translate(content, chr(13) || chr(39), '  ') || m.z AS body, m.more AS more FROM lines JOIN marks ON i = line_index % {len(MARKS)}),
placed AS (SELECT *, coalesce(sum(length(body) + 2) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM marked),
ast AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_index) - 1)::INTEGER AS ast_index, kind AS type, start, (start + length(body) + 1 + more)::INTEGER AS "end", body || repeat(chr(10), 1 + more) AS t FROM placed WHERE kind <> '')"""

SQL = """
WITH pages AS (SELECT doc_id, 0 AS page_id, source AS document, text AS markdown FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, page_id, string_split(markdown, chr(10)) AS l FROM pages),
pos AS (SELECT doc_id, page_id, l, unnest(range(len(l))) AS line_index FROM split),
cut AS (SELECT doc_id, page_id, CAST(line_index AS INTEGER) AS line_index, l[line_index + 1] AS content FROM pos),
lines AS (SELECT doc_id, page_id, line_index, 'line_' || line_index AS node_id, content,
  CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start,
  line_index // 4 AS block_index, 0 AS x0, 12 * line_index AS y0, 8 * least(length(content), 200) AS x1, 12 * line_index + 10 AS y1 FROM cut),
blocks AS (SELECT doc_id, page_id, block_index, 'block_' || block_index AS node_id, 0 AS x0, min(y0) + doc_id % 5 * 3 AS y0, max(x1) AS x1, max(y1) AS y1,
  ['text', 'paragraph_title', 'table', 'formula', ''][block_index % 5 + 1] AS label, CASE WHEN block_index % 7 <> 6 THEN block_index END AS ord,
  min(char_start) AS s, max(char_start + length(content)) AS e FROM lines GROUP BY doc_id, page_id, block_index),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord NULLS LAST, block_index) - 1 AS bpos FROM blocks),
heights AS (SELECT doc_id, page_id, (max(y1) + 2) // 3 AS b FROM lines GROUP BY doc_id, page_id),
bands AS (SELECT doc_id, page_id, unnest([{'k': 0, 'a': 0, 'z': b}, {'k': 1, 'a': b // 2, 'z': b // 2 + b}, {'k': 2, 'a': 2 * b, 'z': 3 * b}]) AS r FROM heights),
regions AS (SELECT doc_id, page_id, r.k AS region_index, 'region_' || r.k AS node_id, 0 AS x0, r.a AS y0, 1600 AS x1, r.z AS y1 FROM bands),
regioned AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY greatest(0, (x1 - x0) * (y1 - y0)) DESC, region_index DESC) - 1 AS rpos FROM regions),
words AS (SELECT doc_id, page_id, line_index, k - 1 AS k, w[k] AS content, 'word_' || line_index || '_' || (k - 1) AS node_id, 8 * (k - 1) AS x0, 12 * line_index AS y0, 8 * k AS x1, 12 * line_index + 10 AS y1
  FROM (SELECT doc_id, page_id, line_index, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT *, regexp_extract_all(content, '[^ \\t]+') AS w FROM lines))),
lb AS (SELECT l.doc_id, l.page_id, l.node_id, b.node_id AS parent_id, b.bpos,
  greatest(0, least(l.x1, b.x1) - greatest(l.x0, b.x0)) * greatest(0, least(l.y1, b.y1) - greatest(l.y0, b.y0)) / greatest(1, (l.x1 - l.x0) * (l.y1 - l.y0)) AS ratio
  FROM lines l JOIN ordered b ON l.doc_id = b.doc_id),
line_parent AS (SELECT * FROM lb WHERE ratio >= 0.70 QUALIFY row_number() OVER (PARTITION BY doc_id, node_id ORDER BY ratio DESC, bpos) = 1),
br AS (SELECT b.doc_id, b.page_id, b.node_id, r.node_id AS parent_id, r.rpos,
  greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) / greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0)) AS ratio
  FROM blocks b JOIN regioned r ON b.doc_id = r.doc_id),
block_parent AS (SELECT * FROM br WHERE ratio >= 0.70 QUALIFY row_number() OVER (PARTITION BY doc_id, node_id ORDER BY ratio DESC, rpos) = 1),
tree AS (
  SELECT doc_id, page_id, node_id, 0 AS level_index, 'region' AS level_name, CAST(NULL AS VARCHAR) AS parent_id, x0, y0, x1, y1, 'band' AS label, '' AS content FROM regions
  UNION ALL SELECT b.doc_id, b.page_id, b.node_id, 1, 'block', p.parent_id, b.x0, b.y0, b.x1, b.y1, b.label, '' FROM blocks b LEFT JOIN block_parent p ON b.doc_id = p.doc_id AND b.node_id = p.node_id
  UNION ALL SELECT l.doc_id, l.page_id, l.node_id, 2, 'line', p.parent_id, l.x0, l.y0, l.x1, l.y1, 'line', l.content FROM lines l LEFT JOIN line_parent p ON l.doc_id = p.doc_id AND l.node_id = p.node_id
  UNION ALL SELECT doc_id, page_id, node_id, 3, 'word', 'line_' || line_index, x0, y0, x1, y1, 'word', content FROM words),
nodes AS (SELECT doc_id, page_id, block_index AS ast_index, s, e FROM blocks),
block_alignments AS (SELECT doc_id, page_id, node_id, block_index, block_index AS ast_start, block_index AS ast_end, (doc_id * 31 + block_index * 17) % 100 / 100.0 AS score, label FROM blocks WHERE (doc_id + block_index) % 9 <> 0),
gold_lines AS (SELECT l.doc_id, l.page_id, l.node_id, l.line_index, l.block_index, 'block_' || l.block_index AS parent_id, l.char_start - n.s AS c0, l.char_start - n.s + length(l.content) - 1 AS c1,
  (l.doc_id * 13 + l.line_index * 7) % 101 / 100.0 AS score, n.s FROM lines l JOIN nodes n ON l.doc_id = n.doc_id AND l.block_index = n.ast_index WHERE length(l.content) > 0 AND (l.doc_id + l.line_index) % 11 <> 3),
tags AS (SELECT unnest([{'k': 0, 'noise': '0'}, {'k': 1, 'noise': '0.01'}, {'k': 2, 'noise': '0.05'}, {'k': 3, 'noise': '0.2'}]) AS t),
noise_lines AS (SELECT g.doc_id, g.page_id, g.node_id, g.line_index, g.block_index, t.noise, g.s, c0 + (g.doc_id * 7 + line_index) % 4 * t.k AS c0, c1 + (g.doc_id * 7 + line_index) % 4 * t.k AS c1, score * (5 - t.k) / 5 AS score
  FROM gold_lines g, tags WHERE t.k = 0 OR (g.doc_id * 7 + line_index + t.k) % 11 <> 0),
noise_blocks AS (SELECT doc_id, node_id AS parent_id, t.noise, ast_start, ast_end + CASE WHEN t.k > 0 AND block_index % 13 = 5 THEN 1 ELSE 0 END AS ast_end FROM block_alignments, tags),
scored AS (SELECT n.doc_id, n.page_id, n.noise, n.node_id AS line_id, n.score, ['text', 'paragraph_title', 'table', 'formula', ''][n.block_index % 5 + 1] AS block_label, p.document FROM noise_lines n JOIN pages p ON n.doc_id = p.doc_id),
pr0 AS (SELECT g.doc_id, p.document, t.noise AS noise_level, g.node_id AS line_id, gb.ast_start IS NULL OR nb.ast_start IS NULL OR gb.ast_start <> nb.ast_start OR gb.ast_end <> nb.ast_end AS is_block_error,
  g.s + g.c0 AS g0, g.s + g.c1 AS g1, n.s + n.c0 AS n0, n.s + n.c1 AS n1
  FROM gold_lines g JOIN pages p ON g.doc_id = p.doc_id CROSS JOIN tags LEFT JOIN block_alignments gb ON g.doc_id = gb.doc_id AND g.parent_id = gb.node_id
  LEFT JOIN noise_blocks nb ON g.doc_id = nb.doc_id AND g.parent_id = nb.parent_id AND nb.noise = t.noise LEFT JOIN noise_lines n ON g.doc_id = n.doc_id AND g.node_id = n.node_id AND n.noise = t.noise),
pr AS (SELECT doc_id, document, noise_level, line_id, is_block_error,
  CASE WHEN is_block_error OR n0 IS NULL OR n1 - n0 <= 0 THEN 0.0 ELSE greatest(0, least(g1, n1) - greatest(g0, n0)) / (n1 - n0) END AS precision,
  CASE WHEN is_block_error OR n0 IS NULL OR g1 - g0 <= 0 THEN 0.0 ELSE greatest(0, least(g1, n1) - greatest(g0, n0)) / (g1 - g0) END AS recall FROM pr0),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, CASE WHEN is_block_error THEN 1.0 ELSE 0.0 END AS block_error FROM pr)
"""
