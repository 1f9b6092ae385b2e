"""Interval queries of a viewer: merges, runs, character ranges, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .layout import KEY


def merge_intervals(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of each group's intervals; touching ones merge.

    Equal rows may come in any order: both windows are of one sort.  Rows without a start come last and open a range only
    where the group has no other.
    """
    w = Window.partitionBy(*by).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    marked = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def run_segments(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Runs of neighbours of equal ``flag``: segment number, its first and last position, and the flag."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumn("_c", F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1))
    marked = marked.withColumn("segment", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*by, "segment", flag).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def char_ranges(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parts [start, end) of each node that a range (ast_index_start, char_start, ast_index_end, char_end inclusive) covers; empty parts are dropped."""
    n = nodes.select(*KEY, "ast_index", (F.col("end") - F.col("start")).alias("length"))
    hit = ranges.join(n, KEY).where(F.col("ast_index").between(F.col("ast_index_start"), F.col("ast_index_end")))
    start = F.when(F.col("ast_index") == F.col("ast_index_start"), F.col("char_start")).otherwise(0)
    end = F.when(F.col("ast_index") == F.col("ast_index_end"), F.col("char_end") + 1).otherwise(F.col("length"))
    return hit.select(*KEY, "node_id", "ast_index", start.alias("start"), end.alias("end")).where(F.col("end") > F.col("start"))


def selection_overlap(blocks: DataFrame, lines: DataFrame, selections: DataFrame) -> DataFrame:
    """Nodes that a selection (ast_index_start, char_start, ast_index_end, char_end) overlaps: blocks by node range, lines lexicographically, ends inclusive."""
    s = selections.select(*KEY, F.struct(F.col("ast_index_start").alias("a"), F.col("char_start").alias("c")).alias("s0"), F.struct(F.col("ast_index_end").alias("a"), F.col("char_end").alias("c")).alias("s1"))
    b = blocks.join(s, KEY).where((F.col("ast_start") <= F.col("s1.a")) & (F.col("ast_end") >= F.col("s0.a")))
    n = lines.withColumn("l0", F.struct(F.col("ast_index_start").alias("a"), F.col("char_start").alias("c"))).withColumn("l1", F.struct(F.col("ast_index_end").alias("a"), F.col("char_end").alias("c")))
    n = n.join(s, KEY).where((F.col("l0") <= F.col("s1")) & (F.col("l1") >= F.col("s0")))
    return b.select(*KEY, "node_id", F.lit("block").alias("level_name")).unionByName(n.select(*KEY, "node_id", F.lit("line").alias("level_name")))


def first_hit(hits: DataFrame, tree: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """The first node of a page, in tree order, that is hit and of a visible level."""
    t = tree.select(*KEY, "node_id", "level_name", "tree_pos")
    t = t if levels is None else t.where(F.col("level_name").isin(*levels))
    best = hits.select(*KEY, "node_id").join(t, [*KEY, "node_id"]).groupBy(*KEY).agg(F.min(F.struct("tree_pos", "node_id")).alias("m"))
    return best.select(*KEY, F.col("m.node_id").alias("node_id"))


def active_alignments(active: DataFrame, alignments: DataFrame) -> DataFrame:
    """Alignments of the activated nodes; nodes without one drop out."""
    return alignments.join(active.select(*KEY, "node_id").distinct(), [*KEY, "node_id"], "left_semi")


def highlighted_text(nodes: DataFrame, ranges: DataFrame, opening: str = "<span data-line-highlight>", closing: str = "</span>") -> DataFrame:
    """Nodes (with ``content``) whose ranges [start, end), merged where they touch, stand between ``opening`` and ``closing``."""
    by = [*KEY, "ast_index"]
    parts = merge_intervals(ranges.select(*by, "start", "end"), by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_r"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def mark(acc, r):
        piece = F.concat(acc["out"], F.substring("content", acc["at"] + 1, r["start"] - acc["at"]), F.lit(opening), F.substring("content", r["start"] + 1, r["end"] - r["start"]), F.lit(closing))
        return F.struct(r["end"].cast("int").alias("at"), piece.alias("out"))

    rest = F.aggregate("_r", zero, mark, lambda acc: F.concat(acc["out"], F.substring("content", acc["at"] + 1, F.length("content"))))
    joined = nodes.select(*by, "content").join(parts, by, "left")
    return joined.select(*by, F.when(F.col("_r").isNull(), F.col("content")).otherwise(rest).alias("content"))


def highlighted(ranges: DataFrame, start: str = "ast_start", end: str = "ast_end") -> DataFrame:
    """Distinct node indexes of inclusive ranges."""
    return ranges.select(*KEY, F.explode(F.sequence(F.col(start), F.col(end))).alias("ast_index")).distinct()


def node_labels(tree: DataFrame) -> DataFrame:
    """``parent/id`` of each node, the id alone without a parent."""
    return tree.select(*KEY, "node_id", F.concat_ws("/", "parent_id", "node_id").alias("path"))
