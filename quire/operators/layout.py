"""Layout hierarchy: overlap ratios, max-overlap parents, and the tree of regions, blocks, lines and words.

All tables carry ``doc_id`` and ``page_id``; every join is on them, so no spatial join is a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["doc_id", "page_id"]
BOX = ["x0", "y0", "x1", "y1"]
TOLERANCE = 0.70
TREE = [*KEY, "node_id", "level_index", "level_name", "parent_id", *BOX, "label", "content"]


def area(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    """Signed product of the sides; an inverted box of two negative sides is positive."""
    return (F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0))


def overlap_ratio(child: str = "c_", parent: str = "p_") -> Column:
    """Intersection over the child's area (1 at least); the child's coordinates are truncated to integers, the parent's are not."""
    c = {b: F.col(child + b).cast("int") for b in BOX}
    p = {b: F.col(parent + b) for b in BOX}
    w = F.greatest(F.lit(0), F.least(c["x1"], p["x1"]) - F.greatest(c["x0"], p["x0"]))
    h = F.greatest(F.lit(0), F.least(c["y1"], p["y1"]) - F.greatest(c["y0"], p["y0"]))
    return (w * h) / F.greatest(F.lit(1), (c["x1"] - c["x0"]) * (c["y1"] - c["y0"]))


def overlap_parent(children: DataFrame, parents: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Children (node_id, box) with ``parent_id`` and ``ratio``: the parent of largest ratio at or above the tolerance, of equal ones the first by ``pos``; else null."""
    c = children.select(*KEY, F.col("node_id"), *[F.col(b).alias("c_" + b) for b in BOX])
    p = parents.select(*KEY, F.col("node_id").alias("parent_id"), "pos", *[F.col(b).alias("p_" + b) for b in BOX])
    hits = c.join(p, KEY).withColumn("ratio", overlap_ratio()).where(F.col("ratio") >= tolerance)
    best = hits.groupBy(*KEY, "node_id").agg(F.max(F.struct("ratio", (-F.col("pos")).alias("neg"), "parent_id")).alias("m"))
    return children.join(best.select(*KEY, "node_id", F.col("m.parent_id").alias("parent_id"), F.col("m.ratio").alias("ratio")), [*KEY, "node_id"], "left")


def order_regions(regions: DataFrame) -> DataFrame:
    """``pos``: area descending (negative as 0), equal areas by position reversed."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(F.greatest(F.lit(0), area())), F.desc("region_index"))
    return regions.withColumn("pos", F.row_number().over(w) - 1)


def order_blocks(blocks: DataFrame) -> DataFrame:
    """``pos``: reading order, nulls last, then position."""
    w = Window.partitionBy(*KEY).orderBy(F.col("order").asc_nulls_last(), "block_index")
    return blocks.withColumn("pos", F.row_number().over(w) - 1)


def order_lines(lines: DataFrame) -> DataFrame:
    """``pos``: from the top down, equal heights by position."""
    w = Window.partitionBy(*KEY).orderBy("y0", "line_index")
    return lines.withColumn("pos", F.row_number().over(w) - 1)


def word_parents(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words with the id of the line they name, null where there is none."""
    known = lines.select(*KEY, "line_index", F.col("node_id").alias("parent_id"))
    return words.join(known, [*KEY, "line_index"], "left")


def layout_tree(regions: DataFrame, blocks: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """The adjacency list of a page's four levels."""

    def level(df: DataFrame, index: int, name: str, label: Column, content: Column) -> DataFrame:
        return df.select(*KEY, "node_id", F.lit(index).alias("level_index"), F.lit(name).alias("level_name"), "parent_id", *[F.col(b).cast("long").alias(b) for b in BOX], label.alias("label"), content.alias("content"))

    r = regions.withColumn("parent_id", F.lit(None).cast("string"))
    b = overlap_parent(order_blocks(blocks), order_regions(regions))
    n = overlap_parent(lines, order_blocks(blocks))
    none = F.lit("")
    parts = [
        level(r, 0, "region", F.col("label"), none),
        level(b, 1, "block", F.col("label"), F.col("content")),
        level(n, 2, "line", F.lit("line"), F.col("content")),
        level(word_parents(words, lines), 3, "word", F.lit("word"), F.col("content")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tree_order(regions: DataFrame, blocks: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """``tree_pos`` of each node on its page: regions by area, blocks by reading order, lines by height, words by line and place."""
    word = words.withColumn("pos", F.row_number().over(Window.partitionBy(*KEY).orderBy("line_index", "k")) - 1)
    parts = [d.select(*KEY, "node_id", F.lit(k).alias("level_index"), "pos") for k, d in enumerate((order_regions(regions), order_blocks(blocks), order_lines(lines), word))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("level_index", "pos")) - 1
    return every.select(*KEY, "node_id", place.alias("tree_pos"))


def at_level(tree: DataFrame, *names: str) -> DataFrame:
    """Nodes of the named levels."""
    return tree.where(F.col("level_name").isin(*names))


def children_of(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Child rows of each node of ``nodes`` (doc_id, page_id, node_id)."""
    return tree.join(nodes.select(*KEY, F.col("node_id").alias("parent_id")), [*KEY, "parent_id"], "left_semi")


def node(tree: DataFrame, node_id: str) -> DataFrame:
    """The first row of a node id on a page's tree; KeyError where there is none."""
    found = tree.where(F.col("node_id") == node_id).limit(1)
    if found.isEmpty():
        raise KeyError(node_id)
    return found


def largest_region(regions: DataFrame) -> DataFrame:
    """The region of largest area on each page, of equal ones the first."""
    best = F.max(F.struct(area().alias("area"), (-F.col("region_index")).alias("neg"), "node_id")).alias("m")
    return regions.groupBy(*KEY).agg(best).select(*KEY, F.col("m.node_id").alias("node_id"), F.col("m.area").alias("area"))


def page_percent(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes in percent of their page: left, top, width, height; ``sizes`` has width and height of each page, one without extent gives nulls."""
    part = lambda v, whole: F.when(F.col(whole) > 0, 100.0 * v / F.col(whole))
    b = boxes.join(sizes.select(*KEY, F.col("width").alias("_w"), F.col("height").alias("_h")), KEY)
    x, y = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return b.withColumns({"left": part(F.col("x0"), "_w"), "top": part(F.col("y0"), "_h"), "width": part(x, "_w"), "height": part(y, "_h")}).drop("_w", "_h")
