"""Connected components by alternating large-star and small-star steps.

Every step is a join and an aggregation over edges; labels never reach the driver, which only sees
the number of edges and a checksum to know when nothing changes.  Nodes of many edges, of which the
number of edges allows at most ``HUBS``, are joined by broadcast, so the edges of a large group never
meet in one task; minima are combined before they move.  Each round is a written table in
the shared folder, so lineage stays short and a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


#: Most nodes that are joined by broadcast (16 bytes each), and fewest edges of such a node.
HUBS, BUSY = 20_000, 1_000


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """Links the neighbours of each node to the smallest among them and the node; ``count`` is at least the number of edges."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stats = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    least = stats.select("a", "m")
    # both has at most 2 * count rows, so at most HUBS nodes have this many
    hubs = F.broadcast(stats.where(F.col("n") >= max(BUSY, 2 * count // HUBS + 1)).select("a", "m"))
    near = both.join(hubs, "a").unionByName(both.join(hubs.select("a"), "a", "left_anti").join(least, "a"))
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Columns ``node`` and ``root``: the smallest node that each node of an edge reaches.

    ``edges`` has columns ``a`` and ``b``; loops and repeated edges are allowed, nulls are dropped.
    A node only met in loops has no row.  No edges give no rows.
    """
    now = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), f"{label}0")
    seen, k, count = None, 0, now.count()
    while count:
        k += 1
        # a step never adds edges
        half = scratch.keep(_star(now, True, count), f"{label}{k}-large")
        now = scratch.keep(_star(half, False, count), f"{label}{k}")
        scratch.drop(f"{label}{k}-large")
        scratch.drop(f"{label}{k - 1}")
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            break
        seen, count = mark, mark[0]
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
