"""Score tables, precision and recall, and the report aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .layout import KEY


def block_scores(tree: DataFrame, block_alignments: DataFrame) -> DataFrame:
    """Score of each block, 0 where unaligned; an empty or null label is ``unknown``."""
    b = tree.where("level_name = 'block'").select(*KEY, F.col("node_id").alias("block_id"), "label")
    s = block_alignments.select(*KEY, F.col("node_id").alias("block_id"), "score")
    label = F.when((F.col("label") == "") | F.col("label").isNull(), "unknown").otherwise(F.col("label"))
    return b.join(s, [*KEY, "block_id"], "left").select(*KEY, "block_id", label.alias("block_label"), F.coalesce("score", F.lit(0.0)).alias("score"))


def line_scores(tree: DataFrame, line_alignments: DataFrame) -> DataFrame:
    """Score of each line, 0 where unaligned, with its block's label: ``unknown`` without a block, an empty label stays empty."""
    n = tree.where("level_name = 'line'").select(*KEY, F.col("node_id").alias("line_id"), "parent_id")
    b = tree.where("level_name = 'block'").select(*KEY, F.col("node_id").alias("parent_id"), F.col("label").alias("block_label"))
    s = line_alignments.select(*KEY, F.col("node_id").alias("line_id"), *[c for c in ("noise",) if c in line_alignments.columns], "score")
    out = n.join(s, [*KEY, "line_id"], "left").join(b, [*KEY, "parent_id"], "left")
    return out.select(*KEY, "line_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("block_label", F.lit("unknown")).alias("block_label"))


def f1(p: str = "precision", r: str = "recall") -> Column:
    """Harmonic mean of a row's precision and recall, 0 where both are 0."""
    total = F.col(p) + F.col(r)
    return F.when(total > 0, 2 * F.col(p) * F.col(r) / F.when(total > 0, total).otherwise(1.0)).otherwise(0.0)


def precision_recall(gold_lines: DataFrame, gold_blocks: DataFrame, noise_lines: DataFrame, noise_blocks: DataFrame, nodes: DataFrame, noise_nodes: DataFrame | None = None, inclusive_end: bool = False) -> DataFrame:
    """Precision and recall of each gold line under each noise tag.

    Lines carry node_id, parent_id, ast_index_start, char_start, ast_index_end, char_end; blocks
    node_id, ast_start, ast_end; noise tables a ``noise`` tag too.  ``nodes`` (ast_index, start) turn
    offsets into places in the text.  A block that is missing or has another range on either side is
    a block error and comes first; a line without noise counterpart scores 0; lines without gold have
    no row.  Ends count as exclusive, as published, unless ``inclusive_end``.
    """
    noise_nodes = nodes if noise_nodes is None else noise_nodes
    extra = 1 if inclusive_end else 0

    def placed(lines: DataFrame, table: DataFrame, prefix: str) -> DataFrame:
        a = table.select(*KEY, F.col("ast_index").alias("ast_index_start"), F.col("start").alias("_s"))
        b = table.select(*KEY, F.col("ast_index").alias("ast_index_end"), F.col("start").alias("_e"))
        out = lines.join(a, [*KEY, "ast_index_start"], "left").join(b, [*KEY, "ast_index_end"], "left")
        return out.withColumn(f"{prefix}0", F.col("_s") + F.col("char_start")).withColumn(f"{prefix}1", F.col("_e") + F.col("char_end") + extra)

    g = placed(gold_lines, nodes, "g").select(*KEY, "node_id", "parent_id", "g0", "g1")
    n = placed(noise_lines, noise_nodes, "n").select(*KEY, "noise", "node_id", "n0", "n1")
    gb = gold_blocks.select(*KEY, F.col("node_id").alias("parent_id"), F.struct("ast_start", "ast_end").alias("gr"))
    nb = noise_blocks.select(*KEY, "noise", F.col("node_id").alias("parent_id"), F.struct("ast_start", "ast_end").alias("nr"))
    tags = noise_blocks.select("noise").union(noise_lines.select("noise")).distinct()
    # a handful of tags
    rows = g.join(gb, [*KEY, "parent_id"], "left").join(F.broadcast(tags), F.lit(True))
    rows = rows.join(nb, [*KEY, "noise", "parent_id"], "left").join(n, [*KEY, "noise", "node_id"], "left")
    error = F.col("gr").isNull() | F.col("nr").isNull() | (F.col("gr") != F.col("nr"))
    missing = error | F.col("n0").isNull()
    over = F.greatest(F.lit(0), F.least("g1", "n1") - F.greatest("g0", "n0"))
    share = lambda size: F.when(missing | (size <= 0), 0.0).otherwise(over / F.when(size > 0, size).otherwise(1))
    return rows.select(
        *KEY, F.col("noise").alias("noise_level"), F.col("node_id").alias("line_id"), share(F.col("n1") - F.col("n0")).alias("precision"), share(F.col("g1") - F.col("g0")).alias("recall"), error.alias("is_block_error")
    )


def mean_std_count(df: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Mean, sample deviation and count of each group."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("count"))


def mean_of_rounded(df: DataFrame, by: str, value: str = "score", digits: int = 3) -> DataFrame:
    """Mean and population deviation of group means that are rounded first."""
    means = df.groupBy(by).agg(F.bround(F.avg(value), digits).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))


def grouping_level(df: DataFrame, levels: tuple[str, ...] = ("document", "page")) -> str | None:
    """The first level of more than one distinct value, None for rows."""
    seen = df.agg(*[F.count_distinct(c).alias(c) for c in levels]).first()
    return next((c for c in levels if seen[c] > 1), None)


def aggregate_mean_std(df: DataFrame, value: str = "score", levels: tuple[str, ...] = ("document", "page")) -> DataFrame:
    """Mean and population deviation of the means of the first level with more than one value, or of rows."""
    level = grouping_level(df, levels)
    unit = df.select(F.col(value).alias("m")) if level is None else df.groupBy(level).agg(F.avg(value).alias("m"))
    return unit.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std")).withColumn("level", F.lit(level or "row"))


def top_labels(df: DataFrame, label: str = "block_label", value: str = "score", n: int = 10) -> DataFrame:
    """Mean and count of the n labels with most rows; equal counts by label."""
    return df.groupBy(label).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), label).limit(n)


def top_and_other(df: DataFrame, label: str = "block_label", n: int = 8) -> DataFrame:
    """Rows with ``group``: the n largest labels keep theirs, the rest are ``other (k labels)``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    # one row per label: the labels of a layout model
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rows"), label)))
    rest = ranked.agg(F.count_if(F.col("rank") > n).alias("k"))
    named = ranked.join(F.broadcast(rest), F.lit(True)).select(label, F.when(F.col("rank") <= n, F.col(label)).otherwise(F.concat(F.lit("other ("), F.col("k").cast("string"), F.lit(" labels)"))).alias("group"))
    return df.join(F.broadcast(named), label)


def noise_pivot(df: DataFrame, value: str, tags: list[str], row: str = "document", tag: str = "noise") -> DataFrame:
    """Mean by row and tag, one column per tag in numeric order."""
    tags = sorted(tags, key=float)
    out = df.groupBy(row).pivot(tag, tags).agg(F.avg(value))
    return out.select(row, *[F.col(f"`{t}`").alias("n_" + t.replace(".", "_")) for t in tags])


def pr_summary(pr: DataFrame) -> DataFrame:
    """Means of precision, recall, F1 by row and block error, and rows, of each noise level."""
    p = pr.withColumn("f1", f1())
    return p.groupBy("noise_level").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.avg(F.col("is_block_error").cast("double")).alias("block_error"), F.count(F.lit(1)).alias("n")
    )


def cross_group_deviation(pr: DataFrame, group: str) -> DataFrame:
    """Population deviation over groups of the group means of each noise level; null becomes 0."""
    p = pr.withColumn("f1", f1()).withColumn("block_error", F.col("is_block_error").cast("double"))
    values = ["precision", "recall", "f1", "block_error"]
    means = p.groupBy("noise_level", group).agg(*[F.avg(v).alias(v) for v in values])
    return means.groupBy("noise_level").agg(*[F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"{v}_std") for v in values])


def banded(df: DataFrame, mean: str, std: str) -> DataFrame:
    """``low`` and ``high``: mean less and plus deviation within [0, 1]."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return df.withColumns({"low": clip(F.col(mean) - F.col(std)), "high": clip(F.col(mean) + F.col(std))})


def covered_tags(df: DataFrame, least: int | None = None, tag: str = "noise", document: str = "document") -> DataFrame:
    """Tags found in at least ``least`` documents, by default in all."""
    per = df.groupBy(tag).agg(F.count_distinct(document).alias("documents"))
    if least is not None:
        return per.where(F.col("documents") >= least)
    total = df.agg(F.count_distinct(document).alias("total"))
    return per.join(F.broadcast(total), F.lit(True)).where("documents = total").drop("total")


def even_positions(n: int, k: int = 6) -> list[int]:
    """k of n positions, evenly spread, halves to even; all of them for k of 0 or beyond n."""
    if k <= 0 or k >= n:
        return list(range(n))
    if k == 1:
        return [0]
    return sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})


def curve_stats(df: DataFrame, curve: str, value: str = "score") -> DataFrame:
    """Rows, mean and population deviation of each curve, and its place: numbers in order, then other names."""
    stats = df.groupBy(F.col(curve).alias("curve")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    number = F.col("curve").try_cast("double")
    # one row per curve
    return stats.withColumn("pos", F.row_number().over(Window.orderBy(number.isNull(), number, "curve")) - 1)


def histogram(df: DataFrame, label: str, value: str = "score", bins: int = 20) -> DataFrame:
    """Rows and percent of all rows of each label and bin of [0, 1]; the last bin is closed, values outside count in the total only."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(value).between(0, 1)).groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(total), F.lit(True)).select(label, "bin", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def kde(df: DataFrame, value: str = "score", points: int = 200, bins: int = 20) -> DataFrame:
    """Gaussian density on a grid of [0, 1], Scott's bandwidth, times bin width and 100; no rows where fewer than two values or all equal.

    Equal values are counted first; the grid meets the distinct values, not the rows.
    """
    stats = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("range")).where("n > 1 and range > 0")
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    weights = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    grid = weights.join(F.broadcast(stats.withColumn("h", h)), F.lit(True)).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.col("i") / (points - 1))
    z = (F.col("x") - F.col("v")) / F.col("h")
    return grid.groupBy("i", "x").agg((F.sum(F.col("w") * F.exp(-z * z / 2) / (F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5)) * 100.0 / bins).alias("density"))


def page_average(blocks: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Mean of a page's block and line scores together, 0 without any."""
    both = blocks.select(*KEY, "score").unionByName(lines.select(*KEY, "score")).groupBy(*KEY).agg(F.avg("score").alias("mean"))
    return pages.select(*KEY).join(both, KEY, "left").select(*KEY, F.coalesce("mean", F.lit(0.0)).alias("mean"))


def total_lines(tree: DataFrame, block_alignments: DataFrame) -> DataFrame:
    """Lines below matched blocks, by page."""
    n = tree.where("level_name = 'line'").join(block_alignments.select(*KEY, F.col("node_id").alias("parent_id")), [*KEY, "parent_id"], "left_semi")
    return n.groupBy(*KEY).agg(F.count(F.lit(1)).alias("lines"))
