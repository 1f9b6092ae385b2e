"""All queries of the engine by name, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .functions import treebank
from .operators import align, corrupt, intervals, layout, scores, sequences
from .operators.layout import KEY
from .plans.model import MARKED, SQL, TAGS, Pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, model: bool = True):
    """Registers a query over the derived pages with its SQL, which may use the model's tables."""

    def add(f: Callable[[Pages], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Pages(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = (SQL if model else "") + sql
        return f

    return add


def r6(*names: str):
    return {n: F.round(F.col(n), 6) for n in names}


# Sources and derived tables


@query("SELECT doc_id, line_index, content, char_start, x0, y0, x1, y1 FROM lines")
def derived_lines(p):
    return p.lines.select("doc_id", "line_index", "content", "char_start", "x0", "y0", "x1", "y1")


@query("SELECT doc_id, line_index, k, content FROM words")
def derived_words(p):
    return p.words.select("doc_id", "line_index", "k", "content")


@query("SELECT doc_id, line_index, char_start, char_start + length(content) AS char_end FROM lines")
def line_offsets(p):
    return p.lines.select("doc_id", "line_index", "char_start", (F.col("char_start") + F.length("content")).alias("char_end"))


# Layout


@query("SELECT l.doc_id, l.node_id, p.parent_id, round(p.ratio, 6) AS ratio FROM lines l LEFT JOIN line_parent p ON l.doc_id = p.doc_id AND l.node_id = p.node_id")
def overlap_parent_blocks(p):
    return layout.overlap_parent(p.lines, layout.order_blocks(p.blocks)).select("doc_id", "node_id", "parent_id", F.round("ratio", 6).alias("ratio"))


@query("SELECT b.doc_id, b.node_id, p.parent_id, round(p.ratio, 6) AS ratio FROM blocks b LEFT JOIN block_parent p ON b.doc_id = p.doc_id AND b.node_id = p.node_id")
def overlap_parent_regions(p):
    return layout.overlap_parent(p.blocks, layout.order_regions(p.regions)).select("doc_id", "node_id", "parent_id", F.round("ratio", 6).alias("ratio"))


@query("SELECT doc_id, node_id, 'line_' || line_index AS parent_id FROM words")
def word_parent_lines(p):
    return layout.word_parents(p.words, p.lines).select("doc_id", "node_id", "parent_id")


@query("SELECT doc_id, node_id, rpos AS pos FROM regioned")
def regions_by_area(p):
    return layout.order_regions(p.regions).select("doc_id", "node_id", "pos")


@query("SELECT doc_id, node_id, bpos AS pos FROM ordered")
def blocks_by_order(p):
    return layout.order_blocks(p.blocks).select("doc_id", "node_id", "pos")


@query("SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY y0, line_index) - 1 AS pos FROM lines")
def lines_by_y0(p):
    return layout.order_lines(p.lines).select("doc_id", "node_id", "pos")


@query("SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY l, a, b) - 1 AS tree_pos FROM (SELECT doc_id, node_id, 0 AS l, rpos AS a, 0 AS b FROM regioned UNION ALL SELECT doc_id, node_id, 1, bpos, 0 FROM ordered UNION ALL SELECT doc_id, node_id, 2, y0, line_index FROM lines UNION ALL SELECT doc_id, node_id, 3, line_index, k FROM words)")
def tree_order(p):
    return layout.tree_order(p.regions, p.blocks, p.lines, p.words).select("doc_id", "node_id", "tree_pos")


@query("SELECT doc_id, node_id, level_index, level_name, parent_id, x0, y0, x1, y1, label, content FROM tree")
def layout_tree(p):
    return p.tree.drop("page_id")


@query("SELECT level_name, count(*) AS n, count(parent_id) AS with_parent FROM tree GROUP BY level_name")
def level_counts(p):
    return p.tree.groupBy("level_name").agg(F.count(F.lit(1)).alias("n"), F.count("parent_id").alias("with_parent"))


@query("SELECT doc_id, node_id, (x1 - x0) * (y1 - y0) AS area FROM regions QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (x1 - x0) * (y1 - y0) DESC, region_index) = 1")
def largest_region(p):
    return layout.largest_region(p.regions).select("doc_id", "node_id", "area")


@query("SELECT doc_id, node_id, parent_id FROM tree WHERE parent_id LIKE 'block%'")
def children_of_block(p):
    return layout.children_of(p.tree, p.blocks).select("doc_id", "node_id", "parent_id")


@query("SELECT doc_id, node_id, CASE WHEN parent_id IS NULL THEN node_id ELSE parent_id || '/' || node_id END AS path FROM tree WHERE level_name IN ('block', 'line')")
def node_labels(p):
    return intervals.node_labels(layout.at_level(p.tree, "block", "line")).select("doc_id", "node_id", "path")


@query("SELECT doc_id, node_id, round(100.0 * x0 / 1600, 6) AS left_pct, round(100.0 * x1 / 1600, 6) AS right_pct FROM tree WHERE level_name = 'line'")
def box_scaling(p):
    return layout.at_level(p.tree, "line").select("doc_id", "node_id", F.round(100.0 * F.col("x0") / 1600, 6).alias("left_pct"), F.round(100.0 * F.col("x1") / 1600, 6).alias("right_pct"))


@query(", sz AS (SELECT doc_id, max(x1) AS w, max(y1) AS h FROM regions GROUP BY doc_id) SELECT t.doc_id, node_id, round(100.0 * x0 / w, 6) AS \"left\", round(100.0 * y0 / h, 6) AS top, round(100.0 * (x1 - x0) / w, 6) AS width, round(100.0 * (y1 - y0) / h, 6) AS height FROM tree t JOIN sz ON t.doc_id = sz.doc_id WHERE level_name = 'block'")
def box_percent(p):
    sizes = p.regions.groupBy(*KEY).agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    return layout.page_percent(layout.at_level(p.tree, "block"), sizes).select("doc_id", "node_id", *[F.round(c, 6).alias(c) for c in ("left", "top", "width", "height")])


# Scores

_BS = "SELECT b.doc_id, b.node_id AS block_id, CASE WHEN b.label = '' THEN 'unknown' ELSE b.label END AS block_label, coalesce(a.score, 0.0) AS score FROM blocks b LEFT JOIN block_alignments a ON b.doc_id = a.doc_id AND b.node_id = a.node_id"
_LS = "SELECT l.doc_id, l.node_id AS line_id, p.parent_id, coalesce(g.score, 0.0) AS score, coalesce(b.label, 'unknown') AS block_label FROM lines l LEFT JOIN line_parent p ON l.doc_id = p.doc_id AND l.node_id = p.node_id LEFT JOIN blocks b ON l.doc_id = b.doc_id AND b.node_id = p.parent_id LEFT JOIN gold_lines g ON l.doc_id = g.doc_id AND l.node_id = g.node_id"


def _line_scores(p):
    return scores.line_scores(p.tree, p.gold_lines)


@query(f"SELECT doc_id, block_id, block_label, round(score, 6) AS score FROM ({_BS})")
def block_scores(p):
    return scores.block_scores(p.tree, p.block_alignments).select("doc_id", "block_id", "block_label", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, line_id, parent_id, round(score, 6) AS score, block_label FROM ({_LS})")
def line_scores(p):
    return _line_scores(p).select("doc_id", "line_id", "parent_id", F.round("score", 6).alias("score"), "block_label")


@query(f"SELECT block_label, round(avg(score), 6) AS mean, count(*) AS count FROM ({_LS}) GROUP BY block_label ORDER BY count(*) DESC, block_label LIMIT 10")
def line_score_by_label(p):
    return scores.top_labels(_line_scores(p)).withColumns(r6("mean"))


@query("SELECT document, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(*) AS count FROM scored WHERE noise = '0' GROUP BY document")
def doc_mean_std_count(p):
    return scores.mean_std_count(p.scored_lines.where("noise = '0'"), ["document"]).withColumns(r6("mean", "std"))


@query("SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM (SELECT round_even(avg(score), 3) AS m FROM scored WHERE noise = '0' GROUP BY document)")
def cross_doc_mean_std(p):
    return scores.mean_of_rounded(p.scored_lines.where("noise = '0'"), "document").withColumns(r6("mean", "std"))


@query("SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, 'document' AS level FROM (SELECT avg(score) AS m FROM scored GROUP BY document)")
def aggregate_mean_std(p):
    return scores.aggregate_mean_std(p.scored_lines.withColumn("page", F.col("doc_id"))).withColumns(r6("mean", "std"))


@query(f"SELECT p.doc_id, round(coalesce(avg(s.score), 0.0), 9) AS mean FROM pages p LEFT JOIN (SELECT doc_id, score FROM ({_BS}) UNION ALL SELECT doc_id, score FROM ({_LS})) s ON p.doc_id = s.doc_id GROUP BY p.doc_id")
def page_avg_score(p):
    return scores.page_average(scores.block_scores(p.tree, p.block_alignments), _line_scores(p), p.pages).select("doc_id", F.round("mean", 9).alias("mean"))


@query("SELECT l.doc_id, count(*) AS lines FROM line_parent l JOIN block_alignments a ON l.doc_id = a.doc_id AND l.parent_id = a.node_id GROUP BY l.doc_id")
def total_lines(p):
    return scores.total_lines(p.tree, p.block_alignments).select("doc_id", "lines")


@query("SELECT CASE WHEN rn <= 3 THEN block_label ELSE 'other (' || (SELECT count(DISTINCT block_label) - 3 FROM scored) || ' labels)' END AS grp, sum(n)::BIGINT AS n FROM (SELECT block_label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block_label) AS rn FROM scored GROUP BY block_label) GROUP BY 1")
def top_labels_other(p):
    return scores.top_and_other(p.scored_lines, n=3).groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT block_label, CAST(least(floor(score * 20), 19) AS INTEGER) AS bin, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM scored), 6) AS percent FROM scored WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2")
def score_histogram(p):
    return scores.histogram(p.scored_lines, "block_label").withColumns(r6("percent"))


@query("SELECT i, round(sum(exp(-pow((i / 49.0 - score) / h, 2) / 2) / (n * h * sqrt(2 * pi()))) * 5, 6) AS density FROM (SELECT unnest(range(50)) AS i), (SELECT score FROM scored), (SELECT count(*) AS n, stddev_samp(score) * pow(count(*), -0.2) AS h FROM scored) GROUP BY i")
def score_kde(p):
    return scores.kde(p.scored_lines, points=50).select("i", F.round("density", 6).alias("density"))


@query("SELECT noise, round(mean, 6) AS mean, round(greatest(0, mean - std), 6) AS low, round(least(1, mean + std), 6) AS high FROM (SELECT noise, avg(score) AS mean, stddev_samp(score) AS std FROM scored GROUP BY noise)")
def noise_band(p):
    return scores.banded(scores.mean_std_count(p.scored_lines, ["noise"]), "mean", "std").select("noise", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("SELECT noise, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(*) AS count FROM scored GROUP BY noise")
def noise_mean_std(p):
    return scores.mean_std_count(p.scored_lines, ["noise"]).withColumns(r6("mean", "std")).orderBy(F.col("noise").cast("double"))


@query("SELECT document, " + ", ".join(f"round(avg(score) FILTER (noise = '{t}'), 6) AS n_{t.replace('.', '_')}" for t in TAGS) + " FROM scored GROUP BY document")
def noise_pivot(p):
    out = scores.noise_pivot(p.scored_lines, "score", TAGS)
    return out.withColumns(r6(*out.columns[1:]))


@query("SELECT noise, count(DISTINCT document) AS documents FROM scored GROUP BY noise HAVING count(DISTINCT document) = (SELECT count(DISTINCT document) FROM scored)")
def noise_coverage(p):
    return scores.covered_tags(p.scored_lines)


@query("SELECT curve, n, round(mean, 6) AS mean, round(std, 6) AS std, (row_number() OVER (ORDER BY TRY_CAST(curve AS DOUBLE) NULLS LAST, curve) - 1)::INTEGER AS pos FROM (SELECT curve, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std FROM (SELECT score, unnest([noise, block_label]) AS curve FROM scored) GROUP BY curve)")
def curve_stats(p):
    both = p.scored_lines.select("score", F.explode(F.array("noise", "block_label")).alias("name"))
    return scores.curve_stats(both, "name").withColumns(r6("mean", "std"))


@query("SELECT noise, block_label, count(*) AS n FROM scored WHERE block_label IN ('text', 'table') GROUP BY noise, block_label")
def label_filter(p):
    return p.scored_lines.where(F.col("block_label").isin(*sorted(T.label_set("text, table ,,")))).groupBy("noise", "block_label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n AS page FROM (SELECT unnest([0, 2, 5, 6, 7, 8, 999999999]) AS n) ANTI JOIN pages ON n = doc_id")
def missing_pages(p):
    wanted = p.spark.createDataFrame([(n,) for n in T.page_numbers("0,2,5-8,999999999")], "page int")
    return wanted.join(p.pages.select(F.col("doc_id").alias("page")), "page", "left_anti")


@query("SELECT document, doc_id::VARCHAR AS name, (row_number() OVER (PARTITION BY document ORDER BY doc_id) - 1)::INTEGER AS pos FROM pages")
def page_order(p):
    name = p.pages.select("document", F.col("doc_id").cast("string").alias("name"))
    return name.withColumn("pos", F.row_number().over(Window.partitionBy("document").orderBy(F.col("name").cast("long"))) - 1)


@query("SELECT document, count(DISTINCT noise) AS tags, count(DISTINCT doc_id) AS pages FROM scored GROUP BY document")
def distinct_counts(p):
    return p.scored_lines.groupBy("document").agg(F.count_distinct("noise").alias("tags"), F.count_distinct("doc_id").alias("pages"))


@query("WITH t AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE text IS NOT NULL)), k AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 5.0, 0) AS BIGINT) AS rn FROM t, (SELECT unnest(range(6)) AS i)) SELECT source AS tag FROM t WHERE n <= 6 OR rn IN (SELECT rn FROM k)", model=False)
def tag_subsample(p):
    tags = p.pages.select(F.col("document").alias("tag")).distinct()
    at = p.spark.createDataFrame([(i,) for i in scores.even_positions(tags.count())], "at int")
    # tags are a handful; one task ranks them
    return tags.withColumn("at", F.row_number().over(Window.orderBy("tag")) - 1).join(F.broadcast(at), "at", "left_semi").select("tag")


@query("SELECT document, '_' || array_to_string(list_sort(list(DISTINCT block_label)), '+') AS suffix FROM scored GROUP BY document")
def label_suffix(p):
    return p.scored_lines.groupBy("document").agg(T.label_suffix(F.collect_set("block_label")).alias("suffix"))


@query("SELECT d.document, t.tag, t.tag IN (SELECT noise FROM scored s WHERE s.document = d.document) AS found FROM (SELECT DISTINCT document FROM scored) d, (SELECT unnest(['0', '0.05', '0.2', '0.3']) AS tag) t")
def resolved_tags(p):
    """The tags that a list of levels asks for, and which of them each document has alignments of."""
    found = p.scored_lines.groupBy("document").agg(F.collect_set("noise").alias("held"))
    asked = F.explode(F.array(*[F.lit(t) for t in T.resolved_tags("20, 0.05,5,30", set())])).alias("tag")
    return found.select("document", "held", asked).select("document", "tag", F.array_contains("held", F.col("tag")).alias("found"))


@query("SELECT document, (row_number() OVER (PARTITION BY document ORDER BY noise::DOUBLE) - 1)::INTEGER AS pos, noise AS tag FROM (SELECT DISTINCT document, noise FROM scored)")
def document_tags(p):
    """The tags that each document has alignments of, in numeric order."""
    tags = F.sort_array(F.collect_set(F.struct(F.col("noise").cast("double").alias("at"), "noise")))
    return p.scored_lines.groupBy("document").agg(tags.alias("t")).select("document", F.posexplode("t.noise").alias("pos", "tag"))


@query("SELECT document, inline, CASE WHEN len(t) <= inline THEN 'noise levels: ' || array_to_string(t, ', ') ELSE len(t) || ' noise levels (' || t[1] || '–' || t[-1] || ')' END AS subtitle FROM (SELECT document, list(noise ORDER BY noise::DOUBLE) AS t FROM (SELECT DISTINCT document, noise FROM scored) GROUP BY document), (SELECT unnest([3, 8]) AS inline)")
def noise_subtitles(p):
    tags = F.sort_array(F.collect_set(F.struct(F.col("noise").cast("double").alias("at"), "noise")))
    held = p.scored_lines.groupBy("document").agg(tags.alias("t")).select("document", F.col("t.noise").alias("t"), F.explode(F.array(F.lit(3), F.lit(8))).alias("inline"))
    return held.select("document", "inline", F.when(F.col("inline") == 3, T.noise_subtitle(F.col("t"), 3)).otherwise(T.noise_subtitle(F.col("t"))).alias("subtitle"))


# Precision and recall


def _pr(p):
    return scores.precision_recall(p.gold_lines, p.block_alignments, p.noise_lines, p.noise_blocks, p.nodes)


def _prd(p):
    return _pr(p).join(p.pages.select(*KEY, "document"), KEY)


@query("SELECT doc_id, noise_level, line_id, round(precision, 6) AS precision, round(recall, 6) AS recall, is_block_error FROM pr")
def precision_recall(p):
    return _pr(p).drop("page_id").withColumns(r6("precision", "recall"))


@query("SELECT noise_level, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(block_error), 6) AS block_error, count(*) AS n FROM prf GROUP BY noise_level")
def pr_summary(p):
    return scores.pr_summary(_pr(p)).withColumns(r6("precision", "recall", "f1", "block_error"))


@query("SELECT noise_level, round(avg(f1), 6) AS f1 FROM prf GROUP BY noise_level")
def f1_by_noise(p):
    return scores.pr_summary(_pr(p)).select("noise_level", F.round("f1", 6).alias("f1"))


def _pivot_sql(value: str) -> str:
    return "SELECT document, " + ", ".join(f"round(avg({value}) FILTER (noise_level = '{t}'), 6) AS n_{t.replace('.', '_')}" for t in TAGS) + " FROM prf GROUP BY document"


@query(_pivot_sql("precision"))
def pr_pivot(p):
    out = scores.noise_pivot(_prd(p), "precision", TAGS, tag="noise_level")
    return out.withColumns(r6(*out.columns[1:]))


@query(_pivot_sql("block_error"))
def block_error_pivot(p):
    out = scores.noise_pivot(_prd(p).withColumn("e", F.col("is_block_error").cast("double")), "e", TAGS, tag="noise_level")
    return out.withColumns(r6(*out.columns[1:]))


_DEV = ", ".join(f"round(coalesce(stddev_pop({v}), 0), 6) AS {v}_std" for v in ("precision", "recall", "f1", "block_error"))


@query(f"SELECT noise_level, {_DEV} FROM (SELECT noise_level, document, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(block_error) AS block_error FROM prf GROUP BY noise_level, document) GROUP BY noise_level")
def cross_group_std(p):
    out = scores.cross_group_deviation(_prd(p), "document")
    return out.withColumns(r6(*out.columns[1:]))


@query("SELECT s.noise_level, round(s.precision, 6) AS precision, round(d.precision_std, 6) AS precision_std FROM (SELECT noise_level, avg(precision) AS precision FROM prf GROUP BY noise_level) s LEFT JOIN (SELECT noise_level, stddev_pop(m) AS precision_std FROM (SELECT noise_level, document, avg(precision) AS m FROM prf GROUP BY 1, 2) GROUP BY 1) d USING (noise_level)")
def summary_with_deviation(p):
    pr = _prd(p)
    return scores.pr_summary(pr).join(scores.cross_group_deviation(pr, "document"), "noise_level", "left").select("noise_level", F.round("precision", 6).alias("precision"), F.round("precision_std", 6).alias("precision_std"))


# Candidates and similarity


@query("SELECT a.doc_id, a.ast_index AS ast_start, b.ast_index AS ast_end, a.s AS start, b.e AS \"end\", length(substr(p.markdown, a.s + 1, b.e - a.s)) AS n FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND b.ast_index >= a.ast_index JOIN pages p ON a.doc_id = p.doc_id")
def ast_ranges(p):
    return align.ast_ranges(p.nodes, p.text).select("doc_id", "ast_start", "ast_end", "start", "end", F.length("content").alias("n"))


@query("SELECT l.doc_id, p.parent_id, min(length(content)) // 2 AS least, max(length(content)) * 2 AS most FROM lines l JOIN line_parent p ON l.doc_id = p.doc_id AND l.node_id = p.node_id GROUP BY l.doc_id, p.parent_id")
def candidate_length_window(p):
    return align.length_window(layout.at_level(p.tree, "line")).select("doc_id", "parent_id", "least", "most")


def _items(p):
    """The benchmark table as pages: a node per sentence, a block per two, a line per sentence, words in place."""
    text = p.spark.read.parquet(f"{p.sf_dir}/benchmark.parquet").where("text is not null").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_id"), F.col("text").alias("markdown"))
    s = text.select(*KEY, F.posexplode(F.split("markdown", r"\. ")).alias("i", "content"))
    before = F.sum(F.length("content") + 2).over(Window.partitionBy(*KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("start", F.coalesce(before, F.lit(0)).cast("int")).withColumn("end", F.col("start") + F.length("content"))
    w = s.select("*", F.posexplode(F.regexp_extract_all("content", F.lit("[^ ]+"), F.lit(0))).alias("k", "w"), F.split("content", "[^ ]+", -1).alias("gaps"))
    to = F.sum(F.length("w") + F.length(F.get("gaps", F.col("k")))).over(Window.partitionBy(*KEY, "i").orderBy("k"))
    words = w.select(*KEY, F.col("i").alias("ast_index"), (F.col("i") * 100000 + F.col("k")).alias("word_index"), (F.col("start") + to - F.length("w")).cast("int").alias("start"), (F.col("start") + to).cast("int").alias("end"))
    return text, s, words


_IT = r"""WITH s0 AS (SELECT item_id AS doc_id, string_split(text, '. ') AS l FROM benchmark WHERE text IS NOT NULL),
s1 AS (SELECT doc_id, i, l[i + 1] AS content FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM s0)),
s AS (SELECT *, coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM s1),
w0 AS (SELECT doc_id, i, st, unnest(range(len(w))) AS k, w, g FROM (SELECT *, regexp_extract_all(content, '[^ ]+') AS w, string_split_regex(content, '[^ ]+') AS g FROM s)),
w1 AS (SELECT doc_id, i, i * 100000 + k AS wi, st, length(w[k + 1]) AS n, sum(length(w[k + 1]) + length(g[k + 1])) OVER (PARTITION BY doc_id, i ORDER BY k) AS e FROM w0),
nw AS (SELECT doc_id, i AS node, wi, st + e - n AS s, st + e AS e FROM w1) """


@query(_IT + "SELECT a.doc_id, a.node AS ast_start, b.node AS ast_end, a.wi AS i, b.wi AS j, CAST(a.s AS INTEGER) AS s, CAST(b.e AS INTEGER) AS e FROM nw a JOIN nw b ON a.doc_id = b.doc_id AND b.wi >= a.wi AND b.e - a.s BETWEEN 20 AND 40", model=False)
def word_ranges(p):
    _, s, words = _items(p)
    ranges = s.groupBy(*KEY).agg(F.lit("page").alias("parent_id"), F.lit(0).alias("ast_start"), F.max("i").alias("ast_end"), F.lit(20).alias("least"), F.lit(40).alias("most"))
    return align.word_ranges(words, ranges).select("doc_id", F.col("ast_index_start").alias("ast_start"), F.col("ast_index_end").alias("ast_end"), "i", "j", "s", "e")


def _vectors(p):
    return p.spark.read.parquet(f"{p.sf_dir}/embeddings.parquet")


_VP = "SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id"


@query(f"SELECT a, b, round(score, 6) AS score FROM ({_VP})", model=False)
def embedding_cosine(p):
    return align.cosine_pairs(_vectors(p), "label", 6)


@query(f"SELECT a, b, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM (SELECT a, b, round(score, 9) AS score FROM ({_VP}))) WHERE rank <= 3", model=False)
def embedding_topk(p):
    return align.cosine_top(_vectors(p), "label", 3, 9).withColumns(r6("score"))


# embedding_topk ranks the pairs of its SQL only: one label, larger ids
@query("SELECT a, b, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0)) WHERE rank <= 3", model=False)
def embedding_search(p):
    """The three nearest of all other vectors for each vec_id divisible by 100."""
    return align.nearest(_vectors(p), F.col("vec_id") % 100 == 0, 3).withColumns(r6("score"))


@query("WITH g AS (SELECT item_id, substr(text, i, 3) AS t, count(*) AS n FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM benchmark) GROUP BY 1, 2), s AS (SELECT item_id, sqrt(sum(n * n)) AS z FROM g GROUP BY 1) SELECT a.item_id AS a, b.item_id AS b, round(sum(a.n * b.n) / (max(x.z) * max(y.z)), 6) AS score FROM g a JOIN g b ON a.t = b.t AND a.item_id < b.item_id JOIN s x ON x.item_id = a.item_id JOIN s y ON y.item_id = b.item_id GROUP BY 1, 2", model=False)
def trigram_cosine(p):
    b = p.spark.read.parquet(f"{p.sf_dir}/benchmark.parquet").where("length(text) >= 3")
    g = b.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring("text", i, F.lit(3)))).alias("t")).groupBy("item_id", "t").agg(F.count(F.lit(1)).alias("n"))
    z = g.groupBy("item_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("z"))
    x, y = g.select(F.col("item_id").alias("a"), "t", F.col("n").alias("na")), g.select(F.col("item_id").alias("b"), "t", F.col("n").alias("nb"))
    dots = x.join(y, "t").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    dots = dots.join(z.select(F.col("item_id").alias("a"), F.col("z").alias("za")), "a").join(z.select(F.col("item_id").alias("b"), F.col("z").alias("zb")), "b")
    return dots.select("a", "b", F.round(F.col("dot") / (F.col("za") * F.col("zb")), 6).alias("score"))


_MT = """WITH RECURSIVE w AS (SELECT label * 1000000 + (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 10 AS g, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 10 AS rn, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT a.g, a.rn AS r, b.rn - 4 AS c, 1 + list_cosine_similarity(a.v, b.v) AS s FROM w a JOIN w b ON a.g = b.g WHERE a.rn < 4 AND b.rn >= 4),
walk AS (SELECT DISTINCT g, 0::BIGINT AS r, 0::BIGINT AS used, 0.0::DOUBLE AS total FROM m UNION ALL
 SELECT k.g, k.r + 1, k.used | x.bit, k.total + x.s FROM walk k JOIN (SELECT g, r, 1::BIGINT << c AS bit, s FROM m UNION ALL SELECT DISTINCT g, r, 0::BIGINT, 0.0::DOUBLE FROM m) x ON x.g = k.g AND x.r = k.r AND (k.used & x.bit) = 0)
SELECT g, round(max(total), 6) AS total FROM walk GROUP BY g"""


@query(_MT, model=False)
def matching_total_tiny(p):
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    v = _vectors(p).withColumn("n", n).select((F.col("label") * 1000000 + F.expr("n div 10")).cast("long").alias("g"), (F.col("n") % 10).alias("rn"), "embedding")

    def best(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("rn")
        e = np.array(pdf["embedding"].tolist(), float)
        if len(e) < 5:
            return pd.DataFrame({"g": [], "total": []}).astype({"g": "int64", "total": "float64"})
        w = 1 + align._cosines(e[:4], e[4:])
        return pd.DataFrame({"g": [int(pdf["g"].iloc[0])], "total": [sum(w[r, c] for r, c in align.assignment(w))]})

    return v.groupBy("g").applyInPandas(best, "g long, total double").withColumns(r6("total"))


# Intervals

_SEL = ", sel AS (SELECT doc_id, 0 AS a0, 3 AS k0, 1 AS a1, 5 AS k1 FROM pages)"
_HITS = _SEL + ", hits AS (SELECT b.doc_id, b.node_id, 'block' AS level_name FROM block_alignments b JOIN sel s ON b.doc_id = s.doc_id WHERE b.ast_start <= a1 AND b.ast_end >= a0 UNION ALL SELECT g.doc_id, g.node_id, 'line' FROM gold_lines g JOIN sel s ON g.doc_id = s.doc_id WHERE (g.block_index, g.c0) <= (a1, k1) AND (g.block_index, g.c1) >= (a0, k0))"


def _selection(p):
    return p.pages.select(*KEY, F.lit(0).alias("ast_index_start"), F.lit(3).alias("char_start"), F.lit(1).alias("ast_index_end"), F.lit(5).alias("char_end"))


@query(_HITS + " SELECT * FROM hits")
def selection_overlap(p):
    return intervals.selection_overlap(p.block_alignments, p.gold_lines, _selection(p)).drop("page_id")


@query(_HITS + " SELECT h.doc_id, h.node_id FROM hits h JOIN (SELECT doc_id, node_id, level_index * 1000000 + CASE level_name WHEN 'block' THEN CAST(substr(node_id, 7) AS INTEGER) ELSE CAST(substr(node_id, 6) AS INTEGER) END AS tp FROM tree WHERE level_name IN ('block', 'line')) t ON h.doc_id = t.doc_id AND h.node_id = t.node_id WHERE h.level_name = 'line' QUALIFY row_number() OVER (PARTITION BY h.doc_id ORDER BY tp) = 1")
def first_selection_hit(p):
    tree = layout.at_level(p.tree, "block", "line").withColumn("tree_pos", F.col("level_index") * 1000000 + F.regexp_extract("node_id", "([0-9]+)$", 1).cast("int"))
    hits = intervals.selection_overlap(p.block_alignments, p.gold_lines, _selection(p))
    return intervals.first_hit(hits, tree, ["line"]).select("doc_id", "node_id")


@query("SELECT doc_id, ast_index AS ast_index_start, doc_id % 5 AS char_start, ast_index + 1 AS ast_index_end, doc_id % 3 - 1 AS char_end FROM nodes WHERE ast_index % 2 = 0")
def selection_ranges(p):
    n = p.nodes.select("doc_id", "ast_index", (F.col("doc_id") % 5).alias("a"), (F.col("doc_id") % 3).alias("b"), F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    at = T.selection_range(F.col("ast_index"), F.col("a"), F.col("ast_index") + F.col("step"), F.when(F.col("step") == 1, F.col("b")).otherwise(F.col("a")))
    # a selection that ends where it begins is none
    return n.where("ast_index % 2 = 0").select("doc_id", at.alias("r")).where("r is not null").select("doc_id", "r.*")


_MI = "WITH i AS (SELECT user_id, value, event_id % 50 AS s, event_id % 50 + event_id % 7 AS e FROM events), o AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i), g AS (SELECT user_id, s, e, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY user_id, k"


@query(_MI, model=False)
def merge_intervals(p):
    e = p.spark.read.parquet(f"{p.sf_dir}/events.parquet").select("user_id", (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + F.col("event_id") % 7).alias("end"))
    return intervals.merge_intervals(e, ["user_id"])


@query(", f AS (SELECT doc_id, line_index, (doc_id + line_index * line_index) % 3 = 0 AS flag FROM lines), c AS (SELECT *, CASE WHEN lag(flag) OVER (PARTITION BY doc_id ORDER BY line_index) IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS b FROM f), g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line_index) - 1 AS segment FROM c) SELECT doc_id, segment::BIGINT AS segment, flag, min(line_index) AS first, max(line_index) AS last FROM g GROUP BY doc_id, segment, flag")
def highlight_segments(p):
    f = p.lines.select("doc_id", "line_index", ((F.col("doc_id") + F.col("line_index") * F.col("line_index")) % 3 == 0).alias("flag"))
    return intervals.run_segments(f, ["doc_id"], "line_index", "flag")


@query(", r AS (SELECT n.doc_id, n.ast_index, CASE WHEN n.ast_index = 0 THEN 3 ELSE 0 END AS s0, CASE WHEN n.ast_index = 1 THEN 6 ELSE n.e - n.s END AS e0 FROM nodes n WHERE n.ast_index BETWEEN 0 AND 1) SELECT doc_id, 'sel' AS node_id, ast_index, s0 AS start, e0 AS \"end\" FROM r WHERE e0 > s0")
def char_ranges(p):
    return intervals.char_ranges(_selection(p).withColumn("node_id", F.lit("sel")), p.nodes).drop("page_id")


@query(_HITS + " SELECT doc_id, node_id, ast_start, ast_end, round(score, 6) AS score FROM block_alignments SEMI JOIN hits USING (doc_id, node_id)")
def active_alignments(p):
    return intervals.active_alignments(intervals.selection_overlap(p.block_alignments, p.gold_lines, _selection(p)), p.block_alignments).select("doc_id", "node_id", "ast_start", "ast_end", F.round("score", 6).alias("score"))


@query("SELECT DISTINCT doc_id, ast_start + k AS ast_index FROM (SELECT doc_id, ast_start, unnest(range(0, 3)) AS k FROM block_alignments)")
def highlighted_indexes(p):
    return intervals.highlighted(p.block_alignments.withColumn("ast_end", F.col("ast_start") + 2)).drop("page_id")


# Text, corruption, rewrites


@query("SELECT doc_id, ast_index, substr(markdown, s + 1, e - s) AS content FROM nodes JOIN pages USING (doc_id)")
def content_slice(p):
    return p.nodes.join(p.text, KEY).select("doc_id", "ast_index", T.slice_of("markdown", F.col("start"), F.col("end")).alias("content"))


@query("SELECT n.doc_id, n.node_id, l.content AS visual, substr(p.markdown, n.s + n.c0 + 1, n.c1 + 1 - n.c0) AS markdown FROM gold_lines n JOIN lines l ON n.doc_id = l.doc_id AND n.node_id = l.node_id JOIN pages p ON n.doc_id = p.doc_id")
def match_content(p):
    start = p.nodes.select(*KEY, F.col("ast_index").alias("block_index"), F.col("start").alias("s"))
    t = p.gold_lines.join(start, [*KEY, "block_index"]).select(*KEY, "node_id", (F.col("s") + F.col("char_start")).alias("start"), (F.col("s") + F.col("char_end") + 1).alias("end"))
    return align.match_content(layout.at_level(p.tree, "line"), p.text, t).drop("page_id")


_CR = """, sp AS (SELECT doc_id, line_index AS pos, s + c0 AS a, s + c1 AS z FROM gold_lines),
ch AS (SELECT doc_id, i AS char_index, min(pos) AS pos FROM (SELECT doc_id, pos, unnest(range(a, z)) AS i FROM sp WHERE z > a) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY md5('7:' || doc_id || ':0:' || char_index), char_index) AS rank, count(*) OVER (PARTITION BY doc_id, pos) AS n FROM ch),
hit AS (SELECT * FROM rk WHERE rank <= CAST(round_even(n * 0.05::DOUBLE, 0) AS INTEGER))"""


def _corrupted(p):
    return corrupt.corrupt_relational(p.text, corrupt.spans_of(p.gold_lines, p.nodes), 0.05, 7)


@query(_CR + " SELECT doc_id, pos, char_index, CASE WHEN ascii(substr(markdown, char_index + 1, 1)) BETWEEN 32 AND 125 THEN chr(ascii(substr(markdown, char_index + 1, 1)) + 1) ELSE ' ' END AS replacement FROM hit JOIN pages USING (doc_id)")
def corrupt_relational(p):
    return _corrupted(p).drop("page_id")


@query(_CR + " SELECT doc_id, pos, count(*) AS n FROM hit GROUP BY doc_id, pos")
def corrupt_counts(p):
    return _corrupted(p).groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"))


@query()
def corrupt_compat(p):
    out = corrupt.corrupt_pages(p.text, corrupt.spans_of(p.gold_lines, p.nodes), [0.0, 0.05, 0.2], seed=7)
    return out.select("doc_id", "level", F.length("markdown").alias("n"), F.md5("markdown").alias("digest"))


@query(MARKED + ' SELECT doc_id, ast_index, type, start, "end" FROM ast')
def markdown_ast(p):
    return T.parse_pages(p.marked, "whitespace").drop("page_id", "words")


def _cascade(text: str) -> str:
    """SQL of the Treebank rules on a text; a line feed may stand behind its end, and the one look-ahead is a group."""

    def by(value: str, rules) -> str:
        for pattern, parts in rules:
            put = "".join(x if isinstance(x, str) else f"\\{x}" if isinstance(x, int) else x[0] for x in parts)
            if pattern == r"([:,])$":
                pattern, put = r"([:,])(\n?)$", put + r"\2"
            if "(?=" in pattern:
                pattern, put = pattern.replace(r"(?=\s))", r")(\s)"), put + r"\3"
            value = "regexp_replace({}, '{}', '{}', 'g')".format(value, pattern.replace("'", "''"), put.replace("'", "''"))
        return value

    return by(f"' ' || {by(text, treebank.OPENING + treebank.PUNCTUATION)} || ' '", treebank.CLOSING + treebank.CONTRACTIONS)


# words are found by their widths among the characters that are not blank; a quote has the width that it had in the text
_TB = rf"""{MARKED}, tb AS (SELECT doc_id, ast_index, t, list_filter(regexp_split_to_array({_cascade("t")}, '\s+'), lambda x: x <> '') AS w, regexp_extract_all(t, '``|''''|"') AS q FROM ast),
word AS (SELECT doc_id, ast_index, q, unnest(w) AS w, unnest(range(len(w))) AS k FROM tb),
quoted AS (SELECT *, w IN ('``', chr(39) || chr(39), '"') AS is_quote, count(*) FILTER (w IN ('``', chr(39) || chr(39), '"')) OVER (PARTITION BY doc_id, ast_index ORDER BY k) AS nth FROM word),
wide AS (SELECT *, CASE WHEN is_quote THEN length(q[nth]) ELSE length(w) END AS n FROM quoted),
ends AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, ast_index ORDER BY k) AS z FROM wide),
dark AS (SELECT doc_id, ast_index, list_filter(range(length(t)), lambda i: NOT regexp_matches(substr(t, i + 1, 1), '\s')) AS p FROM ast)
SELECT a.doc_id, a.ast_index, p[(z - n + 1)::BIGINT]::INTEGER AS start, p[z::BIGINT]::INTEGER + 1 AS "end" FROM ends a JOIN dark f ON a.doc_id = f.doc_id AND a.ast_index = f.ast_index"""


@query(_TB)
def treebank_spans(p):
    return T.parse_pages(p.marked).select("doc_id", "ast_index", F.explode("words").alias("w")).select("doc_id", "ast_index", "w.start", "w.end")


@query(MARKED + " SELECT doc_id, ast_index, type, t AS markdown FROM ast")
def ast_listing(p):
    return T.parse_pages(p.marked, "whitespace").join(p.marked, KEY).select("doc_id", "ast_index", "type", T.slice_of("markdown", F.col("start"), F.col("end")).alias("markdown"))


_IMG = "'![f](fig_' || doc_id || '.png) <img alt=\"x\" src=\"a/b.png\"> ![g](https://e.org/x.png) ![h](/r.png)'"


def _images(p):
    return p.pages.select("doc_id", F.concat(F.lit("![f](fig_"), F.col("doc_id").cast("string"), F.lit('.png) <img alt="x" src="a/b.png"> ![g](https://e.org/x.png) ![h](/r.png)')).alias("md"))


# all targets get the base, then those that had an address or a rooted path lose it
@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_IMG}, '(!\\[[^\\]]*\\]\\()', '\\1/api/p/0/', 'g'), '(<img\\s[^>]*src=\")', '\\1/api/p/0/', 'g'), '/api/p/0/(https?://|/)', '\\1', 'g') AS markdown FROM pages")
def image_url_rewrite(p):
    return _images(p).select("doc_id", T.image_urls(F.col("md"), "/api/p/0/").alias("markdown"))


@query(f"SELECT doc_id, regexp_replace({_IMG}, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', '<img src=\"\\2\" alt=\"\\1\">', 'g') AS markdown FROM pages")
def raw_image_tags(p):
    return _images(p).select("doc_id", T.image_tags(F.col("md")).alias("markdown"))


@query("SELECT doc_id, regexp_replace('a$x$ b $y ' || document, '([^$\\s\\\\])\\$', '\\1 $', 'g') AS markdown FROM pages")
def dollar_spacing(p):
    return p.pages.select("doc_id", T.dollar_spacing(F.concat(F.lit("a$x$ b $y "), F.col("document"))).alias("markdown"))


# the rewrites over whole texts, each with cases of its own behind
_CASES = '\n![f](fig.png) <img alt="x" src=\'a/b.png\'> ![g](https://e.org/x.png) ![h](/r.png) a$x$ b $y \\$z'


_MD = "(SELECT doc_id, markdown || chr(10) || '![f](fig.png) <img alt=\"x\" src=''a/b.png''> ![g](https://e.org/x.png) ![h](/r.png) a$x$ b $y \\$z' AS md FROM pages)"


def _with_cases(p):
    return p.pages.select("doc_id", F.concat("markdown", F.lit(_CASES)).alias("md"))


# every target gets a mark, those with an address or a rooted path lose it, and the mark becomes the base
@query(f" SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(md, '(!\\[[^\\]]*\\]\\()([^)]+\\))', '\\1' || chr(1) || '\\2', 'g'), '(<img\\s[^>]*src=[\"''])([^\"'']+[\"''])', '\\1' || chr(1) || '\\2', 'gi'), chr(1) || '(https?://|/)', '\\1', 'g'), chr(1), '/api/p/0/') AS markdown FROM {_MD}")
def page_image_urls(p):
    return _with_cases(p).select("doc_id", T.image_urls(F.col("md"), "/api/p/0/").alias("markdown"))


@query(f" SELECT doc_id, regexp_replace(md, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', '<img src=\"\\2\" alt=\"\\1\">', 'g') AS markdown FROM {_MD}")
def page_image_tags(p):
    return _with_cases(p).select("doc_id", T.image_tags(F.col("md")).alias("markdown"))


@query(f" SELECT doc_id, regexp_replace(md, '([^$\\s\\x0B\\\\])\\$', '\\1 $', 'g') AS markdown FROM {_MD}")
def page_dollar_spacing(p):
    return _with_cases(p).select("doc_id", T.dollar_spacing(F.col("md")).alias("markdown"))


@query(", r AS (SELECT doc_id, block_index AS i, c0 AS a, c1 + 1 + line_index % 2 * 2 AS z FROM gold_lines WHERE (doc_id + line_index) % 3 <> 1), f AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id, i ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM r), g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, i ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS k FROM f), m AS (SELECT doc_id, i, min(a) AS a, max(z) AS z FROM g GROUP BY doc_id, i, k), c AS (SELECT n.doc_id, ast_index, substr(markdown, s + 1, e - s) AS c FROM nodes n JOIN pages p ON n.doc_id = p.doc_id), h AS (SELECT m.*, c, coalesce(lag(z) OVER (PARTITION BY m.doc_id, i ORDER BY a), 0) AS b FROM m JOIN c ON m.doc_id = c.doc_id AND i = ast_index), o AS (SELECT doc_id, i, string_agg(substr(c, b + 1, a - b) || '<mark>' || substr(c, a + 1, z - a) || '</mark>', '' ORDER BY a) || substr(any_value(c), max(z) + 1) AS t FROM h GROUP BY doc_id, i) SELECT c.doc_id, ast_index, coalesce(t, c) AS content FROM c LEFT JOIN o ON c.doc_id = o.doc_id AND ast_index = i")
def highlight_markup(p):
    r = p.gold_lines.where("(doc_id + line_index) % 3 <> 1").select(*KEY, F.col("block_index").alias("ast_index"), F.col("char_start").alias("start"), F.expr("char_end + 1 + line_index % 2 * 2").alias("end"))
    n = p.nodes.join(p.text, KEY).select(*KEY, "ast_index", T.slice_of("markdown", F.col("start"), F.col("end")).alias("content"))
    return intervals.highlighted_text(n, r, "<mark>", "</mark>").drop("page_id")


def _coded(text: str):
    """The words of a text as codes, and the words by code."""
    import numpy as np

    code: dict[str, int] = {}
    y = np.array([code.setdefault(w, len(code)) for w in text.split()], int)
    return y, list(code)


@query()
def sequence_align(p):
    sim = sequences.WordCount()

    def run(pdf):
        import pandas as pd

        rows = []
        for d, t in zip(pdf["doc_id"], pdf["markdown"], strict=True):
            y, _ = _coded(t)
            for k, (a, b) in enumerate(sequences.hybrid(y[::6], y, sim)):
                rows.append((d, k, a, b))
        return pd.DataFrame(rows, columns=["doc_id", "k", "a", "b"])

    return p.pages.select("doc_id", "markdown").mapInPandas(lambda it: map(run, it), "doc_id long, k int, a int, b int")


@query()
def string_align(p):
    """Every other word of a line, found in it again in order."""

    def run(pdf):
        import pandas as pd

        rows = []
        for d, n, t in zip(pdf["doc_id"], pdf["line_index"], pdf["content"], strict=True):
            for k, hit in enumerate(sequences.match_strings(t.split()[::2], t, sequences.Equal())):
                rows.append((d, n, k, *(hit or (None, None))))
        out = pd.DataFrame(rows, columns=["doc_id", "line_index", "k", "start", "end"])
        return out.astype({"start": "Int32", "end": "Int32"})

    return p.lines.select("doc_id", "line_index", "content").mapInPandas(lambda it: map(run, it), "doc_id long, line_index int, k int, start int, end int")


def _located(p):
    """The words of the lines with their places on the page; a word's row has its own gap only, so that long lines cost no more."""
    each = F.arrays_zip(F.regexp_extract_all("content", F.lit("[^ \t]+"), F.lit(0)).alias("w"), F.split("content", "[^ \t]+", -1).alias("gap"))
    # the gap behind the last word has no word
    sizes = F.transform(F.slice(each, 1, F.size(each) - 1), lambda x: F.struct(F.length(x["w"]).alias("n"), F.length(x["gap"]).alias("gap")))
    d = p.lines.select(*KEY, "line_index", "block_index", "char_start", F.posexplode(sizes).alias("k", "x")).select("*", "x.*")
    to = F.sum(F.col("n") + F.col("gap")).over(Window.partitionBy(*KEY, "line_index").orderBy("k"))
    end = (F.col("char_start") + to).cast("int")
    return d.select(*KEY, "line_index", "block_index", (F.col("line_index").cast("long") * 1000000 + F.col("k")).alias("word_index"), (end - F.col("n")).alias("start"), end.alias("end"))


_LOC = r""", wg AS (SELECT doc_id, line_index, block_index, char_start, regexp_extract_all(content, '[^ \t]+') AS w, string_split_regex(content, '[^ \t]+') AS g FROM lines),
wk AS (SELECT *, unnest(range(len(w))) AS k FROM wg),
loc AS (SELECT doc_id, line_index, block_index, line_index::BIGINT * 1000000 + k AS wi, length(w[k + 1]) AS n, char_start + sum(length(w[k + 1]) + length(g[k + 1])) OVER (PARTITION BY doc_id, line_index ORDER BY k) AS e FROM wk)"""


@query(_LOC + """, rg AS (SELECT doc_id, block_index AS b, min(length(content)) // 2 AS least, max(length(content)) * 2 AS most FROM lines GROUP BY 1, 2),
rw AS (SELECT r.doc_id, b, least, most, wi, e - n AS s, e, row_number() OVER (PARTITION BY r.doc_id, b ORDER BY wi) - 1 AS i FROM rg r JOIN loc w ON w.doc_id = r.doc_id AND w.block_index BETWEEN b AND b + 1)
SELECT a.doc_id, 'block_' || a.b AS parent_id, a.wi AS word_index, greatest(f.i, a.i)::INTEGER AS first, l.i::INTEGER AS last
FROM rw a ASOF JOIN rw f ON a.doc_id = f.doc_id AND a.b = f.b AND a.s + a.least <= f.e ASOF JOIN rw l ON a.doc_id = l.doc_id AND a.b = l.b AND a.s + a.most >= l.e WHERE greatest(f.i, a.i) <= l.i""")
def word_bands(p):
    """The window of candidate ends of each word, within the nodes of its block and the next, by the lengths of the block's lines."""
    b = F.concat(F.lit("block_"), F.col("block_index").cast("string"))
    window = align.length_window(p.lines.select(*KEY, b.alias("parent_id"), "content"))
    at = p.lines.select(*KEY, b.alias("parent_id"), F.col("block_index").alias("ast_start"), (F.col("block_index") + 1).alias("ast_end")).distinct()
    words = _located(p).withColumn("ast_index", F.col("block_index"))
    return align.word_bands(words, window.join(at, [*KEY, "parent_id"])).select("doc_id", "parent_id", "word_index", "first", "last")


def _line_nodes(p):
    """A node for each line that is not empty, and blocks of four lines with the text that they span."""
    full = p.lines.where("length(content) > 0")
    nodes = full.select(*KEY, F.col("line_index").alias("ast_index"), F.col("char_start").alias("start"), (F.col("char_start") + F.length("content")).alias("end"))
    b = F.concat(F.lit("block_"), F.col("block_index").cast("string"))
    span = full.groupBy(*KEY, b.alias("node_id")).agg(F.min("char_start").alias("s"), F.max(F.col("char_start") + F.length("content")).alias("e"))
    blocks = span.join(p.text, KEY).select(*KEY, "node_id", F.lit("block").alias("level_name"), F.lit(None).cast("string").alias("parent_id"), T.slice_of("markdown", F.col("s"), F.col("e")).alias("content"))
    lines = full.select(*KEY, "node_id", F.lit("line").alias("level_name"), b.alias("parent_id"), "content")
    return nodes, blocks.unionByName(lines)


# each block is the text of four nodes; among blocks or ranges of equal text any may be matched, so texts are told
@query(", sp AS (SELECT doc_id, block_index, min(char_start) AS s, max(char_start + length(content)) AS e FROM lines WHERE length(content) > 0 GROUP BY 1, 2) SELECT sp.doc_id, 'block_' || block_index AS node_id, substr(markdown, s + 1, e - s) AS markdown, 1.0::DOUBLE AS score FROM sp JOIN pages p ON sp.doc_id = p.doc_id")
def block_alignment(p):
    nodes, tree = _line_nodes(p)
    out = align.align_blocks(tree, nodes, p.text)
    a, z = nodes.select(*KEY, F.col("ast_index").alias("ast_start"), "start"), nodes.select(*KEY, F.col("ast_index").alias("ast_end"), "end")
    out = out.join(a, [*KEY, "ast_start"]).join(z, [*KEY, "ast_end"]).join(p.text, KEY)
    return out.select("doc_id", "node_id", T.slice_of("markdown", F.col("start"), F.col("end")).alias("markdown"), F.round("score", 6).alias("score"))


# vectors are blind to case, and so is the result
@query(" SELECT l.doc_id, l.node_id, lower(trim(content, ' ' || chr(9))) AS markdown, true AS whole FROM lines l WHERE regexp_matches(content, '[^ \\t]')")
def tree_alignment(p):
    """Lines matched within their matched blocks: the words that each line has, of score 1 where it has no blanks around them."""
    p = p.gathered()
    nodes, tree = _line_nodes(p)
    _, out = align.align_tree(tree, nodes, None, p.text)
    a, z = nodes.select(*KEY, F.col("ast_index").alias("ast_index_start"), F.col("start").alias("a")), nodes.select(*KEY, F.col("ast_index").alias("ast_index_end"), F.col("start").alias("z"))
    out = out.join(a, [*KEY, "ast_index_start"]).join(z, [*KEY, "ast_index_end"]).join(p.text, KEY)
    found = T.slice_of("markdown", F.col("a") + F.col("char_start"), F.col("z") + F.col("char_end") + 1)
    return out.select("doc_id", "node_id", F.lower(found).alias("markdown"), (F.col("score") > 0.9).alias("whole"))


@query(", parts AS (SELECT doc_id, noise, node_id, c0, c1, score, CASE noise WHEN '0' THEN 0 WHEN '0.01' THEN 3 WHEN '0.05' THEN 1 ELSE 2 END AS part FROM noise_lines) SELECT doc_id, node_id, arg_max(c0, part)::INTEGER AS char_start, arg_max(c1, part)::INTEGER AS char_end, arg_max(noise, part) AS noise FROM parts GROUP BY doc_id, node_id")
def alignment_union(p):
    """The alignment maps of four tags laid over each other in the order 0, 0.05, 0.2, 0.01."""
    part = F.when(F.col("noise") == "0", 0).when(F.col("noise") == "0.01", 3).when(F.col("noise") == "0.05", 1).otherwise(2)
    return align.merged_alignments(p.noise_lines.withColumn("part", part), "part").select("doc_id", "node_id", "char_start", "char_end", "noise")


# Table functions in SQL


def _views(p, **tables) -> dict[str, str]:
    """The session with the table functions, and views of tables by names of their own."""
    import uuid

    from .functions import table_functions

    table_functions.register(p.spark)
    names = {}
    for name, df in tables.items():
        names[name] = f"{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(names[name])
    return names


@query(MARKED + ' SELECT doc_id, ast_index, type, start, "end" FROM ast')
def sql_markdown_blocks(p):
    v = _views(p, pages=p.marked)
    return p.spark.sql(f"SELECT p.doc_id, b.* FROM {v['pages']} p, LATERAL markdown_blocks(p.markdown) b")


@query("SELECT a.doc_id, a.ast_index AS ast_start, b.ast_index AS ast_end, a.s AS start, b.e AS \"end\" FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND b.ast_index >= a.ast_index")
def sql_node_ranges(p):
    v = _views(p, nodes=p.nodes)
    return p.spark.sql(f"SELECT doc_id, ast_start, ast_end, start, `end` FROM node_ranges(TABLE({v['nodes']}))")


@query(ORACLE_SQL["word_bands"], model=False)
def sql_word_windows(p):
    """The rows of ``word_bands``, by the table function over a row for each block."""
    b = F.concat(F.lit("block_"), F.col("block_index").cast("string"))
    window = align.length_window(p.lines.select(*KEY, b.alias("parent_id"), "content"))
    own = _located(p).groupBy(*KEY, "block_index").agg(F.sort_array(F.collect_list(F.struct("word_index", "start", "end"))).alias("own"))
    # a block has its own words and those of the next
    both = own.select(*KEY, F.explode(F.array("block_index", F.col("block_index") - 1)).alias("b"), "block_index", "own").where("b >= 0").withColumn("parts", F.struct("block_index", "own"))
    blocks = both.groupBy(*KEY, F.concat(F.lit("block_"), F.col("b").cast("string")).alias("parent_id")).agg(F.flatten(F.sort_array(F.collect_list("parts"))["own"]).alias("words"))
    v = _views(p, blocks=blocks.join(window, [*KEY, "parent_id"]))
    return p.spark.sql(f"SELECT doc_id, parent_id, word_index, first, last FROM block_windows(TABLE({v['blocks']}))")


# Storage shapes and lookups


@query("SELECT doc_id, node_id, ast_start, ast_end, round(score, 6) AS score FROM block_alignments")
def alignment_json_roundtrip(p):
    from .sources import pages as S

    back = S.blocks_from_json(S.alignment_json(p.block_alignments, p.gold_lines))
    return back.select("doc_id", "node_id", "ast_start", "ast_end", F.round("score", 6).alias("score"))


@query("SELECT doc_id, node_id, to_json({'node_id': node_id, 'level_index': level_index, 'parent_id': parent_id, 'x0': x0, 'label': label})::VARCHAR AS js FROM tree WHERE level_name = 'block'")
def tree_json(p):
    fields = F.struct("node_id", "level_index", "parent_id", "x0", "label")
    return layout.at_level(p.tree, "block").select("doc_id", "node_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("js"))


def _ocr(p):
    """The derived lines and words in the shape of a text recogniser's output: parallel arrays, words nested by line, boxes in fractions."""
    box = F.array(*[F.col(c) + F.lit(0.7) for c in ("x0", "y0", "x1", "y1")])
    each = p.words.groupBy(*KEY, "line_index").agg(F.sort_array(F.collect_list(F.struct("k", box.alias("b"), F.col("content").alias("t")))).alias("w"))
    rows = p.lines.select(*KEY, "line_index", box.alias("b"), "content").join(each, [*KEY, "line_index"], "left")
    none = F.array().cast("array<struct<k:int,b:array<double>,t:string>>")
    line = F.struct("line_index", "b", "content", F.coalesce("w", none).alias("w"))
    page = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(line)).alias("l"))
    return page.select(*KEY, F.col("l.b").alias("boxes"), F.col("l.content").alias("texts"), F.transform("l", lambda _: F.lit(0.9)).alias("scores"), F.transform("l", lambda x: x["w"]["b"]).alias("word_boxes"), F.transform("l", lambda x: x["w"]["t"]).alias("words"))


@query("SELECT doc_id, line_index AS line_pos, x0, y0, x1, y1, content AS text FROM lines")
def ocr_lines(p):
    from .sources import pages as S

    return S.tokens_from_ocr(_ocr(p))[0].drop("page_id", "score")


@query("SELECT doc_id, line_index::BIGINT AS line_index, k, x0, y0, x1, y1, content AS text FROM words")
def ocr_words(p):
    from .sources import pages as S

    return S.tokens_from_ocr(_ocr(p))[1].drop("page_id")


@query("SELECT doc_id, 'block_' || block_index AS index, x0, y0, x1, y1, label FROM blocks")
def layout_boxes(p):
    from .sources import pages as S

    box = F.struct(F.array(*[F.col(c) + F.lit(0.9) for c in ("x0", "y0", "x1", "y1")]).alias("box"), "label", F.lit(0.5).alias("score"))
    page = p.blocks.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("block_index", box.alias("b")))), lambda x: x["b"]).alias("boxes"))
    return S.parsed_boxes(page, "block").drop("page_id", "score")


@query("SELECT doc_id, 'block_' || block_index AS index, x0 + 0.5::DOUBLE AS x0, y0 + 0.5::DOUBLE AS y0, x1 + 0.5::DOUBLE AS x1, y1 + 0.5::DOUBLE AS y1, label, ord AS \"order\", '' AS content, block_index FROM blocks")
def parsed_blocks(p):
    from .sources import pages as S

    box = F.struct("block_index", F.array(*[F.col(c) + F.lit(0.5).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("box"), "label", "order", "content", F.col("block_index").alias("index"))
    page = p.blocks.groupBy(*KEY).agg(F.sort_array(F.collect_list(box)).alias("blocks"))
    return S.parsed_blocks(page).drop("page_id")


@query("SELECT doc_id, 'formula_' || (row_number() OVER (PARTITION BY doc_id ORDER BY block_index) - 1) AS index, x0, CASE WHEN block_index % 2 = 0 THEN y0 ELSE least(y0, y1) END AS y0, x1, CASE WHEN block_index % 2 = 0 THEN y1 ELSE greatest(y0, y1) END AS y1, label AS text, block_index AS formula_region_id FROM blocks WHERE label = 'formula'")
def parsed_formulas(p):
    from .sources import pages as S

    # a box on even blocks, the corners of a quadrangle on others
    c = {n: F.col(n) + F.lit(0.25).cast("double") for n in ("x0", "y0", "x1", "y1")}
    poly = F.when(F.col("block_index") % 2 == 0, F.array(c["x0"], c["y0"], c["x1"], c["y1"])).otherwise(F.array(c["x0"], c["y1"], c["x1"], c["y1"], c["x1"], c["y0"], c["x0"], c["y0"]))
    page = p.blocks.where("label = 'formula'").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("block_index", poly.alias("poly"), F.col("label").alias("text"), F.col("block_index").alias("id")))).alias("formulas"))
    return S.parsed_formulas(page).drop("page_id")


# Jobs over a written store


def _shared(p) -> str:
    """The session's shared folder; a local session without one takes a folder of its warehouse."""
    at = p.spark.conf.get("spark.checkpoint.dir", None) or p.spark.conf.get("spark.sql.warehouse.dir")
    return at.rstrip("/")


def _store(p, *tables: str):
    """A store of the derived pages with the named tables, deleted when the driver ends."""
    import uuid

    from .jobs import Store

    store = Store(p.spark, f"{_shared(p)}/store-{uuid.uuid4().hex}")
    at = p.spark._jvm.org.apache.hadoop.fs.Path(store.root)
    fs = at.getFileSystem(p.spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    made = {
        "text": lambda: p.pages,
        "nodes": lambda: p.nodes,
        "regions": lambda: p.regions,
        "blocks": lambda: p.blocks,
        "line_tokens": lambda: p.lines,
        "word_tokens": lambda: p.words,
        "line_alignments": lambda: p.noise_lines,
        "block_alignments": lambda: p.noise_blocks,
    }
    for name in tables:
        store.write(name, made[name](), by=("noise",) if name in ("line_alignments", "block_alignments") else ())
    return store


@query("SELECT level_name, count(*) AS n, count(parent_id) AS with_parent FROM tree GROUP BY level_name")
def job_layout_trees(p):
    from . import jobs

    store = _store(p, "regions", "blocks", "line_tokens", "word_tokens")
    jobs.build_layout_trees(store)
    # a second run finds every page there
    jobs.build_layout_trees(store)
    return store.read("tree").groupBy("level_name").agg(F.count(F.lit(1)).alias("n"), F.count("parent_id").alias("with_parent"))


def _scored_store(p):
    from . import jobs

    store = _store(p, "text", "nodes", "regions", "blocks", "line_tokens", "word_tokens", "line_alignments", "block_alignments")
    jobs.build_layout_trees(store)
    return store


@query(f"SELECT document, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(*) AS count FROM ({_LS}) JOIN pages USING (doc_id) GROUP BY document")
def job_benchmark(p):
    from . import jobs

    store = _scored_store(p)
    jobs.benchmark(store)
    return jobs.summary(store)["line_scores_by_document"].withColumns(r6("mean", "std"))


@query("SELECT t.noise, round(avg(coalesce(n.score, 0)), 6) AS mean, count(*) AS count FROM lines l CROSS JOIN (SELECT t.noise AS noise FROM tags) t LEFT JOIN noise_lines n ON n.doc_id = l.doc_id AND n.node_id = l.node_id AND n.noise = t.noise GROUP BY t.noise")
def job_noise_benchmark(p):
    from . import jobs

    store = _scored_store(p)
    jobs.noise_benchmark(store)
    return jobs.summary(store)["noise"].select("noise", "mean", "count").withColumns(r6("mean"))


@query("SELECT noise_level, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(block_error), 6) AS block_error, count(*) AS n FROM prf GROUP BY noise_level")
def job_precision_recall(p):
    from . import jobs

    store = _scored_store(p)
    jobs.precision_recall_benchmark(store)
    return jobs.summary(store)["precision_recall"].withColumns(r6("precision", "recall", "f1", "block_error"))


@query("SELECT noise, count(*) AS n, round(sum(CASE WHEN noise = '0.2' AND doc_id % 3 = 0 THEN 1 - score ELSE score END), 6) AS score FROM noise_lines WHERE noise <> '0.2' OR doc_id % 3 <> 0 OR line_index % 2 = 0 GROUP BY noise")
def job_replace(p):
    """A store in which the pages of every third document are written anew under one tag, with half of their lines."""
    store = _store(p, "text", "line_alignments")
    pages = store.documents().where("doc_id % 3 = 0").select(*KEY, F.lit("0.2").alias("noise"))
    new = store.read("line_alignments").where("noise = '0.2' and doc_id % 3 = 0 and line_index % 2 = 0").withColumn("score", 1 - F.col("score"))
    store.write("line_alignments", new, True, ("noise",), pages)
    return store.read("line_alignments").groupBy("noise").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query()
def job_corrupt(p):
    from . import jobs

    store = _store(p, "text", "nodes", "line_alignments")
    jobs.build_corruption(store, "5,20", seed=7)
    return store.read("corrupted").select("doc_id", "noise", F.length("markdown").alias("n"), F.md5("markdown").alias("digest"))


@query("SELECT DISTINCT document FROM pages")
def doc_list(p):
    return p.pages.select("document").distinct().orderBy("document")


@query("SELECT document, count(*) AS pages FROM pages GROUP BY document")
def page_counts(p):
    return p.pages.groupBy("document").agg(F.count(F.lit(1)).alias("pages"))
