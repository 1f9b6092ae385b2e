"""A corpus pipeline of five of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents
that the stage keeps, in the columns of ``docs``; the last returns the pieces of packed windows.
``run`` applies them in order, each over what the one before wrote; what a stage and its operators
leave behind is deleted once the next stage is written.

All stages take null and empty texts (quality rules reject them), texts of any length, repeated rows
(each judged alike), null ids (never near-duplicates of others), empty
tables (no rows) and any further columns, which pass through; names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import fertility, minhash, packing, pii, toxicity
from quire.llm.crossparse import fold
from quire.llm.store import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language; null and empty texts fail them."""
    return fertility.judged(docs, "__quality").where(F.col("__quality")["kept"]).drop("__quality")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, learned from the labels of the training folds; without labels all stay."""
    scorer = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(5) != 0)
    return toxicity.scored(docs, scorer, "__score").where(F.col("__score") < 0.5).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id: five-word shingles, similarity of 0.8 or more.

    A document is an id with a text, so texts that share an id are judged each for itself, and rows that repeat both
    go together.  Only hashes of dropped documents are joined; rows without an id, and texts without a word, stay.
    """
    of = F.col("doc_id").cast("long")
    node = F.when(of.isNotNull(), F.xxhash64(of, "text"))
    found = minhash.near_duplicates(docs.select(node.alias("doc_id"), "text"), shingle=5, limit=(4, 5)).where("doc_id is not null")
    found = found.select(F.col("doc_id").alias("__node"), "component_id").distinct()
    ids = docs.where(of.isNotNull()).select(node.alias("__node"), of.alias("__id")).distinct()
    first = found.join(ids.hint("merge"), "__node").groupBy("component_id").agg(F.min_by("__node", F.struct("__id", "__node")).alias("__node"))
    dropped = found.select("__node").join(first.select("__node").hint("merge"), "__node", "left_anti").withColumnRenamed("__node", "__dropped")
    return docs.join(dropped.hint("merge"), node == F.col("__dropped"), "left_anti")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it generalised in the text; a null text stays null."""
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed windows; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("pii", sanitise), ("packing", pack)]

#: Learned scores and vocabularies are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``; each stage is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = []
    for k, (name, stage) in enumerate(STAGES):
        with scratch.scope(f"{k}-own"):
            docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        scratch.drop(*done)
        done = [f"{k}-{name}"]
    return docs
