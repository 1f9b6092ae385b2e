"""Incremental ingest of page tables: a file-source stream into a partitioned store.

Files that were seen are never read again, and pages that the store already has are skipped, or with ``overwrite`` replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.pages import write_tables


def ingest(spark: SparkSession, source: str, schema: StructType, name: str, root: str, checkpoint: str, overwrite: bool = False) -> StreamingQuery:
    """Appends the pages (doc_id, page_id, ...) of new Parquet files below ``source`` to the table ``name``; stops when all are in."""

    def step(batch: DataFrame, _: int) -> None:
        write_tables({name: batch}, root, overwrite)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
