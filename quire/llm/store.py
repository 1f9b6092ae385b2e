"""Shared scratch tables.

Intermediate tables that cut lineage are Parquet folders below ``spark.checkpoint.dir``, which every
executor and the driver can reach, so a lost executor never loses them.  Where the setting is absent a
local session takes a temporary folder of its machine; any other session fails.  What an operator leaves
behind is deleted with the scope it ran in, or else when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, from ``spark.checkpoint.dir``."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = spark.conf.get("quire.local.scratch", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="quire-")
            spark.conf.set("quire.local.scratch", at)
    return at.rstrip("/")


class Scratch:
    """A folder of named Parquet tables for one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{_SCOPE.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        fs, at = self._at("")
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, name: str) -> str:
        return f"{self.root}/{name}".rstrip("/")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        at = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            fs, at = self._at(name)
            fs.delete(at, True)

    @contextmanager
    def scope(self, name: str) -> Iterator[None]:
        """Operators called inside keep their tables below ``name``, which is deleted at the end."""
        outer = _SCOPE.set(self.path(name))
        try:
            yield
        finally:
            _SCOPE.reset(outer)
            self.drop(name)
