"""Pages of a stream, held until all their tables are there.

Recognition writes a page's tables one by one, in any order.  The stream has a row for each table of a page that
arrives; a page's parts wait in state, keyed by page, and the page comes out once, when its last part is
in.  A part that arrives again before that takes the place of the first; after it, it is dropped.  What waits survives a restart
with the query's checkpoint; a page's state afterwards is one flag.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.layout import KEY
from ..sources.pages import REQUIRED

PART = "doc_id string, page_id int, table string, rows string"
PAGE = "doc_id string, page_id int, tables map<string,string>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parts(table: DataFrame, name: str) -> DataFrame:
    """Rows of a table as parts: one for each page of a batch, its rows as a JSON array."""
    own = [c for c in table.columns if c not in KEY]
    row = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    return table.select(*KEY, F.lit(name).alias("table"), F.concat(F.lit("["), row, F.lit("]")).alias("rows"))


def rows_of(pages: DataFrame, name: str, schema: str | StructType) -> DataFrame:
    """The rows of a table of complete pages."""
    return pages.select(*KEY, F.explode(F.from_json(F.col("tables")[name], f"array<struct<{schema}>>" if isinstance(schema, str) else schema)).alias("r")).select(*KEY, "r.*")


class Waiting(StatefulProcessor):
    """Holds the parts of a page."""

    def __init__(self, required: tuple[str, ...]):
        self.required = required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "table string", "rows string")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        for pdf in rows:
            for table, data in zip(pdf["table"], pdf["rows"], strict=True):
                if table in self.required:
                    self.held.updateValue((table,), (data,))
        held = {t[0]: d[0] for t, d in self.held.iterator()}
        if len(held) == len(self.required):
            self.held.clear()
            self.done.update((True,))
            yield pd.DataFrame({"doc_id": [key[0]], "page_id": [key[1]], "tables": [held]})

    def close(self) -> None:
        pass


def complete(stream: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Pages (doc_id, page_id, tables by name) of a stream of parts (``PART``), each when the last of its required tables is in; other tables are dropped."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own = stream.select(F.col("doc_id").cast("string"), F.col("page_id").cast("int"), "table", "rows").where("doc_id is not null and page_id is not null")
    return own.groupBy(*KEY).transformWithStateInPandas(Waiting(tuple(required)), PAGE, "Append", "None")
