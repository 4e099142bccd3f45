"""A durable record of executed statements, so that a run can go on after its driver is lost.

A run folder holds

* ``items``: the items as they were first given,
* ``work/<chunk>``: what the statements of a chunk write while it runs; removed after it,
* ``rows/chunk=<chunk>``: the chunk's result rows in one table, numbered,
* ``log/chunk=<chunk>``: one line per finished statement. This folder is written last and
  commits the chunk: rows of chunks without one are never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldmatch.session import dimension

LINE_SCHEMA = "item_id long, side string, status string, error_message string, execution_time_ms double"
ROW_SCHEMA = "item_id long, side string, row_no long, cells array<string>"
PLACED_SCHEMA = "at long, cells array<string>, item_id long, side string"


@dataclass
class Ledger:
    spark: SparkSession
    path: str

    def _hadoop(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jpath

    def holds(self, name: str) -> bool:
        fs, path = self._hadoop(f"{self.path}/{name}")
        return fs.exists(path)

    def remove(self, name: str) -> None:
        fs, path = self._hadoop(f"{self.path}/{name}")
        fs.delete(path, True)

    def items(self, given: DataFrame) -> DataFrame:
        """The run's items: those stored by its first call, else ``given``, which are then stored."""
        if not self.holds("items/_SUCCESS"):
            given.write.mode("overwrite").parquet(f"{self.path}/items")
        return self.spark.read.schema(given.schema).parquet(f"{self.path}/items")

    def lines(self) -> DataFrame:
        """The log of all committed chunks."""
        if not self.holds("log"):
            return self.spark.createDataFrame([], LINE_SCHEMA + ", chunk string")
        return self.spark.read.schema(LINE_SCHEMA + ", chunk string").parquet(f"{self.path}/log")

    def rows(self) -> DataFrame:
        """The result rows of all committed chunks, with a dense row_no per result."""
        if not self.holds("rows"):
            return self.spark.createDataFrame([], ROW_SCHEMA)
        stored = self.spark.read.schema(ROW_SCHEMA + ", chunk string").parquet(f"{self.path}/rows")
        committed = dimension(self.lines().select("chunk").distinct(), "committed")
        return stored.join(committed, "chunk", "left_semi").drop("chunk")

    def new_chunk(self) -> str:
        return uuid.uuid4().hex

    def place(self, chunk: str, item_id: int, side: str) -> str:
        """Where one statement of a running chunk writes its rows."""
        return f"{self.path}/work/{chunk}/item_id={item_id}/side={side}"

    def commit(self, chunk: str, log: list[tuple], written: list[str]) -> None:
        """Join the statements' own folders to one table and add the chunk's log lines."""
        if written:
            base = f"{self.path}/work/{chunk}"
            placed = self.spark.read.schema(PLACED_SCHEMA).option("basePath", base).parquet(*written)
            numbered(placed).write.parquet(f"{self.path}/rows/chunk={chunk}")
        lines = self.spark.createDataFrame(log, LINE_SCHEMA).coalesce(1)
        lines.write.parquet(f"{self.path}/log/chunk={chunk}")
        self.remove(f"work/{chunk}")


def numbered(rows: DataFrame) -> DataFrame:
    """``at`` (task, place in task) to a dense position: the place plus the rows of
    earlier tasks. The table of task sizes has a line per result file; it is measured
    before it is broadcast."""
    placed = rows.withColumn("_part", F.shiftrightunsigned("at", 33))
    earlier = Window.partitionBy("item_id", "side").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        placed.groupBy("item_id", "side", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    place = F.col("at") - F.shiftleft("_part", 33)
    return placed.join(dimension(sizes, "result-sizes"), ["item_id", "side", "_part"]).select(
        "item_id", "side", (place + F.col("_before")).alias("row_no"), "cells"
    )
