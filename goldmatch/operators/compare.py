"""Set-based comparison of many pairs of result sets at once.

``rows`` has one line per result row: item_id, side (``gold``/``pred``), row_no
(dense, from 0) and cells (see :mod:`goldmatch.functions.cells`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sign() -> Column:
    return F.when(F.col("side") == "gold", F.lit(1)).otherwise(F.lit(-1)).alias("sign")


def positional_residue(rows: DataFrame) -> DataFrame:
    """Rows that have no equal partner at the same position, with their surplus.

    The key holds the position, so a huge result spreads over all tasks.
    """
    return (
        rows.select("item_id", "row_no", "cells", _sign())
        .groupBy("item_id", "row_no", "cells")
        .agg(F.sum("sign").alias("surplus"))
        .where(F.col("surplus") != 0)
    )


def differing_items(rows: DataFrame) -> DataFrame:
    """Items whose results differ as lists, with ``same_bag``.

    One shuffle of the rows answers both questions: rows equal at their position
    cancel out, and only the residue is summed again per distinct row. That sum
    starts on the map side, so a result made of one repeated row shrinks before
    it moves.
    """
    per_row = (
        positional_residue(rows)
        .groupBy("item_id", "cells")
        .agg(F.sum("surplus").alias("surplus"))
    )
    return per_row.groupBy("item_id").agg((F.max(F.abs("surplus")) == 0).alias("same_bag"))


def ordered_compare(items: DataFrame, rows: DataFrame) -> DataFrame:
    """List equality per item; two empty results are equal."""
    differing = positional_residue(rows).select("item_id").distinct()
    return _mark(items, differing)


def bag_compare(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Multiset equality per item: equal rows of both sides cancel out."""
    differing = (
        rows.select("item_id", "cells", _sign())
        .groupBy("item_id", "cells")
        .agg(F.sum("sign").alias("surplus"))
        .where(F.col("surplus") != 0)
        .select("item_id")
        .distinct()
    )
    return _mark(items, differing)


def _mark(items: DataFrame, differing: DataFrame) -> DataFrame:
    hit = differing.withColumn("_hit", F.lit(True))
    return (
        items.select("item_id")
        .join(hit, "item_id", "left")
        .select("item_id", F.col("_hit").isNull().alias("is_equal"))
    )


def cap_result_rows(rows: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows of every result."""
    return rows.where(F.col("row_no") < max_rows)


def capped_results(rows: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows of every result, with ``truncated``: whether it has more.

    Positions are dense, so the row after the last one kept answers that; rows beyond it are
    dropped before anything moves, and a group has ``max_rows`` + 1 rows at most.
    """
    near = rows.where(F.col("row_no") <= max_rows)
    last = F.max("row_no").over(Window.partitionBy("item_id", "side"))
    return cap_result_rows(near.withColumn("truncated", last == max_rows), max_rows)


def truncated_results(rows: DataFrame, max_rows: int) -> DataFrame:
    """Row counts per result and whether the cap would cut it."""
    return (
        rows.groupBy("item_id", "side")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("kept_rows", F.least(F.col("n_rows"), F.lit(max_rows).cast("long")))
        .withColumn("truncated", F.col("n_rows") > max_rows)
    )
