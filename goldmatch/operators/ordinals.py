"""Dense row positions that do not put a large group into one task."""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldmatch.session import dimension, scratch_path, written

HOT_ROWS = 5_000_000
SAMPLE = 0.001
TASK_ROWS = 250_000


def _same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def spread_positions(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    name: str = "row_no",
    size: str | None = None,
) -> DataFrame:
    """Positions from a distributed sort.

    Rows are range-partitioned on (group, order), so a large group spans many
    tasks, and written with their place in the sorted output. A row's position is
    its place in its block plus the rows of the group in earlier blocks; there is
    one block per (group, partition) the group touches.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted")
    placed = df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = (
        spark.read.schema(placed.schema)
        .parquet(path)
        .withColumn("_part", F.shiftrightunsigned("_at", 33))
    )
    blocks = placed.groupBy(*group, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    in_group = Window.partitionBy(*group)
    earlier = in_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(in_group).alias("_size"),
    )
    blocks = dimension(blocks, "blocks")
    joined = placed.join(blocks, _same_key(placed, blocks, [*group, "_part"]))
    out = [placed[c] for c in df.columns] + [(F.col("_at") + F.col("_shift")).alias(name)]
    if size:
        out.append(F.col("_size").alias(size))
    return joined.select(*out)


def _window_positions(df, group, order, name, size) -> DataFrame:
    in_group = Window.partitionBy(*group)
    out = df.withColumn(name, (F.row_number().over(in_group.orderBy(*order)) - 1).cast("long"))
    return out.withColumn(size, F.count(F.lit(1)).over(in_group)) if size else out


def row_ordinals(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    name: str = "row_no",
    size: str | None = None,
    hot_rows: int = HOT_ROWS,
    sample: float = SAMPLE,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in a total order.

    Ordinary groups take one shuffle and a window. Groups that look larger than
    ``hot_rows`` in a sample are numbered by :func:`spread_positions`. The sample also
    tells about how many rows there are; they are dealt out ``task_rows`` to a task, as
    partitions that are joined by their compressed size can be of any size in memory, also
    for what follows by the same key. The sample only chooses the plan: a group it misses
    is numbered correctly all the same.
    """
    keys = df.select(*group)
    drawn = keys if sample >= 1 else keys.sample(fraction=sample, seed=17)
    counts, least = drawn.groupBy(*group).count(), max(1.0, hot_rows * sample / 2)
    seen = counts.agg(F.sum("count").alias("n"), F.max("count").alias("top")).first()
    tasks = ceil((seen.n or 0) / min(sample, 1) / task_rows)
    if tasks > 1:
        df = df.repartition(tasks, *group)
    if (seen.top or 0) < least:
        return _window_positions(df, group, order, name, size)
    hot = written(counts.where(F.col("count") >= least).select(*group), "hot-keys")
    on_key = _same_key(df, hot, group)
    cold_rows = df.join(hot, on_key, "left_anti")
    hot_rows_df = df.join(hot, on_key, "left_semi")
    return _window_positions(cold_rows, group, order, name, size).unionByName(
        spread_positions(hot_rows_df, group, order, name, size)
    )
