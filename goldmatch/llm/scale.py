"""Positions and components over all rows, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldmatch.session import written

BINS = 1024
BATCH_BYTES, BATCH_LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` that gets batches of about ``BATCH_BYTES``.

    Spark's own limits are 10,000 rows and 64 MB, and its buffers double as they grow, so with
    whole texts a task takes far more memory outside the heap than its chunks need. A batch has
    one row at least. The limit is one of the session, which reads it when the plan runs;
    one that the session has already stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is None:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` behind as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, spread: Column, to: str, bins: int = BINS) -> DataFrame:
    """Add ``to``: the sum of ``value`` over the earlier rows of the same keys.

    ``spread`` is a 64-bit number per row that deals the rows of one key to ``bins``
    bins; the order is by bin, then by ``order``. Only the sums of the bins meet per
    key, so a key with a third of all rows is worked on by ``bins`` groups. Use a hash
    of a row's identity: rows that agree in it share a bin. Keys are not null.
    """
    bin_, sum_, before = (f"_{to}_{x}" for x in ("bin", "sum", "before"))
    binned = df.withColumn(bin_, F.pmod(spread, F.lit(bins)))
    sums = binned.groupBy(*keys, bin_).agg(F.sum(value).alias(sum_))
    earlier = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(bin_).alias("_kb"),
        F.coalesce(F.sum(sum_).over(earlier), F.lit(0)).alias(before),
    )
    same = F.col(bin_) == F.col("_kb")
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"_k{i}")
    inside = Window.partitionBy(*keys, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        binned.withColumn(to, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, same)
        .withColumn(to, F.col(to) + F.col(before))
        .drop(bin_, before, "_kb", *[f"_k{i}" for i in range(len(keys))])
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``links(u, v)``: the smallest node reachable.

    Every round joins each node to the smallest of itself and its neighbours and draws
    the links anew between those; rounds grow with the logarithm of a path's length.
    Each round is a written table, and a node's links are reduced to a minimum before
    they are shuffled.
    """
    levels, edges = [], links.select("u", "v").where("u <> v")
    while True:
        both = edges.union(edges.select("v", "u"))
        nearest = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("to"))
        level = written(nearest, "nearest")
        if level.isEmpty():
            break
        levels.append(level)
        a = level.select(F.col("node").alias("u"), F.col("to").alias("a"))
        b = level.select(F.col("node").alias("v"), F.col("to").alias("b"))
        edges = edges.join(a, "u").join(b, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        edges = written(edges.where("u <> v").distinct(), "links")
    if not levels:
        return links.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    out = levels[0].withColumnRenamed("to", "component")
    for level in levels[1:]:
        step = level.select(F.col("node").alias("component"), "to")
        out = out.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out
