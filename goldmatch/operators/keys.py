"""Declared keys as data checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_profile(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    """rows, distinct keys, null keys and uniqueness of one declared key.

    Counting per key first keeps the distinct count off a single task and shrinks
    a repeated key before it moves.
    """
    no_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_ok", no_null)
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count_if("_ok").alias("n_keys"),
        F.coalesce(F.sum(F.when(~F.col("_ok"), F.col("_n"))), F.lit(0)).alias("n_null"),
    ).select(
        F.lit(name).alias("table_name"),
        F.lit(", ".join(key)).alias("key_columns"),
        "n_rows",
        "n_keys",
        "n_null",
        ((F.col("n_rows") == F.col("n_keys")) & (F.col("n_null") == 0)).alias("is_unique"),
    )


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, edge: str) -> DataFrame:
    """Child rows of one foreign key without a parent; null keys do not count.

    The child is reduced to (key, rows) before the anti join, so a hot key is one
    line in it.
    """
    keys = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("k")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    lost = keys.join(parent.select(F.col(pk).alias("k")), "k", "left_anti")
    return lost.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"),
        F.count(F.lit(1)).alias("orphan_keys"),
    ).select(F.lit(edge).alias("edge"), "orphan_rows", "orphan_keys")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def profile_tables(table: Callable[[str], DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    return union_all([key_profile(table(t), t, key) for t, key in keys.items()])


def orphan_report(
    table: Callable[[str], DataFrame], edges: list[tuple[str, str, str, str]]
) -> DataFrame:
    return union_all(
        [fk_orphans(table(c), fk, table(p), pk, f"{c}.{fk} -> {p}.{pk}") for c, fk, p, pk in edges]
    )
