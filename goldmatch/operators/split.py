"""Splits that keep all rows of a key together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmatch.operators.ordinals import spread_positions
from goldmatch.session import dimension, written


def validation_keys(df: DataFrame, key: str, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """The keys of the validation half, in the order of a seeded hash.

    ``max(1, floor(n * ratio))`` keys, none when there is only one. The distinct
    keys are stored once and ranked by a distributed sort.
    """
    keys = written(df.select(key).where(F.col(key).isNotNull()).distinct(), "split-keys")
    n = keys.count()
    n_val = max(1, int(n * val_ratio)) if n > 1 else 0
    hashed = keys.withColumn(
        "_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    )
    ranked = spread_positions(hashed, [], ["_hash", key], "_rank")
    return ranked.where(F.col("_rank") < n_val).select(key)


def group_split(df: DataFrame, key: str, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split`` (train/val) with disjoint keys.

    The chosen keys are stored and measured: a short list is broadcast, for a long
    one adaptive execution splits hot keys.
    """
    chosen = dimension(validation_keys(df, key, val_ratio, seed), "val-keys")
    chosen = chosen.withColumn("_val", F.lit(True))
    return df.join(chosen, key, "left").select(
        *[df[c] for c in df.columns],
        F.when(F.col("_val"), F.lit("val")).otherwise(F.lit("train")).alias("split"),
    )


def shared_keys(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides; a clean split has none. Both sides are reduced
    to distinct keys before they meet."""
    a, b = first.select(key).distinct(), second.select(key).distinct()
    return a.join(b, key, "left_semi")


def leakage_audit(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Per-key row counts of both halves and whether the key leaks, in one shuffle."""
    return df.groupBy(key).agg(
        F.count_if(F.col(split) == "train").alias("train_rows"),
        F.count_if(F.col(split) == "val").alias("val_rows"),
    ).withColumn("leaks", (F.col("train_rows") > 0) & (F.col("val_rows") > 0))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def distinct_databases(items: DataFrame) -> DataFrame:
    """Databases in use with their number of items."""
    return items.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_items"))
