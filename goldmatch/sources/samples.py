"""Training samples as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmatch.functions.prompts import sft_messages

SAMPLE_SCHEMA = (
    "item_id long, db_id string, question string, gold_sql string, difficulty string, "
    "messages array<struct<role:string,content:string>>"
)
OPEN_SPLITS, FILE_SAMPLES = 8, 200_000


def sft_samples(items: DataFrame) -> DataFrame:
    """Three-message samples of items that carry ``schema_ddl``; ``split`` is kept."""
    extra = ["split"] if "split" in items.columns else []
    return items.select(
        "item_id",
        "db_id",
        "question",
        "gold_sql",
        "difficulty",
        sft_messages(F.col("schema_ddl"), F.col("question"), F.col("gold_sql")).alias("messages"),
        *extra,
    )


def write_samples_jsonl(samples: DataFrame, path: str, compression: str = "gzip") -> None:
    """One folder per split, one object per line, null fields written as null.

    A schema text comes with every question on it, so files are compressed (``none``: plain)
    and end after ``FILE_SAMPLES`` lines, as one compressed file is read by one task.
    A task has a file per split open at once: to sort long rows by their split would move
    them all through memory and disk.
    """
    conf, name = samples.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, "0")
    conf.set(name, max(int(before), OPEN_SPLITS))
    try:
        (
            samples.write.partitionBy("split")
            .options(ignoreNullFields="false", compression=compression, maxRecordsPerFile=FILE_SAMPLES)
            .json(path)
        )
    finally:
        conf.set(name, before)


def read_labelled_splits(spark: SparkSession, path: str, splits: dict[str, str]) -> DataFrame:
    """``{folder: label}`` read as one dataset with a ``split`` column."""
    out = None
    for folder, label in splits.items():
        part = (
            spark.read.schema(SAMPLE_SCHEMA)
            .json(f"{path}/split={folder}")
            .withColumn("split", F.lit(label))
        )
        out = part if out is None else out.unionByName(part)
    return out
