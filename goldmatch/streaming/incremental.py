"""Evaluation of a growing folder of items, resumable at any point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from goldmatch.operators.verdict import SAMPLE_FIELDS
from goldmatch.plans.evaluate import Database, evaluate


def _each_batch(spark: SparkSession, source: str, schema: T.StructType | str, save: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int) -> int:
    """Call ``save(batch, batch_id)`` for all files of ``source`` not yet seen; the number of batches."""
    done: list[int] = []

    def step(batch: DataFrame, batch_id: int) -> None:
        save(batch, batch_id)
        done.append(batch_id)

    query = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return len(done)


def incremental_eval(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    evaluate: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int = 20,
) -> int:
    """Evaluate all files of ``source`` not yet seen; returns the number of batches.

    Every micro-batch is stored in a folder named by its id. A batch that was cut
    off runs again with the same id and the same files and overwrites what it left,
    so a resumed run equals an uninterrupted one.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _each_batch(spark, source, schema, save, checkpoint, files_per_batch)


def incremental_items(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    databases: dict[str, Database],
    sink: str,
    checkpoint: str,
    files_per_batch: int = 20,
    **options,
) -> int:
    """Execute and judge the statements of all item files not yet seen; the number of batches.

    A micro-batch is a run of :func:`goldmatch.plans.evaluate.evaluate` in a folder named by
    its id. A batch that was cut off comes again with the same id and the same files, finds
    the chunks it had committed and executes the rest. Its samples replace what it left, so
    a resumed run equals an uninterrupted one, and a rerun without new files adds nothing.
    An item that comes again in a later file is a further sample.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        samples, _ = evaluate(batch, databases, run_path=f"{sink}/runs/batch={batch_id}", **options)
        samples.select(*SAMPLE_FIELDS).write.mode("overwrite").parquet(f"{sink}/samples/batch={batch_id}")

    return _each_batch(spark, source, schema, save, checkpoint, files_per_batch)


def evaluated(spark: SparkSession, sink: str, schema: T.StructType | str) -> DataFrame:
    """Everything evaluated so far; reports are batch jobs over it."""
    return spark.read.schema(schema).parquet(sink)
