"""Report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmatch.operators.metrics import errors_of, group_of, metric_cells, overall_of
from goldmatch.operators.verdict import SAMPLE_FIELDS
from goldmatch.session import written

_GROUP = "struct<total:long,correct:long,accuracy:double>"
METRICS_SCHEMA = (
    "total_queries long, correct_queries long, valid_sql_queries long, "
    "execution_accuracy double, valid_sql_rate double, "
    f"tier_accuracy map<string,{_GROUP}>, query_type_accuracy map<string,{_GROUP}>, "
    "error_breakdown map<string,long>"
)
SAMPLE_SCHEMA = (
    "item_id long, db_id string, question string, gold_sql string, predicted_sql string, "
    "difficulty string, query_type string, is_correct boolean, gold_status string, "
    "pred_status string, error_message string, execution_time_ms double"
)


def summary(samples: DataFrame) -> DataFrame:
    """One line with the eight fields of the stored metrics."""
    cells = written(metric_cells(samples), "cells")

    def packed(df: DataFrame, key: str, name: str) -> DataFrame:
        value = F.struct("total", "correct", "accuracy") if key != "category" else F.col("n")
        pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))))
        return df.agg(F.map_from_entries(pairs).alias(name))

    parts = [
        overall_of(cells),
        packed(group_of(cells, "difficulty"), "difficulty", "tier_accuracy"),
        packed(group_of(cells, "query_type"), "query_type", "query_type_accuracy"),
        packed(errors_of(cells), "category", "error_breakdown"),
    ]
    names = [n for p in parts for n in p.columns]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])


def write_metrics_json(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The flat metrics file: one object, one line."""
    summary(samples).coalesce(1).write.mode(mode).json(path)


def write_report_json(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``<path>/summary`` (one object) and ``<path>/samples`` (JSON lines)."""
    write_metrics_json(samples, f"{path}/summary", mode)
    samples.select(*SAMPLE_FIELDS).write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/samples")


def read_samples_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMA).json(path)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """A stored metrics object, whatever its layout on lines."""
    return spark.read.schema(METRICS_SCHEMA).option("multiLine", "true").json(path)


def metrics_of(stored: DataFrame) -> DataFrame:
    """Stored metrics as (dimension, key, total, correct, accuracy) lines."""
    overall = stored.select(
        F.lit("overall").alias("dimension"),
        F.lit("all").alias("key"),
        F.col("total_queries").alias("total"),
        F.col("correct_queries").alias("correct"),
        F.col("execution_accuracy").alias("accuracy"),
    )

    def lines(column: str, dimension: str) -> DataFrame:
        return stored.select(F.explode(column).alias("key", "v")).select(
            F.lit(dimension).alias("dimension"), "key", "v.total", "v.correct", "v.accuracy"
        )

    return overall.unionByName(lines("tier_accuracy", "difficulty")).unionByName(
        lines("query_type_accuracy", "query_type")
    )


def errors_stored(stored: DataFrame) -> DataFrame:
    """Stored error counts as (category, n) lines."""
    return stored.select(F.explode("error_breakdown").alias("category", "n"))
