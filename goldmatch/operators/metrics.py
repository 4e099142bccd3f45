"""Accuracy reports.

All of them start from :func:`metric_cells`, the only pass over the fact table:
a partial aggregate to at most tiers x types x categories lines. Everything after
it works on that handful of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmatch.functions import statuses as S
from goldmatch.functions.numbers import percent
from goldmatch.functions.sqltext import QUERY_TYPES, TIERS
from goldmatch.functions.text import label


def metric_cells(samples: DataFrame) -> DataFrame:
    """total, correct, valid per (difficulty, query_type, error category)."""
    correct = F.col("is_correct")
    return samples.groupBy(
        "difficulty",
        "query_type",
        F.when(~correct, S.error_category(F.col("pred_status"))).alias("category"),
    ).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(correct).alias("correct"),
        F.count_if(F.col("pred_status") == S.SUCCESS).alias("valid"),
    )


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def overall_of(cells: DataFrame) -> DataFrame:
    counts = cells.agg(_sum("total"), _sum("correct"), _sum("valid"))
    return counts.select(
        F.col("total").alias("total_queries"),
        F.col("correct").alias("correct_queries"),
        F.col("valid").alias("valid_sql_queries"),
        _ratio("correct", "total").alias("execution_accuracy"),
        _ratio("valid", "total").alias("valid_sql_rate"),
    )


def group_of(cells: DataFrame, key: str) -> DataFrame:
    counts = cells.groupBy(key).agg(_sum("total"), _sum("correct"))
    return counts.withColumn("accuracy", _ratio("correct", "total"))


def long_of(cells: DataFrame) -> DataFrame:
    """overall, difficulty and query_type lines in one grouping-sets aggregate."""
    sets = cells.groupingSets(
        [[], ["difficulty"], ["query_type"]], "difficulty", "query_type"
    ).agg(
        F.grouping_id("difficulty", "query_type").alias("level"),
        _sum("total"),
        _sum("correct"),
        _sum("valid"),
    )
    return sets.select(
        F.when(F.col("level") == 3, "overall")
        .when(F.col("level") == 1, "difficulty")
        .otherwise("query_type")
        .alias("dimension"),
        F.when(F.col("level") == 3, "all")
        .when(F.col("level") == 1, F.col("difficulty"))
        .otherwise(F.col("query_type"))
        .alias("key"),
        "total",
        "correct",
        "valid",
        _ratio("correct", "total").alias("accuracy"),
    )


def errors_of(cells: DataFrame) -> DataFrame:
    return (
        cells.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("total").alias("n"))
    )


def overall_metrics(samples: DataFrame) -> DataFrame:
    """Counts and rates; zeros for an empty input."""
    return overall_of(metric_cells(samples))


def tier_metrics(samples: DataFrame) -> DataFrame:
    return group_of(metric_cells(samples), "difficulty")


def type_metrics(samples: DataFrame) -> DataFrame:
    return group_of(metric_cells(samples), "query_type")


def metrics_long(samples: DataFrame) -> DataFrame:
    return long_of(metric_cells(samples))


def error_breakdown(samples: DataFrame) -> DataFrame:
    """Incorrect items per category."""
    return errors_of(metric_cells(samples))


def ordered_categories(samples: DataFrame) -> DataFrame:
    return error_breakdown(samples).select("category").orderBy("category")


def union_categories(first: DataFrame, second: DataFrame) -> DataFrame:
    a, b = error_breakdown(first).select("category"), error_breakdown(second).select("category")
    return a.union(b).distinct()


def fixed_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """A fixed list of keys with their report position."""
    rows = [(k, i) for i, k in enumerate(keys)]
    return df.sparkSession.createDataFrame(rows, "key string, position int")


def _table(samples: DataFrame, dimension: str, keys: list[str]) -> DataFrame:
    """Fixed lines left-joined to the long form, which is computed once."""
    found = long_of(metric_cells(samples)).where(F.col("dimension").isin(dimension, "overall"))
    lines = fixed_keys(samples, keys).join(found, "key", "left")
    return lines.select(
        "position",
        F.when(F.col("key") == "all", F.lit("OVERALL")).otherwise(label(F.col("key"))).alias("label"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("correct", F.lit(0)).alias("correct"),
        percent(F.coalesce("accuracy", F.lit(0.0))).alias("accuracy"),
    ).orderBy("position")


def tier_table(samples: DataFrame) -> DataFrame:
    """Tiers in fixed order, absent ones as zeros, then OVERALL."""
    return _table(samples, "difficulty", [*TIERS, "all"])


def type_table(samples: DataFrame) -> DataFrame:
    """Query types in fixed order, absent ones as zeros."""
    return _table(samples, "query_type", QUERY_TYPES)
