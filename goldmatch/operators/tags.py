"""SQL text tags of many items.

The steps are columns of their own: the optimizer keeps a column that is costly
and used more than once, so upper case, the SELECT count and the score are each
computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmatch.functions import sqltext

_UP, _SELECTS, _SCORE = "_up", "_n_select", "_score"


def _staged(df: DataFrame, sql: str) -> DataFrame:
    up = df.withColumn(_UP, F.upper(sql))
    return up.withColumn(_SELECTS, sqltext.select_count(F.col(_UP)))


def _scored(df: DataFrame, annotated: Column | None) -> DataFrame:
    """The score, computed only where no annotation decides."""
    score = sqltext.complexity(F.col(_UP), F.col(_SELECTS))
    if annotated is not None:
        score = F.when(F.coalesce(annotated, F.lit("")) == "", score)
    return df.withColumn(_SCORE, score)


def _tier(annotated: Column | None) -> Column:
    estimate = sqltext.tier_of(F.col(_SCORE))
    return estimate if annotated is None else F.coalesce(F.nullif(annotated, F.lit("")), estimate)


def with_query_type(df: DataFrame, sql: str = "gold_sql") -> DataFrame:
    """Adds ``query_type``."""
    kind = sqltext.query_type(F.col(_UP), F.col(_SELECTS))
    return _staged(df, sql).withColumn("query_type", kind).drop(_UP, _SELECTS)


def with_difficulty(df: DataFrame, sql: str = "gold_sql", annotated: str | None = "difficulty") -> DataFrame:
    """Sets ``difficulty``: the annotated tier where there is one, else the estimate."""
    given = F.col(annotated) if annotated else None
    scored = _scored(_staged(df, sql), given)
    return scored.withColumn("difficulty", _tier(given)).drop(_UP, _SELECTS, _SCORE)


def with_sql_tags(df: DataFrame, sql: str = "gold_sql") -> DataFrame:
    """``query_type`` and ``difficulty`` from the same steps."""
    given = F.col("difficulty")
    return (
        _scored(_staged(df, sql), given)
        .withColumns(
            {"query_type": sqltext.query_type(F.col(_UP), F.col(_SELECTS)), "difficulty": _tier(given)}
        )
        .drop(_UP, _SELECTS, _SCORE)
    )
