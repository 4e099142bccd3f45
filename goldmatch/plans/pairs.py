"""A corpus of (gold, predicted) statements over the given tables.

Every query shape appears with itself as prediction, then come predictions that
differ in a known way. ``expected`` is the outcome the pair is meant to have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmatch.functions import statuses as S
from goldmatch.plans.shapes import SQL

CORRECT = "CORRECT"
DATABASE = "warehouse"
RUNAWAY_SECONDS = 15.0  # the limit of an item meant to run into it; the others have the caller's

_SEGMENTS = "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"
_NATIONS = "SELECT c_nationkey FROM customer WHERE c_acctbal > 2000"
_BY_BALANCE = "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey"


@dataclass(frozen=True)
class Pair:
    kind: str
    gold: str
    pred: str
    expected: str


CHANGED = [
    Pair("reordered", _SEGMENTS, _SEGMENTS + " ORDER BY n DESC, c_mktsegment", CORRECT),
    Pair("wrong_direction", _BY_BALANCE, _BY_BALANCE.replace("s_acctbal, s_suppkey", "s_acctbal DESC, s_suppkey")
         .replace("SELECT s_suppkey, s_acctbal DESC", "SELECT s_suppkey, s_acctbal"), S.RESULT_SET_MISMATCH),
    Pair("lost_duplicates", _NATIONS, _NATIONS.replace("SELECT", "SELECT DISTINCT"), S.RESULT_SET_MISMATCH),
    Pair("swapped_columns", _SEGMENTS, _SEGMENTS.replace("c_mktsegment, count(*) AS n", "count(*) AS n, c_mktsegment"),
         S.RESULT_SET_MISMATCH),
    Pair("renamed_columns", _SEGMENTS, _SEGMENTS.replace("AS n", "AS customers"), CORRECT),
    Pair("int_vs_double", _SEGMENTS, _SEGMENTS.replace("count(*)", "cast(count(*) AS double)"), CORRECT),
    Pair("number_vs_text", _SEGMENTS, _SEGMENTS.replace("count(*)", "cast(count(*) AS varchar(20))"),
         S.RESULT_SET_MISMATCH),
    Pair("wrong_filter", _NATIONS, _NATIONS.replace("2000", "3000"), S.RESULT_SET_MISMATCH),
    Pair("extra_column", _SEGMENTS, _SEGMENTS.replace("AS n", "AS n, max(c_acctbal) AS top"), S.RESULT_SET_MISMATCH),
    Pair("both_empty", "SELECT c_name FROM customer WHERE c_custkey < 0",
         "SELECT c_name, c_custkey FROM customer WHERE c_custkey < -1", CORRECT),
    Pair("unknown_column", _NATIONS, _NATIONS.replace("c_acctbal", "c_balance"), S.SCHEMA_ERROR),
    Pair("unknown_table", _NATIONS, _NATIONS.replace("FROM customer", "FROM customers"), S.SCHEMA_ERROR),
    Pair("broken_text", _NATIONS, _NATIONS.replace("FROM customer", "FROM"), S.SYNTAX_ERROR),
    Pair("runtime_failure", _NATIONS, "SELECT c_custkey / (c_nationkey - c_nationkey) FROM customer",
         S.EXECUTION_ERROR),
    Pair("write_attempt", _NATIONS, "INSERT INTO customer SELECT * FROM customer", S.EXECUTION_ERROR),
    Pair("runaway", _NATIONS, "SELECT count(*) FROM range(3000000) AS a JOIN range(3000000) AS b ON a.id * 7 + b.id <> 3", S.TIMEOUT),
    Pair("broken_gold", _NATIONS.replace("FROM customer", "FROM clients"), _NATIONS, S.GOLD_SQL_ERROR),
]
CORPUS = [Pair(f"identical_{name[2:]}", sql, sql, CORRECT) for name, sql in SQL.items()] + CHANGED


def pair_items(spark: SparkSession, pairs: list[Pair] = CORPUS) -> DataFrame:
    """The corpus as items; the prediction comes in a fence, as a generator gives it. The gold
    statement of an item with a limit of its own is a quick one."""
    rows = [
        (no, DATABASE, p.kind, p.gold, f"/corpus/{DATABASE}", None, f"```sql\n{p.pred}\n```", RUNAWAY_SECONDS if p.expected == S.TIMEOUT else None)
        for no, p in enumerate(pairs)
    ]
    schema = "item_id long, db_id string, question string, gold_sql string, db_path string, difficulty string, "
    return spark.createDataFrame(rows, schema + "raw_output string, limit_seconds double")


def outcome():
    """Outcome of a sample result in the words of ``Pair.expected``."""
    return (
        F.when(F.col("is_correct"), F.lit(CORRECT))
        .when(F.col("pred_status") != S.SUCCESS, F.col("pred_status"))
        .when(F.col("gold_status") != S.SUCCESS, F.lit(S.GOLD_SQL_ERROR))
        .otherwise(F.lit(S.RESULT_SET_MISMATCH))
    )
