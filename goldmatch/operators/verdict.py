"""From executions and comparisons to one verdict per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmatch.functions import sqltext
from goldmatch.functions import statuses as S
from goldmatch.operators.tags import with_sql_tags

SAMPLE_FIELDS = [
    "item_id",
    "db_id",
    "question",
    "gold_sql",
    "predicted_sql",
    "difficulty",
    "query_type",
    "is_correct",
    "gold_status",
    "pred_status",
    "error_message",
    "execution_time_ms",
]


def exists_guard(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Status of items whose database is not in the inventory; null status = go on.

    Pass the inventory through :func:`goldmatch.session.dimension`, which decides
    about a broadcast by its size.
    """
    known = inventory.select("db_id").distinct().withColumn("_known", F.lit(True))
    missing = F.col("_known").isNull()
    return items.join(known, "db_id", "left").select(
        *[items[c] for c in items.columns],
        F.when(missing, F.lit(S.EXECUTION_ERROR)).alias("guard_status"),
        F.when(missing, F.concat(F.lit(S.MISSING_DATABASE), F.col("db_path"))).alias("guard_message"),
        F.when(missing, F.lit(0.0)).alias("guard_time_ms"),
    )


def classify_errors(log: DataFrame) -> DataFrame:
    """Error texts of an execution log to statuses."""
    return log.withColumn("status", S.status_of_message(F.col("error_message")))


def executed_pairs(executions: DataFrame) -> DataFrame:
    """One line per item from one line per (item, side)."""

    def of(side: str, column: str):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return executions.groupBy("item_id").agg(
        of("gold", "status").alias("gold_status"),
        of("gold", "error_message").alias("gold_message"),
        of("pred", "status").alias("pred_status"),
        of("pred", "error_message").alias("pred_message"),
        of("pred", "execution_time_ms").alias("execution_time_ms"),
    )


def joined_pairs(items: DataFrame, pairs: DataFrame, differing: DataFrame) -> DataFrame:
    """items ⨝ executed pairs ⨝ differing results.

    All three have one line per item, so the joins cannot skew. What is read from
    the texts is computed first: a report that needs only tags then moves tags
    through the joins, and the texts are pruned from the scan's output. A side without
    a log line counts as failed, so no item vanishes from the totals.
    """
    read = with_sql_tags(items).withColumns(
        {
            "_ordered": sqltext.order_sensitive(F.col("gold_sql")),
            "predicted_sql": sqltext.extract_sql(F.col("raw_output")),
        }
    )
    joined = read.join(pairs, "item_id", "left").join(differing, "item_id", "left")
    absent = {s: F.col(f"{s}_status").isNull() for s in ("gold", "pred")}
    messages = {f"{s}_message": F.when(no, F.lit(S.NOT_EXECUTED)).otherwise(F.col(f"{s}_message")) for s, no in absent.items()}
    statuses = {f"{s}_status": F.coalesce(f"{s}_status", F.lit(S.EXECUTION_ERROR)) for s in absent}
    return joined.withColumns(messages | statuses | {"execution_time_ms": F.coalesce("execution_time_ms", F.lit(0.0))})


def judge(joined: DataFrame) -> DataFrame:
    """is_correct and error_message of joined pairs.

    A failed prediction comes before a failed gold statement, which comes before
    a mismatch. Only two successful executions can be correct.
    """
    same = (
        F.when(F.col("same_bag").isNull(), F.lit(True))
        .when(F.col("_ordered"), F.lit(False))
        .otherwise(F.col("same_bag"))
    )
    pred_ok = F.col("pred_status") == S.SUCCESS
    gold_ok = F.col("gold_status") == S.SUCCESS
    return (
        joined.withColumn("is_correct", pred_ok & gold_ok & same)
        .withColumn(
            "error_message",
            F.when(~pred_ok, F.concat_ws(": ", "pred_status", "pred_message"))
            .when(~gold_ok, F.concat(F.lit(S.GOLD_SQL_ERROR + ": "), F.col("gold_message")))
            .when(~F.col("is_correct"), F.lit(S.RESULT_SET_MISMATCH)),
        )
        .drop("same_bag", "_ordered", "gold_message", "pred_message")
    )


def sample_verdict(items: DataFrame, pairs: DataFrame, differing: DataFrame) -> DataFrame:
    return judge(joined_pairs(items, pairs, differing))


def finished(joined: DataFrame) -> DataFrame:
    """Joined pairs to the twelve fields of a sample result."""
    return judge(joined).select(*SAMPLE_FIELDS)


def sample_results(items: DataFrame, pairs: DataFrame, differing: DataFrame) -> DataFrame:
    """The fact table of all reports: twelve fields per item."""
    return finished(joined_pairs(items, pairs, differing))


def remaining_items(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a finished result."""
    return items.join(done.select("item_id").distinct(), "item_id", "left_anti")


def limit_items(items: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` items in id order; none or 0 keeps all."""
    return items.orderBy("item_id").limit(n) if n else items
