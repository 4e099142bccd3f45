"""Execution statuses and where they come from."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses, report categories and the message parts that decide.
SUCCESS = "SUCCESS"
SYNTAX_ERROR = "SYNTAX_ERROR"
SCHEMA_ERROR = "SCHEMA_ERROR"
TIMEOUT = "TIMEOUT"
EXECUTION_ERROR = "EXECUTION_ERROR"
STATUSES = [SUCCESS, SYNTAX_ERROR, SCHEMA_ERROR, TIMEOUT, EXECUTION_ERROR]
RESULT_MISMATCH = "RESULT_MISMATCH"
RESULT_SET_MISMATCH = "RESULT_SET_MISMATCH"
GOLD_SQL_ERROR = "GOLD_SQL_ERROR"
MESSAGE_PARTS = {
    TIMEOUT: ["interrupt"],
    SCHEMA_ERROR: ["no such table", "no such column"],
    SYNTAX_ERROR: ["syntax error", "incomplete input", "near "],
}
MISSING_DATABASE = "Database file does not exist: "
NOT_EXECUTED = "statement was not executed"

_CONDITIONS = {
    SYNTAX_ERROR: ("PARSE_SYNTAX_ERROR",),
    SCHEMA_ERROR: ("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN"),
    TIMEOUT: ("SPARK_JOB_CANCELLED",),
}


def status_of_message(message: Column) -> Column:
    """Status of a database's error text; null means success."""
    low = F.lower(message)
    out = F.when(message.isNull(), F.lit(SUCCESS))
    for status, parts in MESSAGE_PARTS.items():
        out = out.when(reduce(or_, [F.contains(low, F.lit(p)) for p in parts]), F.lit(status))
    return out.otherwise(F.lit(EXECUTION_ERROR))


def status_of_condition(condition: str | None) -> str:
    """Status of a Spark error condition such as ``UNRESOLVED_COLUMN.WITH_SUGGESTION``."""
    head = (condition or "").split(".")[0]
    for status, names in _CONDITIONS.items():
        if head in names:
            return status
    return EXECUTION_ERROR


def error_category(pred_status: Column) -> Column:
    """Report category of an incorrect item. A failed gold statement with a good
    prediction also counts as a mismatch."""
    return F.when(pred_status != SUCCESS, pred_status).otherwise(F.lit(RESULT_MISMATCH))
