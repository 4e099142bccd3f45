"""Facts about SQL text, as built-in column expressions (no Python worker)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldmatch.functions.text import strip

# Patterns, markers and tier bounds that decide the tags.
# A word character is any letter, number or underscore, white space is Unicode's.
# Java's own classes for both differ between releases, so they are spelled out. The
# boundary before a word is tested after its first letter has matched; tested
# first, it would cost a Unicode lookup at every position of the text.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _word(text: str) -> str:
    """Pattern of a whole word, like ``\\bTEXT\\b``."""
    return rf"{_starts(text)}(?!{WORD})"


def _starts(text: str) -> str:
    """Pattern of a word's start, like ``\\bTEXT``."""
    return rf"{text[0]}(?<!{WORD}{text[0]}){text[1:]}"


ORDER_BY = rf"(?iu){_starts('order')}{SPACE}+by(?!{WORD})"
SELECT_WORD = _word("SELECT")
CLAUSE_END = "|".join(_word(w) for w in ["WHERE", "GROUP", "ORDER", "LIMIT"])
FROM_LIST = rf"{_starts('FROM')}{SPACE}+([^;]+?)(?:{CLAUSE_END}|$)"
FROM_COMMA = rf"{_starts('FROM')}{SPACE}+[^,;]+,[^,;]+"
AND_OR = rf"(?:{_word('AND')}|{_word('OR')})"
FENCE = r"(?isu)```(?:sql)?\s*(.*?)\s*```"
STATEMENT = rf"(?isu)({_starts('WITH')}.+?SELECT.+|{_starts('SELECT')}.+)"
JOIN_MARK = " JOIN "
AGGREGATE_MARKS = ["COUNT(", "SUM(", "AVG(", "MIN(", "MAX("]
SET_MARKS = [" UNION ", " EXCEPT ", " INTERSECT "]
QUERY_TYPES = ["single_table", "join", "aggregation", "nested"]
TIERS = ["easy", "medium", "hard", "extra"]
EASY_UP_TO, MEDIUM_UP_TO = 1, 3


def _any(text: Column, marks: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(m)) for m in marks])


def order_sensitive(sql: Column) -> Column:
    """Does the text contain ORDER BY anywhere, also in a subquery?"""
    return F.rlike(sql, F.lit(ORDER_BY))


def select_count(up: Column) -> Column:
    """Number of SELECT words in an upper-case statement."""
    return F.regexp_count(up, F.lit(SELECT_WORD))


def query_type(up: Column, n_select: Column) -> Column:
    """nested, join, aggregation or single_table; the first that applies."""
    from_list = F.regexp_extract(up, FROM_LIST, 1)
    return (
        F.when(n_select > 1, F.lit("nested"))
        .when(F.contains(up, F.lit(JOIN_MARK)) | F.contains(from_list, F.lit(",")), F.lit("join"))
        .when(_any(up, [*AGGREGATE_MARKS, "GROUP BY", "HAVING"]), F.lit("aggregation"))
        .otherwise(F.lit("single_table"))
    )


def complexity(up: Column, n_select: Column) -> Column:
    """Additive score of a plain statement; null for nested ones and set operations."""
    joins = F.contains(up, F.lit(JOIN_MARK)) | F.rlike(up, F.lit(FROM_COMMA))
    score = (
        2 * joins.cast("int")
        + F.contains(up, F.lit("GROUP BY")).cast("int")
        + F.contains(up, F.lit("ORDER BY")).cast("int")
        + _any(up, AGGREGATE_MARKS).cast("int")
        + F.regexp_count(up, F.lit(AND_OR))
    )
    return F.when((n_select <= 1) & ~_any(up, SET_MARKS), score)


def tier_of(score: Column) -> Column:
    """easy, medium or hard by score; extra where there is none."""
    return (
        F.when(score <= EASY_UP_TO, F.lit("easy"))
        .when(score <= MEDIUM_UP_TO, F.lit("medium"))
        .when(score.isNotNull(), F.lit("hard"))
        .otherwise(F.lit("extra"))
    )


def extract_sql(raw: Column) -> Column:
    """SQL out of a generator's answer: fenced block, else statement, else all.

    An empty fence yields the empty text, so a match is tested by ``rlike`` and
    not by the extracted value; only texts with a mark of one are looked through for that. A
    statement is never empty, so one search both tests and extracts it.
    """
    text = strip(raw)
    fenced = F.contains(text, F.lit("```")) & F.rlike(text, F.lit(FENCE))
    found = F.when(fenced, F.regexp_extract(text, FENCE, 1)).otherwise(
        F.coalesce(F.regexp_substr(text, F.lit(STATEMENT)), text)
    )
    body = strip(F.substring_index(strip(found), "```", 1))
    return F.when(
        body.endswith(";"), strip(F.substr(body, F.lit(1), F.length(body) - 1))
    ).otherwise(body)
