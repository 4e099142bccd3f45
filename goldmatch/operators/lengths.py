"""Text lengths and their distribution.

The measure is declared: words and punctuation marks by default, or any scalar
function, e.g. a pandas UDF around a real tokenizer.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Length bounds and percentiles of the report, the default measure.
THRESHOLDS = [512, 1024, 1536, 2048]
PERCENTILES = [0.5, 0.9, 0.95, 0.99]
MAX_TOKENS = 1024
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"
# White space, or a border of a token: after a mark, or between a word and a mark. The last
# code point, itself a mark, makes the look behind go by code points instead of code units.
_WORD, _MARK = r"[\p{L}\p{M}\p{N}_&&[^%s]]" % chr(0x10FFFF), r"[%s[^\s\p{L}\p{M}\p{N}_]]" % chr(0x10FFFF)
TOKEN_BORDER = rf"\s+|(?<={_MARK})(?!\s|$)|(?<={_WORD})(?={_MARK})"
SKETCH_ERROR = 0.01

Measure = Callable[[Column], Column]


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def python_measure(length_of: Callable[[str], int]) -> Measure:
    """A measure from a Python function, applied to Arrow batches."""

    @F.pandas_udf(T.IntegerType())
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else length_of(t) for t in texts], dtype="Int32")

    return measure


def python_token_count() -> Measure:
    """The default measure in Python; stands for a tokenizer.

    The function is local, so it travels by value and workers need not import it.
    """
    import regex

    pattern = regex.compile(TOKEN.replace(r"\s", r"\t-\r "))

    def length_of(text: str) -> int:
        return sum(1 for _ in pattern.finditer(text))

    return python_measure(length_of)


def text_lengths(df: DataFrame, parts: dict[str, Column], keep: list[str], measure: Measure = token_count) -> DataFrame:
    """One length column per named text."""
    return df.select(*keep, *[measure(c).alias(f"{name}_len") for name, c in parts.items()])


def length_by_part(lengths: DataFrame, keep: list[str], parts: list[str]) -> DataFrame:
    """Wide lengths to (part, len) lines."""
    lines = F.array(
        *[F.struct(F.lit(p).alias("part"), F.col(f"{p}_len").alias("len")) for p in parts]
    )
    return lengths.select(*keep, F.inline(lines))


def length_profile(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, min, mean, median, p90, p95, p99, max; percentiles interpolate.

    A histogram comes first: equal lengths merge before the shuffle, and the final
    task sees distinct lengths, not rows.
    """
    by = by or []
    histogram = lengths.where(F.col("len").isNotNull()).groupBy(*by, "len").agg(
        F.count(F.lit(1)).alias("n")
    )
    return histogram.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min("len").alias("min_len"),
        F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 4).alias("mean_len"),
        *[
            F.round(F.percentile("len", F.lit(p), F.col("n")), 4).alias(name)
            for p, name in zip(PERCENTILES, ["median_len", "p90", "p95", "p99"])
        ],
        F.max("len").alias("max_len"),
    )


def length_coverage(lengths: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """Share of texts within each bound, in percent; one pass, one output line per bound."""
    known = lengths.where(F.col("len").isNotNull())
    counts = known.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("len") <= t).alias(f"le_{t}") for t in thresholds],
    )
    lines = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(f"le_{t}").alias("n_fit")) for t in thresholds]
    )
    return counts.select("n", F.inline(lines)).select(
        "threshold",
        "n_fit",
        F.coalesce(F.try_divide("n_fit", "n") * F.lit(100.0), F.lit(0.0)).alias("coverage_pct"),
    )


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def length_sketch(lengths: DataFrame, by: list[str] | None = None, error: float = SKETCH_ERROR) -> DataFrame:
    """A mergeable quantile sketch of ``len``: ``by, bucket, n, total, low, high``.

    Bucket i counts the lengths in (g^(i-1), g^i] with g = (1 + error) / (1 - error), so
    its middle is within ``error`` of each of them, in proportion; lengths from 0 down are
    bucket -1. A sketch has a line per bucket met, about ln(largest) / (2 error) at most, whatever the
    rows. Null lengths are left out.
    """
    bucket = F.when(F.col("len") <= 0, F.lit(-1)).otherwise(F.ceil(F.ln("len") / F.lit(math.log(_gamma(error)))).cast("int"))
    known = lengths.where(F.col("len").isNotNull()).withColumn("bucket", bucket)
    return known.groupBy(*(by or []), "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), F.min("len").alias("low"), F.max("len").alias("high")
    )


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One sketch from any number of stored ones, made with the same error."""
    return sketches.groupBy(*(by or []), "bucket").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def sketch_profile(sketch: DataFrame, by: list[str] | None = None, error: float = SKETCH_ERROR) -> DataFrame:
    """The fields of :func:`length_profile` from a sketch. n, min, mean and max are exact; a
    percentile is that of the nearest rank below, within ``error`` of it in proportion."""
    by = by or []
    before = Window.partitionBy(*by).orderBy("bucket")
    placed = sketch.withColumn("_upto", F.sum("n").over(before)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    middle = F.lit(2.0) * F.pow(F.lit(_gamma(error)), F.col("bucket")) / F.lit(_gamma(error) + 1)
    value = F.when(F.col("bucket") < 0, F.col("high").cast("double")).otherwise(F.least(F.greatest(middle, "low"), "high"))

    def quantile(p: float, name: str) -> Column:
        rank = F.floor(F.lit(p) * (F.col("_all") - 1))
        return F.round(F.min(F.when(F.col("_upto") > rank, F.struct("bucket", value.alias("v"))))["v"], 4).alias(name)

    return placed.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min("low").alias("min_len"),
        F.round(F.sum("total") / F.sum("n"), 4).alias("mean_len"),
        *[quantile(p, name) for p, name in zip(PERCENTILES, ["median_len", "p90", "p95", "p99"])],
        F.max("high").alias("max_len"),
    )


def token_total(text: Column) -> Column:
    """The number of tokens without a list of them: each becomes one mark, white space goes."""
    return F.length(F.regexp_replace(F.regexp_replace(text, TOKEN, "x"), r"\s+", ""))


def first_tokens(text: Column, n: int) -> Column:
    """The first ``n`` tokens. The text is cut at token borders ``n`` times at most; what
    follows stays one piece and is left out."""
    pieces = F.split(F.regexp_replace(text, r"^\s+", ""), TOKEN_BORDER, n + 1)
    return F.filter(F.slice(pieces, 1, n), lambda x: x != "")


def overlength_cut(df: DataFrame, text: str, keep: list[str], max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Training sequences cut to ``max_tokens`` tokens, with a flag. No list is longer than
    that, whatever the text."""
    counted = df.select(*keep, text, token_total(F.col(text)).alias("n_tokens"))
    return counted.select(
        *keep,
        "n_tokens",
        (F.col("n_tokens") > max_tokens).alias("overlength"),
        first_tokens(F.col(text), max_tokens).alias("tokens"),
    )
