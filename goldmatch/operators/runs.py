"""Two runs side by side.

Inputs are the small long-form frames of one run: ``metrics`` (dimension, key,
total, correct, accuracy) and ``errors`` (category, n), computed from a fact table
or read from a stored metrics file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmatch.functions import statuses as S
from goldmatch.functions.numbers import fixed2, percent_delta
from goldmatch.functions.text import label
from goldmatch.operators.metrics import fixed_keys

# Row order of the two reports and the bound of a big win.
TIER_ORDER = ["easy", "medium", "hard", "extra"]
TYPE_ORDER = ["join", "nested", "single_table", "aggregation"]
BIG_WIN_POINTS = 4


def _compare(base: DataFrame, cand: DataFrame, dimension: str, keys: list[str]) -> DataFrame:
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.where(F.col("dimension") == dimension).select(
            "key",
            (F.col("accuracy") * F.lit(100.0)).alias(f"{prefix}_pct"),
            F.concat(
                fixed2(F.col("accuracy") * F.lit(100.0)),
                F.lit("% ("),
                F.col("correct").cast("string"),
                F.lit("/"),
                F.col("total").cast("string"),
                F.lit(")"),
            ).alias(f"{prefix}_text"),
        )

    delta = F.col("candidate_pct") - F.col("baseline_pct")
    joined = (
        fixed_keys(base, keys)
        .join(side(base, "baseline"), "key", "left")
        .join(side(cand, "candidate"), "key", "left")
        .fillna(0.0, [f"{p}_pct" for p in ("baseline", "candidate")])
        .fillna("0.00% (0/0)", [f"{p}_text" for p in ("baseline", "candidate")])
    )
    return joined.select(
        "position",
        "key",
        label(F.col("key")).alias("label"),
        "baseline_text",
        "candidate_text",
        percent_delta(delta).alias("delta_text"),
        F.when(delta > BIG_WIN_POINTS, "big_win").when(delta > 0, "up").otherwise("flat").alias("flag"),
    ).orderBy("position")


def compare_runs_tier(base: DataFrame, cand: DataFrame) -> DataFrame:
    return _compare(base, cand, "difficulty", TIER_ORDER)


def compare_runs_type(base: DataFrame, cand: DataFrame) -> DataFrame:
    return _compare(base, cand, "query_type", TYPE_ORDER)


def compare_runs_errors(base: DataFrame, cand: DataFrame) -> DataFrame:
    """All categories of either run; an absent one counts 0."""
    a = base.select("category", F.col("n").alias("baseline"))
    b = cand.select("category", F.col("n").alias("candidate"))
    both = a.join(b, "category", "full_outer").select(
        "category",
        F.coalesce("baseline", F.lit(0)).alias("baseline"),
        F.coalesce("candidate", F.lit(0)).alias("candidate"),
    )
    delta = F.col("candidate") - F.col("baseline")
    return both.select(
        "category",
        "baseline",
        "candidate",
        delta.alias("delta"),
        F.when(delta < 0, "good").otherwise("other").alias("flag"),
    ).orderBy("category")


def _one_run(overall: DataFrame, errors: DataFrame, run: str) -> DataFrame:
    crashes = errors.where(F.col("category") == S.EXECUTION_ERROR).select(
        F.lit(run).alias("run"),
        F.lit(None).cast("double").alias("valid"),
        F.lit(None).cast("double").alias("accuracy"),
        F.col("n").alias("crashes"),
    )
    rates = overall.select(
        F.lit(run).alias("run"),
        (F.col("valid_sql_rate") * F.lit(100.0)).alias("valid"),
        (F.col("execution_accuracy") * F.lit(100.0)).alias("accuracy"),
        F.lit(0).cast("long").alias("crashes"),
    )
    return rates.unionByName(crashes)


def compare_runs_overall(
    base: DataFrame, base_errors: DataFrame, cand: DataFrame, cand_errors: DataFrame
) -> DataFrame:
    """Valid rate, accuracy and crashes before and after, one line each.

    The one-line aggregates are stacked and folded, not cross joined. The crash
    change is computed.
    """
    stacked = _one_run(base, base_errors, "b").unionByName(_one_run(cand, cand_errors, "c"))
    both = stacked.agg(
        *[
            F.max(F.when(F.col("run") == run, F.col(part))).alias(f"{run}_{part}")
            for run in ("b", "c")
            for part in ("valid", "accuracy", "crashes")
        ]
    )
    change = F.try_divide((F.col("c_crashes") - F.col("b_crashes")) * F.lit(100.0), F.col("b_crashes"))

    def line(name: str, b, c, d):
        return F.struct(F.lit(name).alias("metric"), b.alias("baseline"), c.alias("candidate"), d.alias("delta"))

    def rate(name: str, part: str):
        b, c = F.col(f"b_{part}"), F.col(f"c_{part}")
        return line(
            name,
            F.concat(fixed2(b), F.lit("%")),
            F.concat(fixed2(c), F.lit("%")),
            percent_delta(c - b),
        )

    lines = F.array(
        rate("valid_sql_rate", "valid"),
        rate("execution_accuracy", "accuracy"),
        line(
            "execution_crashes",
            F.col("b_crashes").cast("string"),
            F.col("c_crashes").cast("string"),
            percent_delta(change),
        ),
    )
    return both.select(F.inline(lines))
