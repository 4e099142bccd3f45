"""A pluggable generator applied to prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Generator = Callable[[str], str]


def with_predictions(
    df: DataFrame,
    make_generator: Callable[[], Generator],
    prompt: str = "prompt",
    output: str = "raw_output",
) -> DataFrame:
    """Adds the generator's answer to every prompt.

    ``make_generator`` runs once per task and may load a model; batches then flow
    through it as Arrow data. Only the prompt column crosses to Python.
    """

    @F.pandas_udf(T.StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = make_generator()
        for prompts in batches:
            yield prompts.map(answer, na_action="ignore")

    return df.withColumn(output, generate(F.col(prompt)))
