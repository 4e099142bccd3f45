"""The whole path in one call: schema, prompt, generation, extraction, execution, comparison, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmatch.functions import prompts as P
from goldmatch.operators import predict
from goldmatch.operators.schema import attach_schema, schema_text
from goldmatch.plans.evaluate import Database, evaluate
from goldmatch.session import dimension
from goldmatch.sources import catalog, reports


def benchmark(
    items: DataFrame,
    databases: dict[str, Database],
    make_generator: Callable[[], Callable[[str], str]],
    run_path: str,
    keys: catalog.Keys | None = None,
    edges: catalog.Edges | None = None,
    demonstrations: bool = True,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(sample results, execution log); the report lies below ``run_path``/report.

    Prompts hold the schema text of the tables in use. The generator is asked once per
    item: answers are stored with the run, so a run that was cut off and is called again
    neither generates nor executes anew what it has. ``options`` are those of
    :func:`goldmatch.plans.evaluate.evaluate`.
    """
    spark = items.sparkSession
    columns = catalog.catalog_columns(spark, databases, keys)
    ddl = dimension(schema_text(columns, catalog.catalog_fks(spark, databases, edges or [])), "ddl")
    messages = P.chat_messages(F.col("schema_ddl"), F.col("question"), demonstrations=demonstrations)
    asked = attach_schema(items, ddl).withColumn("prompt", P.chatml_prompt(messages)).drop("schema_ddl")
    samples, log = evaluate(predict.with_predictions(asked, make_generator), databases, run_path=run_path, **options)
    reports.write_report_json(samples, f"{run_path}/report", mode="overwrite")
    return samples, log
