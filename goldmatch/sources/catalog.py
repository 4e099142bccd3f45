"""The catalog of databases in use: columns, types, nullability and keys of their tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Database = dict[str, Callable[[SparkSession], DataFrame]]
Keys = dict[str, list[str]]
Edges = list[tuple[str, str, str, str]]

COLUMNS = "db_id string, table_no int, table_name string, cid int, name string, data_type string, not_null int, default_value string, pk int"
FKS = "db_id string, table_no int, table_name string, fk_no int, from_column string, to_table string, to_column string"


def catalog_columns(spark: SparkSession, databases: dict[str, Database], keys: Keys | None = None, observe: bool = False) -> DataFrame:
    """A line per column, in the form :mod:`goldmatch.operators.schema` takes.

    Tables go by their order in the database, types are Spark's own names. ``not_null`` is
    what the schema says; files can't say it, so with ``observe`` it is whether the column
    holds no null, which reads every table once. ``keys`` names the key columns of a table.
    Only schemas pass the driver.
    """
    lines, seen = [], []
    for db_id, tables in databases.items():
        for no, (table, read) in enumerate(tables.items()):
            df = read(spark)
            key = (keys or {}).get(table, [])
            for cid, f in enumerate(df.schema.fields):
                pk = key.index(f.name) + 1 if f.name in key else 0
                lines.append((db_id, no, table, cid, f.name, f.dataType.simpleString(), int(not f.nullable), None, pk))
            if observe and df.columns:
                plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
                full = [F.struct(F.lit(i).alias("cid"), (F.count(F.lit(1)) == F.count(c)).cast("int").alias("seen")) for i, c in enumerate(plain.columns)]
                counted = plain.agg(F.array(*full).alias("c")).select(F.inline("c"))
                seen.append(counted.select(F.lit(db_id).alias("db_id"), F.lit(table).alias("table_name"), "cid", "seen"))
    columns = spark.createDataFrame(lines, COLUMNS)
    if not seen:
        return columns
    joined = columns.join(reduce(DataFrame.union, seen), ["db_id", "table_name", "cid"], "left")
    return joined.withColumn("not_null", F.coalesce("seen", "not_null")).select(*columns.columns)


def catalog_fks(spark: SparkSession, databases: dict[str, Database], edges: Edges) -> DataFrame:
    """A line per foreign key ``(table, column, to_table, to_column)`` whose two tables a database has."""
    lines = [
        (db_id, list(tables).index(table), table, no, column, to_table, to_column)
        for db_id, tables in databases.items()
        for no, (table, column, to_table, to_column) in enumerate(edges)
        if table in tables and to_table in tables
    ]
    return spark.createDataFrame(lines, FKS)
