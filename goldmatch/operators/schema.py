"""Catalog tables to schema text.

``columns``: db_id, table_no, table_name, cid, name, data_type, not_null,
default_value, pk. ``fks``: db_id, table_no, table_name, fk_no, from_column,
to_table, to_column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tables a database keeps for itself.
INTERNAL_TABLES = ["sqlite_sequence", "sqlite_stat1", "sqlite_master"]
DEFAULT_TYPE = "TEXT"


def drop_internal_tables(df: DataFrame) -> DataFrame:
    return df.where(~F.col("table_name").isin(INTERNAL_TABLES))


def normalize_types(columns: DataFrame) -> DataFrame:
    """Upper-case types, TEXT where none is declared, flags as booleans."""
    return columns.select(
        "db_id",
        "table_no",
        "table_name",
        "cid",
        "name",
        F.upper(F.coalesce(F.nullif("data_type", F.lit("")), F.lit(DEFAULT_TYPE))).alias("data_type"),
        (F.col("not_null") != 0).alias("not_null"),
        "default_value",
        (F.col("pk") != 0).alias("is_primary_key"),
    )


def normalize_fks(fks: DataFrame) -> DataFrame:
    """The target column defaults to the source column; no source, no key."""
    return fks.where(F.col("from_column").isNotNull()).withColumn(
        "to_column", F.coalesce(F.nullif("to_column", F.lit("")), F.col("from_column"))
    )


def primary_keys(columns: DataFrame) -> DataFrame:
    """Key columns per table in column order, joined by comma."""
    keys = columns.where("is_primary_key").groupBy("db_id", "table_name")
    ordered = F.array_sort(F.collect_list(F.struct("cid", "name")))
    return keys.agg(F.array_join(F.transform(ordered, lambda c: c["name"]), ", ").alias("primary_keys"))


def table_ddl(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """One CREATE TABLE text per table. A group is one table's catalog entry.

    Columns and foreign keys are stacked and grouped once instead of joined.
    """
    stacked = columns.select(
        "db_id", "table_no", "table_name",
        F.struct(F.col("cid").alias("no"), "name", "data_type", "is_primary_key").alias("col"),
        F.lit(None).cast("struct<no:int,line:string>").alias("fk"),
    ).unionByName(
        fks.select(
            "db_id", "table_no", "table_name",
            F.lit(None)
            .cast("struct<no:int,name:string,data_type:string,is_primary_key:boolean>")
            .alias("col"),
            F.struct(
                F.col("fk_no").alias("no"),
                F.concat(
                    F.lit("    FOREIGN KEY ("), "from_column", F.lit(") REFERENCES "),
                    "to_table", F.lit("("), "to_column", F.lit(")"),
                ).alias("line"),
            ).alias("fk"),
        )
    )
    grouped = stacked.groupBy("db_id", "table_no", "table_name").agg(
        F.array_sort(F.collect_list("col")).alias("cols"),
        F.array_sort(F.collect_list("fk")).alias("fks"),
    ).where(F.size("cols") > 0)
    pks = F.transform(F.filter("cols", lambda c: c["is_primary_key"]), lambda c: c["name"])
    with_keys = grouped.withColumn("pks", pks)
    single = F.size("pks") == 1
    column_lines = F.transform(
        "cols",
        lambda c: F.concat(
            F.lit("    "), c["name"], F.lit(" "), c["data_type"],
            F.when(single & c["is_primary_key"], F.lit(" PRIMARY KEY")).otherwise(F.lit("")),
        ),
    )
    key_line = F.when(
        F.size("pks") > 1,
        F.array(F.concat(F.lit("    PRIMARY KEY ("), F.array_join("pks", ", "), F.lit(")"))),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(column_lines, key_line, F.transform("fks", lambda f: f["line"]))
    return with_keys.select(
        "db_id", "table_no", "table_name",
        F.concat(
            F.lit("CREATE TABLE "), "table_name", F.lit(" (\n"), F.array_join(lines, ",\n"), F.lit("\n);")
        ).alias("ddl"),
    )


def render_ddl(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """One schema text per database, tables in catalog order."""
    tables = F.array_sort(F.collect_list(F.struct("table_no", "table_name", "ddl")))
    return table_ddl(columns, fks).groupBy("db_id").agg(
        F.array_join(F.transform(tables, lambda t: t["ddl"]), "\n\n").alias("ddl")
    )


def schema_text(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """Raw catalog tables to schema text: cleaning and rendering in one go."""
    return render_ddl(
        normalize_types(drop_internal_tables(columns)), normalize_fks(drop_internal_tables(fks))
    )


def attach_schema(items: DataFrame, ddl: DataFrame) -> DataFrame:
    """Schema text per item, ``''`` where the database is unknown.

    Pass ``ddl`` through :func:`goldmatch.session.dimension`, which decides about a
    broadcast by its size.
    """
    text = ddl.select("db_id", F.col("ddl").alias("_ddl"))
    return items.join(text, "db_id", "left").select(
        *[items[c] for c in items.columns],
        F.coalesce("_ddl", F.lit("")).alias("schema_ddl"),
    )
