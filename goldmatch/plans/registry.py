"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from math import ceil

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from goldmatch.functions import cells as C
from goldmatch.functions import prompts as P
from goldmatch.functions import sqltext
from goldmatch.functions.numbers import percent, percent_delta
from goldmatch.operators import chat, compare, keys, lengths, metrics, predict, runs, schema, split, tags, verdict
from goldmatch.operators.ordinals import row_ordinals
from goldmatch.plans import pairs as PC
from goldmatch.plans import workload as W
from goldmatch.plans.evaluate import Runner, Statement, evaluate, parquet_database
from goldmatch.plans.shapes import SHAPES, SQL
from goldmatch.session import dimension, mounted_path, scratch_path, written
from goldmatch.sources import catalog, inventory, items, reports, samples
from goldmatch.streaming.incremental import evaluated, incremental_eval, incremental_items

Query = Callable[[SparkSession, str], DataFrame]

FIRST_ITEMS, ROW_CAP, BATCHES, ITEM_FILES = 1000, 3, 2, 4
FOLDERS_PER_TASK = 1000  # creating a file takes far longer than its line
NO_FOLDER_NAME, ESCAPED = "__HIVE_DEFAULT_PARTITION__", r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]"  # as Spark writes partitions
PAIR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_QUERIES: dict[str, Query] = {}


def query(f: Callable[[W.Table], DataFrame]) -> Callable[[W.Table], DataFrame]:
    """Register ``f(table)`` under its name."""
    _QUERIES[f.__name__] = lambda spark, sf_dir: f(W.tables(spark, sf_dir))
    return f


def _spark(t: W.Table) -> SparkSession:
    return t("region").sparkSession


def _md5(c):
    return F.md5(c)


# --- sources and sinks -------------------------------------------------------


@query
def load_items(t):
    path = scratch_path(_spark(t), "split") + "/dev.json"
    items.write_split_files(W.items(t), path)
    return items.load_items(_spark(t), [path], W.DB_ROOT)


@query
def load_items_union(t):
    root = scratch_path(_spark(t), "split")
    done = t("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("item_id"))
    items.write_split_files(W.items(t).join(done, "item_id", "left_semi"), f"{root}/train.json")
    items.write_split_files(W.items(t).join(done, "item_id", "left_anti"), f"{root}/train_others.json")
    loaded = items.load_split(_spark(t), root, "train", include_others=True)
    return loaded.select("item_id", "db_id", "question", "gold_sql", "difficulty")


def _training(t):
    """Items with split and schema text."""
    ddl = dimension(schema.schema_text(W.schema_columns(t), W.schema_fks(t)), "ddl")
    return schema.attach_schema(split.group_split(W.items(t), "db_id"), ddl)


def _stored_samples(t) -> str:
    path = scratch_path(_spark(t), "samples")
    samples.write_samples_jsonl(samples.sft_samples(_training(t)), path)
    return path


@query
def split_labelled_scan(t):
    both = samples.read_labelled_splits(_spark(t), _stored_samples(t), {"train": "train", "val": "validation"})
    return both.select(
        "item_id", "db_id", "difficulty", "split",
        F.size("messages").cast("long").alias("n_messages"),
        _md5(F.get("messages", F.lit(1))["content"]).alias("user_md5"),
        F.get("messages", F.lit(2))["content"].alias("answer"),
    )


@query
def source_inventory(t):
    """The rule for database files, on the items' paths and on paths beside them that
    do not name their folder."""
    beside = F.regexp_replace("db_path", r"db_(\d+)\.sqlite$", "old_$1.sqlite")
    files = W.items(t).select(F.explode(F.array(F.col("db_path"), beside)).alias("path"))
    return inventory.databases_of(files, F.col("path"))


def _folder_maker(roots: list[str]) -> Callable[[Iterable[Row]], None]:
    """A function for foreachPartition: a folder of Spark's form with one file, below each root,
    for every name. A task that runs again writes the same files again."""

    def make(rows: Iterable[Row]) -> None:
        file, begun = f"part-{TaskContext.get().partitionId():05d}.json", set()
        for row in rows:
            name = re.sub(ESCAPED, lambda m: f"%{ord(m[0]):02X}", row.db_id) if row.db_id else NO_FOLDER_NAME
            for root in roots:
                folder = f"{root}/db_id={name}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{file}", "a" if name in begun else "w", encoding="utf-8") as f:
                    f.write(f"{row.line}\n")
            begun.add(name)

    return make


def _write_folders(names: DataFrame, *paths: str, per_task: int = FOLDERS_PER_TASK) -> None:
    """Below each path a folder ``db_id=<name>`` with one file for each of the distinct
    ``names``, made by as many tasks as there are folders for.

    Where the file system is mounted, the tasks make them in place: Hadoop's local files take
    a process each for their permissions, and the driver moves every folder at the end. All
    paths are filled at once, since new folders of one parent wait for each other.
    """
    tasks = max(1, ceil(names.count() * len(paths) / per_task))
    dealt = names.withColumn("named", F.col("db_id")).repartition(tasks, "db_id")
    roots = [mounted_path(names.sparkSession, path) for path in paths]
    if None in roots:
        for path in paths:
            dealt.write.partitionBy("db_id").json(path)
        return
    for root in roots:
        os.makedirs(root, exist_ok=True)
    dealt.select("db_id", F.to_json(F.struct("named")).alias("line")).foreachPartition(_folder_maker(roots))


@query
def folder_inventory(t):
    """A real folder: a file per database of the items, and copies where they do not count."""
    root = scratch_path(_spark(t), "corpus")
    found = written(W.items(t).select("db_id").distinct(), "names")
    # files are named by task, so the folder alone names the database here
    _write_folders(found, *(f"{root}/{place}" for place in ("database", "backup/database", "database/old")))
    return inventory.source_inventory(_spark(t), root, "database/db_id=*/*.json", r"^database/db_id=([^/]+)/[^/]+$")


@query
def missing_folders(t):
    """Databases of the items without a folder: those whose orders are all finished have none."""
    root, items_ = scratch_path(_spark(t), "corpus"), W.items(t)
    open_ = t("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("item_id"))
    present = items_.join(open_, "item_id", "left_semi").where("difficulty = 'hard'").select("db_id").distinct()
    _write_folders(written(present, "names"), f"{root}/database")
    _write_folders(written(items_.select("db_id").distinct(), "names"), f"{root}/database/copy")
    found = inventory.source_inventory(_spark(t), root, "database/db_id=*/*.json", r"^database/db_id=([^/]+)/[^/]+$")
    return inventory.missing_required(items_, found, "db_id")


@query
def missing_required(t):
    present = t("lineitem").where(F.col("l_quantity") > 40).select(F.col("l_partkey").alias("p_partkey"))
    return inventory.missing_required(t("part"), present, "p_partkey")


@query
def write_samples_jsonl(t):
    lines = _spark(t).read.text(_stored_samples(t))
    return lines.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.contains("value", F.lit('"difficulty":null'))).alias("n_null_difficulty"),
    )


@query
def write_report_json(t):
    path = scratch_path(_spark(t), "report")
    reports.write_report_json(W.samples(t), path)
    return reports.read_samples_json(_spark(t), f"{path}/samples")


@query
def read_metrics_json(t):
    path = scratch_path(_spark(t), "metrics")
    reports.write_metrics_json(W.samples(t), path)
    stored = reports.read_metrics_json(_spark(t), path)
    errors = reports.errors_stored(stored).select(
        F.lit("error").alias("dimension"), F.col("category").alias("key"), F.col("n").alias("total"),
        F.lit(0).cast("long").alias("correct"), F.lit(0.0).alias("accuracy"),
    )
    return reports.metrics_of(stored).unionByName(errors)


def _warehouse(t):
    """The given tables as one database."""
    return {PC.DATABASE: {name: (lambda _, name=name: t(name)) for name in W.GIVEN_TABLES}}


@query
def catalog_columns(t):
    """Columns, types and observed nullability of the given tables themselves."""
    columns = catalog.catalog_columns(_spark(t), _warehouse(t), W.DATA_KEYS, observe=True)
    return schema.normalize_types(columns).select("table_name", "cid", "name", "data_type", "not_null", "is_primary_key")


@query
def catalog_ddl(t):
    """Schema text of the given tables themselves."""
    columns = catalog.catalog_columns(_spark(t), _warehouse(t), W.DATA_KEYS)
    return schema.schema_text(columns, catalog.catalog_fks(_spark(t), _warehouse(t), W.DATA_EDGES))


# --- projections and filters -------------------------------------------------


@query
def drop_internal_tables(t):
    return schema.drop_internal_tables(W.schema_columns(t)).select("db_id", "table_name", "cid", "name")


@query
def normalize_types(t):
    return schema.normalize_types(W.schema_columns(t)).drop("table_no", "default_value")


@query
def normalize_fks(t):
    return schema.normalize_fks(W.schema_fks(t)).drop("table_no")


@query
def order_sensitive(t):
    return W.items(t).select("item_id", sqltext.order_sensitive(F.col("gold_sql")).alias("order_sensitive"))


def _differing(t, run="a"):
    return compare.differing_items(W.result_rows(t, run))


@query
def sample_verdict(t):
    judged = verdict.sample_verdict(W.items(t), W.executed(t), _differing(t))
    return judged.select("item_id", "is_correct", "gold_status", "pred_status", "error_message")


@query
def difficulty_or_estimate(t):
    return tags.with_difficulty(W.items(t)).select("item_id", "difficulty")


@query
def exists_guard(t):
    return verdict.exists_guard(W.items(t), dimension(W.inventory(t), "inventory")).select(
        "item_id", "db_id", "guard_status", "guard_message", "guard_time_ms"
    )


@query
def overlength_cut(t):
    cut = lengths.overlength_cut(t("documents").select("doc_id", "text"), "text", ["doc_id"])
    return cut.select(
        "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "overlength",
        F.size("tokens").cast("long").alias("n_kept"), _md5(F.array_join("tokens", " ")).alias("kept_md5"),
    )


# --- joins -------------------------------------------------------------------


@query
def attach_schema(t):
    ddl = dimension(schema.schema_text(W.schema_columns(t), W.schema_fks(t)), "ddl")
    return schema.attach_schema(W.items(t), ddl).select(
        "item_id", "db_id", F.length("schema_ddl").cast("long").alias("ddl_chars"), _md5(F.col("schema_ddl")).alias("ddl_md5")
    )


@query
def ordered_compare(t):
    return compare.ordered_compare(W.items(t), W.result_rows(t))


@query
def bag_compare(t):
    return compare.bag_compare(W.items(t), W.result_rows(t))


@query
def bag_compare_by_name(t):
    """The prediction has its columns in another order; aligned by name it is judged
    as in ``bag_compare``."""
    cell = lambda i: F.get("cells", F.lit(i))
    named = lambda *pairs: F.array(
        *[F.struct(F.lit(n).alias("name"), cell(i).alias("cell")) for n, i in pairs]
    )
    columns = F.when(
        F.col("side") == "gold", named(("part", 0), ("price", 1), ("flag", 2))
    ).otherwise(named(("FLAG", 2), ("Part", 0), ("price", 1)))
    rows = W.result_rows(t).select("item_id", "side", "row_no", C.cells_by_name(columns).alias("cells"))
    return compare.bag_compare(W.items(t), rows)


@query
def remaining_items(t):
    done = t("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("item_id"))
    return verdict.remaining_items(W.items(t), done).select("item_id", "gold_sql")


def _long(t, run):
    return metrics.metrics_long(W.samples(t, run))


def _errors(t, run):
    return metrics.error_breakdown(W.samples(t, run))


@query
def compare_runs_tier(t):
    return runs.compare_runs_tier(_long(t, "a"), _long(t, "b"))


@query
def compare_runs_type(t):
    return runs.compare_runs_type(_long(t, "a"), _long(t, "b"))


@query
def compare_runs_errors(t):
    return runs.compare_runs_errors(_errors(t, "a"), _errors(t, "b"))


@query
def compare_runs_overall(t):
    a, b = (written(metrics.metric_cells(W.samples(t, run)), "cells") for run in ("a", "b"))
    return runs.compare_runs_overall(
        metrics.overall_of(a), metrics.errors_of(a), metrics.overall_of(b), metrics.errors_of(b)
    )


@query
def leakage_audit(t):
    halves = split.group_split(t("documents").select("doc_id", "source"), "source")
    return split.leakage_audit(halves, "source")


# --- aggregations ------------------------------------------------------------


@query
def overall_metrics(t):
    return metrics.overall_metrics(W.samples(t))


@query
def tier_metrics(t):
    return metrics.tier_metrics(W.samples(t))


@query
def type_metrics(t):
    return metrics.type_metrics(W.samples(t))


@query
def metrics_long(t):
    return _long(t, "a")


@query
def error_breakdown(t):
    return _errors(t, "a")


@query
def tier_table(t):
    return metrics.tier_table(W.samples(t))


@query
def type_table(t):
    return metrics.type_table(W.samples(t))


def _token_lengths(t):
    docs = t("documents").select("text").select(F.lit("documents").alias("part"), "text")
    talk = t("conversations").select("text").select(F.lit("conversations").alias("part"), "text")
    return docs.unionByName(talk).select("part", lengths.token_count(F.col("text")).cast("long").alias("len"))


@query
def length_profile(t):
    return lengths.length_profile(_token_lengths(t), ["part"])


@query
def length_profile_sketch(t):
    """One stored sketch per batch of texts, merged; every source is a batch."""
    path = scratch_path(_spark(t), "sketches")
    docs = t("documents").select(F.lit("documents").alias("part"), F.coalesce("source", F.lit("")).alias("batch"), "text")
    talk = t("conversations").select(F.lit("conversations").alias("part"), F.coalesce("role", F.lit("")).alias("batch"), "text")
    for texts in (docs, talk):
        measured = texts.select("part", "batch", lengths.token_count(F.col("text")).cast("long").alias("len"))
        lengths.length_sketch(measured, ["batch", "part"]).write.mode("append").partitionBy("batch").parquet(path)
    stored = _spark(t).read.parquet(path)
    return lengths.sketch_profile(lengths.merge_sketches(stored, ["part"]), ["part"])


@query
def length_coverage(t):
    docs = t("documents").select("text")
    measured = docs.select(lengths.token_count(F.col("text")).cast("long").alias("len"))
    return lengths.length_coverage(measured)


@query
def length_by_part(t):
    """Full sample text, question and statement of every item; texts by role."""
    training = samples.sft_samples(_training(t)).withColumn(
        "full", P.chatml_prompt(F.col("messages"))
    )
    parts = {"full": F.col("full"), "question": F.col("question"), "sql": F.col("gold_sql")}
    wide = lengths.text_lengths(training, parts, [], lambda c: F.length(c).cast("long"))
    sample_parts = lengths.length_by_part(wide, [], list(parts))
    roles = t("conversations").select(F.col("role").alias("part"), F.length("text").cast("long").alias("len"))
    return lengths.length_profile(sample_parts.unionByName(roles), ["part"])


@query
def render_ddl(t):
    return schema.schema_text(W.schema_columns(t), W.schema_fks(t))


@query
def primary_keys(t):
    return schema.primary_keys(schema.normalize_types(schema.drop_internal_tables(W.schema_columns(t))))


@query
def distinct_databases(t):
    return split.distinct_databases(W.items(t))


@query
def split_counts(t):
    return split.split_counts(split.group_split(W.items(t), "db_id"))


@query
def key_profile(t):
    return keys.profile_tables(t, W.DATA_KEYS)


@query
def fk_orphans(t):
    return keys.orphan_report(t, W.DATA_EDGES)


# --- splits, sorts, limits ---------------------------------------------------


@query
def group_split(t):
    return split.group_split(t("documents").select("doc_id", "source"), "source")


@query
def limit_items(t):
    return verdict.limit_items(W.items(t), FIRST_ITEMS).select("item_id", "gold_sql")


@query
def cap_result_rows(t):
    """The rows kept, with the flag of their result."""
    value = lambda i: F.substr(F.get("cells", F.lit(i)), F.lit(3))
    return compare.capped_results(W.result_rows(t), ROW_CAP).select(
        "item_id", "side", "row_no", value(0).cast("long").alias("part"), value(1).cast("double").alias("price"), value(2).alias("flag"), "truncated"
    )


@query
def truncated_results(t):
    return compare.truncated_results(W.result_rows(t), ROW_CAP)


@query
def row_ordinals_(t):
    lines = t("lineitem").select("l_orderkey", *W.LINE_ORDER)
    return row_ordinals(lines, ["l_orderkey"], W.LINE_ORDER)


_QUERIES["row_ordinals"] = _QUERIES.pop("row_ordinals_")


@query
def ordered_category_report(t):
    return metrics.ordered_categories(W.samples(t))


@query
def union_categories(t):
    return metrics.union_categories(W.samples(t, "a"), W.samples(t, "b"))


# --- execution and cells -----------------------------------------------------


def evaluate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    databases = {PC.DATABASE: parquet_database(sf_dir, PAIR_TABLES)}
    results, _ = evaluate(PC.pair_items(spark), databases, timeout_seconds=600.0)
    return results.select(
        F.col("question").alias("kind"), PC.outcome().alias("outcome"), "difficulty", "query_type",
        "is_correct", "gold_status", "pred_status",
    )


def execution_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times differ from run to run; that every statement has one does not."""
    runner = Runner(spark, {PC.DATABASE: parquet_database(sf_dir, PAIR_TABLES)}, timeout_seconds=600.0)
    log, _ = runner.run([Statement(i, "gold", PC.DATABASE, sql) for i, sql in enumerate(SQL.values())])
    return log.select("item_id", "side", "status", (F.col("execution_time_ms") > 0).alias("timed"))


# Every triple of line items is looked at: a statement that ends at no size worth a test.
ENDLESS = (
    "SELECT count(*) AS n FROM lineitem AS a, lineitem AS b, lineitem AS c "
    "WHERE a.l_extendedprice * b.l_discount + c.l_tax <> a.l_quantity - b.l_tax * c.l_extendedprice"
)


def statement_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that cannot keep its limit, next to one that has no need to."""
    runner = Runner(spark, {PC.DATABASE: parquet_database(sf_dir, PAIR_TABLES)}, timeout_seconds=600.0)
    statements = [Statement(0, "gold", PC.DATABASE, SQL["q_group_agg"]), Statement(0, "pred", PC.DATABASE, ENDLESS, limit_seconds=3.0)]
    log, _ = runner.run(statements)
    return log.select("item_id", "side", "status")


def incremental_eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair corpus as a stream of items: executed, judged and reported from the sink."""
    root, given = scratch_path(spark, "stream"), PC.pair_items(spark)
    given.repartition(ITEM_FILES, "item_id").write.parquet(f"{root}/source")
    databases = {PC.DATABASE: parquet_database(sf_dir, PAIR_TABLES)}
    incremental_items(
        spark, f"{root}/source", given.schema, databases, f"{root}/sink", f"{root}/checkpoint",
        files_per_batch=ITEM_FILES // BATCHES, timeout_seconds=600.0,
    )
    return metrics.metrics_long(evaluated(spark, f"{root}/sink/samples", reports.SAMPLE_SCHEMA))


_QUERIES |= {f.__name__: f for f in (evaluate_pairs, execution_times, statement_timeout)}
_QUERIES["incremental_eval"] = incremental_eval_items


@query
def normalize_cells(t):
    lines = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
        F.concat(F.lit("\t "), F.col("l_returnflag"), F.lit(" \n")).alias("flag"),
        F.col("l_shipdate").cast("string").alias("shipped"),
    )
    types = {f.name: f.dataType for f in lines.schema.fields}
    return lines.select(*[C.normalize_value(F.col(c), types[c]).alias(c) for c in lines.columns])


@query
def canonical_cells(t):
    """Tagged texts of cells of every family, nested ones too."""
    lines = t("lineitem")
    flags = F.array(F.concat(F.lit(" "), F.col("l_returnflag")), F.when(F.col("l_linenumber") > 3, F.col("l_linestatus")))
    values = {
        "wide": F.col("l_orderkey").cast("double") * 1e14,
        "exact": (F.col("l_partkey").cast("decimal(20,0)") * F.lit("123456789.123456").cast("decimal(18,6)")),
        "real": F.col("l_extendedprice") * F.col("l_discount"),
        "since": F.col("l_shipdate") - F.lit("1992-01-01 00:00:00").cast("timestamp_ntz"),
        "flags": flags,
        "named": F.create_map(F.lit("tax"), F.col("l_tax"), F.lit("qty"), F.col("l_quantity")),
        "nested": F.struct(F.col("l_suppkey").alias("s"), flags.alias("f")),
    }
    wide = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in values.items()])
    types = {f.name: f.dataType for f in wide.schema.fields}
    return wide.select(*[C.canonical_cell(F.col(c), types[c]).alias(c) if c in values else F.col(c) for c in wide.columns])


@query
def classify_errors(t):
    return verdict.classify_errors(W.execution_log(t)).select("item_id", "side", "status", "error_message")


# --- text --------------------------------------------------------------------


@query
def extract_sql(t):
    return W.items(t).select("item_id", sqltext.extract_sql(F.col("raw_output")).alias("predicted_sql"))


@query
def classify_query_type(t):
    return tags.with_query_type(W.items(t)).select("item_id", "query_type")


@query
def estimate_difficulty(t):
    return tags.with_difficulty(W.items(t), annotated=None).select("item_id", "difficulty")


def _with_ddl(t):
    ddl = dimension(schema.schema_text(W.schema_columns(t), W.schema_fks(t)), "ddl")
    return schema.attach_schema(W.items(t), ddl)


@query
def user_content(t):
    content = P.user_content(F.col("schema_ddl"), F.col("question"))
    return _with_ddl(t).select("item_id", _md5(content).alias("content_md5"))


@query
def chat_messages(t):
    out = _with_ddl(t).select(
        "item_id",
        P.chat_messages(F.col("schema_ddl"), F.col("question")).alias("few"),
        P.chat_messages(F.col("schema_ddl"), F.col("question"), demonstrations=False).alias("none"),
    )
    joined = F.array_join(F.transform("few", lambda m: F.concat_ws("=", m["role"], m["content"])), "|")
    return out.select(
        "item_id", F.size("few").cast("long").alias("n_few"), F.size("none").cast("long").alias("n_none"),
        _md5(joined).alias("few_md5"),
    )


@query
def chatml_prompt(t):
    messages = P.chat_messages(F.col("schema_ddl"), F.col("question"))
    return _with_ddl(t).select("item_id", P.chatml_prompt(messages).alias("prompt")).select(
        "item_id", F.length("prompt").cast("long").alias("prompt_chars"), _md5(F.col("prompt")).alias("prompt_md5")
    )


@query
def sft_samples(t):
    return samples.sft_samples(_training(t)).select(
        "item_id", "db_id", "question", "gold_sql", "difficulty", "split",
        F.size("messages").cast("long").alias("n_messages"),
        _md5(F.get("messages", F.lit(1))["content"]).alias("user_md5"),
        F.get("messages", F.lit(2))["content"].alias("answer"),
    )


@query
def render_conversations(t):
    return chat.render_conversations(W.talk_turns(t), add_generation_prompt=True)


@query
def render_tool_calls(t):
    return chat.render_conversations(W.chat_turns(t), tools=W.TOOLS)


@query
def merge_tool_turns(t):
    return chat.merge_tool_turns(W.chat_turns(t))


@query
def text_lengths(t):
    docs = t("documents").select("doc_id", "text")
    return docs.select(
        "doc_id", lengths.token_count(F.col("text")).cast("long").alias("n_tokens"),
        F.length("text").cast("long").alias("n_chars"),
    )


@query
def percent_format(t):
    """Accuracy per database as text, and its distance from one half."""
    per_db = metrics.group_of(
        W.samples(t).groupBy("db_id").agg(
            F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct")
        ),
        "db_id",
    )
    points = F.col("accuracy") * F.lit(100.0) - F.lit(50.0)
    return per_db.select(
        "db_id", percent(F.col("accuracy")).alias("accuracy_text"), percent_delta(points).alias("delta_text")
    )


@query
def status_strings(t):
    return W.samples(t).groupBy("gold_status", "pred_status").agg(F.count(F.lit(1)).alias("n"))


# --- streaming and Python functions ------------------------------------------


@query
def incremental_verdicts(t):
    """Pairs that were executed before, judged as a stream."""
    spark = _spark(t)
    root = scratch_path(spark, "incremental")
    joined = verdict.joined_pairs(W.items(t), W.executed(t), _differing(t))
    joined.write.parquet(f"{root}/source")
    n_files = len(spark.read.schema(joined.schema).parquet(f"{root}/source").inputFiles())
    incremental_eval(
        spark, f"{root}/source", joined.schema, verdict.finished, f"{root}/sink", f"{root}/checkpoint",
        files_per_batch=max(1, n_files // BATCHES),
    )
    done = evaluated(spark, f"{root}/sink", reports.SAMPLE_SCHEMA)
    return metrics.metrics_long(done)


@query
def with_predictions(t):
    """The generator is a double that answers with the prompt's question, in a fence."""

    def make_generator():
        def answer(prompt: str) -> str:
            asked = prompt.rsplit("### Question:\n", 1)[1].split("\n", 1)[0]
            return f"```sql\nSELECT '{asked}';\n```"

        return answer

    prompts = _with_ddl(t).select(
        "item_id", P.chatml_prompt(P.chat_messages(F.col("schema_ddl"), F.col("question"))).alias("prompt")
    )
    answered = predict.with_predictions(prompts, make_generator)
    return answered.select(
        "item_id", "raw_output", sqltext.extract_sql(F.col("raw_output")).alias("predicted_sql")
    )


@query
def length_udf(t):
    measure = lengths.python_token_count()
    docs = t("documents").select("doc_id", "text")
    return docs.select("doc_id", measure(F.col("text")).cast("long").alias("n_tokens"))


_QUERIES |= {name: (lambda spark, sf_dir, f=f: f(W.tables(spark, sf_dir))) for name, f in SHAPES.items()}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
