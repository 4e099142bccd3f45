import re
import importlib.util
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from goldmatch.operators import compare, metrics, verdict
from goldmatch.plans import shapes
from goldmatch.plans import workload as W
from goldmatch.session import dimension, scratch_path, written
from goldmatch.sources import reports
from goldmatch.streaming.incremental import evaluated, incremental_eval

spec = importlib.util.spec_from_file_location("check_oracle", Path(entry.__file__).parent / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

# The rest is compared by tools/check_oracle.py; these stand for every group.
COMPARED = [
    "execution_times", "statement_timeout", "incremental_eval", "folder_inventory", "missing_folders", "catalog_columns", "catalog_ddl",
    "length_profile_sketch", "canonical_cells", "truncated_results",
    "load_items_union", "split_labelled_scan", "write_samples_jsonl", "write_report_json", "read_metrics_json",
    "normalize_types", "normalize_fks", "overlength_cut", "ordered_compare", "bag_compare_by_name",
    "compare_runs_errors", "leakage_audit", "tier_table", "metrics_long", "length_by_part", "render_ddl",
    "key_profile", "fk_orphans", "cap_result_rows", "normalize_cells", "classify_errors", "extract_sql",
    "chat_messages", "render_tool_calls", "merge_tool_turns", "percent_format", "with_predictions",
    *shapes.SHAPES,
]


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", COMPARED)
def test_query_agrees_with_sql(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert len(want) and check.difference(got, want) is None


def test_registry_is_consistent():
    optional = re.compile(r"op\d+_|pipeline$")
    without_sql = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not optional.match(n)}
    assert without_sql == set()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_not_in_has_three_values(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    ids = lambda df: sorted((r.k for r in df.collect()), key=str)
    listed = spark.createDataFrame([(1,)], "v int")
    assert ids(shapes.not_in(left, "k", listed, "v")) == [2]
    assert ids(shapes.not_in(left, "k", listed.where("v > 1"), "v")) == [1, 2, None]
    assert ids(shapes.not_in(left, "k", spark.createDataFrame([(1,), (None,)], "v int"), "v")) == []


def test_not_in_is_one_lazy_plan(spark, table):
    tracker, _ = spark.sparkContext.statusTracker(), [table(name) for name in ("part", "lineitem")]  # footers are read
    spark.sparkContext.setJobGroup("lazy", "no job before the action")
    try:
        df = shapes.q_not_in_subquery(table)
        assert "Subquery" in plan(df) and not tracker.getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_shapes_avoid_products_and_push_down(table):
    for name in ("q_comma_join", "q_not_in_subquery", "q_in_subquery", "q_correlated", "q_multi_join", "q_except"):
        text = plan(shapes.SHAPES[name](table))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
    text = plan(shapes.q_filter_project(table))
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double,c_mktsegment:string>" in text
    assert "TakeOrderedAndProject" in plan(shapes.q_top_k(table))
    assert "GreaterThan(l_quantity,45.0)" in plan(shapes.q_and_or_predicates(table))


def test_evaluation_stays_out_of_python_and_prunes_texts(table):
    text = plan(metrics.metrics_long(W.samples(table)))
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    # the joins carry tags, not statements
    joins = [block for block in text.split("\n\n") if "HashJoin" in block or "SortMergeJoin" in block]
    assert joins and not any("gold_sql" in block or "raw_output" in block for block in joins)


def test_comparison_moves_rows_once(table):
    text = plan(compare.differing_items(W.result_rows(table)))
    assert text.split("== Physical Plan ==")[1].split("\n\n")[0].count("Exchange") == 1


def test_written_survives(spark, table):
    df = written(spark.range(10).withColumn("r", F.rand()), "t")
    assert df.collect() == df.collect()


def test_dimension_is_broadcast_by_its_real_size(spark):
    facts = spark.range(1000).select((F.col("id") % 7).alias("k"))
    texts = spark.range(7).select(F.col("id").alias("k"), F.repeat(F.lit("same text "), 10000).alias("v"))
    small, large = dimension(texts, "t"), dimension(texts, "t", max_bytes=1000)
    for df, join in ((small, "BroadcastHashJoin"), (large, "SortMergeJoin")):
        joined = facts.join(df.withColumn("w", F.lit(1)), "k", "left")
        assert join in plan(joined) and joined.count() == 1000


def test_incremental_run_resumes(spark, table):
    root = scratch_path(spark, "stream")
    joined = written(verdict.joined_pairs(W.items(table), W.executed(table), compare.differing_items(W.result_rows(table))), "joined")
    half = F.col("item_id") % 2 == 0
    joined.where(half).repartition(3).write.parquet(f"{root}/source")
    args = (spark, f"{root}/source", joined.schema, verdict.finished, f"{root}/sink", f"{root}/checkpoint", 2)

    def interrupted(batch):
        verdict.finished(batch).count()
        raise RuntimeError("stopped")

    with pytest.raises(Exception):
        incremental_eval(*args[:3], interrupted, *args[4:])
    assert incremental_eval(*args) == 2
    assert incremental_eval(*args) == 0
    joined.where(~half).repartition(2).write.mode("append").parquet(f"{root}/source")
    assert incremental_eval(*args) == 1
    done = evaluated(spark, f"{root}/sink", reports.SAMPLE_SCHEMA)
    assert done.count() == done.select("item_id").distinct().count() == joined.count() == 1500
    key = lambda df: sorted(map(tuple, df.select("dimension", "key", "total", "correct", "valid").collect()))
    assert key(metrics.metrics_long(done)) == key(metrics.metrics_long(W.samples(table)))


def test_more_batches_than_recent_progress_holds(spark):
    root = scratch_path(spark, "many")
    spark.range(0, 120, 1, 120).write.parquet(f"{root}/in")
    n = incremental_eval(spark, f"{root}/in", "id long", lambda b: b, f"{root}/out", f"{root}/checkpoint", files_per_batch=1)
    assert n == 120 and evaluated(spark, f"{root}/out", "id long").count() == 120
