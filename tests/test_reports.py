import json

import pytest
from pyspark.sql import functions as F

from goldmatch.operators import metrics as M
from goldmatch.operators import runs as R
from goldmatch.operators import verdict as V
from goldmatch.plans import workload as W
from goldmatch.sources import reports

# Published results of two runs over 1,034 statements.
BASE = {
    "total_queries": 1034, "correct_queries": 607, "valid_sql_queries": 809,
    "execution_accuracy": 0.5870406189555126, "valid_sql_rate": 0.7823984526112185,
    "tier_accuracy": {"easy": [406, 311], "medium": [303, 153], "hard": [166, 86], "extra": [159, 57]},
    "query_type_accuracy": {"single_table": [252, 180], "join": [331, 146], "aggregation": [292, 224], "nested": [159, 57]},
    "error_breakdown": {"SCHEMA_ERROR": 196, "RESULT_MISMATCH": 202, "EXECUTION_ERROR": 27, "TIMEOUT": 1, "SYNTAX_ERROR": 1},
}
TUNED = {
    "total_queries": 1034, "correct_queries": 587, "valid_sql_queries": 835,
    "execution_accuracy": 0.5676982591876208, "valid_sql_rate": 0.8075435203094777,
    "tier_accuracy": {"easy": [406, 286], "medium": [303, 152], "extra": [159, 66], "hard": [166, 83]},
    "query_type_accuracy": {"aggregation": [292, 199], "single_table": [252, 168], "nested": [159, 66], "join": [331, 154]},
    "error_breakdown": {"SCHEMA_ERROR": 194, "RESULT_MISMATCH": 248, "SYNTAX_ERROR": 1, "EXECUTION_ERROR": 4},
}


def stored(spark, path, run):
    full = dict(run)
    for name in ("tier_accuracy", "query_type_accuracy"):
        full[name] = {k: {"total": t, "correct": c, "accuracy": c / t} for k, (t, c) in run[name].items()}
    path.write_text(json.dumps(full, indent=2))
    return reports.read_metrics_json(spark, str(path))


@pytest.fixture(scope="module")
def two_runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    return stored(spark, folder / "a.json", BASE), stored(spark, folder / "b.json", TUNED)


def sample(item_id, difficulty, query_type, correct, status):
    return (item_id, difficulty, query_type, correct, "SUCCESS", status)


SAMPLES = "item_id long, difficulty string, query_type string, is_correct boolean, gold_status string, pred_status string"


@pytest.fixture(scope="module")
def several(spark):
    rows = [
        sample(3, "medium", "nested", True, "SUCCESS"),
        sample(5, "medium", "nested", False, "TIMEOUT"),
        sample(6, "medium", "aggregation", True, "SUCCESS"),
        sample(8, "extra", "nested", False, "SUCCESS"),
        sample(9, "extra", "nested", False, "SYNTAX_ERROR"),
    ]
    return spark.createDataFrame(rows, SAMPLES)


def test_metrics_of_samples(several):
    o = M.overall_metrics(several).first()
    assert (o.total_queries, o.correct_queries, o.valid_sql_queries) == (5, 2, 3)
    assert (o.execution_accuracy, o.valid_sql_rate) == (2 / 5, 3 / 5)
    assert {r.difficulty: (r.total, r.correct, r.accuracy) for r in M.tier_metrics(several).collect()} == {
        "medium": (3, 2, 2 / 3), "extra": (2, 0, 0.0),
    }
    assert {r.category: r.n for r in M.error_breakdown(several).collect()} == {"TIMEOUT": 1, "SYNTAX_ERROR": 1, "RESULT_MISMATCH": 1}
    table = {r.label: (r.total, r.correct, r.accuracy) for r in M.tier_table(several).collect()}
    assert list(table) == ["Easy", "Medium", "Hard", "Extra", "OVERALL"]
    assert table["Medium"] == (3, 2, "66.67%") and table["Hard"] == (0, 0, "0.00%") and table["OVERALL"] == (5, 2, "40.00%")
    labels = [r.label for r in M.type_table(several).collect()]
    assert labels == ["Single table", "Join", "Aggregation", "Nested"]


def test_empty_input_gives_zeros(spark):
    empty = spark.createDataFrame([], SAMPLES)
    assert tuple(M.overall_metrics(empty).first()) == (0, 0, 0, 0.0, 0.0)
    assert M.error_breakdown(empty).count() == 0
    assert [r.total for r in M.tier_table(empty).collect()] == [0] * 5


def test_stored_runs_side_by_side(two_runs):
    a, b = (reports.metrics_of(r) for r in two_runs)
    tiers = [(r.label, r.baseline_text, r.candidate_text, r.delta_text, r.flag) for r in R.compare_runs_tier(a, b).collect()]
    assert tiers == [
        ("Easy", "76.60% (311/406)", "70.44% (286/406)", "-6.16%", "flat"),
        ("Medium", "50.50% (153/303)", "50.17% (152/303)", "-0.33%", "flat"),
        ("Hard", "51.81% (86/166)", "50.00% (83/166)", "-1.81%", "flat"),
        ("Extra", "35.85% (57/159)", "41.51% (66/159)", "+5.66%", "big_win"),
    ]
    types = [(r.label, r.delta_text, r.flag) for r in R.compare_runs_type(a, b).collect()]
    assert types == [
        ("Join", "+2.42%", "up"), ("Nested", "+5.66%", "big_win"), ("Single table", "-4.76%", "flat"), ("Aggregation", "-8.56%", "flat"),
    ]


def test_stored_errors_side_by_side(two_runs):
    a, b = (reports.errors_stored(r) for r in two_runs)
    got = [tuple(r) for r in R.compare_runs_errors(a, b).collect()]
    assert got == [
        ("EXECUTION_ERROR", 27, 4, -23, "good"), ("RESULT_MISMATCH", 202, 248, 46, "other"),
        ("SCHEMA_ERROR", 196, 194, -2, "good"), ("SYNTAX_ERROR", 1, 1, 0, "other"), ("TIMEOUT", 1, 0, -1, "good"),
    ]
    overall = [tuple(r) for r in R.compare_runs_overall(two_runs[0], a, two_runs[1], b).collect()]
    assert overall == [
        ("valid_sql_rate", "78.24%", "80.75%", "+2.51%"),
        ("execution_accuracy", "58.70%", "56.77%", "-1.93%"),
        ("execution_crashes", "27", "4", "-85.19%"),
    ]


@pytest.mark.parametrize("run", [BASE, TUNED])
def test_stored_runs_keep_the_invariants(spark, tmp_path, run):
    check_invariants(
        reports.metrics_of(stored(spark, tmp_path / "m.json", run)),
        reports.errors_stored(stored(spark, tmp_path / "e.json", run)),
        run["valid_sql_queries"],
    )


def check_invariants(long, errors, valid):
    total = {r.dimension: (r.t, r.c) for r in long.groupBy("dimension").agg(F.sum("total").alias("t"), F.sum("correct").alias("c")).collect()}
    assert total["overall"] == total["difficulty"] == total["query_type"]
    n, correct = total["overall"]
    found = {r.category: r.n for r in errors.collect()}
    assert sum(found.values()) == n - correct
    assert sum(v for k, v in found.items() if k != "RESULT_MISMATCH") == n - valid


def test_derived_runs_keep_the_invariants(table):
    for run in ("a", "b"):
        samples = W.samples(table, run)
        check_invariants(M.metrics_long(samples), M.error_breakdown(samples), M.overall_metrics(samples).first().valid_sql_queries)


def test_report_files(spark, several, tmp_path):
    full = several.select(*[F.col(c) if c in several.columns else F.lit(None).cast("double" if c == "execution_time_ms" else "string").alias(c) for c in V.SAMPLE_FIELDS])
    reports.write_report_json(full, f"{tmp_path}/report")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/report/samples").collect()]
    assert len(lines) == 5 and set(lines[0]) == set(V.SAMPLE_FIELDS) and lines[0]["error_message"] is None
    summary = json.loads(spark.read.text(f"{tmp_path}/report/summary").first().value)
    assert summary["tier_accuracy"]["extra"] == {"total": 2, "correct": 0, "accuracy": 0.0}
    assert summary["error_breakdown"] == {"TIMEOUT": 1, "SYNTAX_ERROR": 1, "RESULT_MISMATCH": 1} and len(summary) == 8
    back = reports.read_metrics_json(spark, f"{tmp_path}/report/summary")
    assert reports.metrics_of(back).count() == 5
    assert reports.read_samples_json(spark, f"{tmp_path}/report/samples").count() == 5


def test_verdict_precedence(spark):
    items = spark.createDataFrame(
        [(i, "d", "q", sql, "p", None, "SELECT 1") for i, sql in enumerate(["SELECT a FROM t"] * 5 + ["SELECT a FROM t ORDER BY a"] * 2)],
        "item_id long, db_id string, question string, gold_sql string, db_path string, difficulty string, raw_output string",
    )
    log = [
        (0, "SUCCESS", None, "SUCCESS", None), (1, "SCHEMA_ERROR", "no such table: g", "TIMEOUT", "interrupted"),
        (2, "SCHEMA_ERROR", "no such table: g", "SUCCESS", None), (3, "SUCCESS", None, "SUCCESS", None),
        (4, "SUCCESS", None, "SUCCESS", None), (5, "SUCCESS", None, "SUCCESS", None), (6, "SUCCESS", None, "SUCCESS", None),
    ]
    executions = spark.createDataFrame(
        [(i, side, s, m, 1.5) for i, gs, gm, ps, pm in log for side, s, m in (("gold", gs, gm), ("pred", ps, pm))],
        "item_id long, side string, status string, error_message string, execution_time_ms double",
    )
    differing = spark.createDataFrame([(3, False), (4, True), (5, True)], "item_id long, same_bag boolean")
    out = V.sample_results(items, V.executed_pairs(executions), differing).orderBy("item_id").collect()
    assert [(r.is_correct, r.error_message) for r in out] == [
        (True, None), (False, "TIMEOUT: interrupted"), (False, "GOLD_SQL_ERROR: no such table: g"),
        (False, "RESULT_SET_MISMATCH"), (True, None), (False, "RESULT_SET_MISMATCH"), (True, None),
    ]
    errors = {r.category: r.n for r in M.error_breakdown(V.sample_results(items, V.executed_pairs(executions), differing)).collect()}
    assert errors == {"TIMEOUT": 1, "RESULT_MISMATCH": 3}


def test_remaining_and_limit(spark):
    items = spark.range(10).withColumnRenamed("id", "item_id")
    done = spark.createDataFrame([(1,), (1,), (3,)], "item_id long")
    assert V.remaining_items(items, done).count() == 8
    assert [r.item_id for r in V.limit_items(items, 3).collect()] == [0, 1, 2]
    assert V.limit_items(items, 0).count() == V.limit_items(items, None).count() == 10


def test_exists_guard(spark):
    items = spark.createDataFrame([(1, "here", "/r/here.sqlite"), (2, "gone", "/r/gone.sqlite")], "item_id long, db_id string, db_path string")
    known = spark.createDataFrame([("here",)], "db_id string")
    out = {r.item_id: (r.guard_status, r.guard_message, r.guard_time_ms) for r in V.exists_guard(items, known).collect()}
    assert out == {1: (None, None, None), 2: ("EXECUTION_ERROR", "Database file does not exist: /r/gone.sqlite", 0.0)}
