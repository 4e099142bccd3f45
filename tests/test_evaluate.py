from pathlib import Path

import pytest
from pyspark.sql import functions as F

from goldmatch.functions import prompts as P
from goldmatch.operators import metrics as M
from goldmatch.operators import predict
from goldmatch.operators import verdict as V
from goldmatch.operators.compare import differing_items
from goldmatch.operators.verdict import executed_pairs
from goldmatch.plans import evaluate as E
from goldmatch.plans import pairs as PC
from goldmatch.plans.benchmark import benchmark
from goldmatch.plans.evaluate import Runner, Statement, evaluate, parquet_database
from goldmatch.plans.ledger import ROW_SCHEMA, Ledger
from goldmatch.plans.registry import PAIR_TABLES
from goldmatch.sources import items, reports
from goldmatch.streaming.incremental import evaluated, incremental_items

SMALL = "/root/testdata/sf0.001"


def seeds(s):
    return s.createDataFrame([(1, "Kale", 0.31416), (2, " Leek ", 6.25), (3, "Chard", 14.0)], "id int, name string, grams double")


@pytest.fixture(scope="module")
def runner(spark):
    return Runner(spark, {"shop": {"seeds": seeds}}, timeout_seconds=60)


def run_one(runner, sql, db_id="shop"):
    Runner.__post_init__(runner)  # a fresh run folder
    log, rows = runner.run([Statement(0, "gold", db_id, sql)])
    line = log.first()
    return line.status, [tuple(r.cells) for r in rows.orderBy("row_no").collect()], line


def test_rows_are_normalised(runner):
    assert run_one(runner, "SELECT id, name FROM seeds WHERE id = 1;")[:2] == ("SUCCESS", [("n:1", "s:Kale")])
    assert run_one(runner, "SELECT name, grams FROM seeds WHERE id = 2")[:2] == ("SUCCESS", [("s:Leek", "n:6.25")])
    assert run_one(runner, "SELECT id, id FROM seeds ORDER BY id DESC -- two equal names")[1][0] == ("n:3", "n:3")


@pytest.mark.parametrize(
    "sql,status",
    [
        ("SELECT id WHERE FROM seeds", "SYNTAX_ERROR"),
        ("SELECT colour FROM seeds", "SCHEMA_ERROR"),
        ("SELECT * FROM nowhere", "SCHEMA_ERROR"),
        ("INSERT INTO seeds SELECT 9, 'Okra', 1.5", "EXECUTION_ERROR"),
        ("DROP VIEW seeds", "EXECUTION_ERROR"),
        ("SELECT grams seeds FROM", "SYNTAX_ERROR"),
        ("SELECT id / (id - id) FROM seeds", "EXECUTION_ERROR"),
        ("SELECT name FROM seeds GROUP BY id", "EXECUTION_ERROR"),
        ("", "SYNTAX_ERROR"),
    ],
)
def test_failures(runner, sql, status):
    got, rows, line = run_one(runner, sql)
    assert (got, rows) == (status, []) and line.error_message and line.execution_time_ms >= 0


def test_commands_have_no_effect(runner):
    for sql in ("DROP VIEW seeds", "CREATE OR REPLACE TEMP VIEW seeds AS SELECT 1 AS id"):
        run_one(runner, sql)
    assert run_one(runner, "SELECT count(grams) FROM seeds")[1] == [("n:3",)]


def test_unknown_database(runner):
    status, _, line = run_one(runner, "SELECT 1", "elsewhere")
    assert (status, line.error_message, line.execution_time_ms) == ("EXECUTION_ERROR", "Database file does not exist: elsewhere", 0.0)


ENDLESS_RANGE = "SELECT count(*) FROM range(3000000) a JOIN range(3000000) b ON a.id * 7 + b.id <> 3"


def test_runaway_statement_is_stopped(spark):
    runner = Runner(spark, {"d": {}}, timeout_seconds=1.0)
    log, _ = runner.run([Statement(0, "pred", "d", ENDLESS_RANGE)])
    line = log.first()
    assert line.status == "TIMEOUT" and line.execution_time_ms < 20000
    after = Runner(spark, {"d": {}}, timeout_seconds=60).run([Statement(0, "pred", "d", "SELECT 1")])[0]
    assert after.first().status == "SUCCESS"


def test_row_numbers_follow_a_distributed_sort(spark):
    runner = Runner(spark, {"d": {}}, timeout_seconds=60)
    _, rows = runner.run([Statement(0, "gold", "d", "SELECT id FROM range(0, 20000, 1, 8) ORDER BY id DESC")])
    got = rows.orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(20000))
    assert [r.cells[0] for r in got] == [f"n:{19999 - i}" for i in range(20000)]


def test_row_cap(spark):
    pairs = [("SELECT id FROM range(100) ORDER BY id", "SELECT id FROM range(5) ORDER BY id"), ("SELECT 1", "SELECT 1")]
    data = [(i, "d", "", gold, pred, "easy") for i, (gold, pred) in enumerate(pairs)]
    table = spark.createDataFrame(data, "item_id long, db_id string, question string, gold_sql string, raw_output string, difficulty string")
    for cap, want in ((5, [(True, True), (True, False)]), (6, [(False, True), (True, False)]), (100, [(False, False), (True, False)])):
        got, _ = evaluate(table, {"d": {}}, timeout_seconds=60, max_rows=cap)
        assert [(r.is_correct, r.truncated) for r in got.orderBy("item_id").collect()] == want


def test_commands_are_refused(runner):
    for sql in ("RESET", "CLEAR CACHE", "USE default", "REFRESH seeds", "SHOW TABLES", "DESCRIBE seeds", "SET a=b", "EXPLAIN SELECT 1"):
        assert run_one(runner, sql)[:2] == ("EXECUTION_ERROR", []), sql


SHORT_TASKS = "SELECT sum(hash(a.id * b.id)) FROM range(0, 40000, 1, 8000) a JOIN range(100000) b ON a.id + b.id <> 3"


def with_neighbours(spark, sql):
    quick = [Statement(i, "pred", "d", f"SELECT sum(id) FROM range({i}000)") for i in range(1, 8)]
    log, _ = Runner(spark, {"d": {}}, timeout_seconds=10.0).run([Statement(0, "pred", "d", sql, limit_seconds=12.0), *quick])
    lines = {r.item_id: r for r in log.collect()}
    assert {i: r.status for i, r in lines.items()} == {0: "TIMEOUT"} | {i: "SUCCESS" for i in range(1, 8)}
    return max(lines[i].execution_time_ms for i in range(1, 8))


def test_waiting_is_not_a_timeout(spark):
    """Tasks that run long hold all slots until their statement's limit; waiting for them does not count."""
    with_neighbours(spark, ENDLESS_RANGE)


def test_pools_share_the_slots(spark):
    """Where tasks end, the next slots go to the neighbours first."""
    assert with_neighbours(spark, SHORT_TASKS) < 11_000


MANY_STAGES = "SELECT " + " + ".join(f"(SELECT count(*) FROM range({i + 10}) WHERE id % {i + 2} = 1)" for i in range(300))
ON_THE_DRIVER = "SELECT aggregate(sequence(1, 9000), 0L, (a, x) -> a + aggregate(sequence(1, 9000), 0L, (b, y) -> b + x * y % 7)) AS s"


@pytest.mark.parametrize("sql,seconds", [(MANY_STAGES, 1.0), (MANY_STAGES, 0.5), (ON_THE_DRIVER, 1.0), (ENDLESS_RANGE, 1.0)])
def test_the_limit_holds(spark, sql, seconds):
    """Many short stages, time spent while planning, one long stage: all end within twice the limit."""
    log, _ = Runner(spark, {"d": {}}, timeout_seconds=seconds).run([Statement(0, "pred", "d", sql)])
    line = log.first()
    assert line.status == "TIMEOUT" and line.execution_time_ms < 2000 * seconds + 300


def test_statements_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 2)
    log, rows = Runner(spark, {"d": {}}, timeout_seconds=60).run(Statement(i, "gold", "d", f"SELECT {i}") for i in range(5))
    assert log.count() == 5 and sorted(r.cells[0] for r in rows.collect()) == [f"n:{i}" for i in range(5)]


PEOPLE = "item_id long, db_id string, question string, gold_sql string, raw_output string, difficulty string"


def numbers(spark, n, db=lambda i: "d"):
    data = [(i, db(i), "", f"SELECT {i} AS x", f"SELECT {i if i % 3 else -1} AS y", "easy") for i in range(n)]
    return spark.createDataFrame(data, PEOPLE)


def folders(path):
    return sorted(p.name for p in Path(path).iterdir() if p.is_dir()) if Path(path).exists() else []


class Killed(Exception):
    pass


def test_a_run_goes_on_after_a_lost_driver(spark, tmp_path, monkeypatch):
    """Killed while its third chunk runs, the run executes only what is not committed."""
    monkeypatch.setattr(E, "CHUNK", 4)
    executed, execute, commit = [], Runner.execute, Ledger.commit

    def counted(self, s, chunk):
        executed.append((s.item_id, s.side))
        return execute(self, s, chunk)

    monkeypatch.setattr(Runner, "execute", counted)
    whole = sorted(tuple(r)[:11] for r in evaluate(numbers(spark, 10), {"d": {}}, timeout_seconds=60)[0].collect())
    assert len(executed) == 20
    executed.clear()

    def dies(self, chunk, log, written):
        if len(folders(f"{self.path}/log")) == 2:
            commit(self, chunk, log, written)
            Path(f"{self.path}/log/chunk={chunk}").rename(tmp_path / "torn")  # rows without their log
            raise Killed
        commit(self, chunk, log, written)

    monkeypatch.setattr(Ledger, "commit", dies)
    run = f"{tmp_path}/run"
    with pytest.raises(Killed):
        evaluate(numbers(spark, 10), {"d": {}}, timeout_seconds=60, run_path=run)
    assert len(executed) == 12 and len(folders(f"{run}/log")) == 2 and len(folders(f"{run}/rows")) == 3
    monkeypatch.setattr(Ledger, "commit", commit)
    executed.clear()
    samples, log = evaluate(numbers(spark, 10).where("false"), {"d": {}}, timeout_seconds=60, run_path=run)
    assert len(executed) == 12 and log.count() == 20
    assert sorted(tuple(r)[:11] for r in samples.collect()) == whole
    executed.clear()
    again, _ = evaluate(numbers(spark, 10), {"d": {}}, timeout_seconds=60, run_path=run)
    assert executed == [] and sorted(tuple(r)[:11] for r in again.collect()) == whole


def test_a_chunk_leaves_two_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 16)
    monkeypatch.setattr(E, "OPEN_SESSIONS", 2)
    opened = []

    def table(db):
        def read(s):
            opened.append(db)
            return s.range(3)

        return {"t": read}

    databases = {f"d{i}": table(f"d{i}") for i in range(6)}
    runner = Runner(spark, databases, timeout_seconds=60, run_path=f"{tmp_path}/run")
    assert opened == []  # sessions are made on first use
    log, rows = runner.run(Statement(i, "gold", f"d{i % 5}", f"SELECT count(*) + {i} FROM t") for i in range(40))
    assert log.count() == 40 and sorted(r.cells[0] for r in rows.collect()) == sorted(f"n:{i + 3}" for i in range(40))
    assert len(folders(f"{tmp_path}/run/rows")) == len(folders(f"{tmp_path}/run/log")) == 3
    assert folders(f"{tmp_path}/run/work") == [] and "d5" not in opened and not runner._sessions


def test_absent_databases_and_null_texts(spark):
    data = [(0, "d", "SELECT 1", "SELECT 1", "/x/d"), (1, "gone", "SELECT 1", "SELECT 1", "/x/gone.sqlite"), (2, "d", None, "SELECT 1", None), (3, "gone", "", None, None)]
    table = spark.createDataFrame([(i, d, "", g, p, "easy", path) for i, d, g, p, path in data], PEOPLE + ", db_path string")
    samples, log = evaluate(table, {"d": {}}, timeout_seconds=60)
    got = {r.item_id: (r.is_correct, r.gold_status, r.pred_status, r.error_message) for r in samples.collect()}
    absent = "EXECUTION_ERROR: Database file does not exist: "
    assert got[0] == (True, "SUCCESS", "SUCCESS", None)
    assert got[1] == (False, "EXECUTION_ERROR", "EXECUTION_ERROR", absent + "/x/gone.sqlite")
    assert got[2][:3] == (False, "SYNTAX_ERROR", "SUCCESS") and got[3][3] == absent + "gone"
    assert log.count() == 8
    assert V.sample_results(table, executed_pairs(log.where("item_id > 0")), differing_items(spark.createDataFrame([], ROW_SCHEMA))).where("item_id = 0").first().error_message == "EXECUTION_ERROR: statement was not executed"


def test_items_as_a_stream(spark, tmp_path, monkeypatch):
    """A batch killed in its second chunk comes again and executes the rest; the sink equals batch."""
    monkeypatch.setattr(E, "CHUNK", 4)
    executed, execute = [], Runner.execute

    def counted(self, s, chunk):
        executed.append(s.item_id)
        if len(executed) == 7 and not (tmp_path / "died").exists():
            (tmp_path / "died").touch()
            raise Killed
        return execute(self, s, chunk)

    monkeypatch.setattr(Runner, "execute", counted)
    numbers(spark, 6).repartition(2, "item_id").write.parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", PEOPLE, {"d": {}}, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    options = {"files_per_batch": 5, "timeout_seconds": 60}
    with pytest.raises(Exception):
        incremental_items(*args, **options)
    before = len(executed)
    assert incremental_items(*args, **options) == 1 and len(executed) - before == 8
    done = lambda: sorted(tuple(r)[:11] for r in evaluated(spark, f"{tmp_path}/out/samples", reports.SAMPLE_SCHEMA).collect())
    assert done() == sorted(tuple(r)[:11] for r in evaluate(numbers(spark, 6), {"d": {}}, timeout_seconds=60)[0].collect())
    assert incremental_items(*args, **options) == 0 and len(done()) == 6


def test_pair_corpus(spark):
    databases = {PC.DATABASE: parquet_database(SMALL, PAIR_TABLES)}
    results, log = evaluate(PC.pair_items(spark), databases, timeout_seconds=300)
    got = {r.question: r.o for r in results.select("question", PC.outcome().alias("o")).collect()}
    assert got == {p.kind: p.expected for p in PC.CORPUS}
    assert log.count() == 2 * len(PC.CORPUS)
    errors = {r.category: r.n for r in M.error_breakdown(results).collect()}
    assert errors["RESULT_MISMATCH"] == 7 and errors["SCHEMA_ERROR"] == 2
    assert M.overall_metrics(results).first().valid_sql_queries == len(PC.CORPUS) - 6 and errors["TIMEOUT"] == 1


def test_columns_by_name(spark):
    swapped = [p for p in PC.CORPUS if p.kind == "swapped_columns"]
    databases = {PC.DATABASE: parquet_database(SMALL, ["customer"])}
    for by_name in (False, True):
        results, _ = evaluate(PC.pair_items(spark, swapped), databases, timeout_seconds=60, by_name=by_name)
        assert results.first().is_correct is by_name


def rivers(s):
    return s.createDataFrame([(7, "Elbe", 1094), (8, "Ebro", 930), (9, "Oder", 840)], "river_id int, name string, km int")


def test_end_to_end(spark, tmp_path):
    (tmp_path / "dev.json").write_text(
        '[{"db_id": "atlas", "question": "List the rivers from short to long.",'
        ' "query": "SELECT name FROM rivers ORDER BY km"},'
        ' {"db_id": "atlas", "question": "What do all rivers measure together?",'
        ' "query": "SELECT sum(km) FROM rivers"},'
        ' {"db_id": "atlas", "question": "Which names start with O?",'
        ' "query": "SELECT name FROM rivers WHERE name LIKE \'O%\'"}]'
    )

    calls = tmp_path / "calls"

    def from_a_table():
        answers = {"short to long": "SELECT name FROM rivers ORDER BY km", "together": "SELECT max(km) FROM rivers", "start with": "SELECT FROM rivers name"}

        def answer(prompt):
            with open(calls, "a") as f:
                f.write("x")
            return next(sql for words, sql in answers.items() if words in prompt)

        return answer

    loaded = items.load_split(spark, str(tmp_path), "dev")
    prompt = P.chatml_prompt(P.chat_messages(F.lit("CREATE TABLE rivers (km INTEGER);"), F.col("question"), demonstrations=False))
    answered = predict.with_predictions(loaded.withColumn("prompt", prompt), from_a_table)
    results, _ = evaluate(answered, {"atlas": {"rivers": rivers}}, timeout_seconds=60)
    o = M.overall_metrics(results).first()
    assert tuple(o) == (3, 1, 2, 1 / 3, 2 / 3)
    reports.write_report_json(results, f"{tmp_path}/report")
    back = reports.read_samples_json(spark, f"{tmp_path}/report/samples").orderBy("item_id").collect()
    assert [r.is_correct for r in back] == [True, False, False] and back[2].pred_status == "SYNTAX_ERROR"
    assert calls.read_text() == "xxx"  # the generator ran once for each item
    first, _ = evaluate(answered, {"atlas": {"rivers": rivers}}, limit=1, timeout_seconds=60)
    assert [r.item_id for r in first.collect()] == [0]


def test_one_call_from_schema_to_report(spark, tmp_path):
    """Prompts hold the tables' own schema; called again, the run neither generates nor executes."""
    calls = tmp_path / "calls"

    def make_generator():
        def answer(prompt):
            with open(calls, "a") as f:
                f.write("x")
            assert "river_id INT PRIMARY KEY" in prompt and "km INT" in prompt
            return "SELECT max(km) FROM rivers" if "longest" in prompt else "SELECT name FROM rivers"

        return answer

    asked = [(0, "atlas", "How long is the longest?", "SELECT 1094"), (1, "atlas", "All names?", "SELECT name FROM rivers ORDER BY name DESC")]
    table = spark.createDataFrame([(*r, None) for r in asked], "item_id long, db_id string, question string, gold_sql string, difficulty string")
    for _ in range(2):
        samples, log = benchmark(table, {"atlas": {"rivers": rivers}}, make_generator, f"{tmp_path}/run", keys={"rivers": ["river_id"]}, demonstrations=False, timeout_seconds=60)
        assert [r.is_correct for r in samples.orderBy("item_id").collect()] == [True, False] and log.count() == 4
        assert reports.read_samples_json(spark, f"{tmp_path}/run/report/samples").count() == 2
    assert calls.read_text() == "xx"
