"""Run gold and predicted statements as Spark SQL and judge the results.

Each statement is one Spark job that writes its normalised rows to the shared
folder; only a status line per statement returns to the driver. Statements go in
chunks, each committed as one table and one log (:mod:`goldmatch.plans.ledger`), so a
run that was cut off goes on where it stopped. All comparisons then happen at once
(:mod:`goldmatch.operators.compare`).
"""

from __future__ import annotations

import re
import threading
from collections import OrderedDict
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice
from queue import SimpleQueue

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmatch.functions import statuses as S
from goldmatch.functions.cells import canonical_frame
from goldmatch.functions.sqltext import extract_sql
from goldmatch.operators.compare import cap_result_rows, differing_items
from goldmatch.operators.verdict import executed_pairs, exists_guard, sample_results
from goldmatch.plans.deadline import run_limited
from goldmatch.plans.ledger import Ledger
from goldmatch.session import dimension, scratch_path, written

# Table name -> reader; a view belongs to a session, so tables are read per session.
Database = dict[str, Callable[[SparkSession], DataFrame]]

# Limits of a statement, and the dialect switches it runs under.
TIMEOUT_SECONDS = 3.0
DIALECT = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.enforceReservedKeywords": "true",
    "spark.sql.session.timeZone": "UTC",
}
CHUNK, OPEN_SESSIONS = 256, 32


@dataclass
class Statement:
    """``limit_seconds`` replaces the runner's limit for this statement."""

    item_id: int
    side: str
    db_id: str
    sql: str
    limit_seconds: float | None = None


@dataclass
class Runner:
    """Executes statements over named databases of temporary views.

    ``max_rows`` keeps the first rows of every result, by position, and reads one more;
    none compares whole results. ``by_name`` aligns columns by name instead of by position.
    ``run_path`` is a folder all executors reach; without one the run has a folder of its
    own and can't be resumed.

    A database's session is made when its first statement comes. Between chunks, all but the
    ``OPEN_SESSIONS`` used last are closed. Every worker thread has a scheduler pool: in a
    session with FAIR scheduling the slots that a long statement's tasks free go to its
    neighbours first. Running tasks are not taken from it before its limit.
    """

    spark: SparkSession
    databases: dict[str, Database]
    timeout_seconds: float = TIMEOUT_SECONDS
    max_rows: int | None = None
    by_name: bool = False
    threads: int = 8
    run_path: str | None = None
    _sessions: OrderedDict[str, SparkSession] = field(default_factory=OrderedDict)

    def __post_init__(self) -> None:
        self.ledger = Ledger(self.spark, self.run_path or scratch_path(self.spark, "run"))
        self._lock, self._slots = threading.Lock(), SimpleQueue()
        for slot in range(self.threads):
            self._slots.put(slot)

    def run(self, statements: Iterable[Statement]) -> tuple[DataFrame, DataFrame]:
        """(execution log, result rows with dense row_no) of these and all earlier statements
        of the run folder. The driver holds one chunk at a time."""
        statements = iter(statements)
        self.ledger.remove("work")  # of a run that was cut off
        with ThreadPoolExecutor(self.threads) as pool:
            while chunk := list(islice(statements, CHUNK)):
                name = self.ledger.new_chunk()
                log = list(pool.map(lambda s: self.execute(s, name), chunk))  # noqa: B023 - used up in this round
                self.ledger.commit(name, log, [self.ledger.place(name, x[0], x[1]) for x in log if x[2] == S.SUCCESS])
                self._close_sessions(OPEN_SESSIONS)
        self._close_sessions(0)
        return self.ledger.lines().drop("chunk"), self.ledger.rows()

    def _session(self, db_id: str) -> SparkSession:
        with self._lock:
            if db_id not in self._sessions:
                session = self.spark.newSession()
                for key, value in DIALECT.items():
                    session.conf.set(key, value)
                for name, read in self.databases[db_id].items():
                    read(session).createOrReplaceTempView(name)
                self._sessions[db_id] = session
            self._sessions.move_to_end(db_id)
            return self._sessions[db_id]

    def _close_sessions(self, keep: int) -> None:
        while len(self._sessions) > keep:
            db_id, session = self._sessions.popitem(last=False)
            for name in self.databases[db_id]:
                session.catalog.dropTempView(name)

    def execute(self, s: Statement, chunk: str) -> tuple:
        """Run one statement; returns its log line."""
        if s.db_id not in self.databases:
            return (s.item_id, s.side, S.EXECUTION_ERROR, S.MISSING_DATABASE + s.db_id, 0.0)
        limit, slot = s.limit_seconds or self.timeout_seconds, self._slots.get()
        try:
            session = self._session(s.db_id)
            group = f"goldmatch-{chunk}-{s.item_id}-{s.side}"
            outcome = run_limited(self.spark.sparkContext, group, f"goldmatch-{slot}", limit, lambda: self._store(session, s, chunk))
        finally:
            self._slots.put(slot)
        status, message = status_of_error(outcome.error) if outcome.error else (S.SUCCESS, None)
        if outcome.timed_out:  # also when the statement ended while it was being cancelled
            status, message = S.TIMEOUT, f"interrupted after {limit} s"
        return (s.item_id, s.side, status, message, outcome.seconds * 1000.0)

    def _store(self, session: SparkSession, s: Statement, chunk: str) -> None:
        reject_commands(session, s.sql)
        result = session.sql(s.sql)
        if self.max_rows is not None:
            result = result.limit(self.max_rows + 1)
        placed = canonical_frame(result, self.by_name).select(F.monotonically_increasing_id().alias("at"), "cells")
        placed.write.mode("overwrite").parquet(self.ledger.place(chunk, s.item_id, s.side))


class ReadOnlyError(Exception):
    """The statement is not a query."""


def reject_commands(session: SparkSession, sql: str) -> None:
    """Raise unless ``sql`` is a query. Commands run when ``session.sql`` sees them, so
    the text goes to the session's parser first: a command parses, but not as a query."""
    parser, body = session._jsparkSession.sessionState().sqlParser(), sql.strip().rstrip(";")
    try:
        parser.parseQuery(body)
    except PySparkException:
        parser.parsePlan(f"EXPLAIN {body}")  # a syntax error is raised again, with its own text
        raise ReadOnlyError("attempt to write a readonly database") from None


def status_of_error(e: Exception) -> tuple[str, str]:
    """Status and one-line message of a failed statement."""
    text = str(e)
    condition = e.getCondition() if isinstance(e, PySparkException) else None
    if not condition:
        found = re.search(r"\[([A-Z][A-Z0-9_]+(?:\.[A-Z0-9_]+)*)\]", text)
        condition = found.group(1) if found else None
    first_line = next((line for line in text.splitlines() if line.strip()), type(e).__name__)
    return S.status_of_condition(condition), first_line


def parquet_database(folder: str, names: list[str]) -> Database:
    """Tables stored as ``<folder>/<name>.parquet``."""
    return {n: (lambda s, n=n: s.read.parquet(f"{folder}/{n}.parquet")) for n in names}


def evaluate(
    items: DataFrame,
    databases: dict[str, Database],
    limit: int | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(sample results, execution log) of items with ``gold_sql`` and ``raw_output``.

    Each item costs two driver-submitted statements, so their texts pass the driver,
    a partition at a time; their results do not. Items may bring ``db_path``, which the
    message about an absent database names, and ``limit_seconds``, a time limit of their
    own; a null text is an empty statement. With ``max_rows`` the samples carry
    ``truncated``: whether a result of the item had more rows.

    The items are stored first, so what produced them, e.g. a generator, runs once. With
    ``run_path`` (and the other options of :class:`Runner`) they are stored there: called
    again, the run takes its items from that folder, executes only the statements without
    a committed log line and returns the results of all.
    """
    spark = items.sparkSession
    if limit:
        items = items.orderBy("item_id").limit(limit)
    runner = Runner(spark, databases, **options)
    items = runner.ledger.items(items)
    own_limit = F.col("limit_seconds") if "limit_seconds" in items.columns else F.lit(None)
    path = F.col("db_path") if "db_path" in items.columns else F.col("db_id")
    sides = F.array(
        F.struct(F.lit("gold").alias("side"), F.col("gold_sql").alias("sql")),
        F.struct(F.lit("pred").alias("side"), extract_sql(F.col("raw_output")).alias("sql")),
    )
    texts = items.select("item_id", "db_id", F.coalesce(path, "db_id").alias("db_path"), own_limit.cast("double").alias("limit_seconds"), F.explode(sides).alias("s"))
    known = spark.createDataFrame([(d,) for d in databases], "db_id string")
    guarded = written(exists_guard(texts, dimension(known, "databases")), "statements")
    refused = guarded.where("guard_status IS NOT NULL").select(
        "item_id", "s.side", F.col("guard_status").alias("status"), F.col("guard_message").alias("error_message"), F.col("guard_time_ms").alias("execution_time_ms")
    )
    ready = guarded.where("guard_status IS NULL").select("item_id", "s.side", "db_id", F.coalesce("s.sql", F.lit("")).alias("sql"), "limit_seconds")
    rest = ready.join(runner.ledger.lines().select("item_id", "side"), ["item_id", "side"], "left_anti")
    statements = (Statement(r["item_id"], r["side"], r["db_id"], r["sql"], r["limit_seconds"]) for r in rest.toLocalIterator())
    log, rows = runner.run(statements)
    log = log.unionByName(refused)
    if runner.max_rows is None:
        return sample_results(items, executed_pairs(log), differing_items(rows)), log
    longer = rows.where(F.col("row_no") >= runner.max_rows).select("item_id", F.lit(True).alias("truncated")).distinct()
    kept = cap_result_rows(rows, runner.max_rows)
    samples = sample_results(items, executed_pairs(log), differing_items(kept)).join(longer, "item_id", "left")
    return samples.withColumn("truncated", F.coalesce("truncated", F.lit(False))), log
