"""Evaluation workload derived from the given tables.

One item per order, one result per order made of its line items, one database per
ten customers. Everything grows with the tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldmatch.functions import statuses as S
from goldmatch.functions.cells import canonical_row
from goldmatch.operators.compare import differing_items
from goldmatch.operators.ordinals import row_ordinals
from goldmatch.operators.verdict import sample_results
from goldmatch.sources.items import database_path

DB_ROOT = "/corpus"
CUSTOMERS_PER_DB = 10
CATALOG_BALANCE = 8000
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag"]

# ``{k}`` is the customer key. One template per query shape.
GOLD_TEMPLATES = [
    "SELECT c_name FROM customer WHERE c_custkey = {k}",
    "SELECT o_orderkey FROM orders WHERE o_custkey = {k} AND o_orderstatus = 'F'",
    "SELECT o_orderkey FROM orders WHERE o_custkey = {k} AND o_orderstatus = 'F' "
    "AND o_totalprice > 1000 AND o_orderpriority = '1-URGENT'",
    "SELECT o_orderkey FROM orders WHERE o_custkey = {k} ORDER BY o_totalprice DESC LIMIT 5",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = {k} ORDER BY o_orderdate, o_orderkey",
    "SELECT count(*) FROM orders WHERE o_custkey = {k}",
    "SELECT o_orderstatus, sum(o_totalprice) FROM orders WHERE o_custkey = {k} "
    "GROUP BY o_orderstatus HAVING count(*) > 1",
    "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey = {k}",
    "SELECT c_name, count(*) FROM customer JOIN orders ON c_custkey = o_custkey "
    "WHERE c_custkey = {k} GROUP BY c_name ORDER BY c_name",
    "SELECT c_name, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND c_custkey = {k}",
    "SELECT {k}, o_orderkey FROM customer, orders;",
    "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey = {k})",
    "SELECT c_name FROM customer WHERE c_custkey = {k} UNION SELECT s_name FROM supplier WHERE s_suppkey = {k}",
    "WITH mine AS (SELECT o_totalprice FROM orders WHERE o_custkey = {k}) SELECT max(o_totalprice) FROM mine",
]

# ``{sql}`` is the statement: forms in which a generator answers.
RAW_WRAPPERS = [
    "{sql}",
    "{sql};",
    "```sql\n{sql}\n```",
    "```\n   {sql}   \n\n```",
    "Here is the query:\n```sql\n{sql};\n```\nIt returns the rows you asked for.",
    "The answer is {sql} ;",
    "```sql\n{sql}",
]

# Error text by index; an index past the end means success.
ERROR_TEXTS = [
    "interrupted",
    "no such table: t",
    "no such column: c",
    'near "FROM": syntax error',
    "incomplete input",
    "ambiguous column name: id",
    "attempt to write a readonly database",
]
ERROR_CYCLE, GOLD_FAILS_EVERY, CHANGE_CYCLE = 11, 97, 5
GOLD_ERROR = "no such table: gold_source"
RUNS = {"a": (0, 0), "b": (3, 1)}  # shift of the error index, shift of the change mode

# Catalog of the given tables: column, declared type, not null, key part.
CATALOG: list[tuple[str, list[tuple[str, str | None, int, int]]]] = [
    ("region", [("r_regionkey", "integer", 1, 1), ("r_name", "TEXT", 0, 0)]),
    ("nation", [("n_nationkey", "INTEGER", 1, 1), ("n_name", "text", 0, 0), ("n_regionkey", "INTEGER", 0, 0)]),
    ("customer", [("c_custkey", "INTEGER", 1, 1), ("c_name", "", 0, 0), ("c_nationkey", "INTEGER", 0, 0),
                  ("c_acctbal", "real", 0, 0), ("c_mktsegment", None, 0, 0)]),
    ("supplier", [("s_suppkey", "INTEGER", 1, 1), ("s_name", "TEXT", 0, 0), ("s_nationkey", "INTEGER", 0, 0),
                  ("s_acctbal", "REAL", 0, 0)]),
    ("part", [("p_partkey", "INTEGER", 1, 1), ("p_name", "varchar(55)", 0, 0), ("p_brand", "", 0, 0),
              ("p_type", "TEXT", 0, 0), ("p_size", "int", 0, 0), ("p_retailprice", "REAL", 0, 0)]),
    ("orders", [("o_orderkey", "INTEGER", 1, 1), ("o_custkey", "INTEGER", 0, 0), ("o_orderstatus", "TEXT", 0, 0),
                ("o_totalprice", "REAL", 0, 0), ("o_orderdate", "timestamp", 0, 0), ("o_orderpriority", "TEXT", 0, 0)]),
    ("lineitem", [("l_orderkey", "INTEGER", 1, 1), ("l_partkey", "INTEGER", 0, 0), ("l_suppkey", "INTEGER", 0, 0),
                  ("l_linenumber", "INTEGER", 1, 2), ("l_quantity", "REAL", 0, 0), ("l_extendedprice", "REAL", 0, 0),
                  ("l_discount", "REAL", 0, 0), ("l_tax", "REAL", 0, 0), ("l_returnflag", "TEXT", 0, 0),
                  ("l_linestatus", "TEXT", 0, 0), ("l_shipdate", "timestamp", 0, 0)]),
    ("events", [("event_id", "INTEGER", 1, 1), ("ts", "timestamp", 0, 0), ("user_id", "INTEGER", 0, 0),
                ("event_type", "TEXT", 0, 0), ("value", "REAL", 0, 0), ("props", None, 0, 0)]),
    ("documents", [("doc_id", "INTEGER", 1, 1), ("text", "TEXT", 0, 0), ("lang", "TEXT", 0, 0),
                   ("source", "TEXT", 0, 0), ("n_chars", "INTEGER", 0, 0)]),
    ("labels", [("doc_id", "INTEGER", 1, 1), ("quality", "INTEGER", 0, 0), ("toxic", "INTEGER", 0, 0)]),
    ("conversations", [("conv_id", "INTEGER", 1, 1), ("turn", "INTEGER", 1, 2), ("role", "TEXT", 0, 0),
                       ("text", "TEXT", 0, 0)]),
    ("benchmark", [("item_id", "INTEGER", 0, 0), ("text", "TEXT", 0, 0)]),
    ("pages", [("page_id", "INTEGER", 1, 1), ("url", "TEXT", 0, 0), ("html", "TEXT", 0, 0)]),
    ("embeddings", [("vec_id", "INTEGER", 1, 1), ("embedding", "blob", 0, 0), ("label", "INTEGER", 0, 0)]),
    ("sqlite_sequence", [("name", "", 0, 0), ("seq", "", 0, 0)]),
]
FOREIGN_KEYS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", None),
    ("pages", None, "documents", "doc_id"),
]
GIVEN_TABLES = [name for name, columns in CATALOG if name != "sqlite_sequence"]
DATA_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
}
DATA_EDGES = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
]
TOOLS = [
    {"type": "function", "function": {"name": "find_orders", "parameters": {"custkey": "integer"}}},
    {"type": "function", "function": {"name": "order_total", "parameters": {"orderkey": "integer"}}},
]

Table = Callable[[str], DataFrame]


def tables(spark: SparkSession, sf_dir: str) -> Table:
    """Reader of the given tables; each is listed once per query."""
    return cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def case(index: Column, values: list[Column], default: Column | None = None) -> Column:
    """Lazily pick ``values[index]``."""
    out = F.when(index == 0, values[0])
    for i, value in enumerate(values[1:], start=1):
        out = out.when(index == i, value)
    return out if default is None else out.otherwise(default)


def _fill(template: str, mark: str, value: Column) -> Column:
    pieces = template.split(mark)
    out = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        out += [value, F.lit(piece)]
    return F.concat(*out)


def database_of(custkey: Column) -> Column:
    return F.concat(F.lit("db_"), F.floor(custkey / CUSTOMERS_PER_DB).cast("string"))


def items(t: Table) -> DataFrame:
    """One item per order, with the generator's answer in ``raw_output``."""
    o = t("orders").select("o_orderkey", "o_custkey")
    k = F.col("o_custkey").cast("string")
    key = F.col("o_orderkey")
    gold = case(key % len(GOLD_TEMPLATES), [_fill(x, "{k}", k) for x in GOLD_TEMPLATES])
    raw = case(
        F.col("o_custkey") % len(RAW_WRAPPERS), [_fill(x, "{sql}", F.col("gold_sql")) for x in RAW_WRAPPERS]
    )
    return (
        o.withColumn("gold_sql", gold)
        .withColumn("raw_output", raw)
        .withColumn("db_id", database_of(F.col("o_custkey")))
        .select(
            key.alias("item_id"),
            "db_id",
            F.concat(F.lit("Orders of customer "), k).alias("question"),
            "gold_sql",
            database_path(DB_ROOT, F.col("db_id")).alias("db_path"),
            F.when(key % 20 == 0, "hard").when(key % 20 == 1, "").alias("difficulty"),
            "raw_output",
        )
    )


def database_numbers(t: Table) -> DataFrame:
    """Number of every database with a catalog: those with a customer of some
    balance. Items of the others meet an absent database."""
    n = F.floor(F.col("c_custkey") / CUSTOMERS_PER_DB)
    richest = t("customer").groupBy(n.alias("db_no")).agg(F.max("c_acctbal").alias("top"))
    return richest.where(F.col("top") > CATALOG_BALANCE).select("db_no")


def inventory(t: Table) -> DataFrame:
    return database_numbers(t).select(F.concat(F.lit("db_"), F.col("db_no").cast("string")).alias("db_id"))


def _constant_rows(rows: list[dict], fields: str) -> Column:
    """A fixed list of rows as one array literal (folded when the query is planned)."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def schema_columns(t: Table) -> DataFrame:
    """Raw catalog columns of every database."""
    rows = [
        {"table_no": no, "table_name": table, "cid": cid, "name": name, "data_type": dtype, "not_null": not_null, "pk": pk}
        for no, (table, cols) in enumerate(CATALOG)
        for cid, (name, dtype, not_null, pk) in enumerate(cols)
    ]
    fields = "table_no:int,table_name:string,cid:int,name:string,data_type:string,not_null:int,default_value:string,pk:int"
    return inventory(t).select("db_id", F.inline(_constant_rows(rows, fields)))


def schema_fks(t: Table) -> DataFrame:
    """Raw catalog foreign keys of every database."""
    number = {table: no for no, (table, _) in enumerate(CATALOG)}
    rows = [
        {"table_no": number[table], "table_name": table, "fk_no": no, "from_column": source, "to_table": to, "to_column": target}
        for no, (table, source, to, target) in enumerate(FOREIGN_KEYS)
    ]
    fields = "table_no:int,table_name:string,fk_no:int,from_column:string,to_table:string,to_column:string"
    return inventory(t).select("db_id", F.inline(_constant_rows(rows, fields)))


def execution_log(t: Table, run: str = "a") -> DataFrame:
    """Error texts, one line per (item, side); null text means success."""
    shift, _ = RUNS[run]
    o = t("orders").select("o_orderkey", "o_custkey")
    gold = F.when(F.col("o_orderkey") % GOLD_FAILS_EVERY == 0, F.lit(GOLD_ERROR))
    pred = case((F.col("o_custkey") + shift) % ERROR_CYCLE, [F.lit(e) for e in ERROR_TEXTS])
    spent = (F.col("o_orderkey") % 50).cast("double") + 0.5
    sides = F.array(
        F.struct(F.lit("gold").alias("side"), gold.alias("error_message"), spent.alias("execution_time_ms")),
        F.struct(F.lit("pred").alias("side"), pred.alias("error_message"), spent.alias("execution_time_ms")),
    )
    return o.select(F.col("o_orderkey").alias("item_id"), F.inline(sides))


def executed(t: Table, run: str = "a") -> DataFrame:
    """Executed pairs: both sides of an item on one line. Both come from one row
    of orders, so no shuffle is needed."""
    shift, _ = RUNS[run]
    key = F.col("o_orderkey")
    gold = F.when(key % GOLD_FAILS_EVERY == 0, F.lit(GOLD_ERROR))
    pred = case((F.col("o_custkey") + shift) % ERROR_CYCLE, [F.lit(e) for e in ERROR_TEXTS])
    return t("orders").select(
        key.alias("item_id"),
        S.status_of_message(gold).alias("gold_status"),
        gold.alias("gold_message"),
        S.status_of_message(pred).alias("pred_status"),
        pred.alias("pred_message"),
        ((key % 50).cast("double") + 0.5).alias("execution_time_ms"),
    )


def numbered_lines(t: Table) -> DataFrame:
    """Line items as result rows: item_id, row_no, n_rows and three cells."""
    lines = t("lineitem").select(
        F.col("l_orderkey").alias("item_id"), *LINE_ORDER
    )
    return row_ordinals(lines, ["item_id"], LINE_ORDER, "row_no", size="n_rows").select(
        "item_id",
        "row_no",
        "n_rows",
        F.col("l_partkey").alias("part"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"),
        F.col("l_returnflag").alias("flag"),
    )


def result_rows(t: Table, run: str = "a") -> DataFrame:
    """Gold and predicted rows. By key the prediction is the same, reversed, short
    of its first row, with that row doubled, or equal only after normalisation."""
    _, shift = RUNS[run]
    mode = (F.col("item_id") + shift) % CHANGE_CYCLE
    no, price, flag = F.col("row_no"), F.col("price"), F.col("flag")

    def row(side: str, no: Column, price: Column = price, flag: Column = flag) -> Column:
        return F.struct(F.lit(side).alias("side"), no.alias("row_no"), price.alias("price"), flag.alias("flag"))

    moved = (
        F.when(mode == 1, F.col("n_rows") - 1 - no).when(mode == 2, no - 1).when(mode == 3, no + 1).otherwise(no)
    )
    padded = F.when(mode == 4, F.concat(F.lit("  "), flag, F.lit("\t "))).otherwise(flag)
    nudged = F.when(mode == 4, price + F.lit(0.00001)).otherwise(price)
    variants = F.array(
        row("gold", no),
        row("pred", moved, nudged, padded),
        row("pred", F.when((mode == 3) & (no == 0), no)),
    )
    rows = numbered_lines(t).select("item_id", "part", F.inline(variants)).where(F.col("row_no") >= 0)
    cells = canonical_row(
        [F.col("part"), F.col("price"), F.col("flag")], [T.LongType(), T.DoubleType(), T.StringType()]
    )
    return rows.select("item_id", "side", "row_no", cells.alias("cells"))


def samples(t: Table, run: str = "a") -> DataFrame:
    """The fact table of one run."""
    return sample_results(items(t), executed(t, run), differing_items(result_rows(t, run)))


def chat_turns(t: Table) -> DataFrame:
    """A tool conversation per order, one line per turn."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    args = "struct<custkey:bigint,status:string,note:string>"
    flat = f"struct<name:string,arguments:{args}>"

    def call(name: str, note: Column) -> Column:
        """Every fourth conversation has its calls in function form."""
        said = F.struct(
            F.lit(name).alias("name"),
            F.struct(cust.alias("custkey"), F.col("o_orderstatus").alias("status"), note.cast("string").alias("note")).alias("arguments"),
        ).cast(flat)
        plain = F.when(key % 4 != 0, said)
        return F.struct(
            plain["name"].alias("name"), plain["arguments"].alias("arguments"),
            F.when(key % 4 == 0, F.lit("function")).alias("type"), F.when(key % 4 == 0, said).alias("function"),
        )

    none = F.lit(None).cast(f"array<struct<name:string,arguments:{args},type:string,function:{flat}>>")

    def turn(role: str, content: Column, calls: Column = none) -> Column:
        return F.struct(
            F.lit(role).alias("role"), content.cast("string").alias("content"), calls.alias("tool_calls")
        )

    system = F.when(key % 3 != 0, turn("system", F.lit("Answer from the order book.")))
    answers = F.when(key % 2 == 0, turn("tool", F.col("o_totalprice").cast("long").cast("string")))
    msgs = F.array_compact(
        F.array(
            system,
            turn("user", F.concat(F.lit("Orders of customer "), cust.cast("string"))),
            turn(
                "assistant",
                F.when(key % 5 != 0, F.lit("Looking up.")).otherwise(F.lit("")),
                F.array(
                    call("find_orders", F.lit(None)),
                    call("order_total", F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('"'))),
                ),
            ),
            turn("tool", F.concat(F.lit("status "), F.col("o_orderstatus"))),
            answers,
            turn("assistant", F.lit("Done.")),
            F.when(key % 7 == 0, turn("tool", F.lit("late"))),
        )
    )
    return o.select(key.alias("conv_id"), F.posexplode(msgs).alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "m.*"
    )


def talk_turns(t: Table) -> DataFrame:
    """The given conversations in the chat model."""
    return t("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
