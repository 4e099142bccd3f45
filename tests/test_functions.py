import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldmatch.functions import sqltext, statuses
from goldmatch.functions.cells import canonical_frame, cells_by_name, normalize_value
from goldmatch.functions.numbers import fixed2, percent, percent_delta, round_exact
from goldmatch.functions.text import WHITESPACE, json_text, label, strip
from goldmatch.operators import tags


def values(spark, xs, dtype, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_rounding_agrees_with_python(spark):
    rng = random.Random(3)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 14) for _ in range(4000)]
    xs += [k / 32 for k in range(-200, 200)] + [k / 20000 for k in range(-3000, 3000)]
    xs += [2.00005, 0.00015, -2.00005, 0.0, -0.0, 1e-9, 1e300, -1e300, math.inf, 2.0**53]
    assert values(spark, xs, "double", lambda c: round_exact(c, 4)) == [round(x, 4) for x in xs]


def test_fixed_text_agrees_with_python(spark):
    rng = random.Random(4)
    xs = [a / b * 100 for a in range(0, 40) for b in (3, 7, 8, 32, 40, 64, 160, 800)]
    xs += [rng.uniform(-100, 100) for _ in range(2000)] + [0.155, 0.145, 3.125, -0.001, 0.005, -3.125]
    assert values(spark, xs, "double", fixed2) == [f"{x:.2f}" for x in xs]
    assert values(spark, xs, "double", percent_delta) == [f"{x:+.2f}%" for x in xs]
    assert values(spark, [0.587, 0.0, 1.0], "double", percent) == ["58.70%", "0.00%", "100.00%"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(allow_nan=False, min_value=-1e12, max_value=1e12), min_size=50, max_size=400))
def test_rounding_property(spark, xs):
    assert values(spark, xs, "double", lambda c: round_exact(c, 4)) == [round(x, 4) for x in xs]


def test_strip_knows_unicode_white_space(spark):
    assert WHITESPACE.strip() == ""
    xs = [WHITESPACE + "a b" + WHITESPACE, " ", "", None, "x​"]
    assert values(spark, xs, "string", strip) == [None if x is None else x.strip() for x in xs]


def test_label_raises_first_letter_only(spark):
    assert values(spark, ["single_table", "join", "HARD"], "string", label) == ["Single table", "Join", "Hard"]


def test_json_text_is_spaced_and_keeps_nulls(spark):
    df = spark.sql(
        "SELECT named_struct('s', 'a \"q\"', 'n', 1, 'z', cast(null as string), 'l', array(1, 2), 'm', map('k', true)) AS v"
    )
    got = df.select(json_text(F.col("v"), df.schema["v"].dataType)).first()[0]
    assert got == '{"s": "a \\"q\\"", "n": 1, "z": null, "l": [1, 2], "m": {"k": true}}'


def cells(spark, sql, **kw):
    return [tuple(r["cells"]) for r in canonical_frame(spark.sql(sql), **kw).collect()]


def test_cells_are_equal_across_types(spark):
    one = cells(spark, "SELECT 1")
    for other in ("1D", "1.0BD", "1.000001D", "true", "cast(1 as tinyint)", "cast(1 as float)"):
        assert cells(spark, f"SELECT {other}") == one
    assert cells(spark, "SELECT '1'") != one
    assert cells(spark, "SELECT -0.0D") == cells(spark, "SELECT 0")
    assert cells(spark, "SELECT cast(null as int)") == cells(spark, "SELECT cast(null as string)") == cells(spark, "SELECT null")
    assert cells(spark, "SELECT X'41'") == [("b:41",)]
    assert cells(spark, "SELECT ' Mouse ', 25.5D") == [("s:Mouse", "n:25.5")]
    assert cells(spark, "SELECT DATE'2020-01-02', TIMESTAMP_NTZ'2020-01-02 03:04:05'") == [("s:2020-01-02", "s:2020-01-02 03:04:05")]


def test_cells_by_name(spark):
    a = cells(spark, "SELECT 1 AS b, 'x' AS A", by_name=True)
    assert a == cells(spark, "SELECT 'x' AS a, 1 AS B", by_name=True) == [("s:x", "n:1")]
    df = spark.sql("SELECT array(named_struct('name','B','cell','n:1'), named_struct('name','a','cell','s:x')) AS v")
    assert df.select(cells_by_name(F.col("v"))).first()[0] == ["s:x", "n:1"]


def test_normalize_value_keeps_numeric_text(spark):
    assert values(spark, [" 1.50 "], "string", lambda c: normalize_value(c, T.StringType())) == ["1.50"]
    assert values(spark, [999.99123], "double", lambda c: normalize_value(c, T.DoubleType())) == [999.9912]


def test_order_sensitive(spark):
    cases = {
        "SELECT peak FROM ridge ORDER BY height DESC": True,
        "SELECT peak FROM ridge WHERE height > 3000": False,
        "select a from (select b from t order\n  by b) x": True,
        "SELECT border by FROM t": False,
        "SELECT reorder by_x FROM t": False,
        "SELECT a FROM t ORDER BY a": True,
        "SELECT 1 order  byte": False,
    }
    assert values(spark, list(cases), "string", sqltext.order_sensitive) == list(cases.values())


TAGGED = {
    "SELECT peak FROM ridge WHERE height > 3000;": ("single_table", "easy"),
    "SELECT r.peak, h.beds FROM ridge r JOIN hut h ON r.hut = h.id JOIN valley v ON h.valley = v.id;": ("join", "medium"),
    "SELECT peak FROM ridge WHERE hut IN (SELECT id FROM hut);": ("nested", "extra"),
    "SELECT range, min(height), sum(length) FROM ridge GROUP BY range;": ("aggregation", "medium"),
    "SELECT peak FROM ridge WHERE hut NOT IN (SELECT id FROM hut) UNION SELECT name FROM valley;": ("nested", "extra"),
    "SELECT peak FROM ridge INTERSECT SELECT name FROM valley": ("nested", "extra"),
    "SELECT a FROM t\nJOIN u ON t.x = u.x": ("single_table", "easy"),
    "SELECT a FROM x, y WHERE x.i = y.i": ("join", "medium"),
    "SELECT a FROM x, y": ("join", "medium"),
    "SELECT a FROM x, y;": ("single_table", "medium"),
    "SELECT a FROM t ORDER BY a, b": ("single_table", "medium"),
    "SELECT a FROM t WHERE b IN (1, 2)": ("single_table", "medium"),
    "SELECT a FROM t WHERE b BETWEEN 1 AND 2 OR c = 3": ("single_table", "medium"),
    "SELECT a FROM t WHERE b = 1 AND c = 2 AND d = 3 AND e = 4": ("single_table", "medium"),
    "SELECT a FROM t WHERE b = 1 AND c = 2 AND d = 3 AND e = 4 OR f": ("single_table", "hard"),
    "SELECT selected FROM t": ("single_table", "easy"),
    "SELECT a FROM t WHERE x = 'HAVING'": ("aggregation", "easy"),
    "": ("single_table", "easy"),
}


def test_query_type_and_difficulty(spark):
    df = spark.createDataFrame([(i, s, None) for i, s in enumerate(TAGGED)], "i int, gold_sql string, difficulty string")
    rows = tags.with_sql_tags(df).orderBy("i").collect()
    assert [(r.query_type, r.difficulty) for r in rows] == list(TAGGED.values())
    alone = tags.with_query_type(df).orderBy("i").collect()
    assert [r.query_type for r in alone] == [k for k, _ in TAGGED.values()]
    alone = tags.with_difficulty(df, annotated=None).orderBy("i").collect()
    assert [r.difficulty for r in alone] == [d for _, d in TAGGED.values()]


def test_annotated_difficulty_wins_unless_empty(spark):
    df = spark.createDataFrame([("SELECT a FROM t", "hard"), ("SELECT a FROM t", ""), ("SELECT a FROM t", None)], "gold_sql string, difficulty string")
    assert [r.difficulty for r in tags.with_sql_tags(df).collect()] == ["hard", "easy", "easy"]


EXTRACTED = {
    "Here is the query:\n```sql\nSELECT name FROM users WHERE id = 1;\n```\nExplanation...": "SELECT name FROM users WHERE id = 1",
    "SELECT count(*) FROM orders WHERE total > 100;": "SELECT count(*) FROM orders WHERE total > 100",
    "```sql\nWITH top_sales AS (SELECT * FROM sales) SELECT * FROM top_sales\n```": "WITH top_sales AS (SELECT * FROM sales) SELECT * FROM top_sales",
    "``````": "",
    "```sql\n```": "",
    "```python\nSELECT 1\n```": "python\nSELECT 1",
    "```SQL\nselect 1;;\n```": "select 1;",
    "```sql\nSELECT 2": "SELECT 2",
    "Sorted with filters: SELECT a FROM t": "with filters: SELECT a FROM t",
    "the answer: select 1 ; ": "select 1",
    "no statement here": "no statement here",
    "  ``` SELECT 3 ; ``` tail ``` more": "SELECT 3",
    "SELECT 1; ``` rest": "SELECT 1",
    "preselect x": "preselect x",
    "": "",
}


def test_extract_sql(spark):
    assert values(spark, list(EXTRACTED), "string", sqltext.extract_sql) == list(EXTRACTED.values())


def test_status_of_message(spark):
    cases = {
        "interrupted": "TIMEOUT",
        "no such table: t": "SCHEMA_ERROR",
        "No Such Column: c": "SCHEMA_ERROR",
        'near "FROM": syntax error': "SYNTAX_ERROR",
        "incomplete input": "SYNTAX_ERROR",
        "ambiguous column name: id": "EXECUTION_ERROR",
        None: "SUCCESS",
    }
    assert values(spark, list(cases), "string", statuses.status_of_message) == list(cases.values())


def test_status_of_condition():
    assert statuses.status_of_condition("UNRESOLVED_COLUMN.WITH_SUGGESTION") == "SCHEMA_ERROR"
    assert statuses.status_of_condition("PARSE_SYNTAX_ERROR") == "SYNTAX_ERROR"
    assert statuses.status_of_condition("SPARK_JOB_CANCELLED") == "TIMEOUT"
    assert statuses.status_of_condition("DIVIDE_BY_ZERO") == statuses.status_of_condition(None) == "EXECUTION_ERROR"
