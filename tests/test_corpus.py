import hashlib
import json
import os
import random
import re
from functools import reduce

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, DataFrameWriter, Row
from pyspark.sql import functions as F

from goldmatch.functions import prompts as P
from goldmatch.operators import chat, keys, lengths, predict, schema, split
from goldmatch.plans import registry
from goldmatch.session import mounted_path, qualified
from goldmatch.sources import catalog, inventory, items, samples

COLS = "db_id string, table_no int, table_name string, cid int, name string, data_type string, not_null int, default_value string, pk int"
FKS = "db_id string, table_no int, table_name string, fk_no int, from_column string, to_table string, to_column string"


@pytest.fixture(scope="module")
def harbour(spark):
    def cols(no, table, *names):
        return [("harbour", no, table, i, n, t, 0, None, pk) for i, (n, t, pk) in enumerate(names)]

    columns = (
        cols(0, "quay", ("code", "varchar(4)", 1), ("depth", "real", 0))
        + cols(1, "vessel", ("imo", "bigint", 1), ("flag", "", 0), ("home", "varchar(4)", 0))
        + cols(2, "mooring", ("quay", None, 1), ("vessel", "BIGINT", 0), ("tide", "Integer", 2), ("fee", "real", 0))
        + cols(3, "sqlite_sequence", ("name", "", 0), ("seq", "", 0))
    )
    fks = [
        ("harbour", 1, "vessel", 0, "home", "quay", "code"),
        ("harbour", 2, "mooring", 0, "quay", "quay", "code"),
        ("harbour", 2, "mooring", 1, "vessel", "vessel", None),
        ("harbour", 2, "mooring", 2, None, "quay", "code"),
    ]
    return spark.createDataFrame(columns, COLS), spark.createDataFrame(fks, FKS)


HARBOUR_DDL = """CREATE TABLE quay (
    code VARCHAR(4) PRIMARY KEY,
    depth REAL
);

CREATE TABLE vessel (
    imo BIGINT PRIMARY KEY,
    flag TEXT,
    home VARCHAR(4),
    FOREIGN KEY (home) REFERENCES quay(code)
);

CREATE TABLE mooring (
    quay TEXT,
    vessel BIGINT,
    tide INTEGER,
    fee REAL,
    PRIMARY KEY (quay, tide),
    FOREIGN KEY (quay) REFERENCES quay(code),
    FOREIGN KEY (vessel) REFERENCES vessel(vessel)
);"""


def test_schema_text(harbour):
    assert [tuple(r) for r in schema.schema_text(*harbour).collect()] == [("harbour", HARBOUR_DDL)]


def test_primary_keys(harbour):
    clean = schema.normalize_types(schema.drop_internal_tables(harbour[0]))
    assert {r.table_name: r.primary_keys for r in schema.primary_keys(clean).collect()} == {
        "quay": "code", "vessel": "imo", "mooring": "quay, tide",
    }


def test_attach_schema(spark, harbour):
    df = spark.createDataFrame([(1, "harbour"), (2, "none")], "item_id long, db_id string")
    got = {r.item_id: r.schema_ddl for r in schema.attach_schema(df, schema.schema_text(*harbour)).collect()}
    assert got == {1: HARBOUR_DDL, 2: ""}


def test_prompts(spark):
    ddl, question = "CREATE TABLE users (id INT PRIMARY KEY, name TEXT);", "Find all user names."
    df = spark.createDataFrame([(f" {ddl}\n", f"{question} ", " SELECT name FROM users; ")], "d string, q string, s string")
    few = P.chat_messages(F.col("d"), F.col("q"))
    none = P.chat_messages(F.col("d"), F.col("q"), demonstrations=False)
    row = df.select(
        P.user_content(F.col("d"), F.col("q")).alias("user"), few.alias("few"), none.alias("none"),
        P.chatml_prompt(none).alias("prompt"), P.sft_messages(F.col("d"), F.col("q"), F.col("s")).alias("sft"),
    ).first()
    user = f"### SQLite Database Schema:\n```sql\n{ddl}\n```\n\n### Question:\n{question}\n\n### SQL Query:"
    assert row.user == user
    assert [m.role for m in row.few] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert row.few[0].content == P.system_text() and "single valid SQLite query" in P.system_text()
    assert row.few[2].content.startswith("```sql\nSELECT avg(salary)") and row.few[-1].content == user
    assert [m.role for m in row.none] == ["system", "user"]
    turns = [f"<|im_start|>{m.role}\n{m.content}<|im_end|>" for m in row.none]
    assert row.prompt == "\n".join([*turns, "<|im_start|>assistant\n"])
    assert row.sft[2].content == "```sql\nSELECT name FROM users;\n```" and len(row.sft) == 3


# --- chat template -----------------------------------------------------------


def expected_text(messages, tools, open_turn):
    """Plain restatement of the template's text for the tests."""
    first = messages[0]
    out = "<|im_start|>system\n" + (first["content"] if first["role"] == "system" else chat.DEFAULT_SYSTEM)
    if tools:
        out += chat.TOOLS_BEFORE + "".join("\n" + json.dumps(t) for t in tools) + chat.TOOLS_AFTER
    out += "<|im_end|>\n"
    roles = [None] + [m["role"] for m in messages] + [None]
    for i, m in enumerate(messages):
        calls = m.get("tool_calls") or []
        if m["role"] == "tool":
            out += "<|im_start|>user" if roles[i] != "tool" else ""
            out += f"\n<tool_response>\n{m['content']}\n</tool_response>"
            out += "<|im_end|>\n" if roles[i + 2] != "tool" else ""
        elif m["role"] == "assistant" and calls:
            out += "<|im_start|>assistant" + (f"\n{m['content']}" if m["content"] else "")
            for c in calls:
                args = json.dumps(c["arguments"], ensure_ascii=False)
                out += f'\n<tool_call>\n{{"name": "{c["name"]}", "arguments": {args}}}\n</tool_call>'
            out += "<|im_end|>\n"
        elif not (m["role"] == "system" and i == 0):
            out += f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n"
    return out + ("<|im_start|>assistant\n" if open_turn else "")


TURN = "conv_id long, turn long, role string, content string, tool_calls array<struct<name:string,arguments:struct<city:string,days:int>>>"


def conversations(n=40, seed=7):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        roles = [rng.choice(["system", "user", "assistant", "tool", "tool"]) for _ in range(rng.randint(1, 13))]
        out[c] = [
            {
                "role": r, "content": rng.choice(["", f"text {i}", 'é "x"\n']),
                "tool_calls": [
                    {"name": f"f{k}", "arguments": {"city": rng.choice(["Köln", 'a"b', None]), "days": k}} for k in range(rng.randint(0, 2))
                ] if r == "assistant" else None,
            }
            for i, r in enumerate(roles)
        ]
    return out


@pytest.mark.parametrize("tools", [None, [{"type": "function", "function": {"name": "f0"}}]])
def test_conversation_text_in_parts(spark, tools):
    talks = conversations()
    rows = [(c, i, m["role"], m["content"], m["tool_calls"]) for c, ms in talks.items() for i, m in enumerate(ms)]
    turns = spark.createDataFrame(rows, TURN)
    want = {c: expected_text(ms, tools, True) for c, ms in talks.items()}
    for part_turns in (1, 2, 3, 1000):
        parts = chat.render_conversations(turns, tools, True, part_turns).orderBy("conv_id", "part_no").collect()
        got = {}
        for p in parts:
            got[p.conv_id] = got.get(p.conv_id, "") + p.text
        assert got == want
        assert max(p.part_no for p in parts) == (12 // part_turns if part_turns < 13 else 0)
    marks = {(r.conv_id, r.turn): (r.opens, r.closes) for r in chat.merge_tool_turns(turns, 2).collect()}
    for c, ms in talks.items():
        roles = [None] + [m["role"] for m in ms] + [None]
        for i, m in enumerate(ms):
            tool = m["role"] == "tool"
            assert marks[c, i] == (tool and roles[i] != "tool", tool and roles[i + 2] != "tool")


def test_long_conversation_is_one_row_by_position(spark):
    # from 1 on and with gaps: 1500 turns, tool turns on both sides of number 1024 and of position 1024
    messages = [{"role": "user" if i % 3 else "tool", "content": f"text {i}"} for i in range(1500)]
    for i in range(1018, 1032):
        messages[i]["role"] = "tool"
    number = [1 + i * 2 + (i > 500) * 7 for i in range(1500)]
    turns = spark.createDataFrame([(5, n, m["role"], m["content"]) for n, m in zip(number, messages)][::-1], "conv_id long, turn long, role string, content string")
    got = chat.render_conversations(turns, None, True).collect()
    assert [(r.conv_id, r.part_no) for r in got] == [(5, 0)]
    assert got[0].text == expected_text(messages, None, True)
    pieces = chat.render_turns(turns, None, True, 4).orderBy("position").collect()
    assert [r.turn for r in pieces] == number and "".join(r.text for r in pieces) == got[0].text
    marks = {r.turn: (r.opens, r.closes) for r in chat.merge_tool_turns(turns).collect()}
    roles = [None] + [m["role"] for m in messages] + [None]
    assert marks == {n: (roles[i + 1] == "tool" != roles[i], roles[i + 1] == "tool" != roles[i + 2]) for i, n in enumerate(number)}


def test_gaps_do_not_depend_on_parts(spark):
    messages = [{"role": r, "content": str(i)} for i, r in enumerate(["user", "tool", "tool", "user"])]
    turns = spark.createDataFrame([(1, n, m["role"], m["content"]) for n, m in zip((3, 1020, 1030, 5000), messages)], "conv_id long, turn long, role string, content string")
    got = chat.render_conversations(turns, None, True).collect()
    assert [r.text for r in got] == [expected_text(messages, None, True)]


def test_null_content_is_empty(spark):
    rows = [("system", None, None), ("user", None, None), ("tool", None, None), ("assistant", None, [("f", ("x", 1))])]
    turns = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], TURN)
    want = expected_text([{"role": r, "content": (c or "") if i else chat.DEFAULT_SYSTEM, "tool_calls": [{"name": k[0], "arguments": {"city": k[1][0], "days": k[1][1]}} for k in calls or []]} for i, (r, c, calls) in enumerate(rows)], None, False)
    assert [r.text for r in chat.render_conversations(turns).collect()] == [want]
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "tool_calls"))).alias("messages"))
    text = chat.render_messages(F.col("messages"), listed.schema["messages"].dataType.elementType)
    assert [r.text for r in listed.select(text.alias("text")).collect()] == [want]


def test_arguments_may_be_a_map(spark):
    turns = spark.sql(
        "SELECT 1L AS conv_id, t AS turn, if(t = 0, 'user', 'assistant') AS role, concat('c', t) AS content, "
        "if(t = 1, array(named_struct('name', 'f', 'arguments', map('k', t))), null) AS tool_calls "
        "FROM (SELECT explode(array(2L, 0L, 1L)) AS t)"
    )
    text = chat.render_conversations(turns).first().text
    assert text.endswith('assistant\nc1\n<tool_call>\n{"name": "f", "arguments": {"k": 1}}\n</tool_call><|im_end|>\n<|im_start|>assistant\nc2<|im_end|>\n')


def test_message_array_text(spark):
    talks = conversations(seed=8)
    rows = [(c, [(m["role"], m["content"], m["tool_calls"]) for m in ms]) for c, ms in talks.items()]
    kind = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:struct<city:string,days:int>>>>>"
    df = spark.createDataFrame(rows, f"conv_id long, messages {kind}")
    text = chat.render_messages(F.col("messages"), df.schema["messages"].dataType.elementType)
    got = {r.conv_id: r.text for r in df.select("conv_id", text.alias("text")).collect()}
    assert got == {c: expected_text(ms, None, False) for c, ms in talks.items()}


# --- splits, keys, lengths ---------------------------------------------------


@pytest.mark.parametrize("n_keys,ratio,want", [(4, 0.25, 1), (1, 0.5, 0), (2, 0.1, 1), (40, 0.1, 4), (100, 0.29, 28)])
def test_group_split(spark, n_keys, ratio, want):
    df = spark.range(300).select(F.concat(F.lit("db_"), F.col("id") % n_keys).alias("db_id"), "id")
    out = split.group_split(df, "db_id", ratio)
    assert out.count() == 300
    halves = {r.split: r.n for r in out.groupBy("split").agg(F.count_distinct("db_id").alias("n")).collect()}
    assert halves.get("val", 0) == want and sum(halves.values()) == n_keys
    assert split.leakage_audit(out, "db_id").where("leaks").count() == 0
    train, val = (out.where(F.col("split") == s) for s in ("train", "val"))
    assert split.shared_keys(train, val, "db_id").count() == 0


def test_group_split_with_many_keys_ranks_by_sort(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    short = {r.k for r in split.validation_keys(df, "k", 0.2).collect()}
    by_hash = sorted(map(str, range(500)), key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
    assert short == set(by_hash[:100])
    assert {r.k for r in split.validation_keys(df, "k", 0.2, seed=7).collect()} != short


def test_rows_without_a_key_stay(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert split.group_split(df, "k").count() == 3


def test_leak_is_found(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "val")], "k string, split string")
    assert [r.k for r in split.leakage_audit(df, "k").where("leaks").collect()] == ["a"]


def test_key_profile_and_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    row = keys.key_profile(parent, "p", ["k"]).first()
    assert (row.n_rows, row.n_keys, row.n_null, row.is_unique) == (4, 2, 1, False)
    child = spark.createDataFrame([(1,), (3,), (3,), (None,)], "f int")
    assert tuple(keys.fk_orphans(child, "f", parent, "k", "e").first()) == ("e", 2, 1)
    assert keys.key_profile(parent.where("k = 1"), "p", ["k"]).first().is_unique


def test_length_profile_interpolates(spark):
    import numpy as np

    rng = random.Random(9)
    xs = [rng.randint(1, 60) for _ in range(501)]
    df = spark.createDataFrame([(x,) for x in xs], "len long")
    row = lengths.length_profile(df).first()
    assert (row.n, row.min_len, row.max_len) == (501, min(xs), max(xs))
    assert row.mean_len == pytest.approx(np.mean(xs), abs=1e-4)
    for name, p in (("median_len", 50), ("p90", 90), ("p95", 95), ("p99", 99)):
        assert row[name] == pytest.approx(np.percentile(xs, p), abs=1e-4)
    cover = {r.threshold: r.coverage_pct for r in lengths.length_coverage(df, [10, 60]).collect()}
    assert cover == {10: pytest.approx(sum(x <= 10 for x in xs) / 501 * 100), 60: 100.0}


def test_measures_agree_and_cut(spark):
    df = spark.createDataFrame([(1, "SELECT a, b FROM t;"), (2, ""), (3, None)], "i int, text string")
    built_in = [r[0] for r in df.orderBy("i").select(lengths.token_count(F.col("text"))).collect()]
    python = lengths.python_token_count()
    assert built_in == [r[0] for r in df.orderBy("i").select(python(F.col("text"))).collect()] == [7, 0, None]
    row = lengths.overlength_cut(df.where("i = 1"), "text", ["i"], 3).first()
    assert (row.n_tokens, row.overlength, row.tokens) == (7, True, ["SELECT", "a", ","])


HOSTILE = [
    "", " ", None, "a", " a", "a ", "--", "a--b c", "naïve café\u0301!", "x\u00a0y", "tab\tline\n\nend\n", "😀😀 a😀b", "𝒜𝒷c-𝒟", "_a_1.2", "(a)(b)", "a" * 5000 + "!", "日本語、テスト",
]


def test_the_cut_agrees_with_all_tokens(spark):
    df = spark.createDataFrame(list(enumerate(HOSTILE)), "i int, text string")
    every = F.regexp_extract_all("text", F.lit(f"({lengths.TOKEN})"), F.lit(1))
    for n in (1, 2, 3, 100):
        cut = lengths.overlength_cut(df, "text", ["i"], n).join(df.select("i", every.alias("all")), "i")
        for r in cut.collect():
            if r["all"] is None:
                assert (r.n_tokens, r.overlength, r.tokens) == (None, None, None)
            else:
                assert (r.n_tokens, r.overlength, r.tokens) == (len(r["all"]), len(r["all"]) > n, r["all"][:n]), HOSTILE[r.i]


def test_a_text_of_ten_million_tokens(spark):
    df = spark.range(1).select(F.repeat(F.lit("ab, "), 5_000_000).alias("text"))
    row = lengths.overlength_cut(df, "text", []).select("n_tokens", "overlength", F.size("tokens").alias("n")).first()
    assert tuple(row) == (10_000_000, True, 1024)


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(9)
    xs = {p: [int(rng.paretovariate(0.8) * scale) for _ in range(4000)] + [0, 0, 1, 10**9] for p, scale in (("a", 1), ("b", 300))}
    df = spark.createDataFrame([(p, i % 7, x) for p, values in xs.items() for i, x in enumerate(values)] + [("a", 0, None)], "part string, batch int, len long")
    for error in (0.01, 0.1):
        batches = [lengths.length_sketch(df.where(F.col("batch") == b), ["part"], error) for b in range(7)]
        merged = batches[0]
        for more in batches[1:]:
            merged = lengths.merge_sketches(merged.unionByName(more), ["part"])
        whole = lengths.length_sketch(df, ["part"], error)
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
        assert whole.count() < 2 * 25 / error
        for r in lengths.sketch_profile(merged, ["part"], error).collect():
            ordered = sorted(xs[r.part])
            assert (r.n, r.min_len, r.max_len) == (len(ordered), ordered[0], ordered[-1])
            assert r.mean_len == pytest.approx(sum(ordered) / len(ordered), abs=1e-3)
            for name, p in zip(("median_len", "p90", "p95", "p99"), lengths.PERCENTILES):
                assert r[name] == pytest.approx(ordered[int(p * (len(ordered) - 1))], rel=error * 1.0001, abs=1e-4)
    assert lengths.sketch_profile(lengths.length_sketch(df.where("false"))).first().n == 0


def test_calls_in_function_form(spark):
    arguments = {"k": 1}
    flat = "struct<name:string,arguments:struct<k:int>>"
    calls = [("plain", arguments, None), (None, None, ("inner", arguments)), ("outer", arguments, ("inner", arguments))]
    turns = spark.createDataFrame(
        [(1, 0, "assistant", "", calls)], f"conv_id long, turn long, role string, content string, tool_calls array<struct<name:string,arguments:struct<k:int>,function:{flat}>>"
    )
    text = chat.render_conversations(turns).first().rendered if "rendered" in chat.render_conversations(turns).columns else chat.render_conversations(turns).first()[-1]
    assert [json.loads(x)["name"] for x in re.findall(r"<tool_call>\n(.*)\n</tool_call>", text)] == ["plain", "inner", "inner"]
    only = turns.withColumn("tool_calls", F.transform("tool_calls", lambda c: F.struct(F.lit("function").alias("type"), c["function"].alias("function"))))
    assert chat.render_conversations(only).first()[-1].count('{"name": "inner", "arguments": {"k": 1}}') == 2


def test_generator_is_made_per_task_and_sees_whole_prompts(spark):
    def make():
        return lambda prompt: f"{len(prompt)}"

    df = spark.createDataFrame([(1, "x" * 5000), (2, None)], "i int, prompt string")
    assert [r.raw_output for r in predict.with_predictions(df, make).orderBy("i").collect()] == ["5000", None]


# --- files -------------------------------------------------------------------


def write_split(path, rows):
    path.write_text(json.dumps(rows))


def test_load_split(spark, tmp_path):
    rows = [{"db_id": f"d{i % 2}", "question": f"q{i}", "query": f"SELECT {i}"} for i in range(5)]
    write_split(tmp_path / "train.json", rows)
    write_split(tmp_path / "train_others.json", [{**r, "difficulty": "hard"} for r in rows[:3]])
    alone = items.load_split(spark, str(tmp_path), "train").orderBy("item_id").collect()
    assert [r.item_id for r in alone] == list(range(5)) and alone[1].difficulty is None
    assert alone[1].db_path == f"{tmp_path}/database/d1/d1.sqlite" and alone[3].gold_sql == "SELECT 3"
    both = items.load_split(spark, str(tmp_path), "train", include_others=True).orderBy("item_id").collect()
    assert [r.item_id for r in both] == list(range(8))
    assert [r.question for r in both[5:]] == ["q0", "q1", "q2"] and both[5].difficulty == "hard"
    (tmp_path / "train_others.json").unlink()
    assert items.load_split(spark, str(tmp_path), "train", include_others=True).count() == 5
    with pytest.raises(AnalysisException):
        items.load_split(spark, str(tmp_path), "dev")


def test_split_files_are_bounded_and_keep_order(spark, tmp_path, table):
    from goldmatch.plans import workload as W

    path = f"{tmp_path}/dev.json"
    source = W.items(table)
    items.write_split_files(source, path, records_per_file=100)
    assert len(list((tmp_path / "dev.json").glob("*/part-*"))) == 15
    loaded = items.load_items(spark, [path], W.DB_ROOT)
    assert loaded.join(source, ["item_id", "gold_sql", "question", "db_path"]).count() == source.count() == 1500


def test_inventory(spark, tmp_path):
    for name, file in (("a", "a"), ("b", "other"), ("stadium", "stadium")):
        folder = tmp_path / "database" / name
        folder.mkdir(parents=True)
        (folder / f"{file}.sqlite").write_bytes(b"x")
    (tmp_path / "dev.json").write_text("[]")
    assert sorted(r.db_id for r in inventory.source_inventory(spark, str(tmp_path)).collect()) == ["a", "stadium"]
    missing = {r.name for r in inventory.missing_sources(spark, str(tmp_path)).collect()}
    assert missing == {"tables.json"} | {f"database/{d}/{d}.sqlite" for d in inventory.REQUIRED_DATABASES if d != "stadium"}


def test_inventory_is_anchored(spark, tmp_path):
    """Copies in other folders do not count, neither as databases nor as required files."""
    for place in ("database/a/a.sqlite", "database/a/old/b/b.sqlite", "backup/database/c/c.sqlite", "database/stray.sqlite", "old/dev.json", "database/stadium/x/stadium.sqlite"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(b"x")
    (tmp_path / "tables.json").write_text("{}")
    assert [r.db_id for r in inventory.source_inventory(spark, f"{tmp_path}/").collect()] == ["a"]
    missing = {r.name for r in inventory.missing_sources(spark, str(tmp_path), databases=["a", "c", "stadium"]).collect()}
    assert missing == {"dev.json", "database/c/c.sqlite", "database/stadium/stadium.sqlite"}
    assert inventory.source_inventory(spark, f"{tmp_path}/nowhere").collect() == []


def test_catalog_of_tables(spark):
    tables = {
        "quay": lambda s: s.createDataFrame([("A1", 9.5), ("B2", None)], "code string not null, depth double"),
        "vessel": lambda s: s.createDataFrame([(7, ["x"], "A1")], "imo bigint, names array<string>, home string"),
        "empty": lambda s: s.createDataFrame([], "a decimal(9,2), b timestamp_ntz"),
    }
    columns = catalog.catalog_columns(spark, {"harbour": tables}, {"quay": ["code"]})
    assert [(r.table_no, r.name, r.data_type, r.not_null, r.pk) for r in columns.collect()] == [
        (0, "code", "string", 1, 1), (0, "depth", "double", 0, 0), (1, "imo", "bigint", 0, 0), (1, "names", "array<string>", 0, 0), (1, "home", "string", 0, 0),
        (2, "a", "decimal(9,2)", 0, 0), (2, "b", "timestamp_ntz", 0, 0),
    ]
    seen = catalog.catalog_columns(spark, {"harbour": tables}, observe=True)
    assert {r.name: r.not_null for r in seen.collect()} == {"code": 1, "depth": 0, "imo": 1, "names": 1, "home": 1, "a": 1, "b": 1}
    fks = catalog.catalog_fks(spark, {"harbour": tables}, [("vessel", "home", "quay", "code"), ("vessel", "imo", "nowhere", "x")])
    text = schema.schema_text(columns, fks).first().ddl
    assert "code STRING PRIMARY KEY" in text and "names ARRAY<STRING>" in text and text.count("FOREIGN KEY") == 1


def test_samples_round_trip(spark, tmp_path):
    rows = [(1, "d", "q", "SELECT 1", None, "ddl", "train"), (2, "e", "q2", " SELECT 2 ", "easy", "", "val")]
    df = spark.createDataFrame(rows, "item_id long, db_id string, question string, gold_sql string, difficulty string, schema_ddl string, split string")
    path = f"{tmp_path}/samples"
    samples.write_samples_jsonl(samples.sft_samples(df), path)
    line = json.loads(spark.read.text(f"{path}/split=train").first().value)
    assert line["difficulty"] is None and [m["role"] for m in line["messages"]] == ["system", "user", "assistant"]
    back = samples.read_labelled_splits(spark, path, {"train": "train", "val": "validation"})
    assert {(r.item_id, r.split, r.messages[2].content) for r in back.collect()} == {
        (1, "train", "```sql\nSELECT 1\n```"), (2, "validation", "```sql\nSELECT 2\n```"),
    }


def test_samples_are_stored_small(spark, tmp_path):
    """Files are compressed, and long rows are not sorted by their split."""
    text = F.repeat(F.lit("CREATE TABLE t (a TEXT);\n"), 100)
    df = spark.range(400).select(
        F.col("id").alias("item_id"), F.lit("d").alias("db_id"), F.lit("q").alias("question"), F.lit("SELECT 1").alias("gold_sql"),
        F.lit(None).cast("string").alias("difficulty"), text.alias("schema_ddl"), F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"),
    )
    conf, name = spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, "0")
    for compression, suffix in (("gzip", "json.gz"), ("none", "json")):
        samples.write_samples_jsonl(samples.sft_samples(df), f"{tmp_path}/{suffix}", compression)
        assert conf.get(name, "0") == before
        lines = spark.read.text(f"{tmp_path}/{suffix}").groupBy("split").count()
        assert {(r.split, r["count"]) for r in lines.collect()} == {("train", 300), ("val", 100)}
    samples.write_samples_jsonl(samples.sft_samples(df), f"{tmp_path}/default")
    size = {d: sum(f.stat().st_size for f in (tmp_path / d).glob("split=*/part-*")) for d in ("default", "json")}
    assert size["default"] * 10 < size["json"]


def test_folders_are_written_by_many_tasks(spark, tmp_path):
    names = spark.range(30).select(F.concat(F.lit("db_"), F.col("id").cast("string")).alias("db_id"))
    registry._write_folders(names, f"{tmp_path}/database", per_task=5)
    files = list((tmp_path / "database").glob("db_id=*/part-*.json"))
    assert len(files) == 30 and len({f.name.split("-")[1] for f in files}) > 2
    found = inventory.source_inventory(spark, str(tmp_path), "database/db_id=*/*.json", r"^database/db_id=([^/]+)/[^/]+$")
    assert {r.db_id for r in found.collect()} == {f"db_{i}" for i in range(30)}
    registry._write_folders(names.limit(0), f"{tmp_path}/none")
    assert not list((tmp_path / "none").glob("db_id=*"))


def test_folders_are_made_in_place(spark, tmp_path):
    """The folders and lines of Spark's writer, at many places by one job, without Hadoop's local files."""
    odd = ["a", "a", None, "", "x/y=z", "50%", 'q"#\'*:?\\{[]^', "tab\there", "päd é", "."]
    names = spark.createDataFrame([(n,) for n in odd], "db_id string")
    places = [tmp_path / "database", tmp_path / "backup" / "database", tmp_path / "database" / "old"]
    registry._write_folders(names, *map(str, places), per_task=4)
    names.withColumn("named", F.col("db_id")).write.partitionBy("db_id").json(f"{tmp_path}/spark")

    def lines(place):
        return sorted((f.parent.name, line) for f in place.glob("db_id=*/part-*.json") for line in f.read_text().splitlines())

    for place in places:
        assert lines(place) == lines(tmp_path / "spark") and len(lines(place)) == len(odd)
        assert not list(place.rglob("*.crc")) and not (place / "_temporary").exists()


def test_a_folder_task_may_run_again(tmp_path, monkeypatch):
    monkeypatch.setattr(registry.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda _: 3})())
    make, row = registry._folder_maker([str(tmp_path)]), Row("db_id", "line")
    for _ in range(2):
        make([row("a", "1"), row("b", "2"), row("a", "3")])
    assert (tmp_path / "db_id=a" / "part-00003.json").read_text() == "1\n3\n"
    assert (tmp_path / "db_id=b" / "part-00003.json").read_text() == "2\n"


def _odd_tree(root):
    files = ["dev.json", "top.sqlite", "database/a/a.sqlite", "database/a/b.sqlite", "database/a/_h.sqlite", "database/a/.h.sqlite", "database/a/x._COPYING_",
             "database/a/_k=v.sqlite", "database/a/_metadata.sqlite", "database/.b/b.sqlite", "database/_c/c.sqlite", "database/d e/d e.sqlite", "database/50%/50%25.sqlite",
             "database/a+b/a+b.sqlite", "database/deep/er/er.sqlite", "database/é/é.sqlite", "database/flat.sqlite", "other/a/a.sqlite", "database/star*/s.sqlite"]
    for f in files:
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_bytes(b"x")
    (root / "database/linked").symlink_to(root / "other" / "a")
    (root / "database/a/gone.sqlite").symlink_to(root / "nowhere")


GLOBS = ["database/*/*.sqlite", "database/a/*", "*/?/?.sqlite", "database/[ad]*/*", "database/[!a]/*", "database/{a,deep/er}/*.sqlite", "{dev,no}.json", "dev.json", "dev.json/x",
         "no.json", "*/*/*/*", "*", "*/a/a.sqlite", "database/star\\*/*.sqlite", "database//a/a.sqlite", "database/a/_h.sqlite", "database/a/gone.sqlite", "nowhere/*/*", "database/a+b/*", "database/50%/*"]


def test_listing_agrees_with_sparks_readers(spark, tmp_path):
    _odd_tree(tmp_path)
    full = qualified(spark, str(tmp_path))
    fs = full.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    globbed, by_spark, by_tasks = {}, [], []
    for glob in GLOBS:
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{full.toString()}/{glob}")) or []
        globbed[glob] = {x.getPath().toString().removeprefix(f"{full.toString()}/") for x in found}
        by_spark.append(inventory._looked_up(spark, full.toString(), glob).withColumn("glob", F.lit(glob)))
        by_tasks.append(inventory._listed(spark, str(tmp_path), [glob]).withColumn("glob", F.lit(glob)))
    by_spark, by_tasks = ({(r.glob, r.name) for r in reduce(DataFrame.union, x).coalesce(4).collect()} for x in (by_spark, by_tasks))
    assert by_tasks == {(g, n) for g, n in by_spark if n in globbed[g]}  # Spark enters a folder that matches
    assert len(by_tasks) > 20
    both = inventory.files_below(spark, f"file://{tmp_path}/", ["database/*/*.sqlite", "dev.json", "database/a/*"])
    assert both.count() == len(set(both.collect())) and {"dev.json", "database/linked/a.sqlite"} <= {r.name for r in both.collect()}


def test_listing_passes_over_names_that_are_no_text(spark, tmp_path):
    for folder in (b"a", b"bad\xff"):
        os.makedirs(os.fsencode(tmp_path) + b"/database/" + folder)
        for file in (b"a.sqlite", b"\xfe.sqlite"):
            open(os.fsencode(tmp_path) + b"/database/" + folder + b"/" + file, "wb").close()
    assert [r.name for r in inventory.files_below(spark, str(tmp_path), ["database/*/*"]).collect()] == ["database/a/a.sqlite"]


def test_tasks_list_the_folders(spark, tmp_path, monkeypatch):
    """The driver neither looks the pattern up nor holds the paths; found once, the names stay."""
    for i in range(40):
        (tmp_path / f"database/db_{i}").mkdir(parents=True)
        (tmp_path / f"database/db_{i}/db_{i}.sqlite").write_bytes(b"x")

    def unwanted(*_, **__):
        raise AssertionError("looked up by the driver")

    monkeypatch.setattr(DataFrameReader, "load", unwanted)
    found = inventory.source_inventory(spark, str(tmp_path))
    monkeypatch.undo()
    (tmp_path / "database/db_0/db_0.sqlite").unlink()
    assert {r.db_id for r in found.collect()} == {f"db_{i}" for i in range(40)}


def _only_tasks(spark, monkeypatch, query, orders):
    """``query`` over these orders, without folders moved or looked up by the driver."""
    tables = {"orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string"), "region": spark.range(1)}

    def unwanted(*_, **__):
        raise AssertionError("by the driver")

    monkeypatch.setattr(DataFrameReader, "load", unwanted)
    monkeypatch.setattr(DataFrameWriter, "partitionBy", unwanted)
    return {r.db_id for r in query(tables.__getitem__).collect()}


def test_folder_inventory_by_tasks(spark, monkeypatch):
    orders = [(i, i, "O") for i in range(3000)] + [(7, None, "O"), (7, 7, "F"), (None, 30_000, None)]
    found = _only_tasks(spark, monkeypatch, registry.folder_inventory, orders)
    assert found == {f"db_{i}" for i in range(300)} | {"db_3000", "__HIVE_DEFAULT_PARTITION__"}


def test_missing_folders_by_tasks(spark, monkeypatch):
    orders = [(20 * i, 10 * i, "O" if i % 3 else "F") for i in range(300)]  # all hard: every third database is finished
    orders += [(41, 30_000, "O"), (6020, None, "O"), (None, 40_000, "O"), (20, 50_000, "F"), (40, 60_000, None), (40, 70_000, "O")]
    found = _only_tasks(spark, monkeypatch, registry.missing_folders, orders)
    # keys repeat: 20 is open in another row; a database without a name is always missing
    assert found == {f"db_{i}" for i in range(0, 300, 3)} | {"db_3000", "db_4000", None}


def test_stores_that_only_spark_reaches(spark, tmp_path):
    """Written and listed by Spark there, with the same names."""
    root = f"viewfs://{tmp_path.name.replace('_', '-')}/in"
    spark.conf.set(f"fs.viewfs.mounttable.{tmp_path.name.replace('_', '-')}.link./in", f"file://{tmp_path}")
    names = spark.range(7).select(F.concat(F.lit("db_"), F.col("id").cast("string")).alias("db_id"))
    assert mounted_path(spark, root) is None and mounted_path(spark, f"{tmp_path}/") == str(tmp_path)
    registry._write_folders(names, f"{root}/database", f"{root}/backup/database", per_task=3)
    for place in ("database", "backup/database"):
        found = inventory.source_inventory(spark, root, f"{place}/db_id=*/*.json", rf"^{place}/db_id=([^/]+)/[^/]+$")
        assert {r.db_id for r in found.collect()} == {f"db_{i}" for i in range(7)}
    assert inventory.source_inventory(spark, root).collect() == []

