"""The registered queries once more, as SQL for an independent engine."""

from __future__ import annotations

import math

from goldmatch.functions import prompts as P
from goldmatch.functions import sqltext as Q
from goldmatch.functions import statuses as S
from goldmatch.functions.text import WHITESPACE
from goldmatch.operators import chat
from goldmatch.operators.lengths import MAX_TOKENS, PERCENTILES, SKETCH_ERROR, THRESHOLDS, TOKEN
from goldmatch.operators.metrics import QUERY_TYPES, TIERS
from goldmatch.operators.runs import BIG_WIN_POINTS, TIER_ORDER, TYPE_ORDER
from goldmatch.operators.schema import INTERNAL_TABLES
from goldmatch.plans import workload as W
from goldmatch.plans.pairs import CORPUS, CORRECT, DATABASE
from goldmatch.plans.registry import FIRST_ITEMS, ROW_CAP
from goldmatch.plans.shapes import SQL


def lit(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + text.replace("'", "''") + "'"


SPACES = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def ctes(**parts: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in parts.items()) + " "


def filled(template: str, mark: str, value: str) -> str:
    return "concat(" + ", ".join(_pieces(template, mark, value)) + ")"


def _pieces(template: str, mark: str, value: str) -> list[str]:
    head, *rest = template.split(mark)
    out = [lit(head)]
    for piece in rest:
        out += [value, lit(piece)]
    return out


def choose(index: str, values: list[str], default: str = "NULL") -> str:
    lines = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {index} {lines} ELSE {default} END"


# --- views ---------------------------------------------------------------------

_GOLD = choose(f"o_orderkey % {len(W.GOLD_TEMPLATES)}", [filled(x, "{k}", "o_custkey") for x in W.GOLD_TEMPLATES])
_RAW = choose(f"o_custkey % {len(W.RAW_WRAPPERS)}", [filled(x, "{sql}", "gold_sql") for x in W.RAW_WRAPPERS])
_DB = f"concat('db_', o_custkey // {W.CUSTOMERS_PER_DB})"
ITEMS = (
    f"SELECT o_orderkey AS item_id, db_id, concat('Orders of customer ', o_custkey) AS question, gold_sql, "
    f"concat('{W.DB_ROOT}/database/', db_id, '/', db_id, '.sqlite') AS db_path, "
    f"CASE o_orderkey % 20 WHEN 0 THEN 'hard' WHEN 1 THEN '' END AS difficulty, {_RAW} AS raw_output "
    f"FROM (SELECT *, {_GOLD} AS gold_sql, {_DB} AS db_id FROM orders) AS o"
)
INVENTORY = (
    f"SELECT concat('db_', c_custkey // {W.CUSTOMERS_PER_DB}) AS db_id FROM customer "
    f"GROUP BY c_custkey // {W.CUSTOMERS_PER_DB} HAVING max(c_acctbal) > {W.CATALOG_BALANCE}"
)


def _values(rows: list[list[str]]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows)


_COLUMN_ROWS = [
    [str(no), lit(table), str(cid), lit(name), lit(dtype), str(nn), str(pk)]
    for no, (table, cols) in enumerate(W.CATALOG)
    for cid, (name, dtype, nn, pk) in enumerate(cols)
]
_NUMBER = {table: no for no, (table, _) in enumerate(W.CATALOG)}
_FK_ROWS = [
    [str(_NUMBER[table]), lit(table), str(no), lit(source), lit(to_table), lit(target)]
    for no, (table, source, to_table, target) in enumerate(W.FOREIGN_KEYS)
]
_INTERNAL = ", ".join(lit(x) for x in INTERNAL_TABLES)
COLUMNS = (
    f"SELECT i.db_id, v.* FROM ({INVENTORY}) AS i, ({_values(_COLUMN_ROWS)}) "
    "AS v(table_no, table_name, cid, name, data_type, not_null, pk)"
)
FKS = (
    f"SELECT i.db_id, v.* FROM ({INVENTORY}) AS i, ({_values(_FK_ROWS)}) "
    "AS v(table_no, table_name, fk_no, from_column, to_table, to_column)"
)
CLEAN_COLUMNS = (
    "SELECT db_id, table_no, table_name, cid, name, upper(coalesce(nullif(data_type, ''), 'TEXT')) AS data_type, "
    f"not_null <> 0 AS not_null, pk <> 0 AS is_primary_key FROM ({COLUMNS}) AS c"
)
CLEAN_FKS = (
    "SELECT db_id, table_no, table_name, fk_no, from_column, to_table, "
    f"coalesce(nullif(to_column, ''), from_column) AS to_column FROM ({FKS}) AS f WHERE from_column IS NOT NULL"
)
DDL = ctes(
    col=f"SELECT * FROM ({CLEAN_COLUMNS}) AS c WHERE table_name NOT IN ({_INTERNAL})",
    pk="SELECT db_id, table_no, count(*) AS n, string_agg(name, ', ' ORDER BY cid) AS pks FROM col "
    "WHERE is_primary_key GROUP BY db_id, table_no",
    line="SELECT col.db_id, col.table_no, table_name, 1 AS part, cid AS no, concat('    ', name, ' ', data_type, "
    "CASE WHEN is_primary_key AND n = 1 THEN ' PRIMARY KEY' ELSE '' END) AS txt "
    "FROM col LEFT JOIN pk ON col.db_id = pk.db_id AND col.table_no = pk.table_no "
    "UNION ALL SELECT pk.db_id, pk.table_no, (SELECT min(table_name) FROM col WHERE col.db_id = pk.db_id "
    "AND col.table_no = pk.table_no), 2, 0, concat('    PRIMARY KEY (', pks, ')') FROM pk WHERE n > 1 "
    "UNION ALL SELECT db_id, table_no, table_name, 3, fk_no, concat('    FOREIGN KEY (', from_column, ') REFERENCES ', "
    f"to_table, '(', to_column, ')') FROM ({CLEAN_FKS}) AS f WHERE table_name NOT IN ({_INTERNAL})",
    tab="SELECT db_id, table_no, concat('CREATE TABLE ', table_name, ' (', chr(10), "
    "string_agg(txt, concat(',', chr(10)) ORDER BY part, no), chr(10), ');') AS ddl "
    "FROM line GROUP BY db_id, table_no, table_name",
) + "SELECT db_id, string_agg(ddl, concat(chr(10), chr(10)) ORDER BY table_no) AS ddl FROM tab GROUP BY db_id"
ITEMS_DDL = f"SELECT i.*, coalesce(d.ddl, '') AS schema_ddl FROM ({ITEMS}) AS i LEFT JOIN ({DDL}) AS d ON i.db_id = d.db_id"


def status(message: str) -> str:
    out = f"CASE WHEN {message} IS NULL THEN '{S.SUCCESS}' "
    for name, parts in S.MESSAGE_PARTS.items():
        test = " OR ".join(f"contains(lower({message}), {lit(p)})" for p in parts)
        out += f"WHEN {test} THEN '{name}' "
    return out + f"ELSE '{S.EXECUTION_ERROR}' END"


def _messages(run: str) -> tuple[str, str]:
    shift, _ = W.RUNS[run]
    gold = f"CASE WHEN o_orderkey % {W.GOLD_FAILS_EVERY} = 0 THEN {lit(W.GOLD_ERROR)} END"
    pred = choose(f"(o_custkey + {shift}) % {W.ERROR_CYCLE}", [lit(e) for e in W.ERROR_TEXTS])
    return gold, pred


def executed(run: str = "a") -> str:
    gold, pred = _messages(run)
    return (
        f"SELECT item_id, {status('gold_message')} AS gold_status, gold_message, "
        f"{status('pred_message')} AS pred_status, pred_message, execution_time_ms FROM (SELECT "
        f"o_orderkey AS item_id, {gold} AS gold_message, {pred} AS pred_message, "
        "CAST(o_orderkey % 50 AS DOUBLE) + 0.5 AS execution_time_ms FROM orders) AS o"
    )


_ORDER = ", ".join(W.LINE_ORDER)
NUMBERED = (
    f"SELECT l_orderkey AS item_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS row_no, "
    "count(*) OVER (PARTITION BY l_orderkey) AS n_rows, l_partkey AS part, "
    "l_extendedprice * (1 - l_discount) AS price, l_returnflag AS flag FROM lineitem"
)


def sides(run: str = "a") -> dict[str, str]:
    """CTEs num, gold and pred: normalised result rows."""
    _, shift = W.RUNS[run]
    mode = f"(item_id + {shift}) % {W.CHANGE_CYCLE}"
    price = "printf('%.4f', {0})"
    moved = f"CASE {mode} WHEN 1 THEN n_rows - 1 - row_no WHEN 2 THEN row_no - 1 WHEN 3 THEN row_no + 1 ELSE row_no END"
    nudged = f"CASE WHEN {mode} = 4 THEN price + 0.00001 ELSE price END"
    padded = f"CASE WHEN {mode} = 4 THEN concat('  ', flag, chr(9), ' ') ELSE flag END"
    return {
        f"num_{run}": NUMBERED,
        f"gold_{run}": f"SELECT item_id, row_no, part, {price.format('price')} AS price, {strip('flag')} AS flag FROM num_{run}",
        f"pred_{run}": (
            f"SELECT * FROM (SELECT item_id, {moved} AS row_no, part, {price.format(nudged)} AS price, "
            f"{strip(padded)} AS flag FROM num_{run}) AS m WHERE row_no >= 0 "
            f"UNION ALL SELECT item_id, row_no, part, {price.format('price')}, {strip('flag')} FROM num_{run} "
            f"WHERE {mode} = 3 AND row_no = 0"
        ),
    }


def differing(run: str, fields: str) -> str:
    g, p = f"SELECT {fields} FROM gold_{run}", f"SELECT {fields} FROM pred_{run}"
    return f"SELECT DISTINCT item_id FROM (({g} EXCEPT ALL {p}) UNION ALL ({p} EXCEPT ALL {g})) AS d"


def diffs(run: str = "a") -> dict[str, str]:
    return {
        **sides(run),
        f"lists_{run}": differing(run, "item_id, row_no, part, price, flag"),
        f"bags_{run}": differing(run, "item_id, part, price, flag"),
    }


def order_sensitive(x: str) -> str:
    return f"regexp_matches({x}, '\\border\\s+by\\b', 'i')"


def _contains_any(x: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(m)})" for m in marks) + ")"


def query_type(x: str) -> str:
    up = f"upper({x})"
    from_list = f"regexp_extract({up}, '\\bFROM\\s+([^;]+?)(?:\\bWHERE\\b|\\bGROUP\\b|\\bORDER\\b|\\bLIMIT\\b|$)', 1)"
    return (
        f"CASE WHEN len(regexp_extract_all({up}, '\\bSELECT\\b')) > 1 THEN 'nested' "
        f"WHEN contains({up}, ' JOIN ') OR contains({from_list}, ',') THEN 'join' "
        f"WHEN {_contains_any(up, [*Q.AGGREGATE_MARKS, 'GROUP BY', 'HAVING'])} THEN 'aggregation' "
        "ELSE 'single_table' END"
    )


def estimate(x: str) -> str:
    up = f"upper({x})"
    score = (
        f"(2 * CAST(contains({up}, ' JOIN ') OR regexp_matches({up}, '\\bFROM\\s+[^,;]+,[^,;]+') AS INTEGER) "
        f"+ CAST(contains({up}, 'GROUP BY') AS INTEGER) + CAST(contains({up}, 'ORDER BY') AS INTEGER) "
        f"+ CAST({_contains_any(up, Q.AGGREGATE_MARKS)} AS INTEGER) "
        f"+ len(regexp_extract_all({up}, '\\b(AND|OR)\\b')))"
    )
    return (
        f"CASE WHEN len(regexp_extract_all({up}, '\\bSELECT\\b')) > 1 OR {_contains_any(up, Q.SET_MARKS)} THEN 'extra' "
        f"WHEN {score} <= 1 THEN 'easy' WHEN {score} <= 3 THEN 'medium' ELSE 'hard' END"
    )


def difficulty(annotated: str, x: str) -> str:
    return f"coalesce(nullif({annotated}, ''), {estimate(x)})"


def extracted(rel: str, raw: str, keep: str, name: str = "predicted_sql") -> str:
    fence = "'```(?:sql)?\\s*([\\s\\S]*?)\\s*```'"
    stmt = "'\\b(WITH[\\s\\S]+?SELECT[\\s\\S]+|SELECT[\\s\\S]+)'"
    found = (
        f"CASE WHEN regexp_matches(_t, {fence}, 'i') THEN regexp_extract(_t, {fence}, 1, 'i') "
        f"WHEN regexp_matches(_t, {stmt}, 'i') THEN regexp_extract(_t, {stmt}, 1, 'i') ELSE _t END"
    )
    first = f"split_part(_f, {lit('```')}, 1)"
    return (
        f"SELECT {keep}, CASE WHEN _b LIKE '%;' THEN {strip('_b[:-2]')} ELSE _b END AS {name} "
        f"FROM (SELECT *, {strip(first)} AS _b FROM (SELECT *, {strip(found)} AS _f "
        f"FROM (SELECT *, {strip(raw)} AS _t FROM {rel}) AS t1) AS t2) AS t3"
    )


def samples_ctes(run: str = "a") -> dict[str, str]:
    """CTEs up to samples_<run>: the fact table."""
    judged = (
        "SELECT i.*, e.gold_status, e.pred_status, e.execution_time_ms, e.gold_message, e.pred_message, "
        f"e.pred_status = 'SUCCESS' AND e.gold_status = 'SUCCESS' AND CASE WHEN {order_sensitive('i.gold_sql')} "
        "THEN l.item_id IS NULL ELSE b.item_id IS NULL END AS is_correct "
        f"FROM ({ITEMS}) AS i JOIN ({executed(run)}) AS e ON i.item_id = e.item_id "
        f"LEFT JOIN lists_{run} AS l ON i.item_id = l.item_id LEFT JOIN bags_{run} AS b ON i.item_id = b.item_id"
    )
    message = (
        f"CASE WHEN pred_status <> 'SUCCESS' THEN concat(pred_status, ': ', pred_message) "
        f"WHEN gold_status <> 'SUCCESS' THEN concat('{S.GOLD_SQL_ERROR}: ', gold_message) "
        f"WHEN NOT is_correct THEN '{S.RESULT_SET_MISMATCH}' END AS error_message"
    )
    return {
        **diffs(run),
        f"judged_{run}": judged,
        f"samples_{run}": (
            "SELECT item_id, db_id, question, gold_sql, predicted_sql, "
            f"{difficulty('difficulty', 'gold_sql')} AS difficulty, {query_type('gold_sql')} AS query_type, "
            f"is_correct, gold_status, pred_status, {message}, execution_time_ms "
            f"FROM ({extracted(f'judged_{run}', 'raw_output', '*')}) AS x"
        ),
    }


_ACC = "coalesce(CAST(count_if(is_correct) AS DOUBLE) / nullif(count(*), 0), 0)"
_CORRECT = "CAST(count_if(is_correct) AS BIGINT)"
_VALID = "CAST(count_if(pred_status = 'SUCCESS') AS BIGINT)"


def long_of(run: str = "a") -> str:
    def part(dim: str, key: str, group: str) -> str:
        return (
            f"SELECT '{dim}' AS dimension, {key} AS key, count(*) AS total, {_CORRECT} AS correct, "
            f"{_VALID} AS valid, {_ACC} AS accuracy FROM samples_{run} {group}"
        )

    return " UNION ALL ".join(
        [
            part("overall", "'all'", ""),
            part("difficulty", "difficulty", "GROUP BY difficulty"),
            part("query_type", "query_type", "GROUP BY query_type"),
        ]
    )


def errors_of(run: str = "a") -> str:
    return (
        f"SELECT CASE WHEN pred_status <> 'SUCCESS' THEN pred_status ELSE '{S.RESULT_MISMATCH}' END AS category, "
        f"count(*) AS n FROM samples_{run} WHERE NOT is_correct GROUP BY 1"
    )


def label(x: str) -> str:
    words = f"replace({x}, '_', ' ')"
    return f"concat(upper({words}[1]), lower({words}[2:]))"


def pct(x: str) -> str:
    return f"printf('%.2f%%', {x})"


def fixed(keys: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({lit(k)}, {i})" for i, k in enumerate(keys)) + ") AS f(key, position)"


def table_of(dim: str, keys: list[str]) -> str:
    return (
        f"SELECT f.position, {label('f.key')} AS label, coalesce(m.total, 0) AS total, coalesce(m.correct, 0) AS correct, "
        f"{pct('coalesce(m.accuracy, 0) * 100')} AS accuracy FROM {fixed(keys)} "
        f"LEFT JOIN (SELECT * FROM m WHERE dimension = '{dim}') AS m ON f.key = m.key"
    )


def runs_of(dim: str, keys: list[str]) -> str:
    text = lambda m: f"concat(printf('%.2f', {m}.accuracy * 100), '% (', {m}.correct, '/', {m}.total, ')')"
    delta = "(b.accuracy * 100 - a.accuracy * 100)"
    return ctes(**samples_ctes("a"), **samples_ctes("b"), la=long_of("a"), lb=long_of("b")) + (
        f"SELECT f.position, f.key, {label('f.key')} AS label, {text('a')} AS baseline_text, {text('b')} AS candidate_text, "
        f"printf('%+.2f%%', {delta}) AS delta_text, CASE WHEN {delta} > {BIG_WIN_POINTS} THEN 'big_win' "
        f"WHEN {delta} > 0 THEN 'up' ELSE 'flat' END AS flag FROM {fixed(keys)} "
        f"JOIN la AS a ON a.dimension = '{dim}' AND a.key = f.key JOIN lb AS b ON b.dimension = '{dim}' AND b.key = f.key"
    )


def val_keys(rel: str, key: str, ratio: float = 0.1, seed: int = 42) -> str:
    ranked = (
        f"SELECT {key}, row_number() OVER (ORDER BY md5(concat('{seed}|', {key})), {key}) AS rn, "
        f"count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {rel}) AS k"
    )
    n_val = f"CASE WHEN n > 1 THEN greatest(1, floor(n * CAST({ratio} AS DOUBLE))) ELSE 0 END"
    return f"SELECT {key} FROM ({ranked}) AS r WHERE rn <= {n_val}"


def split_of(rel: str, key: str) -> str:
    return (
        f"SELECT r.*, CASE WHEN v.{key} IS NULL THEN 'train' ELSE 'val' END AS split FROM {rel} AS r "
        f"LEFT JOIN ({val_keys(rel, key)}) AS v ON r.{key} = v.{key}"
    )


TOKENS = f"regexp_extract_all(text, {lit(TOKEN)})"


def profile(rel: str) -> str:
    names = ["median_len", "p90", "p95", "p99"]
    quantiles = ", ".join(f"round(quantile_cont(len, {p}), 4) AS {n}" for p, n in zip(PERCENTILES, names))
    return (
        f"SELECT part, count(*) AS n, min(len) AS min_len, round(avg(len), 4) AS mean_len, {quantiles}, "
        f"max(len) AS max_len FROM ({rel}) AS l GROUP BY part"
    )


def user_content(ddl: str, question: str) -> str:
    return (
        f"concat({lit(P.SCHEMA_HEADING.format(dialect=P.DIALECT))}, {strip(ddl)}, {lit(P.QUESTION_HEADING)}, "
        f"{strip(question)}, {lit(P.ANSWER_HEADING)})"
    )


def demo_messages() -> list[tuple[str, str]]:
    out = [("system", lit(P.system_text()))]
    for ddl, question, sql in P.DEMONSTRATIONS:
        out.append(("user", user_content(lit(ddl), lit(question))))
        out.append(("assistant", f"concat({lit('```sql' + chr(10))}, {lit(sql)}, {lit(chr(10) + '```')})"))
    return out


def chatml(messages: list[tuple[str, str]]) -> str:
    turns = [f"{lit('<|im_start|>' + role + chr(10))}, {text}, {lit('<|im_end|>' + chr(10))}" for role, text in messages]
    return "concat(" + ", ".join(turns) + f", {lit(P.OPEN_TURN)})"


USER = user_content("schema_ddl", "question")
ANSWER = f"concat({lit('```sql' + chr(10))}, {strip('gold_sql')}, {lit(chr(10) + '```')})"
FULL = chatml([("system", lit(P.system_text())), ("user", USER), ("assistant", ANSWER)])
TRAINING = f"SELECT s.*, coalesce(d.ddl, '') AS schema_ddl FROM ({split_of('(SELECT * FROM it)', 'db_id')}) AS s LEFT JOIN ({DDL}) AS d ON s.db_id = d.db_id"


def _call(name: str, note: str) -> str:
    return (
        f"concat({lit(chat.CALL_BEFORE)}, '{{\"name\": \"{name}\", \"arguments\": {{\"custkey\": ', o_custkey, "
        f"', \"status\": \"', o_orderstatus, '\", \"note\": ', {note}, '}}}}', {lit(chat.CALL_AFTER)})"
    )


_CALLS = f"concat({_call('find_orders', lit('null'))}, {_call('order_total', 'concat(' + lit(chr(34) + 'say ' + chr(92) + chr(34)) + ', o_orderpriority, ' + lit(chr(92) + chr(34) + chr(34)) + ')')})"
# slot, keep?, role, content, calls
CHAT = (
    "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY slot) - 1 AS turn FROM ("
    "SELECT o_orderkey AS conv_id, 0 AS slot, 'system' AS role, 'Answer from the order book.' AS content, NULL AS calls "
    "FROM orders WHERE o_orderkey % 3 <> 0 "
    "UNION ALL SELECT o_orderkey, 1, 'user', concat('Orders of customer ', o_custkey), NULL FROM orders "
    f"UNION ALL SELECT o_orderkey, 2, 'assistant', CASE WHEN o_orderkey % 5 <> 0 THEN 'Looking up.' ELSE '' END, {_CALLS} FROM orders "
    "UNION ALL SELECT o_orderkey, 3, 'tool', concat('status ', o_orderstatus), NULL FROM orders "
    "UNION ALL SELECT o_orderkey, 4, 'tool', CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR), NULL FROM orders WHERE o_orderkey % 2 = 0 "
    "UNION ALL SELECT o_orderkey, 5, 'assistant', 'Done.', NULL FROM orders "
    "UNION ALL SELECT o_orderkey, 6, 'tool', 'late', NULL FROM orders WHERE o_orderkey % 7 = 0) AS u"
)
MARKED = (
    "SELECT *, role = 'tool' AND coalesce(lag(role) OVER w, '') <> 'tool' AS opens, "
    "role = 'tool' AND coalesce(lead(role) OVER w, '') <> 'tool' AS closes FROM {0} AS c "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
)


def rendered(turns: str, tools: list[dict] | None, open_turn: bool) -> str:
    import json

    listed = ""
    if tools:
        listed = chat.TOOLS_BEFORE + "".join("\n" + json.dumps(x, ensure_ascii=False) for x in tools) + chat.TOOLS_AFTER
    start, end, nl = lit("<|im_start|>"), lit("<|im_end|>\n"), "chr(10)"
    head = (
        f"concat({start}, 'system', {nl}, coalesce(max(CASE WHEN turn = 0 AND role = 'system' THEN content END), "
        f"{lit(chat.DEFAULT_SYSTEM)}), {lit(listed)}, {end})"
    )
    plain = f"concat({start}, role, {nl}, content, {end})"
    body = (
        f"CASE WHEN role = 'system' AND turn = 0 THEN '' WHEN role = 'tool' THEN concat("
        f"CASE WHEN opens THEN {lit('<|im_start|>user')} ELSE '' END, {lit(chat.RESPONSE_BEFORE)}, content, "
        f"{lit(chat.RESPONSE_AFTER)}, CASE WHEN closes THEN {end} ELSE '' END) "
        f"WHEN calls IS NOT NULL THEN concat({start}, role, CASE WHEN content <> '' THEN concat({nl}, content) ELSE '' END, "
        f"calls, {end}) ELSE {plain} END"
    )
    tail = lit(P.OPEN_TURN if open_turn else "")
    return ctes(turns=turns, marked=MARKED.format("turns")) + (
        f"SELECT conv_id, CAST(0 AS BIGINT) AS part_no, concat({head}, string_agg({body}, '' ORDER BY turn), {tail}) AS text "
        "FROM marked GROUP BY conv_id"
    )


def _key_profile(table: str, key: list[str]) -> str:
    no_null = " AND ".join(f"{k} IS NOT NULL" for k in key)
    cols = ", ".join(key)
    n_rows, n_null = f"(SELECT count(*) FROM {table})", f"(SELECT count(*) FROM {table} WHERE NOT ({no_null}))"
    n_keys = f"(SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {table} WHERE {no_null}) AS k)"
    return (
        f"SELECT '{table}' AS table_name, '{cols}' AS key_columns, {n_rows} AS n_rows, {n_keys} AS n_keys, "
        f"{n_null} AS n_null, {n_rows} = {n_keys} AND {n_null} = 0 AS is_unique"
    )


def _orphans(child: str, fk: str, parent: str, pk: str) -> str:
    lost = f"FROM {child} WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {pk} = {fk})"
    return (
        f"SELECT '{child}.{fk} -> {parent}.{pk}' AS edge, (SELECT count(*) {lost}) AS orphan_rows, "
        f"(SELECT count(DISTINCT {fk}) {lost}) AS orphan_keys"
    )


def _pairs() -> str:
    """Verdict of every pair from the engine's own results; failing statements are
    known by kind."""
    lines = []
    for p in CORPUS:
        fails_gold = p.expected == S.GOLD_SQL_ERROR
        fails_pred = p.expected in (S.SCHEMA_ERROR, S.SYNTAX_ERROR, S.EXECUTION_ERROR, S.TIMEOUT)
        if fails_gold or fails_pred or p.kind in ("extra_column", "number_vs_text", "both_empty"):
            same = "true" if p.expected == CORRECT else "false"
        else:
            gold, pred = (f"SELECT * FROM ({x}) AS x" for x in (p.gold, p.pred))
            if "ORDER BY" in p.gold.upper():
                gold, pred = (f"SELECT row_number() OVER () AS rn, * FROM ({x}) AS x" for x in (p.gold, p.pred))
            if p.kind == "swapped_columns":
                gold, pred = (
                    f"SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM ({x}) AS x(a, b)" for x in (p.gold, p.pred)
                )
            same = (
                f"NOT EXISTS (SELECT * FROM ({gold} EXCEPT ALL {pred}) AS d) "
                f"AND NOT EXISTS (SELECT * FROM ({pred} EXCEPT ALL {gold}) AS d)"
            )
        outcome = lit(p.expected) if fails_gold or fails_pred else (
            f"CASE WHEN {same} THEN '{CORRECT}' ELSE '{S.RESULT_SET_MISMATCH}' END"
        )
        pred_status = p.expected if fails_pred else S.SUCCESS
        gold_status = S.SCHEMA_ERROR if fails_gold else S.SUCCESS
        lines.append(
            f"SELECT '{p.kind}' AS kind, {outcome} AS outcome, {lit(p.gold)} AS gold_sql, {same} AS is_correct, "
            f"'{gold_status}' AS gold_status, '{pred_status}' AS pred_status"
        )
    return (
        f"SELECT kind, outcome, {estimate('gold_sql')} AS difficulty, {query_type('gold_sql')} AS query_type, "
        f"is_correct, gold_status, pred_status FROM ({' UNION ALL '.join(lines)}) AS p"
    )


# Spark's names of the given tables' types
_TYPE_NAMES = {"VARCHAR": "STRING", "INTEGER": "INT", "TIMESTAMP": "TIMESTAMP_NTZ", "FLOAT[]": "ARRAY<FLOAT>"}


def _own_columns() -> str:
    """Catalog lines of the given tables, from the tables."""
    named = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPE_NAMES.items()) + " ELSE t END"
    lines = [
        f"SELECT {no} AS table_no, '{table}' AS table_name, {cid} AS cid, '{name}' AS name, max(typeof({name})) AS t, "
        f"count(*) = count({name}) AS not_null, {'true' if name in W.DATA_KEYS.get(table, []) else 'false'} AS is_primary_key FROM {table}"
        for no, (table, columns) in enumerate(W.CATALOG) if table in W.GIVEN_TABLES
        for cid, (name, *_) in enumerate(columns)
    ]
    return f"SELECT table_no, table_name, cid, name, {named} AS data_type, not_null, is_primary_key FROM ({' UNION ALL '.join(lines)}) AS c"


def _own_ddl() -> str:
    keys = _values([[lit(table), lit(", ".join(key)), str(len(key))] for table, key in W.DATA_KEYS.items()])
    edges = _values([[lit(table), str(no), lit(f"    FOREIGN KEY ({c}) REFERENCES {to}({to_c})")] for no, (table, c, to, to_c) in enumerate(W.DATA_EDGES)])
    single = "CASE WHEN is_primary_key AND k.n = 1 THEN ' PRIMARY KEY' ELSE '' END"
    return ctes(
        col=_own_columns(),
        k=f"SELECT * FROM ({keys}) AS v(table_name, pks, n)",
        line=f"SELECT table_no, col.table_name, 1 AS part, cid AS no, concat('    ', name, ' ', data_type, {single}) AS txt FROM col LEFT JOIN k ON col.table_name = k.table_name "
        "UNION ALL SELECT (SELECT min(table_no) FROM col WHERE col.table_name = k.table_name), table_name, 2, 0, concat('    PRIMARY KEY (', pks, ')') FROM k WHERE n > 1 "
        f"UNION ALL SELECT (SELECT min(table_no) FROM col WHERE col.table_name = e.table_name), table_name, 3, no, txt FROM ({edges}) AS e(table_name, no, txt)",
        tab="SELECT table_no, concat('CREATE TABLE ', table_name, ' (', chr(10), string_agg(txt, concat(',', chr(10)) ORDER BY part, no), chr(10), ');') AS ddl FROM line GROUP BY table_no, table_name",
    ) + f"SELECT '{DATABASE}' AS db_id, string_agg(ddl, concat(chr(10), chr(10)) ORDER BY table_no) AS ddl FROM tab"


def _sketch_profile(rel: str) -> str:
    gamma = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)
    value = f"CASE WHEN bucket < 0 THEN high ELSE least(greatest(2.0 * pow({gamma!r}, bucket) / {gamma + 1!r}, low), high) END"
    names = zip(PERCENTILES, ["median_len", "p90", "p95", "p99"])
    quantiles = ", ".join(f"round(arg_min(v, bucket) FILTER (WHERE upto > floor({p} * (every - 1))), 4) AS {n}" for p, n in names)
    return ctes(
        s=f"SELECT part, CASE WHEN len <= 0 THEN -1 ELSE CAST(ceil(ln(len) / {math.log(gamma)!r}) AS INTEGER) END AS bucket, count(*) AS n, sum(len) AS total, min(len) AS low, max(len) AS high FROM ({rel}) AS l GROUP BY 1, 2",
        p=f"SELECT *, CAST({value} AS DOUBLE) AS v, sum(n) OVER (PARTITION BY part ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY part) AS every FROM s",
    ) + f"SELECT part, CAST(sum(n) AS BIGINT) AS n, min(low) AS min_len, round(sum(total) / sum(n), 4) AS mean_len, {quantiles}, max(high) AS max_len FROM p GROUP BY part"


def _canonical_cells() -> str:
    plain = lambda x: f"regexp_replace({x}, '\\.?0+$', '')"
    number = lambda x: f"concat('n:', {plain(f'printf({lit(chr(37) + chr(46) + chr(52) + chr(102))}, {x})')})"
    quoted = lambda x: f"concat('\"', {x}, '\"')"
    text = lambda x: f"concat('s:', {strip(x)})"
    flags = f"concat('[', {quoted(text('l_returnflag'))}, ',', CASE WHEN l_linenumber > 3 THEN {quoted(text('l_linestatus'))} ELSE 'null' END, ']')"
    pair = lambda k, x: f"concat('[', {quoted(lit('s:' + k))}, ',', {quoted(number(x))}, ']')"
    seconds = "epoch(l_shipdate) - epoch(TIMESTAMP '1992-01-01')"
    return (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('n:', CAST(CAST(l_orderkey * 100000000000000::HUGEINT AS HUGEINT) AS VARCHAR)) AS wide, "
        f"concat('n:', {plain('CAST(CAST(round(CAST(l_partkey AS DECIMAL(18,0)) * 123456789.123456::DECIMAL(18,6), 4) AS DECIMAL(30,4)) AS VARCHAR)')}) AS exact, "
        f"{number('l_extendedprice * l_discount')} AS real, "
        f"concat('i:INTERVAL ', chr(39), CAST(({seconds})::BIGINT // 86400 AS VARCHAR), ' ', strftime(l_shipdate, '%H:%M:%S'), chr(39), ' DAY TO SECOND') AS since, "
        f"concat('a:', {flags}) AS flags, concat('m:[', {pair('qty', 'l_quantity')}, ',', {pair('tax', 'l_tax')}, ']') AS named, "
        f"concat('t:[', {quoted('concat(' + lit('n:') + ', l_suppkey)')}, ',', {quoted('replace(concat(' + lit('a:') + ', ' + flags + '), chr(34), concat(chr(92), chr(34)))')}, ']') AS nested FROM lineitem"
    )


def oracle_sql() -> dict[str, str]:
    a, both = samples_ctes("a"), {**samples_ctes("a"), **samples_ctes("b")}
    it = {"it": ITEMS}
    overall = (
        f"SELECT count(*) AS total_queries, {_CORRECT} AS correct_queries, {_VALID} AS valid_sql_queries, "
        f"{_ACC} AS execution_accuracy, coalesce(CAST({_VALID} AS DOUBLE) / nullif(count(*), 0), 0) AS valid_sql_rate FROM samples_"
    )
    group = lambda k: f"SELECT {k}, count(*) AS total, {_CORRECT} AS correct, {_ACC} AS accuracy FROM samples_a GROUP BY {k}"
    sft = (
        f"item_id, db_id, question, gold_sql, difficulty, split, CAST(3 AS BIGINT) AS n_messages, "
        f"md5({USER}) AS user_md5, {ANSWER} AS answer"
    )
    crash = lambda run: f"(SELECT coalesce(max(n), 0) FROM e{run} WHERE category = '{S.EXECUTION_ERROR}')"
    rate = lambda name, col: (
        f"SELECT '{name}' AS metric, printf('%.2f%%', oa.{col} * 100) AS baseline, printf('%.2f%%', ob.{col} * 100) AS candidate, "
        f"printf('%+.2f%%', ob.{col} * 100 - oa.{col} * 100) AS delta FROM oa, ob"
    )
    done = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"
    few = demo_messages() + [("user", USER)]
    few_text = "concat(" + ", '|', ".join(f"'{role}=', {text}" for role, text in few) + ")"
    equal = lambda hit: f"SELECT i.o_orderkey AS item_id, d.item_id IS NULL AS is_equal FROM orders AS i LEFT JOIN {hit} AS d ON i.o_orderkey = d.item_id"
    shown = "SELECT {0} FROM samples_a"
    prompt = chatml(few)
    gold_msg, pred_msg = _messages("a")
    out = {
        "load_items": f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_id, db_id, question, gold_sql, db_path, difficulty FROM ({ITEMS}) AS i",
        "load_items_union": f"SELECT row_number() OVER (ORDER BY item_id NOT IN ({done}), item_id) - 1 AS item_id, db_id, question, gold_sql, difficulty FROM ({ITEMS}) AS i",
        "split_labelled_scan": ctes(**it, tr=TRAINING) + f"SELECT item_id, db_id, difficulty, CASE split WHEN 'val' THEN 'validation' ELSE 'train' END AS split, CAST(3 AS BIGINT) AS n_messages, md5({USER}) AS user_md5, {ANSWER} AS answer FROM tr",
        "source_inventory": f"SELECT DISTINCT db_id FROM ({ITEMS}) AS i",
        "folder_inventory": f"SELECT DISTINCT db_id FROM ({ITEMS}) AS i",
        "missing_folders": f"SELECT DISTINCT db_id FROM ({ITEMS}) AS i WHERE db_id NOT IN (SELECT db_id FROM ({ITEMS}) AS j WHERE difficulty = 'hard' AND item_id NOT IN ({done}))",
        "catalog_columns": f"SELECT table_name, cid, name, data_type, not_null, is_primary_key FROM ({_own_columns()}) AS c",
        "catalog_ddl": _own_ddl(),
        "length_profile_sketch": _sketch_profile(f"SELECT 'documents' AS part, len({TOKENS}) AS len FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'conversations', len({TOKENS}) FROM conversations WHERE text IS NOT NULL"),
        "canonical_cells": _canonical_cells(),
        "missing_required": "SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)",
        "write_samples_jsonl": ctes(**it, sp=split_of("(SELECT * FROM it)", "db_id")) + "SELECT split, count(*) AS n_lines, CAST(count_if(difficulty IS NULL) AS BIGINT) AS n_null_difficulty FROM sp GROUP BY split",
        "write_report_json": ctes(**a) + "SELECT * FROM samples_a",
        "read_metrics_json": ctes(**a, m=long_of(), e=errors_of()) + "SELECT dimension, key, total, correct, accuracy FROM m UNION ALL SELECT 'error', category, n, 0, 0 FROM e",
        "drop_internal_tables": f"SELECT db_id, table_name, cid, name FROM ({COLUMNS}) AS c WHERE table_name NOT IN ({_INTERNAL})",
        "normalize_types": f"SELECT db_id, table_name, cid, name, data_type, not_null, is_primary_key FROM ({CLEAN_COLUMNS}) AS c",
        "normalize_fks": f"SELECT db_id, table_name, fk_no, from_column, to_table, to_column FROM ({CLEAN_FKS}) AS f",
        "order_sensitive": f"SELECT item_id, {order_sensitive('gold_sql')} AS order_sensitive FROM ({ITEMS}) AS i",
        "sample_verdict": ctes(**a) + shown.format("item_id, is_correct, gold_status, pred_status, error_message"),
        "difficulty_or_estimate": f"SELECT item_id, {difficulty('difficulty', 'gold_sql')} AS difficulty FROM ({ITEMS}) AS i",
        "exists_guard": (
            f"SELECT item_id, i.db_id, CASE WHEN v.db_id IS NULL THEN '{S.EXECUTION_ERROR}' END AS guard_status, "
            f"CASE WHEN v.db_id IS NULL THEN concat('{S.MISSING_DATABASE}', db_path) END AS guard_message, "
            f"CASE WHEN v.db_id IS NULL THEN CAST(0 AS DOUBLE) END AS guard_time_ms FROM ({ITEMS}) AS i LEFT JOIN ({INVENTORY}) AS v ON i.db_id = v.db_id"
        ),
        "overlength_cut": (
            f"SELECT doc_id, len(t) AS n_tokens, len(t) > {MAX_TOKENS} AS overlength, least(len(t), {MAX_TOKENS}) AS n_kept, "
            f"md5(array_to_string(t[1:{MAX_TOKENS}], ' ')) AS kept_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM documents) AS d"
        ),
        "attach_schema": f"SELECT item_id, db_id, length(schema_ddl) AS ddl_chars, md5(schema_ddl) AS ddl_md5 FROM ({ITEMS_DDL}) AS i",
        "ordered_compare": ctes(**diffs()) + equal("lists_a"),
        "bag_compare": ctes(**diffs()) + equal("bags_a"),
        "bag_compare_by_name": ctes(**diffs()) + equal("bags_a"),
        "remaining_items": f"SELECT item_id, gold_sql FROM ({ITEMS}) AS i WHERE item_id NOT IN ({done})",
        "compare_runs_tier": runs_of("difficulty", TIER_ORDER),
        "compare_runs_type": runs_of("query_type", TYPE_ORDER),
        "compare_runs_errors": ctes(**both, ea=errors_of("a"), eb=errors_of("b")) + (
            "SELECT coalesce(ea.category, eb.category) AS category, coalesce(ea.n, 0) AS baseline, coalesce(eb.n, 0) AS candidate, "
            "coalesce(eb.n, 0) - coalesce(ea.n, 0) AS delta, CASE WHEN coalesce(eb.n, 0) < coalesce(ea.n, 0) THEN 'good' ELSE 'other' END AS flag "
            "FROM ea FULL JOIN eb ON ea.category = eb.category"
        ),
        "compare_runs_overall": ctes(**both, ea=errors_of("a"), eb=errors_of("b"), oa=overall + "a", ob=overall + "b") + (
            rate("valid_sql_rate", "valid_sql_rate") + " UNION ALL " + rate("execution_accuracy", "execution_accuracy")
            + f" UNION ALL SELECT 'execution_crashes', CAST({crash('a')} AS VARCHAR), CAST({crash('b')} AS VARCHAR), "
            f"printf('%+.2f%%', CAST(({crash('b')} - {crash('a')}) * 100 AS DOUBLE) / nullif({crash('a')}, 0))"
        ),
        "leakage_audit": f"SELECT source, CAST(count_if(split = 'train') AS BIGINT) AS train_rows, CAST(count_if(split = 'val') AS BIGINT) AS val_rows, count_if(split = 'train') > 0 AND count_if(split = 'val') > 0 AS leaks FROM ({split_of('documents', 'source')}) AS s GROUP BY source",
        "overall_metrics": ctes(**a) + overall + "a",
        "tier_metrics": ctes(**a) + group("difficulty"),
        "type_metrics": ctes(**a) + group("query_type"),
        "metrics_long": ctes(**a) + long_of(),
        "error_breakdown": ctes(**a) + errors_of(),
        "tier_table": ctes(**a, m=long_of()) + table_of("difficulty", TIERS) + f" UNION ALL SELECT {len(TIERS)}, 'OVERALL', total, correct, {pct('accuracy * 100')} FROM m WHERE dimension = 'overall'",
        "type_table": ctes(**a, m=long_of()) + table_of("query_type", QUERY_TYPES),
        "length_profile": profile(f"SELECT 'documents' AS part, len({TOKENS}) AS len FROM documents UNION ALL SELECT 'conversations', len({TOKENS}) FROM conversations"),
        "length_coverage": ctes(d=f"SELECT len({TOKENS}) AS len FROM documents") + " UNION ALL ".join(
            f"SELECT {x} AS threshold, CAST(count_if(len <= {x}) AS BIGINT) AS n_fit, coalesce(CAST(count_if(len <= {x}) AS DOUBLE) / nullif(count(*), 0) * 100, 0) AS coverage_pct FROM d" for x in THRESHOLDS
        ),
        "length_by_part": ctes(**it, tr=TRAINING, l=f"SELECT 'full' AS part, length({FULL}) AS len FROM tr UNION ALL SELECT 'question', length(question) FROM tr UNION ALL SELECT 'sql', length(gold_sql) FROM tr UNION ALL SELECT role, length(text) FROM conversations") + profile("SELECT * FROM l"),
        "render_ddl": DDL,
        "primary_keys": f"SELECT db_id, table_name, string_agg(name, ', ' ORDER BY cid) AS primary_keys FROM ({CLEAN_COLUMNS}) AS c WHERE is_primary_key AND table_name NOT IN ({_INTERNAL}) GROUP BY db_id, table_name",
        "distinct_databases": f"SELECT db_id, count(*) AS n_items FROM ({ITEMS}) AS i GROUP BY db_id",
        "split_counts": ctes(**it, sp=split_of("(SELECT * FROM it)", "db_id")) + "SELECT split, count(*) AS n FROM sp GROUP BY split",
        "key_profile": " UNION ALL ".join(_key_profile(x, k) for x, k in W.DATA_KEYS.items()),
        "fk_orphans": " UNION ALL ".join(_orphans(*e) for e in W.DATA_EDGES),
        "group_split": f"SELECT doc_id, source, split FROM ({split_of('documents', 'source')}) AS s",
        "limit_items": f"SELECT item_id, gold_sql FROM ({ITEMS}) AS i ORDER BY item_id LIMIT {FIRST_ITEMS}",
        "cap_result_rows": ctes(**sides()) + (
            f"SELECT item_id, side, row_no, part, CAST(price AS DOUBLE) AS price, flag, n > {ROW_CAP} AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY item_id, side) AS n "
            f"FROM (SELECT 'gold' AS side, * FROM gold_a UNION ALL SELECT 'pred', * FROM pred_a) AS s) AS c WHERE row_no < {ROW_CAP}"
        ),
        "truncated_results": ctes(**sides()) + (
            f"SELECT item_id, side, count(*) AS n_rows, least(count(*), {ROW_CAP}) AS kept_rows, count(*) > {ROW_CAP} AS truncated "
            "FROM (SELECT item_id, 'gold' AS side FROM gold_a UNION ALL SELECT item_id, 'pred' FROM pred_a) AS s GROUP BY item_id, side"
        ),
        "row_ordinals": f"SELECT l_orderkey, {_ORDER}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS row_no FROM lineitem",
        "ordered_category_report": ctes(**a, e=errors_of()) + "SELECT category FROM e",
        "union_categories": ctes(**both, ea=errors_of("a"), eb=errors_of("b")) + "SELECT category FROM ea UNION SELECT category FROM eb",
        "evaluate_pairs": _pairs(),
        "normalize_cells": (
            f"SELECT l_orderkey, l_partkey, l_linenumber, CAST(printf('%.4f', l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS DOUBLE) AS charge, "
            f"{strip('concat(chr(9), chr(32), l_returnflag, chr(32), chr(10))')} AS flag, CAST(l_shipdate AS VARCHAR) AS shipped FROM lineitem"
        ),
        "classify_errors": (
            f"SELECT item_id, side, {status('error_message')} AS status, error_message FROM (SELECT o_orderkey AS item_id, 'gold' AS side, {gold_msg} AS error_message FROM orders "
            f"UNION ALL SELECT o_orderkey, 'pred', {pred_msg} FROM orders) AS l"
        ),
        "extract_sql": extracted(f"({ITEMS}) AS i", "raw_output", "item_id"),
        "classify_query_type": f"SELECT item_id, {query_type('gold_sql')} AS query_type FROM ({ITEMS}) AS i",
        "estimate_difficulty": f"SELECT item_id, {estimate('gold_sql')} AS difficulty FROM ({ITEMS}) AS i",
        "user_content": f"SELECT item_id, md5({USER}) AS content_md5 FROM ({ITEMS_DDL}) AS i",
        "chat_messages": f"SELECT item_id, CAST({len(few)} AS BIGINT) AS n_few, CAST(2 AS BIGINT) AS n_none, md5({few_text}) AS few_md5 FROM ({ITEMS_DDL}) AS i",
        "chatml_prompt": f"SELECT item_id, length({prompt}) AS prompt_chars, md5({prompt}) AS prompt_md5 FROM ({ITEMS_DDL}) AS i",
        "sft_samples": ctes(**it, tr=TRAINING) + f"SELECT {sft} FROM tr",
        "render_conversations": rendered("SELECT conv_id, turn, role, text AS content, CAST(NULL AS VARCHAR) AS calls FROM conversations", None, True),
        "render_tool_calls": rendered(CHAT, W.TOOLS, False),
        "merge_tool_turns": ctes(turns=CHAT) + f"SELECT conv_id, turn, role, opens, closes FROM ({MARKED.format('turns')}) AS m",
        "text_lengths": f"SELECT doc_id, len({TOKENS}) AS n_tokens, length(text) AS n_chars FROM documents",
        "percent_format": ctes(**a, g=group("db_id")) + f"SELECT db_id, {pct('accuracy * 100')} AS accuracy_text, printf('%+.2f%%', accuracy * 100 - 50) AS delta_text FROM g",
        "status_strings": ctes(**a) + "SELECT gold_status, pred_status, count(*) AS n FROM samples_a GROUP BY gold_status, pred_status",
        "incremental_verdicts": ctes(**a) + long_of(),
        "incremental_eval": ctes(samples_a=_pairs()) + long_of(),
        "execution_times": f"SELECT CAST(i AS BIGINT) AS item_id, 'gold' AS side, '{S.SUCCESS}' AS status, true AS timed FROM range({len(SQL)}) AS r(i)",
        "statement_timeout": f"SELECT CAST(0 AS BIGINT) AS item_id, side, status FROM (VALUES ('gold', '{S.SUCCESS}'), ('pred', '{S.TIMEOUT}')) AS v(side, status)",
        "with_predictions": f"SELECT item_id, concat({lit('```sql' + chr(10) + 'SELECT ')}, chr(39), question, chr(39), ';', {lit(chr(10) + '```')}) AS raw_output, concat('SELECT ', chr(39), question, chr(39)) AS predicted_sql FROM ({ITEMS}) AS i",
        "length_udf": f"SELECT doc_id, len({TOKENS}) AS n_tokens FROM documents",
    }
    return out | SQL
