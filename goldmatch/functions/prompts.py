"""Prompts and training samples as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldmatch.functions.text import strip

# Prompt texts and turn marks. The dialect name is a parameter.
DIALECT = "SQLite"
SYSTEM_TEXT = (
    "You are an expert {dialect} assistant. Given the database schema (DDL) and a natural language question, "
    "generate a single valid {dialect} query that answers the question. "
    "Do not hallucinate column names or table names not present in the schema. "
    "Output ONLY the SQL query wrapped in a ```sql\n...``` code block."
)
SCHEMA_HEADING = "### {dialect} Database Schema:\n```sql\n"
QUESTION_HEADING = "\n```\n\n### Question:\n"
ANSWER_HEADING = "\n\n### SQL Query:"
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
OPEN_TURN = "<|im_start|>assistant\n"
DEMONSTRATIONS = [
    (
        """CREATE TABLE employee (
    employee_id INTEGER PRIMARY KEY,
    name TEXT,
    department TEXT,
    salary REAL,
    hire_date TEXT
);""",
        "What is the average salary of employees in the 'Engineering' department?",
        "SELECT avg(salary) FROM employee WHERE department = 'Engineering';",
    ),
    (
        """CREATE TABLE customer (
    customer_id INTEGER PRIMARY KEY,
    customer_name TEXT,
    city TEXT
);

CREATE TABLE orders (
    order_id INTEGER PRIMARY KEY,
    customer_id INTEGER,
    order_amount REAL,
    order_date TEXT,
    FOREIGN KEY (customer_id) REFERENCES customer(customer_id)
);""",
        "List all customer names who have spent more than 500 in total across all their orders.",
        "SELECT T1.customer_name FROM customer AS T1 JOIN orders AS T2 ON T1.customer_id = T2.customer_id "
        "GROUP BY T1.customer_name HAVING sum(T2.order_amount) > 500;",
    ),
]


def system_text(dialect: str = DIALECT) -> str:
    return SYSTEM_TEXT.format(dialect=dialect)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _fenced(sql: Column) -> Column:
    return F.concat(F.lit("```sql\n"), sql, F.lit("\n```"))


def user_content(ddl: Column, question: Column, dialect: str = DIALECT) -> Column:
    """The user turn: schema block, question, open heading."""
    return F.concat(
        F.lit(SCHEMA_HEADING.format(dialect=dialect)),
        strip(ddl),
        F.lit(QUESTION_HEADING),
        strip(question),
        F.lit(ANSWER_HEADING),
    )


def chat_messages(
    ddl: Column, question: Column, demonstrations: bool = True, dialect: str = DIALECT
) -> Column:
    """system, demonstration pairs, user: six messages, or two without pairs."""
    pairs = []
    for demo_ddl, demo_question, demo_sql in DEMONSTRATIONS if demonstrations else []:
        pairs.append(_message("user", user_content(F.lit(demo_ddl), F.lit(demo_question), dialect)))
        pairs.append(_message("assistant", _fenced(F.lit(demo_sql))))
    return F.array(
        _message("system", F.lit(system_text(dialect))),
        *pairs,
        _message("user", user_content(ddl, question, dialect)),
    )


def chatml_prompt(messages: Column) -> Column:
    """Marked turns joined by line breaks, then an open assistant turn."""
    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(TURN_START), m["role"], F.lit("\n"), m["content"], F.lit(TURN_END + "\n")
        ),
    )
    return F.concat(F.array_join(turns, ""), F.lit(OPEN_TURN))


def sft_messages(ddl: Column, question: Column, gold_sql: Column, dialect: str = DIALECT) -> Column:
    """system, user and the fenced gold statement as assistant turn."""
    return F.array(
        _message("system", F.lit(system_text(dialect))),
        _message("user", user_content(ddl, question, dialect)),
        _message("assistant", _fenced(strip(gold_sql))),
    )
