"""Chat formatting with a grammar round trip, in column expressions only.

Grammar of a formatted conversation:

    conversation = { turn }
    turn         = open content "</s>"
    open         = "[INST] " | "[/INST] " | "[SYS] " | "[ROLE=" hex "] "

for the roles user, assistant, system and any other (its UTF-8 bytes in hex). Content
holds no control string. A control string inside a text gets a backslash after its
first character; one that has backslashes there already gets one more, so taking one
away restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = r"\[(/?INST|SYS|ROLE=[0-9A-F]*)\] "
CLOSE = "</s>"
# what the grammar gives a meaning, with any number of backslashes after the first character
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|ROLE=)"
PLAIN_CONTROL = r"[<\[](/?s>|/?INST\]|/?SYS\]|ROLE=)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(content: Column) -> Column:
    return F.regexp_replace(content, r"([<\[])\\(\\*)(/?s>|/?INST\]|/?SYS\]|ROLE=)", "$1$2$3")


def opening(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE="), F.hex(F.encode(role, "UTF-8")), F.lit("] "))
    return (
        F.when(role == "user", "[INST] ").when(role == "assistant", "[/INST] ").when(role == "system", "[SYS] ").otherwise(other)
    )


def role_of(tag: Column) -> Column:
    """The role that an opening's tag names."""
    other = F.decode(F.unhex(F.substring(tag, 6, 1 << 30)), "UTF-8")
    return F.when(tag == "INST", "user").when(tag == "/INST", "assistant").when(tag == "SYS", "system").otherwise(other)


def parsed(formatted: Column) -> Column:
    """The deterministic parser: array of (role, content), contents still escaped.

    Null when the text isn't a conversation of the grammar: when turns leave something
    over between them, or a control string stands inside a content.
    """
    turn = f"(?s){OPEN}(.*?){CLOSE}"
    tags, contents = (F.regexp_extract_all(formatted, F.lit(turn), F.lit(i)) for i in (1, 2))
    turns = F.arrays_zip(tags.alias("tag"), contents.alias("content"))
    length = F.aggregate(
        turns, F.lit(0).cast("long"), lambda n, t: n + F.length(t["tag"]) + F.length(t["content"]) + F.lit(3 + len(CLOSE))
    )
    whole = (length == F.length(formatted)) & ~F.exists(contents, lambda c: c.rlike(PLAIN_CONTROL))
    return F.when(whole, F.transform(turns, lambda t: F.struct(role_of(t["tag"]).alias("role"), t["content"].alias("content"))))


def round_trip(role: Column, content: Column, text: Column) -> Column:
    """Whether a turn rendered with ``content`` is read back as that role and text."""
    back = parsed(F.concat(opening(role), content, F.lit(CLOSE)))
    return F.coalesce(
        (F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == role) & (unescape(F.get(back, F.lit(0))["content"]) == text),
        F.lit(False),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text)``: conv_id, n_turns,
    formatted, loss_spans.

    Every turn is rendered as it is, parsed again and compared with its source; where they
    differ, the content is escaped, and a turn that still differed would end the job.
    ``loss_spans`` are the (start, length) in code points, from 0, of the assistant
    contents inside ``formatted``.

    Null texts and roles count as empty. Turns go by ``turn`` (nulls first); those with
    the same number by role, then text, so ties and repeated rows, which all stay, have
    one order. A null conv_id is a conversation of its own. An empty table gives an empty
    result; columns beside the four are left out. A conversation becomes one value, so its
    turns meet in one task: that is the size of the result itself, the sort before it spills.
    """
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    content = F.when(round_trip(F.col("role"), F.col("text"), F.col("text")), F.col("text")).otherwise(escape(F.col("text")))
    rendered = clean.withColumn("content", content)
    identical = round_trip(F.col("role"), F.col("content"), F.col("text"))
    rendered = rendered.withColumn(
        "piece",
        F.when(identical, F.concat(opening(F.col("role")), "content", F.lit(CLOSE))).otherwise(
            F.raise_error(F.lit("a turn isn't read back as it was written")).cast("string")
        ),
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumn("n", F.row_number().over(in_order)).withColumn(
        "start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length(opening(F.col("role")))
    )
    each = F.struct("n", "piece", "role", "start", F.length("content").cast("long").alias("length"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("all"))
    spans = F.filter("all", lambda t: t["role"] == "assistant")
    return grouped.select(
        "conv_id",
        F.size("all").cast("long").alias("n_turns"),
        F.array_join(F.col("all")["piece"], "").alias("formatted"),
        F.transform(spans, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of ``format_conversations`` output, read from the text alone:
    conv_id, turns (role, text), loss_text, formatted_chars."""
    text = F.col("formatted")
    turns = F.transform(parsed(text), lambda t: F.struct(t["role"].alias("role"), unescape(t["content"]).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select(
        "conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length(text).cast("long").alias("formatted_chars")
    )
