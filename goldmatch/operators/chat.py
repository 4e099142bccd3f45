"""Chat template over stored conversations.

A conversation is either one ``ARRAY<STRUCT<role, content[, tool_calls]>>`` value
or one line per turn (conv_id, turn, role, content[, tool_calls]). Lines go by their
position in the order of ``turn``, whatever its first number and gaps; lines with the
same number go by role, content and calls. Positions are dense ordinals that need no
task to hold a conversation, and neighbours are found in blocks of positions, so a
line sees its neighbours however long its conversation is.

A null content counts as empty; a leading system message without one gets the
default text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldmatch.functions.prompts import OPEN_TURN, TURN_END, TURN_START
from goldmatch.functions.text import json_text
from goldmatch.operators.ordinals import row_ordinals

BLOCK_TURNS = 1024  # positions whose neighbours are looked up in one group; no result depends on it

# Texts of the chat template.
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOLS_BEFORE = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_AFTER = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)
CALL_BEFORE, CALL_AFTER = "\n<tool_call>\n", "\n</tool_call>"
RESPONSE_BEFORE, RESPONSE_AFTER = "\n<tool_response>\n", "\n</tool_response>"


def _turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(TURN_START), role, body, F.lit(TURN_END + "\n"))


def system_turn(first_role: Column, first_content: Column, tools: list[dict] | None = None) -> Column:
    """The leading system turn: given or default text, then the tool signatures."""
    text = F.coalesce(F.when(first_role == "system", first_content), F.lit(DEFAULT_SYSTEM))
    listed = ""
    if tools:
        lines = "".join("\n" + json.dumps(t, ensure_ascii=False) for t in tools)
        listed = TOOLS_BEFORE + lines + TOOLS_AFTER
    return _turn(F.lit("system"), F.concat(F.lit("\n"), text, F.lit(listed)))


def _call_text(call: Column, call_type: T.StructType) -> Column:
    """One call as a JSON object: ``{name, arguments}``, or that as the field ``function``."""
    own = None
    if "arguments" in call_type.names:
        own = F.concat(
            F.lit('{"name": "'), F.coalesce(call["name"], F.lit("")), F.lit('", "arguments": '),
            json_text(call["arguments"], call_type["arguments"].dataType), F.lit("}"),
        )
    if "function" not in call_type.names:
        return own
    inner = _call_text(call["function"], call_type["function"].dataType)
    return inner if own is None else F.when(call["function"].isNotNull(), inner).otherwise(own)


def tool_call_text(calls: Column, call_type: T.StructType) -> Column:
    """``<tool_call>`` blocks of one assistant turn."""
    return F.array_join(F.transform(calls, lambda c: F.concat(F.lit(CALL_BEFORE), _call_text(c, call_type), F.lit(CALL_AFTER))), "")


def opens_tool_turn(role: Column, previous: Column) -> Column:
    return (role == "tool") & ~previous.eqNullSafe("tool")


def closes_tool_turn(role: Column, following: Column) -> Column:
    return (role == "tool") & ~following.eqNullSafe("tool")


def turn_text(
    m: Column, previous: Column, following: Column, first: Column, call_type: T.StructType | None
) -> Column:
    """Text of one message given its neighbours' roles. The first message's system
    text is part of :func:`system_turn`; consecutive tool messages share a turn."""
    role, content = m["role"], F.coalesce(m["content"], F.lit(""))
    plain = _turn(role, F.concat(F.lit("\n"), content))
    out = F.when((role == "user") | ((role == "system") & ~first), plain)
    if call_type is None:
        out = out.when(role == "assistant", plain)
    else:
        calls = m["tool_calls"]
        has_calls = F.coalesce(F.size(calls) > 0, F.lit(False))
        body = F.when(content != "", F.concat(F.lit("\n"), content)).otherwise(F.lit(""))
        out = out.when((role == "assistant") & ~has_calls, plain)
        out = out.when(
            role == "assistant", _turn(role, F.concat(body, tool_call_text(calls, call_type)))
        )
    tool = F.concat(
        F.when(opens_tool_turn(role, previous), F.lit(TURN_START + "user")).otherwise(F.lit("")),
        F.lit(RESPONSE_BEFORE),
        content,
        F.lit(RESPONSE_AFTER),
        F.when(closes_tool_turn(role, following), F.lit(TURN_END + "\n")).otherwise(F.lit("")),
    )
    return out.when(role == "tool", tool).otherwise(F.lit(""))


def _call_type(message_type: T.StructType) -> T.StructType | None:
    if "tool_calls" not in message_type.names:
        return None
    return message_type["tool_calls"].dataType.elementType


def render_messages(
    messages: Column,
    message_type: T.StructType,
    tools: list[dict] | None = None,
    add_generation_prompt: bool = False,
) -> Column:
    """Template text of an array of messages."""
    args = _call_type(message_type)
    turns = F.transform(
        messages,
        lambda m, i: turn_text(
            m, F.get(messages, i - 1)["role"], F.get(messages, i + 1)["role"], i == 0, args
        ),
    )
    first = F.get(messages, F.lit(0))
    return F.concat(
        system_turn(first["role"], first["content"], tools),
        F.array_join(turns, ""),
        F.lit(OPEN_TURN if add_generation_prompt else ""),
    )


def _placed(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Turns with ``_pos`` (from 0), ``_size`` (turns of the conversation) and the roles
    beside them, ``_previous`` and ``_following``.

    A block's edge turns also travel to the neighbouring block, so no group is larger
    than a block and its two neighbours.
    """
    order = ["turn", "role", *[c for c in ("content",) if c in turns.columns]]
    if "tool_calls" in turns.columns:
        order.append(F.to_json("tool_calls"))
    numbered = row_ordinals(turns, ["conv_id"], order, "_pos", "_size")
    block, place = F.floor(F.col("_pos") / block_turns), F.col("_pos") % block_turns
    homes = F.array_compact(
        F.array(
            F.struct(block.alias("_block"), F.lit(True).alias("_own")),
            F.when((place == 0) & (F.col("_pos") > 0), F.struct((block - 1).alias("_block"), F.lit(False).alias("_own"))),
            F.when(
                (place == block_turns - 1) & (F.col("_pos") < F.col("_size") - 1),
                F.struct((block + 1).alias("_block"), F.lit(False).alias("_own")),
            ),
        )
    )
    beside = Window.partitionBy("conv_id", "_block").orderBy("_pos")
    seen = numbered.select("*", F.inline(homes)).select(
        "*", F.lag("role").over(beside).alias("_previous"), F.lead("role").over(beside).alias("_following")
    )
    return seen.where("_own").drop("_own", "_block")


def render_turns(
    turns: DataFrame,
    tools: list[dict] | None = None,
    add_generation_prompt: bool = False,
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """(conv_id, position, turn, text) of every turn; the texts of a conversation joined by
    position are its text. The first one has the system turn, the last one the prompt."""
    first, last = F.col("_pos") == 0, F.col("_pos") == F.col("_size") - 1
    message = {c: F.col(c) for c in turns.columns}
    text = turn_text(message, F.col("_previous"), F.col("_following"), first, _call_type(turns.schema))
    head = F.when(first, system_turn(F.col("role"), F.col("content"), tools)).otherwise(F.lit(""))
    tail = F.when(last, F.lit(OPEN_TURN if add_generation_prompt else "")).otherwise(F.lit(""))
    return _placed(turns, block_turns).select(
        "conv_id", F.col("_pos").alias("position"), "turn", F.concat(head, text, tail).alias("text")
    )


def _joined(pieces: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One text per group of ``keys``, of the pieces in their order."""
    listed = F.sort_array(F.collect_list(F.struct(order, "text")))
    return pieces.groupBy(*keys).agg(listed.alias("_all")).select(*keys, F.array_join(F.col("_all.text"), "").alias("text"))


def render_conversations(
    turns: DataFrame,
    tools: list[dict] | None = None,
    add_generation_prompt: bool = False,
    part_turns: int | None = None,
) -> DataFrame:
    """(conv_id, part_no, text) from one line per turn: one row per conversation, part 0.

    A caller may ask for parts of ``part_turns`` positions; joined in order they are the
    same text. A text is one value and so ends at Spark's limit of 2 GB, where the job
    fails; :func:`render_turns` has no such limit.
    """
    rendered = render_turns(turns, tools, add_generation_prompt)
    part = F.lit(0).cast("long") if part_turns is None else F.floor(F.col("position") / part_turns)
    block = F.floor(F.col("position") / BLOCK_TURNS)
    blocks = _joined(rendered.select("conv_id", part.alias("part_no"), block.alias("block"), "position", "text"), ["conv_id", "part_no", "block"], "position")
    return _joined(blocks, ["conv_id", "part_no"], "block")


def merge_tool_turns(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Where the shared user turn of consecutive tool messages opens and closes."""
    role = F.col("role")
    return _placed(turns.select("conv_id", "turn", "role"), block_turns).select(
        "conv_id", "turn", "role",
        opens_tool_turn(role, F.col("_previous")).alias("opens"),
        closes_tool_turn(role, F.col("_following")).alias("closes"),
    )
