"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmatch.llm.scale import free_name

BLANK = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

# The most frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it on with as was by be at are from this or "
    "der die das und den von zu mit dem des ist auf für im nicht ein eine als "
    "le la les de du et un une en que qui dans pour par sur pas est au ce avec "
    "el los las y se del con no una su para al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; None leaves a side open."""

    metric: str
    low: float | None
    high: float | None


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.5),
)


def without(text: Column, characters: str) -> Column:
    """Code points of ``text`` outside ``characters``."""
    return F.length(F.translate(text, characters, ""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more.

    Windows are compared by a 64-bit hash: sorted, a repeated one has an equal neighbour.
    The positions of those, sorted, cover up to three words each.
    """
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    equal = lambda s, x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
    again = bind(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: equal(s, x, i - 1) | equal(s, x, i + 1)))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    steps = bind(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def measures(text: Column) -> Column:
    """A struct of the counts and ratios that rules can use.

    Words are runs outside white space. A null text has no words, lines or symbols, and
    ratios over nothing are 0.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    parts = F.struct(text.alias("text"), F.array_remove(F.split(text, BLANK), "").alias("words"), lines.alias("lines"))
    counts = bind(
        parts,
        lambda p: F.struct(
            F.size(p["words"]).cast("long").alias("n_words"),
            without(p["text"], BLANKS).cast("long").alias("word_chars"),
            (F.length(p["text"]) - without(p["text"], SYMBOLS)).cast("long").alias("n_symbols"),
            F.size(p["lines"]).cast("long").alias("n_lines"),
            (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("long").alias("n_dup_lines"),
            repeated_words(p["words"]).alias("n_repeat_words"),
            F.size(F.filter(p["words"], lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return bind(
        counts,
        lambda q: F.struct(
            *[q[name].alias(name) for name in COUNTS],
            ratio(q["word_chars"], q["n_words"]).alias("mean_word_chars"),
            ratio(q["n_symbols"], q["n_words"]).alias("symbol_ratio"),
            ratio(q["n_stop_words"], q["n_words"]).alias("stop_ratio"),
            ratio(q["n_dup_lines"], q["n_lines"]).alias("dup_line_ratio"),
        ),
    )


def compiled(rules: tuple[Rule, ...], of: Column) -> Column:
    """The table of thresholds as one condition."""
    holds = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            holds &= of[rule.metric] >= rule.low
        if rule.high is not None:
            holds &= of[rule.metric] <= rule.high
    return holds


def judged(text: Column, rules: tuple[Rule, ...], min_words: int, max_repeat_percent: int) -> Column:
    """``quality, base_failed, kept`` of a text as one struct."""
    failed = lambda q: (q["n_words"] < min_words) | (q["n_repeat_words"] * 100 > q["n_words"] * max_repeat_percent)
    return bind(
        measures(text),
        lambda q: F.struct(q.alias("quality"), failed(q).alias("base_failed"), (~failed(q) & compiled(rules, q)).alias("kept")),
    )


def keeps(text: Column, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """The verdict alone, as a condition on a text."""
    return judged(text, rules, min_words, max_repeat_percent)["kept"]


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with ``quality`` (the measures), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent``
    hundredths of the words in repeated 3-word windows. ``kept``: not base_failed, and
    every rule holds. All of it is one expression over the text, in which each value is
    bound once, so a filter on ``kept`` doesn't compute anything twice.

    All other columns stay; ``quality``, ``base_failed`` and ``kept`` replace columns of
    those names. Null, empty and blank texts are base_failed, since they have no words. Each
    row is judged alone, so repeated rows get equal results, and an empty table gives an
    empty one.
    """
    names = ("quality", "base_failed", "kept")
    others = [c for c in docs.columns if c.lower() not in names]
    verdict = judged(F.col("text"), rules, min_words, max_repeat_percent)
    by_name = docs.select(*others, verdict.alias(own := free_name(docs, "judged")))
    return by_name.select(*others, *[F.col(own)[name].alias(name) for name in names])
