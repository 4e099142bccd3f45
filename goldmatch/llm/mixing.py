"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldmatch.llm.scale import running_sum
from goldmatch.session import written

EPOCHS, BLOCK_WORDS, CELLS, SEED = 3, 256, 4096, 11
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words are runs outside white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int = SEED) -> Column:
    """A document's place in the shuffled order of its source, by doc_id and text."""
    return F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed))


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of ``sizes(source, source_size)``, a row per source.

    Sources weigh 1, 2, 3, repeating, by code point, null last. Together they get as many
    words as there are; a target stops at ``epochs`` times its source, and the excess goes
    to the others by weight until none is above. That is the level at which
    sum(min(cap, weight * level)) is the total: sources fill up in the order of
    cap / weight, so one pass over the sorted sources finds it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    full = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / (
        F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    )
    # with the sources before it full, a source is full if the level reaches its ratio
    leveled = weighed.withColumn("level", level).withColumn("open", F.col("level") < F.col("ratio"))
    first = F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(all_)["level"]
    target = F.when(first.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * first))
    return leveled.select("source", "source_size", target.alias("target"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, source_no, turn of ``sources(source_no, target)``: which source fills each slot,
    and how many slots it filled before.

    Slot i lies at the fraction of i times the golden ratio; the source whose part of the
    cumulative targets holds that point fills the slot. The unit interval is cut into cells,
    and slots meet sources by cell, so this is an equi-join whose small side has a row per
    cell and source. Any run of slots has each source near its share.
    """
    earlier = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    all_ = F.sum("target").over(Window.partitionBy())
    before = F.coalesce(F.sum("target").over(earlier), F.lit(0.0))
    parts = sources.where("target > 0").select(
        "source_no", (before / all_).alias("low"), ((before + F.col("target")) / all_).alias("high")
    )
    last = F.max("source_no").over(Window.partitionBy())
    parts = parts.withColumn("high", F.when(F.col("source_no") == last, F.lit(1.0)).otherwise(F.col("high")))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    parts = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    point = F.col("slot") * F.lit(GOLDEN)
    points = sources.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point))
    points = points.withColumn("cell", cell(F.col("u")))
    placed = points.join(parts, "cell").where("u >= low AND u < high").select("slot", "source_no")
    # bins of consecutive slots, so that the turn follows the schedule
    width = max(1, -(-slots // 1024))
    return running_sum(placed, ["source_no"], ["slot"], F.lit(1), F.floor(F.col("slot") / width), "turn").select("slot", "source_no", "turn")


def mix(docs: DataFrame, epochs: int = EPOCHS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, source, text)`` and its documents.

    The first result has a row per piece of the mix in its order: slot, source_no, doc_no,
    epoch, start, length (words of the document). The second has a row per document:
    doc_no, doc_id, source, size, source_no, source_size, target.

    Each source's documents, shuffled by a seeded hash, are one stream of words, read up to
    ``epochs`` times and cut into blocks of ``block_words``. Block n of a source goes to the
    nth slot that the schedule gives it, until its target (rounded to a word) is reached; the
    last block is cut there. Where the schedule leaves a source a few blocks short, they
    follow at the end. So every source gives exactly its rounded target, and no document is
    taken more than ``epochs`` times.

    A null source is a source of its own; null, empty and blank texts have size 0 and are
    never taken. Repeated rows and equal doc_ids are separate documents; their shuffled
    order falls back to the text's hash, and rows equal in both are interchangeable. Columns
    beside the three are left out. Empty tables give empty results.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), place(seed).alias("place"))
    sized = written(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    sources = written(targets(per_source, epochs).withColumn("source_no", F.row_number().over(by_name).cast("long")), "targets")
    named = sized.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    # bins of the hash's range, so that the stream's order is the hash's
    bin_ = F.shiftrightunsigned("place", 54)
    placed = running_sum(named, ["source_no"], ["place", "doc_id", "text_hash"], F.col("size"), bin_, "start")
    documents = written(placed.withColumn("doc_no", F.struct("source_no", "start", "place", "doc_id")), "documents")

    wanted = sources.withColumn("words", F.round("target").cast("long")).withColumn(
        "blocks", F.ceil(F.col("words") / block_words)
    )
    total = wanted.agg(F.sum("blocks")).first()[0] or 0
    planned = schedule(wanted, total).join(wanted.select("source_no", "blocks"), "source_no").where("turn < blocks")
    planned = written(planned.select("slot", "source_no", "turn"), "schedule")
    given = planned.groupBy("source_no").agg((F.max("turn") + 1).alias("given"))
    short = wanted.join(given, "source_no", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < blocks")
    rest = short.select("source_no", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)).alias("turn"))
    at_end = F.row_number().over(Window.orderBy("turn", "source_no")) + F.lit(total - 1)
    slots = planned.unionByName(rest.select(at_end.cast("long").alias("slot"), "source_no", "turn"))

    limits = wanted.select("source_no", "words")
    read = documents.where("size > 0").join(limits, "source_no")
    read = read.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    read = read.withColumn("low", F.col("start") + F.col("epoch") * F.col("source_size"))
    read = read.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("words"))).where("low < high")
    block = lambda x: F.floor(x / block_words)
    read = read.withColumn("turn", F.explode(F.sequence(block(F.col("low")), block(F.col("high") - 1))))
    start = F.greatest("low", F.col("turn") * block_words)
    pieces = read.select(
        "source_no", "turn", "doc_no", "epoch",
        (start - F.col("low")).alias("start"),
        (F.least("high", (F.col("turn") + 1) * block_words) - start).alias("length"),
    )
    mixed = pieces.join(slots, ["source_no", "turn"]).select("slot", "source_no", "doc_no", "epoch", "start", "length")
    return mixed, documents.select("doc_no", "doc_id", "source", "size", "source_no", "source_size", "target")


def taken_words(mixed: DataFrame, documents: DataFrame) -> DataFrame:
    """Every document with ``taken``: the words that the mix takes of it, repeats counted."""
    taken = mixed.groupBy("doc_no").agg(F.sum("length").alias("taken"))
    return documents.join(taken, "doc_no", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
