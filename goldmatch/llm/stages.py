"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``, whatever else these hold: helper columns
have names that ``docs`` does not use.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmatch.llm import linededup, mixing, neardup, packing, quality
from goldmatch.llm.scale import free_name
from goldmatch.session import dimension, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Each row is judged alone by its text, so repeated
    rows stay or go together; null and empty texts go."""
    return docs.where(quality.keeps(F.col("text")))


def by_text(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` whose doc_id is a number of its own per (doc_id, text), in the order of doc_id
    and then of the text's hash, and the name of the column with the doc_id as it was.

    Where no doc_id has several texts, the doc_id is that number already. Only otherwise
    are the pairs sorted and numbered, and the rows stored with their number.
    """
    id_, text, number, was = (free_name(docs, n) for n in ("id", "text_hash", "number", "doc_id_was"))
    pair = {id_: F.col("doc_id").cast("long"), text: F.xxhash64("text")}
    ids = docs.where("doc_id IS NOT NULL").select(*[c.alias(n) for n, c in pair.items()])
    ends = ids.groupBy(id_).agg(F.min(text).alias("low"), F.max(text).alias("high"))
    named = docs.withColumn(was, F.col("doc_id"))
    if ends.where("low <> high").isEmpty():
        return named, was
    numbers = ids.distinct().orderBy(id_, text).withColumn(number, F.monotonically_increasing_id())
    numbered = named.withColumns(pair).join(dimension(numbers, "numbers"), [id_, text], "left")
    return written(numbered.withColumn("doc_id", F.col(number)).select(*named.columns), "by-text"), was


def _original(named: DataFrame, docs: DataFrame, was: str) -> DataFrame:
    return named.withColumn("doc_id", F.col(was)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; one that loses all goes.

    Rows equal in doc_id and text come once; different texts under one doc_id are separate
    documents, and rows without a doc_id stay as they are. Only rows of repeated documents
    are grouped, and the lists that meet the texts are measured, so the texts themselves
    stay where they are, unless a doc_id has several texts.
    """
    named, was = by_text(docs)
    removed = linededup.repeated_lines(named.select("doc_id", "text"))
    cleaned = linededup.without_lines(named, removed, drop_emptied=True)
    counts = named.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    again = dimension(counts.where("n > 1").select("doc_id"), "repeated-ids")
    single = cleaned.join(again, "doc_id", "left_anti")
    once = single.unionByName(cleaned.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return _original(once, docs, was)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one that names it. Rows without a doc_id
    stay; different texts under one doc_id are separate documents."""
    named, was = by_text(docs)
    copies = neardup.near_duplicates(named, k=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return _original(named.join(dimension(copies, "copies"), "doc_id", "left_anti"), docs, was)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes once for each time that the mix reads at least half of it.

    Rows and their reads meet on the hash of doc_id and text, so rows without a doc_id take
    part. Rows equal in both share their reads evenly, rounded up; texts without a word are
    never read. A null source is a source of its own.
    """
    place, times, turn = (free_name(docs, n) for n in ("place", "times", "turn"))
    mixed, documents = mixing.mix(docs)
    reads = mixed.groupBy("doc_no", "epoch").agg(F.sum("length").alias("words"))
    read = documents.join(reads, "doc_no").where("2 * words >= size").groupBy(F.col("doc_no.place").alias(place)).agg(F.count("*").alias("reads"))
    rows = documents.groupBy(F.col("doc_no.place").alias(place)).agg(F.count("*").alias("rows"))
    repeats = read.join(rows, place).select(place, F.ceil(F.col("reads") / F.col("rows")).alias(times))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))
    return docs.withColumn(place, mixing.place()).join(repeats, place).withColumn(turn, each).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their place in sequences of 4096 tokens, and their ids. Each
    row is a document; null and empty texts are one token, the end."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", keep_first_copies),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
