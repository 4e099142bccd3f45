"""Token ids in files: Re-Pair grammars per shard, with expansion lengths for random access.

A store is a Parquet dataset with a row per shard, in the order of (part, shard). A row
holds whole documents in ascending doc_id order:

    part, shard   place of the row; parts come from a range partitioning by doc_id
    n_ids         ids of the shard
    doc_ids       its documents
    doc_starts    ids of the shard before each document
    doc_symbols   grammar symbols of the shard before each document
    base          numbers below it are ids, base + r is the nonterminal of rule r
    rules         pairs of symbols, little-endian unsigned 32-bit integers
    rule_lengths  how many ids each rule expands to, the same kind of integers
    symbols       the shard's symbols; width bytes each (2 or 4), little-endian unsigned

Spark's writer puts the rows into the store, so any file system that Spark reaches will do,
and a task that is run again replaces its own files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldmatch.llm.pieces import CHUNK_BYTES, Encoder, ragged
from goldmatch.llm.text import buffer_of, chunks

SHARD_IDS, ROUND_RULES, MIN_COUNT = 1 << 19, 4096, 16
SLOTS = 1 << 18
# a writer, a reader and an Arrow batch hold few shards: sizes are looked at after each row
LAYOUT = {"parquet.block.size": 8 << 20} | {f"parquet.{x}.size.row.check.{m}": 1 for x in ("page", "block") for m in ("min", "max")}

SCHEMA = (
    "part int, shard int, n_ids long, doc_ids array<long>, doc_starts array<long>, doc_symbols array<long>, "
    "base int, rules binary, rule_lengths binary, width int, symbols binary"
)
ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("doc_starts", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int64())), ("base", pa.int32()),
     ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("width", pa.int32()), ("symbols", pa.binary())]
)


@dataclass
class Grammar:
    base: int
    rules: np.ndarray  # (n, 2)
    symbols: np.ndarray
    starts: np.ndarray  # of each document, in symbols


def slot_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left.astype(np.uint32) * np.uint32(0x9E3779B1) ^ right.astype(np.uint32) * np.uint32(0x85EBCA6B)
    return (mixed ^ mixed >> np.uint32(15)) & np.uint32(SLOTS - 1)


def re_pair(ids: np.ndarray, starts: np.ndarray, base: int, rounds: int | None = None, most: int = ROUND_RULES, least: int = MIN_COUNT) -> Grammar:
    """Replace the most frequent pairs by nonterminals, round by round.

    A round counts all adjacent pairs of the shard, makes rules of the (up to ``most``) most
    frequent ones seen ``least`` times, and replaces them from the left; pairs that overlap
    or share a slot with a more frequent one wait for the next round. Rounds end when no pair
    is seen ``least`` times, or after ``rounds``. No pair crosses the end of a document.
    """
    symbols, starts, rules = ids.astype(np.uint32), starts.copy(), np.zeros((0, 2), np.uint32)
    for _ in count() if rounds is None else range(rounds):
        if len(symbols) < 2:
            break
        left, right = symbols[:-1], symbols[1:]
        inside = np.ones(len(left), bool)
        cuts = starts[(starts > 0) & (starts < len(symbols))] - 1
        inside[cuts] = False
        slots = slot_of(left, right)
        # a pair is no more frequent than its slot, so only pairs of frequent slots are sorted
        likely = inside & (np.bincount(slots[inside], minlength=SLOTS) >= least)[slots]
        keys = np.sort(left[likely].astype(np.uint64) << np.uint64(32) | right[likely])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        # by count, then by pair: the same rules on every run
        often = often[np.argsort(-counts[often], kind="stable")][:most]
        pairs = keys[first[often]]
        made = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        table = np.full(SLOTS, -1, np.int32)
        at = slot_of(made[::-1, 0], made[::-1, 1])
        table[at] = np.arange(len(made) - 1, -1, -1)  # where two pairs share a slot the more frequent one has it
        made = made[kept := np.sort(np.unique(table[table >= 0]))]
        number = np.full(kept[-1] + 1, -1, np.int32)
        number[kept] = np.arange(len(kept))
        table[table >= 0] = number[table[table >= 0]]
        rule = table[slots]
        hit = np.flatnonzero((rule >= 0) & inside)
        hit = hit[(made[rule[hit], 0] == left[hit]) & (made[rule[hit], 1] == right[hit])]
        fresh = np.concatenate([[True], np.diff(hit) > 1])
        order = np.arange(len(hit))
        hit = hit[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
        symbols = symbols.copy()
        symbols[hit] = base + len(rules) + rule[hit]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        starts = starts - np.searchsorted(hit, starts)
        symbols, rules = symbols[stay], np.concatenate([rules, made])
    return Grammar(base, rules, symbols, starts)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids of each rule; a rule's symbols come before it."""
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


def expanded(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of a run of symbols."""
    bodies: list[list[int]] = []
    for a, b in rules.tolist():
        bodies.append([x for s in (a, b) for x in (bodies[s - base] if s >= base else [s])])
    flat = np.array([x for body in bodies for x in body], np.uint32)
    each, is_rule = np.ones(len(symbols), np.int64), symbols >= base
    of = symbols[is_rule].astype(np.int64) - base
    each[is_rule] = lengths[of]
    at = np.cumsum(each) - each
    out = np.empty(int(each.sum()), np.uint32)
    out[at[~is_rule]] = symbols[~is_rule]
    out[ragged(each, np.flatnonzero(is_rule))] = flat[ragged(lengths, of)]
    return out


def row_parts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    return rules, np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64), np.frombuffer(row["symbols"], f"<u{row['width']}")


def decode(row: dict, start: int = 0, length: int | None = None) -> np.ndarray:
    """Ids [start, start + length) of a shard; only the symbols that cover them are expanded."""
    rules, lengths, symbols = row_parts(row)
    length = row["n_ids"] - start if length is None else length
    if length <= 0:
        return np.zeros(0, np.uint32)
    if start == 0 and length == row["n_ids"]:
        return expanded(symbols, rules, lengths, row["base"])
    each = np.ones(len(symbols), np.int64)
    each[symbols >= row["base"]] = lengths[symbols[symbols >= row["base"]].astype(np.int64) - row["base"]]
    ends = np.cumsum(each)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left")
    got = expanded(symbols[a : b + 1], rules, lengths, row["base"])
    skip = start - (ends[a] - each[a])
    return got[skip : skip + length]


def shard_row(part: int, shard: int, doc_ids: list, ids: np.ndarray, starts: np.ndarray, base: int, **how: int) -> dict:
    grammar = re_pair(ids, starts, base, **how)
    width = 2 if base + len(grammar.rules) <= 1 << 16 else 4
    return {
        "part": part, "shard": shard, "n_ids": len(ids), "doc_ids": doc_ids, "doc_starts": starts, "doc_symbols": grammar.starts,
        "base": base, "rules": grammar.rules.astype("<u4").tobytes(),
        "rule_lengths": rule_lengths(grammar.rules, base).astype("<u4").tobytes(),
        "width": width, "symbols": grammar.symbols.astype(f"<u{width}").tobytes(),
    }


def encoded_shards(docs: DataFrame, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS, **how: int) -> DataFrame:
    """Rows of the store for ``docs(doc_id, text)``: ids by the tokenizers library from the
    file at ``path``, without added special tokens, and ``end_id`` after each document.

    Documents are partitioned and sorted by doc_id before they are encoded; a shard closes
    when it has ``shard_ids`` ids, so a task holds one shard and one chunk of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = Encoder(path), TaskContext.get().partitionId(), 0
        base = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        n_held = 0

        def closed() -> pa.RecordBatch:
            doc_ids = [d for h in held for d in h[0]]
            ids, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            row = shard_row(part, shard, doc_ids, ids, np.cumsum(counts) - counts, base, **how)
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in chunks(batches, size=CHUNK_BYTES):
            ids, at = encoder.encode(*buffer_of(batch.column("text")))
            doc_ids, n = batch.column("doc_id").to_pylist(), len(at) - 1
            ends = np.arange(1, n + 1)
            with_end = np.full(len(ids) + n, end_id, np.uint32)
            with_end[np.arange(len(ids)) + np.repeat(ends - 1, np.diff(at))] = ids
            at = at + np.arange(n + 1)
            done = 0
            while done < n:
                stop = max(int(np.searchsorted(at, at[done] + shard_ids - n_held, "left")), done + 1)
                stop = min(stop, n)
                held.append((doc_ids[done:stop], with_end[at[done] : at[stop]], np.diff(at[done : stop + 1])))
                n_held += int(at[stop] - at[done])
                done = stop
                if n_held >= shard_ids:
                    yield closed()
                    held, n_held, shard = [], 0, shard + 1
        if held:
            yield closed()

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    splits, cores = wanted.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(splits, cores), splits // 8)
    order = ("doc_id", F.xxhash64("text"))  # texts under one doc_id, or under none, spread too
    return wanted.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, **how: int) -> None:
    """Encode ``docs`` and write the store at ``path``.

    Null and empty texts are documents of one id, the end. Repeated rows and rows with equal
    doc_ids are separate documents, next to each other, ordered by the text's hash; null
    doc_ids come first. An empty table makes an empty store. Other columns are left out.
    """
    shards = encoded_shards(docs, tokenizer, end_id, **how)
    shards.write.options(**LAYOUT).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store, decoded: doc_id, start (ids of all documents before it),
    n_tokens, ids (little-endian unsigned 32-bit integers)."""
    return _documents(spark, path, with_ids=True)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store, decoded: doc_id, start, n_tokens, ids_crc32."""
    return _documents(spark, path, with_ids=False)


def _documents(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    last = ("ids", pa.binary()) if with_ids else ("ids_crc32", pa.int64())
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                starts = np.array(row["doc_starts"], np.int64)
                ends = np.append(starts[1:], row["n_ids"])
                raw = decode(row).astype("<u4", copy=False).tobytes()
                texts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts),
                        pa.array(texts if with_ids else [zlib.crc32(x) for x in texts], last[1]),
                    ],
                    schema=schema,
                )

    stored = spark.read.schema(SCHEMA).parquet(path)
    found = stored.mapInArrow(run, f"part int, shard int, doc_id long, start long, n_tokens long, {last[0]} {'binary' if with_ids else 'long'}")
    # ids before each part, and before each shard of its part
    sizes = stored.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("in_parts"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.join(parts, "part").select(
        "part", "shard", (F.col("in_parts") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("before")
    )
    placed = found.join(before, ["part", "shard"])
    return placed.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", last[0])
