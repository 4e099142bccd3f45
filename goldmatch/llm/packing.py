"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmatch.llm.pieces import CHUNK_BYTES, Encoder, in_large_tasks
from goldmatch.llm.scale import in_batches, running_sum
from goldmatch.llm.text import buffer_of, chunks
from goldmatch.session import dimension, written

MAX_LENGTH = 4096


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, max_length: int = MAX_LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of ``docs(doc_id, text)``.

    A document's ids come from the tokenizers library with the file at ``path``, without
    added special tokens, and ``end_id`` after them. Documents of more than ``max_length``
    ids are cut into pieces of that many; the last may be shorter. Null and empty texts are
    one piece of the end alone.
    """
    last = [("ids", pa.binary())] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches, size=CHUNK_BYTES):
            ids, at = encoder.encode(*buffer_of(batch.column("text")))
            raw, rows = ids.astype("<u4", copy=False).tobytes(), []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = raw[4 * a : 4 * b] + end
                for i, s in enumerate(range(0, b - a + 1, max_length)):
                    cut = own[4 * s : 4 * (s + max_length)]
                    rows.append((doc, i, s, len(cut) // 4, zlib.crc32(cut), *([cut] if with_ids else [])))
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    wanted = in_large_tasks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return in_batches(wanted, run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit_plan(histogram: dict[int, int], capacity: int = MAX_LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for all lengths: rows (length, low, high, sequence, each, offset).

    Pieces of a length are numbered; number r in [low, high) goes to the sequence
    ``sequence`` + (r - low) // each, at ``offset`` + (r - low) % each * length. Longest
    first, every piece takes the fullest sequence that still holds it. Sequences with the
    same room left are handled together as ranges, so the work depends on the number of
    different lengths, not on the number of pieces.
    """
    plan, next_sequence = [], 0
    ranges: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    rooms: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, low = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(at)
            else:
                room, n = capacity, -(-left // (capacity // length))
                first, next_sequence = next_sequence, next_sequence + n
            each = room // length
            whole = min(n, left // each)
            for sequences, of_each in ((whole, each), (min(1, n - whole), left - whole * each if whole < n else 0)):
                if sequences and of_each:
                    of_each = min(of_each, each)
                    pieces = sequences * of_each
                    plan.append((length, low, low + pieces, first, of_each, capacity - room))
                    put(room - of_each * length, first, sequences)
                    low, left, first, n = low + pieces, left - pieces, first + sequences, n - sequences
            put(room, first, n)
    return plan


def pack(pieces: DataFrame, keys: list[str], capacity: int = MAX_LENGTH) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit packing by the column ``length``.

    Only the histogram of lengths, at most ``capacity`` counts, comes to the driver; the
    plan goes out as a stored table whose size is measured before it is broadcast. Each
    piece takes the slot of its rank within its length. Ranks come from counts per bin of a
    hash, so a length with a third of all pieces is spread over many tasks. ``keys`` name a
    piece (rows equal in them are interchangeable); lengths lie in [1, capacity].
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_table(spark, best_fit_plan(counts, capacity))
    ranked = running_sum(pieces, ["length"], list(keys), F.lit(1), F.xxhash64(*keys), "_rank")
    slot = (F.col("_length") == F.col("length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    of = F.col("_rank") - F.col("_low")
    return ranked.join(plan, slot).select(
        *[F.col(c) for c in pieces.columns],
        (F.col("_sequence") + F.floor(of / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + of % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def plan_table(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    schema = "_length long, _low long, _high long, _sequence long, _each long, _offset long"
    return dimension(spark.createDataFrame(plan, schema), "plan")


def packed_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = MAX_LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in packed sequences.

    Documents are encoded once; the pieces are a written table. Repeated rows and equal
    doc_ids are packed as separate documents, and a null doc_id is kept. An empty table
    gives an empty result. Columns beside doc_id and text are left out.
    """
    pieces = written(token_pieces(docs, path, end_id, capacity, with_ids), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of pieces packed with their ids: a row per sequence, at most
    ``capacity`` ids each."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered["ids"], F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
