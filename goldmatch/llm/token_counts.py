"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmatch.llm.pieces import CHUNK_BYTES, Encoder, byte_letters, distinct, in_large_tasks, piece_spans
from goldmatch.llm.text import buffer_of, chunks

NO_RANK = np.int32(1 << 30)
BATCH = 100_000


class Merges:
    """The merge table of a byte-level BPE file: symbols are numbers, pairs have ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        number = {c: b for b, c in letters.items()}
        left, right, made = [], [], []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left.append(number[a])
            right.append(number[b])
            made.append(number.setdefault(a + b, len(number)))
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.made = np.array(made, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank[at], NO_RANK)


def count_symbols(merges: Merges, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many symbols of each sequence survive all merges.

    The sequences lie one after another. In every round each one merges all places of its
    own lowest-rank pair, from the left where they overlap; a merged symbol's pairs rank
    behind it, so this is what merging place by place gives. Sequences with no pair left
    leave the arrays.
    """
    counts = lengths.copy()
    alive = np.flatnonzero(lengths > 1)
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    keep = np.isin(sequence, alive, kind="table") if len(lengths) else np.zeros(0, bool)
    symbols, sequence = symbols[keep].astype(np.int64), sequence[keep]
    while len(symbols):
        inside = sequence[1:] == sequence[:-1]
        rank = np.full(len(symbols), NO_RANK, np.int32)
        rank[:-1][inside] = merges.ranks(symbols[:-1][inside], symbols[1:][inside])
        first = np.flatnonzero(np.concatenate([[True], ~inside]))
        lowest = np.minimum.reduceat(rank, first)
        each = np.diff(np.append(first, len(symbols)))
        mergeable = lowest < NO_RANK
        counts[sequence[first[~mergeable]]] = each[~mergeable]
        hit = (rank == np.repeat(lowest, each)) & (rank < NO_RANK)
        # of places next to each other only every other one, from the left
        at = np.flatnonzero(hit)
        run_start = np.concatenate([[True], np.diff(at) > 1]) if len(at) else np.zeros(0, bool)
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
        at = at[since % 2 == 0]
        symbols[at] = merges.made[rank[at]]
        stay = np.repeat(mergeable, each)
        stay[at + 1] = False
        symbols, sequence = symbols[stay], sequence[stay]
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of ``docs(doc_id, text)``.

    Tokens are those of the byte-level BPE file at ``path``, as the tokenizers library
    counts them without added special tokens; a special token's string inside a text is
    that one token. Texts are cut into pieces, each distinct piece of a chunk is cut into
    pre-tokens once, and their bytes go into one ragged array that is merged round by round.

    Null and empty texts have 0 bytes and 0 tokens. Every row is counted alone: repeated
    rows and null ids come back as they are, an empty table gives an empty result, columns
    beside the two are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, merges = Encoder(path), Merges(path)
        byte_of = {c: b for b, c in byte_letters().items()}
        for batch in chunks(batches, size=CHUNK_BYTES):
            data, offsets = buffer_of(batch.column("text"))
            starts, ends, first = piece_spans(data, offsets)
            codes, one, _ = distinct(data, starts, ends)
            raw, per_piece = data.tobytes(), np.zeros(len(one), np.int64)
            kinds: dict[str, int] = {}
            owner, kind = [], []
            for i, (a, b) in enumerate(zip(starts[one].tolist(), ends[one].tolist(), strict=True)):
                for part, special in parts_of(encoder, raw[a:b]):
                    if special:
                        per_piece[i] += 1
                    else:
                        owner.append(i)
                        kind.append(kinds.setdefault(part, len(kinds)))
            names = list(kinds)
            tokens = [
                count_symbols(merges, np.array([byte_of[c] for n in part for c in n], np.int64), np.array([len(n) for n in part], np.int64))
                for part in (names[j : j + BATCH] for j in range(0, len(names), BATCH))
            ]
            if owner:
                np.add.at(per_piece, np.array(owner), np.concatenate(tokens)[np.array(kind)])
            total = np.concatenate([[0], np.cumsum(per_piece[codes])])[first]
            n_bytes, n_tokens = np.diff(offsets), np.diff(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    wanted = in_large_tasks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return wanted.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def parts_of(encoder: Encoder, piece: bytes) -> Iterator[tuple[str, bool]]:
    """The pre-tokens of a piece, and the special tokens between them."""
    parts = encoder.parts(piece)
    if parts is not None:
        yield from ((p, False) for p in parts)
        return
    text = piece.decode("utf-8")
    while text:
        at, found = min(((text.find(s), s) for s in encoder.special if s in text), default=(len(text), ""))
        yield from ((p, False) for p in encoder.parts(text[:at].encode()) or [])
        if found:
            yield found, True
        text = text[at + len(found) :]
