"""Texts cut into pieces that a tokenizer treats alone, each distinct piece handled once.

A cut stands before white space that follows something else, and between an ASCII letter
and a closing mark. The tokenizers' patterns never match across such a place, so a text's
tokens are those of its pieces in order.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from goldmatch.llm.text import buffer_of, chunks, span_hashes

CHUNK_BYTES = 5 << 20
KNOWN_PIECES, KNOWN_BYTES = 1 << 20, 64
# marks that end a word but stand behind no letter inside a special token
CLOSING = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()#*$%&", np.uint8))
LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
# The patterns of the byte-level and of the lower-cased word tokenizer, for
# texts of ASCII characters and Latin-1 letters.
LATIN_BYTES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"
LATIN_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\s{LATIN}0-9]+"


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1
    characters for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, and for every text the index of its first one.

    No cut is made after a character that might be white space outside ASCII.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        blank = (data == 32) | (data == 10) | (data == 9) | (data == 13)
        solid = (data > 32) & (data != 127)
        high = data >= 128
        solid[1:] &= ~(high[1:] & (data[:-1] == 0xC2))
        solid[2:] &= ~(high[2:] & (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
        cut[1:] = blank[1:] & solid[:-1] | CLOSING[data[1:]] & LETTER[data[:-1]]
    begin = offsets[:-1][np.diff(offsets) > 0]
    cut[begin] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every piece the number of its distinct kind, and for every kind one piece and the hash."""
    codes, kinds = pd.factorize(span_hashes(data, starts, ends))
    one = np.empty(len(kinds), np.int64)
    one[codes] = np.arange(len(codes))
    return codes, one, kinds


def ragged(lengths: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Positions in a flat array of rows with these lengths, for the rows in ``take``."""
    first = np.cumsum(lengths) - lengths
    n = lengths[take]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[take] - (ends - n), n)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The rows of a flat array that start there and have these lengths, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class Known:
    """Ids of pieces met before, by the pieces' hashes, in flat arrays.

    Beyond ``most`` pieces those go that no chunk has asked for since the last time; if that
    leaves more than half, all go. What is gone is encoded again.
    """

    def __init__(self, most: int = KNOWN_PIECES):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.asked = np.zeros(0, bool)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece stands, and whether it does."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        there = self.keys[at] == hashes
        self.asked[at[there]] = True
        return at, there

    def add(self, hashes: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        if len(self.keys) + len(hashes) > self.most:
            stay = self.asked
            if 2 * np.count_nonzero(stay) > self.most:
                self.clear()
            else:
                kept = gathered(self.flat, self.starts[stay], self.lengths[stay])
                self.keys, self.lengths, self.flat = self.keys[stay], self.lengths[stay], kept
                self.starts, self.asked = np.cumsum(self.lengths) - self.lengths, np.zeros(len(self.keys), bool)
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.keys, hashes[order])
        starts = np.cumsum(lengths) - lengths + len(self.flat)
        self.keys, self.asked = np.insert(self.keys, at, hashes[order]), np.insert(self.asked, at, False)
        self.starts, self.lengths = np.insert(self.starts, at, starts[order]), np.insert(self.lengths, at, lengths[order])
        self.flat = np.concatenate([self.flat, flat])


class Encoder:
    """Ids of a byte-level or word-end BPE file by the tokenizers library.

    ``known`` keeps the ids of short pieces met before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        self.lowers = spec["normalizer"] is not None
        self.latin = re.compile(LATIN_WORDS if self.lowers else LATIN_BYTES, re.ASCII)
        self.other = re.compile(f"[^\\x00-\\x7f{LATIN}]")
        self.special = [t["content"] for t in spec["added_tokens"]]
        for token in self.special:
            raw = np.frombuffer(token.encode("utf-8"), np.uint8)
            if (CLOSING[raw[1:]] & LETTER[raw[:-1]]).any():
                raise ValueError(f"texts would be cut inside the special token {token}")
        self.known = Known()

    def parts(self, piece: bytes) -> list[str] | None:
        """What the model gets of a piece; None if a special token stands in it."""
        text = piece.decode("utf-8")
        if "<|" in text and any(s in text for s in self.special):
            return None
        if not self.other.search(text):
            if self.lowers:
                text = text.lower()
            return [m.encode("utf-8").decode("latin-1").translate(self.letters) for m in self.latin.findall(text)]
        if self.lowers:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [m for m, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def piece_ids(self, piece: bytes) -> list[int]:
        parts = self.parts(piece)
        if parts is None:
            return self.tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids
        model = self.tokenizer.model.tokenize
        return [t.id for p in parts for t in model(p)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts, and n + 1 offsets into them."""
        starts, ends, first = piece_spans(data, offsets)
        codes, one, hashes = distinct(data, starts, ends)
        at, there = self.known.find(hashes)
        new = np.flatnonzero(~there)
        raw, out = data.tobytes(), []
        gc.disable()  # many small objects, none in cycles
        for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True):
            out.append(self.piece_ids(raw[a:b]))
        gc.enable()
        new_lengths = np.array([len(x) for x in out], np.int64)
        new_flat = np.array([i for x in out for i in x], np.uint32)
        new_starts = np.cumsum(new_lengths) - new_lengths
        # every kind's ids, in the known pieces' array or behind it
        begin, lengths = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
        begin[there], lengths[there] = self.known.starts[at[there]], self.known.lengths[at[there]]
        begin[new], lengths[new] = new_starts + len(self.known.flat), new_lengths
        ids = gathered(np.concatenate([self.known.flat, new_flat]), begin[codes], lengths[codes])
        short = ends[one[new]] - starts[one[new]] < KNOWN_BYTES
        self.known.add(hashes[new[short]], new_lengths[short], gathered(new_flat, new_starts[short], new_lengths[short]))
        total = np.concatenate([[0], np.cumsum(lengths[codes])])
        return ids, total[first]


def in_large_tasks(docs: DataFrame) -> DataFrame:
    """Up to eight scan splits per task while all cores have one, without a shuffle: a task
    handles each distinct piece once, and larger tasks repeat fewer of them."""
    splits, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(max(1, min(splits, cores), splits // 8))


def per_chunk(work: Callable[[np.ndarray, np.ndarray], list[pa.Array]], names: list[str]) -> Callable:
    """A function for mapInArrow: ``doc_id`` and the arrays that ``work`` makes of a chunk's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=CHUNK_BYTES):
            arrays = work(*buffer_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    return run
