"""Spelling variants: words one edit apart, found by Gram matrices of letter-count blocks.

One inserted or deleted letter changes a word's letter counts by one step, one replaced
letter by two, so the squared distance of the counts is 1 (adjacent lengths) or 2 (equal
lengths). The words of one length fall into blocks by the counts of eight letter classes;
an edit leads to one of a few neighbouring blocks. Each pair of neighbouring blocks meets
in one task, where a matrix product gives all squared distances and the pairs that are
near enough are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmatch.session import dimension, written

# fixed values: the letters of a run, and how many a word has at least
RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(chr(c) for c in range(0xC0, 0x100))
MIN_LENGTH, MIN_COUNT, RATIO, DROP = 7, 2, 10, 31

CLASSES = 8
TILE_WORDS, TILE_BYTES, LANE_TILES = 2048, 4 << 20, 16


def lexicon(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int | None = DROP) -> DataFrame:
    """``word, n``: the lower-cased runs of letters of all texts that are long and frequent enough.

    With ``drop`` a run loses one letter where ``drop`` divides the checksum of its doc_id
    and itself: the letter whose place is that checksum modulo the length. A null doc_id
    counts as empty; null and empty texts have no runs; repeated rows count as often as
    they occur. Texts are read whole, in generated code.
    """
    shortest = f"{RUN}{{{min_length},}}"
    # the doc_id takes part in the checksum only, so it stays text next to the run
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text"), F.lit(shortest), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if drop:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = h % F.length("run")
        less = F.concat(F.substr("run", F.lit(1), at.cast("int")), F.substr("run", at.cast("int") + 2))
        word = F.when(h % drop == 0, less).otherwise(F.col("run"))
    counts = found.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def block_of(word: Column) -> Column:
    """How many letters of each class the word has; the classes are code points modulo eight."""
    classes = ["".join(c for c in LETTERS if ord(c) % CLASSES == i) for i in range(CLASSES)]
    return F.array(*[F.length(word) - F.length(F.translate(word, letters, "")) for letters in classes])


def neighbours_of(block: Column) -> Column:
    """The blocks one step away, each pair of blocks from one side only: a letter of one
    class replaced by one of an earlier class, and a letter more of any class."""

    def moved(*steps: tuple[int, int]) -> Column:
        by = dict(steps)
        return F.array(*[F.get(block, F.lit(i)) + by.get(i, 0) for i in range(CLASSES)])

    swaps = [F.when(F.get(block, F.lit(j)) > 0, moved((i, 1), (j, -1))) for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    return F.array_compact(F.array(*swaps, *[moved((i, 1)) for i in range(CLASSES)]))


def tiles_of(n: Column, length: Column) -> Column:
    """Over how many tiles a block's ``n`` words of ``length`` letters are dealt."""
    room = F.greatest(F.lit(1), F.least(F.lit(TILE_WORDS), F.floor(F.lit(TILE_BYTES) / length)))
    return F.ceil(n / room).cast("int")


class Words:
    """Words of one length as a matrix of letters, with their counts."""

    def __init__(self, joined: list[str], n: list[np.ndarray], length: int) -> None:
        letters = np.frombuffer("".join(joined).encode("latin-1"), np.uint8)
        self.letters, self.n, self.length = letters.reshape(-1, length), np.concatenate(n), length

    def text(self, at: np.ndarray) -> list[str]:
        return [row.tobytes().decode("latin-1") for row in self.letters[at]]

    def letter_counts(self) -> np.ndarray:
        """Exact in the chosen type: sums of products stay below the squared length."""
        codes = np.full(256, 0, np.int64)
        codes[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
        rows = np.repeat(np.arange(len(self.letters)) * len(LETTERS), self.length)
        flat = np.bincount(rows + codes[self.letters].ravel(), minlength=len(self.letters) * len(LETTERS))
        return flat.reshape(-1, len(LETTERS)).astype(np.float32 if self.length < 2048 else np.float64)


def near_pairs(a: Words, b: Words, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs one edit apart; ``b`` is as long as ``a`` or one shorter.

    With ``same``, ``b`` is ``a`` and every pair comes once.
    """
    x, y = a.letter_counts(), b.letter_counts()
    squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(squared == (2 if a.length == b.length else 1))
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, (8 << 20) // a.length)
    near = [one_edit(a.letters[i[k : k + step]], b.letters[j[k : k + step]]) for k in range(0, len(i), step)]
    near = np.concatenate(near) if near else np.zeros(0, bool)
    return i[near], j[near]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of letters: equal but for one letter, or ``a`` with one letter left out is ``b``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a[:, :-1] == b, axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= b.shape[1]


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: both directions of every pair of ``words(word, n)`` one edit apart.

    A block's words are dealt over tiles of bounded rows and bytes. A tile meets the tiles
    of neighbouring blocks, at most ``LANE_TILES`` of a block in one group; a group holds its own tile and as
    much of the others as fills one. No pair is left out, whatever a block's size.
    """
    known = words.select("word", "n", block_of(F.col("word")).alias("block"), F.length("word").alias("length"))
    sizes = known.groupBy("block", "length").agg(F.count("*").alias("n")).select("block", tiles_of(F.col("n"), F.col("length")).alias("tiles"))
    many = dimension(sizes.where("tiles > 1"), "spelling-tiles")
    dealt = known.join(many, "block", "left").withColumn("tile", F.pmod(F.xxhash64("word"), F.coalesce("tiles", F.lit(1))).cast("int"))
    packed = F.sort_array(F.collect_list(F.struct("word", "n")))
    stored = dealt.groupBy("block", "length", "tile").agg(packed.alias("w"), F.first(F.coalesce("tiles", F.lit(1))).alias("tiles"))
    stored = written(stored.select("block", "length", "tile", "tiles", F.array_join("w.word", "").alias("words"), F.col("w.n").alias("n")), "spelling-blocks")

    # a block whose neighbours have many tiles meets them in several lanes
    reach = many.select(F.explode(F.concat(F.array("block"), neighbours_of(F.col("block")))).alias("block"), F.ceil(F.col("tiles") / LANE_TILES).cast("int").alias("lanes"))
    lanes = dimension(reach.groupBy("block").agg(F.max("lanes").alias("lanes")).where("lanes > 1"), "spelling-lanes")
    held = stored.join(lanes, "block", "left").withColumn("lane", F.explode(F.sequence(F.lit(0), F.coalesce("lanes", F.lit(1)) - 1)))
    held = held.select("block", "tile", "lane", F.lit(0).alias("role"), "length", "words", "n")

    lane = F.floor(F.col("tile") / LANE_TILES).cast("int").alias("lane")
    to = stored.select(F.explode(neighbours_of(F.col("block"))).alias("block"), lane, "length", "words", "n")
    to = to.join(many, "block", "left").withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    earlier = stored.where("tile > 0").select("block", lane, "length", "words", "n", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("tile"))
    asking = to.select(*held.columns[:3], F.lit(1).alias("role"), *held.columns[4:]).union(earlier.select(*held.columns[:3], F.lit(1).alias("role"), *held.columns[4:]))
    met = held.union(asking).repartition("block", "tile", "lane").sortWithinPartitions("block", "tile", "lane", "role", F.desc("length"))

    def pairs(a: Words, b: Words, same: bool) -> pa.RecordBatch:
        i, j = near_pairs(a, b, same)
        left, right = a.text(i), b.text(j)
        return pa.RecordBatch.from_pydict({
            "word": pa.array(left + right, pa.string()),
            "near": pa.array(right + left, pa.string()),
            "near_n": pa.array(np.concatenate([b.n[j], a.n[i]]), pa.int64()),
        })

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own = None
        waiting, held_words = [], 0
        for batch in batches:
            n_values, n_at = batch.column("n").flatten().to_numpy(), batch.column("n").offsets.to_numpy()
            n_at = n_at - n_at[0]
            keys = zip(*[batch.column(c).to_pylist() for c in ("block", "tile", "lane", "role", "length", "words")], strict=True)
            for row, (block, tile, lane, role, length, words) in enumerate(keys):
                n = n_values[n_at[row] : n_at[row + 1]]
                full = held_words + len(n) > TILE_WORDS or (held_words + len(n)) * length > TILE_BYTES
                if waiting and ((block, tile, lane) != at or waiting[0][0] != length or full):
                    yield pairs(own, Words([w for _, w, _ in waiting], [m for *_, m in waiting], waiting[0][0]), False)
                    waiting, held_words = [], 0
                if (block, tile, lane) != at:
                    at, own = (block, tile, lane), None
                if role == 0:
                    own = Words([words], [n], length)
                    if lane == 0 and len(n) > 1:
                        yield pairs(own, own, True)
                elif own:
                    waiting.append((length, words, n))
                    held_words += len(n)
        if waiting:
            yield pairs(own, Words([w for _, w, _ in waiting], [m for *_, m in waiting], waiting[0][0]), False)

    return met.mapInArrow(compare, "word string, near string, near_n long")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words(word, n)``; words are distinct.

    Two words are near if one inserted, deleted or replaced code point leads from one to
    the other. A word's ``form`` is its near word of largest n (ties: the smaller word), if
    that n is at least ``ratio`` times its own; ``root`` is the last of the forms from word
    to form to form. Words consist of the letters of ``LETTERS``. Pairs are reduced to one
    line per word before they are shuffled. An empty table gives an empty result.

    Along forms n grows ``ratio`` times a step, so the steps of the longest chain are
    bounded by the logarithm of the largest n; each round doubles the distance followed.
    """
    words = written(words, "lexicon")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
    has = F.col("best_n") >= F.lit(ratio) * F.col("n")
    judged = written(
        joined.select(
            "word", F.when(has, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    step = dimension(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("last"))
        ahead = step.join(further, "root", "left")
        if ahead.where("last IS NOT NULL").isEmpty():
            break
        step = dimension(ahead.select("word", F.coalesce("last", "root").alias("root")), "spelling-steps")
    return judged.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
