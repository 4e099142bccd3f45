"""Line dedup by an exact set-similarity join: prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmatch.llm.pieces import in_large_tasks
from goldmatch.llm.scale import free_name, in_batches
from goldmatch.llm.text import buffer_of, chunks, mix, runs, span_hashes, words
from goldmatch.session import dimension, written

PERCENT, COUNTERS, SLICES, BLOCK, CHUNK = 80, 1 << 22, 64, 8192, 2 << 20
NARROW = 48  # sets of up to so many tokens get a sketch of 64 parities instead of 128
MAYBE_LARGE = 1 << 31
_U = np.uint64


def needed_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of n and m tokens with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's rarest tokens suffice to share one with every similar set."""
    return n - -(-percent * n // 100) + 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty lines: starts, ends, their document, their number in it (from 0, empty ones counted)."""
    starts, ends = runs(data != 10, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[doc])
    return starts, ends, doc, number


def distinct_tokens(hashed: np.ndarray, line: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Line and token of the distinct tokens of each line; ``line`` has the line of every word.

    They come by line, and in a line by rarity in ``counts``, then by hash. All words are
    numbered in that order once, so that one sort of integers serves every line.
    """
    codes, kinds = pd.factorize(hashed)
    kinds = np.asarray(kinds, _U)
    order = np.argsort(kinds) if counts is None else np.lexsort((kinds, counts[(kinds % _U(len(counts))).astype(np.int64)]))
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    keys = np.unique(line * max(len(kinds), 1) + rank[codes])
    line, place = np.divmod(keys, max(len(kinds), 1))
    return line, kinds[order[place]]


def token_counters(docs: DataFrame, counters: int) -> np.ndarray:
    """How often tokens occur in all texts, by hash modulo ``counters``.

    Every task counts into one array and hands it on in slices, which are added up by
    slice. The driver gets one array of ``counters`` 32-bit numbers, whatever the input.
    """
    width = counters // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in chunks(batches, size=CHUNK):
            data, offsets = buffer_of(batch.column("text"))
            starts, ends, _ = words(data, offsets)
            codes, kinds = pd.factorize(span_hashes(data, starts, ends))
            np.add.at(total, (np.asarray(kinds, _U) % _U(counters)).astype(np.int64), np.bincount(codes, minlength=len(kinds)))
        parts = np.minimum(total, (1 << 31) - 1).astype("<i4").reshape(SLICES, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(c.as_buffer(), "<i4").astype(np.int64)
        whole = [np.minimum(x, (1 << 31) - 1).astype("<i4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(whole, pa.binary())], ["slice", "counts"])

    parts = in_batches(docs.select("text"), count, "slice int, counts binary")
    rows = parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()
    out = np.zeros((SLICES, width), np.int32)
    for r in rows:
        out[r.slice] = np.frombuffer(r.counts, "<i4")
    return out.ravel()


def line_sets(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Lines with a token: doc_id, line, n (distinct tokens), k0, k1 (key of the set), prefix, s0, s1.

    ``prefix`` has the rarest tokens: 32 bits of each above its place in the order of rarity,
    with ``MAYBE_LARGE`` set where its counter allows more than ``BLOCK`` lines.
    Tokens that occur once in all texts stand in no other line and are left out of it. The
    32-bit numbers only propose pairs. ``s0`` and ``s1`` are 128 parities: each token turns
    one bit, so two sets differ in at least as many tokens as their sketches in bits. Small
    sets have both halves folded into ``s0``, 64 parities, and 0 in ``s1``.
    """
    counters, block = len(counts), BLOCK
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in chunks(batches, size=CHUNK):
            data, offsets = buffer_of(batch.column("text"))
            starts, ends, doc, number = line_spans(data, offsets)
            w_starts, w_ends, _ = words(data, offsets)
            if not len(w_starts):
                continue
            in_line = np.searchsorted(starts, w_starts, "right") - 1
            of, tokens = distinct_tokens(span_hashes(data, w_starts, w_ends), in_line, often)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            has, n = of[first], np.diff(np.append(first, len(of)))
            keys = [np.add.reduceat(mix(tokens ^ _U(salt)), first).view(np.int64) for salt in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)]
            bit, upper = _U(1) << (tokens >> _U(20) & _U(63)), tokens >> _U(26) & _U(1)
            sketch = [np.bitwise_xor.reduceat(np.where(upper == _U(half), bit, _U(0)), first).view(np.int64) for half in (1, 0)]
            narrow = n <= NARROW
            sketch = [np.where(narrow, sketch[0] ^ sketch[1], sketch[0]), np.where(narrow, 0, sketch[1])]
            place = np.arange(len(of)) - np.repeat(first, n)
            count = often[(tokens % _U(counters)).astype(np.int64)]
            use = (place < np.repeat(np.where(n > 1, prefix_length(n, percent), 0), n)) & (count > 1)
            sizes = np.add.reduceat(use.astype(np.int64), first)
            at = np.where(count > block, place | MAYBE_LARGE, place)[use].astype(_U)
            prefix = (tokens[use] << _U(32) | at).view(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc[has])), pa.array(number[has].astype(np.int32)), pa.array(n.astype(np.int32)),
                    pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(pa.array(at), pa.array(prefix)),
                    pa.array(sketch[0]), pa.array(sketch[1]),
                ],
                ["doc_id", "line", "n", "k0", "k1", "prefix", "s0", "s1"],
            )

    return in_batches(docs, run, "doc_id long, line int, n int, k0 long, k1 long, prefix array<long>, s0 long, s1 long")


def lines_with_words(text: Column) -> Column:
    """Numbers of the lines that hold a word, ascending."""
    numbers = F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i))
    return F.filter(numbers, lambda i: i.isNotNull())


def candidates(postings: DataFrame, percent: int, first_only: bool) -> DataFrame:
    """Pairs (later line, earlier line) that pass the filters, of ``postings`` by token.
    Only lines that ask are later ones; without a column ``asks`` all do.

    With ``first_only`` each later line gets the earliest partner of each token and whether
    it has more there (2 partners) or not (1), else all of them. Rows come by block pair of a
    token; they are put in the order of the lines and compared as arrays, a step at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            whole = pa.Table.from_batches([*([carried] if carried else []), batch]).combine_chunks().to_batches()
            if not whole:
                continue
            rows = whole[0]
            group = np.asarray(rows.column("pair"))
            change = np.flatnonzero(group[1:] != group[:-1]) + 1
            if not len(change):
                carried = rows
                continue
            carried = rows.slice(int(change[-1]))
            yield found(rows.slice(0, int(change[-1])), np.concatenate([[0], change]))
        if carried:
            yield found(carried, np.array([0, carried.num_rows]))

    def found(rows: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        column = {c: np.asarray(rows.column(c)) for c in rows.schema.names}
        order = np.lexsort((column["line"], column["doc_id"], column["pair"]))
        pair, doc, line, cut, size = (column[c][order] for c in ("pair", "doc_id", "line", "cut", "size"))
        own, cross, n, place = cut >> 1, cut & 1 > 0, size >> 32, size & MAYBE_LARGE - 1
        s0, s1 = (column[c][order].view(_U) for c in ("s0", "s1"))
        folded, wide = s0 ^ s1, n > NARROW
        later = np.flatnonzero(column["asks"][order]) if "asks" in column else np.arange(len(n))
        begin = np.repeat(edges[:-1], np.diff(edges))[later]
        partners, first = np.zeros(len(n), np.int64), np.full(len(n), -1)
        pairs_y, pairs_x = [], []
        step, active = 0, later[begin < later]
        start = begin[begin < later]
        while len(active):
            x, y = start + step, active
            overlap = needed_overlap(n[x], n[y], percent)
            # the tokens from this one on must suffice; of two blocks only pairs across count
            good = (np.minimum(n[x] - place[x], n[y] - place[y]) >= overlap) & ~(cross[y] & (own[x] == own[y]))
            halves = np.bitwise_count(s0[x] ^ s0[y]) + np.bitwise_count(s1[x] ^ s1[y]).astype(np.int64)
            differ = np.where(wide[x] & wide[y], halves, np.bitwise_count(folded[x] ^ folded[y]))
            good &= differ <= n[x] + n[y] - 2 * overlap
            hit = y[good]
            if first_only:
                fresh = first[hit] < 0
                first[hit[fresh]] = x[good][fresh]
                partners[hit] += 1
            else:
                pairs_y.append(hit)
                pairs_x.append(x[good])
            step += 1
            going = (start + step < active) & (partners[active] < 2)
            active, start = active[going], start[going]
        if first_only:
            y = np.flatnonzero(first >= 0)
            x, count = first[y], partners[y]
        else:
            y, x = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (pairs_y, pairs_x))
            count = np.ones(len(y), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (doc[y], line[y], doc[x], line[x], count, pair[y])], ["doc_y", "line_y", "doc_x", "line_x", "partners", "pair"]
        )

    ordered = postings.repartition("pair").sortWithinPartitions("pair")
    return ordered.mapInArrow(run, "doc_y long, line_y int, doc_x long, line_x int, partners long, pair long")


def _token(t: Column) -> Column:
    return F.shiftright(t, 32).cast("int")


def large_tokens(classes: DataFrame) -> DataFrame:
    """token, blocks: the prefix tokens with more than ``BLOCK`` lines. Only those are counted whose counter allows it."""
    maybe = F.filter("prefix", lambda t: t.bitwiseAND(F.lit(MAYBE_LARGE)) != 0)
    counts = classes.select(F.explode(F.transform(maybe, _token)).alias("token")).groupBy("token").count()
    large = counts.where(F.col("count") > BLOCK)
    return dimension(large.select("token", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "blocks")


def posted(classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row per prefix token of each class, ready for ``candidates``.

    Large tokens are cut into blocks by a hash of the line; a line goes to every pair of
    its block with another, so no task holds more than two blocks.
    ``pair`` is the token above a hash of the blocks (0: not cut): rows that meet by its
    chance are only tested more. Rows are narrow, as they are the bulk of what is shuffled:
    ``size`` has n above place, ``cut`` the own block above whether the other one differs.
    """
    each = classes.select("doc_id", "line", "n", "s0", "s1", F.explode("prefix").alias("t"))
    size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("t").bitwiseAND(F.lit(MAYBE_LARGE - 1))).alias("size")
    each = each.select(_token(F.col("t")).alias("token"), "doc_id", "line", size, "s0", "s1")
    each = each.join(blocks, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("doc_id", "line"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = each.withColumn("own", own).withColumn("other", other)
    met = F.xxhash64(F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(F.lit(0xFFFFFFFF))
    pair = F.shiftleft(F.col("token").cast("long"), 32).bitwiseOR(F.when(F.col("blocks") > 1, met).otherwise(0)).alias("pair")
    cut = (2 * F.col("own") + (F.col("own") != F.col("other")).cast("long")).alias("cut")
    return dealt.select(pair, "doc_id", "line", "size", "s0", "s1", cut)


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """doc_y, line_y of the pairs whose token sets are similar, by the sets themselves."""
    ends = [pairs.select(F.col(f"doc_{e}").alias("doc_id"), F.col(f"line_{e}").alias("line")) for e in "xy"]
    wanted = ends[0].union(ends[1]).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    texts = docs.join(dimension(wanted, "wanted"), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=CHUNK):
            data, offsets = buffer_of(batch.column("text"))
            starts, ends, doc, number = line_spans(data, offsets)
            w_starts, w_ends, _ = words(data, offsets)
            in_line = np.searchsorted(starts, w_starts, "right") - 1
            lists = batch.column("lines")
            asked = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists))) << 32 | np.asarray(lists.flatten()).astype(np.int64)
            use = np.isin(doc << 32 | number, asked)[in_line]
            of, tokens = distinct_tokens(span_hashes(data, w_starts, w_ends)[use], in_line[use])
            if not len(of):
                continue
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            at = np.append(first, len(of)).astype(np.int32) * np.int32(8)
            sets = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(tokens)])
            ids = batch.column("doc_id").take(pa.array(doc[of[first]]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number[of[first]].astype(np.int32)), sets], ["doc_id", "line", "tokens"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, tokens, sizes = [], [], []
            for side in ("tokens_x", "tokens_y"):
                sets = batch.column(side)
                n = np.asarray(pc.binary_length(sets)).astype(np.int64) // 8
                pair.append(np.repeat(np.arange(len(n)), n))
                tokens.append(np.frombuffer(b"".join(sets.to_pylist()), _U))
                sizes.append(n)
            codes, kinds = pd.factorize(np.concatenate(tokens))
            both = np.sort(np.concatenate(pair) * max(len(kinds), 1) + codes)
            twice = both[1:][both[1:] == both[:-1]] // max(len(kinds), 1)
            shared = np.bincount(twice, minlength=batch.num_rows)
            keep = 100 * shared >= percent * (sizes[0] + sizes[1] - shared)
            yield batch.select(["doc_y", "line_y"]).filter(pa.array(keep))

    found = written(in_batches(texts.select("doc_id", "text", "lines"), sets, "doc_id long, line int, tokens binary"), "sets")
    for e in "xy":
        pairs = pairs.join(found.select(F.col("doc_id").alias(f"doc_{e}"), F.col("line").alias(f"line_{e}"), F.col("tokens").alias(f"tokens_{e}")), [f"doc_{e}", f"line_{e}"])
    return in_batches(pairs.select("doc_y", "line_y", "tokens_x", "tokens_y"), similar, "doc_y long, line_y int").distinct()


def repeated_lines(docs: DataFrame, percent: int = PERCENT, counters: int = COUNTERS) -> DataFrame:
    """doc_id, n_lines, removed (numbers of the lines to remove, from 0) of ``docs(doc_id, text)``.

    Lines are cut at \\n; a line's set are its distinct words, as they are written. A line is
    removed if an earlier one, by doc_id and then by its number, has 100 * |A and B| >=
    percent * |A or B|, whether that one stays or not. Lines without a word stay.

    1. A pass counts tokens into a bounded table, which orders them by rarity.
    2. Another writes every line's set key and its prefix: the rarest tokens, of which two
       similar sets share one. Equal sets fold into their first line.
    3. Lines that share a prefix token are tested by length, by the token's places and by a
       sketch of parities, none of which loses a similar pair; each
       later line is verified against the earliest partner of each of its tokens. A group
       of n similar lines so costs about n pairs.
    4. Lines still without a match are verified against all partners of the tokens that
       have more than the one tried.

    doc_id names a text: repeated rows of a document count once and get equal results, and
    rows with a null doc_id keep all lines, as do null and empty texts. ``n_lines`` counts
    lines with a word. An empty table gives an empty result; other columns are left out.
    """
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = one.where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = line_sets(texts, token_counters(in_large_tasks(texts), counters), percent)
    first = F.min(F.struct("doc_id", "line")).alias("first")
    classes = lines.groupBy("k0", "k1").agg(first, *[F.first(c).alias(c) for c in ("n", "prefix", "s0", "s1")])
    classes = written(classes.select("first.doc_id", "first.line", "n", "prefix", "s0", "s1"), "classes")
    long_enough = classes.where("n >= 2 AND size(prefix) > 0")
    postings = posted(long_enough, large_tokens(long_enough))
    tried = written(candidates(postings, percent, first_only=True), "candidates")
    pairs = tried.select("doc_y", "line_y", "doc_x", "line_x").distinct()
    gone = written(verified(pairs, texts, percent), "gone")
    more = tried.where("partners > 1").join(gone, ["doc_y", "line_y"], "left_anti")
    more = written(more.select("pair", F.col("doc_y").alias("doc_id"), F.col("line_y").alias("line")).distinct(), "open")
    if not more.isEmpty():
        again = postings.join(dimension(more.select("pair").distinct(), "pairs"), "pair", "left_semi")
        again = again.join(more.withColumn("asks", F.lit(True)), ["pair", "doc_id", "line"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        rest = candidates(again, percent, first_only=False).select("doc_y", "line_y", "doc_x", "line_x").distinct()
        rest = written(rest.join(pairs, ["doc_y", "line_y", "doc_x", "line_x"], "left_anti"), "rest")
        gone = written(gone.union(verified(rest, texts, percent)), "gone")
    first_ones = classes.join(gone, (F.col("doc_id") == F.col("doc_y")) & (F.col("line") == F.col("line_y")), "left_anti")
    stays = first_ones.groupBy("doc_id").agg(F.collect_list("line").alias("stays"))
    none = F.array().cast("array<int>")
    numbered = one.select("doc_id", F.when(F.col("doc_id").isNotNull(), lines_with_words(F.col("text"))).alias("lines"))
    listed = numbered.join(stays, "doc_id", "left").withColumn("lines", F.coalesce("lines", none))
    return listed.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.array_except("lines", F.coalesce("stays", none)).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` whose texts have lost the lines in ``removed(doc_id, n_lines, removed)``; all columns stay.

    With ``drop_emptied`` a document whose lines with a word all go is left out itself.
    """
    id_, gone, emptied = (free_name(docs, n) for n in ("id", "gone", "emptied"))
    listed = removed.where("size(removed) > 0").select(
        F.col("doc_id").alias(id_), F.col("removed").alias(gone), (F.col("n_lines") == F.size("removed")).alias(emptied)
    )
    joined = docs.join(dimension(listed.dropDuplicates([id_]), "removed"), docs["doc_id"].cast("long") == F.col(id_), "left")
    if drop_emptied:
        joined = joined.where(F.col(emptied).isNull() | ~F.col(emptied))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
