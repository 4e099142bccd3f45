"""Token counts, token files and packing against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from goldmatch.llm import packing, token_counts, token_store
from goldmatch.llm import queries as Q
from goldmatch.llm.pieces import Encoder, Known, gathered
from goldmatch.llm.text import buffer_of

SMALL = "/root/testdata/sf0.001"
FILES = {name: public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}

NASTY = [
    "", None, "a", "'s 'S don't  x\n\n\ny   z　 a", "<|endoftext|> a<|endoftext|>b <|endoftext|", "<|startoftext|>x<|endoftext|> é",
    "a" * 900, "İstanbul ΣΑΣ ΟΔΟΣ ß ﬁ", "é ́ a ́b", "\x1c \x1d a\x85 b\x0b\x0cc", "日本語 テスト。", "😀😀 👨‍👩 ok",
    "1234 56 ７８ ²³ Ⅷ", " \t \r\n x", "​ a​ b", "﻿ q", "À  B", "don’t ‘x’ “y” … –", "\x7f x\x7f y", "\x00",
]


def nasty_texts():
    rng = random.Random(2)
    letters = "aAbB'sSt  \n\t é<|0.,! 　́İΣ日"
    return NASTY + ["".join(rng.choice(letters) for _ in range(30)) for _ in range(600)] + ["word " * 30_000, "x" * 40_000]


@pytest.mark.parametrize("name", FILES)
def test_encoder_is_the_library(name):
    texts, library = nasty_texts(), Tokenizer.from_file(FILES[name])
    ids, at = Encoder(FILES[name]).encode(*buffer_of(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def documents(spark, texts):
    rows = [(i if i % 50 else None, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, piece string, length int")


@pytest.mark.parametrize("name", list(FILES))
def test_encoder_forgets_and_cuts_before_marks(name):
    encoder, rng = Encoder(FILES[name]), np.random.default_rng(3)
    encoder.known = Known(most=40)
    syllables = ["don't", "x's.", "a...b", "Ok!?", "(z)", "é.", "e\u0301,", "ß'S", "K%", "1.5", "'ll", "n'T", "<|endoftext|>", "a<|", "|>.", "q&&& "]
    for _ in range(12):
        texts = ["".join(rng.choice(syllables + [" ", "\n"], 30)) for _ in range(20)]
        ids, at = encoder.encode(*buffer_of(pa.array(texts)))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known.keys) <= 40 + 40 * 20


def test_known_pieces_drop_those_not_asked_for():
    known, key = Known(most=4), lambda *x: np.array(x, np.uint64)
    known.add(key(9, 3, 5), np.array([1, 0, 2]), np.array([90, 50, 51], np.uint32))
    known.find(key(5))
    known.add(key(1, 7), np.array([1, 1]), np.array([10, 70], np.uint32))
    at, there = known.find(key(1, 3, 5, 7, 9))
    assert there.tolist() == [True, False, True, True, False]
    assert gathered(known.flat, known.starts[at[there]], known.lengths[at[there]]).tolist() == [10, 50, 51, 70]
    known.add(key(2, 4), np.array([1, 1]), np.array([20, 40], np.uint32))
    assert known.keys.tolist() == [2, 4]


def test_token_counts(spark):
    texts, library = nasty_texts(), Tokenizer.from_file(FILES["byte_bpe_50k.json"])
    table = documents(spark, texts)
    got = token_counts.token_counts(table, FILES["byte_bpe_50k.json"]).collect()
    want = []
    for r in table.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(table.limit(0), FILES["byte_bpe_50k.json"]).count() == 0


def encoded(spark, name):
    library = Tokenizer.from_file(FILES[name])
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    return [(d.doc_id, library.encode(d.text or "", add_special_tokens=False).ids, d.text or "") for d in docs]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_queries(spark):
    want = encoded(spark, "byte_bpe_50k.json")
    got = {r.doc_id: tuple(r) for r in Q.op2_token_counts(spark, SMALL).collect()}
    assert got == {d: (d, len(t.encode()), len(i), len(i) > 512) for d, i, t in want}
    start, expected = 0, {}
    for d, ids, _ in want:
        expected[d] = (d, start, len(ids) + 1, crc([*ids, 0]))
        start += len(ids) + 1
    assert {r.doc_id: tuple(r) for r in Q.op3_token_store(spark, SMALL).collect()} == expected


def test_re_pair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    copies = np.tile(rng.permutation(5000).astype(np.uint32), 40)
    for ids, starts in ((np.full(1 << 16, 7, np.uint32), np.array([0])), (copies, np.arange(0, len(copies), 5000))):
        g = token_store.re_pair(ids, starts, 50_257)
        assert len(g.symbols) <= max(len(starts), token_store.MIN_COUNT)
        inside = np.setdiff1d(np.arange(len(g.symbols) - 1), g.starts - 1)
        pairs = np.unique(np.stack([g.symbols[inside], g.symbols[inside + 1]]), axis=1, return_counts=True)[1]
        assert pairs.max(initial=0) < token_store.MIN_COUNT
        assert (token_store.expanded(g.symbols, g.rules, token_store.rule_lengths(g.rules, g.base), g.base) == ids).all()


def test_re_pair_round_trip():
    rng = np.random.default_rng(4)
    for case in range(12):
        ids = rng.integers(0, [2, 5, 40, 3000][case % 4], [1, 2, 50, 20_000][case // 3]).astype(np.uint32)
        if case % 3 == 0:
            ids[:] = 1
        starts = np.unique(np.append(0, rng.integers(0, len(ids), len(ids) // 40)))
        row = token_store.shard_row(0, 0, [*range(len(starts))], ids, starts, 50_257, least=2, rounds=6)
        assert (token_store.decode(row) == ids).all()
        symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")
        assert case != 9 or len(symbols) < len(ids) / 20
        for _ in range(20):
            a = int(rng.integers(0, len(ids)))
            n = int(rng.integers(0, len(ids) - a + 1))
            assert (token_store.decode(row, a, n) == ids[a : a + n]).all()
        rules, lengths, _ = token_store.row_parts(row)
        for s, at in zip(starts, row["doc_symbols"], strict=True):  # documents start at their symbols
            assert token_store.expanded(symbols[:at], rules, lengths, 50_257).size == s


def test_token_store_edges(spark, tmp_path):
    table, library = documents(spark, nasty_texts()), Tokenizer.from_file(FILES["byte_bpe_50k.json"])
    token_store.write_store(table, f"{tmp_path}/s", FILES["byte_bpe_50k.json"], shard_ids=5000, least=2)
    got = token_store.read_documents(spark, f"{tmp_path}/s").collect()
    want = Counter((r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in table.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    token_store.write_store(table.limit(0), f"{tmp_path}/e", FILES["byte_bpe_50k.json"])
    assert token_store.document_digests(spark, f"{tmp_path}/e").count() == 0


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    got = Q.op5_best_fit_packing(spark, SMALL).collect()
    want = {}
    for d, ids, _ in encoded(spark, "word_bpe_49k.json"):
        ids = [*ids, 1]
        for i, s in enumerate(range(0, len(ids), 4096)):
            cut = ids[s : s + 4096]
            want[d, i] = (s, len(cut), crc(cut))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    total = sum(r.length for r in got)
    assert check_packed(got, 4096) <= -(-total // 4096) * 1.02 + 1


def greedy_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([1, 5, 64, 200])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        histogram = Counter(lengths)
        rows, used = [], {}
        for length, low, high, sequence, each, offset in packing.best_fit_plan(histogram, capacity):
            for r in range(high - low):
                rows.append((length, low + r))
                used.setdefault(sequence + r // each, []).append((offset + r % each * length, length))
        assert sorted(rows) == sorted((n, r) for n, c in histogram.items() for r in range(c))
        for places in used.values():
            assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))]
            assert sum(n for _, n in places) <= capacity
        assert len(used) == greedy_best_fit(lengths, capacity)


def test_packing_edges(spark):
    table = documents(spark, nasty_texts())
    packed = packing.packed_documents(table, FILES["word_bpe_49k.json"], capacity=256, with_ids=True)
    rows = packed.collect()
    check_packed(rows, 256)
    assert len({(r.doc_id, r.piece) for r in rows}) <= len(rows)
    assert sum(r.start == 0 for r in rows) == table.count()
    sequences = {r.sequence_id: bytes(r.ids) for r in packing.packed_sequences(packed).collect()}
    for r in rows:
        assert sequences[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.packed_documents(table.limit(0), FILES["word_bpe_49k.json"]).count() == 0


@pytest.mark.parametrize("size,letters", [(3000, 12), (40_000, 300), (20_000, 4000)])
def test_rules_are_the_most_frequent_pairs(size, letters):
    rng = np.random.default_rng(size)
    ids = (rng.pareto(0.7, size) * 3).astype(np.int64) % letters
    starts = np.sort(rng.choice(size, 20, replace=False))
    starts[0] = 0
    ends = set((starts - 1).tolist())
    seen = Counter((int(a), int(b)) for i, (a, b) in enumerate(zip(ids[:-1], ids[1:])) if i not in ends)
    ranked = sorted((-n, pair) for pair, n in seen.items() if n >= token_store.MIN_COUNT)[: token_store.ROUND_RULES]
    taken, want = set(), []
    for _, pair in ranked:  # a pair that shares its slot with a more frequent one waits
        slot = int(token_store.slot_of(np.array([pair[0]], np.uint32), np.array([pair[1]], np.uint32))[0])
        if slot not in taken:
            taken.add(slot)
            want.append(pair)
    rules = token_store.re_pair(ids.astype(np.uint32), starts, letters, rounds=1).rules
    assert [tuple(r) for r in rules.tolist()] == want and want


def test_hot_and_missing_ids_spread(spark, tmp_path):
    """A third of the rows under one doc_id and a third under none still go to several tasks."""
    texts = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} of a hot group") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(24)
    token_store.write_store(docs, f"{tmp_path}/store", FILES["byte_bpe_50k.json"])
    got = token_store.document_digests(spark, f"{tmp_path}/store")
    assert Counter(r.doc_id for r in got.collect()) == Counter(d for d, _ in texts)
    parts = [r.doc_ids for r in spark.read.parquet(f"{tmp_path}/store").collect()]
    assert sum(any(d == 7 for d in p) for p in parts) > 1
