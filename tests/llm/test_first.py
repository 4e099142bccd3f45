"""Chat formatting, quality rules, mixing, nearest neighbours, near duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from goldmatch.llm import chatformat, graph_index, mixing, neardup, quality, sql
from goldmatch.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def rows(spark, name, sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def documents(spark, data, schema="doc_id long, text string, source string, component_id long, kept boolean, size int"):
    wide = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (wide - len(r)) for r in data], schema)


# --- chat formatting ---------------------------------------------------------


def expected_chat(turns):
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    out = {}
    for c, all_ in by.items():
        all_.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in all_)
        loss = "".join(x for _, r, x in all_ if r == "assistant")
        out[c] = (len(all_), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in rows(spark, "conversations")]
    turns += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in Q.op1_chat_formatting(spark, SMALL).collect()}
    assert got == expected_chat(turns)


NASTY = [
    "", None, "[INST]", "[\\INST] [\\\\INST] </s>", "<\\/s>", "\\", "<s>[/INST] x </s>\n", "[ROLE=41] y", "[SYS] ", "a" * 300_000,
    "emoji 😀 [/SYS]", "[\\ROLE=", "</s", "[INST", "$1 \\2 ${x}", "\x00\r\n ", " </s></s> ",
]


def test_chat_nasty_texts(spark):
    roles = ["user", "assistant", "system", "tool] </s>", "", None]
    data = [(i % 7 if i % 7 else None, i if i % 5 else 3, roles[i % 6], x, 1) for i, x in enumerate(NASTY * 3)]
    data += data[:6]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted int")
    back = chatformat.read_back(chatformat.format_conversations(turns)).collect()
    want = expected_chat([d[:4] for d in data])
    assert len(back) == len(want)
    for r in back:
        n, turns_sha, chars, loss_sha = want[r.conv_id]
        said = "".join(f"{t.role}\n{t.text}\n" for t in r.turns)
        assert (len(r.turns), hashlib.sha256(said.encode()).hexdigest()) == (n, turns_sha)
        assert (len(r.loss_text), hashlib.sha256(r.loss_text.encode()).hexdigest()) == (chars, loss_sha)
    assert chatformat.format_conversations(turns.limit(0)).count() == 0


# --- quality rules -----------------------------------------------------------


def base_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c"), (4, "a b c a b c"), (None, "x y"), (6, "a a a a a"), (7, "\n\na\na\n b\x0bc | #")]


def test_quality_query(spark):
    got = {r.doc_id: r for r in Q.op6_quality_rules(spark, SMALL).collect()}
    for d in rows(spark, "documents"):
        r, want = got[d.doc_id], base_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_edges(spark):
    data = EDGES + [(9, "word " * 60_000)]
    got = quality.quality_rules(documents(spark, data)).collect()
    assert sorted((r.doc_id or 0, *r.quality[:3], r.quality.n_dup_lines, r.quality.n_repeat_words) for r in got) == sorted(
        (i or 0, *base_counts(t)) for i, t in data
    )
    assert all(r.base_failed and not r.kept for r in got)
    assert quality.quality_rules(documents(spark, [])).count() == 0


def test_quality_sql_agrees_on_edges(spark):
    """The SQL states the verdict a second time, thresholds included."""
    stop = "the of and to in a is that for it " * 8
    data = EDGES + [(10 + i, t) for i, t in enumerate([
        " ".join(f"w{i}" for i in range(60)),  # no stop words
        " ".join(f"w{i} the" for i in range(60)),
        " ".join(f"w{i} of # |" for i in range(40)),  # symbols
        "\n".join(["the same line"] * 30 + [f"a{i} b{i} c{i} d{i} e{i} f{i} g{i}" for i in range(29)]),
        " ".join(f"{'long' * 5}{i} the" for i in range(60)),
        stop,
    ])]
    table = documents(spark, data)
    judged = quality.quality_rules(table)
    got = judged.select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "base_failed", "kept")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [d[:2] for d in data])
    want = con.execute(sql.oracle_sql()["op6_quality_rules"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {r.kept for r in got.where("NOT base_failed").collect()} == {True, False}


def test_quality_keeps_clean_documents(spark):
    judged = Q.op6_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    by = {r.quality: r for r in judged.where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert by[1].k == 1.0 and by[0].k < 0.2


# --- mixing ------------------------------------------------------------------


def water_filled(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check_mix(got, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[2]] += len(WORD.findall(d[1] or ""))
    want, taken = water_filled(sizes), defaultdict(int)
    assert len(got) == len(docs)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mix(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed, found = mixing.mix(docs)
    check_mix(mixing.taken_words(mixed, found).collect(), [(d.doc_id, d.text, d.source) for d in docs.collect()])
    a, b = (sorted(Q.op8_source_mix(spark, SMALL).collect()) for _ in range(2))
    assert a == b
    # every run of the schedule has the sources near their shares
    order = [r.source_no for r in mixed.select("slot", "source_no").distinct().orderBy("slot").collect()]
    share, half = Counter(order), Counter(order[: len(order) // 2])
    assert all(abs(half[s] - share[s] / 2) <= 5 for s in share)
    # slots hold equal blocks
    lengths = Counter(r.n for r in mixed.groupBy("slot").agg(F.sum("length").alias("n")).collect())
    assert lengths[mixing.BLOCK_WORDS] >= sum(lengths.values()) - len(share)


def test_mix_edges(spark):
    data = [(i, "w " * (i % 9) if i % 4 else None, ["a", "b", None, "", "é"][i % 5 if i < 80 else 0]) for i in range(200)]
    data += [(7, "same words here", "b")] * 5 + [(None, "x y z", "b"), (500, "long " * 50_000, "b")]
    for part in (data, [(1, None, "a"), (2, " ", None)], []):
        got = mixing.taken_words(*mixing.mix(documents(spark, part))).collect()
        check_mix(got, part)


# --- nearest neighbours ------------------------------------------------------


def recall(got, ids, vectors, queries, k=5):
    u = graph_index.unit(vectors)
    at, hits, total = {v: i for i, v in enumerate(ids)}, 0, 0
    for q in queries:
        s = u @ u[at[q]]
        best = sorted((-x, v) for x, v in zip(s, ids) if v != q)[:k]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        for r in mine:
            assert r.score == pytest.approx(float(s[at[r.vec_id]]), abs=1e-12)
        hits, total = hits + len({r.vec_id for r in mine} & {v for _, v in best}), total + len(best)
    return hits / total


def test_neighbours_query(spark):
    data = rows(spark, "embeddings", "/root/testdata/sf0.01")
    ids, vectors = [r.vec_id for r in data], np.array([r.embedding for r in data])
    assert recall(Q.op9_nearest_neighbours(spark, "/root/testdata/sf0.01").collect(), ids, vectors, [i for i in ids if i % 50 == 0]) >= 0.9


def test_neighbours_edges(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=6)], None) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0], 1) for i in range(40)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 6, 1), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (904, [float("nan")] * 6, 1), (905, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1)]
    table = spark.createDataFrame(good + bad + good[:3], "vec_id long, embedding array<double>, score int")
    got = graph_index.search(table, table.where("vec_id % 10 = 0 OR vec_id > 800"), shard_rows=16).collect()
    ids, vectors = [g[0] for g in good], np.array([g[1] for g in good])
    assert {r.query_id for r in got} == {i for i in ids if i % 10 == 0}
    assert recall(got, ids, vectors, [i for i in ids if i % 10 == 0]) >= 0.9
    hot = sorted((r.rank, r.vec_id) for r in got if r.query_id == 110)
    assert [v for _, v in hot] == [100, 101, 102, 103, 104]
    few = table.where("vec_id < 3")
    assert len(graph_index.search(few, few).collect()) == 6
    assert graph_index.search(table.limit(0), table).count() == 0 and graph_index.search(table, table.limit(0)).count() == 0


def grouped(rng, groups, size, noise, d=64):
    centres = graph_index.unit(rng.normal(size=(groups, d)))
    return np.repeat(centres, size, axis=0) + noise * rng.normal(size=(groups * size, d))


@pytest.mark.parametrize("shape", [(400, 10, 0.05, 0), (40, 100, 0.1, 0), (8, 500, 0.05, 0), (1, 1000, 0.0001, 3000), (1, 3000, 0.01, 1096)])
def test_neighbours_among_dense_groups(shape):
    """One shard at production parameters; the random vectors beside a group are measured apart."""
    groups, size, noise, alone = shape
    rng = np.random.default_rng(1)
    points = graph_index.unit(np.concatenate([grouped(rng, groups, size, noise), rng.normal(size=(alone, 64))]))
    narrow = points.astype(np.float32)
    graph, entries = graph_index.build_graph(narrow)
    asked = [rng.choice(groups * size, 200, replace=False)] + ([groups * size + rng.choice(alone, 200, replace=False)] if alone else [])
    for q in asked:
        found, _ = graph_index.beam_search(narrow, graph, entries, narrow[q], graph_index.BEAM)
        exact = points[q] @ points.T
        exact[np.arange(len(q)), q] = -2
        near = np.where((found >= 0) & (found != q[:, None]), np.take_along_axis(exact, np.maximum(found, 0), 1), -2)
        mine = np.take_along_axis(found, np.argsort(-near, axis=1)[:, :5], 1)
        best = np.argsort(-exact, axis=1)[:, :5]
        assert (mine[:, :, None] == best[:, None, :]).any(axis=2).mean() >= 0.9


def test_neighbours_of_several_lengths_and_huge_components(spark):
    data = [(i, [float(i), 1.0]) for i in range(4)] + [(10 + i, [1.0, float(i), 2.0]) for i in range(3)] + [(20, [1e308, 1e308]), (21, [-1e308, 1e308])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = graph_index.search(table, table).collect()
    for length in (2, 3):
        ids = [i for i, v in data if len(v) == length]
        assert recall([r for r in got if r.query_id in ids], ids, np.array([v for _, v in data if len(v) == length]), ids) == 1.0


# --- near duplicates ---------------------------------------------------------


def shingles_of(text, k):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute_components(docs, k, percent=80):
    sets = {d: shingles_of(t, k) for d, t in docs if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_chat_and_near_duplicates_sql_agree_on_edges(spark, tmp_path):
    """What the given tables don't hold: controls in all spellings, other roles, ties, short and cased texts."""
    turns = [(1, 1, "user", "</s> <\\s> [INST]"), (1, 1, "assistant", "<\\/s> é"), (1, None, "tool é", None), (2, 0, None, "[ROLE=41] <"), (2, 1, "system", "")]
    turns += [(3, i, "assistant", "[\\\\INST] <") for i in range(3)] + [(None, 0, "assistant", "x")]
    texts = ["A b c d e", "a B c d e", "a b c d e f", None, "", " \t", "One", "one", "w " * 50] + [" ".join(f"v{j}" for j in range(i, i + 60)) for i in (0, 2, 4, 9)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name, query in [("conversations", Q.op1_chat_formatting), ("documents", Q.op10_near_duplicates)]:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        got = query(spark, str(tmp_path))
        want = con.execute(sql.oracle_sql()[query.__name__])
        assert [c[0] for c in want.description] == got.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_near_duplicates_query(spark):
    want = brute_components([(d.doc_id, d.text) for d in rows(spark, "documents")], 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op10_near_duplicates(spark, SMALL).collect()}
    assert got == want


@pytest.mark.parametrize(("block", "hashes"), [(neardup.BLOCK, neardup.BLOCK_HASHES), (3, neardup.BLOCK_HASHES), (neardup.BLOCK, 500)])
def test_near_duplicates_planted(spark, monkeypatch, block, hashes):
    monkeypatch.setattr(neardup.block_links, "__defaults__", (block, hashes))
    rng = np.random.default_rng(5)
    data, i = [], 0
    for base in range(12):
        text = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(4, 200)))]
        for _ in range(int(rng.integers(1, 25))):
            copy = list(text)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(0, len(copy)))] = f"e{rng.integers(0, 50)}"
            data.append(((i := i + 7) % 1009, " ".join(copy)))
            if rng.random() < 0.5:
                text = copy  # chains: each copy of the one before
    data += [(2000, None), (2001, ""), (2002, " \t"), (2003, "One"), (2004, "one"), (2005, "a b"), (2006, "a b c d e f g h"), (2007, "x " * 100_000)]
    data = list({d: (d, t) for d, t in data}.values())
    table = documents(spark, data + data[:4] + [(None, "one")])
    want = brute_components(data, 4)
    got = neardup.near_duplicates(table, k=4).collect()
    assert len(got) == len(data) + 5
    for r in got:
        if r.doc_id is None:
            assert r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_several_texts_under_one_id_keep_all_their_links(spark):
    """Whatever the rows' order: A (1) - A' (2), B (2) - B' (3) make one component."""
    rng = np.random.default_rng(11)
    long = lambda seed: [f"w{seed}x{i}" for i in range(60)]
    a, b, c = long(1), long(2), long(3)
    near = lambda words: " ".join([*words[:-1], "other"])
    data = [(1, " ".join(a)), (2, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (2, ""), (5, near(c)), (5, " ".join(long(5))), (6, " ".join(long(5))), (None, " ".join(a))]
    for _ in range(4):
        table = spark.createDataFrame([data[i] for i in rng.permutation(len(data))], "doc_id long, text string").coalesce(2)
        got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(table, k=4).collect()}
        assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (6, 4, False), (None, None, True), (2, 2, True)}  # the text without words
