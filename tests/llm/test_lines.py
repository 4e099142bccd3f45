"""Line dedup, the classifier and the pipeline against brute force and held-out labels."""

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from goldmatch.llm import classifier, linededup, neardup, packing, quality, scale
from goldmatch.llm import queries as Q
from goldmatch.session import written

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_lines(docs, percent=80):
    """doc_id -> (lines with a word, numbers of removed lines)."""
    seen, by_token, out = [], defaultdict(set), {}
    for d, text in sorted((d, t) for d, t in docs if d is not None):
        n, gone = 0, []
        for i, line in enumerate((text or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if not s:
                continue
            n += 1
            near = set().union(*(by_token[x] for x in s))
            if any(100 * len(s & seen[j]) >= percent * len(s | seen[j]) for j in near):
                gone.append(i)
            for x in s:
                by_token[x].add(len(seen))
            seen.append(s)
        out[d] = (n, gone)
    return out


def got_lines(df):
    return {r.doc_id: (r.n_lines, list(r.removed)) for r in df.collect()}


def test_line_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got_lines(Q.op7_line_dedup(spark, SMALL)) == brute_lines(docs)


def planted():
    rng, docs = np.random.default_rng(8), []
    bases = [[f"b{x}" for x in rng.integers(0, 60, int(rng.integers(3, 40)))] for _ in range(15)]
    for d in range(150):
        lines = []
        for _ in range(int(rng.integers(0, 6))):
            line = list(bases[int(rng.integers(0, len(bases)))])
            for _ in range(int(rng.integers(0, 5))):
                line[int(rng.integers(0, len(line)))] = f"b{rng.integers(0, 80)}"
            lines.append(" ".join(line) + " " * int(rng.integers(0, 3)))
        docs.append((d * 13 % 151, "\n".join(lines)))
    docs += [(500, None), (501, ""), (502, "\n \n\t"), (503, "a\n\nb\na"), (504, "A\x0ba"), (505, "x " * 50_000), (506, " ".join(f"u{i}" for i in range(3000)))]
    return docs


def test_planted_lines(spark, monkeypatch):
    docs = planted()
    table = spark.createDataFrame([(*d, "clash", 3) for d in docs + docs[:4]] + [(None, "b1 b2", "clash", 3)], "doc_id long, text string, line string, n int")
    want = brute_lines(docs)
    for block in (linededup.BLOCK, 7):  # blocks of any size give the same
        monkeypatch.setattr(linededup, "BLOCK", block)
        found = linededup.repeated_lines(table, counters=1 << 10)
        got = found.collect()
        assert len(got) == len(docs) + 5
        assert {r.doc_id: (r.n_lines, list(r.removed)) for r in got if r.doc_id is not None} == want
        assert [(r.n_lines, r.removed) for r in got if r.doc_id is None] == [(0, [])]
    clean = {r.doc_id: r.text for r in linededup.without_lines(table, found).collect()}
    for d, text in docs:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[d][1])
        assert clean[d] == kept
    assert linededup.repeated_lines(table.limit(0)).count() == 0


# --- classifier --------------------------------------------------------------


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    good = label == 1
    n1, n0 = good.sum(), (~good).sum()
    return (rank[good].sum() - n1 * (n1 + 1) / 2) / n1 / n0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = Q.op4_quality_classifier(spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert auc(score, label) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_edges(spark):
    texts = [None, "", " ", "\n\n", "x", "long " * 80_000, "THE OF!!", "\x00"] + [f"the cat of {i} and a dog" if i % 2 else f"### {i} %%% $$$" for i in range(60)]
    docs = spark.createDataFrame([(i if i else None, t, 1.0, 1) for i, t in enumerate(texts)] + [(9, texts[9], 1.0, 1)], "doc_id long, text string, score double, stats int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8, 68)] + [(9, 1), (10, 1), (11, None), (None, 1), (12, 7), (999, 0)], "doc_id long, label int")
    got = classifier.score(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert min(by[i] for i in range(13, 68, 2)) > max(by[i] for i in range(14, 68, 2))
    assert classifier.score(docs.limit(0), labels, F.lit(True)).count() == 0
    assert {r.score for r in classifier.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_statistics_are_per_text():
    import pyarrow as pa

    from goldmatch.llm.text import buffer_of

    texts = ["a b\n\nc", None, "", "The the é", "x" * 1000, "\n", "q\nq\n"]
    together = classifier.statistics(*buffer_of(pa.array(texts)))
    alone = np.concatenate([classifier.statistics(*buffer_of(pa.array([t], pa.string()))) for t in texts])
    assert np.allclose(together, alone) and not together[1].any()


def test_few_labels_are_calibrated_on_scores_of_other_folds(spark):
    # labels that nothing explains: scores of rows that were fitted would part them
    rng = np.random.default_rng(4)
    stats, label = rng.normal(size=(120, 6)), rng.integers(0, 2, 120)
    rows = spark.createDataFrame([(i, s.tolist(), int(y)) for i, (s, y) in enumerate(zip(stats, label))], "doc_id long, stats array<double>, label int")
    model = classifier.fit(rows)
    assert np.abs(model.scores(stats) - label.mean()).mean() < 0.3
    two = classifier.fit(rows.where("doc_id < 2").withColumn("label", F.col("doc_id").cast("int")))
    assert np.isfinite(two.scores(stats)).all()


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SMALL).write.parquet(f"{tmp_path}/{i}")
        steps.append(spark.read.parquet(f"{tmp_path}/{i}"))
    good, lines, near, mixed, packed = steps[1:]
    assert all(s.columns == docs.columns for s in steps[1:5])
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    want = brute_lines([(r.doc_id, r.text) for r in good.collect()])
    texts = {r.doc_id: r.text for r in good.collect()}
    expected = {d: "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone) for d, (n, gone) in want.items() if len(gone) < n}
    assert {r.doc_id: r.text for r in lines.collect()} == expected
    from test_first import brute_components

    groups = brute_components([(r.doc_id, r.text) for r in lines.collect()], 5)
    assert {r.doc_id for r in near.collect()} == {d for d, (_, c) in groups.items() if c == d}
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in near.collect()}
    assert packed.where("start = 0").count() == mixed.count()
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()


def test_pipeline_keeps_rows_without_an_id_and_one_of_repeated_rows(spark):
    good = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 3")
    unnamed = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id IN (5, 6)").withColumn("doc_id", F.lit(None).cast("long"))
    docs = good.union(good).union(unnamed)
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, SMALL)
    ids = [r.doc_id for r in lines.collect()]
    named = [x for x in ids if x is not None]
    assert len(named) == len(set(named)) and ids.count(None) == 2
    near = corpus_pipeline.keep_first_copies(spark, lines, SMALL)
    assert near.where("doc_id IS NULL").count() == 2
    mixed = corpus_pipeline.mix_sources(spark, near, SMALL)
    assert mixed.columns == docs.columns and mixed.where("doc_id IS NULL").count() > 0


def test_pipeline_keeps_different_texts_under_one_id(spark):
    line = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcdef"]
    texts = [(1, f"{line[0]}\n{line[1]}"), (2, f"{line[0]}\n{line[2]}"), (2, f"{line[3]}\n{line[4]}"), (2, f"{line[3]}\n{line[4]}"), (3, line[5]), (None, line[0])]
    docs = spark.createDataFrame([(*t, "s") for t in texts], "doc_id int, text string, source string")
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, SMALL)
    want = [(1, texts[0][1]), (2, line[2]), (2, texts[2][1]), (3, line[5]), (None, line[0])]
    assert lines.schema == docs.schema
    assert {(r.doc_id, r.text) for r in lines.collect()} == set(want) and lines.count() == len(want)
    copied = docs.where("doc_id < 3").union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(2)))
    near = corpus_pipeline.keep_first_copies(spark, copied.distinct(), SMALL)
    assert {(r.doc_id, r.text) for r in near.collect()} == set(texts[:3]) and near.count() == 3


CLASHING = ["quality", "kept", "base_failed", "judged", "id", "gone", "emptied", "place", "times", "turn", "number", "doc_id_was", "text_hash", "_id", "_gone", "_place", "_times", "_doc_id", "count", "words"]


@pytest.mark.parametrize("several", [False, True])
def test_pipeline_leaves_other_columns_alone(spark, several):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    if several:  # different texts under one doc_id
        docs = docs.union(docs.where("doc_id IN (7, 9, 11)").withColumn("doc_id", F.lit(8).cast("long")))
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string"), F.lit("-"), F.crc32(F.col("source").cast("binary"))).alias(c) for c in CLASHING])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SMALL), "stage")
        assert out.columns == docs.columns and out.count() > 0
        for r in out.collect():
            assert all(r[c].startswith(f"{c}-{r.doc_id}-") for c in CLASHING)
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() == 0


def test_whole_texts_come_in_batches_of_bounded_size(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    before = spark.conf.get(scale.BATCH_LIMIT, None)
    spark.conf.unset(scale.BATCH_LIMIT)
    try:
        got = scale.in_batches(docs, sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 2 * scale.BATCH_BYTES
        # every pass over whole texts asks for it, and a limit of the caller's own stays
        for ask in (lambda: neardup.signatures(docs, 5, 45, 5), lambda: neardup.full_sets(docs, 5), lambda: packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")),
                    lambda: linededup.line_sets(docs, np.ones(1 << 12, np.int32), 80)):
            spark.conf.unset(scale.BATCH_LIMIT)
            ask()
            assert int(spark.conf.get(scale.BATCH_LIMIT)) == scale.BATCH_BYTES
        spark.conf.set(scale.BATCH_LIMIT, "1000000")
        assert max(r.n for r in scale.in_batches(docs, sizes, "n long, bytes long").collect()) < 300
    finally:
        spark.conf.unset(scale.BATCH_LIMIT)
        if before:
            spark.conf.set(scale.BATCH_LIMIT, before)
