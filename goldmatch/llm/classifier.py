"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmatch.llm.quality import STOP_WORDS
from goldmatch.llm.text import LOWER, buffer_of, chunks, shingles, span_hashes, words
from goldmatch.session import written

FEATURES, SCALE, RIDGE, SEED, BINS = 256, 4.0, 1e-3, 20, 1000

# classes of bytes whose shares of a text are statistics
CLASSES: dict[str, bytes] = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>=+~^_@/\\{}[]",
    "loud": b"!?",
    "point": b".,;:",
    "line": b"\n",
    "high": bytes(range(128, 256)),
    "control": bytes([*range(9), *range(14, 32), 127]),
}
NAMES = [
    "log_words", "mean_word", "long_words", "stop_words", "distinct_words", "top_word", "repeated_pairs", "repeated_windows",
    "same_as_before", "log_line", "distinct_lines", *CLASSES,
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers per text, from its whole text alone; an empty text has zeros."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    table = np.zeros(256, np.uint8)
    for i, members in enumerate(CLASSES.values(), 1):
        table[list(members)] = i
    kind = table[data]
    shares = []
    for i in range(1, len(CLASSES) + 1):
        sums = np.concatenate([[0], np.cumsum(kind == i)])
        shares.append((sums[offsets[1:]] - sums[offsets[:-1]]) / size)
    lowered = LOWER[data]
    starts, ends, first = words(lowered, offsets)
    hashed, exact = span_hashes(lowered, starts, ends), span_hashes(data, starts, ends)
    stop_data = "\n".join(STOP_WORDS).encode()
    stop_buffer = np.frombuffer(stop_data, np.uint8)
    stop_starts, stop_ends, _ = words(stop_buffer, np.array([0, len(stop_buffer)]))
    stops = np.unique(span_hashes(stop_buffer, stop_starts, stop_ends))
    # stop words as they are written, so that shouted ones don't count
    is_stop = stops[np.minimum(np.searchsorted(stops, exact), len(stops) - 1)] == exact
    length = ends - starts
    pairs, pairs_at = shingles(hashed, first, 2)
    windows, windows_at = shingles(hashed, first, 3)
    line_mask = data != 10
    edge = np.flatnonzero(line_mask & ~np.concatenate([[False], line_mask[:-1]]))
    line_cut = np.unique(np.concatenate([edge, offsets[:-1][(np.diff(offsets) > 0)]]))
    line_cut = line_cut[line_mask[line_cut]] if len(line_cut) else line_cut
    line_end = np.searchsorted(np.append(np.flatnonzero(~line_mask), len(data)), line_cut)
    line_end = np.append(np.flatnonzero(~line_mask), len(data))[line_end]
    doc_end = offsets[np.searchsorted(offsets, line_cut, "right")]
    line_hash = span_hashes(data, line_cut, np.minimum(line_end, doc_end))
    lines_at = np.searchsorted(line_cut, offsets)
    out = np.zeros((n, len(NAMES)))
    out[:, 11:] = np.stack(shares, axis=1) if n else 0
    for i in range(n):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        w, m = hashed[a:b], b - a
        kinds, counts = np.unique(w, return_counts=True)
        p, t = pairs[pairs_at[i] : pairs_at[i + 1]], windows[windows_at[i] : windows_at[i + 1]]
        lines = line_hash[lines_at[i] : lines_at[i + 1]]
        out[i, :11] = (
            np.log1p(m), length[a:b].mean(), (length[a:b] > 12).mean(), is_stop[a:b].mean(), len(kinds) / np.sqrt(m) / 10,
            counts.max() / m, 1 - len(np.unique(p)) / len(p), 1 - len(np.unique(t)) / len(t), (w[1:] == w[:-1]).sum() / m,
            np.log1p(m / max(len(lines), 1)), len(np.unique(lines)) / max(len(lines), 1),
        )
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array<double>) of the whole texts of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=8 << 20):
            rows = statistics(*buffer_of(batch.column("text")))
            at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()))], ["doc_id", "stats"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as rows."""
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Model:
    """What ``fit`` learns; a few hundred kilobytes, whatever the corpus."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        f = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([f, np.ones((len(f), 1))], axis=1)

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_scores(stats), self.raw, self.level)


def summed(parts: DataFrame, fan_in: int = 64) -> np.ndarray | None:
    """The sum of the arrays in the rows ``sums`` (binary doubles), added up in a tree.

    A task adds its rows one after another, so it holds two arrays at a time; the driver
    gets at most ``fan_in`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums"):
                x = np.frombuffer(x.as_buffer(), np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "sums"]
            )

    tree = parts.mapInArrow(run, "task int, sums binary")
    tree = tree.repartition(fan_in, "task").mapInArrow(run, "task int, sums binary")
    rows = [np.frombuffer(r.sums, np.float64) for r in sorted(tree.collect())]
    return np.sum(rows, axis=0) if rows else None


def pool_adjacent(x: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic fit of shares good / count over ascending x: block means and levels."""
    blocks: list[list[float]] = []
    for at, g, c in zip(x, good, count, strict=True):
        blocks.append([at * c, g, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame, features: int = FEATURES, scale: float = SCALE, ridge: float = RIDGE, seed: int = SEED, calibration: int = 4) -> Model | None:
    """A model of ``labelled(doc_id, stats, label)`` from all its rows; None without both labels.

    One pass sums the statistics' moments. Random directions drawn from a seed make
    ``features`` Fourier features of the standardized statistics, an approximation of a
    Gaussian kernel of width ``scale``. The next pass sums the normal equations over the
    partitions, each row weighted so that both labels weigh the same; the driver solves a
    system of ``features`` + 1 unknowns. The equations are summed in ``calibration`` folds (by
    a hash), so that every row also gets the raw score of a system without its fold, at any
    number of rows: those scores, counted in bins, give the isotonic map to shares of label 1.
    Between block means the map is linear, so that the order of scores stays.
    """
    rows = labelled.select("stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(calibration)).cast("int").alias("fold"))
    rows = written(rows.where("label IN (0, 1)"), "labelled")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, y = matrix(batch.column("stats")), np.asarray(batch.column("label"))
            sums = np.concatenate([[len(s), y.sum()], s.sum(axis=0), (s * s).sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    total = summed(rows.mapInArrow(moments, "sums binary"))
    if total is None or not 0 < total[1] < total[0]:
        return None
    n, ones = total[:2]
    mean, square = np.split(total[2:] / n, 2)
    spread = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    empty = np.zeros(0)
    model = Model(mean, spread, rng.normal(size=(len(mean), features)) / scale, rng.uniform(0, 2 * np.pi, features), empty, empty, empty)
    weight = np.array([n / 2 / (n - ones), n / 2 / ones])
    size = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((calibration, size, size + 2))  # the last column counts rows
        for batch in batches:
            y, fold = np.asarray(batch.column("label")), np.asarray(batch.column("fold"))
            f = model.features(matrix(batch.column("stats")))
            weighted = f * weight[y.astype(int)][:, None]
            for k in np.unique(fold):
                own = fold == k
                total[k, :, :size] += f[own].T @ weighted[own]
                total[k, :, size] += weighted[own].T @ y[own]
                total[k, 0, size + 1] += own.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def solution(system: np.ndarray) -> np.ndarray:
        few = ridge * max(system[0, size + 1], 1) * np.eye(size) / size
        return np.linalg.solve(system[:, :size] + few, system[:, size])

    folds = summed(rows.mapInArrow(equations, "sums binary")).reshape(calibration, size, size + 2)
    whole = folds.sum(axis=0)
    model.weights = solution(whole)
    without = np.stack([solution(whole - f) for f in folds], axis=1)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch.column("fold")).astype(np.int64)
            crossed = np.take_along_axis(model.features(matrix(batch.column("stats"))) @ without, fold[:, None], axis=1)[:, 0]
            raw = np.clip(np.floor(crossed * BINS), -BINS, 2 * BINS)
            yield pa.RecordBatch.from_arrays([pa.array(raw.astype(np.int64)), batch.column("label")], ["bin", "label"])

    counts = rows.mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    bins = sorted(counts.collect())  # at most 3 * BINS + 1
    if not bins:
        return None
    at, good, number = (np.array(c, float) for c in zip(*bins, strict=True))
    model.raw, model.level = pool_adjacent((at + 0.5) / BINS, good, number)
    # a little slope outside and on level stretches keeps scores apart
    model.raw = np.concatenate([[-2.0], model.raw, [3.0]])
    model.level = np.clip(np.concatenate([[model.level[0] * 0.9], model.level, [1 - (1 - model.level[-1]) * 0.9]]), 0, 1)
    return model


def score(docs: DataFrame, labels: DataFrame, learn: Column, **how: float) -> DataFrame:
    """doc_id, score (0 to 1) of every row of ``docs(doc_id, text)``.

    The model learns from the rows of ``labels(doc_id, label)`` that meet ``learn``, a
    condition on doc_id; labels other than 0 and 1, null or conflicting ones are left out,
    repeated ones count once, and of several texts under one doc_id one fixed by its
    statistics is learnt from. Only statistics of the text are inputs. Null and empty texts
    are scored like any other. Without both labels to learn from, every score is 0.5.
    Repeated rows get equal scores; a null doc_id is scored and never learnt from. An empty
    table gives an empty result. Columns beside the named ones are left out.
    """
    stats = written(document_statistics(docs), "statistics")
    known = labels.where(learn & F.col("label").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    # of several texts under one doc_id the one with the smallest statistics is learnt from
    one = stats.join(known, "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.min("label").alias("label"))
    model = fit(one, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(matrix(batch.column("stats"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")
