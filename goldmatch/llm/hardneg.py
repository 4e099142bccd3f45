"""Hard negatives by exact searches in multiway hyperplane trees.

Scores are integer inner products. All vectors are lifted onto one sphere by a further
coordinate, so that a window of scores is an annulus of distances around the anchor. A
tree node has a few split points; its points go to the nearest one (the cells between are
bounded by hyperplanes), and each split point stores the range of its distances to every
sibling's subtree. A search drops the siblings whose range cannot meet its annulus and
scores the points of the leaves that are left, so results are exact.

The first level of the tree is Spark's: its cells are cut into blocks of bounded size, and
searches go to the blocks of the cells that they cannot drop. A block builds its own tree
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldmatch.session import dimension, written

# SAMPLE vectors choose the first level's split points; the choice moves work, not results
CELLS, SAMPLE, BLOCK_ROWS, LANE_SEARCHES = 32, 1024, 8192, 1 << 16
FANOUT, LEAF, DEPTH, BATCH = 16, 128, 24, 512
# integer vectors from this squared length on take no part: 100 times a score fits 64 bits below it
MAX_NORM = 1 << 56
EXACT = float(1 << 53)
NONE = 1 << 62
SLACK = 1e-6


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of integers."""
    return np.array(vectors.to_list(), np.int64).reshape(len(vectors), len(vectors.iloc[0]))


def lift(v: np.ndarray, top: float) -> np.ndarray:
    """Integer vectors with the coordinate that puts them on the sphere of squared radius ``top``."""
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))])


def distances(points: np.ndarray, splits: np.ndarray, top: float) -> np.ndarray:
    """Between lifted points and lifted split points; shorter ones count as padded with zeros."""
    n = min(points.shape[1], splits.shape[1]) - 1
    products = points[:, :n] @ splits[:, :n].T + np.outer(points[:, -1], splits[:, -1])
    return np.sqrt(np.maximum(2 * top - 2 * products, 0.0))


def spread(points: np.ndarray, top: float, n: int) -> np.ndarray:
    """Indices of up to ``n`` distinct points, each the farthest from those before."""
    chosen, least = [0], distances(points, points[:1], top)[:, 0]
    while len(chosen) < n and least.max() > SLACK * top**0.5:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distances(points, points[chosen[-1:]], top)[:, 0])
    return np.array(chosen)


def grow(points: np.ndarray, rows: np.ndarray, top: float, depth: int = 0):
    """A leaf is an array of rows, a node ``(split points, low, high, children)`` where
    ``low[i, j]`` and ``high[i, j]`` bound the distances of split point i to subtree j."""
    if len(rows) <= LEAF or depth == DEPTH:
        return rows
    inner = points[rows]
    splits = inner[spread(inner, top, FANOUT)]
    if len(splits) == 1:
        return rows
    far = distances(inner, splits, top)
    side = far.argmin(axis=1)
    parts = [side == j for j in range(len(splits)) if (side == j).any()]
    low = np.stack([far[p].min(axis=0) for p in parts], axis=1)
    high = np.stack([far[p].max(axis=0) for p in parts], axis=1)
    return splits, low, high, [grow(points, rows[p], top, depth + 1) for p in parts]


class Searches:
    """A batch of searches: the ``k`` best rows with scores from ``low`` to ``high`` and the
    same label as the anchor or another one, without the anchor itself."""

    def __init__(self, rows: pd.DataFrame, k: int) -> None:
        self.v = matrix(rows["v"])
        self.own, self.label = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.same = rows["same"].to_numpy(bool)
        self.low, self.high = rows["low"].to_numpy(np.int64), rows["high"].to_numpy(np.int64)
        self.request, self.k = rows["request"].to_numpy(np.int64), k
        self.norm = (self.v.astype(np.float64) ** 2).sum(axis=1)
        self.score = np.full((len(rows), k), -NONE, np.int64)
        self.found = np.full((len(rows), k), np.iinfo(np.int64).max)

    def away(self, splits: np.ndarray, at: np.ndarray, top: float) -> np.ndarray:
        """Distances of the anchors, which are not lifted, to split points."""
        v = self.v[at].astype(np.float64)
        n = min(v.shape[1], splits.shape[1] - 1)
        return np.sqrt(np.maximum(self.norm[at][:, None] + top - 2 * (v[:, :n] @ splits[:, :n].T), 0.0))

    def annulus(self, at: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances of rows that can still count: scores fall as distances grow."""
        least = np.maximum(self.low[at], self.score[at, -1]).astype(np.float64)
        square, slack = self.norm[at] + top, SLACK * top**0.5
        inner = np.sqrt(np.maximum(square - 2.0 * self.high[at], 0.0)) - slack
        return inner, np.sqrt(np.maximum(square - 2.0 * least, 0.0)) + slack

    def reaches(self, at: np.ndarray, splits: np.ndarray, low: np.ndarray, high: np.ndarray, top: float) -> np.ndarray:
        """Which subtrees each search cannot drop."""
        away = self.away(splits, at, top)
        inner, outer = self.annulus(at, top)
        open_ = np.ones((len(at), low.shape[1]), bool)
        for i in range(len(splits)):
            d = away[:, i : i + 1]
            open_ &= (np.maximum(low[i] - d, d - high[i]) <= outer[:, None]) & (d + high[i] >= inner[:, None])
        return open_

    def scan(self, at: np.ndarray, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, exact: bool) -> None:
        """Score the rows of a leaf and keep the best; ties go to the smaller vec_id."""
        if exact:  # every partial sum of a product is a whole double
            score = (self.v[at].astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
        else:
            score = self.v[at] @ v.T
        least = np.maximum(self.low[at], self.score[at, -1])
        fits = (score >= least[:, None]) & (score <= self.high[at][:, None])
        fits &= ((labels[None, :] == self.label[at][:, None]) == self.same[at][:, None]) & (ids[None, :] != self.own[at][:, None])
        some = fits.any(axis=1)
        at, score, fits = at[some], score[some], fits[some]
        scores = np.concatenate([self.score[at], np.where(fits, score, -NONE)], axis=1)
        found = np.concatenate([self.found[at], np.where(fits, ids[None, :], np.iinfo(np.int64).max)], axis=1)
        best = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.score[at], self.found[at] = np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)

    def run(self, tree, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, top: float) -> None:
        """Depth first; a node is looked at again with the annulus as it is by then."""
        exact, waiting = top < EXACT, [(tree, np.arange(len(self.v)))]
        while waiting:
            node, at = waiting.pop()
            if isinstance(node, np.ndarray):
                self.scan(at, v[node], ids[node], labels[node], exact)
                continue
            splits, low, high, children = node
            open_ = self.reaches(at, splits, low, high, top)
            waiting += [(child, at[open_[:, j]]) for j, child in enumerate(children) if open_[:, j].any()]

    def answers(self) -> pd.DataFrame:
        i, j = np.nonzero(self.score > -NONE)
        return pd.DataFrame({"request": self.request[i], "vec_id": self.found[i, j], "score": self.score[i, j]})


def clean(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, v, norm``: sound rows as integer vectors, each component ``floor(scale * x)``."""
    sound = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.where(sound).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("norm", square).where(F.col("norm") < float(MAX_NORM))


class Index:
    """Points dealt to cells around split points, and the ranges that searches are routed by."""

    def __init__(self, points: DataFrame) -> None:
        self.top = points.agg(F.max("norm")).first()[0] or 0.0
        top = self.top = max(self.top, 1.0)
        sample = points.orderBy(F.xxhash64("v"), "vec_id").select("v").limit(SAMPLE).toPandas()["v"]
        width = max((len(v) for v in sample), default=0)
        padded = np.zeros((len(sample), width))
        for i, v in enumerate(sample):
            padded[i, : len(v)] = v
        lifted = lift(padded, top)
        splits = self.splits = lifted[spread(lifted, top, CELLS)] if len(lifted) else lifted

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for _, rows in part.groupby(part["v"].map(len)):
                    far = distances(lift(matrix(rows["v"]), top), splits, top)
                    yield rows.assign(cell=far.argmin(axis=1).astype(np.int32))

        def ranges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for (_, cell), rows in part.groupby([part["v"].map(len), "cell"]):
                    far = distances(lift(matrix(rows["v"]), top), splits, top)
                    yield pd.DataFrame({"cell": cell, "split": np.arange(len(splits)), "low": far.min(axis=0), "high": far.max(axis=0), "n": len(rows)})

        fields = "vec_id long, label long, v array<long>"
        self.points = written(points.select("vec_id", "label", "v").mapInPandas(deal, fields + ", cell int"), "hard-points")
        seen = self.points.mapInPandas(ranges, "cell int, split int, low double, high double, n long")
        lines = seen.groupBy("cell", "split").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
        n = max(1, len(splits))
        self.low, self.high, self.blocks = np.full((n, n), np.inf), np.full((n, n), -np.inf), [0] * n
        for r in lines:
            self.low[r["split"], r["cell"]], self.high[r["split"], r["cell"]] = r["low"], r["high"]
            self.blocks[r["cell"]] = -(-r["n"] // BLOCK_ROWS)
        self.n_points = sum(r["n"] for r in lines if r["split"] == 0)
        self.first = [sum(self.blocks[:i]) for i in range(n)]

    def search(self, requests: DataFrame, k: int, nearest_only: bool = False) -> DataFrame:
        """``request, vec_id, score``: up to ``k`` best rows of every block a request reaches.

        ``requests(request, vec_id, label, v, same, low, high)`` are written. With
        ``nearest_only`` a request visits one block, of the cell it is nearest to.
        """
        if not sum(self.blocks):
            return requests.select("request", "vec_id", F.col("high").alias("score")).limit(0)
        top, splits, low, high = self.top, self.splits, self.low, self.high
        fields = "request long, vec_id long, label long, v array<long>, same boolean, low long, high long"

        def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for _, rows in part.groupby(part["v"].map(len)):
                    searches = Searches(rows, 1)
                    everyone = np.arange(len(rows))
                    if nearest_only:
                        at, cell = everyone, searches.away(splits, everyone, top).argmin(axis=1)
                    else:
                        at, cell = np.nonzero(searches.reaches(everyone, splits, low, high, top))
                    yield rows.iloc[at].assign(cell=cell.astype(np.int32))

        def per_cell(values: list[int]):
            return F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell"))

        routed = requests.select("request", "vec_id", "label", "v", "same", "low", "high").mapInPandas(route, fields + ", cell int")
        first, blocks = per_cell(self.first), per_cell(self.blocks)
        if nearest_only:
            visits = routed.where(blocks > 0).withColumn("block", first + F.pmod("request", blocks).cast("int"))
        else:
            visits = routed.where(blocks > 0).withColumn("block", F.explode(F.sequence(first, first + blocks - 1)))
        # a lane has a bounded number of searches; a block's points go to all its lanes
        lanes = max(1, -(-requests.count() // LANE_SEARCHES))
        visits = visits.withColumn("lane", F.pmod("request", F.lit(lanes)).cast("int"))
        points = self.points.withColumn("block", first + F.pmod(F.xxhash64("v", "vec_id"), blocks).cast("int"))
        points = points.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        kept = ["block", "lane", "asks", "request", "vec_id", "label", "v", "same", "low", "high"]
        nothing = {c: F.lit(0).cast("long").alias(c) for c in ("request", "low", "high")} | {"same": F.lit(False).alias("same")}
        both = points.withColumn("asks", F.lit(False)).select(*[nothing.get(c, c) for c in kept]).union(visits.withColumn("asks", F.lit(True)).select(*kept))
        # a task works on one block at a time, so small cells share tasks
        tasks = 2 * lanes * -(-self.n_points // BLOCK_ROWS)
        met = both.withColumn("dim", F.size("v")).repartition(tasks, "block", "lane")

        def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows come by block, lane and length, points before searches."""
            at, held, index = None, [], None
            for part in parts:
                for key, rows in part.groupby(["block", "lane", "dim"], sort=False):
                    if key != at:
                        at, held, index = key, [], None
                    asks = rows["asks"].to_numpy(bool)
                    if not asks.all():
                        held.append(rows[~asks])
                    asking = rows[asks]
                    if not held or not len(asking):
                        continue
                    if index is None:
                        points = pd.concat(held)
                        v = matrix(points["v"])
                        tree = grow(lift(v, top), np.arange(len(v)), top)
                        index = (tree, v, points["vec_id"].to_numpy(np.int64), points["label"].to_numpy(np.int64))
                    for i in range(0, len(asking), BATCH):
                        searches = Searches(asking.iloc[i : i + BATCH], k)
                        searches.run(*index, top)
                        yield searches.answers()

        ordered = met.sortWithinPartitions("block", "lane", "dim", "asks")
        return ordered.mapInPandas(visit, "request long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors(vec_id, label, embedding)`` are indexed whole, ``anchors`` are any stated set of
    such rows. A score is the inner product of the integer vectors ``floor(scale * x)``. An
    anchor's positives are its ``positives`` best other rows of the same label; its negatives
    for a positive are the ``negatives`` best rows of other labels with ``low`` to ``high``
    per cent of the positive's score, so a positive below zero has none. Higher scores come
    first, ties by smaller vec_id. Fewer are returned where fewer exist; a pair without any
    negative has no row. Results are exact.

    Rows with a null vec_id, label or vector, or with any null or non-finite component, take
    no part; nor do those whose integer vector has a squared length of 2^56 or more. Only
    vectors of one length meet. Rows equal in all three columns count once; rows that share
    only the vec_id are separate, but never each other's positive or negative. An empty
    table gives an empty result. Other columns are not used.

    Rows equal in vector and label fold to the few smallest vec_ids that any answer can
    need. A first round visits the block nearest to the anchor: its last positive there
    bounds the annulus of the second round.
    """
    named = ("vec_id", "label", "embedding")
    sound = clean(vectors.select(*named), scale).distinct()
    by_id = Window.partitionBy("v", "label").orderBy("vec_id")
    few = sound.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= max(positives + 1, negatives))
    index = Index(written(few.drop("r"), "hard-vectors"))

    asked = clean(anchors.select(*named), scale).distinct().select(F.monotonically_increasing_id().alias("request"), "vec_id", "label", "v")
    asked = written(asked, "anchors")
    open_ = [F.lit(True).alias("same"), F.lit(-NONE).alias("low"), F.lit(NONE).alias("high")]
    near = _best(index.search(asked.select("*", *open_), positives, nearest_only=True), positives)
    bound = dimension(near.where(F.col("rank") == positives).select("request", F.col("score").alias("bound")), "bounds")
    wide = asked.join(bound, "request", "left").select("request", "vec_id", "label", "v", open_[0], F.coalesce("bound", F.lit(-NONE)).alias("low"), open_[2])
    found = written(_best(index.search(written(wide, "anchor-searches"), positives), positives), "positives")

    paired = found.select(F.col("request").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("high")).where("high >= 0")
    paired = paired.join(asked.withColumnRenamed("request", "anchor"), "anchor")
    window = F.expr(f"({low} * high + 99) div 100")
    requests = written(paired.select(F.monotonically_increasing_id().alias("request"), "vec_id", "label", "v", F.lit(False).alias("same"), window.alias("low"),
                                     F.expr(f"({high} * high) div 100").alias("high"), "positive_id", F.col("high").alias("positive_score")), "window-searches")
    best = _best(index.search(requests, negatives), negatives).select("request", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = requests.select("request", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    return pairs.join(best, "request").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
