"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldmatch.session import written

SHARD_ROWS, DEGREE, LONG, BEAM, BUILD_BEAM, ALPHA, ENTRIES = 16384, 32, 8, 96, 40, 1.2, 16
BLOCK = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that nothing overflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def beam_search(points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy best-first search of a block of queries at once, from all ``entries``.

    ``graph`` has a row of neighbours per point, -1 where there is none. In each step
    every query expands its best point that isn't expanded yet. Returns the beam's
    points (-1: none) and cosines, best first.
    """
    n_q, beam = len(queries), max(beam, len(entries))
    ids = np.full((n_q, beam), -1, np.int32)
    near = np.full((n_q, beam), -np.inf, points.dtype)
    done = np.zeros((n_q, beam), bool)
    score = queries @ points[entries].T
    order = np.argsort(-score, axis=1, kind="stable")
    ids[:, : len(entries)], near[:, : len(entries)] = entries[order], np.take_along_axis(score, order, axis=1)
    rows = np.arange(n_q)
    while len(rows):
        ready = (ids[rows] >= 0) & ~done[rows]
        rows, ready = rows[ready.any(axis=1)], ready[ready.any(axis=1)]
        if not len(rows):
            break
        best = ready.argmax(axis=1)  # the beam is sorted, so the first one is the best
        done[rows, best] = True
        step = graph[ids[rows, best]]
        known = (step[:, :, None] == ids[rows][:, None, :]).any(axis=2)
        step = np.where(known, -1, step)
        score = (points[step] @ queries[rows][:, :, None])[:, :, 0]
        score[step < 0] = -np.inf
        all_ids = np.concatenate([ids[rows], step], axis=1)
        all_near = np.concatenate([near[rows], score], axis=1)
        all_done = np.concatenate([done[rows], np.zeros(step.shape, bool)], axis=1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, top, axis=1)
        near[rows] = np.take_along_axis(all_near, top, axis=1)
        done[rows] = np.take_along_axis(all_done, top, axis=1)
    return ids, near


def robust_prune(points: np.ndarray, at: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Neighbours for a block of points: of each row of candidates (-1: none) the nearest
    stays and removes those that lie ``alpha`` times nearer to it than to the point; then
    the next one, up to ``degree``. Rows end in -1 where fewer are left."""
    candidates = np.sort(np.where(candidates == at[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    block = points[candidates]
    own = 2 - 2 * np.einsum("bcd,bd->bc", block, points[at])
    own[candidates < 0] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
    block = np.take_along_axis(block, order[:, :, None], 1)
    between = 2 - 2 * (block @ block.transpose(0, 2, 1))
    alive, rows = candidates >= 0, np.arange(len(at))
    out = np.full((len(at), degree), -1, np.int32)
    for i in range(degree):
        has = alive.any(axis=1)
        if not has.any():
            break
        best = alive.argmax(axis=1)
        out[has, i] = candidates[rows, best][has]
        alive &= alpha * alpha * between[rows, best] > own  # squared distances
        alive[rows, best] = False
    return out


def spread_points(points: np.ndarray, count: int) -> np.ndarray:
    """The medoid, then one point after the other that is farthest from all chosen ones."""
    chosen = [int(np.argmax(points @ points.mean(axis=0)))]
    nearest = points @ points[chosen[0]]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    return np.unique(chosen).astype(np.int32)


def build_graph(
    points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, long: int = LONG, entries: int = ENTRIES, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """A robust-pruned graph over unit vectors, and the points where searches enter it.

    It starts as a random graph: ``long`` edges a point that no pruning removes, so that
    every point can be reached and a dense group is not closed in itself. Two passes, with
    factor 1 and then ``alpha``, search each point on the graph as it stands and prune what
    they met to ``degree - long`` edges. Edges are made both ways; a row has room for
    half as many again and is pruned when that is full, and once more at the end."""
    n, rng, long = len(points), np.random.default_rng(seed), min(long, degree // 4)
    kept = degree - long
    room = kept + kept // 2
    graph = np.full((n, room + long), -1, np.int32)
    graph[:, room:] = rng.integers(0, n, (n, long))
    filled = np.zeros(n, np.int64)
    begin = spread_points(points, entries)

    def put(rows: np.ndarray, near: np.ndarray, factor: float) -> None:
        graph[rows, :room] = -1
        graph[rows, :kept] = robust_prune(points, rows, near, factor, kept)
        filled[rows] = (graph[rows, :room] >= 0).sum(axis=1)

    def insert(block: np.ndarray, factor: float) -> None:
        found, _ = beam_search(points, graph, begin, points[block], beam)
        put(block, np.concatenate([found, graph[block, :room]], axis=1), factor)
        to, source = graph[block, :kept].ravel(), np.repeat(block, kept)
        to, source = to[to >= 0], source[to >= 0]
        new = ~(graph[to, :room] == source[:, None]).any(axis=1)
        to, source = to[new], source[new]
        by = np.argsort(to, kind="stable")
        to, source = to[by], source[by]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = filled[to] + np.arange(len(to)) - np.repeat(first, counts)
        roomy = filled[targets] + counts <= room
        fits = np.repeat(roomy, counts)
        graph[to[fits], place[fits]] = source[fits]
        filled[targets[roomy]] += counts[roomy]
        over, first, counts = targets[~roomy], first[~roomy], counts[~roomy]
        for i in range(0, len(over), BLOCK):
            rows, part = over[i : i + BLOCK], counts[i : i + BLOCK]
            column = np.arange(part.max())
            extra = np.where(column < part[:, None], source[np.minimum(first[i : i + BLOCK, None] + column, len(source) - 1)], -1)
            put(rows, np.concatenate([graph[rows, :room], extra], axis=1), factor)

    for factor in (1.0, alpha):
        order, at, size = rng.permutation(n), 0, 1
        while at < n:
            insert(order[at : at + size], factor)
            at, size = at + size, min(2 * size, BLOCK)
    for i in range(0, n, BLOCK):
        rows = np.arange(i, min(i + BLOCK, n))
        put(rows, graph[rows, :room], alpha)
    graph = np.sort(np.concatenate([graph[:, :kept], graph[:, room:]], axis=1), axis=1)
    graph[:, 1:][graph[:, 1:] == graph[:, :-1]] = -1
    return graph, begin


def answers(asking: pd.DataFrame, points: np.ndarray, ids: list, narrow: np.ndarray, graph: np.ndarray, entries: np.ndarray, k: int, beam: int) -> pd.DataFrame:
    """The k best of one shard for a block of queries, without the query itself.

    The search goes over ``narrow``, the points in single precision; what it finds is
    scored in double precision."""
    queries = unit(np.stack(asking["v"].to_numpy()))
    found, _ = beam_search(narrow, graph, entries, queries.astype(np.float32), beam)
    near = (points[found] @ queries[:, :, None])[:, :, 0]
    rows = []
    for query, f, s in zip(asking["query_id"], found, near, strict=True):
        best = [(-x, v) for p, x in zip(f, s, strict=True) if p >= 0 for v in ids[p] if v != query]
        rows += [(query, v, -x) for x, v in sorted(best)[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """The ``k`` nearest other vectors of each query: query_id, rank, vec_id, score.

    ``vectors(vec_id, embedding)`` are indexed whole; ``queries(vec_id, embedding)`` are
    any stated set. Nearness is the cosine in double precision; ties go to the smaller
    vec_id. Recall against brute force is approximate (tests ask for 0.9).

    Equal vectors fold into one point that keeps its k + 1 smallest vec_ids, which is all
    that k neighbours besides the query itself can need. Distinct points are dealt by
    hash to shards of about ``shard_rows``; each shard builds its graph in one task of
    bounded memory, and all queries visit every shard in blocks, which is work queries x
    shards: larger shards cost fewer visits and more memory (64 dimensions: about 1.3 KB a
    point). Shard results are cut to k per query before they meet.

    Vectors that are null, empty, zero, or hold null or non-finite components take no
    part, neither as points nor as queries; neither do rows with a null vec_id. Only
    vectors as long as the query are its candidates. Repeated rows count once. An empty
    table gives an empty result; with fewer than k candidates all are returned.
    """
    sound = (
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    vec_id, vector = F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    clean = [df.where(sound).select(vec_id, vector) for df in (vectors, queries)]
    # -0.0 and 0.0 are one value; the key is the vector itself
    points = clean[0].withColumn("v", F.transform("v", lambda x: x + 0.0)).distinct()
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = points.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = written(distinct.withColumn("dim", F.size("v")), "points")
    shards = max(1, -(-distinct.count() // shard_rows))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    asked = clean[1].distinct().select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"))
    visits = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by shard, a shard's points before its queries."""
        at, held, index = None, [], None
        for part in parts:
            for key, rows in part.groupby(["shard", "dim"], sort=False):
                if key != at:
                    at, held, index = key, [], None
                held.append(rows[~rows["asks"]])
                asking = rows[rows["asks"]]
                if len(asking) and index is None:
                    points = pd.concat(held)
                    if not len(points):
                        continue
                    block = unit(np.stack(points["v"].to_numpy()))
                    narrow = block.astype(np.float32)
                    index = (block, points["ids"].to_list(), narrow, *build_graph(narrow, degree, alpha=alpha))
                for i in range(0, len(asking), BLOCK):
                    yield answers(asking.iloc[i : i + BLOCK], *index, k, beam)

    points = dealt.select("shard", "dim", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("query_id"), "v", "ids")
    asking = visits.select("shard", "dim", F.lit(True).alias("asks"), "query_id", "v", F.lit(None).cast("array<long>").alias("ids"))
    by_shard = points.union(asking).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "dim", "asks")
    found = by_shard.mapInPandas(visit, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = written(found, "found").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
