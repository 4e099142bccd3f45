"""MinHash near-dedup of documents: one-permutation hashing, bands, star-shaped candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmatch.llm.scale import components, in_batches
from goldmatch.llm.text import buffer_of, chunks, mix, shingle_sets
from goldmatch.session import written

BANDS, ROWS, BLOCK, BLOCK_HASHES = 45, 5, 2048, 1 << 20
_U = np.uint64


def donor_order(bins: int) -> np.ndarray:
    """For every bin all bins in a pseudo-random order that depends on nothing else."""
    cells = np.arange(bins * bins, dtype=_U).reshape(bins, bins)
    return np.argsort(mix(cells * _U(0x9E3779B97F4A7C15) + _U(77)), axis=1)


def densified(sets: list[np.ndarray], bins: int, order: np.ndarray) -> np.ndarray:
    """One-permutation minima of non-empty sets, a row per set.

    The top bits of a hash choose its bin, so the ascending hashes of a set come bin by
    bin and the first of each is the bin's minimum. An empty bin takes the value of the
    first filled bin in its own random order (optimal densification), the same one for
    every set in which that bin is filled.
    """
    sig, filled = np.zeros((len(sets), bins), _U), np.zeros((len(sets), bins), bool)
    for i, h in enumerate(sets):
        where, first = np.unique(((h >> _U(32)) * _U(bins)) >> _U(32), return_index=True)
        sig[i, where], filled[i, where] = h[first], True
    doc, empty = np.nonzero(~filled)
    step = 0
    while len(doc):
        donor = order[empty, step]
        found = filled[doc, donor]
        sig[doc[found], empty[found]] = sig[doc[found], donor[found]]
        doc, empty = doc[~found], empty[~found]
        step += 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for every band of every set; the band's number is part of it."""
    keys = np.broadcast_to(np.arange(bands, dtype=_U) * _U(0x2545F4914F6CDD1D) + _U(1), (len(sig), bands)).copy()
    for r in range(rows):
        keys = mix(keys * _U(0x9FB21C651E98DF25) + sig[:, r::rows][:, :bands])
    return keys


def set_key(hashes: np.ndarray) -> bytes | None:
    """What stands for a whole set; nothing for an empty one."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set), bands (keys; none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = donor_order(bands * rows)
        for batch in chunks(batches, size=4 << 20):
            data, offsets = buffer_of(batch.column("text"))
            sets = shingle_sets(data, offsets, k)
            full = [s for s in sets if len(s)]
            keys = band_keys(densified(full, bands * rows, order), bands, rows).astype(np.int64)
            each = np.array([bands if len(s) else 0 for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(keys.ravel())),
                ],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(wanted, run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """set_key, hashes: the ascending distinct shingle hashes as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=4 << 20):
            sets = shingle_sets(*buffer_of(batch.column("text")), k)
            keys = pa.array([set_key(s) for s in sets], pa.binary())
            hashes = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, hashes], ["set_key", "hashes"])

    return in_batches(docs.select("text"), run, "set_key binary, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have at least ``percent`` hundredths in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    return in_batches(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), run, "u long, v long")


def similar_enough(percent: int):
    """Sizes that allow the similarity at all."""
    return F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent


def open_buckets(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets with more than one component: key, rep, n, c, center."""
    labelled = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.withColumn("c", F.coalesce("component", "rep")).drop("component")
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return labelled.join(mixed, "key").select("key", "rep", "n", "c", "center")


def linked_in_blocks(left: pa.Table, right: pa.Table, percent: int, columns: int = 1024) -> tuple[list[int], list[int]]:
    """Confirmed links between two blocks of sets, one for each row of ``left`` and component.

    Shared hashes are the columns of 0/1 matrices whose product counts the overlaps.
    """
    sides = []
    for side in (left, right):
        sets = [np.frombuffer(h.as_buffer(), "<u8") for h in side.column("hashes")]
        sides.append((np.concatenate(sets), np.array([len(x) for x in sets])))
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    overlap = np.zeros((left.num_rows, right.num_rows), np.float32)
    placed = []
    for hashes, sizes in sides:
        at = np.minimum(np.searchsorted(shared, hashes), max(len(shared) - 1, 0))
        hit = shared[at] == hashes if len(shared) else np.zeros(len(hashes), bool)
        at, row = at[hit], np.repeat(np.arange(len(sizes)), sizes)[hit]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], row[order]))
    for first in range(0, len(shared), columns):
        parts = []
        for (at, row), (_, sizes) in zip(placed, sides, strict=True):
            a, b = np.searchsorted(at, [first, first + columns])
            part = np.zeros((len(sizes), min(columns, len(shared) - first)), np.float32)
            part[row[a:b], at[a:b] - first] = 1
            parts.append(part)
        overlap += parts[0] @ parts[1].T
    union = sides[0][1][:, None] + sides[1][1][None, :] - overlap
    c_left, c_right = (np.asarray(side.column("c")) for side in (left, right))
    near = (100 * overlap >= percent * union) & (c_left[:, None] != c_right[None, :])
    x, y = np.nonzero(near)
    if len(x):
        _, keep = np.unique(np.stack([x, c_right[y]]), axis=1, return_index=True)
        x, y = x[keep], y[keep]
    u, v = left.column("rep").to_pylist(), right.column("rep").to_pylist()
    return [u[i] for i in x], [v[i] for i in y]


def block_links(open_: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, hashes: int = BLOCK_HASHES) -> DataFrame:
    """Links between the components of the clusters that open buckets form.

    A cluster's members, and those outside its largest component, are dealt by hash to
    blocks of about ``block`` sets and about ``hashes`` hashes, whichever makes more; a task
    holds one block of each kind at a time.
    """
    clusters = components(open_.select(F.col("center").alias("u"), F.col("rep").alias("v")))
    members = open_.select("rep", "n", "c").distinct().join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    sizes = members.groupBy("cluster", "c").agg(F.count("*").alias("sets"), F.sum("n").alias("hashes"))
    counted = sizes.groupBy("cluster").agg(
        F.sum("sets").alias("sets"), F.sum("hashes").alias("hashes"), F.max(F.struct("sets", "hashes", "c")).alias("main")
    )
    blocks = lambda n, h: F.greatest(F.ceil(n / block), F.ceil(h / hashes), F.lit(1)).cast("int")
    plan = counted.select(
        "cluster", F.col("main.c").alias("main"), blocks(F.col("sets"), F.col("hashes")).alias("all_blocks"),
        blocks(F.col("sets") - F.col("main.sets"), F.col("hashes") - F.col("main.hashes")).alias("few_blocks"),
    )
    dealt = written(members.join(plan, "cluster"), "members")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = dealt.where("c <> main").select("cluster", own("few_blocks").alias("i"), each("all_blocks").alias("j"), F.lit(0).alias("side"), "rep", "c")
    all_ = dealt.select("cluster", each("few_blocks").alias("i"), own("all_blocks").alias("j"), F.lit(1).alias("side"), "rep", "c")
    rows = few.union(all_).join(sets.select(F.col("node").alias("rep"), "hashes"), "rep")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            side = np.asarray(table.column("side"))
            left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
            u, v = linked_in_blocks(left, right, percent) if len(left) and len(right) else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        at = None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("cluster", "i", "j")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if at is not None and at != tuple(keys[a]):
                        yield links()
                        held = []
                    at = tuple(keys[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield links()

    return in_batches(rows.select("cluster", "i", "j", "side", "rep", "c", "hashes"), run, "u long, v long")


def texts_of_one_id(full: DataFrame, member: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of doc_ids that have several texts."""
    of = full.select("doc_id", "set_key").distinct().join(member, "set_key").select("doc_id", "rep")
    several = of.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u <> last").select("doc_id", "u")
    return of.join(several, "doc_id").where("rep <> u").select("u", F.col("rep").alias("v"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Words are runs outside white space (0x20, 0x09-0x0D), A-Z lower-cased. A document's
    set holds its distinct k-word windows, or its whole word sequence if it is shorter.
    Documents are linked when 100 * |A and B| >= percent * |A or B|.

    1. A pass over the whole texts makes a one-permutation signature of bands * rows
       bins, densified, cut into bands. At a similarity of 0.8 a pair shares none of 45
       bands of 5 rows once in 10^7.7 pairs.
    2. Equal sets fold into the smallest doc_id before anything is paired.
    3. A bucket yields a star: its smallest member against the rest. Pairs are confirmed
       on full sets, the links make components.
    4. Buckets that still hold several components are joined to clusters. In each of those
       the members outside its largest component are compared with all members of other
       components, block by block inside the tasks; only links come out. So no pair that
       shares a bucket goes unexamined unless it is connected already, and a group of n
       near copies costs about n pairs plus what its stars have not connected.

    Null or empty texts and texts without words have n_shingles 0, are linked with
    nothing and are kept. Rows with the same doc_id and text give equal rows; rows with
    one doc_id and different texts are linked as one document, with the links of all of
    its texts (texts without words have none). A null doc_id stays
    alone under a null component and is kept. Columns beside doc_id and text are left out.
    """
    sig = written(signatures(docs, k, bands, rows), "signatures")
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # a class has a number of its own, fixed once it is stored
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "*"), "classes")
    member = classes.select("set_key", "rep", "first_id")
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    stars = buckets.groupBy("key").agg(F.min("rep").alias("center"), F.min_by("n", "rep").alias("n_u"), F.count("*").alias("size"))
    shared = written(
        buckets.join(stars.where("size > 1"), "key").select("key", "rep", "n", "center", "n_u"), "buckets"
    )
    nodes = member.join(shared.select("rep").distinct(), "rep", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text").join(nodes.select("first_id").distinct(), "first_id", "left_semi")
    once = full_sets(texts.dropDuplicates(["first_id", "text"]), k).dropDuplicates(["set_key"])
    sets = written(once.join(nodes.select("set_key", F.col("rep").alias("node")), "set_key").select("node", "hashes"), "sets")

    pairs = shared.where("rep <> center").withColumnRenamed("n", "n_v").where(similar_enough(percent))
    pairs = written(pairs.select(F.col("center").alias("u"), F.col("rep").alias("v")).distinct(), "pairs")
    links = written(confirmed(pairs, sets, percent).union(texts_of_one_id(full, member)), "links")
    open_ = written(open_buckets(shared, components(links)), "open")
    if not open_.isEmpty():
        links = links.union(written(block_links(open_, sets, percent), "block-links"))
    found = written(components(links), "components").withColumnRenamed("node", "rep")
    # every document to its class, every class to its component, which has its smallest doc_id's name
    named = member.join(found, "rep").groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = member.join(found.join(named, "component"), "rep", "left").select("set_key", F.coalesce("component_id", "first_id").alias("component_id"))
    out = sig.join(by_class, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
