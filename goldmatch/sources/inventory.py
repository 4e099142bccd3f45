"""Which databases and required files are there?"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmatch.session import mounted_path, qualified, written

# Names an intact download must contain.
REQUIRED_FILES = ["dev.json", "tables.json"]
REQUIRED_DATABASES = ["concert_singer", "pets_1", "car_1", "flight_2", "stadium"]
DATABASE_FILE = r"([^/]+)/([^/]+)\.sqlite$"
# Names that Spark's readers pass over: hidden files, and those that are not text.
HIDDEN_FILE, NO_TEXT = r"\..*|.*\._COPYING_|_[^=]*", r".*[\udc80-\udcff].*"
TASKS_PER_CORE, BATCH_ROWS = 4, 10_000


def databases_of(files: DataFrame, path: Column, pattern: str = DATABASE_FILE) -> DataFrame:
    """db_id of every path that ends in ``<name>/<name>.sqlite``, or as ``pattern`` says."""
    folder = F.regexp_extract(path, pattern, 1)
    stem = F.regexp_extract(path, pattern, min(2, re.compile(pattern).groups))
    return files.where((folder != "") & (folder == stem)).select(folder.alias("db_id")).distinct()


def _children(root: str, wanted: str, files: bool) -> Callable[[str], Iterator[str]]:
    """A function of a folder below ``root``: its files, or else its folders, with a name as ``wanted`` says."""
    matches = re.compile(wanted, re.DOTALL).fullmatch
    skips = re.compile(f"{HIDDEN_FILE}|{NO_TEXT}" if files else NO_TEXT, re.DOTALL).fullmatch

    def children(folder: str) -> Iterator[str]:
        try:
            with os.scandir(f"{root}/{folder}") as entries:
                for e in entries:
                    if matches(e.name) and not skips(e.name) and (e.is_file() if files else e.is_dir()):
                        yield f"{folder}{e.name}" if files else f"{folder}{e.name}/"
        except (FileNotFoundError, NotADirectoryError):
            return

    return children


def _existing(root: str) -> Callable[[str], Iterator[str]]:
    """A function of a name below ``root``: the name if it is a file, without a look at the others."""
    hidden = re.compile(HIDDEN_FILE, re.DOTALL).fullmatch
    return lambda name: iter([name] if os.path.isfile(f"{root}/{name}") and not hidden(name.rpartition("/")[2]) else [])


def _each(names: DataFrame, found: Callable[[str], Iterator[str]]) -> DataFrame:
    """What ``found`` has for every name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = (x for batch in batches for name in batch.column("name").to_pylist() for x in found(name))
        while rows := list(islice(out, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["name"])

    return names.mapInArrow(run, "name string")


def _wildcard(spark: SparkSession, part: str) -> str | None:
    """The regular expression of a part of a pattern; None where it is a plain name."""
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(part)
    return pattern.compiled().pattern() if pattern.hasWildcard() else None


def _plain(part: str) -> str:
    return re.sub(r"\\(.)", r"\1", part)


def _listed(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """The files below a mounted ``root`` that match one of ``globs``. The folders that a wildcard
    finds are dealt out, so many tasks list them and none holds the names of all."""
    expand, tasks = spark._jvm.org.apache.hadoop.fs.GlobExpander.expand, TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    found, plain = [], []
    for parts in ([p for p in g.split("/") if p] for braced in globs for g in expand(braced)):
        regexes = [_wildcard(spark, p) for p in parts]
        if not any(regexes):
            plain.append(("/".join(map(_plain, parts)),))
            continue
        names = spark.range(0, 1, 1, 1).select(F.lit("").alias("name"))
        for part, wanted in zip(parts[:-1], regexes[:-1], strict=True):
            if wanted:
                names = _each(names, _children(root, wanted, files=False)).repartition(tasks, "name")
            else:
                names = names.select(F.concat("name", F.lit(f"{_plain(part)}/")).alias("name"))
        if regexes[-1]:
            found.append(_each(names, _children(root, regexes[-1], files=True)))
        else:
            found.append(_each(names.select(F.concat("name", F.lit(_plain(parts[-1]))).alias("name")), _existing(root)))
    if plain or not found:
        found.append(_each(spark.createDataFrame(plain, "name string"), _existing(root)))
    return reduce(DataFrame.union, found)


def _looked_up(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """The same in a store that only Spark reaches: the driver looks the pattern up, and Spark
    spreads the listing over tasks where there are many paths."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/{glob}").select("path")
    except AnalysisException as e:
        if (e.getCondition() or "") != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string")
    return files.select(F.substr("path", F.lit(len(root) + 2)).alias("name"))


def files_below(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """``name``: paths below ``root``, relative to it, that match one of ``globs``.

    Patterns are Hadoop's, anchored at the root, and list only the folders they name. Contents
    are not read. Each pattern is looked up once; one that nothing matches adds nothing.
    """
    mounted = mounted_path(spark, root)
    if mounted is not None:
        return written(_listed(spark, mounted, globs).distinct(), "listing")
    full, names = qualified(spark, root).toString().rstrip("/"), spark.createDataFrame([], "name string")
    for g in globs:
        names = names.union(_looked_up(spark, full, g))
    return names.distinct()


def source_inventory(spark: SparkSession, root: str, glob: str = "database/*/*.sqlite", pattern: str = DATABASE_FILE) -> DataFrame:
    """Databases below ``root``: ``db_id`` of the files at ``glob`` that name their folder.

    ``pattern`` has the folder's name and the file's stem as its groups, or the name alone.
    """
    return databases_of(files_below(spark, root, [glob]), F.col("name"), pattern)


def missing_required(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Required keys that are not present; none means intact."""
    return required.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def missing_sources(spark: SparkSession, root: str, files: list[str] = REQUIRED_FILES, databases: list[str] = REQUIRED_DATABASES) -> DataFrame:
    """Missing required files and databases below ``root``. Each has one place; a copy in
    another folder does not count, and only the required places are looked at."""
    names = files + [f"database/{d}/{d}.sqlite" for d in databases]
    required = spark.createDataFrame([(n,) for n in names], "name string")
    return missing_required(required, files_below(spark, root, names), "name")
