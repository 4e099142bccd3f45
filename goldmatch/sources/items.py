"""Items from JSON-array split files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldmatch.session import dimension

RECORD = "array<struct<db_id:string,question:string,query:string,difficulty:string>>"


def _split_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One line per file: source_no (position in ``paths``), file, text."""
    frames = [
        spark.read.text(p, wholetext=True).select(
            F.lit(i).alias("source_no"), F.input_file_name().alias("file"), F.col("value").alias("text")
        )
        for i, p in enumerate(paths)
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def load_items(spark: SparkSession, paths: list[str], db_root: str) -> DataFrame:
    """Items of all files in order; item_id runs on from file to file.

    A JSON array is one unit of work, so a large split should be stored as many
    files in a folder. The first id of a file is the number of records in earlier
    files; that table has one line per file and is stored, so it is broadcast.
    """
    files = _split_files(spark, paths)
    by_file = Window.orderBy("source_no", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        files.select("source_no", "file", F.json_array_length("text").cast("long").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(by_file), F.lit(0)))
        .drop("_n")
    )
    starts = dimension(starts, "file-starts")
    records = files.select(
        "source_no",
        "file",
        F.posexplode(F.from_json("text", RECORD, {"mode": "FAILFAST"})).alias("_pos", "r"),
    )
    return records.join(starts, ["source_no", "file"]).select(
        (F.col("_start") + F.col("_pos")).alias("item_id"),
        F.col("r.db_id").alias("db_id"),
        F.col("r.question").alias("question"),
        F.col("r.query").alias("gold_sql"),
        database_path(db_root, F.col("r.db_id")).alias("db_path"),
        F.col("r.difficulty").alias("difficulty"),
    )


def database_path(db_root: str, db_id):
    return F.concat(F.lit(db_root.rstrip("/") + "/database/"), db_id, F.lit("/"), db_id, F.lit(".sqlite"))


def load_split(spark: SparkSession, root: str, split: str = "dev", include_others: bool = False) -> DataFrame:
    """``<root>/<split>.json``; train may be continued by ``train_others.json``."""
    root = root.rstrip("/")
    paths = [f"{root}/{split}.json"]
    if include_others and split == "train" and path_exists(spark, f"{root}/train_others.json"):
        paths.append(f"{root}/train_others.json")
    return load_items(spark, paths, root)


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("PATH_NOT_FOUND"):
            return False
        raise


def write_split_files(items: DataFrame, path: str, records_per_file: int = 50_000) -> None:
    """Store items as JSON-array files of bounded size, in id order."""
    record = F.struct("db_id", "question", F.col("gold_sql").alias("query"), "difficulty")
    pairs = F.array_sort(F.collect_list(F.struct("item_id", record.alias("r"))))
    arrays = (
        items.withColumn("file_no", F.lpad(F.floor(F.col("item_id") / records_per_file).cast("string"), 12, "0"))
        .groupBy("file_no")
        .agg(
            F.to_json(F.transform(pairs, lambda p: p["r"]), {"ignoreNullFields": "false"}).alias("value")
        )
    )
    arrays.write.partitionBy("file_no").text(path)
