"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "goldmatch", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the defaults above; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="goldmatch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder; nothing is created."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str):
    """``path`` as Hadoop's path with its store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(folder)


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as tasks can open it, if it lies in a mounted file system; None in other stores."""
    uri = qualified(spark, path).toUri()
    return uri.getPath().rstrip("/") if uri.getScheme() == "file" else None


def written(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` as a table in the scratch folder and read it back.

    This cuts the lineage in a way that survives lost executors and fixes
    non-deterministic columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dimension(df: DataFrame, label: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Store a lookup table and decide by its real size how to join it.

    The size of the files says little, repeated texts compress very well, so the
    stored values are measured. Up to ``max_bytes`` the table is broadcast. A larger
    one is joined by sort-merge, where adaptive execution splits hot keys.
    """
    stored = written(df, label)
    size = stored.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return stored.hint("broadcast" if size <= max_bytes else "merge")

