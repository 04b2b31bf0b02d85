"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "aspectra", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` overrides any setting.

    Keyword names use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Stored intermediate results go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary folder; on a cluster
    such a folder would live on one machine, so the setting is required there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            configured = tempfile.mkdtemp(prefix="aspectra-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage; a lost executor cannot undo it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder, and the table read back from there."""
    path = new_table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the input has fewer splits than the session has cores.

    A table of many files already has more splits than cores and is returned unchanged, so this
    never adds a shuffle to a large scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
