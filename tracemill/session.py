"""Session settings the operators are tuned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tracemill", master: str | None = None, **conf) -> SparkSession:
    """A session with AQE, skew-join splitting and UTC; ``conf`` overrides win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Top-k per group is pruned before its shuffle up to this k (link cap: 5000).
        "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder named in ``spark.checkpoint.dir``.

    A cluster names the folder; only where nothing is set and all runs in one
    process (tests) is a temporary one chosen. Files in it outlive any executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tracemill-ckpt-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local master (tests) may go without, and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="tracemill-stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def parquet_stage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet beside the checkpoints, and read back: columns prune, filters reach the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` written once, and broadcast only if it has at most ``max_rows`` rows.

    For lookups with a few short columns and one row per case (or a capped
    number). Beyond the limit the caller's join shuffles, with AQE splitting
    hot keys.
    """
    kept = reliable_checkpoint(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept
