"""Incremental ingest: new files of a landing folder through the batch run.

An addition around the batch operators: ``availableNow`` takes what has arrived
since the last call, and the checkpoint folder remembers which files were seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.plans.process import process
from tracemill.schema import IngestParams
from tracemill.sources.commits import CommitLog
from tracemill.sources.sinks import rebuildable

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
LAST_IDS = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("last_id", T.LongType())])
SKIPPED = T.StructType([T.StructField(c, T.StringType()) for c in ("case_id", "evidence_id", "reason")])


def landing_files(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files under ``.../<case_id>/<evidence_id>/<name>`` with their recorded hash; ``listed`` is false where the manifest has none."""
    parts = F.split("path", "/")
    named = raw.select(
        F.element_at(parts, -3).alias("case_id"),
        F.element_at(parts, -2).alias("evidence_id"),
        F.element_at(parts, -1).alias("filename"),
        "content",
    )
    known = manifest.select(
        "case_id", "evidence_id", F.col("evidence_type").alias("declared_type"),
        F.col("sha256").alias("recorded_sha256"), F.lit(True).alias("listed"),
    )
    return named.join(known, ["case_id", "evidence_id"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def ingest_available(
    spark: SparkSession, landing: str, manifest: DataFrame, out: str, p: IngestParams = IngestParams(),
    guard: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Process everything that has arrived, one commit a batch: events and raw records replaced per evidence, runs appended.

    A batch that is given again changes nothing. ``guard`` takes the case and
    evidence ids of a batch and returns those that history refers to, with a
    ``reason`` (``sinks.pinned_evidence``): their events and raw records stay and
    the reason goes to ``skipped``. Files that the manifest does not list go to ``unlisted``.
    """
    stream = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("recursiveFileLookup", "true").load(landing)
    )
    log = CommitLog(spark, out)

    def write(batch: DataFrame, batch_id: int) -> None:
        key = f"BATCH-{batch_id:06d}"
        if log.has(key):
            return
        arrived = landing_files(batch, manifest)
        files = arrived.filter("listed").drop("listed")
        run = process(files, p, log.history("last_ids", LAST_IDS).groupBy("case_id").agg(F.max("last_id").alias("last_id")))
        asked = files.select("case_id", "evidence_id").distinct()
        skipped = guard(asked) if guard else spark.createDataFrame([], SKIPPED)
        log.commit(
            key,
            {"events": rebuildable(run.events, skipped), "raw_records": rebuildable(run.raw_records, skipped)},
            {
                "runs": run.runs.withColumn("run_uid", F.lit(key)),
                "last_ids": run.events.groupBy("case_id").agg(F.max("id").alias("last_id")),
                "skipped": skipped.select(*SKIPPED.names),
                "unlisted": arrived.filter(~F.col("listed")).select("case_id", "evidence_id", "filename"),
            },
            rebuildable(asked, skipped),
        )

    query = (
        stream.writeStream.foreachBatch(write).trigger(availableNow=True)
        .option("checkpointLocation", f"{out}/_stream").start()
    )
    query.awaitTermination()
