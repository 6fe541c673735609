"""Table writes: replace per evidence, append-only history, history guard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_per_evidence(df: DataFrame, path: str) -> None:
    """Only the partitions present in ``df`` are replaced.

    Rows of one evidence go to one file, so partitions do not multiply files.
    """
    (
        df.repartition("case_id", "evidence_id").sortWithinPartitions("case_id", "evidence_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("case_id", "evidence_id").parquet(path)
    )


def append_history(df: DataFrame, path: str, partitions: tuple[str, ...] = ("case_id", "run_uid")) -> None:
    """History is never rewritten."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def pinned_evidence(
    events: DataFrame, links: DataFrame, finding_events: DataFrame, group_members: DataFrame
) -> DataFrame:
    """Evidence whose events history refers to, with the reason to keep them.

    Links are named first, then findings, then groups.
    """
    refs = [
        links.select("case_id", F.explode(F.array("event_a_id", "event_b_id")).alias("id"), F.lit(1).alias("why")),
        finding_events.select("case_id", "id", F.lit(2).alias("why")),
        group_members.select("case_id", "id", F.lit(3).alias("why")),
    ]
    hits = reduce(DataFrame.unionByName, refs).join(
        events.select("case_id", "id", "evidence_id"), ["case_id", "id"]
    )
    ends = links.select(
        "case_id", "correlation_uid", F.explode(F.array("event_a_id", "event_b_id")).alias("id")
    ).join(events.select("case_id", "id", "evidence_id"), ["case_id", "id"])
    counted = ends.groupBy("case_id", "evidence_id").agg(F.count_distinct("correlation_uid").alias("links"))
    keep = "(append-only history keeps the existing rows)"
    reason = (
        F.when(F.col("why") == 1, F.concat(
            F.lit("rebuild skipped: "), F.col("links").cast("string"),
            F.lit(f" preserved correlation link(s) reference these events {keep}")))
        .when(F.col("why") == 2, f"rebuild skipped: a preserved finding references these events {keep}")
        .otherwise(f"rebuild skipped: a preserved activity group references these events {keep}")
    )
    return (
        hits.groupBy("case_id", "evidence_id").agg(F.min("why").alias("why"))
        .join(counted, ["case_id", "evidence_id"], "left")
        .select("case_id", "evidence_id", reason.alias("reason"))
    )


def rebuildable(df: DataFrame, pinned: DataFrame) -> DataFrame:
    """Rows of evidence that may be replaced."""
    return df.join(pinned.select("case_id", "evidence_id"), ["case_id", "evidence_id"], "left_anti")
