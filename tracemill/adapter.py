"""Projects the benchmark parquet tables onto the investigation schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_SQL = """
SELECT event_id AS id,
  'EVT-' || lpad(CAST(event_id + 1 AS STRING), 6, '0') AS event_uid,
  'CASE-2024-' || lpad(CAST(user_id % 4 + 1 AS STRING), 3, '0') AS case_id,
  'EV-' || lpad(CAST((user_id % 4) * 5 + (CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1
     WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END) + 1 AS STRING), 4, '0') AS evidence_id,
  ts AS timestamp,
  CASE event_type WHEN 'signup' THEN 'authentication' WHEN 'error' THEN 'authentication'
     WHEN 'click' THEN 'file_activity' WHEN 'view' THEN 'process' ELSE 'network' END AS source_type,
  CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'login'
     WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'write' WHEN 1 THEN 'delete'
                       WHEN 2 THEN 'rename' ELSE 'open' END
     WHEN 'view' THEN 'start' ELSE 'connect' END AS action,
  CASE event_type WHEN 'signup' THEN 'success' WHEN 'error' THEN 'failure' END AS status,
  'usr_' || CAST(user_id AS STRING) AS user,
  'WS-' || lpad(CAST(user_id % 10 AS STRING), 2, '0') AS host,
  CASE WHEN event_id % 3 = 0
       THEN '8.8.' || CAST(user_id % 4 AS STRING) || '.' || CAST(event_id % 5 + 1 AS STRING)
       ELSE '10.0.' || CAST(user_id % 200 AS STRING) || '.' || CAST(event_id % 5 + 1 AS STRING)
  END AS source_ip,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0
       THEN '93.184.216.' || CAST(event_id % 200 + 1 AS STRING)
       ELSE '10.20.30.' || CAST(event_id % 200 + 1 AS STRING) END END AS destination_ip,
  CASE WHEN event_type = 'view' THEN CASE event_id % 5 WHEN 0 THEN 'powershell.exe'
       WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'explorer.exe' WHEN 3 THEN 'chrome.exe'
       ELSE 'python3' END END AS process,
  CASE WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'powershell -nop -w hidden -enc AAAA'
       WHEN event_type = 'view' THEN 'run' END AS command_line,
  CASE WHEN event_type = 'click' THEN '/data/f' || CAST(event_id % 50 AS STRING) || '.txt' END
       AS file_path,
  CASE WHEN value > 300 THEN 'Critical' WHEN value > 200 THEN 'High'
       WHEN value > 100 THEN 'Medium' ELSE 'Low' END AS severity,
  props AS content
FROM {source}
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS_SQL, source=read(spark, sf_dir, "events"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common event table; one projection, no shuffle."""
    flat = _flat(spark, sf_dir)
    present = F.filter(
        F.array(
            F.struct(F.lit("status").alias("key"), F.col("status").alias("value")),
            F.struct(F.lit("command_line").alias("key"), F.col("command_line").alias("value")),
        ),
        lambda e: e["value"].isNotNull(),
    )
    return flat.select(
        "id", "event_uid", "case_id", "evidence_id",
        F.col("id").alias("row_index"),
        "timestamp",
        F.lit("assumed UTC (no timezone in source)").alias("tz_note"),
        "source_type",
        F.col("action").alias("event_type"),
        "user", "host", "source_ip", "destination_ip", "process", "file_path", "action", "severity",
        F.map_from_entries(present).alias("metadata"),
        F.lit(None).cast("string").alias("dedupe_hash"),
        F.lit(None).cast("string").alias("duplicate_of"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case dimension derived from the events."""
    ev = events(spark, sf_dir)
    number = F.substring("case_id", -3, 3).cast("int")
    return (
        ev.groupBy("case_id")
        .agg(F.min("timestamp").alias("created_at"), F.max("timestamp").alias("last_activity"))
        .select(
            "case_id",
            F.concat(F.lit("Investigation "), number.cast("string")).alias("title"),
            F.when(number == 1, "benchmark fixture").otherwise("").alias("description"),
            F.when(number % 2 == 0, "Active").otherwise("Under Review").alias("status"),
            F.when(number % 3 == 0, "High").otherwise("Medium").alias("severity"),
            F.lit(False).alias("demo"),
            "created_at", "last_activity",
        )
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence manifest: one row per (case, evidence id) of the events.

    The byte size is the total length of the events' properties, so it is a
    plain aggregate over the whole table.
    """
    return (
        _flat(spark, sf_dir).withColumn("size", F.length("content"))
        .groupBy("case_id", "evidence_id")
        .agg(
            F.min("source_type").alias("evidence_type"),
            F.sum("size").alias("file_size"),
            F.count("*").alias("record_count"),
            F.min("timestamp").alias("uploaded_at"),
        )
        .select(
            "case_id", "evidence_id",
            F.concat(F.lower("evidence_id"), F.lit(".csv")).alias("original_filename"),
            F.sha2(F.concat_ws("|", "case_id", "evidence_id"), 256).alias("sha256"),
            "evidence_type", "file_size", "record_count",
            F.lit("Analyzed").alias("status"),
            F.lit("benchmark export").alias("source"),
            "uploaded_at",
        )
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original record behind every event: its properties text."""
    return _flat(spark, sf_dir).select(
        "case_id", "evidence_id", F.col("id").alias("row_index"), "content",
        F.lit(None).cast("string").alias("reject_reason"),
    )
