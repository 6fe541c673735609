"""Evidence file scan, admission and manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.predicates import uid
from tracemill.functions.timestamps import strip
from tracemill.schema import IngestParams

# --- fixed values: admission rules ---------------------------------------------------
MIME_TYPES = {
    "csv": "text/csv", "json": "application/json", "txt": "text/plain", "log": "text/plain",
    "zip": "application/zip",
}
BANNED_MAGIC = (
    ("4D5A", "Windows executable"), ("7F454C46", "ELF executable"), ("89504E47", "PNG image"),
    ("25504446", "PDF document"), ("1F8B", "gzip archive"),
)
MAX_NAME = 200
PEEK = 8192
# --------------------------------------------------------------------------------------


def scan_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with size and SHA-256.

    Spark's file scan leaves out files of zero bytes; ``with_empty`` brings
    them back where a listing of the expected names exists.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        "content",
        F.col("length").alias("file_size"),
        F.sha2("content", 256).alias("sha256"),
    )


def with_empty(scanned: DataFrame, expected: DataFrame) -> DataFrame:
    """Every expected ``filename``; one the scan did not see has no bytes."""
    nothing = F.lit(b"")
    return (
        expected.select("filename").join(scanned, "filename", "left")
        .withColumns({
            "content": F.coalesce("content", nothing),
            "file_size": F.coalesce("file_size", F.lit(0)),
            "sha256": F.coalesce("sha256", F.sha2(nothing, 256)),
        })
    )


def safe_name(c):
    """Base name without control or reserved characters, no leading dots, at most 200 long."""
    name = F.element_at(F.split(F.regexp_replace(c, r"[/\\]+$", ""), r"[/\\]"), -1)
    name = F.regexp_replace(name, r"\p{C}", "")
    name = F.regexp_replace(name, r'[<>:"|?*]', "_")
    name = F.regexp_replace(strip(F.regexp_replace(name, r"\s+", " ")), r"^[. ]+", "")
    ext = F.regexp_extract(name, r"\.([^.]{0,10})$", 1)
    room = F.lit(MAX_NAME) - F.length(ext) - 1
    cut = F.when(
        name.rlike(r"\.[^.]{0,10}$"), F.concat(F.substring(name, F.lit(1), room), F.lit("."), ext)
    ).otherwise(F.substring(name, 1, MAX_NAME))
    return F.when(F.length(name) > MAX_NAME, cut).otherwise(name)


def _is_text(head):
    """UTF-8 up to a character cut at the end, and no null byte."""
    hexed = F.hex(head)
    whole = F.is_valid_utf8(head.cast("string"))
    for cut in (1, 2, 3):
        whole = whole | F.is_valid_utf8(F.substring(head, F.lit(1), F.length(head) - cut).cast("string"))
    return whole & ~hexed.rlike("^(..)*?00")


def _is_json(text):
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda line: strip(line) != "")
    parses = lambda t: F.try_parse_json(t).isNotNull()
    return parses(text) | ((F.size(lines) > 0) & F.forall(lines, parses))


def admit(files: DataFrame, p: IngestParams = IngestParams()) -> DataFrame:
    """Adds ``safe_filename``, ``extension``, ``mime_type``, ``reject_code``, ``admitted``."""
    name = safe_name(F.col("filename"))
    ext = F.lower(F.regexp_extract("safe_filename", r"[^.]\.([^.]+)$", 1))
    head = F.substring("content", 1, PEEK)
    magic = F.hex(F.substring("content", 1, 4))
    banned = F.lit(False)
    for prefix, _ in BANNED_MAGIC:
        banned = banned | magic.startswith(prefix)
    text = F.col("content").cast("string")
    mismatch = (
        banned
        | ((F.col("extension") == "zip") & ~magic.startswith("504B"))
        | ((F.col("extension") != "zip") & ~_is_text(head))
        | ((F.col("extension") == "json") & (~F.is_valid_utf8(text) | ~_is_json(text)))
    )
    code = (
        F.when(F.coalesce("safe_filename", F.lit("")) == "", "INVALID_FILENAME")
        .when(~F.col("extension").isin(*MIME_TYPES), "UNSUPPORTED_FILE_TYPE")
        .when(F.length("content") > p.max_bytes, "FILE_TOO_LARGE")
        .when(F.length("content") == 0, "EMPTY_FILE")
        .when(mismatch, "CONTENT_TYPE_MISMATCH")
    )
    mime = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv]), F.col("extension")
        ),
        F.lit("application/octet-stream"),
    )
    return (
        files.withColumn("safe_filename", name)
        .withColumn("extension", ext)
        .withColumn("mime_type", mime)
        .withColumn("reject_code", code)
        .withColumn("admitted", F.col("reject_code").isNull())
    )


def split_new(incoming: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts). A recorded evidence id is never written twice.

    Of rows that share an id inside the batch the first by path and hash is
    appended; the others are conflicts, so every row is in one output.
    """
    key = ["case_id", "evidence_id"]
    known = manifest.select(*key)
    first = [F.asc_nulls_last(c) for c in ("path", "sha256") if c in incoming.columns] or [F.lit(0)]
    ranked = incoming.withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy(*first)))
    unknown = ranked.join(known, key, "left_anti")
    fresh = unknown.filter("_copy = 1").drop("_copy")
    return fresh, incoming.join(known, key, "left_semi").unionByName(unknown.filter("_copy > 1").drop("_copy"))


def evidence_ids(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """EV-0001 style ids per case, continuing after the manifest's greatest number."""
    last = manifest.groupBy("case_id").agg(
        F.max(F.substring("evidence_id", 4, 20).try_cast("int")).alias("last")
    )
    order = Window.partitionBy("case_id").orderBy("path")
    number = F.coalesce("last", F.lit(0)) + F.row_number().over(order)
    return (
        incoming.join(last, "case_id", "left")
        .withColumn("evidence_id", uid("EV-", number, 4))
        .drop("last")
    )
