"""Exact dedup: group by a 128-bit content hash, keep one id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest",
                 content_hash=lambda text: F.unhex(F.md5(text))) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    A group is all rows with the same bytes of text; a null text counts as
    empty, nothing is normalised. ``keep`` ("smallest" or "largest") picks the id
    that stays. Groups come from a partial aggregate on the hash, which also
    carries the least and greatest text: when those differ, two texts share a
    hash, and only such groups are grouped again by (hash, text). No group is
    ever gathered, so any group may hold a third of the rows.

    Ids: a null id loses to any other; a group of null ids keeps null. Rows that
    repeat an id and its text are one document and are flagged alike. An empty
    table gives an empty result; other columns are not read.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).withColumn("h", content_hash(F.col("text")))
    groups = staged(
        rows.groupBy("h").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"),
                              (F.min("text") == F.max("text")).alias("one_text")),
        "exact-groups",
    )
    slim = rows.select("id", "h", F.sha2("text", 256).alias("text_sha256"))
    marked = slim.join(groups.filter("one_text").drop("one_text"), "h")
    shared = groups.filter("not one_text").select("h")
    if not shared.isEmpty():
        apart = rows.join(shared, "h", "left_semi")
        texts = apart.groupBy("h", "text").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
        marked = marked.unionByName(
            apart.join(texts, ["h", "text"]).select(
                "h", "id", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"
            )
        )
    return marked.select(
        F.col("id").alias(id_column), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def hash_groups(keys: DataFrame, hash_column: str, id_column: str, best: Column | None = None) -> DataFrame:
    """(hash, smallest id, rows) of rows that already carry a content hash."""
    return keys.groupBy(hash_column).agg((best if best is not None else F.min(id_column)).alias("keep_id"), F.count("*").alias("group_size"))
