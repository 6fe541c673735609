"""Line dedup by distinct-site spread: HyperLogLog per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_hash, sheltered, staged, text_of


def _lines(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    """(row, id, site, at, a, b): one row per line that is not blank, with a 128-bit hash in two longs."""
    text = text_of(text_column)
    line = F.trim("line")
    return docs.select(
        row_hash(F.col(id_column), F.col(text_column)).alias("row"), F.col(id_column).alias("id"),
        F.concat(F.when(F.col(site_column).isNull(), "n").otherwise("s"), F.coalesce(F.col(site_column).cast("string"), F.lit(""))).alias("site"),
        F.posexplode(F.split(text, "\n", -1)).alias("at", "line"),
    ).filter(line != "").select("row", "id", "site", "at", F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """(a, b, first) of the lines on at least ``min_sites`` sites; ``first`` is where a line comes first.

    Sketches of sites merge in a partial aggregate per line. An estimate is off
    by 1.04 / sqrt(2**lg_k); lines within four such errors of the threshold (and
    always within one site) are counted exactly, the rest is decided by the
    estimate alone.
    """
    slack = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = staged(
        lines.groupBy("a", "b").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
            F.min(F.struct("id", "row", "at")).alias("first"),
        ).filter(F.col("sites") >= min_sites - slack),
        "line-spread",
    )
    near = spread.filter(F.col("sites") <= min_sites + slack)
    counted = (
        lines.join(near.select("a", "b"), ["a", "b"], "left_semi")
        .groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
        .groupBy("a", "b").agg(F.count("*").alias("exact")).filter(F.col("exact") >= min_sites)
    )
    return spread.filter(F.col("sites") > min_sites + slack).select("a", "b", "first").unionByName(
        near.join(counted, ["a", "b"]).select("a", "b", "first")
    )


def removals(docs: DataFrame, min_sites: int = 6, keep_first: bool = True, id_column: str = "doc_id", text_column: str = "text",
             site_column: str = "source") -> DataFrame:
    """(row, removed): positions of the lines that go, for rows that lose any.

    A line is compared without the spaces around it; blank lines stay. With
    ``keep_first`` the copy with the smallest (id, row, position) stays, so no
    content leaves the corpus. A hot line meets its hash in a plain equi join,
    which AQE splits.
    """
    lines = staged(_lines(docs, id_column, text_column, site_column), "lines")
    hits = lines.join(boilerplate(lines, min_sites), ["a", "b"])
    if keep_first:
        hits = hits.filter(~F.struct("id", "row", "at").eqNullSafe(F.col("first")))
    return hits.groupBy("row").agg(F.collect_set("at").alias("removed"))


def drop_spread_lines(docs: DataFrame, min_sites: int = 6, keep_first: bool = True, id_column: str = "doc_id",
                      text_column: str = "text", site_column: str = "source") -> DataFrame:
    """``docs`` with all its columns; texts lose their boilerplate lines, ``__lines`` and ``__removed`` count.

    Every row stays, also one that loses all its lines (empty text); a null
    text stays null; rows that repeat id and text lose the same lines; a null
    site is a site of its own. A caller's own ``__lines`` stays as it is, and the
    count is then called ``__lines_``. Texts shuffle once, by the row's hash.
    """
    docs, named, restored = sheltered(docs)
    id_column, text_column, site_column = map(named, (id_column, text_column, site_column))
    gone = removals(docs, min_sites, keep_first, id_column, text_column, site_column)
    keyed = docs.withColumn("__row", row_hash(F.col(id_column), F.col(text_column)))
    joined = keyed.join(gone.select(F.col("row").alias("__row"), F.col("removed").alias("__gone")), "__row", "left")
    lines = F.split(F.col(text_column), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_column)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return restored(joined.select(
        *[text.alias(c) if c == text_column else keyed[c] for c in docs.columns],
        F.size(F.split(text_of(text_column), "\n", -1)).cast("bigint").alias("__lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("__removed"),
    ))
