"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn one after the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import uniform


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = 8, per_rack: int = 2, racks_per_region: int = 2) -> list[Shard]:
    """A tree of ``shards`` leaves that grows without moving rows between old leaves.

    The first ``base`` leaves fill regions of ``racks_per_region`` racks of
    ``per_rack`` shards. Each leaf beyond opens a region of its own, so no old
    subtree changes its weight and the new leaf only takes rows into itself.
    """
    size = per_rack * racks_per_region
    first = [Shard(i // size, i // per_rack, i) for i in range(min(shards, base))]
    regions, racks = -(-base // size), -(-base // per_rack)
    return first + [Shard(regions + i - base, racks + i - base, i) for i in range(base, shards)]


def _draw(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the least ``-ln(u)/weight``: each wins in proportion to its weight.

    Draws of one child do not depend on the others, so a changed weight moves
    rows only into that child (grown) or out of it (shrunk). Ties go to the
    smaller number.
    """
    ranked = [
        F.struct((-F.log(uniform(key, F.lit(level), F.lit(node))) / F.lit(float(weight))).alias("d"), F.lit(node).alias("n"))
        for node, weight in sorted(children.items()) if weight > 0
    ]
    return (F.least(*ranked) if len(ranked) > 1 else ranked[0])["n"]


def place(key: Column, leaves: list[Shard]) -> Column:
    """The leaf of ``key``: a column expression, no shuffle and no Python."""
    def weights(rows, level):
        out: dict[int, float] = {}
        for row in rows:
            out[getattr(row, level)] = out.get(getattr(row, level), 0.0) + row.weight
        return out

    def descend(rows: list[Shard], levels: tuple[str, ...]) -> Column:
        children = weights(rows, levels[0])
        drawn = _draw(key, levels[0], children)
        if len(levels) == 1:
            return drawn
        below = {c: descend([r for r in rows if getattr(r, levels[0]) == c], levels[1:]) for c, w in children.items() if w > 0}
        if len(below) == 1:
            return next(iter(below.values()))
        chosen = None
        for child, leaf in sorted(below.items()):
            chosen = F.when(drawn == child, leaf) if chosen is None else chosen.when(drawn == child, leaf)
        return chosen

    return descend(leaves, ("region", "rack", "shard"))


def assign_shards(docs: DataFrame, leaves: list[Shard], grown: list[Shard] | None = None, id_column: str = "doc_id",
                  text_column: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the UTF-8 length of the text plus 1 (null text: 1, and the crc of
    the empty text). The id alone and the leaves decide the shard; a null id is a
    key like any other. ``slot`` numbers a shard's rows from 0 without gaps:
    rows are dealt to (shard, bucket) by the id's hash, bucket counts become
    offsets, and each bucket of about ``rows_per_bucket`` rows is numbered by
    itself, so no task sees a whole shard. Rows that repeat an id go to its
    shard and get slots of their own. Texts never shuffle.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    key = F.col(id_column)
    rows = docs.select(
        key.alias("id"), (F.length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        place(key, leaves).alias("shard"),
        (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    buckets = max(1, docs.count() // (rows_per_bucket * max(1, len(leaves))))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    counts = docs.select(place(key, leaves).alias("shard"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")).groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    return rows.join(offsets, ["shard", "bucket"]).select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.row_number().over(inside) - 1).cast("bigint").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, leaves: list[Shard], path: str, id_column: str = "doc_id") -> None:
    """Writes every column of ``docs`` below ``path``, one folder ``shard=n`` per leaf."""
    docs.withColumn("shard", place(F.col(id_column), leaves)).write.partitionBy("shard").mode("overwrite").parquet(path)
