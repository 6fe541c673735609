"""Hash trees over ordered items: one digest proves a list of any length, and a short proof places one item in it.

Items are ranked within their keys (``ranking.order_index``, so a hot key is
split over tasks) and hashed; sixteen neighbours make a node of the next level,
until a key has one. Every level is an aggregation with at most ``FAN`` short
hashes in a group, so no row and no task grows with a key. A key's digest
depends on its own items alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.ranking import order_index
from tracemill.session import parquet_stage

FAN = 16


@dataclass(frozen=True)
class HashTree:
    levels: list[DataFrame]  # keys, total, position from 0, hash; level 0 holds the items
    roots: DataFrame         # one row a key: keys, items, digest
    keys: list[str]

    def proof(self, wanted: DataFrame) -> DataFrame:
        """(keys, position, level, place, hashes) for the items at ``wanted`` (keys, position).

        ``hashes`` are the children of the item's node one level up, among
        them the item's own at ``place`` (from 0): the hash of their
        concatenation stands in the next row, the last one gives the digest.
        Positions that a key does not have give no rows.
        """
        asked = wanted.select(*self.keys, F.col("position").alias("_asked")).dropDuplicates()
        rows = []
        for level, nodes in enumerate(self.levels[:-1]):
            children = nodes.filter(_branching(level)).withColumn("_parent", _up(F.col("position"), 1))
            at = asked.withColumns({"_parent": _up(F.col("_asked"), level + 1), "_own": _up(F.col("_asked"), level)})
            met = at.join(children, [*self.keys, "_parent"]).filter("_asked >= 0 AND _asked < total")
            rows.append(met.groupBy(*self.keys, F.col("_asked").alias("position")).agg(
                F.lit(level).alias("level"), F.first(F.pmod("_own", F.lit(FAN))).alias("place"), _in_order().alias("hashes")))
        return reduce(DataFrame.unionByName, rows)


def _up(position: Column, levels: int) -> Column:
    return F.floor(position / F.lit(FAN**levels))


def _branching(level: int) -> Column:
    """Whether a key's nodes of this level have parents: the items always, later levels until there is one node."""
    return F.lit(True) if level == 0 else F.col("total") > FAN**level


def _in_order() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("position", "hash"))), lambda n: n["hash"])


def item_hash(*fields: str) -> Column:
    """SHA-256 of the fields as text, each with its length in front; null is ``-``, so it differs from empty."""
    parts = [F.coalesce(F.concat(F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def hash_tree(items: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> HashTree:
    """The tree over ``items`` by ``order``, ties by the hash of ``fields``; equal items may repeat.

    Items without a key are in no tree, and an empty table has no roots.
    """
    narrow = items.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], item_hash(*fields).alias("hash"))
    index = order_index(narrow, keys, [F.asc_nulls_first(f"_o{i}") for i in range(len(order))] + [F.asc("hash")], "_rank")
    totals = parquet_stage(index.totals)
    most = totals.agg(F.max("total")).first()[0] or 1
    levels = [index.rows.join(totals, keys).select(*keys, "total", (F.col("_rank") - 1).alias("position"), "hash")]
    while len(levels) == 1 or FAN ** (len(levels) - 1) < most:
        level = len(levels) - 1
        grouped = levels[-1].filter(_branching(level)).groupBy(*keys, "total", _up(F.col("position"), 1).alias("_parent"))
        levels.append(parquet_stage(grouped.agg(F.sha2(F.array_join(_in_order(), ""), 256).alias("hash")).withColumnRenamed("_parent", "position")
                                    .select(*keys, "total", "position", "hash")))
    tops = [nodes.filter(F.col("total") <= FAN**level) for level, nodes in enumerate(levels) if level]
    roots = reduce(DataFrame.unionByName, tops).select(*keys, F.col("total").alias("items"), F.col("hash").alias("digest"))
    return HashTree(levels, roots, keys)
