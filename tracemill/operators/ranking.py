"""Ranks and pages of whole tables: an order-statistic index over range-partitioned rows.

Rows are dealt out by ranges of (keys, order), so a hot key is split over many
tasks. A rank is the place inside a range plus the rows of the key's earlier
ranges, of which there is one count each. The stage is written in rank order:
a page is a range of ranks that the file statistics narrow down to its row
groups, and the total of a key is known from the counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.slices import top_k_per_group
from tracemill.session import parquet_stage, reliable_checkpoint

MAX_PAGE = 500


@dataclass(frozen=True)
class Index:
    rows: DataFrame    # all rows with their rank from 1, stored by range and rank
    totals: DataFrame  # one row a key: keys, total
    keys: list[str]
    rank: str

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """One page of every key, with the key's ``total``; keys without rows on it do not appear."""
        if not 1 <= limit <= MAX_PAGE:
            raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
        if offset < 0:
            raise ValueError("offset must not be negative")
        found = self.rows.filter((F.col(self.rank) > offset) & (F.col(self.rank) <= offset + limit))
        return found.join(self.totals, self.keys)


def order_index(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> Index:
    """Ranks every row of ``df`` within its keys; ``order`` must be total.

    Rows with a null key are ranked too, but are on no page. An empty table
    gives an index without rows and totals.
    """
    if not keys:
        raise ValueError("an index needs a key")
    columns = df.columns
    spread = parquet_stage(df.repartitionByRange(*[F.asc_nulls_first(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()))
    groups = [*keys, "_range"]
    counts = spread.groupBy(*groups).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*groups, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = spread.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    starts = before.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_before")
    on = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups])
    rows = placed.join(starts, on).select(*columns, (F.col("_before") + F.col("_place")).alias(rank))
    rows = parquet_stage(rows.sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys], rank))
    return Index(rows, counts.groupBy(*keys).agg(F.sum("_n").alias("total")), keys, rank)


def first_or_all(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key, numbered; with None all rows are."""
    return order_index(df, keys, order, rank).rows if k is None else top_k_per_group(df, keys, order, k, rank)


def stored_first_or_all(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """``first_or_all`` written once; an index of all rows is stored already and is not written again."""
    kept = first_or_all(df, keys, order, k, rank)
    return kept if k is None else reliable_checkpoint(kept)
