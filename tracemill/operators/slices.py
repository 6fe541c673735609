"""Building blocks that keep time- and rank-based work off single hot keys.

A window over ``partitionBy(key)`` puts a key's rows into one task. Here the
rows are first folded to one per (key, instant) with a mergeable aggregate and
then windowed per (key, time slice), so the largest task holds the distinct
instants of two slices, however many rows the key, or the slice, has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import small_side


def top_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per group in ``order``, numbered from 1.

    Two levels: per (group, salt), then per group over at most ``salts * k``
    rows. The salt is the task a row comes from, so a task sends at most ``k``
    rows of a group, all to one place (Spark prunes them before the shuffle, see
    ``spark.sql.optimizer.windowGroupLimitThreshold``). Which salt a row gets
    has no influence on the result; ``order`` must be total.
    """
    salts = 256 if k <= 1000 else 4096
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .withColumn(rank, F.row_number().over(first))
        .filter(F.col(rank) <= k)
        .withColumn(rank, F.row_number().over(second))
        .filter(F.col(rank) <= k)
        .drop("_salt")
    )


def slice_of(us: Column, span_us: int | Column) -> Column:
    """Index of the time slice, by whole-number arithmetic, also before 1970."""
    span = F.lit(span_us)
    return F.call_function("div", us - F.pmod(us, span), span)


def with_neighbour_slice(points: DataFrame, us: str, span_us: int, forward: bool) -> DataFrame:
    """Each row in its own slice, and a visiting copy in the slice that looks at it."""
    own = slice_of(F.col(us), span_us)
    other = own - 1 if forward else own + 1
    return points.withColumn(
        "_copy",
        F.explode(
            F.array(
                F.struct(own.alias("slice"), F.lit(True).alias("home")),
                F.struct(other.alias("slice"), F.lit(False).alias("home")),
            )
        ),
    ).select(*points.columns, "_copy.slice", "_copy.home")


def sliding(
    points: DataFrame, keys: list[str], us: str, span_us: int | Column, value: str, out: str = "n",
    edge: str | None = None, forward: bool = True, also: dict[str, str] | None = None,
) -> DataFrame:
    """Sum of ``value`` over ``[us, us + span]`` (or ``[us - span, us]``) per key.

    ``also`` maps further columns (none negative) to the names of their sums, in the same pass. ``edge`` names a column for the farthest instant of the frame whose value
    is above 0. ``span_us`` may be a column that is one value per key.
    ``points`` must hold one row per (key, instant). Each instant
    also puts a probe at the far end of its frame; running sums at the two
    positions give the frame's sum, so the work per slice is one sort, whereas
    a moving frame would be added up anew for every row.
    """
    sign = 1 if forward else -1
    at = F.col(us) * sign
    own = slice_of(at, span_us)
    spots = F.array(
        F.struct(own.alias("slice"), at.alias("pos"), F.lit(0).alias("probe"), F.lit(True).alias("home")),
        F.struct((own - 1).alias("slice"), at.alias("pos"), F.lit(0).alias("probe"), F.lit(False).alias("home")),
        F.struct(own.alias("slice"), (at + span_us).alias("pos"), F.lit(1).alias("probe"), F.lit(True).alias("home")),
    )
    rows = points.withColumn("_s", F.explode(spots)).select(*points.columns, "_s.*")
    so_far = Window.partitionBy(*keys, "slice").orderBy("pos", "probe").rowsBetween(Window.unboundedPreceding, 0)
    names = {value: out, **(also or {})}
    amounts = {c: F.when(F.col("probe") == 0, F.col(c)).otherwise(F.lit(0)) for c in names}
    summed = rows.select(
        "*", *[a.alias(f"_v_{c}") for c, a in amounts.items()], *[F.sum(a).over(so_far).alias(f"_sum_{c}") for c, a in amounts.items()],
        F.max(F.when(amounts[value] > 0, F.col("pos"))).over(so_far).alias("_far"),
    )
    is_probe = F.col("probe") == 1
    aggs = [
        (F.max(F.when(is_probe, F.col(f"_sum_{c}"))) - F.max(F.when(~is_probe, F.col(f"_sum_{c}") - F.col(f"_v_{c}")))).alias(name)
        for c, name in names.items()
    ]
    if edge:
        aggs.append((F.max(F.when(is_probe, F.col("_far"))) * sign).alias(edge))
    return summed.filter("home").groupBy(*points.columns, "slice").agg(*aggs).drop("slice")


def next_instant(
    points: DataFrame, keys: list[str], us: str, span_us: int, cols: dict[str, str]
) -> DataFrame:
    """Columns of the following instant of the key, null when over ``span_us`` away.

    ``points`` must hold one row per (key, instant).
    """
    order = Window.partitionBy(*keys, "slice").orderBy(us)
    copies = with_neighbour_slice(points, us, span_us, forward=True)
    near = F.lead(us).over(order) - F.col(us) <= span_us
    out = copies.select(
        "*", *[F.when(near, F.lead(c).over(order)).alias(name) for name, c in cols.items()]
    )
    return out.filter("home").drop("slice", "home")


def nearest_preceding(
    left: DataFrame, right: DataFrame, keys: list[str], us: str, span_us: int, value: str
) -> DataFrame:
    """As-of join: ``value`` of the latest right instant in ``[us - span, us]``.

    Both sides must hold one row per (key, instant). Right rows visit the next
    slice, so a slice never needs more than its own and one older slice.
    """
    r = with_neighbour_slice(
        right.select(*keys, us, F.struct(F.col(us).alias("at"), F.col(value)).alias("_hit")),
        us, span_us, forward=False,
    ).withColumn("home", F.lit(False))
    own = slice_of(F.col(us), span_us)
    le = left.select(
        *keys, us, F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"),
        own.alias("slice"), F.lit(True).alias("home"),
    )
    order = Window.partitionBy(*keys, "slice").orderBy(us, "home")
    order = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        r.unionByName(le)
        .withColumn("_hit", F.last("_hit", ignorenulls=True).over(order))
        .filter(F.col("home") & (F.col(us) - F.col("_hit.at") <= span_us))
        .select(*keys, us, F.col("_hit.at").alias("matched_us"), F.col(f"_hit.{value}").alias(value))
    )


def near_any(
    df: DataFrame, marks: DataFrame, keys: list[str], us: str, span_us: int, out: str
) -> DataFrame:
    """Flag rows within ``span_us`` of any mark of the same key (interval semi join).

    With slices as long as the span only the latest mark of the slice before
    and the earliest of the slice after matter; a mark in the own slice always
    hits. The lookup therefore has one row per (key, slice); ``df`` is not
    shuffled for it while these are few.
    """
    own = slice_of(F.col(us), span_us)
    bounds = (
        marks.withColumn("slice", own)
        .groupBy(*keys, "slice")
        .agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    )
    seen = (
        bounds.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .withColumn("slice", F.col("slice") + F.col("step"))
        .groupBy(*keys, "slice")
        .agg(
            F.max(F.col("step") == 0).alias("_same"),
            F.max(F.when(F.col("step") == 1, F.col("hi"))).alias("_before"),
            F.min(F.when(F.col("step") == -1, F.col("lo"))).alias("_after"),
        )
    )
    hit = (
        F.col("_same")
        | (F.col(us) - F.col("_before") <= span_us)
        | (F.col("_after") - F.col(us) <= span_us)
    )
    return (
        df.withColumn("slice", own)
        .join(small_side(seen), [*keys, "slice"], "left")
        .withColumn(out, F.coalesce(hit, F.lit(False)))
        .drop("slice", "_same", "_before", "_after")
    )


def number_rows(
    df: DataFrame, keys: list[str], identity: list[str], out: str = "number", salts: int = 1024
) -> DataFrame:
    """Numbers 1..n per group in a fixed pseudo-random order of ``identity``.

    Rows are ranked inside (group, salt); the counts of the salts before, at
    most ``salts`` rows per group, are added on top.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*identity)).withColumn("_salt", F.pmod("_hash", F.lit(salts)))
    counts = hashed.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_salt").orderBy("_hash", *identity)
    return (
        hashed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, "_salt"])
        .withColumn(out, F.col("_offset") + F.col("_rank"))
        .drop("_hash", "_salt", "_rank", "_offset")
    )
