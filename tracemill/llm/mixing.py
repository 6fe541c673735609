"""Mixing sources to target weights: repetition rates per source, whole copies plus one drawn copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sheltered, staged, text_of, uniform

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text_column: str = "text") -> Column:
    return F.regexp_count(text_of(text_column), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one per source.

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes. A target stops at ``most`` times its source's size and
    the excess goes to the others by weight, again and again; in closed form,
    target = min(most * size, level * weight) with one level for all. The
    window without a key runs over one row per source, never over documents.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("turn", F.row_number().over(named) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    everything = Window.partitionBy(F.lit(0))
    stepped = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_here", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
    )
    free = F.when(F.col("cap") / F.col("weight") >= F.col("level_here"), F.col("level_here"))
    return stepped.withColumn("level", F.max(free).over(everything)).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17, id_column: str = "doc_id",
           text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(id, size, source_size, target, copies) for every row of ``docs``.

    rate = target / source_size. A row is emitted floor(rate) times, and once
    more when a draw from (seed, id) is at most the fraction of the rate. The
    draw depends on nothing else, so reruns and retried tasks agree; rows that
    repeat an id draw alike. Null texts have size 0; a source of size 0 has
    target 0 and its rows are emitted 0 times. The only shuffles carry partial
    sums per source and, if Spark does not broadcast the rates, (id, size).
    """
    sized = staged(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words(text_column).alias("size")), "mix-sizes")
    rates = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(float(most)))
    joined = sized.join(rates.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
    counted = joined.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    drawn = (uniform(F.lit(seed), F.col("id")) <= F.col("rate") - F.floor("rate")).cast("bigint")
    return counted.select(F.col("id").alias(id_column), "size", "source_size", "target", (F.floor("rate") + drawn).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17, id_column: str = "doc_id",
        text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``copies`` says."""
    docs, named, restored = sheltered(docs)
    id_column, text_column, source_column = map(named, (id_column, text_column, source_column))
    sized = docs.select(F.col(source_column).alias("source"), words(text_column).alias("size"))
    rates = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).select(
        F.col("source").alias("__named"),
        F.coalesce(F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(float(most))), F.lit(0.0)).alias("__rate"),
    )
    rates = staged(rates, "mix-rates")
    n = F.floor("__rate") + (uniform(F.lit(seed), F.col(id_column)) <= F.col("__rate") - F.floor("__rate")).cast("bigint")
    joined = docs.join(rates, docs[source_column].eqNullSafe(rates["__named"]))
    return restored(joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*[docs[c] for c in docs.columns]))
