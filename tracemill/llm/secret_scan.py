"""Secret scan: spans from patterns, told apart by how many repositories and owners hold a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_hash, staged, text_of

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # whole runs of 20 characters or more
HEX = r"[0-9a-f]{24,}"
# The kind this method adds: runs that mix cases and digits, as generated keys do.
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "mixed")
BLOCK = 64  # matches whose lengths are summed one by one
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where a lambda reads it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block_starts(lengths: Column) -> Column:
    """The sum of all lengths before each block."""
    zero = F.lit(0).cast("bigint")
    blocks = F.sequence(F.lit(0), ((F.size(lengths) - 1) / BLOCK).cast("int"))
    inside = lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), zero, lambda n, x: n + x)
    return F.aggregate(
        blocks, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + inside(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"])


def _start(lengths: Column, starts: Column, i: Column) -> Column:
    """The sum of all lengths before element ``i``."""
    block = (i / BLOCK).cast("int")
    return F.aggregate(F.slice(lengths, block * BLOCK + 1, i % BLOCK), F.get(starts, block), lambda n, x: n + x)


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of spans of ``pattern``, leftmost first and never overlapping; ends are exclusive code points.

    The text between matches comes from ``split``, so a start is the sum of
    the lengths before it: sums of whole blocks of matches plus a sum inside
    the own block, so the work of a text grows with its matches and not with
    their square. Matches whose ``group`` is shorter than ``least`` are dropped
    after matching, as a match consumes its text either way.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("value"))
    long = lambda x: F.coalesce(F.length(x), F.lit(0)).cast("bigint")
    none = F.array().cast(f"array<{SPAN}>")

    def placed(p: Column) -> Column:
        return _bound(F.transform(p, lambda x: long(x["gap"]) + long(x["hit"])), lambda lengths: _bound(_block_starts(lengths), lambda starts: F.filter(
            F.transform(p, lambda x, i: _bound(_start(lengths, starts, i) + long(x["gap"]), lambda start: F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), (start + long(x["hit"])).alias("end"), x["value"].alias("value")))),
            lambda s: F.length(s["value"]) >= least)))

    return F.when(text.rlike(pattern), _bound(parts, placed)).otherwise(none)


def written(found: Column) -> Column:
    """``kind:start:end`` by start and kind, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", repository: str = "doc_id", owner: str = "source",
         most_owners: int = 2) -> DataFrame:
    """(id, base, added, live, copied, repositories) per row: arrays of spans and counts.

    ``base`` has every span of the fixed patterns. Candidates of all kinds are
    hashed and counted over the whole corpus: a value held by at most
    ``most_owners`` owners looks live, however many of their repositories hold
    it; a wider spread is a copied example. ``live`` and ``copied`` count a
    row's spans of either sort; live values of the added kind that no base span
    covers become ``added`` spans. ``repositories`` is the most repositories
    that one owner has of any of the row's values, 0 without values.

    Counting is by distinct (value, owner, repository), then (value, owner),
    then value, each a partial aggregate, so one value may fill a third of
    the corpus. Null texts are empty, null owners and repositories count as one
    each, repeated rows get equal results, empty tables give no rows.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"), F.col(repository).cast("string").alias("repository"),
                       F.col(owner).cast("string").alias("owner"))
    found = staged(rows.select(
        "id", row_hash(F.col("id"), text).alias("row"), "repository", "owner",
        F.concat(spans(text, ASSIGN, 0, 2, 6), spans(text, ACCESS, 1), spans(text, HEX, 2)).alias("base"),
        spans(text, MIXED, 3).alias("mixed"),
    ), "secret-spans")
    single = found.filter(F.size("base") + F.size("mixed") > 0)
    each = single.select("row", "repository", "owner", F.explode(F.concat("base", "mixed")).alias("s")).withColumn("value", F.unhex(F.md5("s.value")))
    spread = (
        each.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("value", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("value").agg(F.count("*").alias("owners"), F.max("repositories").alias("repositories"))
    )
    live, base = F.col("owners") <= most_owners, F.col("s.kind") < 3
    before = F.max(F.when(base, F.col("s.end"))).over(Window.partitionBy("row").orderBy("s.start"))
    after = F.min(F.when(base, F.col("s.start"))).over(Window.partitionBy("row").orderBy(F.desc("s.start")))
    covered = F.coalesce(before > F.col("s.start"), F.lit(False)) | F.coalesce(after < F.col("s.end"), F.lit(False))
    judged = each.select("row", "s", "value").distinct().join(spread, "value").withColumns({"live": live, "covered": covered}).groupBy("row").agg(
        F.max("repositories").alias("repositories"),
        F.sum(F.col("live").cast("bigint")).alias("live"), F.sum((~F.col("live")).cast("bigint")).alias("copied"),
        F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3) & ~F.col("covered"), F.col("s"))).alias("added"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    return found.join(judged, "row", "left").select(
        F.col("id").alias(id_column), "base", F.coalesce("added", none).alias("added"),
        F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("copied", F.lit(0)).alias("copied"),
        F.coalesce("repositories", F.lit(0)).alias("repositories"),
    )


def digest(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans in text form."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        id_column, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"),
        F.col("live").alias("n_live"), F.col("copied").alias("n_copied"),
    )
