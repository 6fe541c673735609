"""Reason-tagged links between events close in time.

A link needs a shared host, user or address, so pairs come from an equi join
on that value and a time slice as long as the window. A run keeps the first
``max_links`` links of a case in time order. That order lets most pairs be
ruled out before the join, without changing the result:

* slices after the one by which a case certainly has its links hold none;
* two events of one host (or user) in one slice always link, so the first
  ``a`` events of a slice already make ``a (a + 1) / 2`` links and no later
  event of it can open a kept one.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.functions.network import external_ip
from tracemill.operators.ranking import first_or_all
from tracemill.operators.slices import slice_of, sliding, top_k_per_group
from tracemill.schema import CONFIDENCE_BANDS, CORRELATION_TYPES, LinkParams
from tracemill.session import parquet_stage, small_side

_FIELDS = [
    "id", "event_uid", "evidence_id", "us", "source_type", "user", "host", "source_ip",
    "process", "file_path", "destination_ip", "external",
]
_KEY = ["case_id", "kind", "value", "slice"]
_PARTS = 32


def dated_events(events: DataFrame) -> DataFrame:
    """Events with a timestamp, reduced to what linking reads; '' counts as absent."""
    blank = {c: F.nullif(F.col(c), F.lit("")) for c in ("user", "host", "source_ip")}
    return (
        events.filter(F.col("timestamp").isNotNull())
        .withColumns({**blank, "us": P.micros(F.col("timestamp"))})
        .withColumn(
            "external",
            (F.col("source_type") == "network") & external_ip(F.col("destination_ip")),
        )
        .select("case_id", *_FIELDS)
    )


def _slice(span_us: int) -> Column:
    return slice_of(F.col("us"), span_us)


def _last_slices(dated: DataFrame, span_us: int, max_links: int) -> DataFrame:
    """Per case the slice by which ``max_links`` links certainly exist.

    Counts per (case, host, slice) and (case, user, slice) give a lower bound
    per slice; the running sum has one row per slice of the case's time span.
    """
    pairs = F.col("count") * (F.col("count") - 1) / 2
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("host", "user")])
    bound = (
        dated.select("case_id", _slice(span_us).alias("slice"), F.inline(values))
        .filter(F.col("value").isNotNull())
        .groupBy("case_id", "kind", "value", "slice").count()
        .groupBy("case_id", "kind", "slice").agg(F.sum(pairs).alias("pairs"))
        .groupBy("case_id", "slice").agg(F.max("pairs").alias("pairs"))
    )
    so_far = F.sum("pairs").over(
        Window.partitionBy("case_id").orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        bound.withColumn("so_far", so_far)
        .filter(F.col("so_far") >= max_links)
        .groupBy("case_id").agg(F.min("slice").alias("last_slice"))
    )


def _by_value(dated: DataFrame, span_us: int) -> DataFrame:
    """One row per event and shared value it can link on."""
    values = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("host", "user", "source_ip")]
    )
    return (
        dated.withColumn("v", F.explode(F.filter(values, lambda v: v["value"].isNotNull())))
        .select("case_id", "v.kind", "v.value", _slice(span_us).alias("slice"), *_FIELDS)
    )


def _prune_rows(rows: DataFrame, span_us: int, max_links: int) -> DataFrame:
    """Keep rows that can be in a kept link, flagged when they can open one.

    Groups of at most ``openers`` rows, which is nearly all, pass unranked; the
    larger ones are found by a count and ranked.
    """
    openers = math.ceil((math.sqrt(8 * max_links + 1) - 1) / 2)
    typed = F.col("source_type").isin("authentication", "network")
    rows = rows.withColumn("strong", (F.col("kind") != "source_ip") | typed)
    kind_key = [*_KEY, "strong"]
    large = small_side(
        rows.groupBy(*kind_key).count().filter(F.col("count") > openers).select(*kind_key)
    )
    calm = rows.join(large, kind_key, "left_anti").withColumn("opens", F.lit(True))
    busy = rows.join(large, kind_key, "left_semi")
    # Enough rows of each sort to close every kept link an opener starts.
    ranked = top_k_per_group(
        _busy_groups(busy, rows, large, span_us), [*_KEY, "group"], [F.asc("us"), F.asc("id")],
        openers + 2 * max_links,
    )
    opens = (
        F.when(F.col("group") == "strong", F.col("rank") <= openers)
        .when(F.col("group") == "closer", False)
        .otherwise(F.col("rank") <= max_links)
    )
    return calm.unionByName(ranked.withColumn("opens", opens).drop("rank", "group"))


def _busy_groups(busy: DataFrame, rows: DataFrame, large: DataFrame, span_us: int) -> DataFrame:
    """Adds ``group``. In an address group an event that is neither authentication
    nor network opens a link only if such an event follows, in its slice
    (``early``) or soon enough in the next one (``late``).

    The lookup of those events is repeated per part, so that a hot address
    slice is not joined in one task.
    """
    ends = (
        rows.filter((F.col("kind") == "source_ip") & F.col("strong"))
        .groupBy(*_KEY).agg(F.max(F.struct("us", "id")).alias("last"), F.min("us").alias("first_us"))
        .withColumn("step", F.explode(F.array(F.lit(0), F.lit(-1))))
        .withColumn("slice", F.col("slice") + F.col("step"))
        .join(large.filter(~F.col("strong")).select(*_KEY), _KEY, "left_semi")
        .groupBy(*_KEY)
        .agg(
            F.max(F.when(F.col("step") == 0, F.col("last"))).alias("last_strong"),
            F.min(F.when(F.col("step") == -1, F.col("first_us"))).alias("next_strong_us"),
        )
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    )
    early = F.struct("us", "id") < F.col("last_strong")
    late = F.col("next_strong_us") - F.col("us") <= span_us
    group = (
        F.when(F.coalesce(early, F.lit(False)), "early")
        .when(F.coalesce(late, F.lit(False)), "late")
        .otherwise("closer")
    )
    weak = (
        busy.filter(~F.col("strong"))
        .withColumn("part", F.pmod(F.xxhash64("id"), F.lit(_PARTS)).cast("int"))
        .join(ends, [*_KEY, "part"], "left")
        .withColumn("group", group)
    )
    return busy.filter("strong").withColumn("group", F.lit("strong")).unionByName(
        weak.select(*busy.columns, "group")
    )


def _correlation_type() -> Column:
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same_host = F.coalesce(a("host") == b("host"), F.lit(False))
    same_user = F.coalesce(a("user") == b("user"), F.lit(False))
    same_ip = F.coalesce(a("source_ip") == b("source_ip"), F.lit(False))
    kinds = F.array(a("source_type"), b("source_type"))
    file_process = F.array_contains(kinds, "process") & F.array_contains(kinds, "file_activity")
    net_process = F.array_contains(kinds, "process") & (a("external") | b("external"))
    typed = F.array_contains(kinds, "authentication") | F.array_contains(kinds, "network")
    return (
        F.when(same_host & file_process, "CORR-004")
        .when(same_host & net_process, "CORR-005")
        .when(same_user, "CORR-002")
        .when(same_ip & typed, "CORR-003")
        .when(same_host, "CORR-001")
    )


def _reason(window: int) -> Column:
    shared = F.col("shared_entities")
    when = F.concat(
        F.bround("time_delta_seconds", 0).cast("long").cast("string"),
        F.lit(f" seconds apart (window {window}s)"),
    )

    def either(c: str, fallback: str) -> Column:
        text = F.trim(F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")), F.col(f"b.{c}"), F.lit("")))
        return F.when(text != "", text).otherwise(fallback)

    host = F.coalesce(shared["host"], F.lit("unknown"))
    # The wording of a link's reason.
    by_type = {
        "CORR-001": ("Both events occurred on host ", shared["host"], " and ", when,
                     ". Shared host is co-occurrence, not causation."),
        "CORR-002": ("Both events involve user ", shared["user"], " and ", when,
                     ". Shared user is co-occurrence, not causation."),
        "CORR-003": ("Both events carry source IP ", shared["source_ip"], " and ", when,
                     " (at least one event is authentication or network activity)."),
        "CORR-004": ("Process '", either("process", "a process"), "' follows file activity (",
                     either("file_path", "file activity"), ") on the same host (", host, ") and ", when,
                     ". Temporal association is not causation."),
        "CORR-005": ("Process '", either("process", "a process"), "' follows an external connection to ",
                     either("destination_ip", "an external address"), " on the same host (", host,
                     ") and ", when, ". Temporal association is not causation."),
    }
    out = F.lit(None).cast("string")
    for ctype, parts in by_type.items():
        text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        out = F.when(F.col("correlation_type") == ctype, text).otherwise(out)
    return out


def _all_rows(dated: DataFrame, span_us: int, openers: DataFrame | None) -> DataFrame:
    """Every row as ``_prune_rows`` flags them, but none left out; only ``openers`` open, where given."""
    typed = F.col("source_type").isin("authentication", "network")
    rows = _by_value(dated, span_us).withColumn("strong", (F.col("kind") != "source_ip") | typed)
    if openers is None:
        return rows.withColumn("opens", F.lit(True))
    few = small_side(openers.select("case_id", "id", "us", F.lit(True).alias("opens")).distinct())
    return rows.join(few, ["case_id", "id", "us"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))


def links(events: DataFrame, p: LinkParams = LinkParams(), openers: DataFrame | None = None) -> DataFrame:
    """The first ``max_links`` links of every case, numbered in time order; with None all links.

    ``openers`` (case_id, id, us), which needs a limit of None, leaves only the
    links that these events open. Where they are the first linked events of a
    case in time order, the numbers are those among all links.
    """
    if openers is not None and p.max_links is not None:
        raise ValueError("openers need a limit of None")
    span = p.window_seconds * 1_000_000
    dated = dated_events(events)
    if p.max_links is None:
        rows = _all_rows(dated, span, openers)
    else:
        last = small_side(_last_slices(dated, span, p.max_links))
        # A kept link opens at or before the last slice, so it closes one later at most. What is left is read several times.
        dated = parquet_stage(
            dated.join(last, "case_id", "left")
            .filter(F.col("last_slice").isNull() | (_slice(span) <= F.col("last_slice") + 1))
            .drop("last_slice")
        )
        rows = _prune_rows(_by_value(dated, span), span, p.max_links)

    side = ["strong", *_FIELDS]
    opening = rows.filter("opens").select(
        "case_id", "kind", "value",
        F.explode(F.array(F.col("slice"), F.col("slice") + 1)).alias("slice"),
        F.struct(*side).alias("a"),
    )
    if openers is not None:
        opening = small_side(opening)
    closing = rows.select(*_KEY, F.struct(*side).alias("b"))
    after = F.struct("b.us", "b.id") > F.struct("a.us", "a.id")
    # A pair sharing several values is taken once: by host, else user, else address.
    first_kind = (
        F.when(F.col("kind") == "host", True)
        .when(F.col("kind") == "user", ~F.col("a.host").eqNullSafe(F.col("b.host")) | F.col("a.host").isNull())
        .otherwise(
            (F.col("a.strong") | F.col("b.strong"))
            & (~F.col("a.host").eqNullSafe(F.col("b.host")) | F.col("a.host").isNull())
            & (~F.col("a.user").eqNullSafe(F.col("b.user")) | F.col("a.user").isNull())
        )
    )
    pairs = (
        opening.join(closing, _KEY)
        .filter(after & (F.col("b.us") - F.col("a.us") <= span) & first_kind)
        .select("case_id", "a", "b", _correlation_type().alias("correlation_type"))
    )
    order = [F.asc("a.us"), F.asc("a.id"), F.asc("b.us"), F.asc("b.id")]
    kept = first_or_all(pairs, ["case_id"], order, p.max_links, rank="link_rank")
    same = {c: F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False))
            for c in ("host", "user", "source_ip")}
    weights = {"host": p.weight_host, "user": p.weight_user, "source_ip": p.weight_ip}
    confidence = F.lit(p.weight_time)
    for c, w in weights.items():
        confidence = confidence + F.when(same[c], F.lit(w)).otherwise(F.lit(0.0))
    shared = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(c).alias("key"), F.when(same[c], F.col(f"a.{c}")).alias("value"))
                      for c in weights]),
            lambda e: e["value"].isNotNull(),
        )
    )
    described = kept.withColumns(
        {
            "time_delta_seconds": F.round((F.col("b.us") - F.col("a.us")) / F.lit(1e6), 3),
            "confidence": F.round(F.least(confidence, F.lit(1.0)), 4),
            "shared_entities": shared,
        }
    )
    return described.select(
        "case_id",
        "link_rank",
        P.uid("COR-", F.col("link_rank")).alias("correlation_uid"),
        "correlation_type",
        F.col("a.id").alias("event_a_id"),
        F.col("b.id").alias("event_b_id"),
        F.col("a.event_uid").alias("event_a_uid"),
        F.col("b.event_uid").alias("event_b_uid"),
        F.col("a.us").alias("us_a"),
        F.col("b.us").alias("us_b"),
        "time_delta_seconds",
        "confidence",
        P.confidence_band(F.col("confidence")).alias("band"),
        "shared_entities",
        _reason(p.window_seconds).alias("reason"),
        F.array_sort(F.array_distinct(F.array("a.evidence_id", "b.evidence_id"))).alias("evidence_ids"),
    )


def link_stats(events: DataFrame, found: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """Per case counts, zero-filled by type and band.

    ``pairs_evaluated`` counts the time-window pairs up to the last kept link,
    or all of them when the cap was not reached. It is summed from sliding
    counts per instant; no pair is built.
    """
    span, cap = p.window_seconds * 1_000_000, p.max_links if p.max_links is not None else 2**62
    dated = events.filter(F.col("timestamp").isNotNull()).select(
        "case_id", "id", P.micros(F.col("timestamp")).alias("us")
    )
    per_case = found.groupBy("case_id").agg(
        F.count("*").alias("links"),
        *[F.count_if(F.col("correlation_type") == t).alias(t.replace("-", "_").lower())
          for t in CORRELATION_TYPES],
        *[F.count_if(F.col("band") == b).alias(f"band_{b.lower()}") for b in CONFIDENCE_BANDS],
        F.max(F.struct("us_a", "event_a_id", "us_b", "event_b_id")).alias("end"),
    ).withColumn("end", F.when(F.col("links") >= cap, F.col("end")))
    points = dated.groupBy("case_id", "us").agg(F.count("*").alias("c"))
    ahead = sliding(points, ["case_id"], "us", span, "c", out="reach")
    # An instant with c events and `reach` events from it on makes these pairs.
    whole = F.col("c") * F.col("reach") - F.col("c") * (F.col("c") + 1) / 2
    ends = per_case.select("case_id", "end")
    before = (
        ahead.join(ends, "case_id", "left")
        .groupBy("case_id")
        .agg(
            F.sum("c").alias("dated_events"),
            F.sum(F.when(F.col("end").isNull() | (F.col("us") < F.col("end.us_a")), whole)).alias("p1"),
            F.max(F.when(F.col("us") == F.col("end.us_a"), F.col("reach"))).alias("reach_end"),
        )
    )
    at_end = (
        dated.join(ends.filter("end is not null"), "case_id")
        .filter((F.col("us") >= F.col("end.us_a")) & (F.col("us") <= F.col("end.us_b")))
        .groupBy("case_id")
        .agg(
            F.count_if((F.col("us") == F.col("end.us_a")) & (F.col("id") < F.col("end.event_a_id"))).alias("k"),
            F.count_if(
                (F.struct("us", "id") > F.struct("end.us_a", "end.event_a_id"))
                & (F.struct("us", "id") <= F.struct("end.us_b", "end.event_b_id"))
            ).alias("p3"),
        )
    )
    k = F.coalesce("k", F.lit(0))
    partial = k * F.coalesce("reach_end", F.lit(0)) - k * (k + 1) / 2
    zero = [c for c in per_case.columns if c not in ("case_id", "end")]
    return (
        before.join(per_case.drop("end"), "case_id", "left")
        .join(at_end, "case_id", "left")
        .select(
            "case_id",
            F.lit(p.window_seconds).alias("window_seconds"),
            "dated_events",
            (F.coalesce("p1", F.lit(0)) + partial + F.coalesce("p3", F.lit(0))).cast("long").alias("pairs_evaluated"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
            (F.coalesce("links", F.lit(0)) >= cap).alias("links_truncated"),
        )
    )


def _link_counts(dated: DataFrame, of: list[str], p: LinkParams, apart: bool = False) -> DataFrame:
    """Links by type and band of every key ``of``; ``apart`` leaves out pairs of rows that are one event (same id, same instant)."""
    span = p.window_seconds * 1_000_000
    parts = {"host": 1, "user": 2, "source_ip": 4}
    weights = {"host": p.weight_host, "user": p.weight_user, "source_ip": p.weight_ip}
    sets = range(1, 8)
    kind = F.col("source_type")
    classes = {
        "n": F.lit(True), "process": kind == "process", "file": kind == "file_activity", "outward": F.col("external"),
        "untyped": ~F.coalesce(kind.isin("authentication", "network"), F.lit(False)),
    }
    folded = dated.groupBy(*of, *parts, "us").agg(*[F.count_if(c).alias(name) for name, c in classes.items()])
    agreed = F.array(*[
        F.when(F.expr(" AND ".join(f"{c} IS NOT NULL" for c, bit in parts.items() if m & bit)), F.struct(
            F.lit(m).alias("shared"), *[(F.col(c) if m & bit else F.lit("")).alias(c) for c, bit in parts.items()]))
        for m in sets])
    keys = [*of, "shared", *parts]

    def agreeing(rows: DataFrame, *more: str) -> DataFrame:
        return (
            rows.select(*of, "us", *more, *classes, F.explode(F.array_compact(agreed)).alias("k"))
            .groupBy(*of, "k.shared", *[F.col(f"k.{c}").alias(c) for c in parts], "us", *more)
            .agg(*[F.sum(c).alias(c) for c in classes])
        )

    points = agreeing(folded)
    ahead = sliding(points, keys, "us", span, "n", out="n_ahead", also={c: f"{c}_ahead" for c in classes if c != "n"})
    within = lambda c: F.col(c) * F.col(f"{c}_ahead") - F.call_function("div", F.col(c) * (F.col(c) + 1), F.lit(2))
    between = lambda a, b: F.col(a) * F.col(f"{b}_ahead") + F.col(b) * F.col(f"{a}_ahead") - F.col(a) * F.col(b)
    pairs = {"n": within("n"), "untyped": within("untyped"), "file": between("process", "file"), "outward": between("process", "outward")}
    amounts = ahead.select(*of, "shared", *[amount.alias(name) for name, amount in pairs.items()])
    if apart:
        key = ["case_id", "id", "us"]
        again = dated.groupBy(*key).count().filter(F.col("count") > 1).select(*[F.col(c).alias(f"_{c}") for c in key])
        twice = dated.join(again, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]), "left_semi")
        twins = agreeing(twice.select(*of, "id", *parts, "us", *[
            F.coalesce(c, F.lit(False)).cast("long").alias(name) for name, c in classes.items()]), "id")
        own = lambda c: F.call_function("div", F.col(c) * (F.col(c) - 1), F.lit(2))
        theirs = {"n": own("n"), "untyped": own("untyped"), "file": F.col("process") * F.col("file"), "outward": F.col("process") * F.col("outward")}
        amounts = amounts.unionByName(twins.select(*of, "shared", *[(-amount).alias(name) for name, amount in theirs.items()]))
    sums = amounts.groupBy(*of).agg(
        *[F.sum(F.when(F.col("shared") == m, F.col(name)).otherwise(0)).alias(f"{name}_{m}") for m in sets for name in pairs])

    def exactly(name: str, m: int) -> Column:
        return sum((F.col(f"{name}_{t}") * (-1) ** (t ^ m).bit_count() for t in sets if t & m == m), F.lit(0))

    counts = {name: F.lit(0) for name in (*CORRELATION_TYPES, *CONFIDENCE_BANDS)}
    for m in sets:
        every, untyped = exactly("n", m), exactly("untyped", m)
        file, outward = (exactly(c, m) if m & 1 else F.lit(0) for c in ("file", "outward"))
        rest = every - file - outward
        # A process and a file event are both untyped, an outward connection never is.
        by_address = F.lit(0) if m & 2 or not m & 4 else every - untyped - outward
        by_type = {"CORR-004": file, "CORR-005": outward, "CORR-002": rest if m & 2 else F.lit(0), "CORR-003": by_address,
                   "CORR-001": rest - by_address if m & 1 and not m & 2 else F.lit(0)}
        confidence = p.weight_time
        for c, bit in parts.items():
            confidence += weights[c] if m & bit else 0.0
        band = P.confidence_band(F.lit(round(min(confidence, 1.0), 4)))
        for t, amount in by_type.items():
            counts[t] = counts[t] + amount
        for b in CONFIDENCE_BANDS:
            counts[b] = counts[b] + F.when(band == b, sum(by_type.values(), F.lit(0))).otherwise(0)
    names = {**{t: t.replace("-", "_").lower() for t in CORRELATION_TYPES}, **{b: f"band_{b.lower()}" for b in CONFIDENCE_BANDS}}
    return dated.groupBy(*of).agg(F.count("*").alias("dated_events")).join(sums, of, "left").select(
        *of, "dated_events", F.coalesce(sum((counts[t] for t in CORRELATION_TYPES), F.lit(0)), F.lit(0)).cast("bigint").alias("links"),
        *[F.coalesce(counts[k], F.lit(0)).cast("bigint").alias(name) for k, name in names.items()])


def link_counts(events: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """A7 without a cap: per case all links by type and band, and no pair is built.

    A pair's type and confidence follow from which of {host, user, address} it
    shares and from its two event classes. For each of the seven subsets, pairs
    that agree on it (and maybe on more) are counted from sliding sums per
    instant; inclusion and exclusion over the supersets leaves the pairs that
    agree on exactly that subset. Rows are folded to one per (values, instant)
    before they are repeated for the subsets, and a task holds the instants of
    two time slices of one value at most. Events without time or without any
    value link to nothing; their case is listed with zeros.
    """
    return _link_counts(dated_events(events), ["case_id"], p)


def link_totals(events: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """``link_counts`` as ``links`` without a limit would count them: a row that comes twice does not link to itself."""
    return _link_counts(dated_events(events), ["case_id"], p, apart=True)


def component_links(events: DataFrame, components: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """(case_id, component, link_count, types) of all links, and no pair is built; both ends of a link are in one component."""
    dated = dated_events(events).join(components, ["case_id", "id"])
    counts = _link_counts(dated, ["case_id", "component"], p, apart=True)
    types = F.array_compact(F.array(*[F.when(F.col(t.replace("-", "_").lower()) > 0, t) for t in CORRELATION_TYPES]))
    return counts.select("case_id", "component", F.col("links").alias("link_count"), types.alias("types"))
