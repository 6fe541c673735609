"""Activity groups: connected components over links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.operators.ranking import first_or_all, stored_first_or_all
from tracemill.operators.slices import (
    nearest_preceding,
    next_instant,
    slice_of,
)
from tracemill.schema import LinkParams
from tracemill.session import reliable_checkpoint
from tracemill.wording import CORRELATION_NOTE

# Words for single-source groups in the explanation.
SOURCE_WORDS = {
    "authentication": "authentication", "process": "process", "file_activity": "file-activity",
    "network": "network", "browser": "browser", "system": "system", "generic": "generic",
}


def _case_components(edges: pd.DataFrame) -> pd.DataFrame:
    """Components of one case's capped links; the label is the smallest event id."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(edges["event_a_id"].tolist(), edges["event_b_id"].tolist()):
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    ids = sorted(parent)
    return pd.DataFrame(
        {"case_id": edges["case_id"].iloc[0], "id": ids, "component": [root(i) for i in ids]}
    )


def link_components(found: DataFrame) -> DataFrame:
    """(case_id, id, component) over capped links.

    The link cap bounds a case at ``max_links`` edges, so one small task per
    case settles it; cases run in parallel. Uncapped data goes through
    ``session_components``.
    """
    return (
        found.select("case_id", "event_a_id", "event_b_id")
        .groupBy("case_id")
        .applyInPandas(_case_components, "case_id string, id long, component long")
    )


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge list (src, dst) of any size.

    Alternating large-star and small-star steps: each needs one minimum per
    node and one join, so a hub is never gathered, and the number of rounds
    grows with the logarithm of the graph, not with its diameter. The steps
    keep the components, so the work is done when every edge points at a node
    without an edge of its own. Lineage is cut each round; only the answer to
    that test reaches the driver.
    """
    cur = reliable_checkpoint(edges.select("src", "dst").filter("src <> dst").distinct())
    while True:
        both = cur.unionByName(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = (
            both.join(low, "src").filter(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        )
        small_low = large.groupBy("src").agg(F.min("dst").alias("m"))
        cur = reliable_checkpoint(
            large.join(small_low, "src")
            .select(F.explode(F.array(
                F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")),
                F.struct(F.col("src"), F.col("m").alias("dst")))).alias("e"))
            .select("e.src", "e.dst").filter("src <> dst").distinct()
        )
        inner = cur.join(cur.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        if inner.isEmpty():
            break
    return cur.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        cur.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )


def _sessions(points: DataFrame, keys: list[str], span_us: int) -> DataFrame:
    """Start of the gap session of every (key, instant).

    Whether an instant opens a session is decided within two slices; the start
    is then carried over slices, one row per (key, slice).
    """
    # Backwards in time the next instant is the one before; none near means a new session.
    mirrored = points.withColumn("us", -F.col("us"))
    prev = next_instant(mirrored, keys, "us", span_us, {"prev_us": "us"}).withColumn("us", -F.col("us"))
    own = slice_of(F.col("us"), span_us)
    marked = prev.withColumn("opens", F.when(F.col("prev_us").isNull(), F.col("us"))).withColumn("slice", own)
    last_open = (
        marked.groupBy(*keys, "slice").agg(F.max("opens").alias("last_open"))
        .withColumn(
            "carried",
            F.last("last_open", ignorenulls=True).over(
                Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
    )
    inside = F.max("opens").over(
        Window.partitionBy(*keys, "slice").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        marked.withColumn("inside", inside)
        .join(last_open.select(*keys, "slice", "carried"), [*keys, "slice"])
        .select(*keys, "us", F.coalesce("inside", "carried").alias("session_us"))
    )


def session_components(dated: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Components of *all* links of any size, without building a pair.

    Events of one host (or user) link whenever they lie within the window, so
    their links connect exactly the gap sessions. In an address group the
    authentication and network events form sessions the same way and every
    other event hangs on the nearest such event before and after it. The
    result graph has sessions as nodes and at most three edges per event.
    ``dated`` comes from ``links.dated_events``.
    """
    span = window_seconds * 1_000_000
    strong = F.col("source_type").isin("authentication", "network")
    kinds = {
        "host": dated.filter(F.col("host").isNotNull()),
        "user": dated.filter(F.col("user").isNotNull()),
        "source_ip": dated.filter(F.col("source_ip").isNotNull() & strong),
    }
    node = lambda kind, value, start: F.concat_ws("|", F.lit(kind), "case_id", value, start)
    labelled = {}
    for kind, rows in kinds.items():
        points = rows.select("case_id", kind, "us").distinct()
        labelled[kind] = _sessions(points, ["case_id", kind], span).select(
            "case_id", kind, "us", node(kind, F.col(kind), F.col("session_us")).alias("node")
        )
    attach = [
        kinds[k].select("case_id", "id", k, "us").join(labelled[k], ["case_id", k, "us"])
        .select("case_id", "id", "node")
        for k in kinds
    ]
    weak = dated.filter(F.col("source_ip").isNotNull() & ~strong).select("case_id", "id", "source_ip", "us")
    instants = weak.select("case_id", "source_ip", "us").distinct()
    ip_nodes = labelled["source_ip"]
    before = nearest_preceding(instants, ip_nodes, ["case_id", "source_ip"], "us", span, "node")
    mirrored = nearest_preceding(
        instants.withColumn("us", -F.col("us")), ip_nodes.withColumn("us", -F.col("us")),
        ["case_id", "source_ip"], "us", span, "node",
    ).withColumn("us", -F.col("us"))
    for side in (before, mirrored):
        attach.append(
            weak.join(side.select("case_id", "source_ip", "us", "node"), ["case_id", "source_ip", "us"])
            .select("case_id", "id", "node")
        )
    memberships = attach[0]
    for more in attach[1:]:
        memberships = memberships.unionByName(more)
    memberships = reliable_checkpoint(memberships)
    anchor = memberships.groupBy("case_id", "id").agg(F.min("node").alias("anchor"))
    edges = memberships.join(anchor, ["case_id", "id"]).select(
        F.col("node").alias("src"), F.col("anchor").alias("dst")
    )
    labels = star_components(edges)
    roots = (
        anchor.join(labels, anchor["anchor"] == labels["node"], "left")
        .select("case_id", "id", F.coalesce("component", "anchor").alias("component"))
    )
    sizes = roots.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("label"))
    return roots.join(sizes.filter("n > 1"), "component").select(
        "case_id", "id", F.col("label").alias("component")
    )


def groups(
    events: DataFrame,
    found: DataFrame,
    components: DataFrame,
    tags: DataFrame | None = None,
    p: LinkParams = LinkParams(),
    counts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(groups, members): one row per group, and its members in long form.

    ``tags`` holds (case_id, event_uid, severity) of findings; ``events`` may
    carry ``is_anomalous``. ``counts`` (``links.component_links``) stands for
    all links of the components; ``found`` is not read then and no uids are listed.
    """
    ev = events.select(
        "case_id", "id", "event_uid", "evidence_id", "timestamp", "source_type", "user", "host",
        "source_ip", "destination_ip", "process",
        (F.col("is_anomalous") if "is_anomalous" in events.columns else F.lit(False)).alias("is_anomalous"),
    )
    grouped = ev.join(components, ["case_id", "id"])
    key = ["case_id", "component"]
    kept = stored_first_or_all(
        grouped, key, [F.asc("timestamp"), F.asc("id")], p.max_members, rank="position"
    )
    kinds = kept.groupBy(*key).agg(
        F.count("*").alias("members"),
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end"),
        F.when(F.min("source_type") == F.max("source_type"), F.min("source_type")).alias("only_source"),
        F.max("is_anomalous").alias("anomalous"),
        F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"),
    ).filter("members >= 2").withColumn(
        "kind",
        F.when(F.col("only_source").isin("authentication", "process", "file_activity", "network"),
               F.col("only_source")).otherwise("cross_source"),
    )
    filled = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs[:-1]], F.lit(cs[-1]))
    subject = (
        F.when(F.col("kind") == "authentication", filled("user", "host", "source_ip", "unknown"))
        .when(F.col("kind") == "process", F.lower(filled("process", "unknown process")))
        .when(F.col("kind") == "file_activity", filled("host", "user", "unattributed"))
        .when(F.col("kind") == "network", filled("destination_ip", "source_ip", "external"))
        .otherwise(F.nullif(F.col("user"), F.lit("")))
    )
    dominant = (
        kept.join(kinds.select(*key, "kind"), key)
        .withColumn("subject", subject).filter(F.col("subject").isNotNull())
        .groupBy(*key, "subject").count()
        .groupBy(*key).agg(F.min(F.struct(-F.col("count"), F.col("subject"))).alias("best"))
        .select(*key, F.col("best.subject").alias("subject"))
    )
    if counts is not None:
        inner = counts.withColumn("correlation_uids", F.array().cast("array<string>"))
    else:
        ends = kept.select("case_id", "id", "component")
        inner = (
            found.join(ends.select("case_id", F.col("id").alias("event_a_id"), "component"), ["case_id", "event_a_id"])
            .join(
                ends.select("case_id", F.col("id").alias("event_b_id"), F.col("component").alias("component_b")),
                ["case_id", "event_b_id"],
            )
            .filter(F.col("component") == F.col("component_b"))
            .groupBy(*key)
            .agg(
                F.count("*").alias("link_count"),
                F.sort_array(F.collect_set("correlation_type")).alias("types"),
                F.sort_array(F.collect_list("correlation_uid")).alias("correlation_uids"),
            )
        )
    base = kinds.join(dominant, key, "left").join(inner, key, "left")
    if tags is not None:
        worst = (
            kept.join(tags.select("case_id", "event_uid", "severity"), ["case_id", "event_uid"])
            .groupBy(*key).agg(F.max(P.severity_rank(F.col("severity"))).alias("worst"))
        )
        base = base.join(worst, key, "left")
    else:
        base = base.withColumn("worst", F.lit(None).cast("int"))
    title = (
        F.when(F.col("kind") == "authentication", F.concat(F.lit("Authentication cluster — "), "subject"))
        .when(F.col("kind") == "process", F.concat(F.lit("Process execution cluster — "), "subject"))
        .when(F.col("kind") == "file_activity", F.concat(F.lit("File activity burst — "), "subject"))
        .when(F.col("kind") == "network", F.concat(F.lit("External connection cluster — "), "subject"))
        .otherwise(F.concat(F.lit("Cross-source activity group — "),
                            F.coalesce("subject", F.lit("multiple sources"))))
    )
    word = F.coalesce(P.lookup(F.col("only_source"), SOURCE_WORDS), F.lit("cross-source"))
    explanation = F.concat(
        F.col("members").cast("string"), F.lit(" "), word, F.lit(" event(s) between "),
        P.stamp("time_start"), F.lit(" and "), P.stamp("time_end"), F.lit(" linked by "),
        F.coalesce("link_count", F.lit(0)).cast("string"), F.lit(" correlation(s) ("),
        F.array_join(F.coalesce("types", F.array().cast("array<string>")), ", "),
        F.lit(f") inside the {p.window_seconds}-second window. {CORRELATION_NOTE}"),
    )
    severity = (
        F.when(F.col("worst").isNotNull(), P.severity_of_rank(F.col("worst")))
        .when(F.col("anomalous"), "Medium").otherwise("Low")
    )
    titled = base.select(
        *key, "kind", title.alias("title"), severity.alias("severity"), explanation.alias("explanation"),
        "time_start", "time_end", "members", F.coalesce("link_count", F.lit(0)).alias("link_count"),
        "correlation_uids", "evidence_ids",
    )
    top = first_or_all(
        titled, ["case_id"],
        [F.asc("time_start"), F.desc("members"), F.asc("title"), F.asc("component")],
        p.max_groups, rank="group_rank",
    ).withColumn("group_uid", P.uid("GRP-", F.col("group_rank")))
    out = reliable_checkpoint(top)
    members = kept.join(out.select(*key, "group_uid"), key).select(
        "case_id", "group_uid", "component", "position", "id", "event_uid", "timestamp"
    )
    return out, members
