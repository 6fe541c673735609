"""The seven detection rules (R1-R8) as skew-safe aggregations.

Each rule yields *candidates*, one row per (case, rule, scope), with the member
range of the finding; ``run_rules`` caps them per rule and case, and only then
joins members and spells out the text. Members stay in long form
(``finding_events``), never as an array, because one finding may cover a third
of all events.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.functions.network import external_ip
from tracemill.operators.ranking import first_or_all
from tracemill.operators.slices import (
    nearest_preceding,
    next_instant,
    sliding,
    top_k_per_group,
)
from tracemill.schema import RuleParams
from tracemill.session import parquet_stage, reliable_checkpoint, small_side

MINUTE_US = 60_000_000
SCOPE = ["case_id", "scope_a", "scope_b"]

# Rule titles and descriptions shown with findings.
TITLES = {
    "AUTH-001": "Repeated failed logins followed by a successful login",
    "AUTH-002": "Authentication events from an unusual external source IP",
    "AUTH-003": "Rapid login sequence from two distinct source addresses",
    "PROC-001": "Scripting or interpreter process execution",
    "FILE-001": "Mass file modifications in a short window",
    "FILE-002": "Rapid file rename burst",
    "NET-001": "External connection shortly after process execution",
}
DEFAULT_SEVERITY = {
    "AUTH-001": "High", "AUTH-002": "Medium", "AUTH-003": "Low", "PROC-001": "Medium",
    "FILE-001": "Medium", "FILE-002": "High", "NET-001": "Medium",
}


@dataclass(frozen=True)
class RuleOutput:
    """Findings (one row each), their supporting events and named values (long form)."""

    findings: DataFrame
    finding_events: DataFrame
    finding_values: DataFrame


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _candidate(df: DataFrame, rule_id: str, **cols: Column) -> DataFrame:
    """Project to the common candidate shape."""
    shape = {
        "severity": F.lit(DEFAULT_SEVERITY[rule_id]),
        "n": F.col("n").cast("long"),
        "start_us": F.col("start_us"),
        "end_us": F.col("end_us"),
        "lo_us": F.lit(None).cast("long"),
        "hi_us": F.lit(None).cast("long"),
        "id_1": F.lit(None).cast("long"),
        "id_2": F.lit(None).cast("long"),
        **cols,
    }
    return df.select(
        *SCOPE, F.lit(rule_id).alias("rule_id"), *[c.alias(name) for name, c in shape.items()]
    )


# --- one pass over the events: what each can mean to each rule -----------------------

KEPT = ["id", "event_uid", "evidence_id", "timestamp", "us", "action", "process", "file_path", "destination_ip", "user", "source_ip"]


def _roles() -> dict[str, list[tuple[str, Column, Column, Column]]]:
    """Per rule the roles an event can have: (role, condition, scope_a, scope_b)."""
    source = lambda kind: F.col("source_type") == kind
    dated = F.col("timestamp").isNotNull()
    login = source("authentication") & (_text("user") != "") & P.is_login() & dated
    user, address, host, nobody = F.col("user"), F.col("source_ip"), _text("host"), F.lit("")
    script = source("process") & (F.trim(_text("process")) != "") & (P.is_script_host(F.col("process")) | (F.size("tokens") > 0))
    touched = source("file_activity") & (_text("file_path") != "") & dated
    return {
        "AUTH-001": [("failure", login & P.is_failure(), user, nobody), ("success", login & P.is_success(), user, nobody)],
        "AUTH-002": [("all", source("authentication") & external_ip(address), address, nobody)],
        "AUTH-003": [("login", login & (_text("source_ip") != ""), user, nobody)],
        "PROC-001": [("all", script, host, _text("user"))],
        "FILE-001": [("range", touched & P.is_modify(), host, _text("user"))],
        "FILE-002": [("range", touched & P.is_rename(), host, _text("user"))],
        "NET-001": [("connection", source("network") & external_ip(F.col("destination_ip")) & dated, host, nobody),
                    ("process", source("process") & dated, host, nobody)],
    }


def tag(events: DataFrame, p: RuleParams = RuleParams(), only: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per event, rule and role: the only read of the events, stored sorted by rule.

    ``only`` names rules; otherwise all enabled ones are tagged.
    """
    line = F.try_element_at("metadata", F.lit("command_line"))
    # Tokens come from a function over arrays, which runs outside generated code: only processes need them.
    found = F.when(F.col("source_type") == "process", P.command_tokens(line))
    known = events.withColumns({"us": P.micros(F.col("timestamp")), "tokens": found})
    spots = [
        F.when(condition, F.struct(F.lit(rid).alias("rule_id"), F.lit(role).alias("role"), a.alias("scope_a"), b.alias("scope_b")))
        for rid, roles in _roles().items() if rid in (only or set(RULES) - p.disabled)
        for role, condition, a, b in roles
    ]
    if not spots:
        spots = [F.lit(None).cast("struct<rule_id:string,role:string,scope_a:string,scope_b:string>")]
    # Roles an event does not have go after the explode: as a function over arrays, array_compact takes its whole input out of generated code.
    tagged = known.withColumn("_t", F.explode(F.array(*spots))).filter(F.col("_t").isNotNull()).select(
        "case_id", "_t.rule_id", "_t.role", "_t.scope_a", "_t.scope_b", *KEPT,
        F.when(F.col("_t.rule_id") == "PROC-001", F.col("tokens")).alias("tokens"))
    return parquet_stage(tagged.sortWithinPartitions("rule_id", "role"))


def of(tags: DataFrame, rule_id: str, role: str | None = None) -> DataFrame:
    """A rule's rows; the filter reaches the stored files."""
    rows = tags.filter(F.col("rule_id") == rule_id)
    return rows if role is None else rows.filter(F.col("role") == role)


# --- candidates -----------------------------------------------------------------


def spans(p: RuleParams) -> dict[str, int]:
    """Microseconds of the window that a rule counts in."""
    return {"AUTH-001": p.auth001_window_minutes * MINUTE_US, "FILE-001": p.file001_window_minutes * MINUTE_US,
            "FILE-002": p.file002_window_minutes * MINUTE_US}


def windows_ahead(tags: DataFrame, p: RuleParams) -> DataFrame:
    """Rows of a rule in the window that starts at each instant, for all rules that count in one: one kernel, the span a column.

    Instants of AUTH-001 count failures and hold the first success of the instant.
    """
    counted = F.count_if(F.col("role") != "success")
    points = tags.filter(F.col("rule_id").isin(*spans(p))).groupBy("rule_id", *SCOPE, "us").agg(
        counted.alias("c"), F.min(F.when(F.col("role") == "success", F.col("id"))).alias("success_id"))
    points = points.withColumn("span", P.lookup(F.col("rule_id"), spans(p)).cast("long"))
    return sliding(points, ["rule_id", *SCOPE], "us", F.col("span"), "c", edge="last_us")


def auth001(ahead: DataFrame, p: RuleParams) -> DataFrame:
    """Failures before a success (High), else a failure burst (Medium).

    Both branches count failures per instant, then slide over instants.
    """
    after = ahead.filter("rule_id = 'AUTH-001'").withColumnRenamed("c", "failures")
    points = after.select(*SCOPE, "us", "failures", "success_id")
    before = sliding(points, SCOPE, "us", spans(p)["AUTH-001"], "failures", edge="first_us", forward=False)
    # Most failures first; among equals the earliest instant.
    best_success = reliable_checkpoint(
        before.filter(F.col("success_id").isNotNull() & (F.col("n") >= p.auth001_min_failures))
        .groupBy(*SCOPE)
        .agg(F.max(F.struct("n", (-F.col("us")).alias("neg"), "success_id", "first_us")).alias("b"))
        .select(
            *SCOPE,
            (F.col("b.n") + 1).alias("n"),
            F.col("b.first_us").alias("start_us"),
            (-F.col("b.neg")).alias("end_us"),
            F.col("b.success_id").alias("id_1"),
        )
    )
    best_burst = (
        after.filter((F.col("failures") > 0) & (F.col("n") >= p.auth001_min_failures))
        .groupBy(*SCOPE)
        .agg(F.max(F.struct("n", (-F.col("us")).alias("neg"), "last_us")).alias("b"))
        .select(
            *SCOPE,
            F.col("b.n").alias("n"),
            (-F.col("b.neg")).alias("start_us"),
            F.col("b.last_us").alias("end_us"),
        )
    )
    high = _candidate(
        best_success, "AUTH-001",
        lo_us=F.col("start_us"), hi_us=F.col("end_us"), id_1=F.col("id_1"),
    )
    medium = _candidate(
        best_burst.join(best_success.select(*SCOPE), SCOPE, "left_anti"), "AUTH-001",
        severity=F.lit("Medium"), lo_us=F.col("start_us"), hi_us=F.col("end_us"),
    )
    return high.unionByName(medium)


def auth002(tags: DataFrame, p: RuleParams) -> DataFrame:
    """R2: enough authentication events from one external address."""
    counted = (
        of(tags, "AUTH-002")
        .groupBy(*SCOPE)
        .agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
        .filter(F.col("n") >= p.auth002_min_external_logins)
    )
    return _candidate(counted, "AUTH-002")


def auth003(tags: DataFrame, p: RuleParams) -> DataFrame:
    """First pair of consecutive logins close in time from two addresses.

    Logins are folded to one row per instant (first and last login of it), so
    consecutive logins are either neighbours inside an instant or the last of
    one instant and the first of the next.
    """
    span = p.auth003_window_seconds * 1_000_000
    logins = of(tags, "AUTH-003")
    instants = logins.groupBy(*SCOPE, "us").agg(
        F.min(F.struct("id", "source_ip")).alias("first"),
        F.max(F.struct("id", "source_ip")).alias("last"),
        (F.min("source_ip") != F.max("source_ip")).alias("mixed"),
    )
    nxt = next_instant(instants, SCOPE, "us", span, {"next_us": "us", "next_first": "first"})
    across = F.coalesce(F.col("last.source_ip") != F.col("next_first.source_ip"), F.lit(False))
    hit = reliable_checkpoint(
        nxt.filter(F.col("mixed") | across)
        .groupBy(*SCOPE)
        .agg(
            F.min(
                F.struct(
                    "us", "mixed", "first",
                    F.col("last.id").alias("id_1"),
                    F.col("next_first.id").alias("id_2"),
                    "next_us",
                )
            ).alias("h")
        )
    )
    apart = hit.filter(~F.col("h.mixed")).select(
        *SCOPE, F.col("h.us").alias("start_us"), F.col("h.next_us").alias("end_us"),
        F.col("h.id_1").alias("id_1"), F.col("h.id_2").alias("id_2"),
    )
    # Inside one instant: the first login from another address, and the login before it.
    same = hit.filter("h.mixed").select(*SCOPE, F.col("h.us").alias("us"), F.col("h.first").alias("first"))
    inside = logins.select(*SCOPE, "us", "id", "source_ip").join(same, [*SCOPE, "us"])
    second = inside.groupBy(*SCOPE, "us").agg(
        F.min(F.when(F.col("source_ip") != F.col("first.source_ip"), F.col("id"))).alias("id_2")
    )
    together = (
        inside.join(second, [*SCOPE, "us"])
        .groupBy(*SCOPE, "us", "id_2")
        .agg(F.max(F.when(F.col("id") < F.col("id_2"), F.col("id"))).alias("id_1"))
        .select(*SCOPE, F.col("us").alias("start_us"), F.col("us").alias("end_us"), "id_1", "id_2")
    )
    both = apart.unionByName(together).withColumn("n", F.lit(2))
    return _candidate(both, "AUTH-003", id_1=F.col("id_1"), id_2=F.col("id_2"))


def proc001(tags: DataFrame, p: RuleParams) -> DataFrame:
    """Scripting or interpreter processes per host and user."""
    counted = (
        of(tags, "PROC-001")
        .groupBy(*SCOPE)
        .agg(
            F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"),
            F.max(F.size("tokens") > 0).alias("indicators"),
        )
    )
    return _candidate(
        counted, "PROC-001",
        severity=F.when(F.col("indicators"), F.lit("High")).otherwise(F.lit("Medium")),
    )


def _densest(ahead: DataFrame, rule_id: str, least: int) -> DataFrame:
    """Densest forward window per scope; among equals the one starting latest."""
    return (
        ahead.filter((F.col("rule_id") == rule_id) & (F.col("n") >= least))
        .groupBy(*SCOPE)
        .agg(F.max(F.struct("n", "us", "last_us")).alias("b"))
        .select(
            *SCOPE, F.col("b.n").alias("n"), F.col("b.us").alias("start_us"),
            F.col("b.last_us").alias("end_us"),
        )
    )


def file001(ahead: DataFrame, p: RuleParams) -> DataFrame:
    """Mass modification."""
    best = _densest(ahead, "FILE-001", p.file001_min_modifications)
    return _candidate(
        best, "FILE-001",
        severity=F.when(F.col("n") >= p.file001_high_min, F.lit("High")).otherwise(F.lit("Medium")),
        lo_us=F.col("start_us"), hi_us=F.col("end_us"),
    )


def file002(ahead: DataFrame, p: RuleParams) -> DataFrame:
    """Rename burst."""
    best = _densest(ahead, "FILE-002", p.file002_min_renames)
    return _candidate(best, "FILE-002", lo_us=F.col("start_us"), hi_us=F.col("end_us"))


def process_before_connection(tags: DataFrame, p: RuleParams) -> DataFrame:
    """The latest process instant within the window before each connection instant."""
    connections = of(tags, "NET-001", "connection").groupBy(*SCOPE, "us").agg(F.count("*").alias("c"))
    processes = of(tags, "NET-001", "process").groupBy(*SCOPE, "us").agg(F.min("id").alias("process_id"))
    hits = nearest_preceding(
        connections, processes, SCOPE, "us", p.net001_window_minutes * MINUTE_US, "process_id"
    )
    return hits.join(connections, [*SCOPE, "us"])


def net001(tags: DataFrame, p: RuleParams) -> DataFrame:
    """External connections soon after a process on the host."""
    counted = (
        process_before_connection(tags, p)
        .groupBy(*SCOPE)
        .agg(
            F.sum("c").alias("n"), F.min("matched_us").alias("start_us"), F.max("us").alias("end_us")
        )
        .filter(F.col("n") >= p.net001_min_connections)
    )
    return _candidate(counted, "NET-001")


RULES = {
    "AUTH-001": auth001, "AUTH-002": auth002, "AUTH-003": auth003, "PROC-001": proc001,
    "FILE-001": file001, "FILE-002": file002, "NET-001": net001,
}


def candidates_of(tags: DataFrame, p: RuleParams = RuleParams(), only: tuple[str, ...] = ()) -> DataFrame:
    """All enabled (or the named) rules over tagged rows, uncapped."""
    ids = [rid for rid in RULES if (rid in only if only else rid not in p.disabled)]
    ahead = reliable_checkpoint(windows_ahead(tags, p)) if set(ids) & set(spans(p)) else None
    found = [RULES[rid](ahead if rid in spans(p) else tags, p) for rid in ids]
    return reduce(DataFrame.unionByName, found) if found else _candidate(tags.filter("false").withColumns(
        {"n": F.lit(0), "start_us": F.col("us"), "end_us": F.col("us")}), "AUTH-001")


def candidates(events: DataFrame, p: RuleParams = RuleParams(), only: tuple[str, ...] = ()) -> DataFrame:
    """All enabled (or the named) rules over events, uncapped; the events are read once."""
    return candidates_of(tag(events, p, only), p, only)


def cap_candidates(found: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """The earliest findings per case and rule, or all of them, ranked, where the limit is None."""
    order = [F.asc_nulls_first("start_us"), F.asc("scope_a"), F.asc("scope_b")]
    return first_or_all(
        found, ["case_id", "rule_id"], order, p.max_findings_per_rule, rank="rule_rank",
    )


def members(tags: DataFrame, found: DataFrame, p: RuleParams) -> DataFrame:
    """Supporting events of the given candidates: (case, rule, scope, event).

    One equi join of the tagged rows on rule and scope plus a range test picks
    the members. For NET-001 they are the paired connections and processes.
    """
    want = found.select(*SCOPE, "rule_id", "lo_us", "hi_us", "id_1", "id_2")
    picked = F.coalesce(F.col("id") == F.col("id_1"), F.lit(False)) | F.coalesce(F.col("id") == F.col("id_2"), F.lit(False))
    inside = (
        F.when(F.col("role") == "all", True)
        .when(F.col("role").isin("range", "failure"), F.col("us").between(F.col("lo_us"), F.col("hi_us")))
        .otherwise(picked)
    )
    shape = [*SCOPE, "rule_id", *KEPT, "role", "tokens"]
    out = tags.filter("rule_id <> 'NET-001'").join(want, [*SCOPE, "rule_id"]).filter(inside).select(*shape)
    if "NET-001" not in p.disabled:
        net = found.filter(F.col("rule_id") == "NET-001").select(*SCOPE)
        pairs = process_before_connection(tags, p).join(net, SCOPE)
        connections = of(tags, "NET-001", "connection").join(pairs.select(*SCOPE, "us"), [*SCOPE, "us"], "left_semi")
        process_ids = pairs.select("case_id", F.col("process_id").alias("id")).distinct()
        processes = of(tags, "NET-001", "process").join(process_ids, ["case_id", "id"], "left_semi")
        out = out.unionByName(connections.select(*shape)).unionByName(processes.select(*shape))
    return out


# A text spells out the first of these and ends in "…" beyond
# them; every other list is whole.
_LISTED = {"files": 5, "destinations": 4}
_FIRST = {**_LISTED, "addresses": 2}


def finding_values(member_rows: DataFrame) -> DataFrame:
    """Every distinct value behind a finding's text, in long form and whole."""
    rid = F.col("rule_id")
    role = F.col("role")
    def facet(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.alias("value"))

    # Addresses sort by login time, so the text names them in order.
    when_from = F.concat(F.lpad(F.col("us").cast("string"), 20, "0"), F.lit(" "), F.col("source_ip"))
    action = F.lower(F.coalesce(F.nullif(F.col("action"), F.lit("")), F.lit("unknown")))
    net_process = (rid == "NET-001") & (role == "process")
    net_connection = (rid == "NET-001") & (role == "connection")
    pick = F.array_compact(
        F.concat(
            F.array(
                F.when(rid == "AUTH-002", facet("actions", action)),
                F.when(rid == "AUTH-003", facet("addresses", when_from)),
                F.when((rid == "PROC-001") | net_process, facet("processes", F.lower(_text("process")))),
                F.when(rid.startswith("FILE"), facet("files", F.col("file_path"))),
                F.when(net_connection, facet("destinations", F.col("destination_ip"))),
                F.when((rid == "NET-001") & (_text("user") != ""), facet("users", F.col("user"))),
            ),
            F.transform(
                F.coalesce("tokens", F.array().cast("array<string>")), lambda t: facet("tokens", t)
            ),
        )
    )
    key = [*SCOPE, "rule_id"]
    values = (
        member_rows.select(*key, F.explode(pick).alias("f"))
        .groupBy(*key, F.col("f.facet").alias("facet"), F.col("f.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return values


def _facets(values: DataFrame) -> DataFrame:
    """What the texts spell out, as one map row per finding.

    Of files, destinations and addresses only the first are gathered, by a
    two-level top-k; names, tokens and actions are distinct already, and whole.
    The totals are counted.
    """
    key = [*SCOPE, "rule_id"]
    cut = F.col("facet").isin(*_FIRST)
    first = top_k_per_group(values.filter(cut), [*key, "facet"], [F.asc("value")], max(_FIRST.values())).drop("rank")
    shown = first.unionByName(values.filter(~cut))
    lists = shown.groupBy(*key, "facet").agg(
        F.sort_array(F.collect_list(F.struct("value", "n"))).alias("items")
    )
    counts = values.groupBy(*key, "facet").agg(F.count("*").alias("total"))
    return (
        lists.join(counts, [*key, "facet"])
        .groupBy(*key)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("facet", "items"))).alias("lists"),
            F.map_from_entries(F.collect_list(F.struct("facet", "total"))).alias("totals"),
        )
    )


def _total(facet: str) -> Column:
    return F.coalesce(F.try_element_at("totals", F.lit(facet)), F.lit(0))


def _joined(facet: str, sep: str = ", ") -> Column:
    items = F.coalesce(
        F.try_element_at("lists", F.lit(facet)), F.array().cast("array<struct<value:string,n:bigint>>")
    )
    if facet in _LISTED:
        items = F.slice(items, 1, _LISTED[facet])
    return F.array_join(F.transform(items, lambda i: i["value"]), sep)


def _more(facet: str) -> Column:
    return F.when(_total(facet) > _LISTED[facet], F.lit("…")).otherwise(F.lit(""))


def _texts(p: RuleParams) -> tuple[Column, Column]:
    """Explanation and reasons of a finding, by rule. Wording is a fixed value."""
    n = F.col("n").cast("string")
    a, b = F.col("scope_a"), F.col("scope_b")
    review = "requires investigator review."
    fails = (F.col("n") - 1).cast("string")
    m1 = str(p.auth001_window_minutes)
    actions = F.array_join(
        F.transform(F.try_element_at("lists", F.lit("actions")),
                    lambda i: F.concat(i["value"], F.lit("="), i["n"].cast("string"))), ", ")
    addresses = F.transform(
        F.try_element_at("lists", F.lit("addresses")), lambda i: F.substring(i["value"], 22, 64))
    first_ip, second_ip = F.get(addresses, F.lit(0)), F.get(addresses, F.lit(1))
    host = F.when(a != "", a).otherwise("unknown host")
    user = F.when(b != "", b).otherwise("unknown user")
    tokens, procs = _joined("tokens"), _joined("processes")
    scope = F.concat_ws(
        " / ", F.when(a != "", F.concat(F.lit("host "), a)), F.when(b != "", F.concat(F.lit("user "), b)))
    scope = F.when(scope != "", scope).otherwise("unattributed scope")
    files = _total("files").cast("string")

    def say(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    high = F.col("severity") == "High"
    by_rule = {
        "AUTH-001": (
            F.when(high, say(a, " had ", fails, " failed login attempts before a successful login within ",
                             m1, " minutes. This pattern is potentially suspicious and ", review))
            .otherwise(say(a, " had ", n, " failed login attempts within ", m1, " minutes and no subsequent "
                           "success was observed in the case dataset. Requires investigator review.")),
            F.array(F.when(high, say(fails, " failed login(s) followed by a successful login."))
                    .otherwise(say(n, " failed login(s) in a single window without success."))),
        ),
        "AUTH-002": (
            say(n, " authentication events originate from external source IP ", a, ". 'External' is defined "
                "as an address outside RFC1918 private space that is otherwise unobserved as a source in "
                "this case's dataset. This is a statistical observation, not a claim of malicious activity; ",
                review),
            F.array(say(n, " authentication event(s) from ", a, " (", actions, ").")),
        ),
        "AUTH-003": (
            say(a, f" performed two logins within {p.auth003_window_seconds} seconds from different source "
                "addresses (", first_ip, " and ", second_ip, "). Rapid multi-origin logins are an improbable "
                "pattern and require investigator review."),
            F.array(F.lit("Login events from two different source addresses within "
                          f"{p.auth003_window_seconds} seconds.")),
        ),
        "PROC-001": (
            say(n, " scripting/interpreter process event(s) for user ", user, " on ", host,
                F.when(tokens != "", say(" carrying evasion indicators (", tokens, ").")).otherwise("."),
                " Script execution is common in administration but is also used to evade controls — "
                "potentially suspicious and ", review),
            F.array_compact(F.array(
                say("Process(es) observed: ", procs, " on ", host, " (user ", user, ")."),
                F.when(tokens != "", say("Command-line indicators present: ", tokens, " — elevated severity.")))),
        ),
        "FILE-001": (
            say(n, " file modification events for ", scope, f" within {p.file001_window_minutes} minutes, "
                "touching ", files, " distinct file path(s). High-volume file activity is a potentially "
                "suspicious pattern that ", review),
            F.array_compact(F.array(
                say(n, f" file modification(s) (>= {p.file001_min_modifications}) in a "
                    f"{p.file001_window_minutes}-minute window."),
                F.when(high, F.lit(f"Volume reached the high threshold ({p.file001_high_min}).")),
                say("Files involved: ", _joined("files"), _more("files"), "."))),
        ),
        "FILE-002": (
            say(n, " file rename events for ", scope, f" within {p.file002_window_minutes} minutes, affecting ",
                files, " distinct path(s). Rapid rename activity is potentially suspicious and ", review),
            F.array(
                say(n, f" rename(s) (>= {p.file002_min_renames}) within {p.file002_window_minutes} minutes."),
                say("Paths involved: ", _joined("files"), _more("files"), ".")),
        ),
        "NET-001": (
            say(n, " external network connection(s) on host ", F.when(a != "", a).otherwise("unknown"),
                f" within {p.net001_window_minutes} minutes of process execution (",
                F.when(procs != "", procs).otherwise("process activity"),
                "). 'External' means an address outside RFC1918 private space. Temporal association is not "
                "causation — ", review),
            F.array_compact(F.array(
                say(n, " external connection(s) to ", _joined("destinations"), _more("destinations"),
                    f" following process activity within {p.net001_window_minutes} minutes."),
                F.when(_joined("users") != "", say("Users involved: ", _joined("users"), ".")))),
        ),
    }
    explanation, reasons = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for rid, (text, why) in by_rule.items():
        is_rule = F.col("rule_id") == rid
        explanation = F.when(is_rule, text).otherwise(explanation)
        reasons = F.when(is_rule, why).otherwise(reasons)
    return explanation, reasons


def run_rules(events: DataFrame, p: RuleParams = RuleParams()) -> RuleOutput:
    """All rules over all cases: capped findings with text, and their members.

    The events are read once, for the tagged rows; everything else reads
    those. The candidates and the members feed several branches, so each is
    computed once and cut from its lineage. The tagged rows are not shuffled
    for the member join while the candidates are few.
    """
    tags = tag(events, p)
    kept = small_side(cap_candidates(candidates_of(tags, p), p))
    rows = reliable_checkpoint(members(tags, kept, p))
    key = [*SCOPE, "rule_id"]
    explanation, reasons = _texts(p)
    support = rows.groupBy(*key).agg(
        F.count("*").alias("event_count"),
        F.count_distinct("evidence_id").alias("distinct_evidence"),
    )
    values = finding_values(rows)
    title = P.lookup(F.col("rule_id"), TITLES)
    findings = (
        kept.join(support, key)
        .join(_facets(values), key, "left")
        .select(
            *key,
            title.alias("title"),
            "severity",
            P.rule_confidence(F.col("severity")).alias("confidence"),
            "event_count",
            "distinct_evidence",
            P.from_micros(F.col("start_us")).alias("timestamp_start"),
            P.from_micros(F.col("end_us")).alias("timestamp_end"),
            explanation.alias("explanation"),
            reasons.alias("reasons"),
        )
    )
    return RuleOutput(
        findings, rows.select(*key, "id", "event_uid", "evidence_id", "timestamp"), values
    )


def rule_catalogue(spark, p: RuleParams = RuleParams()) -> DataFrame:
    """Fixed-order rule list with severity, enabled flag and settings."""
    settings = {
        "AUTH-001": {"min_failures": p.auth001_min_failures, "window_minutes": p.auth001_window_minutes},
        "AUTH-002": {"min_external_logins": p.auth002_min_external_logins},
        "AUTH-003": {"window_seconds": p.auth003_window_seconds},
        "PROC-001": {"indicator_source": "process name + command line tokens"},
        "FILE-001": {"min_modifications": p.file001_min_modifications,
                     "window_minutes": p.file001_window_minutes, "high_min": p.file001_high_min},
        "FILE-002": {"min_renames": p.file002_min_renames, "window_minutes": p.file002_window_minutes},
        "NET-001": {"min_connections": p.net001_min_connections, "window_minutes": p.net001_window_minutes},
    }
    rows = [
        (i + 1, rid, TITLES[rid], DEFAULT_SEVERITY[rid], rid not in p.disabled,
         {k: str(v) for k, v in settings[rid].items()})
        for i, rid in enumerate(RULES)
    ]
    return spark.createDataFrame(
        rows, "position int, rule_id string, title string, report_severity string, "
        "enabled boolean, config map<string,string>"
    )
