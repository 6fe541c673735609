from collections import Counter

import pytest

import brute
from fixtures import event, frame, random_events
from pyspark.sql import functions as F
from tracemill.operators import groups as G
from tracemill.operators import links as L
from tracemill.schema import LinkParams


@pytest.mark.parametrize("seed,cap,span", [(1, 5000, 1500), (2, 1, 1500), (3, 7, 1500), (4, 40, 600), (5, 150, 3000), (6, 12, 300), (7, 3, 100)])
def test_capped_links_equal_the_plain_sweep(spark, seed, cap, span):
    rows = random_events(seed, span=span, step=1 if seed % 2 else 20)
    p = LinkParams(max_links=cap, window_seconds=120)
    ev = frame(spark, rows)
    found = L.links(ev, p).cache()
    got = {}
    for r in found.orderBy("case_id", "link_rank").collect():
        got.setdefault(r.case_id, []).append((r.event_a_id, r.event_b_id, r.correlation_type))
    want = brute.links(rows, 120, cap)
    assert got == {c: v[0] for c, v in want.items() if v[0]}
    stats = {r.case_id: r for r in L.link_stats(ev, found, p).collect()}
    for case, (links, pairs) in want.items():
        assert (stats[case].links, stats[case].pairs_evaluated) == (len(links), pairs)
        assert stats[case].links_truncated == (len(links) >= cap)
        assert sum(stats[case][f"corr_00{i}"] for i in range(1, 6)) == len(links)


@pytest.mark.parametrize("seed", [11, 12])
def test_address_only_events_still_link(spark, seed):
    rows = [dict(r, host=None, user=None) for r in random_events(seed, n=120, span=900, step=1)]
    for cap in (2, 9, 5000):
        found = L.links(frame(spark, rows), LinkParams(max_links=cap, window_seconds=60))
        got = {}
        for r in found.orderBy("case_id", "link_rank").collect():
            got.setdefault(r.case_id, []).append((r.event_a_id, r.event_b_id, r.correlation_type))
        assert got == {c: v[0] for c, v in brute.links(rows, 60, cap).items() if v[0]}


@pytest.mark.parametrize("seed,step,bare", [(31, 1, False), (32, 20, False), (33, 5, True)])
def test_link_counts_without_links_equal_all_links(spark, seed, step, bare):
    rows = random_events(seed, span=1500, step=step)
    rows = [dict(r, host=None, user=None) if bare else r for r in rows]
    p = LinkParams(max_links=10**6, window_seconds=120)
    ev = frame(spark, rows)
    want = {c: Counter(t for _, _, t in v[0]) for c, v in brute.links(rows, 120, 10**9).items()}
    bands = {(r.case_id, r.band): r["count"] for r in L.links(ev, p).groupBy("case_id", "band").count().collect()}
    got = L.link_counts(ev, p).collect()
    assert {r.case_id for r in got} >= set(want)
    for r in got:
        types = want.get(r.case_id, Counter())
        assert r.links == sum(types.values())
        assert [r[f"corr_00{i}"] for i in range(1, 6)] == [types[f"CORR-00{i}"] for i in range(1, 6)]
        assert [r[f"band_{b.lower()}"] for b in ("Low", "Medium", "High")] == [bands.get((r.case_id, b), 0) for b in ("Low", "Medium", "High")]
    assert L.link_counts(ev.limit(0), p).count() == 0


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_sessions_give_the_components_of_all_links(spark, seed):
    rows = random_events(seed, n=120, span=6000, step=1)
    ev = frame(spark, rows)
    got = {(r.case_id, r.id): r.component for r in G.session_components(L.dated_events(ev), 60).collect()}
    want = {}
    for case, (links, _) in brute.links(rows, 60, 10**9).items():
        want.update({(case, k): v for k, v in brute.components([(a, b) for a, b, _ in links]).items()})
    assert got == want
    capped = G.link_components(L.links(ev, LinkParams(window_seconds=60, max_links=10**6)))
    assert {(r.case_id, r.id): r.component for r in capped.collect()} == want


def test_star_components_on_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, i) for i in range(1001, 1200)]
    edges = spark.createDataFrame(chain + hub, "src long, dst long")
    got = {r.node: r.component for r in G.star_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1200))


def test_pair_precedence_window_edge_and_confidence(spark):
    def one(a, b):
        r = L.links(frame(spark, [event(1, 0, **a), event(2, b.pop("at", 10), **b)])).collect()
        return (r[0].correlation_type, r[0].confidence, r[0].band) if r else None

    proc, net = dict(source="process", process="p.exe", host="h"), dict(source="network", host="h", destination_ip="93.184.216.34")
    assert one(dict(proc, user="u"), dict(source="file_activity", file_path="/x", host="h", user="u")) == ("CORR-004", 0.85, "High")
    assert one(proc, dict(net)) == ("CORR-005", 0.55, "Low")
    assert one(proc, dict(net, destination_ip="10.0.0.1")) == ("CORR-001", 0.55, "Low")
    assert one(dict(user="u"), dict(user="u", at=300)) == ("CORR-002", 0.55, "Low")
    assert one(dict(user="u"), dict(user="u", at=301)) is None
    ip = dict(source_ip="1.1.1.1")
    assert one(dict(ip, source="authentication"), dict(ip)) == ("CORR-003", 0.4, "Low")
    assert one(dict(ip), dict(ip)) is None
    assert one(dict(host="h", user="u", source_ip="1"), dict(host="h", user="u", source_ip="1")) == ("CORR-002", 1.0, "High")


def test_groups_title_severity_and_members(spark):
    rows = [event(i, i * 10, source="file_activity", host="h", user=f"u{i}", file_path="/f", action="write") for i in range(1, 6)]
    rows += [event(50, 9000, user="a"), event(51, 9010, user="a")]
    ev = frame(spark, rows)
    found = L.links(ev)
    tags = spark.createDataFrame([("C1", "EVT-000002", "High")], "case_id string, event_uid string, severity string")
    g, m = G.groups(ev, found, G.link_components(found), tags, LinkParams(max_members=4))
    out = g.orderBy("group_rank").collect()
    assert [(r.kind, r.title, r.severity, r.members, r.link_count) for r in out] == [
        ("file_activity", "File activity burst — h", "High", 4, 6),
        ("cross_source", "Cross-source activity group — a", "Low", 2, 1),
    ]
    assert out[0].group_uid == "GRP-000001" and m.count() == 6


@pytest.mark.parametrize("seed,step", [(41, 1), (42, 20)])
def test_links_without_a_limit_and_of_given_openers(spark, seed, step):
    rows = random_events(seed, span=1500, step=step)
    ev, p = frame(spark, rows), LinkParams(max_links=None, window_seconds=120)
    want = {c: v[0] for c, v in brute.links(rows, 120, 10**9).items() if v[0]}

    def listed(found):
        got = {}
        for r in found.orderBy("case_id", "link_rank").collect():
            got.setdefault(r.case_id, []).append((r.link_rank, r.event_a_id, r.event_b_id, r.correlation_type))
        return got

    numbered = {c: [(i, *x) for i, x in enumerate(v, 1)] for c, v in want.items()}
    assert listed(L.links(ev, p)) == numbered
    linked = {(c, x) for c, v in want.items() for a, b, _ in v for x in (a, b)}
    first = {(c, r["id"]) for c, evs in brute.by(rows, lambda r: r["case_id"]).items() for r in [r for r in evs if (c, r["id"]) in linked][:7]}
    openers = L.dated_events(ev).select("case_id", "id", "us").filter(F.concat_ws("/", "case_id", "id").isin([f"{c}/{x}" for c, x in first]))
    assert listed(L.links(ev, p, openers)) == {c: [x for x in v if (c, x[1]) in first] for c, v in numbered.items()}


@pytest.mark.parametrize("seed", [51, 52])
def test_totals_of_all_links_by_case_and_component_also_with_rows_twice(spark, seed):
    rows = random_events(seed, n=120, span=3000, step=5)
    rows += rows[:40]
    ev, p = frame(spark, rows), LinkParams(max_links=None, window_seconds=60)
    found = L.links(ev, p).select("case_id", "event_a_id", "event_b_id", "correlation_type").collect()
    totals = {r.case_id: r.links for r in L.link_totals(ev, p).collect() if r.links}
    assert totals == dict(Counter(r.case_id for r in found))
    parts = G.session_components(L.dated_events(ev), 60)
    of = {(r.case_id, r.id): r.component for r in parts.collect()}
    assert {(r.case_id, x) for r in found for x in (r.event_a_id, r.event_b_id)} == set(of)
    want = {}
    for r in found:
        assert of[r.case_id, r.event_a_id] == of[r.case_id, r.event_b_id]
        want.setdefault((r.case_id, of[r.case_id, r.event_a_id]), []).append(r.correlation_type)
    got = {(r.case_id, r.component): (r.link_count, list(r.types)) for r in L.component_links(ev, parts, p).collect()}
    assert got == {k: (len(v), sorted(set(v))) for k, v in want.items()}
