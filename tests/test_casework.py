import random
import threading
from datetime import datetime

from fixtures import event, frame, random_events
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F
from tracemill.operators import anomaly, casework, graph, links, rollups, timeline
from tracemill.operators.features import feature_windows
from tracemill.plans import assistant, classifier
from tracemill.plans.analyze import analyze
from tracemill.schema import FEATURE_NAMES, AnomalyParams, RuleParams, ViewParams

ALLOWED = {
    "New": {"Under Review"}, "Under Review": {"Confirmed", "Dismissed"}, "Confirmed": {"Under Review", "Dismissed"},
    "Dismissed": {"Under Review", "Confirmed"},
}


def test_review_fold_equals_the_state_machine(spark, monkeypatch):
    monkeypatch.setattr(casework, "_SEQ_SLICE", 5)
    rng = random.Random(3)
    wanted = ["Under Review", "Confirmed", "Dismissed", "New"]
    acts = [("C1", rng.choice(["RFND-000001", "RFND-000001", "RFND-000002", "RFND-000009"]), i, rng.choice(wanted), "a", "n") for i in range(80)]
    findings = spark.createDataFrame([("C1", "RFND-000001"), ("C1", "RFND-000002"), ("C1", "RFND-000003")], "case_id string, finding_uid string")
    decided, final = casework.fold_reviews(
        spark.createDataFrame(acts, "case_id string, finding_uid string, seq long, to_status string, author string, note string"), findings)
    got = {r.seq: (r.from_status, r.accepted, r.reject_code) for r in decided.collect()}
    state = {"RFND-000001": "New", "RFND-000002": "New", "RFND-000003": "New"}
    for _, uid, seq, to, _, _ in acts:
        if uid not in state:
            assert got[seq] == (None, False, "FINDING_NOT_FOUND")
            continue
        cur = state[uid]
        code = "FINDING_STATUS_UNCHANGED" if to == cur else None if to in ALLOWED[cur] else "FINDING_STATUS_TRANSITION"
        assert got[seq] == (cur, code is None, code)
        if code is None:
            state[uid] = to
    assert {r.finding_uid: r.status for r in final.collect()} == state


def test_notes_and_markers(spark):
    notes = spark.createDataFrame(
        [("C1", 1, " hi ", " ", None), ("C1", 2, " ", "a", None), ("C1", 3, "x" * 4001, "a", None), ("C1", 4, "ok", "b" * 200, "RFND-000001"),
         ("C2", 5, "ok", "a", "RFND-000001"), ("C1", 6, "ok", "a", "BAD")],
        "case_id string, note_id int, body string, author string, finding_uid string")
    findings = spark.createDataFrame([("C1", "RFND-000001")], "case_id string, finding_uid string")
    got = {r.note_id: r for r in casework.load_notes(notes, findings).collect()}
    assert [got[i].reject_reason is None for i in range(1, 7)] == [True, False, False, False, False, False]
    assert (got[1].body, got[1].author, len(got[4].author)) == ("hi", "investigator", 200)
    assert got[4].reject_reason == "Note author exceeds the 127 character limit."
    cases = spark.createDataFrame([("C1", False, "x SYNTHETIC / DEMONSTRATION DATA"), ("C2", True, None), ("C3", False, "synthetic / demonstration data"), ("C4", False, None)],
                                  "case_id string, demo boolean, description string")
    evidence = spark.createDataFrame([("C4", None), ("C3", "plain")], "case_id string, source string")
    raw = spark.createDataFrame([("C4", "SYNTHETIC / DEMONSTRATION DATA")], "case_id string, content string")
    assert sorted(r.case_id for r in casework.synthetic_cases(cases, evidence, raw).collect()) == ["C1", "C2", "C4"]


def windows_frame(spark, n, busy=()):
    rows = []
    for i in range(n):
        for j in range(12 if i in busy else 1):
            rows.append(event(i * 100 + j, i * 300 + j, user=f"u{j}", host=f"h{j}", severity="Critical" if i in busy else "Low", source="process"))
    return frame(spark, rows)


def test_forest_flags_the_busy_window_and_is_repeatable(spark):
    ev = windows_frame(spark, 40, busy={17})
    p = AnomalyParams(n_estimators=60)
    scored = anomaly.score_windows(feature_windows(ev), p).orderBy("window_start").collect()
    assert [i for i, r in enumerate(scored) if r.flagged] == [17]
    assert max(r.score for r in scored) == 1.0 and min(r.score for r in scored) == 0.0
    assert all(-1.0 <= r.raw_score <= 0.0 for r in scored)
    again = anomaly.score_windows(feature_windows(ev.repartition(3)), p).orderBy("window_start").collect()
    assert [r.raw_score for r in scored] == [r.raw_score for r in again]


def test_abstention_and_constant_windows(spark):
    few = anomaly.score_windows(feature_windows(windows_frame(spark, 3)), AnomalyParams(n_estimators=5)).collect()
    assert all(r.abstained and r.score is None and not r.flagged for r in few)
    flat = anomaly.score_windows(feature_windows(windows_frame(spark, 12)), AnomalyParams(n_estimators=5)).collect()
    assert {(r.score, r.flagged) for r in flat} == {(0.0, False)}


def test_seven_minute_windows_start_at_midnight(spark):
    ev = frame(spark, [event(1, 0), event(2, 420)])
    starts = [r.window_start for r in feature_windows(ev, 7).orderBy("window_start").collect()]
    assert starts == [datetime(2026, 3, 8, 0, 56), datetime(2026, 3, 8, 1, 3)]


def test_analysis_timeline_and_graph_agree_with_plain_loops(spark):
    rows = random_events(31, n=150, span=40000, step=40)
    ev = frame(spark, rows)
    p = RuleParams(auth001_min_failures=2, auth002_min_external_logins=2, file002_min_renames=2)
    out = analyze(ev, p, AnomalyParams(n_estimators=10))
    found = out.findings.collect()
    assert all(f.event_count > 0 and f.css == f.components.total for f in found)
    members = {}
    for m in out.finding_events.collect():
        members.setdefault(m.id, set()).add(m.kind)
    lk = links.links(ev)
    linked = {i for r in lk.collect() for i in (r.event_a_id, r.event_b_id)}
    marked = {r.id: r.is_anomalous for r in out.events.collect()}
    tagged = {r["id"] for r in rows if r["id"] in members or r["id"] in linked or marked[r["id"]]}
    view = ViewParams(timeline_max=25, graph_max_nodes=30, graph_max_edges=20)
    line = timeline.timeline(out.events, out.findings, out.finding_events, lk, view)
    got = line.entries.collect()
    totals = {r.case_id: r for r in line.totals.collect()}
    for case in ("C1", "C2"):
        mine = sorted((r for r in rows if r["case_id"] == case), key=lambda r: (r["timestamp"], r["id"]))
        times = [r["timestamp"] for r in mine if r["id"] in tagged]
        want = [r["id"] for r in mine if r["id"] in tagged or any(abs((r["timestamp"] - t).total_seconds()) <= 120 for t in times)]
        assert [e.id for e in sorted((e for e in got if e.case_id == case), key=lambda e: e.position)] == want[:25]
        assert (totals[case].total, totals[case].truncated) == (len(want), len(want) > 25)
    for e in got:
        kinds = members.get(e.id, set())
        level = "SUSPICIOUS" if "rule" in kinds else "NOTABLE" if kinds or marked[e.id] else "NORMAL"
        assert e.significance == level and e.context == (e.id not in tagged) and e.reasons
    evidence = spark.createDataFrame([(c, f"EV-000{i}", "f.csv", "system", 1, "ab" * 32) for c in ("C1", "C2") for i in (1, 2)],
                                     "case_id string, evidence_id string, original_filename string, evidence_type string, file_size long, sha256 string")
    g = graph.graph(out.events, evidence, out.findings, out.finding_events, lk, view)
    nodes = g.nodes.collect()
    edges = g.edges.collect()
    known = {(n.case_id, n.node_id) for n in nodes}
    assert max(n.node_rank for n in nodes) <= 30 and max(e.edge_rank for e in edges) <= 20
    assert all((e.case_id, e.source) in known and (e.case_id, e.target) in known for e in edges)
    assert len({(e.case_id, e.source, e.target, e.relation) for e in edges}) == len(edges)


def test_integrity_headline_labels(spark):
    evidence = spark.createDataFrame([("A", "E1"), ("B", "E1"), ("B", "E2"), ("C", "E1"), ("D", "E1")], "case_id string, evidence_id string")
    checks = spark.createDataFrame(
        [("B", "E1", 1, datetime(2026, 1, 1), "VERIFIED"), ("C", "E1", 2, datetime(2026, 1, 1), "MISMATCH"), ("C", "E1", 3, datetime(2026, 1, 2), "VERIFIED"),
         ("D", "E1", 4, datetime(2026, 1, 1), "VERIFIED")],
        "case_id string, evidence_id string, check_id long, checked_at timestamp_ntz, result string")
    got = {r.case_id: r.integrity_status for r in rollups.integrity_headline(evidence, checks).collect()}
    assert got == {"A": "Unverified", "B": "Partially verified", "C": "Mismatch", "D": "Verified"}
    assert [r.latest for r in rollups.latest_integrity(checks).filter("case_id = 'C'").collect()] == ["VERIFIED"]


def test_intents(spark):
    asked = {
        "": "UNKNOWN", "Why was RFND-000001 flagged?": "FINDING_EXPLANATION", "where does rfnd-000001 come from": "FINDING_TRACE",
        "What evidence supports MFND-000002?": "EVIDENCE_SUPPORT", "Show EVT-000123": "TIMELINE_CONTEXT", "what happened around 10:30?": "TIMELINE_CONTEXT",
        "Which findings need review?": "REVIEW_QUEUE", "did the ML abstain": "ML_EXPLANATION", "is the SHA-256 hash unchanged": "INTEGRITY_STATUS",
        "how many records were rejected": "PROCESSING_STATUS", "which user was it": "CORRELATION_SUMMARY", "explain COR-000001": "CORRELATION_SUMMARY",
        "list activity groups": "GROUP_SUMMARY", "suspicious things": "TOP_FINDINGS", "give me an overview": "CASE_SUMMARY", "what can you do": "CAPABILITIES", "hello": "UNKNOWN",
    }
    df = spark.createDataFrame([(q,) for q in asked], "question string")
    assert {r.question: r.intent for r in assistant.classify(df).collect()} == asked


def labelled(spark, sizes):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            i += 1
            base = {"benign": 1, "compromise": 6, "ransomware_like": 15}[label]
            rows.append(("C", datetime(2026, 1, 1 + i // 96, i % 96 // 4, i % 4 * 15), datetime(2026, 1, 1), label, *[base + (i * k) % 3 for k in range(len(FEATURE_NAMES))]))
    schema = "case_id string, window_start timestamp_ntz, window_end timestamp_ntz, label string, " + ", ".join(f"{c} int" for c in FEATURE_NAMES)
    return spark.createDataFrame(rows, schema)


def test_classifier_guards_and_learning(spark):
    empty = classifier.guard(labelled(spark, {"benign": 1}).filter("false")).first()
    assert empty.abstained_reason == "no labelled windows available"
    assert "no windows labelled compromise" in classifier.guard(labelled(spark, {"benign": 9, "ransomware_like": 9})).first().abstained_reason
    assert "compromise=7" in classifier.guard(labelled(spark, {"benign": 20, "compromise": 7, "ransomware_like": 9})).first().abstained_reason
    assert "98/118" in classifier.guard(labelled(spark, {"benign": 98, "compromise": 10, "ransomware_like": 10})).first().abstained_reason
    data = labelled(spark, {"benign": 40, "compromise": 24, "ransomware_like": 16})
    parts = classifier.stratified_parts(data, 4).groupBy("label").pivot("part", [0, 1, 2, 3]).count().collect()
    assert {r.label: (r["0"], r["3"]) for r in parts} == {"benign": (10, 10), "compromise": (6, 6), "ransomware_like": (4, 4)}
    out = classifier.evaluate(data, trees=10, folds=2)
    assert out.metrics.first().accuracy > out.guard.first().baseline_accuracy and len(out.cv_accuracy) == 2
    assert out.predictions.filter(F.col("predicted_label") == F.col("label")).count() > 70
    assert len(classifier.feature_columns()) == 50
    assert out.confusion.count() == 9 and out.confusion.agg(F.sum("n")).first()[0] == 20
    summary = classifier.fold_summary(out.folds).first()
    assert summary.folds == 2 and abs(summary["mean"] - sum(out.cv_accuracy) / 2) < 1e-12


def test_rows_keep_their_nodes_while_a_forest_grows(spark):
    """The same trees as from a forest that is sent out anew for each group of nodes."""
    data = classifier.vectors(labelled(spark, {"benign": 40, "compromise": 24, "ransomware_like": 16}))
    model = classifier.fit(data, trees=6, seed=3)
    plain = RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w", numTrees=6, seed=3, maxDepth=classifier.DEPTH,
                                   maxBins=classifier.BINS, featureSubsetStrategy="sqrt").fit(classifier._weighted(data))
    assert model.getCacheNodeIds() and model.getNumTrees == 6
    assert [t.toDebugString.partition("\n")[2] for t in model.trees] == [t.toDebugString.partition("\n")[2] for t in plain.trees]


def test_forests_of_an_evaluation_grow_side_by_side(spark, monkeypatch):
    """Each fit waits for another one, so fits one after the other would break the barrier."""
    together, grow = threading.Barrier(2, timeout=60), classifier.fit

    def fit(*args):
        together.wait()
        return grow(*args)

    monkeypatch.setattr(classifier, "fit", fit)
    out = classifier.evaluate(labelled(spark, {"benign": 40, "compromise": 24, "ransomware_like": 16}), trees=2, folds=2)
    assert [r.fold for r in out.folds.orderBy("fold").collect()] == [0, 1] and out.folds.agg(F.sum("windows")).first()[0] == 80


def test_breakdowns_fill_vocabularies_and_list_free_values(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("z", "y", None), (None, "x", 4)], "one string, two string, n long")
    got = lambda df, v: sorted(map(tuple, rollups.breakdowns(df, v).collect()), key=repr)
    want = [("one", "a", 0, 2), ("one", "b", 1, 0), ("two", "x", None, 2), ("two", "y", None, 1), ("two", None, None, 1)]
    assert got(rows, {"one": ("a", "b"), "two": None}) == sorted(want, key=repr)
    assert got(rows.limit(0), {"one": ("a", "b"), "two": None}) == [("one", "a", 0, 0), ("one", "b", 1, 0)]
    assert got(rows, {"two": ("y",)}) == [("two", "y", 0, 1)]
    assert [tuple(r) for r in rollups.sums(rows, ("n",)).collect()] == [("n", 7)]
    assert [tuple(r) for r in rollups.sums(rows.limit(0), ("n",)).collect()] == [("n", 0)]
