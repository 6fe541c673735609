import hashlib

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from test_process import AUTH, WEB
from tracemill.sources.commits import CommitLog
from tracemill.streaming.landing import ingest_available


def test_each_call_takes_the_new_files(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    rows = []
    for n, (name, body, kind) in enumerate([("a.csv", AUTH, "authentication"), ("w.csv", WEB, "browser")], start=1):
        folder = landing / "C1" / f"EV-000{n}"
        folder.mkdir(parents=True)
        rows.append(("C1", f"EV-000{n}", kind, hashlib.sha256(body).hexdigest()))
    manifest = spark.createDataFrame(rows, "case_id string, evidence_id string, evidence_type string, sha256 string")
    (landing / "C1" / "EV-0001" / "a.csv").write_bytes(AUTH)
    ingest_available(spark, str(landing), manifest, out)
    assert spark.read.parquet(f"{out}/events").count() == 3
    (landing / "C1" / "EV-0002" / "w.csv").write_bytes(WEB)
    ingest_available(spark, str(landing), manifest, out)
    assert sorted(r.event_uid for r in spark.read.parquet(f"{out}/events").collect()) == [f"EVT-00000{i}" for i in range(1, 5)]
    runs = {r.evidence_id: r.run_uid for r in spark.read.parquet(f"{out}/runs").collect()}
    assert runs == {"EV-0001": "BATCH-000000", "EV-0002": "BATCH-000001"}


def test_a_batch_that_fails_or_repeats_changes_nothing(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    schema = StructType.fromDDL("case_id string, evidence_id string, n long")
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: sorted((r.case_id, r.evidence_id, r.n) for r in log.current("t", schema).collect())
    assert read() == [] and log.history("h", schema).count() == 0
    assert log.commit("a", {"t": rows(("C1", "1", 1), ("C1", "2", 2))}, {"h": rows(("C1", "1", 1))})
    assert not log.commit("a", {"t": rows(("C1", "1", 9))}, {"h": rows(("C1", "1", 9))})
    assert read() == [("C1", "1", 1), ("C1", "2", 2)] and log.history("h", schema).count() == 1
    # A run that dies before its commit is written stays unseen; its repetition overwrites what it left.
    rows(("C1", "1", 7)).write.partitionBy("case_id", "evidence_id").parquet(f"{log.folder}/t/commit=b")
    rows(("C1", "1", 7)).select("case_id", "evidence_id").write.parquet(f"{log.folder}/_replaced/commit=b")
    assert read() == [("C1", "1", 1), ("C1", "2", 2)]
    assert log.commit("b", {"t": rows(("C1", "1", 3), ("C1", "1", 3))}, {"h": rows(("C1", "1", 3))})
    assert read() == [("C1", "1", 3), ("C1", "1", 3), ("C1", "2", 2)] and log.history("h", schema).count() == 2
    # An evidence that is replaced by no rows is empty.
    assert log.commit("c", {"t": rows()}, {}, rows(("C1", "2", 0)))
    assert read() == [("C1", "1", 3), ("C1", "1", 3)]


def test_history_keeps_evidence_and_unlisted_files_are_named(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    for evidence in ("EV-0001", "EV-0009"):
        (landing / "C1" / evidence).mkdir(parents=True)
        (landing / "C1" / evidence / "a.csv").write_bytes(AUTH)
    manifest = spark.createDataFrame([("C1", "EV-0001", "authentication", hashlib.sha256(AUTH).hexdigest())],
                                     "case_id string, evidence_id string, evidence_type string, sha256 string")
    pinned = lambda asked: asked.filter("evidence_id = 'EV-0001'").withColumn("reason", F.lit("history refers to it"))
    ingest_available(spark, str(landing), manifest, out)
    log = CommitLog(spark, out)
    events = StructType.fromDDL("case_id string, evidence_id string, event_uid string")
    before = sorted(r.event_uid for r in log.current("events", events).collect())
    assert len(before) == 3
    assert [r.evidence_id for r in spark.read.parquet(f"{out}/unlisted").collect()] == ["EV-0009"]
    (landing / "C1" / "EV-0001" / "b.csv").write_bytes(AUTH)  # a new file of evidence that is pinned now
    ingest_available(spark, str(landing), manifest, out, guard=pinned)
    assert sorted(r.event_uid for r in log.current("events", events).collect()) == before
    assert [(r.evidence_id, r.reason) for r in spark.read.parquet(f"{out}/skipped").collect()] == [("EV-0001", "history refers to it")]
    assert log.commits().count() == 2
