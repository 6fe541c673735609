import hashlib
import io
import json
import zipfile

from tracemill.plans.process import process, rejected_view
from tracemill.schema import IngestParams
from tracemill.sources.evidence_files import admit, scan_evidence, split_new, with_empty
from tracemill.sources.sinks import append_history, rebuildable, replace_per_evidence

SCHEMA = "case_id string, evidence_id string, filename string, declared_type string, content binary, recorded_sha256 string"
AUTH = (
    b"Timestamp,User,Host,Source IP,Action,Result\n"
    b"2026-10-06 10:00:00,alice,H1,10.0.0.1,login,success\n"
    b"2026-10-06 10:00:00,alice,H1,10.0.0.1,login,success\n"
    b'10/06/2026 11:00:00,"bob\nsmith",H2,8.8.8.8,login,failed\n'
    b"not-a-time,bob,H2,8.8.8.8,login,failed\n\n"
    b"1759740000,,H2,8.8.8.8,login,failed\n"
    b"1,2,3\n , , , , , \n"
)
SYSTEM = {"events": [
    {"@timestamp": "2026-10-06T10:00:00+05:30", "level": "error", "hostname": "h", "service": "s", "message": "m",
     "remote": {"ip": "1.2.3.4", "port": 22}, "tags": ["a", 1], "online": True, "detail": None, "ratio": 1.0},
    42,
    {"timestamp": "", "message": "x"},
]}
WEB = b"time,username,url,action\n2026-10-06T10:00:00Z,al,https://ex.com:8080/a?b,visit\n2026-10-06T10:00:00Z,al,,visit\n"


def files(spark, rows):
    return spark.createDataFrame(
        [(c, e, n, d, bytearray(b), hashlib.sha256(b).hexdigest() if ok else "0") for c, e, n, d, b, ok in rows], SCHEMA)


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def test_accounting_rejects_duplicates_and_failures(spark):
    rows = [
        ("C1", "EV-0001", "a.csv", "authentication", AUTH, True), ("C1", "EV-0002", "s.json", "system", json.dumps(SYSTEM).encode(), True),
        ("C1", "EV-0003", "w.log", "browser", WEB, True), ("C2", "EV-0001", "x.csv", "generic", b"a,b\n1,2\n", True),
        ("C2", "EV-0002", "e.csv", "generic", b" \n", True), ("C2", "EV-0003", "t.csv", "authentication", AUTH, False),
        ("C2", "EV-0004", "b.bin", "generic", b"plain words", True), ("C2", "EV-0005", "j.json", "generic", b"{broken", True),
        ("C2", "EV-0006", "l.json", "generic", b'{"ts":"2026-10-06","k":1}\n{"ts":"2026-10-07","k":2}\n', True),
        ("C2", "EV-0007", "h.csv", "generic", b"timestamp,user\n", True),
    ]
    out = process(files(spark, rows))
    runs = {(r.case_id, r.evidence_id): r for r in out.runs.collect()}
    brief = {k: (r.status, r.parser, r.records_received, r.records_parsed, r.records_normalized, r.records_rejected, r.duplicates_detected) for k, r in runs.items()}
    assert brief == {
        ("C1", "EV-0001"): ("Partial", "csv/authentication", 6, 5, 3, 3, 1), ("C1", "EV-0002"): ("Partial", "json/system", 3, 2, 1, 2, 0),
        ("C1", "EV-0003"): ("Partial", "csv/browser", 2, 2, 1, 1, 0), ("C2", "EV-0001"): ("Failed", None, 0, 0, 0, 0, 0),
        ("C2", "EV-0002"): ("Failed", None, 0, 0, 0, 0, 0), ("C2", "EV-0003"): ("Failed", None, 0, 0, 0, 0, 0),
        ("C2", "EV-0004"): ("Failed", None, 0, 0, 0, 0, 0), ("C2", "EV-0005"): ("Failed", None, 0, 0, 0, 0, 0),
        ("C2", "EV-0006"): ("Completed", "json/generic", 2, 2, 2, 0, 0), ("C2", "EV-0007"): ("Partial", "csv/generic", 0, 0, 0, 0, 0),
    }
    assert "integrity mismatch" in runs["C2", "EV-0003"].error and runs["C2", "EV-0002"].error == "evidence file is empty"
    rejects = {(r.evidence_id, r.row_index): r.reject_reason for r in rejected_view(out.raw_records, out.runs).filter("case_id = 'C1'").collect()}
    assert rejects == {
        ("EV-0001", 4): "invalid timestamp format: 'not-a-time'", ("EV-0001", 5): "missing required field: user",
        ("EV-0001", 6): "malformed row: expected 6 columns, got 3", ("EV-0002", 2): "record is not a JSON object",
        ("EV-0002", 3): "missing timestamp value", ("EV-0003", 2): "missing required field: url or domain",
    }
    events = out.events.filter("case_id = 'C1'").orderBy("id").collect()
    assert [(e.id, e.event_uid, e.evidence_id, e.row_index, e.duplicate_of) for e in events] == [
        (1, "EVT-000001", "EV-0001", 1, None), (2, "EVT-000002", "EV-0001", 2, "EVT-000001"), (3, "EVT-000003", "EV-0001", 3, None),
        (4, "EVT-000004", "EV-0002", 1, None), (5, "EVT-000005", "EV-0003", 1, None)]
    assert events[2].user == "bob\nsmith" and events[2].metadata == {"normalizer": "authentication", "status": "failed"}
    assert (events[3].severity, events[3].destination_ip) == ("High", "1.2.3.4")
    assert events[3].metadata == {"normalizer": "system", "service": "s", "message": "m", "remote_port": "22", "tags": "a, 1", "online": "true", "ratio": "1.0"}
    assert events[4].metadata["domain"] == "ex.com:8080" and events[4].user == "al"
    raw = {(r.case_id, r.evidence_id, r.row_index): r for r in out.raw_records.collect()}
    assert len(raw) == sum(r.records_received for r in runs.values())
    assert json.loads(raw["C1", "EV-0001", 1].content)["Source IP"] == "10.0.0.1"


def test_archives(spark):
    good = archive(**{"logs__auth_dot_csv": AUTH, "system_logs_dot_json": json.dumps(SYSTEM), "n_dot_zip": b"PK", "r_dot_docx": b"x", "up__plain_dot_txt": b"timestamp\n"})
    bomb = archive(**{"big_dot_csv": b"timestamp,a\n" + b"0" * 3_000_000, "w_dot_csv": WEB})
    rows = [("C1", "EV-0001", "a.zip", "generic", good, True), ("C1", "EV-0002", "b.zip", "generic", bomb, True), ("C1", "EV-0003", "c.zip", "generic", b"PK\x03\x04junk", True),
            ("C1", "EV-0004", "d.zip", "generic", archive(), True)]
    out = process(files(spark, rows))
    runs = {r.evidence_id: r for r in out.runs.collect()}
    assert [(runs[f"EV-000{i}"].status, runs[f"EV-000{i}"].records_received, runs[f"EV-000{i}"].records_normalized) for i in (1, 2, 3, 4)] == [
        ("Partial", 10, 4), ("Partial", 3, 1), ("Failed", 0, 0), ("Partial", 0, 0)]
    assert runs["EV-0003"].error.startswith("not a readable ZIP archive")
    members = {(m.evidence_id, m.member_path): (m.status, m.detail, m.records) for m in out.members.collect()}
    assert members["EV-0001", "n.zip"] == ("skipped", "nested archive not expanded", 0)
    assert members["EV-0001", "logs/auth.csv"] == ("ok", None, 6)
    assert "compression ratio" in members["EV-0002", "big.csv"][1]
    event = out.events.filter("evidence_id = 'EV-0002'").collect()[0]
    assert event.metadata["member_path"] == "w.csv" and event.metadata["member_parser"] == "csv/browser"
    sources = {r.source_type for r in out.events.filter("evidence_id = 'EV-0001'").collect()}
    assert sources == {"authentication", "system"}
    small = process(files(spark, rows[:1]), IngestParams(zip_max_members=2)).runs.collect()[0]
    assert (small.status, small.error) == ("Failed", "archive contains more members than the configured limit")


def test_record_cap_is_reported(spark):
    body = b"timestamp,user,action\n" + b"".join(b"2026-10-06 10:00:%02d,u,login\n" % i for i in range(9))
    (run,) = process(files(spark, [("C1", "EV-0001", "a.csv", "authentication", body, True)]), IngestParams(max_records=4)).runs.collect()
    assert (run.status, run.records_received, run.warnings) == ("Partial", 4, ["record limit of 4 reached; 5 remaining records were not processed in this run"])


def test_admission(spark, tmp_path):
    cases = {
        "ok.csv": (b"a,b\n", None), "ok.json": (b'{"a":1}', None), "lines.json": (b'{"a":1}\n{"a":2}\n', None), "bad.json": (b"{x", "CONTENT_TYPE_MISMATCH"),
        "exe.csv": (b"MZ..", "CONTENT_TYPE_MISMATCH"), "bin.txt": (b"a\x00b", "CONTENT_TYPE_MISMATCH"), "latin.log": (b"caf\xe9 au lait", "CONTENT_TYPE_MISMATCH"),
        "none.csv": (b"", "EMPTY_FILE"), "no.exe": (b"x", "UNSUPPORTED_FILE_TYPE"), "z.zip": (b"PK\x03\x04", None), "nz.zip": (b"xx", "CONTENT_TYPE_MISMATCH"),
        "cut.txt": (b"x" * 8190 + "é€".encode(), None),
    }
    for name, (body, _) in cases.items():
        (tmp_path / name).write_bytes(body)
    listed = spark.createDataFrame([(name,) for name in cases], "filename string")
    scanned = with_empty(scan_evidence(spark, str(tmp_path)), listed)
    got = {r.filename: r for r in admit(scanned).drop("content").collect()}
    assert {k: v.reject_code for k, v in got.items()} == {k: code for k, (_, code) in cases.items()}
    assert got["ok.csv"].sha256 == hashlib.sha256(b"a,b\n").hexdigest() and got["ok.csv"].mime_type == "text/csv"
    names = spark.createDataFrame([("../../etc/pass<wd>.csv", bytearray(b"x")), ("C:\\a\\ .hid  den.TXT", bytearray(b"x")), ("...", bytearray(b"x"))], "filename string, content binary")
    assert [r.safe_filename for r in admit(names).collect()] == ["pass_wd_.csv", "hid den.TXT", ""]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("C1", "EV-0001", 1), ("C1", "EV-0002", 2)], "case_id string, evidence_id string, v int")
    path = str(tmp_path / "t")
    replace_per_evidence(rows, path)
    replace_per_evidence(rows.filter("v = 2").selectExpr("case_id", "evidence_id", "v + 5 AS v"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 7]
    log = str(tmp_path / "log")
    for n in (1, 2):
        append_history(spark.createDataFrame([("C1", f"R{n}", n)], "case_id string, run_uid string, v int"), log)
    assert spark.read.parquet(log).count() == 2
    fresh, conflict = split_new(rows, rows.filter("v = 1"))
    assert [r.evidence_id for r in fresh.collect()] == ["EV-0002"] and [r.evidence_id for r in conflict.collect()] == ["EV-0001"]
    twice = spark.createDataFrame([("C1", "EV-0003", "b"), ("C1", "EV-0003", "a"), ("C1", "EV-0003", None)], "case_id string, evidence_id string, path string")
    fresh, conflict = split_new(twice, rows)
    assert [r.path for r in fresh.collect()] == ["a"] and sorted(str(r.path) for r in conflict.collect()) == ["None", "b"]
    assert rebuildable(rows, rows.filter("v = 2")).count() == 1
