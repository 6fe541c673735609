"""Inputs of the shared steps are read once: what follows reads stages."""

import hashlib
import json

from fixtures import frame, random_events
from tracemill.operators import links as L
from tracemill.operators import timeline as T
from tracemill.plans.analyze import analyze
from tracemill.plans.process import process
from tracemill.schema import AnomalyParams, LinkParams, RuleParams
from test_process import SCHEMA


def stored(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.schema(df.schema).parquet(str(path))


def test_links_and_analysis_leave_the_events_behind(spark, tmp_path):
    ev = stored(spark, frame(spark, random_events(21, n=120)), tmp_path / "events")
    own = set(ev.inputFiles())
    found = L.links(ev, LinkParams(max_links=7, window_seconds=120))
    assert not own & set(found.inputFiles())
    a = analyze(ev, RuleParams(), AnomalyParams(min_windows=1))
    assert a.events.count() == 120
    assert not own & set(a.events.inputFiles()) and not own & set(a.finding_events.inputFiles()) and not own & set(a.stats.inputFiles())


def test_totals_of_a_timeline_do_not_tag_again(spark, tmp_path):
    ev = frame(spark, random_events(22, n=120))
    lk = L.links(ev, LinkParams(max_links=7, window_seconds=120))
    a = analyze(ev, RuleParams(), AnomalyParams(min_windows=1))
    tags = stored(spark, a.finding_events, tmp_path / "tags")
    tl = T.timeline(a.events, a.findings, tags, lk)
    assert not set(tags.inputFiles()) & set(tl.totals.inputFiles())
    totals = {r.case_id: r.total for r in tl.totals.collect()}
    assert {r.case_id: r["count"] for r in tl.entries.groupBy("case_id").count().collect()} == {c: n for c, n in totals.items() if n}


def test_events_of_a_run_are_mapped_once_and_raw_records_stay_json(spark):
    body = (
        'timestamp,"us""er",user,"[k]",user,note\n'
        '2026-10-06 10:00:00,"a""b",x,"[1]",y,"]["\n2026-10-06 10:00:00,"a""b",x,"[1]",y,"]["\n2026-10-07 10:00:00,,,"\\","é, ""q""",[\n').encode()
    files = spark.createDataFrame([("C1", "EV-0001", "a.csv", "generic", bytearray(body), hashlib.sha256(body).hexdigest())], SCHEMA)
    run = process(files)
    assert run.events.inputFiles() and run.raw_records.inputFiles()
    first = {"timestamp": "2026-10-06 10:00:00", 'us"er': 'a"b', "user": "y", "[k]": "[1]", "note": "]["}
    last = {"timestamp": "2026-10-07 10:00:00", 'us"er': "", "user": 'é, "q"', "[k]": "\\", "note": "["}
    assert [json.loads(r.content) for r in run.raw_records.orderBy("row_index").collect()] == [first, first, last]
    assert [r.duplicate_of for r in run.events.orderBy("id").collect()] == [None, "EVT-000001", None]
    assert [r.duplicates_detected for r in run.runs.collect()] == [1]
