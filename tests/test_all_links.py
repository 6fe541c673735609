"""Reports of a case with more links and groups than a run lists."""

import json
import os

import duckdb
import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

DENSE, PAIRS = 130, 60  # events of one user within a minute, then lone pairs an hour apart


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Own events, the other tables as they are."""
    path, given = str(tmp_path_factory.mktemp("dense")), "/root/testdata/sf0.001"
    for name in os.listdir(given):
        if name != "events.parquet":
            os.symlink(f"{given}/{name}", f"{path}/{name}")
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 SECOND * (i // 3) AS ts, 4 AS user_id, ['view', 'click', 'purchase'][i % 3 + 1] AS event_type,
        10.0::DOUBLE AS value, '{{}}' AS props FROM range({DENSE}) t(i)
      UNION ALL SELECT 1000 + i, TIMESTAMP '2024-01-05 02:00:00' + INTERVAL 1 HOUR * (i // 2) + INTERVAL 1 SECOND * (i % 2), 8 + 4 * (i // 2), 'click', 10.0, '{{}}' FROM range({2 * PAIRS}) t(i)
      UNION ALL SELECT 5000 + i, TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 HOUR * i, 1 + i % 3, 'signup', 10.0, '{{}}' FROM range(30) t(i)) TO '{path}/events.parquet'""")
    return path


def test_summary_counts_every_link_and_group(spark, folder):
    query = entry.queries()["report_summary"]
    found = {r.case_id: r for r in query(spark, folder).collect()}["CASE-2024-001"]
    assert (found.correlations, found.activity_groups) == (DENSE * (DENSE - 1) // 2 + PAIRS, PAIRS + 1)
    assert compare(spark, duck(folder), "report_summary", query, entry.oracle_sql()["report_summary"], folder) is None


def test_snapshot_has_every_link_behind_its_lists(spark, folder):
    report = json.loads(entry.queries()["report_snapshot"](spark, folder).filter("case_id = 'CASE-2024-001'").first().report_json)
    dense = DENSE * (DENSE - 1) // 2
    assert report["executive_summary"]["correlations"] == report["correlations"]["total"] == dense + PAIRS
    assert report["correlations"]["truncated"] and len(report["correlations"]["correlations"]) == 200
    listed = report["activity_groups"]["groups"]
    assert report["activity_groups"]["total"] == len(listed) == PAIRS + 1
    assert (listed[0]["event_count"], listed[0]["correlation_count"]) == (DENSE, dense)
    assert [(g["event_count"], g["correlation_count"]) for g in listed[1:]] == [(2, 1)] * PAIRS
    entries = {e["event_uid"]: e for e in report["timeline"]["entries"]}
    assert report["timeline"]["total"] == len(entries) == DENSE + 2 * PAIRS
    for i in range(PAIRS):
        for end in (1000 + 2 * i, 1001 + 2 * i):
            assert entries[f"EVT-{end + 1:06d}"]["correlation_ids"] == [f"COR-{dense + 1 + i:06d}"]
    assert entries["EVT-000003"]["correlation_ids"] == ["COR-000002", f"COR-{DENSE:06d}", f"COR-{2 * DENSE - 2:06d}"]
    assert report["graph"]["truncated"] and report["graph"]["relation_correlated"] > 0
