"""Ranks, pages and totals of whole tables against sorting in Python."""

import random

import fixtures
import pytest
from pyspark.sql import functions as F

from tracemill.functions.predicates import uid
from tracemill.operators import links, ranking, search, timeline
from tracemill.operators.ranking import first_or_all, order_index
from tracemill.schema import ViewParams


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # One case holds most rows; values repeat and may be null, the id settles ties.
    return [("hot" if i % 4 else rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 2, 3]), i, "x") for i in range(400)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "case_id string, v int, id long, total string").repartition(5)


def wanted(rows):
    out = {}
    for case in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == case), key=lambda r: (r[1] is not None, -(r[1] or 0), r[2]))
        out.update({r[2]: n for n, r in enumerate(mine, 1)})
    return out


def test_every_row_gets_its_rank(frame, rows):
    index = order_index(frame.drop("total"), ["case_id"], [F.desc_nulls_first("v"), F.asc("id")], "position")
    assert {r.id: r.position for r in index.rows.collect()} == wanted(rows)
    assert {r.case_id: r.total for r in index.totals.collect()} == {c: sum(r[0] == c for r in rows) for c in {r[0] for r in rows}}
    page = index.page(limit=7, offset=3).collect()
    want = {i: n for i, n in wanted(rows).items() if 3 < n <= 10 and rows[i][0] is not None}
    assert {r.id: r.position for r in page} == want and all(r.total == sum(x[0] == r.case_id for x in rows) for r in page)
    assert index.page(limit=5, offset=10_000).count() == 0
    for limit, offset in ((0, 0), (501, 0), (5, -1)):
        with pytest.raises(ValueError):
            index.page(limit, offset)
    with pytest.raises(ValueError):
        order_index(frame, [], [F.asc("id")])


def test_empty_table_and_one_limit(frame, rows):
    order = [F.desc_nulls_first("v"), F.asc("id")]
    empty = order_index(frame.drop("total").limit(0), ["case_id"], order)
    assert empty.rows.count() == 0 and empty.totals.count() == 0 and empty.page().count() == 0
    whole = {r.id: r["rank"] for r in first_or_all(frame, ["case_id"], order, None).collect()}
    first = {r.id: r["rank"] for r in first_or_all(frame, ["case_id"], order, 4).collect()}
    assert whole == wanted(rows) and first == {i: n for i, n in whole.items() if n <= 4}


def test_a_page_reads_only_its_ranks(frame):
    page = order_index(frame.drop("total"), ["case_id"], [F.asc("id")], "position").page(limit=5, offset=20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(position,20), LessThanOrEqual(position,25)" in plan


def test_filtered_pages(spark):
    groups = spark.createDataFrame([("c", f"GRP-{i:06d}", "process" if i % 3 else "network") for i in range(1, 10)], "case_id string, group_uid string, kind string")
    got = search.group_pages(groups, limit=2, offset=1, kind="network").orderBy("position").collect()
    assert [(r.group_uid, r.position, r.total) for r in got] == [("GRP-000006", 2, 3), ("GRP-000009", 3, 3)]
    assert {r.total for r in search.group_pages(groups).collect()} == {9}


def test_long_numbers_keep_their_digits(spark):
    got = spark.createDataFrame([(7,), (999_999,), (1_234_567,)], "n long").select(uid("EVT-", F.col("n")).alias("u")).collect()
    assert [r.u for r in got] == ["EVT-000007", "EVT-999999", "EVT-1234567"]


def test_a_complete_timeline_is_not_stored_twice_nor_with_columns_it_does_not_show(spark, monkeypatch):
    ev = fixtures.frame(spark, fixtures.random_events(61, n=80))
    none = spark.createDataFrame([], "case_id string, id long, kind string, finding_uid string")
    found = spark.createDataFrame([], "case_id string, finding_uid string, rule_id string, title string, severity string, anchor_score double")
    lk = links.links(ev)
    want = timeline.timeline(ev, found, none, lk).entries.orderBy("case_id", "position").collect()
    stored, again, store, check = [], [], timeline.parquet_stage, ranking.reliable_checkpoint
    monkeypatch.setattr(timeline, "parquet_stage", lambda df: stored.append(df.columns) or store(df))
    monkeypatch.setattr(ranking, "reliable_checkpoint", lambda df: again.append(df.columns) or check(df))
    got = timeline.timeline(ev, found, none, lk, ViewParams(timeline_max=None)).entries.orderBy("case_id", "position").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) > 40
    assert not again and "metadata" not in stored[0] and len(stored) == 1
