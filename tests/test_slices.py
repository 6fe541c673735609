import random

from pyspark.sql import functions as F

from tracemill.operators import slices as S


def points(spark, seed, n=400, span=3000):
    rng = random.Random(seed)
    rows = sorted({(rng.choice("aab"), rng.randrange(-span, span)) for _ in range(n)})
    return [(k, u, rng.randrange(1, 5)) for k, u in rows]


def test_sliding_both_ways(spark):
    rows = points(spark, 1)
    rows = [(k, u, c - 1) for k, u, c in rows]
    df = spark.createDataFrame(rows, "k string, us long, c long")
    for forward in (True, False):
        got = {(r.k, r.us): (r.s, r.e) for r in S.sliding(df, ["k"], "us", 70, "c", "s", "e", forward).collect()}
        for k, u, _ in rows:
            lo, hi = (u, u + 70) if forward else (u - 70, u)
            inside = [(c, x) for kk, x, c in rows if kk == k and lo <= x <= hi]
            edges = [x for c, x in inside if c > 0]
            assert got[k, u][0] == sum(c for c, _ in inside)
            if edges:
                assert got[k, u][1] == (max(edges) if forward else min(edges))


def test_next_instant_and_as_of(spark):
    rows = points(spark, 2)
    df = spark.createDataFrame(rows, "k string, us long, c int")
    got = {(r.k, r.us): r.n for r in S.next_instant(df, ["k"], "us", 40, {"n": "us"}).collect()}
    for k, u, _ in rows:
        later = [x for kk, x, _ in rows if kk == k and u < x]
        nxt = min(later, default=None)
        assert got[k, u] == (nxt if nxt is not None and nxt - u <= 40 else None)
    right = [(k, u + 3, c) for k, u, c in points(spark, 3, n=60)]
    rdf = spark.createDataFrame(right, "k string, us long, v int").dropDuplicates(["k", "us"])
    right = [tuple(r) for r in rdf.collect()]
    rdf = spark.createDataFrame(right, "k string, us long, v int")
    hits = {(r.k, r.us): (r.matched_us, r.v) for r in S.nearest_preceding(df, rdf, ["k"], "us", 55, "v").collect()}
    for k, u, _ in rows:
        prior = [(x, v) for kk, x, v in right if kk == k and 0 <= u - x <= 55]
        assert hits.get((k, u)) == max(prior, default=None)


def test_near_any(spark):
    rows = points(spark, 4)
    marks = points(spark, 5, n=25)
    df = spark.createDataFrame(rows, "k string, us long, c int")
    mdf = spark.createDataFrame(marks, "k string, us long, c int").select("k", "us")
    got = {(r.k, r.us): r.near for r in S.near_any(df, mdf, ["k"], "us", 30, "near").collect()}
    for k, u, _ in rows:
        assert got[k, u] == any(kk == k and abs(u - x) <= 30 for kk, x, _ in marks)


def test_top_k_and_numbering(spark):
    rows = [("hot" if i % 3 else "cold", i, i * 7 % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    got = S.top_k_per_group(df, ["k"], [F.desc("v"), F.asc("id")], 9).collect()
    for k in ("hot", "cold"):
        want = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:9]
        assert [(r.k, r.id, r.v) for r in sorted((r for r in got if r.k == k), key=lambda r: r.rank)] == want
    numbered = S.number_rows(df, ["k"], ["id"], salts=16).collect()
    for k in ("hot", "cold"):
        mine = sorted(r.number for r in numbered if r.k == k)
        assert mine == list(range(1, len(mine) + 1))
    again = S.number_rows(df.repartition(7), ["k"], ["id"], salts=16).collect()
    assert {(r.id, r.number) for r in again} == {(r.id, r.number) for r in numbered}
