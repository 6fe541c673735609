import ipaddress
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brute import external
from tracemill.functions import predicates as P
from tracemill.functions import records as R
from tracemill.functions.network import external_ip
from tracemill.functions.scores import css_band, suspicion
from tracemill.functions.timestamps import parse_timestamp

STAMPS = [
    ("1759740000", datetime(2025, 10, 6, 8, 40), "UTC (epoch value)"),
    ("1759740000123", datetime(2025, 10, 6, 8, 40, 0, 123000), "UTC (epoch value)"),
    ("2026-10-06 10:00:00.25", datetime(2026, 10, 6, 10, 0, 0, 250000), "assumed UTC (no timezone in source)"),
    ("2026/10/06 10:00:00", datetime(2026, 10, 6, 10), "assumed UTC (no timezone in source)"),
    ("10/06/2026 1:02:03", datetime(2026, 10, 6, 1, 2, 3), "assumed UTC (no timezone in source)"),
    ("2026-10-06", datetime(2026, 10, 6), "assumed UTC (no timezone in source)"),
    ("[06/oct/2026:10:00:00 -0800]", datetime(2026, 10, 6, 18), "UTC (source offset converted) from -0800"),
    ("06/Oct/2026:10:00:00", datetime(2026, 10, 6, 10), "UTC (source offset +0000)"),
    ("2026-10-06T10:00:00Z", datetime(2026, 10, 6, 10), "UTC (source offset +0000)"),
    ("2026-10-06 10:00:00 +05:30", datetime(2026, 10, 6, 4, 30), "UTC (source offset converted) from +0530"),
    ("2026-03-08 02:30:00", datetime(2026, 3, 8, 2, 30), "assumed UTC (no timezone in source)"),
]


def test_timestamps(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in STAMPS], "t string").select("t", parse_timestamp(F.col("t")).alias("p"))
    got = {r.t: (r.p.value, r.p.tz_note, r.p.reason) for r in df.collect()}
    assert got == {t: (v, n, None) for t, v, n in STAMPS}


@pytest.mark.parametrize("text,reason", [
    (None, "missing timestamp value"), ("  ", "missing timestamp value"), ("2026", "invalid timestamp format: '2026'"),
    ("2026-02-30 00:00:00", "invalid timestamp format: '2026-02-30 00:00:00'"), ("it's", "invalid timestamp format: \"it's\""),
    ("x" * 80, f"invalid timestamp format: '{'x' * 64}'"), ("2026-10-06 10:00:60", "invalid timestamp format: '2026-10-06 10:00:60'"),
])
def test_bad_timestamps(spark, text, reason):
    (r,) = spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t")).alias("p")).collect()
    assert (r.p.value, r.p.reason) == (None, reason)


def test_external_addresses(spark):
    rng = random.Random(7)
    edges = ["0.0.0.0", "10.0.0.0", "100.64.0.1", "127.1.1.1", "169.254.0.1", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0",
             "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.1.1", "192.0.2.5", "192.167.1.1", "192.168.0.1", "198.17.0.1", "198.18.0.1", "198.19.9.9",
             "198.20.0.1", "198.51.100.1", "203.0.113.1", "223.9.9.9", "224.0.0.1", "240.0.0.1", "255.255.255.255", "256.1.1.1", "01.1.1.1", "1.1.1", " 8.8.8.8 ",
             "", "x", "::", "::1", "2001:db8::1", "2001:4860::8888", "2001:1::1", "2001:1::3", "2001:20::1", "2002::1", "fe80::1%eth0", "2600::1%eth0",
             "2600:1:2:3:4:5:6:7", "2600:1:2:3:4:5:6:7:8", "2600::1::2", "::ffff:8.8.8.8", "2600::1.2.3.4", "fc00::1", "ff02::1", None]
    edges += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    edges += [str(ipaddress.IPv6Address((2 << 124) | rng.getrandbits(124))) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in edges], "v string").withColumn("e", external_ip(F.col("v")))
    wrong = [r.v for r in df.collect() if r.e != external(r.v)]
    assert wrong == []


def test_micros_ignore_the_session_zone(spark):
    times = [datetime(2026, 3, 8, 2, 30, 0, 5), datetime(1969, 12, 31, 23, 59, 59), datetime(2026, 11, 1, 1, 30)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = df.select("t", P.micros(F.col("t")).alias("us"), P.from_micros(P.micros(F.col("t"))).alias("back"), P.clock("t").alias("c")).collect()
    for r in got:
        delta = r.t - datetime(1970, 1, 1)
        assert r.us == (delta.days * 86400 + delta.seconds) * 10**6 + delta.microseconds
        assert (r.back, r.c) == (r.t, r.t.strftime("%H:%M"))


def test_suspicion_score_and_bands(spark):
    df = spark.createDataFrame([("High", 0.9, 3), ("Low", None, 1), (None, 0.95, 2), ("Critical", 1.0, 9)], "s string, a double, n int")
    got = [(r.c.total, r.c.band) for r in df.select(suspicion(F.col("s"), F.col("a"), F.col("n")).alias("c")).collect()]
    assert got == [(0.815, "Potentially suspicious - high priority"), (0.3, "Informational"), (0.4325, "Low interest"), (1.0, "Potentially suspicious - high priority")]
    edges = spark.createDataFrame([(0.75,), (0.55,), (0.35,), (0.3499,)], "x double").select(css_band(F.col("x")).alias("b"))
    assert [r.b for r in edges.collect()] == ["Potentially suspicious - high priority", "Anomalous - review", "Low interest", "Informational"]


def test_columns_and_detection(spark):
    names = spark.createDataFrame([("Source IP",), ("@timestamp",), ("  __X--y ",)], "c string")
    assert [r.n for r in names.select(R.normalize_column(F.col("c")).alias("n")).collect()] == ["source_ip", "timestamp", "x_y"]
    shapes = [
        ("timestamp,user,host,source_ip,action,result", None, "authentication"), ("timestamp,user,host,file_path,action,result", None, "authentication"),
        ("timestamp,user,host,file_path,action,result", "file_activity", "file_activity"), ("timestamp,host,user,process,action,pid,parent_process,command_line", None, "process"),
        ("timestamp,host,process,source_ip,destination_ip,destination_port,protocol,action", None, "network"), ("timestamp,user,host,url,domain,action", None, "browser"),
        ("timestamp,event_type,source,host,user,message", None, "system"), ("time,colour", None, "generic"), ("a,b", None, None), ("timestamp,user,host,action", None, "generic"),
    ]
    df = spark.createDataFrame([(c.split(","), d) for c, d, _ in shapes], "c array<string>, d string")
    assert [r.s for r in df.select(R.detect_source(F.col("c"), F.col("d")).alias("s")).collect()] == [w for _, _, w in shapes]
    hints = spark.createDataFrame([("x/auth_logs.csv",), ("net.csv",), ("syslog.txt",), ("plain.csv",)], "p string")
    assert [r.h for r in hints.select(R.name_hint(F.col("p")).alias("h")).collect()] == ["authentication", "network", "system", None]


def test_fields_of_distinct_names_are_taken_as_they_are(spark):
    rows = [([("ts", "1"), ("usr", "a"), ("other", "x")],), ([("usr", ""), ("user", "b"), ("account", "c"), ("x", None)],), ([],), (None,)]
    df = spark.createDataFrame(rows, "e array<struct<key:string,value:string>>")
    fields = R.canonical_fields(F.col("e"))
    assert [r[0] for r in df.select(fields).collect()] == [{"timestamp": "1", "user": "a", "other": "x"}, {"user": "b"}, {}, None]
    assert "map_from_entries" in df.select(fields)._jdf.queryExecution().analyzed().toString()
