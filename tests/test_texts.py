"""Native CSV and JSON reading against the standard library on hostile texts, and how files spread over tasks."""

import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import texts as T
from tracemill.sources import archives, decode

SCHEMA = "case_id string, evidence_id string, filename string, declared_type string, content binary, recorded_sha256 string"


def one(spark, text, *exprs):
    return spark.createDataFrame([(text,)], "t string").select(*exprs).collect()[0]


def csv_texts():
    rng = random.Random(5)
    made = ["".join(rng.choices(['"', '""', ",", "\n", "\r\n", "a", " ", "é", "b c", "\t", "\xa0", "'"], k=rng.randint(0, 40))) for _ in range(300)]
    return ["a,b\n1,2\n", "a,b", "\n1,2\n", 'a,"b\nc"\n"x ""y""",""\n', 'q"q,"w"z,"open\nend', "a,b\n , \n,\n1,2", 'h\n"' + '""' * 50_000 + '"\n', ",".join("c" * 3000), *made]


def test_csv_equals_the_standard_reader(spark):
    texts = csv_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in frame.select("i", T.csv_cells(T.csv_header(F.col("t"))).alias("h"), F.transform(T.csv_records(F.col("t")), T.csv_cells).alias("r")).collect()}
    for i, text in enumerate(texts):
        rows = list(csv.reader(io.StringIO(text, newline="")))
        header = None if not rows else rows[0] or [""]
        assert got[i].h == header, repr(text)
        assert got[i].r == [r for r in rows[1:] if any(c.strip() for c in r)], repr(text)


def plain(value):
    return "" if value is None else str(value)


def flat(item):
    out = {}
    for key, value in item.items():
        if isinstance(value, dict):
            out.update({f"{key}_{k}": plain(v) for k, v in value.items()})
        elif isinstance(value, list):
            out[key] = ", ".join(map(str, value))
        else:
            out[key] = str(value).lower() if isinstance(value, bool) else plain(value)
    return out


ITEMS = [
    {"b": 1, "a": "x", "z": None, "t": True, "f": 1.5, "i": 12345678901234567890}, {"o": {"y": True, "x": None, "k": "v", "n": 2.0}, "l": [1, "two", None, False, 2.5]},
    {}, {"e": {}, "m": [], "s": "[1]", "p": '{"q": 1}', "u": "é\"\\\n "}, 42, "text", None, [1, 2], True, {"a": "", "w": " x "},
]


def test_json_items_and_fields(spark):
    whole = json.dumps(ITEMS, ensure_ascii=False)
    for text in (whole, json.dumps({"x": 1, "records": ITEMS}), "\n".join(json.dumps(x) for x in ITEMS), f"  {whole}\n"):
        row = one(spark, text, T.json_items(F.col("t")).alias("i"))
        assert len(row.i) == len(ITEMS)
        assert [r.kind == "OBJECT" for r in row.i] == [isinstance(x, dict) for x in ITEMS]
        read = one(spark, text, F.transform(T.json_items(F.col("t")), lambda r: T.json_fields(r["text"])).alias("f"), F.transform(
            T.json_items(F.col("t")), lambda r: T.json_text(r["kind"], r["text"])).alias("raw"))
        for item, fields, raw in zip(ITEMS, read.f, read.raw):
            assert json.loads(raw) == item
            if isinstance(item, dict):
                assert [tuple(e) for e in fields] == list(flat(item).items())


@pytest.mark.parametrize("text, n", [
    ("{}", 1), ("[]", 0), ('{"a":1}', 1), ("{broken", None), ('{"a":1} x', None), ('[{"a":1},]', None), ('{"a":1}\n{"b"', None), ('{"a":1}\n\n{"b":2}\n', 2),
    ('{"data":{"a":1},"logs":[1,2]}', 2), ('{"events":"[1,2]"}', 1), ('{"a":{"b":1,"b":2}}', 1), ("[" * 3 + "]" * 3, 1),
])
def test_json_texts(spark, text, n):
    row = one(spark, text, T.json_items(F.col("t")).alias("i"))
    assert (None if row.i is None else len(row.i)) == n


def test_repeated_names_keep_the_last_value(spark):
    row = one(spark, '{"a":1,"b":2,"a":3}', T.json_fields(F.col("t")).alias("f"), T.last_values(T.paired(
        F.array(F.lit("x"), F.lit("y"), F.lit("x")), F.array(F.lit("1"), F.lit("2"), F.lit("3")))).alias("p"))
    assert [tuple(e) for e in row.f] == [("a", "3"), ("b", "2")] and [tuple(e) for e in row.p] == [("x", "3"), ("y", "2")]


def test_a_large_file_is_read_by_several_tasks(spark):
    body = ("Time Stamp,User\n" + "".join(f"2026-10-06 10:00:00,u{i}\n" for i in range(9_001))).encode()
    wide = json.dumps([{f"k{i}": i} for i in range(200)]).encode()
    files = spark.createDataFrame([("C", e, n, "generic", bytearray(b), hashlib.sha256(b).hexdigest()) for e, n, b in (
        ("E1", "a.csv", body), ("E2", "w.json", wide), ("E3", "l.csv", "naïve,ts\nü,1\n".encode("cp1252")))], SCHEMA)
    got = decode.decode(files)
    slices = decode._slices(decode._parts(files, decode.IngestParams())).filter("evidence_id = 'E1'")
    assert [r.n for r in slices.select("slice", F.size("lines").alias("n")).orderBy("slice").collect()] == [2000] * 4 + [1001]
    assert slices.repartition(16, *decode.PART, "slice").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    parts = {r.evidence_id: r for r in got.parts.collect()}
    assert parts["E1"].n == 9001 and parts["E1"].columns == ["time_stamp", "user"]
    assert sorted(parts["E2"].columns) == sorted(f"k{i}" for i in range(200))  # no limit on columns
    assert parts["E3"].warnings == ["file was not valid UTF-8; decoded using cp1252 fallback"] and parts["E3"].columns == ["na_ve", "ts"]
    rows = got.records.filter("evidence_id = 'E1'").select("row_index", F.element_at("entries", 2)["value"].alias("u")).collect()
    assert sorted(tuple(r) for r in rows) == [(i + 1, f"u{i}") for i in range(9001)]
    assert decode.decode(files.limit(0)).parts.count() == 0


def test_members_with_one_label_stay_apart(spark):
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("a/x.csv", "a//x.csv", "../a/x.csv", "b.json", "c.csv"):
            z.writestr(name, "ts,k\n2026-10-06,1\n" if name.endswith("x.csv") else "{" if name == "b.json" else "")
    data = out.getvalue()
    files = spark.createDataFrame([("C", "E1", "a.zip", "generic", bytearray(data), hashlib.sha256(data).hexdigest())], SCHEMA)
    got = decode.decode(files)
    parts = got.parts.orderBy("entry").collect()
    assert [(p.member_path, p.n, p.reject) for p in parts] == [
        ("a/x.csv", 1, None), ("a/x.csv", 1, None), ("a/x.csv", 1, None), ("b.json", 1, "member could not be parsed: malformed JSON"), ("c.csv", 1, "member header could not be read")]
    assert sorted((r.entry, r.row_index, r.parse_error) for r in got.records.collect()) == [(p.entry, i + 1, p.reject) for i, p in enumerate(parts)]
    assert archives.member_label("..\\x/./../y//") == "y" and archives.member_label("../..") == "unnamed"
