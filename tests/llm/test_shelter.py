"""Stages on tables whose columns are called like the stages' own helpers, and on other hostile rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import line_spread, mixing, multi_index, near_dedup, toxicity

CLASHES = ["__gone", "__lines", "__removed", "__row", "__own", "__h", "__rate", "__copy", "__named", "__features", "__vector", "__raw", "__score",
           "__level", "__probability", "__margin", "__class"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    texts = ["", None, " ", "\n\n", "word " * 20_000, "same text here for all\nand a line"] + ["same text here for all\nand a line"] * 2
    for i in range(60):
        texts.append(" ".join(rng.choices(["alpha", "beta", "gamma", "delta"] + ["you idiot", "fool"] * (i % 5 == 0), k=rng.randint(3, 60))))
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "a", 5), (None, "no id at all", "en", "b", 3)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.filter("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.col("text").rlike("idiot|fool").cast("int").alias("toxic")).distinct().write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_clashing_columns_stay_as_they_are(spark, docs, tables, name):
    out = STAGES[name](spark, docs, tables)
    assert out.columns[:len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for c in CLASHES)
    bare = STAGES[name](spark, docs.drop(*CLASHES), tables)
    key = lambda r: (str(r.doc_id), r.text or "")
    assert sorted(map(key, rows)) == sorted(map(key, bare.collect()))
    assert STAGES[name](spark, docs.limit(0), tables).count() == 0


def test_counts_beside_columns_of_their_names(docs):
    out = line_spread.drop_spread_lines(docs, min_sites=2)
    assert out.columns == [*docs.columns, "__lines_", "__removed_"]
    assert {r.doc_id: r["__lines_"] for r in out.collect()}[3] == 3


def test_vectors_of_extreme_size_have_cosines(spark):
    vectors = [[1e200, 1e200], [1e200, 2e200], [1e-200, 1e-200], [3.0, 3.0], [1e308, -1e308], [5e-324, 0.0], [1.0, 0.0]]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in multi_index.search(frame, F.col("vec_id") == 0, k=6).collect()}
    want = {1: 3 / 10 ** 0.5, 2: 1.0, 3: 1.0, 4: 0.0, 5: 0.5 ** 0.5, 6: 0.5 ** 0.5}
    assert len(got) == 6 and all(abs(got[0, i] - s) < 1e-12 for i, s in want.items())
