"""Hash trees against a loop, proofs, and seals of long reports."""

import hashlib

import pytest

from tracemill.operators.hash_tree import FAN, hash_tree


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields) -> str:
    return sha("".join("-" if f is None else f"{len(f)}:{f}" for f in fields))


def root(hashes: list[str]) -> str:
    while True:
        hashes = [sha("".join(hashes[i:i + FAN])) for i in range(0, len(hashes), FAN)]
        if len(hashes) == 1:
            return hashes[0]


@pytest.fixture(scope="module")
def items(spark):
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "e": 256, "f": 257, "g": 700}
    rows = [(k, f"{i * 37 % n:05d}", None if i % 9 == 0 else "" if i % 9 == 1 else f"é{k}{i}") for k, n in sizes.items() for i in range(n)]
    rows += [("d", "00003", "twice")] * 2 + [(None, "00001", "no key")]
    return rows, spark.createDataFrame(rows, "case_id string, item_key string, item string").repartition(5)


def expected(rows):
    out = {}
    for k, key, item in rows:
        if k is not None:
            out.setdefault(k, []).append((key, leaf(key, item)))
    return {k: [h for _, h in sorted(v)] for k, v in out.items()}


def test_roots_equal_a_loop(items):
    rows, frame = items
    want = {k: (len(v), root(v)) for k, v in expected(rows).items()}
    tree = hash_tree(frame, ["case_id"], ["item_key"], ["item_key", "item"])
    assert {r.case_id: (r["items"], r.digest) for r in tree.roots.collect()} == want


def test_proofs_lead_to_the_digest(spark, items):
    rows, frame = items
    want = expected(rows)
    tree = hash_tree(frame, ["case_id"], ["item_key"], ["item_key", "item"])
    asked = [("a", 0), ("c", 15), ("d", 18), ("f", 256), ("g", 0), ("g", 391), ("g", 699), ("g", 700), ("b", -1), ("x", 0)]
    got = {}
    for r in tree.proof(spark.createDataFrame(asked + asked[:2], "case_id string, position long")).orderBy("level").collect():
        got.setdefault((r.case_id, r.position), []).append(r)
    assert set(got) == set(asked[:7])
    for (k, position), steps in got.items():
        own = want[k][position]
        for level, step in enumerate(steps):
            assert step.level == level and len(step.hashes) <= FAN and step.hashes[step.place] == own
            own = sha("".join(step.hashes))
        assert own == root(want[k])


def test_one_changed_item_changes_its_own_key_only(items):
    _, frame = items
    from pyspark.sql import functions as F

    changed = frame.withColumn("item", F.when(F.col("case_id").eqNullSafe("e") & (F.col("item_key") == "00100"), "other").otherwise(F.col("item")))
    first, second = ({r.case_id: r.digest for r in hash_tree(f, ["case_id"], ["item_key"], ["item_key", "item"]).roots.collect()} for f in (frame, changed))
    assert {k for k in first if first[k] != second[k]} == {"e"}


def test_empty_table(items):
    tree = hash_tree(items[1].limit(0), ["case_id"], ["item_key"], ["item_key", "item"])
    assert tree.roots.count() == 0 and tree.proof(items[1].limit(1).selectExpr("case_id", "0L AS position")).count() == 0
