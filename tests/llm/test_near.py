"""Near-dedup against a brute force over all pairs, and its samples against the similarity they estimate."""

import random

import numpy as np
import pytest

from tracemill.llm import near_dedup


def profile(text):
    words = text.lower().split()
    runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
    return {r: runs.count(r) for r in set(runs)}


def brute_classes(texts):
    """Classes by all pairs; documents under 1/256 of the corpus have one weight, so plain counts do (small corpora: exact idf below)."""
    import math

    profiles = [profile(t or "") for t in texts]
    n = len(texts)
    df = {}
    for p in profiles:
        for s in p:
            df[s] = df.get(s, 0) + 1
    floor = max(1.0, n / 256)
    idf = {s: 1 + math.log(n / max(d, floor)) / math.log(256) for s, d in df.items()}
    weighted = [{s: c * idf[s] for s, c in p.items()} for p in profiles]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or ""):
                same = True
            else:
                a, b = weighted[i], weighted[j]
                low = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
                high = sum(a.values()) + sum(b.values()) - low
                same = high > 0 and low / high >= 0.8
            if same:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 400))) for _ in range(60)]
    for base in list(texts[:25]):
        for _ in range(rng.randint(1, 4)):
            words = base.split()
            for _ in range(max(1, int(len(words) * rng.choice([0.002, 0.005, 0.06])))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    chain = rng.choices(vocabulary, k=300)
    for step in range(12):  # each is near the next only
        texts.append(" ".join(chain[step * 12: step * 12 + 150]))
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=120)) for _ in range(40)]  # shared passage, not near
    return texts + ["", None, "", " ", "\n", "one two", "One  two", "é", "a b c d e", "A b c D e", texts[3], texts[3], "z " * 30_000, "z " * 30_001]


@pytest.fixture(scope="module", params=[64, 0])
def rows(spark, request):
    """With 0 every late comparison goes through blocks."""
    texts = corpus()
    frame = spark.createDataFrame([(i, t, "n", "l") for i, t in enumerate(texts)], "doc_id long, text string, node string, links string")
    return texts, frame, {r.doc_id: r for r in near_dedup.near_classes(frame, pairs_per_bucket=request.param).collect()}


def test_classes_equal_brute_force(rows):
    texts, _, got = rows
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) and got[i].group_size == want.count(want[i]) for i in got)
    assert len(set(want)) < len(texts) - 40


def test_one_row_of_each_class_stays(rows):
    texts, frame, got = rows
    kept = near_dedup.drop_near(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got.values()})


def test_null_ids_repeated_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (2, None)], "doc_id long, text string")
    got = sorted(near_dedup.near_classes(frame).collect(), key=str)
    assert len(got) == 5 and sorted(r.group_size for r in got) == [1, 1, 3, 3, 3]
    assert near_dedup.drop_near(frame).count() == 3
    assert near_dedup.near_classes(frame.limit(0)).count() == 0


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 5000, 3000)]
    for share in (0.01, 0.05):
        other = [w if rng.random() > share else "new" + w for w in base]
        doc, shingle, count = near_dedup.shingles([" ".join(base), " ".join(other)])
        weight = np.where(shingle % np.uint64(7) == 0, 1.2, 2.0) * count
        _, signs = near_dedup.signatures(doc, shingle, weight, 1024)
        first = doc == 0
        exact = near_dedup.weighted_jaccard((shingle[first], weight[first]), (shingle[~first], weight[~first]))
        assert abs((signs[0] == signs[1]).mean() - exact) < 0.06


def test_blocks_equal_single_pairs():
    texts = [t for t in corpus()[:60] if t and t.split()] + ["a b c d e a b c d e a b c d e", "a b c d e f a b c d e"]
    weights = near_dedup.Weights(np.empty(0, np.uint64), np.empty(0), 2.0)
    each = []
    for t in texts:
        _, shingle, count = near_dedup.shingles([t])
        each.append((shingle, weights.of(shingle, count)))
    grid = near_dedup.similarities(texts[:9] + texts[-2:], texts, weights, width=50)
    for i, a in enumerate(each[:9] + each[-2:]):
        assert np.allclose(grid[i], [near_dedup.weighted_jaccard(a, b) for b in each])


def test_shingles_do_not_depend_on_the_batch():
    texts = ["a b c d e f g", "", "a b", "é ü ö ä ß x", "b c d e f"]
    doc, shingle, _ = near_dedup.shingles(texts)
    for i, text in enumerate(texts):
        assert sorted(near_dedup.shingles([text])[1]) == sorted(shingle[doc == i])


def test_copies_do_not_lower_the_weight_of_their_shingles(spark):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(50_000)}"
    hot = [word() for _ in range(60)]
    texts = [" ".join(hot)] * 400
    for at in (10, 30, 50):
        texts.append(" ".join([*hot[:at], "changed", *hot[at + 1:]]))
    texts += [" ".join(word() for _ in range(60)) for _ in range(800)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_classes(frame).collect()}
    assert {got[i].class_id for i in range(403)} == {0} and got[0].group_size == 403
    assert all(got[i].group_size == 1 for i in range(403, len(texts)))


def test_different_texts_under_one_id_stay_apart(spark):
    rng = random.Random(9)
    words = [[f"u{rng.randrange(50_000)}" for _ in range(60)] for _ in range(3)]
    a, b, c = (" ".join(w) for w in words)
    near_a, near_b = " ".join([*words[0][:-1], "changed"]), " ".join([*words[1][:-1], "changed"])
    rows = [(1, a), (5, near_a), (5, b), (5, c), (5, c), (9, near_b), (9, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_dedup.drop_near(frame).collect()) == sorted([(1, a), (5, b), (5, c)])
    got = sorted((r.doc_id, r.class_id, r.group_size, r.kept) for r in near_dedup.near_classes(frame).collect())
    assert got == sorted([(1, 1, 2, True), (5, 1, 2, False), (5, 5, 2, True), (5, 5, 3, True), (5, 5, 3, True), (9, 5, 2, False), (9, 5, 3, False)])
