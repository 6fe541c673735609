"""Token counts, periodic runs and collocations against the library, plain loops and hand-made cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracemill.llm import collocations, periodic_runs, queries, token_counts

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, runs string, id string, phrase string, f long"
ODD = ["", None, " ", "   ", "  a  b\n c", "a \n\tb", "it's 's  x''s", "x  y", "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>x  <|endoftext|>",
       " lead", "trail ", "é　 z", "日本語 😀 \U0001e6c0\U00010940x", "\x1c \x85 \xa0 x", "a​ b ՘c", "word " * 30_000, "n" * 20_000, "1234567 89,0 $5.00!!  ?",
       "same same", "same same", "<|endoftext", "\r\n \r\n  x"]


def frame(spark, texts, langs=None):
    langs = langs or [None] * len(texts)
    return spark.createDataFrame([(i, t, g, "r", "i", "p", 1) for i, (t, g) in enumerate(zip(texts, langs))], DDL)


@pytest.mark.parametrize("slice_chars", [3, 1 << 20])
def test_counts_equal_the_library(slice_chars):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    vocabulary = open(path, encoding="utf-8").read()
    library, proven = Tokenizer.from_file(path), token_counts.prove(vocabulary)
    assert len(proven) > 49_000 and all(len(library.encode(t).ids) == 1 for t in random.Random(1).sample(proven, 2000))
    counter = token_counts.TokenCounter(vocabulary, proven, most_known=50_100, slice_chars=slice_chars)
    rng = random.Random(2)
    made = ["".join(rng.choices(["a", "the", " ", "  ", "\n", "'s", "'", "1", "!", "é", "日", "<|endoftext|>", "\t", "\xa0", "ß̈", "\U0001f600"], k=rng.randint(1, 30))) for _ in range(1500)]
    for text in [*(t or "" for t in ODD), *made]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_token_count_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    docs = frame(spark, ODD).unionByName(frame(spark, [ODD[4]]))
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, queries.vocabulary("byte_bpe_50k.json")).collect())
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(ODD), (0, ODD[4])]]
    assert got == sorted(want)
    assert token_counts.token_counts(docs.limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0
    rows = queries.QUERIES["op11_token_counts"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(ValueError):
        token_counts.TokenCounter(open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8").read(), [])


def brute_runs(words, least=12):
    """All maximal runs: every period's maximal stretches, each kept at its smallest period."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= 2 * p:
                best.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in best.items() if e - s >= max(least, 2 * p))


def brute_kept(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def nested(rng):
    """Periods made of periodic pieces, so that whole regions have no synchronising positions."""
    word = rng.choices("ab", k=rng.randint(1, 3))
    for _ in range(rng.randint(1, 4)):
        word = word * rng.randint(2, 12)
        word = word[:rng.randint(max(1, len(word) - 5), len(word))] + rng.choices("abc", k=rng.choice([0, 0, 1, 2]))
        if len(word) > 150:
            break
    return word * rng.randint(2, 3)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [fibonacci(rng.randint(50, 400)), ["x"] * 300, [], ["a"], list("ab" * 7), list("abababa" * 9), list(("a" * 40 + "b") * 4), list(("ab" * 30 + "a") * 5)]
    for _ in range(25):
        texts.append(rng.choices("ab", k=rng.randint(0, 120)))
        texts.append(nested(rng)[:700])
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(12, 150))]
        texts.append((rng.choices("abc", k=rng.randint(0, 40)) + base * rng.randint(2, 4))[:rng.randint(30, 500)] + rng.choices("abcd", k=rng.randint(0, 20)))
    found, kept = periodic_runs._of_texts([" ".join(t) for t in texts], 12)
    for text, runs, rest in zip(texts, found, kept):
        want = brute_runs(text)
        assert sorted(runs) == want, "".join(text)
        assert runs == sorted(runs, key=lambda r: (r[0], r[2])) and rest == brute_kept(text, want)


def test_small_runs_are_found_when_asked_for():
    rng = random.Random(9)
    texts = [rng.choices("abc", k=60) for _ in range(50)]
    found, _ = periodic_runs._of_texts([" ".join(t) for t in texts], 2)
    assert [sorted(f) for f in found] == [brute_runs(t, 2) for t in texts]


def wanted_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(brute_kept(words, runs)))


def test_run_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 12_000}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    wrong = [i for i, t in texts.items() if got[i] != wanted_digest(i, t)]
    assert not wrong and sum(got[i][1] > 0 for i in texts) > 10


def test_runs_of_hostile_rows(spark):
    rng = random.Random(3)
    texts = ["", None, "  ", "one", "a b " * 20, "a b " * 20, " ".join(rng.choices("ab", k=200)), "é ü " * 15, "long " * 40_000, "x\ty\nz " * 9]
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, "q r s " * 8, None, None, None, None, None)], DDL))
    made = periodic_runs.periodic_runs(docs.repartition(3), group_chars=100)
    assert made.columns == ["doc_id", "runs", "collapsed"]
    rows = {r.doc_id: r for r in made.collect()}
    for i, text in [*enumerate(texts), (None, "q r s " * 8)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = [(0, 40_000, 1)] if i == 8 else brute_runs(words)
        assert sorted(tuple(r) for r in rows[i].runs) == want and rows[i].collapsed == ("long" if i == 8 else brute_kept(words, want))
    planted = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(docs.filter("doc_id is null or doc_id <> 8")))).collect()
    assert Counter(tuple(r)[1:] for r in planted if r.doc_id is not None) == Counter(wanted_digest(i, t)[1:] for i, t in enumerate(texts) if i != 8)
    assert periodic_runs.digest(periodic_runs.periodic_runs(docs.limit(0))).count() == 0


def brute_collocations(rows, least, share, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            if len(phrase) == 2 and any(len(t) == 3 and c >= least and 100 * c >= share * a and phrase in (t[:2], t[1:]) for t, c in counts.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[phrase[:k]] * counts[phrase[k:]]), k, counts[phrase[:k]], counts[phrase[k:]]) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("every", [1, 3, 10**9])
def test_collocations_equal_brute_force(spark, every):
    rng = random.Random(every)
    texts = ["", None, " ", "....", "Éa éA", "the The THE the", "a", "a b", "a b c.a b c\ta b c", "x " * 3000, "\x0bq\x0cr s t!"]
    texts += [" ".join(rng.choices(["New", "york", "city", "the", "of", "ß", "a.", "b,", "c!d", "\n", "日"], k=rng.randint(1, 60))) for _ in range(60)] * 2
    langs = [rng.choice(["en", "de", None, "und"]) for _ in texts]
    docs = frame(spark, texts, langs).repartition(3)
    for least, share, top in ((1, 50, 10**6), (10, 50, 12), (3, 100, 5)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, share=share, top=top, every=every).collect())
        assert got == brute_collocations(zip(texts, langs), least, share, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_frequencies_are_weights(spark):
    """Billions of copies of a passage are counted without reading them, past 32 bits."""
    big = 4_000_000_000
    dictionary = spark.createDataFrame([("en", 0, "a b c", big), ("en", 0, "a b", 7), ("en", 2, "z a b", 3), ("de", 0, "a b c", 1)],
                                       "lang string, shared int, chunk string, f long").coalesce(1)
    counts = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(dictionary, (1, 2, 3)).collect()}
    assert counts == {("en", "a"): big + 7, ("en", "b"): big + 7, ("en", "c"): big, ("en", "z"): 3, ("en", "a b"): big + 7, ("en", "b c"): big,
                      ("en", "z a"): 3, ("en", "a b c"): big, ("en", "z a b"): 3, **{("de", p): 1 for p in ("a", "b", "c", "a b", "b c", "a b c")}}
    pairs = spark.createDataFrame([("en", "a b"), ("en", "b c"), ("de", "b c")], "lang string, phrase string")
    bits = spark.sparkContext.broadcast(collocations.pair_bitmap(pairs))
    assert [tuple(r) for r in collocations.phrase_counts(dictionary, (3,), bits).collect()] == [("en", 3, "a b c", big)]
    assert not any(collocations.pair_bitmap(pairs.limit(0)))


def test_chunks_cover_each_word_once():
    rng = random.Random(4)
    for every in (1, 3, 50):
        for _ in range(40):
            data = " ".join(rng.choices(["ab", "cd", "EF.", "g", ",", "hi", "é", "\t"], k=rng.randint(0, 80))).encode()
            on, last = (c.to_pylist() for c in collocations.parse(collocations.plain(data), every))
            pieces = [re.findall(rb"[^ \t]+", p.lower()) for p in re.split(rb"[.,;:!?\n-\r]", data)]
            assert sum(len(c.split()) - 2 for c in on) + sum(len(c.split()) for c in last) == sum(map(len, pieces))
            assert all(len(c.split()) > 2 for c in on) and len(last) == sum(map(bool, pieces))


def test_blocks_end_with_a_piece():
    texts = [b"A b. c d, e", b"", b"no end at all " * 30, b"x;" * 50]
    for most in (1, 7, 100, 10**6):
        assert b"\n".join(collocations._blocks(iter(texts), most)).replace(b"\n", b"") == b"".join(map(collocations.plain, texts)).replace(b"\n", b"")
        whole = [w for t in texts for w in re.split(rb"\n", collocations.plain(t)) if w]
        assert [w for b in collocations._blocks(iter(texts), most) for w in b.split(b"\n") if w] == whole
