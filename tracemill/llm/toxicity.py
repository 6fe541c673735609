"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, sheltered, staged, text_of

# A small seed lexicon of insults and the second-person pronouns of the four languages.
SEED_LEXICON = frozenset((
    "idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "fool", "jerk", "garbage",
    "imbecile", "freak", "creep", "coward", "liar", "filth", "vermin", "hate", "ugly",
    "dummkopf", "trottel", "abschaum", "idioten", "versager", "ekelhaft",
    "idiota", "imbécil", "estúpido", "estúpida", "basura", "asqueroso", "payaso",
    "imbécile", "crétin", "ordure", "connard", "abruti", "dégoûtant",
))
SECOND_PERSON = frozenset((
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "ti", "tus", "usted", "ustedes", "vosotros",
    "toi", "vous", "votre", "vos", "ton", "ta",
))
#: Look-alikes of letters inside words.
LOOKALIKES = str.maketrans("01345@$!", "oieasasi")

FEATURES = (
    "seed_density", "word_density", "stem_density", "any_hits", "log_hits", "strongest", "weight_density", "near_second_person",
    "second_person_density", "capitals", "shouted_words", "exclamation", "punctuation", "obfuscated", "obfuscated_hits", "digits", "log_words",
)
_WORD = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W\d_]+[@$!*#.0-9]+[^\W\d_]+")
_STEMS = (4, 5, 6)


@dataclass
class Lexicon:
    """Learned weights of whole words and of word beginnings (a beginning ends in "-")."""

    words: dict[str, float]
    stems: dict[str, float]


def terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + "-" for w in words for n in _STEMS if len(w) > n}


def learn_lexicon(labelled: DataFrame, least_docs: int = 8, least_ratio: float = 2.5, most_terms: int = 1000) -> Lexicon:
    """Terms of (text, label) rows whose smoothed log odds of label 1 are at least ``least_ratio``.

    Tasks count documents per term and label, Spark adds the counts. The
    lexicon is part of the model: ``most_terms`` bounds it, strongest first.
    A beginning is left out when it says no more than a longer term it covers.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(terms(text))
        both = list(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][t] for t in both], pa.int64()), pa.array([seen[0][t] for t in both], pa.int64())], names=["term", "toxic", "clean"])
        rest = [t for t in seen[0] if t not in seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([seen[0][t] for t in rest], pa.int64())], names=["term", "toxic", "clean"])

    totals = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, {})
    sums = labelled.select("text", "label").mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    chosen = sums.filter(F.col("toxic") >= min(least_docs, max(2, n1 // 4))).withColumn("odds", odds).filter(F.col("odds") >= least_ratio).orderBy(
        (F.col("odds") * F.sqrt("toxic")).desc(), "term").limit(most_terms).collect()
    found = {r["term"]: (float(r["odds"]), r["toxic"]) for r in chosen}
    stems = {t[:-1]: v[0] for t, v in found.items() if t.endswith("-")}
    return Lexicon({t: v[0] for t, v in found.items() if not t.endswith("-")}, stems)


_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("a"):ord("z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[ord("!")] = 4
_CLASS[[ord(c) for c in "\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = 5


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES; all 0 for an empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    lower = text.lower()
    words = _WORD.findall(lower)
    n = max(1, len(words))
    counted = Counter(words)
    weights: dict[str, float] = {}
    seeds = learned = begun = 0
    for w in counted:
        value = 0.0
        if w in SEED_LEXICON:
            seeds, value = seeds + counted[w], 3.0
        if w in lexicon.words:
            learned, value = learned + counted[w], max(value, lexicon.words[w])
        stem = max((lexicon.stems.get(w[:k], 0.0) for k in _STEMS if len(w) > k), default=0.0)
        if stem:
            begun, value = begun + counted[w], max(value, stem)
        if value:
            weights[w] = value
    hits = sum(counted[w] for w in weights)
    near = 0
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON] if weights or not SECOND_PERSON.isdisjoint(counted) else []
    if weights and second:
        places = np.array(second)
        at = np.array([i for i, w in enumerate(words) if w in weights])
        right = np.searchsorted(places, at)
        gap = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - at), np.abs(at - places[np.maximum(right - 1, 0)]))
        near = int((gap <= 5).sum())
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
    masked = _MASKED.findall(lower)
    unmasked = sum(1 for m in masked if (plain := re.sub(r"[^\w]|_", "", m.translate(LOOKALIKES))) in SEED_LEXICON or plain in lexicon.words)
    return [
        seeds / n, learned / n, begun / n, float(hits > 0), math.log1p(hits), max(weights.values(), default=0.0),
        sum(counted[w] * v for w, v in weights.items()) / n, near / max(1, hits), len(second) / n,
        float(kinds[1] / max(1, kinds[1] + kinds[2])), sum(1 for w in text.split() if len(w) > 2 and w.isupper()) / n,
        float(kinds[4] / len(raw)), float((kinds[4] + kinds[5]) / len(raw)), len(masked) / n, unmasked / n, float(kinds[3] / len(raw)), math.log1p(len(words)),
    ]


def with_features(docs: DataFrame, lexicon: Lexicon, text_column: str = "text", to: str = "features", keep_text: bool = False) -> DataFrame:
    """``docs`` with an array of the features, and with its text only if asked for; no shuffle."""
    at = docs.columns.index(text_column)
    names = [*[c for c in docs.columns if keep_text or c != text_column], to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                made = pa.array([features(t or "", lexicon) for t in batch.column(at).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if keep_text or i != at], made], names=names)

    return docs.mapInArrow(run, extended((docs if keep_text else docs.drop(text_column)).schema, f"{to} array<double>"))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Model | None
    calibration: Model | None
    prior: float

    def score(self, docs: DataFrame, text_column: str = "text", to: str = "score", keep_text: bool = False) -> DataFrame:
        """``docs`` with the calibrated probability of label 1, and with its text only if asked for."""
        done = with_features(docs, self.lexicon, text_column, "__features", keep_text)
        if self.trees is None:
            return done.drop("__features").withColumn(to, F.lit(self.prior))
        raw = self.trees.transform(done.withColumn("__vector", array_to_vector("__features"))).withColumn("__raw", vector_to_array("__probability")[1])
        level = self.calibration.transform(raw)
        # Isotonic steps are flat; a hundredth of the raw probability keeps the order inside a step.
        blended = F.col("__level") * 0.99 + F.col("__raw") * 0.01
        return level.select(*[c for c in docs.columns if keep_text or c != text_column], F.least(F.greatest(blended, F.lit(0.0)), F.lit(1.0)).alias(to))


def fold(id_column: Column, n: int = 5) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def fit(labelled: DataFrame, most_rows: int = 30_000, trees: int = 20, depth: int = 4, seed: int = 7) -> ToxicityModel:
    """Fits on rows (id, text, label); label 0 or 1, other labels are left out.

    At most about ``most_rows`` rows are used, drawn by the hash of the id
    (all rows when there are fewer): half of them give the lexicon, a third the
    trees, the rest the calibration, so that no part is fitted on words the
    lexicon was read from. With one label only, the score is its share.
    """
    usable = labelled.filter(F.col("label").isin(0, 1)).select("id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    total = usable.count()
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    if total > most_rows:
        usable = usable.filter(draw < int(1_000_000 * most_rows / total))
    part = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(6))
    rows = staged(usable.withColumn("part", part), "toxicity-sample")
    lexicon = learn_lexicon(rows.filter("part < 3"))
    ready = staged(with_features(rows.filter("part >= 3").select("id", "text", "label", "part"), lexicon).withColumn("label", F.col("label").cast("double")), "toxicity-features")
    counts = {(r["late"], r["label"]): r["count"] for r in ready.groupBy((F.col("part") == 5).alias("late"), "label").count().collect()}
    prior = sum(v for k, v in counts.items() if k[1] == 1) / max(1, sum(counts.values()))
    if not counts.get((False, 0.0)) or not counts.get((False, 1.0)):
        return ToxicityModel(lexicon, None, None, prior)
    vectors = ready.select("id", "label", "part", array_to_vector("features").alias("__vector")).coalesce(4)
    booster = GBTClassifier(featuresCol="__vector", labelCol="label", predictionCol="__class", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed,
                            minInstancesPerNode=5).setProbabilityCol("__probability").setRawPredictionCol("__margin")
    grown = booster.fit(vectors.filter("part < 5"))
    late = vectors.filter("part = 5") if counts.get((True, 0.0)) and counts.get((True, 1.0)) else vectors
    raw = grown.transform(late).select("label", vector_to_array("__probability")[1].alias("__raw"))
    level = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__level").fit(raw)
    return ToxicityModel(lexicon, grown, level, prior)


def fit_on(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """Fits on the labelled rows whose crc32(id as text) mod 5 is not 0; labels of the others are never read."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label")).filter(fold(F.col("id")) != 0).filter(F.col("label").isNotNull())
    return fit(docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).join(known, "id"))


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every row; labels of held-out rows are never read.

    A row is held out when crc32(id as text) mod 5 is 0. Only the text makes a
    score; null and empty texts get the score of all-zero features. Rows that
    repeat get equal scores. An id with several labels counts once per label.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    model = fit_on(docs, labels, id_column, text_column, label_column)
    out = model.score(rows)
    return out.select(F.col("id").alias(id_column), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``most``; a null text scores as an empty one."""
    model = fit_on(docs, labels, id_column, text_column)
    docs, named, restored = sheltered(docs)
    return restored(model.score(docs, named(text_column), "__score", keep_text=True).filter(F.col("__score") < most).select(*docs.columns))
