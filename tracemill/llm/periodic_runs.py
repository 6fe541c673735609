"""Maximal repetitions of words, found from string synchronising sets."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

_WORD = re.compile(r"[^ \t-\r]+")
#: Periods below this are found by comparing the words with themselves at each distance.
_DIRECT = 12
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Sequences:
    """Word codes of documents one behind the other, longest first, each closed by a code of its own.

    ``names[k]`` holds hashes of the windows of 2 ** k codes. Only documents
    with that many words are in it; they are a prefix, as the longest come first.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, seed: int):
        self.codes, self.lengths = codes, lengths
        self.ends = np.cumsum(lengths + 1)
        self.names = [_mixed(codes.astype(np.uint64), np.full(len(codes), seed, np.uint64))]
        while (n := self.prefix(2 ** len(self.names))) > 0:
            below, half = self.names[-1], 2 ** (len(self.names) - 1)
            windows = n - 2 * half + 1
            self.names.append(_mixed(below[:windows], below[half:half + windows]))

    def prefix(self, words: int) -> int:
        """Codes of the documents with at least ``words`` words."""
        docs = int(np.searchsorted(-self.lengths, -words, "right"))
        return int(self.ends[docs - 1]) if docs else 0

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many codes agree from i and j on, or before them."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            a, b = (i - length - step, j - length - step) if back else (i + length, j + length)
            inside = (a >= 0) & (np.maximum(a, b) < len(name))
            same = np.zeros(len(i), bool)
            same[inside] = name[a[inside]] == name[b[inside]]
            length[same] += step
        return length

    def runs_at(self, i: np.ndarray, period: np.ndarray) -> np.ndarray:
        """(start, end, period) of the maximal stretches around i with the period, if twice as long as it."""
        start, end = i - self.common(i, i + period, back=True), i + period + self.common(i, i + period)
        found = np.stack([start, end, period], 1)
        return found[end - start >= 2 * period]


def _distinct(runs: np.ndarray) -> np.ndarray:
    """One row a stretch, with its smallest period, in order of period and start."""
    order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 0], runs[:, 2]))]


def _small_periods(codes: np.ndarray) -> list[np.ndarray]:
    found = []
    for period in range(1, min(_DIRECT, len(codes))):
        at = np.flatnonzero(codes[period:] == codes[:-period])
        if len(at):
            gap = np.flatnonzero(np.diff(at) > 1)
            start, end = at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [-1]])] + 1 + period
            found.append(np.stack([start, end, np.full(len(start), period)], 1)[end - start >= 2 * period])
    return found


def _synchronising(seq: _Sequences, level: int, n: int, runs: np.ndarray) -> np.ndarray:
    """Synchronising positions at scale 2 ** level: the same wherever the next 2 * scale words are the same.

    Position i is taken if the least hash among the windows that start at
    i .. i + scale is that of the first or the last of them. Windows inside a
    region of period up to scale / 3 have no say; only where all have none,
    positions may be missing.
    """
    scale = 1 << level
    ids = seq.names[level][:n - scale + 1].copy()
    dense = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= scale) & (runs[:, 0] < n)]
    if len(dense):
        step = np.zeros(len(ids) + 1, np.int64)
        np.add.at(step, dense[:, 0], 1)
        np.add.at(step, np.minimum(dense[:, 1] - scale + 1, len(ids)), -1)
        ids[np.cumsum(step[:-1]) > 0] = _NONE
    least, width = ids.copy(), 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    count = n - 2 * scale + 1
    first, last = ids[:count], ids[scale:scale + count]
    least = np.minimum(least[:count], last)
    return np.flatnonzero((least != _NONE) & ((least == first) | (least == last)))


def _equal_contexts(seq: _Sequences, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, distance) of synchronising positions with equal contexts, 3 to 6 scales apart.

    Equal contexts are over a third of the scale apart (else they would lie in
    a region without positions), so a position has at most 18 partners.
    """
    scale = 1 << level
    context = seq.names[level + 1][at]
    order = np.argsort(context, kind="stable")
    context, at = context[order], at[order]
    live, ahead, starts, distances = np.arange(len(at)), 0, [], []
    while len(live):
        ahead += 1
        live = live[live + ahead < len(at)]
        far = at[live + ahead] - at[live]
        near = (context[live] == context[live + ahead]) & (far < 6 * scale)
        live, far = live[near], far[near]
        starts.append(at[live[far >= 3 * scale]])
        distances.append(far[far >= 3 * scale])
    return np.concatenate([*starts, np.empty(0, np.int64)]), np.concatenate([*distances, np.empty(0, np.int64)])


def _from_dense_regions(seq: _Sequences, scale: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, period) that lie where the synchronising set is empty.

    Such a run joins two neighbouring regions of one small period q whose roots
    agree: its period fits the roots' alignment and is at most as long as
    either region and half of both.
    """
    dense = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= 3 * scale)]
    if len(dense) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = dense[:-1], dense[1:]
    joined = (left[:, 2] == right[:, 2]) & (right[:, 0] <= left[:, 1])
    left, right = left[joined], right[joined]
    q = left[:, 2]
    pair = np.repeat(np.arange(len(q)), q)
    turn = np.arange(len(pair)) - np.repeat(np.cumsum(q) - q, q)
    x, y = (left[:, 1] - q)[pair], right[:, 0][pair] + turn
    fits = seq.common(x, y) >= q[pair]
    pair, shift = pair[fits], (y - x)[fits]
    left, right, q = left[pair], right[pair], q[pair]
    low = 3 * scale + (shift - 3 * scale) % q
    high = np.minimum.reduce([np.full(len(q), 6 * scale - 1), left[:, 1] - left[:, 0], right[:, 1] - right[:, 0], (right[:, 1] - left[:, 0]) // 2])
    count = np.maximum((high - low) // q + 1, 0)
    pair = np.repeat(np.arange(len(q)), count)
    period = low[pair] + (np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)) * q[pair]
    return np.maximum(left[pair, 0], right[pair, 0] - period), period


def maximal_runs(codes: np.ndarray, lengths: np.ndarray, least: int = 12) -> np.ndarray:
    """(start, end, smallest period) of all maximal runs of at least ``least`` codes and two periods.

    ``codes`` holds the documents one behind the other, longest first, each
    followed by one code that occurs nowhere else; ``lengths`` are theirs
    without it. Periods from 12 on are found scale by scale: scale s serves
    the periods 3s to 6s - 1. Every run found is compared word by word; should
    hashes ever have misled, all is done again with others.
    """
    for seed in range(1, 10):
        seq = _Sequences(codes, lengths, seed)
        runs = _distinct(np.concatenate([*_small_periods(codes), np.empty((0, 3), np.int64)]))
        level = 2
        while (n := seq.prefix(6 << level)) > 0:
            at, period = _equal_contexts(seq, level, _synchronising(seq, level, n, runs))
            more, others = _from_dense_regions(seq, 1 << level, runs)
            found = seq.runs_at(np.concatenate([at, more]), np.concatenate([period, others]))
            if len(found):
                runs = _distinct(np.concatenate([runs, found]))
            level += 1
        runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, 2 * runs[:, 2])]
        if all(np.array_equal(codes[s:e - p], codes[s + p:e]) for s, e, p in runs):
            return runs
    raise RuntimeError("hashes of word windows collide")


def _of_texts(texts: list[str], least: int) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Per text its runs, by start and period, and the text without repeated periods."""
    words = [_WORD.findall(text) for text in texts]
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    order = sorted(range(len(texts)), key=lambda i: -len(words[i]))
    lengths = np.array([len(words[i]) for i in order], np.int64)
    ends = np.cumsum(lengths + 1)
    codes = np.empty(int(ends[-1]), np.int64)
    for rank, i in enumerate(order):
        codes[ends[rank] - 1 - lengths[rank]:ends[rank] - 1] = np.fromiter(map(numbers.__getitem__, words[i]), np.int64, len(words[i]))
        codes[ends[rank] - 1] = -1 - rank
    runs = maximal_runs(codes, lengths, least)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kept = [" ".join(w) for w in words]
    owner = np.searchsorted(ends, runs[:, 0], "right")
    for rank in np.unique(owner):
        i, mine = order[rank], runs[owner == rank]
        mine = mine - np.array([ends[rank] - 1 - lengths[rank]] * 2 + [0])
        found[i] = [(int(s), int(e - s), int(p)) for s, e, p in mine]
        step = np.zeros(len(words[i]) + 1, np.int64)
        np.add.at(step, mine[:, 0] + mine[:, 2], 1)
        np.add.at(step, mine[:, 1], -1)
        kept[i] = " ".join([w for w, gone in zip(words[i], np.cumsum(step).tolist()) if not gone])
    return found, kept


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 12, group_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, runs, collapsed): the maximal runs of every text's words and the text without their repeats.

    A run is a stretch of words of at least ``least`` words and twice its
    smallest period that no neighbour extends; ``runs`` lists (start, length,
    period) by start, then period. ``collapsed`` joins by single spaces the
    words that no run holds after its first period. Words are cut at ASCII
    white space. No shuffle; a worker holds texts of about ``group_chars``
    characters, or one longer text. Null and empty texts have no runs and an
    empty ``collapsed``; null ids and repeated rows stay, one result each; an
    empty table gives none; other columns are ignored, whatever their names.
    """
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                texts, size, end = [], 0, begin
                while end < batch.num_rows and (end == begin or size < group_chars):
                    texts.append(batch.column(1)[end].as_py())
                    size, end = size + len(texts[-1]), end + 1
                found, kept = _of_texts(texts, least)
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(one)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), runs, pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])
                begin = end

    slim = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_planted_periods(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the documents, chosen by the crc32 of the id, turn periodic behind some word."""
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size("words").cast("bigint"), F.call_function("div", F.col("h"), F.lit(10))
    turned = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), h.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words)).withColumn("a", F.when(n > 0, g % n)).withColumn(
        "p", 1 + F.call_function("div", n - F.col("a"), 3 + g % 8))
    repeated = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(
        F.col("words"), F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")))
    return turned.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Count, longest run and SHA-256 of runs and collapsed texts of ``periodic_runs``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.call_function("div", 1000 * F.col("best.length"), -F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
