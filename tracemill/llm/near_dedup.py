"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.groups import star_components

from .common import row_key, sheltered, staged, text_of

_U = np.uint64
_MIX1, _MIX2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CELLS = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_ODD = _mixed(np.arange(1, 33, dtype=np.uint64)) | _U(1)
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _POWERS[size]


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, 52-bit shingle hash, count), sorted by both; distinct within a document.

    Words are the lower-case runs between ASCII white space; a shingle is
    ``width`` words in a row. A text of fewer words is one shingle of them all;
    a text without words has none. At most 4096 texts at a time.
    """
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    if len(data) <= len(raw):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _powers(len(data) + 1)
    space = _SPACE[data]
    change = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = change[0::2], change[1::2]
    rolled = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    words = _mixed((rolled[ends] - rolled[starts]) * down[starts])
    first_byte = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    doc = np.searchsorted(first_byte, starts, "right") - 1
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    per_doc = np.bincount(doc, minlength=len(raw))
    offset = np.concatenate([[0], np.cumsum(per_doc)])
    left = offset[doc + 1] - np.arange(n)  # words from here to the document's end
    total = words * _ODD[0]
    for k in range(1, min(width, n)):
        total[:-k] += words[k:] * _ODD[k]
    begins = left >= width
    short = np.flatnonzero((per_doc[doc] < width) & (left == per_doc[doc]))
    if len(short):
        total[short] = words[short] * _ODD[0]
        for k in range(1, width):
            inside = short[left[short] > k]
            total[inside] += words[inside + k] * _ODD[k]
        begins[short] = True
    key = np.sort(doc[begins].astype(np.uint64) << _U(52) | _mixed(total[begins]) >> _U(12))
    fresh = np.flatnonzero(np.diff(key, prepend=key[0] ^ _U(1)) if len(key) else key)
    count = np.diff(fresh, append=len(key))
    key = key[fresh]
    return (key >> _U(52)).astype(np.int64), key & _U((1 << 52) - 1), count


@dataclass
class Weights:
    """Inverse document frequencies: exact for shingles of at least ``floor`` documents, one weight for all others."""

    shingle: np.ndarray
    idf: np.ndarray
    rare: float

    def of(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.full(len(shingle), self.rare)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
            out = np.where(self.shingle[at] == shingle, self.idf[at], out)
        return out * count


def _chunks(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of at most 2048 rows and about ``most_bytes`` of text (one long text may exceed it alone)."""
    for batch in batches:
        begin, size = 0, 0
        for i, more in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if i > begin and (size + more > most_bytes or i - begin == 2048):
                yield (part := batch.slice(begin, i - begin)), part.column(column).to_pylist()
                begin, size = i, 0
            size += more
        if batch.num_rows:
            yield (part := batch.slice(begin)), part.column(column).to_pylist()


def learn_weights(texts: DataFrame, documents: int, share: float = 1 / 256) -> Weights:
    """Document frequencies over all texts (one column, ``text``), of which there are ``documents``.

    idf = 1 + ln(N / max(df, share * N)) / ln(1 / share), between 1 and 2: a
    shingle in less than ``share`` of the documents weighs 2. So only shingles
    above the share need their own count, and there are at most (mean distinct
    shingles of a document) / share of them, however large the corpus. They are
    found exactly in two passes: counts per hash cell, summed over all tasks,
    leave the cells that can hold such a shingle; shingles of those cells are
    then counted one by one.
    """
    floor = max(1.0, share * documents)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_CELLS, np.uint32)
        for _, some in _chunks(batches, 0):
            _, hashed, _ = shingles(some)
            sums += np.bincount(hashed.astype(np.int64) & (_CELLS - 1), minlength=_CELLS).astype(np.uint32)
        parts = sums.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        at = [np.flatnonzero(total >= floor) + part * len(total) for part, total in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*at, np.empty(0, np.int64)]), pa.int64())], names=["cell"])

    marked = np.zeros(_CELLS, bool)
    found = texts.mapInArrow(cells, "slice int, counts binary").repartition("slice").mapInArrow(heavy, "cell bigint").collect()
    marked[[r["cell"] for r in found]] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed():
            seen, n = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

        for _, some in _chunks(batches, 0):
            _, hashed, _ = shingles(some)
            held.append(hashed[marked[hashed.astype(np.int64) & (_CELLS - 1)]])
            size += len(held[-1])
            if size > 1_000_000:
                yield summed()
                held, size = [], 0
        yield summed()

    rows = texts.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor).toArrow() if marked.any() else None
    scale = math.log(1 / share)
    if rows is None or not rows.num_rows:
        return Weights(np.empty(0, np.uint64), np.empty(0), 2.0)
    shingle, n = rows.column(0).to_numpy().astype(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(shingle)
    return Weights(shingle[order], 1 + np.log(documents / np.maximum(n[order], floor)) / scale, 1 + min(scale, math.log(max(documents, 1) / floor)) / scale)


def _gamma_table(size: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of ``size`` equal steps, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(size) + 0.5) / size
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), x / 2)
    return x


_GAMMA = _gamma_table()
_R, _LOG_C = _GAMMA.astype(np.float32), np.log(_GAMMA).astype(np.float32)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, hashes: int, seed: int = 11, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, uint32 signature of each): improved consistent weighted sampling.

    For every shingle and hash: r, c ~ Gamma(2, 1) and beta ~ U(0, 1), drawn
    from the shingle's hash; t = floor(ln w / r + beta), y = exp(r (t - beta)),
    a = c / (y exp(r)). The sample is (shingle, t) of the least a; two documents
    share it with a probability of their weighted Jaccard similarity.
    """
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    ends = np.append(starts[1:], len(doc))
    out = np.empty((len(starts), hashes), np.uint32)
    log_weight = np.log(weight).astype(np.float32)
    seeds = _mixed(np.arange(1, hashes + 1, dtype=np.uint64) * _GOLD + _U(seed))
    first = 0
    while first < len(starts):
        last = first + 1
        while last < len(starts) and ends[last] - starts[first] <= step:
            last += 1
        span = slice(starts[first], ends[last - 1])
        x, lw, at = shingle[span], log_weight[span], starts[first:last] - starts[first]
        for k in range(hashes):
            z = (x ^ seeds[k]) * _MIX1
            z ^= z >> _U(29)
            z *= _MIX2
            z ^= z >> _U(32)
            bits = z.view(np.uint16).reshape(-1, 4)
            r = _R[bits[:, 3]]
            beta = bits[:, 2] * np.float32(1 / 65536)
            t = np.floor(lw / r + beta)
            a = _LOG_C[bits[:, 1]] - r * (t - beta + 1)
            rank = ((a + 96) * np.float32(1 << 24)).astype(np.uint64) << _U(32)
            rank |= (z ^ (t.astype(np.int64).view(np.uint64) * _GOLD >> _U(7))) & _U(0xFFFFFFFF)
            out[first:last, k] = np.minimum.reduceat(rank, at)
        first = last
    return doc[starts], out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least weights over sum of greatest weights; inputs are (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(a[1].sum() + b[1].sum() - both, 1e-300))


def _sketches(rows: DataFrame, weights: Weights, bands: int, band_rows: int) -> DataFrame:
    """(node, mass, bands): a row per text with shingles, one 64-bit hash per band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _MIX1)
        for batch, texts in _chunks(batches, 1):
            doc, hashed, count = shingles(texts)
            if not len(doc):
                continue
            weight = weights.of(hashed, count)
            at, signs = signatures(doc, hashed, weight, bands * band_rows)
            mass = np.bincount(doc, weights=weight, minlength=len(texts))[at]
            folded = np.zeros((len(at), bands), np.uint64)
            for k in range(band_rows):
                folded = _mixed(folded * _GOLD + signs.reshape(len(at), bands, band_rows)[:, :, k] + salt)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(folded.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(mass), lists], names=["node", "mass", "bands"])

    return rows.mapInArrow(run, "node bigint, mass double, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs (src, dst) whose texts have a weighted Jaccard similarity of at least ``threshold``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, tuple | None] = (None, None)

        def profile(text: str):
            _, hashed, count = shingles([text])
            return hashed, weights.of(hashed, count)

        for batch in batches:
            src, dst, near = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i in range(batch.num_rows):
                if last[0] != src[i]:
                    last = (src[i], profile(batch.column(2)[i].as_py()))
                near.append(weighted_jaccard(last[1], profile(batch.column(3)[i].as_py())) >= threshold - 1e-9)
            kept = batch.filter(pa.array(near))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["src", "dst"])

    left = texts.select(F.col("node").alias("src"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("dst"), F.col("text").alias("right"))
    joined = pairs.join(right, "dst").join(left, "src").select("src", "dst", "left", "right")
    return joined.mapInArrow(run, "src bigint, dst bigint")


def near_classes(docs: DataFrame, id_column: str = "doc_id", **how) -> DataFrame:
    """(id, class_id, group_size, links, kept): every row with its class of near duplicates, see ``_classes``."""
    return _classes(docs, id_column=id_column, **how).select(F.col("id").alias(id_column), "class_id", "group_size", "links", "kept")


def _classes(docs: DataFrame, threshold: float = 0.8, bands: int = 16, band_rows: int = 4, pairs_per_bucket: int = 64,
             id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, own, h, class_id, group_size, links, kept): every row with its class of near duplicates.

    Texts with a weighted Jaccard similarity of ``threshold`` or more are linked,
    and links are followed: a class is a component, named by its smallest id,
    which is the row that stays. ``links`` is the number of verified links of
    the row's text that the classes rest on (a spanning set, not all pairs).

    1. Equal texts (128-bit hash) become one node, named by 64 bits of that hash; only nodes go on.
       Document frequencies count a node once, so copies do not lower the
       weight of their own shingles.
    2. Every node is sampled and banded. In each bucket all nodes are compared
       with the bucket's smallest node: one pair per row, not all pairs.
    3. Buckets whose nodes are then still in different components are gone
       through again: nodes outside the bucket's most frequent component are
       compared with every node of another component whose total weight
       allows the threshold. No pair that could join two components is left out.
       Buckets that ask for more than ``pairs_per_bucket`` comparisons are
       compared block by block, exactly as well; only links leave a block.

    Null and empty texts are equal to each other and similar to nothing else, as
    are texts without words; texts under five words are one shingle. A null
    id takes part under a number made from its text and is returned as null.
    Rows that repeat an id and text are one row here; different texts under one
    id are nodes of their own and may be in different classes, which then share
    a ``class_id``. ``own`` is the id (or its stand-in), ``h`` the text's hash;
    of two texts under a class's smallest id the one with the smaller hash stays.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    named = rows.select(
        "id", F.coalesce("id", row_key(F.col("id"), F.col("text"))).alias("own"), "text", F.unhex(F.md5("text")).alias("h"))
    copies = staged(
        named.groupBy("h", "own").agg(F.count("*").alias("n")).groupBy("h").agg(F.min(F.struct("own", "n")).alias("least"), F.sum("n").alias("rows"))
        .select("h", F.xxhash64("h").alias("node"), F.col("least.own").alias("own"), F.col("least.n").alias("same"), "rows"), "near-copies")
    # The row of the smallest id carries the text; only rows that repeat it are sorted out by a shuffle.
    carrying = named.join(copies.select("h", "own", "node", "same"), ["h", "own"])
    distinct = staged(
        carrying.filter("same = 1").unionByName(carrying.filter("same > 1").dropDuplicates(["h"])).select("node", "text"), "near-distinct")
    weights = learn_weights(distinct.select("text"), max(1, copies.count()))
    sketches = staged(_sketches(distinct, weights, bands, band_rows), "near-sketches")
    nodes = sketches.dropDuplicates(["node"])
    entries = nodes.select("node", "mass", F.posexplode("bands").alias("band", "bucket"))
    # Each band orders nodes its own way, so a large group meets several centres.
    crowded = entries.groupBy("band", "bucket").agg(
        F.min_by("node", F.xxhash64("node", "band")).alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = staged(entries.join(crowded, ["band", "bucket"]), "near-members")

    pairs = members.filter("node <> centre").select(F.least("centre", "node").alias("src"), F.greatest("centre", "node").alias("dst")).distinct()
    wanted = members.select("node").distinct()
    texts = staged(distinct.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    links = staged(_verified(pairs, texts, weights, threshold), "near-links")

    component = _components(links)
    placed = staged(members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-placed")
    mixed = placed.groupBy("band", "bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    split = placed.join(mixed.select("band", "bucket"), ["band", "bucket"], "left_semi")
    sizes = split.groupBy("band", "bucket", "component").count()
    main = sizes.groupBy("band", "bucket").agg(
        F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("n"), (F.sum("count") - F.max("count")).alias("outside"))
    sorted_in = staged(split.join(main, ["band", "bucket"]), "near-split")
    narrow = F.col("outside") * F.col("n") <= pairs_per_bucket
    late = staged(
        _verified(_crossed(sorted_in.filter(narrow), threshold).join(pairs, ["src", "dst"], "left_anti"), texts, weights, threshold)
        .unionByName(_crossed_in_blocks(sorted_in.filter(~narrow), nodes, texts, weights, threshold)).distinct(),
        "near-late-links",
    )
    every = links.unionByName(late)
    final = component if late.isEmpty() else _components(every)

    degree = every.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    classed = copies.join(final, "node", "left").withColumn("class", F.coalesce("component", "node")).join(degree, "node", "left")
    classed = staged(classed.select("h", "own", "class", "rows", F.coalesce("links", F.lit(0)).alias("links")), "near-classes")
    sizes = classed.groupBy("class").agg(F.sum("rows").alias("group_size"), F.min(F.struct("own", "h")).alias("first"))
    found = named.select("id", "own", "h").join(classed.join(sizes, "class").select("h", "first", "group_size", "links"), "h")
    return found.select("id", "own", "h", F.col("first.own").alias("class_id"), "group_size", "links", (F.struct("own", "h") == F.col("first")).alias("kept"))


def _crossed(split: DataFrame, threshold: float) -> DataFrame:
    """Pairs (src, dst) of a bucket in different components, at least one outside the main one."""
    level = F.floor(F.log("mass") / math.log(1 / threshold)).cast("bigint")
    levelled = split.withColumn("level", level)
    outside = levelled.filter("component <> main").select(
        "band", "bucket", F.col("node").alias("src"), F.col("component").alias("one"), F.col("mass").alias("m"), F.explode(F.array(*[F.col("level") + d for d in (-1, 0, 1)])).alias("level"))
    other = levelled.select("band", "bucket", F.col("node").alias("dst"), F.col("component").alias("two"), F.col("mass").alias("w"), "level")
    return outside.join(other, ["band", "bucket", "level"]).filter(
        (F.col("one") != F.col("two")) & (F.least("m", "w") >= threshold * F.greatest("m", "w") * 0.999999)
    ).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _levels(texts: list[str], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight): a shingle that occurs n times is n elements, so shared weight is a dot product."""
    doc, shingle, count = shingles(texts)
    idf = weights.of(shingle, np.ones(len(shingle)))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    element = np.repeat(shingle, count)
    element = np.where(nth > 0, _mixed(element + nth.astype(np.uint64) * _GOLD), element)
    return np.repeat(doc, count), element, np.repeat(idf, count)


def similarities(left: list[str], right: list[str], weights: Weights, width: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarity of every left text with every right text."""
    a, b = _levels(left, weights), _levels(right, weights)
    shared = np.intersect1d(a[1], b[1])
    both = np.zeros((len(left), len(right)))
    for begin in range(0, len(shared), width):
        part = shared[begin:begin + width]
        grids = []
        for (doc, element, weight), n, weighted in ((a, len(left), True), (b, len(right), False)):
            at = np.minimum(np.searchsorted(part, element), len(part) - 1)
            hit = part[at] == element
            grid = np.zeros((n, len(part)))
            grid[doc[hit], at[hit]] = weight[hit] if weighted else 1.0
            grids.append(grid)
        both += grids[0] @ grids[1].T
    mass = [np.bincount(doc, weights=weight, minlength=n) for (doc, _, weight), n in ((a, len(left)), (b, len(right)))]
    return both / np.maximum(mass[0][:, None] + mass[1][None, :] - both, 1e-300)


def _crossed_in_blocks(split: DataFrame, nodes: DataFrame, texts: DataFrame, weights: Weights, threshold: float, block_rows: int = 128) -> DataFrame:
    """The links (src, dst) that ``_crossed`` would lead to, found without a row per pair.

    Nodes of a bucket are dealt to blocks of about ``block_rows``; every block of
    outside nodes meets every block of the bucket. A pair that shares several
    bands is looked at in the first of them only.
    """
    sides = F.col("component") != F.col("main")
    lanes = F.greatest(F.lit(1), F.ceil(F.when(sides, F.col("outside")).otherwise(F.col("n") - F.col("outside")) / block_rows))
    rows = (
        split.join(texts, "node").join(nodes.select("node", "bands"), "node")
        .withColumn("out", sides).withColumn("lane", F.pmod(F.xxhash64("node"), lanes.cast("bigint")))
    )
    packs = rows.groupBy("band", "bucket", "out", "lane").agg(F.collect_list(F.struct("node", "component", "mass", "bands", "text", "out")).alias("pack"))
    met = packs.filter("out").select("band", "bucket", F.col("pack").alias("left")).join(packs.select("band", "bucket", F.col("pack").alias("right")), ["band", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band = batch.column(0)[i].as_py()
                packed = [batch.column(c)[i].values for c in (1, 2)]
                node, part, mass = ([p.field(f).to_numpy(zero_copy_only=False) for p in packed] for f in ("node", "component", "mass"))
                signs = [p.field("bands").flatten().to_numpy().reshape(len(p), -1) for p in packed]
                out = packed[1].field("out").to_numpy(zero_copy_only=False)
                wanted = part[0][:, None] != part[1][None, :]
                wanted &= ~out[None, :] | (node[0][:, None] < node[1][None, :])
                wanted &= np.minimum(mass[0][:, None], mass[1][None, :]) >= threshold * np.maximum(mass[0][:, None], mass[1][None, :]) * 0.999999
                for earlier in range(band):
                    wanted &= signs[0][:, earlier][:, None] != signs[1][:, earlier][None, :]
                rows, columns = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
                if not len(rows):
                    continue
                one, two = (packed[s].field("text").take(pa.array(at)).to_pylist() for s, at in ((0, rows), (1, columns)))
                near = similarities(one, two, weights) >= threshold - 1e-9
                x, y = np.nonzero(near & wanted[np.ix_(rows, columns)])
                a, b = node[0][rows[x]], node[1][columns[y]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    return met.select("band", "left", "right").mapInArrow(run, "src bigint, dst bigint")


def _components(links: DataFrame) -> DataFrame:
    if links.isEmpty():
        return links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return staged(star_components(links), "near-components")


def drop_near(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, of which one per class stays (the one with the smallest id).

    Rows with equal ids and texts of a class that stays are reduced to one. Null
    ids stay if their own text names the class.
    """
    classes = _classes(docs, id_column=id_column, text_column=text_column, **how)
    stay = classes.filter("kept").select(F.col("own").alias("__own"), F.col("h").alias("__h")).distinct()
    docs, named, restored = sheltered(docs)
    id_column, text = named(id_column), text_of(named(text_column))
    keyed = docs.withColumn("__own", F.coalesce(F.col(id_column), row_key(F.col(id_column), text))).withColumn("__h", F.unhex(F.md5(text)))
    return restored(keyed.join(stay, ["__own", "__h"], "left_semi").dropDuplicates(["__own", "__h"]).select(*docs.columns))
