"""Phrase collocations, counted in the dictionary of a prefix-free parse instead of in the texts."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.slices import top_k_per_group
from .common import staged, text_of

#: Breaks become line feeds and tabs spaces, so that texts fall into pieces and pieces into words.
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: Words that neighbouring chunks share: one less than the longest phrase.
_SHARED = 2
_SPOT_BITS = 27


def plain(text: bytes) -> bytes:
    """``text`` in lower case (A-Z only), with a line feed for each break and a space for each tab."""
    return text.lower().translate(_PLAIN)


def _words(lines: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of lines that are joined by single spaces, their crc32, and the words from each one to its line's end."""
    lists = pc.split_pattern(lines, " ")
    words = lists.flatten().dictionary_encode()
    crc = np.fromiter((zlib.crc32(w) for w in words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
    return words, crc, np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))


def parse(text: bytes, every: int) -> tuple[pa.Array, pa.Array]:
    """Chunks of a plain text's pieces: those that run on into a next one, and those that end their piece.

    A piece is cut where the hash of two neighbouring words is a multiple of
    ``every``, so equal passages are cut alike wherever they stand. A chunk
    that runs on also holds the two words that the next chunk begins with.
    """
    if b"  " in text:
        text = re.sub(b"  +", b" ", text)
    pieces = pc.ascii_trim(pc.split_pattern(pa.array([text], pa.binary()).cast(pa.string()), "\n").flatten(), characters=" ")
    words, crc, left = _words(pieces.filter(pc.greater(pc.binary_length(pieces), 0)))
    codes = words.indices.to_numpy()
    h = crc[codes]
    opens = np.ones(len(h), bool)
    opens[1:] = left[:-1] == 1
    mix = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    opens[:-1] |= (left[:-1] >= 2) & ((mix >> np.uint64(33)) % np.uint64(every) == 0)
    begin = np.flatnonzero(opens)
    close, following = begin + left[begin], np.append(begin[1:], len(h))[:len(begin)]
    on = following < close
    size = np.where(on, following + _SHARED, close) - begin
    ends = np.cumsum(size)
    at = np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
    held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), words.dictionary.take(pa.array(codes[at])))
    chunks = pc.binary_join(held, " ")
    return chunks.filter(pa.array(on)), chunks.filter(pa.array(~on))


def _blocks(texts: Iterator[bytes], most: int) -> Iterator[bytes]:
    """Plain texts, one behind the other, in blocks of about ``most`` bytes that end with a piece."""
    block, size = [], 0
    for text in texts:
        text = plain(text)
        while len(text) > most and (cut := text.rfind(b"\n", 0, most) + 1 or text.find(b"\n", most) + 1):
            yield text[:cut]
            text = text[cut:]
        block.append(text)
        size += len(text)
        if size > most:
            yield b"\n".join(block)
            block, size = [], 0
    if block:
        yield b"\n".join(block)


def chunk_dictionary(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", every: int = 12, block_bytes: int = 8_000_000) -> DataFrame:
    """(lang, shared, chunk, f): the distinct chunks and how often the parse of all texts uses them.

    ``shared`` is the number of words at the chunk's end that belong to the
    next chunk. Workers count the chunks of a block of texts before the
    shuffle; a block is about ``block_bytes`` long, or one longer piece.
    """
    names = ["lang", "shared", "chunk", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = defaultdict(list)
            for row, lang in enumerate(batch.column(0).to_pylist()):
                members[lang].append(row)
            for lang, rows in members.items():
                texts = (text.to_pybytes() for row in rows if (text := batch.column(1)[row].as_buffer()) is not None)
                for block in _blocks(texts, block_bytes):
                    for shared, chunks in zip((_SHARED, 0), parse(block, every)):
                        values, counts = pc.value_counts(chunks).flatten()
                        n = len(values)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, shared, np.int32)), values, counts], names=names)

    slim = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), text_of(text_column).alias("text"))
    parsed = slim.mapInArrow(run, "lang string, shared int, chunk string, f bigint")
    return parsed.groupBy("lang", "shared", "chunk").agg(F.sum("f").alias("f"))


def _spots(lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of word pairs in a bitmap of 2 ** ``_SPOT_BITS`` bits, from the words' crc32."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(zlib.crc32(lang.encode()))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - _SPOT_BITS)).astype(np.int64)


def _counted(lang: str, chunks: pa.Array, shared: np.ndarray, f: np.ndarray, sizes: tuple[int, ...], pairs: np.ndarray | None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(k, phrases, weights) of some distinct chunks of a language."""
    words, crc, left = _words(chunks)
    codes, known, wide = words.indices.to_numpy().astype(np.int64), words.dictionary, len(words.dictionary)
    lengths = np.diff(np.append(np.flatnonzero(np.concatenate([[True], left[:-1] == 1])), len(codes)))
    opens, weights = left > np.repeat(shared, lengths), np.repeat(f, lengths)
    if pairs is not None:
        spots = _spots(lang, crc[codes[:-1]], crc[codes[1:]])
        allowed = np.append((pairs[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 > 0, False)
    for k in sizes:
        at = np.flatnonzero(opens & (left >= k))
        if pairs is not None:
            for step in range(k - 1):
                at = at[allowed[at + step]]
        if not len(at):
            continue
        keys = codes[at]
        for step in range(1, k):
            keys = (np.unique(keys, return_inverse=True)[1] if step > 1 else keys) * wide + codes[at + step]
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        begin = at[order[first]]
        parts = [known.take(pa.array(codes[begin + step])) for step in range(k)]
        yield k, pc.binary_join_element_wise(*parts, " "), np.add.reduceat(weights[at][order], first)


def phrase_counts(dictionary: DataFrame, sizes: tuple[int, ...], pairs: Broadcast | None = None, block_bytes: int = 8_000_000) -> DataFrame:
    """(lang, k, phrase, f) of the phrases of ``sizes`` words, up to three, in all texts of a dictionary.

    Each distinct chunk is counted once, with its frequency as weight; phrases
    that start in the words shared with the next chunk are left to that one.
    Where a bitmap of pairs is given, phrases with another pair may be left out.
    """
    names = ["lang", "k", "phrase", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(pairs.value, np.uint8) if pairs is not None else None

        def flush(blocks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(blocks).combine_chunks()
            members = block.column(0).chunk(0).dictionary_encode()
            for code, lang in enumerate(members.dictionary.to_pylist()):
                mine = block.filter(pc.equal(members.indices, code))
                _, shared, chunks, f = (c.combine_chunks() for c in mine.columns)
                for k, phrases, total in _counted(lang, chunks, shared.to_numpy(), f.to_numpy(), sizes, bits):
                    n = len(phrases)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, k, np.int32)), phrases, pa.array(total)], names=names)

        blocks, size = [], 0
        for batch in batches:
            blocks.append(batch)
            size += batch.nbytes
            if size > block_bytes:
                yield from flush(blocks)
                blocks, size = [], 0
        if size:
            yield from flush(blocks)

    counted = dictionary.select("lang", "shared", "chunk", "f").mapInArrow(run, "lang string, k int, phrase string, f bigint")
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def pair_bitmap(pairs: DataFrame) -> bytes:
    """A bitmap of fixed size (16 MB) with the places of all given (lang, phrase) pairs set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [phrase.encode().split(b" ") for phrase in batch.column(1).to_pylist()]
            left, right = (np.fromiter((zlib.crc32(w[i]) for w in split), np.uint64, len(split)) for i in (0, 1))
            spots = [_spots(lang, left[i:i + 1], right[i:i + 1])[0] for i, lang in enumerate(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(spots, np.int64) + 1)], names=["spot"])

    spots = pairs.select("lang", "phrase").mapInArrow(run, "spot bigint")
    parts = spots.groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    bitmap = bytearray(2 ** (_SPOT_BITS - 3))
    for row in parts.toLocalIterator():
        at = (row.part - 1) * len(row.bits)
        bitmap[at:at + len(row.bits)] = row.bits
    return bytes(bitmap)


def _first(n: int) -> Column:
    return F.substring_index("phrase", " ", n)


def _last(n: int) -> Column:
    return F.substring_index("phrase", " ", -n)


def collocations(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = 10, share: int = 50, top: int = 2000, every: int = 12) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words.

    ``a``, ``l`` and ``r`` count the phrase and its two parts at the cut with
    the lowest score, ``n`` all words of the language; candidates occur
    ``least`` times or more. A pair goes if a candidate of three words holds it
    in ``share`` percent of its occurrences or more. Scores are whole numbers
    computed with 38 digits: exact for counts below 10 ** 16.

    A part of a phrase occurs at least as often as the phrase, so phrases of
    three words are counted only where both of their pairs may be frequent
    (a bitmap of fixed size says so, and errs on the side of counting), and
    only words and pairs with ``least`` occurrences are joined. Null texts
    count as empty, null languages as "und"; repeated rows count again; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    dictionary = staged(chunk_dictionary(docs, lang_column, text_column, every), "chunks")
    frequent = F.col("f") >= least
    short = phrase_counts(dictionary, (1, 2)).filter((F.col("k") == 1) | frequent)
    short = staged(short, "short-phrases")
    totals = short.filter("k = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    words, pairs = (short.filter((F.col("k") == k) & frequent).select("lang", "phrase", "f") for k in (1, 2))
    bitmap = docs.sparkSession.sparkContext.broadcast(pair_bitmap(pairs))
    triples = staged(phrase_counts(dictionary, (3,), bitmap).filter(frequent).select("lang", "phrase", F.col("f").alias("a")), "long-phrases")

    def part(of: DataFrame, key: str, value: str) -> DataFrame:
        return of.select("lang", F.col("phrase").alias(key), F.col("f").alias(value))

    def score(l: str, r: str) -> Column:
        wide = lambda c: F.col(c).cast("decimal(16,0)")
        return F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))

    held = triples.select("lang", F.col("a").alias("over"), F.explode(F.array(_first(2), _last(2))).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("over").alias("over"))
    two = (pairs.withColumnRenamed("f", "a").join(held, ["lang", "phrase"], "left")
           .filter(F.coalesce(100 * F.col("over") < share * F.col("a"), F.lit(True)))
           .withColumn("w1", _first(1)).withColumn("w2", _last(1))
           .join(part(words, "w1", "l"), ["lang", "w1"]).join(part(words, "w2", "r"), ["lang", "w2"])
           .select("lang", "phrase", "a", "l", "r", score("l", "r").alias("score")))
    three = (triples.withColumn("w1", _first(1)).withColumn("p2", _last(2)).withColumn("p1", _first(2)).withColumn("w2", _last(1))
             .join(part(words, "w1", "l1"), ["lang", "w1"]).join(part(pairs, "p2", "r1"), ["lang", "p2"])
             .join(part(pairs, "p1", "l2"), ["lang", "p1"]).join(part(words, "w2", "r2"), ["lang", "w2"])
             .withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
             .select("lang", "phrase", "a", F.when(F.col("s1") <= F.col("s2"), F.col("l1")).otherwise(F.col("l2")).alias("l"),
                     F.when(F.col("s1") <= F.col("s2"), F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score")))
    ranked = top_k_per_group(two.unionByName(three), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
