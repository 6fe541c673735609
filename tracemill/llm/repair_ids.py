"""Token ids in a binary format: Re-Pair grammars per shard, with random access to any document."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, text_of

MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sIIQIBB")
_SPACE_AFTER_SPACE = re.compile(r"\s ")
# Characters that the pre-tokenizer takes as plain letters, digits or signs; no apostrophe (it may begin a contraction) and no "<".
_LETTERS, _SIGNS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF", r"!-&(-/:;=-@\[-`{-~"
_ENDS = ".,;:!?"
_PLAIN = re.compile(rf"[{_LETTERS}0-9{_SIGNS}]+(?:\n[{_LETTERS}0-9{_SIGNS}]+)*")
_RUN = re.compile(rf"[{_LETTERS}]+|[0-9]+|[{_SIGNS}]+|\n")
# The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _PRINTED)}
_known: dict[str, _Words] = {}
_tokenizers: dict[str, object] = {}


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, symbols, symbol ends) of the ids of documents that end at ``ends``.

    Frequent pairs are replaced by nonterminals, numbered from ``base``, until
    no pair is seen ``least`` times (a rule takes about three symbols' room, so
    rarer ones would cost more than they save). A round replaces many pairs:
    ranked by frequency, ties by a hash, a pair is taken wherever no better
    ranked one overlaps it; in a run of one pair, every second. The most
    frequent pair is replaced throughout in each round, so rounds end. A pair
    never spans two documents.

    Symbols stay where they are and are linked. A pair that was seen too
    seldom can only get rarer, so a round looks again only at the places of
    frequent pairs and next to new symbols.
    """
    n = len(ids)
    # Half as wide where numbers fit: the time goes into reading them at scattered places.
    kind = np.int32 if n < 1 << 30 and base < 1 << 30 else np.int64
    symbols = np.append(ids, 0).astype(kind)
    after, before = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
    stops = ends[np.diff(ends, prepend=0) > 0].astype(np.int64)
    after[stops - 1], before[np.concatenate([[0], stops[:-1]])] = n, n
    alive, seen = np.ones(n, bool), np.zeros(n + 1, bool)
    unranked = np.iinfo(kind).max
    rank = np.full(n + 1, unranked, kind)
    left, right, lengths, count = [], [], [np.ones(1, np.int64)], 0
    size = np.ones(n + 1, kind)
    look = np.flatnonzero(after[:n] < n)
    places = max(n, 1).bit_length()
    while len(look):
        a, b = symbols[look].astype(np.int64), symbols[after[look]]
        # Numbers sort much faster than their places, so pair and place share a number where it has room.
        bits = int(base + count).bit_length()
        if 2 * bits + places < 64:
            ordered = np.sort((a << bits | b) << places | np.arange(len(look)))
            order, key = ordered & (1 << places) - 1, ordered >> places
            left_of, right_of = key >> bits, key & (1 << bits) - 1
        else:
            order = np.lexsort((b, a))
            left_of, right_of = a[order], b[order]
        new_pair = np.ones(len(look), bool)
        new_pair[1:] = (left_of[1:] != left_of[:-1]) | (right_of[1:] != right_of[:-1])
        first = np.flatnonzero(new_pair)
        times = np.diff(np.append(first, len(look)))
        kept = times >= least
        if not kept.any():
            break
        number = np.full(len(first), -1, kind)
        number[kept] = np.arange(kept.sum())
        pair = np.empty(len(look), kind)
        pair[order] = np.repeat(number, times)
        first, times = first[kept], times[kept]
        mine = np.flatnonzero(pair >= 0)
        look, pair = look[mine], pair[mine]
        keys = left_of[first] << 32 | right_of[first]
        place = np.empty(len(keys), kind)
        place[np.lexsort((keys * -7046029254386353131 & 0x7FFFFFFFFFFF, -times))] = np.arange(len(keys))
        mine = place[pair]
        rank[look] = mine
        takes = rank[before[look]] > mine
        # In a run of one pair, number its places.
        joined = np.flatnonzero((mine[1:] == mine[:-1]) & (before[look[1:]] == look[:-1])) + 1
        begins = np.diff(joined, prepend=-1) != 1
        takes[joined] = (joined - np.maximum.accumulate(np.where(begins, joined, 0))) % 2 == 1
        takes &= rank[after[look]] >= mine
        rank[look] = unranked
        takes = np.flatnonzero(takes)
        taken, which = look[takes], pair[takes]
        some = np.zeros(len(keys), bool)
        some[which] = True
        used, new = np.flatnonzero(some), (np.cumsum(some) - 1)[which]
        gone = after[taken]
        size[taken] += size[gone]
        one = np.empty(len(used), kind)
        one[new] = taken
        left.append(keys[used] >> 32)
        right.append(keys[used] & 0xFFFFFFFF)
        lengths.append(size[one])
        symbols[taken] = base + count + new
        count += len(used)
        alive[gone] = False
        after[taken] = after[gone]
        before[after[taken]] = taken
        near = np.concatenate([look, taken, before[taken]])
        seen[near] = True
        seen[gone], seen[n] = False, False
        look = np.flatnonzero(seen) if len(near) > n >> 5 else np.unique(near[seen[near]])
        seen[look] = False
        look = look[after[look] < n]
    rules = np.stack([np.concatenate([*x, np.empty(0, np.int64)]) for x in (left, right)], 1).astype(np.uint32)
    where = np.cumsum(alive)
    symbol_ends = np.where(ends > 0, where[np.maximum(ends.astype(np.int64), 1) - 1], 0).astype(np.uint64) if n else np.zeros(len(ends), np.uint64)
    return rules, np.concatenate(lengths)[1:].astype(np.uint32), symbols[:n][alive].astype(np.uint32), symbol_ends


def _narrow(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits: 16 of each together, then one plane for each further bit."""
    return b"".join([(values & 0xFFFF).astype("<u2").tobytes(), *[np.packbits((values >> bit & 1).astype(np.uint8)).tobytes() for bit in range(16, width)]])


def pack(ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    """A shard block: head, rules, expansion lengths, symbols (all as narrow as they can be), symbol ends and id ends per document."""
    rules, lengths, symbols, symbol_ends = compress(ids, ends, base)
    width, long = max(16, int(base + len(rules)).bit_length()), max(16, int(lengths.max(initial=0)).bit_length())
    head = _HEAD.pack(MAGIC, len(ends), len(rules), len(symbols), base, width, long)
    return b"".join([head, _narrow(rules.ravel(), width), _narrow(lengths, long), _narrow(symbols, width),
                     symbol_ends.astype("<u8").tobytes(), ends.astype("<u8").tobytes()])


class Block:
    """Reads a packed block; documents decode one by one."""

    def __init__(self, data: bytes):
        magic, docs, rules, symbols, self.base, width, long = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        def narrow(n: int, bits: int) -> np.ndarray:
            values = take("<u2", n).astype(np.uint32)
            for bit in range(16, bits):
                values |= np.unpackbits(take("u1", -(-n // 8)), count=n).astype(np.uint32) << np.uint32(bit)
            return values

        self.rules, self.lengths, self.symbols = narrow(2 * rules, width).reshape(-1, 2), narrow(rules, long), narrow(symbols, width)
        self.symbol_ends, self.ends = take("<u8", docs), take("<u8", docs)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        while (inner := symbols >= self.base).any():
            width = inner + 1
            out, at = np.repeat(symbols, width), (np.cumsum(width) - width)[inner]
            both = self.rules[symbols[inner] - self.base]
            out[at], out[at + 1] = both[:, 0], both[:, 1]
            symbols = out
        return symbols

    def whole(self) -> np.ndarray:
        """All ids of the block: every rule is expanded once, its ids are copied wherever it stands."""
        inner = np.flatnonzero(self.symbols >= self.base)
        which = self.symbols[inner] - self.base
        rules = self.expand(np.arange(self.base, self.base + len(self.rules), dtype=np.uint32))
        starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        size = np.ones(len(self.symbols), np.int64)
        size[inner] = self.lengths[which]
        # An id's place in (rules, symbols): the start of its rule's ids or its symbol's own place, and how far it is behind.
        source = np.arange(len(rules), len(rules) + len(self.symbols))
        source[inner] = starts[which]
        source -= np.cumsum(size) - size
        place = np.repeat(source, size)
        place += np.arange(len(place))
        return np.concatenate([rules, self.symbols])[place]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``i``; only the symbols that cover them are expanded."""
        begin = int(self.symbol_ends[i - 1]) if i else 0
        symbols = self.symbols[begin:int(self.symbol_ends[i])]
        if start == 0 and stop is None:
            return self.expand(symbols)
        inner = symbols >= self.base
        size = np.ones(len(symbols), np.int64)
        size[inner] = self.lengths[symbols[inner] - self.base]
        ends = np.cumsum(size)
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        first, final = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = int(ends[first - 1]) if first else 0
        return self.expand(symbols[first:final])[start - skip:stop - skip]


class _Words(dict):
    """Ids by word; a word stands for itself behind a space. Words not met before are encoded by the library.

    The byte-level pre-tokenizer cuts runs of letters, of digits and of signs
    apart, the first one with the space before it, and a single line break
    between them stands alone. So the ids of a word of plain characters are
    those of its runs, which words share; a run is read by the library's model.
    All other words are encoded whole, as are all words of a tokenizer that is
    set up otherwise or has an added token of plain characters.
    """

    def __init__(self, tokenizer, most_runs: int = 250_000):
        super().__init__()
        self.tokenizer, self.runs, self.most_runs, self.merge = tokenizer, {}, most_runs, tokenizer.model.tokenize
        set_up = json.loads(tokenizer.to_str())
        cut, after = set_up["pre_tokenizer"] or {}, set_up["post_processor"] or {"type": "ByteLevel"}
        self.plain = (
            set_up["normalizer"] is set_up["truncation"] is set_up["padding"] is None and after["type"] == "ByteLevel"
            and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
            and set_up["model"].get("type") == "BPE" and not set_up["model"].get("dropout")
            and not any(re.fullmatch(rf"[{_LETTERS}0-9{_SIGNS}\s]*", t["content"]) for t in set_up["added_tokens"]))

    def ids(self, run: str) -> bytes:
        signs = "\u0120" + run[1:] if run[0] == " " and run.isascii() else run.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return array("I", [token.id for token in self.merge(signs)]).tobytes()

    def inner(self, run: str) -> bytes:
        """Ids of a run behind another one."""
        data = self.runs.get(run)
        if data is None:
            if len(self.runs) >= self.most_runs:
                self.runs.clear()
            data = self.runs[run] = self.ids(run)
        return data

    def __missing__(self, word: str) -> bytes:
        first = word.rstrip(_ENDS)
        if self.plain and first.isalpha() and (first.isascii() or max(first) <= "\u00FF"):
            others = (word[len(first):],) if len(first) < len(word) else ()
        elif self.plain and _PLAIN.fullmatch(word):
            first, *others = _RUN.findall(word)
        else:
            data = self[word] = array("I", self.tokenizer.encode(" " + word, add_special_tokens=False).ids).tobytes()
            return data
        data = self.get(first)
        rare = data is None
        if rare:
            data = self[first] = self.ids(" " + first)
        if others:
            data += b"".join(map(self.inner, others))
            if not rare:  # a word that begins with a new run hardly comes again
                self[word] = data
        return data


def encode_texts(texts: list[str], path: str, most_known: int = 1_000_000) -> list[bytes]:
    """Ids of whole texts as little-endian uint32 bytes; no special tokens are added, their strings in a text are read as the library does.

    The byte-level pre-tokenizer always cuts before a single space that follows
    a non-space, so a text is the concatenation of such pieces, and a worker
    encodes each piece that it has not met before. Texts with white space
    before a space are encoded whole. (No special string holds a space.)
    """
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _known[path] = _Words(_tokenizers[path])
    tokenizer, known = _tokenizers[path], _known[path]
    run = lambda some: [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    if len(known) > most_known:
        known.clear()
    out: list[bytes] = []
    for begin in range(0, len(texts), 256):
        some = texts[begin:begin + 256]
        pieces = [None if _SPACE_AFTER_SPACE.search(t) else t.split(" ") for t in some]
        whole = iter(run([t for t, p in zip(some, pieces) if p is None]))
        heads = iter(run([p[0] for p in pieces if p is not None]))
        out += [next(whole) if p is None else next(heads) + b"".join(map(known.__getitem__, p[1:])) for p in pieces]
    return out


def write_blocks(docs: DataFrame, tokenizer: str, base: int, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0,
                 block_ids: int = 1_000_000) -> DataFrame:
    """The stored table: (part, block, n_ids, doc_ids, payload), ids in ascending order over (part, block).

    Rows are dealt by ranges of the id and sorted inside a range. Each range is
    a shard of blocks of about ``block_ids`` ids (a longer document has a block
    of its own); every block holds its grammar, so a block decodes alone. Null
    ids come first; a null text counts as empty and holds the end id only.
    """
    ordered = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).repartitionByRange(
        F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    kinds = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            data = np.frombuffer(b"".join(parts), "<u4")
            ends = np.cumsum([len(p) // 4 for p in parts])
            return pa.RecordBatch.from_pylist([{"part": part, "block": number, "n_ids": len(data), "doc_ids": ids, "payload": pack(data, ends, base)}], kinds)

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                for key, data in zip(some.column(0).to_pylist(), encode_texts(some.column(1).to_pylist(), tokenizer)):
                    if parts and size + len(data) // 4 + 1 > block_ids:
                        yield flush()
                        number, ids, parts, size = number + 1, [], [], 0
                    ids.append(key)
                    parts.append(data + end)
                    size += len(data) // 4 + 1
        if parts:
            yield flush()

    return staged(ordered.mapInArrow(blocks, "part int, block int, n_ids bigint, doc_ids array<bigint>, payload binary"), "token-ids")


def read_documents(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), decoded from the stored blocks.

    ``start`` adds up: ids of earlier ranges (one row per range), of earlier
    blocks in the range, of earlier documents in the block.
    """
    slim = stored.select("part", "block", "n_ids")
    ranges = slim.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(ranges, "part").select(
        "part", "block", (F.col("inside") + F.col("range_start")).alias("start"))
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, start = Block(batch.column(2)[row].as_py()), batch.column(0)[row].as_py()
                ids, ends = block.whole(), block.ends.astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(1)[row].as_py(), pa.int64()), pa.array(start + begins), pa.array(ends - begins), pa.array(crc, pa.int64())], schema=kinds)

    return stored.join(starts, ["part", "block"]).select("start", "doc_ids", "payload").mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
