"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_models: dict[str, PieceModel] = {}


class PieceModel:
    """Pieces, scores and byte fallback of a model file; encodes the best-scored segmentation.

    A space is written as U+2581 and one is put before the text. No piece has
    a U+2581 behind another character, so the best path of a text is made of
    the best paths of its words, which a worker keeps. A character that is no
    piece of its own may be spelt in bytes at a score below every piece. A
    U+2581 of the text itself is always spelt in bytes, so decoding gives back
    every text exactly. Ties go to the longer piece.
    """

    def __init__(self, path: str, most_known: int = 250_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known, self.most_known = {}, most_known
        self.spelt, self.bytes, self.piece = [], {}, {}
        self.automaton = ahocorasick.Automaton()
        for i in range(model.vocab_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(text[3:5], 16)] = i
                self.spelt.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelt.append(b"")
            else:
                self.spelt.append(text.replace(SPACE, " ").encode())
                self.piece[text] = (len(text), i, model.get_score(i))
        for text, value in self.piece.items():
            self.automaton.add_word(text, value)
        self.automaton.make_automaton()
        self.fallback = min(v[2] for v in self.piece.values()) - 10
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.piece)
        self.literal = [self.bytes[b] for b in SPACE.encode()]

    def best(self, segment: str) -> tuple[float, list[int]]:
        """Score and ids of the best path; the automaton reports, position by position, every piece that ends there."""
        n = len(segment)
        score, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        at, single = 0, False

        def close(end: int, single: bool) -> None:
            if not single and score[end] + self.fallback > score[end + 1]:
                score[end + 1], back[end + 1] = score[end] + self.fallback, (1, -1)

        for end, (length, piece, value) in self.automaton.iter(segment):
            while at < end:
                close(at, single)
                at, single = at + 1, False
            single |= length == 1
            reached = score[end + 1 - length] + value
            if reached > score[end + 1]:
                score[end + 1], back[end + 1] = reached, (length, piece)
        while at < n:
            close(at, single)
            at, single = at + 1, False
        ids: list[int] = []
        while n:
            length, piece = back[n]
            if piece < 0:
                ids += [self.bytes[b] for b in reversed(segment[n - 1].encode())]
            else:
                ids.append(piece)
            n -= length
        return score[len(segment)], ids[::-1]

    def _segments(self, part: str, first: bool) -> list[str]:
        words = part.split(" ")
        if self.cuts and "" not in words:
            return [(SPACE if first else "") + words[0], *[SPACE + w for w in words[1:]]]
        marked = (SPACE if first else "") + part.replace(" ", SPACE)
        return _SEGMENT.findall(marked) if self.cuts else [marked] * bool(marked)

    def encode(self, text: str) -> tuple[float, bytes]:
        """Score and ids (little-endian uint32) of a whole text; an empty text has no ids."""
        if not text:
            return 0.0, b""
        if len(self.known) > self.most_known:
            self.known.clear()
        total, out = 0.0, []
        for number, part in enumerate(text.split(SPACE)):
            if number:
                out.append(np.array(self.literal, "<u4").tobytes())
                total += self.fallback
            segments = self._segments(part, number == 0)
            for fresh in set(segments).difference(self.known):
                value, ids = self.best(fresh)
                self.known[fresh] = (np.array(ids, "<u4").tobytes(), value)
            found = [self.known[s] for s in segments]
            out += [f[0] for f in found]
            total += sum(f[1] for f in found)
        return total, b"".join(out)

    def decode(self, ids) -> str:
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model: str, text_column: str = "text", with_ids: bool = True, prefix: str = "piece") -> DataFrame:
    """``docs`` with all columns, plus {prefix}_ids (unless ``with_ids`` is false), _count, _score, _crc32, _exact.

    ``_crc32`` is that of the ids as little-endian uint32; ``_exact`` says that
    decoding gave back the text. Null texts count as empty. No shuffle; one
    Arrow batch at a time; a worker keeps at most a fixed number of words.
    Columns of ``docs`` with these names are replaced.
    """
    own = {f"{prefix}_ids": "array<int>", f"{prefix}_count": "bigint", f"{prefix}_score": "double", f"{prefix}_crc32": "bigint", f"{prefix}_exact": "boolean"}
    if not with_ids:
        own.pop(f"{prefix}_ids")
    source = docs.drop(*own)
    at = source.columns.index(text_column)
    names = [*source.columns, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                scored = [pieces.encode(t) for t in texts]
                ids = [np.frombuffer(b, "<u4") for _, b in scored]
                made = [pa.array([len(i) for i in ids], pa.int64()), pa.array([s for s, _ in scored], pa.float64()),
                        pa.array([zlib.crc32(b) for _, b in scored], pa.int64()),
                        pa.array([pieces.decode(i.tolist()) == t for i, t in zip(ids, texts)], pa.bool_())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                    made.insert(0, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return source.mapInArrow(run, extended(source.schema, ", ".join(f"{n} {k}" for n, k in own.items())))


def decode(encoded: DataFrame, model: str, ids_column: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give null."""
    names = [*encoded.drop(to).columns, to]
    at = names.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return encoded.drop(to).mapInArrow(run, extended(encoded.drop(to).schema, f"{to} string"))


def digest(docs: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_pieces, score, ids_crc32, exact) of every document."""
    done = encode(docs.select(id_column, F.col("text").cast("string").alias("text")), model, with_ids=False)
    return done.select(id_column, F.col("piece_count").alias("n_pieces"), F.col("piece_score").alias("score"),
                       F.col("piece_crc32").alias("ids_crc32"), F.col("piece_exact").alias("exact"))
