"""Token counts without tokenizing most of the text: strings proven to be one whole token are looked up, the rest is merged."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

_CUT = re.compile(r"(?<=\S)(?= )")
_UNSAFE = re.compile(r"\s ")
_counters: dict[str, TokenCounter] = {}


def prove(vocabulary: str) -> list[str]:
    """The vocabulary's strings, as plain text, that encode alone as exactly one token.

    A string is taken if the pre-tokenizer makes one pre-token of it and the
    merges of that pre-token end in its own id. ``vocabulary`` is the text of
    a byte-level BPE file. Strings that are no whole UTF-8 text are left out.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    ids = json.loads(vocabulary)["model"]["vocab"]
    texts = {form: tokenizer.decoder.decode([form]) for form in ids}
    return [text for form, text in texts.items() if "�" not in text
            and [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [form]
            and [t.id for t in tokenizer.model.tokenize(form)] == [ids[form]]]


class _AfterSpace(dict):
    """Word -> tokens of " word"; a word not met before is counted and, if short, kept."""

    def __init__(self, counter: TokenCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.merged(" " + word)
        if len(word) <= 64:
            self[word] = n
        return n


class TokenCounter:
    """Counts the tokens of texts as the library would, special strings included.

    No pre-token of the byte-level pattern reaches from a character that is no
    white space over a following space, so texts fall into parts that begin at
    such a space. A part that is a proven string counts one; any other part is
    cut into its pre-tokens, of which the proven ones count one each and only
    the others are merged. At most ``most_known`` counts are kept.
    """

    def __init__(self, vocabulary: str, proven: list[str], most_known: int = 500_000, slice_chars: int = 1 << 20):
        from tokenizers import Tokenizer

        stated = json.loads(vocabulary)
        cutter, model, added = stated["pre_tokenizer"], stated["model"], stated["added_tokens"]
        plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        if stated["normalizer"] or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"] or model["type"] != "BPE" or not plain:
            raise ValueError("not a byte-level BPE vocabulary with plain special strings")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.special = re.compile("|".join(re.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None
        self.words = [text[1:] for text in proven if text[0] == " " and " " not in text[1:]]
        self.whole = {p for text in proven for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        self.most_known, self.slice_chars = most_known, slice_chars
        self.after_space = _AfterSpace(self)
        self.after_space.update(dict.fromkeys(self.words, 1))

    def merged(self, part: str) -> int:
        forms = [form for form, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return sum(1 if form in self.whole else len(self.tokenizer.model.tokenize(form)) for form in forms)

    def _slices(self, text: str) -> Iterator[str]:
        """``text`` in parts of about ``slice_chars`` characters, cut only before a space that follows no white space."""
        begin = 0
        while len(text) - begin > self.slice_chars:
            cut = text.find(" ", begin + self.slice_chars)
            while cut > 0 and text[cut - 1].isspace():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[begin:cut]
            begin = cut
        yield text[begin:]

    def _plain(self, text: str) -> int:
        if len(self.after_space) > self.most_known:
            self.after_space.clear()
            self.after_space.update(dict.fromkeys(self.words, 1))
        total = 0
        for some in self._slices(text):
            if _UNSAFE.search(some):
                for part in _CUT.split(some):
                    total += self.after_space[part[1:]] if part[:1] == " " and part[1:2] not in ("", " ") else self.merged(part)
            else:
                first, *rest = some.split(" ")
                total += self.merged(first) + sum(map(self.after_space.__getitem__, rest))
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def token_counts(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row: UTF-8 bytes and tokens of the whole text.

    The vocabulary file is read and proven once on the driver and broadcast
    (its size is that of the file), so executors need no path. No shuffle.
    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows
    stay, one result each; an empty table gives none; other columns are ignored.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(vocabulary.encode()).hexdigest(), vocabulary, prove(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, text, proven = shared.value
        if digest not in _counters:
            _counters[digest] = TokenCounter(text, proven)
        counter = _counters[digest]
        for batch in batches:
            # One text at a time becomes a Python string.
            counts = [counter.count(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_column).alias("id"), F.octet_length(text_of(text_column)).cast("bigint").alias("n_bytes"), text_of(text_column).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    counted = slim.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumnRenamed("id", id_column)
