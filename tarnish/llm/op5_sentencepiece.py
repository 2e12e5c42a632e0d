"""SentencePiece encoding and decoding with a merge-type prefix table.

The encoder never replays merges over a text. It keeps, for each prefix of a segment, the one token that can end the
prefix's encoding: an automaton over the vocabulary lists the tokens that end there, and such a token is right if it
is compatible with the last token of the prefix before it, that is, if merging the two tokens' characters gives back just
these two. The ids are then read backwards from the last prefix.

Segments (a run of word marks and the characters up to the next one, or a line feed) can't influence each other as no
piece of the model spans their border; this is checked when the model is loaded. A task therefore encodes each distinct
segment once while its bounded memory lasts.

Defined results: a null text counts as empty; an empty text has the end id alone and decodes to an empty text; a
character outside the vocabulary becomes the ids of its UTF-8 bytes. Nothing else in a row is looked at, so nulls, ties,
repeated rows and further columns have no effect.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tarnish.llm.common import own, table

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Segments longer than this are encoded anew each time, and no more than so many others are remembered by a task.
REMEMBERED_CHARS, REMEMBERED = 48, 400_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixTable:
    """Encodes and decodes with a BPE model of the sentencepiece library, read from its file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(self.pieces))]
        self.scores = [model.get_score(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if any(MARK in p.lstrip(MARK) or "\n" in p[1:] or "\n" in p[:-1] for p in self.ids):
            raise ValueError("a piece of this model spans the border of two segments")
        self._pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or len(self.merge(piece)) == 1:  # else merging never ends in this piece
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """The symbols left when the best-scored neighbours, the leftmost of equals, are merged until none can be."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both tokens gives back just these two."""
        a, b = self.pieces[left], self.pieces[right]
        found = self.merge(a + b) == [a, b]
        if len(self._pairs) >= 4 * REMEMBERED:
            self._pairs.clear()
        self._pairs[left << 32 | right] = found
        return found

    def segment(self, text: str) -> list[int]:
        """The ids of one segment."""
        n = len(text)
        last = [-1] * (n + 1)  # of each prefix: the token that ends it; -1: a character outside the vocabulary
        known = self._pairs.get
        for stop, (token, length) in self.automaton.iter(text):
            stop += 1
            if last[stop] >= 0:
                continue
            before = last[stop - length] if stop > length else -1
            if before >= 0:
                fits = known(before << 32 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[stop] = token
        out: list[int] = []
        at = n
        while at:
            token = last[at]
            if token < 0:
                at -= 1
                out.extend(self.bytes[b] for b in reversed(text[at].encode()))
            else:
                at -= len(self.pieces[token])
                out.append(token)
        out.reverse()
        return out

    def pieces_of(self, ids: list[int]) -> str:
        """The text of ids, before the leading mark is taken off."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if i != self.end:
                out.append(self.pieces[i])
        if held:
            out.append(held.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")

    def split(self, text: str) -> list[str]:
        return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.split(text) for i in self.segment(s)] + [self.end]

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_of(ids)
        return text[1:] if text.startswith(" ") else text


class Remembered(dict):
    """segment -> make(segment), kept while short and while there is room."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, segment):
        value = self.make(segment)
        if len(segment) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = value
        return value


_LOADED: dict[str, PrefixTable] = {}
_DIGESTS: dict[str, Remembered] = {}


def loaded(path: str) -> PrefixTable:
    """The table of a file, read once by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixTable(path)
    return _LOADED[path]


def digests(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, n_tokens, ids_sha256 and decoded_sha256 of every row. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(path)

        def make(segment: str) -> tuple[str, int, str]:
            ids = table.segment(segment)
            return " ".join(map(str, ids)), len(ids), table.pieces_of(ids)

        known = _DIGESTS.setdefault(path, Remembered(make))
        end = str(table.end)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                found = [known[s] for s in table.split(text.as_py() or "")]
                counts.append(sum([x[1] for x in found]) + 1)
                of_ids.append(hashlib.sha256(" ".join([x[0] for x in found] + [end]).encode()).hexdigest())
                decoded = "".join([x[2] for x in found])
                of_text.append(hashlib.sha256((decoded[1:] if decoded[:1] == " " else decoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    names = ["doc_id", *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return own(docs, *names, "text").mapInArrow(
        run, f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row, for operators that need the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(path)
        known = Remembered(table.segment)
        for batch in batches:
            ids = [[i for s in table.split(t.as_py() or "") for i in known[s]] + [table.end]
                   for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows that hold doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(path)
        for batch in batches:
            texts = [table.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return own(rows, "doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
