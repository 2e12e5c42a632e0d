"""Repeated word windows by seed and extend.

Documents meet on winnowed anchors (see ``repeats``): k-grams of words that stand in more than one block. Within an anchor's
group the blocks are aligned at the anchor, the seed, and each pair is extended to the left and to the right, word by word, as
far as the words are equal. A maximal repeat of the threshold or more covers the windows that lie in it.

Defined results: a null text has no words; a text of fewer words than the threshold loses nothing; equal texts of the
threshold or more are both removed whole; null ids are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnish.llm.common import own, table, text_bytes, word_hashes, word_spans
from tarnish.llm.repeats import Kind, marks, merged, with_marks

#: Threshold in words, and the words of an anchor.
LENGTH, GRAM = 35, 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def extended(words: np.ndarray, length: int, left: int) -> np.ndarray:
    """Blocks as rows, aligned so that their seeds start in column ``left``; no two blanks are equal. True at [row, e] if
    the window that starts e words before the seed is within a maximal repeat shared with another row."""
    m = len(words)
    edges = np.zeros((m, left + 2), np.int64)
    for row in range(m):
        same = words == words[row]
        back = np.minimum.accumulate(same[:, left - 1::-1], axis=1).sum(1) if left else np.zeros(m, np.int64)
        ahead = np.minimum.accumulate(same[:, left:], axis=1).sum(1)
        ok = (back + ahead >= length) & (np.arange(m) != row) & (ahead > 0)
        low = np.maximum(length - ahead[ok], 0)
        high = np.minimum(back[ok], left)
        good = low <= high
        np.add.at(edges[row], low[good], 1)
        np.add.at(edges[row], high[good] + 1, -1)
    return np.cumsum(edges, axis=1)[:, : left + 1] > 0


def compare(blocks: list[bytes], groups: np.ndarray, shifts: list[int], length: int = LENGTH, k: int = GRAM) -> list[np.ndarray]:
    """For each block, which of its windows are shared with another block of its anchor's group."""
    number: dict[bytes, int] = {}
    split = [[number.setdefault(w, len(number)) for w in b.split(b" ")] for b in blocks]
    out: list[np.ndarray] = []
    cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(blocks)]
    left = length - k
    for a, b in zip(cuts, cuts[1:]):
        rows = np.arange(-1, -1 - (b - a) * (left + length), -1, dtype=np.int64).reshape(b - a, -1)
        for i in range(a, b):
            start = left - shifts[i]
            words = split[i][: left + length - start]
            rows[i - a, start: start + len(words)] = words
        shared = extended(rows, length, left)
        for i in range(a, b):  # window j of a block starts shift - j words before its seed
            count = len(split[i]) - length + 1
            out.append(shared[i - a, shifts[i] - np.arange(count)])
    return out


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    starts, ends, firsts = word_spans(data, offsets)
    return word_hashes(data, starts, ends), firsts


def _cut(text: bytes, starts: list[int], stops: list[int]) -> list[bytes]:
    words = _WORD.findall(text)
    return [b" ".join(words[a:b]) for a, b in zip(starts, stops)]


def _of(block: bytes) -> np.ndarray:
    return _symbols(pa.array([block.decode()]))[0]


WORDS = Kind(LENGTH, GRAM, _symbols, _cut, _of, compare)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, ranges in zip(batch.column("text"), batch.column("_ranges")):
                words = _WORD.findall((text.as_py() or "").encode())
                kept, at, gone = [], 0, 0
                for start, stop in merged(ranges.as_py() or []):
                    kept += words[at:start]
                    at, gone = stop, gone + stop - start
                kept += words[at:]
                for o, v in zip(out, (len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(o, pa.int64()) for o in out[:2]], pa.array(out[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_marks(docs, marks(docs, WORDS), "doc_id").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(own(table(spark, sf_dir, "documents"), "doc_id", "text"))
