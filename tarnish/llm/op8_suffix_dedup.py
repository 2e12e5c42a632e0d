"""Repeated byte strings by a run-length index.

Blocks of text that may repeat (see ``repeats``) are indexed in batches: a suffix array over the blocks gives the
Burrows-Wheeler transform, of which only runs are kept, with the suffix and the length of the common prefix with its
neighbour sampled where runs start and end. Between samples that length falls by one for each byte, so one pass over the
text streams the matching statistics: at each byte, the longest string that starts there and also elsewhere. Where it
reaches the threshold, the bytes are marked. Repetitive batches have few runs and thus few samples.

Defined results: a null text counts as empty; texts under the threshold lose nothing by themselves; equal texts of the
threshold or more are both removed whole, as every string counts that starts anywhere else; null ids are kept as they are.
``removed`` keeps valid UTF-8: a character that is cut in part goes wholly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnish.llm.common import byte_values, own, table, text_bytes
from tarnish.llm.repeats import Kind, marks, merged, with_marks

#: Length of a repeated string in bytes, and of the k-grams that anchor its windows.
LENGTH, GRAM = 200, 32


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The suffix array, and levels of (width, times, rank): the ranks of all substrings of that width, where the next level's width is
    one more than ``times`` of them. As many symbols or ranks as fit 64 bits are sorted at once, and from then on only suffixes
    that are still tied; a rank is the first row of those that tie."""
    n = len(text)

    def starts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each sorted key the first of its equals, and whether it has others."""
        new = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
        return np.maximum.accumulate(np.where(new[:-1], np.arange(len(ordered)), 0)), ~(new[:-1] & new[1:])

    bits = max(1, int(text.max()).bit_length())
    width = min(64 // bits, 8)
    wide = np.zeros(n + width, np.uint64)
    wide[:n] = text
    key = wide[:n]
    for j in range(1, width):
        key = key << np.uint64(bits) | wide[j: n + j]
    order = np.argsort(key)
    first, tied = starts(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = first
    rows = np.flatnonzero(tied)
    bits, levels = np.uint64(n.bit_length()), []
    times = max(2, min(64 // int(bits), 4))
    while True:
        levels.append((width, times - 1, rank.astype(np.int32)))
        if not len(rows):
            return order, levels
        at = order[rows]
        key = rank[at].astype(np.uint64)
        for j in range(1, times):
            after = at + j * width
            key = key << bits | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0).astype(np.uint64)
        sort = np.argsort(key)
        at = at[sort]
        order[rows] = at
        first, tied = starts(key[sort])
        rank[at] = rows[first]
        rows = rows[tied]
        width *= times


def common_prefix(levels: list[tuple[int, int, np.ndarray]], text: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes x and y."""
    n = len(text)
    x, y, total = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for width, times, values in [*reversed(levels), (1, levels[0][0] - 1, text)]:
        for _ in range(times):
            ok = (x < n) & (y < n)
            same = ok & (values[np.minimum(x, n - 1)] == values[np.minimum(y, n - 1)])
            step = same * width
            total, x, y = total + step, x + step, y + step
    return total


def matching_statistics(text: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest string that starts there and at another position."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    order, levels = suffix_order(text)
    bwt = text[order - 1]
    border = bwt[1:] != bwt[:-1]
    at = np.arange(n)
    best = np.zeros(n, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], border]))
    ends = np.flatnonzero(np.concatenate([border, [True]]))
    for rows, step in ((starts, -1), (ends, 1)):  # the neighbour above a run's start, and below its end
        inner = (rows + step >= 0) & (rows + step < n)
        length = np.zeros(len(rows), np.int64)
        length[inner] = common_prefix(levels, text, order[rows[inner]], order[rows[inner] + step])
        sample = np.full(n, -1, np.int64)
        sample[order[rows]] = length
        last = np.maximum.accumulate(np.where(sample >= 0, at, -1))
        best = np.maximum(best, np.where(last >= 0, sample[last] - (at - last), 0))
    return best


def compare(blocks: list[bytes], groups: np.ndarray, shifts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each block, which of its windows also start elsewhere in the batch."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(blocks)
    room = 65_000 - 256
    for first in range(0, len(blocks), room):  # each block ends in a symbol of its own; a batch never holds so many
        part = blocks[first: first + room]
        sizes = np.array([len(b) for b in part])
        stops = np.cumsum(sizes + 1)
        text = np.zeros(int(stops[-1]), np.int64)
        body = np.ones(len(text), bool)
        body[stops - 1] = False
        text[body] = np.frombuffer(b"".join(part), np.uint8)
        text[stops - 1] = 256 + np.arange(len(part))
        long = matching_statistics(text) >= length
        for i, (stop, size) in enumerate(zip(stops, sizes)):
            out[first + i] = long[stop - 1 - size: stop - length]
    return out


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    return byte_values(data), offsets


BYTES = Kind(LENGTH, GRAM, _symbols, lambda text, starts, stops: [text[a:b] for a, b in zip(starts, stops)],
             lambda block: byte_values(np.frombuffer(block, np.uint8)), compare)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, ranges in zip(batch.column("text"), batch.column("_ranges")):
                data = (text.as_py() or "").encode()
                spans = merged(ranges.as_py() or [])
                kept, at = hashlib.sha256(), 0
                for start, stop in spans:
                    kept.update(data[at:start])
                    at = stop
                kept.update(data[at:])
                for o, v in zip(out, (len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_marks(docs, marks(docs, BYTES), "doc_id").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def removed(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of text; a null text stays null, all other columns stay as they are."""
    names = docs.columns
    rest = [n for n in names if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column("text"), batch.column("_ranges")):
                value, spans = text.as_py(), ranges.as_py()
                if value is not None and spans:
                    data, pieces, at = value.encode(), [], 0
                    for start, stop in merged(spans):
                        while start > 0 and data[start] & 0xC0 == 0x80:  # within a character: all of it goes
                            start -= 1
                        while stop < len(data) and data[stop] & 0xC0 == 0x80:
                            stop += 1
                        pieces.append(data[at:max(at, start)])
                        at = max(at, stop)
                    value = b"".join([*pieces, data[at:]]).decode()
                texts.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return with_marks(docs, marks(docs, BYTES), *rest).mapInArrow(run, docs.schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(own(table(spark, sf_dir, "documents"), "doc_id", "text"))
