"""Token ids packed into rows of fixed length, best fit decreasing.

Texts are encoded; one longer than a row is split into pieces that follow each other, without loss. Pieces are dealt by a hash of
their document into groups of about ``GROUP_BYTES`` of text. Within a group the longest piece comes first, and each goes to the row
with the least room that still holds it; a segment tree over room, whose leaves list the rows with just that room, finds it in
log(row length) steps. A group wastes at most its last rows, so many groups pack as tightly as one.

Each result row is one row of the id matrix: ``ids`` holds exactly ``length`` ids, little-endian, padded; ``cu_seqlens`` the
cumulative lengths of its segments from 0; ``position_resets`` the offsets at which positions begin again at 0; ``doc_ids``,
``pieces`` and ``starts`` say for each segment which part of which document it is, so that ``unpacked`` gives every id back.

Scale: one shuffle of the ids; a task holds one group. Results depend on the ids of documents alone, not on partitions.

Defined results: a null or empty text is one end id; repeated rows are each packed; null ids are packed as such; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm.common import own, table, text_key
from tarnish.llm.op5_sentencepiece import Remembered, loaded

#: Ids in a row, id of the padding, and bytes of text in a group.
LENGTH, PAD, GROUP_BYTES = 2048, 0, 8 << 20
_ENCODERS: dict[str, tuple[Callable[[str], bytes], str]] = {}


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str) -> tuple[Callable[[str], bytes], str]:
    """A text's ids with an end id, as little-endian bytes, and the type of an id; made once by each Python worker. A file of ranks
    is byte-level BPE, its first free id the end; any other file is a SentencePiece model."""
    if path not in _ENCODERS:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            kind = "<u2" if len(ranks) < 1 << 16 else "<u4"
            bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            end = np.array([max(ranks.values()) + 1], kind).tobytes()
            _ENCODERS[path] = (lambda text: np.array(bpe.encode_ordinary(text), kind).tobytes() + end), kind
        else:
            table = loaded(path)
            kind = "<u2" if len(table.pieces) <= 1 << 16 else "<u4"
            known = Remembered(lambda s: np.array(table.segment(s), kind).tobytes())
            end = np.array([table.end], kind).tobytes()
            _ENCODERS[path] = (lambda text: b"".join([known[s] for s in table.split(text)]) + end), kind
    return _ENCODERS[path]


class Room:
    """A segment tree over room: how many rows have it, and which."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> int | None:
        """A row with the least room of need or more, taken out; None if there is none."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to the first right neighbour with rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not self.count[at]:
                    at += 1
        row = self.rows[at - self.size].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Places of the sizes, given in falling order, by row."""
    room, rows, left = Room(length), [], []
    for place, size in enumerate(sizes):
        row = room.take(size)
        if row is None:
            row = len(rows)
            rows.append([])
            left.append(length)
        rows[row].append(place)
        left[row] -= size
        if left[row]:
            room.add(left[row], row)
    return rows


def packed(docs: DataFrame, path: str, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """The rows of the id matrices of all documents."""
    kind = encoder(path)[1]
    wide = np.dtype(kind).itemsize
    rows = own(docs, "doc_id", "text").withColumn("key", F.expr(f"xxhash64(cast(doc_id as string), {text_key()})"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(path)
        step = length * wide
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, text in enumerate(batch.column("text")):
                data = encode(text.as_py() or "")
                for p in range(0, len(data), step):
                    for o, v in zip(out, (i, p // step, min(step, len(data) - p) // wide, data[p: p + step])):
                        o.append(v)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(out[1], pa.int32()),
                 pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["doc_id", "key", "piece", "n", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(group: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = best_fit_decreasing([h[2] for h in held], length)
            filler = np.array([pad], kind).tobytes()
            for lo in range(0, len(found), 256):
                part = found[lo: lo + 256]
                cu = [[0, *np.cumsum([held[p][2] for p in places]).tolist()] for places in part]
                ids = [b"".join([held[p][3] for p in places]) + filler * (length - c[-1]) for places, c in zip(part, cu)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group << 32 | lo + k for k in range(len(part))], pa.int64()),
                     pa.array([c[-1] for c in cu], pa.int32()), pa.array(ids, pa.binary()), pa.array(cu, pa.list_(pa.int32())),
                     pa.array([c[:-1] for c in cu], pa.list_(pa.int32())),
                     pa.array([[held[p][0] for p in places] for places in part], pa.list_(pa.int64())),
                     pa.array([[held[p][1] for p in places] for places in part], pa.list_(pa.int32())),
                     pa.array([[held[p][1] * length for p in places] for places in part], pa.list_(pa.int64()))],
                    names=["pack_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"])

        held, group = [], None
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "doc_id", "piece", "n", "ids"))):
                if g != group:
                    if held:
                        yield from emit(group, held)
                    held, group = [], g
                held.append(tuple(row))
        if held:
            yield from emit(group, held)

    cut = rows.selectExpr("cast(doc_id as bigint) doc_id", "text", "key").mapInArrow(
        pieces, "doc_id bigint, key bigint, piece int, n int, ids binary")
    dealt = cut.withColumn("grp", F.expr(f"pmod(xxhash64(key, piece), {groups}L)"))
    return dealt.repartition("grp").sortWithinPartitions("grp", F.desc("n"), "key", "piece").mapInArrow(
        pack, "pack_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>,"
              " pieces array<int>, starts array<bigint>")


def unpacked(packs: DataFrame, kind: str = "<u2") -> DataFrame:
    """(doc_id, piece, ids): each segment of packed rows as an id list; sorted by piece, a document's segments are its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for ids, cu, docs, pieces in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "pieces"))):
                row = np.frombuffer(ids, kind)
                for a, b, d, p in zip(cu, cu[1:], docs, pieces):
                    for o, v in zip(out, (d, p, row[a:b].tolist())):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                                              pa.array(out[2], pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])
    return packs.mapInArrow(run, "doc_id bigint, piece int, ids array<int>")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), ranks_path())
