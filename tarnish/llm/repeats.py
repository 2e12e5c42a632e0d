"""Exact search for windows of symbols that stand more than once in a corpus, for bytes and for words.

1. Of each window of ``length`` symbols the k-gram with the least hash, the leftmost of equals, is its anchor. Two equal
   windows have equal anchors at equal places. Neighbouring windows with one anchor form a block: all that is shuffled
   is one row for each block (about two for every ``length - k`` symbols): hash of the anchor, hash of the block, key of
   its text, place.
2. Anchors that stand once drop out after an aggregation with map-side combine. If all blocks of an anchor are equal, all their
   windows are repeated. Only anchors with unequal blocks need the symbols: one copy of each distinct block is
   cut from its text and handed to ``compare``, which gets whole anchor groups in bounded batches.
3. Groups of more than ``HOT`` distinct blocks are never gathered whole. Their blocks are cut into nodes of neighbouring windows: what
   all windows of a node hold rules the node out if it stands once, and settles it if all that they reach stands twice. What is left
   of a block's nodes are slices, which meet again by what their windows hold in common, as by a longer anchor, and are compared so.
   Where more than ``HOT`` slices share that, they are cut into smaller nodes in turn, down to nodes of one window.

Marks go by the key of the text, so repeated rows and null ids need no care: equal texts have equal marks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.common import chunks, mix, own, prefix_hashes, range_hashes, signed, text_key
from tarnish.session import materialize

#: Distinct blocks of one anchor up to which they are compared within one task.
HOT = 500
#: Nodes that the windows of a hot block are cut into, and parts that a node is cut into in turn.
NODES, PARTS = 7, 4
#: Bytes of blocks that are compared together.
BATCH_BYTES = 400_000


@dataclass(frozen=True)
class Kind:
    """What a symbol is. ``symbols(column)`` gives the hashes of all symbols and the offset of each text; ``cut(text,
    starts, stops)`` the bytes of ranges of one text; ``of(block)`` the symbols' hashes of such bytes;
    ``compare(blocks, groups, places)`` a boolean array of the windows of each block."""

    length: int
    k: int
    symbols: Callable
    cut: Callable
    of: Callable
    compare: Callable


def blocks(values: np.ndarray, offsets: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """The blocks of a batch of texts: text number, place in the text, number of windows, anchor's offset, hashes."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < length:
        return {"text": none, "place": none, "count": none, "shift": none, "h": none.view(np.uint64), "bh": none.view(np.uint64)}
    prefix = prefix_hashes(values)
    at = np.arange(n - k + 1)
    grams = range_hashes(prefix, at, at + k)
    bits = np.uint64(max(21, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (grams & ~low) | at.astype(np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: n - length + 1], least[width - span:])
    anchor = (least & low).astype(np.int64)
    enough = np.flatnonzero(np.diff(offsets) >= length)
    steps = np.zeros(n + 2, np.int32)
    steps[offsets[enough]] += 1
    steps[offsets[enough + 1] - length + 1] -= 1
    inside = np.cumsum(steps)[: n - length + 1] > 0
    differs = np.ones(len(anchor), bool)
    differs[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(inside & differs)
    ends_here = np.ones(len(anchor), bool)
    ends_here[:-1] = (anchor[1:] != anchor[:-1]) | ~inside[1:]
    ends = np.flatnonzero(inside & ends_here)
    shift = anchor[starts] - starts
    text = np.searchsorted(offsets, starts, "right") - 1
    whole = range_hashes(prefix, starts, ends + length)
    return {"text": text, "place": starts - offsets[text], "count": ends - starts + 1, "shift": shift,
            "h": grams[anchor[starts]], "bh": mix(whole ^ mix(shift.astype(np.uint64) + np.uint64(77)))}


def _block_rows(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = blocks(*kind.symbols(part.column("text")), kind.length, kind.k)
                keys = np.asarray(part.column("tk"))
                loc = found["place"] << 16 | found["count"] << 8 | found["shift"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(found["h"])), pa.array(signed(found["bh"])), pa.array(keys[found["text"]]), pa.array(loc)],
                    names=["h", "bh", "tk", "loc"])
    return run


def _cut_rows(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, wanted in zip(batch.column("text"), batch.column("wanted")):
                wanted = wanted.as_py()
                starts = [w["loc"] >> 16 for w in wanted]
                stops = [s + (w["loc"] >> 8 & 255) + kind.length - 1 for s, w in zip(starts, wanted)]
                for w, block in zip(wanted, kind.cut((text.as_py() or "").encode(), starts, stops)):
                    for o, v in zip(out, (w["h"], w["bh"], w["loc"] & 255, w["hot"], block)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.bool_()), pa.array(out[4], pa.binary())], names=["h", "bh", "shift", "hot", "block"])
    return run


def _runs(flags: np.ndarray) -> list[list[int]]:
    """[first, last] of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [[int(a), int(b) - 1] for a, b in zip(edge[::2], edge[1::2])]


def _compared(kind: Kind):
    """Rows sorted by ``g``, what they are compared by, in; (h, bh, first, last) of repeated windows out."""
    def emit(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        groups = np.array([r[0] for r in rows], np.int64)
        for row, flags in zip(rows, kind.compare([r[5] for r in rows], groups, [r[4] for r in rows])):
            for first, last in _runs(flags):
                for o, v in zip(out, (row[1], row[2], row[3] + first, row[3] + last)):
                    o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["h", "bh", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "h", "bh", "first", "shift", "block"))):
                if size > BATCH_BYTES and row[0] != held[-1][0]:
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield emit(held)
    return run


def _node_sizes(kind: Kind) -> list[int]:
    """Windows of a node, level by level; the nodes of a level divide those of the level before."""
    sizes = [max(1, (kind.length - kind.k + 1) // NODES)]
    while sizes[-1] > 1:
        sizes.append(sizes[-1] // PARTS if sizes[-1] % PARTS == 0 else 1)
    return sizes


def _nodes(size: int, shift: int, count: int) -> list[tuple[int, int, int]]:
    """(node, lo, hi): the intervals of offsets before the anchor that a block's windows fall in; equal ones for all blocks."""
    return [(n, n * size, n * size + size - 1) for n in range((shift - count + 1) // size, shift // size + 1)]


def _node_rows(kind: Kind, size: int):
    """(h, bh, first, node, wh) of hot blocks or slices: for each node the hash of what all its windows hold, as 2 · node, and of all
    that they reach, as 2 · node + 1, if the block has them all; for a node of one window, which are the same, only the latter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for h, bh, at, shift, block in zip(*(batch.column(c).to_pylist() for c in ("h", "bh", "first", "shift", "block"))):
                values = kind.of(block)
                count = len(values) - kind.length + 1
                found = []
                for node, lo, hi in _nodes(size, shift, count):
                    if size > 1:
                        found.append((2 * node, shift - lo, shift + kind.length - hi))
                    if hi <= shift and lo > shift - count:
                        found.append((2 * node + 1, shift - hi, shift + kind.length - lo))
                of, a, b = np.array(found).T
                wh = mix(range_hashes(prefix_hashes(values), a, b) ^ mix(of.astype(np.uint64)))
                for o, v in zip(out, ([h] * len(of), [bh] * len(of), [at] * len(of), of.tolist(), signed(wh).tolist())):
                    o.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["h", "bh", "first", "node", "wh"])
    return run


def _slice_rows(kind: Kind, size: int):
    """(h, bh, first, last, g, shift, block) of hot blocks or slices with the list of their shared nodes: ranges of windows that are
    repeated (g null), and the slices of nodes that may be in part, with the hash of what their windows hold in common. Of the
    blocks that settle a node together, one, the lead, shows its slice to others, if there are any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for h, bh, at, shift, block, shared in zip(*(batch.column(c).to_pylist() for c in ("h", "bh", "first", "shift", "block", "nodes"))):
                shared = {x["node"]: x for x in shared}
                count = len(kind.of(block)) - kind.length + 1
                settled, open_ = np.zeros(count, bool), []
                for node, lo, hi in _nodes(size, shift, count):
                    first, last = max(0, shift - hi), min(count - 1, shift - lo)
                    held, reached = shared.get(2 * node), shared.get(2 * node + 1)
                    if reached:
                        settled[first: last + 1] = True
                    if held and (not reached or reached["lead"] and reached["n"] < held["n"]):
                        open_.append((first, last, held["wh"]))
                rows = [(h, bh, at + first, at + last, None, None, None) for first, last in _runs(settled)]
                slices = kind.cut(block, [first for first, _, _ in open_], [last + kind.length for _, last, _ in open_])
                rows += [(h, bh, at + first, at + last, g, shift - first, part) for (first, last, g), part in zip(open_, slices)]
                for row in rows:
                    for o, v in zip(out, row):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(o, pa.int64()) for o in out[:5]], pa.array(out[5], pa.int32()), pa.array(out[6], pa.binary())],
                names=["h", "bh", "first", "last", "g", "shift", "block"])
    return run


def _sliced(hot: DataFrame, kind: Kind, size: int) -> DataFrame:
    """The ranges and slices of hot blocks or slices at nodes of ``size`` windows, stored."""
    key = ["h", "bh", "first"]
    nodes = materialize(hot.mapInArrow(_node_rows(kind, size), "h bigint, bh bigint, first bigint, node bigint, wh bigint"), "repeat_nodes")
    shared = nodes.groupBy("h", "node", "wh").agg(F.count(F.lit(1)).alias("n"), F.min("bh").alias("lead")).where("n > 1")
    shown = nodes.join(shared, ["h", "node", "wh"]).groupBy(*key).agg(
        F.collect_list(F.expr("struct(node, wh, n, bh = lead as lead)")).alias("nodes"))
    return materialize(hot.join(shown, key).mapInArrow(
        _slice_rows(kind, size), "h bigint, bh bigint, first bigint, last bigint, g bigint, shift int, block binary"), "repeat_slices")


def marks(docs: DataFrame, kind: Kind) -> DataFrame:
    """(tk, ranges): for each text with repeated windows, the ranges [start, stop) of symbols they cover, unmerged."""
    texts = own(docs, "doc_id", "text").selectExpr("doc_id", "text", f"{text_key()} tk")
    found = materialize(texts.select("text", "tk").mapInArrow(_block_rows(kind), "h bigint, bh bigint, tk bigint, loc bigint"),
                        "repeat_blocks")
    anchors = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("bh").alias("lo"), F.max("bh").alias("hi")).where(
        "n > 1").selectExpr("h", "lo <> hi mixed")
    repeated = materialize(found.join(anchors, "h"), "repeat_rows")
    mixed = repeated.where("mixed")

    distinct = mixed.groupBy("h", "bh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tk", "loc")).alias("one"))
    distinct = materialize(distinct.selectExpr("h", "bh", "n", "one.tk tk", "one.loc loc"), "repeat_distinct")
    sizes = distinct.groupBy("h").agg((F.count(F.lit(1)) > HOT).alias("hot"))
    wanted = distinct.join(sizes, "h").groupBy("tk").agg(F.collect_list(F.struct("h", "bh", "loc", "hot")).alias("wanted"))
    firsts = texts.groupBy("tk").agg(F.min("doc_id").alias("first_id"))
    wanted = wanted.join(firsts, "tk")
    cut = texts.join(wanted, "tk").where("doc_id <=> first_id").select("text", "wanted").mapInArrow(
        _cut_rows(kind), "h bigint, bh bigint, shift int, hot boolean, block binary").dropDuplicates(["h", "bh"])
    cut = materialize(cut, "repeat_cuts")

    own_group = cut.selectExpr("hot", "h g", "h", "bh", "0L first", "shift", "block")
    some, hot = own_group.where("not hot").drop("hot"), own_group.where("hot").drop("hot")
    settled = []
    for size in _node_sizes(kind):
        found = _sliced(hot, kind, size)
        settled.append(found.where("g is null").select("h", "bh", "first", "last"))
        slices = found.where("g is not null").select(*some.columns)
        large = slices.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HOT}").select("g")
        some, hot = some.unionByName(slices.join(large, "g", "left_anti")), slices.join(large, "g", "left_semi")
    # nodes of one window leave no slices
    compared = some.repartition("g").sortWithinPartitions("g").mapInArrow(_compared(kind), "h bigint, bh bigint, first bigint, last bigint")
    for ranges in settled:
        compared = compared.unionByName(ranges)
    partly = compared.groupBy("h", "bh").agg(F.collect_list(F.struct("first", "last")).alias("parts"))

    length = kind.length
    place, count = "shiftright(loc, 16)", "(shiftright(loc, 8) & 255)"
    of_mixed = mixed.join(distinct.select("h", "bh", "n").join(partly, ["h", "bh"], "left"), ["h", "bh"])
    whole = repeated.where("not mixed").selectExpr("tk", f"{place} start", f"{place} + {count} + {length - 1} stop").unionByName(
        of_mixed.where("n > 1").selectExpr("tk", f"{place} start", f"{place} + {count} + {length - 1} stop"))
    some = of_mixed.where("n = 1 and parts is not null").selectExpr("tk", f"{place} place", "inline(parts)").selectExpr(
        "tk", "place + first start", f"place + last + {length} stop")
    return whole.unionByName(some).groupBy("tk", "start").agg(F.max("stop").alias("stop")).groupBy("tk").agg(
        F.collect_list(F.struct("start", "stop")).alias("ranges"))


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs that the ranges of one text cover."""
    out: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def with_marks(docs: DataFrame, found: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and text of every row with the ranges of its text (null: none)."""
    rows = own(docs, *keep, "text").withColumn("_tk", F.expr(text_key()))
    return rows.join(found.withColumnRenamed("tk", "_tk").withColumnRenamed("ranges", "_ranges"), "_tk", "left").drop("_tk")



