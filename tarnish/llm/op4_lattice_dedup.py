"""Near-duplicate vectors by E8 lattice hashing.

In each of several tables a vector is projected at random to two points of eight dimensions; both are decoded to their nearest points
of the lattice E8, and to the next ones. A cell is a pair of lattice points; each vector is entered in the cell it falls in and
in the nearest neighbouring cells, so two vectors meet if one neighbourhood reaches the other's. Vectors of a cell are compared
by cosine in double precision. A pair that meets in several cells counts in the first one only, which each cell finds out from the
cells that its vectors list, so no list of pairs is ever shuffled: a cell gives counts of links and a tree of its components.

Vectors of equal direction are one class: its vector of the least id stands for all of them in the cells, with their number, so copies cost
one entry however many they are, and their links follow: those of the class and the size of it less one. Classes are told apart by
128 bits of hash. Cells of more than ``BLOCK`` classes are cut into blocks that meet pairwise, each pair in a task of its own. Classes alone
in a cell are dropped before any vector is sent.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing; vectors of different length
never link; a null id links with nothing, and its component is null; rows that repeat an id are one vector, the one of the least
direction (compared component by component) among those that can link. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm.common import lists, mix, own, signed, table
from tarnish.llm.components import components
from tarnish.session import materialize

COSINE = 0.95
#: Tables, cells that a vector is entered in for each table, and the width of the lattice in units of a projected unit vector.
TABLES, ENTRIES, WIDTH = 8, 6, 1.4
#: Vectors of a block of a cell.
BLOCK = 256


def _nearest_d8(y: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """Near points of D8, whole vectors of even sum, and their squared distances: (n, ways, 8) and (n, ways)."""
    near = np.rint(y)
    off = y - near
    odd = (near.sum(1).astype(np.int64) & 1).astype(bool)
    order = np.argsort(-np.abs(off), axis=1)
    rows = np.arange(len(y))
    points = np.repeat(near[:, None, :], ways, 1)
    for w in range(ways):
        # an odd sum takes one coordinate to its second nearest value; an even one none, or two
        first = order[:, w if w else 0]
        turn = np.where(odd, order[:, w], first)
        take = odd | (w > 0)
        step = np.where(off[rows, turn] >= 0, 1.0, -1.0)
        points[rows, w, turn] += np.where(take, step, 0.0)
        again = order[:, 0] if w else order[:, 1]
        step = np.where(off[rows, again] >= 0, 1.0, -1.0)
        points[rows, w, again] += np.where(~odd & (w > 0), step, 0.0)
    return points, ((y[:, None, :] - points) ** 2).sum(2)


def lattice_points(y: np.ndarray, ways: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ways nearest of the points of E8 = D8 and D8 + 1/2 that were tried, doubled to whole numbers, nearest first."""
    a, da = _nearest_d8(y, ways)
    b, db = _nearest_d8(y - 0.5, ways)
    points = np.concatenate([2 * a, 2 * b + 1], axis=1)
    distance = np.concatenate([da, db], axis=1)
    order = np.argsort(distance, axis=1, kind="stable")[:, :ways]
    rows = np.arange(len(y))[:, None]
    return points[rows, order].astype(np.int64), distance[rows, order]


def cells(x: np.ndarray, tables: int = TABLES, entries: int = ENTRIES, width: float = WIDTH) -> np.ndarray:
    """The cells of unit vectors: (n, tables · entries) hashes."""
    n, d = x.shape
    out = np.zeros((n, tables * entries), np.uint64)
    rng = np.random.default_rng(8000 + d)
    ways = 4
    for t in range(tables):
        found = []
        for _ in range(2):
            points, distance = lattice_points(x @ rng.standard_normal((d, 8)) / width, ways)
            h = np.full(points.shape[:2], np.uint64(d * 1000 + t), np.uint64)
            for c in range(8):
                h = mix(h * np.uint64(31) + points[:, :, c].astype(np.uint64))
            found.append((h, distance))
        (ha, da), (hb, db) = found
        both = mix(ha[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + hb[:, None, :]).reshape(n, -1)
        order = np.argsort((da[:, :, None] + db[:, None, :]).reshape(n, -1), axis=1, kind="stable")[:, :entries]
        out[:, t * entries: (t + 1) * entries] = np.take_along_axis(both, order, 1)
    return out


def unit_vectors(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows and unit vectors in double precision, for each length of vector; those that link with nothing are left out."""
    sizes = np.diff(np.asarray(column.offsets, dtype=np.int64)) if len(column) else np.zeros(0, np.int64)
    rows, vectors = [], []
    flat = column.values.cast(pa.float64())
    values = np.asarray(flat.fill_null(float("nan")))
    begins = np.asarray(column.offsets, dtype=np.int64)[:-1] if len(column) else sizes
    valid = np.asarray(column.is_valid())
    for d in np.unique(sizes[valid & (sizes > 0)]):
        at = np.flatnonzero(valid & (sizes == d))
        x = values[begins[at][:, None] + np.arange(d)]
        with np.errstate(all="ignore"):
            x = x / np.abs(x).max(1)[:, None]  # first to a largest component of 1, so that squares neither over- nor underflow
            x = x / np.sqrt((x * x).sum(1))[:, None]
        ok = np.isfinite(x).all(1)
        rows.append(at[ok])
        vectors.append(x[ok])
    return rows, vectors


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, x in zip(*unit_vectors(batch.column("embedding"))):
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)), lists((x + 0.0).ravel(), np.full(len(x), x.shape[1]), pa.float64())],
                names=["vec_id", "unit"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in; with their cells out, in slices of one length of vector."""
    for batch in batches:
        units = batch.column("unit")
        offsets = np.asarray(units.offsets, dtype=np.int64)
        values, sizes = np.asarray(units.values), np.diff(offsets)
        for d in np.unique(sizes):
            of = np.flatnonzero(sizes == d)
            for lo in range(0, len(of), 2048):
                at = of[lo: lo + 2048]
                part = values[offsets[at][:, None] + np.arange(d)]
                found = cells(part)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(rows), batch.column("size").take(rows),
                     lists(part.ravel(), np.full(len(part), d), pa.float64()),
                     lists(signed(found.ravel()), np.full(len(part), found.shape[1]), pa.int64())],
                    names=["vec_id", "size", "unit", "cells"])


def block_links(a: tuple, b: tuple | None, cell: int, cosine: float = COSINE):
    """Links between two blocks, or within one: (ids, link counts), edges. A block is ids, unit vectors, cells, class sizes."""
    (ia, xa, ca, na), (ib, xb, cb, nb) = a, b or a
    with np.errstate(all="ignore"):
        linked = xa @ xb.T >= cosine
    linked &= ia[:, None] != ib[None, :]
    if linked.any():
        earlier = np.unique(np.concatenate([ca[ca < cell], cb[cb < cell]]))
        if len(earlier):
            def listed(c):
                out = np.zeros((len(c), len(earlier)), np.float32)
                at = np.minimum(np.searchsorted(earlier, c), len(earlier) - 1)
                row, col = np.nonzero(earlier[at] == c)
                out[row, at[row, col]] = 1
                return out
            linked &= (listed(ca) @ listed(cb).T) == 0  # met before, in a cell of a lesser key
    ids = np.concatenate([ia, ib]) if b else ia
    counts = np.concatenate([linked @ nb, na @ linked]) if b else linked @ nb
    label_a, label_b = ia.copy(), ib.copy()
    big = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(label_b, np.where(linked, label_a[:, None], big).min(0))
        new_a = np.minimum(label_a, np.where(linked, new_b[None, :], big).min(1))
        if b is None:
            new_b = new_a
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    return ids, counts, np.concatenate([label_a, label_b]) if b else label_a


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, i, j, side) in; (vec_id, links, label) of vectors with a link out."""
    def done(key, rows):
        _, i, j = key
        def block(side):
            r = {x[1]: x for x in rows if x[0] == side}.values()
            return (np.array([x[1] for x in r], np.int64), np.array([x[2] for x in r]), np.array([x[3] for x in r], np.int64),
                    np.array([x[4] for x in r], np.int64))
        first = block(0)
        second = block(1) if i != j else None
        if not len(first[0]) or second is not None and (not len(second[0]) or first[1].shape[1] != second[1].shape[1]):
            return None
        ids, counts, labels = block_links(first, second, key[0])
        hit = counts > 0
        return ids[hit], counts[hit], labels[hit]

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int64()) for k in range(3)],
                                          names=["vec_id", "links", "label"])

    held, key, found = [], None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cell", "i", "j", "side", "vec_id", "size")]
        units = [np.asarray(u.values) for u in batch.column("unit")]
        listed = [np.asarray(u.values) for u in batch.column("cells")]
        for cell, i, j, side, vec_id, size, unit, cs in zip(*columns, units, listed):
            if (cell, i, j) != key:
                if held and (r := done(key, held)) and len(r[0]):
                    found.append(r)
                held, key = [], (cell, i, j)
            held.append((side, vec_id, unit, cs, size))
        yield emit(found)
        found = []
    if held and (r := done(key, held)) and len(r[0]):
        yield emit([r])


def linked(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = own(vectors, "vec_id", "embedding").selectExpr("cast(vec_id as bigint) vec_id", "embedding")
    units = rows.where("vec_id is not null and embedding is not null").mapInArrow(
        _units, "vec_id bigint, unit array<double>").groupBy("vec_id").agg(F.min("unit").alias("unit"))
    units = materialize(units.selectExpr("vec_id", "unit", "xxhash64(unit) h", "xxhash64(1, unit) g"), "lattice_units")
    classes = materialize(units.groupBy("h", "g").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size")), "lattice_classes")
    entered = units.select("vec_id", "unit").join(classes.selectExpr("first vec_id", "size"), "vec_id").select("vec_id", "size", "unit").mapInArrow(
        _entries, "vec_id bigint, size bigint, unit array<double>, cells array<bigint>")
    entered = materialize(entered, "lattice_entries")
    listed = entered.select("vec_id", F.explode(F.array_distinct("cells")).alias("cell"))
    full = listed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").selectExpr(
        "cell", f"cast(ceil(n / {BLOCK}) as int) ways")
    met = listed.join(full, "cell").withColumn("block", F.expr("cast(pmod(xxhash64(vec_id, cell), ways) as int)"))
    tasks = met.selectExpr("cell", "vec_id", "block", "explode(sequence(0, ways - 1)) other").selectExpr(
        "cell", "vec_id", "least(block, other) i", "greatest(block, other) j", "if(block <= other, 0, 1) side")
    sent = tasks.join(entered, "vec_id").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")
    found = materialize(sent.mapInArrow(_compared, "vec_id bigint, links bigint, label bigint"), "lattice_links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    labels = components(found.selectExpr("vec_id a", "label b").distinct()).withColumnRenamed("id", "vec_id")
    of_class = classes.join(counts.withColumnRenamed("vec_id", "first"), "first", "left").join(
        labels.withColumnRenamed("vec_id", "first"), "first", "left").selectExpr(
        "h", "g", "coalesce(n_links, 0L) + size - 1 n_links", "coalesce(component, first) component")
    of_vector = units.select("vec_id", "h", "g").join(of_class, ["h", "g"]).drop("h", "g")
    return rows.select("vec_id").join(of_vector, "vec_id", "left").selectExpr(
        "vec_id", "coalesce(n_links, 0L) n_links", "coalesce(component, vec_id) component_id",
        "coalesce(component, vec_id) <=> vec_id kept")


def op4_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
