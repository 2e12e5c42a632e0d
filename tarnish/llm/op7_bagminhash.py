"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A text is a bag of shingles of five words (all its words if it has fewer). Its signature holds for each register the least
point of Poisson processes, one for each shingle and each dyadic interval of weights below the shingle's count; a point
belongs to the weights it falls on, and those beyond the count are thinned out. Two signatures agree in a register with just
the probability of the weighted Jaccard similarity. Points beyond the value that fills all registers are never
generated, which makes a signature cost little more than one point for each shingle.

Texts with equal bags form a class. Classes meet in bands of registers; in each bucket they are compared to one hub, as a
star; links found make groups; buckets that still hold several groups get other hubs. What is then left in a bucket is compared all
with all, without texts that a bound rules out, the shingles that no other text left holds, as they can't be shared. This is done
in blocks of two sides of texts: a text is sent once for each side, a block counts common shingles as a product of matrices and
returns only links that join its texts. So no link that could join two groups is lost, a bucket of copies costs one comparison
for each, and a bucket of texts that are alike but not enough costs a row for each text and side.

Defined results: a row with a null id or without words is in no group and is kept; its class_id and group_id are its own id.
Rows that repeat an id with an equal text share one verdict. Group ids are the least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm.common import chunks, lists, mix, own, prefix_hashes, range_hashes, signed, table, text_bytes, text_key
from tarnish.llm.common import word_hashes, word_spans
from tarnish.llm.components import components
from tarnish.session import materialize

SHINGLE, SIMILARITY = 5, 0.8
#: Registers of a signature and registers of a band: a pair at the threshold is missed with probability 0.0002.
REGISTERS, ROWS = 168, 6
#: Members of a star that one sorted run of rows compares to their hub, and the number of rounds of stars.
STAR, ROUNDS = 200, 3
#: Texts and shingles of a side of a block of what the stars left, and elements that are multiplied at once.
SIDE, SIDE_SHINGLES, COLUMNS = 512, 1 << 20, 4096
#: Hash slots of shingles, and shares of them that one task counts.
SLOTS, SHARES = 1 << 24, 256


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts in order of text and hash, their counts, and the offset of each text."""
    data, offsets = text_bytes(column)
    starts, ends, firsts = word_spans(data, offsets)
    prefix = prefix_hashes(word_hashes(data, starts, ends))
    n_words = np.diff(firsts)
    sizes = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    text = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    at = np.arange(len(text)) - begins[text] + firsts[text]
    hashes = range_hashes(prefix, at, at + np.minimum(n_words[text], SHINGLE))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(text)))
    return hashes[first], counts, np.searchsorted(text[first], np.arange(len(sizes) + 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(shingles: np.ndarray, counts: np.ndarray, offsets: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """A row of m least points for each text; infinite where a text has no shingles."""
    n = len(offsets) - 1
    out = np.full(n * m, np.inf)
    text = np.repeat(np.arange(n), np.diff(offsets))
    weight = np.bincount(text, counts, n)
    limit = (np.log(m) + 6) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        mine = todo[text]
        who, element, count = text[mine], shingles[mine], counts[mine]
        low, level = 0, 0
        while len(who):
            high = 1 << level
            seed = mix(element + np.uint64((level + 1) * 0xA24BAED4963EE407 % 2**64))
            _points(out, who, seed, count - low, high - low, limit, m)
            low, level = high, level + 1
            more = count > low
            who, element, count = who[more], element[more], count[more]
        filled = np.isfinite(out.reshape(n, m)).all(1)
        todo &= ~filled
        out.reshape(n, m)[todo] = np.inf
        limit = limit * 2
    return out.reshape(n, m)


def _points(out: np.ndarray, who: np.ndarray, seed: np.ndarray, reach: np.ndarray, span: int, limit: np.ndarray, m: int) -> None:
    """Runs the processes of one interval of ``span`` weights, of which the first ``reach`` count, up to each text's limit."""
    x = np.zeros(len(who))
    while len(who):
        seed = mix(seed + np.uint64(0x9FB21C651E98DF25))
        x = x - np.log(_uniform(seed)) / (m * span)
        go = x <= limit[who]
        who, seed, reach, x = who[go], seed[go], reach[go], x[go]
        place = mix(seed ^ np.uint64(0x5851F42D4C957F2D))
        hit = (_uniform(place) * span).astype(np.int64) < reach if span > 1 else np.ones(len(who), bool)
        register = (mix(place) % np.uint64(m)).astype(np.int64)
        np.minimum.at(out, who[hit] * m + register[hit], x[hit])


def bands(found: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of registers."""
    parts = np.ascontiguousarray(found).view(np.uint64).reshape(len(found), -1, rows)
    out = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        out = mix(out + parts[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags of distinct sorted shingles with counts."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    shared = int(np.minimum(a[1][at[both]], b[1][both]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            shingles, counts, offsets = bags(part.column("text"))
            sizes = np.diff(offsets)
            key = range_hashes(prefix_hashes(mix(shingles ^ mix(counts.astype(np.uint64)))), offsets[:-1], offsets[1:])
            b = bands(signatures(shingles, counts, offsets))
            b[sizes == 0] = 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tk"),
                 pa.array(signed(key), mask=sizes == 0), pa.array(np.add.reduceat(np.append(counts, 0), offsets[:-1]) * (sizes > 0)),
                 lists(signed(b.ravel()), np.full(len(b), b.shape[1]), pa.int64())], names=["doc_id", "tk", "cid", "total", "bands"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub, share and role in; (a, b, similarity) of each member and its hub out."""
    hub, of_hub = None, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for batch in batches:
        for part in chunks(batch):
            shingles, counts, offsets = bags(part.column("text"))
            out: list[list] = [[], [], []]
            for i, (h, member) in enumerate(zip(part.column("b").to_pylist(), part.column("a").to_pylist())):
                bag = shingles[offsets[i]: offsets[i + 1]], counts[offsets[i]: offsets[i + 1]]
                if member is None:
                    hub, of_hub = h, bag
                elif hub == h:
                    for o, v in zip(out, (member, h, similarity(of_hub, bag))):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                                             names=["a", "b", "similarity"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of classes, stored. Each hub b is sent once to every STAR of its members."""
    pairs = materialize(pairs, "near_pairs")
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("shares"))
    members = pairs.join(shares, "b").join(texts.withColumnRenamed("cid", "a"), "a").selectExpr(
        "b", "cast(pmod(xxhash64(a), shares) as int) share", "a", "text")
    hubs = shares.join(texts.withColumnRenamed("cid", "b"), "b").selectExpr(
        "b", "explode(sequence(0, shares - 1)) share", "cast(null as bigint) a", "text")
    rows = hubs.unionByName(members).repartition("b", "share").sortWithinPartitions("b", "share", F.col("a").asc_nulls_first())
    return materialize(rows.mapInArrow(_stars, "a bigint, b bigint, similarity double"), "near_similarities")


def _elements(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a bag, each as often as it counts: two bags share as many elements as the sum of their lesser counts."""
    shingles, counts = bag
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(shingles, counts) + mix(nth.astype(np.uint64)))


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each text of x and each of y, as products of 0/1 matrices over elements that both sides hold."""
    one, other = (np.concatenate([np.zeros(0, np.uint64), *side]) for side in (x, y))
    of_one, of_other = (np.repeat(np.arange(len(side)), [len(e) for e in side]) for side in (x, y))
    if x is y:
        held, times = np.unique(one, return_counts=True)
        both = held[times > 1]
    else:
        both = np.intersect1d(one, other)
    found = np.zeros((len(x), len(y)))
    if not len(both):
        return found
    found_at = []
    for elements, of in ((one, of_one), (other, of_other)):
        at = np.minimum(np.searchsorted(both, elements), len(both) - 1)
        known = both[at] == elements
        order = np.argsort(at[known], kind="stable")
        found_at.append((at[known][order], of[known][order]))
    for first in range(0, len(both), COLUMNS):
        width, made = min(COLUMNS, len(both) - first), []
        for (at, of), side in zip(found_at, (x, y)):
            lo, hi = np.searchsorted(at, (first, first + width))
            held = np.zeros((len(side), width), np.float32)
            held[of[lo:hi], at[lo:hi] - first] = 1
            made.append(held)
        found += made[0] @ made[1].T
    if x is y:
        np.fill_diagonal(found, [len(e) for e in x])
    return found


def _tree(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that the symmetric matrix joins; one less than the texts of each component."""
    out, todo = [], linked.any(1)
    while todo.any():
        first = int(np.argmax(todo))
        todo[first], reached = False, [first]
        while reached:
            at = reached.pop()
            new = np.flatnonzero(linked[at] & todo)
            todo[new] = False
            out += [(at, int(n)) for n in new]
            reached += new.tolist()
    return out


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block in; (a, b, similarity) of links between components out, as many as join what all such links join."""
    def emit(lo: int, hi: int, rows: list[tuple]) -> pa.RecordBatch:
        ids = [r[0] for r in rows]
        side = np.array([r[1] for r in rows])
        component = np.array([r[2] for r in rows])
        one = [r[3] for r in rows if r[1] == lo]
        other = one if lo == hi else [r[3] for r in rows if r[1] == hi]
        shared = overlaps(one, other)
        sizes = np.array([len(r[3]) for r in rows])
        like = np.zeros((len(rows), len(rows)))
        in_one, in_other = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        like[np.ix_(in_one, in_other)] = shared / (sizes[in_one][:, None] + sizes[in_other] - shared)
        like = np.maximum(like, like.T)
        links = _tree((like >= SIMILARITY) & (component[:, None] != component))
        return pa.RecordBatch.from_arrays(
            [pa.array([max(ids[i], ids[j]) for i, j in links], pa.int64()), pa.array([min(ids[i], ids[j]) for i, j in links], pa.int64()),
             pa.array([like[i, j] for i, j in links], pa.float64())], names=["a", "b", "similarity"])

    block, held = None, []
    for batch in batches:
        for part in chunks(batch):
            shingles, counts, offsets = bags(part.column("text"))
            keys = zip(*(part.column(c).to_pylist() for c in ("band", "bh", "lo", "hi")))
            rows = zip(*(part.column(c).to_pylist() for c in ("cid", "side", "component")))
            for i, (key, row) in enumerate(zip(keys, rows)):
                if key != block:
                    if held:
                        yield emit(*block[2:], held)
                    block, held = key, []
                held.append((*row, _elements((shingles[offsets[i]: offsets[i + 1]], counts[offsets[i]: offsets[i + 1]]))))
    if held:
        yield emit(*block[2:], held)


def compared_in_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of links that join the components of the members (band, bh, cid, component, total) of each bucket as all
    links within the bucket do, stored.

    A bucket is cut into sides of about SIDE texts, fewer if they are long, and a block compares two sides, or one with itself. So a
    text is sent once for each side of its bucket, not once for each other text.
    """
    sides = members.groupBy("band", "bh").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("shingles")).where("n > 1").selectExpr(
        "band", "bh", f"cast(least(n, greatest(ceil(n / {SIDE}), ceil(shingles / {SIDE_SHINGLES}))) as int) sides")
    dealt = members.join(sides, ["band", "bh"]).selectExpr("band", "bh", "cid", "component", "sides", "cast(pmod(xxhash64(cid, 7), sides) as int) side")
    dealt = dealt.withColumn("other", F.expr("explode(sequence(0, sides - 1))")).selectExpr(
        "band", "bh", "least(side, other) lo", "greatest(side, other) hi", "side", "cid", "component")
    dealt = materialize(dealt, "near_blocks")
    rows = dealt.join(texts, "cid").repartition("band", "bh", "lo", "hi").sortWithinPartitions("band", "bh", "lo", "hi", "side", "cid")
    return materialize(rows.mapInArrow(_block_links, "a bigint, b bigint, similarity double"), "near_block_links")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _slot_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each share of the slots, the slots of all shingles of each chunk of texts; a text lists a slot once."""
    width = SLOTS // SHARES
    for batch in batches:
        for part in chunks(batch):
            shingles, _, offsets = bags(part.column("text"))
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            slots = np.sort(np.unique(text * SLOTS + _slots(shingles)) % SLOTS)
            sizes = np.diff(np.searchsorted(slots, np.arange(0, SLOTS + 1, width)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARES, dtype=np.int32)), lists(slots % width, sizes, pa.int32())],
                                             names=["share", "slots"])


def _slots_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the slots that more than one text lists, for each share; rows come sorted by share."""
    share, seen = None, np.zeros(SLOTS // SHARES, np.int64)

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()])], names=["share", "bits"])

    for batch in batches:
        for s, slots in zip(batch.column("share").to_pylist(), batch.column("slots")):
            if s != share:
                if share is not None:
                    yield emit()
                share, seen = s, np.zeros(SLOTS // SHARES, np.int64)
            seen += np.bincount(np.asarray(slots.values), minlength=len(seen))
    if share is not None:
        yield emit()


def common_counts(texts: DataFrame) -> DataFrame:
    """(cid, common): an upper bound of the shingles of each text that any other of the texts holds, by hash slots.

    The table of slots has a fixed size; where it fills up, the bound grows and rules out less, but stays a bound.
    """
    shares = texts.select("text").mapInArrow(_slot_lists, "share int, slots array<int>").repartition("share").sortWithinPartitions(
        "share").mapInArrow(_slots_twice, "share int, bits binary").collect()  # SLOTS / 8 bytes in all
    twice = np.zeros(SLOTS, bool)
    width = SLOTS // SHARES
    for r in shares:
        twice[r["share"] * width: (r["share"] + 1) * width] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    table = texts.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                shingles, counts, offsets = bags(part.column("text"))
                held = np.concatenate([[0], np.cumsum(counts * table.value[_slots(shingles)])])
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(held[offsets[1:]] - held[offsets[:-1]])], names=["cid", "common"])

    return materialize(texts.mapInArrow(run, "cid bigint, common bigint"), "near_common")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, tk, class_id, group_id and kept: one row for each row of docs."""
    rows = own(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "text", f"{text_key()} tk")
    profiles = materialize(rows.mapInArrow(_profiles, "doc_id bigint, tk bigint, cid bigint, total bigint, bands array<bigint>"), "near_profiles")
    known = profiles.where("doc_id is not null and cid is not null")
    classes = materialize(known.groupBy("cid").agg(
        F.min(F.struct("doc_id", "tk")).alias("one"), F.first("bands").alias("bands"), F.max("total").alias("total")).selectExpr(
            "cid", "one.doc_id class_id", "one.tk tk", "total", "bands"), "near_classes")

    entries = classes.select("cid", "total", F.posexplode("bands").alias("band", "bh"))
    full = entries.groupBy("band", "bh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cid", "total")).alias("hub")).where(
        "n > 1").selectExpr("band", "bh", "hub.cid hub", "hub.total hub_total")
    buckets = materialize(entries.join(full, ["band", "bh"]), "near_buckets")
    involved = buckets.select("cid").distinct()
    wanted = classes.join(involved, "cid", "left_semi").select("cid", F.col("class_id").alias("_id"), F.col("tk").alias("_tk"))
    texts = rows.join(wanted, F.col("tk").eqNullSafe(F.col("_tk")) & (F.col("doc_id") == F.col("_id"))).select("cid", "text")
    texts = materialize(texts.dropDuplicates(["cid"]), "near_texts")

    near = lambda a, b: f"{SIMILARITY} * greatest({a}, {b}) <= least({a}, {b}) + 1e-6"  # noqa: E731  bags of other sizes can't link
    measured = [compared(buckets.where(f"cid <> hub and {near('total', 'hub_total')}").selectExpr("cid a", "hub b").distinct(), texts)]
    for step in range(1, ROUNDS + 1):
        labels = components(_links(measured))
        labelled = materialize(buckets.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn(
            "component", F.coalesce("component", "cid")), "near_labelled")
        split = labelled.groupBy("band", "bh").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.min(F.struct(F.xxhash64("cid", F.lit(step)), F.col("cid"), F.col("component"), F.col("total"))).alias("next")).where("lo <> hi")
        open_ = labelled.join(split.selectExpr("band", "bh", "next.cid b", "next.component bc", "next.total bt"), ["band", "bh"])
        if step < ROUNDS:
            pairs = open_.where(f"component <> bc and {near('total', 'bt')}").selectExpr("cid a", "b")
            measured.append(compared(pairs.distinct(), texts))
        else:
            left = open_.select("cid").distinct()
            open_ = materialize(open_.join(common_counts(texts.join(left, "cid", "left_semi")), "cid").where(
                f"common >= {SIMILARITY} * total").select("band", "bh", "cid", "component", "total"), "near_left")
            split = open_.groupBy("band", "bh").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            measured.append(compared_in_blocks(open_.join(split, ["band", "bh"], "left_semi"), texts))
    labels = components(_links(measured))
    found = classes.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid")).select("cid", "class_id", "component")
    heads = found.groupBy("component").agg(F.min("class_id").alias("group_id"))
    verdicts = found.join(heads, "component").select("cid", "class_id", "group_id")
    out = profiles.select("doc_id", "tk", "cid").join(verdicts, "cid", "left")
    return out.selectExpr("doc_id", "tk", "coalesce(class_id, doc_id) class_id", "coalesce(group_id, doc_id) group_id").withColumn(
        "kept", F.expr("doc_id is null or doc_id = group_id"))


def _links(measured: list[DataFrame]) -> DataFrame:
    out = measured[0]
    for more in measured[1:]:
        out = out.unionByName(more)
    return out.where(f"similarity >= {SIMILARITY}").select("a", "b")


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each group left, and each repeated row once."""
    verdicts = groups(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).distinct()
    rows = docs.withColumn("_tk0", F.expr(text_key())).withColumn("_id0", F.col("doc_id").cast("bigint"))
    same = F.col("_tk0").eqNullSafe(F.col("_tk")) & F.col("_id0").eqNullSafe(F.col("_id"))
    return rows.join(verdicts, same, "left_semi").dropDuplicates(["_tk0", "_id0"]).drop("_tk0", "_id0")


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("tk")
