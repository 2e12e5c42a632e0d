"""Quality classifier on random-indexing word vectors.

Every token, a run of letters and digits or of punctuation, hashes to one of ``ROWS`` rows. A row's index vector is sparse, ternary and
random; its word vector is the sum of the index vectors of the tokens next to it, over all documents. A document is pooled from
its tokens' vectors (mean, mean weighted against frequent tokens, spread, and the log of its length) and scored by a two-layer network
in numpy, whose logits are divided by a temperature fitted on rows that the network was not fitted on.

Scale: word vectors are whole-number sums, one partial table for each task, added by an aggregation; only the finished table
(``ROWS`` × ``WIDTH`` numbers whatever the corpus) reaches the driver and the tasks. The network is fitted on the driver on
``FIT_ROWS`` labelled documents at most, chosen by a hash of the id. Scoring is one narrow pass without a shuffle.

Defined results: a null or empty text has zero features and gets the score the network gives them; rows with a null id are scored and
not held out; labels other than 0 and 1 and labels without an id are not used, repeated labels of an id count as the least.
With no label to learn from every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm.common import byte_values, chunks, lists, mix, own, prefix_hashes, range_hashes, table, text_bytes

#: Rows of the vector table, their width, entries of an index vector, and words on each side that count as near.
ROWS, WIDTH, ENTRIES, NEAR = 1 << 14, 64, 4, 2
#: Labelled documents that the network is fitted on at most, its hidden units, rounds of fitting, and the score that predicts 1.
FIT_ROWS, HIDDEN, ROUNDS, THRESHOLD = 20_000, 32, 400, 0.3
#: Text taken at once: pooling holds a vector for each token.
TAKEN_BYTES = 512 << 10

_KIND = np.full(256, 1, np.uint8)  # letters, digits and bytes of other scripts
_KIND[:128] = [0 if chr(c).isspace() or c < 32 else 1 if chr(c).isalnum() else 2 for c in range(128)]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each token of all texts, and the number of the first token of each text."""
    data, offsets = text_bytes(column)
    kind = np.append(_KIND[data], np.uint8(0))
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[:-1]] = True
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], len(data))
    solid = kind[begins] > 0
    begins, ends = begins[solid], np.minimum(ends[solid], len(data))
    h = range_hashes(prefix_hashes(byte_values(data)), begins, ends)
    return (h >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64), np.searchsorted(begins, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each row's index vector."""
    h = mix(np.arange(1, ROWS * ENTRIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(ROWS, ENTRIES)
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def near_sums(rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """ROWS × WIDTH sums of the index vectors of near tokens, within each text."""
    places, signs = index_vectors()
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    out = np.zeros(ROWS * WIDTH)
    for step in range(1, NEAR + 1):
        same = text[step:] == text[:-step]
        a, b = rows[step:][same], rows[:-step][same]
        for at, near in ((a, b), (b, a)):
            for e in range(ENTRIES):
                out += np.bincount(at * WIDTH + places[near, e], signs[near, e], ROWS * WIDTH)
    return out.reshape(ROWS, WIDTH)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros((ROWS, WIDTH)), np.zeros(ROWS)
    for batch in batches:
        for part in chunks(batch):
            rows, firsts = tokens(part.column("text"))
            total += near_sums(rows, firsts)
            seen += np.bincount(rows, minlength=ROWS)
    used = np.flatnonzero(seen)
    values = np.concatenate([seen[used, None], total[used]], axis=1).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), lists(values.ravel(), np.full(len(used), WIDTH + 1), pa.int64())],
                                     names=["row", "v"])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors of all rows, and the share of all tokens that fall on each."""
    parts = own(docs, "text").mapInArrow(_sums, "row int, v array<bigint>")
    found = parts.groupBy("row").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(WIDTH + 1)]).toArrow()
    total, seen = np.zeros((ROWS, WIDTH)), np.zeros(ROWS)
    at = np.asarray(found["row"])
    for k in range(WIDTH + 1):
        (seen if k == 0 else total[:, k - 1])[at] = np.asarray(found[f"v{k}"], dtype=float)
    vectors = total / np.maximum(seen, 1)[:, None]
    vectors -= total.sum(0) / max(seen.sum(), 1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    return (vectors * (seen > 0)[:, None]).astype(np.float32), seen / max(seen.sum(), 1)


def features(column: pa.Array, vectors: np.ndarray, share: np.ndarray) -> np.ndarray:
    """One row of pooled features for each text."""
    rows, firsts = tokens(column)
    n = np.diff(firsts)
    out = np.zeros((len(n), 3 * WIDTH + 2), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        at = firsts[:-1][some]
        taken = vectors[rows]
        weight = (1e-3 / (1e-3 + share[rows])).astype(np.float32)
        size = n[some, None].astype(np.float32)
        mean = np.add.reduceat(taken, at) / size
        square = np.add.reduceat(taken * taken, at) / size
        out[some, :WIDTH] = mean
        out[some, WIDTH: 2 * WIDTH] = np.add.reduceat(taken * weight[:, None], at) / np.add.reduceat(weight, at)[:, None]
        out[some, 2 * WIDTH: 3 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[some, -2] = np.log(n[some])
        out[some, -1] = np.linalg.norm(mean, axis=1)
    return out


class Network:
    """Two layers, fitted by Adam on all rows at once; ``probability`` is calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        aside = np.arange(len(x)) % 5 == 4
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        self.w = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN),
                  rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.w]
        fit, goal = z[~aside], y[~aside]
        for step in range(1, ROUNDS + 1):
            hidden = np.tanh(fit @ self.w[0] + self.w[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -40, 40))) - goal) / len(goal)
            back = error[:, None] * self.w[2] * (1 - hidden * hidden)
            for w, m, g in zip(self.w, moments, (fit.T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ error + 1e-4 * self.w[2],
                                                 error.sum(keepdims=True))):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                w -= 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        check = aside if aside.any() else ~aside
        logits = self.logits(x[check])

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, -np.where(y[check] > 0, 1, -1) * logits / t)))

        self.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 60)), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    spark = docs.sparkSession
    rows = own(docs, "doc_id", "text")
    table_of = spark.sparkContext.broadcast(word_vectors(rows))
    usable = own(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality")).where("crc32(cast(doc_id as string)) % 5 <> 0")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)  # the documented bound of the fit

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=TAKEN_BYTES):
                x = features(part.column("text"), *table_of.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"),
                                                  lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float32())],
                                                 names=["doc_id", "quality", "x"])

    kind, label = docs.schema["doc_id"].dataType.simpleString(), labels.schema["quality"].dataType.simpleString()
    sample = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").mapInArrow(
        pooled, f"doc_id {kind}, quality {label}, x array<float>").toArrow().sort_by("doc_id")
    network = None
    if sample.num_rows:
        x = np.asarray(sample["x"].combine_chunks().flatten(), dtype=float).reshape(sample.num_rows, -1)
        network = Network(x, np.asarray(sample["quality"], dtype=float))
    fitted = spark.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=TAKEN_BYTES):
                x = features(part.column("text"), *table_of.value)
                p = fitted.value.probability(x) if fitted.value else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p, pa.float64()),
                                                  pa.array((p >= THRESHOLD).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    return rows.withColumn("held_out", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)")).mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
