"""What several operators share: table access, words and hashes of whole Arrow batches, 64-bit mixing."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: the blank and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task turns into numpy arrays at once; a longer text is taken alone.
CHUNK_BYTES = 2 << 20

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they find it nowhere else."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key() -> str:
    """SQL of the key of a text: its 64-bit hash and its length tell texts apart; null counts as empty."""
    return "xxhash64(coalesce(text, ''), octet_length(coalesce(text, '')))"


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the hash base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        found = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            found.append(np.cumprod(p))
        _POWERS[:] = found
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial of values[i:j] times base**i; values are 64-bit hashes of symbols."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One well-mixed hash for each range; equal content gives equal hashes wherever it stands."""
    _, down = powers(len(prefix))
    length = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each text; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a batch, and the number of the first word of each text."""
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~_IS_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    first[cuts] |= solid[cuts]
    last = np.zeros(n + 1, bool)
    last[1:] = solid[:n] & ~solid[1:]
    last[cuts] |= (cuts > 0) & solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_hashes(byte_values(data)), starts, ends)


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``size`` bytes together."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of a table can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])
