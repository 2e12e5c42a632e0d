"""Alignment of two tokenizers: which ids of one stand where which ids of the other stand, and how firmly.

Both id lists of a text cover the same bytes. Each list's cumulative end offsets become a dictionary from end to index; the
ends that both dictionaries hold, sorted, cut both lists into groups, and every id of a group's one side is linked with every id
of its other side. How many documents hold a pair of ids linked is then counted over the corpus, and each document learns how
many of its links are the firmest of their A id.

A text is cut before each run of blanks that follows other characters: neither tokenizer joins anything over such a place
(A's pattern begins a match there; no piece of B holds a word mark after another character, which is checked when the model is
loaded). So a task aligns each distinct segment once while its bounded memory lasts, and both lists end together at each cut.

Scale: alignment is one narrow pass whose result is stored: digests, and each document's distinct pairs with their numbers of
links. Pairs are counted by an aggregation with map-side combine. Pairs that hold more than 1 / ``FREQUENT`` of all (document, pair) rows, so
fewer than ``FREQUENT`` by definition, go to every task and are summed there; only the rows of the rare pairs are
shuffled, and none of those keys holds more than that share. The result is the same for any ``FREQUENT``.

Defined results: texts that are null, empty or not reproduced byte by byte by both tokenizers (a literal U+2581, say) have no
tokens: zeros and an empty digest; each row counts as a document, repeated rows and repeated or null ids included; long texts are taken
alone, and a group of many tokens is linked by distinct ids with counts, never by occurrence; an empty table gives no rows. Further
columns of the table play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm.common import chunks, lists, own, table
from tarnish.session import materialize

MARK = "▁"
#: A pair is frequent, and sent to every task, if it holds at least this part of all (document, pair) rows.
FREQUENT = 500_000
#: Segments longer than this are aligned anew each time, and no more than so many others are remembered by a task.
REMEMBERED_CHARS, REMEMBERED = 48, 400_000
#: Characters of segments that are aligned together.
RUN_CHARS = 1 << 17
#: Groups with more links than this are linked by distinct ids.
LARGE_GROUP = 64
_CUT = re.compile(r"(?<=\S)(?= )")


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligned(NamedTuple):
    """One segment: its token counts, its groups as text, and its links."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes  # 64-bit pairs, one for each link
    many: tuple[tuple[int, int], ...]  # (pair, number) of groups with many links


class Aligner:
    """Encodes segments with both tokenizers and groups their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_of = byte_characters()
        self.bytes_a: dict[int, bytes] = {}
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in bytes_of for c in piece)
            self.bytes_a[i] = bytes(bytes_of[c] for c in piece) if known else piece.encode()
        self.bytes_b: list[bytes] = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            plain = not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))
            if plain and MARK in piece.lstrip(MARK):
                raise ValueError("a piece of this model spans the border of two segments")
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.mark = self.b.piece_to_id(MARK)
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.length_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.text = [str(i) for i in range(max(len(self.length_a), len(self.length_b)))]
        self.known: dict[str, Aligned] = {}
        self.lost: set[str] = set()  # segments that aren't reproduced

    def ids(self, segments: list[str]) -> tuple[list[int], list[int]]:
        """Both id lists of segments that each begin with a blank; B adds that blank itself."""
        of_a = self.a.encode_batch_fast(segments, add_special_tokens=False)
        of_b = self.b.encode([s[1:] for s in segments], num_threads=1)
        return (list(chain.from_iterable([e.ids for e in of_a])),
                list(chain.from_iterable([ids if len(s) > 1 else (self.mark,) for s, ids in zip(segments, of_b)])))

    def aligned(self, segments: list[str]) -> list[Aligned] | None:
        """Aligns segments; None if one of the tokenizers doesn't reproduce them."""
        raw = "".join(segments).encode()
        ids_a, ids_b = self.ids(segments)
        if any(b"".join([of[i] for i in ids]) != raw for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            return None
        a, b = np.array(ids_a), np.array(ids_b)
        # from end to index plus one; offsets are small whole numbers, so the dictionaries are addressed directly
        at_a, at_b = np.zeros(len(raw) + 1, np.int64), np.zeros(len(raw) + 1, np.int64)
        at_a[np.cumsum(self.length_a[a])] = np.arange(1, len(a) + 1)
        at_b[np.cumsum(self.length_b[b])] = np.arange(1, len(b) + 1)
        common = np.flatnonzero((at_a > 0) & (at_b > 0))
        to_a, to_b = at_a[common], at_b[common]
        from_a, from_b = np.r_[0, to_a[:-1]], np.r_[0, to_b[:-1]]
        text_a, text_b = [self.text[i] for i in ids_a], [self.text[i] for i in ids_b]
        groups = [
            f"{text_a[i]}|{text_b[j]}" if p - i == 1 and q - j == 1 else f"{','.join(text_a[i:p])}|{','.join(text_b[j:q])}"
            for i, p, j, q in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist())]
        size_a, size_b = to_a - from_a, to_b - from_b
        large = np.flatnonzero(size_a * size_b > LARGE_GROUP)
        n = np.where(size_a * size_b > LARGE_GROUP, 0, size_a * size_b)
        before = np.r_[0, np.cumsum(n)]
        k = np.repeat(np.arange(len(n)), n)
        place = np.arange(before[-1]) - before[k]
        links = (a[from_a[k] + place // size_b[k]] << 32 | b[from_b[k] + place % size_b[k]]).tobytes()
        ends = np.cumsum([len(s.encode()) for s in segments])
        last = np.searchsorted(common, ends) + 1
        if (common[last - 1] != ends).any():
            raise ArithmeticError("a token spans the border of two segments")
        first = np.r_[0, last[:-1]]
        many: dict[int, list[tuple[int, int]]] = {}
        for g in large.tolist():
            of_b = Counter(ids_b[from_b[g]:to_b[g]]).items()
            many.setdefault(int(np.searchsorted(last, g, "right")), []).extend(
                (x << 32 | y, m * c) for x, m in Counter(ids_a[from_a[g]:to_a[g]]).items() for y, c in of_b)
        return [
            Aligned(n_a, n_b, j - i, ";".join(groups[i:j]), links[8 * x: 8 * y], tuple(many.get(s, ())) if many else ())
            for s, (n_a, n_b, i, j, x, y) in enumerate(zip(
                (to_a[last - 1] - from_a[first]).tolist(), (to_b[last - 1] - from_b[first]).tolist(), first.tolist(),
                last.tolist(), before[first].tolist(), before[last].tolist()))]

    def learn(self, segments: list[str]) -> None:
        """Aligns segments and remembers the results."""
        found = self.aligned(segments)
        if found is not None:
            self.known.update(zip(segments, found))
        elif len(segments) == 1:
            self.lost.add(segments[0])
        else:
            half = len(segments) // 2
            self.learn(segments[:half])
            self.learn(segments[half:])

    def runs(self, segments: list[str]) -> Iterator[list[str]]:
        """Segments in runs of some length."""
        run, size = [], 0
        for s in segments:
            run.append(s)
            size += len(s)
            if size > RUN_CHARS:
                yield run
                run, size = [], 0
        if run:
            yield run

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray] | None]:
        """n_a, n_b, n_groups, digest of the groups, pairs and their numbers of links, of each text; None without tokens."""
        cut = [_CUT.split(" " + t) if t else None for t in texts]
        known, lost = self.known, self.lost
        if len(known) + len(lost) >= REMEMBERED:
            known.clear()
            lost.clear()
        fresh = list(set(chain.from_iterable(filter(None, cut))).difference(known, lost))
        for run in self.runs(fresh):
            self.learn(run)
        for segments in cut:
            if not segments or (lost and not lost.isdisjoint(segments)):
                yield None
                continue
            n_a, n_b, n_groups, groups, links, many = zip(*map(known.__getitem__, segments))
            pairs = np.frombuffer(b"".join(links), np.int64)
            if more := list(chain.from_iterable(many)):
                extra = np.array(more, np.int64)
                numbers = np.concatenate([np.ones(len(pairs), np.int64), extra[:, 1]])
                pairs = np.concatenate([pairs, extra[:, 0]])
                order = np.argsort(pairs, kind="stable")
                pairs, numbers = pairs[order], numbers[order]
            else:
                pairs, numbers = np.sort(pairs), None
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            counts = np.diff(np.r_[first, len(pairs)]) if numbers is None else np.add.reduceat(numbers, first)
            yield (sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs[first], counts)
        for segment in fresh:
            if len(segment) > REMEMBERED_CHARS:
                known.pop(segment, None)
                lost.discard(segment)


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(path_a: str, path_b: str) -> Aligner:
    """Both tokenizers, read once by each Python worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


_NONE = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, groups_sha256, and the distinct pairs (A id << 32 | B id) of every row with their numbers of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(path_a, path_b)
        for batch in batches:
            for part in chunks(batch):
                rows = [r or _NONE for r in aligner.texts(part.column("text").to_pylist())]
                counts = np.array([len(r[4]) for r in rows])
                yield pa.RecordBatch.from_arrays([
                    part.column(key), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)],
                    pa.array([r[3] for r in rows], pa.string()),
                    *[lists(np.concatenate([r[k] for r in rows]), counts, pa.int64()) for k in (4, 5)]],
                    names=[key, "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "numbers"])

    kind = docs.schema[key].dataType.simpleString()
    return own(docs, key, "text").mapInArrow(
        run, f"`{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, "
             "numbers array<bigint>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, held (number of documents that hold it linked) and best (whether no pair of its A id is held by more)."""
    counts = materialize(
        aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held")), "alignment_counts")
    a = F.call_function("shiftright", F.col("pair"), F.lit(32))
    highest = counts.groupBy(a.alias("a")).agg(F.max("held").alias("highest"))  # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "held", (F.col("held") == F.col("highest")).alias("best"))


def with_counts(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The columns of ``aligned`` but the arrays, with n_links, n_best and count_sum of every row."""
    keep = [c for c in aligned.columns if c not in ("pairs", "numbers")]
    aligned = materialize(aligned.withColumn("_row", F.monotonically_increasing_id()), "alignment_rows")
    counts = materialize(pair_counts(aligned), "alignment_pairs")
    total = counts.agg(F.sum("held")).first()[0] or 0
    least = max(1, -(-total // frequent))
    # fewer than ``frequent`` rows, since each holds at least total / frequent of the total
    top = counts.where(F.col("held") >= least).toArrow().sort_by("pair")
    pairs, held, best = (top.column(c).to_numpy() for c in ("pair", "held", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("pairs").offsets.to_numpy()
            mine = batch.column("pairs").flatten().to_numpy()
            numbers = batch.column("numbers").flatten().to_numpy()
            offsets = offsets - offsets[0]
            at = np.searchsorted(pairs, mine)
            at[at == len(pairs)] = 0
            hit = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)

            def sums(values: np.ndarray) -> pa.Array:
                run = np.zeros(len(values) + 1, np.int64)
                np.cumsum(values, out=run[1:])
                return pa.array(run[offsets[1:]] - run[offsets[:-1]])

            left = np.diff(np.r_[0, np.cumsum(~hit)][offsets])
            known = [sums(np.where(hit, numbers * x[at], 0)) for x in (best, held)] if len(pairs) else [sums(numbers * 0)] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), sums(numbers), *known, lists(mine[~hit], left, pa.int64()),
                 lists(numbers[~hit], left, pa.int64())],
                names=["_row", "n_links", "n_best", "count_sum", "pairs", "numbers"])

    sums = materialize(aligned.select("_row", "pairs", "numbers").mapInArrow(
        run, "_row bigint, n_links bigint, n_best bigint, count_sum bigint, pairs array<bigint>, numbers array<bigint>"),
        "alignment_sums")
    rare = sums.select("_row", F.explode(F.arrays_zip("pairs", "numbers")).alias("_x")).select(
        "_row", F.col("_x.pairs").alias("pair"), F.col("_x.numbers").alias("number"))
    rest = rare.join(counts.where(F.col("held") < least), "pair").select(
        "_row", (F.col("number") * F.col("best").cast("bigint")).alias("n_best"), (F.col("number") * F.col("held")).alias("count_sum"))
    both = sums.select("_row", "n_links", "n_best", "count_sum").unionByName(
        rest.withColumn("n_links", F.lit(0).cast("bigint"))).groupBy("_row").agg(
        *[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    return aligned.select("_row", *keep).join(both, "_row").select(*keep, "n_links", "n_best", "count_sum")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_counts(alignments(docs, *paths()))
