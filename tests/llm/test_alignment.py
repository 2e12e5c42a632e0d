"""Alignment of two tokenizers against whole-text encoding and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tarnish.llm.queries")

from tarnish.llm import op13_alignment as op  # noqa: E402
from tarnish.llm.common import importable  # noqa: E402

NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def texts():
    rng = random.Random(8)
    pool = ["the", "naïve", "日本語", "can't", "'s", "12345", "3.14", "<s>", "</s>", "<|endoftext|>", "<0x41>", "🙂👍🏽", "é", "\x1c", "\xa0", "x" * 70,
            "=====", "Straße", "​", "ﬁ", "foo\tbar", "a\nb", "\n", "  ", "\t", "...", "’s"]
    out = [None, "", " ", "  ", "a", " a", "a ", "a  b ", "\n", "\n\n a", "a \n b", "▁", "one ▁ two", "tail\n", "the", "the", "x" * 3000,
           "日本語テキスト" * 300, "ab" * 20 + "́" * 90]
    out += ["".join(rng.choice(pool) + rng.choice(["", " ", " ", "  ", "\n", " \n"]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return out


def expected(texts):
    """Every column by encoding each whole text once and looping over all links."""
    path_a, path_b = op.paths()
    al = op.Aligner(path_a, path_b)
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b = al.a.encode(" " + t, add_special_tokens=False).ids, al.b.encode(t)
        pa_, pb = [al.bytes_a[i] for i in a], [al.bytes_b[i] for i in b]
        if not b"".join(pa_) == b"".join(pb) == (" " + t).encode():
            docs.append(None)
            continue
        ends = lambda parts: [sum(map(len, parts[:k + 1])) for k in range(len(parts))]
        ea, eb = ends(pa_), ends(pb)
        groups, i, j = [], 0, 0
        for end in [e for e in ea if e in set(eb)]:
            p, q = ea.index(end) + 1, eb.index(end) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        docs.append((a, b, groups, [(x, y) for g, h in groups for x in g for y in h]))
    held = Counter(pair for d in docs if d for pair in set(d[3]))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def case():
    found = texts()
    return found, expected(found)


@pytest.mark.parametrize("frequent", [1, 40, 10 ** 6])
def test_alignment_against_loops(spark, case, frequent):
    importable(spark)
    found, want = case
    rows = [(i if i != 20 else None, t, "x", i) for i, t in enumerate(found)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs string, _row int").repartition(3)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in op.with_counts(op.alignments(docs, *op.paths()), frequent).collect()}
    for i, w in enumerate(want):
        assert got[i if i != 20 else None] == w, found[i]


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    al = op.Aligner(*op.paths())

    def align(text, a, b, bytes_a, bytes_b):
        al.bytes_a, al.bytes_b = dict(enumerate(bytes_a)), bytes_b
        al.length_a, al.length_b = (np.array([len(x) for x in z]) for z in (bytes_a, bytes_b))
        monkeypatch.setattr(al, "ids", lambda _: (a, b))
        return al.aligned([text])

    assert align("ab" * 30 + "c", [0] * 30 + [1], [0] * 20 + [1], [b"ab", b"c"], [b"abc", b"c"]) is None  # bytes differ
    got, = align("a" * 60 + "b", [0] * 30 + [1], [0] * 20 + [1], [b"aa", b"b"], [b"aaa", b"b"])
    assert got.n_groups == 11 and len(got.links) == 8 * 61 and not got.many
    got, = align("a" * 899 + "b", [0] * 29 + [1], [0] * 31 + [1], [b"a" * 31, b"b"], [b"a" * 29, b"b"])
    assert got.n_groups == 2 and got.links == (1 << 32 | 1).to_bytes(8, "little") and got.many == ((0, 899),)


def test_empty_table_and_repeated_rows(spark):
    importable(spark)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert op.with_counts(op.alignments(empty, *op.paths())).collect() == []
    twice = spark.createDataFrame([(1, "hello there"), (1, "hello there"), (2, None)], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in op.with_counts(op.alignments(twice, *op.paths())).select("doc_id", "n_links", "count_sum").collect())
    assert got[0] == got[1] and got[0][2] == 2 * got[0][1] and got[2] == (2, 0, 0)
