"""I-Match fingerprints against a plain Python model that hashes the same bytes."""

import hashlib
import random
import struct
from collections import Counter

import pytest
import regex
import xxhash

pytest.importorskip("tarnish.llm.queries")

from tarnish.llm import op12_imatch as op  # noqa: E402
from tarnish.llm.common import importable  # noqa: E402


def hashed(*values):
    """Hash of typed values one after the other: bool and ("i", x) as 4 bytes, int as 8, text as UTF-8; None changes nothing."""
    seed = 42
    for v in values:
        if v is None:
            continue
        if isinstance(v, str):
            data = v.encode()
        elif isinstance(v, tuple) or isinstance(v, bool):
            data = struct.pack("<i", v[1] if isinstance(v, tuple) else v)
        else:
            data = struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed & (2 ** 64 - 1))
    return seed - 2 ** 64 if seed >= 2 ** 63 else seed


def terms(text):
    return {w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def signature(words, lexicon):
    used = sorted(hashed(w) & ~7 for w in ((words & lexicon) or words))
    parts = []
    for k in range(op.FAMILIES):
        drawn = sorted((hashed(("i", k), t) % 2 ** 64) >> 1 for t in used)
        for level in range(op.LEVELS, 0, -1):
            inside = [h for h in drawn if h < 1 << (63 - level)]
            smaller = [1 << (63 - x) for x in range(op.LEVELS, level, -1)]
            parts.append(hashed(*sorted(inside + smaller)) % 32767 + 1 if inside else 0)
    return hashed(*used), len(used), parts


def likeness(x, y):
    d = sum(a != b for a, b in zip(x[2], y[2]))
    u = sum(bool(a or b) for a, b in zip(x[2], y[2]))
    differ = x[:2] != y[:2]
    return 1.0 if not differ and not d else 1 - (2 ** (d / op.FAMILIES + differ) - 1) / (2 ** (u / op.FAMILIES + (x[1] + y[1] > 0)) - 1)


def expected(rows):
    texts = [(i, t or "") for i, t in rows]
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[0] is None, r[0], r[1]), hashed(("i", 12), r[1], r[0], r[0] is None)))
    copies = Counter(t for _, t in texts)
    hot = {t for t, n in copies.items() if n > 1 and n * op.COPIED > len(texts)}
    counted = [t for _, t in texts if t not in hot] + list(hot)
    df = Counter(w for t in counted for w in terms(t))
    lexicon = {w for w, n in df.items() if max(2, op.RARE * len(counted)) <= n <= max(2, op.COMMON * len(counted))}
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[:len(t) - half] + after[:half]
        a, b, c = (signature(terms(x), lexicon) for x in (t, changed, after))
        digits = lambda s: f"{s[0] % 2 ** 64:016X}" + "".join(f"{v:04X}" for v in s[2])
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), digits(a), digits(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return out


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows],
                                 "doc_id bigint, text string, h1 string, n int, term int, copies int").repartition(3)
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in op.fingerprints(docs).collect()]


def order_of(rows):
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


def test_fingerprints_against_a_plain_model(spark):
    importable(spark)
    rng = random.Random(6)
    vocabulary = [rng.choice(["ab", "Ço", "日", "x1", "ß"]) + rng.choice(["er", "ON", "ña"]) + str(rng.randrange(60)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\n"]) for _ in range(n))
    base = prose(150)
    rows = [(i, prose(rng.randrange(1, 200))) for i in range(40)]
    rows += [(100, base), (101, base), (102, base + " end"), (103, None), (104, ""), (105, "... !"), (106, "👍🏽 naïve 👍🏽 test"), (107, "w " * 9000),
             (7, "same id"), (7, "same id"), (7, "same id"), (None, base), (None, base), (None, "no id"), (-5, "below zero")]
    rows += [(200 + i, "copied words of one page") for i in range(25)]  # a third of all rows
    found = got(spark, rows)
    assert len(found) == len(rows) and order_of(found) == order_of(expected(rows))
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).update(r[3] for r in found if r[0] == i and i not in (7, None))
    assert all(len(v) <= 1 for v in by_text.values())


def test_small_tables(spark):
    importable(spark)
    for rows in ([], [(1, "alone here")], [(1, None), (2, None)]):
        assert order_of(got(spark, rows)) == order_of(expected(rows) if rows else [])


def test_half_edits_are_nearer_than_other_texts(spark):
    importable(spark)
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([60, 200, 900])))) for i in range(200)]
    found = got(spark, rows)
    assert sum(r[5] > r[6] for r in found) > 190


def test_a_lexicon_too_large_to_broadcast(spark, monkeypatch):
    importable(spark)
    rows = [(i, f"one two{i % 3} three{i % 5} four{i}") for i in range(30)]
    want = order_of(got(spark, rows))
    monkeypatch.setattr(op, "BROADCAST", 0)
    assert order_of(got(spark, rows)) == want == order_of(expected(rows))


def test_no_python_workers(spark):
    importable(spark)
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id bigint, text string")
    plan = op.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
