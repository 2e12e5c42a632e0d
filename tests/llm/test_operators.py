"""The dealt operators against brute force, on fixtures with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tarnish.llm.queries")

from tarnish.llm import op1_packing, op2_mixing, op3_quality_classifier, op4_lattice_dedup, op5_sentencepiece  # noqa: E402
from tarnish.llm import op6_page_differencing, op7_bagminhash, op8_suffix_dedup, op9_substring_dedup  # noqa: E402
from tarnish.llm import op10_quality_rules, repeats  # noqa: E402
from tarnish.llm.common import importable  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(("", "Th", "ver", "é", "日")) + rng.choice(("on", "er", "ing")) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage, base = prose(rng, 60), prose(rng, 120)
    out = [None, "", " \n\t ", "one", "one", "a" * 900, "the The\n" * 300, base, base, base + " end", "x " + base, "word " * 5000]
    for k in range(12):
        words = base.split(" ")
        words[k * 9] = f"edit{k}"
        out.append(" ".join(words))
        out.append(prose(rng, 30) + "\n" + passage + " " + prose(rng, 20))
        out.append(prose(rng, 80))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    importable(spark)
    rows = [(i if i != 20 else None, t, ["en", "de", None][i % 3], ["a", "b"][i % 2], 5, i, "x") for i, t in enumerate(texts)]
    rows.append(rows[7])
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _bin int, tk string").repartition(3)


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def covered(sequences, length):
    counts = Counter(tuple(s[i:i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        flags = [False] * len(s)
        for i in range(len(s) - length + 1):
            if counts[tuple(s[i:i + length])] > 1:
                flags[i:i + length] = [True] * length
        out.append(flags)
    return out


@pytest.mark.parametrize("hot", [500, 1])
def test_repeated_bytes_and_words(docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = docs.select("doc_id", "text").collect()
    data = [(r["text"] or "").encode() for r in rows]
    flags = covered([list(d) for d in data], 200)
    want = {r["doc_id"]: (len(d), sum(f), hashlib.sha256(bytes(x for x, y in zip(d, f) if not y)).hexdigest())
            for r, d, f in zip(rows, data, flags)}
    got = op8_suffix_dedup.digests(docs)
    assert got.count() == len(rows)
    assert by_id(got, "n_bytes", "n_removed", "kept_sha256") == want
    words = [WORD.findall(r["text"] or "") for r in rows]
    flags = covered(words, 35)
    want = {r["doc_id"]: (len(w), sum(f), hashlib.sha256(" ".join(x for x, y in zip(w, f) if not y).encode()).hexdigest())
            for r, w, f in zip(rows, words, flags)}
    assert by_id(op9_substring_dedup.digests(docs), "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("op, symbols, length", [(op8_suffix_dedup, lambda t: list(t.encode()), 200), (op9_substring_dedup, WORD.findall, 35)])
def test_near_copies_of_one_passage_leave_few_rows(spark, op, symbols, length, monkeypatch):
    importable(spark)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000):04}" for _ in range(75)]
    texts = [" ".join(w if rng.random() < 0.97 else f"x{rng.randrange(10_000):04}" for w in base) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stored, write = {}, repeats.materialize

    def counted(df, name, path=None):
        out = write(df, name, path)
        stored.setdefault(name, []).append(out.where("hot").count() if name == "repeat_cuts" else out.count())
        return out

    monkeypatch.setattr(repeats, "HOT", 40)
    monkeypatch.setattr(repeats, "materialize", counted)
    flags = covered([symbols(t) for t in texts], length)
    assert by_id(op.digests(docs), "n_removed") == {i: (sum(f),) for i, f in enumerate(flags)}
    blocks = stored["repeat_cuts"][0]
    # beyond their nodes, what is still open of a hot block takes a few rows, not one for each of its windows
    assert blocks > 400 and sum(sum(n) for name, n in stored.items() if name in ("repeat_slices", "repeat_windows")) < 5 * blocks, (blocks, stored)


def test_removed_keeps_rows_and_columns(docs):
    out = op8_suffix_dedup.removed(docs)
    assert out.schema == docs.schema and out.count() == docs.count()


def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=op5_sentencepiece.model_path())
    table = op5_sentencepiece.PrefixTable(op5_sentencepiece.model_path())
    rng = random.Random(9)
    odd = ["".join(rng.choice("ab e▁ \n\r\t;)日é́😀𝕏<>0x1A_=-*#.\x00") for _ in range(rng.randrange(60))) for _ in range(800)]
    for text in [*odd, " " * 300, "a" * 500, "<s>x</s>", "<0x0A>", *[r["text"] or "" for r in docs.collect()]]:
        ids = library.encode(text, add_bos=False, add_eos=True)
        assert table.encode(text) == ids and table.decode(ids) == library.decode(ids)
    got = op5_sentencepiece.digests(docs, op5_sentencepiece.model_path())
    for r in got.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_packing_is_lossless(docs):
    packs = op1_packing.packed(docs, op5_sentencepiece.model_path(), length=64)
    table = op5_sentencepiece.PrefixTable(op5_sentencepiece.model_path())
    rows = packs.collect()
    assert all(len(r["ids"]) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64 for r in rows)
    found = {}
    for r in op1_packing.unpacked(packs).orderBy("piece").collect():
        found.setdefault(r["doc_id"], []).extend(r["ids"])
    texts = Counter(r["doc_id"] for r in docs.collect())
    for r in docs.collect():
        if texts[r["doc_id"]] == 1:
            assert found[r["doc_id"]] == table.encode(r["text"] or "")


def test_best_fit_against_search():
    rng = random.Random(4)
    sizes = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    rooms, want = [], []
    for s in sizes:
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(64 - s)
    found = op1_packing.best_fit_decreasing(sizes, 64)
    assert sorted(64 - sum(sizes[p] for p in row) for row in found) == sorted(rooms)


def test_mixing_keeps_all_rows_within_a_block(spark, docs):
    weights = {"a": 5.0, "b": 2.0, "c": 1.0}
    whole = op2_mixing.whole_weights(weights, 80)
    slots = op2_mixing.period_slots(whole)
    for s, w in whole.items():
        for t in range(1, 81):
            assert abs(sum(x < t for x in slots[s]) - t * w / sum(whole.values())) < 1
    phases = op2_mixing.phases({"a": 7, "b": 30, "c": 1, "d": 3}, weights)
    taken = sorted(start + (b - first) // len(sl) * p + sl[(b - first) % len(sl)] for _, first, end, start, p, sl in phases for b in range(first, end))
    assert taken == list(range(41))
    out = op2_mixing.interleaved(docs, {"a": 1.0}).collect()
    assert len(out) == docs.count() and len({r["mix_position"] for r in out}) == len(out)
    assert max(r["mix_position"] for r in out if r["source"] == "a") < min(r["mix_position"] for r in out if r["source"] == "b")
    assert op2_mixing.interleaved(docs.limit(0)).count() == 0


def test_mixing_keeps_to_the_given_weights(spark):
    for blocks, weights in (({"hot": 30_000, **{f"s{k:02}": 3_000 for k in range(19)}}, {"hot": 0.13961, **{f"s{k:02}": 0.86039 / 19 for k in range(19)}}),
                            ({"a": 40_000, "b": 4}, {"a": 0.9999, "b": 0.0001})):
        first = [p for p in op2_mixing.phases(blocks, weights) if p[3] == 0]
        end = min(slots[-1] for s, _, n, _, p, slots in first if n == blocks[s]) if all(p[4] > p[2] for p in first) else 4_000
        for s, _, n, _, period, slots in first:
            for had, slot in enumerate(slots[:n]):
                assert slot > end or abs(had - slot * weights[s] / sum(weights.values())) <= 1 + 1e-6
    rows = spark.range(6_000).selectExpr("id doc_id", "if(id < 2000, 'hot', concat('s', id % 19)) source")
    out = op2_mixing.interleaved(rows, {"hot": 0.13961, **{f"s{k}": 0.86039 / 19 for k in range(19)}}).collect()
    assert len({r["mix_position"] for r in out}) == 6_000
    for upto in range(16, 3_000, 16):
        assert abs(sum(r["source"] == "hot" and r["mix_position"] < upto for r in out) - 0.13961 * upto) <= 16 + 1e-6


def test_near_duplicates_against_all_pairs(docs, texts):
    bags = []
    for t in texts:
        w = WORD.findall(t or "")
        bags.append(Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 20 in (i, j) or not bags[i] or not bags[j]:
                continue
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = by_id(op7_bagminhash.groups(docs), "group_id", "kept")
    assert got.pop(None) == (None, True)
    assert got == {i: (group[i], group[i] == i) for i in range(len(texts)) if i != 20}
    kept = op7_bagminhash.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({g for i, g in enumerate(group) if i != 20})


def test_bagminhash_estimates_weighted_jaccard():
    import pyarrow as pa

    a, b = "u v w x y " * 4 + "p q r s t m", "u v w x y " * 2 + "p q r s t n"
    shingles, counts, offsets = op7_bagminhash.bags(pa.array([a, b, ""]))
    s = op7_bagminhash.signatures(shingles, counts, offsets, 4096)
    exact = op7_bagminhash.similarity((shingles[:offsets[1]], counts[:offsets[1]]), (shingles[offsets[1]:offsets[2]], counts[offsets[1]:offsets[2]]))
    assert abs((s[0] == s[1]).mean() - exact) < 0.04 and np.isinf(s[2]).all()


def test_vectors_against_all_pairs(spark):
    importable(spark)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 16))
    x[50:90] = x[:40] + 0.25 * rng.standard_normal((40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [
        (200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] + [1.0] * 15), (204, []), (205, [1.0, 2.0]), (None, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, cell int, unit int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r for r in op4_lattice_dedup.linked(df).collect()}
    assert [got[i]["n_links"] for i in range(150)] == links.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 206))
    assert op4_lattice_dedup.linked(df).count() == len(rows)


def test_copies_of_vectors_against_all_pairs(spark):
    """Classes of copies of three sizes, chains of near vectors, a repeated id with two vectors: links and components of every row."""
    importable(spark)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((120, 8))
    for i in range(1, 30):
        x[i] = x[i - 1] + 0.2 * rng.standard_normal(8)  # a chain: neighbours link, ends need not
    x[40:100] = x[5]  # copies within the chain
    x[100:110] = x[30]
    x[110] = 4.0 * x[30]  # the same direction
    ids = rng.permutation(120) + 10
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>, first string").repartition(7)
    other = spark.createDataFrame([(int(ids[0]), [1e6] * 8, "x")], df.schema)  # of the two directions the lesser counts
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    if tuple(np.ones(8) / np.sqrt(8)) < tuple(unit[0]):
        unit[0] = np.ones(8) / np.sqrt(8)
    near = (unit @ unit.T >= 0.95) & ~np.eye(120, dtype=bool)
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 10**9).min(1))
        if (new == label).all():
            break
        label = new
    want = {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(1), label)}
    out = op4_lattice_dedup.linked(df.unionByName(other)).collect()
    assert len(out) == 121 and max(n for n, _, _ in want.values()) >= 60
    assert all(want[r["vec_id"]] == (r["n_links"], r["component_id"], r["kept"]) for r in out)
    assert op4_lattice_dedup.linked(df.limit(0)).collect() == []


def test_markup_is_walked_in_linear_time():
    import time

    def seconds(n):
        t0 = time.process_time()
        lines, _ = op6_page_differencing.lines_of("<div>" * n + "text" + "</span>" * n + "<article>" * n + "<p>in" + "</b>" * n)
        assert lines[-1] == "in"
        return time.process_time() - t0

    seconds(1000)
    assert seconds(40_000) < 2  # 1 MB
    assert op6_page_differencing.kind_of_name.__wrapped__("ads-" * 100_000) == 0
    assert op6_page_differencing.kind_of_name("promo_" * 60 + "!") == 0


@pytest.mark.parametrize("name, out, within", [
    ("reader-comments", True, True), ("post-ad", True, True), ("feedback", True, True), ("topnav", True, False), ("site-header", True, False),
    ("has-ads", False, False), ("comment-free-zone", False, False), ("nav-", False, False), ("story", False, False)])
def test_names_of_blocks(name, out, within):
    """A block of that name is left out beside an article, and within one."""
    text = "a long text of the page " * 9
    lines, _ = op6_page_differencing.lines_of(f'<p>{text}</p><div class="{name}">X</div><article><p>in</p><div class="{name}">Y</div></article>')
    assert ("X" not in lines, "Y" not in lines) == (out, within)


def test_page_text(spark):
    importable(spark)
    frame = "<html><head><title>t</title></head><body><nav><a>menu</a></nav>{}<div>Shared frame line</div><footer>f</footer></body>"
    rows = [(1, "http://h.x/a/1", frame.format("<div>Own &amp; text\n one</div>"), "z"), (2, "http://h.x/a/2", frame.format("<p>Other<p>two<script>x</script>"), "z"),
            (3, None, None, "z"), (4, "http://g.x/", "<article><h1>T</h1><p><b>One<br>two<div class=\"comments\">no</div></article><div class='ad'>x</div>", "z"),
            (5, "http://g.x/", "", "z"), (None, "u", "plain &lt;text&gt;", "z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").coalesce(1)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op6_page_differencing.extracted(df.repartition(1)).collect()}
    assert got[4] == ("T\nOne\ntwo", 9) and got[3] == ("", 0) and got[5] == ("", 0) and got[None] == ("plain <text>", 12)
    assert op6_page_differencing.shared(list("abcxd"), list("abycd")) == ({0, 1, 2, 4}, {0, 1, 3, 4})
    assert {got[1][0].split("\n")[0], got[2][0].split("\n")[0]} == {"Own & text one", "Other"}


def test_page_names_of_wrappers():
    article = "<article><h1>T</h1>{}<p>One</p></article>"
    frame = "<div class='menu'>m</div><div id='main-nav'>n</div>{}<div class='site-footer'>f</div><div class='cookie-banner'>k</div>"
    lines = lambda page: op6_page_differencing.lines_of(frame.format(page))[0]
    for start in ('div class="layout with-sidebar"', 'div id="page-header-fixed"', 'section class="content no-comments"', "div class=header",
                  "form id=aspnet", "div class='sidebar'><div class='header'"):
        ends = "</div></div>" if "><" in start else f"</{start.split()[0]}>"
        assert lines(f"<{start}>{article.format('')}{ends}") == ["T", "One"], start
    for name in ("section-header", "related-work", "search-results", "header", "menu", "share"):
        assert lines(article.format(f"<div class='{name}'><h2>Part</h2><p>Text</p></div>")) == ["T", "Part", "Text", "One"], name
    for name in ("ad", "ads top", "ad-slot", "comments", "comment-list", "sponsored"):
        assert lines(article.format(f"<div class='{name}'>x</div>")) == ["T", "One"], name
    comments = "<div class='comments'><article>first</article><article>second</article></div>"
    assert lines(article.format("") + comments) == ["T", "One"]
    assert lines("<div class='related'><p>A text without an article, that is most of the page.</p></div><p>End</p>") == [
        "A text without an article, that is most of the page.", "End"]
    assert lines("<div hidden><article>no</article></div><p>Yes</p>") == ["Yes"]


def test_page_copies_keep_their_text_wherever_they_are_cut(spark):
    importable(spark)
    page = lambda *own: "<div>Menu of the host</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights</div>"
    rng = random.Random(4)
    text = {c: [prose(rng, 12) for _ in range(8)] for c in "abc"}
    near = [*text["b"][:7], "changed"]
    rows = [(1, "http://h.x/a", page(*text["a"])), (2, "https://h.x/a", page(*text["a"])), (2, "https://h.x/a", page(*text["a"])),
            (3, "http://h.x/b?p=1", page(*text["b"])), (4, "http://h.x/b?p=2", page(*near)), (5, "http://h.x/c", page(*text["c"])),
            (6, "http://two.x/1", page(*text["a"])), (7, "http://two.x/2", page(*text["c"])),
            (8, "http://mirror.x/p", page(*text["a"])), (9, "https://mirror.x/p", page(*text["a"])), (10, "http://h.x/bb", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    plain = {**dict.fromkeys((1, 2, 6), text["a"]), 3: text["b"], 4: near, 5: text["c"], 7: text["c"], 10: [],
             **dict.fromkeys((8, 9), ["Menu of the host", *text["a"], "All rights"])}
    for cuts in (1, 3, 11):
        got = op6_page_differencing.extracted(df.repartition(cuts)).collect()
        assert sorted((r["page_id"], r["text"]) for r in got) == sorted((i, "\n".join(plain[i])) for i, _, _ in rows)


def test_quality_rules_against_plain_python(docs):
    out = op10_quality_rules.judged(docs)
    assert out.count() == docs.count()
    got = by_id(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in docs.collect():
        w, t = WORD.findall(r["text"] or ""), r["text"] or ""
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        seen = Counter(grams)
        inside = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert got[r["doc_id"]] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside),
                                    len(w) < 50 or 100 * len(inside) > 50 * len(w))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert op10_quality_rules.judged(docs.limit(0)).count() == 0


def test_quality_outliers_are_found(spark):
    importable(spark)
    rng = random.Random(6)
    rows = [(i, prose(rng, 100), "en", "s") for i in range(80)] + [(100 + i, " | ".join(prose(rng, 60).split(" ")), "en", "s") for i in range(15)]
    got = by_id(op10_quality_rules.judged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")), "kept")
    assert all(got[i][0] for i in range(80)) and not any(got[100 + i][0] for i in range(15))


def plain_distances(x, rng):
    """Regularised minimum covariance determinant in plain numpy: exact nearest halves, random starts, steps until nothing changes."""
    n, p = x.shape
    h = min(n, (n + p + 1) // 2)
    y = 1.0
    while 1 - np.exp(-y) * (1 + y) < h / n - 1e-12 and y < 30:
        y += 1e-4
    factor = 1.0 if h == n else h / n / (1 - np.exp(-y) * (1 + y + y * y / 2))
    floor = np.diag(np.square(op10_quality_rules.FLOOR))
    found = None
    for _ in range(40):
        near = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(100):
            mean, cov = x[near].mean(0), factor * np.cov(x[near].T, bias=True) + floor
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            last, near = near, np.sort(np.argsort(d2, kind="stable")[:h])
            if np.array_equal(last, near):
                break
        if found is None or np.linalg.det(cov) < found[0]:
            found = np.linalg.det(cov), np.sqrt(d2)
    return found[1]


@pytest.mark.parametrize("kind", ["symbols", "copies"])
def test_quality_outliers_of_hot_and_tiny_groups(spark, kind):
    importable(spark)
    rng = random.Random(16)
    bad = lambda: " | ".join(prose(rng, 60).split(" "))
    page = bad()
    rows = []
    for lang, share in (("a", 0.3), ("b", 0.4), ("c", 0.45)):
        junk = round(300 * share)
        rows += [(prose(rng, 100), lang, "hot", True) for _ in range(300 - junk)]
        rows += [(page if kind == "copies" else bad(), lang, "hot", False) for _ in range(junk)]
        rows += [(bad(), lang, "alone", False), (bad(), lang, None, False), (prose(rng, 80), lang, "one", True)]
        rows += [(bad(), lang, "three", False)] * 2 + [(prose(rng, 70), lang, "three", True)]
    docs = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string")
    got = by_id(op10_quality_rules.judged(docs.repartition(5)), "kept", "distance")
    assert [got[i][0] for i in range(len(rows))] == [r[3] for r in rows]
    x = {r["doc_id"]: [r[c] / op10_quality_rules.UNIT for c in op10_quality_rules.NAMES]
         for r in op10_quality_rules.vectors(op10_quality_rules.text_statistics(docs, "doc_id")).collect()}
    for lang in "abc":
        hot = [i for i, r in enumerate(rows) if r[1] == lang and r[2] == "hot"]
        plain = plain_distances(np.array([x[i] for i in hot]), np.random.default_rng(1))
        assert [bool(d <= op10_quality_rules.CUTOFF) for d in plain] == [got[i][0] for i in hot]
        assert np.allclose([got[i][1] for i in hot], plain, rtol=0.15, atol=0.3)
    assert abs(spark.range(1).select(op10_quality_rules.consistency(F.lit(0.5))).first()[0] - 2.1096) < 1e-3


def test_classifier_held_out(spark):
    importable(spark)
    rng = random.Random(8)
    rows = [(i, prose(rng, 40) if i % 4 else " ### ".join(prose(rng, 40).split(" "))) for i in range(400)] + [(None, "x"), (900, None), (901, "")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id bigint, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 1) for i in range(400)] + [(1, None, 1), (None, 1, 1)], "doc_id bigint, quality int, text int")
    got = op3_quality_classifier.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.95
    assert op3_quality_classifier.scored(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (op7_bagminhash.groups, op8_suffix_dedup.digests, op9_substring_dedup.digests):
        assert f(none).count() == 0
    assert op1_packing.packed(none, op5_sentencepiece.model_path()).count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(corpus_pipeline.STAGES) == 5 and 0 < out.count() <= 200 and "mix_position" in out.columns


def test_near_copies_of_one_text_are_not_paired(spark, monkeypatch):
    """Copies with edits of their own, most at 0.6 of each other and some linked: rows grow with the copies, links stay those of all pairs."""
    importable(spark)
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    out = []
    for i in range(200):
        words = [w for w in base if rng.random() > 0.03] + [f"own{i}"]
        out.append(" ".join(words))
        if i % 10 == 0:
            out.append(" ".join([*words[:-3], "last", str(i)]))
    made = []
    real = op7_bagminhash.materialize

    def counted(df, name, path=None):
        found = real(df, name, path)
        made.append((name, found.count()))
        return found

    monkeypatch.setattr(op7_bagminhash, "materialize", counted)
    rows = spark.createDataFrame(list(enumerate(out)), "doc_id bigint, text string").repartition(4)
    got = by_id(op7_bagminhash.groups(rows), "group_id")
    bags = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in map(str.split, out)]
    group = list(range(len(out)))
    for i in range(len(out)):
        for j in range(i):
            if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert {i: (g,) for i, g in enumerate(group)} == got and 100 < len(set(group)) < 200
    buckets = max(n for name, n in made if name == "near_buckets")
    assert max(n for name, n in made if name != "near_buckets") <= buckets, made


def test_overlaps_of_bags_are_sums_of_lesser_counts():
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    shingles, counts, offsets = op7_bagminhash.bags(pa.array(texts))
    bags = [(shingles[a:b], counts[a:b]) for a, b in zip(offsets, offsets[1:])]
    held = [op7_bagminhash._elements(b) for b in bags]
    for one, other in ((held, held), (held[:5], held[5:])):
        shared = op7_bagminhash.overlaps(one, other)
        for i, x in enumerate(one):
            for j, y in enumerate(other):
                b = bags[j] if other is held else bags[5 + j]
                like = op7_bagminhash.similarity(bags[i], b)
                assert abs(shared[i, j] / (len(x) + len(y) - shared[i, j]) - like) < 1e-12


def test_suffixes_that_are_settled_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(6)
    text = rng.integers(0, 256, 20_000)
    text[15_000:15_400] = text[2_000:2_400]
    text[12_000], text[-1] = 256, 257
    sorted_, real = [], np.argsort
    monkeypatch.setattr(op8_suffix_dedup.np, "argsort", lambda x, *a, **k: sorted_.append(len(x)) or real(x, *a, **k))
    found = op8_suffix_dedup.matching_statistics(text)
    assert sum(sorted_) < 2 * len(text), sorted_

    def elsewhere(at, n):
        same = np.ones(len(text) - n + 1, bool)
        for j in range(n):
            same &= text[j: len(text) - n + 1 + j] == text[at + j]
        return same.sum() > 1

    for at in [*rng.integers(0, len(text), 60).tolist(), 2_000, 2_100, 2_399, 15_000, 15_399]:
        n = int(found[at])
        assert elsewhere(at, n) and (at + n >= len(text) or not elsewhere(at, n + 1)), at
