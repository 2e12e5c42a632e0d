"""Main text of web pages: structure of blocks and differencing with the pages of nearest URL.

A page becomes lines, one for each block, with a note whether the block stands in an article or main element. Blocks in menus, headers,
footers, sidebars, forms, scripts, styles, templates, and in elements whose class, id or role names adverts, notices,
comments or the like are left out. Pages are sorted by host and URL path; each is aligned with the nearest pages of other content of the same
host, before and after it, by the longest common subsequence of lines, and lines that both share are boilerplate and are deleted, unless they
stand in an article or main element: an article's sentence may well be quoted by the next page, and a site's frame doesn't stand there.
Copies and near copies tell nothing about a frame: successive pages that share ``COPY`` or more of the characters of the larger one are a run,
and neighbours are the last page of the run before and the first of the run after. Each deleted line stands in two pages of different content.

Differencing alone doesn't give the main text where the frame of a page differs from page to page (a menu and an
advert of its own on each), hence the structural part. Where the pages of a host hold hardly more than one and the same frame, they
are copies of each other by that measure, and the frame stays.

Scale: pages are parsed where they are read and stored as lines. What is sorted by host is one 8-byte mark per line (hash and length);
neighbours come from windows over these, so results don't depend on partitions. Only pages that lose lines are joined back.

Defined results: a null or empty html gives an empty text; a null URL has no host and is not aligned; pages without lines are no neighbours;
repeated rows are each extracted; very long pages are aligned by marks of lines in memory linear in the lines.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnish.llm.common import own, table
from tarnish.session import materialize

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe|select|object)\b.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_BLANK = re.compile(r"\s+")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Names of advert and comment blocks, of the other parts of a frame, and words that may stand beside these in a name of several parts.
_CLEAR = r"ads?|advert[a-z0-9]*|sponsor[a-z0-9]*|promo[a-z0-9]*|comments?|disqus|replies|respond|feedback|discussion"
_FRAME = (r"banner|(?:top|main|sub|side)?nav[a-z0-9]*|menu|breadcrumbs?|sidebar|aside|footer|header|masthead|cookies?|consent|notices?|popup|modal|newsletter|subscribe"
          r"|share|social|related|widget|search|login|signup|toolbar|pagination|pager|navigation|contentinfo|complementary|dialog|alert"
          r"|gdpr|paywall")
_BESIDE = (r"site|page|global|main|primary|secondary|top|bottom|left|right|fixed|sticky|inner|outer|wrapper|wrap|container|box|block|bar|area"
           r"|list|links?|items?|buttons?|icons?|media|slot|unit|form|\d+")
_CLEAR_PART, _KNOWN_PART = re.compile(_CLEAR), re.compile(f"{_CLEAR}|{_FRAME}|{_BESIDE}")
_BESIDE_PART = re.compile(_BESIDE)
#: First parts of a name that says what a block has, not what it is.
_STATES = frozenset("has no with without is hide".split())
#: Part of the characters of the larger of two pages that makes them copies, and the bits of a mark that hold the length of its line.
COPY, LENGTH_BITS = 0.8, 20
#: Elements that are left out with all they hold; those that begin and end a block; those that have no end.
LEFT_OUT = frozenset("head title nav header footer aside form button menu dialog option label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: An element that a new one of the same kind closes.
CLOSES_ITSELF = frozenset("p li td th tr dt dd option".split())


#: Why an element is left out: it is hidden or never text of the page, its kind, a name of the frame, a name of adverts or comments.
HIDDEN, KIND, NAME, CLEAR = 1, 2, 3, 4


@lru_cache(1 << 12)
def kind_of_name(word: str) -> int:
    """CLEAR or NAME for the name of a block of adverts or comments, or of the frame; else 0.

    Whatever parts stand before it, a name that ends in known parts, one of them for adverts or comments, is theirs (reader-comments), but for one
    that states their presence (has-ads). A name of the frame has known parts only.
    """
    parts = re.split("[_-]+", word.lower())
    known = 0
    while known < len(parts) and _KNOWN_PART.fullmatch(parts[-1 - known]):
        known += 1
    ending = parts[len(parts) - known:]
    if parts[0] not in _STATES and any(_CLEAR_PART.fullmatch(x) for x in ending):
        return CLEAR
    return NAME if known == len(parts) and not all(_BESIDE_PART.fullmatch(x) for x in parts) else 0


def reason(name: str, attributes: str, inner: bool) -> int:
    """Why an element is left out, 0 if it isn't; inner: it stands in an article or main element."""
    if name in MAIN or name in ("html", "body"):
        return 0
    if name in ("head", "title"):
        return HIDDEN
    # a header or a form of the frame; the header of an article may hold its title
    found = KIND if name in LEFT_OUT and not (name == "header" and inner) else 0
    for a in _ATTRIBUTE.finditer(attributes):
        value = (a.group(2) or "").strip("\"'")
        kind = a.group(1).lower()
        if kind == "hidden" and a.group(2) is None or kind == "aria-hidden" and value.lower() == "true":
            return HIDDEN
        if kind in ("class", "id", "role") and found in (0, NAME):
            for word in value.split():
                named = kind_of_name(word) if len(word) < 256 else kind_of_name.__wrapped__(word)  # long ones aren't held
                if named == CLEAR:
                    found = CLEAR
                elif named and not inner and not found:
                    found = NAME
    return found


def lines_of(page: str) -> tuple[list[str], list[bool]]:
    """The lines of a page outside what is left out, and whether each stands in an article or main element.

    Left-out elements that turn out to hold the main text are kept by a second walk: those named as a frame that hold an article or
    main element; any others, unless hidden, that hold all of these; and on a page without these, named ones with
    most of its text. Inside an article or main element only names of adverts and comments count.
    """
    tokens = list(_TOKEN.finditer(page))
    lines, main, keep = _walk(page, tokens, frozenset())
    while keep:  # a kept element may hold others
        lines, main, more = _walk(page, tokens, keep)
        if more <= keep:
            break
        keep |= more
    return lines, main


def _walk(page: str, tokens: list[re.Match], keep: frozenset[int]) -> tuple[list[str], list[bool], frozenset[int]]:
    """Lines, whether each stands in an article or main element, and the left-out elements to be kept, by the place of their tags."""
    lines: list[str] = []
    main: list[bool] = []
    held: list[str] = []
    # open elements, why each is left out, where it begins, and the article or main elements and characters before it
    stack: list[tuple[str, int, int, int, int]] = []
    ended: list[tuple[int, int, int, int]] = []  # left-out elements: why, where, and the article or main elements and characters in them
    out = 0  # open elements that are left out
    inner = 0  # open article or main elements
    fixed = 0  # open elements that are left out for what they are, whose text doesn't count
    hidden = 0  # open elements that are hidden
    opened: Counter[str] = Counter()  # open elements by name, so that a stray end tag costs no search
    mains = chars = 0  # article and main elements and characters so far

    def end_block() -> None:
        if held:
            line = _BLANK.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if line:
                lines.append(line)
                main.append(inner > 0)

    def close(upto: int) -> None:
        nonlocal out, inner, fixed, hidden
        while len(stack) > upto:
            name, why, where, *before = stack.pop()
            opened[name] -= 1
            hidden -= why == HIDDEN
            out -= why > 0
            fixed -= why in (HIDDEN, KIND)
            inner -= name in MAIN
            if why:
                ended.append((why, where, mains - before[0], chars - before[1]))

    at = 0
    for found in tokens:
        if found.start() > at and not fixed:
            text = page[at: found.start()]
            chars += len(text.strip())
            if not out:
                held.append(text)
        at = found.end()
        name = found.group(3)
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS and not out:
            end_block()
        if found.group(2):
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:  # all of these end here
                    k -= 1
                close(k)
            continue
        if name in VOID:
            continue
        if name in CLOSES_ITSELF and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        why = 0 if found.start() in keep else reason(name, found.group(4) or "", inner > 0)
        stack.append((name, why, found.start(), mains, chars))
        opened[name] += 1
        hidden += why == HIDDEN
        out += why > 0
        fixed += why in (HIDDEN, KIND)
        inner += name in MAIN
        mains += name in MAIN and not hidden
    if not out and at < len(page):
        held.append(page[at:])
        chars += len(page[at:].strip())
    end_block()
    close(0)
    return lines, main, keep | frozenset(
        where for why, where, n, size in ended
        if n and (why == NAME or why in (KIND, CLEAR) and n == mains) or not mains and why in (NAME, CLEAR) and 2 * size > chars)


def shared(a: list, b: list) -> tuple[set[int], set[int]]:
    """The lines of a and of b in a longest common subsequence, in O((n + m) · differences) time and linear space:
    equal ends are taken off, lines unknown to the other are dropped, and what is left is aligned by patience."""
    left_a, left_b = list(range(len(a))), list(range(len(b)))
    known_a, known_b = set(a), set(b)
    left_a = [i for i in left_a if a[i] in known_b]
    left_b = [j for j in left_b if b[j] in known_a]
    # longest increasing chain of matches (Hunt and Szymanski): places of each line in b, latest first
    places: dict[str, list[int]] = {}
    for j in left_b:
        places.setdefault(b[j], []).append(j)
    from bisect import bisect_left

    ends: list[int] = []
    links: list[tuple[int, int, tuple | None]] = []
    for i in left_a:
        for j in reversed(places[a[i]]):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k] = j
                links[k] = link
    of_a, of_b = set(), set()
    at = links[-1] if links else None
    while at:
        of_a.add(at[0])
        of_b.add(at[1])
        at = at[2]
    return of_a, of_b


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each page with its html replaced by its lines and whether each stands in an article or main element."""
    for batch in batches:
        pages = [lines_of(x.as_py() or "") for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("page_id", "url", "host", "path")],
             pa.array([x for x, _ in pages], pa.list_(pa.string())), pa.array([m for _, m in pages], pa.list_(pa.bool_()))],
            names=["page_id", "url", "host", "path", "lines", "main"])


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each line of a page is shared with a neighbour, for pages with such lines."""
    for batch in batches:
        rows, flags = [], []
        for row, marks, before, after in zip(*(batch.column(c).to_pylist() for c in ("_row", "marks", "before", "after"))):
            found = set().union(*(shared(marks, other)[0] for other in (before, after) if other))
            if found:
                rows.append(row)
                flags.append([k in found for k in range(len(marks))])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(flags, pa.list_(pa.bool_()))], names=["_row", "gone"])


def copies(a: Column, b: Column) -> Column:
    """Whether two pages, as marks of their lines, are copies or near copies; null if one is."""
    chars = lambda marks: F.aggregate(
        marks, F.lit(0).cast("bigint"), lambda n, x: n + x.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1).cast("bigint")))
    return chars(F.array_intersect(a, b)) >= COPY * F.greatest(chars(F.array_distinct(a)), chars(F.array_distinct(b)))


def neighbours(marked: DataFrame) -> DataFrame:
    """_row, marks and the marks of the nearest pages of other content before and after, of pages of a host that have lines."""
    order = ["path", "page_id", "marks", "url", "_row"]
    up = Window.partitionBy("host").orderBy(*order)
    down = Window.partitionBy("host").orderBy(*[F.col(c).desc() for c in order])
    # a page that opens a run has its neighbour beside it; the others of the run take it over
    pairs = marked.withColumn("_last", F.lag("marks").over(up)).withColumn(
        "_opens", ~F.coalesce(copies(F.col("marks"), F.col("_last")), F.lit(False)))
    before = pairs.withColumn("before", F.last(F.when(F.col("_opens"), F.col("_last")), True).over(
        up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    after = before.withColumn("_next", F.when(F.lag("_opens").over(down), F.lag("marks").over(down))).withColumn(
        "after", F.last("_next", True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    other = lambda c: F.when(~copies(F.col("marks"), F.col(c)), F.col(c)).alias(c)
    return after.where("free").select("_row", "marks", other("before"), other("after")).where(
        F.col("before").isNotNull() | F.col("after").isNotNull())


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    url = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(url, r"^//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?://[^/?#]*)?([^?#]*)", 1)
    rows = own(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("bigint"), F.col("url"), "html", host.alias("host"), path.alias("path"))
    parsed = materialize(rows.mapInArrow(
        _parsed, "page_id bigint, url string, host string, path string, lines array<string>, main array<boolean>",
    ).withColumn("_row", F.monotonically_increasing_id()), "page_lines")
    most = (1 << LENGTH_BITS) - 1
    mark = f"xxhash64(x) & {~most}L | cast(least(length(x), {most}) as bigint)"
    marked = parsed.where("host <> '' and size(lines) > 0").select(
        "_row", "host", "path", "page_id", "url", F.expr(f"transform(lines, x -> {mark})").alias("marks"),
        F.expr("exists(main, m -> not m)").alias("free"))
    # stored, so that its size is known: few such pages are broadcast and no text is shuffled
    gone = materialize(neighbours(marked).mapInArrow(_gone, "_row bigint, gone array<boolean>"), "page_gone")
    text = F.expr("array_join(if(gone is null, lines, filter(lines, (x, i) -> main[i] or not gone[i])), '\n')")
    return parsed.join(gone, "_row", "left").select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
