"""Document fingerprints by I-Match, in DataFrame operations alone.

A text's terms are its distinct runs of letters and digits in lower case. Only terms within a band of inverse document frequency
count: those found in at least ``RARE`` and at most ``COMMON`` of the counted texts (and in two at least). These terms, sorted, are hashed
whole, and again under randomised subsets of the lexicon: ``FAMILIES`` independent draws, each nested over ``LEVELS`` levels that keep
a half, a quarter, an eighth and so on of the terms, so that texts of any length meet subsets that hold only a few of their
terms. The fingerprint is the hash of all terms and those of all subsets. A text without a term in the band is hashed by all its terms.

Likeness of two fingerprints: a subset differs if it draws a term that only one text has, and is in use if it draws any. As the
levels halve, the number that differ grows by FAMILIES with each doubling of the terms that differ, so with D
that differ and U in use, 2^(D/FAMILIES) - 1 over 2^(U/FAMILIES) - 1 estimates the share of terms not shared; the likeness is one minus it.

The edited text of a document ends in the beginning of the next document's, by falling doc_id.

Scale: the order of documents is a range partitioning of narrow rows, each bucket's last row followed by the next bucket's
first; texts are shuffled once by key and read twice (as own and as next text). Document frequencies are one aggregation with
map-side combine. The lexicon holds (mean number of terms of a text) / RARE terms at the most, whatever the number of texts; it is
counted, and broadcast up to ``BROADCAST`` terms, else joined by a shuffle. A text with more than 1 / ``COPIED`` of all rows counts once, so that groups of copies
don't push their own terms out of the band; fewer than ``COPIED`` such texts can exist.

Defined results: a null text counts as empty; texts without terms have equal fingerprints (likeness 1 to each other, 0 to others);
ids may repeat or be null (null last); rows of one id follow each other by the hash of their text, equal rows directly, so that all
but the last are followed by their own text; the only row of a table is followed by itself; an empty table gives no rows. Rows
are told apart by 128 bits of hash over id and text. Further columns of the table play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnish.llm.common import own, table
from tarnish.llm.op10_quality_rules import let
from tarnish.session import materialize

#: The band: least and largest share of the counted texts that hold a term.
RARE, COMMON = 1 / 2000, 0.2
#: Draws of the lexicon, and halvings of each.
FAMILIES, LEVELS = 12, 20
#: A text with more than this part of all rows counts once.
COPIED = 1000
#: Terms of a lexicon that is sent to every task.
BROADCAST = 2_000_000
KEY = ["h1", "h2"]
#: Where a term is found, in the free bits of its hash.
IN_TEXT, IN_EDITED, IN_BAND = 1, 2, 4


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and the key of both."""
    rows = own(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    none = F.col("doc_id").isNull()
    return rows.withColumns({
        "h1": F.xxhash64(none, "doc_id", "text"), "h2": F.xxhash64(F.lit(12), "text", "doc_id", none)})


def neighbours(rows: DataFrame) -> DataFrame:
    """For each distinct row: its key, doc_id, n, key of its text (t1, t2), and what follows: n1, n2 with the number of copies
    that it follows. Where equal rows follow each other, ``own`` marks the entry of those followed by themselves."""
    narrow = rows.select("doc_id", *KEY, F.length("text").cast("bigint").alias("n"), F.xxhash64("text").alias("t1"),
                         F.xxhash64(F.lit(12), "text").alias("t2"))
    distinct = narrow.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in ("doc_id", "n", "t1", "t2")])
    order = [F.desc_nulls_last("doc_id"), F.asc("h1"), F.asc("h2")]
    ranged = materialize(
        distinct.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()), "imatch_order")
    inside = Window.partitionBy("bucket").orderBy(*order)
    placed = ranged.withColumns({
        "n1": F.lead("h1").over(inside), "n2": F.lead("h2").over(inside), "place": F.row_number().over(inside)})
    # a row for each bucket, so no more than partitions; the last bucket is followed by the first
    firsts = materialize(placed.where(F.col("place") == 1).select("bucket", *KEY), "imatch_borders")
    turn = Window.orderBy("bucket")
    start = F.struct(*KEY)
    borders = firsts.select("bucket", F.coalesce(
        F.lead(start).over(turn), F.first(start).over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    joined = placed.join(F.broadcast(borders), "bucket").select(
        *KEY, "doc_id", "n", "t1", "t2", "copies", F.coalesce("n1", "next.h1").alias("n1"), F.coalesce("n2", "next.h2").alias("n2"))
    entry = lambda own, a, b, copies: F.struct(
        F.lit(own).alias("own"), F.col(a).alias("n1"), F.col(b).alias("n2"), copies.alias("copies"))
    return joined.withColumn("_e", F.explode(F.array(
        entry(False, "n1", "n2", F.lit(1).cast("bigint")), entry(True, "h1", "h2", F.col("copies") - 1)))).select(
        *KEY, "doc_id", "n", "t1", "t2", "_e.*").where("copies > 0")


def terms(text: Column) -> Column:
    """The distinct terms of a text as hashes whose last three bits are free."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(~7))))


def lexicon(rows: DataFrame, order: DataFrame) -> DataFrame:
    """The terms within the band."""
    texts = order.groupBy("t1", "t2").agg(F.sum("copies").alias("all"), F.min(F.struct(*KEY)).alias("one"))
    total = order.agg(F.sum("copies")).first()[0] or 0
    hot = materialize(texts.where((F.col("all") > 1) & (F.col("all") * COPIED > total)).select("one.*", "t1", "t2", "all"), "imatch_hot")
    copied = hot.agg(F.count(F.lit(1)), F.sum("all")).first()
    counted = total - (copied[1] or 0) + copied[0]
    named = rows.select("text", *KEY, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(12), "text").alias("t2"))
    others = named.join(F.broadcast(hot.select("t1", "t2")), ["t1", "t2"], "left_anti").select("text")
    once = named.join(F.broadcast(hot.select(*KEY)), KEY, "left_semi").dropDuplicates(KEY).select("text")
    found = others.unionByName(once).select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))
    least, most = max(2.0, RARE * counted), max(2.0, COMMON * counted)
    return materialize(found.where(F.col("df").between(least, most)).select("term"), "imatch_lexicon")


def signature(found: Column) -> Column:
    """The hash of the terms, and for each family its levels: a hash from 1 to 32767, or 0 for a subset that draws no term."""
    edges = [1 << (63 - level) for level in range(LEVELS, 0, -1)]  # rising

    def family(number: int) -> Column:
        # numbers below 2^63; the edges are sorted in with the terms, so that a level's terms are those before its edge
        drawn = F.sort_array(F.concat(
            F.transform(found, lambda t: F.call_function("shiftrightunsigned", F.xxhash64(F.lit(number), t), F.lit(1))),
            F.array(*[F.lit(e) for e in edges])))
        return let(drawn, lambda s: F.transform(
            F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(k).alias("below")) for k, e in enumerate(edges)]),
            lambda level: let(F.array_position(s, level["edge"]).cast("int") - 1, lambda before: F.when(
                before > level["below"], F.pmod(F.xxhash64(F.slice(s, 1, before)), F.lit(32767)) + 1).otherwise(0).cast("smallint"))))

    return F.struct(F.xxhash64(F.sort_array(found)).alias("whole"), F.size(found).alias("size"),
                    F.flatten(F.array(*[family(k) for k in range(FAMILIES)])).alias("parts"))


def likeness(x: Column, y: Column) -> Column:
    """Of two signatures, from 0 to 1."""
    both = F.zip_with(x["parts"], y["parts"], lambda a, b: F.when(a != b, 2).when(a != 0, 1).otherwise(0))
    sums = F.aggregate(both, F.struct(F.lit(0).alias("d"), F.lit(0).alias("u")), lambda s, v: F.struct(
        (s["d"] + (v == 2).cast("int")).alias("d"), (s["u"] + (v > 0).cast("int")).alias("u")))
    # the whole lexicon is the level above the first, the same for each family
    grown = lambda n, whole: F.pow(F.lit(2.0), n / FAMILIES + whole.cast("int")) - 1
    differ = (x["whole"] != y["whole"]) | (x["size"] != y["size"])
    return let(sums, lambda s: F.when(~differ & (s["d"] == 0), 1.0).otherwise(
        1 - grown(s["d"], differ) / grown(s["u"], (x["size"] + y["size"]) > 0)))


def text_of(x: Column) -> Column:
    """A signature as hexadecimal digits: 16 of the whole, then four for each subset."""
    return F.concat(F.lpad(F.hex(x["whole"]), 16, "0"), F.array_join(
        F.transform(x["parts"], lambda v: F.lpad(F.hex(v.cast("int")), 4, "0")), ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    rows = keyed(docs)
    order = materialize(neighbours(rows), "imatch_neighbours")
    words = lexicon(rows, order)
    known = words.withColumn("in_band", F.lit(IN_BAND).cast("bigint"))
    if words.count() <= BROADCAST:
        known = F.broadcast(known)

    texts = rows.dropDuplicates(KEY).select(*KEY, "text")
    half = F.expr("cast(n div 2 as int)")
    following = texts.select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.col("text").alias("next"))
    pieces = order.join(following, ["n1", "n2"]).select(
        *KEY, "doc_id", "n", "own", "n1", "n2", "copies", F.substring(F.col("next"), F.lit(1), half).alias("piece"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n").cast("int") - half), "piece")
    both = texts.join(pieces, KEY).select(*KEY, "doc_id", "n", "own", "n1", "n2", "copies", "text", edited.alias("edited"))
    marked = both.select(
        *KEY, "own", F.struct("doc_id", "n", "n1", "n2", "copies", F.sha2("edited", 256).alias("edited_sha256")).alias("about"),
        terms(F.col("text")).alias("mine"), terms(F.col("edited")).alias("changed"))
    # a term of both texts is one row
    flagged = lambda found, bits: F.transform(found, lambda t: t.bitwiseOR(F.lit(bits)))
    marked = marked.select(*KEY, "own", "about", F.concat(
        flagged(F.array_intersect("mine", "changed"), IN_TEXT | IN_EDITED), flagged(F.array_except("mine", "changed"), IN_TEXT),
        flagged(F.array_except("changed", "mine"), IN_EDITED)).alias("terms"))
    each = marked.select(*KEY, "own", "about", F.posexplode_outer("terms").alias("place", "term")).select(
        *KEY, "own", "term", F.when(F.coalesce("place", F.lit(0)) == 0, F.col("about")).alias("about"))
    found = each.join(known.withColumnRenamed("term", "_known"), F.col("term").bitwiseAND(F.lit(~7)) == F.col("_known"), "left").groupBy(
        *KEY, "own").agg(
        F.first("about", ignorenulls=True).alias("about"),
        F.collect_list(F.col("term").bitwiseOR(F.coalesce("in_band", F.lit(0).cast("bigint")))).alias("terms"))

    def of(side: int) -> Column:
        mine = F.filter("terms", lambda t: t.bitwiseAND(F.lit(side)) != 0)
        banded = let(mine, lambda all: let(
            F.filter(all, lambda t: t.bitwiseAND(F.lit(IN_BAND)) != 0), lambda band: F.when(F.size(band) > 0, band).otherwise(all)))
        return let(F.transform(banded, lambda t: t.bitwiseAND(F.lit(~7))), signature)

    base = materialize(
        found.select(*KEY, "own", "about.*", of(IN_TEXT).alias("mine"), of(IN_EDITED).alias("changed")), "imatch_signatures")
    first = base.where(~F.col("own")).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.col("mine").alias("following"))
    return base.join(first, ["n1", "n2"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", text_of(F.col("mine")).alias("fingerprint"),
        text_of(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("mine"), F.col("changed")).alias("near_edited"),
        likeness(F.col("mine"), F.col("following")).alias("near_next"))


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
