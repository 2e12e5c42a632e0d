"""Quality rules with robust multivariate outliers, in DataFrame operations alone.

Base rules look at one text. Beside them, four statistics of each text that passes form a vector: mean length of a word,
symbols per word, repeated lines per hundred words, all on a log scale, and the share of repeated words. For each language and source a
minimum-covariance-determinant estimate describes the bulk of these vectors: from several starts (quartiles and medians), C-steps take the
h = (n + p + 1) / 2 texts of the group that lie nearest by Mahalanobis distance and estimate mean and covariance anew from them;
the covariance of the nearest h of n is enlarged to that of all (consistency factor of the normal law). Of the starts the one with the
least determinant counts. A text is rejected when its distance from the estimate passes ``CUTOFF``. Just under half of a group may be bad.

A group of fewer than ``SMALL`` texts bears no estimate of its own: it is judged by that of its whole language, all sources pooled.

Scale: the statistics are one narrow pass. The vectors are stored once, as whole numbers, so that sums don't depend on
their order; a C-step is two aggregations with map-side combine, one to counts of distance bins per group and start, one to 15 sums
per group and start. No group is ever gathered, so a source that holds a third of all rows costs what its rows cost.

Defined results: a null text counts as empty; texts of fewer than 50 words fail the base rules; a null language or source is a
group of its own; repeated rows are each judged and each count in their group; an empty table gives no rows. Variances never
fall below ``FLOOR``, so groups of a few or of equal vectors have a defined distance too. Where h ends among texts of one distance bin, each
of them counts by the same part. A language of fewer than ``SMALL`` texts in all is judged by the estimate from what it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnish.llm.common import BLANKS, own, table
from tarnish.session import materialize

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Number of C-steps, the distance beyond which a text is an outlier, and the texts a group needs for an estimate of its own.
STEPS, CUTOFF, SMALL = 4, 8.0, 20
#: Least standard deviation of each statistic.
FLOOR = (0.05, 0.03, 0.3, 0.06)
#: Vectors are whole multiples of 1 / UNIT; distances are counted in BINS bins for each factor of e.
UNIT, BINS = 10_000, 64
NAMES = ("x0", "x1", "x2", "x3")
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row, though body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that are found twice or more in the array.

    Window hashes carry their position in the low bits; after one primitive sort, equal windows are neighbours.
    Neighbours are compared by their words, so a clash of hashes adds nothing.
    """
    def of(words: Column, n: Column) -> Column:
        def with_bits(bits: Column) -> Column:
            place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1).cast("int")
            top = lambda x: F.call_function("shiftright", x, bits)
            windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function(
                "shiftleft", top(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))), bits,
            ).bitwiseOR(i.cast("bigint"))))

            def equal(x: Column, y: Column) -> Column:
                same = top(x) == top(y)
                for d in range(3):
                    same = same & (F.get(words, place(x) + d) == F.get(words, place(y) + d))
                return F.coalesce(same, F.lit(False))

            def covered(s: Column) -> Column:
                found = F.sort_array(F.transform(
                    F.filter(s, lambda x, k: equal(F.get(s, k - 1), x) | equal(x, F.get(s, k + 1))), place))
                return let(found, lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))),
                    F.lit(0), lambda a, x: a + x))

            return let(windows, covered)

        return let(F.length(F.bin(n.cast("bigint"))).cast("int"), with_bits)

    return let(words, lambda w: F.when(F.size(w) >= 3, of(w, F.size(w))).otherwise(F.lit(0))).cast("bigint")


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The base statistics of every row, beside the columns to keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = "[^\\x20\\x09-\\x0D]"
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(solid))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    return own(docs, *keep, "text").select(
        *keep,
        F.array_remove(F.split(text, BLANKS), "").alias("_words"),
        without(BLANK_CHARS).cast("bigint").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    ).select(
        *keep, F.size("_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics as whole numbers; null where the base rules failed."""
    n = F.col("n_words").cast("double")
    values = (F.log(F.col("word_chars") / n), F.log1p(F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n),
              F.col("n_repeat_words") / n)
    return stats.select("*", *[
        F.when(~F.col("base_failed"), F.round(v * UNIT).cast("bigint")).alias(x) for v, x in zip(values, NAMES)])


def same(groups: list[str]) -> Column:
    """Whether a row's groups equal those of a frame in which they are renamed with a leading underscore; null equals null."""
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return on


def renamed(frame: DataFrame, groups: list[str]) -> DataFrame:
    return frame.select(*[F.col(g).alias(f"_{g}") for g in groups], *[c for c in frame.columns if c not in groups])


def consistency(share: Column) -> Column:
    """What the covariance of the nearest share of normal vectors is to be multiplied by: share / F6(x), where F4(x) = share.

    Fk is the chi-square law of k degrees of freedom; with y = x / 2, F4 = 1 - exp(-y) (1 + y), solved by Newton's steps from the left.
    """
    y = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(1.6783469), lambda y, _: y + (
        share - F.lit(1.0) + F.exp(-y) * (y + 1)) / (y * F.exp(-y)))
    return F.when(share >= 1, F.lit(1.0)).otherwise(share / (share - F.exp(-y) * y * y / 2))


def estimates(core: DataFrame, groups: list[str]) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group's core, floors included."""
    parts = core.groupBy(*groups, "_part", "_share").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s_{x}") for x in NAMES],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p_{i}{j}") for i, j in PAIRS])
    # at most two rows a group: whole bins and the last one, so the sum doesn't depend on order
    sums = parts.groupBy(*groups, "_share").agg(*[
        F.sum(F.col(c) * F.col("_part")).alias(c) for c in parts.columns if c[:2] in ("n", "s_", "p_")])
    n = F.col("n")
    factor = sums.withColumn("_factor", consistency(F.col("_share")))
    means = factor.select(*groups, *[(F.col(f"s_{x}") / n).alias(f"m{i}") for i, x in enumerate(NAMES)], *[
        (F.col("_factor") * (F.col(f"p_{i}{j}") / n - F.col(f"s_{NAMES[i]}") / n * (F.col(f"s_{NAMES[j]}") / n))).alias(f"c{i}{j}")
        for i, j in PAIRS])
    out = means.withColumns({
        f"c{i}{i}": F.greatest(F.col(f"c{i}{i}"), F.lit(0.0)) + F.lit((FLOOR[i] * UNIT) ** 2) for i in range(4)})
    for i in range(4):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select(*groups, *[f"m{i}" for i in range(4)], *[f"l{i}{j}" for i, j in PAIRS])


def starts(points: DataFrame, groups: list[str]) -> DataFrame:
    """The first estimates, numbered by _start, as if the statistics were independent: medians, lower and upper quartiles with the
    floors as scales, and medians with the distance of the quartiles."""
    found = points.groupBy(*groups).agg(*[
        F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).cast("array<double>").alias(f"q{i}") for i, x in enumerate(NAMES)])

    def start(number: int, quartile: int, spread: bool) -> Column:
        def scale(i: int) -> Column:
            floor = F.lit(2.0 * FLOOR[i] * UNIT)
            return F.greatest(floor, (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) if spread else floor

        return F.struct(
            F.lit(number).alias("_start"), *[F.col(f"q{i}")[quartile].alias(f"m{i}") for i in range(4)],
            *[(scale(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS])

    each = F.array(*[start(k, *x) for k, x in enumerate(((1, False), (0, False), (2, False), (1, True)))])
    return found.select(*groups, F.explode(each).alias("_s")).select(*groups, "_s.*")


def squared_distances(points: DataFrame, estimate: DataFrame, groups: list[str], *keep: str) -> DataFrame:
    """points with d2, the squared Mahalanobis distance from the own group's estimate, and the columns to keep of that."""
    out = points.join(renamed(estimate, groups), same(groups), "left")
    for i in range(4):
        rest = F.col(NAMES[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, 4)), F.col("z0") * F.col("z0"))
    return out.select(*points.columns, *keep, d2.alias("d2"))


def nearest(distances: DataFrame, groups: list[str]) -> DataFrame:
    """The h rows of each group with the least distances; _part is 1, or the part by which each row of the last bin counts, so that
    just h are taken; _share is h / n."""
    binned = distances.withColumn("_bin", F.floor(F.log(F.col("d2") + 1e-9) * BINS))
    counts = binned.groupBy(*groups, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*groups).orderBy("_bin")
    ends = counts.select(
        *groups, "_bin", "_n", (F.sum("_n").over(run) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_all"),
    ).withColumn("_h", F.least(F.col("_all"), F.expr(f"(_all + {len(NAMES) + 1}) div 2"))).where("_before < _h").groupBy(*groups).agg(
        F.max("_bin").alias("_last"), F.max_by((F.col("_h") - F.col("_before")) / F.col("_n"), "_bin").alias("_rest"),
        (F.max("_h") / F.max("_all")).alias("_share"))
    return binned.join(renamed(ends, groups), same(groups) & (F.col("_bin") <= F.col("_last"))).withColumn(
        "_part", F.when(F.col("_bin") < F.col("_last"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("_rest")))).drop(
        "_bin", "_last", "_rest", "d2", *[f"_{g}" for g in groups])


def best(estimate: DataFrame, groups: list[str]) -> DataFrame:
    """The estimate of least determinant of each group's starts."""
    others = [c for c in estimate.columns if c not in groups and c != "_start"]
    size = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, 4)), F.log(F.col("l00")))
    return estimate.groupBy(*groups).agg(F.min(F.struct(size.alias("_size"), "_start", *others)).alias("_s")).select(
        *groups, *[f"_s.{c}" for c in others])


def judged(docs: DataFrame, key: str = "doc_id", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """key, base statistics, base_failed, distance and kept of every row of docs."""
    groups = list(groups)
    stats = materialize(vectors(text_statistics(docs, key, *groups)), "quality_statistics")
    vector = stats.where(~F.col("base_failed")).select(*groups, *NAMES)
    sizes = materialize(vector.groupBy(*groups).agg((F.count(F.lit(1)) < SMALL).alias("_small")), "quality_sizes")
    # a pool is a group, or for small groups all groups that share the columns but the last
    pool = ["pooled", *[f"pool{i}" for i in range(len(groups))]]

    def named(wide: Column) -> list[Column]:
        return [wide.alias("pooled"), *[F.col(g).alias(f"pool{i}") for i, g in enumerate(groups[:-1])],
                F.when(~wide, F.col(groups[-1])).alias(pool[-1])]

    large = renamed(sizes.where(~F.col("_small")).select(*groups), groups)
    shared = renamed(sizes.where("_small").select(*groups[:-1]).distinct(), groups[:-1])
    points = materialize(
        vector.join(large, same(groups), "left_semi").select(*named(F.lit(False)), *NAMES).unionByName(
            vector.join(shared, same(groups[:-1]), "left_semi").select(*named(F.lit(True)), *NAMES)), "quality_points")
    estimate = starts(points, pool)
    each = [*pool, "_start"]
    for step in range(STEPS):
        estimate = materialize(estimate, f"quality_estimate{step}")  # a row per pool and start; ends the plan of the step
        estimate = estimates(nearest(squared_distances(points, estimate, pool, "_start"), each), each)
    estimate = materialize(best(estimate, pool), "quality_estimate")
    members = stats.join(renamed(sizes, groups), same(groups), "left").select(
        *stats.columns, *named(F.coalesce(F.col("_small"), F.lit(True))))
    out = squared_distances(members, estimate, pool)
    return out.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF * CUTOFF, F.lit(True))).alias("kept"),
        F.sqrt("d2").alias("distance"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
