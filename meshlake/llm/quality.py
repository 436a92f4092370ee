"""Quality rules: robust multivariate outliers per language and source (operator 5).

Built-in functions only. Counts of a text are taken within its row. A document's
statistics are logarithms in steps of 1/SCALE, held as whole numbers, so that sums over
any partitioning agree exactly, and documents with equal statistics are one weighted point.
For each language and source, each language, and all, a minimum-covariance-determinant
estimate is found by concentration steps from several deterministic starts: each point
gets its Mahalanobis distance, the nearest share of the group is chosen by a histogram of
distances (the bin in which it ends counts in part), and its mean and covariance are the
next estimate. After two steps the start of least determinant goes on until no group's
determinant falls. A step is one aggregation over weighted points for all groups at once.
Estimates are drawn towards their parent's (language, then all) as if it were SHRINK more
documents, so groups of any size are judged by one rule. The cutoff is a quantile of the
chi-square law that squared distances of normal data follow.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.common import WORD, let, text_of
from meshlake.llm.filters import bitmap_filter, bits_for, maybe_in, surely_out
from meshlake.runtime import counted, materialize, observed

SYMBOLS = "#*$%&|<>"
SCALE = 256
#: Statistics of a document, in this order.
STATS = ("s_wordlen", "s_symbols", "s_dup", "s_repeat")
#: Deviations in one statistic that no group rejects by itself: words of twice the length, 10
#: symbols or 10 repeated lines a hundred words, and repeated words up to the base rule's half.
#: Most groups do not vary at all in some statistic; these regularise the determinant.
TOLERANCE = (math.log(2.0), math.log(11.0), math.log(11.0), math.log(51.0))
#: The part of a group that an estimate rests on, and the chi-square quantile of the cutoff.
SHARE, QUANTILE = 0.75, 0.975
#: Documents that the parent's estimate counts for.
SHRINK = 40.0
#: Bins of the logarithm of the squared distance to an octave.
BINS_PER_OCTAVE = 32
#: Steps at most, should determinants go on falling by less than a millionth.
STEPS = 30


def chi_square(x: float, k: int) -> float:
    """The chance that a chi-square variable of k degrees is at most x, by the series of the incomplete gamma function."""
    half, at = x / 2.0, k / 2.0
    term = total = 1.0 / at
    while term > total * 1e-16:
        at += 1.0
        term *= half / at
        total += term
    return total * math.exp(k / 2.0 * math.log(half) - half - math.lgamma(k / 2.0)) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return high


def consistency(share: float, k: int) -> float:
    """What the covariance of the nearest share of normal data is multiplied by to be that of all."""
    return share / chi_square(chi_square_quantile(share, k), k + 2)


def floors(tolerance: tuple[float, ...] = TOLERANCE, quantile: float = QUANTILE) -> tuple[float, ...]:
    """Variances added to each statistic's, by which its tolerance alone just reaches the cutoff."""
    return tuple(t * t / chi_square_quantile(quantile, len(tolerance)) for t in tolerance)


def base_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text."""
    own = docs.select(*keep, text_of(text).alias("__t"))
    words = own.select(*keep, "__t", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)).alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    n_dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return words.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        (F.length("__t") - F.length(F.regexp_replace("__t", WORD, ""))).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__w")).cast("long").alias("n_repeat_words"),
    )


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of width words found at least twice in the array.

    A text whose windows have hashes all unlike has none; that test is linear. Else the
    windows themselves are sorted with their places, and equal neighbours compared.
    """
    at = lambda w, i: F.get(w, i)

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, width)).alias("t"), i.alias("i")))
        return let(F.sort_array(windows), places)

    def places(s: Column) -> Column:
        same = lambda x, other: F.coalesce(x["t"] == other["t"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, at(s, k - 1)) | same(x, at(s, k + 1)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.coalesce(F.least(at(p, k + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[at(words, i + k) for k in range(width)]))
    unlike = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) <= width, F.lit(0)).when(unlike, F.lit(0)).otherwise(exact(words))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed statistics: logarithms, in whole steps of 1/SCALE."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    step = lambda x: F.floor(x * F.lit(float(SCALE)) + F.lit(0.5)).cast("long")
    share = lambda c: step(F.log(F.lit(1.0) + F.lit(100.0) * F.col(c) / n))
    return [step(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n)).alias("s_wordlen"), share("n_symbols").alias("s_symbols"), share("n_dup_lines").alias("s_dup"), share("n_repeat_words").alias("s_repeat")]


def _sums(weight: Column, stats: tuple[str, ...]) -> list[Column]:
    """Weighted counts, sums and sums of products, as exact decimals."""
    wide = lambda x: x.cast("decimal(20,0)")
    once = [F.sum(wide(weight * F.col(x))).alias(f"t{i}") for i, x in enumerate(stats)]
    twice = [F.sum(wide(weight * F.col(stats[i]) * F.col(stats[j]))).alias(f"t{i}_{j}") for i in range(len(stats)) for j in range(i + 1)]
    return [F.sum(wide(weight)).alias("m"), *once, *twice]


def _names(d: int, letter: str) -> list[str]:
    return [f"{letter}{i}_{j}" for i in range(d) for j in range(i + 1)]


def _estimates(sums: DataFrame, keys: list[str], floor: tuple[float, ...], widen: float) -> DataFrame:
    """keys, mu.., c.. (covariance times widen), l.. and logdet from weighted sums."""
    d = len(floor)
    number = lambda c: F.col(c).cast("double")
    mean = {i: number(f"t{i}") / number("m") for i in range(d)}
    cov = [((number(f"t{i}_{j}") / number("m") - mean[i] * mean[j]) * F.lit(widen / (SCALE * SCALE))).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)]
    return _factored(sums.select(*keys, *[m.alias(f"mu{i}") for i, m in mean.items()], *cov), floor)


def _factored(params: DataFrame, floor: tuple[float, ...]) -> DataFrame:
    """params with the Cholesky factor of covariance plus floor, and the logarithm of its determinant."""
    out, d = params, len(floor)
    for i in range(d):
        for j in range(i + 1):
            own = F.col(f"c{i}_{j}") + (F.lit(floor[i]) if i == j else F.lit(0.0))
            rest = own - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            # with the floor the matrix is positive definite but for rounding
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    return out.withColumn("logdet", 2.0 * sum((F.log(F.col(f"l{i}_{i}")) for i in range(d)), F.lit(0.0)))


def _distance(stats: tuple[str, ...]) -> Column:
    """The squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, s in enumerate(stats):
        x = (F.col(s) - F.col(f"mu{i}")) / F.lit(float(SCALE))
        rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * solved[k], range(i), x)  # noqa: B023
        solved.append(rest / F.col(f"l{i}_{i}"))
    return reduce(lambda a, b: a + b, (z * z for z in solved))


def starts(points: DataFrame, key: str, stats: tuple[str, ...], floor: tuple[float, ...]) -> DataFrame:
    """Three first estimates of each group, by column start.

    0: medians, all statistics alike; 1: mean and covariance of all; 2: medians, and
    variances from the distance between the tenths at both ends.
    """
    d = len(stats)
    tall = points.select(key, "w", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(s).alias("v")) for i, s in enumerate(stats)])).alias("x"))
    steps = tall.groupBy(key, "x.k", "x.v").agg(F.sum("w").alias("w"))
    # as many rows a group and statistic as it has whole steps
    line = Window.partitionBy(key, "k")
    placed = steps.withColumn("u", F.sum("w").over(line.orderBy("v"))).withColumn("n", F.sum("w").over(line))
    at = lambda i, p: F.min(F.when((F.col("k") == i) & (10 * F.col("u") >= p * F.col("n")), F.col("v")))
    each = placed.groupBy(key).agg(*[at(i, p).alias(f"{name}{i}") for i in range(d) for name, p in (("m", 5), ("a", 1), ("b", 9))])
    spread = lambda i: F.pow((F.col(f"b{i}") - F.col(f"a{i}")) / F.lit(SCALE * 2 * 1.2815515655446004), F.lit(2.0))
    centre = lambda number, var: each.select(key, F.lit(number).alias("start"), *[F.col(f"m{i}").cast("double").alias(f"mu{i}") for i in range(d)], *[(var(i) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)])
    plain = _estimates(points.groupBy(key).agg(*_sums(F.col("w"), stats)), [key], floor, 1.0).withColumn("start", F.lit(1))
    alike = _factored(centre(0, lambda i: F.lit(1.0)), (0.0,) * d)
    return alike.unionByName(plain).unionByName(_factored(centre(2, spread), floor))


def concentrate(points: DataFrame, params: DataFrame, key: str, stats: tuple[str, ...], share: float, floor: tuple[float, ...]) -> DataFrame:
    """The estimates that rest on the nearest share of each group by the given ones."""
    placed = points.join(params.select(key, "start", *[f"mu{i}" for i in range(len(stats))], *_names(len(stats), "l")), key)
    placed = placed.withColumn("bin", F.floor(F.log2(_distance(stats) + F.lit(1e-6)) * F.lit(float(BINS_PER_OCTAVE))).cast("int"))
    bins = placed.groupBy(key, "start", "bin").agg(*_sums(F.col("w"), stats))
    # some 1,500 bins a group at most
    group = Window.partitionBy(key, "start")
    upto, total = F.sum("m").over(group.orderBy("bin")).cast("double"), F.sum("m").over(group).cast("double")
    part = (F.lit(share) * total - (upto - F.col("m").cast("double"))) / F.col("m").cast("double")
    taken = bins.withColumn("part", F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)).cast("decimal(10,9)")).where("part > 0")
    names = ["m", *[f"t{i}" for i in range(len(stats))], *_names(len(stats), "t")]
    sums = taken.groupBy(key, "start").agg(*[F.sum(F.col(n) * F.col("part")).alias(n) for n in names])
    return _estimates(sums, [key, "start"], floor, consistency(share, len(stats)))


def mcd(points: DataFrame, key: str = "g", stats: tuple[str, ...] = STATS, share: float = SHARE, floor: tuple[float, ...] | None = None) -> DataFrame:
    """A row per group: key, start, mu.., c.., l.., logdet of the estimate of least determinant that was found.

    points has the key, whole-number statistics and a weight w.
    """
    floor = floors() if floor is None else floor
    params = materialize(starts(points, key, stats, floor), "starts")
    for _ in range(2):
        params = materialize(concentrate(points, params, key, stats, share, floor), "mcd")
    best = params.groupBy(key).agg(F.min(F.struct("logdet", "start")).alias("b")).select(key, F.col("b.start").alias("start"))
    params = params.join(best, [key, "start"])
    for _ in range(STEPS):
        before = params.select(key, F.col("logdet").alias("was"))
        after = concentrate(points, params, key, stats, share, floor).join(before, key)
        # a fall below a millionth is rounding, or a bin's edge
        params, seen = observed(after, "mcd", {"falls": F.count_if(F.col("was") - F.col("logdet") > 1e-6)})
        params = params.drop("was")
        if not seen["falls"]:
            break
    return params


def _drawn(own: DataFrame, parent: dict[str, Column], d: int, shrink: float) -> DataFrame:
    """own with mean and covariance moved towards the parent's, which counts for shrink documents."""
    mine = F.col("n_group") / (F.col("n_group") + F.lit(float(shrink)))
    names = [f"mu{i}" for i in range(d)] + _names(d, "c")
    others = [c for c in own.columns if c not in names and not c.startswith(("l0", "l1", "l2", "l3", "logdet", "p_"))]
    return own.select(*others, *[(mine * F.col(n) + (F.lit(1.0) - mine) * parent[n]).alias(n) for n in names])


def estimates(passed: DataFrame, share: float = SHARE, floor: tuple[float, ...] | None = None, shrink: float = SHRINK) -> DataFrame:
    """(g_lang, g_source, mu.., l..): the estimate of each language and source, drawn towards its parents'."""
    floor, d = floors() if floor is None else floor, len(STATS)
    cells = materialize(passed.groupBy("g_lang", "g_source", *STATS).agg(F.count(F.lit(1)).alias("w")), "cells")
    level = F.explode(F.array(F.struct("g_lang", "g_source"), F.struct(F.col("g_lang"), F.lit(None).cast("string").alias("g_source")), F.struct(F.lit(None).cast("string").alias("g_lang"), F.lit(None).cast("string").alias("g_source"))))
    # g_lang and g_source are never null, so null marks a wider group
    points = cells.select(level.alias("x"), *STATS, "w").withColumn("g", F.to_json("x"))
    points = materialize(points.groupBy("g", "x", *STATS).agg(F.sum("w").alias("w")), "points")
    sizes = points.groupBy("g").agg(F.sum("w").alias("n_group"), F.first("x").alias("x"))
    found = mcd(points.drop("x"), "g", STATS, share, floor).join(sizes, "g").select("x.*", "n_group", *[f"mu{i}" for i in range(d)], *_names(d, "c"))
    found = materialize(found, "levels")
    names = [f"mu{i}" for i in range(d)] + _names(d, "c")
    top = found.where("g_lang is null").first()
    whole = {n: F.lit(float(top[n]) if top else 0.0) for n in names}
    langs = _drawn(found.where("g_lang is not null and g_source is null").drop("g_source"), whole, d, shrink)
    parent = langs.select("g_lang", *[F.col(n).alias(f"p_{n}") for n in names])
    own = found.where("g_source is not null").join(parent, "g_lang")
    drawn = _drawn(own, {n: F.col(f"p_{n}") for n in names}, d, shrink)
    return materialize(_factored(drawn, floor).select("g_lang", "g_source", *[f"mu{i}" for i in range(d)], *_names(d, "l")), "estimates")


def _group(column: str) -> Column:
    """A language or source as the name of its group; null is a group of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), min_words: int = 50, max_repeat_percent: int = 50, quantile: float = QUANTILE, share: float = SHARE, tolerance: tuple[float, ...] = TOLERANCE, shrink: float = SHRINK) -> DataFrame:
    """One row per document: the columns of keep, the base counts, base_failed, d2, kept.

    A document that the base rules pass is rejected if its squared distance from the
    estimate of its language and source is above the chi-square quantile. A null language
    or source is a group of its own. Groups of any size are judged: small ones lean on
    their language's estimate, and that on all. Null and empty texts have no words and fail
    the base rules (for min_words of 1 or more). Repeated rows are judged alike. Extra
    columns are ignored, those of keep pass, whatever their names but those above; an empty
    table gives no rows.
    """
    if not 0 < quantile < 1 or not 0.5 <= share < 1:
        raise ValueError("quantile lies between 0 and 1, share from 0.5 to 1")
    floor = floors(tolerance, quantile)
    named = docs.select(*keep, text_of().alias("__text"), *[_group(c).alias(f"g_{c}") for c in ("lang", "source")])
    counts = base_counts(named, [*keep, "g_lang", "g_source"], "__text").withColumn("base_failed", base_failed(min_words, max_repeat_percent))
    counts = materialize(counts.select("*", *statistics()), "counts")
    params = estimates(counts.where("not base_failed").select("g_lang", "g_source", *STATS), share, floor, shrink)
    judged = counts.join(params, ["g_lang", "g_source"], "left").withColumn("d2", F.when(~F.col("base_failed"), _distance(STATS)))
    fits = F.coalesce(F.col("d2"), F.lit(0.0)) <= F.lit(chi_square_quantile(quantile, len(STATS)))
    return judged.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", (~F.col("base_failed") & fits).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, all columns unchanged. Options, nulls and ties are as in judge.

    The verdict depends on text, language and source alone, so of a row only two 64-bit hashes
    of these go with its statistics. Rows that a filter of the rejected hashes rules out pass
    as they are read; the others meet the rejected hashes by shuffle. So no text is written,
    repeated rows stay repeated, and any column names pass.
    """
    judged_by = [text_of("row.text"), *[_group(f"row.{c}") for c in ("lang", "source")]]
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.xxhash64(*judged_by).alias("k1"), F.xxhash64(F.lit("row"), *judged_by).alias("k2"))
    own = keyed.select("k1", "k2", "row.text", "row.lang", "row.source")
    rejected = judge(own, keep=("k1", "k2"), **options).where("not kept").select("k1", "k2").distinct()
    rejected, n = counted(rejected, "rejected")
    bits = bits_for(n)
    held = bitmap_filter(rejected, "k1", bits)
    # an anti-join would be planned below the filter, over all texts
    some = maybe_in(keyed, held, F.col("k1"), bits).join(rejected.withColumn("rejected", F.lit(True)), ["k1", "k2"], "left").where("rejected is null")
    return surely_out(keyed, held, F.col("k1"), bits).select("row").unionByName(some.select("row")).select("row.*")
