"""Quality rules: base rules on words and lines, then robust multivariate
outliers. For every language and source the minimum-covariance-determinant
estimate of location and scatter is found by concentration steps; a document is
rejected when the Mahalanobis distance of its transformed statistics is beyond
a chi-square bound. Built-in DataFrame functions only.

The texts are read once. What follows works on one narrow row per document, and
every pass over these is a partial aggregation by group, so a source that holds
a third of all rows is spread over all tasks. The estimates are tables with one
row per group and start; they are joined by the planner's own choice.

Defined results: a null text has no words; a document without words fails the
base rules; a null language or source is a group of its own; groups with fewer
rows than ``least`` are estimated with all rows of their language, and languages
with fewer with all rows. Extra columns are ignored, repeated rows count twice,
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.sources.staging import stage, unstage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"

#: Transformed statistics, each with the least standard deviation it is given:
#: shares of symbols or repeats are zero in most clean texts, and without a floor
#: any text with one of them would be infinitely far away.
STATISTICS = {"log_words": 0.3, "log_word_chars": 0.12, "symbols": 0.15, "lines": 0.15, "repeats": 0.15}


def counted_words(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        *keep,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.size(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0))).cast("long").alias("n_symbols"),
        _repeated_lines(text).alias("n_dup_lines"),
    )
    hashed = split.select(
        *keep, "n_symbols", "n_dup_lines",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"),
    )
    windows = hashed.withColumn("windows", _bound(F.col("hashes"), _windows)).drop("hashes")
    unrepeated = F.size(F.array_distinct("windows")) == F.size("windows")
    return windows.withColumn(
        "n_repeat_words",
        F.when(unrepeated, 0).otherwise(_repeated_words(F.col("windows"))).cast("long"),
    ).drop("windows")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _windows(hashes: Column) -> Column:
    """A hash of every three consecutive words."""
    starts = F.when(F.size(hashes) >= 3, F.sequence(F.lit(0), F.size(hashes) - 3)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts,
        lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )


def _repeated_words(windows: Column) -> Column:
    """Number of words inside windows that occur twice or more: windows sorted by
    hash stand next to their equals."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = _bound(
        ordered,
        lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        ),
    )
    covered = F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return F.size(F.array_distinct(F.flatten(covered)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """The statistic vector: logarithms of sizes, arcsine roots of shares."""

    def share(part: Column, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(part / F.greatest(whole, F.lit(1)), F.lit(1.0))))

    words = F.col("n_words")
    return {
        "log_words": F.log1p(words.cast("double")),
        "log_word_chars": F.log1p(F.col("word_chars") / F.greatest(words, F.lit(1))),
        "symbols": share(F.col("n_symbols"), F.col("word_chars")),
        "lines": share(F.col("n_dup_lines"), words),
        "repeats": share(F.col("n_repeat_words"), words),
    }


def chi_square_quantile(share: float, degrees: int) -> float:
    """The cube approximation of Wilson and Hilferty."""
    a = 2 / (9 * degrees)
    return degrees * (1 - a + NormalDist().inv_cdf(share) * math.sqrt(a)) ** 3


def _pairs() -> list[tuple[str, str]]:
    names = list(STATISTICS)
    return [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]


def _moments() -> list[Column]:
    """Sums from which location and scatter follow."""
    sums = [F.sum(n).alias(f"s_{n}") for n in STATISTICS]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in _pairs()]
    return [F.count("*").alias("n"), *sums, *products]


def _estimates(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Location and the Cholesky factor of the scatter (with the floors on its
    diagonal), and the logarithm of its determinant."""
    means = {a: F.col(f"s_{a}") / F.col("n") for a in STATISTICS}
    table = moments.select(
        *keys, "n", *[m.alias(f"m_{a}") for a, m in means.items()],
        *[
            (
                F.col(f"s_{a}_{b}") / F.col("n") - means[a] * means[b]
                + F.lit(STATISTICS[a] ** 2 if a == b else 0.0)
            ).alias(f"c_{a}_{b}")
            for a, b in _pairs()
        ],
    )
    names = list(STATISTICS)
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            inner = F.col(f"c_{a}_{b}")
            for k in names[:j]:
                inner = inner - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            # Rounding can leave a pivot below its floor.
            value = (
                F.sqrt(F.greatest(inner, F.lit(STATISTICS[a] ** 2 / 4)))
                if a == b else inner / F.col(f"l_{b}_{b}")
            )
            table = table.withColumn(f"l_{a}_{b}", value)
    log_determinant = sum((2 * F.log(F.col(f"l_{a}_{a}")) for a in names), F.lit(0.0))
    return table.select(
        *keys, *[f"m_{a}" for a in names], *[f"l_{a}_{b}" for a, b in _pairs()],
        log_determinant.alias("log_determinant"),
    )


def _with_distance(table: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    names = list(STATISTICS)
    for i, a in enumerate(names):
        rest = F.col(a) - F.col(f"m_{a}")
        for b in names[:i]:
            rest = rest - F.col(f"l_{a}_{b}") * F.col(f"y_{b}")
        table = table.withColumn(f"y_{a}", rest / F.col(f"l_{a}_{a}"))
    return table.withColumn("distance", sum(F.col(f"y_{a}") ** 2 for a in names))


def _starts(rows: DataFrame, keys: list[str], starts: int) -> DataFrame:
    """First estimates: coordinate-wise medians with median deviations, and the
    moments of fixed hash samples of each group (an eighth of it each)."""
    medians = rows.groupBy(*keys).agg(
        *[F.percentile_approx(a, [0.25, 0.5, 0.75], 1000).alias(f"q_{a}") for a in STATISTICS]
    )
    robust = medians.select(
        *keys, F.lit(0).alias("start"),
        *[F.col(f"q_{a}")[1].alias(f"m_{a}") for a in STATISTICS],
        *[
            F.sqrt((0.7413 * (F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0])) ** 2 + STATISTICS[a] ** 2)
            .alias(f"l_{a}_{b}") if a == b else F.lit(0.0).alias(f"l_{a}_{b}")
            for a, b in _pairs()
        ],
        F.lit(0.0).alias("log_determinant"),
    )
    lanes = rows.withColumn("start", F.pmod(F.xxhash64(*STATISTICS), F.lit(8)).cast("int") + 1)
    sampled = lanes.filter(F.col("start") < starts).groupBy(*keys, "start").agg(*_moments())
    return robust.unionByName(_estimates(sampled, [*keys, "start"]))


def fit_mcd(
    rows: DataFrame, key: str, starts: int = 3, steps: int = 5, share: float = 0.75
) -> DataFrame:
    """One row per ``key`` with the estimate of least determinant that
    concentration steps reach from any start, and ``scale``, the factor that makes
    the median squared distance that of a normal sample. It is 1 at least: statistics
    that hardly vary in a cell lower the median, and dividing by less than one would
    carry clean rows beyond the bound. A step keeps the ``share``
    of rows that are nearest (by a quantile sketch) and estimates anew."""
    each = F.explode(F.array(*[F.lit(s) for s in range(starts)]))
    repeated = rows.select("*", each.alias("start"))
    keys = [key, "start"]
    estimates = stage(_starts(rows, [key], starts), "mcd")
    for _ in range(steps):
        distances = _with_distance(repeated.join(estimates, keys)).select(
            *keys, *STATISTICS, "distance"
        )
        nearest = stage(
            distances.groupBy(*keys).agg(F.percentile_approx("distance", share, 2000).alias("h")),
            "mcd",
        )
        kept = distances.join(nearest, keys).filter(F.col("distance") <= F.col("h"))
        better = stage(_estimates(kept.groupBy(*keys).agg(*_moments()), keys), "mcd")
        unstage(rows.sparkSession, estimates, nearest)
        estimates = better
    columns = [c for c in estimates.columns if c != key]
    best = estimates.groupBy(key).agg(
        F.min_by(F.struct(*columns), F.struct("log_determinant", "start")).alias("best")
    ).select(key, "best.*").drop("start", "log_determinant")
    best = stage(best, "mcd")
    middle = _with_distance(rows.join(best, key)).groupBy(key).agg(
        F.percentile_approx("distance", 0.5, 2000).alias("middle")
    )
    normal = chi_square_quantile(0.5, len(STATISTICS))
    return best.join(middle, key).select(
        best["*"], F.greatest(F.col("middle") / normal, F.lit(1.0)).alias("scale")
    )


def quality(
    docs: DataFrame, least: int = 200, tail: float = 1e-7, steps: int = 5
) -> DataFrame:
    """One row per document: ``doc_id``, the base statistics, ``base_failed``,
    ``distance`` (squared, scaled) and ``kept``. ``tail`` is the share of a normal
    sample beyond the bound."""
    spark = docs.sparkSession
    counted = counted_words(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "text",
            F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
            F.coalesce(F.col("source"), F.lit("")).alias("source"),
        ),
        "doc_id", "lang", "source",
    )
    rows = stage(
        counted.withColumn("base_failed", base_failed()).withColumns(transformed()), "quality"
    )
    fitted = rows.filter(~F.col("base_failed"))
    sizes = stage(fitted.groupBy("lang", "source").count(), "quality")
    languages = sizes.groupBy("lang").agg(F.sum("count").alias("in_lang"))
    cells = stage(
        sizes.join(languages, "lang").select(
            "lang", "source",
            F.when(F.col("count") >= least, F.concat_ws("\u0001", F.lit("s"), "lang", "source"))
            .when(F.col("in_lang") >= least, F.concat_ws("\u0001", F.lit("l"), "lang"))
            .otherwise("all").alias("cell"),
        ),
        "quality",
    )
    members = fitted.join(cells, ["lang", "source"]).select("cell", *STATISTICS)
    # A pooled cell is estimated with all rows of its language, or with all rows.
    pools = [
        members.filter(F.col("cell").startswith("s\u0001")),
        fitted.select(F.concat_ws("\u0001", F.lit("l"), "lang").alias("cell"), *STATISTICS),
        fitted.select(F.lit("all").alias("cell"), *STATISTICS),
    ]
    used = cells.select("cell").distinct()
    pooled = reduce(DataFrame.unionByName, pools).join(used, "cell", "left_semi")
    model = stage(fit_mcd(stage(pooled, "quality"), "cell", steps=steps), "mcd")
    bound = chi_square_quantile(1 - tail, len(STATISTICS))
    judged = _with_distance(
        rows.join(cells, ["lang", "source"], "left").join(model, "cell", "left")
    )
    distance = F.col("distance") / F.col("scale")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        F.when(~F.col("base_failed"), distance).alias("distance"),
        F.when(F.col("base_failed"), False)
        .otherwise(F.coalesce(distance <= bound, F.lit(True)))
        .alias("kept"),
    )


def op1_mcd_outliers(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
