"""Quality rules whose thresholds bound the share of good documents they reject.

Every rule compares one figure of a document with a cutoff. In each stratum a quarter of the
labelled good documents, dealt by a hash, lays down one path of cutoffs for all rules
together: it ends where few of them are rejected, and begins many grid steps more lenient. The
others test it. From lenient to strict, the exact binomial (Clopper-Pearson) upper bound of the
share rejected by any rule must stay below the risk; testing stops at the first failure, so a
path is one hypothesis and the error level is divided by the number of strata only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelwise.llm.common import bind, stored, text_of, words_of

#: Of good documents that pass the base rules, at most this share is rejected in a
#: stratum, by all rules together, with this confidence for all strata together.
RISK, ERROR = 0.02, 0.05

#: One of so many labelled good documents lays down the path, the others test it.
FOLDS = 4

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Rule -> cutoffs from lenient to strict. A document fails above its cutoff. The
#: last three count in opposite sense, so their figure is negated.
GRIDS = {
    "symbol_ratio": [3.0, 2.5, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01],
    "dup_line_ratio": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "repeat_ratio": [0.49, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03],
    "long_words": [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5, 6.0],
    "upper_ratio": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "bang_ratio": [2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0, -4.5, -5.0],
    "few_letters": [-0.3, -0.4, -0.5, -0.6, -0.7, -0.8, -0.85, -0.9, -0.95],
}


def _covered(windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the windows' hashes.

    Sorted with their positions, equal windows are neighbours; a found window adds the
    words up to the next found one, three at most.
    """
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda a: F.filter(
        a,
        lambda x, j: (F.get(a, j - 1)["h"] == x["h"]) | (F.get(a, j + 1)["h"] == x["h"]),
    )
    found = bind(ranked, lambda a: F.array_sort(F.transform(twice(a), lambda x: x["i"])))
    return bind(
        found,
        lambda at: F.aggregate(
            F.transform(
                at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))
            ),
            F.lit(0),
            lambda total, n: total + n,
        ),
    )


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One struct ``row`` with the columns given and one struct ``stats``.

    Being structs, they cannot clash with the columns of ``docs``. A null text has no
    words. Texts of any length are read whole. 3-word windows are compared by a 64-bit
    hash of their words.
    """
    whole = text_of(F.col("row")[text])
    lines = docs.select(F.struct("*").alias("row")).select(
        "row",
        words_of(whole).alias("words"),
        F.split(whole, "\n", -1).alias("lines"),
        whole.alias("whole"),
    )
    w = F.col("words")
    windows = F.when(
        F.size(w) < 3, F.array().cast("array<bigint>")
    ).otherwise(
        F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )
    )
    worded = F.filter(F.col("lines"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gone = lambda pattern: F.length(F.regexp_replace("whole", pattern, ""))
    parts = lines.select(
        "row",
        F.size(w).cast("long").alias("n_words"),
        (F.length(F.array_join(w, ""))).cast("long").alias("word_chars"),
        (F.length("whole") - gone(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        worded.alias("worded"),
        windows.alias("windows"),
        (F.length("whole") - gone(r"\p{Lu}+")).alias("upper"),
        (F.length("whole") - gone(r"!+")).alias("bangs"),
        (F.length("whole") - gone(r"\p{L}+")).alias("letters"),
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    counted = parts.withColumns(
        {
            "n_dup_lines": (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long"),
            "n_repeat_words": F.when(repeated, _covered(F.col("windows")))
            .otherwise(0)
            .cast("long"),
        }
    )
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    figures = {
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size("worded"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
        "upper_ratio": F.col("upper") / F.greatest("letters", F.lit(1)),
        "bang_ratio": F.col("bangs") / n,
        "short_words": -F.col("word_chars") / n,
        "few_letters": -F.col("letters") / chars,
    }
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.select(
        "row",
        F.struct(
            *counts,
            failed.alias("base_failed"),
            *[figures[rule].cast("double").alias(rule) for rule in GRIDS],
        ).alias("stats"),
    )


def binomial_limit(n: Column, p: float, error: Column) -> Column:
    """The largest k with P(Binomial(n, p) <= k) <= error; -1 if there is none.

    With at most k failures among n, the exact upper bound of the failure rate at this
    error is at most p. The sum runs over logarithms, so no n underflows.
    """
    start = F.struct(
        (n * F.log(F.lit(1.0 - p))).alias("term"),
        F.lit(float("-inf")).alias("total"),
        F.lit(-1).alias("k"),
    )

    def step(state: Column, i: Column) -> Column:
        high = F.greatest(state["total"], state["term"])
        total = high + F.log(F.exp(state["total"] - high) + F.exp(state["term"] - high))
        odds = F.lit(p / (1.0 - p))
        # log() of the zero ratio past the last term is null in Spark; -inf is meant.
        ratio = F.log((n - i) / (i + 1) * odds)
        return F.struct(
            F.coalesce(state["term"] + ratio, F.lit(float("-inf"))).alias("term"),
            total.alias("total"),
            F.when(total <= F.log(error), i).otherwise(state["k"]).cast("int").alias("k"),
        )

    terms = F.sequence(F.lit(0), F.ceil(n * p).cast("int"))
    return F.aggregate(terms, start, step, lambda state: state["k"])


def cutoffs(
    holdout: DataFrame, risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """Per stratum, the chosen cutoff of each rule; +infinity where none is proven.

    ``holdout`` has ``stratum`` and ``stats`` of labelled good documents. The rules of a
    stratum share ``risk`` as a whole, the strata share ``error`` equally. One row for each stratum.
    """
    good = holdout.where(~F.col("stats.base_failed"))
    lays = (F.pmod(F.xxhash64("stats"), F.lit(FOLDS)) == 0).alias("lays")
    # How many cutoffs of its grid each figure is above, counted from the strict end.
    above = [
        sum((F.col("stats")[rule] > c).cast("int") for c in grid).alias(rule) for rule, grid in GRIDS.items()
    ]
    graded = good.select("stratum", lays, F.struct(*above).alias("above"))
    counted = graded.groupBy("stratum").agg(
        F.sum((~F.col("lays")).cast("long")).alias("n"),
        F.sum(F.col("lays").cast("long")).alias("n_lays"),
        *[
            F.sum((F.col("lays") & (F.col("above")[rule] > j)).cast("long")).alias(f"{rule}_{j}")
            for rule, grid in GRIDS.items()
            for j in range(len(grid))
        ],
    )
    # The least j whose cutoff is passed by too few: the path ends at that cutoff of each rule.
    ends = []
    for rule, grid in GRIDS.items():
        end = F.lit(len(grid))
        for j in reversed(range(len(grid))):
            fits = F.col(f"{rule}_{j}") <= F.floor(F.col("n_lays") * F.lit(risk / len(GRIDS)))
            end = F.when(fits, F.lit(j)).otherwise(end)
        ends.append(end.alias(rule))
    strata = counted.select("stratum", "n", "n_lays", F.struct(*ends).alias("ends"))
    strata = stored(strata.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0)))), "quality-paths")
    # So many grid steps before its end a document is still rejected by some rule.
    last = F.greatest(*[F.col("above")[rule] - F.col("ends")[rule] - 1 for rule in GRIDS])
    tested = graded.where(~F.col("lays")).join(
        strata.select(F.col("stratum").alias("s"), "ends"), F.col("stratum") == F.col("s")
    )
    steps = range(max(map(len, GRIDS.values())))
    rejected = tested.groupBy("s").agg(*[F.sum((last >= m).cast("long")).alias(f"at_{m}") for m in steps])
    limit = binomial_limit(F.col("n"), risk, F.lit(error) / F.col("strata"))
    limited = strata.withColumn("limit", F.when(F.col("n_lays") > 0, limit).otherwise(-1)).join(
        rejected, F.col("stratum") == F.col("s"), "left"
    )
    # Strict steps reject whatever lenient ones do, so the first failure ends it.
    margin = F.lit(None).cast("int")
    for m in reversed(steps):
        margin = F.when(F.coalesce(f"at_{m}", F.lit(0)) <= F.col("limit"), F.lit(m)).otherwise(margin)
    limited = limited.withColumn("margin", margin)
    chosen = []
    for rule, grid in GRIDS.items():
        at = F.lit(len(grid) - 1) - F.col("ends")[rule] - F.col("margin")
        cut = F.get(F.array(*[F.lit(float(c)) for c in grid]), at)
        chosen.append(F.coalesce(F.when(at >= 0, cut), F.lit(float("inf"))).alias(rule))
    return limited.select("stratum", F.struct(*chosen).alias("cut"))


def judge(
    rows: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    id_column: str = "doc_id",
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """``rows`` of :func:`with_stats` with a boolean ``kept``.

    ``labels`` has ``doc_id`` and ``quality``; rows of quality 1 are the good documents.
    A null stratum is a stratum of its own; a stratum without enough labels gets no
    cutoff and only base rules hold there. Labels with nulls are passed over; a document labelled
    twice counts twice; empty tables give empty results.
    """
    named = F.coalesce(F.col("row")[stratum].cast("string"), F.lit(""))
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_labelled"))
    figures = rows.select(
        F.col("row")[id_column].alias("_id"), named.alias("stratum"), "stats"
    )
    holdout = figures.join(good, figures["_id"] == good["_labelled"]).select("stratum", "stats")
    cuts = stored(cutoffs(holdout, risk, error), "quality-cutoffs")
    cuts = cuts.withColumnRenamed("stratum", "_stratum")
    passed = F.lit(True)
    for rule in GRIDS:
        cut = F.coalesce(F.col("cut")[rule], F.lit(float("inf")))
        passed = passed & (F.col("stats")[rule] <= cut)
    joined = rows.withColumn("_named", named).join(cuts, F.col("_named") == F.col("_stratum"), "left")
    return joined.select("row", "stats", (~F.col("stats.base_failed") & passed).alias("kept"))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base verdict and verdict of every document."""
    slim = docs.select("doc_id", "lang", "text")
    rows = with_stats(slim).select(
        F.struct(F.col("row.doc_id"), F.col("row.lang")).alias("row"), "stats"
    )
    judged = judge(stored(rows, "quality-stats"), labels)
    return judged.select(
        "row.doc_id",
        *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        "stats.n_repeat_words",
        "stats.base_failed",
        "kept",
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    judged = judge(stored(with_stats(docs), "quality-rows"), labels)
    return judged.where("kept").select("row.*")
