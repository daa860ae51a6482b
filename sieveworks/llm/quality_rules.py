"""Quality rules whose cutoffs carry a guarantee on labelled holdouts.

Base rules look at one text each: too few words, or too many words inside repeated three-word
windows.  The further rules ("value above cutoff") get their cutoffs from labelled documents.  For
each stratum and rule a fixed grid of cutoffs is tested from the mildest on: the hypothesis "this
cutoff rejects more than ``alpha / rules`` of the good documents" is rejected when the exact
binomial tail of the good holdout documents it rejects is at most ``delta / (strata * rules)``
(fixed-sequence testing inside the grid, Bonferroni over strata and rules).  The strictest cutoff
reached holds; a stratum and rule that reach none reject nothing.  With probability ``1 - delta``
every stratum loses at most ``alpha`` of its good documents to these rules.

Defined results: a null or empty text has no words and fails the base rules; a null stratum is a
stratum of its own; labels with null quality or id are ignored, labels that occur more than once
count each time; repeated rows give repeated rows.  Other columns are carried by
:func:`keep_documents` and not read by :func:`judge`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, words_of, written

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\f\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]

#: Ratios that the risk-controlled rules bound from above, as numerator and denominator.
RATIOS = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
}


@dataclass(frozen=True)
class Risk:
    """``grid``: cutoffs from the mildest to the strictest, fixed before any data are seen."""

    alpha: float = 0.02
    delta: float = 0.05
    grid: tuple[float, ...] = field(default=(0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1))
    min_words: int = 50
    max_repeat_percent: int = 50


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Windows are compared by a 64-bit hash, sorted with their positions; the covered words are the
    union of the repeated windows.
    """

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

    def windows(ws: Column) -> Column:
        hashed = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
        return let(hashed, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), repeated),
        ).otherwise(F.lit(0)))

    return windows(words)


def measures(text: Column) -> Column:
    """The counts of :data:`MEASURES` for a text as a struct of longs."""
    known = F.coalesce(text, F.lit(""))
    solid = F.translate(known, SPACES, "")
    lines = F.filter(F.split(known, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    cut = let(words_of(text), lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("r")))
    line = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("d")))
    out = let(F.struct(cut.alias("w"), line.alias("l"), solid.alias("s")), lambda x: F.struct(
        x["w"]["n"].cast("long").alias("n_words"),
        F.length(x["s"]).cast("long").alias("word_chars"),
        (F.length(x["s"]) - F.length(F.translate(x["s"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
        x["l"]["d"].cast("long").alias("n_dup_lines"),
        x["w"]["r"].cast("long").alias("n_repeat_words"),
        x["l"]["n"].cast("long").alias("n_lines"),
        (F.length(x["s"]) - F.length(F.translate(x["s"], UPPER, ""))).cast("long").alias("n_upper"),
        (F.length(x["s"]) - F.length(F.translate(x["s"], "!", ""))).cast("long").alias("n_marks"),
    ))
    return out


def ratio(name: str, m: str = "_m") -> Column:
    top, below = RATIOS[name]
    return F.col(f"{m}.{top}").cast("double") / F.greatest(F.col(f"{m}.{below}"), F.lit(1)).cast("double")


def base_failed(how: Risk, m: str = "_m") -> Column:
    few = F.col(f"{m}.n_words") < how.min_words
    return few | (100 * F.col(f"{m}.n_repeat_words") > how.max_repeat_percent * F.col(f"{m}.n_words"))


def log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1: Stirling's series after a shift by eight."""
    y = x + 8
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k) below the mean, to double precision; 1 at or above it, which certifies nothing.

    Terms are summed downwards from k.  Each is at most the first ratio times the one before, so the
    number of terms that tell in 17 digits is known beforehand; it never exceeds k.
    """
    n, k = n.cast("double"), k.cast("double")
    odds = (1 - rate) / rate

    def total(s: Column) -> Column:
        ratio = F.greatest(s["k"] / (s["n"] - s["k"] + 1) * odds, F.lit(1e-300))
        steps = F.sequence(F.lit(0), F.least(s["k"], F.ceil(-40 / F.log(F.least(ratio, F.lit(1 - 1e-12)))).cast("double")).cast("int"))
        run = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
            lambda a, j: F.struct((a["term"] * (s["k"] - j) / (s["n"] - s["k"] + j + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        )
        first = log_gamma(s["n"] + 1) - log_gamma(s["k"] + 1) - log_gamma(s["n"] - s["k"] + 1) + s["k"] * F.log(F.lit(rate)) + (s["n"] - s["k"]) * F.log(F.lit(1 - rate))
        return F.least(F.lit(1.0), F.exp(first) * run["sum"])

    below = F.when((n > 0) & (k < n * rate), F.struct(n.alias("n"), k.alias("k")))
    return F.coalesce(let(below, lambda s: F.when(s.isNotNull(), total(s))), F.lit(1.0))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, how: Risk = Risk()) -> DataFrame:
    """``stratum`` and one cutoff per rule (null: the rule rejects nothing there).

    ``measured(doc_id, stratum, _m)``, ``labels(doc_id, good boolean)``.  All labelled rows count;
    the counts are pre-aggregated per stratum before any shuffle by it.
    """
    good = labels.where(F.col("good") & F.col("doc_id").isNotNull()).select("doc_id")
    held = measured.join(good, "doc_id")
    counts = [F.count("*").alias("n")]
    for name in RATIOS:
        counts += [F.sum((ratio(name) > c).cast("long")).alias(f"{name}_{i}") for i, c in enumerate(how.grid)]
    per = written(held.groupBy("stratum").agg(*counts), "strata-counts")
    strata = per.count()
    level = how.delta / max(1, strata * len(RATIOS))
    rate = how.alpha / len(RATIOS)

    def chosen(name: str) -> Column:
        grid = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"{name}_{i}").alias("k")) for i, c in enumerate(how.grid)])
        reached = F.aggregate(
            grid,
            F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("cut")),
            lambda a, g: let(a["on"] & (binomial_tail(F.col("n"), g["k"], rate) <= level), lambda on: F.struct(
                on.alias("on"), F.when(on, g["cut"]).otherwise(a["cut"]).alias("cut"))),
        )
        return reached["cut"].alias(f"cut_{name}")

    return per.select("stratum", *[chosen(n) for n in RATIOS])


def _with_verdict(rows: DataFrame, cutoffs: DataFrame, how: Risk) -> DataFrame:
    """Adds ``_kept``.  Cutoffs have a row per stratum; they are broadcast only while few."""
    cuts = written(cutoffs, "cutoffs").withColumnRenamed("stratum", "_cut_stratum")
    small = cuts.limit(10_001).count() <= 10_000
    out = rows.join(F.broadcast(cuts) if small else cuts, F.col("stratum").eqNullSafe(F.col("_cut_stratum")), "left")
    over = F.lit(False)
    for name in RATIOS:
        over = over | F.coalesce(ratio(name) > F.col(f"cut_{name}"), F.lit(False))
    return out.withColumn("_kept", ~base_failed(how) & ~over)


def judge(docs: DataFrame, labels: DataFrame, how: Risk = Risk()) -> DataFrame:
    """Counts and verdict per row of ``docs(doc_id, text, stratum)``; texts are read once."""
    rows = docs.select("doc_id", F.col("stratum").cast("string").alias("stratum"), measures(F.col("text")).alias("_m"))
    rows = written(rows, "measured")
    out = _with_verdict(rows, fit_cutoffs(rows, labels, how), how)
    return out.select("doc_id", "stratum", *[F.col(f"_m.{m}") for m in MEASURES], base_failed(how).alias("base_failed"), F.col("_kept").alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", how: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_row"), F.col("doc_id"), F.col(stratum).cast("string").alias("stratum"), measures(F.col("text")).alias("_m"))
    rows = written(rows, "measured-documents")
    narrow = rows.select("doc_id", "stratum", "_m")
    return _with_verdict(rows, fit_cutoffs(narrow, labels, how), how).where("_kept").select("_row.*")
