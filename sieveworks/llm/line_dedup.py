"""Line dedup by winnowing.

The lines of a text that hold a word are hashed.  A window begins at each of them and takes lines until it has
``window`` lines or ``long_words`` words; what is shorter than that counts as no repetition.  The least hash of
a window (the last of equals) is its fingerprint.  A line that is least in several windows is one fingerprint,
so only these minima are kept, each with its place, the hashes of the lines around it and the windows that it
stands for.  Documents that share a window share its fingerprint at the same place in it.

1. Fingerprints at more than one place are joined to their first place in the corpus, in the order of
   document id (then text) and line.  From there the match is extended to the left and right, line by line.
   A window inside the extended match is a repeat; it is deleted with the lines beside it that the match
   reaches, up to ``window`` - 1 on either side.  Beyond those a match consists of further windows, which have fingerprints
   of their own, so a repeated run goes whole.
2. A fingerprint whose first place lies among other lines explains nothing.  Windows that step 1 leaves open are joined to
   the first place where the same window is open, by a hash of all their lines, and extended in the same way.

So exactly those windows are deleted that occur earlier.  No pairs of places are made: each place is compared
with one first place, found by an aggregate that is combined before its shuffle.  The joins are sort-merge
joins at every size, as none of their sides has a bound; AQE splits them where one line has a large share of
the places.

Defined results: null and empty texts have no lines and stay as they are; lines without a word are never
deleted; equal texts are one after another, so all but the first lose every window; rows equal in id and
text have the same place in the order and get the same result.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WS, let, written


@dataclass(frozen=True)
class Winnow:
    window: int = 3
    long_words: int = 25


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("_h")]


def _words(line: Column) -> Column:
    return let(F.split(line, WS), lambda s: F.size(s) - (F.get(s, F.lit(0)) == "").cast("int") - (F.element_at(s, -1) == "").cast("int"))


def _windows(lines: Column, how: Winnow) -> Column:
    """``p, f, t`` of each window of ``lines(a, at, words)``: numbers of its least, first and last line."""

    def at(i: Column) -> Column:
        cut = [F.get(lines, i + k) for k in range(how.window)]
        so_far = cut[0]["words"]
        ends = F.when(so_far >= how.long_words, F.lit(0))
        for k in range(1, how.window):
            so_far = so_far + cut[k]["words"]
            ends = ends.when((so_far >= how.long_words) if k < how.window - 1 else cut[k].isNotNull(), F.lit(k))

        def found(last: Column) -> Column:
            least = F.array_min(F.transform(F.sequence(F.lit(0), last), lambda k: let(F.get(lines, i + k), lambda x: F.struct(x["a"].alias("a"), (-i - k).alias("p")))))
            return F.when(last.isNotNull(), F.struct((-least["p"]).alias("p"), i.alias("f"), (i + last).alias("t")))

        return let(ends, found)

    return F.array_compact(F.transform(lines, lambda _, i: at(i)))


def minima(docs: DataFrame, how: Winnow) -> DataFrame:
    """``_id, _h, _print, _place, _c, _a, _at, _windows``: each fingerprint, its line number, its index in
    the hashes and numbers of the lines around it, and first and last index of its windows."""
    numbered = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    worded = F.filter(numbered, lambda x: x["line"].rlike("[^\\x20\\x09-\\x0D]"))
    hashed = F.transform(worded, lambda x: F.struct(F.xxhash64(x["line"]).alias("a"), x["at"].alias("at"), _words(x["line"]).alias("words")))
    reach = 2 * (how.window - 1)

    def prints(x: Column) -> Column:
        first = F.filter(x["ws"], lambda w, i: ~F.coalesce(F.get(x["ws"], i - 1)["p"] == w["p"], F.lit(False)))

        def one(w: Column) -> Column:
            begin = F.greatest(w["p"] - reach, F.lit(0))
            mine = F.filter(F.slice(x["ws"], w["f"] + 1, how.window), lambda y: y["p"] == w["p"])
            return F.struct(
                F.get(x["a"], w["p"]).alias("_print"),
                F.get(x["at"], w["p"]).alias("_place"),
                (w["p"] - begin).alias("_c"),
                F.slice(x["a"], begin + 1, w["p"] - begin + 1 + reach).alias("_a"),
                F.slice(x["at"], begin + 1, w["p"] - begin + 1 + reach).alias("_at"),
                F.transform(mine, lambda y: F.struct((y["f"] - begin).alias("f"), (y["t"] - begin).alias("t"))).alias("_windows"),
            )

        return F.transform(first, one)

    whole = let(hashed, lambda ls: let(F.struct(F.transform(ls, lambda l: l["a"]).alias("a"), F.transform(ls, lambda l: l["at"]).alias("at"), _windows(ls, how).alias("ws")), prints))
    return docs.select(*_key(), F.explode(whole).alias("_p")).select("_id", "_h", "_p.*")


def _equal_lines(a: Column, i: Column, b: Column, j: Column, step: int, most: int) -> Column:
    """How many lines in a row, ``most`` at most, are equal from index i of a and j of b on."""
    out = F.lit(most)
    for k in reversed(range(most)):
        out = F.when(F.get(a, i + step * k) == F.get(b, j + step * k), out).otherwise(F.lit(k))
    return out


def repeated_lines(docs: DataFrame, how: Winnow = Winnow()) -> DataFrame:
    """``_id, _h, removed``: for each (id, text) with repeats, the numbers of the deleted lines (from 0)."""
    prints, beside = written(minima(docs, how), "line-fingerprints"), how.window - 1
    place = F.struct("_id", "_h", "_place", F.col("_c").alias("c"), F.col("_a").alias("a"))
    first = prints.groupBy("_print").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = written(first, "first-places")
    later = prints.join(first.hint("merge"), "_print").where(F.struct("_id", "_h", "_place") != F.struct("_first._id", "_first._h", "_first._place"))
    c, g = F.col("_c"), F.col("_first.c")
    left = _equal_lines(F.col("_a"), c - 1, F.col("_first.a"), g - 1, -1, 2 * beside)
    right = _equal_lines(F.col("_a"), c + 1, F.col("_first.a"), g + 1, 1, 2 * beside)
    reached = later.select("_id", "_h", "_c", "_a", "_at", F.explode("_windows").alias("_w"), (c - left).alias("_l"), (c + right).alias("_r")).select("*", "_w.f", "_w.t")
    reached = written(reached.select(
        "_id", "_h", "_a", "_at", "f", "t",
        F.when((F.col("_l") <= F.col("f")) & (F.col("_r") >= F.col("t")), F.struct(F.greatest(F.col("_l"), F.col("f") - beside).alias("from"), F.least(F.col("_r"), F.col("t") + beside).alias("to"))).alias("_match"),
    ), "extended-matches")

    def lines(matches: DataFrame) -> DataFrame:
        return matches.select("_id", "_h", F.slice("_at", F.col("_match.from") + 1, F.col("_match.to") - F.col("_match.from") + 1).alias("_gone"))

    own = F.slice("_a", F.col("f") + 1, F.col("t") - F.col("f") + 1)
    rest = reached.where("_match IS NULL").select("*", F.xxhash64(own).alias("_w1"), F.xxhash64(F.lit(1), own).alias("_w2"), F.get("_at", F.col("f")).alias("_from"))
    whole = F.struct("_id", "_h", "_from", F.col("f").alias("f"), F.col("t").alias("t"), F.col("_a").alias("a"))
    opened = rest.groupBy("_w1", "_w2").agg(F.min(whole).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = rest.join(written(opened, "first-windows").hint("merge"), ["_w1", "_w2"]).where(F.struct("_id", "_h", "_from") != F.struct("_first._id", "_first._h", "_first._from"))
    left = _equal_lines(F.col("_a"), F.col("f") - 1, F.col("_first.a"), F.col("_first.f") - 1, -1, beside)
    right = _equal_lines(F.col("_a"), F.col("t") + 1, F.col("_first.a"), F.col("_first.t") + 1, 1, beside)
    again = again.withColumn("_match", F.struct((F.col("f") - left).alias("from"), (F.col("t") + right).alias("to")))
    gone = lines(reached.where("_match IS NOT NULL")).unionByName(lines(again))
    return gone.groupBy("_id", "_h").agg(F.collect_set("_gone").alias("_gone")).select("_id", "_h", F.array_sort(F.array_distinct(F.flatten("_gone"))).alias("removed"))


def dedup_lines(docs: DataFrame, how: Winnow = Winnow()) -> DataFrame:
    """``doc_id, text, n_lines, removed`` for each row of ``docs(doc_id, text)``; ``text`` is what stays."""
    removed = written(repeated_lines(docs, how), "repeated-lines")
    rows = docs.select("doc_id", "text", *_key()).join(removed.hint("merge"), ["_id", "_h"], "left")

    def stay(r: Column) -> Column:
        """Lines between deleted ones, by slices: removed is sorted."""
        lines, gone = lines_of(r["text"]), r["removed"]
        edges = F.concat(gone, F.array(F.size(lines)))
        return let(F.struct(lines.alias("l"), edges.alias("e")), lambda x: F.array_join(F.flatten(F.transform(
            x["e"], lambda e, i: F.slice(x["l"], F.coalesce(F.get(x["e"], i - 1) + 2, F.lit(1)), F.when(i == 0, e).otherwise(e - F.get(x["e"], i - 1) - 1)))), "\n"))

    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(let(F.struct("removed", "text"), stay))
    return rows.select("doc_id", kept.alias("text"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
