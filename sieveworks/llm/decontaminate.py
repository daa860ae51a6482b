"""Benchmark decontamination by spaced seeds.

Words are runs of characters other than white space and the marks of :data:`SPLIT`, lower-cased, and are
compared by 64-bit hashes.  A mask says which of the words after a position count; the hash of those words
is a seed, which survives substitutions at the ignored places.  Seeds of the corpus are joined to those
of the benchmark; a hit fixes an alignment of a document and an item.  Around each alignment the words are
compared one by one: a match scores 1, a mismatch -4, and a run starts anew when its score falls below 0, so a
run is at least four fifths equal.  The document holds the item when a run has ``min_overlap`` equal
words, or all the item's words if it has fewer.

The default masks miss nothing that this rule accepts: a run of 13 equal words holds at most three
mismatches, there are 80 ways to place them, and each leaves all counted places of one of the two masks equal
(the tests go through them).  Items of fewer than ``min_overlap`` words must match in every word, so their
seed is the hash of all of them; the corpus is asked for windows of the lengths that such items have.

The benchmark's seeds are broadcast only while there are at most ``broadcast_seeds`` of them; beyond,
the join is a shuffle.  Items with equal words are compared once.  Only the words beside an item, cut
out of a document where the hit is found, go on to the comparison, and each alignment is one row.

Defined results: a null or empty text or item has no words and holds nothing; documents with equal id
and text are one case and repeated rows give repeated rows; a null id is kept; an empty table gives no
rows, an empty benchmark clears every document.  Other columns pass through :func:`keep_clean` and
are not read by :func:`contamination`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

SPLIT = "[\\x20\\x09-\\x0D.,;:!?\"()|]+"
MISMATCH = 4


@dataclass(frozen=True)
class Seeds:
    masks: tuple[str, ...] = ("111101011001", "1111011000101")
    min_overlap: int = 13
    broadcast_seeds: int = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def _hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds_of(rows: DataFrame, how: Seeds, lengths: list[int]) -> DataFrame:
    """``rows`` with an array ``_w`` of word hashes, once for each ``_pos`` and ``_seed`` of the masks
    and of windows of the ``lengths``.

    Positions are generated and hashed inside one generated loop, so the array is not copied.
    """
    at = F.col("_pos")
    rows = rows.where(F.size("_w") > 0).select("*", F.explode(F.sequence(F.lit(0), F.size("_w") - 1)).alias("_pos"))

    def seed(number: int, places: list[int], span: int) -> Column:
        return F.when(at + span <= F.size("_w"), F.xxhash64(F.lit(number), *[F.get("_w", at + p) for p in places]))

    seeds = [seed(k, [p for p, c in enumerate(mask) if c == "1"], len(mask)) for k, mask in enumerate(how.masks)]
    seeds += [seed(-n, list(range(n)), n) for n in lengths]
    return rows.select("*", F.explode(F.array(*seeds)).alias("_seed")).where("_seed IS NOT NULL")


def _keyed(docs: DataFrame) -> list[Column]:
    """A key without nulls for each distinct (id, text)."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("_h")]


def overlap(part: Column, item: Column, start: Column) -> Column:
    """Most equal words in a run of ``part`` against the item's words from ``start`` on."""
    zero = F.lit(0)

    def step(a: Column, same: Column) -> Column:
        score = a["score"] + F.when(same, F.lit(1)).otherwise(F.lit(-MISMATCH))
        equal = a["equal"] + same.cast("int")
        lives = score >= 0
        return F.struct(F.when(lives, score).otherwise(zero).alias("score"), F.when(lives, equal).otherwise(zero).alias("equal"), F.greatest(a["best"], F.when(lives, equal).otherwise(zero)).alias("best"))

    start_state = F.struct(zero.alias("score"), zero.alias("equal"), zero.alias("best"))
    return F.aggregate(F.transform(part, lambda w, j: w == F.get(item, j + start)), start_state, step)["best"]


def _cut(hits: DataFrame) -> DataFrame:
    """Distinct alignments of ``hits(_id, _h, _w, _pos, _first, _at, _n)`` with the document's words beside the item."""
    shift = F.col("_pos") - F.col("_at")
    start = F.greatest(F.lit(0), -shift)
    part = F.slice("_w", F.greatest(shift, F.lit(0)) + 1, F.least(F.col("_n"), F.size("_w") - shift) - start)
    return hits.select("_id", "_h", "_first", start.alias("_start"), part.alias("_part")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, how: Seeds = Seeds()) -> DataFrame:
    """``_id, _h, items, overlap`` for each contaminated (id, text): the items and the longest run."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    distinct = items.groupBy("_words").agg(F.min("item_id").alias("_first"), F.array_sort(F.collect_set("item_id")).alias("_all"))
    distinct = written(distinct.select("_first", "_all", F.transform("_words", lambda w: F.xxhash64(w)).alias("_item"), F.size("_words").alias("_n")), "benchmark-items")
    short = F.col("_n") < how.min_overlap
    lengths = sorted(r["_n"] for r in distinct.where(short).select("_n").distinct().collect())  # fewer than min_overlap rows
    bare = distinct.select("_first", "_n", F.col("_item").alias("_w"))
    test = seeds_of(bare.where(~short), how, [])
    for n in lengths:
        test = test.unionByName(seeds_of(bare.where(F.col("_n") == n), Seeds(()), [n]))
    test = written(test.select("_seed", "_first", "_n", F.col("_pos").alias("_at")), "benchmark-seeds")
    small = test.limit(how.broadcast_seeds + 1).count() <= how.broadcast_seeds

    hashed = docs.select(*_keyed(docs), _hashed(F.col("text")).alias("_w"))
    train = seeds_of(hashed, how, lengths)
    if small:
        cut = _cut(train.join(F.broadcast(test), "_seed"))
    else:
        hits = train.select("_id", "_h", "_pos", "_seed").join(test, "_seed").select("_id", "_h", "_first", "_n", (F.col("_pos") - F.col("_at")).alias("_pos"), F.lit(0).alias("_at")).distinct()
        cut = _cut(hashed.join(written(hits, "seed-hits"), ["_id", "_h"]))
    side = F.broadcast(distinct) if small else distinct
    scored = cut.join(side, "_first").select("_id", "_h", "_all", overlap(F.col("_part"), F.col("_item"), F.col("_start")).alias("_best"), "_n")
    held = scored.where(F.col("_best") >= F.least(F.col("_n"), F.lit(how.min_overlap)))
    return held.groupBy("_id", "_h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_all")))).alias("items"), F.max("_best").alias("overlap"))


def contamination(docs: DataFrame, benchmark: DataFrame, how: Seeds = Seeds()) -> DataFrame:
    """``doc_id, contaminated, items, overlap`` for each row of ``docs(doc_id, text)``."""
    held = written(overlaps(docs, benchmark, how), "contaminated")
    rows = docs.select("doc_id", *_keyed(docs)).join(held, ["_id", "_h"], "left")
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, how: Seeds = Seeds()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged."""
    held = written(overlaps(docs.select("doc_id", "text"), benchmark, how).select("_id", "_h"), "contaminated")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(whole, *_keyed(docs)).join(held.hint("merge"), ["_id", "_h"], "left_anti").select("_row.*")
