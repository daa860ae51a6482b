"""Identifier-aware BM25 search.

Statistics (documents, document frequency, average length) cover the whole collection; a layer
filter stays above them.  Only the query's terms are counted, inside each document's row, and
kept, so a search is one scan and a top-k without a shuffle of postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.text import name_tokens
from ..sources.corpus import spread

K1, B, DETECTED_BOOST = 1.5, 0.75, 1.35

#: Question words that carry no signal.
STOP_WORDS = (
    "a an and any are be by can do does find for from get has have how i in is it its me of on or our show"
    " that the their there this to use used uses we what when where which who why with you your"
).split()


@dataclass(frozen=True)
class Bm25:
    k1: float = K1
    b: float = B
    boost: float = DETECTED_BOOST


def query_terms(query: str) -> list[str]:
    """Distinct terms in query order, stop words dropped unless there is nothing else."""
    import re

    tokens: list[str] = []
    for run in re.findall("[A-Za-z0-9]+", query):
        spaced = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", run)).lower().split(" ")
        tokens += [run.lower(), *(spaced if len(spaced) > 1 else [])]
    kept = [t for t in tokens if t not in STOP_WORDS]
    return list(dict.fromkeys(kept or tokens))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``: texts are shuffled by key, so that postings are counted where they are made and not shuffled."""
    return spread(docs.select(key, text), key).select(key, F.explode(name_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``term, df``: each document's distinct terms, so no postings are shuffled."""
    return docs.select(F.explode(F.array_distinct(name_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _score(terms: list[str], df: dict[str, int], n: int, average: float, how: Bm25) -> Column:
    import math

    total = F.lit(0.0)
    norm = 1 - how.b + how.b * (F.col("length") / average if average else F.lit(1.0))
    for i, t in enumerate(terms):
        tf = F.get("tfs", F.lit(i)).cast("double")
        idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        total = total + F.when(tf > 0, F.lit(idf) * tf * (how.k1 + 1) / (tf + how.k1 * norm)).otherwise(F.lit(0.0))
    return total


def search(docs: DataFrame, query: str, key: list[str], text: str, limit: int | None, detected: Column | None = None, where: Column | None = None, how: Bm25 = Bm25()) -> DataFrame:
    """``key, score, matched_terms``, best first, ties by key; scores rounded to 6 places.

    ``detected`` boosts, ``where`` filters after the statistics.  The statistics are one row.
    """
    terms = query_terms(query)
    tokens = docs.select(*key, (detected if detected is not None else F.lit(False)).alias("_detected"), (where if where is not None else F.lit(True)).alias("_inside"), name_tokens(F.col(text)).alias("_tokens"))

    def tf(t: str) -> Column:
        return F.size(F.filter("_tokens", lambda x: x == t))

    counted = tokens.select(*key, "_detected", "_inside", F.size("_tokens").alias("length"), F.array(*[tf(t) for t in terms]).cast("array<int>").alias("tfs"))
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)  # a few numbers for each document; texts are tokenised once
    stats = counted.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"), *[F.count_if(F.get("tfs", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    df = {t: stats[f"df{i}"] for i, t in enumerate(terms)}
    scored = counted.where("_inside").withColumn("score", _score(terms, df, stats["n"], stats["average"], how))
    boosted = F.when(F.coalesce(F.col("_detected"), F.lit(False)), F.col("score") * how.boost).otherwise(F.col("score"))
    names = F.array(*[F.when(F.get("tfs", F.lit(i)) > 0, F.lit(t)) for i, t in enumerate(terms)]).cast("array<string>")
    out = scored.where("score > 0").select(*key, F.round(boosted, 6).alias("score"), F.array_join(F.array_compact(names), " ").alias("matched_terms"))
    ordered = out.orderBy(F.desc("score"), *key)
    return ordered if limit is None else ordered.limit(limit)
