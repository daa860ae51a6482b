"""Token counts of whole texts without token ids.

A byte-level tokenizer cuts a text into pre-tokens and each pre-token into pieces on its own.  So
the pieces of each distinct pre-token of the corpus are counted once, that table is joined to the
pre-token frequencies of each document, and the products are summed.

The join is split by a bound: the most frequent pre-tokens of at most ``HEAD_CHARS`` characters, at
most ``head`` of them, travel to every task and are summed where the frequencies are made; only the
rarer pre-tokens of a document are shuffled to their counts.  A histogram over steps of the
frequency (a few hundred rows) says from which frequency on there are no more than ``head``, so the
driver gets that many rows at most, whatever the partitions.  The result does not depend on ``head``.

Defined results: a null text counts as empty (no bytes, no tokens); rows with equal id and text
each get their count; a null id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written
from .tokenizing import count_pieces, pre_tokens

HEAD_CHARS = 64
#: Steps of the frequency histogram for each doubling.
STEPS = 8
FLUSH = 200_000


def piece_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``pre_token, n, pieces``: every distinct pre-token of ``docs(text)``, pieces counted once."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(pre_tokens(vocabulary, text.as_py() or ""))
                if len(counts) > FLUSH:
                    yield _counts(counts)
                    counts = Counter()
        if counts:
            yield _counts(counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = count_pieces(vocabulary, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], names=["pre_token", "n", "pieces"])

    parts = docs.select("text").mapInArrow(seen, "pre_token string, n long")
    distinct = parts.groupBy("pre_token").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(count, "pre_token string, n long, pieces long")


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["pre_token", "n"])


_FREQ = "doc_id long, text_key long, n_bytes long, known long, rest array<struct<pre_token:string,n:long>>"
_REST = pa.list_(pa.struct([("pre_token", pa.string()), ("n", pa.int64())]))


def frequent_pieces(pieces: DataFrame, head: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: all above some frequency, at most ``head``."""
    short = pieces.where(F.length("pre_token") <= HEAD_CHARS).withColumn("step", F.floor(F.log2("n") * STEPS))
    total, least = 0, None
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > head:
            break
        least = r["step"]
    if least is None:
        return {}
    found = short.where(F.col("step") >= least).select("pre_token", "pieces").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


def token_counts(docs: DataFrame, vocabulary: str, limit: int, head: int = 250_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    pieces = written(piece_table(docs, vocabulary), "pre-tokens")
    shared = spark.sparkContext.broadcast(frequent_pieces(pieces, head))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_pieces = shared.value
        for batch in batches:
            size, total, rest = [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                counts, tail, tokens = Counter(pre_tokens(vocabulary, text)), [], 0
                for p, n in counts.items():
                    k = head_pieces.get(p)
                    if k is None:
                        tail.append({"pre_token": p, "n": n})
                    else:
                        tokens += k * n
                size.append(len(text.encode("utf-8", "replace")))
                total.append(tokens)
                rest.append(tail)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, _REST)],
                names=["doc_id", "text_key", "n_bytes", "known", "rest"],
            )

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    freq = written(keyed.mapInArrow(frequencies, _FREQ), "pre-token-frequencies")
    summed = freq.select("doc_id", "text_key", "n_bytes", "known", F.lit(1).cast("long").alias("rows"))
    rare = freq.select("doc_id", "text_key", F.explode("rest").alias("p")).select("doc_id", "text_key", "p.*")
    counted = rare.join(pieces.select("pre_token", "pieces"), "pre_token").groupBy("doc_id", "text_key").agg(F.sum(F.col("n") * F.col("pieces")).alias("known"))
    zero = F.lit(0).cast("long")
    both = summed.unionByName(counted.select("doc_id", "text_key", zero.alias("n_bytes"), "known", zero.alias("rows")))
    totals = both.groupBy("doc_id", "text_key").agg(F.sum("n_bytes").alias("b"), F.sum("known").alias("t"), F.sum("rows").alias("r"))
    each = totals.select("doc_id", (F.col("b") / F.col("r")).cast("long").alias("n_bytes"), (F.col("t") / F.col("r")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("r"))).alias("_copy"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
