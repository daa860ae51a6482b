"""Mixing sources to target weights by Pfair scheduling.

Each source is a task whose weight is its target share; its documents, in the order of a digest of id and text, are
cut into blocks of ``block_bytes``.  Block j of a source of weight w is released at floor(j / w) and
due by ceil((j + 1) / w); slots go to the released block with the earliest deadline.  At every slot the
blocks given to a source differ from its weight times the slots so far by less than one.

Weights are exact fractions, releases and deadlines whole numbers computed from them, and every block that
exists is scheduled, so the deviation does not grow with the corpus.  One task writes the schedule, a row
per block, in a stream; it holds a row per source.  Blocks are as much larger as it takes for ``most_blocks`` of
them to hold the corpus (from 1 TiB on), so that task's work is bounded; the deviation stays below one block.  Blocks of a source that has run out are not scheduled;
the windows of the others do not move.

Block numbers need a running sum of bytes inside each source.  A source is cut into buckets by
digest, of at most about ``bucket_bytes`` each and at least ``buckets`` of them; sums run inside a bucket,
and each bucket starts where the totals of those before it end.  So a source with a third of all rows is
spread over all tasks, and no window grows with the corpus.

Defined results: nothing is dropped; a source that has run out leaves its slots empty.  A null source is
a source of its own; a null or empty text counts one byte; equal ids with other texts are other documents, and
identical rows keep separate places.  Sources beyond the ``max_sources`` largest are scheduled as one
stream with the sum of their weights, and lie in it by digest, so in proportion to their bytes; sources without a
given weight make such a stream with the least weight of the others.  It exists only where they do.
An empty table gives no rows.  Other columns pass through :func:`mixed`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import written


@dataclass(frozen=True)
class Mix:
    """``weights``: target share per source; where None, shares follow bytes to the power ``temper``.

    ``period`` is the length of a schedule in :func:`whole_shares`; the mix itself does not repeat one.
    """

    weights: dict[str, float] | None = None
    temper: float = 0.5
    block_bytes: int = 65536
    most_blocks: int = 1 << 24
    period: int = 1024
    buckets: int = 256
    bucket_bytes: int = 16 << 20
    max_sources: int = 10_000


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Shares of the period by largest remainder, one at least for a positive weight."""
    weights = {s: w for s, w in weights.items() if w > 0}
    if not weights:
        return {}
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: 1 + (period - len(weights)) * w / total for s, w in weights.items()}
    shares = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (shares[s] - exact[s], s))[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def exact_weights(weights: dict[str, float]) -> dict[str, int]:
    """The positive weights as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def schedule(streams: list[tuple[str, int, int]], total: int) -> Iterator[tuple[str, int, int, int, int]]:
    """``name, block, release, deadline, slot`` of the blocks of ``(name, weight, blocks)``, slots ascending.

    Weights are shares of ``total``.  The earliest deadline goes first; slots without a released block stay empty.
    """
    waiting = [(0, i, 0) for i, (_, _, blocks) in enumerate(streams) if blocks]
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // streams[i][1]), i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        name, weight, blocks = streams[i]
        yield name, j, release, deadline, slot
        slot += 1
        if j + 1 < blocks:
            heapq.heappush(waiting, ((j + 1) * total // weight, i, j + 1))


def one_period(shares: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """``source, block, release, deadline, slot`` over one period, earliest deadline first."""
    return list(schedule([(s, shares[s], shares[s]) for s in sorted(shares)], sum(shares.values())))


def _slots(spark: SparkSession, weights: dict[str, int], blocks: dict[str, int]) -> DataFrame:
    """``_stream, _block, _r, _d, _t``: the schedule of ``blocks`` by stream, written by one task."""
    total = sum(weights.values())
    streams = [(s, w, blocks[s]) for s, w in sorted(weights.items()) if s in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rows = schedule(streams, total)
            while part := list(islice(rows, 65536)):
                columns = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(next(columns), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["_stream", "_block", "_r", "_d", "_t"])

    one = spark.range(0, 1, 1, 1)
    return written(one.mapInArrow(run, "_stream string, _block long, _r long, _d long, _t long"), "mix-slots")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def plan_mix(docs: DataFrame, how: Mix = Mix(), source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (``doc_id``, ``text`` and more), its ``carry`` columns (all) packed in ``_row``, with its place in the mix.

    Adds ``_source, _start, _block, _release, _deadline, _slot``; ``_start`` counts the bytes of the
    stream before the document.  Texts move only if they are carried.
    """
    spark = docs.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("_row")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    size = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long")
    whole_bytes = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    block_bytes = max(how.block_bytes, -(-whole_bytes // how.most_blocks))
    buckets = max(how.buckets, -(-whole_bytes // how.bucket_bytes))
    share = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2.0**32  # ascends with the key
    bucket = F.floor(share * buckets).cast("int")
    rows = docs.select(_source_key(F.col(source)).alias("_source"), bucket.alias("_bucket"), key.alias("_key"), size.alias("_size"), whole)

    totals = written(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_total")), "mix-totals")
    if how.weights is None:
        roots = totals.groupBy("_source").agg(F.sum("_total").alias("bytes"))
        sources = roots.orderBy(F.desc("bytes"), "_source").limit(how.max_sources).collect()
        weights = {r["_source"]: float(r["bytes"]) ** how.temper for r in sources}
    else:
        weights = {f"s:{s}": w for s, w in how.weights.items() if w > 0}
    single = spark.createDataFrame([(s, s) for s in weights], "_source string, _known string")

    # bounded by max_sources
    named = totals.join(F.broadcast(single), "_source", "left").withColumn("_stream", F.coalesce("_known", F.lit("rest")))
    blocks = {r["_stream"]: -(-r["bytes"] // block_bytes) for r in named.groupBy("_stream").agg(F.sum("_total").alias("bytes")).collect()}
    if "rest" in blocks:
        others = named.where("_stream = 'rest'").groupBy("_source").agg(F.sum("_total").alias("bytes")).agg(F.sum(F.pow(F.col("bytes").cast("double"), F.lit(how.temper))))
        weights["rest"] = others.first()[0] if how.weights is None else min(weights.values(), default=1.0)
    slots = _slots(spark, exact_weights(weights), blocks)

    # what a bucket needs of the schedule: the blocks from its first byte to its last
    before = Window.partitionBy("_stream").orderBy("_bucket", "_source").rowsBetween(Window.unboundedPreceding, -1)
    bases = named.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long")))
    met = F.sequence(F.expr(f"_base div {block_bytes}"), F.expr(f"(_base + _total - 1) div {block_bytes}"))
    spans = bases.select("_source", "_bucket", "_stream", "_base", F.explode(met).alias("_block")).join(slots, ["_stream", "_block"])
    plans = spans.groupBy("_source", "_bucket").agg(F.min("_base").alias("_base"), F.array_sort(F.collect_list(F.struct("_block", "_r", "_d", "_t"))).alias("_plan"))

    inside = Window.partitionBy("_source", "_bucket").orderBy("_key")
    summed = rows.withColumn("_upto", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = summed.join(plans, ["_source", "_bucket"]).withColumn("_start", F.col("_base") + F.col("_upto") - F.col("_size"))
    placed = placed.withColumn("_block", F.expr(f"_start div {block_bytes}")).withColumn("_at", F.expr("get(_plan, cast(_block - _plan[0]._block AS int))"))
    return placed.select("_row", "_source", "_start", "_block", F.col("_at._r").alias("_release"), F.col("_at._d").alias("_deadline"), F.col("_at._t").alias("_slot"))


def mixed(docs: DataFrame, how: Mix = Mix(), source: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` in the order of the mix: files, and rows in them, ascend by slot."""
    placed = plan_mix(docs, how, source)
    return placed.repartitionByRange("_slot", "_start").sortWithinPartitions("_slot", "_start", F.col("_row.doc_id")).select("_row.*")
