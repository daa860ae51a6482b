"""Query 9 and its SQL, which simulates the schedule; the tests hold it against exact fractions too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .mixing import Mix, plan_mix

HOW = Mix()


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan_mix(docs, HOW, carry=["doc_id", "source"]).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), F.col("_start").alias("start"), F.col("_block").alias("block"),
        F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"),
    )


#: Slot by slot over lists of the sources: of the next blocks that are released the one due first, then the first name.
OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s:' || source, 'null') AS name, greatest(strlen(coalesce(text, '')), 1)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
placed AS (SELECT doc_id, source, name, (sum(size) OVER (PARTITION BY name ORDER BY key ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d),
s AS (SELECT name, sqrt(sum(size)) AS w, ceil(sum(size) / {HOW.block_bytes}.0)::BIGINT AS blocks FROM d GROUP BY name),
c AS (SELECT list(name ORDER BY name) AS names, list(w ORDER BY name) AS ws, list(blocks ORDER BY name) AS bs, sum(w ORDER BY name) AS total, count(*) AS n FROM s),
sim AS (
    SELECT -1::BIGINT AS slot, list_transform(range(1, n + 1), lambda i: 0::BIGINT) AS done, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS release, 0::BIGINT AS deadline FROM c
    UNION ALL
    SELECT t, list_transform(range(1, n + 1), lambda k: done[k] + (k = best.i)::BIGINT), best.i, done[best.i], best.r, best.d
    FROM (SELECT *, list_sort(list_filter(cand, lambda x: x.r <= t))[1] AS best
        FROM (SELECT *, greatest(slot + 1, list_min(list_transform(cand, lambda x: x.r))) AS t
            FROM (SELECT slot, done, n, list_transform(list_filter(range(1, n + 1), lambda i: done[i] < bs[i]), lambda i: {{'d': ceil((done[i] + 1) * total / ws[i])::BIGINT, 'i': i, 'r': floor(done[i] * total / ws[i])::BIGINT}}) AS cand FROM sim CROSS JOIN c)
            WHERE len(cand) > 0))
),
slots AS (SELECT names[i] AS name, j AS block, release, deadline, slot FROM sim CROSS JOIN c WHERE slot >= 0)
SELECT doc_id, source, start, start // {HOW.block_bytes} AS block, release, deadline, slot FROM placed p JOIN slots b ON b.name = p.name AND b.block = p.start // {HOW.block_bytes}
"""

QUERIES = {"op9_mixing": op9_mixing}
SQL = {"op9_mixing": OP9_SQL}
