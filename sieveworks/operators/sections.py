"""Sections from evidence: validity, caps that keep totals, overrides, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EVIDENCE_LIMIT = 25


def valid_evidence() -> Column:
    """Whether an evidence row proves its range: one of the three provenance shapes."""
    lines = (F.col("provenance") == "source_lines") & F.col("path").isNotNull() & (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & (F.col("source_line_count") >= F.col("line_end")) & F.col("source_digest").rlike("^[0-9a-f]{64}$")
    whole = (F.col("provenance") == "file") & F.col("path").isNotNull() & F.col("line_start").isNull() & F.col("line_end").isNull()
    model = (F.col("provenance") == "gradle_model") & F.col("project").isNotNull() & F.col("property").isNotNull() & F.col("path").isNull() & F.col("line_start").isNull()
    return F.coalesce(lines | whole | model, F.lit(False))


def accepted(evidence: DataFrame) -> DataFrame:
    return evidence.where(valid_evidence())


def rejections(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rejected, error``: how many rows failed, and the text that says so."""
    counted = evidence.groupBy(*keys).agg(F.count_if(~valid_evidence()).alias("rejected"))
    text = F.format_string("Omitted %d invalid evidence entries", F.col("rejected"))
    return counted.withColumn("error", F.when(F.col("rejected") > 0, text))


def capped_evidence(evidence: DataFrame, keys: list[str], order: list[Column], limit: int | None = EVIDENCE_LIMIT) -> DataFrame:
    """The first rows of each section, ``ordinal`` from 0, with the section's ``evidence_total`` before the cut."""
    total = evidence.groupBy(*keys).agg(F.count("*").alias("evidence_total"))
    numbered = evidence.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = numbered.where(F.col("_n") <= limit) if limit else numbered
    return kept.withColumn("ordinal", F.col("_n").cast("long") - 1).drop("_n").join(total, keys)


def merged(sections: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``sections`` with the override's columns where there is one."""
    right = overrides.select(*keys, F.struct(*columns).alias("_other"))
    out = sections.join(right, keys, "left")
    return out.select(*keys, *[F.when(F.col("_other").isNotNull(), F.col(f"_other.{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.col("_other").isNotNull().alias("overridden"))


def layer_rollup(sections: DataFrame) -> DataFrame:
    """``layer, sections, detected`` counts."""
    return sections.groupBy("layer").agg(F.count("*").alias("sections"), F.count_if(F.col("detected")).alias("detected"))


def highlights(sections: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """The listed sections that are detected, ``rank`` as listed."""
    spark = sections.sparkSession
    listed = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(keys)], "layer string, section string, rank int")
    return sections.where("detected").join(F.broadcast(listed), ["layer", "section"])


def undetected(sections: DataFrame) -> DataFrame:
    return sections.where(~F.coalesce(F.col("detected"), F.lit(False)))
