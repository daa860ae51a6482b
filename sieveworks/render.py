"""Markdown of a scan: one file for each layer, with a generated part between markers.

What stands before the markers is the reader's own and is kept.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from .functions.text import markdown_escape
from .plans.registry import LAYERS

BEGIN, END = "<!-- generated: begin -->", "<!-- generated: end -->"


def layer_texts(sections: DataFrame) -> dict[str, str]:
    """The generated text of each layer; sections in registry order."""
    safe = markdown_escape(F.col("summary"))
    line = F.format_string("### %s\n\n%s %s\n", F.col("title"), F.when(F.col("detected"), F.lit("[+]")).otherwise(F.lit("[-]")), safe)
    rows = sections.select("layer", F.struct("place", line.alias("t")).alias("s")).groupBy("layer").agg(F.array_sort(F.collect_list("s")).alias("all")).select("layer", F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("text"))
    texts = {r["layer"]: r["text"] for r in rows.collect()}
    return {layer: f"## {layer.split('_')[0]} {title}\n\n{texts.get(layer, '')}" for layer, title in LAYERS.items()}


def write_layers(sections: DataFrame, folder: str, fresh_headers: bool = False) -> None:
    """One file for each layer; what stands before the generated part stays, unless ``fresh_headers``."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    for layer, text in layer_texts(sections).items():
        path = target / f"{layer}.md"
        header = path.read_text("utf-8").partition(BEGIN)[0] if path.exists() and not fresh_headers else ""
        path.write_text(f"{header}{BEGIN}\n{text}\n{END}\n", "utf-8")


def digest_of(folder: Path, layer: str) -> str | None:
    """SHA-256 of the generated part of a layer's file; null if there is none."""
    path = folder / f"{layer}.md"
    text = path.read_text("utf-8") if path.exists() else ""
    return hashlib.sha256(text.partition(BEGIN)[2].encode()).hexdigest() if BEGIN in text else None
