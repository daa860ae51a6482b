"""A recorded build model: JSON blocks between marker lines in a build's output, one for each build.

The block whose ``rootDir`` is the wanted root counts; none or several is an error.  Builds are not run.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

PROJECT = """path: string, dir: string, plugins: array<string>, androidPluginKind: string, projectDependencies: array<string>, projectDependenciesComplete: boolean,
android: struct<namespace: string, applicationId: string, minSdk: int, targetSdk: int, compileSdk: int, testInstrumentationRunner: string, buildTypes: array<string>,
  flavorDimensions: array<string>, productFlavors: array<struct<name: string, dimension: string, applicationIdSuffix: string>>,
  testOptions: struct<animationsDisabled: boolean, execution: string>, sourceSets: array<string>, unavailableProperties: array<string>>"""


def chosen_block(output: str, root: str | None) -> str:
    """The text of the block that counts."""
    blocks = [m[1].strip() for m in re.finditer(r"(?ms)^\S*MODEL_BEGIN\s*$(.*?)^\S*MODEL_END\s*$", output)]
    parsed = [(b, json.loads(b)) for b in blocks]
    wanted = [b for b, d in parsed if isinstance(d, dict) and isinstance(d.get("projects", []), list) and (root is None or d.get("rootDir") == root)]
    if len(wanted) != 1:
        raise ValueError(f"{len(wanted)} models for the requested root")
    return wanted[0]


def projects(spark: SparkSession, output: str, root: str | None = None) -> DataFrame:
    """One row per project in the model's order (``place``)."""
    text = spark.createDataFrame([(chosen_block(output, root),)], "j string")
    shape = f"struct<projects: array<struct<{PROJECT}>>>"
    parsed = text.select(F.from_json("j", shape, {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.posexplode("m.projects").alias("place", "p")).select("place", "p.*")
