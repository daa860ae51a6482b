"""Sections that a recorded build model answers better than patterns, and their merge into a scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _kind() -> Column:
    """Kind of a project: what its plugin says, else what its plugins imply."""
    has = lambda p: F.array_contains("plugins", p)
    return F.coalesce(
        "androidPluginKind",
        F.when(has("com.android.application"), "application").when(has("com.android.library"), "library").when(has("java-library") | has("org.jetbrains.kotlin.jvm"), "jvm-library").otherwise("other"),
    )


def complete(projects: DataFrame, needed: list[str]) -> DataFrame:
    """``complete``: there are projects, all report what is unavailable, and nothing needed is."""
    missing = F.col("android.unavailableProperties")
    holds = F.col("android").isNotNull() & missing.isNotNull() & ~F.arrays_overlap(missing, F.array(*[F.lit(n) for n in needed]))
    return projects.agg(F.coalesce(F.bool_and(F.coalesce(holds, F.lit(False))), F.lit(False)).alias("complete"))


def _state(done: Column) -> Column:
    return F.when(done, "complete").otherwise("unknown")


def sections(projects: DataFrame) -> DataFrame:
    """``layer, section, summary, items, completeness`` of the sections the model answers; empty ones are left out.

    The root project counts for edges but is no module; an edge to itself is none.
    """
    typed = projects.withColumn("kind", _kind())
    modules = typed.where("path <> ':'")
    apps = typed.where("kind = 'application' AND android IS NOT NULL")
    out = []

    def add(layer: str, section: str, rows: DataFrame, summary: Column, items: Column, done: Column) -> None:
        out.append(rows.select(F.lit(layer).alias("layer"), F.lit(section).alias("section"), summary.alias("summary"), items.alias("items"), done.alias("completeness")).where(F.size("items") > 0))

    listed = modules.agg(F.array_sort(F.collect_list("path")).alias("i"))
    add("04_modules_map", "full_module_list", listed, F.format_string("%d modules configured by Gradle", F.size("i")), F.col("i"), F.lit("complete"))

    groups = modules.groupBy("kind").agg(F.array_sort(F.collect_list("path")).alias("p")).agg(F.array_sort(F.collect_list(F.struct("kind", "p"))).alias("g"))
    told = F.array_join(F.transform("g", lambda g: F.format_string("%s: %d", g["kind"], F.size(g["p"]))), ", ")
    add("04_modules_map", "module_classification", groups, told, F.flatten(F.transform("g", lambda g: F.transform(g["p"], lambda p: F.concat(p, F.lit(" - "), g["kind"])))), F.lit("complete"))

    pairs = typed.select("path", F.explode("projectDependencies").alias("d")).where("d <> path").agg(F.array_sort(F.collect_list(F.concat("path", F.lit(" -> "), "d"))).alias("i"))
    whole = typed.agg(F.count("*").alias("n"), F.bool_and(F.coalesce("projectDependenciesComplete", F.lit(False))).alias("c"))
    add("04_modules_map", "module_dependency_graph", pairs.crossJoin(whole), F.format_string("%d dependencies between %d modules", F.size("i"), "n"), F.col("i"), _state(F.col("c")))

    types, dimensions, flavors = F.coalesce("android.buildTypes", F.array()), F.coalesce("android.flavorDimensions", F.array()), F.col("android.productFlavors")
    names = F.coalesce(F.transform(flavors, lambda f: f["name"]), F.array().cast("array<string>"))
    pieces = F.array_compact(F.array(
        F.when(F.size(types) > 0, F.concat(F.lit("build types: "), F.array_join(types, ", "))),
        F.when(F.size(dimensions) > 0, F.concat(F.lit("dimensions: "), F.array_join(dimensions, ", "))),
        F.when(F.size(names) > 0, F.concat(F.size(names).cast("string"), F.lit(" flavours: "), F.array_join(names, ", "))),
    ))
    variant_items = F.concat(
        F.transform(types, lambda t: F.concat("path", F.lit(" - build type: "), t)),
        F.coalesce(F.transform(flavors, lambda f: F.concat("path", F.lit(" - flavour: "), f["name"], F.coalesce(F.concat(F.lit(" (dimension "), f["dimension"], F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(", applicationIdSuffix "), f["applicationIdSuffix"]), F.lit("")))), F.array().cast("array<string>")),
    )
    per = apps.select("place", F.when(F.size(pieces) > 0, F.concat("path", F.lit(" ("), F.array_join(pieces, "; "), F.lit(")"))).alias("t"), variant_items.alias("i"))
    add("02_build_and_run", "build_types_flavors_dimensions", _ordered(per).crossJoin(complete(apps, ["buildTypes", "flavorDimensions", "productFlavors"])), F.col("t"), F.col("i"), _state(F.col("complete")))

    suffixes = F.size(F.filter(flavors, lambda f: f["applicationIdSuffix"].isNotNull()))
    said = F.concat("path", F.lit(": "), F.size(names).cast("string"), F.lit(" product flavours"), F.when(F.size(dimensions) > 0, F.concat(F.lit(" across dimensions "), F.array_join(dimensions, ", "))).otherwise(F.lit("")), F.when(suffixes > 0, F.concat(F.lit("; "), suffixes.cast("string"), F.lit(" with applicationId suffix"))).otherwise(F.lit("")))
    brands = apps.where(F.size(names) > 0).select("place", said.alias("t"), F.transform(names, lambda n: F.concat("path", F.lit(" - "), n)).alias("i"))
    add("01_overview", "brands_flavors_presence", _ordered(brands).crossJoin(complete(apps, ["productFlavors"])), F.col("t"), F.col("i"), _state(F.col("complete")))

    animations = F.when(F.col("android.testOptions.animationsDisabled"), "True").when(~F.col("android.testOptions.animationsDisabled"), "False")
    values = [("testInstrumentationRunner", F.col("android.testInstrumentationRunner")), ("testOptions.execution", F.col("android.testOptions.execution")), ("testOptions.animationsDisabled", animations)]
    knobs = F.array_compact(F.array(*[F.concat("path", F.lit(f" - {n} = "), v) for n, v in values]))
    tests = apps.select("place", F.array_join(knobs, "; ").alias("t"), knobs.alias("i")).where(F.size("i") > 0)
    add("07_testing", "test_config_knobs", _ordered(tests).crossJoin(complete(apps, ["testInstrumentationRunner", "testOptions"])), F.concat(F.lit("Observed Gradle test configuration: "), F.col("t")), F.col("i"), _state(F.col("complete")))
    return reduce(DataFrame.unionByName, out)


def _ordered(rows: DataFrame) -> DataFrame:
    """Texts and items of all projects in the model's order, as one row."""
    listed = F.array_sort(F.collect_list(F.struct("place", "t", "i")))
    one = rows.agg(listed.alias("all"))
    return one.select(F.array_join(F.transform("all", lambda x: x["t"]), "; ").alias("t"), F.flatten(F.transform("all", lambda x: x["i"])).alias("i"))


def with_model(scanned: DataFrame, answered: DataFrame) -> DataFrame:
    """A section table in which the model's answers stand in for the scan's."""
    model = answered.select("layer", "section", F.col("summary").alias("_s"), F.size("items").cast("long").alias("_n"))
    out = scanned.join(F.broadcast(model), ["layer", "section"], "left")
    known = F.col("_s").isNotNull()
    changed = {"detected": F.col("detected") | known, "summary": F.coalesce("_s", "summary"), "evidence_total": F.coalesce("_n", "evidence_total"), "kind": F.when(known, "inventory").otherwise(F.col("kind"))}
    return out.withColumns(changed).withColumn("source", F.when(known, "gradle").otherwise("scan")).select(*scanned.columns, "source").orderBy("place")
