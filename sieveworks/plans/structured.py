"""Sections that come from facts of structured files, directories or values inside matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.globs import glob_any
from ..functions.text import base_name, parent_path, path_parts
from ..operators import collect, grep, lookup
from ..sources.corpus import Corpus
from .registry import BOTH_GRADLE, KT, SETTINGS, UI, YML

# Library groups in order of claim, words of test modules, reserved source sets.
STACKS = [
    ("Testing", "junit mockk mockito kaspresso kakao espresso robolectric truth turbine mockwebserver wiremock ui-test uiautomator".split()),
    ("DI", "dagger hilt koin kodein".split()),
    ("Networking", "retrofit okhttp ktor moshi gson apollo".split()),
    ("Database", "room datastore realm sqldelight objectbox".split()),
    ("Analytics/Crash", "analytics crashlytics sentry appcenter bugsnag".split()),
    ("Marketing/Engagement", "onesignal braze appsflyer adjust messaging exponea".split()),
    ("Content Platform", "kontent kentico contentful strapi prismic".split()),
    ("UI", "compose material accompanist constraintlayout coil glide".split()),
]
DOUBLES = "fake stub mock test-double testcommon test-common".split()
SOURCE_SETS = ["main", "test", "androidTest", "debug", "release"]
CONFIG_FILES = [("**/*.properties", "Properties files"), ("**/config*.json", "JSON configs"), ("**/config*.yaml", "YAML configs"), ("**/config*.yml", "YAML configs"), ("**/res/values/*.xml", "Values XML")]
TASKS = grep.Rule("registered", r"""tasks\.register\s*[<(]\s*["']?(\w*[Tt]est\w*)|tasks\.create\s*\(\s*["'](\w*[Tt]est\w*)""", BOTH_GRADLE)
REFERENCED = grep.Rule("referenced", r"\b(connected\w*AndroidTest|test\w*UnitTest|connectedCheck|managedDevices?\w*)\b", (*BOTH_GRADLE, *YML, "**/*.sh", "Makefile", "**/*.md"))
MANAGED = grep.Rule("managed", "managedDevices|localDevices|gradleManagedDevice", BOTH_GRADLE)
TAGS = grep.Rule("tag", r"""testTag\s*\(\s*["']([^"']+)["']|testTag\s*=\s*["']([^"']+)["']""", (KT,), every_match=True)
IDS = grep.Rule("id", r'android:id\s*=\s*"@\+id/(\w+)"', ("**/*.xml",), every_match=True)
FAKES = grep.Rule("fakes", r"class\s+Fake\w+|class\s+Stub\w+|object\s+Fake\w+", (KT,))
HILT = grep.Rule("hilt", r"\bhilt\b|dagger\.hilt|HiltAndroidTest|HiltTestApplication", ("**/*gradle*", "**/gradle/libs.versions.toml", *UI))
DAGGER = grep.Rule("dagger", r"\bdagger\b|com\.google\.dagger", ("**/*gradle*", "**/gradle/libs.versions.toml", *UI))
TEST_MANIFEST = grep.Rule("manifest", r'android:name\s*=\s*"([^"]+)"', ("**/androidTest/**/AndroidManifest.xml",))
NEW_APPLICATION = [r'newApplication\([^)]*?"([A-Za-z0-9_$.]+)"', r"newApplication\([^)]*?([A-Za-z0-9_]+)::class\.java(?:\.name)?", r"newApplication\([^)]*?([A-Za-z0-9_$.]+)\.class(?:\.getName\(\))?"]
APPLICATION = grep.Rule("application", "newApplication", ("**/*Runner*.kt", "**/*Runner*.java"), case_sensitive=True)

#: Sections whose evidence quotes a text that stands in no file: none of it can be proven, so all of it is rejected.
UNPROVEN = ["module_types", "module_classification"]

RULES = [TASKS, REFERENCED, MANAGED, TAGS, IDS, FAKES, HILT, DAGGER, TEST_MANIFEST, APPLICATION]


def _section(rows: DataFrame, section: str, found: Column, summary: Column, total: Column) -> DataFrame:
    """One row for a section from an aggregate of one row."""
    return rows.select(F.lit(section).alias("section"), F.coalesce(found, F.lit(False)).alias("detected"), summary.alias("summary"), F.coalesce(total, F.lit(0)).cast("long").alias("evidence_total"))


def _counted(rows: DataFrame, section: str, template: str, value: Column | None = None) -> DataFrame:
    """``template`` with %d for the number of rows, or of distinct values."""
    n = F.count("*") if value is None else F.count_distinct(value)
    out = rows.agg(n.alias("n"), F.count("*").alias("total"))
    return _section(out, section, F.col("n") > 0, F.format_string(template, F.col("n")), F.col("total"))


def _first_settings(facts: DataFrame) -> DataFrame:
    """Facts of the settings script that counts: the first of the listed names that exists."""
    settings = facts.where(F.col("path").isin(*SETTINGS))
    rank = F.array_position(F.array(*[F.lit(s) for s in SETTINGS]), F.col("path"))
    first = settings.agg(F.min_by("path", rank).alias("path"))
    return settings.join(first, "path", "left_semi")


def _module_groups(modules: DataFrame) -> DataFrame:
    parts = F.split(F.ltrim(F.col("name"), F.lit(":")), ":")
    grouped = modules.select(F.when(F.size(parts) >= 2, parts[0]).otherwise(F.lit("root")).alias("grp"), "name")
    counted = collect.counted_groups(grouped, "grp", ["name"])
    return counted.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "grp", "n"))), lambda g: F.concat(g["grp"], F.lit("("), g["n"].cast("string"), F.lit(")"))), ", ").alias("summary"), F.count("*").alias("n"))


def _module_kinds(facts: DataFrame) -> DataFrame:
    """``path, place, type`` of build scripts whose plugins, resolved by the catalog, name a type."""
    aliases = facts.where("kind = 'plugin_alias'")
    named = collect.resolved(facts.where("kind = 'plugin'").select("path", "name"), "name", aliases, "name", "detail")
    per = named.groupBy("path").agg(F.collect_set("resolved").alias("ids"))
    kind = F.when(F.array_contains("ids", "com.android.application"), "application").when(F.array_contains("ids", "com.android.library"), "library").when(F.array_contains("ids", "java-library") | F.array_contains("ids", "org.jetbrains.kotlin.jvm"), "jvm-library")
    return per.select("path", kind.alias("type")).where("type IS NOT NULL")


def sections(corpus: Corpus, facts: DataFrame, matches: DataFrame) -> DataFrame:
    """``section, detected, summary, evidence_total`` of the structured detectors.

    ``matches`` are all matches of :data:`RULES` and of the probes that structured sections share.
    """
    files, dirs = corpus.files.select("path"), corpus.dirs
    settings = _first_settings(facts)
    modules = settings.where("kind = 'module'").select("name").distinct()
    scripts = F.col("path")
    out: list[DataFrame] = []

    named = settings.where("kind = 'root_name'").agg(F.first("name").alias("name")).crossJoin(files.agg(F.count_if(scripts.isin(*SETTINGS)).alias("n")))
    out.append(_section(named, "repository_identity", F.col("n") > 0, F.coalesce(F.concat(F.lit("rootProject.name = "), F.col("name")), F.lit("settings.gradle found")), F.least("n", F.lit(1))))

    top = files.where(F.contains("path", F.lit("/"))).select(path_parts(F.col("path"))[0].alias("d")).distinct()
    out.append(_counted(top, "high_level_layout", "%d top-level directories"))

    flavors = facts.where("kind = 'flavor'").agg(F.array_sort(F.collect_set("name")).alias("f"))
    hits = matches.where("section = 'brands_flavors_presence'").groupBy().agg(F.array_sort(F.collect_set(F.struct("probe", "label"))).alias("l"), F.count("*").alias("n")).crossJoin(flavors)
    labels = F.concat(F.transform("l", lambda x: x["label"]), F.when(F.size("f") > 0, F.array(F.concat(F.lit("flavors: "), F.array_join("f", ", ")))).otherwise(F.array().cast("array<string>")))
    out.append(_section(hits, "brands_flavors_presence", F.col("n") > 0, F.array_join(labels, ", "), F.col("n")))

    kinds = _module_kinds(facts)
    counts = kinds.where("type IN ('application', 'library')").agg(F.count_if(F.col("type") == "application").alias("a"), F.count_if(F.col("type") == "library").alias("l"))
    out.append(_section(counts, "module_types", F.col("a") + F.col("l") > 0, F.format_string("%d application, %d library", "a", "l"), F.col("a") + F.col("l")))
    classed = kinds.agg(F.count("*").alias("total"))
    typed = collect.joined_first_seen(kinds.groupBy("type").agg(F.count("*").alias("n"), F.min(path_parts(F.col("path"))).alias("at")).select(F.lit(1).alias("k"), F.concat(F.col("n").cast("string"), F.lit(" "), F.col("type")).alias("v"), "at", "n"), ["k"], "v", ["at"])
    out.append(_section(typed.agg(F.first("summary").alias("s")).crossJoin(classed), "module_classification", F.col("s").isNotNull(), F.col("s"), F.col("total")))

    variants = facts.where("kind IN ('build_type', 'flavor')").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "build_type", F.col("name")))).alias("t"), F.array_sort(F.collect_set(F.when(F.col("kind") == "flavor", F.col("name")))).alias("f"), F.count("*").alias("n"))
    pieces = F.array_compact(F.array(F.when(F.size("t") > 0, F.concat(F.lit("buildTypes: "), F.array_join("t", ", "))), F.when(F.size("f") > 0, F.concat(F.lit("flavors: "), F.array_join("f", ", ")))))
    out.append(_section(variants, "build_types_flavors_dimensions", F.col("n") > 0, F.array_join(pieces, "; "), F.col("n")))

    groups = _module_groups(modules)
    for section in ("layering_hints", "module_grouping"):
        out.append(_section(groups, section, F.col("n") > 0, F.col("summary"), F.lit(1) if section == "layering_hints" else F.col("n")))
    out.append(_counted(modules, "full_module_list", "%d modules"))
    edges = facts.where("kind = 'project_dependency'").select(parent_path(F.col("path")).alias("src"), F.col("name").alias("dst"))
    out.append(_counted(edges, "module_dependency_graph", "%d inter-module dependencies"))

    overrides = lookup.named_children(dirs, "src", SOURCE_SETS, ["java", "kotlin", "res"]).select("name")
    named_sets = overrides.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    out.append(_section(named_sets, "flavor_overrides_location", F.col("n") > 0, F.format_string("%d flavor source sets: %s", "n", "names"), F.col("n")))

    code = files.where(F.col("path").rlike(r"\.(kt|java)$"))
    ui_dirs = lookup.dirs_with_files(lookup.find_dirs(dirs, ["androidTest"]), code)
    out.append(_counted(ui_dirs, "ui_tests_location_per_module", "%d modules with androidTest"))
    tests = lookup.dirs_with_files(lookup.find_dirs(dirs, ["test", "androidTest"]), code).where(base_name(F.col("parent")) == "src")
    out.append(_counted(tests, "test_source_sets_map", "%d test source sets"))
    out.append(_counted(lookup.find_dirs(dirs, ["androidTest"]), "ui_test_framework_location", "Found %d androidTest locations"))

    doubles = modules.where(F.exists(F.array(*[F.lit(w) for w in DOUBLES]), lambda w: F.contains(F.lower("name"), w))).agg(F.count("*").alias("m")).crossJoin(matches.where("rule_id = 'fakes'").agg(F.count("*").alias("c")))
    out.append(_section(doubles, "test_fakes_stubs_modules", F.col("m") + F.col("c") > 0, F.format_string("%d test modules, %d fake classes", "m", "c"), F.col("m") + F.col("c")))

    counted = files.agg(*[F.count_if(glob_any(F.col("path"), [g])).alias(f"c{i}") for i, (g, _) in enumerate(CONFIG_FILES)])
    shown = F.array_compact(F.array(*[F.when(F.col(f"c{i}") > 0, F.format_string(f"%d {n}", f"c{i}")) for i, (_, n) in enumerate(CONFIG_FILES)]))
    total = sum((F.col(f"c{i}") for i in range(len(CONFIG_FILES))), F.lit(0))
    out.append(_section(counted, "config_sources_inventory", total > 0, F.array_join(shown, ", "), total))

    catalog = facts.where("path = 'gradle/libs.versions.toml'").agg(F.count_if(F.col("kind") == "version").alias("v"), F.count("*").alias("n"))
    out.append(_section(catalog, "versions_source_of_truth", F.col("n") > 0, F.format_string("Version catalog (gradle/libs.versions.toml) with %d versions", "v"), F.col("v") + 1))
    libraries = facts.where("kind = 'library'").select(F.col("name"), collect.claimed_by(F.concat_ws(" ", "name", F.split("detail", "\t")[0]), STACKS).alias("grp")).where("grp IS NOT NULL")
    rank = F.array_position(F.array(*[F.lit(n) for n, _ in STACKS]), F.col("grp"))
    stacks = collect.sorted_names(libraries, ["grp"], "name", 6).withColumn("r", rank).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(": ", "grp", "names").alias("t")))), lambda x: x["t"]), "; ").alias("s"), F.coalesce(F.sum("n_names"), F.lit(0)).alias("n"))
    out.append(_section(stacks, "core_stacks_inventory", F.col("n") > 0, F.col("s"), F.col("n")))

    runners = matches.where("section = 'instrumentation_runner'")
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("label") == "runner", F.regexp_extract("match_text", r"""['"]([^'"]+)['"]""", 1)))), ", ")
    seen = runners.agg(names.alias("names"), F.array_sort(F.collect_set(F.struct("probe", "label"))).alias("l"), F.count("*").alias("n"))
    texts = F.transform("l", lambda x: F.when(x["label"] == "runner", F.concat(F.lit("runner: "), F.col("names"))).otherwise(x["label"]))
    out.append(_section(seen, "instrumentation_runner", F.col("n") > 0, F.concat(F.lit("Observed: "), F.array_join(texts, "; ")), F.col("n")))

    tasks = matches.where("rule_id IN ('registered', 'referenced', 'managed')")
    task = F.when(F.col("rule_id") == "registered", F.nullif(F.regexp_extract("line_content", r"""["'](\w*[Tt]est\w*)["']""", 1), F.lit(""))).when(F.col("rule_id") == "referenced", F.col("match_text"))
    named_tasks = tasks.select(task.alias("t")).where("t IS NOT NULL").distinct().orderBy("t").limit(8).agg(F.array_sort(F.collect_list("t")).alias("t"))
    listed = tasks.agg(F.count_if(F.col("rule_id") == "managed").alias("m"), F.count("*").alias("n")).crossJoin(named_tasks)
    text = F.when(F.size("t") > 0, F.concat(F.lit("Observed task references: "), F.array_join("t", ", "))).otherwise(F.lit("Observed Gradle managed-device configuration"))
    out.append(_section(listed, "test_tasks", (F.size("t") > 0) | (F.col("m") > 0), F.concat(text, F.when(F.col("m") > 0, F.lit("; Gradle managed devices")).otherwise(F.lit(""))), F.col("n")))

    for section, template in (("screen_names_inventory", "Found %d Screen classes"), ("ui_test_class_names", "Found %d UI test classes")):
        out.append(_counted(matches.where(F.col("section") == section), section, template, F.regexp_extract("match_text", r"([A-Za-z0-9_]+)$", 1)))

    candidates = F.coalesce(
        F.when(F.col("rule_id") == "manifest", F.nullif(F.regexp_extract("match_text", TEST_MANIFEST.pattern, 1), F.lit(""))),
        *[F.when(F.col("rule_id") == "application", F.nullif(F.regexp_extract("line_content", p, 1), F.lit(""))) for p in NEW_APPLICATION],
    )
    apps = matches.where("rule_id IN ('hilt', 'dagger', 'manifest', 'application')").agg(F.array_sort(F.collect_set(candidates)).alias("c"), F.count_if(F.col("rule_id") == "hilt").alias("h"), F.count_if(F.col("rule_id") == "dagger").alias("d"), F.count("*").alias("n"))
    prefix = F.when(F.col("h") > 0, "DI: Hilt; ").when(F.col("d") > 0, "DI: Dagger; ").otherwise("")
    said = F.when(F.size("c") > 0, F.concat(F.lit("Test application class candidates: "), F.array_join("c", ", "))).otherwise(F.lit("No test application class detected"))
    out.append(_section(apps, "ui_test_application_class", F.col("n") > 0, F.concat(prefix, said), F.col("n")))

    below = lookup.find_dirs(dirs, ["scenarios"]).where(F.array_contains(path_parts(F.col("path")), "androidTest"))
    held = below.join(lookup.files_below(code).withColumnRenamed("dir", "path"), "path").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("f"))
    out.append(_section(held, "scenarios_directory", F.col("n") > 0, F.format_string("Found %d scenarios directories, %d files", "n", "f"), F.col("n")))

    for section, kind, template in (("deep_link_inventory", "deep_link", "%d deep links declared"), ("exported_components", "exported", "%d explicitly exported components")):
        out.append(_counted(facts.where(F.col("kind") == kind).select("name").distinct(), section, template))
    tags = matches.where("rule_id IN ('tag', 'id')").select("rule_id", F.regexp_extract("match_text", r"""["'](?:@\+id/)?([^"']+)["']""", 1).alias("v")).distinct()
    kinds_of = tags.agg(F.count_if(F.col("rule_id") == "tag").alias("t"), F.count_if(F.col("rule_id") == "id").alias("i"))
    both = F.array_compact(F.array(F.when(F.col("t") > 0, F.format_string("%d Compose test tags", "t")), F.when(F.col("i") > 0, F.format_string("%d view ids", "i"))))
    out.append(_section(kinds_of, "test_tag_inventory", F.col("t") + F.col("i") > 0, F.array_join(both, ", "), F.col("t") + F.col("i")))

    ci = facts.where("kind IN ('stage', 'job')").agg(F.count_if(F.col("kind") == "stage").alias("s"), F.count_if(F.col("kind") == "job").alias("j"))
    told = F.array_compact(F.array(F.when(F.col("s") > 0, F.format_string("%d stages", "s")), F.when(F.col("j") > 0, F.format_string("%d jobs", "j"))))
    out.append(_section(ci, "jobs_and_stages", F.col("s") + F.col("j") > 0, F.array_join(told, ", "), F.col("s") + F.col("j")))

    art = matches.where("section = 'artifacts_and_reports'")
    value = F.when((F.col("label") == "") & (F.col("line_content") != ""), F.trim(F.regexp_replace("line_content", r"(?i)^\s*(?:(?:junit|path|outputDir)\s*:\s*|-\s+)", ""), F.lit(" '\"")))
    named_paths = art.select(value.alias("v"), path_parts(F.col("path")).alias("p"), "line").where("v IS NOT NULL").groupBy("v").agg(F.min(F.struct("p", "line", "v")).alias("at")).orderBy("at").limit(8).agg(F.array_sort(F.collect_list("at")).alias("v"))
    parts = art.agg(F.array_sort(F.collect_set(F.when(F.col("label") != "", F.struct("probe", "label")))).alias("l"), F.count("*").alias("n")).crossJoin(named_paths)
    paths = F.transform("v", lambda x: x["v"])
    art_text = F.concat(F.lit("Observed CI outputs: "), F.array_join(F.transform("l", lambda x: x["label"]), ", "), F.when(F.size(paths) > 0, F.concat(F.lit("; paths: "), F.array_join(paths, ", "))).otherwise(F.lit("")))
    out.append(_section(parts, "artifacts_and_reports", F.size("l") > 0, art_text, F.col("n")))

    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole
