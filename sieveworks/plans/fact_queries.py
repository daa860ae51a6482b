"""Registered queries of the structured parsers, the build model and whole scans.

The files are written from rows of the driver's tables, so that SQL over the same rows says what has to
be found in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import formats
from ..functions.redact import REDACTED, sanitize, sanitize_columns
from ..operators import sections as evidence
from ..sources import build_files
from ..sources.corpus import Corpus, spread
from . import model_sections, scan
from .registering import query
from .registry import DETECTORS, LAYERS


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(template: str, **values: str) -> Column:
    """``template`` with ``<name>`` replaced by the column expression of that name."""
    out = F.lit(template)
    for name, expression in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.expr(expression).cast("string"))
    return out


def _facts(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    """Facts of a file for each row; rows are spread before their texts are made, as parsing is what costs."""
    return build_files.facts(Corpus.from_table(spread(rows), path, text))


# --- build scripts ----------------------------------------------------------

_SCRIPT = """plugins {
  id("com.example.<r>")
  alias(libs.plugins.region<n>)
}
apply plugin: 'old.<n>'
android {
  buildTypes {
    debug { }
    create("qa<n>") { minifyEnabled = true }
  }
  productFlavors {
    register("flavor<n>") { dimension = "x" }
    paid { ext { deep { } } }
    if (x) { }
  }
}
dependencies {
  implementation(project(":supplier:s<k>"))
  implementation(projects.region.r<n>)
}
"""
_PARTS = """SELECT 'm/s' || s_suppkey || '/build.gradle.kts' AS path, s_suppkey AS k, s_nationkey AS n FROM supplier"""


def _scripts(spark: SparkSession, sf: str) -> DataFrame:
    text = _text(_SCRIPT, r="s_suppkey", k="s_suppkey", n="s_nationkey")
    return _facts(_table(spark, sf, "supplier"), _text("m/s<k>/build.gradle.kts", k="s_suppkey"), text)


@query(f"""WITH p AS ({_PARTS}), f AS (SELECT path, unnest(['debug', 'qa' || n]) AS name, 'build_type' AS kind FROM p UNION ALL SELECT path, unnest(['flavor' || n, 'paid']), 'flavor' FROM p)
SELECT path, kind, name FROM f""")
def script_variants(spark, sf):
    return _scripts(spark, sf).where("kind IN ('build_type', 'flavor')").select("path", "kind", "name")


@query(f"WITH p AS ({_PARTS}) SELECT path, unnest(['com.example.' || k, 'region' || n, 'old.' || n]) AS plugin FROM p")
def script_plugins(spark, sf):
    return _scripts(spark, sf).where("kind = 'plugin'").select("path", F.col("name").alias("plugin"))


@query(f"WITH p AS ({_PARTS}) SELECT path, unnest([':supplier:s' || k, ':region:r' || n]) AS dependency FROM p")
def script_project_dependencies(spark, sf):
    return _scripts(spark, sf).where("kind = 'project_dependency'").select("path", F.col("name").alias("dependency"))


@query("""WITH m AS (SELECT ':region' || n_regionkey || ':' || lower(replace(n_name, ' ', '_')) AS name FROM nation)
SELECT 'module' AS kind, name FROM m UNION ALL SELECT 'root_name', 'atlas-' || count(*) FROM nation""")
def settings_modules(spark, sf):
    """One settings script: include calls in brackets for half of the nations, bare rows for the others."""
    path = F.concat(F.lit("':region"), F.col("n_regionkey").cast("string"), F.lit(":"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("'"))
    listed = _table(spark, sf, "nation").select(path.alias("m"), (F.col("n_nationkey") % 2 == 0).alias("even"))

    def joined(even: bool, sep: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("even") == even, F.col("m")))), sep)

    text = F.concat(F.lit('rootProject.name = "atlas-'), F.count("*").cast("string"), F.lit('"\ninclude('), joined(True, ",\n"), F.lit(")\n// include ':none'\ninclude "), joined(False, ",\n  "), F.lit("\nx = 1\n"))
    one = listed.agg(text.alias("t"))
    return build_files.facts(Corpus.from_table(one, F.lit("settings.gradle.kts"), F.col("t"))).select("kind", "name")


# --- version catalogs -------------------------------------------------------

_CATALOG = """[versions]
v<k> = "1.<z>"
[libraries]
a<k> = "grp.<z>:art<k>:2.<z>"
b<k> = { module = "grp:mod<k>", version.ref = "v<k>" }
c<k> = { group = "grp", name = "name<k>", version = "3" }
d<k> = { module = "grp:rich<k>", version = { prefer = "4.<z>" } }
e<k> = { module = "grp:bare<k>" }
f<k> = { name = "no group" }
[plugins]
p<k> = "plug.<z>:5"
q<k> = { id = "plug.id<k>", version.ref = "v<k>" }
[bundles]
s<k> = ["a<k>", "b<k>"]
"""


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 50 == 0, F.lit("not [ toml")).otherwise(_text(_CATALOG, k="p_partkey", z="p_size"))
    return _facts(_table(spark, sf, "part"), F.lit("gradle/libs.versions.toml"), text)


_GOOD = "FROM part WHERE p_partkey % 50 <> 0"


@query(f"""SELECT alias, module, version FROM (SELECT p_partkey AS k, p_size AS z {_GOOD}), LATERAL (VALUES ('a' || k, 'grp.' || z || ':art' || k, '2.' || z), ('b' || k, 'grp:mod' || k, '1.' || z), ('c' || k, 'grp:name' || k, '3'), ('d' || k, 'grp:rich' || k, '4.' || z), ('e' || k, 'grp:bare' || k, '')) v(alias, module, version)""")
def catalog_libraries(spark, sf):
    """Libraries in all their forms, versions by reference resolved."""
    parts = F.split("detail", "\t")
    return _catalog(spark, sf).where("kind = 'library'").select(F.col("name").alias("alias"), parts[0].alias("module"), parts[1].alias("version"))


@query(f"""SELECT 'version' AS kind, 'v' || p_partkey AS name, '1.' || p_size AS detail {_GOOD} UNION ALL SELECT 'plugin_alias', 'p' || p_partkey, 'plug.' || p_size {_GOOD}
UNION ALL SELECT 'plugin_alias', 'q' || p_partkey, 'plug.id' || p_partkey {_GOOD} UNION ALL SELECT 'bundle', 's' || p_partkey, 'a' || p_partkey || ',b' || p_partkey {_GOOD}
UNION ALL SELECT 'failure', 'catalog', NULL FROM part WHERE p_partkey % 50 = 0""")
def catalog_entries(spark, sf):
    return _catalog(spark, sf).where("kind <> 'library'").select("kind", "name", "detail")


# --- manifests, CI ----------------------------------------------------------

_MANIFEST = """<manifest xmlns:android="http://schemas.android.com/apk/res/android"><application>
<activity android:name=".A<k>" android:exported="true"><intent-filter><data android:scheme="https" android:host="h<n>.test" android:port="8<n>" android:pathPrefix="/p<k>"/><data android:host="only<k>"/><data/></intent-filter></activity>
<service android:name=".S<k>" android:exported="<even>"/>
<receiver android:name=".R<k>"><intent-filter/></receiver>
<provider android:name=".P<k>"/>
</application></manifest>"""


@query("""WITH s AS (SELECT 'm/' || s_suppkey || '/AndroidManifest.xml' AS path, s_suppkey AS k, s_nationkey AS n FROM supplier), g AS (SELECT * FROM s WHERE k % 7 <> 0)
SELECT path, 'deep_link' AS kind, unnest(['https://h' || n || '.test:8' || n || '/p' || k, '*://only' || k]) AS name FROM g
UNION ALL SELECT path, 'exported', 'activity .A' || k FROM g UNION ALL SELECT path, 'exported', 'service .S' || k FROM g WHERE k % 2 = 0
UNION ALL SELECT path, 'implicit_export', 'receiver .R' || k FROM g UNION ALL SELECT path, 'failure', 'manifest' FROM s WHERE k % 7 = 0""")
def manifest_components(spark, sf):
    """Deep links and exported components; every seventh manifest is torn off."""
    whole = _text(_MANIFEST, k="s_suppkey", n="s_nationkey", even="s_suppkey % 2 = 0")
    text = F.when(F.col("s_suppkey") % 7 == 0, F.substring(whole, 1, 200)).otherwise(whole)
    return _facts(_table(spark, sf, "supplier"), _text("m/<k>/AndroidManifest.xml", k="s_suppkey"), text).select("path", "kind", "name")


_CI = """# ci <k>
stages:
  - build
  - seg<n>
variables:
  a: b
job<k>:
  stage: build
.hidden<k>:
  x: y
"""


@query("""SELECT 'job' AS kind, 'job' || c_custkey AS name FROM customer UNION ALL SELECT 'stage', unnest(['build', 'seg' || c_nationkey]) FROM customer""")
def ci_jobs_and_stages(spark, sf):
    return _facts(_table(spark, sf, "customer"), F.lit(".gitlab-ci.yml"), _text(_CI, k="c_custkey", n="c_nationkey")).select("kind", "name")


# --- the recorded build model -----------------------------------------------

def _projects(spark: SparkSession, sf: str) -> DataFrame:
    """A project for each nation and the root, in the shape of a recorded model."""
    nation = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").alias("r"))
    flavors = F.when(F.col("k") % 8 == 0, F.array(
        F.struct(F.concat(F.lit("f"), F.col("k").cast("string")).alias("name"), F.lit("tier").alias("dimension"), F.lit(".f").alias("applicationIdSuffix")),
        F.struct(F.lit("plain").alias("name"), F.lit("tier").alias("dimension"), F.lit(None).cast("string").alias("applicationIdSuffix")),
    )).otherwise(F.array().cast("array<struct<name:string,dimension:string,applicationIdSuffix:string>>"))
    android = F.when(F.col("k") % 4 < 2, F.struct(
        F.when(F.col("k") % 3 == 0, F.lit("x.Runner")).alias("testInstrumentationRunner"),
        F.array(F.lit("debug"), F.lit("release")).alias("buildTypes"),
        F.when(F.col("k") % 8 == 0, F.array(F.lit("tier"))).otherwise(F.array().cast("array<string>")).alias("flavorDimensions"),
        flavors.alias("productFlavors"),
        F.struct((F.col("k") % 2 == 1).alias("animationsDisabled"), F.when(F.col("k") % 5 == 0, F.lit("ORCHESTRATOR")).alias("execution")).alias("testOptions"),
        F.when(F.col("k") == 4, F.array(F.lit("testOptions"))).otherwise(F.array().cast("array<string>")).alias("unavailableProperties"),
    ))
    path = F.format_string(":r%d:n%d", F.col("r"), F.col("k"))
    modules = nation.select(
        (F.col("k") + 1).cast("int").alias("place"), path.alias("path"),
        F.when(F.col("k") % 4 == 2, F.array(F.lit("java-library"))).when(F.col("k") % 4 == 1, F.array(F.lit("com.android.library"))).otherwise(F.array().cast("array<string>")).alias("plugins"),
        F.when(F.col("k") % 4 == 0, F.lit("application")).alias("androidPluginKind"),
        F.array(path, F.format_string(":hub%d", F.col("r"))).alias("projectDependencies"), F.lit(True).alias("projectDependenciesComplete"), android.alias("android"),
    )
    root = spark.range(1).select(F.lit(0).alias("place"), F.lit(":").alias("path"), F.array().cast("array<string>").alias("plugins"), F.lit(None).cast("string").alias("androidPluginKind"), F.array(F.lit(":build")).alias("projectDependencies"), F.lit(True).alias("projectDependenciesComplete"), F.lit(None).cast(modules.schema["android"].dataType).alias("android"))
    return root.unionByName(modules)


_NATIONS = """n AS (SELECT n_nationkey AS k, n_regionkey AS r, ':r' || n_regionkey || ':n' || n_nationkey AS path,
    CASE n_nationkey % 4 WHEN 0 THEN 'application' WHEN 1 THEN 'library' WHEN 2 THEN 'jvm-library' ELSE 'other' END AS kind FROM nation),
apps AS (SELECT * FROM n WHERE kind = 'application')"""


@query(f"""WITH {_NATIONS},
counts AS (SELECT kind, count(*) AS c, list_sort(list(path || ' - ' || kind)) AS i FROM n GROUP BY kind),
edges AS (SELECT list_sort(list(path || ' -> :hub' || r) || [': -> :build']) AS i FROM n),
variants AS (SELECT string_agg(path || ' (build types: debug, release' || CASE WHEN k % 8 = 0 THEN '; dimensions: tier; 2 flavours: f' || k || ', plain' ELSE '' END || ')', '; ' ORDER BY k) AS t, 2 * count(*) + 2 * count(*) FILTER (k % 8 = 0) AS c FROM apps),
brands AS (SELECT string_agg(path || ': 2 product flavours across dimensions tier; 1 with applicationId suffix', '; ' ORDER BY k) AS t, 2 * count(*) AS c FROM apps WHERE k % 8 = 0),
knobs AS (SELECT k, list_filter([CASE WHEN k % 3 = 0 THEN path || ' - testInstrumentationRunner = x.Runner' END, CASE WHEN k % 5 = 0 THEN path || ' - testOptions.execution = ORCHESTRATOR' END, path || ' - testOptions.animationsDisabled = ' || CASE WHEN k % 2 = 1 THEN 'True' ELSE 'False' END], lambda x: x IS NOT NULL) AS i FROM apps),
tests AS (SELECT string_agg(array_to_string(i, '; '), '; ' ORDER BY k) AS t, sum(len(i)) AS c FROM knobs)
SELECT 'full_module_list' AS section, count(*) || ' modules configured by Gradle' AS summary, count(*)::BIGINT AS n_items, string_agg(path, '|' ORDER BY path) AS items, 'complete' AS completeness FROM n
UNION ALL SELECT 'module_classification', string_agg(kind || ': ' || c, ', ' ORDER BY kind), sum(c)::BIGINT, array_to_string(flatten(list(i ORDER BY kind)), '|'), 'complete' FROM counts
UNION ALL SELECT 'module_dependency_graph', len(i) || ' dependencies between ' || (SELECT count(*) + 1 FROM n) || ' modules', len(i)::BIGINT, array_to_string(i, '|'), 'complete' FROM edges
UNION ALL SELECT 'build_types_flavors_dimensions', t, c::BIGINT, (SELECT string_agg(path || ' - build type: debug|' || path || ' - build type: release' || CASE WHEN k % 8 = 0 THEN '|' || path || ' - flavour: f' || k || ' (dimension tier), applicationIdSuffix .f|' || path || ' - flavour: plain (dimension tier)' ELSE '' END, '|' ORDER BY k) FROM apps), 'complete' FROM variants
UNION ALL SELECT 'brands_flavors_presence', t, c::BIGINT, (SELECT string_agg(path || ' - f' || k || '|' || path || ' - plain', '|' ORDER BY k) FROM apps WHERE k % 8 = 0), 'complete' FROM brands
UNION ALL SELECT 'test_config_knobs', 'Observed Gradle test configuration: ' || t, c::BIGINT, (SELECT string_agg(array_to_string(i, '|'), '|' ORDER BY k) FROM knobs), 'unknown' FROM tests""")
def model_sections_answered(spark, sf):
    """The six sections that a recorded model answers: modules, kinds, edges, variants, brands, test settings."""
    found = model_sections.sections(_projects(spark, sf))
    return found.select("section", "summary", F.size("items").cast("long").alias("n_items"), F.array_join("items", "|").alias("items"), "completeness")


@query(f"WITH {_NATIONS} SELECT unnest(['buildTypes', 'testOptions']) AS property, unnest([true, false]) AS complete")
def model_completeness(spark, sf):
    """Whether all applications report a property: every one must, and none may list it as unavailable."""
    apps = _projects(spark, sf).where("androidPluginKind = 'application'")
    parts = [model_sections.complete(apps, [p]).select(F.lit(p).alias("property"), "complete") for p in ("buildTypes", "testOptions")]
    return parts[0].unionByName(parts[1])


# --- a whole scan -----------------------------------------------------------

_SOURCES = [
    ("app/src/main/java/A<k>.kt", "@Composable\nfun a() { Modifier.testTag(\"t<k>\") }\n"),
    ("core/src/main/java/B<k>.kt", "val s: StateFlow<Int>\nsuspend fun go() {}\nval token = \"<k>secret\"\n"),
    ("docs/d<k>.md", "text <k>\n"),
    ("app/src/androidTest/java/L<k>Screen.kt", "class L<k>Screen\n"),
]


def _tree(spark: SparkSession, sf: str) -> Corpus:
    """A small source tree: every supplier is a file of one of four kinds."""
    place = (F.col("s_suppkey") % 4).cast("int")
    chosen = F.get(F.array(*[F.struct(_text(p, k="s_suppkey").alias("p"), _text(t, k="s_suppkey").alias("t")) for p, t in _SOURCES]), place)
    return Corpus.from_table(spread(_table(spark, sf, "supplier").select("s_suppkey")).withColumn("_f", chosen), F.col("_f.p"), F.col("_f.t"))


#: What the scan of the tree finds: summary and evidence in SQL over the counts a, b, c, d of the four kinds of files.
_SCANNED = {
    "high_level_layout": ("(a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0 AND a = 0)::INT || ' top-level directories'", "(a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0 AND a = 0)::INT"),
    "ui_technology_signals": ("'@Composable usage'", "a"),
    "documentation_locations": ("c || ' documentation locations'", "c"),
    "state_management": ("'StateFlow'", "b"),
    "concurrency": ("'Coroutines'", "b"),
    "compose_setup": ("'Jetpack Compose'", "a"),
    "ui_tests_location_per_module": ("'1 modules with androidTest'", "1"),
    "test_source_sets_map": ("'1 test source sets'", "1"),
    "ui_test_framework_location": ("'Found 1 androidTest locations'", "1"),
    "screen_objects_inventory": ("'Found ' || d || ' Screen/Robot/Page objects'", "d"),
    "screen_names_inventory": ("'Found ' || d || ' Screen classes'", "d"),
    "test_entry_points": ("'Observed: ' || d || ' screen/robot/helper files'", "d"),
    "compose_selectors_convention": ("'Found ' || a || ' testTag usages'", "a"),
    "test_tag_inventory": ("a || ' Compose test tags'", "a"),
}
_KINDS = "k AS (SELECT count(*) FILTER (s_suppkey % 4 = 0) AS a, count(*) FILTER (s_suppkey % 4 = 1) AS b, count(*) FILTER (s_suppkey % 4 = 2) AS c, count(*) FILTER (s_suppkey % 4 = 3) AS d FROM supplier)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SECTION_ROWS = " UNION ALL ".join(
    f"SELECT {n} AS place, {_quoted(d.layer)} AS layer, {_quoted(d.id)} AS section, {_quoted(d.title)} AS title, {'true' if d.id in _SCANNED else 'false'} AS detected, "
    f"{_SCANNED[d.id][0] if d.id in _SCANNED else _quoted(d.missing)} AS summary, {f'({_SCANNED[d.id][1]})::BIGINT' if d.id in _SCANNED else '0::BIGINT'} AS evidence_total FROM k"
    for n, d in enumerate(DETECTORS)
)


@query(f"WITH {_KINDS} {_SECTION_ROWS}")
def scan_sections(spark, sf):
    """Every section of a scan, found or not."""
    return scan.sections(_tree(spark, sf)).select("place", "layer", "section", "title", "detected", "summary", "evidence_total")


_LAYER_IDS = list(LAYERS)
_LAYER_CASE = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {_quoted(x)}" for i, x in enumerate(_LAYER_IDS)) + " END"
_PART_SECTIONS = f"s AS (SELECT {_LAYER_CASE} AS layer, p_partkey AS place, lower(p_brand) AS section, p_size > 20 AS detected, p_type AS summary FROM part)"


def _part_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A section table of any size: a section for each part."""
    layer = F.get(F.array(*[F.lit(x) for x in _LAYER_IDS]), (F.col("p_partkey") % 9).cast("int"))
    return _table(spark, sf, "part").select(layer.alias("layer"), F.col("p_partkey").alias("place"), F.lower("p_brand").alias("section"), (F.col("p_size") > 20).alias("detected"), F.col("p_type").alias("summary"))


@query(f"WITH {_PART_SECTIONS}, t AS (SELECT * FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in LAYERS.items())}) v(layer, title)) SELECT t.layer, t.title, count(s.place) AS sections, count(*) FILTER (detected) AS detected FROM t LEFT JOIN s USING (layer) GROUP BY t.layer, t.title")
def scan_layers(spark, sf):
    return scan.layers(_part_sections(spark, sf))


@query(f"WITH {_PART_SECTIONS} SELECT layer, place, printf('[%s] %-32s %s', CASE WHEN detected THEN '+' ELSE '-' END, section, summary) AS line FROM s")
def scan_section_lines(spark, sf):
    return formats.section_lines(_part_sections(spark, sf))


@query("""WITH f AS (SELECT 'core/src/main/java/B' || s_suppkey || '.kt' AS path FROM supplier WHERE s_suppkey % 4 = 1), r AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS ordinal, least(200, count(*) OVER ()) AS total FROM f),
d AS (SELECT 'docs/d' || s_suppkey || '.md' AS path FROM supplier WHERE s_suppkey % 4 = 2), o AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS ordinal, count(*) OVER () AS total FROM d)
SELECT 'state_management' AS section, ordinal, path || ':1  val s: StateFlow<Int>' AS line, total::BIGINT AS evidence_total FROM r WHERE ordinal < 25
UNION ALL SELECT 'documentation_locations', ordinal, path || ' (file)  ', total::BIGINT FROM o WHERE ordinal < 25""")
def scan_evidence_located(spark, sf):
    """Evidence of two sections as a scan keeps it: capped, checked, with the place it stands at."""
    tree = _tree(spark, sf)
    kept = scan.evidence(tree, scan.matches(tree)).where("section IN ('state_management', 'documentation_locations')")
    return formats.evidence_lines(kept).join(kept.select("section", "ordinal", "evidence_total"), ["section", "ordinal"])


# --- masking ----------------------------------------------------------------


@query(f"""SELECT c_custkey, 'password: {REDACTED}' || chr(10) || 'user = ' || c_name || chr(10) || 'val apiKey = "{REDACTED}' || chr(10) || '"' AS safe FROM customer""")
def sanitize_statements(spark, sf):
    """The whole masking pipeline on texts whose masked form SQL can say."""
    text = F.concat(F.lit("password: hunter"), F.col("c_custkey").cast("string"), F.lit("\nuser = "), F.col("c_name"), F.lit('\nval apiKey = "k'), F.col("c_nationkey").cast("string"), F.lit('" +\n  "z"'))
    # the value goes on over a line end, which is kept
    return _table(spark, sf, "customer").select("c_custkey", sanitize(text).alias("safe"))


@query(f"SELECT c_custkey, 'token={REDACTED}' AS first_item, 'Bearer {REDACTED}' AS noted, c_nationkey AS n FROM customer")
def sanitize_nested(spark, sf):
    """Texts inside arrays, maps and structs."""
    nested = _table(spark, sf, "customer").select(
        "c_custkey",
        F.array(F.concat(F.lit("token=t"), F.col("c_custkey").cast("string")), F.lit(None).cast("string")).alias("items"),
        F.create_map(F.lit("note"), F.struct(F.concat(F.lit("Bearer b"), F.col("c_custkey").cast("string")).alias("s"), F.col("c_nationkey").alias("n"))).alias("notes"),
    )
    return sanitize_columns(nested).select("c_custkey", F.col("items")[0].alias("first_item"), F.col("notes")["note"]["s"].alias("noted"), F.col("notes")["note"]["n"].alias("n"))


# --- evidence ---------------------------------------------------------------


@query("""WITH e AS (SELECT l_returnflag AS section, l_orderkey AS o, l_linenumber AS n, (l_linenumber % 5 <> 0) AS good FROM lineitem),
r AS (SELECT section, o, n, row_number() OVER (PARTITION BY section ORDER BY o, n) - 1 AS ordinal FROM e WHERE good),
t AS (SELECT section, count(*) FILTER (good) AS evidence_total, count(*) FILTER (NOT good) AS rejected FROM e GROUP BY section)
SELECT section, o + 1 AS line_start, ordinal, evidence_total, 'Omitted ' || rejected || ' invalid evidence entries' AS error FROM r JOIN t USING (section) WHERE ordinal < 25""")
def evidence_checked_and_capped(spark, sf):
    """Evidence that proves its range, the first 25 of each section, with what was left out."""
    items = _table(spark, sf, "lineitem")
    stop = F.when(F.col("l_linenumber") % 5 == 0, F.col("l_orderkey")).otherwise(F.col("l_orderkey") + 1)
    rows = items.select(
        F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("k"), F.lit("source_lines").alias("provenance"), F.lit("a.kt").alias("path"), (F.col("l_orderkey") + 1).alias("line_start"), stop.alias("line_end"),
        F.lit(2**40).alias("source_line_count"), F.sha2(F.lit("x"), 256).alias("source_digest"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("property"),
    )
    told = evidence.rejections(rows, ["section"]).select("section", "error")
    kept = evidence.capped_evidence(evidence.accepted(rows), ["section"], [F.col("line_start"), F.col("k")])
    return kept.join(told, "section").select("section", "line_start", "ordinal", "evidence_total", "error")
