"""A whole scan of a small tree, its store and its front end."""

import dataclasses
import json
import os
import subprocess

import pytest

from sieveworks.__main__ import main
from sieveworks.plans import registry, scan
from sieveworks.render import BEGIN, layer_texts, write_layers
from sieveworks.sources import build_files
from sieveworks.sources.corpus import Corpus
from sieveworks.sources.tree import outermost, project_name, project_roots, read_tree
from sieveworks.sources.version_control import Checkout, changed_since, checkout
from sieveworks.store import Status, Store

TREE = {
    "settings.gradle.kts": 'pluginManagement {\n}\nrootProject.name = "demo-app"\ninclude(":app", ":core:net",\n ":core:ui")\ninclude(":feature:login")\n',
    "build.gradle.kts": 'plugins {\n  id("io.gitlab.arturbosch.detekt")\n}\n',
    "app/build.gradle.kts": 'plugins {\n alias(libs.plugins.hilt)\n id("com.android.application")\n}\nandroid {\n defaultConfig { testInstrumentationRunner = "com.x.Runner" }\n buildTypes {\n  debug { }\n  create("qa") { minifyEnabled = true }\n }\n flavorDimensions += "env"\n productFlavors {\n  create("demo") { applicationIdSuffix = ".demo" }\n  register("prod")\n }\n}\ndependencies { implementation(project(":core:net"))\n implementation(projects.core.ui) }\n',
    "core/net/build.gradle.kts": 'plugins { id("com.android.library") }\n',
    "gradle/libs.versions.toml": '[versions]\nkotlin = "2.0"\n[libraries]\nretrofit = "com.squareup.retrofit2:retrofit:2.9"\nroom = { module = "androidx.room:room", version.ref = "kotlin" }\nhilt = { group = "com.google.dagger", name = "hilt-android", version = "1" }\n[plugins]\nhilt = "com.google.dagger.hilt:2"\n',
    "app/src/main/AndroidManifest.xml": '<manifest xmlns:android="http://schemas.android.com/apk/res/android"><application><activity android:name=".Main" android:exported="true"><intent-filter><data android:scheme="https" android:host="x.y" android:path="/a"/></intent-filter></activity></application></manifest>',
    "app/src/main/java/A.kt": '@Composable\nfun A() { Modifier.testTag("one") ; Modifier.testTag("two") }\nval s: StateFlow<Int>\nval token = "secretvalue123"\nval accessToken = 1\n',
    "app/src/androidTest/java/LoginScreen.kt": 'package x.screens\nclass LoginScreen\nclass LoginTest : TestCase()\nstep("a") { flakySafely { } }\n',
    "app/src/test/java/FakeRepo.kt": "class FakeRepo\nimport org.junit.Test\n",
    ".gitlab-ci.yml": "stages:\n  - build\n  - test\nbuild-job:\n  stage: build\n  artifacts:\n    paths:\n      - app/build/reports\n  cache:\n    key: x\n  script: ./gradlew testDemoUnitTest\n",
    ".gitignore": "*.jks\nlocal.properties\n",
    "README.md": "How to test\n",
    "docs/README.md": "x\n",
    "build/skipped.kt": "@Composable",
    "logo.PNG": "x",
}
EXPECTED = {
    "repository_identity": "rootProject.name = demo-app",
    "brands_flavors_presence": "productFlavors, flavorDimensions, applicationIdSuffix, flavors: demo, prod",
    "documentation_locations": "3 documentation locations",
    "module_types": "1 application, 1 library",
    "build_types_flavors_dimensions": "buildTypes: debug, qa; flavors: demo, prod",
    "layering_hints": "core(2), root(1), feature(1)",
    "di_framework": "Hilt",
    "networking_stack": "Retrofit",
    "persistence": "Room",
    "full_module_list": "4 modules",
    "module_dependency_graph": "2 inter-module dependencies",
    "core_stacks_inventory": "DI: hilt; Networking: retrofit; Database: room",
    "instrumentation_runner": "Observed: runner: com.x.Runner",
    "test_tag_inventory": "2 Compose test tags",
    "jobs_and_stages": "2 stages, 1 jobs",
    "artifacts_and_reports": "Observed CI outputs: artifacts; paths: app/build/reports",
    "secrets_handling": "Secrets protection configured",
    "external_systems": "No external system signals found",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    out = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (out / path).parent.mkdir(parents=True, exist_ok=True)
        (out / path).write_text(text)
    os.symlink(out / "README.md", out / "link.md")
    return str(out)


@pytest.fixture(scope="module")
def store(spark, root):
    out = Store(spark, root)
    assert out.status().state == "missing"
    assert out.refresh() == "scanned"
    return out


def test_tree_source(spark, root):
    rows = {r["path"]: r for r in read_tree(spark, root, exclude=["docs"]).collect()}
    assert set(rows) == set(TREE) - {"build/skipped.kt", "logo.PNG", "docs/README.md"}
    assert rows[".gitignore"]["content"] == TREE[".gitignore"] and rows["README.md"]["size"] == len(TREE["README.md"])
    assert all(r["content"] is None for r in read_tree(spark, root, text=False).collect())
    assert project_roots(root) == [""]


def test_sections(store):
    rows = {r["section"]: r for r in store.sections().collect()}
    assert len(rows) == 84 and {k: rows[k]["summary"] for k in EXPECTED} == EXPECTED
    assert not rows["external_systems"]["detected"] and rows["external_systems"]["evidence_total"] == 0
    told = {k: (r["detected"], r["error"]) for k, r in rows.items() if r["error"]}
    assert told == {"module_types": (False, "Omitted 2 invalid evidence entries"), "module_classification": (False, "Omitted 2 invalid evidence entries")}
    layers = store.layers().collect()
    assert [r["layer"] for r in layers] == list(registry.LAYERS) and sum(r["sections"] for r in layers) == 84


def test_no_secret_is_stored(store):
    shown = " ".join(str(r) for r in store._table("evidence").collect())
    assert "secretvalue123" not in shown and "accessToken" in shown


def test_readers(store, root, tmp_path, capsys):
    assert store.search("hilt injection", 3).first()["section"] == "di_framework"
    assert {r["layer"] for r in store.search("test", 50, "07_testing").collect()} == {"07_testing"}
    page, following = store.evidence_page("documentation_locations", None, 2)
    assert [r["path"] for r in page.collect()] == ["README.md", "docs/README.md"] and following == "2"
    over = store.overview()
    assert over["project"] == "demo-app" and over["highlights"]["identity"] == "rootProject.name = demo-app" and "03_architecture/concurrency" in over["undetected"]
    with pytest.raises(LookupError):
        store.section("01_overview", "nothing")
    texts = layer_texts(store.sections())
    assert len(texts) == 9 and "\\[+\\]" not in texts["01_overview"] and "demo-app" in texts["01_overview"]
    (tmp_path / "01_overview.md").write_text("my header\n")
    write_layers(store.sections(), str(tmp_path))
    assert (tmp_path / "01_overview.md").read_text().startswith("my header\n" + BEGIN)
    assert main(["--json", "status", root]) == 0 and json.loads(capsys.readouterr().out)["state"] == "fresh"
    assert main(["show", root, "01_overview"]) == 0
    text = capsys.readouterr().out
    assert text.startswith("01_overview  Project Overview\n\n[+] repository_identity" + " " * 13 + " rootProject.name = demo-app\n")
    assert main(["show", root, "01_overview", "documentation_locations", "--limit", "2"]) == 0
    assert capsys.readouterr().out == "Documentation Locations (documentation_locations)\nDetected: 3 documentation locations\n\n  README.md (file)  \n  docs/README.md (file)  \n  ... 1 more\n"
    assert main(["show", root, "nothing"]) == 1 and main(["status", f"{root}/docs"]) == 1
    assert main(["show", root, "01_overview", "nothing"]) == 1


def test_freshness(store, root):
    assert store.refresh() == "no_op" and store.status(verify_content=True).state == "fresh"
    os.utime(f"{root}/README.md", (1, 1))
    assert store.refresh() == "metadata_updated"
    layer = store.folder / "layers" / "01_overview.md"
    layer.write_text("mine\n" + layer.read_text())
    assert store.status().state == "fresh"
    layer.write_text(layer.read_text().replace("demo-app", "other"))
    assert store.status().state == "damaged" and store.refresh() == "artifacts_repaired"
    assert layer.read_text().startswith("mine\n") and "demo-app" in layer.read_text()
    assert store.refresh(fresh_headers=True) == "headers_refreshed" and layer.read_text().startswith(BEGIN)
    pointer = store.folder / "current.json"
    kept = pointer.read_text()
    for change, state in (({"schema_version": "3"}, "schema_mismatch"), ({"digest": "x"}, "damaged"), ({"evidence": "x"}, "damaged"), ({"generation": "gone"}, "damaged")):
        pointer.write_text(json.dumps(json.loads(kept) | change))
        assert store.status().state == state
    pointer.write_text("{broken")
    assert store.status().state == "damaged"
    pointer.write_text(kept)
    with open(f"{root}/README.md", "a") as f:
        f.write("more\n")
    assert store.status().state == "stale"
    with store.lock(), pytest.raises(BlockingIOError):
        store.refresh()


def test_evidence_is_capped_and_proven(spark):
    texts = [(f"src/F{i:03}.kt", "@Composable\n" * 3) for i in range(100)] + [("src/none.kt", None)]
    corpus = Corpus(spark.createDataFrame(texts, "path string, content string"))
    found = scan.matches(corpus)
    rows = scan.evidence(corpus, found).where("section = 'ui_technology_signals'").orderBy("ordinal").collect()
    assert [(r["path"], r["line_start"], r["ordinal"]) for r in rows] == [(f"src/F{i // 3:03}.kt", i % 3 + 1, i) for i in range(25)]
    assert {(r["evidence_total"], r["source_line_count"], len(r["source_digest"])) for r in rows} == {(200, 3, 64)}
    assert scan.evidence(corpus, found, None).where("section = 'ui_technology_signals'").count() == 200


def test_inventories_of_a_scan_are_counted_whole(spark):
    tags = "".join(f'Modifier.testTag("t{i}")\n' for i in range(5100))
    ids = "".join(f'<v android:id="@+id/i{i}"/>\n' for i in range(5200))
    rows = {r["section"]: r for r in scan.sections(Corpus(spark.createDataFrame([("a.kt", tags), ("res/b.xml", ids)], "path string, content string"))).collect()}
    assert (rows["test_tag_inventory"]["summary"], rows["test_tag_inventory"]["evidence_total"]) == ("5100 Compose test tags, 5200 view ids", 10300)


def test_sections_count_all_matches(spark):
    yml = "".join(f"  path: build/out{i}\n" for i in range(299, -1, -1)) + "".join(f"  - nightly{i} test{i}UnitTest\n" for i in range(300))
    texts = [(f"app/src/androidTest/F{i:03}Screen.kt", f"@Composable\nclass F{i:03}Screen\n") for i in range(250)] + [("ci.yml", yml), ("two.yml", "junit: x\n" * 201)]
    rows = {r["section"]: (r["summary"], r["evidence_total"]) for r in scan.sections(Corpus(spark.createDataFrame(texts, "path string, content string"))).collect()}
    assert rows["ui_technology_signals"] == ("@Composable usage", 250) and rows["screen_names_inventory"] == ("Found 250 Screen classes", 250)
    assert rows["scheduled_nightly_signals"] == ("Found 300 schedule-related rules", 300)
    tasks = ", ".join(sorted(f"test{i}UnitTest" for i in range(300))[:8])
    assert rows["test_tasks"] == (f"Observed task references: {tasks}", 300)
    outputs = rows["artifacts_and_reports"]
    assert outputs[0].endswith("; paths: " + ", ".join(f"build/out{i}" for i in range(299, 291, -1))) and outputs[1] == 501


def test_a_broken_detector_fails_alone(spark, monkeypatch):
    bad = dataclasses.replace(registry.DETECTORS[3], probes=(*registry.DETECTORS[3].probes, registry.lines("([", "**/*.kt")))
    monkeypatch.setattr(scan, "DETECTORS", [bad if d.id == bad.id else d for d in registry.DETECTORS])
    rows = {r["section"]: r for r in scan.sections(Corpus(spark.createDataFrame([("a.kt", "@Composable")], "path string, content string"))).collect()}
    assert (rows[bad.id]["detected"], rows[bad.id]["error"]) == (False, "Detector failed") and rows["compose_setup"]["detected"]


def test_status_lines_and_checkouts(tmp_path):
    assert Status("missing").line == "Nothing has been scanned; run a scan"
    assert Status("stale", "T", 3, "a" * 40, "b" * 40, 2).line == f"The scan is out of date; run a scan, scanned T, 3 files, built at {'a' * 12}, HEAD {'b' * 12}, 2 files changed since"
    assert checkout(str(tmp_path)) == Checkout() and changed_since(str(tmp_path), "x") is None
    git = ["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x"]
    (tmp_path / "a").write_text("1")
    for words in (["init", "-q"], ["add", "a"], ["commit", "-qm", "m"]):
        subprocess.run([*git, *words], check=True)
    here = checkout(str(tmp_path))
    assert len(here.commit) == 40 and here.dirty is False and os.path.samefile(here.root, tmp_path)
    (tmp_path / "a").write_text("2")
    assert checkout(str(tmp_path)).dirty and changed_since(str(tmp_path), here.commit.upper()) == 1


def test_exclusions(tmp_path):
    root = str(tmp_path)
    assert outermost(root, ["a/b", "a", "/elsewhere", "a/../c/d", "../x"]) == [f"{os.path.realpath(root)}/a", f"{os.path.realpath(root)}/c/d"]
    assert project_name.__doc__


def test_an_empty_corpus_has_every_section(spark):
    empty = Corpus(spark.createDataFrame([], "path string, content string"))
    rows = scan.sections(empty).collect()
    assert len(rows) == 84 and not any(r["detected"] for r in rows)


def test_registry():
    ids = [d.id for d in registry.DETECTORS]
    assert len(ids) == len(set(ids)) == 84 and {d.layer for d in registry.DETECTORS} == set(registry.LAYERS)
    assert all(d.missing and d.keywords and d.title for d in registry.DETECTORS)
    assert registry.catalogue().count("\n- ") == 84


def test_parsers():
    script = "android { productFlavors { demo { x { } }\n create('pro') { } register(\"lite\")\n if (a) { } } }"
    assert build_files.container_names(build_files.block(script, "productFlavors")) == ["demo", "pro", "lite"]
    assert build_files.block("buildTypes { a {", "buildTypes") == "" and build_files.block("x", "y") == ""
    assert build_files.included_modules("include ':a',\n  ':b:c'\n// include ':no'\ninclude(\n\":d\"\n)") == [":a", ":b:c", ":d"]
    assert build_files.project_dependencies('project(":x:y") projects.a.b projects.getByName') == [":a:b", ":x:y"]
    assert build_files.plugins("plugins { id('p.q') alias(libs.plugins.android.app) }\napply plugin: 'old'") == ["app", "old", "p.q"]
    assert build_files.catalog_facts("not toml [") == [("failure", "catalog", None)]
    assert build_files.manifest_facts("<broken") == [("failure", "manifest", None)]
    links = '<m xmlns:android="http://schemas.android.com/apk/res/android"><intent-filter><data android:host="h" android:port="1"/><data/></intent-filter><service android:name="s"><intent-filter/></service></m>'
    assert build_files.manifest_facts(links) == [("deep_link", "*://h:1", None), ("implicit_export", "service s", None)]
    assert build_files.ci_facts("stages:\n  - a\n.hidden:\nvariables:\njob one:\n  x: y\n# c:\n") == [("stage", "a", None), ("job", "job one", None)]
