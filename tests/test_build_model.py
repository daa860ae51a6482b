"""Sections from a recorded build model."""

import json

import pytest

from sieveworks.plans.model_sections import complete, sections, with_model
from sieveworks.sources.build_model import chosen_block, projects

APP = {
    "path": ":app", "dir": "/r/app", "plugins": ["com.android.application"], "projectDependencies": [":app", ":core"], "projectDependenciesComplete": True,
    "android": {"namespace": "n", "minSdk": 26, "testInstrumentationRunner": "x.Runner", "buildTypes": ["debug", "release"], "flavorDimensions": ["env"], "productFlavors": [{"name": "demo", "dimension": "env", "applicationIdSuffix": ".demo"}, {"name": "prod", "dimension": "env"}], "testOptions": {"animationsDisabled": False}, "unavailableProperties": []},
}
MODEL = {"gradleVersion": "8", "rootProject": "m", "rootDir": "/r", "projects": [{"path": ":", "plugins": [], "projectDependencies": []}, APP, {"path": ":core", "plugins": ["com.android.library"], "projectDependencies": [], "projectDependenciesComplete": True}]}
OUTPUT = f"> Task :help\nX_MODEL_BEGIN\n{json.dumps({'rootDir': '/r/buildSrc', 'projects': []})}\nX_MODEL_END\nX_MODEL_BEGIN\n{json.dumps(MODEL)}\nX_MODEL_END\n"


def test_blocks():
    assert json.loads(chosen_block(OUTPUT, "/r"))["rootProject"] == "m"
    for root in (None, "/other"):
        with pytest.raises(ValueError):
            chosen_block(OUTPUT, root)


def test_sections(spark):
    rows = {r["section"]: r for r in sections(projects(spark, OUTPUT, "/r")).collect()}
    assert {k: (r["summary"], r["completeness"]) for k, r in rows.items()} == {
        "full_module_list": ("2 modules configured by Gradle", "complete"),
        "module_classification": ("application: 1, library: 1", "complete"),
        "module_dependency_graph": ("1 dependencies between 3 modules", "unknown"),
        "build_types_flavors_dimensions": (":app (build types: debug, release; dimensions: env; 2 flavours: demo, prod)", "complete"),
        "brands_flavors_presence": (":app: 2 product flavours across dimensions env; 1 with applicationId suffix", "complete"),
        "test_config_knobs": ("Observed Gradle test configuration: :app - testInstrumentationRunner = x.Runner; :app - testOptions.animationsDisabled = False", "complete"),
    }
    assert rows["build_types_flavors_dimensions"]["items"][2] == ":app - flavour: demo (dimension env), applicationIdSuffix .demo"
    assert rows["module_dependency_graph"]["items"] == [":app -> :core"]
    scanned = spark.createDataFrame([(0, "04_modules_map", "full_module_list", "signal", False, "none", 0), (1, "x", "y", "signal", True, "s", 3)], "place int, layer string, section string, kind string, detected boolean, summary string, evidence_total long")
    merged = [tuple(r) for r in with_model(scanned, sections(projects(spark, OUTPUT, "/r"))).collect()]
    assert merged == [(0, "04_modules_map", "full_module_list", "inventory", True, "2 modules configured by Gradle", 2, "gradle"), (1, "x", "y", "signal", True, "s", 3, "scan")]


def test_unknown_is_not_complete(spark):
    for missing, expected in ((["testOptions"], False), (None, False), ([], True)):
        app = json.loads(json.dumps(APP))
        app["android"]["unavailableProperties"] = missing
        text = f"MODEL_BEGIN\n{json.dumps(MODEL | {'projects': [app]})}\nMODEL_END\n"
        assert complete(projects(spark, text), ["testOptions"]).first()["complete"] is expected
    assert complete(projects(spark, "MODEL_BEGIN\n{\"projects\": []}\nMODEL_END\n"), []).first()["complete"] is False
