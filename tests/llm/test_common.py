"""Plumbing of intermediate tables."""

from types import SimpleNamespace

import pytest

from sieveworks.llm.common import discard, recorded, scratch, shared_dir, written


def session_of(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder), sparkContext=SimpleNamespace(master=master))


def test_no_folder_of_one_machine_on_a_cluster():
    assert shared_dir(session_of("spark://a:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session_of("local[4]")).startswith("file:///")
    for master in ("spark://a:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session_of(master))


def test_scratch_tables_go(spark):
    frame = spark.range(5)
    with recorded() as made:
        with scratch(spark) as keep:
            gone, kept = written(frame, "gone"), written(frame, "kept")
            keep(kept)
        assert kept.count() == 5 and made == [kept._sieveworks_path]
        with pytest.raises(Exception, match="(?i)exist"):
            gone.count()
    discard(kept)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
