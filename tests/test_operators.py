"""Operators on small corpora."""

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import collect, fingerprint, grep, inventory, lookup, search, sections
from sieveworks.sources.corpus import Corpus


@pytest.fixture(scope="module")
def corpus(spark):
    files = [("a/b/x.kt", "One\ntwo one\n\nthree"), ("a-b/y.kt", "ONE"), ("a/z.md", "none\r\none"), ("r.md", None), ("src/demo/java/q.kt", "")]
    return Corpus.from_table(spark.createDataFrame(files, "p string, t string"), F.col("p"), F.col("t"))


def values(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.collect()]


def test_lines_and_dirs(corpus):
    assert len(values(corpus.lines, "path")) == 7
    assert set(values(corpus.dirs, "path", "name", "parent", "depth")) >= {("a", "a", "", 1), ("a/b", "b", "a", 2), ("src/demo/java", "java", "src/demo", 3)}
    assert values(lookup.nearest_root(corpus.dirs), "path") == [("a",)]
    assert values(lookup.find_first(corpus.files, ["none", "r.md", "a/z.md"]), "path") == [("r.md",)]
    assert set(values(lookup.dirs_with_files(corpus.dirs, corpus.files.where("content LIKE '%two%'")), "path")) == {("a",), ("a/b",)}
    assert values(lookup.named_children(corpus.dirs, "src", ["main"], ["java"]), "path") == [("src/demo",)]


def test_grep_order_cap_case_and_tiers(corpus):
    rule = grep.Rule("one", "one")
    found = grep.grep(corpus.lines, [rule])
    assert sorted(values(found, "path", "line", "match_text")) == [("a-b/y.kt", 1, "ONE"), ("a/b/x.kt", 1, "One"), ("a/b/x.kt", 2, "one"), ("a/z.md", 1, "one"), ("a/z.md", 2, "one")]
    assert sorted(values(grep.capped(found, 3), "path", "line")) == [("a/b/x.kt", 1), ("a/b/x.kt", 2), ("a/z.md", 1)]  # by components: a before a-b
    assert values(grep.grep(corpus.lines, [grep.Rule("c", "ONE", case_sensitive=True)]), "path") == [("a-b/y.kt",)]
    every = grep.grep(corpus.lines, [grep.Rule("e", "[a-z]+", globs=("a/b/*",), every_match=True)])
    assert sorted(values(every, "line", "ordinal", "match_text")) == [(1, 1, "One"), (2, 1, "two"), (2, 2, "one"), (4, 1, "three")]
    tiers = [grep.Rule("t0", "zero", label="L", tier=0), grep.Rule("t1", "two", label="L", tier=1), grep.Rule("t2", "one", label="L", tier=2)]
    assert values(grep.first_tier(grep.grep(corpus.lines, tiers)), "rule_id") == [("t1",)]
    assert values(grep.grep_whole(corpus.files, "one\\s+three", ("**/*.kt",)), "line_start", "line_end", "match_text") == [(2, 4, "two one")]


def test_collect(spark):
    rows = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "b", 3), ("j", "c", 4)], "k string, v string, at int")
    assert dict(values(collect.joined_first_seen(rows, ["k"], "v", ["at"]), "k", "summary")) == {"k": "b, a", "j": "c"}
    assert set(values(collect.sorted_names(rows, ["k"], "v", 1), "k", "names", "n_names")) == {("k", "a", 2), ("j", "c", 1)}
    assert values(collect.counted_groups(rows, "v", ["at"]).orderBy("place"), "v", "n") == [("b", 2), ("a", 1), ("c", 1)]
    assert set(values(collect.edges(rows, "k", "v").unionByName(collect.edges(rows, "v", "v")), "src", "dst")) == {("k", "b"), ("k", "a"), ("j", "c")}
    assert dict(values(collect.all_hold(rows, ["k"], F.when(F.col("at") != 4, True)), "k", "complete")) == {"k": True, "j": False}
    assert values(rows.select(collect.claimed_by(F.col("v"), [("x", ["a"]), ("y", ["a", "b"])]).alias("g")), "g") == [("y",), ("x",), ("y",), (None,)]


def test_inventories(spark):
    found = spark.createDataFrame([("s", "b", 1), ("s", "a", 2), ("s", "b", 3), ("s", "c", 4)], "s string, v string, at int")
    items = inventory.items(found, ["s"], "v", ["at"])
    assert sorted(values(items, "ordinal", "value", "n_evidence")) == [(0, "b", 2), (1, "a", 1), (2, "c", 1)]
    assert values(inventory.with_limit(items, ["s"], 2), "n_items", "completeness", "stop_reason") == [(2, "incomplete", "collection limit 2 reached")]
    assert values(inventory.with_limit(items, ["s"], 3), "n_items", "completeness", "stop_reason") == [(3, "complete", None)]
    assert values(inventory.page(items, ["s"], 1, 1), "value", "total", "next_cursor") == [("a", 3, "2")]
    assert values(inventory.page(items, ["s"], 2, 5), "value", "next_cursor") == [("c", None)]
    assert [inventory.clamped(n, 50) for n in (-1, 7, 80)] == [1, 7, 50]
    for bad in ("", "-1", "01", "one", "999", "+1", "1.0", "\u0661"):
        with pytest.raises(ValueError):
            inventory.checked_cursor(bad, 10)
    assert inventory.checked_cursor(None, 0) == 0 and inventory.checked_cursor("10", 10) == 10


def test_sections(spark):
    shape = "path string, provenance string, line_start int, line_end int, source_line_count int, source_digest string, project string, property string"
    good = "0" * 64
    rows = [("a", "source_lines", 1, 2, 2, good, None, None), ("a", "file", None, None, None, None, None, None), (None, "gradle_model", None, None, None, None, ":a", "p"), ("a", "source_lines", 2, 3, 2, good, None, None), ("a", "source_lines", 0, 1, 2, good, None, None), ("a", "source_lines", 1, 1, 2, "x", None, None), ("a", "file", 1, None, None, None, None, None), ("a", None, 1, 1, 1, good, None, None)]
    evidence = spark.createDataFrame(rows, shape)
    assert sections.accepted(evidence).count() == 3
    assert values(sections.rejections(evidence.withColumn("s", F.lit(1)), ["s"]), "rejected", "error") == [(5, "Omitted 5 invalid evidence entries")]
    capped = sections.capped_evidence(evidence.withColumn("s", F.lit(1)), ["s"], [F.col("path"), F.col("line_end")], 2)
    assert sorted(values(capped, "ordinal", "evidence_total")) == [(0, 8), (1, 8)]
    assert sections.capped_evidence(evidence.withColumn("s", F.lit(1)), ["s"], [F.col("path")], None).count() == 8
    base = spark.createDataFrame([("l", "a", "x"), ("l", "b", "y")], "layer string, section string, summary string")
    other = spark.createDataFrame([("l", "b", None)], "layer string, section string, summary string")
    assert set(values(sections.merged(base, other, ["layer", "section"], ["summary"]), "section", "summary", "overridden")) == {("a", "x", False), ("b", None, True)}


def test_search(spark):
    docs = spark.createDataFrame([("l1", 1, "hilt module for dependency injection", True), ("l1", 2, "hilt " * 3 + "padding " * 40, False), ("l2", 3, "network layer", False), ("l2", 4, None, True)], "layer string, id int, text string, found boolean")
    plain = values(search.search(docs, "where is hilt", ["id"], "text", 10), "id", "matched_terms")
    assert plain == [(1, "hilt"), (2, "hilt")] or plain == [(2, "hilt"), (1, "hilt")]
    scores = dict(values(search.search(docs, "hilt", ["id"], "text", None), "id", "score"))
    boosted = dict(values(search.search(docs, "hilt", ["id"], "text", None, detected=F.col("found")), "id", "score"))
    assert abs(boosted[1] - scores[1] * search.DETECTED_BOOST) < 1e-5 and boosted[2] == scores[2]
    inside = dict(values(search.search(docs, "hilt network", ["id"], "text", None, where=F.col("layer") == "l1"), "id", "score"))
    assert set(inside) == {1, 2} and inside[1] == scores[1]  # the filter does not change the statistics
    assert search.search(docs.limit(0), "hilt", ["id"], "text", 5).count() == 0
    assert dict(values(search.document_frequency(docs, "id", "text").where("term = 'hilt'"), "term", "df")) == {"hilt": 2}


def test_fingerprints(spark):
    import hashlib

    rows = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, d string").repartition(2)
    line = F.concat("path", "d")
    assert fingerprint.fold(rows, line, "path").first()["digest"] == hashlib.sha256(b"a1b2").hexdigest()
    assert fingerprint.bucketed_fold(rows, line, "path").first() == fingerprint.bucketed_fold(rows.repartition(3), line, "path").first()
    left = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    right = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, digest string")
    assert set(values(fingerprint.differences(left, right), "path", "change")) == {("b", "changed"), ("c", "missing"), ("d", "added")}
