"""Near-dedup and mixing."""

import random
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from sieveworks.llm import chosen_path as kernel
from sieveworks.llm.mixing import Mix, exact_weights, mixed, one_period, plan_mix, schedule, whole_shares
from sieveworks.llm.near_dedup import Join, _Search, keep_one, link

from .conftest import prose


def shingle_set(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = lowered.replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(rng, sizes):
    """Groups of near copies of one text, with one to a few words changed in each."""
    docs, number = [], 0
    for size in sizes:
        base = prose(rng, 200, 10_000).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
            docs.append((number, " ".join(words)))
            number += 1
    return docs


@pytest.mark.parametrize("how", [Join(), Join(small=4, depth=5, leaders=2, one_task=0)], ids=["usual", "dense nodes, labels in tables"])
def test_components_match_brute_force(spark, how):
    rng = random.Random(9)
    docs = families(rng, [1] * 30 + [2] * 10 + [6] * 4 + [40])
    docs += [(5000, docs[3][1]), (5001, docs[3][1].upper()), (5002, "one two"), (5003, "One\ttwo"), (5004, ""), (5005, None)]
    boiler = prose(rng, 150, 10_000)
    docs += [(6000 + i, boiler + " " + prose(rng, 60, 10_000)) for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link(spark.createDataFrame(docs, "doc_id long, text string"), how).collect()}
    assert got == brute_components(docs)


def test_recall_where_nodes_are_large_and_loose(spark):
    """Boilerplate brings all documents together; pairs at the threshold have to be found levels below."""
    rng = random.Random(77)
    boiler = prose(rng, 130, 10_000)
    docs, pairs = [], []
    for i in range(250):
        own = prose(rng, 110, 10**6).split()
        other = list(own)
        for k in rng.sample(range(110), rng.randrange(3, 5)):
            other[k] = f"n{rng.randrange(10**6)}"
        docs += [(2 * i, boiler + " " + " ".join(own)), (2 * i + 1, boiler + " " + " ".join(other))]
        a, b = (shingle_set(t) for _, t in docs[-2:])
        if 100 * len(a & b) >= 85 * len(a | b):
            pairs.append(2 * i)
    how = Join(small=8, block_rows=16)
    got = {r["doc_id"]: r["component_id"] for r in link(spark.createDataFrame(docs, "doc_id long, text string"), how).collect()}
    found = sum(got[i] == got[i + 1] == i for i in pairs)
    assert len(pairs) > 150 and found >= 0.9 * len(pairs)
    assert all(c in (i, i - i % 2) for i, c in got.items())


def test_compared_nodes_are_not_opened_again(spark, monkeypatch):
    """Nodes of loose boilerplate, joined pairs and pairs below the threshold hold no pair that is not compared yet."""
    rng = random.Random(78)
    boiler = prose(rng, 100, 10_000)
    docs = []
    for i in range(40):
        own = (boiler + " " + prose(rng, 100, 10**6)).split()
        other = list(own)
        for k in range(1 if i % 2 else 6):
            other[110 + 15 * k] = f"n{i}"
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    opened, before = [], _Search.open

    def counted(self, *nodes):
        out = before(self, *nodes)
        opened.append(out.count())
        return out

    monkeypatch.setattr(_Search, "open", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs) and len({c for _, c in got.values()}) == 60
    assert opened == [0]


def test_near_dedup_odd_rows(odd_docs, no_docs):
    got = link(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[6][0]["component_id"] == 5 and not by[6][0]["kept"] and by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert [r["n_shingles"] for r in by[2] + by[3] + by[4]] == [0, 0, 0] and all(r["kept"] for r in by[7] + by[8])
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
    assert link(no_docs).count() == 0 and keep_one(no_docs).count() == 0


def test_kernels():
    text = "The  quick\tbrown fox\njumps over THE lazy dog"
    assert np.array_equal(kernel.shingles(text), kernel.shingles("the quick brown fox jumps over the lazy dog"))
    assert len(kernel.shingles("a b c d e f")) == 2 and len(kernel.shingles("a b")) == 1 and len(kernel.shingles(" ")) == 0
    assert not np.array_equal(kernel.shingles("a b"), kernel.shingles("a b c"))
    rng = random.Random(10)
    found = 0
    for _ in range(200):  # pairs just at the threshold meet in some tree
        base = [rng.randrange(2**63) for _ in range(400)]
        a = np.array(sorted(base), np.uint64)
        b = np.array(sorted(base[:368] + [rng.randrange(2**63) for _ in range(32)]), np.uint64)
        signatures = np.stack([kernel.signature(a), kernel.signature(b)])
        doc, node = kernel.descend(*kernel.roots(2, 12), signatures, 3, 0.3)
        found += bool(set(node[doc == 0]) & set(node[doc == 1]))
    assert found >= 198


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": 1 + i % 7 for i in range(40)}, {"a": 1e-9, "b": 1.0}])
def test_schedule_deviates_by_less_than_a_block(weights):
    shares = whole_shares(weights, 256)
    period = one_period(shares)
    total = sum(shares.values())
    assert total >= 256 and len(period) == total and min(shares.values()) >= 1
    given = dict.fromkeys(shares, 0)
    for source, block, release, deadline, slot in period:
        assert block == given[source] and release <= slot < deadline
        given[source] += 1
        assert all(abs(given[s] * total - shares[s] * (slot + 1)) < total for s in shares)


def test_documents_follow_the_schedule(spark, odd_docs, no_docs):
    rng = random.Random(11)
    docs = [(i, "x" * rng.randrange(1, 300), "hot" if i % 2 else f"s{i % 10}", "y") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, _slot string").repartition(5)
    how = Mix(block_bytes=1000, buckets=8, period=64)
    rows = plan_mix(frame, how).select("_row.doc_id", "_row.text", "_source", "_start", "_block", "_release", "_deadline", "_slot").collect()
    assert len(rows) == 400
    by = defaultdict(list)
    for r in rows:
        by[r["_source"]].append(r)
        assert r["_block"] == r["_start"] // 1000 and r["_release"] <= r["_slot"] < r["_deadline"]
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["_start"]):
            assert r["_start"] == at
            at += len(r["text"])
    assert len({r["_slot"] for r in rows}) == len({(r["_source"], r["_block"]) for r in rows})
    out = mixed(frame, how)
    slots = {r["doc_id"]: (r["_slot"], r["_start"]) for r in rows}
    order = [slots[r["doc_id"]] for r in out.collect()]
    assert out.columns == frame.columns and order == sorted(order)
    few = plan_mix(frame, Mix(max_sources=2, block_bytes=1000, period=64))
    assert few.count() == 400
    given = plan_mix(frame, Mix(weights={"hot": 0.1, "s2": 0.9}, block_bytes=1000, period=64))
    assert given.count() == 400
    larger = plan_mix(frame, Mix(block_bytes=1000, most_blocks=10)).collect()
    size = -(-sum(len(d[1]) for d in docs) // 10)
    assert all(r["_block"] == r["_start"] // size for r in larger) and len({r["_slot"] for r in larger}) <= 10 + 6
    odd = mixed(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count() and mixed(no_docs).count() == 0


def test_schedule_keeps_to_the_exact_weights():
    weights = exact_weights({f"s{i}": (1000.0 + 777 * i * i) ** 0.5 for i in range(20)} | {"nought": 0.0, "tenth": 0.1})
    total, blocks = sum(weights.values()), 2000
    given, last = dict.fromkeys(weights, 0), {}
    assert "nought" not in weights
    for source, block, release, deadline, slot in schedule([(s, w, blocks) for s, w in weights.items()], total):
        assert block == given[source] and release == block * total // weights[source] <= slot < deadline == -(-(block + 1) * total // weights[source])
        given[source] += 1
        last.setdefault(source, slot) if given[source] == blocks else None
        if not last:  # no slot is empty and no source a block off, over many periods
            assert sum(given.values()) == slot + 1 and all(abs(given[s] * total - w * (slot + 1)) < total for s, w in weights.items())
    assert min(last.values()) > 8 * 1024 and set(given.values()) == {blocks}


def test_mix_keeps_to_the_target_weights(spark):
    sizes = {"a": 2000, "b": 700, "c": 300}
    docs = [(k, "x" * 10, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    roots = {f"s:{s}": Fraction(float(10 * n) ** 0.5) for s, n in sizes.items()}
    exact = {s: w / sum(roots.values()) for s, w in roots.items()}
    rows = plan_mix(frame, Mix(block_bytes=10, buckets=8)).orderBy("_slot").collect()
    assert len(rows) == 3000 and all(r["_release"] == r["_block"] // exact[r["_source"]] and r["_deadline"] == -(-(r["_block"] + 1) // exact[r["_source"]]) for r in rows)
    given = dict.fromkeys(exact, 0)
    for slot, r in enumerate(rows):
        if r["_slot"] >= 300 / exact["s:c"]:  # where the first source runs out
            break
        given[r["_source"]] += 1
        assert r["_slot"] == slot and all(abs(given[s] - w * (slot + 1)) < 1 for s, w in exact.items())
    assert given["s:c"] >= 299
