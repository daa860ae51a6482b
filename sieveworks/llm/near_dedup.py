"""MinHash near-dedup by a chosen-path similarity join.

Every text is its set of distinct five-word shingles; equal sets are one class, named by a hash of
the set.  In each of ``trees`` trees a class starts at the root; each node chooses one or
two positions of the minwise signature, and a class moves to the child named by its token there.  Classes
that meet at a node are likely to be similar.

* A node of at most ``small`` members is compared by sketches (64 bytes each; a similarity of ``percent``
  falls below their threshold once in a million).  First the pairs of a spanning forest of what looks similar
  are confirmed on full sets; then, where members are still apart, all pairs that look similar.
* A larger node is first compared with one leader, the member of least hashed id.  Without a main component
  it goes ``step`` levels deeper, where unrelated members part, down to ``depth``.
* A larger node with a component of half its members, or at full depth, is dense, and so is a smaller one
  with more similar-looking pairs than ``pairs_each`` for each member.  Large ones are compared with a few
  more leaders.  Then the members outside the main component are the queries: they and all members are cut
  into blocks of at most about ``block_bytes`` of text and ``block_rows`` members, and each block of queries meets each block of members
  in one matrix product over full sets.  So no pair that meets at such a node is skipped, no group is
  collected anywhere, and a text is sent once for each opposing block, not for each partner.

A larger node whose members are one component needs no further comparison, nor does a smaller one where all
pairs of the spanning forest are joined, and only pairs between components are compared.  Texts are fetched for the classes that have a similar-looking partner or lie in a large node.
Links between components so far are joined in one task
while there are at most ``one_task`` of them, and beyond by passing on the least label, in tables.  Texts are joined by sort-merge at every size.  Every round is written to the shared folder, so lost executors cost one round at most.

Two sets of similarity s meet at level ``first`` of some tree with probability 1 - (1 - s**first)**trees at
least.  A pair that parts from its node only below, because the node is large and loose, has to meet again
``step`` levels down.  There each node doubles its path with probability ``branch``: the pair survives all eight
levels of a tree with probability 0.58 at a similarity of 0.85 (0.47 at 0.80), so 12 trees miss it with probability
0.005 (20 trees at 0.80: 0.004).
The tests measure both: pairs at the threshold, and a whole run in which every node is large and loose.

Defined results: a null or empty text has no shingles and is its own component; a row with a null id
is not compared, gets a null component and is kept; rows with the same id are compared each by its
own text; identical rows of a kept document are all kept.  An empty table gives no
rows.  Other columns are read only by :func:`keep_one`, which passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import chosen_path as kernel
from .common import discard, scratch, written


@dataclass(frozen=True)
class Join:
    percent: int = 85
    trees: int = 12
    first: int = 3
    step: int = 8
    depth: int = 11
    branch: float = 0.3
    small: int = 256
    leaders: int = 4
    pairs_each: int = 4
    block_bytes: int = 8_000_000
    block_rows: int = 2048
    one_task: int = 500_000

    @property
    def agreeing(self) -> int:
        """Equal sketch bytes that a pair must have: five deviations below the threshold."""
        s = self.percent / 100
        return int(kernel.SKETCH * s - 5 * (kernel.SKETCH * s * (1 - s)) ** 0.5)


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64), pa.int64())


def _lists(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    offsets = np.searchsorted(owner[order], np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _longs(values[order]))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _key() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")]


def describe(docs: DataFrame, how: Join) -> DataFrame:
    """``doc_id, h, n, s1, s2, bytes, sketch, nodes`` of each row of ``docs(doc_id, text)``; no nodes without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [kernel.shingles(t.as_py()) for t in batch.column(2)]
            signatures = np.stack([kernel.signature(s) for s in sets])
            keys = [kernel.set_key(s) for s in sets]
            doc, node = kernel.roots(len(sets), how.trees)
            doc, node = kernel.descend(doc, node, signatures, how.first, how.branch)
            filled = np.array([len(s) > 0 for s in sets])[doc]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pc.fill_null(pc.binary_length(batch.column(2)), 0).cast(pa.int64()), pa.array([r.tobytes() for r in kernel.sketch(signatures)], pa.binary()), _lists(doc[filled], node[filled], len(sets)),
                ],
                names=["doc_id", "h", "n", "s1", "s2", "bytes", "sketch", "nodes"],
            )

    return docs.select(*_key(), "text").mapInArrow(run, "doc_id long, h long, n long, s1 long, s2 long, bytes long, sketch binary, nodes array<long>")


def deeper(texts: DataFrame, how: Join) -> DataFrame:
    """``node, rep`` after ``step`` levels more, for ``texts(rep, text, nodes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            signatures = np.stack([kernel.signature(kernel.shingles(t.as_py())) for t in batch.column(1)])
            lists = batch.column(2)
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            node = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            doc, node = kernel.descend(doc, node, signatures, how.step, how.branch)
            doc, node = np.unique(np.stack([doc.astype(np.uint64), node]), axis=1)
            reps = batch.column(0).to_numpy(zero_copy_only=False)[doc.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([_longs(node), pa.array(reps, pa.int64())], names=["node", "rep"])

    return texts.select("rep", "text", "nodes").mapInArrow(run, "node long, rep long")


def _agree(pairs: DataFrame, how: Join) -> DataFrame:
    """``a, b`` of the pairs ``a, b, x, y`` whose sketches x and y agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, kernel.SKETCH) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= how.agreeing))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, how: Join) -> DataFrame:
    """``a, b`` of the pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.empty(0, np.uint64)
        for batch in batches:
            good = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:  # rows come sorted by b from the join
                    last, kept = b, kernel.shingles(y.as_py())
                good.append(kernel.similar(kernel.shingles(x.as_py()), kept, how.percent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _roots_in_one_task(edges: DataFrame) -> DataFrame:
    """``u, root`` by union-find over a bounded number of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                parent[max(a, b)] = min(a, b)
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([find(x) for x in parent], pa.int64())], names=["u", "root"])

    return written(edges.coalesce(1).mapInArrow(run, "u long, root long"), "component-roots")


def _roots_in_tables(edges: DataFrame) -> DataFrame:
    """``u, root`` by passing on the least label along edges and over labels, until none changes."""
    edges = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "component-links")
    roots = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "component-roots")
    while True:
        to = roots.select(F.col("u").alias("v"), F.col("root").alias("far"))
        heard = edges.join(to, "v").groupBy("u").agg(F.min("far").alias("far"))
        near = roots.join(heard, "u").select("u", "root", F.least("root", "far").alias("next"))
        hop = roots.select(F.col("u").alias("next"), F.col("root").alias("jump"))
        moved = written(near.join(hop, "next").select("u", F.least("next", "jump").alias("root"), (F.least("next", "jump") < F.col("root")).alias("moved")), "component-roots")
        changed = moved.where("moved").limit(1).count()
        discard(roots)
        roots = moved.select("u", "root")
        roots._sieveworks_path = moved._sieveworks_path
        if not changed:
            discard(edges)
            return roots


def components(labels: DataFrame, links: DataFrame, how: Join) -> DataFrame:
    """``rep, comp``: labels joined along ``links(a, b)``; links inside a component so far add nothing."""
    old = labels.select(F.col("rep").alias("a"), F.col("comp").alias("u"))
    ends = links.join(old, "a").join(old.select(F.col("a").alias("b"), F.col("u").alias("v")), "b").where("u <> v")
    edges = written(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "component-edges")
    few = edges.limit(how.one_task + 1).count()
    if not few:
        discard(edges)
        return labels
    roots = _roots_in_one_task(edges) if few <= how.one_task else _roots_in_tables(edges)
    out = written(labels.join(roots.select(F.col("u").alias("comp"), "root"), "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp")), "labels")
    discard(roots, edges, labels)
    return out


def sketch_pairs(members: DataFrame, how: Join) -> DataFrame:
    """``node, a, b, spans, crowded``: pairs of a node's ``members(node, rep, comp, sketch)`` in different components that look similar.

    ``spans`` marks those of a spanning forest, the most similar first.  Of a node with more than
    ``pairs_each`` pairs for each member, which is ``crowded``, there are no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            reps, comps = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("rep", "comp"))
            sketches = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, kernel.SKETCH)
            found: list[tuple[int, int, int, bool, bool]] = []
            for node, start, end in zip(batch.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                a, b, spans = kernel.look_similar(comps[start:end], sketches[start:end], how.agreeing)
                crowded = len(a) > how.pairs_each * (end - start)
                if crowded:
                    a, b, spans = a[spans], b[spans], spans[spans]
                found += zip([node] * len(a), reps[start:end][a].tolist(), reps[start:end][b].tolist(), spans.tolist(), [crowded] * len(a))
            if found:
                kinds = [pa.int64()] * 3 + [pa.bool_()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["node", "a", "b", "spans", "crowded"])

    grouped = members.groupBy("node").agg(F.collect_list(F.struct("rep", "comp", "sketch")).alias("members"))
    return grouped.mapInArrow(run, "node long, a long, b long, spans boolean, crowded boolean")


def _some(rows: DataFrame) -> bool:
    """Whether a written table has rows."""
    return rows.limit(1).count() > 0


class _Search:
    """State of one join: what is written so far.  Steps without rows are not taken."""

    def __init__(self, sketches: DataFrame, how: Join):
        self.sketches, self.how = sketches, how
        self.labels = written(sketches.select("rep", F.col("rep").alias("comp")), "labels")
        self.texts: DataFrame | None = None
        self.tried: list[DataFrame] = []

    def new_pairs(self, pairs: DataFrame) -> DataFrame:
        """``a, b`` of ``pairs(a, b)`` that have not been compared, written."""
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried:
            ordered = ordered.join(reduce(DataFrame.unionByName, self.tried), ["a", "b"], "left_anti")
        self.tried.append(written(ordered, "pairs"))
        return self.tried[-1]

    def compare(self, pairs: DataFrame) -> None:
        """Confirm written ``pairs`` on full sets and join components along links."""
        if _some(pairs):
            self.join(_confirmed(pairs, self.texts, self.how))

    def join(self, links: DataFrame) -> None:
        links = written(links, "links")
        if _some(links):
            self.labels = components(self.labels, links, self.how)
        discard(links)

    def named(self, nodes: DataFrame) -> DataFrame:
        """``node, rep, n, comp, bytes, sketch``, written."""
        return written(nodes.select("node", "rep", "n").join(self.labels, "rep").join(self.sketches, "rep"), "named-nodes")

    def split(self, nodes: DataFrame) -> DataFrame:
        """``node, rep, n`` of the nodes whose members are not one component."""
        own = nodes.select("node", "rep").join(self.labels, "rep")
        apart = own.groupBy("node").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
        return nodes.select("node", "rep", "n").join(apart, "node", "left_semi")

    def still_apart(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` whose ``a`` and ``b`` are in different components, written."""
        ends = self.labels.select(F.col("rep").alias("a"), F.col("comp").alias("u"))
        both = pairs.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("u").alias("v")), "b")
        return written(both.where("u <> v").select(*pairs.columns), "apart-pairs")

    def open(self, nodes: DataFrame, apart: DataFrame) -> DataFrame:
        """:meth:`named` for the nodes that may hold a link between components beside the pairs known.

        These are larger nodes whose members are not one component, and crowded ones of :func:`sketch_pairs`
        with a pair that is still ``apart``: if no pair of the forest is, no pair that looks similar is.
        """
        crowded = nodes.join(apart.where("crowded").select("node").distinct(), "node", "left_semi")
        return self.named(crowded.select("node", "rep", "n").unionByName(self.split(nodes.where(F.col("n") > self.how.small))))

    def of_sketches(self, named: DataFrame) -> DataFrame:
        """:func:`sketch_pairs` of the nodes of at most ``small`` members."""
        return sketch_pairs(named.where(F.col("n") <= self.how.small), self.how)

    def of_leaders(self, named: DataFrame) -> DataFrame:
        """``a, b``: members of larger nodes and their leader, if in different components and similar by sketch."""
        large = named.where(F.col("n") > self.how.small)
        lead = written(large.groupBy("node").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "comp", "sketch")).alias("lead")), "node-leaders")
        pairs = large.join(lead, "node").where(F.col("comp") != F.col("lead.comp"))
        return _agree(pairs.select(F.col("rep").alias("a"), F.col("lead.rep").alias("b"), F.col("sketch").alias("x"), F.col("lead.sketch").alias("y")), self.how)

    def first_pairs(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What :meth:`of_sketches` finds, and the pairs to compare first, both written."""
        named = self.named(nodes)
        alike = written(self.of_sketches(named), "similar-pairs")
        pairs = alike.where("spans").select("a", "b")
        if _some(named.where(F.col("n") > self.how.small)):
            pairs = pairs.unionByName(self.of_leaders(named))
        out = self.new_pairs(pairs)
        discard(named)
        return alike, out

    def with_kind(self, nodes: DataFrame, deepest: bool) -> DataFrame:
        """The larger nodes with ``dense``: whether one component has half of the members or more, or no level is below."""
        large = nodes.where(F.col("n") > self.how.small)
        if deepest:
            return large.withColumn("dense", F.lit(True))
        main = large.groupBy("node", "comp").agg(F.count("*").alias("k"), F.max("n").alias("n")).where("2 * k >= n").select("node", F.lit(True).alias("dense")).distinct()
        return written(large.join(main, "node", "left").withColumn("dense", F.coalesce("dense", F.lit(False))), "large-nodes")

    def outside(self, nodes: DataFrame) -> DataFrame:
        """The members that are not in their node's main component."""
        sizes = nodes.groupBy("node", "comp").agg(F.count("*").alias("k"))
        main = written(sizes.groupBy("node").agg(F.max(F.struct("k", "comp")).alias("m")).select("node", F.col("m.comp").alias("main")), "main-components")
        return nodes.join(main, "node").where("comp <> main").drop("main")

    def of_more_leaders(self, dense: DataFrame) -> DataFrame:
        """``a, b``: members of dense nodes and a few outside the main component, similar by sketch."""
        ranked = self.outside(dense).withColumn("h", F.xxhash64("rep")).selectExpr("node", "rep", "comp", "sketch", "row_number() OVER (PARTITION BY node ORDER BY h, rep) AS k")
        chosen = written(ranked.where(F.col("k") <= self.how.leaders).select("node", F.col("rep").alias("b"), F.col("comp").alias("other"), F.col("sketch").alias("y")), "node-leaders")
        pairs = dense.select("node", F.col("rep").alias("a"), "comp", F.col("sketch").alias("x")).join(chosen, "node").where("comp <> other")
        return _agree(pairs, self.how)

    def in_blocks(self, nodes: DataFrame) -> None:
        """Compare the members of ``nodes(node, rep, n, comp, bytes)`` outside the main component with all, on full sets."""
        how = self.how
        queries = written(self.outside(nodes).select("node", "rep", "comp", "bytes"), "node-queries")
        if not _some(queries):
            return discard(queries)
        blocks = F.ceil(F.greatest(F.sum("bytes") / how.block_bytes, F.count("*") / how.block_rows)).cast("int")
        counts = queries.groupBy("node").agg(blocks.alias("q_blocks")).join(nodes.groupBy("node").agg(blocks.alias("m_blocks")), "node")
        counts = written(counts, "node-blocks")

        def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
            block = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int")
            each = rows.select("node", "rep", "comp").join(counts, "node").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            return each.select("node", "rep", "comp", "own", "other")

        asked = spread(queries, "q_blocks", "m_blocks").select("node", F.col("own").alias("q"), F.col("other").alias("m"), "rep", "comp", F.lit(True).alias("asks"))
        there = spread(nodes, "m_blocks", "q_blocks").select("node", F.col("other").alias("q"), F.col("own").alias("m"), "rep", "comp", F.lit(False).alias("asks"))
        members = asked.unionByName(there).join(self.texts.hint("merge"), "rep")
        groups = members.groupBy("node", "q", "m").agg(F.collect_list(F.struct("rep", "comp", "asks", "text")).alias("members"))
        self.join(groups.select("members").mapInArrow(_block_links(how.percent), "a long, b long").distinct())
        discard(queries, counts)


def _block_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                rows = group.as_py()
                sides = [[r for r in rows if r["asks"] is asks] for asks in (True, False)]
                found = kernel.joining_links(*([(r["rep"], r["comp"], kernel.shingles(r["text"])) for r in side] for side in sides), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def _shared(nodes: DataFrame) -> DataFrame:
    """``node, rep, n``: nodes of two members or more."""
    nodes = written(nodes, "nodes")
    sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    out = written(nodes.join(sizes, "node").select("node", "rep", "n"), "shared-nodes")
    discard(nodes)
    return out


def _component_labels(classes: DataFrame, docs: DataFrame, how: Join) -> DataFrame:
    """``rep, comp`` of the classes that share a node with another, written."""
    nodes = _shared(classes.select(F.explode(F.array_distinct("nodes")).alias("node"), "rep"))
    sketches = written(classes.select("rep", "bytes", "sketch").join(nodes.select("rep").distinct(), "rep", "left_semi"), "sketches")
    search, depth = _Search(sketches, how), how.first
    while True:
        alike, pairs = search.first_pairs(nodes)
        if search.texts is None:
            needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(nodes.where(F.col("n") > how.small).select("rep")).distinct()
            needed = written(classes.select("rep", "doc_id", "h").join(needed, "rep", "left_semi"), "involved")
            search.texts = written(docs.select(*_key(), "text").join(needed.hint("merge"), ["doc_id", "h"]).groupBy("rep").agg(F.max("text").alias("text")), "texts")
            discard(needed)
        search.compare(pairs)
        apart = search.still_apart(alike)
        unsolved = search.open(nodes, apart)
        discard(nodes, alike)
        pairs = apart.where("NOT spans").select("a", "b")
        if not _some(unsolved):
            search.compare(search.new_pairs(pairs))
            return search.labels
        large = search.with_kind(unsolved, depth >= how.depth)
        dense = large.where("dense").drop("dense")
        some_dense = _some(dense)
        search.compare(search.new_pairs(pairs.unionByName(search.of_more_leaders(dense)) if some_dense else pairs))
        crowded = unsolved.where(F.col("n") <= how.small)
        if some_dense or _some(crowded):
            crowded = search.named(crowded.unionByName(dense) if some_dense else crowded)
            search.in_blocks(crowded)
        loose = large.where("NOT dense").drop("dense")
        if not _some(loose):
            return search.labels
        lists = written(search.split(loose).groupBy("rep").agg(F.collect_set("node").alias("nodes")), "loose-members")
        texts = written(search.texts.join(lists.hint("merge"), "rep"), "loose-texts")
        discard(search.texts, unsolved, apart, crowded, large, lists)
        nodes, search.texts = _shared(deeper(texts, how)), texts.select("rep", "text")
        search.texts._sieveworks_path = texts._sieveworks_path
        depth += how.step


def _linked(docs: DataFrame, how: Join) -> DataFrame:
    """``doc_id, h, n, component_id``; ``h`` tells texts with the same id apart."""
    described = written(describe(docs, how), "described")
    rows = written(described.select("doc_id", "h", "n", "s1", "s2"), "set-keys")
    known = described.where("doc_id IS NOT NULL AND n > 0")
    one = F.min(F.struct("doc_id", "h", "bytes", "sketch", "nodes")).alias("m")
    classes = written(known.groupBy("s1", "s2", "n").agg(one, F.count("*").alias("copies")).select(F.col("s1").alias("rep"), "s2", "m.*", "copies"), "classes")
    discard(described)
    with scratch(docs.sparkSession) as keep:
        labels = _component_labels(classes, docs, how)
        keep(labels)
    named = classes.join(labels, "rep", "left").select(F.col("rep").alias("s1"), "s2", F.coalesce("comp", "rep").alias("comp"), "doc_id", "copies")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component"), F.sum("copies").alias("rows")).where("rows > 1").drop("rows")
    joined = written(named.join(least, "comp").select("s1", "s2", "component"), "joined-classes")
    discard(classes, labels)
    out = rows.join(joined, ["s1", "s2"], "left")
    linked = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "h", "n", linked.alias("component_id"))


def link(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``."""
    out = _linked(docs, how).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The rows of ``docs`` that :func:`link` keeps, all columns unchanged."""
    gone = _linked(docs.select("doc_id", "text"), how).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("h").alias("_text")).distinct()
    gone = written(gone, "near-copies")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    same = (F.col("_row.doc_id").cast("long") == F.col("_gone")) & (F.col("_h") == F.col("_text"))
    return docs.select(whole, F.xxhash64("text").alias("_h")).join(gone.hint("merge"), same, "left_anti").select("_row.*")
