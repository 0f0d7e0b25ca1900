"""Grouping over an edge list: connected components and deterministic pivot clusters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic import session

#: Edges (16 bytes each) that one task resolves by itself, and that are contracted at once before the first round.
TASK_EDGES, CHUNK_EDGES = 500_000, 1 << 18


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list, ascending, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return nodes, nodes[root]
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _resolved(edges: DataFrame, chunk: int | None) -> DataFrame:
    """u, v: nodes and their smallest connected node, of each ``chunk`` edges or (None) of a whole partition; with all nodes in
    the latter case, else without a component's smallest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def done():
            nodes, root = _roots(*(np.concatenate(x) for x in zip(*held)))
            keep = slice(None) if chunk is None else nodes != root
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], ["u", "v"])

        for b in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            rows += b.num_rows
            if chunk is not None and rows >= chunk:
                yield done()
                held, rows = [], 0
        if rows:
            yield done()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def connected_components(spark: SparkSession, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has an edge.

    ``edges`` has two bigint columns ``src`` and ``dst`` in either order; self-loops and repeated edges are allowed, rows with
    a null end are dropped. Each task first contracts its own edges to stars. While more than ``task_edges`` are left, large-star
    and small-star steps alternate: each joins edges with per-node minima, so the rounds grow with the logarithm of the longest
    chain. What is left then, of a known size, is resolved by one task. Every round's edges are written to the shared folder,
    which cuts lineage and lets the optimiser split a hub's rows. Nothing is collected but counts.
    """
    hi, lo = F.greatest("src", "dst"), F.least("src", "dst")
    cur = session.written(spark, _resolved(edges.where("src <> dst").select(hi.alias("u"), lo.alias("v")), CHUNK_EDGES).distinct(), "edges")
    while cur.count() > task_edges:
        # Converged: every u hangs on one v, and no v hangs on anything.
        forked = cur.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not forked and not cur.select(F.col("v").alias("u")).distinct().join(cur, "u", "left_semi").limit(1).count():
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = session.written(spark, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        wide = session.written(spark, large, "edges")
        session.discard(spark, cur, low)
        low = session.written(spark, wide.groupBy("u").agg(F.min("v").alias("m")), "minima")
        moved = wide.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = session.written(spark, small, "edges")
        session.discard(spark, wide, low)
    return _resolved(cur.repartition(1), None).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _walk(node: np.ndarray, low: np.ndarray) -> tuple[list[int], list[int]]:
    """Nodes and their pivots of whole components, from edges to smaller nodes: in ascending order a node without a pivot among
    its smaller neighbours is one, another belongs to the smallest."""
    by = np.lexsort((low, node))
    node, low = node[by].tolist(), low[by].tolist()
    pivots, out = set(low).difference(node), {}
    out.update((p, p) for p in pivots)
    i = 0
    while i < len(node):
        x, own = node[i], None
        while i < len(node) and node[i] == x:
            if own is None and low[i] in pivots:
                own = low[i]
            i += 1
        if own is None:
            pivots.add(x)
        out[x] = x if own is None else own
    return list(out), list(out.values())


def _walked(edges: DataFrame) -> DataFrame:
    """node, pivot of components (component, node, low) that lie together, in order of component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def done(parts):
            nodes, pivots = _walk(parts[1], parts[2])
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(pivots, pa.int64())], ["node", "pivot"])

        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
            if rows >= CHUNK_EDGES:
                parts = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(parts[0], parts[0][-1]))  # the last component may go on
                if cut:
                    yield done([x[:cut] for x in parts])
                held, rows = [[x[cut:] for x in parts]], len(parts[0]) - cut
        if rows:
            yield done([np.concatenate(x) for x in zip(*held)])

    return edges.select("component", "node", "low").mapInArrow(run, "node long, pivot long")


def pivot_clusters(spark: SparkSession, nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, pivot: the clusters of repeatedly taking the smallest remaining node and its remaining neighbours.

    The pivots are the lexicographically first maximal independent set, and every other node belongs to its smallest
    neighbouring pivot. Components of at most ``task_edges`` edges are dealt to tasks and walked in order there, many a task. In
    larger ones all nodes decide side by side: one whose smaller neighbours are all decided against is a pivot, one with a
    pivot among them is not; as soon as at most ``task_edges`` edges wait, one task walks what is left of them. There is no
    limit to the rounds. ``nodes`` has a column ``node``; ``edges`` src and dst. Each round is written to the shared folder.
    """
    lower = session.written(spark, edges.where("src <> dst").select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("low")).distinct(), "lower")
    alone = nodes.select("node").distinct().join(lower.select("node").union(lower.select("low")).distinct(), "node", "left_anti")
    decided = [alone.select("node", F.col("node").alias("pivot"))]
    if lower.count() <= task_edges:
        decided.append(_walked(lower.repartition(1).select(F.lit(0).cast("long").alias("component"), "node", "low")))
    else:
        whole = connected_components(spark, lower.select(F.col("node").alias("src"), F.col("low").alias("dst")), task_edges)
        named = session.written(spark, lower.join(whole, "node"), "named")
        huge = session.written(spark, named.groupBy("component").count().where(F.col("count") > task_edges).select("component"), "huge")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        decided.append(_walked(named.join(huge, "component", "left_anti").repartition(parts, "component").sortWithinPartitions("component")))
        waiting = named.join(huge, "component", "left_semi").select("node", "low")
        waiting = session.written(spark, waiting, "waiting")
        roots = waiting.select(F.col("low").alias("node")).distinct().join(waiting.select("node"), "node", "left_anti")
        pivots = session.written(spark, roots, "pivots")  # no smaller neighbour at all
        while True:
            decided.append(pivots.select("node", F.col("node").alias("pivot")))
            taken = waiting.join(pivots.select(F.col("node").alias("low")), "low").groupBy("node").agg(F.min("low").alias("pivot"))
            taken = session.written(spark, taken, "taken")
            decided.append(taken)
            # Taken nodes are settled, and no longer hold others back.
            rest = waiting.join(taken.select("node"), "node", "left_anti").join(taken.select(F.col("node").alias("low")), "low", "left_anti")
            rest = session.written(spark, rest, "rest")
            loose = waiting.select("node").distinct().join(taken.select("node"), "node", "left_anti").join(rest.select("node").distinct(), "node", "left_anti")
            pivots, left = session.written(spark, loose, "loose"), rest.count()
            if left <= task_edges:
                # a node that waits has only undecided smaller neighbours and new pivots: the walk finds the latter as such
                decided.append(pivots.select("node", F.col("node").alias("pivot")))
                if left:
                    decided.append(_walked(rest.repartition(1).select(F.lit(0).cast("long").alias("component"), "node", "low")))
                break
            waiting = rest
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.groupBy("node").agg(F.min("pivot").alias("pivot"))
