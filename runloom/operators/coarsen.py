"""Similarity graph and its coarsening: which point must be simulated, which can copy.

The sequential rule is: take the node of highest degree, let all its neighbours copy
from it, remove them all, repeat. The same result is reached in rounds. A node whose
(degree, tie, id) is the largest within two steps cannot be overtaken, because degrees
only fall, and two such nodes share no neighbour, so all of them are taken at once.

Where most nodes lie within two steps of each other such a round takes very few. There a
bounded number of edges, those of the first nodes in order, is walked through one node
after the other, until the next in order might be a node that is not among them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_group_stats
from ..functions.workspace import discard, materialise

# A node with more edges than this is looked up in several parts.
HUB_EDGES = 100_000
# Edges that are walked through one after the other by one task (about 40 bytes each), nodes that are listed for
# it, and nodes of a graph that is walked as a whole.
WALK_EDGES, WALK_NODES, WHOLE_NODES = 16_000_000, 50_000, 1_000_000
# A graph with more edges a node than this is walked first: nearly all of it lies within two steps.
DENSE = 32
# The other kind of round is taken after one that leaves a larger share of the edges.
KEPT = 0.75
# Edges of a graph that one task makes distinct, where their number is known.
TASK_EDGES = 1_000_000


def build_graph(edges: DataFrame, rows: int | None = None, once: bool = False) -> DataFrame:
    """Simple undirected graph: (a < b, dist, weight = 1 / dist), the least distance kept.

    Self loops are dropped; distance 0 has no weight. ``rows``: the number of edges, if it is known
    cheaply; they are dealt to more tasks then, so that a task holds a bounded number of pairs.
    ``once``: every pair is known to come once, so nothing is grouped.
    """
    pairs = edges.filter(F.col("cell1") != F.col("cell2")).select(
        F.least("cell1", "cell2").alias("a"), F.greatest("cell1", "cell2").alias("b"), "dist"
    )
    if rows is not None:
        least = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = pairs.repartition(max(least, math.ceil(rows / TASK_EDGES)), "a", "b")
    if not once:
        pairs = pairs.groupBy("a", "b").agg(F.min("dist").alias("dist"))
    return pairs.withColumn("weight", F.try_divide(F.lit(1.0), F.col("dist")))


def two_way(graph: DataFrame) -> DataFrame:
    return graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(graph: DataFrame) -> DataFrame:
    ends = graph.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def max_degree_node(graph: DataFrame) -> DataFrame:
    """The single node of highest degree; ties go to the larger id."""
    return degrees(graph).agg(F.max(F.struct("degree", "node")).alias("m")).select("m.node", "m.degree")


def _tie(node: Column, tie: str) -> Column:
    return F.lit(0).cast("long") if tie == "id" else F.xxhash64(node)


def coarsen(graph: DataFrame, classes: DataFrame | None = None, tie: str = "id") -> DataFrame:
    """(gp, rep) for every node of the graph.

    ``classes`` (cell, copies) gives nodes that stand for several equal points: a node's
    degree then counts the copies of its neighbours and its own other copies. ``tie``:
    ``id`` gives equal degrees to the larger id; ``hash`` to the larger hash of the id,
    which keeps the number of rounds low when ids run along the graph.
    """
    sizes = degrees(graph)
    nodes, most = sizes.agg(F.count(F.lit(1)), F.max("degree")).first()
    # Every node is its own neighbour here, so a grouped maximum covers the node itself.
    pairs = two_way(graph).unionByName(sizes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    edges = pairs.withColumn("copies", F.lit(1).cast("long"))
    several = None if classes is None else classes.filter("copies > 1")
    if several is not None and not several.isEmpty():
        several = several.select(F.col("cell").alias("b"), F.col("copies").cast("long").alias("_c"))
        edges = join_group_stats(edges, several, ["b"], "left").select("a", "b", F.coalesce("_c", "copies").alias("copies"))
    hubs = sizes.filter(F.col("degree") >= HUB_EDGES).select(
        F.col("node").alias("a"), F.ceil((F.col("degree") + 1) / F.lit(float(HUB_EDGES))).cast("int").alias("_p")
    )
    for end in ("a", "b"):
        if nodes and most >= HUB_EDGES:
            edges = join_group_stats(edges, hubs.withColumnRenamed("a", end), [end], "left")
        else:
            edges = edges.withColumn("_p", F.lit(1))
        edges = edges.withColumn(f"parts_{end}", F.coalesce("_p", F.lit(1))).drop("_p")
    edges = materialise(edges, "edges")
    rows, parts = edges.count(), []
    walking = rows > DENSE * nodes
    while rows:
        whole, old = rows <= WALK_EDGES and nodes <= WHOLE_NODES, edges
        if whole or walking:
            fates = _walk(edges, tie, whole)
            parts.append(fates)
            if not whole:
                gone = fates.select("gp")
                for end in ("a", "b"):
                    edges = edges.join(gone.withColumnRenamed("gp", end), end, "left_anti")
                edges = materialise(edges.select("a", "b", "copies", "parts_a", "parts_b"), "edges")
        else:
            state = _round(edges, tie)
            # A round's own table is read again: by the result and by the next round.
            parts.append(state.filter("a = b AND rep IS NOT NULL").select(F.col("a").alias("gp"), "rep"))
            edges = state.filter("rep IS NULL").drop("rep")
        if hasattr(old, "work_path"):
            discard(old)
        if whole:
            break
        left, nodes = edges.agg(F.count(F.lit(1)), F.count_if(F.col("a") == F.col("b"))).first()
        walking = walking != (left > KEPT * rows)
        rows = left
    if not parts:
        kind = sizes.schema["node"].dataType.simpleString()
        return graph.sparkSession.createDataFrame([], f"gp {kind}, rep {kind}")
    return reduce(DataFrame.unionByName, parts)


def _round(edges: DataFrame, tie: str) -> DataFrame:
    """Every edge with ``rep`` of its end b, after all nodes that lead within two steps are taken."""
    # The degree of a node counts all points it can serve, its own other copies too.
    rank = F.struct(F.sum("copies").alias("degree"), _tie(F.col("a"), tie).alias("tie"), F.col("a").alias("id"))
    priority = edges.groupBy("a").agg(rank.alias("top"), F.first("parts_a").alias("parts"))
    one_step = _over_neighbours(edges, priority, F.max("top").alias("top"))
    two_steps = _over_neighbours(edges, one_step, F.max("top").alias("top"))
    taken = F.when(F.col("top.id") == F.col("b"), F.col("b"))
    fate = _over_neighbours(edges, two_steps, F.max(taken).alias("rep"))
    # One written table per round: every edge with the fate of its end b. Rows whose
    # end b is gone leave the graph; a row of a gone start a is never looked up again.
    return materialise(_with_end(edges, fate), "round")


def _walk(edges: DataFrame, tie: str, whole: bool) -> DataFrame:
    """(gp, rep) of the nodes that the first ones in order take, or of all where ``whole``."""
    bound, met = None, edges
    if not whole:
        # A start whose own row is missing has left the graph.
        degree = edges.groupBy("a").agg(
            F.sum("copies").alias("degree"), F.count(F.lit(1)).alias("n"), F.max(F.col("a") == F.col("b")).alias("here"))
        ranked = degree.filter("here").select("a", "degree", _tie(F.col("a"), tie).alias("tie"), "n")
        first = ranked.orderBy(F.desc("degree"), F.desc("tie"), F.desc("a")).limit(WALK_NODES + 1).collect()
        fit = int((np.cumsum([r["n"] for r in first]) <= WALK_EDGES).sum())
        # The very first node is taken whatever its degree: its edges alone are read then.
        fit = max(1, min(fit, WALK_NODES))
        if fit < len(first):
            bound = (first[fit]["degree"], first[fit]["tie"], first[fit]["a"])
        if fit == 1:
            rep = first[0]["a"]
            return materialise(edges.filter(F.col("a") == rep).select(F.col("b").alias("gp"), F.lit(rep).alias("rep")), "walk")
        listed = edges.sparkSession.createDataFrame([(r["a"],) for r in first[:fit]], ranked.select("a").schema)
        met = edges.join(listed, "a", "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Many edges to a row, so that the one task that walks has few rows to read. Only b's other copies
        # and the ties of own rows are more than the two ends.
        for batch in batches:
            a, b, c, t = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            row = [a, b, np.stack([b[c > 1], c[c > 1]]), np.stack([a[a == b], t[a == b]])]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in row], names=["a", "b", "heavy", "own"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[], [], [], []]
        for batch in batches:
            for i, v in enumerate(held):
                # Copies, so that no batch is held with its other columns.
                v += [np.frombuffer(x.as_buffer(), dtype=np.int64).copy() for x in batch.column(i)]
        if not held[0]:
            return
        heavy, own = (np.unique(np.concatenate([x.reshape(2, -1) for x in held.pop(2)], axis=1), axis=1) for _ in range(2))
        gp, rep = in_order(held, heavy, own, bound)
        for s in range(0, len(gp), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(gp[s: s + 65536]), pa.array(rep[s: s + 65536])], names=["gp", "rep"])

    kind = edges.schema["a"].dataType.simpleString()
    ends = met.select("a", "b", "copies", _tie(F.col("a"), tie).alias("tie"))
    one = ends.mapInArrow(pack, "a binary, b binary, heavy binary, own binary").repartition(1)
    taken = one.mapInArrow(walk, "gp long, rep long")
    return materialise(taken.select(F.col("gp").cast(kind).alias("gp"), F.col("rep").cast(kind).alias("rep")), "walk")


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2^32, sixteen bits at a time (numpy counts those)."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() > 0xFFFF:
        order = order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _places(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of values among sorted known ones, as narrow numbers."""
    out = np.empty(len(values), dtype=np.int32)
    for s in range(0, len(values), 1 << 20):
        out[s: s + (1 << 20)] = np.searchsorted(known, values[s: s + (1 << 20)])
    return out


def in_order(
    edges: list[list[np.ndarray]], heavy: np.ndarray, own: np.ndarray, bound: tuple[int, int, int] | None
) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, representative of each) that the listed nodes take one after the other.

    ``edges``: starts and ends of all edges of the listed nodes (taken over, to hold them once), in pieces;
    ``heavy``: (node, copies) of ends that stand for several points; ``own``: (node, tie) of the listed nodes,
    sorted, each with an edge to itself. Other starts have left the graph. It ends with the first node in
    order that is behind ``bound``.
    """
    end = np.concatenate(edges.pop())
    ends = np.unique(end)
    end = _places(ends, end)
    start = np.concatenate(edges.pop())
    ids, tie = own
    place = _places(ids, start)
    here = ids[np.minimum(place, len(ids) - 1)] == start if len(ids) else np.zeros(len(start), dtype=bool)
    del start
    start, end = place[here], end[here]
    del place, here
    weight = np.ones(len(ends), dtype=np.int64)
    weight[np.searchsorted(ends, heavy[0])] = heavy[1]
    degree = np.bincount(start, weights=weight[end], minlength=len(ids)).astype(np.int64)
    reach_at = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(ids)))])
    met_at = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=len(ends)))])
    reach = end[_order(start)]
    met = start[_order(end)]
    del start, end
    itself, here = np.searchsorted(ends, ids), np.ones(len(ends), dtype=bool)
    # A larger id has a larger place among them.
    heap = [(-d, -t, -k) for k, (d, t) in enumerate(zip(degree.tolist(), tie.tolist()))]
    heapq.heapify(heap)
    gone, reps = [ends[:0]], [ids[:0]]
    while heap:
        d, t, k = heap[0][0], heap[0][1], -heap[0][2]
        if not here[itself[k]]:
            heapq.heappop(heap)
        elif -d != degree[k]:
            heapq.heapreplace(heap, (-int(degree[k]), t, -k))
        elif bound is not None and (-d, -t, ids[k]) <= bound:
            break
        else:
            near = reach[reach_at[k]: reach_at[k + 1]]
            near = near[here[near]]
            here[near] = False
            for x in near:
                np.subtract.at(degree, met[met_at[x]: met_at[x + 1]], weight[x])
            gone.append(ends[near])
            reps.append(np.full(len(near), ids[k]))
    return np.concatenate(gone), np.concatenate(reps)


def _with_end(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Edges with the values of their end b. A hub's values are repeated for each of its
    parts and its edges are spread over them."""
    copies = values.withColumnRenamed("a", "b").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.pmod(F.xxhash64("a"), F.col("parts_b")).cast("int")
    return edges.withColumn("_part", part).join(copies.drop("parts"), ["b", "_part"]).drop("_part")


def _over_neighbours(edges: DataFrame, values: DataFrame, total: Column) -> DataFrame:
    """Aggregate the values of a node's neighbours, itself included."""
    met = _with_end(edges.select("a", "b", "parts_a", "parts_b"), values)
    return met.groupBy("a").agg(total, F.first("parts_a").alias("parts"))


def full_mapping(mapping: DataFrame, num_points: int) -> DataFrame:
    """Every point 0..n-1 with its representative, itself where it has no neighbour."""
    points = mapping.sparkSession.range(num_points).withColumnRenamed("id", "gp")
    return points.join(mapping, "gp", "left").select("gp", F.coalesce("rep", "gp").alias("rep"))


def expand_classes(mapping: DataFrame, members: DataFrame) -> DataFrame:
    """Mapping of all points from the mapping of classes (a class without edge keeps its own)."""
    of_class = mapping.select(F.col("gp").alias("class"), "rep")
    return members.join(of_class, "class", "left").select(
        F.col("cell").alias("gp"), F.coalesce("rep", "class").alias("rep")
    )


def apply_mapping(mapping: DataFrame, results: DataFrame, key: str = "gp") -> DataFrame:
    """Every point takes the result rows of its representative.

    Both sides are plain shuffles, so Spark splits a representative of very many points.
    """
    source = results.withColumnRenamed(key, "rep")
    return mapping.join(source, "rep")


def remove_nodes(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without any end in ``nodes`` (node)."""
    return graph.join(nodes.select(F.col("node").alias("a")), "a", "left_anti").join(
        nodes.select(F.col("node").alias("b")), "b", "left_anti"
    )


def neighbours_of(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Given nodes and all their neighbours, once each."""
    sym = two_way(graph)
    near = sym.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
    return near.unionByName(nodes.select("node")).distinct()


def coarsening_counts(mapping: DataFrame, to_update: DataFrame) -> DataFrame:
    """One row: points to update, points that copy, simulations left, representatives.

    ``to_update``: one row per point (or similarity file) that asked for an update.
    """
    nothing = F.lit(None).cast("long")
    rows = mapping.select("gp", "rep", F.lit(0).alias("asked")).unionByName(
        to_update.select(nothing.alias("gp"), nothing.alias("rep"), F.lit(1).alias("asked"))
    )
    both = rows.agg(
        F.sum("asked").alias("points_to_update"),
        F.count_if(F.col("gp") != F.col("rep")).alias("neighbours_removed"),
        F.count_if(F.col("gp") == F.col("rep")).alias("representatives"),
    )
    return both.select(
        "points_to_update", "neighbours_removed",
        (F.col("points_to_update") - F.col("neighbours_removed")).alias("simulations_required"), "representatives",
    )
