"""Pairwise L2 similarity of histories below a threshold, exact and without all pairs.

Four facts keep the work down, and none of them loses a pair:

* equal vectors are one class, so copies (a third of all points may be at rest) are compared
  as one vector; where pairs of points are wanted, those of the members follow from the classes;
* two vectors closer than the threshold differ by less than it in every coordinate, so
  only vectors in the same or a neighbouring grid cell over the widest coordinates meet;
* if every vector lives with its nearest pivot, a partner in the cell of another pivot is
  at least as far away as the plane halfway between the two pivots, and distances to one
  pivot differ by less than the threshold, so a vector visits few cells and few rings there;
* a crowded cell is cut into blocks, and every pair of blocks is one task of bounded size.

Grid, pivots or plain blocks: ``similar_pairs`` counts on a bounded sample how many pairs
each would compare and takes the least. The choice changes the work, never the result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_group_stats
from ..functions.workspace import materialise
from ..schemas import STRAIN

PAIR_SCHEMA = "cell1 long, cell2 long, dist double"
PLACE_SCHEMA = "side int, cell long, vec array<double>, home array<long>"
# Pivots are at most so many, and at most so many bytes; every task holds them.
MAX_PIVOTS = 4096
PIVOT_BYTES = 8 << 20
# Where every block meets every other, blocks grow to this many vectors before their number does.
MOST_BLOCKS, MOST_BLOCK_ROWS = 32, 16_384
# Distances that are screened at once.
TILE_ROWS, TILE_COLUMNS = 64, 2048
# Vectors on which the number of compared pairs is estimated.
SAMPLE_VECTORS = 1024


def history_vectors(resampled: DataFrame, key: str = "cell", point: str = "point", values: list[str] = STRAIN) -> DataFrame:
    """Resampled histories as one vector per key (points x components, a fixed length)."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(point), F.array(*values).alias("v"))))
    return resampled.groupBy(key).agg(F.flatten(F.transform(ordered, lambda p: p["v"])).alias("vec"))


def _doubles(vec: str) -> Column:
    """As doubles, without negative zero."""
    return F.transform(vec, lambda x: x.cast("double") + F.lit(0.0)).alias("vec")


def vector_classes(vectors: DataFrame, key: str = "cell") -> DataFrame:
    """One row per distinct vector: (cell = largest member, copies, vec)."""
    return vectors.select(key, _doubles("vec")).groupBy("vec").agg(F.max(key).alias("cell"), F.count(F.lit(1)).alias("copies"))


def class_members(vectors: DataFrame, classes: DataFrame, key: str = "cell") -> DataFrame:
    """(cell, class): the class each point belongs to. Only vectors with copies are joined."""
    same = vectors.select(F.col(key).alias("member"), _doubles("vec"))
    several = classes.filter("copies > 1").select("vec", F.col("cell").alias("class"))
    return join_group_stats(same, several, ["vec"], "left").select(
        F.col("member").alias("cell"), F.coalesce("class", "member").alias("class")
    )


def widest_coordinates(classes: DataFrame, threshold: float, axes: int) -> list[int]:
    """Positions (0-based) whose spread is at least two cells, largest variance first."""
    spread = (
        classes.select(F.posexplode("vec").alias("pos", "x"))
        .groupBy("pos")
        .agg(F.var_pop("x").alias("var"), (F.max("x") - F.min("x")).alias("range"))
        .filter(F.col("range") >= 2 * threshold)
        .orderBy(F.desc("var"), "pos")
        .limit(axes)
    )
    return [r["pos"] for r in spread.collect()]


def _compare_blocks(threshold: float):
    """Distances of one task: left x right of a block pair, or the triangle of one block."""
    limit = threshold * threshold

    def compare(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, task = key[0], pd.concat(list(batches), ignore_index=True)
        own = list(t["home"]) == list(t["other"]) and t["i"] == t["j"]
        left = task[task.side == 0]
        right = left if own else task[task.side == 1]
        if not len(left) or not len(right):
            return
        a, b = np.stack(left.vec.to_numpy()), np.stack(right.vec.to_numpy())
        ids_a, ids_b = left.cell.to_numpy(), right.cell.to_numpy()
        # A vector that is not finite is near nothing.
        finite_a, finite_b = np.isfinite(a).all(axis=1), np.isfinite(b).all(axis=1)
        a, b, ids_a, ids_b = a[finite_a], b[finite_b], ids_a[finite_a], ids_b[finite_b]
        if not len(a) or not len(b):
            return
        # The product form finds candidates fast; its rounding is covered by the slack,
        # and the kept candidates are then measured directly. Norms and slack are columns of the product.
        centre = a.mean(axis=0)
        ca, cb = a - centre, b - centre
        na, nb = (ca * ca).sum(axis=1), (cb * cb).sum(axis=1)
        less = 1.0 - 1e-14 * a.shape[1]
        rows = np.column_stack([-2.0 * ca, less * na, np.ones(len(a))])
        columns = np.column_stack([cb, np.ones(len(b)), less * nb])
        if not (np.isfinite(rows).all() and np.isfinite(columns).all() and math.isfinite(2.0 * (na.max() + nb.max()))):
            # Squares overflow and tell nothing: all pairs are candidates.
            rows, columns = np.zeros_like(rows), np.zeros_like(columns)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def measured() -> Iterator[pd.DataFrame]:
            i, j = (np.concatenate(v) for v in zip(*held))
            for c in range(0, len(i), 65536):
                ci, cj = i[c : c + 65536], j[c : c + 65536]
                d = np.sqrt(((a[ci] - b[cj]) ** 2).sum(axis=1))
                keep = d < threshold
                x, y = ids_a[ci[keep]], ids_b[cj[keep]]
                yield pd.DataFrame({"cell1": np.minimum(x, y), "cell2": np.maximum(x, y), "dist": d[keep]})

        # Tiles that fit the processor's cache.
        for s in range(0, len(a), TILE_ROWS):
            for r in range(s if own else 0, len(b), TILE_COLUMNS):
                rough = rows[s : s + TILE_ROWS] @ columns[r : r + TILE_COLUMNS].T
                i, j = np.divmod(np.flatnonzero(~(rough > limit)), rough.shape[1])
                i, j = i + s, j + r
                if own:
                    once = (i < j) & (ids_a[i] != ids_b[j])
                    i, j = i[once], j[once]
                held.append((i, j))
                if sum(len(x) for x, _ in held) >= 65536:
                    yield from measured()
                    held.clear()
        if held:
            yield from measured()

    return compare


def _task(i: Column, j: Column) -> Column:
    return F.struct("home", "other", i.alias("i"), j.alias("j")).alias("task")


@dataclass(frozen=True)
class Pivots:
    """Vectors that own a cell each. ``width``: of a ring of distances around a pivot; ``slack``: most
    that rounding can change a squared distance between a vector and a pivot."""

    points: np.ndarray
    threshold: float
    width: float
    slack: float

    def squared(self, vecs: np.ndarray) -> np.ndarray:
        """Squared distances of vectors and pivots, within the slack."""
        centre = self.points.mean(axis=0)
        p, v = self.points - centre, vecs - centre
        return (v * v).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2.0 * v @ p.T

    def visited(self, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home, visits): the nearest pivot of each vector, and which other cells it has to visit.

        ``d(x,q)^2 - d(x,p)^2`` changes by at most ``2 d(p,q)`` per unit of distance and is not above 0 for
        a vector of pivot q, so x of pivot p has partners there only if it is at most
        ``2 * threshold * d(p,q)``. Only the cell of the smaller pivot is visited: a pair meets once.
        """
        squared = self.squared(vecs)
        home = squared.argmin(axis=1)
        least = np.take_along_axis(squared, home[:, None], axis=1)
        apart = np.sqrt(np.maximum(self.squared(self.points[home]) + self.slack, 0.0))
        visits = squared - least <= 2.0 * self.threshold * apart + 4.0 * self.slack
        return home, visits & (np.arange(len(self.points))[None, :] < home[:, None])

    def places(self, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot, ring, is home) of every cell a vector lives in or visits, homes first."""
        home, visits = self.visited(vecs)
        row, cell = np.nonzero(visits)
        row = np.concatenate([np.arange(len(vecs)), row])
        cell = np.concatenate([home, cell])
        ring = np.empty(len(row), dtype=np.int64)
        for s in range(0, len(row), 4096):
            apart = vecs[row[s : s + 4096]] - self.points[cell[s : s + 4096]]
            ring[s : s + 4096] = np.sqrt((apart * apart).sum(axis=1)) // self.width
        return row, cell, ring, np.arange(len(row)) < len(vecs)


def _sampled(classes: DataFrame, rows: int, seed: int) -> np.ndarray:
    """Vectors of the least hashes of their ids: the same for any partitioning."""
    found = classes.select("vec").orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(rows).collect()
    return np.array([r["vec"] for r in found], dtype=float)


def choose_pivots(classes: DataFrame, threshold: float, block_rows: int = 1024, pivots: int | None = None) -> Pivots | None:
    """Pivots drawn from the vectors by hash: about the root of their number, bounded in rows and bytes.

    Rings are never narrower than the threshold, and wider where a cell holds few vectors. None
    without vectors, or where a vector has no coordinate or no finite length.
    """
    rows, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not rows or not dims:
        return None
    wanted = pivots or math.ceil(math.sqrt(rows))
    points = _sampled(classes, max(1, min(wanted, MAX_PIVOTS, PIVOT_BYTES // (8 * dims))), 1)
    centre = F.array(*[F.lit(float(c)) for c in points.mean(axis=0)])
    shifted = F.zip_with("vec", centre, lambda x, c: x - c)
    length = F.aggregate(shifted, F.lit(0.0), lambda total, x: total + x * x)
    most = math.sqrt(classes.agg(F.max(length)).first()[0]) * (1 + 1e-9)
    if not math.isfinite(4 * most * most):
        return None
    slack = 1e-14 * dims * 4.0 * most * most
    trial = Pivots(points, threshold, 1.0, slack)
    nearest = trial.squared(_sampled(classes, SAMPLE_VECTORS, 2)).min(axis=1)
    rings = math.ceil(rows / len(points) / block_rows)
    reach = math.sqrt(max(float(nearest.max()), 0.0) + slack)
    # A ring is a little wider than the threshold so that rounding cannot part a pair by two rings.
    return Pivots(points, threshold, max(1.001 * threshold + 1e-14 * dims * most, reach / rings), slack)


def pivot_share(found: Pivots, sample: np.ndarray) -> tuple[float, float]:
    """(share of all ordered pairs that are compared, cells each vector is sent to) on a sample."""
    row, cell, ring, home = found.places(sample)
    lives: dict[tuple[int, int], int] = {}
    for c, r in zip(cell[home], ring[home]):
        lives[c, r] = lives.get((c, r), 0) + 1
    met = 0.0
    for c, r, h in zip(cell, ring, home):
        own = lives.get((c, r), 0)
        met += (own / 2 if h else own + lives.get((c, r - 1), 0)) + lives.get((c, r + 1), 0)
    return met / len(sample) ** 2, len(row) / len(sample)


def grid_share(positions: list[int], threshold: float, sample: np.ndarray) -> float:
    """Share of all pairs that lie in the same or a neighbouring cell of the grid, on a sample."""
    cells = np.floor(sample[:, positions] / (1.001 * threshold))
    near = sum(int((np.abs(cells - c) <= 1).all(axis=1).sum()) for c in cells)
    return near / len(sample) ** 2 / 2


def pair_tasks(classes: DataFrame, threshold: float, axes: int = 2, block_rows: int = 1024, method: str | None = None,
               pivots: int | None = None) -> DataFrame:
    """(side, cell, vec, task): the vectors that each unit of work compares.

    ``method``: ``grid``, ``pivots`` or ``blocks``; None takes the one with the fewest pairs on a sample
    (blocks where all vectors fill two at most). A grid without a wide coordinate, and pivots among
    vectors that are empty or not finite, become blocks.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    if method is None and classes.count() <= 2 * block_rows:
        method = "blocks"
    positions = widest_coordinates(classes, threshold, axes) if method in (None, "grid") else []
    found = choose_pivots(classes, threshold, block_rows, pivots) if method in (None, "pivots") else None
    if method is None:
        sample = _sampled(classes, SAMPLE_VECTORS, 3)
        shares = {"blocks": 0.5}
        if len(sample) and positions:
            shares["grid"] = grid_share(positions, threshold, sample)
        if len(sample) and found:
            share, copies = pivot_share(found, sample)
            # Vectors are moved as well as compared: more copies than blocks give nothing.
            if copies <= max(4.0, classes.count() / block_rows):
                shares["pivots"] = share
        method = min(shares, key=lambda m: (shares[m], m))
    if method == "grid" and positions:
        return _cell_tasks(classes, positions, threshold, block_rows)
    if method == "pivots" and found:
        return _pivot_tasks(classes, found, block_rows)
    return _block_tasks(classes, block_rows)


def compared_pairs(tasks: DataFrame) -> int:
    """Number of pairs of vectors that the tasks compare."""
    left, right = F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)
    own = (F.col("task.home") == F.col("task.other")) & (F.col("task.i") == F.col("task.j"))
    sizes = tasks.groupBy("task").agg(left.alias("l"), right.alias("r"))
    pairs = F.when(own, F.floor(F.col("l") * (F.col("l") - 1) / 2)).otherwise(F.col("l") * F.col("r"))
    return sizes.agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0]


def similar_pairs(classes: DataFrame, threshold: float, axes: int = 2, block_rows: int = 1024, method: str | None = None,
                  pivots: int | None = None) -> DataFrame:
    """All pairs of distinct vectors with L2 distance below ``threshold``.

    ``classes``: (cell, vec), vectors distinct. Output (cell1 < cell2, dist).
    """
    tasks = pair_tasks(classes, threshold, axes, block_rows, method, pivots)
    return tasks.groupBy("task").applyInPandas(_compare_blocks(threshold), PAIR_SCHEMA)


def _place(found: Pivots):
    """Rows of the cells that the vectors of a batch live in or visit."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024]
                row, cell, ring, home = found.places(np.stack(part.vec.to_numpy()))
                for s in range(0, len(row), 8192):
                    r, c, g = row[s : s + 8192], cell[s : s + 8192], ring[s : s + 8192]
                    yield pd.DataFrame({
                        "side": np.where(home[s : s + 8192], 0, 1).astype(np.int32), "cell": part.cell.to_numpy()[r],
                        "vec": part.vec.to_numpy()[r], "home": list(np.stack([c, g], axis=1)),
                    })

    return place


def _pivot_tasks(classes: DataFrame, found: Pivots, block_rows: int) -> DataFrame:
    """Vectors of a ring meet those of the same and the next ring, and the visitors of three rings.

    A ring's rows are cut into blocks before they meet anything, so no key holds a whole ring.
    """
    placed = classes.select("cell", "vec").mapInPandas(_place(found), PLACE_SCHEMA)
    placed = materialise(placed, "placed")
    counts = placed.groupBy("home", "side").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("nb"))
    lives = counts.filter("side = 0").select(F.col("home"), F.col("nb"))

    # Which rings meet: homes with homes of the same and the next ring, visitors with three rings.
    reach = F.when(F.col("side") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    meetings = (
        counts.select("side", F.col("home").alias("other"), F.col("nb").alias("nb_other"), F.explode(reach).alias("_s"))
        .withColumn("home", F.array(F.get("other", F.lit(0)), F.get("other", F.lit(1)) - F.col("_s")))
        .drop("_s").join(lives, "home")
    )
    # A visitor's ring is told from the ring that lives there by a third number.
    mark = F.concat("other", F.array(F.col("side").cast("long")))
    meetings = meetings.withColumns({"home": F.concat("home", F.array(F.lit(0).cast("long"))), "other": mark})
    where = F.concat("home", F.array(F.col("side").cast("long")))
    crowded = counts.filter("nb > 1").select(where.alias("home"), F.col("nb").alias("_nb"))
    own = F.pmod(F.xxhash64("cell"), F.coalesce("_nb", F.lit(1))).cast("int")
    tagged = join_group_stats(placed.select("cell", "vec", where.alias("home")), crowded, ["home"], "left").select(
        "cell", "vec", "home", own.alias("own")
    )
    return _meet(tagged, meetings.select("home", "nb", "other", "nb_other"))


def _block_tasks(classes: DataFrame, block_rows: int) -> DataFrame:
    """No coordinate can part the vectors: every block goes to one task with every other.

    A vector is sent once per block, so blocks of many vectors are larger.
    """
    n = classes.count()
    block_rows = max(block_rows, min(MOST_BLOCK_ROWS, math.ceil(n / MOST_BLOCKS)))
    blocks = max(1, math.ceil(n / block_rows))
    nowhere = F.array(F.lit(0).cast("long"))
    met = (
        classes.select("cell", "vec", F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int").alias("own"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumns({"home": nowhere, "other": nowhere})
    )
    side = F.when(F.col("own") <= F.col("_other"), F.lit(0)).otherwise(F.lit(1))
    return met.select(side.alias("side"), "cell", "vec", _task(F.least("own", "_other"), F.greatest("own", "_other")))


def _cell_tasks(classes: DataFrame, positions: list[int], threshold: float, block_rows: int) -> DataFrame:
    """Vectors meet those of their own and of neighbouring grid cells, block by block."""
    # Cells are a little wider than the threshold so that rounding cannot part a pair.
    width = F.lit(1.001 * threshold)
    home = F.array(*[F.floor(F.get("vec", F.lit(p)) / width).cast("long") for p in positions])
    placed = classes.select("cell", "vec", home.alias("home"))
    blocks = placed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("nb"))

    # Pairs of occupied neighbour cells, each once (offset not lexicographically negative).
    m = len(positions)
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=m) if o >= (0,) * m]
    shifts = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in offsets])
    towards = (
        blocks.withColumn("_o", F.explode(shifts))
        .withColumn("other", F.zip_with("home", "_o", lambda x, y: x + y))
        .select("home", "nb", "other")
    )
    cell_pairs = towards.join(blocks.select(F.col("home").alias("other"), F.col("nb").alias("nb_other")), "other")

    # The block of a vector is known before it meets any pair of cells, so the keys of the
    # joins below are single blocks, never a whole crowded cell.
    crowded = blocks.filter("nb > 1").withColumnRenamed("nb", "_nb")
    own = F.pmod(F.xxhash64("cell"), F.coalesce("_nb", F.lit(1))).cast("int")
    tagged = join_group_stats(placed, crowded, ["home"], "left").select("cell", "vec", "home", own.alias("own"))
    return _meet(tagged, cell_pairs)


def _meet(tagged: DataFrame, cell_pairs: DataFrame) -> DataFrame:
    """Tasks of every pair of blocks of the given pairs of cells (home, nb, other, nb_other)."""
    same = F.col("home") == F.col("other")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    # Inside one cell block i meets blocks j >= i: from the left for i <= j, from the
    # right for i < j; the block itself is a triangle of the left side.
    as_left = (
        tagged.join(cell_pairs.withColumn("own", each("nb")), ["home", "own"])
        .withColumn("_other", each("nb_other"))
        .filter(~same | (F.col("own") <= F.col("_other")))
        .select(F.lit(0).alias("side"), "cell", "vec", _task(F.col("own"), F.col("_other")))
    )
    as_right = (
        tagged.withColumnRenamed("home", "other")
        .join(cell_pairs.withColumn("own", each("nb_other")), ["other", "own"])
        .withColumn("_other", each("nb"))
        .filter(~same | (F.col("_other") < F.col("own")))
        .select(F.lit(1).alias("side"), "cell", "vec", _task(F.col("_other"), F.col("own")))
    )
    return as_left.unionByName(as_right)


def similar_histories(vectors: DataFrame, threshold: float, key: str = "cell", axes: int = 2,
                      block_rows: int = 1024, method: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, classes, members) of a table of vectors, for coarsening by classes.

    Edges join distinct vectors. Points with equal vectors are found in ``members``: they
    are at distance 0 of each other and share all edges of their class. ``similar_points``
    gives the pairs of all points.
    """
    classes = materialise(vector_classes(vectors, key), "classes")
    edges = similar_pairs(classes, threshold, axes, block_rows, method)
    return edges, classes.select("cell", "copies"), class_members(vectors, classes, key)


def _point_classes(vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(classes, members) of the points that have a key and a vector; without copies no members.

    A key may have several vectors and be the largest of several classes, so where there are
    copies ``cell`` is a number of its own, and members are (class, member, n rows).
    """
    known = vectors.filter(F.col(key).isNotNull() & F.col("vec").isNotNull())
    numbered = vector_classes(known, key).withColumn("number", F.monotonically_increasing_id())
    classes = materialise(numbered, "classes")
    several = classes.filter("copies > 1")
    if several.isEmpty():
        return classes.drop("number"), None
    same = known.select(F.col(key).alias("member"), _doubles("vec"))
    copied = join_group_stats(same, several.select("vec", "number"), ["vec"]).select(F.col("number").alias("class"), "member")
    alone = classes.filter("copies = 1").select(F.col("number").alias("class"), F.col("cell").alias("member"))
    members = copied.unionByName(alone).groupBy("class", "member").agg(F.count(F.lit(1)).alias("n"))
    return classes.withColumn("cell", F.col("number")).drop("number"), materialise(members, "members")


def _copied(classes: DataFrame) -> DataFrame:
    """Classes whose members are near each other: a vector that is not finite is not even near its copies."""
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    return classes.filter((F.col("copies") > 1) & finite)


def similar_points(vectors: DataFrame, threshold: float, key: str = "cell", axes: int = 2,
                   block_rows: int = 1024, method: str | None = None) -> DataFrame:
    """All pairs of points with L2 distance below ``threshold``, copies at distance 0 included.

    Output (cell1 < cell2, dist), once for any two rows of ``vectors`` with these keys. Pairs of
    members are made from the pairs of classes, block of members by block.
    """
    classes, members = _point_classes(vectors, key)
    edges = similar_pairs(classes, threshold, axes, block_rows, method)
    if members is None:
        return edges.filter("cell1 < cell2")
    parts = F.ceil(F.col("copies") / F.lit(float(block_rows))).cast("int")
    crowded = classes.withColumn("parts", parts).filter("parts > 1").select(F.col("cell").alias("class"), "parts")
    part = F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = join_group_stats(members, crowded, ["class"], "left").select("class", "member", "n", part.alias("part"))
    own = _copied(classes).select(F.col("cell").alias("class1"), F.col("cell").alias("class2"), F.lit(0.0).alias("dist"))
    met = edges.select(F.col("cell1").alias("class1"), F.col("cell2").alias("class2"), "dist").unionByName(own)
    for side in ("1", "2"):
        met = join_group_stats(met, crowded.withColumnRenamed("class", f"class{side}"), [f"class{side}"], "left").withColumn(
            f"part{side}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    for side in ("1", "2"):
        met = met.join(dealt.toDF(f"class{side}", f"member{side}", f"n{side}", f"part{side}"), [f"class{side}", f"part{side}"])
    # Both orders of two members of one class are met; two classes meet once.
    once = F.when(F.col("class1") == F.col("class2"), F.col("member1") < F.col("member2")).otherwise(
        F.col("member1") != F.col("member2"))
    rows = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n1") * F.col("n2")))
    return met.filter(once).withColumn("_row", rows).select(
        F.least("member1", "member2").alias("cell1"), F.greatest("member1", "member2").alias("cell2"), "dist")


def most_similar_points(vectors: DataFrame, threshold: float, key: str = "cell", axes: int = 2,
                        block_rows: int = 1024, method: str | None = None) -> DataFrame:
    """``most_similar`` of the pairs of all points; with copies it is told from the classes, without pairs of members."""
    classes, members = _point_classes(vectors, key)
    if members is None:
        return most_similar(similar_pairs(classes, threshold, axes, block_rows, method).filter("cell1 < cell2"))
    if not members.groupBy("member").count().filter("count > 1").isEmpty():
        # A key with several vectors is no partner of itself, whatever the class.
        return most_similar(similar_points(vectors, threshold, key, axes, block_rows, method))
    edges = similar_pairs(classes, threshold, axes, block_rows, method)
    least = members.groupBy("class").agg(F.min("member").alias("low"), F.sum("n").alias("rows"))
    others = join_group_stats(members, least.select("class", "low"), ["class"]).filter("member > low")
    second = others.groupBy("class").agg(F.min("member").alias("second"))
    least = materialise(least.join(second, "class", "left"), "least")
    links = edges.select(F.col("cell1").alias("class"), F.col("cell2").alias("other"), "dist").unionByName(
        edges.select(F.col("cell2").alias("class"), F.col("cell1").alias("other"), "dist"))
    near = links.join(least.select(F.col("class").alias("other"), "low", "rows"), "other").groupBy("class").agg(
        F.sum("rows").alias("near_rows"), F.min(F.struct("dist", F.col("low").alias("other"))).alias("_near"))
    copied = _copied(classes).select(F.col("cell").alias("class"), F.lit(True).alias("_copied"))
    of_class = least.join(near, "class", "left").join(copied, "class", "left")
    met = join_group_stats(members, of_class, ["class"])
    partner = F.when(F.col("member") == F.col("low"), F.col("second")).otherwise(F.col("low"))
    own = F.when(F.col("_copied") & partner.isNotNull(), F.struct(F.lit(0.0).alias("dist"), partner.alias("other")))
    own_rows = F.when(F.col("_copied"), F.col("rows") - F.col("n")).otherwise(F.lit(0))
    return met.select(
        F.col("member").alias("cell"), (F.col("n") * (F.coalesce("near_rows", F.lit(0)) + own_rows)).alias("n_similar"),
        F.coalesce(own, "_near").alias("_m"),
    ).filter("n_similar > 0").select("cell", "n_similar", F.col("_m.other").alias("nearest"), F.col("_m.dist").alias("dist"))


def most_similar(edges: DataFrame) -> DataFrame:
    """Per point: number of similar histories and the closest one (ties to the smaller id)."""
    both = edges.select(F.col("cell1").alias("cell"), F.col("cell2").alias("other"), "dist").unionByName(
        edges.select(F.col("cell2").alias("cell"), F.col("cell1").alias("other"), "dist")
    )
    nearest = F.min(F.struct("dist", "other"))
    return both.groupBy("cell").agg(F.count(F.lit(1)).alias("n_similar"), nearest.alias("_m")).select(
        "cell", "n_similar", F.col("_m.other").alias("nearest"), F.col("_m.dist").alias("dist")
    )

