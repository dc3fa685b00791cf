"""Queries on history similarity and the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spline import resample_histories
from ..functions.workspace import discard, materialise
from ..operators import coarsen, similarity
from ..schemas import STRAIN
from .source_queries import lineitem_edges, similarity_edge_scan
from .tables import HISTORY_SQL, load, register, supplier_histories

THRESHOLD = 1.19
POINTS = 10
HISTORY_THRESHOLD = 90.0
# About one partner per history: what a threshold for copying a simulation leaves.
NEAR_THRESHOLD = 65.0


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("vec"))


def embedding_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_points(embedding_vectors(spark, sf_dir), THRESHOLD)


EMBEDDING_PAIRS = f"""
vectors AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS vec FROM embeddings),
pairs AS (SELECT a.cell AS cell1, b.cell AS cell2, list_distance(a.vec, b.vec) AS dist
          FROM vectors a JOIN vectors b ON a.cell < b.cell WHERE list_distance(a.vec, b.vec) < {THRESHOLD}::DOUBLE)"""

register("similar_embeddings", embedding_edges, f"WITH {EMBEDDING_PAIRS} SELECT * FROM pairs", ["dist"])

register(
    "most_similar_embeddings",
    lambda spark, sf: similarity.most_similar_points(embedding_vectors(spark, sf), THRESHOLD),
    f"""WITH {EMBEDDING_PAIRS},
        both_ AS (SELECT cell1 AS cell, cell2 AS other, dist FROM pairs UNION ALL SELECT cell2, cell1, dist FROM pairs)
        SELECT cell, count(*) AS n_similar, arg_min(other, dist) AS nearest, min(dist) AS dist FROM both_ GROUP BY cell""",
    ["dist"],
)

# --- the graph of orders and parts, read from edge files ---------------------------------

GRAPH_SQL = """
graph AS (SELECT least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b, min(l_quantity) AS dist
          FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY ALL),
sym AS (SELECT a, b FROM graph UNION ALL SELECT b, a FROM graph),
degrees AS (SELECT a AS node, count(*) AS degree FROM sym GROUP BY a),
hub AS (SELECT node, degree FROM degrees ORDER BY degree DESC, node DESC LIMIT 1)"""


def lineitem_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen.build_graph(lineitem_edges(spark, sf_dir), load(spark, sf_dir, "lineitem").count())


register(
    "similarity_graph",
    lambda spark, sf: coarsen.build_graph(similarity_edge_scan(spark, sf), load(spark, sf, "lineitem").count()),
    f"WITH {GRAPH_SQL} SELECT a, b, dist, 1 / dist AS weight FROM graph",
    ["dist", "weight"],
)
register(
    "node_degrees",
    lambda spark, sf: coarsen.degrees(lineitem_graph(spark, sf)),
    f"WITH {GRAPH_SQL} SELECT * FROM degrees",
)
register(
    "hub_node",
    lambda spark, sf: coarsen.max_degree_node(lineitem_graph(spark, sf)),
    f"WITH {GRAPH_SQL} SELECT * FROM hub",
)


def graph_without_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read four times below: written once.
    graph = materialise(lineitem_graph(spark, sf_dir), "graph")
    gone = coarsen.neighbours_of(graph, coarsen.max_degree_node(graph))
    return coarsen.remove_nodes(graph, gone).select("a", "b", "dist")


register(
    "graph_without_hub",
    graph_without_hub,
    f"""WITH {GRAPH_SQL}, gone AS (SELECT node FROM hub UNION SELECT sym.b FROM sym JOIN hub ON sym.a = hub.node)
        SELECT a, b, dist FROM graph WHERE a NOT IN (SELECT node FROM gone) AND b NOT IN (SELECT node FROM gone)""",
    ["dist"],
)

# --- coarsening ----------------------------------------------------------------------------


def mapping_of(vectors: DataFrame, threshold: float) -> DataFrame:
    """(gp, rep) of every vector, from its similarity graph."""
    edges, classes, members = similarity.similar_histories(vectors, threshold)
    # A key with several vectors may be the largest of several classes; else a pair of classes comes once.
    once = classes.groupBy("cell").count().filter("count > 1").isEmpty()
    # Coarsening needs no distances; its results are written, so the graph goes with it.
    graph = materialise(coarsen.build_graph(edges, once=once).select("a", "b"), "graph")
    coarse = coarsen.coarsen(graph, classes)
    discard(graph)
    return coarsen.expand_classes(coarse, members)


def embedding_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embedding_vectors(spark, sf_dir)
    points = vectors.agg(F.max("cell") + 1).first()[0]
    return coarsen.full_mapping(mapping_of(vectors, THRESHOLD), points)


def greedy_sql(pairs: str, points: str) -> str:
    """Sequential greedy as a recursion: one step takes the node of highest degree."""
    return f"""
edges AS (SELECT cell1 AS a, cell2 AS b FROM {pairs} UNION ALL SELECT cell2, cell1 FROM {pairs}),
walk(kind, a, b) AS (
  SELECT 'edge', a, b FROM edges
  UNION ALL
  (WITH e AS (SELECT a, b FROM walk WHERE kind = 'edge'),
        deg AS (SELECT a, count(*) AS d FROM e GROUP BY a),
        top AS (SELECT a AS t FROM deg ORDER BY d DESC, a DESC LIMIT 1),
        grp AS (SELECT t AS x, t FROM top UNION ALL SELECT b, t FROM e JOIN top ON e.a = t)
   SELECT 'edge', a, b FROM e WHERE a NOT IN (SELECT x FROM grp) AND b NOT IN (SELECT x FROM grp)
   UNION ALL
   SELECT 'map', x, t FROM grp)),
mapping AS (SELECT cell AS gp, coalesce(walk.b, cell) AS rep FROM {points} LEFT JOIN walk ON kind = 'map' AND walk.a = cell)"""


EMBEDDING_MAPPING = f"{EMBEDDING_PAIRS}, {greedy_sql('pairs', 'vectors')}"

register(
    "coarse_mapping", embedding_mapping, f"WITH RECURSIVE {EMBEDDING_MAPPING} SELECT * FROM mapping"
)


def coarsening_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = materialise(embedding_mapping(spark, sf_dir), "mapping")
    return coarsen.coarsening_counts(mapping, mapping)


register(
    "coarsening_counts",
    coarsening_counts,
    f"""WITH RECURSIVE {EMBEDDING_MAPPING}
        SELECT count(*) AS points_to_update, count(*) FILTER (gp <> rep) AS neighbours_removed,
               count(*) FILTER (gp = rep) AS simulations_required, count(*) FILTER (gp = rep) AS representatives FROM mapping""",
)


def applied_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point takes the component rows of its representative."""
    rows = embedding_vectors(spark, sf_dir).select(F.col("cell").alias("gp"), F.posexplode("vec").alias("t", "value"))
    return coarsen.apply_mapping(embedding_mapping(spark, sf_dir), rows)


register(
    "applied_mapping",
    applied_mapping,
    f"""WITH RECURSIVE {EMBEDDING_MAPPING}
        SELECT gp, rep, CAST(p AS BIGINT) AS t, vec[p + 1] AS value FROM mapping JOIN vectors ON rep = cell, range(64) AS r(p)""",
    ["value"],
)

# --- supplier histories ------------------------------------------------------------------------


def written_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(supplier_histories(spark, sf_dir), "histories")


def resampled(histories: DataFrame) -> DataFrame:
    return resample_histories(histories, ["cell"], "step", STRAIN, POINTS)


# Natural spline by forward and backward elimination over the steps of all histories.
SPLINE_CTE = f"""
{HISTORY_SQL},
long AS ({" UNION ALL ".join(f"SELECT cell, '{c}' AS comp, step, {c} AS y FROM history" for c in STRAIN)}),
sized AS (SELECT cell, comp, step, y, count(*) OVER (PARTITION BY cell, comp) AS n,
                 6 * (lead(y) OVER w - 2 * y + lag(y) OVER w) AS d
          FROM long WINDOW w AS (PARTITION BY cell, comp ORDER BY step)),
fwd(cell, comp, step, cp, dp) AS (
  SELECT cell, comp, step, 0.0::DOUBLE, 0.0::DOUBLE FROM sized WHERE step = 0
  UNION ALL
  SELECT s.cell, s.comp, s.step, 1 / (4 - f.cp), (s.d - f.dp) / (4 - f.cp)
  FROM fwd f JOIN sized s ON s.cell = f.cell AND s.comp = f.comp AND s.step = f.step + 1 AND s.step < s.n - 1),
bwd(cell, comp, step, m) AS (
  SELECT cell, comp, n - 1, 0.0::DOUBLE FROM sized WHERE step = 0
  UNION ALL
  SELECT f.cell, f.comp, f.step, CASE WHEN f.step = 0 THEN 0 ELSE f.dp - f.cp * b.m END
  FROM bwd b JOIN fwd f ON f.cell = b.cell AND f.comp = b.comp AND f.step = b.step - 1),
at_points AS (
  SELECT cell, comp, n, p AS point, p * (n - 1) / {POINTS - 1}::DOUBLE AS pos
  FROM (SELECT DISTINCT cell, comp, n FROM sized WHERE n >= 2), range({POINTS}) AS r(p)),
knots AS (SELECT s.cell, s.comp, s.step, y, m FROM sized s JOIN bwd USING (cell, comp, step)),
spline AS (
  SELECT q.cell, q.comp, q.point,
         (1 - t) * lo.y + t * hi.y + ((pow(1 - t, 3) - (1 - t)) * lo.m + (pow(t, 3) - t) * hi.m) / 6 AS v
  FROM (SELECT *, CAST(least(floor(pos), n - 2) AS BIGINT) AS k, pos - least(floor(pos), n - 2) AS t FROM at_points) q
  JOIN knots lo ON lo.cell = q.cell AND lo.comp = q.comp AND lo.step = q.k
  JOIN knots hi ON hi.cell = q.cell AND hi.comp = q.comp AND hi.step = q.k + 1)"""

register(
    "resampled_histories",
    lambda spark, sf: resampled(written_histories(spark, sf)),
    f"""WITH RECURSIVE {SPLINE_CTE}
        SELECT cell, point, {", ".join(f"max(CASE WHEN comp = '{c}' THEN v END) AS {c}" for c in STRAIN)}
        FROM spline GROUP BY cell, point""",
    STRAIN,
)


def history_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    histories = written_histories(spark, sf_dir)
    vectors = materialise(similarity.history_vectors(resampled(histories)), "vectors")
    discard(histories)
    return vectors


HISTORY_PAIRS = f"""
{SPLINE_CTE},
vectors AS (SELECT cell, list(v ORDER BY point, comp) AS vec FROM spline GROUP BY cell),
pairs AS (SELECT a.cell AS cell1, b.cell AS cell2, list_distance(a.vec, b.vec) AS dist
          FROM vectors a JOIN vectors b ON a.cell < b.cell WHERE list_distance(a.vec, b.vec) < {HISTORY_THRESHOLD}::DOUBLE)"""

register(
    "similar_histories",
    lambda spark, sf: similarity.similar_points(history_vectors(spark, sf), HISTORY_THRESHOLD),
    f"WITH RECURSIVE {HISTORY_PAIRS} SELECT * FROM pairs",
    ["dist"],
)
register(
    "near_histories",
    lambda spark, sf: similarity.similar_points(history_vectors(spark, sf), NEAR_THRESHOLD),
    f"WITH RECURSIVE {HISTORY_PAIRS} SELECT * FROM pairs WHERE dist < {NEAR_THRESHOLD}::DOUBLE",
    ["dist"],
)
register(
    "history_mapping",
    lambda spark, sf: mapping_of(history_vectors(spark, sf), HISTORY_THRESHOLD),
    f"WITH RECURSIVE {HISTORY_PAIRS}, {greedy_sql('pairs', 'vectors')} SELECT * FROM mapping",
)
