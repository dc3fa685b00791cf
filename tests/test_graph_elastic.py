from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom import schemas
from runloom.functions import workspace
from runloom.operators import coarsen, elastic, similarity
from runloom.plans import elastic_queries, graph_queries, registry


def greedy(edges, copies=None):
    """Sequential rule: highest (degree, id) first."""
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    size = copies or {}
    rep = {}
    while adj:
        best = max(adj, key=lambda n: (sum(size.get(m, 1) for m in adj[n]) + size.get(n, 1) - 1 if adj[n] else -1, n))
        group = adj[best] | {best}
        for n in group:
            rep[n] = best
        adj = {n: {m for m in ns if m not in group} for n, ns in adj.items() if n not in group}
    return rep


def mapping(spark, edges, **kw):
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "cell1 long, cell2 long, dist double")
    return {r.gp: r.rep for r in coarsen.coarsen(coarsen.build_graph(df), **kw).collect()}


def test_coarsen_path_golden(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "cell1 long, cell2 long, dist double")
    got = coarsen.full_mapping(coarsen.coarsen(coarsen.build_graph(df)), 6)
    assert {r.gp: r.rep for r in got.collect()} == {0: 1, 1: 1, 2: 3, 3: 3, 4: 3, 5: 5}
    c = coarsen.coarsening_counts(got.filter("gp < 5"), got.filter("gp < 5")).first()
    assert (c.points_to_update, c.neighbours_removed, c.simulations_required, c.representatives) == (5, 3, 2, 2)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 25), st.integers(0, 25)).filter(lambda e: e[0] < e[1]), min_size=1, max_size=60))
def test_coarsen_equals_sequential_greedy(spark, edges):
    assert mapping(spark, sorted(edges)) == greedy(edges)


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(coarsen, "HUB_EDGES", 2)
    rng = np.random.default_rng(6)
    edges = {(0, int(b)) for b in range(1, 20)} | {tuple(sorted(map(int, rng.choice(40, 2, replace=False)))) for _ in range(50)}
    assert mapping(spark, sorted(edges)) == greedy(edges)


def test_hash_ties_give_a_valid_mapping(spark):
    edges = [(i, i + 1) for i in range(40)]
    rep = mapping(spark, edges, tie="hash")
    assert set(rep) == set(range(41))
    near = {frozenset(e) for e in edges}
    assert all(g == r or frozenset((g, r)) in near for g, r in rep.items())
    kept = {g for g, r in rep.items() if g == r}
    assert all(not (a in kept and b in kept) for a, b in edges)


def test_graph_build(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (3, 3, 0.0), (4, 5, 0.0)], "cell1 long, cell2 long, dist double")
    g = {(r.a, r.b): (r.dist, r.weight) for r in coarsen.build_graph(df).collect()}
    assert g == {(1, 2): (0.25, 4.0), (4, 5): (0.0, None)}
    m = coarsen.max_degree_node(coarsen.build_graph(df)).first()
    assert (m.node, m.degree) == (5, 1)
    g2 = coarsen.build_graph(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (5, 6, 1.0)], df.schema))
    pick = spark.createDataFrame([(2,)], "node long")
    gone = coarsen.neighbours_of(g2, pick)
    assert sorted(r.node for r in gone.collect()) == [1, 2, 3]
    assert [(r.a, r.b) for r in coarsen.remove_nodes(g2, gone).collect()] == [(5, 6)]


def brute(vecs, thr):
    out = {}
    for i in range(len(vecs)):
        for j in range(i + 1, len(vecs)):
            d = np.sqrt(((vecs[i] - vecs[j]) ** 2).sum())
            if d < thr:
                out[i, j] = d
    return out


@pytest.mark.parametrize("axes,block", [(0, 7), (1, 7), (2, 5), (2, 1000), (3, 3)])
def test_similar_pairs_equal_brute_force(spark, axes, block):
    rng = np.random.default_rng(4)
    vecs = np.concatenate([rng.normal(size=(60, 6)), 50 + 0.1 * rng.normal(size=(40, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "cell long, vec array<double>").repartition(3)
    got = {(r.cell1, r.cell2): r.dist for r in similarity.similar_pairs(df, 0.8, axes, block).collect()}
    expect = brute(vecs, 0.8)
    assert got.keys() == expect.keys() and len(got) == similarity.similar_pairs(df, 0.8, axes, block).count()
    assert np.allclose([got[k] for k in expect], list(expect.values()), rtol=1e-12)


def _unit_clusters(seed, groups, members, dims, noise):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    vecs = np.repeat(middles, members, axis=0) + noise * rng.normal(size=(groups * members, dims))
    return vecs / np.linalg.norm(vecs, axis=1)[:, None]


def _table(spark, vecs):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "cell long, vec array<double>")


@pytest.mark.parametrize("method, block", [("pivots", 16), ("pivots", 1024), ("grid", 16), ("blocks", 16), (None, 16)])
def test_every_method_finds_all_pairs(spark, method, block):
    """Clusters, a crowded spot, far outliers and vectors on the border between two pivots."""
    rng = np.random.default_rng(8)
    vecs = np.concatenate([
        rng.normal(size=(120, 5)), 0.2 * rng.normal(size=(150, 5)) + 3, 40 * rng.normal(size=(20, 5)),
        np.outer(np.linspace(-4, 4, 60), np.ones(5)),
    ])
    for threshold in (0.3, 1.0, 8.0):
        got = similarity.similar_pairs(_table(spark, vecs), threshold, 2, block, method).collect()
        expect = brute(vecs, threshold)
        assert {(r.cell1, r.cell2) for r in got} == expect.keys() and len(got) == len(expect)


def test_pivots_compare_few_pairs_of_unit_vectors(spark):
    """No coordinate parts the clusters; cells of pivots do, and the choice falls on them."""
    vecs = _unit_clusters(1, 60, 50, 16, 0.03)
    df = _table(spark, vecs).cache()
    assert similarity.compared_pairs(similarity.pair_tasks(df, 0.1, method="blocks")) == len(vecs) * (len(vecs) - 1) // 2
    chosen = similarity.compared_pairs(similarity.pair_tasks(df, 0.1))
    assert chosen == similarity.compared_pairs(similarity.pair_tasks(df, 0.1, method="pivots")) < 0.05 * len(vecs) ** 2
    got = similarity.similar_pairs(df, 0.1).collect()
    assert {(r.cell1, r.cell2) for r in got} == brute(vecs, 0.1).keys()


def test_rings_part_a_cell(spark):
    """One pivot alone: only rings of distances to it keep vectors apart."""
    vecs = np.random.default_rng(3).normal(size=(600, 2)) * 20
    df = _table(spark, vecs).cache()
    tasks = similarity.pair_tasks(df, 0.5, 2, 8, "pivots", 1)
    assert similarity.compared_pairs(tasks) < 0.1 * 600**2
    got = similarity.similar_pairs(df, 0.5, 2, 8, "pivots", 1).collect()
    assert {(r.cell1, r.cell2) for r in got} == brute(vecs, 0.5).keys()


def test_pivots_far_from_origin_empty_and_not_finite(spark):
    base = np.full(60, 1000.0)
    vecs = np.array([base + i * 1e-7 for i in range(8)] + [base + 1e-3 * i for i in range(1, 5)])
    got = similarity.similar_pairs(_table(spark, vecs), 1e-6, method="pivots").collect()
    assert {(r.cell1, r.cell2) for r in got} == brute(vecs, 1e-6).keys()
    empty = spark.createDataFrame([], "cell long, vec array<double>")
    assert similarity.similar_pairs(empty, 1.0, method="pivots").count() == 0
    odd = np.array([[0.0, 0.0], [0.1, 0.0], [np.nan, 0.0], [np.inf, 0.0]])
    got = similarity.similar_pairs(_table(spark, odd), 1.0, method="pivots").collect()
    assert [(r.cell1, r.cell2) for r in got] == [(0, 1)]


def test_tiny_threshold_far_from_origin(spark):
    base = np.full(60, 1000.0)
    vecs = [base + i * 1e-7 for i in range(8)] + [base + 1e-3 * i for i in range(1, 5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "cell long, vec array<double>")
    got = {(r.cell1, r.cell2) for r in similarity.similar_pairs(df, 1e-6).collect()}
    assert got == set(brute(np.array(vecs), 1e-6))


def test_copies_become_one_class_and_mapping_equals_sequential(spark):
    """A third of all points are equal; the class graph gives the same mapping as all pairs."""
    rng = np.random.default_rng(5)
    vecs = rng.uniform(0, 6, size=(60, 2))
    vecs[::3] = vecs[0]
    vecs[1] = vecs[4] = vecs[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "cell long, vec array<double>")
    edges, classes, members = similarity.similar_histories(df, 0.7)
    assert classes.agg(F.max("copies")).first()[0] == 20
    m = coarsen.coarsen(coarsen.build_graph(edges), classes)
    got = {r.gp: r.rep for r in coarsen.expand_classes(m, members).collect()}
    pairs = list(brute(vecs, 0.7))
    expect = {i: i for i in range(60)} | greedy(pairs)
    assert got == expect


def test_most_similar(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.1)], "cell1 long, cell2 long, dist double")
    got = {r.cell: (r.n_similar, r.nearest, r.dist) for r in similarity.most_similar(e).collect()}
    assert got == {1: (2, 2, 0.5), 2: (2, 3, 0.1), 3: (2, 2, 0.1)}


def test_apply_mapping(spark):
    m = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "gp long, rep long")
    res = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)], "gp long, t int, v double")
    got = sorted((r.gp, r.t, r.v) for r in coarsen.apply_mapping(m, res).collect())
    assert got == [(0, 0, 5.0), (0, 1, 6.0), (1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)]


def test_many_edges_are_dealt_to_more_tasks(spark, many_partitions):
    rows = [(i % 90, (i * 7) % 50, float(i % 5 + 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "cell1 long, cell2 long, dist double")
    pairs = {(min(a, b), max(a, b)) for a, b, _ in rows if a != b}
    graph = coarsen.build_graph(df, rows=20_000_000)
    assert graph.rdd.getNumPartitions() == 20 and graph.count() == len(pairs)
    assert {(r.a, r.b): r.dist for r in graph.collect()} == {(r.a, r.b): r.dist for r in coarsen.build_graph(df).collect()}
    ends = [x for pair in pairs for x in pair]
    assert {r.node: r.degree for r in coarsen.degrees(graph).collect()} == {x: ends.count(x) for x in set(ends)}


def test_sized_samples_average_as_counted_ones(spark):
    """The number of samples of a series may come with the rows; a series without a full key is left out."""
    rows = [(m, 0, "org", p) for m in (1, 2, None) for p in range(25 if m == 1 else 7)]
    df = spark.createDataFrame(rows, "material long, dir long, ori string, position long").withColumns(
        {p: (F.col("position") * (i + 1.0) + 1.0) for i, p in enumerate(elastic.PRESSURES)})
    sizes = df.groupBy("material").agg(F.count(F.lit(1)).alias("n"))
    sized = df.join(sizes.withColumnRenamed("material", "_m"), F.col("material").eqNullSafe(F.col("_m"))).drop("_m")
    got = sorted(tuple(r) for r in elastic.averaged_stress(sized, size="n").collect())
    assert np.allclose([g[3:] for g in got], [r[3:] for r in sorted(tuple(r) for r in elastic.averaged_stress(df).collect())])
    assert [g[0] for g in got] == [1, 2] and np.isclose(got[0][3], np.arange(24).mean() + 1.0)


def test_running_block_means(spark):
    df = spark.range(45).select(F.lit(1).alias("s"), F.col("id").alias("p"), F.col("id").cast("double").alias("v"))
    out = elastic.running_block_means(df, ["s"], "p", ["v"]).orderBy("block").collect()
    blocks = [np.arange(4 * b, 4 * b + 4).mean() for b in range(11)]
    assert np.allclose([r.v_block for r in out], blocks)
    assert np.allclose([r.v_running for r in out], np.cumsum(blocks) / np.arange(1, 12))
    w = spark.createDataFrame([(n,) for n in (5, 100, 10000, 10001, 50000)], "n long")
    assert [r[0] for r in w.select(elastic.averaging_width(F.col("n"))).collect()] == [1, 10, 1000, 10, 50]
    half = elastic.average_lengths(df.filter("p < 10"), ["s"], "p", ["v"]).first()
    assert half.v == 4.5


def stiffness(c11, c12, c44):
    c = np.zeros((6, 6))
    c[:3, :3] = c12
    c[range(3), range(3)] = c11
    c[range(3, 6), range(3, 6)] = c44
    return c


def test_elastic_tensor_recovers_known_stiffness(spark):
    c = stiffness(151.4, 76.4, 56.4)
    lengths = {"lx0": 10.0, "ly0": 12.0, "lz0": 14.0}
    eeps = [0.0, -0.2, 0.1, -0.3, 0.0, 0.4]
    order = {"pxx": 0, "pyy": 1, "pzz": 2, "pyz": 3, "pxz": 4, "pxy": 5}
    base = {p: 3.0 + k for p, k in order.items()}
    rows = [("m", 0, "org", *[base[p] for p in schemas.PRESSURES])]
    for j in range(6):
        for ori, side in (("neg", -1.0), ("pos", 1.0)):
            strain = side * (1.0 if eeps[j] == 0 else np.sign(eeps[j])) * 1e-2
            rows.append(("m", j + 1, ori, *[float(base[p] - c[order[p], j] * strain / elastic.CFAC) for p in schemas.PRESSURES]))
    stress = spark.createDataFrame(rows, ["material", "dir", "ori", *schemas.PRESSURES])
    names = [elastic.STRAIN_OF_DIRECTION[j] for j in range(1, 7)]
    states = spark.createDataFrame([("m", *lengths.values(), *eeps)], ["material", *lengths, *names])
    d = elastic.stiffness_differences(stress, states)
    for ori in (None, "neg", "pos"):
        full = {(r.i, r.j): r.c for r in elastic.combine_orientations(d, ori).collect()}
        assert len(full) == 36
        assert np.allclose([full[i + 1, j + 1] for i in range(6) for j in range(6)], c.ravel())
    sym = elastic.symmetrise(elastic.combine_orientations(d))
    assert sym.count() == 21
    m = elastic.cubic_moduli(sym).first()
    assert np.allclose([m.bulk, m.shear1, m.shear2, m.poisson], [101.4, 56.4, 37.5, 0.335382], atol=1e-6)


def test_raw_rows_of_a_series_are_numbered_without_one_task(spark, sf_dir, many_partitions):
    """No window is dealt by the keys of a series alone: each has the part of the range-partitioned table too."""
    for query, keys in ((elastic_queries.averaged_stress, ["material", "dir", "ori"]), (elastic_queries.lengths, ["run_id"])):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        numbered = [x for x in plan.split("\n") if "row_number()" in x and "Window [" in x]
        assert numbered and all("_part#" in x for x in numbered)


def _dense(n=120, seed=5):
    draw = np.random.default_rng(seed)
    return [(int(i), int(j), 1.0) for i in range(n) for j in range(i) if draw.random() < 0.12]


@pytest.mark.parametrize("budget", [10, 200, 100_000])
def test_a_dense_graph_is_walked_in_few_rounds(spark, monkeypatch, budget):
    """Nearly all nodes lie within two steps: a round of leaders alone would take about one each time."""
    made, write = [], coarsen.materialise

    def counted(df, label):
        made.append(label)
        return write(df, label)

    monkeypatch.setattr(coarsen, "materialise", counted)
    monkeypatch.setattr(coarsen, "WALK_EDGES", budget, raising=False)
    edges = _dense(20 if budget == 10 else 60)
    df = spark.createDataFrame(edges, "cell1 long, cell2 long, dist double")
    got = {r.gp: r.rep for r in coarsen.coarsen(coarsen.build_graph(df)).collect()}
    assert got == greedy([e[:2] for e in edges])
    if budget == 100_000:
        assert made == ["edges", "walk"]


@pytest.mark.parametrize("budget,most,tie", [(40, 50_000, "id"), (60, 3, "hash")])
def test_walks_and_rounds_agree_on_copies_and_ties(spark, monkeypatch, budget, most, tie):
    df = spark.createDataFrame(_dense(24, 6), "cell1 long, cell2 long, dist double")
    classes = spark.createDataFrame([(i, 1 + i % 4) for i in range(24)], "cell long, copies long")
    graph = coarsen.build_graph(df)
    monkeypatch.setattr(coarsen, "WALK_EDGES", 0)
    monkeypatch.setattr(coarsen, "KEPT", 1.0)
    want = {r.gp: r.rep for r in coarsen.coarsen(graph, classes, tie).collect()}
    monkeypatch.setattr(coarsen, "WALK_EDGES", budget)
    monkeypatch.setattr(coarsen, "WALK_NODES", most)
    monkeypatch.setattr(coarsen, "KEPT", 0.0)
    assert {r.gp: r.rep for r in coarsen.coarsen(graph, classes, tie).collect()} == want


def test_a_dense_graph_is_walked_before_any_round(spark, monkeypatch):
    """A round would rewrite all edges; the walk needs several turns here."""
    made, write = [], coarsen.materialise
    monkeypatch.setattr(coarsen, "materialise", lambda df, label: made.append(label) or write(df, label))
    monkeypatch.setattr(coarsen, "WALK_EDGES", 150)
    monkeypatch.setattr(coarsen, "DENSE", 4)
    edges = _dense(60)
    df = spark.createDataFrame(edges, "cell1 long, cell2 long, dist double")
    graph = coarsen.build_graph(df, once=True)
    assert "Exchange" not in graph._jdf.queryExecution().executedPlan().toString()
    got = {r.gp: r.rep for r in coarsen.coarsen(graph).collect()}
    assert got == greedy([e[:2] for e in edges])
    assert made[:3] == ["edges", "walk", "edges"]


@pytest.mark.parametrize("repeated", [False, True])
def test_a_mapping_keeps_no_edges(spark, repeated):
    """The graph and the edges of all turns are deleted once the mapping is written; a key may have two vectors."""
    rng = np.random.default_rng(12)
    vecs = rng.uniform(0, 3, size=(40, 2))
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + ([(3, vecs[7].tolist()), (9, [8.0, 8.0]), (9, [8.1, 8.0])] if repeated else [])
    root = Path(workspace.work_root(spark).removeprefix("file:"))
    before = set(root.iterdir()) if root.exists() else set()
    out = graph_queries.mapping_of(spark.createDataFrame(rows, "cell long, vec array<double>"), 0.7)
    left = {p.name.split("-")[0] for p in set(root.iterdir()) - before}
    assert "classes" in left and not left & {"graph", "edges"}
    got = sorted((r.gp, r.rep) for r in out.collect())
    assert len(got) == len(rows)
    if not repeated:
        assert dict(got) == {i: i for i in range(40)} | greedy(list(brute(vecs, 0.7)))


def test_order_of_places_is_stable():
    for top in (50, 70_000, 1 << 30):
        values = np.random.default_rng(1).integers(0, top, 5000).astype(np.int32)
        assert (coarsen._order(values) == np.argsort(values, kind="stable")).all()


def test_vectors_are_sent_to_a_bounded_number_of_blocks(spark):
    """Where every block meets every other, blocks grow before their number does; no pair is lost."""
    draw = np.random.default_rng(8).normal(size=(400, 3))
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw)], "cell long, vec array<double>")
    tasks = similarity.pair_tasks(classes, 0.5, block_rows=4, method="blocks")
    assert tasks.count() <= 400 * similarity.MOST_BLOCKS and similarity.compared_pairs(tasks) == 400 * 399 // 2
    got = {(r.cell1, r.cell2) for r in similarity.similar_pairs(classes, 0.5, block_rows=4, method="blocks").collect()}
    near = np.sqrt(((draw[:, None] - draw[None]) ** 2).sum(axis=2)) < 0.5
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j}


def _point_pairs(rows, threshold):
    """All pairs of rows with different keys below the threshold, as SQL joins them."""
    out = []
    for a, v in rows:
        for b, w in rows:
            if a is not None and b is not None and a < b and v is not None and w is not None:
                with np.errstate(invalid="ignore"):
                    d = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                if d < threshold:
                    out.append((a, b, round(d, 9)))
    return sorted(out)


@pytest.mark.parametrize("again, method, block", [(False, "blocks", 1024), (True, "blocks", 8), (False, "pivots", 8)])
def test_pairs_of_points_hold_copies(spark, again, method, block):
    """Copies are pairs at distance 0 and share all pairs of their vector; keys and vectors may be null or repeat."""
    rng = np.random.default_rng(11)
    vecs = rng.uniform(0, 6, size=(70, 2))
    vecs[::3], vecs[1::7] = vecs[0], vecs[1]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    if method == "blocks":
        rows += [(200 + i, [float("nan"), 0.0]) for i in range(2)] + [(300 + i, [float("inf"), 0.0]) for i in range(2)]
    rows += [(None, rows[3][1]), (None, [9.0, 9.0]), (400, None), (401, None), (90, [-0.0, 0.5]), (91, [0.0, 0.5])]
    if again:
        rows += rows[:5] + [(3, [5.0, 5.0]), (69, [2.0, 3.0]), (5, rows[3][1])]
    df = spark.createDataFrame(rows, "cell long, vec array<double>").repartition(3)
    want = _point_pairs(rows, 0.7)
    assert any(d == 0 for _, _, d in want)
    got = similarity.similar_points(df, 0.7, block_rows=block, method=method).collect()
    assert sorted((r.cell1, r.cell2, round(r.dist, 9)) for r in got) == want
    near = {}
    for a, b, d in want:
        near.setdefault(a, []).append((d, b))
        near.setdefault(b, []).append((d, a))
    got = similarity.most_similar_points(df, 0.7, block_rows=block, method=method).collect()
    assert len(got) == len(near)
    assert {r.cell: (r.n_similar, round(r.dist, 9), r.nearest) for r in got} == {c: (len(x), *min(x)) for c, x in near.items()}


@pytest.mark.parametrize("name", ["similar_embeddings", "most_similar_embeddings"])
def test_queries_on_embeddings_list_copies(spark, tmp_path, name):
    rows = [(i, [float(i % 3), 0.0]) for i in range(7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    want = _point_pairs(rows, graph_queries.THRESHOLD)
    if name == "similar_embeddings":
        assert sorted((r.cell1, r.cell2, round(r.dist, 9)) for r in got) == want
    else:
        assert {r.cell: r.n_similar for r in got} == {i: sum(i in p[:2] for p in want) for i in range(7)}


def test_a_huge_vector_hides_no_pair(spark):
    """Its square overflows, so the quick form of the distances tells nothing there."""
    vecs = np.array([[0.0, 0.0], [0.1, 0.0], [1e200, 0.0], [5.0, 0.0], [5.2, 0.0]])
    got = similarity.similar_pairs(_table(spark, vecs), 1.0).collect()
    assert sorted((r.cell1, r.cell2) for r in got) == [(0, 1), (3, 4)]
