"""Autocovariances in two parts against dense ones; communities over edges on planted graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import kernels as K
from chronoloom.operators import lowrank

KEY = ["g"]


def _walk(seed, n, link):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) < link, 1).astype(float)
    a = a + a.T
    a[np.arange(n), (np.arange(n) + 1) % n] = a[(np.arange(n) + 1) % n, np.arange(n)] = 1
    return a / a.sum(axis=1, keepdims=True), a.sum(axis=1) / a.sum()


def _tables(spark, mats):
    cells = [(g, int(i), int(j), float(t[i, j])) for g, (t, p) in enumerate(mats) for i, j in zip(*np.nonzero(t), strict=True)]
    vectors = [(g, i, float(x)) for g, (t, p) in enumerate(mats) for i, x in enumerate(p)]
    return spark.createDataFrame(cells, "g long, i long, j long, v double"), spark.createDataFrame(vectors, "g long, node long, d double")


def _dense(frame, shapes):
    out = [np.zeros((n, n)) for n in shapes]
    for r in frame.collect():
        out[r["g"]][r["i"], r["j"]] += r["v"]
    return out


def test_parts_against_dense(spark):
    rng = np.random.default_rng(1)
    mats = [(_walk(g, n, 0.3)[0], rng.dirichlet(np.ones(n))) for g, n in enumerate((7, 12))]
    t, p = _tables(spark, mats)
    s = lowrank.autocovariance(t, p, KEY)
    want = [np.diag(p) @ t - np.outer(p, p @ t) for t, p in mats]
    for a, b in zip(_dense(lowrank.to_cells(s), (7, 12)), want, strict=True):
        assert np.allclose(a, b)
    margins = {(r["g"], r["node"]): (r["row_sum"], r["column_sum"]) for r in lowrank.margins(s).collect()}
    assert all(margins[g, i] == pytest.approx((m[i].sum(), m[:, i].sum()), abs=1e-12) for g, m in enumerate(want) for i in range(len(m)))
    part = p.select("g", "node", (F.col("node") % 3).alias("cluster"))
    hot = [np.eye(3)[np.arange(len(m)) % 3] for m in want]
    for a, b, h in zip(_dense(lowrank.to_cells(lowrank.contract(s, part)), (3, 3)), want, hot, strict=True):
        assert np.allclose(a, h.T @ b @ h)
    got = {r["g"]: r["stability"] for r in lowrank.stability(s, part).collect()}
    assert got == pytest.approx({g: K.stability(m, np.arange(len(m)) % 3) for g, m in enumerate(want)})
    total = {r["g"]: r["total"] for r in lowrank.block_total(s, p.where("node < 3"), p.where("node >= 2")).collect()}
    assert total == pytest.approx({g: m[:3, 2:].sum() for g, m in enumerate(want)})
    asked = spark.createDataFrame([(0, 1, 2), (0, 3, 3), (1, 11, 0), (1, 50, 0)], "g long, i long, j long")
    found = {(r["g"], r["i"], r["j"]): r["v"] for r in lowrank.elements(s, asked).collect()}
    assert found == pytest.approx({(0, 1, 2): want[0][1, 2], (0, 3, 3): want[0][3, 3], (1, 11, 0): want[1][11, 0], (1, 50, 0): 0.0})
    blocks = _dense(lowrank.to_cells(lowrank.forward_blocks(t, p, part, KEY)), (3, 3))
    for a, (t_, p_), h in zip(blocks, mats, hot, strict=True):
        assert np.allclose(a, h.T @ K.forward_autocovariance(t_, p_) @ h)


def test_near_zero(spark):
    """A matrix of equal rows, the same with one cell left out or moved, one of vectors alone, and vectors too small to matter."""
    n, p = 6, np.arange(1, 7) / 21
    same = np.tile(p, (n, 1))
    hole, moved = same.copy(), same.copy()
    hole[2, 5], moved[2, 5] = 0.0, 0.9
    t, v = _tables(spark, [(same, p), (hole, p), (moved, p), (np.zeros((n, n)), p), (np.zeros((n, n)), p * 1e-5)])
    s = lowrank.autocovariance(t, v, KEY, v)
    assert {r["g"]: r["near_zero"] for r in lowrank.near_zero(s).collect()} == {0: True, 1: False, 2: False, 3: False, 4: True}


def _planted(seed, blocks, size, inside, between):
    rng = np.random.default_rng(seed)
    block = np.repeat(np.arange(blocks), size)
    a = np.triu(rng.random((len(block),) * 2) < np.where(block[:, None] == block, inside, between), 1).astype(float)
    a = a + a.T
    return a / a.sum(axis=1, keepdims=True), a.sum(axis=1) / a.sum(), block


def test_communities_of_planted_blocks(spark):
    """Two graphs that are not made of cliques, at once; no less stable than the dense kernel's runs."""
    graphs = [_planted(3, 3, 25, 0.4, 0.03), _planted(4, 4, 15, 0.6, 0.05)]
    t, p = _tables(spark, [g[:2] for g in graphs])
    rows = lowrank.communities(lowrank.autocovariance(t, p, KEY), seed=1).collect()
    for g, (walk, stationary, block) in enumerate(graphs):
        mine = sorted((r["node"], r["cluster"], r["stability"]) for r in rows if r["g"] == g)
        assert [x[0] for x in mine] == list(range(len(block)))
        label = np.array([x[1] for x in mine])
        assert (label == np.searchsorted(block, block)).all()
        s = K.autocovariance(walk, stationary)
        assert mine[0][2] == pytest.approx(K.stability(s, label))
        assert mine[0][2] >= max(K.stability(s, K.louvain(s, seed)) for seed in range(3)) - 1e-9


def test_communities_without_structure(spark):
    """No better than apart: a complete graph stays one class or a node each, and an empty table has no rows."""
    n = 8
    t = (np.ones((n, n)) - np.eye(n)) / (n - 1)
    cells, p = _tables(spark, [(t, np.full(n, 1 / n))])
    got = lowrank.communities(lowrank.autocovariance(cells, p, KEY)).toPandas()
    s = K.autocovariance(t, np.full(n, 1 / n))
    assert got["stability"].iloc[0] >= K.stability(s, K.louvain(s, 0)) - 1e-9
    assert lowrank.communities(lowrank.autocovariance(cells.where("false"), p.where("false"), KEY)).count() == 0


def test_orders_are_not_exploded_over_keys(spark):
    """Near orders meet in one range frame; links are dealt once, by their first node."""
    from chronoloom import catalog

    plan = catalog.queries()["order_covariance_total"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan and plan.count("hashpartitioning(i#") <= 1
    pairs = catalog._order_pairs(spark, "/root/testdata/sf0.001")
    placed = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey").collect())
    want = 2 * sum(0 < b[0] - a[0] <= 12 and a[1] != b[1] for n, a in enumerate(placed) for b in placed[n + 1 : n + 40])
    assert pairs.count() == want


def test_conditions_on_cells_reach_the_pairs(spark):
    """Cells that are not asked for are left out before pairs are shuffled, and cells meet no join that divides and multiplies rows."""
    from chronoloom import catalog

    for name, condition in (("order_covariance_elements", "+ 1)"), ("order_covariance_total", "% 3)")):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        dealt = next(n for n, line in enumerate(plan) if "RepartitionByExpression [i#" in line)
        assert any(line.strip(" :+-").startswith("Filter") and condition in line for line in plan[dealt + 1 :])


def test_undirected_links(spark):
    """The same parts as of the walk's own matrix."""
    links = spark.createDataFrame([(0, 0, 1, 2.0), (0, 1, 0, 2.0), (0, 1, 2, 6.0), (0, 2, 1, 6.0)], "g long, i long, j long, v double")
    p = spark.createDataFrame([(0, 0, 2 / 16), (0, 1, 8 / 16), (0, 2, 6 / 16)], "g long, node long, d double")
    walk = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, 0.25), (0, 1, 2, 0.75), (0, 2, 1, 1.0)], "g long, i long, j long, v double")
    mine = lowrank.to_cells(lowrank.undirected(links, p, spark.createDataFrame([(0, 16.0)], "g long, all double"), KEY)).collect()
    want = {(r["i"], r["j"]): r["v"] for r in lowrank.to_cells(lowrank.autocovariance(walk, p, KEY)).collect()}
    assert {(r["i"], r["j"]): r["v"] for r in mine} == pytest.approx(want) and len(mine) == 9


def test_forward_blocks_of_a_given_vector(spark):
    """p2 given is p1 T: the same blocks."""
    cells = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, 0.5), (0, 1, 2, 0.5), (0, 2, 1, 1.0)], "sample_id long, i long, j long, v double")
    p = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.5), (0, 2, 0.25)], "sample_id long, node long, d double")
    part = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 1)], "sample_id long, node long, cluster long")
    a, b = (lowrank.to_cells(lowrank.forward_blocks(cells, p, part, ["sample_id"], *x)).collect() for x in ((), (p,)))
    values = lambda rows: {(r["i"], r["j"]): r["v"] for r in rows}
    assert values(a) == pytest.approx(values(b)) and len(a) == 4
