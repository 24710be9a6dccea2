"""Golden toys, edge cases and properties of the temporal-network operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import arrays, kernels
from chronoloom.operators import cells, clustering, detection, graph, intervals, partitions, scores, series, transitions
from chronoloom.plans import pipelines, windows
from chronoloom.schema import EVENTS
from chronoloom.sources import events as ev
from chronoloom.sources import generators, storage
from chronoloom.streaming import active


def _events(spark, rows):
    return spark.createDataFrame([(0, n, *r) for n, r in enumerate(rows)], EVENTS)


def _values(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_cycle_entropy(spark):
    _, packed = pipelines.prepare(generators.cycle(spark))
    got = {(r["lamda"], r["k"]): r["entropy"] for r in transitions.running_entropy(packed, [1.0, 10.0]).collect()}
    want = {(1.0, 0): 0.455974, (1.0, 1): 0.911948, (1.0, 2): 1.082869, (10.0, 0): 0.462098, (10.0, 1): 0.924196, (10.0, 2): 1.068037}
    assert got == pytest.approx(want, abs=1e-6)
    back = {(r["lamda"], r["k"]): r["entropy"] for r in transitions.running_entropy(packed, [1.0], reverse=True).collect()}
    assert back[1.0, 0] == pytest.approx(1.082869, abs=1e-6)


@pytest.mark.parametrize("reverse, walk", [(False, True), (True, False), (True, True)])
def test_scan_over_blocks(spark, reverse, walk):
    """One sample of many blocks, joined in three levels, against products one by one."""
    rng = np.random.default_rng(9)
    a = np.sort(rng.uniform(0, 40, 70))
    rows = [(int(i), int(j), float(t), float(t + d)) for i, j, t, d in zip(rng.integers(0, 5, 70), rng.integers(0, 5, 70), a, rng.exponential(1, 70), strict=True) if i != j]
    _, packed = pipelines.prepare(_events(spark, rows))
    part = packed.toPandas().sort_values("k", ascending=not reverse)
    n, total, want = int(part["n_nodes"].iloc[0]), None, {}
    for k, m in zip(part["k"], transitions._kernels(part, n, 0.5, walk), strict=True):
        total = m if total is None else total @ m
        want[k] = kernels.entropy(total)
    got = {r["k"]: r["entropy"] for r in transitions.running_entropy(packed, [0.5], walk, reverse, block=4).collect()}
    assert got == pytest.approx(want)
    products = transitions.block_products(packed, [0.5], walk, reverse, 4)
    whole = transitions.carries(products, reverse, fan=3).collect()
    assert len(whole) == products.count() > 9 and sum(np.allclose(np.reshape(r["m"], (n, n)), np.eye(n)) for r in whole) == 1
    cells = {(r["i"], r["j"]): r["v"] for r in transitions.running_transition(packed, [0.5], walk, reverse, block=4).collect()}
    assert cells == pytest.approx({(i, j): total[i, j] for i in range(n) for j in range(n) if abs(total[i, j]) > 1e-12})
    groups = transitions.block_products(packed, [0.5], block=4).groupBy("sample_id", "lamda").count().first()["count"]
    assert groups == -(-(int(part["k"].max()) + 1) // 4)


def test_rows_of_intervals_are_no_broadcast(spark):
    """Rows whose length no estimate knows are not sent to the driver, however small they seem."""
    rows = spark.createDataFrame([(0, k) for k in range(6)], "sample_id long, k long")
    ranges = spark.createDataFrame([(0, 1, 1, 3), (0, 2, 3, 6)], "sample_id long, interval long, start long, stop long")
    found = clustering.within(rows, ranges, 2)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert _values(found, "interval", "k") == [(1, 1), (1, 2), (2, 3), (2, 4), (2, 5)]


def test_summary_makes_its_runs_once(spark):
    """The plan of a summary reads tables, not what made the runs."""
    runs = spark.createDataFrame([(0, r, n, n // 2 if r else 0, 0.5 + r) for r in (0, 1) for n in range(4)], "sample_id long, run long, node long, cluster long, stability double")
    made = clustering.summarize(runs.mapInPandas(lambda parts: parts, runs.schema), ["sample_id"])
    assert "MapInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    assert _values(made, "best_stability", "avg_stability", "avg_clusters") == [(1.5, 1.0, 1.5)]


def test_window_plans_send_no_grid_to_the_driver(spark):
    grid = spark.createDataFrame([(s, k, float(k), 1.0) for s in (0, 1) for k in range(9)], "sample_id long, k long, t double, tau double")
    plans = [windows.centered(grid, 4.0), windows.sampled(windows.centered(grid, 4.0), 0.5), windows.forward(grid, 4.0), windows.backward(grid, 4.0), windows.bound_windows(grid, 4.0)]
    for plan in plans:
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert _values(plans[0].where("sample_id = 1"), "k", "left", "right") == [(2, 0, 4), (3, 1, 5), (4, 2, 6), (5, 3, 7), (6, 4, 7)]


def test_packed_sends_no_edges_to_the_driver(spark):
    """Edges have no side in a join, so no estimate can make a broadcast of them; empty intervals stay."""
    events = _events(spark, [(0, 1, 0.0, 1.0), (1, 2, 0.5, 1.0), (0, 2, 3.0, 4.0)])
    _, packed = pipelines.prepare(events)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    got = {r["k"]: (r["t"], r["tau"], sorted(zip(r["ii"], r["jj"], strict=True))) for r in packed.collect()}
    assert got == {0: (0.0, 0.5, [(0, 1)]), 1: (0.5, 0.5, [(0, 1), (1, 2)]), 2: (1.0, 2.0, []), 3: (3.0, 1.0, [(0, 2)])}


def test_interval_products(spark):
    """Products of the kernels between cuts agree with those of stored cells; intervals without a contact have none."""
    rows = [(0, 1, 0.0, 1.0), (1, 2, 0.5, 1.5), (0, 2, 3.0, 4.0), (2, 3, 3.5, 5.0), (0, 3, 7.0, 8.0)]
    grid, packed = pipelines.prepare(_events(spark, rows))
    ranges = spark.createDataFrame([(0, 1, 0, 3), (0, 2, 3, 4), (0, 3, 4, 9)], "sample_id long, interval long, start long, stop long")
    got = {(r["interval"], r["k"], r["i"], r["j"]): r["v"] for r in clustering.interval_products(packed, ranges, [0.5]).collect()}
    stored = clustering.within(transitions.inter_transitions(packed, [0.5]), ranges)
    n = packed.select("sample_id", "n_nodes").distinct()
    want = {(r["interval"], r["k"], r["i"], r["j"]): r["v"] for r in transitions.running_products(stored, n, ["sample_id", "interval", "lamda"], only_last=True).collect()}
    assert got == pytest.approx(want) and {k[0] for k in got} == {1, 3}


@pytest.mark.parametrize("overlap, want", [(0, [0.341981, 0.683961, 1.025942]), (1, [0.817049, 1.159030]), (2, [1.371261])])
def test_path_entropy(spark, overlap, want):
    _, packed = pipelines.prepare(generators.path(spark, 4, overlap))
    got = [r["entropy"] for r in transitions.running_entropy(packed, [1.0]).orderBy("k").collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_path_rejects_bad_overlap(spark):
    with pytest.raises(ValueError):
        generators.path(spark, 4, 3)


def test_merge(spark):
    rows = [(0, 1, 0.0, 10.0), (1, 0, 5.0, 6.0), (0, 1, 7.0, 8.0), (0, 1, 8.0, 9.0), (0, 1, 20.0, 21.0), (1, 0, 21.0, 22.0)]
    merged = intervals.merge_overlaps(_events(spark, rows))
    assert _values(merged, "t_start", "t_end") == [(0.0, 10.0), (20.0, 21.0), (21.0, 22.0)]
    assert _values(intervals.merge_overlaps(merged), "t_start", "t_end") == [(0.0, 10.0), (20.0, 21.0), (21.0, 22.0)]


def test_edge_cases(spark):
    """Empty table, self-loop, zero duration, duplicates and reversed ends."""
    empty = _events(spark, [])
    for frame in (intervals.merge_overlaps(empty), intervals.time_grid(empty), intervals.active_count(empty), graph.static_adjacency(empty), intervals.snapshots(empty, 1.0)):
        assert frame.count() == 0
    odd = _events(spark, [(2, 2, 0.0, 1.0), (0, 1, 1.0, 1.0), (0, 1, 2.0, 4.0), (0, 1, 2.0, 4.0), (1, 0, 3.0, 5.0)])
    merged = intervals.merge_overlaps(odd)
    edges = intervals.interval_edges(merged)
    assert {(r["i"], r["j"]) for r in edges.collect()} == {(0, 1)}
    loops = graph.static_adjacency(odd).where("i = 2").collect()
    assert [(r["j"], r["v"]) for r in loops] == [(2, 2.0)]
    assert _values(intervals.active_count(odd), "t", "active") == [(0.0, 1), (1.0, 0), (2.0, 2), (3.0, 3), (4.0, 1), (5.0, 0)]
    assert ev.invalid(_events(spark, [(0, 1, 3.0, 2.0)])).count() == 1


def test_from_lists(spark):
    events, nodes = ev.from_lists(spark, ["b", "a"], ["c", "b"], [1, 0], [2, 5], extra={"kind": ["x", "y"]})
    assert _values(events, "event_id", "src", "dst", "kind") == [(0, 0, 1, "y"), (1, 1, 2, "x")]
    assert _values(nodes, "node", "label") == [(0, "a"), (1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        ev.from_lists(spark, [1], [2], [1.0], [0.0])
    with pytest.raises(ValueError):
        ev.from_lists(spark, [1], [2, 3], [1.0], [2.0])


def test_window_backends_agree(spark):
    rng = np.random.default_rng(3)
    a = np.sort(rng.uniform(0, 20, 60))
    rows = [(int(i), int(j), float(t), float(t + d)) for i, j, t, d in zip(rng.integers(0, 6, 60), rng.integers(0, 6, 60), a, rng.exponential(1, 60), strict=True) if i != j]
    grid, packed = pipelines.prepare(_events(spark, rows))
    plans = pipelines.window_plans(grid, [4.0])
    signal = lambda *x, **y: [r["value"] for r in transitions.window_entropy(packed, plans, [0.5], *x, **y).orderBy("k").collect()]
    sliding = signal("sliding")
    assert sliding == pytest.approx(signal("tree")) and sliding == pytest.approx(signal("direct"))
    assert signal("sliding", reverse=True, walk=True) == pytest.approx(signal("tree", reverse=True, walk=True))
    assert min(sliding) >= 0 and max(sliding) <= math.log(6)
    # symmetric kernels: the reversed product is the transpose, of equal entropy over uniform starts where rows agree
    assert len(signal("sliding", reverse=True)) == len(sliding)
    assert windows.sampled(plans.drop("window"), 0.3).count() == math.ceil(0.3 * plans.count())
    with pytest.raises(ValueError):
        transitions.window_entropy(packed, plans, [0.5], "unknown")


def test_inter_transitions_are_stochastic(spark):
    _, packed = pipelines.prepare(generators.path(spark, 5, 2))
    for walk in (True, False):
        rows = transitions.inter_transitions(packed, [1.0], walk).groupBy("k", "i").agg(F.sum("v").alias("s")).collect()
        assert all(r["s"] == pytest.approx(1) for r in rows)


def test_component_bounds(spark):
    edges = spark.createDataFrame([(0, 0, 1)], "sample_id long, i long, j long")
    n = spark.createDataFrame([(0, 3)], "sample_id long, n_nodes long")
    sizes = graph.component_sizes(edges, ["sample_id"])
    assert graph.upper_bound(sizes, ["sample_id"], n).first()["upper_bound"] == pytest.approx(0.462098, abs=1e-6)
    assert graph.lower_bound(sizes, ["sample_id"], n).first()["lower_bound"] == pytest.approx(0.462098, abs=1e-6)


def test_bound_curves_join_no_pair_with_a_window(spark):
    """Runs of windows give the components of each window's own edges, over several blocks of windows."""
    rng = np.random.default_rng(4)
    a = np.sort(np.round(rng.uniform(0, 60, 90), 1))
    rows = [(int(i), int(j), float(t), float(t + d)) for i, j, t, d in zip(rng.integers(0, 9, 90), rng.integers(0, 9, 90), a, np.round(rng.exponential(1, 90), 1), strict=True)]
    events = intervals.merge_overlaps(_events(spark, rows))
    plan = windows.bound_windows(intervals.time_grid(events), 2.0)
    edges = intervals.range_join(events.where("src != dst"), plan, 2.0).select("sample_id", "k", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()
    want = _values(graph.component_sizes(edges, ["sample_id", "k"]), "k", "component", "size")
    runs = windows.runs_of_windows(events, plan)
    assert _values(graph.component_sizes_of_runs(runs, block=16), "k", "component", "size") == want and runs.count() < edges.count() / 4
    assert pipelines.bound_curves(events, 2.0)._jdf.queryExecution().optimizedPlan().toString().count("bucket") == 0


def test_long_chain_is_one_component(spark):
    chain = spark.range(200).select(F.lit(0).alias("g"), F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert _values(graph.components(chain, ["g"]).groupBy("component").count(), "component", "count") == [(0, 201)]


def test_metrics(spark):
    runs = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "p long, sample_id long")
    truth = spark.createDataFrame([(0, 50.0), (0, 100.0), (0, 150.0)], "sample_id long, bkp double")
    found = spark.createDataFrame([(1, 0, 48.0), (1, 0, 103.0), (1, 0, 170.0), (3, 0, 55.0)], "p long, sample_id long, pred double")
    got = {r["p"]: r for r in scores.evaluate(runs, truth, found, ["p"], 5.0).collect()}
    assert (got[1]["tp"], got[1]["precision"], got[1]["f1"], got[1]["hausdorff"]) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3), 20.0)
    assert got[2]["hausdorff"] == math.inf and got[2]["f1"] == 0
    assert got[3]["tp"] == 0  # a distance equal to the margin does not count
    none = scores.evaluate(runs, truth.where("false"), found.where("false"), ["p"], 5.0).first()
    assert none["hausdorff"] == 0
    assert scores.evaluate(runs, truth, found, ["p"], 5.0, max_error=7.0).where("p = 2").first()["hausdorff"] == 7.0
    with pytest.raises(ValueError):
        scores.evaluate(runs, truth, found, ["p"], 5.0, max_error=-1.0)


def test_equal_points_count_once(spark):
    """Three true points at one time are one, as in the SQL."""
    runs = spark.createDataFrame([(1, 0)], "p long, sample_id long")
    truth = spark.createDataFrame([(0, 50.0), (0, 50.0), (0, 50.0)], "sample_id long, bkp double")
    found = spark.createDataFrame([(1, 0, 50.0), (1, 0, 80.0), (1, 0, 90.0)], "p long, sample_id long, pred double")
    got = scores.evaluate(runs, truth, found, ["p"], 5.0).first()
    assert (got["n_true"], got["tp"], got["n_found"], got["f1"]) == (1, 1, 3, pytest.approx(0.5))


def test_best_ignores_nan(spark):
    means = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, 0.5)], "p long, mean_f1 double")
    assert scores.best(means, ["p"]).first()["p"] == 2


def test_partition_measures(spark):
    def part(labels):
        return spark.createDataFrame([(0, n, c) for n, c in enumerate(labels)], "g long, node long, cluster long")

    def nvi(a, b):
        return partitions.variation(partitions.contingency(part(a), part(b), ["g"]), ["g"]).first()["nvi"]

    assert nvi([0, 0, 1, 1], [0, 1, 2, 2]) == pytest.approx(0.25)
    assert nvi([0, 0, 1, 1], [0, 1, 0, 1]) == pytest.approx(1.0)
    assert nvi([0, 0, 1, 1], [5, 5, 2, 2]) == 0
    same = partitions.contingency(part([0, 0, 1, 1]), part([0, 0, 1, 1]), ["g"])
    assert partitions.mutual_information(same, ["g"]).first()["nmi"] == pytest.approx(1)
    assert partitions.jaccard_distance(same, ["g"]).first()["jaccard"] == 0
    broken = part([0, 0]).union(part([1]))
    row = partitions.integrity(broken, part([0, 0, 0]), ["g"]).first()
    assert (row["n_repeated"], row["n_missing"], row["n_unknown"]) == (1, 1, 0)


def test_change_point_pipeline(spark):
    rng = np.random.default_rng(0)
    rows = [(s, k, float(k), float(rng.normal(3.0 if k >= 15 else 0.0, 0.1))) for s in range(2) for k in range(30)]
    signal = spark.createDataFrame(rows, "sample_id long, k long, t double, value double").withColumn("window", F.lit(1.0))
    n = spark.createDataFrame([(0, 1), (1, 1)], "sample_id long, n_bkps int")
    truth = spark.createDataFrame([(0, 15.0), (1, 15.0)], "sample_id long, bkp double")
    means, best = pipelines.grid_search(signal, truth, n, ["window"], 2.0)
    assert means.first()["mean_f1"] == 1 and best.first()["window"] == 1.0
    found = detection.detect_penalized(signal, [1.0], ["sample_id"])
    assert _values(found, "sample_id", "pred") == [(0, 15.0), (1, 15.0)]
    summary = storage.penalty_summary(found, ["sample_id"]).orderBy("sample_id").first()
    assert (summary["num_change_points"], summary["change_point_indices"]) == (1, "15")
    tested = pipelines.test_evaluation(signal, best, truth, n, ["window"], 2.0)
    assert {r["f1"] for r in tested.collect()} == {1.0}


def test_signals_follow_a_structure_change(spark):
    events = generators.structure_change(spark, 1, lambda seed: 20.0, span=40.0, density=20.0, n_groups=2, per_group=5)
    snaps = intervals.snapshots(events, 2.0)
    bins = snaps.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(18).cast("long"))).alias("bin"))
    n = events.select("sample_id").distinct().withColumn("n_nodes", F.lit(10))
    packed = detection.packed_snapshots(snaps, bins, n)
    for frame in (
        detection.spectrum_signal(detection.laplacian_signatures(packed, 4), 3, detection.second_window(3, 2.0)),
        detection.procrustes_signal(packed, 3, difference=True),
        detection.cumulative_sum_signal(packed, 4),
        detection.spectral_norm_signal(packed, 4),
        detection.spectral_clustering_signal(packed, 4, 2),
    ):
        values = [r["value"] for r in frame.collect()]
        assert values and all(math.isfinite(v) for v in values)


def test_interval_clusters(spark):
    rows = [(i, j, float(t), t + 1.0) for t in range(6) for i, j in ((0, 1), (1, 2), (3, 4), (4, 5))]
    cuts = spark.createDataFrame([(0, 3)], "sample_id long, k long")
    summary, selected, parts = pipelines.interval_clusters(_events(spark, rows), cuts, [1.0], [0, 1, 2])
    assert summary.count() == 2 and selected.count() == 2
    groups = {tuple(sorted(r["n"])) for r in parts.groupBy("interval", "cluster").agg(F.collect_list("node").alias("n")).collect()}
    assert groups == {(0, 1, 2), (3, 4, 5)}


def test_cluster_matching(spark):
    s = spark.createDataFrame([(0, 0, 0, 0.1), (0, 0, 1, 0.9), (0, 1, 0, 0.8), (0, 1, 1, 0.2)], "g long, a long, b long, v double")
    assert _values(clustering.match_clusters(s, ["g"]), "a", "b") == [(0, 1), (1, 0)]


def test_storage(spark, tmp_path):
    _, packed = pipelines.prepare(generators.path(spark, 4, 1))
    cells_ = transitions.inter_transitions(packed, [1.0, 2.0])
    storage.save_transitions(cells_, f"{tmp_path}/t", as_deltas=True)
    back = storage.load_transitions(spark, f"{tmp_path}/t", 2.0, as_deltas=True)
    want = {(r["k"], r["i"], r["j"]): r["v"] for r in cells_.where("lamda = 2.0").collect()}
    got = {(r["k"], r["i"], r["j"]): r["v"] for r in back.collect()}
    assert {k: got[k] for k in want if k in got} == pytest.approx({k: v for k, v in want.items() if k in got}) and len(got) > 0
    signal = spark.createDataFrame([(0, 1.0, 2.0, "forward", 0, 0.0, 0.5)], "sample_id long, lamda double, window double, direction string, k long, t double, value double")
    storage.save_signals(signal, f"{tmp_path}/s")
    assert storage.load_signal(spark, f"{tmp_path}/s", 1.0, 2.0).count() == 1
    assert storage.load_signal(spark, f"{tmp_path}/s", 1.0, 2.0, reverse=True).count() == 0
    assert storage.signal_name(0.1, 30.0, True) == "signal_lamda_0.10000000000_window_30_rev"
    storage.save_network(f"{tmp_path}/n", events=generators.cycle(spark))
    assert storage.load_network(spark, f"{tmp_path}/n", ["events"])["events"].count() == 3
    storage.write_csv(signal, f"{tmp_path}/c")


def test_generators_repeat(spark):
    def once():
        return _values(generators.activity_changes(spark, 2, lambda s: (10.0,), (3.0, 6.0), span=20.0, per_group=5), *EVENTS.names)

    assert once() == once()
    made = generators.simulate(12, 4, np.full((3, 3), 1 / 3), 50.0, 2.0, 1.0, "within_group", seed=1)
    assert ((made["src"] // 4) == (made["dst"] // 4)).all() and (made["t_end"] <= 50).all() and len(made) > 10
    busy = made.sort_values("t_start")
    for node in range(12):
        own = busy[(busy["src"] == node) | (busy["dst"] == node)]
        assert (own["t_start"].to_numpy()[1:] >= own["t_end"].to_numpy()[:-1]).all()
    assert generators.block_of(35, [30, 30, 40]) == 1
    assert np.allclose(generators.block_probabilities(9, 3, 1, 0.8).sum(axis=1), 1)


def test_cell_algebra(spark):
    a = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 0, 0.5), (0, 1, 1, 1.0)], "g long, i long, j long, v double")
    nodes = spark.createDataFrame([(0, n) for n in range(4)], "g long, node long")
    full = cells.to_full(a, nodes, ["g"])
    assert full.count() == 5 and cells.to_compact(full, ["g"]).count() == 3
    product = {(r["i"], r["j"]): r["v"] for r in cells.compact_matmul(a, a, ["g"]).collect()}
    assert product == {(0, 0): 0.25, (0, 1): 0.75, (1, 1): 1.0}
    with pytest.raises(Exception, match="negative time"):
        cells.linear_transition(a, a, ["g"], F.lit(-1.0)).collect()


def test_array_functions(spark):
    row = spark.range(1).select(arrays.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), arrays.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), arrays.clock(F.lit(9.5)).alias("c")).first()
    assert (row["z"], row["u"], row["c"]) == ([0.0, 0.0], [0.6, 0.8], "09:30")


def test_series_of_length_one(spark):
    one = spark.createDataFrame([(0, 0, 5.0)], "sample_id long, k long, value double")
    assert series.first_difference(one, ["sample_id"]).first()["value"] == 0
    assert series.running_mean(one, 2, ["sample_id"]).count() == 0
    assert series.min_max_scaled(one, ["sample_id"]).first()["value"] == 0


def test_stream(spark, tmp_path):
    """Parquet rows drive the streaming snapshots to the end."""
    rows = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 1 as src, 2 as dst, timestamp'2024-01-01 00:12:00' as ends_at union all select timestamp'2024-01-01 00:02:00', 2, 1, timestamp'2024-01-01 00:03:00' union all select timestamp'2024-01-01 03:00:00', 1, 3, timestamp'2024-01-01 03:01:00'")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, frame in (("pairs", active.pair_snapshots(stream)), ("changes", active.net_changes(stream))):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert [(r["i"], r["j"], r["contacts"]) for r in spark.table("pairs").collect()] == [(1, 2, 2)]
    assert spark.table("changes").count() >= 1


@pytest.mark.parametrize("name", ["linear_transition", "stationary_transition", "component_exponentials"])
def test_matrices_of_snapshots_read_kept_ones(spark, name):
    """Their parts are united task by task, and each part read all contacts anew."""
    from chronoloom import catalog

    files = catalog.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "events.parquet" in f]


def test_best_parameters_are_kept_before_they_are_joined(spark, monkeypatch):
    """The search that found them is no part of the plan over other samples."""
    kept, keys = [], ["lamda", "window"]
    monkeypatch.setattr(pipelines, "_kept", lambda frame: kept.append(frame.columns) or frame.localCheckpoint())
    signals = spark.createDataFrame([(1, 1.0, 2.0, k, float(k), float(k >= 6)) for k in range(12)], "sample_id long, lamda double, window double, k long, t double, value double")
    best = spark.createDataFrame([(1.0, 2.0, 0.5)], "lamda double, window double, mean_f1 double")
    truth, n = spark.createDataFrame([(1, 6.0)], "sample_id long, bkp double"), spark.createDataFrame([(1, 1)], "sample_id long, n_bkps int")
    rows = pipelines.test_evaluation(signals, best, truth, n, keys, 0.5).collect()
    assert kept[0] == keys and [(r["n_true"], r["n_found"], r["tp"]) for r in rows] == [(1, 1, 1)]


def test_cells_of_a_flow_integral_are_all_there(spark):
    """A node alone: its only cell is exactly 0, and is a cell all the same."""
    none = "array<bigint>"
    packed = spark.createDataFrame([(0, 1, k, float(k), 1.0, [], []) for k in range(4)], f"sample_id long, n_nodes long, k long, t double, tau double, ii {none}, jj {none}")
    ranges = spark.createDataFrame([(0, 1, 0, 4)], "sample_id long, interval long, start long, stop long")
    got = clustering.interval_autocovariance(packed, ranges, [1.0]).collect()
    assert [(r["i"], r["j"], r["v"]) for r in got] == [(0, 0, 0.0)]
