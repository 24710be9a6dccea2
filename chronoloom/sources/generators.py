"""Synthetic networks: event processes, block models, motifs, paths, cycles and an agent simulation.

Draws are seeded numpy on rows of a parameter table, one task a sample, so a dataset of any
number of samples is made in parallel and again the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENTS

_KIND = "sample_id long, event_id long, src long, dst long, t_start double, t_end double"


def event_process(density: float, inter_tau: float, start: float, end: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (sorted, uniform) and ends of a Poisson number of events of exponential length.

    One seed serves all three draws.
    """
    count = np.random.default_rng(seed).poisson(density * (end - start))
    starts = np.sort(np.random.default_rng(seed).uniform(start, end, count))
    return starts, starts + np.random.default_rng(seed).exponential(inter_tau, count)


def block_probabilities(n_groups: int, n_communities: int, power: int, within: float) -> np.ndarray:
    """Group-to-group contact probabilities: n_communities ** power communities of equal size.

    Power 0 is one community.  A row sums to 1; ``within`` of it stays in the community.
    """
    communities = n_communities**power
    if n_groups % communities:
        raise ValueError("communities must divide the groups")
    of = np.arange(n_groups) // (n_groups // communities)
    same = of[:, None] == of[None, :]
    if communities == 1:
        return np.full((n_groups, n_groups), 1 / n_groups)
    return np.where(same, within / same.sum(axis=1, keepdims=True), (1 - within) / (~same).sum(axis=1, keepdims=True))


def block_contacts(starts: np.ndarray, ends: np.ndarray, stages: Sequence[tuple[float, np.ndarray]], per_group: int, seed: int) -> pd.DataFrame:
    """Sources at random, targets by the block matrix of the stage (its end time, matrix) of the event."""
    rng = np.random.default_rng(seed)
    n_groups = len(stages[0][1])
    src = rng.integers(0, n_groups * per_group, len(starts))
    stage = np.minimum(np.searchsorted([s[0] for s in stages], starts, side="right"), len(stages) - 1)
    cumulative = np.stack([np.cumsum(s[1], axis=1) for s in stages])
    draw = rng.random(len(starts))
    group = (draw[:, None] > cumulative[stage, src // per_group]).sum(axis=1)
    group = np.minimum(group, n_groups - 1)
    dst = group * per_group + rng.integers(0, per_group, len(starts))
    again = dst == src  # nobody meets themselves: the next one of the group
    dst = np.where(again, group * per_group + (dst + 1 - group * per_group) % per_group, dst)
    keep = dst != src
    return pd.DataFrame({"event_id": np.arange(len(starts))[keep], "src": src[keep], "dst": dst[keep], "t_start": starts[keep], "t_end": ends[keep]})


def samples(spark: SparkSession, parameters: Sequence[tuple[int, int]], make: Callable[[int], pd.DataFrame]) -> DataFrame:
    """Events of (sample_id, seed) rows, each made by ``make(seed)`` in its own task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = make(int(group["seed"].iloc[0]))
        out["sample_id"] = int(group["sample_id"].iloc[0])
        return out[EVENTS.names]

    return spark.createDataFrame(list(parameters), "sample_id long, seed long").groupBy("sample_id").applyInPandas(run, _KIND)


def structure_change(spark: SparkSession, n: int, split: Callable[[int], float], seed: int = 34, span: float = 200.0, density: float = 100.0, inter_tau: float = 2.0, n_groups: int = 2, per_group: int = 50) -> DataFrame:
    """Constant activity; two communities merge at split(sample)."""

    def make(s: int) -> pd.DataFrame:
        starts, ends = event_process(density, inter_tau, 0.0, span, s)
        stages = [(split(s), block_probabilities(n_groups, n_groups, 1, 0.9)), (span, block_probabilities(n_groups, n_groups, 0, 1.0))]
        return block_contacts(starts, ends, stages, per_group, s + 1)

    return samples(spark, [(i, seed + i) for i in range(n)], make)


def activity_changes(spark: SparkSession, n: int, breakpoints: Callable[[int], Sequence[float]], densities: Sequence[float] = (100.0, 150.0), seed: int = 34, span: float = 200.0, inter_tau: float = 2.0, n_groups: int = 2, per_group: int = 50) -> DataFrame:
    """Activity alternates between densities at the breakpoints of each sample (one or several)."""

    def make(s: int) -> pd.DataFrame:
        cuts = [0.0, *breakpoints(s), span]
        parts = [event_process(densities[i % len(densities)], inter_tau, a, b, s + 1000 * i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        return block_contacts(starts, ends, [(span, block_probabilities(n_groups, n_groups, 1, 0.9))], per_group, s + 1)

    return samples(spark, [(i, seed + i) for i in range(n)], make)


# fixed values: powers of the number of communities in three phases
MOTIFS = {"merge_merge": (2, 1, 0), "merge_split": (1, 0, 1), "split_merge": (0, 1, 0)}


def motif(spark: SparkSession, name: str, seed: int = 34, span: float = 300.0, density: float = 20.0, inter_tau: float = 5.0, per_group: int = 25) -> DataFrame:
    """100 nodes in four groups whose communities merge or split after each third of the time."""
    phases = MOTIFS[name]

    def make(s: int) -> pd.DataFrame:
        starts, ends = event_process(density, inter_tau, 0.0, span, s)
        stages = [(span * (i + 1) / 3, block_probabilities(4, 2, p, 0.95)) for i, p in enumerate(phases)]
        return block_contacts(starts, ends, stages, per_group, s + 1)

    return samples(spark, [(0, seed)], make)


def first_complete(spark: SparkSession, seeds: Sequence[int], make: Callable[[int], pd.DataFrame], n_nodes: int) -> int:
    """The first seed whose network has all its nodes."""
    made = samples(spark, [(s, s) for s in seeds], make)
    ends = made.select("sample_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("sample_id").agg(F.countDistinct("node").alias("n"))
    row = ends.where(F.col("n") == n_nodes).agg(F.min("sample_id")).first()
    if row[0] is None:
        raise ValueError("no seed gives a complete network")
    return int(row[0])


def path(spark: SparkSession, n: int = 4, overlap: int = 0, time_unit: float = 1.0, total_span: float | None = None, start: float = 0.0) -> DataFrame:
    """A path of n nodes: edge j lasts [j, j + 1); the first overlap + 1 edges share [0, overlap + 1)."""
    if n < 2 or not 0 <= overlap <= n - 2:
        raise ValueError("a path needs two nodes and an overlap from 0 to n - 2")
    unit = total_span / (n - 1) if total_span is not None else time_unit
    j = F.col("id")
    early = j <= overlap if overlap else F.lit(False)
    t0, t1 = F.when(early, 0.0).otherwise(j.cast("double")), F.when(early, float(overlap + 1)).otherwise(j + 1.0)
    return spark.range(n - 1).select(F.lit(0).cast("long").alias("sample_id"), j.alias("event_id"), j.alias("src"), (j + 1).alias("dst"), (start + t0 * unit).alias("t_start"), (start + t1 * unit).alias("t_end"))


def cycle(spark: SparkSession, n: int = 3) -> DataFrame:
    """Edges of a cycle, one after another on unit intervals."""
    j = F.col("id")
    return spark.range(n).select(F.lit(0).cast("long").alias("sample_id"), j.alias("event_id"), j.alias("src"), F.pmod(j + 1, F.lit(n)).alias("dst"), j.cast("double").alias("t_start"), (j + 1.0).alias("t_end"))


def block_graph(spark: SparkSession, sizes: Sequence[int], within: float, between: float, seed: int = 0) -> DataFrame:
    """Static block-model edges (i, j), i < j, drawn by a seeded hash of the pair.

    Every node explodes its own later partners, so no product of tables is planned.
    """
    n = sum(sizes)
    bounds = np.cumsum(sizes)[:-1].tolist()

    def of(node: str):
        return sum(((F.col(node) >= b).cast("int") for b in bounds), F.lit(0))

    pairs = spark.range(n - 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("j"))
    draw = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return pairs.where(draw < F.when(of("i") == of("j"), within).otherwise(between))


def block_of(node: int, sizes: Sequence[int]) -> int:
    return int(np.searchsorted(np.cumsum(sizes), node, side="right"))


def simulate(n: int, per_group: int, probabilities: np.ndarray, until: float, mean_pause: float, mean_contact: float, policy: str = "block", seed: int = 0, tempo: Callable[[float], float] = lambda t: 1.0, mixing: Callable[[float], np.ndarray] | None = None) -> pd.DataFrame:
    """Agents that pause, pick a free partner and stay in contact: an event queue.

    tempo scales pauses and contacts by the time they begin; mixing replaces ``probabilities`` by
    a matrix of the time.

    policy: uniform, within_group, or block (a partner's group by ``probabilities``).  Only
    contacts that end by ``until`` are told.
    """
    rng = np.random.default_rng(seed)
    free = np.ones(n, dtype=bool)
    group = np.arange(n) // per_group
    queue = [(float(t), i, -1) for i, t in enumerate(rng.exponential(mean_pause, n))]
    heapq.heapify(queue)
    began: dict[tuple[int, int], float] = {}
    rows = []
    while queue:
        t, a, b = heapq.heappop(queue)
        if t > until:
            break
        if b >= 0:
            rows.append((a, b, began.pop((a, b)), t))
            free[[a, b]] = True
            for x in (a, b):
                heapq.heappush(queue, (t + rng.exponential(mean_pause * tempo(t)), x, -1))
            continue
        if not free[a]:
            continue
        weight = free.astype(float)
        weight[a] = 0.0
        if policy == "within_group":
            weight *= group == group[a]
        elif policy == "block":
            weight *= (probabilities if mixing is None else mixing(t))[group[a], group]
        if weight.sum() == 0:
            heapq.heappush(queue, (t + rng.exponential(mean_pause * tempo(t)), a, -1))
            continue
        b = int(rng.choice(n, p=weight / weight.sum()))
        free[[a, b]] = False
        began[(a, b)] = t
        heapq.heappush(queue, (t + rng.exponential(mean_contact * tempo(t)), a, b))
    out = pd.DataFrame(rows, columns=["src", "dst", "t_start", "t_end"]).sort_values(["t_start", "t_end"], ignore_index=True)
    out.insert(0, "event_id", np.arange(len(out)))
    return out


def block_features(spark: SparkSession, sizes: Sequence[int], means: Sequence[float], std: float = 1.0, seed: int = 0) -> DataFrame:
    """(node, block, x): a normal attribute around the mean of the node's block."""
    bounds = np.cumsum(sizes)[:-1].tolist()
    block = sum(((F.col("id") >= b).cast("int") for b in bounds), F.lit(0))
    table = spark.range(sum(sizes)).select(F.col("id").alias("node"), block.alias("block"))
    mean = F.element_at(F.array(*[F.lit(float(m)) for m in means]), F.col("block") + 1)
    # two seeded draws of 48 bits give a normal one
    draw = lambda s: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(s)), "node").cast("binary")), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    return table.withColumn("x", mean + std * F.sqrt(-2 * F.ln(draw(2 * seed))) * F.cos(2 * np.pi * draw(2 * seed + 1)))


def simulated(spark: SparkSession, samples_: int, n: int, per_group: int, seed: int = 0, within: float = 0.9, **options) -> DataFrame:
    """``simulate`` for many samples, each in a task of its own, as events."""
    probabilities = block_probabilities(n // per_group, n // per_group, 1, within)
    return samples(spark, [(i, seed + i) for i in range(samples_)], lambda s: simulate(n, per_group, probabilities, seed=s, **options))
