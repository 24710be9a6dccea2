"""Named queries over the provided tables, with equivalent SQL where SQL can tell them.

The temporal network is ``contacts`` (one sample a day, see sources.events); matrices are the
days' contact times; partitions and flows come from customers; scores from the largest events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel_sql as K
from .functions import arrays
from .operators import cells, clustering, detection, graph, intervals, lowrank, partitions, scores, series, transitions
from .plans import pipelines, windows
from .sources import events as ev
from .sources import generators, storage

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

DAY = ["sample_id"]
HALF_HOUR, HOUR = 1800.0, 3600.0
RATES = (1e-4, 1e-3)

# ---- shared SQL ---------------------------------------------------------------------------
_CTES = {
    "contacts": ev.CONTACTS_SQL.strip(),
    "islands": """islands AS (
  SELECT *, sum(CASE WHEN before IS NULL OR t_start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, lo, hi ORDER BY t_start, t_end, event_id) AS island
  FROM (SELECT *, least(src, dst) AS lo, greatest(src, dst) AS hi,
          max(t_end) OVER (PARTITION BY sample_id, least(src, dst), greatest(src, dst) ORDER BY t_start, t_end, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM contacts))""",
    "merged": """merged AS (
  SELECT sample_id, first(event_id ORDER BY t_start, t_end, event_id) AS event_id, first(src ORDER BY t_start, t_end, event_id) AS src,
         first(dst ORDER BY t_start, t_end, event_id) AS dst, min(t_start) AS t_start, max(t_end) AS t_end
  FROM islands GROUP BY sample_id, lo, hi, island)""",
    "grid": """grid AS (
  SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY t) - 1 AS k, t, lead(t) OVER (PARTITION BY sample_id ORDER BY t) - t AS tau
  FROM (SELECT DISTINCT sample_id, t FROM (SELECT sample_id, t_start AS t FROM merged UNION ALL SELECT sample_id, t_end FROM merged)))""",
    "spans": "spans AS (SELECT sample_id, min(t) AS t_first, max(t) AS t_last, max(k) AS n_intervals FROM grid GROUP BY sample_id)",
    "edges": """edges AS (
  SELECT DISTINCT g.sample_id, g.k, least(src, dst) AS i, greatest(src, dst) AS j
  FROM grid g JOIN merged e ON e.sample_id = g.sample_id AND e.t_start <= g.t AND e.t_end > g.t WHERE src <> dst AND g.tau IS NOT NULL)""",
    "nodes": "nodes AS (SELECT DISTINCT sample_id, node FROM (SELECT sample_id, src AS node FROM contacts UNION ALL SELECT sample_id, dst FROM contacts))",
    "n_nodes": "n_nodes AS (SELECT sample_id, count(*) AS n_nodes FROM nodes GROUP BY sample_id)",
    "adj": """adj AS (
  SELECT sample_id, i, j, sum(v) AS v FROM (
    SELECT sample_id, src AS i, dst AS j, t_end - t_start AS v FROM contacts UNION ALL SELECT sample_id, dst, src, t_end - t_start FROM contacts) GROUP BY sample_id, i, j)""",
    "walk": "walk AS (SELECT sample_id, i, j, v / sum(v) OVER (PARTITION BY sample_id, i) AS v FROM adj)",
    "snaps": """snaps AS (
  SELECT DISTINCT sample_id, b AS bin, least(src, dst) AS i, greatest(src, dst) AS j
  FROM (SELECT *, max(t_end) OVER (PARTITION BY sample_id) AS last FROM contacts) c, range(0, 1000) r(b)
  WHERE src <> dst AND b < ceil(floor(last - 1800) / 1800) AND t_start < (b + 1) * 1800 AND t_end > b * 1800)""",
    "bins": "bins AS (SELECT sample_id, unnest(range(0, (ceil(floor(max(t_end) - 1800) / 1800))::BIGINT)) AS bin FROM contacts GROUP BY sample_id)",
    "activity": "activity AS (SELECT sample_id, t, sum(d) OVER (PARTITION BY sample_id ORDER BY t) AS active FROM (SELECT sample_id, t, sum(d) AS d FROM (SELECT sample_id, t_start AS t, 1 AS d FROM contacts UNION ALL SELECT sample_id, t_end, -1 FROM contacts) GROUP BY sample_id, t HAVING sum(d) <> 0))",
    "halfhours": "halfhours AS (SELECT sample_id, (floor(t_start / 1800))::BIGINT AS k, avg(t_end - t_start) AS value FROM contacts GROUP BY 1, 2)",
    "marks": """marks AS (
  SELECT sample_id, kind, t, row_number() OVER (PARTITION BY sample_id, kind ORDER BY value DESC, event_id) AS place
  FROM (SELECT epoch_us(ts) // 86400000000 AS sample_id, event_type AS kind, (epoch_us(ts) % 86400000000) / 1e6 AS t, value, event_id FROM events))""",
    "truth": "truth AS (SELECT sample_id, t AS bkp FROM marks WHERE kind = 'purchase' AND place <= 3)",
    "found": "found AS (SELECT sample_id, n AS param, t AS pred FROM marks, (VALUES (1), (2), (3), (4)) p(n) WHERE kind = 'signup' AND place <= n)",
    "runs": "runs AS (SELECT DISTINCT sample_id, n AS param FROM marks, (VALUES (1), (2), (3), (4)) p(n))",
    "evaluated": """evaluated AS (
  SELECT param, sample_id, n_true, n_found, tp, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, hausdorff FROM (
    SELECT r.param, r.sample_id, coalesce(n_true, 0) AS n_true, coalesce(n_found, 0) AS n_found, coalesce(tp, 0) AS tp,
      CASE WHEN coalesce(n_found, 0) > 0 THEN coalesce(tp, 0) / n_found ELSE 0 END AS p, CASE WHEN coalesce(n_true, 0) > 0 THEN coalesce(tp, 0) / n_true ELSE 0 END AS r,
      CASE WHEN n_true IS NULL AND n_found IS NULL THEN 0 WHEN n_true IS NULL OR n_found IS NULL THEN 'inf'::DOUBLE ELSE greatest(a, b) END AS hausdorff
    FROM runs r
    LEFT JOIN (SELECT param, sample_id, count(*) AS n_true, count(*) FILTER (WHERE d < 1800) AS tp, max(d) AS a FROM (
        SELECT r.param, r.sample_id, t.bkp, min(abs(t.bkp - f.pred)) AS d FROM runs r JOIN truth t USING (sample_id) LEFT JOIN found f ON f.sample_id = r.sample_id AND f.param = r.param GROUP BY 1, 2, 3) GROUP BY 1, 2) x USING (param, sample_id)
    LEFT JOIN (SELECT param, sample_id, count(*) AS n_found, max(d) AS b FROM (
        SELECT f.param, f.sample_id, f.pred, min(abs(t.bkp - f.pred)) AS d FROM found f LEFT JOIN truth t ON t.sample_id = f.sample_id GROUP BY 1, 2, 3) GROUP BY 1, 2) y USING (param, sample_id)))""",
    "means": "means AS (SELECT param, avg(f1) AS mean_f1, avg(hausdorff) AS mean_hausdorff FROM evaluated GROUP BY param)",
    "parts": """parts AS (
  SELECT c_custkey AS node, c_nationkey AS a, (dense_rank() OVER (ORDER BY c_mktsegment) - 1) AS b FROM customer)""",
    "tab": "tab AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS total FROM (SELECT a, b, count(*) AS n FROM parts GROUP BY a, b))",
    "many": "many AS (SELECT run, c_custkey AS node, (c_custkey * (run + 1) + c_nationkey) % 5 AS cluster FROM customer, (VALUES (0), (1), (2), (3)) r(run))",
    "flow": """flow AS (
  SELECT a.run AS level, a.cluster AS source, b.cluster AS target, r_name AS type, count(*) AS value
  FROM many a JOIN many b ON a.node = b.node AND b.run = a.run + 1 JOIN customer ON c_custkey = a.node JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)""",
}
_NEEDS = {
    "islands": ["contacts"], "merged": ["islands"], "grid": ["merged"], "spans": ["grid"], "edges": ["grid"], "nodes": ["contacts"], "n_nodes": ["nodes"], "adj": ["contacts"], "walk": ["adj"], "snaps": ["contacts"], "bins": ["contacts"],
    "activity": ["contacts"], "halfhours": ["contacts"], "truth": ["marks"], "found": ["marks"], "runs": ["marks"], "evaluated": ["truth", "found", "runs"], "means": ["evaluated"], "tab": ["parts"], "flow": ["many"],
}


def _with(names: str, body: str, recursive: bool = False) -> str:
    found: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in found:
            found.append(name)

    for name in names.split():
        need(name)
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(_CTES[n] for n in found) + "\n" + body


def _query(name: str, needs: str = "", sql: str | None = None, recursive: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = _with(needs, sql, recursive) if needs else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- inputs ---------------------------------------------------------------------------------
def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _merged(s, d) -> DataFrame:
    return intervals.merge_overlaps(ev.contacts(s, d))


def _grid(s, d) -> DataFrame:
    return intervals.time_grid(_merged(s, d))


def _adj(s, d) -> DataFrame:
    return graph.static_adjacency(ev.contacts(s, d))


def _walk(s, d) -> DataFrame:
    return graph.random_walk_matrix(_adj(s, d), DAY)


def _edges(s, d) -> DataFrame:
    return intervals.interval_edges(_merged(s, d), merged=True)


def _snaps(s, d) -> DataFrame:
    return intervals.snapshots(ev.contacts(s, d), HALF_HOUR)


def _kept_snaps(s, d) -> DataFrame:
    """Snapshots for matrices that ask for them many times: contacts, which are far more, are read and sorted once."""
    return storage.kept(_snaps(s, d))


def _bins(s, d) -> DataFrame:
    last = ev.contacts(s, d).groupBy("sample_id").agg(F.max("t_end").alias("m"))
    n = F.ceil(F.floor(F.col("m") - HALF_HOUR) / HALF_HOUR).cast("long")
    return last.select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))


def _packed_snaps(s, d) -> DataFrame:
    return detection.packed_snapshots(_snaps(s, d), _bins(s, d), _all_cohorts(s, d))


def _all_cohorts(s, d) -> DataFrame:
    """Every sample has the same 20 possible nodes."""
    return ev.contacts(s, d).select("sample_id").distinct().withColumn("n_nodes", F.lit(20))


def _packed(s, d) -> tuple[DataFrame, DataFrame]:
    merged = _merged(s, d)
    grid = intervals.time_grid(merged)
    return grid, transitions.packed(intervals.interval_edges(merged, merged=True), grid, _all_cohorts(s, d))


def _halfhours(s, d) -> DataFrame:
    return ev.contacts(s, d).groupBy("sample_id", F.floor(F.col("t_start") / HALF_HOUR).cast("long").alias("k")).agg(F.avg(F.col("t_end") - F.col("t_start")).alias("value"))


def _marks(s, d) -> DataFrame:
    day, seconds = ev.day_and_seconds("ts")
    table = _table(s, d, "events").select(day.alias("sample_id"), F.col("event_type").alias("kind"), seconds.alias("t"), "value", "event_id")
    return table.withColumn("place", F.row_number().over(Window.partitionBy("sample_id", "kind").orderBy(F.desc("value"), "event_id")))


def _scored(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    marks = _marks(s, d)
    n = F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 4)])).alias("param")
    truth = marks.where("kind = 'purchase' and place <= 3").select("sample_id", F.col("t").alias("bkp"))
    found = marks.where("kind = 'signup'").select("*", n).where("place <= param").select("param", "sample_id", F.col("t").alias("pred"))
    return marks.select("sample_id").distinct().select("sample_id", n), truth, found


def _evaluated(s, d) -> DataFrame:
    runs, truth, found = _scored(s, d)
    return scores.evaluate(runs, truth, found, ["param"], HALF_HOUR)


def _parts(s, d) -> tuple[DataFrame, DataFrame]:
    c = _table(s, d, "customer").withColumn("g", F.lit(0))
    segments = c.select("c_mktsegment").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("long"))  # a few segments
    a = c.select("g", F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("cluster"))
    return a, c.join(segments, "c_mktsegment").select("g", F.col("c_custkey").alias("node"), "cluster")


def _many(s, d) -> DataFrame:
    c = _table(s, d, "customer").select(F.lit(0).alias("g"), F.col("c_custkey").alias("node"), "c_nationkey", F.explode(F.array(*[F.lit(x) for x in range(4)])).alias("run"))
    return c.select("g", "run", "node", F.pmod(F.col("node") * (F.col("run") + 1) + F.col("c_nationkey"), F.lit(5)).cast("long").alias("cluster"))


def _flow(s, d) -> DataFrame:
    many = _many(s, d)
    named = _table(s, d, "customer").join(_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    classes = named.select(F.col("c_custkey").alias("node"), F.col("r_name").alias("type"))
    a, b = many.select(F.col("run").alias("level"), "node", "cluster"), many.select((F.col("run") - 1).alias("level"), "node", "cluster")
    return partitions.flows(a, b, classes, ["level"])


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# ---- events and intervals -------------------------------------------------------------------
@_query("contacts", "contacts", "SELECT sample_id, event_id, src, dst, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM contacts")
def contacts(s, d):
    return ev.contacts(s, d).select("sample_id", "event_id", "src", "dst", _r("t_start"), _r("t_end"))


@_query("node_dictionary", "nodes", "SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY node * 7 + 3) - 1 AS node, node * 7 + 3 AS label FROM nodes")
def node_dictionary(s, d):
    labelled = ev.contacts(s, d).withColumns({"src": F.col("src") * 7 + 3, "dst": F.col("dst") * 7 + 3})
    return ev.relabel(labelled)[1]


@_query("invalid_events", "contacts", "SELECT sample_id, event_id FROM contacts WHERE src IS NULL OR dst IS NULL OR t_start IS NULL OR t_end IS NULL OR t_end < t_start")
def invalid_events(s, d):
    return ev.invalid(ev.contacts(s, d)).select("sample_id", "event_id")


@_query("durations", "contacts", "SELECT sample_id, event_id, round(t_end - t_start, 6) AS duration FROM contacts")
def durations(s, d):
    return ev.with_durations(ev.contacts(s, d)).select("sample_id", "event_id", _r("duration"))


@_query("merge_overlaps", "merged", "SELECT sample_id, event_id, src, dst, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM merged")
def merge_overlaps(s, d):
    return _merged(s, d).select("sample_id", "event_id", "src", "dst", _r("t_start"), _r("t_end"))


@_query("active_count", "activity", "SELECT sample_id, round(t, 6) AS t, active::BIGINT AS active FROM activity")
def active_count(s, d):
    return intervals.active_count(ev.contacts(s, d)).select("sample_id", _r("t"), "active")


@_query("trim_clip", "contacts", """SELECT sample_id, event_id, round(a - z, 6) AS t_start, round(b - z, 6) AS t_end FROM (
  SELECT *, min(a) OVER (PARTITION BY sample_id) AS z FROM (SELECT sample_id, event_id, greatest(t_start, 21600.0) AS a, least(t_end, 64800.0) AS b FROM contacts WHERE t_end > 21600 AND t_start < 64800))""")
def trim_clip(s, d):
    return intervals.trim(ev.contacts(s, d), 21600.0, 64800.0).select("sample_id", "event_id", _r("t_start"), _r("t_end"))


@_query("event_edges", "contacts", "SELECT sample_id, event_id, round(t_start, 6) AS t, true AS is_start FROM contacts UNION ALL SELECT sample_id, event_id, round(t_end, 6), false FROM contacts")
def event_edges(s, d):
    return intervals.event_edges(ev.contacts(s, d)).select("sample_id", "event_id", _r("t"), "is_start")


@_query("time_grid", "grid", "SELECT sample_id, k, round(t, 6) AS t, round(tau, 6) AS tau FROM grid")
def time_grid(s, d):
    return _grid(s, d).select("sample_id", "k", _r("t"), _r("tau"))


@_query("default_rate", "grid", "SELECT sample_id, round(1 / median(tau), 6) AS lamda FROM grid GROUP BY sample_id")
def default_rate(s, d):
    return intervals.default_rate(_grid(s, d)).select("sample_id", _r("lamda"))


@_query("until_grid_index", "grid", "SELECT e.sample_id, e.event_id FROM merged e JOIN grid g ON g.sample_id = e.sample_id AND g.k = 100 WHERE e.t_end <= g.t")
def until_grid_index(s, d):
    merged = _merged(s, d)
    return ev.until_grid_index(merged, intervals.time_grid(merged), 100).select("sample_id", "event_id")


@_query("as_of_time", "grid", """SELECT q.sample_id, q.at, coalesce(max(g.k) FILTER (WHERE g.t <= q.at), min(g.k)) AS k, round(coalesce(max(g.t) FILTER (WHERE g.t <= q.at), min(g.t)), 6) AS t
FROM (SELECT sample_id, h * 3600.0 AS at FROM (SELECT DISTINCT sample_id FROM grid), range(0, 24) r(h)) q JOIN grid g ON g.sample_id = q.sample_id GROUP BY q.sample_id, q.at""")
def as_of_time(s, d):
    grid = _grid(s, d)
    hours = grid.select("sample_id").distinct().select("sample_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: h * 3600.0)).alias("at"))
    return intervals.as_of(grid, hours).select("sample_id", "at", "k", _r("t"))


@_query("interval_edges", "edges", "SELECT * FROM edges")
def interval_edges(s, d):
    return _edges(s, d)


@_query("window_adjacency", "contacts", """SELECT sample_id, w, i, j, round(sum(v), 6) AS v FROM (
  SELECT sample_id, w, unnest([src, dst]) AS i, unnest([dst, src]) AS j, least(t_end, (w + 1) * 3600) - greatest(t_start, w * 3600) AS v
  FROM contacts, range(0, 24) r(w) WHERE t_start < (w + 1) * 3600 AND t_end > w * 3600) GROUP BY ALL""")
def window_adjacency(s, d):
    contacts_ = ev.contacts(s, d)
    hours = contacts_.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("w"))
    hours = hours.withColumns({"w_start": F.col("w") * HOUR, "w_end": (F.col("w") + 1) * HOUR})
    return graph.adjacency_of_windows(intervals.range_join(contacts_, hours, HOUR), ["sample_id", "w"]).select("sample_id", "w", "i", "j", _r("v"))


@_query("snapshots", "snaps", "SELECT * FROM snaps")
def snapshots(s, d):
    return _snaps(s, d)


@_query("breakpoint_bins", "truth bins", "SELECT DISTINCT sample_id, (floor(bkp / 1800))::BIGINT AS bin FROM truth JOIN (SELECT sample_id, count(*) AS n FROM bins GROUP BY 1) USING (sample_id) WHERE floor(bkp / 1800) > 0 AND floor(bkp / 1800) < n")
def breakpoint_bins(s, d):
    n = _bins(s, d).groupBy("sample_id").agg(F.count("*").alias("n_bins"))
    return intervals.breakpoint_bins(_scored(s, d)[1].join(n, "sample_id"), HALF_HOUR)


@_query("breakpoint_bins_odd", "truth bins", "SELECT sample_id, (floor(bkp / 14400))::BIGINT AS bin FROM truth JOIN (SELECT sample_id, count(*) AS n FROM bins GROUP BY 1) USING (sample_id) WHERE floor(bkp / 14400) > 0 AND floor(bkp / 14400) < n GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def breakpoint_bins_odd(s, d):
    n = _bins(s, d).groupBy("sample_id").agg(F.count("*").alias("n_bins"))
    return intervals.breakpoint_bins(_scored(s, d)[1].join(n, "sample_id"), 14400.0, odd_only=True)


# ---- window plans ---------------------------------------------------------------------------
_CENTERED = """SELECT g.sample_id, g.k, g.t, min(h.k) AS l, least(max(h.k), n_intervals - 1) AS r
FROM grid g JOIN spans USING (sample_id) JOIN grid h ON h.sample_id = g.sample_id AND h.t BETWEEN g.t - 900 AND g.t + 900
WHERE g.t >= t_first + 900 AND g.t <= t_last - 900 GROUP BY g.sample_id, g.k, g.t, n_intervals"""


@_query("plan_centered", "spans", f"SELECT sample_id, k, round(t, 6) AS t, l AS \"left\", r AS \"right\" FROM ({_CENTERED})")
def plan_centered(s, d):
    return windows.centered(_grid(s, d), HALF_HOUR).select("sample_id", "k", _r("t"), "left", "right")


@_query("plan_sampled", "spans", f"""SELECT DISTINCT q.sample_id, arg_min(p.k, p.t) AS k FROM (
  SELECT sample_id, n, CASE WHEN n > 0 AND n = m - 1 THEN b ELSE a + n * CASE WHEN m > 1 THEN (b - a) / (m - 1) ELSE 0 END END AS target
  FROM (SELECT sample_id, min(t) AS a, max(t) AS b, greatest(1, ceil(0.1 * count(*)))::BIGINT AS m FROM ({_CENTERED}) GROUP BY sample_id), range(0, 100000) z(n) WHERE n < m) q
JOIN ({_CENTERED}) p ON p.sample_id = q.sample_id AND p.t >= q.target GROUP BY q.sample_id, q.n""")
def plan_sampled(s, d):
    return windows.sampled(windows.centered(_grid(s, d), HALF_HOUR), 0.1).select("sample_id", "k")


@_query("plan_forward", "spans", """SELECT g.sample_id, g.k, g.k AS "left", least(max(h.k), n_intervals - 1) AS "right" FROM grid g JOIN spans USING (sample_id)
JOIN grid h ON h.sample_id = g.sample_id AND h.t BETWEEN g.t AND g.t + 1800 WHERE g.t < t_last - 1800 GROUP BY g.sample_id, g.k, n_intervals""")
def plan_forward(s, d):
    return windows.forward(_grid(s, d), HALF_HOUR).select("sample_id", "k", "left", "right")


@_query("plan_backward", "spans", """SELECT g.sample_id, g.k, min(h.k) AS "left", least(g.k, n_intervals - 1) AS "right" FROM grid g JOIN spans USING (sample_id)
JOIN grid h ON h.sample_id = g.sample_id AND h.t BETWEEN g.t - 1800 AND g.t WHERE g.t >= t_first + 1800 GROUP BY g.sample_id, g.k, n_intervals""")
def plan_backward(s, d):
    return windows.backward(_grid(s, d), HALF_HOUR).select("sample_id", "k", "left", "right")


@_query("bound_windows", "spans", "SELECT sample_id, k, round(t, 6) AS w_start, round(t + 1800, 6) AS w_end, round(t + 900, 6) AS t_center FROM grid JOIN spans USING (sample_id) WHERE t < t_last - 1800")
def bound_windows(s, d):
    return windows.bound_windows(_grid(s, d), HALF_HOUR).select("sample_id", "k", _r("w_start"), _r("w_end"), _r("t_center"))


@_query("too_sparse_plans", "spans", f"SELECT sample_id, count(*) AS n_windows, 400 AS n_bkps FROM ({_CENTERED}) GROUP BY sample_id HAVING count(*) <= 400")
def too_sparse_plans(s, d):
    grid = _grid(s, d)
    return windows.too_sparse(windows.centered(grid, HALF_HOUR), grid.select("sample_id").distinct().withColumn("n_bkps", F.lit(400)))


# ---- graphs ---------------------------------------------------------------------------------
@_query("static_adjacency", "adj", "SELECT sample_id, i, j, round(v, 6) AS v FROM adj")
def static_adjacency(s, d):
    return _adj(s, d).select("sample_id", "i", "j", _r("v"))


@_query("degrees", "edges", "SELECT sample_id, k, i, count(*)::DOUBLE AS degree FROM (SELECT sample_id, k, i FROM edges UNION ALL SELECT sample_id, k, j FROM edges) GROUP BY ALL")
def degrees(s, d):
    key = ["sample_id", "k"]
    return graph.degrees(graph.both_ways(_edges(s, d), key), key)


_BOTH = "(SELECT sample_id, k, i, j FROM edges UNION ALL SELECT sample_id, k, j, i FROM edges)"


@_query("laplacian_combinatorial", "edges", f"SELECT sample_id, k, i, j, -1.0::DOUBLE AS v FROM {_BOTH} UNION ALL SELECT sample_id, k, i, i, count(*)::DOUBLE FROM {_BOTH} GROUP BY sample_id, k, i")
def laplacian_combinatorial(s, d):
    key = ["sample_id", "k"]
    return graph.laplacian(graph.both_ways(_edges(s, d), key), key)


@_query("laplacian_random_walk", "edges", f"SELECT sample_id, k, i, j, round(-1.0 / count(*) OVER (PARTITION BY sample_id, k, i), 6) AS v FROM {_BOTH} UNION ALL SELECT DISTINCT sample_id, k, i, i, 1.0::DOUBLE FROM {_BOTH}")
def laplacian_random_walk(s, d):
    key = ["sample_id", "k"]
    return graph.random_walk_laplacian(graph.both_ways(_edges(s, d), key), key).select(*key, "i", "j", _r("v"))


@_query("laplacian_normalized", "adj", """SELECT a.sample_id, a.i, a.j, round(-a.v / sqrt(x.d * y.d), 6) AS v FROM adj a
JOIN (SELECT sample_id, i, sum(v) AS d FROM adj GROUP BY 1, 2) x ON x.sample_id = a.sample_id AND x.i = a.i JOIN (SELECT sample_id, i, sum(v) AS d FROM adj GROUP BY 1, 2) y ON y.sample_id = a.sample_id AND y.i = a.j
UNION ALL SELECT DISTINCT sample_id, i, i, 1.0::DOUBLE FROM adj""")
def laplacian_normalized(s, d):
    return graph.normalized_laplacian(_adj(s, d), DAY).select("sample_id", "i", "j", _r("v"))


@_query("random_walk_matrix", "walk", "SELECT sample_id, i, j, round(v, 6) AS v FROM walk")
def random_walk_matrix(s, d):
    return _walk(s, d).select("sample_id", "i", "j", _r("v"))


_REACH = """, reach AS (SELECT sample_id, bin, i AS node, i AS other FROM snaps UNION SELECT sample_id, bin, j, j FROM snaps
  UNION SELECT r.sample_id, r.bin, r.node, b.j FROM reach r JOIN (SELECT sample_id, bin, i, j FROM snaps UNION ALL SELECT sample_id, bin, j, i FROM snaps) b ON b.sample_id = r.sample_id AND b.bin = r.bin AND b.i = r.other),
comps AS (SELECT sample_id, bin, component, count(*) AS size FROM (SELECT sample_id, bin, node, min(other) AS component FROM reach GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)"""


def _sizes(s, d) -> DataFrame:
    return graph.component_sizes(_snaps(s, d), ["sample_id", "bin"])


@_query("component_sizes", "snaps n_nodes", None)
def component_sizes(s, d):
    return _sizes(s, d)


@_query("component_upper_bound", "snaps n_nodes", None)
def component_upper_bound(s, d):
    return graph.upper_bound(_sizes(s, d), ["sample_id", "bin"], ev.node_counts(ev.contacts(s, d))).select("sample_id", "bin", _r("upper_bound"))


@_query("component_lower_bound", "snaps n_nodes", None)
def component_lower_bound(s, d):
    return graph.lower_bound(_sizes(s, d), ["sample_id", "bin"], ev.node_counts(ev.contacts(s, d))).select("sample_id", "bin", _r("lower_bound"))


for _name, _body in {
    "component_sizes": "SELECT sample_id, bin, component, size FROM comps",
    "component_upper_bound": "SELECT sample_id, bin, round(sum(size / n_nodes * ln(size)), 6) AS upper_bound FROM comps JOIN n_nodes USING (sample_id) GROUP BY 1, 2",
    "component_lower_bound": "SELECT sample_id, bin, round(sum(size / n_nodes * (2 - 2 / size) * ln(2)), 6) AS lower_bound FROM comps JOIN n_nodes USING (sample_id) GROUP BY 1, 2",
}.items():
    _SQL[_name] = _with("n_nodes snaps", "", True).rstrip() + _REACH + "\n" + _body


@_query("bound_curves", "spans n_nodes", None)
def bound_curves(s, d):
    out = pipelines.bound_curves(_merged(s, d), HALF_HOUR, ev.node_counts(ev.contacts(s, d)))
    return out.select("sample_id", "k", _r("t_center"), _r("upper_bound"), _r("lower_bound"))


_SQL["bound_curves"] = (
    _with("spans n_nodes", "", True).rstrip()
    + """, links AS (SELECT DISTINCT g.sample_id, g.k, g.t + 900 AS t_center, least(src, dst) AS i, greatest(src, dst) AS j FROM grid g JOIN spans USING (sample_id)
  JOIN merged e ON e.sample_id = g.sample_id AND e.t_start < g.t + 1800 AND e.t_end > g.t WHERE g.t < t_last - 1800 AND src <> dst),
reach AS (SELECT sample_id, k, i AS node, i AS other FROM links UNION SELECT sample_id, k, j, j FROM links
  UNION SELECT r.sample_id, r.k, r.node, b.j FROM reach r JOIN (SELECT sample_id, k, i, j FROM links UNION ALL SELECT sample_id, k, j, i FROM links) b ON b.sample_id = r.sample_id AND b.k = r.k AND b.i = r.other),
comps AS (SELECT sample_id, k, component, count(*) AS size FROM (SELECT sample_id, k, node, min(other) AS component FROM reach GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)
SELECT sample_id, k, round(any_value(t_center), 6) AS t_center, round(sum(size / n_nodes * ln(size)), 6) AS upper_bound, round(sum(size / n_nodes * (2 - 2 / size) * ln(2)), 6) AS lower_bound
FROM comps JOIN n_nodes USING (sample_id) JOIN (SELECT DISTINCT sample_id, k, t_center FROM links) USING (sample_id, k) GROUP BY 1, 2"""
)


@_query("expanding_component_bound")
def expanding_component_bound(s, d):
    """Upper bounds of growing windows from each day's start, hour by hour."""
    contacts_ = ev.contacts(s, d)
    hours = contacts_.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long"))).alias("k"))
    spans = hours.withColumns({"w_start": F.lit(0.0), "w_end": F.col("k") * HOUR})
    edges = intervals.range_join(contacts_, spans, 6 * HOUR).select("sample_id", "k", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()
    out = graph.upper_bound(graph.component_sizes(edges, ["sample_id", "k"]), ["sample_id", "k"], ev.node_counts(contacts_))
    return out.select("sample_id", "k", _r("upper_bound"))


_SQL["expanding_component_bound"] = (
    _with("n_nodes", "", True).rstrip()
    + """, links AS (SELECT DISTINCT sample_id, k, least(src, dst) AS i, greatest(src, dst) AS j FROM contacts, range(1, 25) r(k) WHERE t_start < k * 3600 AND t_end > 0),
reach AS (SELECT sample_id, k, i AS node, i AS other FROM links UNION SELECT sample_id, k, j, j FROM links
  UNION SELECT r.sample_id, r.k, r.node, b.j FROM reach r JOIN (SELECT sample_id, k, i, j FROM links UNION ALL SELECT sample_id, k, j, i FROM links) b ON b.sample_id = r.sample_id AND b.k = r.k AND b.i = r.other),
comps AS (SELECT sample_id, k, component, count(*) AS size FROM (SELECT sample_id, k, node, min(other) AS component FROM reach GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)
SELECT sample_id, k, round(sum(size / n_nodes * ln(size)), 6) AS upper_bound FROM comps JOIN n_nodes USING (sample_id) GROUP BY 1, 2"""
)


# ---- cells ----------------------------------------------------------------------------------
_CELL = "sample_id", "i", "j"


def _cells_out(frame: DataFrame) -> DataFrame:
    return frame.select(*_CELL, _r("v"))


@_query("matmul", "walk", "SELECT a.sample_id, a.i, b.j, round(sum(a.v * b.v), 6) AS v FROM walk a JOIN walk b ON b.sample_id = a.sample_id AND b.i = a.j GROUP BY ALL")
def matmul(s, d):
    return _cells_out(cells.matmul(_walk(s, d), _walk(s, d), DAY))


@_query("gram", "walk", "SELECT a.sample_id, a.i, b.i AS j, round(sum(a.v * b.v), 6) AS v FROM walk a JOIN walk b ON b.sample_id = a.sample_id AND b.j = a.j GROUP BY ALL")
def gram(s, d):
    return _cells_out(cells.gram(_walk(s, d), DAY))


@_query("gram_columns_upper", "walk", "SELECT a.sample_id, a.j AS i, b.j, round(sum(a.v * b.v), 6) AS v FROM walk a JOIN walk b ON b.sample_id = a.sample_id AND b.i = a.i WHERE a.j <= b.j GROUP BY ALL")
def gram_columns_upper(s, d):
    return _cells_out(cells.upper_triangle(cells.gram(_walk(s, d), DAY, columns=True)))


@_query("add_transpose", "walk", "SELECT sample_id, i, j, round(sum(v), 6) AS v FROM (SELECT * FROM walk UNION ALL SELECT sample_id, j, i, v FROM walk) GROUP BY ALL")
def add_transpose(s, d):
    return _cells_out(cells.add(_walk(s, d), cells.transpose(_walk(s, d)), DAY))


@_query("subtract_scaled", "walk", "SELECT sample_id, i, j, round(sum(v), 6) + 0.0 AS v FROM (SELECT * FROM walk UNION ALL SELECT sample_id, j, i, -0.5 * v FROM walk) GROUP BY ALL")
def subtract_scaled(s, d):
    return cells.subtract(_walk(s, d), cells.scale(cells.transpose(_walk(s, d)), 0.5), DAY).select(*_CELL, (F.round("v", 6) + 0.0).alias("v"))


@_query("scale_rows_columns", "walk", "SELECT sample_id, i, j, round(v / (i + 1) * (j + 1), 6) AS v FROM walk")
def scale_rows_columns(s, d):
    walk = _walk(s, d)
    nodes = cells.support(walk, DAY)
    by_row, by_column = nodes.withColumn("d", 1 / (F.col("node") + 1)), nodes.withColumn("d", F.col("node") + 1.0)
    return _cells_out(cells.scale_columns(cells.scale_rows(walk, by_row, DAY), by_column, DAY))


@_query("outer_product", "adj", "SELECT a.sample_id, a.i, b.i AS j, round(a.p * b.p, 6) AS v FROM (SELECT sample_id, i, sum(v) / 86400 AS p FROM adj GROUP BY 1, 2) a JOIN (SELECT sample_id, i, sum(v) / 86400 AS p FROM adj GROUP BY 1, 2) b ON b.sample_id = a.sample_id AND a.i <= b.i")
def outer_product(s, d):
    p = graph.degrees(_adj(s, d), DAY).select("sample_id", F.col("i").alias("node"), (F.col("degree") / 86400).alias("d"))
    return _cells_out(cells.outer(p, DAY, triangle=True))


@_query("row_normalize", "adj", "SELECT sample_id, i, j, round(v * 2 / sum(v) OVER (PARTITION BY sample_id, i), 6) AS v FROM adj")
def row_normalize(s, d):
    return _cells_out(cells.row_normalize(_adj(s, d), DAY, 2.0))


@_query("row_center", "walk", "SELECT sample_id, i, j, round(v - avg(v) OVER (PARTITION BY sample_id, i), 5) + 0.0 AS v FROM walk")
def row_center(s, d):
    return cells.row_normalize(_walk(s, d), DAY, 0).select(*_CELL, (F.round("v", 5) + 0.0).alias("v"))


@_query("drop_small", "walk", "SELECT sample_id, i, j, round(v, 6) AS v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY sample_id) AS m FROM walk) WHERE v > 0.1 * m")
def drop_small(s, d):
    return _cells_out(cells.drop_small(_walk(s, d), DAY, 0.1))


@_query("snap_to_one", "walk", "SELECT sample_id, i, j, round(CASE WHEN abs(v - 1) <= 0.9 THEN 1.0 ELSE v END, 6) AS v FROM walk")
def snap_to_one(s, d):
    return _cells_out(cells.snap_to_one(_walk(s, d), 0.9))


@_query("support", "walk", "SELECT DISTINCT sample_id, unnest([i, j]) AS node FROM walk")
def support(s, d):
    return cells.support(_walk(s, d), DAY)


_DAY_BIN = ["sample_id", "bin"]


@_query("shared_support", "snaps", "SELECT sample_id, bin, count(*) AS n_shared FROM (SELECT DISTINCT sample_id, bin, unnest([i, j]) AS node FROM snaps INTERSECT SELECT DISTINCT sample_id, bin - 1, unnest([i, j]) FROM snaps) GROUP BY 1, 2")
def shared_support(s, d):
    """Nodes that each snapshot shares with the next one."""
    snaps = _snaps(s, d).withColumn("v", F.lit(1.0))
    return cells.shared_support(snaps, snaps.withColumn("bin", F.col("bin") - 1), _DAY_BIN)


_FULL_SNAPS = """SELECT sample_id, bin, i, j, 1.0::DOUBLE AS v FROM snaps
UNION ALL SELECT n.sample_id, b.bin, node, node, 1.0 FROM nodes n JOIN bins b ON b.sample_id = n.sample_id WHERE NOT EXISTS (SELECT 1 FROM snaps x WHERE x.bin = b.bin AND x.sample_id = n.sample_id AND n.node IN (x.i, x.j))"""


def _full_snaps(s, d) -> DataFrame:
    nodes = ev.nodes_of(ev.contacts(s, d)).join(_bins(s, d), "sample_id")
    return cells.to_full(_snaps(s, d).withColumn("v", F.lit(1.0)), nodes, _DAY_BIN)


@_query("to_full", "snaps nodes bins", _FULL_SNAPS)
def to_full(s, d):
    return _full_snaps(s, d)


@_query("to_compact", "snaps", "SELECT sample_id, bin, i, j, 1.0::DOUBLE AS v FROM snaps")
def to_compact(s, d):
    return cells.to_compact(_full_snaps(s, d), _DAY_BIN)


@_query("add_diagonal", "walk nodes", "SELECT sample_id, i, j, round(sum(v), 6) AS v FROM (SELECT * FROM walk UNION ALL SELECT sample_id, node, node, 0.25 FROM nodes) GROUP BY ALL")
def add_diagonal(s, d):
    return _cells_out(cells.add_diagonal(_walk(s, d), ev.nodes_of(ev.contacts(s, d)), DAY, 0.25))


_HOURLY = "(SELECT sample_id, w AS k, src AS i, dst AS j, sum(least(t_end, (w + 1) * 3600) - greatest(t_start, w * 3600)) AS v FROM contacts, range(0, 24) r(w) WHERE t_start < (w + 1) * 3600 AND t_end > w * 3600 GROUP BY ALL)"


def _hourly(s, d) -> DataFrame:
    contacts_ = ev.contacts(s, d)
    w = F.explode(F.sequence(F.floor(F.col("t_start") / HOUR), F.least(F.lit(23).cast("long"), F.ceil(F.col("t_end") / HOUR) - 1)))
    cut = contacts_.withColumn("k", w).withColumns({"a": F.greatest("t_start", F.col("k") * HOUR), "b": F.least("t_end", (F.col("k") + 1) * HOUR)}).where("b > a")
    return cut.groupBy("sample_id", "k", F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum(F.col("b") - F.col("a")).alias("v"))


@_query("deltas", "contacts", f"""SELECT sample_id, k, i, j, round(v, 7) + 0.0 AS v FROM (
  SELECT sample_id, k, i, j, v - coalesce(lag(v) OVER (PARTITION BY sample_id, i, j ORDER BY k), 0) AS v FROM (
    SELECT p.sample_id, p.i, p.j, h.k, coalesce(x.v, 0) AS v FROM (SELECT DISTINCT sample_id, i, j FROM {_HOURLY}) p JOIN (SELECT DISTINCT sample_id, k FROM {_HOURLY}) h ON h.sample_id = p.sample_id
    LEFT JOIN {_HOURLY} x ON x.sample_id = p.sample_id AND x.i = p.i AND x.j = p.j AND x.k = h.k)) WHERE abs(v) > 0""")
def deltas(s, d):
    return cells.deltas(_hourly(s, d), DAY).select("sample_id", "k", "i", "j", (F.round("v", 7) + 0.0).alias("v"))


@_query("restore_deltas", "contacts", f"SELECT sample_id, k, i, j, round(v, 7) AS v FROM {_HOURLY}")
def restore_deltas(s, d):
    hourly = _hourly(s, d)
    back = cells.restore(cells.deltas(hourly, DAY), DAY)
    # a cell that stays the same has no delta: read the running value as of each stored matrix
    asked = hourly.select("sample_id", "k", "i", "j").withColumns({"v": F.lit(None).cast("double"), "q": F.lit(1)})
    both = back.select("sample_id", "k", "i", "j", "v", F.lit(0).alias("q")).unionByName(asked)
    last = F.last("v", ignorenulls=True).over(Window.partitionBy("sample_id", "i", "j").orderBy("k", "q"))
    return both.withColumn("v", last).where("q = 1").select("sample_id", "k", "i", "j", F.round("v", 7).alias("v"))


@_query("entropy_of_cells", "walk n_nodes", "SELECT sample_id, round(sum(-v * ln(v) / n_nodes), 6) AS entropy FROM walk JOIN n_nodes USING (sample_id) GROUP BY 1")
def entropy_of_cells(s, d):
    return cells.entropy(_walk(s, d), DAY, ev.node_counts(ev.contacts(s, d))).select("sample_id", _r("entropy"))


@_query("stationary_transition", "snaps", None)
def stationary_transition(s, d):
    key = ["sample_id", "bin"]
    snaps = _kept_snaps(s, d)
    walk = graph.random_walk_matrix(graph.both_ways(snaps, key), key)
    return cells.stationary(walk, graph.components(snaps, key), key).select(*key, "i", "j", _r("v"))


@_query("linear_transition", "snaps", None)
def linear_transition(s, d):
    key = ["sample_id", "bin"]
    snaps = _kept_snaps(s, d)
    walk = graph.random_walk_matrix(graph.both_ways(snaps, key), key)
    settled = cells.stationary(walk, graph.components(snaps, key), key)
    return cells.linear_transition(walk, settled, key, F.pmod(F.col("bin"), F.lit(13)) * 1.0).select(*key, "i", "j", (F.round("v", 6) + 0.0).alias("v"))


_STATIONARY = """, labels AS (SELECT sample_id, bin, node, min(other) AS component FROM reach GROUP BY 1, 2, 3),
nbr AS (SELECT sample_id, bin, i, j FROM snaps UNION ALL SELECT sample_id, bin, j, i FROM snaps),
deg AS (SELECT sample_id, bin, i AS node, count(*) AS d FROM nbr GROUP BY 1, 2, 3),
stat AS (SELECT a.sample_id, a.bin, a.node AS i, b.node AS j, b.d / sum(b.d) OVER (PARTITION BY a.sample_id, a.bin, a.node) AS v
  FROM labels a JOIN (SELECT l.*, d FROM labels l JOIN deg USING (sample_id, bin, node)) b ON b.sample_id = a.sample_id AND b.bin = a.bin AND b.component = a.component)"""
_SQL["stationary_transition"] = _with("snaps", "", True).rstrip() + _REACH + _STATIONARY + "\nSELECT sample_id, bin, i, j, round(v, 6) AS v FROM stat"
_SQL["linear_transition"] = (
    _with("snaps", "", True).rstrip()
    + _REACH
    + _STATIONARY
    + """
SELECT sample_id, bin, i, j, round(v, 6) + 0.0 AS v FROM (
  SELECT sample_id, bin, i, j, CASE WHEN t <= 1 THEN (1 - t) * e + t * w WHEN t < 10 THEN (w * (t - 10) + s * (1 - t)) / (1 - 10) ELSE s END AS v FROM (
    SELECT sample_id, bin, i, j, bin % 13 AS t, sum(e) AS e, sum(w) AS w, sum(s) AS s FROM (
      SELECT sample_id, bin, node AS i, node AS j, 1.0::DOUBLE AS e, 0.0::DOUBLE AS w, 0.0::DOUBLE AS s FROM deg
      UNION ALL SELECT n.sample_id, n.bin, i, j, 0, 1.0::DOUBLE / d, 0 FROM nbr n JOIN deg ON deg.sample_id = n.sample_id AND deg.bin = n.bin AND deg.node = n.i
      UNION ALL SELECT sample_id, bin, i, j, 0, 0, v FROM stat) GROUP BY 1, 2, 3, 4)) WHERE v <> 0"""
)


@_query("block_sums", "walk", "SELECT sample_id, i % 4 AS i, j % 4 AS j, round(sum(v), 6) AS v FROM walk GROUP BY ALL")
def block_sums(s, d):
    walk = _walk(s, d)
    clusters = cells.support(walk, DAY).withColumn("cluster", F.pmod("node", F.lit(4)))
    return _cells_out(cells.block_sums(walk, clusters, DAY))


@_query("stability_trace", "walk", "SELECT sample_id, round(sum(v), 6) AS trace FROM walk WHERE i % 4 = j % 4 GROUP BY 1")
def stability_trace(s, d):
    walk = _walk(s, d)
    clusters = cells.support(walk, DAY).withColumn("cluster", F.pmod("node", F.lit(4)))
    return cells.trace(cells.block_sums(walk, clusters, DAY), DAY).select("sample_id", _r("trace"))


@_query("autocovariance", "walk n_nodes", """SELECT sample_id, i, j, round(sum(v), 6) + 0.0 AS v FROM (
  SELECT sample_id, i, j, v / n_nodes AS v FROM walk JOIN n_nodes USING (sample_id)
  UNION ALL SELECT a.sample_id, a.node, b.node, -b.p / n_nodes FROM nodes a JOIN n_nodes USING (sample_id)
    JOIN (SELECT sample_id, j AS node, sum(v / n_nodes) AS p FROM walk JOIN n_nodes USING (sample_id) GROUP BY 1, 2) b ON b.sample_id = a.sample_id) GROUP BY ALL""")
def autocovariance(s, d):
    """diag(p) T - p (p T)^T with uniform p."""
    return cells.autocovariance(_walk(s, d), _uniform(s, d), DAY).select(*_CELL, (F.round("v", 6) + 0.0).alias("v"))


def _uniform(s, d) -> DataFrame:
    contacts_ = ev.contacts(s, d)
    return ev.nodes_of(contacts_).join(ev.node_counts(contacts_), "sample_id").select("sample_id", "node", (1 / F.col("n_nodes")).alias("d"))


_FORWARD = """(SELECT sample_id, i, j, sum(v) AS v FROM (
  SELECT a.sample_id, a.i, b.i AS j, a.v * b.v / (n_nodes * n_nodes) / p AS v FROM walk a JOIN n_nodes USING (sample_id) JOIN walk b ON b.sample_id = a.sample_id AND b.j = a.j
    JOIN (SELECT sample_id, j, sum(v / n_nodes) AS p FROM walk JOIN n_nodes USING (sample_id) GROUP BY 1, 2) q ON q.sample_id = a.sample_id AND q.j = a.j
  UNION ALL SELECT a.sample_id, a.node, b.node, -1.0 / (n_nodes * n_nodes) FROM nodes a JOIN nodes b USING (sample_id) JOIN n_nodes USING (sample_id)) GROUP BY ALL)"""


@_query("forward_autocovariance", "walk n_nodes", f"SELECT sample_id, i, j, round(v, 6) + 0.0 AS v FROM {_FORWARD}")
def forward_autocovariance(s, d):
    return cells.forward_autocovariance(_walk(s, d), _uniform(s, d), DAY).select(*_CELL, (F.round("v", 6) + 0.0).alias("v"))


@_query("autocovariance_block_sum", "walk n_nodes", f"SELECT sample_id, round(sum(v), 6) + 0.0 AS total FROM {_FORWARD} WHERE i < 10 AND j >= 10 GROUP BY 1")
def autocovariance_block_sum(s, d):
    p = _uniform(s, d)
    total = cells.block_sum(cells.forward_autocovariance(_walk(s, d), p, DAY), p.where("node < 10"), p.where("node >= 10"), DAY)
    return total.select("sample_id", (F.round("total", 6) + 0.0).alias("total"))


@_query("reindexed_cells", "snaps", """, idx AS (SELECT sample_id, bin, node, row_number() OVER (PARTITION BY sample_id, bin ORDER BY node) - 1 AS n FROM (SELECT DISTINCT sample_id, bin, unnest([i, j]) AS node FROM snaps))
SELECT x.sample_id, x.bin, a.n AS i, b.n AS j FROM snaps x JOIN idx a ON a.sample_id = x.sample_id AND a.bin = x.bin AND a.node = x.i JOIN idx b ON b.sample_id = x.sample_id AND b.bin = x.bin AND b.node = x.j""")
def reindexed_cells(s, d):
    return cells.reindexed(_snaps(s, d).withColumn("v", F.lit(1.0)), _DAY_BIN)[0].select("sample_id", "bin", "i", "j")


@_query("symmetrized_walk", "walk", "SELECT sample_id, i, j, round(sum(v) / 2, 6) AS v FROM (SELECT * FROM walk UNION ALL SELECT sample_id, j, i, v FROM walk) GROUP BY ALL")
def symmetrized_walk(s, d):
    return _cells_out(cells.symmetrized(_walk(s, d), DAY))


@_query("time_slices", "contacts", "SELECT sample_id, event_id, b AS slice, round(greatest(t_start, b * 21600), 6) AS t_start, round(least(t_end, (b + 1) * 21600), 6) AS t_end FROM contacts, range(0, 10) r(b) WHERE t_start < (b + 1) * 21600 AND t_end > b * 21600")
def time_slices(s, d):
    return intervals.time_slices(ev.contacts(s, d), 21600.0).select("sample_id", "event_id", "slice", _r("t_start"), _r("t_end"))


_STATE = "CASE WHEN isnan({0}) THEN 'undefined' WHEN isinf({0}) THEN 'infinite' ELSE 'finite' END"


def _with_state(frame: DataFrame, name: str) -> list:
    """A value where it is finite, and whether it is."""
    finite = ~F.isnan(name) & (F.abs(name) < float("inf"))
    return [F.when(finite, F.round(name, 6)).alias(name), F.when(finite, "finite").when(F.isnan(name), "undefined").otherwise("infinite").alias("state")]


@_query("frobenius_distance", "contacts", f"""SELECT sample_id, k, CASE WHEN NOT isnan(distance) AND NOT isinf(distance) THEN round(distance, 6) END AS distance, {_STATE.format("distance")} AS state FROM (
  SELECT x.sample_id, x.k, CASE WHEN x.s * y.s > 0 THEN (x.s + y.s - 2 * coalesce(z.s, 0)) / sqrt(x.s * y.s) WHEN x.s + y.s > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS distance FROM norms x JOIN norms y ON y.sample_id = x.sample_id AND y.k = x.k + 1
  LEFT JOIN (SELECT a.sample_id, a.k, sum(a.v * b.v) AS s FROM {_HOURLY} a JOIN {_HOURLY} b ON b.sample_id = a.sample_id AND b.i = a.i AND b.j = a.j AND b.k = a.k + 1 GROUP BY 1, 2) z ON z.sample_id = x.sample_id AND z.k = x.k WHERE x.s + y.s > 0)""")
def frobenius_distance(s, d):
    """Each hour against the next one, of hours of which one has a contact."""
    hourly = _hourly(s, d)
    out = cells.frobenius_distance(hourly, hourly.withColumn("k", F.col("k") - 1), ["sample_id", "k"]).where("k between 0 and 22")
    return out.select("sample_id", "k", *_with_state(out, "distance"))


_SQL["frobenius_distance"] = _SQL["frobenius_distance"].replace("\nSELECT", f""", norms AS (SELECT d.sample_id, h.k, coalesce(s, 0) AS s FROM (SELECT DISTINCT sample_id FROM contacts) d, range(0, 24) h(k) LEFT JOIN (SELECT sample_id, k, sum(v * v) AS s FROM {_HOURLY} GROUP BY 1, 2) x ON x.sample_id = d.sample_id AND x.k = h.k)\nSELECT""", 1)


# ---- series ---------------------------------------------------------------------------------
@_query("first_difference", "halfhours", "SELECT sample_id, k, round(coalesce(value - lag(value) OVER (PARTITION BY sample_id ORDER BY k), 0), 7) + 0.0 AS value FROM halfhours")
def first_difference(s, d):
    return series.first_difference(_halfhours(s, d), DAY).select("sample_id", "k", (F.round("value", 7) + 0.0).alias("value"))


@_query("running_mean", "halfhours", "SELECT sample_id, k, round(m, 7) AS value FROM (SELECT sample_id, k, avg(value) OVER w AS m, row_number() OVER (PARTITION BY sample_id ORDER BY k) AS n FROM halfhours WINDOW w AS (PARTITION BY sample_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n >= 4")
def running_mean(s, d):
    return series.running_mean(_halfhours(s, d), 4, DAY).select("sample_id", "k", _r("value", 7))


@_query("derivative", "halfhours", "SELECT sample_id, k, round(s, 7) + 0.0 AS slope FROM (SELECT sample_id, k, (lead(value) OVER w - lag(value) OVER w) / (lead(k) OVER w - lag(k) OVER w) AS s FROM halfhours WINDOW w AS (PARTITION BY sample_id ORDER BY k)) WHERE s IS NOT NULL")
def derivative(s, d):
    return series.derivative(_halfhours(s, d), DAY, x="k").select("sample_id", "k", (F.round("slope", 7) + 0.0).alias("slope"))


@_query("integral", "halfhours", "SELECT sample_id, part, round(coalesce(sum(a), 0), 7) AS integral FROM (SELECT sample_id, k // 12 AS part, (k - lag(k) OVER w) * (value + lag(value) OVER w) / 2 AS a FROM halfhours WINDOW w AS (PARTITION BY sample_id, k // 12 ORDER BY k)) GROUP BY ALL")
def integral(s, d):
    halves = _halfhours(s, d).withColumn("part", F.floor(F.col("k") / 12))
    return series.integral(halves, ["sample_id", "part"], x="k").select("sample_id", "part", _r("integral", 7))


@_query("min_max_scaled", "halfhours", "SELECT sample_id, k, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS value FROM halfhours WINDOW w AS (PARTITION BY sample_id)")
def min_max_scaled(s, d):
    return series.min_max_scaled(_halfhours(s, d), DAY).select("sample_id", "k", _r("value"))


@_query("percentile_mask", "halfhours", "SELECT sample_id, k, (value >= quantile_cont(value, 0.9) OVER (PARTITION BY sample_id))::INT AS mask FROM halfhours")
def percentile_mask(s, d):
    return series.percentile_mask(_halfhours(s, d), 90, DAY).select("sample_id", "k", "mask")


_LABELLED = "(SELECT sample_id, k, (value > avg(value) OVER (PARTITION BY sample_id))::INT AS label FROM halfhours)"
_CHANGED = f"(SELECT sample_id, k, CASE WHEN lag(label) OVER (PARTITION BY sample_id ORDER BY k) <> label THEN 1 ELSE 0 END AS change FROM {_LABELLED})"


def _labelled(s, d) -> DataFrame:
    return _halfhours(s, d).withColumn("label", (F.col("value") > F.avg("value").over(Window.partitionBy("sample_id"))).cast("int"))


@_query("label_changes", "halfhours", f"SELECT * FROM {_CHANGED}")
def label_changes(s, d):
    return series.label_changes(_labelled(s, d), DAY).select("sample_id", "k", "change")


@_query("dilated_changes", "halfhours", f"SELECT sample_id, k, max(change) OVER (PARTITION BY sample_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS change FROM {_CHANGED}")
def dilated_changes(s, d):
    return series.dilated_changes(series.label_changes(_labelled(s, d), DAY), 2, DAY).select("sample_id", "k", "change")


@_query("top_positions", "halfhours", "SELECT sample_id, k FROM (SELECT sample_id, k, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, k DESC) AS n FROM halfhours) WHERE n <= 3")
def top_positions(s, d):
    return series.top_positions(_halfhours(s, d), 3, DAY).select("sample_id", "k")


@_query("pairs_within", "bins", "SELECT a.sample_id, a.bin AS k, b.bin AS k_before FROM bins a JOIN bins b ON b.sample_id = a.sample_id AND b.bin BETWEEN a.bin - 3 AND a.bin - 1")
def pairs_within(s, d):
    return series.pairs_within(_bins(s, d), 3, DAY, order="bin")


_FROB = """SELECT sample_id, k, avg(d) AS value FROM (
  SELECT a.sample_id, a.bin AS k, b.bin AS kb, CASE WHEN a.n * b.n > 0 THEN (a.n + b.n - 2 * coalesce(c.n, 0)) / sqrt(a.n * b.n) WHEN a.n + b.n > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS d
  FROM cnt a JOIN cnt b ON b.sample_id = a.sample_id AND b.bin BETWEEN a.bin - 3 AND a.bin - 1
  LEFT JOIN (SELECT x.sample_id, x.bin, y.bin AS bb, count(*) AS n FROM snaps x JOIN snaps y ON y.sample_id = x.sample_id AND y.i = x.i AND y.j = x.j AND y.bin BETWEEN x.bin - 3 AND x.bin - 1 GROUP BY 1, 2, 3) c ON c.sample_id = a.sample_id AND c.bin = a.bin AND c.bb = b.bin
) GROUP BY 1, 2 HAVING count(*) = 3"""


@_query("frobenius_signal", "snaps bins", f", cnt AS (SELECT b.sample_id, b.bin, count(s.i) AS n FROM bins b LEFT JOIN snaps s ON s.sample_id = b.sample_id AND s.bin = b.bin GROUP BY 1, 2)\nSELECT sample_id, k, CASE WHEN NOT isnan(value) AND NOT isinf(value) THEN round(value, 6) END AS value, {_STATE.format('value')} AS state FROM ({_FROB})")
def frobenius_signal(s, d):
    signal = pipelines.frobenius_signals(_snaps(s, d), _bins(s, d), [3])
    return signal.select("sample_id", "k", *_with_state(signal, "value"))


# ---- scores and choice ----------------------------------------------------------------------
@_query("evaluate_change_points", "evaluated", "SELECT param, sample_id, n_true, n_found, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(hausdorff, 6) AS hausdorff FROM evaluated")
def evaluate_change_points(s, d):
    return _evaluated(s, d).select("param", "sample_id", "n_true", "n_found", "tp", _r("precision"), _r("recall"), _r("f1"), _r("hausdorff"))


@_query("mean_scores", "means", "SELECT param, round(mean_f1, 6) AS mean_f1, round(mean_hausdorff, 7) AS mean_hausdorff FROM means")
def mean_scores(s, d):
    return scores.mean_scores(_evaluated(s, d), ["param"]).select("param", _r("mean_f1"), _r("mean_hausdorff", 7))


@_query("mean_scores_capped", "evaluated", "SELECT param, round(avg(least(hausdorff, 10000.0)), 7) AS mean_hausdorff FROM evaluated GROUP BY 1")
def mean_scores_capped(s, d):
    return scores.mean_scores(_evaluated(s, d), ["param"], cap=10000.0).select("param", _r("mean_hausdorff", 7))


@_query("best_by_f1", "means", "SELECT param, round(mean_f1, 6) AS mean_f1 FROM means ORDER BY means.mean_f1 DESC, param LIMIT 1")
def best_by_f1(s, d):
    return scores.best(scores.mean_scores(_evaluated(s, d), ["param"]), ["param"]).select("param", _r("mean_f1"))


@_query("best_by_hausdorff", "means", "SELECT param, round(mean_hausdorff, 7) AS mean_hausdorff FROM means ORDER BY means.mean_hausdorff, param LIMIT 1")
def best_by_hausdorff(s, d):
    return scores.best(scores.mean_scores(_evaluated(s, d), ["param"]), ["param"], "mean_hausdorff", greatest=False).select("param", _r("mean_hausdorff", 7))


@_query("hausdorff_cap", "evaluated", "SELECT round(max(hausdorff) FILTER (WHERE NOT isinf(hausdorff)) * 1.1, 7) AS cap, bool_or(isinf(hausdorff)) AS any_infinite FROM evaluated")
def hausdorff_cap(s, d):
    return scores.hausdorff_cap(_evaluated(s, d)).select(_r("cap", 7), "any_infinite")


@_query("clipped_scores", "evaluated", "SELECT param, sample_id, round(CASE WHEN isinf(hausdorff) THEN 50000 ELSE hausdorff END, 7) AS hausdorff FROM evaluated")
def clipped_scores(s, d):
    return scores.clipped(_evaluated(s, d), 50000.0).select("param", "sample_id", _r("hausdorff", 7))


_RESULTS = "(SELECT sample_id, param::DOUBLE AS lamda, CASE WHEN n_found = 0 THEN 'nan'::DOUBLE ELSE round(hausdorff / 86400, 6) END AS avg_nvi, round(f1, 6) AS best_stability FROM evaluated)"


def _results(s, d) -> DataFrame:
    return _evaluated(s, d).select("sample_id", F.col("param").cast("double").alias("lamda"), F.when(F.col("n_found") == 0, float("nan")).otherwise(F.round(F.col("hausdorff") / 86400, 6)).alias("avg_nvi"), _r("f1").alias("best_stability"))


@_query("select_rate", "evaluated", f"SELECT sample_id, coalesce(arg_min(lamda, (avg_nvi, lamda)) FILTER (WHERE NOT isnan(avg_nvi) AND NOT isinf(avg_nvi)), arg_min(lamda, (-best_stability, lamda))) AS lamda FROM {_RESULTS} GROUP BY 1")
def select_rate(s, d):
    return scores.select_rate(_results(s, d), DAY)


@_query("best_result", "evaluated", f"SELECT sample_id, arg_min(lamda, (-best_stability, lamda)) AS lamda, max(best_stability) AS best_stability FROM {_RESULTS} GROUP BY 1")
def best_result(s, d):
    return scores.best_result(_results(s, d), DAY)


@_query("nearest_rate", "", "SELECT * FROM (VALUES (0.1::DOUBLE)) t(lamda)")
def nearest_rate(s, d):
    return scores.nearest_rate(s.createDataFrame([(0.01,), (0.1,), (1.0,)], "lamda double"), 0.1004)


@_query("fastest_rate", "evaluated", f"SELECT max(lamda) AS lamda FROM {_RESULTS}")
def fastest_rate(s, d):
    return _results(s, d).agg(F.max("lamda").alias("lamda"))


# ---- partitions and flows ----------------------------------------------------------------------
@_query("mutual_information", "tab", "SELECT round((h1 + h2 - h12) / greatest(h1, h2), 6) AS nmi FROM (SELECT sum(-n / total * log2(na / total)) AS h1, sum(-n / total * log2(nb / total)) AS h2, sum(-n / total * log2(n / total)) AS h12 FROM tab)")
def mutual_information(s, d):
    a, b = _parts(s, d)
    return partitions.mutual_information(partitions.contingency(a, b, ["g"]), ["g"]).select(_r("nmi"))


@_query("variation_of_information", "tab", "SELECT round(abs(sum(-n * log2(n * n / (na * nb)))) / (max(total) * log2(max(total))), 6) AS nvi FROM tab")
def variation_of_information(s, d):
    a, b = _parts(s, d)
    return partitions.variation(partitions.contingency(a, b, ["g"]), ["g"]).select(_r("nvi"))


@_query("jaccard_distance", "tab", "SELECT round(1 - ab / (pa + pb - ab), 6) AS jaccard FROM (SELECT sum(n * (n - 1) / 2) AS ab, sum(na * (na - 1) / 2 * n / na) AS pa, sum(nb * (nb - 1) / 2 * n / nb) AS pb FROM tab)")
def jaccard_distance(s, d):
    a, b = _parts(s, d)
    return partitions.jaccard_distance(partitions.contingency(a, b, ["g"]), ["g"]).select(_r("jaccard"))


@_query("average_variation", "many", """SELECT round(avg(v), 6) AS avg_nvi FROM (SELECT ra, rb, abs(sum(-n * log2(n * n / (na * nb)))) / (max(t) * log2(max(t))) AS v FROM (
  SELECT *, sum(n) OVER (PARTITION BY ra, rb, a) AS na, sum(n) OVER (PARTITION BY ra, rb, b) AS nb, sum(n) OVER (PARTITION BY ra, rb) AS t FROM (
    SELECT x.run AS ra, y.run AS rb, x.cluster AS a, y.cluster AS b, count(*) AS n FROM many x JOIN many y ON x.node = y.node AND x.run < y.run GROUP BY ALL)) GROUP BY ra, rb)""")
def average_variation(s, d):
    return partitions.average_variation(_many(s, d), ["g"]).select(_r("avg_nvi"))


@_query("partition_integrity", "many", "SELECT run, 0::BIGINT AS n_repeated, 0::BIGINT AS n_missing, 0::BIGINT AS n_unknown FROM (SELECT DISTINCT run FROM many)")
def partition_integrity(s, d):
    many = _many(s, d)
    return partitions.integrity(many, many.select("node"), ["run"])


@_query("compact_clusters", "many", "SELECT run, node, dense_rank() OVER (PARTITION BY run ORDER BY cluster * 3) - 1 AS cluster FROM many")
def compact_clusters(s, d):
    return partitions.compacted(_many(s, d).withColumn("cluster", F.col("cluster") * 3), ["run"]).select("run", "node", "cluster")


@_query("cluster_indicator", "many", "SELECT run, node, (cluster = 0)::INT AS c0, (cluster = 1)::INT AS c1, (cluster = 2)::INT AS c2, (cluster = 3)::INT AS c3, (cluster = 4)::INT AS c4 FROM many")
def cluster_indicator(s, d):
    wide = partitions.indicator(_many(s, d), ["run"], list(range(5)))
    return wide.select("run", "node", *[F.col(f"`{c}`").alias(f"c{c}") for c in range(5)])


@_query("flows", "flow", "SELECT * FROM flow")
def flows(s, d):
    return _flow(s, d)


@_query("flow_profiles", "flow", "SELECT label, type, sum(value)::BIGINT AS value FROM (SELECT 'L' || level || '_C' || source AS label, type, value FROM flow UNION ALL SELECT 'L' || (level + 1) || '_C' || target, type, value FROM flow) GROUP BY ALL")
def flow_profiles(s, d):
    return partitions.node_profiles(partitions.flow_labels(_flow(s, d)))


@_query("flow_offsets", "flow", "SELECT level, source + level * 5 AS source, target + (level + 1) * 5 AS target, type, value FROM flow")
def flow_offsets(s, d):
    return partitions.offset_flows(_flow(s, d)).select("level", "source", "target", "type", "value")


@_query("sankey_layers", "flow", """SELECT level, cluster, total::BIGINT AS total, row_number() OVER (PARTITION BY level ORDER BY a DESC, b DESC, cluster) AS place FROM (
  SELECT level, cluster, sum(value) AS total, coalesce(sum(value) FILTER (WHERE type = 'AFRICA'), 0) AS a, coalesce(sum(value) FILTER (WHERE type = 'ASIA'), 0) AS b FROM (
    SELECT level, source AS cluster, type, value FROM flow UNION ALL SELECT level + 1, target, type, value FROM flow WHERE level = (SELECT max(level) FROM flow)) GROUP BY 1, 2)""")
def sankey_layers(s, d):
    return partitions.sankey_layers(_flow(s, d), ["AFRICA", "ASIA"])


@_query("cluster_order", "tab", """SELECT b, row_number() OVER (ORDER BY ma NULLS LAST, mj DESC NULLS LAST, b) AS place FROM (
  SELECT b, min(a) FILTER (WHERE jac >= 0.04) AS ma, arg_min(jac, a) FILTER (WHERE jac >= 0.04) AS mj FROM (SELECT a, b, n / (na + nb - n) AS jac FROM tab) GROUP BY b)""")
def cluster_order(s, d):
    a, b = _parts(s, d)
    return clustering.order_like(partitions.contingency(a, b, ["g"]), ["g"], 0.04).select("b", "place")


# ---- intervals of change points ------------------------------------------------------------------
_CUTS = "(SELECT DISTINCT sample_id, k FROM (SELECT t.sample_id, (SELECT max(g.k) FROM grid g WHERE g.sample_id = t.sample_id AND g.t <= t.bkp) AS k FROM truth t) WHERE k IS NOT NULL)"
_RANGES = f"""(SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY a) AS interval, a, b FROM (
  SELECT sample_id, k AS a, lead(k) OVER (PARTITION BY sample_id ORDER BY k) AS b FROM (SELECT sample_id, k FROM {_CUTS} UNION SELECT sample_id, 0 FROM spans UNION SELECT sample_id, n_intervals FROM spans)) WHERE b - a >= 2)"""


def _cuts(s, d, grid: DataFrame) -> DataFrame:
    truth = _scored(s, d)[1].select("sample_id", F.col("bkp").alias("at"))
    found = intervals.as_of(grid, truth).where("t <= at")
    return found.select("sample_id", "k").distinct()


@_query("change_point_intervals", "spans truth", f"SELECT sample_id, interval, a AS start, b AS stop FROM {_RANGES}")
def change_point_intervals(s, d):
    grid = _grid(s, d)
    return clustering.intervals_between(_cuts(s, d, grid), grid)


@_query("interval_coverage", "spans truth", f"SELECT sample_id, interval FROM {_RANGES} JOIN spans USING (sample_id) WHERE b > n_intervals")
def interval_coverage(s, d):
    grid = _grid(s, d)
    return clustering.uncovered(clustering.intervals_between(_cuts(s, d, grid), grid), grid).select("sample_id", "interval")


@_query("unfinished_intervals", "spans truth", f"SELECT sample_id, interval FROM {_RANGES} WHERE interval <> 1")
def unfinished_intervals(s, d):
    grid = _grid(s, d)
    ranges = clustering.intervals_between(_cuts(s, d, grid), grid)
    return clustering.unfinished(ranges, ranges.where("interval = 1"), ["sample_id", "interval"]).select("sample_id", "interval")


# ---- scalar functions ----------------------------------------------------------------------------
_ANGLES = "(SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings)"


@_query("subspace_measures", "", f"""SELECT vec_id, round(sqrt(list_sum(list_transform(a, lambda x: sin(x) * sin(x)))), 5) AS projection, round(sqrt(greatest(0, 1 - list_product(list_transform(a, lambda x: cos(x) * cos(x))))), 5) AS binet_cauchy,
round(2 * sqrt(list_sum(list_transform(a, lambda x: sin(x / 2) * sin(x / 2)))), 5) AS procrustes FROM {_ANGLES}""")
def subspace_measures(s, d):
    a = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    table = _table(s, d, "embeddings").select("vec_id", a.alias("a"))
    return table.select("vec_id", F.round(arrays.projection(F.col("a")), 5).alias("projection"), F.round(arrays.binet_cauchy(F.col("a")), 5).alias("binet_cauchy"), F.round(arrays.procrustes(F.col("a")), 5).alias("procrustes"))


@_query("unit_misalignment", "", """SELECT vec_id, round(1 - abs(list_sum(list_transform(list_zip(u, list_reverse(u)), lambda z: z[1] * z[2]))), 5) AS score FROM (
SELECT vec_id, list_transform(e, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END) AS u FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)))""")
def unit_misalignment(s, d):
    table = _table(s, d, "embeddings").select("vec_id", arrays.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("u"))
    return table.select("vec_id", F.round(arrays.misalignment(F.col("u"), F.reverse("u")), 5).alias("score"))


@_query("second_windows", "", "SELECT w, greatest(w + 1, round_even(w * 2.5, 0)::BIGINT) AS second FROM range(1, 9) r(w)")
def second_windows(s, d):
    return s.range(1, 9).select(F.col("id").alias("w"), arrays.second_window(F.col("id"), 2.5).alias("second"))


@_query("toy_path", "", "SELECT j AS src, j + 1 AS dst, CASE WHEN j <= 1 THEN 0.0 ELSE j END::DOUBLE AS t_start, CASE WHEN j <= 1 THEN 2.0 ELSE j + 1 END::DOUBLE AS t_end FROM range(0, 5) r(j)")
def toy_path(s, d):
    return generators.path(s, 6, overlap=1).select("src", "dst", "t_start", "t_end")


# ---- kernels ----------------------------------------------------------------------------------------
_RATE_VALUES = "(VALUES " + ", ".join(f"({r!r}::DOUBLE)" for r in RATES) + ") r(lamda)"


def _of_intervals(walk: bool = False) -> str:
    """CTEs adjm, kern and mats: each interval's matrix p (columns q), the identity where nobody meets."""
    return ",\n" + ",\n".join(
        [
            K.adjacency("adjm", "edges", "sample_id, k"),
            f"rated AS (SELECT sample_id, k, a, d, lamda, lamda * tau AS t FROM adjm JOIN grid USING (sample_id, k), {_RATE_VALUES})",
            K.heat("kern", "rated", walk),
            f"mats AS MATERIALIZED (SELECT g.sample_id, lamda, g.k, g.t, g.tau, coalesce(e, {K._EYE}) AS p, CASE WHEN e IS NULL THEN {K._EYE} ELSE {K.transposed('e')} END AS q FROM (SELECT * FROM grid, {_RATE_VALUES} WHERE tau IS NOT NULL) g LEFT JOIN kern USING (sample_id, k, lamda))".replace("LEFT JOIN kern", "LEFT JOIN (SELECT sample_id, k, lamda, e FROM kern)"),
        ]
    )


_BY_RATE = ["sample_id", "lamda"]


@_query("inter_transitions", "edges spans", _of_intervals(True) + """
SELECT sample_id, lamda, k, i, j, round(v, 6) AS v FROM (SELECT sample_id, lamda, k, i, unnest(r) AS v, unnest(range(20)) AS j FROM (SELECT sample_id, lamda, k, unnest(e) AS r, unnest(d) AS deg, unnest(range(20)) AS i FROM kern) WHERE deg > 0) WHERE v > 1e-6""")
def inter_transitions(s, d):
    return transitions.inter_transitions(_packed(s, d)[1], RATES, tol=1e-6).select("sample_id", "lamda", "k", "i", "j", _r("v"))


def _running_sql(reverse: bool) -> str:
    return _of_intervals() + ",\n" + K.running("run", "mats", _BY_RATE, reverse=reverse) + f"\nSELECT sample_id, lamda, k, round(t + tau, 6) AS t, round({K.entropy('p')}, 6) AS entropy FROM run"


def _entropies(frame: DataFrame) -> DataFrame:
    return frame.select("sample_id", "lamda", "k", _r("t"), _r("entropy"))


@_query("running_entropy", "edges spans", _running_sql(False))
def running_entropy(s, d):
    return _entropies(transitions.running_entropy(_packed(s, d)[1], RATES))


@_query("running_entropy_reverse", "edges spans", _running_sql(True))
def running_entropy_reverse(s, d):
    return _entropies(transitions.running_entropy(_packed(s, d)[1], RATES, reverse=True))


@_query("running_transition", "edges spans", _of_intervals() + ",\n" + K.running("run", "mats", _BY_RATE) + "\n" + K.cells("(SELECT * FROM run JOIN spans USING (sample_id) WHERE k = n_intervals - 1)", "sample_id, lamda"))
def running_transition(s, d):
    return transitions.running_transition(_packed(s, d)[1], RATES).where("v > 1e-6").select("sample_id", "lamda", "i", "j", _r("v"))


@_query(
    "linear_running_entropy",
    "snaps bins",
    ",\n"
    + K.adjacency("adjm", "snaps", "sample_id, bin")
    + f""",
linear AS (SELECT sample_id, bin, list_transform(range(1, 21), lambda x: list_transform(range(1, 21), lambda y: CASE WHEN d[x] > 0 THEN 0.5 * (x = y)::DOUBLE + 0.5 * a[x][y] / d[x] ELSE (x = y)::DOUBLE END)) AS p FROM adjm),
mats AS MATERIALIZED (SELECT sample_id, b.bin AS k, x.bin IS NOT NULL AS stored, coalesce(p, {K._EYE}) AS p, CASE WHEN p IS NULL THEN {K._EYE} ELSE {K.transposed('p')} END AS q FROM bins b LEFT JOIN linear x USING (sample_id, bin)),
"""
    + K.running("run", "mats", ["sample_id"], 7)
    + f"\nSELECT sample_id, k, round({K.entropy('p')}, 6) AS entropy FROM run WHERE stored",
)
def linear_running_entropy(s, d):
    """Entropy of the running product of linear stand-ins over each day's snapshots."""
    key = ["sample_id", "k"]
    snaps = _kept_snaps(s, d).withColumnRenamed("bin", "k")
    walk = graph.random_walk_matrix(graph.both_ways(snaps, key), key)
    linear = cells.linear_transition(walk, cells.stationary(walk, graph.components(snaps, key), key), key, F.lit(0.5))
    n = _all_cohorts(s, d)
    return cells.entropy(transitions.running_products(linear, n, DAY), key, n).select("sample_id", "k", _r("entropy"))


@_query(
    "component_exponentials",
    "snaps",
    ",\n" + K.adjacency("adjm", "snaps", "sample_id, bin") + ",\ntimed AS (SELECT *, 0.7::DOUBLE AS t FROM adjm),\n" + K.heat("kern", "timed") + """
SELECT sample_id, bin, i, j, round(v, 6) AS v FROM (SELECT sample_id, bin, i, unnest(r) AS v, unnest(range(20)) AS j FROM (SELECT sample_id, bin, unnest(e) AS r, unnest(d) AS deg, unnest(range(20)) AS i FROM kern) WHERE deg > 0) WHERE v > 1e-6""",
)
def component_exponentials(s, d):
    key = ["sample_id", "bin"]
    snaps = _kept_snaps(s, d)
    out = transitions.component_exponentials(graph.laplacian(graph.both_ways(snaps, key), key), graph.components(snaps, key), key, 0.7)
    return out.where("v > 1e-6").select(*key, "i", "j", _r("v"))


_PARTS_OF_DAYS = f", ranges AS (SELECT * FROM {_RANGES})"
_BY_INTERVAL = ["sample_id", "interval", "lamda"]


@_query(
    "interval_transitions",
    "edges spans truth",
    _of_intervals(True)
    + _PARTS_OF_DAYS
    + """, pieces AS MATERIALIZED (SELECT m.sample_id, interval, lamda, k, p, q FROM mats m JOIN ranges g ON g.sample_id = m.sample_id AND k >= g.a AND k < g.b),
lasts AS (SELECT x.sample_id, interval, max(x.k) AS k FROM adjm x JOIN ranges g ON g.sample_id = x.sample_id AND x.k >= g.a AND x.k < g.b GROUP BY 1, 2),
"""
    + K.running("run", "pieces", _BY_INTERVAL)
    + "\n"
    + K.cells("(SELECT * FROM run JOIN lasts USING (sample_id, interval, k))", "sample_id, interval, lamda, k"),
)
def interval_transitions(s, d):
    """Products that start anew in each interval between change points."""
    grid, packed = _packed(s, d)
    ranges = clustering.intervals_between(_cuts(s, d, grid), grid)
    out = clustering.interval_products(packed, ranges, RATES)
    return out.where("v > 1e-6").select(*_BY_INTERVAL, "k", "i", "j", _r("v"))


def _window_signals(s, d, backend: str = "sliding", reverse: bool = False, fraction: float = 1.0, keep: bool = False) -> DataFrame:
    grid, packed = _packed(s, d)
    if keep or fraction < 1:  # plans of searches are long: sampled windows ask for the grid several times, and what follows for the signals
        grid, packed = storage.kept(grid), storage.kept(packed)
    return transitions.window_entropy(packed, pipelines.window_plans(grid, [HALF_HOUR, HOUR], fraction), RATES, backend, reverse=reverse)


_CENTERED_HOUR = _CENTERED.replace("900", "1800")
_SAMPLED = """SELECT DISTINCT p.* FROM (
  SELECT sample_id, n, CASE WHEN n > 0 AND n = m - 1 THEN b ELSE a + n * CASE WHEN m > 1 THEN (b - a) / (m - 1) ELSE 0 END END AS target
  FROM (SELECT sample_id, min(t) AS a, max(t) AS b, greatest(1, ceil(0.1 * count(*)))::BIGINT AS m FROM {0} GROUP BY sample_id), range(0, 100000) z(n) WHERE n < m) q
ASOF JOIN {0} p ON p.sample_id = q.sample_id AND p.t >= q.target"""


def _windows_sql(sampled: bool = False) -> str:
    """CTEs up to signal: sample_id, lamda, window, k, t, value."""
    both = f", half AS MATERIALIZED ({_CENTERED}), whole AS MATERIALIZED ({_CENTERED_HOUR})"
    parts = [f"SELECT sample_id, k, t, l, r, {w!r}::DOUBLE AS width FROM ({_SAMPLED.format(n)})" if sampled else f"SELECT sample_id, k, t, l, r, {w!r}::DOUBLE AS width FROM {n}" for n, w in (("half", HALF_HOUR), ("whole", HOUR))]
    plan = f", plan AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)}), {_RATE_VALUES})"
    return _of_intervals() + both + plan + ",\n" + K.windows("win", "mats", "plan", _BY_RATE) + f",\nsignal AS (SELECT sample_id, lamda, width, k, t, {K.entropy('p')} AS value FROM win)"


def _signal_out(frame: DataFrame) -> DataFrame:
    return frame.select("sample_id", "lamda", "window", "direction", "k", _r("t"), _r("value"))


_SIGNAL_SQL = "\nSELECT sample_id, lamda, width AS \"window\", '{0}' AS direction, k, round(t, 6) AS t, round(value, 6) AS value FROM signal"


@_query("window_entropy", "edges spans", _windows_sql() + _SIGNAL_SQL.format("forward"))
def window_entropy(s, d):
    return _signal_out(_window_signals(s, d))


@_query("window_entropy_tree", "edges spans", _windows_sql() + _SIGNAL_SQL.format("forward"))
def window_entropy_tree(s, d):
    return _signal_out(_window_signals(s, d, "tree"))


# kernels of symmetric matrices: the product in reverse order is the transpose, whose entropy is the same
@_query("window_entropy_reverse", "edges spans", _windows_sql() + _SIGNAL_SQL.format("reverse"))
def window_entropy_reverse(s, d):
    return _signal_out(_window_signals(s, d, reverse=True))


def _n_bkps(s, d, n: int = 3) -> DataFrame:
    return ev.contacts(s, d).select("sample_id").distinct().withColumn("n_bkps", F.lit(n))


def _three_cuts(keys: str, source: str, name: str = "found", report: str = "t") -> str:
    """CTEs up to name(keys, pred): of all ways to cut each series in four parts of two or more, the one of least cost."""
    return f""", series AS (SELECT {keys}, list(value ORDER BY k) AS v, list({report} ORDER BY k) AS ts, count(*)::BIGINT AS n FROM {source} GROUP BY {keys}),
prefixes AS (SELECT *, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(v[1:i]), 0)) AS s, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(list_transform(v[1:i], lambda x: x * x)), 0)) AS q FROM series WHERE n >= 8),
cuts3 AS (SELECT *, q[a + 1] - s[a + 1] ** 2 / a + q[b + 1] - q[a + 1] - (s[b + 1] - s[a + 1]) ** 2 / (b - a) + q[c + 1] - q[b + 1] - (s[c + 1] - s[b + 1]) ** 2 / (c - b) + q[n + 1] - q[c + 1] - (s[n + 1] - s[c + 1]) ** 2 / (n - c) AS cost
  FROM prefixes, unnest(range(2, n - 1)) x(a), unnest(range(a + 2, n - 1)) y(b), unnest(range(b + 2, n - 1)) z(c)),
{name} AS (SELECT {keys}, unnest([ts[w.a + 1], ts[w.b + 1], ts[w.c + 1]]) AS pred FROM (SELECT {keys}, any_value(ts) AS ts, arg_min({{'a': a, 'b': b, 'c': c}}, cost) AS w FROM cuts3 GROUP BY {keys}))"""


@_query("detect_change_points", "halfhours", _three_cuts("sample_id", "(SELECT *, k * 1800.0::DOUBLE AS t FROM halfhours)") + "\nSELECT * FROM found")
def detect_change_points(s, d):
    signal = _halfhours(s, d).withColumn("t", F.col("k") * HALF_HOUR)
    return detection.detect(signal, _n_bkps(s, d), DAY)


_PENALIZED = """series AS (SELECT sample_id, penalty, list(value ORDER BY k) AS v, list(k ORDER BY k) AS ks, count(*)::BIGINT AS n FROM halfhours, (VALUES (1e3::DOUBLE), (1e4::DOUBLE), (1e5::DOUBLE)) r(penalty) GROUP BY 1, 2),
prefixes AS (SELECT *, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(v[1:i]), 0)) AS s, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(list_transform(v[1:i], lambda x: x * x)), 0)) AS q FROM series WHERE n >= 2),
best AS (
  SELECT sample_id, penalty, 1::BIGINT AS b, n, s, q, [0.0::DOUBLE, 'inf'::DOUBLE] AS cost, [0::BIGINT, 0::BIGINT] AS back FROM prefixes
  UNION ALL
  SELECT sample_id, penalty, b + 1, n, s, q, list_append(cost, list_min(totals)), list_append(back, list_position(totals, list_min(totals))::BIGINT - 1)
  FROM (SELECT *, list_transform(range(0, b), lambda a: cost[a + 1] + q[b + 2] - q[a + 1] - (s[b + 2] - s[a + 1]) ** 2 / (b + 1 - a) + penalty) AS totals FROM best WHERE b < n)),
cut AS (
  SELECT sample_id, penalty, back, back[n + 1] AS start FROM best WHERE b = n
  UNION ALL SELECT sample_id, penalty, back, back[start + 1] FROM cut WHERE start > 0),
points AS (SELECT c.sample_id, c.penalty, row_number() OVER (PARTITION BY c.sample_id, c.penalty ORDER BY start) AS rank, start AS signal_index, ks[start + 1] AS k, ks[start + 1] * 1800.0::DOUBLE AS pred FROM cut c JOIN series USING (sample_id, penalty) WHERE start > 0)"""


def _penalized_sql(body: str) -> str:
    return _with("halfhours", "", True).rstrip() + ",\n" + _PENALIZED + "\n" + body


@_query("detect_penalized")
def detect_penalized(s, d):
    signal = _halfhours(s, d).withColumn("t", F.col("k") * HALF_HOUR)
    return detection.detect_penalized(signal, [1e3, 1e4, 1e5], DAY)


_SQL["detect_penalized"] = _penalized_sql("SELECT * FROM points")


@_query("penalty_summary")
def penalty_summary(s, d):
    return storage.penalty_summary(detect_penalized(s, d), DAY)


_SQL["penalty_summary"] = _penalized_sql("""SELECT sample_id, penalty, count(*)::INT AS num_change_points, string_agg(signal_index::VARCHAR, ' ' ORDER BY rank) AS change_point_indices, string_agg(k::VARCHAR, ' ' ORDER BY rank) AS change_point_k_samples,
string_agg(pred::VARCHAR, ' ' ORDER BY rank) AS change_point_t_seconds, string_agg((pred / 3600)::VARCHAR, ' ' ORDER BY rank) AS change_point_t_hours FROM points GROUP BY 1, 2""")


@_query("change_points_long")
def change_points_long(s, d):
    return storage.change_points_long(detect_penalized(s, d), DAY)


_SQL["change_points_long"] = _penalized_sql("SELECT sample_id, penalty, rank AS change_point_rank, signal_index, k AS k_sample, pred AS t_seconds, pred / 3600 AS t_hours FROM points")


def _scores_sql(keys: str, margin: float, cap: float | None = None, truth: str = "truth") -> str:
    """CTEs up to scored: scores of found(sample_id, keys, pred) for all runs(sample_id, keys)."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in ["sample_id", *keys.split(", ")])
    by = f"sample_id, {keys}"
    return f""", near_true AS (SELECT {", ".join(f"x.{k}" for k in by.split(", "))}, count(*) AS n_true, count(*) FILTER (WHERE d < {margin}) AS tp, max(d) AS a FROM (
    SELECT {", ".join(f"x.{k}" for k in by.split(", "))}, x.bkp, min(abs(x.bkp - y.pred)) AS d FROM (SELECT r.*, bkp FROM runs r JOIN {truth} USING (sample_id)) x LEFT JOIN found y ON {on} GROUP BY ALL) x GROUP BY ALL),
near_found AS (SELECT {by}, count(*) AS n_found, max(d) AS b FROM (SELECT f.*, (SELECT min(abs(t.bkp - f.pred)) FROM {truth} t WHERE t.sample_id = f.sample_id) AS d FROM found f) GROUP BY {by}),
scored AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, CASE WHEN n_true = 0 AND n_found = 0 THEN 0 WHEN n_true = 0 OR n_found = 0 THEN 'inf'::DOUBLE ELSE greatest(a, b) END AS hausdorff FROM (
  SELECT *, CASE WHEN n_found > 0 THEN tp / n_found ELSE 0 END AS p, CASE WHEN n_true > 0 THEN tp / n_true ELSE 0 END AS r FROM (
    SELECT r.*, coalesce(n_true, 0) AS n_true, coalesce(n_found, 0) AS n_found, coalesce(tp, 0) AS tp, a, b FROM runs r LEFT JOIN near_true USING ({by}) LEFT JOIN near_found USING ({by}))))"""


def _three_cuts_by_steps(keys: str, source: str) -> str:
    """The same least cost as of ``_three_cuts``, a cut at a time: series of thousands of points have too many triples.  Of equal costs the last cut."""
    by = keys.split(", ")
    on = " AND ".join(f"x.{k} = y.{k}" for k in by)
    cost = "x.cost + y.q - x.q - (y.s - x.s) ** 2 / (y.b - x.b)"
    named = ", ".join(f"y.{k}" for k in by)
    step = lambda before, where: f"""(SELECT *, w.cost AS cost FROM (SELECT {named}, y.n, y.b, any_value(y.s) AS s, any_value(y.q) AS q, min({{'cost': {cost}, 'a': -x.b}}) AS w
  FROM upto y JOIN {before} x ON {on} AND x.b <= y.b - 2 WHERE {where} GROUP BY ALL))"""  # noqa: E731
    return f""", series AS (SELECT {keys}, list(value ORDER BY k) AS v, list(t ORDER BY k) AS ts, count(*)::BIGINT AS n FROM {source} GROUP BY {keys}),
prefixes AS (SELECT *, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(v[1:i]), 0)) AS s, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(list_transform(v[1:i], lambda x: x * x)), 0)) AS q FROM series WHERE n >= 8),
upto AS MATERIALIZED (SELECT {keys}, n, unnest(range(0, n + 1)) AS b, unnest(s) AS s, unnest(q) AS q FROM prefixes),
cut0 AS MATERIALIZED (SELECT *, q - s ** 2 / b AS cost FROM upto WHERE b >= 2),
cut1 AS MATERIALIZED {step("cut0", "y.b >= 4")},
cut2 AS MATERIALIZED {step("cut1", "y.b >= 6")},
cut3 AS MATERIALIZED {step("cut2", "y.b = y.n")},
thirds AS (SELECT {keys}, -w.a AS c FROM cut3),
seconds AS (SELECT y.*, x.w FROM thirds y JOIN cut2 x ON {on} AND x.b = y.c),
firsts AS (SELECT {named}, y.c, -y.w.a AS b, -x.w.a AS a FROM seconds y JOIN cut1 x ON {on} AND x.b = -y.w.a),
found AS (SELECT {keys}, unnest([ts[a + 1], ts[b + 1], ts[c + 1]]) AS pred FROM firsts JOIN prefixes USING ({keys}))"""


@_query(
    "entropy_grid_search",
    "edges spans truth",
    _windows_sql() + ", runs AS (SELECT DISTINCT sample_id, lamda, width FROM signal)" + _three_cuts_by_steps("sample_id, lamda, width", "signal") + _scores_sql("lamda, width", HALF_HOUR) + "\nSELECT lamda, width AS \"window\", round(avg(f1), 6) AS mean_f1, round(avg(hausdorff), 6) AS mean_hausdorff FROM scored GROUP BY 1, 2",
)
def entropy_grid_search(s, d):
    """Change points of the signals of all windows."""
    signals = _window_signals(s, d, keep=True)
    means = pipelines.grid_search(signals, _scored(s, d)[1], _n_bkps(s, d), ["lamda", "window"], HALF_HOUR)[0]
    return means.select("lamda", "window", _r("mean_f1"), _r("mean_hausdorff"))


@_query("entropy_penalty_search")
def entropy_penalty_search(s, d):
    signals = _window_signals(s, d, fraction=0.1)
    return pipelines.penalty_search(signals, _scored(s, d)[1], [0.01, 0.1, 1.0], ["lamda", "window"], HALF_HOUR)[0]


@_query("entropy_test_evaluation")
def entropy_test_evaluation(s, d):
    """Parameters chosen on even days, scored on odd days."""
    signals, truth, n = storage.kept(_window_signals(s, d, fraction=0.1)), storage.kept(_scored(s, d)[1]), storage.kept(_n_bkps(s, d))
    keys = ["lamda", "window"]
    best = pipelines.grid_search(signals.where("sample_id % 2 = 0"), truth, n, keys, HALF_HOUR)[1]
    out = pipelines.test_evaluation(signals.where("sample_id % 2 = 1"), best, truth, n, keys, HALF_HOUR)
    return out.select("sample_id", *keys, "n_true", "n_found", "tp", _r("f1"), _r("hausdorff"))


_SQL["entropy_test_evaluation"] = (
    _with("edges spans truth", _windows_sql(True) + ", runs AS (SELECT DISTINCT sample_id, lamda, width FROM signal)" + _three_cuts("sample_id, lamda, width", "signal") + _scores_sql("lamda, width", HALF_HOUR))
    + """, chosen AS (SELECT lamda, width FROM scored WHERE sample_id % 2 = 0 GROUP BY 1, 2 ORDER BY avg(hausdorff), lamda, width LIMIT 1)
SELECT sample_id, lamda, width AS "window", n_true, n_found, tp, round(f1, 6) AS f1, round(hausdorff, 6) AS hausdorff FROM scored JOIN chosen USING (lamda, width) WHERE sample_id % 2 = 1"""
)


@_query("frobenius_grid_search")
def frobenius_grid_search(s, d):
    """Snapshots that follow an empty one have no finite distance and are no part of the series."""
    signals = pipelines.frobenius_signals(_snaps(s, d), _bins(s, d), [1, 2, 3])
    finite = signals.where("not isnan(value) and value < double('infinity')")
    truth = _scored(s, d)[1].withColumn("bkp", F.floor(F.col("bkp") / HALF_HOUR).cast("double"))
    means = pipelines.grid_search(finite, truth, _n_bkps(s, d), ["window_length"], 1.0, cap=48.0)[0]
    return means.select("window_length", _r("mean_f1"), _r("mean_hausdorff"))


_SQL["frobenius_grid_search"] = (
    _with("snaps bins truth", "").rstrip()
    + ", cnt AS (SELECT b.sample_id, b.bin, count(s.i) AS n FROM bins b LEFT JOIN snaps s ON s.sample_id = b.sample_id AND s.bin = b.bin GROUP BY 1, 2)"
    + ", signal AS (SELECT *, k::DOUBLE AS t FROM ("
    + " UNION ALL ".join(f"SELECT *, {w} AS window_length FROM ({_FROB.replace('a.bin - 3', f'a.bin - {w}').replace('x.bin - 3', f'x.bin - {w}').replace('count(*) = 3', f'count(*) = {w}')})" for w in (1, 2, 3))
    + ") WHERE NOT isnan(value) AND NOT isinf(value)), runs AS (SELECT DISTINCT sample_id, window_length FROM signal), binned AS (SELECT sample_id, floor(bkp / 1800) AS bkp FROM truth)"
    + _three_cuts("sample_id, window_length", "signal")
    + _scores_sql("window_length", 1.0, truth="binned")
    + "\nSELECT window_length, round(avg(f1), 6) AS mean_f1, round(avg(least(hausdorff, 48.0)), 6) AS mean_hausdorff FROM scored GROUP BY 1"
)


@_query("spectrum_grid_search")
def spectrum_grid_search(s, d):
    """Laplacian spectra: the n largest scores are the change points."""
    signals = pipelines.spectrum_signals(_packed_snaps(s, d), [3, 6], [2, 4], scale=2.0)
    keys = ["n_eigen", "window_length"]
    found = series.top_positions(signals, 3, ["sample_id", *keys]).select(*keys, "sample_id", F.col("t").alias("pred"))
    truth = _scored(s, d)[1].withColumn("bkp", F.floor(F.col("bkp") / HALF_HOUR).cast("double"))
    return scores.mean_scores(scores.evaluate(signals.select(*keys, "sample_id").distinct(), truth, found, keys, 1.0), keys)


@_query("laplacian_signatures")
def laplacian_signatures(s, d):
    found = detection.laplacian_signatures(_packed_snaps(s, d), 6)
    return found.select("sample_id", "bin", F.posexplode("signature").alias("n", "value")).select("sample_id", "bin", F.col("n").cast("long").alias("n"), _r("value"))


_SNAP_MATRICES = f""", every AS (SELECT sample_id, bin, coalesce(a, list_transform(range(20), lambda i: list_transform(range(20), lambda j: 0.0::DOUBLE))) AS a, coalesce(d, list_transform(range(20), lambda i: 0.0::DOUBLE)) AS d FROM bins LEFT JOIN adjm USING (sample_id, bin))"""


def _top_values(n: int) -> str:
    """CTEs up to spectra(sample_id, bin, vals): the n greatest eigenvalues of each Laplacian, with their multiplicities."""
    parts, last = [], "(SELECT sample_id, bin, list_transform(range(1, 21), lambda x: list_transform(range(1, 21), lambda y: (x = y)::DOUBLE * d[x] - a[x][y])) AS m, []::DOUBLE[] AS vals FROM every)"
    for i in range(n):
        parts.append(K.squared(f"sq{i}", f"(SELECT *, m AS b FROM {last})"))
        # a projector over its trace: its squares add up to one over the multiplicity
        times = "greatest(1, round(1 / list_sum(list_transform(b, lambda r: list_dot_product(r, r)))))"
        parts.append(
            f"def{i} AS MATERIALIZED (SELECT sample_id, bin, CASE WHEN s IS NULL THEN m ELSE list_transform(range(1, 21), lambda x: list_transform(range(1, 21), lambda y: m[x][y] - exp(s) * {times} * b[x][y])) END AS m, "
            f"list_concat(vals, CASE WHEN s IS NULL THEN [0.0::DOUBLE] ELSE list_transform(range({times}::BIGINT), lambda x: exp(s)) END) AS vals FROM sq{i})"
        )
        last = f"def{i}"
    return ",\n".join(parts) + f",\nspectra AS (SELECT sample_id, bin, vals[1:{n}] AS vals FROM {last})"


_SQL["laplacian_signatures"] = (
    _with("snaps bins", "").rstrip() + ",\n" + K.adjacency("adjm", "snaps", "sample_id, bin") + _SNAP_MATRICES + ",\n" + _top_values(6)
    + "\nSELECT sample_id, bin, n, round(CASE WHEN len2 > 0 THEN v / len2 ELSE 0 END, 6) + 0.0 AS value FROM (SELECT sample_id, bin, sqrt(list_dot_product(vals, vals)) AS len2, unnest(vals) AS v, unnest(range(6)) AS n FROM spectra)"
)


@_query("laplacian_spectrum_signal")
def laplacian_spectrum_signal(s, d):
    return detection.spectrum_signal(detection.laplacian_signatures(_packed_snaps(s, d), 6), 3, 6, difference=True)


@_query("laplacian_spectrum_signal_low")
def laplacian_spectrum_signal_low(s, d):
    return detection.spectrum_signal(detection.laplacian_signatures(_packed_snaps(s, d), 6, normalized=True, top=False), 3)


@_query("procrustes_signal")
def procrustes_signal(s, d):
    return detection.procrustes_signal(_packed_snaps(s, d), 3)


def _sides(share: str) -> str:
    """Mean cells of the windows of 4 before and after each snapshot; share: which of them by their place."""
    return f"""(SELECT k.sample_id, k.bin, coalesce(x.i, 0) AS i, coalesce(x.j, 1) AS j, coalesce(sum(CASE WHEN x.bin IS NULL THEN 0 WHEN x.bin >= k.bin THEN 1.0 ELSE -1.0 END), 0) / {{0}} AS v FROM inner_bins k
  LEFT JOIN snaps x ON x.sample_id = k.sample_id AND x.bin BETWEEN k.bin - 4 AND k.bin + 3 AND {share} GROUP BY ALL)"""


_INNER_BINS = ", inner_bins AS (SELECT sample_id, bin FROM bins JOIN (SELECT sample_id, count(*) AS n FROM bins GROUP BY 1) USING (sample_id) WHERE bin BETWEEN 4 AND n - 4)"


@_query(
    "cumulative_sum_signal",
    "snaps bins",
    _INNER_BINS
    + f""", even AS {_sides("(x.bin - k.bin + 4) % 2 = 0").format(2)}, odd AS {_sides("(x.bin - k.bin + 4) % 2 = 1").format(2)},
found AS (SELECT e.sample_id, e.bin, sum(e.v * o.v) AS dot FROM even e JOIN odd o USING (sample_id, bin, i, j) GROUP BY 1, 2),
sizes AS (SELECT sample_id, bin, (SELECT sum(v * v) FROM even e WHERE e.sample_id = b.sample_id AND e.bin = b.bin) AS x, (SELECT sum(v * v) FROM odd o WHERE o.sample_id = b.sample_id AND o.bin = b.bin) AS y FROM inner_bins b)
SELECT b.sample_id, b.bin, round(CASE WHEN x * y > 0 THEN coalesce(dot, 0) / sqrt(x * y) ELSE 0 END, 6) + 0.0 AS value FROM bins b LEFT JOIN sizes USING (sample_id, bin) LEFT JOIN found USING (sample_id, bin)""",
)
def cumulative_sum_signal(s, d):
    return detection.cumulative_sum_signal(_packed_snaps(s, d), 4).select("sample_id", "bin", (F.round("value", 6) + 0.0).alias("value"))


_SQL["spectral_norm_signal"] = (
    _with("snaps bins", "").rstrip() + _INNER_BINS
    + f""", change AS {_sides("true").format(4)},
dense AS (SELECT sample_id, bin, list_transform(range(20), lambda x: list_transform(range(20), lambda y: coalesce(list_sum(list_transform(c, lambda z: CASE WHEN z.i = x AND z.j = y OR z.i = y AND z.j = x THEN z.v ELSE 0 END)), 0))) AS m FROM (SELECT sample_id, bin, list({{'i': i, 'j': j, 'v': v}}) AS c FROM change GROUP BY 1, 2)),
"""
    + K.squared("top", f"(SELECT sample_id, bin, {K.product('m', 'm')} AS b FROM dense)")
    + "\nSELECT b.sample_id, b.bin, round(CASE WHEN s IS NULL THEN 0 ELSE exp(s / 2) END, 6) AS value FROM bins b LEFT JOIN top USING (sample_id, bin)"
)


@_query("spectral_norm_signal", None, None)
def spectral_norm_signal(s, d):
    return detection.spectral_norm_signal(_packed_snaps(s, d), 4).select("sample_id", "bin", _r("value"))


@_query("spectral_clustering_signal")
def spectral_clustering_signal(s, d):
    return detection.spectral_clustering_signal(_packed_snaps(s, d), 4, 3)


@_query("spectral_gaps")
def spectral_gaps(s, d):
    return detection.graph_spectra(_packed_snaps(s, d))


@_query("laplacian_embeddings")
def laplacian_embeddings(s, d):
    return detection.node_embeddings(_packed_snaps(s, d), 3)


@_query(
    "walk_profiles",
    "snaps bins",
    ",\n" + K.adjacency("adjm", "snaps", "sample_id, bin") + _SNAP_MATRICES + f""",
steps AS (SELECT sample_id, bin, list_transform(range(1, 21), lambda x: list_transform(range(1, 21), lambda y: d[x] * a[x][y])) AS m FROM every),
both_ AS (SELECT *, {K.transposed("m")} AS mt FROM steps),
powers AS (SELECT sample_id, bin, m, {K.product("m", "mt")} AS m2, mt FROM both_),
third AS (SELECT *, {K.product("m2", "mt")} AS m3 FROM powers)
SELECT sample_id, bin, node, power, CASE power WHEN 1 THEN m[node + 1][node + 1] WHEN 2 THEN m2[node + 1][node + 1] ELSE m3[node + 1][node + 1] END AS value FROM third, range(0, 20) x(node), range(1, 4) y(power)""",
)
def walk_profiles(s, d):
    found = detection.node_embeddings(_packed_snaps(s, d), 3, "walks")
    return found.select("sample_id", "bin", "node", F.posexplode("vec").alias("power", "value")).select("sample_id", "bin", "node", (F.col("power") + 1).cast("long").alias("power"), "value")


@_query(
    "subspace_distances",
    "",
    """WITH e AS (SELECT label::BIGINT AS label, vec_id % 4 AS r, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS place FROM embeddings),
planes AS (SELECT label, r % 2 AS side, place, coalesce(avg(x) FILTER (WHERE r < 2), 0) AS u, coalesce(avg(x) FILTER (WHERE r >= 2), 0) AS w FROM e GROUP BY 1, 2, 3),
gram AS (SELECT label, side, sum(u * u) AS uu, sum(u * w) AS uw, sum(w * w) AS ww FROM planes GROUP BY 1, 2),
mixed AS (SELECT p.label, sum(p.u * q.u) AS a, sum(p.u * q.w) AS b, sum(p.w * q.u) AS c, sum(p.w * q.w) AS d FROM planes p JOIN planes q ON q.label = p.label AND q.place = p.place AND p.side = 0 AND q.side = 1 GROUP BY 1),
inverse AS (SELECT label, side, ww / (uu * ww - uw * uw) AS x, -uw / (uu * ww - uw * uw) AS y, uu / (uu * ww - uw * uw) AS z FROM gram)
SELECT label, round(sqrt(greatest(0, 2 - (
  g.x * (a * a * h.x + 2 * a * b * h.y + b * b * h.z) + 2 * g.y * (a * c * h.x + (a * d + b * c) * h.y + b * d * h.z) + g.z * (c * c * h.x + 2 * c * d * h.y + d * d * h.z)))), 6) AS distance
FROM mixed JOIN inverse g USING (label) JOIN inverse h USING (label) WHERE g.side = 0 AND h.side = 1""",
)
def subspace_distances(s, d):
    """Planes of each label's mean vectors: ids of remainder 0 and 2 by four against those of 1 and 3."""
    e = _table(s, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.pmod("vec_id", F.lit(4)).alias("r"), F.posexplode("embedding").alias("row", "x"))
    mean = lambda upper: F.coalesce(F.avg(F.when((F.col("r") >= 2) == upper, F.col("x").cast("double"))), F.lit(0.0))
    planes = e.groupBy("label", F.pmod("r", F.lit(2)).alias("side"), "row").agg(F.array(mean(False), mean(True)).alias("vec"))
    return detection.subspace_distances(planes, "label", "projection").select("label", _r("distance"))


@_query(
    "balanced_pairs",
    "halfhours",
    """, items AS (SELECT sample_id * 48 + k AS k, label FROM """
    + _LABELLED
    + """), near AS (SELECT y.k AS a, x.k AS b, y.label = x.label AS same FROM items x JOIN items y ON y.k BETWEEN x.k - 10 AND x.k - 1)
SELECT a, b, same FROM (SELECT *, row_number() OVER (PARTITION BY same ORDER BY md5('0|' || a || '|' || b), a, b) AS n FROM near) WHERE n <= 100""",
)
def balanced_pairs(s, d):
    labels = _labelled(s, d).select((F.col("sample_id") * 48 + F.col("k")).alias("k"), "label")
    return detection.balanced_pairs(labels, 100, reach=10)


@_query(
    "interval_integral",
    "edges spans truth",
    _of_intervals()
    + _PARTS_OF_DAYS
    + """, pieces AS MATERIALIZED (SELECT m.sample_id, interval, lamda, k, tau, p, q FROM mats m JOIN ranges g ON g.sample_id = m.sample_id AND k >= g.a AND k < g.b),
"""
    + K.running("run", "pieces", _BY_INTERVAL)
    + f""",
terms AS (SELECT sample_id, interval, lamda, tau, unnest(g) AS r, unnest(range(20)) AS i FROM (SELECT *, {K.product("h", "p")} AS g FROM (SELECT *, list_transform(p, lambda r: list_transform(range(1, 21), lambda x: r[x] / 400 / (list_sum(q[x]) / 20))) AS h FROM run)))
SELECT sample_id, interval, lamda, i, j, round(sum(tau * v) / sum(tau) - 1.0 / 400, 7) + 0.0 AS v FROM (SELECT sample_id, interval, lamda, tau, i, unnest(r) AS v, unnest(range(20)) AS j FROM terms) GROUP BY 1, 2, 3, 4, 5""",
)
def interval_integral(s, d):
    """Flow integrals of the intervals between change points, as cells."""
    grid, packed = _packed(s, d)
    auto = clustering.interval_autocovariance(packed, clustering.intervals_between(_cuts(s, d, grid), grid), RATES)
    return auto.select(*_BY_INTERVAL, "i", "j", (F.round("v", 7) + 0.0).alias("v"))


@_query("interval_communities")
def interval_communities(s, d):
    grid, packed = _packed(s, d)
    ranges = clustering.intervals_between(_cuts(s, d, grid), grid)
    auto = clustering.interval_autocovariance(packed, ranges, RATES)
    return clustering.communities(auto, _all_cohorts(s, d), range(4), _BY_INTERVAL)


@_query("prepared_integral")
def prepared_integral(s, d):
    grid, packed = _packed(s, d)
    ranges = clustering.intervals_between(_cuts(s, d, grid), grid)
    auto = clustering.interval_autocovariance(packed, ranges, RATES)
    return clustering.prepared_integral(auto, _BY_INTERVAL, 2.0, 0.05, largest_component=True)


@_query("interval_summary")
def interval_summary(s, d):
    return clustering.summarize(interval_communities(s, d), _BY_INTERVAL)


@_query("static_communities")
def static_communities(s, d):
    return clustering.static_communities(_adj(s, d), _all_cohorts(s, d))


# nations of a region trade with each other: communities are known to be the regions
_TRADE = "trade AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_regionkey AS region, (a.n + b.n)::DOUBLE AS v FROM sizes a JOIN sizes b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey)"
_REGIONS = f"WITH sizes AS (SELECT n_nationkey, n_regionkey, count(c_custkey) + 1 AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2), {_TRADE}"
_REGION_STABILITY = "(SELECT round(1 - sum(p * p), 6) FROM (SELECT region, sum(v) / (SELECT sum(v) FROM trade) AS p FROM trade GROUP BY 1))"


def _trade(s, d) -> DataFrame:
    sizes = _table(s, d, "nation").join(_table(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg((F.count("c_custkey") + 1).alias("n"))
    a = sizes.select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").alias("region"), F.col("n").alias("x"))
    b = sizes.select(F.col("n_nationkey").cast("long").alias("j"), F.col("n_regionkey").alias("region"), F.col("n").alias("y"))
    return a.join(b, "region").where("i != j").select(F.lit(0).cast("long").alias("sample_id"), "i", "j", (F.col("x") + F.col("y")).cast("double").alias("v"))


def _nations(s) -> DataFrame:
    return s.createDataFrame([(0, 25)], "sample_id long, n_nodes int")


def _named(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters by their least node."""
    return frame.withColumn("cluster", F.min("node").over(Window.partitionBy(*keys, "cluster")))


def _trade_covariance(s, d) -> DataFrame:
    trade = _trade(s, d)
    total = trade.groupBy("sample_id").agg(F.sum("v").alias("all"))
    p = graph.degrees(trade, DAY).join(total, "sample_id").select("sample_id", F.col("i").alias("node"), (F.col("degree") / F.col("all")).alias("d"))
    return cells.autocovariance(graph.random_walk_matrix(trade, DAY), p, DAY)


@_query("region_communities", "", f"{_REGIONS} SELECT run, n_nationkey::BIGINT AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey, run)::BIGINT AS cluster, {_REGION_STABILITY} AS stability FROM sizes, range(0, 4) r(run)")
def region_communities(s, d):
    """Seeded Louvain runs on the autocovariance of one step of a walk along the trade."""
    runs = clustering.communities(_trade_covariance(s, d), _nations(s), range(4), DAY)
    return _named(runs, ["run"]).select("run", "node", "cluster", _r("stability"))


@_query("region_static_communities", "", f"{_REGIONS} SELECT n_nationkey::BIGINT AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey)::BIGINT AS cluster, {_REGION_STABILITY} AS stability FROM sizes")
def region_static_communities(s, d):
    found = clustering.static_communities(_trade(s, d), _nations(s), kind="discrete")
    return _named(found, DAY).select("node", "cluster", _r("stability"))


@_query("region_summary", "", f"{_REGIONS} SELECT {_REGION_STABILITY} AS best_stability, {_REGION_STABILITY} AS avg_stability, count(DISTINCT n_regionkey)::DOUBLE AS avg_clusters, 0.0::DOUBLE AS avg_nvi FROM sizes")
def region_summary(s, d):
    runs = clustering.communities(_trade_covariance(s, d), _nations(s), range(4), DAY)
    return clustering.summarize(runs, DAY).select(_r("best_stability"), _r("avg_stability"), "avg_clusters", (F.round("avg_nvi", 6) + 0.0).alias("avg_nvi"))


@_query("region_best_partition", "", f"{_REGIONS} SELECT n_nationkey::BIGINT AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey)::BIGINT AS cluster FROM sizes")
def region_best_partition(s, d):
    runs = clustering.communities(_trade_covariance(s, d), _nations(s), range(4), DAY)
    return _named(clustering.best_partition(runs, DAY), DAY).select("node", "cluster")


# customers whose orders are near each other, more so within a region: a network of all customers that is not made of cliques
_ORDER_LINKS = """WITH placed AS (SELECT o_orderkey, o_custkey AS node, n_regionkey AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
one AS (SELECT a.node AS i, b.node AS j, CASE WHEN a.region = b.region THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END AS v
  FROM (SELECT *, o_orderkey + unnest(range(1, 13)) AS later FROM placed) a JOIN placed b ON b.o_orderkey = a.later WHERE a.node <> b.node),
links AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM one UNION ALL SELECT j, i, v FROM one) GROUP BY 1, 2),
strength AS (SELECT i AS node, sum(v) / (SELECT sum(v) FROM links) AS p FROM links GROUP BY 1),
joint AS (SELECT i, j, v / (SELECT sum(v) FROM links) AS v FROM links),
grouped AS (SELECT DISTINCT node, region FROM placed)"""


_REACH_OF_ORDERS, _SHELF = 12, 4096


def _order_pairs(s, d) -> DataFrame:
    """Near orders of two customers, both ways, repeats included.

    Orders stand on shelves of 4,096 keys; the first 12 of a shelf also stand at the end of the
    one before, where they begin no pair.  So orders are shuffled once and meet in a range frame.
    """
    homes = _table(s, d, "customer").join(_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("node"), F.col("n_regionkey").cast("long").alias("region"))
    placed = _table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("node")).join(homes, "node")
    shelf = F.floor(F.col("o_orderkey") / _SHELF)
    before = F.floor((F.col("o_orderkey") - _REACH_OF_ORDERS) / _SHELF)
    shelved = placed.select("o_orderkey", F.struct("node", "region").alias("o"), F.explode(F.array_distinct(F.array(shelf, before))).alias("shelf"))
    later = F.collect_list("o").over(Window.partitionBy("shelf").orderBy("o_orderkey").rangeBetween(1, _REACH_OF_ORDERS))
    near = shelved.select("o_orderkey", "shelf", "o", later.alias("later")).where(shelf == F.col("shelf"))
    pairs = near.select(F.col("o.node").alias("i"), F.col("o.region").alias("_r"), F.explode("later").alias("x")).where("i != x.node")
    one = pairs.select(F.lit(0).cast("long").alias("sample_id"), "i", F.col("x.node").alias("j"), F.when(F.col("_r") == F.col("x.region"), 20.0).otherwise(1.0).alias("v"))
    return graph.both_ways(one, DAY)


def _order_covariance(s, d) -> tuple[DataFrame, DataFrame, lowrank.LowRank]:
    """(links, p, autocovariance) of the network of orders.

    Strengths are sums over repeated pairs, which need no links; they are kept, since all parts ask
    for them.  Links are dealt by their first node, so that their sums and the walk need one
    shuffle; the walk is undirected, so links over their total are diag(p) T, and p T is p.
    """
    strength = storage.kept(graph.degrees(_order_pairs(s, d), DAY))
    total = strength.groupBy(*DAY).agg(F.sum("degree").alias("all"))
    p = strength.join(F.broadcast(total), DAY).select(*DAY, F.col("i").alias("node"), (F.col("degree") / F.col("all")).alias("d"))
    links = _order_pairs(s, d).repartition("i").groupBy(*DAY, "i", "j").agg(F.sum("v").alias("v"))
    return links, p, lowrank.undirected(links, p, total, DAY)


def _order_blocks(p: DataFrame) -> DataFrame:
    return p.select(*DAY, "node", F.pmod("node", F.lit(7)).alias("cluster"))


@_query("order_covariance_blocks", "", f"""{_ORDER_LINKS} SELECT i, j, round(sum(v), 9) + 0.0 AS v FROM (
  SELECT i % 7 AS i, j % 7 AS j, v FROM joint UNION ALL SELECT a.b, c.b, -a.p * c.p FROM (SELECT node % 7 AS b, sum(p) AS p FROM strength GROUP BY 1) a, (SELECT node % 7 AS b, sum(p) AS p FROM strength GROUP BY 1) c) GROUP BY 1, 2""")
def order_covariance_blocks(s, d):
    """Autocovariance of all customers, contracted without its n^2 cells."""
    _, p, covariance = _order_covariance(s, d)
    return lowrank.to_cells(lowrank.contract(covariance, _order_blocks(p))).select("i", "j", (F.round("v", 9) + 0.0).alias("v"))


@_query("order_forward_blocks", "", f"""{_ORDER_LINKS}, half AS (SELECT i % 7 AS b, j, sum(v) AS v FROM joint GROUP BY 1, 2), sums AS (SELECT node % 7 AS b, sum(p) AS p FROM strength GROUP BY 1)
SELECT i, j, round(sum(v), 9) + 0.0 AS v FROM (SELECT x.b AS i, y.b AS j, x.v * y.v / p AS v FROM half x JOIN half y USING (j) JOIN strength ON node = x.j UNION ALL SELECT a.b, c.b, -a.p * c.p FROM sums a, sums c) GROUP BY 1, 2""")
def order_forward_blocks(s, d):
    links, p, _ = _order_covariance(s, d)
    return lowrank.to_cells(lowrank.forward_blocks(graph.random_walk_matrix(links, DAY), p, _order_blocks(p), DAY, p)).select("i", "j", (F.round("v", 9) + 0.0).alias("v"))


@_query("order_covariance_total", "", f"""{_ORDER_LINKS} SELECT round((SELECT sum(v) FROM joint WHERE i % 2 = 0 AND j % 3 = 0)
  - (SELECT sum(p) FROM strength WHERE node % 2 = 0) * (SELECT sum(p) FROM strength WHERE node % 3 = 0), 9) + 0.0 AS total""")
def order_covariance_total(s, d):
    """Sum of the rows of some customers and the columns of others."""
    _, p, covariance = _order_covariance(s, d)
    covariance = covariance._replace(cells=covariance.cells.where("i % 2 = 0 and j % 3 = 0"))  # no other cell is in the sum
    return lowrank.block_total(covariance, p.where("node % 2 = 0"), p.where("node % 3 = 0")).select((F.round("total", 9) + 0.0).alias("total"))


@_query("order_covariance_elements", "", f"{_ORDER_LINKS} SELECT a.node AS i, a.node + 1 AS j, round(coalesce(v, 0) - a.p * b.p, 9) + 0.0 AS v FROM strength a JOIN strength b ON b.node = a.node + 1 LEFT JOIN joint ON i = a.node AND j = a.node + 1")
def order_covariance_elements(s, d):
    """The cells of each customer and the next one."""
    _, p, covariance = _order_covariance(s, d)
    pairs = p.select(*DAY, F.col("node").alias("i"), (F.col("node") + 1).alias("j")).join(p.select(*DAY, F.col("node").alias("j")), [*DAY, "j"], "left_semi")
    covariance = covariance._replace(cells=covariance.cells.where("j = i + 1"))  # no other cell is asked for
    return lowrank.elements(covariance, pairs).select("i", "j", (F.round("v", 9) + 0.0).alias("v"))


@_query("order_communities", "", f"""{_ORDER_LINKS} SELECT node, min(node) OVER (PARTITION BY region) AS cluster,
  round((SELECT sum(v) FROM joint JOIN grouped a ON a.node = i JOIN grouped b ON b.node = j WHERE a.region = b.region) - (SELECT sum(p * p) FROM (SELECT sum(p) AS p FROM strength JOIN grouped USING (node) GROUP BY region)), 6) AS stability
FROM strength JOIN grouped USING (node)""")
def order_communities(s, d):
    """Louvain over the edges of all customers; regions are planted."""
    found = lowrank.communities(_order_covariance(s, d)[2])
    return found.select("node", "cluster", _r("stability"))


@_query(
    "matched_clusters",
    "many",
    """, sims AS (SELECT x.cluster AS a, y.cluster AS b, count(*) AS v FROM many x JOIN many y ON x.node = y.node AND x.run = 0 AND y.run = 1 GROUP BY 1, 2),
grid5 AS (SELECT a, b, coalesce(v + sqrt(5 * a + b + 2) / 1000, 0) AS v FROM (SELECT a, b FROM range(0, 5) x(a), range(0, 5) y(b)) LEFT JOIN sims USING (a, b)),
ways AS (SELECT [p0.b, p1.b, p2.b, p3.b, p4.b] AS w, p0.v + p1.v + p2.v + p3.v + p4.v AS total FROM grid5 p0, grid5 p1, grid5 p2, grid5 p3, grid5 p4
  WHERE p0.a = 0 AND p1.a = 1 AND p2.a = 2 AND p3.a = 3 AND p4.a = 4 AND len(list_distinct([p0.b, p1.b, p2.b, p3.b, p4.b])) = 5)
SELECT 0 AS g, unnest(range(0, 5)) AS a, unnest(w) AS b FROM (SELECT arg_max(w, total) AS w FROM ways)""",
)
def matched_clusters(s, d):
    many = _many(s, d)
    table = partitions.contingency(many.where("run = 0").drop("run"), many.where("run = 1").drop("run"), ["g"])
    # a small share by the numbers themselves, so that no two ways are equally good
    return clustering.match_clusters(table.select("g", "a", "b", (F.col("n") + F.sqrt(5 * F.col("a") + F.col("b") + 2) / 1000).alias("v")), ["g"])


@_query(
    "toy_cycle_entropy",
    "",
    "WITH edges AS (SELECT 0::BIGINT AS sample_id, k, least(k, (k + 1) % 3) AS i, greatest(k, (k + 1) % 3) AS j FROM range(0, 3) r(k)),\n"
    + K.adjacency("adjm", "edges", "sample_id, k")
    + ",\nrated AS (SELECT sample_id, k, a, d, lamda, lamda AS t FROM adjm, (VALUES (1.0::DOUBLE), (10.0::DOUBLE)) r(lamda)),\n"
    + K.heat("kern", "rated")
    + ",\nmats AS MATERIALIZED (SELECT sample_id, lamda, k, e AS p, e AS q FROM kern),\n"
    + K.running("run", "mats", _BY_RATE, 3)
    + f"\nSELECT sample_id, lamda, k, (k + 1)::DOUBLE AS t, round({K.entropy('p', 3)}, 6) AS entropy FROM run",
)
def toy_cycle_entropy(s, d):
    _, packed = pipelines.prepare(generators.cycle(s))
    return _entropies(transitions.running_entropy(packed, [1.0, 10.0]))


@_query("generated_structure_change")
def generated_structure_change(s, d):
    return generators.structure_change(s, 4, lambda seed: 80.0 + seed % 40, density=10.0)


@_query("generated_activity_changes")
def generated_activity_changes(s, d):
    return generators.activity_changes(s, 4, lambda seed: (60.0 + seed % 20, 130.0), densities=(10.0, 20.0))


@_query("generated_motif")
def generated_motif(s, d):
    return generators.motif(s, "merge_split", density=5.0)


@_query("simulated_agents")
def simulated_agents(s, d):
    """Agents that pause, meet and part, a sample a task."""
    return generators.simulated(s, 4, n=40, per_group=10, until=50.0, mean_pause=5.0, mean_contact=2.0)


_DRAW = "('0x' || md5({0})[1:12])::BIGINT"


@_query("generated_block_features", "", f"""SELECT id AS node, block, round(mean + sqrt(-2 * ln(({_DRAW.format("'0|' || id")} + 0.5) / 281474976710656)) * cos(2 * pi() * ({_DRAW.format("'1|' || id")} + 0.5) / 281474976710656), 6) AS x
FROM (SELECT id, (id >= 30)::INT + (id >= 60)::INT AS block, CASE WHEN id < 30 THEN 0 WHEN id < 60 THEN 1 ELSE -1 END AS mean FROM range(0, 100) r(id))""")
def generated_block_features(s, d):
    return generators.block_features(s, [30, 30, 40], [0.0, 1.0, -1.0]).select("node", "block", _r("x"))


@_query("generated_block_graph")
def generated_block_graph(s, d):
    return generators.block_graph(s, [30, 30, 40], 0.3, 0.02)


# ---- stored relations ---------------------------------------------------------------------------------
def _folder(s, name: str) -> str:
    """A new folder in the shared directory of the session, for a relation that is written and read back."""
    import uuid

    return f"{storage.shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@_query("stored_network", "contacts", "SELECT sample_id, event_id, src, dst, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM contacts")
def stored_network(s, d):
    """Events saved, saved again (which keeps them) and loaded."""
    folder, contacts_ = _folder(s, "network"), ev.contacts(s, d)
    storage.save_network(folder, events=contacts_)
    storage.save_network(folder, events=contacts_.limit(0))
    return storage.load_network(s, folder, ["events"])["events"].select("sample_id", "event_id", "src", "dst", _r("t_start"), _r("t_end"))


@_query("stored_transitions", "contacts", f"SELECT sample_id, 0.5::DOUBLE AS lamda, k, i, j, round(v, 6) AS v FROM {_HOURLY}")
def stored_transitions(s, d):
    """Matrices of two rates saved by rate; one of them loaded."""
    folder, hourly = _folder(s, "transitions"), _hourly(s, d)
    both = hourly.withColumn("lamda", F.lit(0.5)).unionByName(hourly.withColumns({"v": F.col("v") * 2, "lamda": F.lit(2.0)}))
    storage.save_transitions(both, folder)
    return storage.load_transitions(s, folder, 0.5).select("sample_id", "lamda", "k", "i", "j", _r("v"))


@_query("stored_deltas", "contacts", f"SELECT sample_id, k, i, j, round(v, 6) AS v FROM {_HOURLY}")
def stored_deltas(s, d):
    """Matrices saved as changes, loaded as running sums, read as of each stored matrix."""
    folder, hourly = _folder(s, "deltas"), _hourly(s, d).withColumn("lamda", F.lit(1.0))
    storage.save_transitions(hourly, folder, as_deltas=True)
    back = storage.load_transitions(s, folder, 1.0, as_deltas=True)
    asked = hourly.select("sample_id", "k", "i", "j").withColumns({"v": F.lit(None).cast("double"), "q": F.lit(1)})
    both = back.select("sample_id", "k", "i", "j", "v", F.lit(0).alias("q")).unionByName(asked)
    last = F.last("v", ignorenulls=True).over(Window.partitionBy("sample_id", "i", "j").orderBy("k", "q"))
    return both.withColumn("v", last).where("q = 1").select("sample_id", "k", "i", "j", _r("v"))


@_query("stored_signal", "halfhours", "SELECT sample_id, 0.1::DOUBLE AS lamda, 60.0::DOUBLE AS window, 'reverse' AS direction, k, round(-value, 6) AS value FROM halfhours")
def stored_signal(s, d):
    """Signals of two rates and directions saved; one loaded."""
    folder, base = _folder(s, "signals"), _halfhours(s, d)
    kinds = [(0.1, "forward", 1.0), (0.1, "reverse", -1.0), (1.0, "forward", 2.0)]
    parts = [base.select("sample_id", F.lit(r).alias("lamda"), F.lit(60.0).alias("window"), F.lit(n).alias("direction"), "k", (F.col("value") * f).alias("value")) for r, n, f in kinds]
    storage.save_signals(parts[0].unionByName(parts[1]).unionByName(parts[2]), folder)
    return storage.load_signal(s, folder, 0.1, 60.0, reverse=True).select("sample_id", "lamda", "window", "direction", "k", _r("value"))
