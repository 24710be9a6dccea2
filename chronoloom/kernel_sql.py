"""SQL that tells what the numerical kernels compute, with matrices as lists of rows.

Written for checks on small tables: networks of up to ``N`` nodes, exponentials as scaled Taylor
sums, running products by doubling, spectra by repeated squaring.
"""

from __future__ import annotations

N = 20
#: doublings of a range of intervals, and of a window
LEVELS, WINDOW_LEVELS = 14, 11

_EYE = f"list_transform(range({N}), lambda i: list_transform(range({N}), lambda j: (i = j)::DOUBLE))"


def product(a: str, columns: str) -> str:
    """A B from A's rows and B's columns."""
    return f"list_transform({a}, lambda r: list_transform({columns}, lambda c: list_dot_product(r, c)))"


def cells(source: str, keys: str, matrix: str = "p", where: str = "v > 1e-6") -> str:
    rows = f"SELECT {keys}, i, unnest(r) AS v, unnest(range({N})) AS j FROM (SELECT {keys}, unnest({matrix}) AS r, unnest(range({N})) AS i FROM {source})"
    return f"SELECT {keys}, i, j, round(v, 6) AS v FROM ({rows}) WHERE {where}"


def entropy(matrix: str, n: int | str = N) -> str:
    return f"(-list_sum(list_transform({matrix}, lambda r: list_sum(list_transform(r, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)))) / {n})"


def adjacency(name: str, edges: str, keys: str) -> str:
    """name(keys, a, d): adjacency matrices and degrees of an edge table with i < j."""
    return f"""{name} AS MATERIALIZED (SELECT *, list_transform(a, lambda r: list_sum(r)) AS d FROM (
  SELECT {keys}, list_transform(range({N}), lambda x: list_transform(range({N}), lambda y: list_contains(e, x * {N} + y)::DOUBLE)) AS a
  FROM (SELECT {keys}, list(i * {N} + j) AS e FROM (SELECT {keys}, i, j FROM {edges} UNION ALL SELECT {keys}, j, i FROM {edges}) GROUP BY {keys})))"""


def heat(name: str, source: str, walk: bool = False) -> str:
    """name(..., e): e is exp(-t L) of rows (..., a, d, t), L the Laplacian or that of the random walk."""
    if walk:
        generator = f"list_transform(range(1, {N + 1}), lambda x: list_transform(range(1, {N + 1}), lambda y: -t / 64 * ((x = y AND d[x] > 0)::DOUBLE - CASE WHEN a[x][y] > 0 THEN a[x][y] / sqrt(d[x] * d[y]) ELSE 0 END)))"
    else:
        generator = f"list_transform(range(1, {N + 1}), lambda x: list_transform(range(1, {N + 1}), lambda y: -t / 64 * ((x = y)::DOUBLE * d[x] - a[x][y])))"
    q = f"SELECT *, {generator} AS m, {_EYE} AS e FROM {source}"
    for n in range(14, 0, -1):  # every matrix here is symmetric: rows are columns
        q = f"SELECT * REPLACE (list_transform(range(1, {N + 1}), lambda x: list_transform(range(1, {N + 1}), lambda y: (x = y)::DOUBLE + list_dot_product(m[x], e[y]) / {n})) AS e) FROM ({q})"
    for _ in range(6):
        q = f"SELECT * REPLACE ({product('e', 'e')} AS e) FROM ({q})"
    if walk:
        q = f"SELECT * REPLACE (list_transform(range(1, {N + 1}), lambda x: list_transform(range(1, {N + 1}), lambda y: e[x][y] * sqrt(greatest(d[y], 1)) / sqrt(greatest(d[x], 1)))) AS e) FROM ({q})"
    return f"{name} AS MATERIALIZED ({q})"


def transposed(m: str) -> str:
    return f"list_transform(range(1, {N + 1}), lambda x: list_transform({m}, lambda r: r[x]))"


def running(name: str, source: str, keys: list[str], levels: int = LEVELS, reverse: bool = False) -> str:
    """name(keys, k, p, q): products of matrices p (transposes q) from the first k of each key on, or from the last one back."""
    parts, last = [], source
    for level in range(levels):
        step, at = 1 << level, f"{name}_{level}" if level < levels - 1 else name
        on = " AND ".join(f"b.{k} = a.{k}" for k in keys)
        p, q = product("b.p", "a.q"), product("a.q", "b.p")
        parts.append(
            f"{at} AS MATERIALIZED (SELECT a.* REPLACE (CASE WHEN b.p IS NULL THEN a.p ELSE {p} END AS p, CASE WHEN b.p IS NULL THEN a.q ELSE {q} END AS q) "
            f"FROM {last} a LEFT JOIN {last} b ON {on} AND b.k = a.k {'+' if reverse else '-'} {step})"
        )
        last = at
    return ",\n".join(parts)


def windows(name: str, source: str, plan: str, keys: list[str]) -> str:
    """name(plan's columns, p): products over [l, r] of matrices p (transposes q), by lengths of powers of two."""
    parts, last = [], source
    for level in range(1, WINDOW_LEVELS):
        on = " AND ".join(f"b.{k} = a.{k}" for k in keys)
        parts.append(f"{name}_p{level} AS MATERIALIZED (SELECT a.* REPLACE ({product('a.p', 'b.q')} AS p, {product('b.q', 'a.p')} AS q) FROM {last} a JOIN {last} b ON {on} AND b.k = a.k + {1 << level - 1})")
        last = f"{name}_p{level}"
    at = f"(SELECT *, l AS place, NULL::DOUBLE[][] AS p FROM {plan})"
    for level in range(WINDOW_LEVELS):
        table = f"{name}_p{level}" if level else source
        on = " AND ".join(f"b.{k} = w.{k}" for k in keys)
        bit = f"((w.r - w.l + 1) >> {level}) & 1 = 1"
        p = f"CASE WHEN b.p IS NULL THEN w.p WHEN w.p IS NULL THEN b.p ELSE {product('w.p', 'b.q')} END"
        out = name if level == WINDOW_LEVELS - 1 else f"{name}_w{level}"
        parts.append(f"{out} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN {bit} THEN w.place + {1 << level} ELSE w.place END AS place, {p} AS p) FROM {at} w LEFT JOIN {table} b ON {on} AND b.k = w.place AND {bit})")
        at = out
    return ",\n".join(parts)


def squared(name: str, source: str, times: int = 36) -> str:
    """name(..., s, b): of symmetric positive matrices b, s = ln of the greatest eigenvalue and b the projector on its space over its trace; b NULL for zero matrices."""
    q = f"SELECT *, 0.0::DOUBLE AS s, 1.0::DOUBLE AS w FROM {source}"
    for _ in range(times):
        trace = "list_sum(list_transform(range(1, len(b) + 1), lambda x: b[x][x]))"
        q = f"SELECT * REPLACE (s + w * ln(tr) AS s, w / 2 AS w, CASE WHEN tr IS NULL THEN NULL ELSE list_transform(b, lambda r: list_transform(r, lambda x: x / tr)) END AS b) FROM (SELECT *, CASE WHEN {trace} > 1e-12 THEN {trace} END AS tr FROM ({q}))"
        q = f"SELECT * EXCLUDE (tr) REPLACE ({product('b', 'b')} AS b) FROM ({q})"
    trace = "list_sum(list_transform(range(1, len(b) + 1), lambda x: b[x][x]))"
    q = f"SELECT * REPLACE (list_transform(b, lambda r: list_transform(r, lambda x: x / tr)) AS b) FROM (SELECT *, {trace} AS tr FROM ({q}))"
    return f"{name} AS MATERIALIZED ({q})"
