"""Numerical kernels in numpy: what is sequential or dense linear algebra and no relation.

They work on one small group at a time, inside grouped Arrow or pandas functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


# ---- heat kernels and ordered products -------------------------------------------------


def heat_kernels(laplacians: np.ndarray, times: np.ndarray) -> np.ndarray:
    """exp(-t L) of a stack of symmetric matrices, by their eigenvectors."""
    values, vectors = np.linalg.eigh(laplacians)
    return np.einsum("kij,kj,klj->kil", vectors, np.exp(-times[:, None] * values), vectors, optimize=True)


def walk_heat_kernels(adjacency: np.ndarray, times: np.ndarray) -> np.ndarray:
    """exp(-t (I - D^-1 A)) of a stack of symmetric adjacency matrices; isolated nodes stay.

    D^1/2 L D^-1/2 is symmetric, so the symmetric kernel does the work.
    """
    degree = adjacency.sum(axis=2)
    root = np.sqrt(np.where(degree > 0, degree, 1.0))
    symmetric = np.eye(adjacency.shape[1]) * (degree > 0)[:, :, None] - adjacency / root[:, :, None] / root[:, None, :]
    return heat_kernels(symmetric, times) / root[:, :, None] * root[:, None, :]


def normalize_rows(m: np.ndarray) -> np.ndarray:
    total = m.sum(axis=-1, keepdims=True)
    return np.divide(m, total, out=m.copy(), where=total != 0)


def entropy(m: np.ndarray, p0: np.ndarray | None = None) -> float:
    """-sum_i p_i sum_j m_ij ln m_ij over positive cells; p uniform unless given."""
    if not m.size:
        return 0.0
    p = np.full(m.shape[0], 1 / m.shape[0]) if p0 is None else p0
    positive = np.where(m > 0, m, 1.0)
    return float(-(p[:, None] * positive * np.log(positive)).sum())


def running_products(mats: np.ndarray, reverse: bool = False, normalize: bool = True) -> np.ndarray:
    """Products from the first matrix on, or from the last backwards (stored at the index reached)."""
    out = np.empty_like(mats)
    total = np.eye(mats.shape[1])
    for k in range(len(mats) - 1, -1, -1) if reverse else range(len(mats)):
        total = total @ mats[k]
        if normalize:
            total = normalize_rows(total)
        out[k] = total
    return out


class RangeProducts:
    """Ordered products of ranges [left, right], both included, from a tree of partial products."""

    def __init__(self, mats: np.ndarray):
        self.n = len(mats)
        size = 1 << max(0, (self.n - 1).bit_length())
        self.levels = [mats]
        eye = np.eye(mats.shape[1])[None]
        if size > self.n:
            self.levels = [np.concatenate((mats, np.repeat(eye, size - self.n, axis=0)))]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(below[0::2] @ below[1::2])

    def query(self, left: int, right: int) -> np.ndarray:
        if not 0 <= left <= right < self.n:
            raise IndexError((left, right))
        size = self.levels[0].shape[1]
        head, tail = np.eye(size), np.eye(size)
        lo, hi = left, right + 1
        for level in self.levels:
            if lo >= hi:
                break
            if lo & 1:
                head = head @ level[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                tail = level[hi] @ tail
            lo, hi = lo // 2, hi // 2
        return head @ tail


def sliding_products(mats: np.ndarray, left: np.ndarray, right: np.ndarray) -> Callable[[], object]:
    """Ordered products of windows whose bounds never decrease, each by two products at most.

    Two stacks: finished suffix products of the older part, one running product of the newer.
    """

    def run():
        eye = np.eye(mats.shape[1])
        suffix: list[np.ndarray] = []
        front, split, newest, upto = 0, 0, eye, 0
        for lo, hi in zip(left.tolist(), right.tolist(), strict=True):
            while upto <= hi:
                newest = newest @ mats[upto]
                upto += 1
            if lo >= split:
                # the older part is used up: the newer part becomes the older one
                suffix, total = [], eye
                for k in range(upto - 1, lo - 1, -1):
                    total = mats[k] @ total
                    suffix.append(total)
                front, split, newest = lo, upto, eye
            while front < lo:
                suffix.pop()
                front += 1
            yield (suffix[-1] if suffix else eye) @ newest

    return run


def direct_product(mats: np.ndarray, left: int, right: int, reverse: bool = False) -> np.ndarray:
    total = np.eye(mats.shape[1])
    for k in range(right, left - 1, -1) if reverse else range(left, right + 1):
        total = total @ mats[k]
    return total


# ---- change points -----------------------------------------------------------------------


def _segment_costs(x: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """Linear-kernel cost of [a, b): sum |x|^2 - |sum x|^2 / (b - a), for many a at once."""
    x = x.reshape(len(x), -1)
    squares = np.concatenate(([0.0], np.cumsum((x * x).sum(axis=1))))
    sums = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))
    return lambda a, b: squares[b] - squares[a] - ((sums[b] - sums[a]) ** 2).sum(axis=1) / (b - a)


def change_points(x: np.ndarray, n_bkps: int, least: int = 2) -> list[int]:
    """The n_bkps starts of new segments at the least total cost; none if the signal is too short.

    Of equal costs the one whose last cut is last is taken, then by the cut before it, and so on.
    Costs are added up from the left, as in the SQL, so that rounding tells the same cuts apart.
    """
    n = len(x)
    if n_bkps <= 0 or n <= n_bkps or (n_bkps + 1) * least > n:
        return []
    x = np.asarray(x, dtype=float).reshape(n, -1)
    squares = np.concatenate(([0.0], np.cumsum((x * x).sum(axis=1))))
    sums = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))
    added = lambda before, a, b: before + squares[b] - squares[a] - ((sums[b] - sums[a]) ** 2).sum(axis=1) / (b - a)
    best = np.full(n + 1, np.inf)
    for b in range(least, n + 1):
        best[b] = added(0.0, np.array([0]), b)[0]
    back = np.zeros((n_bkps, n + 1), dtype=np.int64)
    for s in range(n_bkps):
        following = np.full(n + 1, np.inf)
        for b in [n] if s == n_bkps - 1 else range((s + 2) * least, n + 1):
            a = np.arange((s + 1) * least, b - least + 1)
            total = added(best[a], a, b)
            j = len(a) - 1 - int(np.argmin(total[::-1]))
            following[b], back[s, b] = total[j], a[j]
        best = following
    found, at = [], n
    for s in range(n_bkps - 1, -1, -1):
        at = int(back[s, at])
        found.append(at)
    return found[::-1]


def penalized_change_points(x: np.ndarray, penalty: float, least: int = 2) -> list[int]:
    """Starts of new segments at the least cost plus penalty a segment, with pruned candidates."""
    n = len(x)
    if n < least:
        return []
    cost = _segment_costs(np.asarray(x, dtype=float))
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    best[0] = 0.0
    open_, until = np.array([0]), np.array([n + 1])  # candidates, and the ends from which on they are out
    for b in range(least, n + 1):
        if b >= 2 * least:
            open_, until = np.append(open_, b - least), np.append(until, n + 1)
        total = best[open_] + cost(open_, b)
        j = int(np.argmin(total))
        best[b], back[b] = total[j] + penalty, open_[j]
        # a candidate that a cut at b beats is out once a part after b may be long enough
        until = np.where(total > best[b], np.minimum(until, b + least), until)
        open_, until = open_[until > b + 1], until[until > b + 1]
    found, at = [], n
    while at > 0:
        at = int(back[at])
        if at > 0:
            found.append(at)
    return found[::-1]


def top_positions(x: np.ndarray, n: int) -> list[int]:
    """Positions of the n greatest values in order of position; of equal ones the later."""
    order = np.lexsort((np.arange(len(x)), x))
    return sorted(order[max(0, len(x) - n) :].tolist()) if n > 0 else []


# ---- spectra -----------------------------------------------------------------------------


def singular_signature(m: np.ndarray, k: int, top: bool = True) -> np.ndarray:
    """The k greatest (or least) singular values, padded with zeros, of length 1."""
    values = np.linalg.svd(m, compute_uv=False)
    values = values[:k] if top else np.sort(values)[:k]
    return unit(np.pad(values, (0, k - len(values))))


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v)
    return v / norm if norm > 0 and np.isfinite(norm) else np.zeros_like(v)


def principal_direction(signatures: np.ndarray) -> np.ndarray:
    """First left singular vector of signatures as columns."""
    return np.linalg.svd(np.asarray(signatures).T, full_matrices=False)[0][:, 0]


def window_scores(signatures: np.ndarray, window: int) -> np.ndarray:
    """1 - |<s, u>| against the direction of the ``window`` signatures before; 0 while there are none."""
    out = np.zeros(len(signatures))
    for k in range(window, len(signatures)):
        out[k] = 1 - abs(float(signatures[k] @ principal_direction(signatures[k - window : k])))
    return out


def principal_angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    qx, qy = np.linalg.qr(x)[0], np.linalg.qr(y)[0]
    return np.arccos(np.clip(np.linalg.svd(qx.T @ qy, compute_uv=False), -1.0, 1.0))


SUBSPACE_DISTANCES: dict[str, Callable[[np.ndarray], float]] = {
    "grassmann": lambda a: float(np.sqrt((a**2).sum())),
    "asimov": lambda a: float(a.max()),
    "projection": lambda a: float(np.sqrt((np.sin(a) ** 2).sum())),
    "binet_cauchy": lambda a: float(np.sqrt(max(0.0, 1 - np.prod(np.cos(a) ** 2)))),
    "procrustes": lambda a: float(2 * np.sqrt((np.sin(a / 2) ** 2).sum())),
    "chordal": lambda a: float(np.sqrt((np.sin(a) ** 2).sum())),
    "spectral": lambda a: float(2 * np.sin(a.max() / 2)),
    "martin": lambda a: float(np.sqrt(-2 * np.log(np.maximum(np.cos(a), 1e-300)).sum())),
    "fubini_study": lambda a: float(np.arccos(np.clip(np.prod(np.cos(a)), -1, 1))),
}


def normalized_laplacian(a: np.ndarray) -> np.ndarray:
    d = a.sum(axis=1)
    root = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0.0)
    return np.diag((d > 0).astype(float)) - root[:, None] * a * root[None, :]


def embedding(a: np.ndarray, k: int, normalized: bool = True) -> np.ndarray:
    """Eigenvectors of the k least eigenvalues of the Laplacian."""
    lap = normalized_laplacian(a) if normalized else np.diag(a.sum(axis=1)) - a
    return np.linalg.eigh(lap)[1][:, :k]


def spectral_gap(a: np.ndarray) -> float:
    """Least eigenvalue of the normalized Laplacian above its null space: 0 if disconnected."""
    values = np.linalg.eigvalsh(normalized_laplacian(a))
    return float(values[1]) if len(values) > 1 else 0.0


def return_profile(a: np.ndarray, k: int) -> np.ndarray:
    """Diagonals of (D A)^1 .. (D A)^k: weighted closed walks of each node, one column a power."""
    step = a.sum(axis=1)[:, None] * a
    power, out = np.eye(len(a)), []
    for _ in range(k):
        power = power @ step
        out.append(np.diag(power).copy())
    return np.stack(out, axis=1)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Labels by Lloyd's rounds from spread-out seeded centres."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
    centres = np.array(centres)
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        now = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if np.array_equal(now, label) and _:
            break
        label = now
        for c in range(k):
            if (label == c).any():
                centres[c] = x[label == c].mean(axis=0)
    return label


# ---- assignment and clustering -----------------------------------------------------------


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost matching, by shortest augmenting paths."""
    c = np.asarray(cost, dtype=float)
    flipped = c.shape[0] > c.shape[1]
    if flipped:
        c = c.T
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=bool)
        while True:
            done[at] = True
            r = owner[at]
            free = np.flatnonzero(~done[1:]) + 1
            slack = c[r - 1, free - 1] - u[r] - v[free]
            better = slack < least[free]
            least[free[better]], came[free[better]] = slack[better], at
            to = free[np.argmin(least[free])]
            step = least[to]
            u[owner[done]] += step
            v[done] -= step
            least[free] -= step
            at = to
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def autocovariance(t: np.ndarray, p1: np.ndarray, p2: np.ndarray | None = None) -> np.ndarray:
    """diag(p1) T - p1 p2^T; p2 is p1 T unless given."""
    return p1[:, None] * t - np.outer(p1, p1 @ t if p2 is None else p2)


def forward_autocovariance(t: np.ndarray, p1: np.ndarray, p2: np.ndarray | None = None) -> np.ndarray:
    """diag(p1) T diag(1/p2) T^T diag(p1) - p1 p1^T; columns nobody reaches are left out."""
    p2 = p1 @ t if p2 is None else p2
    half = p1[:, None] * t / np.sqrt(np.where(p2 > 0, p2, 1.0))
    return half @ half.T - np.outer(p1, p1)


def flow_integral(mats: np.ndarray, taus: np.ndarray, p1: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Time mean of the forward autocovariance (its product term) over running products, by left sums."""
    total, size = np.zeros(mats.shape[1:]), taus.sum()
    for t, tau in zip(running_products(mats, normalize=normalize), taus, strict=True):
        p2 = p1 @ t
        half = p1[:, None] * t / np.sqrt(np.where(p2 > 0, p2, 1.0))
        total += tau * (half @ half.T)
    return total / size if size > 0 else total


def louvain(s: np.ndarray, seed: int, rounds: int = 1000, gain_above: float = 1e-12) -> np.ndarray:
    """Cluster numbers that greedily maximize the sum of S within clusters.

    Sweeps in a seeded order move single nodes; then clusters become nodes, until nothing gains.
    """
    rng = np.random.default_rng(seed)
    member, level = np.arange(len(s)), np.array(s, dtype=float)
    for _ in range(rounds):
        n = len(level)
        label, symmetric = np.arange(n), level + level.T
        moved_ever = False
        for _ in range(rounds):
            moved = False
            for node in rng.permutation(n):
                sums = np.bincount(label, weights=symmetric[node], minlength=n)
                sums[label[node]] -= symmetric[node, node]
                to = int(np.argmax(np.where(np.bincount(label, minlength=n) > 0, sums, -np.inf)))
                stay = sums[label[node]]
                if sums[to] < 0 and stay < 0:  # better alone: an empty cluster
                    to = int(np.flatnonzero(np.bincount(label, minlength=n) == 0)[0])
                    if -stay <= gain_above:
                        continue
                elif sums[to] - stay <= gain_above:
                    continue
                if to != label[node]:
                    label[node], moved, moved_ever = to, True, True
            if not moved:
                break
        _, label = np.unique(label, return_inverse=True)
        member = label[member]
        if not moved_ever:
            break
        k = int(label.max()) + 1
        hot = np.zeros((n, k))
        hot[np.arange(n), label] = 1
        level = hot.T @ level @ hot
    return member


def stability(s: np.ndarray, label: np.ndarray) -> float:
    return float(s[label[:, None] == label[None, :]].sum())


def variation(a: np.ndarray, b: np.ndarray) -> float:
    """Normalized variation of information of two labelings, in [0, 1]."""
    n = len(a)
    if n < 2:
        return 0.0
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    both = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(both, (a, b), 1)
    i, j = np.nonzero(both)
    x = both[i, j]
    return float(-(x * np.log2(x * x / (both.sum(axis=1)[i] * both.sum(axis=0)[j]))).sum() / (n * np.log2(n))) + 0.0


def markov_stability_matrix(a: np.ndarray, t: float = 1.0, kind: str = "continuous", directed: bool = False) -> np.ndarray:
    """Autocovariance of a walk on a static graph after time t: discrete, linearized or continuous."""
    walk = normalize_rows(np.where(a.sum(axis=1, keepdims=True) > 0, a, np.eye(len(a))))
    if directed:
        values, vectors = np.linalg.eig(walk.T)
        pi = np.abs(np.real(vectors[:, np.argmin(np.abs(values - 1))]))
        pi = pi / pi.sum()
    else:
        d = np.where(a.sum(axis=1) > 0, a.sum(axis=1), 1.0)
        pi = d / d.sum()
    if kind == "discrete":
        step = np.linalg.matrix_power(walk, int(t))
    elif kind == "linearized":
        step = np.eye(len(a)) - t * (np.eye(len(a)) - walk)
    else:
        step = general_exponential(-t * (np.eye(len(a)) - walk))
    return autocovariance(step, pi, pi)


def general_exponential(m: np.ndarray) -> np.ndarray:
    """exp of any square matrix: Taylor terms on a scaled matrix, squared back."""
    halvings = max(0, int(np.ceil(np.log2(max(1e-300, np.linalg.norm(m, 1))))) + 2)
    x = m / 2**halvings
    total, term = np.eye(len(m)), np.eye(len(m))
    for k in range(1, 19):
        term = term @ x / k
        total = total + term
    for _ in range(halvings):
        total = total @ total
    return total


def dense(i: Sequence[int], j: Sequence[int], v: Sequence[float], n: int) -> np.ndarray:
    out = np.zeros((n, n))
    np.add.at(out, (np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64)), np.asarray(v, dtype=float))
    return out
