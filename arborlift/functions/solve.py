"""Small dense numerics for one stratum, used inside Spark tasks."""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np

MAX_ITERATIONS = 25
TOLERANCE = 1e-8
ETA_LIMIT = 30.0
MAD_TO_SD = 1.4826
FIRST_FETCH = 32
#: Distances and scores count to so many decimals, so that ties are ties whatever the order of the sums behind them.
DECIMALS = 9


def standardise(x: np.ndarray) -> np.ndarray:
    """Columns to mean 0 and sd 1; constant columns are dropped."""
    sd = x.std(axis=0)
    scale = np.abs(x).max(axis=0, initial=0.0)
    keep = sd > 1e-12 * np.maximum(scale, 1e-300)
    return (x[:, keep] - x[:, keep].mean(axis=0)) / sd[keep]


def newton_step(gram: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Least-norm solution, so aliased columns do no harm."""
    return np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ gradient


def logit_score(x: np.ndarray, treated: np.ndarray) -> np.ndarray:
    """Linear predictor of a logistic regression with intercept."""
    design = np.column_stack([np.ones(len(x)), standardise(x)])
    y = treated.astype(float)
    beta = np.zeros(design.shape[1])
    beta[0] = np.log(y.mean() / (1 - y.mean()))
    deviance = np.inf
    for _ in range(MAX_ITERATIONS):
        eta = np.clip(design @ beta, -ETA_LIMIT, ETA_LIMIT)
        mu = 1 / (1 + np.exp(-eta))
        now = -2 * np.sum(np.where(y > 0, np.log(mu), np.log1p(-mu)))
        if abs(now - deviance) < TOLERANCE * (abs(now) + 0.1):
            break
        deviance = now
        weight = mu * (1 - mu)
        beta = beta + newton_step((design.T * weight) @ design, design.T @ (y - mu))
    return np.clip(design @ beta, -ETA_LIMIT, ETA_LIMIT)


def _spread(values: np.ndarray, how: str) -> float:
    if how == "sd":
        return float(values.std(ddof=1)) if len(values) > 1 else 0.0
    return MAD_TO_SD * float(np.median(np.abs(values - np.median(values))))


def pooled_scale(score: np.ndarray, treated: np.ndarray, how: str) -> float:
    """Pooled spread of the two arms; sd when the robust one is zero, then 1."""
    n_t, n = int(treated.sum()), len(score)
    for kind in (how, "sd"):
        parts = (n_t - 1) * _spread(score[treated], kind) ** 2
        parts += (n - n_t - 1) * _spread(score[~treated], kind) ** 2
        scale = np.sqrt(parts / (n - 2)) if n > 2 else 0.0
        if scale > 1e-12:
            return float(scale)
    return 1.0


def whitening(cov: np.ndarray) -> np.ndarray:
    """Matrix W with W W' = pseudo-inverse of ``cov``."""
    values, vectors = np.linalg.eigh(cov)
    keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


def whitened(x: np.ndarray, treated: np.ndarray) -> np.ndarray:
    """Coordinates whose Euclidean distance is the Mahalanobis distance."""
    z = standardise(x)
    if z.shape[1] == 0:
        return np.zeros((len(x), 1))
    scatter = np.zeros((z.shape[1],) * 2)
    for arm in (treated, ~treated):
        centred = z[arm] - z[arm].mean(axis=0)
        scatter += centred.T @ centred
    coords = z @ whitening(scatter / max(len(z) - 2, 1))
    return coords if coords.shape[1] else np.zeros((len(x), 1))


class NearestControls:
    """Controls of one stratum in order of (distance, cell) from a point."""

    def __init__(self, coords: np.ndarray, cells: np.ndarray):
        order = np.lexsort((cells, coords[:, 0]))
        self.coords, self.cells = coords[order], cells[order]
        self.line = coords.shape[1] == 1
        self._steps = None

    def walk(self, point: float, caliper: float):
        """(distance, position) of the controls on a line one by one, in the order of :meth:`nearest`."""
        if self._steps is None:
            values, first = np.unique(self.coords[:, 0], return_index=True)
            self._steps = values.tolist(), [*first.tolist(), len(self.cells)], self.cells.tolist()
        values, starts, cells = self._steps
        scale = 10.0 ** DECIMALS
        right = bisect_left(values, point)
        left, last = right - 1, len(values)
        # rounded as numpy does
        gap_l = round(abs(values[left] - point) * scale) / scale if left >= 0 else None
        gap_r = round(abs(values[right] - point) * scale) / scale if right < last else None
        while gap_l is not None or gap_r is not None:
            gap = gap_l if gap_r is None or (gap_l is not None and gap_l < gap_r) else gap_r
            if 0 < caliper < gap:
                return
            level = []
            while gap_l == gap:
                level.append((starts[left], starts[left + 1]))
                left -= 1
                gap_l = round(abs(values[left] - point) * scale) / scale if left >= 0 else None
            while gap_r == gap:
                level.append((starts[right], starts[right + 1]))
                right += 1
                gap_r = round(abs(values[right] - point) * scale) / scale if right < last else None
            if len(level) == 1:
                for at in range(*level[0]):
                    yield gap, at
            else:
                for _, at in heapq.merge(*(zip(cells[a:b], range(a, b)) for a, b in level)):
                    yield gap, at

    def nearest(self, point: np.ndarray, m: int, caliper: float):
        """(distances, positions) of the ``m`` nearest within the caliper."""
        n = len(self.cells)
        if self.line:
            axis = self.coords[:, 0]
            at = int(np.searchsorted(axis, point[0]))
            near = np.abs(axis[max(0, at - m):min(n, at + m)] - point[0])
            reach = np.partition(near, m - 1)[m - 1] if len(near) > m else np.inf
            if caliper > 0:
                reach = min(reach, caliper)
            slack = 1e-9 * (2 + abs(point[0])) + (0 if np.isinf(reach) else reach * 1e-9)
            lo = int(np.searchsorted(axis, point[0] - reach - slack))
            hi = int(np.searchsorted(axis, point[0] + reach + slack, side="right"))
            positions = np.arange(lo, hi)
            distance = np.round(np.abs(axis[lo:hi] - point[0]), DECIMALS)
        else:
            positions = np.arange(n)
            distance = np.round(np.sqrt(((self.coords - point) ** 2).sum(axis=1)), DECIMALS)
        if caliper > 0:
            inside = distance <= caliper
            positions, distance = positions[inside], distance[inside]
        if len(positions) > m:
            cut = np.partition(distance, m - 1)[m - 1]
            inside = distance <= cut
            positions, distance = positions[inside], distance[inside]
        order = np.lexsort((self.cells[positions], distance))[:m]
        return distance[order], positions[order]


class _BeyondHorizon(Exception):
    """The pairing would have to look past the controls at hand."""


def greedy_pairs(treated, treated_cells, controls, control_cells, k, caliper, horizon=None, most=False):
    """1:k pairing without replacement, nearest pair first.

    Ties are broken by treated cell, then control cell. Only units with ``k``
    free controls within the caliper take part in a pass; those that end a pass
    with fewer release them, and the passes go on until no left-out unit has ``k``
    free controls. Where a pass completes nobody, the unit with the nearest free
    control (of equal ones, that of the smallest cell) is completed alone. ``horizon`` says how
    many nearest controls of each unit are known to be present; returns
    ``None`` when the pairing would have to look beyond it.

    With ``most`` (for ``k`` 1) units left out, by rising cell, then get a control by
    exchange: paired units move on to other controls along a shortest chain that ends at
    a free one. Nobody loses its pair, and no way of pairing pairs more units.
    """
    pool = NearestControls(controls, control_cells)
    # at most this many controls can ever be in use, so none needs to look further
    need = len(treated_cells) * k
    fetched, size = {}, {}
    line = pool.line and np.isfinite(controls).all() and np.isfinite(treated).all()
    walks = [pool.walk(point, caliper) for point in treated[:, 0].tolist()] if line else None
    taken = np.zeros(len(control_cells), dtype=bool)

    def at_place(i: int, at: int):
        """(distance, position) of a unit's control number ``at``; None past its last."""
        if at >= need:
            return None
        if horizon is not None and at >= horizon:
            raise _BeyondHorizon
        if line:
            got = fetched.setdefault(i, [])
            while len(got) <= at:
                if (found := next(walks[i], None)) is None:
                    return None
                got.append(found)
            return got[at]
        if i not in fetched or (at >= len(fetched[i][0]) and size[i] <= len(fetched[i][0])):
            size[i] = min(max(FIRST_FETCH, at + 1, size.get(i, 0) * 4), need)
            fetched[i] = pool.nearest(treated[i], size[i], caliper)
        distance, position = fetched[i]
        return (distance[at], int(position[at])) if at < len(distance) else None

    def nearest_free(i: int):
        """The unit's ``k`` nearest free controls, or None if it has fewer."""
        got, at = [], 0
        while len(got) < k:
            found = at_place(i, at)
            if found is None:
                return None
            if not taken[found[1]]:
                got.append(found)
            at += 1
        return got

    def one_pass(units):
        heap, chosen = [], {i: [] for i in units}

        def push(i: int, at: int) -> None:
            found = at_place(i, at)
            if found is not None:
                cell = pool.cells[found[1]]
                heapq.heappush(heap, (found[0], treated_cells[i], cell, i, at, found[1]))

        for i in units:
            push(i, 0)
        while heap:
            distance, _, _, i, at, position = heapq.heappop(heap)
            if not taken[position]:
                taken[position] = True
                chosen[i].append((distance, position))
            if len(chosen[i]) < k:
                push(i, at + 1)
        for got in chosen.values():
            if len(got) < k:
                taken[[position for _, position in got]] = False
        return {i: got for i, got in chosen.items() if len(got) == k}

    def exchange(start: int, owner: dict, lost: set) -> None:
        """Pair unit ``start`` along a shortest chain of exchanges, if there is one."""
        came, queue = {start: None}, [start]
        for i in queue:
            at = 0
            while (found := at_place(i, at)) is not None:
                holder = owner.get(found[1])
                if holder is None:
                    while i is not None:
                        # the unit before in the chain takes what this one gives up
                        free, (i, found) = (i, found), came[i] or (None, None)
                        done[free[0]] = [free[1]]
                        owner[free[1][1]] = free[0]
                    return
                if holder not in came and holder not in lost:
                    came[holder] = (i, found)
                    queue.append(holder)
                at += 1
        # no chain leads on from these, now or after later exchanges
        lost.update(came)

    done, left = {}, list(range(len(treated_cells)))
    try:
        while True:
            able = {i: got for i in left if (got := nearest_free(i)) is not None}
            if not able:
                break
            complete = one_pass(sorted(able))
            if not complete:
                first = min(able, key=lambda i: (able[i][0][0], treated_cells[i]))
                taken[[position for _, position in able[first]]] = True
                complete = {first: able[first]}
            done |= complete
            left = [i for i in able if i not in complete]
        if most:
            owner, lost = {got[0][1]: i for i, got in done.items()}, set()
            for i in sorted(set(range(len(treated_cells))) - set(done), key=lambda i: treated_cells[i]):
                exchange(i, owner, lost)
    except _BeyondHorizon:
        return None
    return {i: [(pool.cells[p], d) for d, p in done[i]] for i in sorted(done)}


def nearest_each(points: np.ndarray, targets: np.ndarray, cells: np.ndarray):
    """(distance, position) of every point's nearest target; small cells win ties."""
    order = np.lexsort((cells, targets[:, 0]))
    targets, cells_sorted = targets[order], cells[order]
    if targets.shape[1] == 1:
        axis, first = np.unique(targets[:, 0], return_index=True)
        right = np.clip(np.searchsorted(axis, points[:, 0]), 0, len(axis) - 1)
        left = np.clip(right - 1, 0, None)
        gap_l, gap_r = (np.round(np.abs(points[:, 0] - axis[at]), DECIMALS) for at in (left, right))
        tie = gap_l == gap_r
        smaller = cells_sorted[first[left]] < cells_sorted[first[right]]
        take_left = (gap_l < gap_r) | (tie & smaller)
        spot = np.where(take_left, first[left], first[right])
        return np.where(take_left, gap_l, gap_r), order[spot]
    by_cell = np.argsort(cells, kind="stable")
    ranked = targets[np.argsort(order)][by_cell]
    distance, position = np.empty(len(points)), np.empty(len(points), dtype=int)
    step = max(1, 2_000_000 // max(ranked.size, 1))
    for at in range(0, len(points), step):
        block = points[at:at + step]
        gaps = np.round(np.sqrt(((block[:, None, :] - ranked[None, :, :]) ** 2).sum(axis=2)), DECIMALS)
        best = gaps.argmin(axis=1)
        position[at:at + step] = by_cell[best]
        distance[at:at + step] = gaps[np.arange(len(block)), best]
    return distance, position
