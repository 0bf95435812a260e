"""Complete linkage by rounds: nodes that are each other's best partner merge, many at once.

The greedy course always merges the best pair of nodes: that of the highest least similarity, ties by the smaller nodes (a node
is named by its first row). A merged node is never more alike to another than both its parts were, and keeps the smaller name, so
no merge elsewhere puts a better pair before two nodes that are each other's best. The greedy course merges these two as well,
sooner or later, and the order in which it does changes no node. No matrix of all pairs is held: a node's partners
are worked out from the rows, a tile at a time, and anew only once the partner it had has merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows of two sides whose products are held at once.
TILE = 512
#: Similarities are whole multiples of one part in this many, so that equal pairs tie wherever they are worked out.
GRID = 2.0**40
#: Nodes without a known partner that a round looks at: four for each pair that the last one merged, this many at least.
LEAST_NODES = 16


def grid(x: float | np.ndarray) -> np.ndarray:
    """The nearest multiple of a GRID-th, as a count."""
    return np.rint(np.asarray(x, float) * GRID)


def _starts(node: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.append(np.ones(min(len(node), 1), bool), node[1:] != node[:-1]))


def _spans(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Bounds (first, end) of runs of whole nodes, of TILE rows at most where a node alone hasn't more."""
    bounds = np.append(starts, n)
    first = 0
    while first < len(starts):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + TILE, "right")) - 1)
        yield first, end
        first = end


def _least(x: np.ndarray, c: np.ndarray | None, sx: np.ndarray, y: np.ndarray, d: np.ndarray | None, sy: np.ndarray) -> np.ndarray:
    """The least similarity between each node of x and each of y, whose rows start at sx and sy; -inf where codes c and d meet."""
    out = None if len(x) <= TILE and len(y) <= TILE else np.full((len(sx), len(sy)), np.inf)
    for lo in range(0, len(x), TILE):
        for at in range(0, len(y), TILE):
            s = x[lo : lo + TILE] @ y[at : at + TILE].T
            if c is not None:
                np.copyto(s, -np.inf, where=c[lo : lo + TILE, None] == d[None, at : at + TILE])
            a, b = (slice(int(np.searchsorted(z, k, "right")) - 1, int(np.searchsorted(z, k + n))) for z, k, n in ((sx, lo, len(s)), (sy, at, s.shape[1])))
            if a.stop - a.start < len(s):
                s = np.minimum.reduceat(s, np.maximum(sx[a] - lo, 0), axis=0)
            if b.stop - b.start < s.shape[1]:
                s = np.minimum.reduceat(s, np.maximum(sy[b] - at, 0), axis=1)
            if out is None:
                return s
            out[a, b] = np.minimum(out[a, b], s)
    return out


def partners(x: np.ndarray, c: np.ndarray | None, node: np.ndarray, y: np.ndarray, d: np.ndarray | None, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes of x, the best of the nodes of y for each, their similarity in counts of the grid): ties go to the smaller node.

    x, y: rows of length 1 in order of their nodes; c, d: codes, or None, that two nodes may not both hold. -1 and -inf where
    there is none.
    """
    sx, sy = _starts(node), _starts(other)
    mine, them = node[sx], other[sy]
    best, high = np.full(len(mine), -1, np.int64), np.full(len(mine), -np.inf)
    right = [(k, e, int(sy[k]), int(sy[e]) if e < len(sy) else len(other)) for k, e in _spans(sy, len(other))]
    for a, b in _spans(sx, len(node)):
        lo, hi = int(sx[a]), int(sx[b]) if b < len(sx) else len(node)
        for k, e, at, to in right:
            s = _least(x[lo:hi], None if c is None else c[lo:hi], sx[a:b] - lo, y[at:to], None if d is None else d[at:to], sy[k:e] - at)
            s *= GRID
            np.rint(s, out=s)
            own = np.minimum(np.searchsorted(them[k:e], mine[a:b]), e - k - 1)
            same = np.flatnonzero(them[k:e][own] == mine[a:b])
            s[same, own[same]] = -np.inf
            j = s.argmax(1)
            v = s[np.arange(b - a), j]
            better = v > high[a:b]  # the nodes of a later span are greater
            high[a:b][better] = v[better]
            best[a:b][better] = them[k:e][j[better]]
    return mine, best, high


def merged(x: np.ndarray, codes: np.ndarray | None, steps: list[float]) -> np.ndarray:
    """(rows, steps): the first row of each row's node at each of the thresholds, which are given from high to low.

    x: rows of length 1 in order of their items; codes: rows of one code never share a node.
    """
    n = len(x)
    steps = [float(grid(t)) for t in steps]
    node, alive, fresh = np.arange(n), np.ones(n, bool), np.zeros(n, bool)
    at = np.repeat(node[:, None], len(steps), 1)
    best, high = np.full(n, -1), np.full(n, np.inf)  # of a node that isn't fresh: no less than it can be
    rows, look = node.copy(), n
    while len(rows):
        own = node[rows]
        nodes = own[_starts(own)]
        stale = nodes[~fresh[nodes]]
        if len(stale) > look:  # the likeliest to merge
            stale = stale[np.lexsort((stale, -high[stale]))[:look]]
        todo = np.zeros(n, bool)
        todo[stale] = True
        q = rows[todo[own]]
        if len(q):
            c, d = (None, None) if codes is None else (codes[q], codes[rows])
            some, to, v = partners(x[q], c, node[q], x[rows], d, own)
            best[some], high[some], fresh[some] = to, v, True
        wanted = np.zeros(n, bool)
        wanted[best[nodes[fresh[nodes] & (high[nodes] >= steps[-1])]]] = True
        alive[nodes[fresh[nodes] & (high[nodes] < steps[-1]) & ~wanted[nodes]]] = False  # never merge again
        nodes = nodes[alive[nodes]]
        known = nodes[fresh[nodes]]
        known = known[high[known] >= steps[-1]]
        keep = known[fresh[best[known]] & (best[best[known]] == known) & (known < best[known])]
        if not len(keep) and len(known) and not (~fresh[nodes]).any():  # rounding alone keeps the best pair from being mutual
            k = known[np.lexsort((known, -high[known]))[0]]
            keep = np.array([min(k, best[k])])
            best[keep], high[keep] = max(k, best[k]), high[k]
        gone, v = best[keep], high[keep]
        to, height, touched = np.arange(n), np.full(n, -np.inf), np.zeros(n, bool)
        to[gone], height[gone] = keep, v
        for k, t in enumerate(steps):
            at[:, k] = np.where(height[node] >= t, to[node], at[:, k])
        node = to[node]
        alive[gone] = False
        touched[keep] = touched[gone] = True
        nodes = nodes[alive[nodes]]
        fresh[nodes] &= ~(touched[nodes] | touched[best[nodes]])
        look = max(LEAST_NODES, 4 * len(keep), 2 * look if not len(keep) else 0)
        rows = rows[alive[node[rows]]]
        rows = rows[np.argsort(node[rows], kind="stable")]
    return at
