"""Exact solvers for one small bipartite component, used inside grouped Spark tasks."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

#: Edges from which on a component is worth a table, and entries that the table may have, in all and for each edge.
DENSE_EDGES, DENSE_ENTRIES, SPARSE = 48, 16_000_000, 256


def solve_component(preds: Sequence, refs: Sequence, dist: Sequence[float], cap_p: dict, cap_r: dict) -> list[int]:
    """Units along each edge of a component: by a table of distances where it is dense enough for one, else by paths."""
    units_p, units_r = sum(cap_p.values()), sum(cap_r.values())
    if len(dist) < DENSE_EDGES or units_p * units_r > min(DENSE_ENTRIES, SPARSE * len(dist)):
        return assign_component(preds, refs, dist, cap_p, cap_r)
    p_at, r_at = {p: i for i, p in enumerate(cap_p)}, {r: i for i, r in enumerate(cap_r)}
    d = np.asarray(dist, dtype="float64")
    ip, ir = np.array([p_at[p] for p in preds]), np.array([r_at[r] for r in refs])
    # a pair out of reach costs more than all that could be saved by it, so as few as possible are taken
    far = (d.max() + 1.0) * (min(units_p, units_r) + 1)
    table = np.full((len(cap_p), len(cap_r)), far)
    table[ip, ir] = d
    rows, cols = np.repeat(np.arange(len(cap_p)), list(cap_p.values())), np.repeat(np.arange(len(cap_r)), list(cap_r.values()))
    units = table[np.ix_(rows, cols)]
    partner = assign_table(units) if len(rows) <= len(cols) else _turned(assign_table(units.T), len(rows))
    took = partner >= 0
    flow = np.zeros(table.shape, dtype="int64")
    np.add.at(flow, (rows[took], cols[partner[took]]), 1)
    return flow[ip, ir].tolist()


def _turned(partner: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -1)
    out[partner] = np.arange(len(partner))
    return out


def assign_table(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a complete assignment of least total cost; rows are no more than columns.

    Each row in turn finds a shortest path, under potentials that keep reduced costs from being negative, to a
    free column; a step looks at a whole row of the table at once.
    """
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of, col_of = np.full(m, -1), np.full(n, -1)
    for start in range(n):
        reach, before, open_ = np.full(m, np.inf), np.full(m, -1), np.ones(m, bool)
        i, least, seen = start, 0.0, []
        while True:
            seen.append(i)
            step = least + cost[i] - u[i] - v
            nearer = open_ & (step < reach)
            reach[nearer] = step[nearer]
            before[nearer] = i
            j = int(np.argmin(np.where(open_, reach, np.inf)))
            least = reach[j]
            open_[j] = False
            if row_of[j] < 0:
                break
            i = row_of[j]
        rest = np.array(seen[1:], dtype=int)
        u[start] += least
        u[rest] += least - reach[col_of[rest]]
        v[~open_] -= least - reach[~open_]
        while True:  # turn the path around
            i = before[j]
            row_of[j], col_of[i], j = i, j, col_of[i]
            if i == start:
                break
    return col_of


def assign_component(preds: Sequence, refs: Sequence, dist: Sequence[float], cap_p: dict, cap_r: dict) -> list[int]:
    """Units sent along each edge ``(preds[i], refs[i])`` of one component.

    Most units first, least total distance second: cheapest augmenting paths
    with node potentials, each carrying as many units as its tightest step.
    """
    adj: dict = {}
    back: dict = {}
    for i, (p, r) in enumerate(zip(preds, refs)):
        adj.setdefault(p, []).append(i)
        back.setdefault(r, []).append(i)
    flow = [0] * len(dist)
    left_p, left_r = dict(cap_p), dict(cap_r)
    pot: dict = {("p", p): 0.0 for p in adj} | {("r", r): 0.0 for r in back}
    while True:
        best: dict = {}
        via: dict = {}
        heap: list = []
        for k, p in enumerate(adj):
            if left_p[p] > 0:
                best[("p", p)] = -pot[("p", p)]
                heap.append((best[("p", p)], k, ("p", p)))
        heapq.heapify(heap)
        tick, done = len(adj), set()
        while heap:
            d, _, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            side, name = node
            for i in adj[name] if side == "p" else back[name]:
                if side == "p":
                    other, step = ("r", refs[i]), dist[i]
                elif flow[i] > 0:
                    other, step = ("p", preds[i]), -dist[i]
                else:
                    continue
                nd = d + max(step + pot[node] - pot[other], 0.0)
                if other not in best or nd < best[other] - 1e-12:
                    best[other], via[other] = nd, i
                    tick += 1
                    heapq.heappush(heap, (nd, tick, other))
        ends = [(best[("r", r)] + pot[("r", r)], k, r) for k, r in enumerate(back) if left_r[r] > 0 and ("r", r) in best]
        if not ends:
            return flow
        r = min(ends)[2]
        for node, d in best.items():
            pot[node] += d
        steps, node = [], ("r", r)
        while node in via:
            i = via[node]
            steps.append((i, node[0] == "r"))
            node = ("p", preds[i]) if node[0] == "r" else ("r", refs[i])
        units = min([left_r[r], left_p[node[1]]] + [flow[i] for i, forward in steps if not forward])
        for i, forward in steps:
            flow[i] += units if forward else -units
        left_r[r] -= units
        left_p[node[1]] -= units


def gains_in_order(order: Sequence, adj: dict, cap_p: dict, cap_r: dict) -> dict:
    """Units each prediction adds to a maximum matching when they arrive in ``order``."""
    free = dict(cap_r)
    held: dict = {r: {} for r in cap_r}  # reference -> {prediction: units}
    gained: dict = {}
    for p in order:
        need, got = cap_p[p], 0
        while need:
            parent, stack, end = {}, [p], None
            seen = {p}
            while stack and end is None:
                u = stack.pop()
                for r in adj[u]:
                    if r in parent:
                        continue
                    parent[r] = u
                    if free[r] > 0:
                        end = r
                        break
                    for owner in held[r]:
                        if owner not in seen:
                            seen.add(owner)
                            parent[("own", owner)] = r
                            stack.append(owner)
            if end is None:
                break
            path, r = [], end
            while True:
                u = parent[r]
                path.append((u, r))
                if u == p:
                    break
                r = parent[("own", u)]
            # units move along the path; a prediction in the middle swaps one reference for another
            units = min([need, free[end]] + [held[parent[("own", u)]][u] for u, _ in path if u != p])
            free[end] -= units
            for u, r in path:
                held[r][u] = held[r].get(u, 0) + units
                if u != p:
                    old = parent[("own", u)]
                    held[old][u] -= units
                    if not held[old][u]:
                        del held[old][u]
            need -= units
            got += units
        gained[p] = got
    return gained
