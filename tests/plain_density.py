"""Density clustering of a few points by all their distances, to compare with."""

from __future__ import annotations

import numpy as np


def spanning_tree(x: np.ndarray, core: np.ndarray | None = None) -> np.ndarray:
    """Edges (a, b, length) of a minimum spanning tree, shortest first; with core distances, of mutual reachability."""
    n = len(x)
    best, source, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        if core is not None:
            d = np.maximum(d, np.maximum(core, core[at]))
        nearer = ~inside & (d < best)
        best[nearer], source[nearer] = d[nearer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((source[at], at, best[at]))
    out = np.array(edges, float).reshape(-1, 3)
    return out[np.argsort(out[:, 2], kind="stable")]


def neighbour_distances(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of and distances to each point's k nearest others, in slices of 500 points."""
    k = min(k, len(x) - 1)
    near, far = np.zeros((len(x), k), int), np.zeros((len(x), k))
    for i in range(0, len(x), 500):
        d = np.sqrt(np.maximum(((x[i : i + 500, None] - x[None]) ** 2).sum(2), 0)) if x.shape[1] * len(x) < 4_000_000 else np.sqrt(np.maximum((x[i : i + 500] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[i : i + 500] @ x.T, 0))
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near[i : i + 500] = np.argsort(d, 1, kind="stable")[:, :k]
        far[i : i + 500] = np.take_along_axis(d, near[i : i + 500], 1)
    return near, far


def density_clusters(x: np.ndarray, least: int, neighbours: int | None = None) -> np.ndarray:
    """Labels from a hierarchy of density (HDBSCAN, Campello et al. 2013): clusters of `least` points on, chosen by
    excess of mass; -1 is noise. Labels are numbered by size."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1)
    core = neighbour_distances(x, min(neighbours or least, n - 1))[1][:, -1]
    # Single linkage: each merge is a node above its two parts.
    up, size, node_of = np.arange(n), [1] * n, list(range(n))
    parts: dict[int, tuple[int, int, float]] = {}

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b, d in spanning_tree(x, core):
        ra, rb = find(int(a)), find(int(b))
        node = len(size)
        parts[node] = node_of[ra], node_of[rb], float(d)
        size.append(size[node_of[ra]] + size[node_of[rb]])
        up[rb], node_of[ra] = ra, node
    # Condensed: a cluster goes on until it splits in two parts of at least `least` points.
    members, mass, children = {0: []}, {0: 0.0}, {0: []}
    todo, next_id = [(len(size) - 1, 0, 0.0)], 1

    def leaves(node):
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += parts[v][:2]
        return out

    while todo:
        node, cluster, born = todo.pop()
        if node < n:
            members[cluster].append(node)
            continue
        a, b, d = parts[node]
        level = 1 / d if d > 0 else 1e12
        big = [p for p in (a, b) if size[p] >= least]
        if len(big) == 2:
            mass[cluster] += (level - born) * size[node]
            for p in big:
                members[next_id], mass[next_id], children[next_id] = [], 0.0, []
                children[cluster].append(next_id)
                todo.append((p, next_id, level))
                next_id += 1
        else:
            for p in (a, b):
                if p in big:
                    todo.append((p, cluster, born))
                else:
                    lost = leaves(p)
                    members[cluster] += lost
                    mass[cluster] += (level - born) * len(lost)
    chosen, total = set(), {}
    for c in range(next_id - 1, -1, -1):
        below = sum(total[k] for k in children[c])
        if c and (not children[c] or mass[c] >= below):
            total[c] = mass[c]
            chosen.add(c)
        else:
            total[c] = below
    labels, order = np.full(n, -1), []
    stack = [0]
    while stack:
        c = stack.pop()
        if c in chosen:
            inside, below = [], [c]
            while below:
                k = below.pop()
                inside += members[k]
                below += children[k]
            order.append(sorted(inside))
        else:
            stack += children[c]
    for label, inside in enumerate(sorted(order, key=lambda m: (-len(m), m[:1]))):
        labels[inside] = label
    return labels
