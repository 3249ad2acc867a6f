"""Iterative graph measures of one graph in numpy: components, PageRank, betweenness, Louvain communities.

A graph is a node count and an array of directed pairs without repeats.  Sums run in node order, so results don't depend
on how rows arrived.
"""

from __future__ import annotations

import random

import numpy as np

ALPHA, TOLERANCE, MOST_STEPS = 0.85, 1e-4, 50
SEED = 42
STATES = 1 << 21  # (source, node) pairs followed at once


def components(n: int, edges: np.ndarray) -> np.ndarray:
    """Smallest node of each node's weakly connected component."""
    label = np.arange(n)
    while len(edges):
        low = np.minimum(label[edges[:, 0]], label[edges[:, 1]])
        new = label.copy()
        np.minimum.at(new, edges[:, 0], low)
        np.minimum.at(new, edges[:, 1], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def degree_centrality(n: int, edges: np.ndarray) -> np.ndarray:
    if n <= 1:
        return np.ones(n)
    return np.bincount(edges.ravel(), minlength=n) / (n - 1)


def pagerank(n: int, edges: np.ndarray, alpha: float = ALPHA, tolerance: float = TOLERANCE, steps: int = MOST_STEPS) -> np.ndarray | None:
    """Stops when the summed change falls below n times the tolerance; None if it doesn't within the steps."""
    if not n:
        return np.zeros(0)
    out = np.bincount(edges[:, 0], minlength=n).astype(float)
    sinks = out == 0
    share = 1 / out[edges[:, 0]] if len(edges) else np.zeros(0)
    x = np.full(n, 1 / n)
    for _ in range(steps):
        new = alpha * (np.bincount(edges[:, 1], x[edges[:, 0]] * share, n) + x[sinks].sum() / n) + (1 - alpha) / n
        if np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    return None


def betweenness(n: int, edges: np.ndarray, sources: int | None = None, seed: int = SEED, block: tuple[int, int] = (0, 1)) -> np.ndarray:
    """Shortest-path betweenness, normalised; from a seeded sample of ``sources`` nodes where that is fewer than all.

    Breadth-first from many sources at once, level by level, then back.  ``block`` (i, k) takes every k-th source from the
    i-th on: the sum over all blocks is the whole measure.
    """
    chosen = list(range(n)) if sources is None or sources >= n else random.Random(seed).sample(range(n), sources)
    order = np.argsort(edges[:, 0], kind="stable") if len(edges) else np.zeros(0, int)
    follow = edges[order, 1] if len(edges) else np.zeros(0, int)
    degree = np.bincount(edges[:, 0], minlength=n) if len(edges) else np.zeros(n, int)
    first = np.concatenate([[0], np.cumsum(degree)])
    total = np.zeros(n)
    own, most = np.array(chosen[block[0] :: block[1]], int), max(1, STATES // max(1, n))
    for at in range(0, len(own), most):
        some = own[at : at + most]
        paths, depth = np.zeros(len(some) * n), np.full(len(some) * n, -1, np.int32)
        front = np.arange(len(some)) * n + some
        start = front
        paths[front], depth[front] = 1, 0
        levels = []
        while len(front):
            count = degree[front % n]
            back = np.repeat(front, count)
            step = np.arange(len(back)) - np.repeat(np.cumsum(count) - count, count)
            ahead = back - back % n + follow[np.repeat(first[front % n], count) + step]
            fresh = np.unique(ahead[depth[ahead] < 0])
            depth[fresh] = len(levels) + 1
            on = depth[ahead] == len(levels) + 1
            back, ahead = back[on], ahead[on]
            np.add.at(paths, ahead, paths[back])
            levels.append((back, ahead))
            front = fresh
        credit = np.zeros(len(paths))
        for back, ahead in reversed(levels):
            np.add.at(credit, back, paths[back] / paths[ahead] * (1 + credit[ahead]))
        credit[start] = 0
        total += credit.reshape(len(some), n).sum(0)
    if n > 2:
        total /= (n - 1) * (n - 2)
        if len(chosen) < n:
            total *= n / len(chosen)
    return total


def betweenness_sources(n: int) -> int:
    return min(n, max(100, int(0.01 * n)))


def louvain(n: int, edges: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Communities of the undirected graph by greedy modularity, level by level; labels are 0, 1, ... by first node."""
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b in {(min(a, b), max(a, b)) for a, b in edges.tolist()}:
        links[a][b] = 1.0
        links[b][a] = 1.0  # a loop is one entry
    rng = random.Random(seed)
    member = np.arange(n)
    while True:
        size = len(links)
        degree = [sum(x.values()) + x.get(i, 0.0) for i, x in enumerate(links)]
        whole = sum(degree)
        if not whole:
            break
        of, load = list(range(size)), list(degree)
        order = list(range(size))
        rng.shuffle(order)
        moved = improved = True
        improved = False
        while moved:
            moved = False
            for v in order:
                toward: dict[int, float] = {}
                for w, x in links[v].items():
                    if w != v:
                        toward[of[w]] = toward.get(of[w], 0.0) + x
                own = of[v]
                load[own] -= degree[v]
                best, gain = own, toward.get(own, 0.0) - load[own] * degree[v] / whole
                for c, x in sorted(toward.items()):
                    if (g := x - load[c] * degree[v] / whole) > gain + 1e-12:
                        best, gain = c, g
                load[best] += degree[v]
                if best != own:
                    of[v], moved, improved = best, True, True
        if not improved:
            break
        names = {c: i for i, c in enumerate(dict.fromkeys(of))}
        coarse: list[dict[int, float]] = [{} for _ in names]
        for v, x in enumerate(links):
            for w, weight in x.items():
                if w >= v:
                    a, b = names[of[v]], names[of[w]]
                    coarse[a][b] = coarse[a].get(b, 0.0) + weight
                    if a != b:
                        coarse[b][a] = coarse[b].get(a, 0.0) + weight
        member = np.array([names[of[m]] for m in member])
        links = coarse
    first = {c: i for i, c in enumerate(dict.fromkeys(member.tolist()))}
    return np.array([first[c] for c in member.tolist()], int)


def modularity(n: int, edges: np.ndarray, member: np.ndarray) -> float:
    pairs = {(min(a, b), max(a, b)) for a, b in edges.tolist()}
    m = len(pairs)
    if not m:
        return 0.0
    degree = np.zeros(n)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    inside = sum(member[a] == member[b] for a, b in pairs) / m
    return inside - sum((degree[member == c].sum() / (2 * m)) ** 2 for c in set(member.tolist()))
