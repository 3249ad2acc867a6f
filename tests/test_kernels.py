"""Graph measures on graphs with known answers."""

from __future__ import annotations

import numpy as np
import pytest

from paxlens.operators import kernels
from paxlens.operators.features import measured

NONE = np.zeros((0, 2), int)


def clique(nodes):
    return [(a, b) for a in nodes for b in nodes if a < b]


def test_path_betweenness():
    n = 6
    got = kernels.betweenness(n, np.array([(i, i + 1) for i in range(n - 1)]))
    assert got == pytest.approx([i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)])


def test_cycle_pagerank_is_uniform():
    assert kernels.pagerank(3, np.array([(0, 1), (1, 2), (2, 0)])) == pytest.approx([1 / 3] * 3)


def test_pagerank_gives_up():
    assert kernels.pagerank(2, np.array([(0, 1)]), tolerance=0.0, steps=3) is None


def test_cliques():
    edges = np.array(clique(range(4)) + clique(range(4, 8)))
    assert len(set(kernels.components(8, edges).tolist())) == 2
    assert kernels.louvain(8, edges).tolist() == [0] * 4 + [1] * 4
    f = measured(8, edges, np.array([1, 0, 0, 0, 1, 0, 0, 0], bool))
    assert f["community"].tolist() == [0] * 4 + [1] * 4 and f["component"][[0, 4]].tolist() == [0, 1] and np.isnan(f["component"][1])


def test_louvain_improves_modularity():
    rng = np.random.default_rng(0)
    edges = np.array([(a, b) for a in range(40) for b in range(40) if a < b and rng.random() < (0.4 if a // 10 == b // 10 else 0.02)])
    c = kernels.louvain(40, edges)
    assert len(c) == 40 and kernels.modularity(40, edges, c) > max(0.4, kernels.modularity(40, edges, np.arange(40)))


def test_one_marked_node():
    f = measured(3, np.array([(0, 1), (1, 2)]), np.array([0, 1, 0], bool))
    assert f["component"][1] == 0 and not any(k.endswith("_in") for k in f) and f["betweenness"][1] == pytest.approx(0.5)


def plain_betweenness(n, edges):
    """By its definition: over all pairs, the share of shortest paths through a node."""
    follow = {i: [b for a, b in edges if a == i] for i in range(n)}
    out = np.zeros(n)
    for s in range(n):
        found, front = {s: [[s]]}, [s]
        while front:
            new = {}
            for v in front:
                for w in follow[v]:
                    if w not in found:
                        new.setdefault(w, []).extend([*p, w] for p in found[v])
            found |= new
            front = list(new)
        for t, paths in found.items():
            for p in paths:
                for v in p[1:-1]:
                    out[v] += 1 / len(paths)
    return out / ((n - 1) * (n - 2))


def test_betweenness_by_definition(monkeypatch):
    rng = np.random.default_rng(3)
    edges = np.array(sorted({(int(a), int(b)) for a, b in rng.integers(0, 14, (40, 2))}))
    want = plain_betweenness(14, edges.tolist())
    assert kernels.betweenness(14, edges) == pytest.approx(want)
    monkeypatch.setattr(kernels, "STATES", 30)
    assert sum(kernels.betweenness(14, edges, block=(i, 3)) for i in range(3)) == pytest.approx(want)


def test_large_packages_are_spread_over_calls(spark, monkeypatch):
    from paxlens.operators import features

    n = 60
    nodes = spark.createDataFrame([("p", f"n{i:02d}", f"n{i:02d}", ["R"] if i % 7 == 0 else []) for i in range(n)], "package_id string, node_id string, order string, hit_rules array<string>")
    edges = spark.createDataFrame([("p", f"n{i:02d}", f"n{(i * 7 + k) % n:02d}", i * 2 + k) for i in range(n) for k in (1, 3)], "package_id string, src string, dst string, edge_seq int")
    whole = features.kernel_features(nodes, edges).collect()
    monkeypatch.setattr(features, "SOURCE_WORK", 1000)
    spread = features.kernel_features(nodes, edges).collect()
    assert len(whole) == len(spread) == 1 and all(spread[0][c] == pytest.approx(whole[0][c]) for c in whole[0].asDict())
    some = features.kernel_features(nodes, edges, ("pagerank",))
    assert some.columns == ["package_id", "mean_malicious_pagerank", "max_malicious_pagerank", "sum_malicious_pagerank"]


def test_sampled_betweenness_is_scaled():
    assert kernels.betweenness_sources(100) == 100 and kernels.betweenness_sources(5000) == 100 and kernels.betweenness_sources(20000) == 200
    edges = np.array([(i, (i + 1) % 200) for i in range(200)])
    assert kernels.betweenness(200, edges, 100).sum() == pytest.approx(kernels.betweenness(200, edges).sum(), rel=0.05)


def test_empty():
    assert kernels.louvain(3, NONE).tolist() == [0, 1, 2] and kernels.degree_centrality(1, NONE).tolist() == [1] and len(kernels.pagerank(0, NONE)) == 0
