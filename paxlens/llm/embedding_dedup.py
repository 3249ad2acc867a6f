"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random lines.  On each line the values are sorted, every vector opens a
window of half-width ``WINDOW`` times the largest distance of a linked pair around its own value, and a pair collides
when one lies in the other's window.  A pair at the threshold collides on each line with a known chance, so the count
needed follows from the binomial law; pairs that reach it are verified by exact cosine.

Vectors meet only within their label.  A label of more than two blocks of distinct vectors is dealt by a few leading
projections into cells, in as many tables as the recall asks for, so the work per vector grows far slower than the label.
A pair at the threshold can so be missed twice, by the cells and by the count: each step is calibrated to the root of
``RECALL``, so the product reaches it at every size.  A cell that is still larger is split into block pairs of bounded size.  Equal vectors are one row with a
count, so copies are never expanded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, local_roots, runs_of, unsigned_mod, written

PROJECTIONS = 16
WINDOW = 3.0  # half-width of a window, in distances of a pair at the threshold
RECALL = 0.9999  # of both steps together, for pairs exactly at the threshold; closer pairs exceed it
STEP_RECALL = math.sqrt(RECALL)
BLOCK = 4096  # vectors in a block
LEAD_WIDTH = 4.0  # width of a leading cell, in distances of a pair at the threshold
SEED = 7
TILE = 64


def usable(v: Column) -> Column:
    """Neither null, zero nor with null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def needed(recall: float = STEP_RECALL) -> int:
    """Largest count that a pair at the threshold reaches with chance ``recall``."""
    p = math.erf(WINDOW / math.sqrt(2))
    tail = 0.0
    for c in range(PROJECTIONS, -1, -1):
        tail += math.comb(PROJECTIONS, c) * p**c * (1 - p) ** (PROJECTIONS - c)
        if tail >= recall:
            return c
    return 0


def lead_chances(threshold: float) -> tuple[float, float]:
    """Chance that a pair at the threshold, and a pair at right angles, share one leading cell."""
    r = math.sqrt(2 * (1 - threshold))

    def same(d: float, w: float) -> float:
        t = w / d
        return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))

    return same(r, LEAD_WIDTH * r), same(math.sqrt(2), LEAD_WIDTH * r)


def lead_plan(n: int, threshold: float, block: int) -> tuple[int, int]:
    """(leading projections, tables) for a label of n vectors; (0, 1) where it fits one or two blocks."""
    if n <= 2 * block:
        return 0, 1
    near, far = lead_chances(threshold)
    k = max(1, math.ceil(math.log(n / block) / math.log(1 / far)))
    tables = max(1, math.ceil(math.log(1 - STEP_RECALL) / math.log1p(-(near**k))))
    return (0, 1) if tables * far**k > 0.5 else (k, tables)


def collisions(p: np.ndarray, w: float, a: slice, b: slice):
    """Yields (rows of a, counts): on how many lines each row of b lies in the window of a row of a, tile by tile."""
    n, m = p.shape
    rank, low, wide = (np.empty((m, n), np.uint16) for _ in range(3))
    for k in range(m):
        order = np.argsort(p[:, k], kind="stable")
        line = p[order, k]
        rank[k, order] = np.arange(n)
        low[k] = np.searchsorted(line, p[:, k] - w, "left")
        wide[k] = np.searchsorted(line, p[:, k] + w, "right") - low[k]
    room, hits = np.empty(TILE * n, np.uint16), np.empty(TILE * n, bool)
    for at in range(a.start, a.stop, TILE):
        q = slice(at, min(at + TILE, a.stop))
        first = max(b.start, q.start) if a == b else b.start  # pairs within a block once
        shape = (q.stop - q.start, b.stop - first)
        count = np.zeros(shape, np.uint8)
        off, hit = (x[: shape[0] * shape[1]].reshape(shape) for x in (room, hits))
        for k in range(m):
            np.subtract(rank[k, None, first : b.stop], low[k, q, None], out=off)
            np.less(off, wide[k, q, None], out=hit)
            count += hit.view(np.uint8)
        yield q.start, first, count


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Two rows link when their labels are equal and not null, their vectors usable and of one length, and their cosine in
    double precision is at least ``threshold``.  Rows that can't link come back with no links and themselves as component.
    Repeated rows link with each other and come back as often; a null vec_id counts as a link of others, takes its
    component's smallest other id (null if none) and is never kept.  An empty table gives no rows; other columns are
    ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    ok = usable(F.col("v")) & F.col("label").isNotNull()
    dim = F.size("v").alias("dim")
    nodes = rows.where(ok).groupBy("label", dim, "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    width = LEAD_WIDTH * math.sqrt(2 * (1 - threshold))
    window = WINDOW * math.sqrt(2 * (1 - threshold))

    def dealt(batches):
        for pdf in batches:
            for (dim, n), g in pdf.groupby(["dim", "n"]):
                k, tables = lead_plan(int(n), threshold, block)
                if not k:
                    yield g.assign(cell=0, tab=0, cells=[[0]] * len(g)).drop(columns="n")
                    continue
                rng = np.random.default_rng([SEED, int(dim), k])
                lines = rng.standard_normal((int(dim), k * tables))
                at = np.floor((unit(np.stack(g.v.to_numpy())) @ lines + rng.uniform(0, width, k * tables)) / width).astype(np.int64)
                mix = rng.integers(1, 2**62, k, np.int64) | 1
                cells = [(at[:, t * k : t * k + k] * mix).sum(1) for t in range(tables)]
                own = list(np.stack(cells, 1))
                for t in range(tables):
                    yield g.assign(cell=cells[t], tab=t, cells=own).drop(columns="n")

    kind = dict(nodes.dtypes)["label"]
    form = f"label {kind}, dim int, v array<double>, copies long, node long, cell long, tab int, cells array<long>"
    placed = nodes.join(sizes, ["label", "dim"]).select("label", "dim", "v", "copies", "node", "n").mapInPandas(dealt, form)
    placed = written(placed, "vector-cells")
    key = ["label", "dim", "tab", "cell"]
    full = placed.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1")
    placed = placed.join(full, key)
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = placed.withColumn("block", unsigned_mod(F.xxhash64("node"), blocks).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other", "size")
    least = needed()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [one(g) for _, g in pdf.groupby(["label", "dim", "tab", "cell", "x", "y"], sort=False)]
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []})

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["block", "node"], ignore_index=True)
        n, node, copies = len(g), g.node.to_numpy(), g.copies.to_numpy()
        u = unit(np.stack(g.v.to_numpy()))
        p = (u @ np.random.default_rng([SEED, u.shape[1]]).standard_normal((u.shape[1], PROJECTIONS))).astype(np.float32)
        cut = int(runs_of(g.block.to_numpy())[1])
        a, b = (slice(0, n), slice(0, n)) if g.x[0] == g.y[0] else (slice(0, cut), slice(cut, n))
        tab, cells = int(g.tab[0]), np.stack(g.cells.to_numpy())
        links, root = np.zeros(n, np.int64), np.arange(n)
        for q, first, count in collisions(p, window, a, b):
            i, j = np.nonzero(count >= least)
            i, j = i + q, j + first
            if a == b:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 65536):
                s, t = i[k : k + 65536], j[k : k + 65536]
                near = np.einsum("ij,ij->i", u[s], u[t]) >= threshold
                if tab:  # a pair counts in the first table where it shares a cell
                    near &= ~(cells[s, :tab] == cells[t, :tab]).any(1)
                s, t = s[near], t[near]
                np.add.at(links, s, copies[t])
                np.add.at(links, t, copies[s])
                if len(s):
                    root = local_roots(n, np.concatenate([np.arange(n), s]), np.concatenate([root, t]))
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": node[at], "links": links[at], "root": node[root[at]]})

    bins = max(1, -(-placed.count() // (2 * block)))
    found = placed.groupBy(unsigned_mod(F.xxhash64(*key, "x", "y"), bins).alias("bin")).applyInPandas(group, "node long, links long, root long")
    found = written(found, "vector-links")
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(comp, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.where(ok).join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~ok | ok.isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
