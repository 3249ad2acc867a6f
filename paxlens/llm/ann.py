"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to the grid cell of ``k`` Gaussian (2-stable) projections.  A query visits
cells in the order of their estimated success, the sum of squared distances from its projected point to the cell's
slabs, produced by a heap over sorted per-line perturbations.  The number of cells visited is fitted on a bounded
sample so that recall of the ten nearest reaches ``TARGET`` there; where ``PROBES`` cells don't reach it the index gets
fewer lines, so larger cells, down to none, which is one cell of all rows.  Candidates of all tables are merged and
ranked by exact Euclidean distance in double precision (a matrix product picks them with room for its rounding).  Every
row is indexed.  Queries whose cells held fewer than k
candidates, such as those off the bulk, are compared with all rows, block by block.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import runs_of, unsigned_mod, written
from .embedding_dedup import usable

TABLES = 3
WIDTH = 1.06  # of a cell, in median nearest-to-random distances of the sample
TARGET = 0.97  # recall on the sample
SAMPLE = 8000  # rows the index is fitted on, by hash order
SAMPLE_QUERIES = 100
REACH = 4  # largest perturbation on a line
PROBES = 600  # cells of a table tried before the index gets fewer lines
CELL = 500  # rows of a cell aimed at
BLOCK = 4096  # rows of a cell in one block, of the index and of queries
PRODUCT = 1 << 21  # distances worked out at once
ROUNDING = 1e-9  # of the squared norms, more than a double's product of vectors can be off
SEED = 11


def probes(at: np.ndarray, most: int):
    """Cells (as integer offsets from the query's own) in ascending score, at most ``most``; ``at`` is the query's place in its cell, 0 to 1."""
    steps = np.arange(-REACH, REACH + 1)
    gap = np.where(steps[None] > 0, steps[None] - at[:, None], np.where(steps[None] < 0, at[:, None] - steps[None] - 1, 0.0))
    order = np.argsort(gap, axis=1, kind="stable")
    cost = np.take_along_axis(gap * gap, order, 1)
    delta = steps[order]
    k, m = cost.shape
    start = (0,) * k
    heap = [(float(cost[:, 0].sum()), start, 0)]
    while heap and most:
        score, state, last = heapq.heappop(heap)
        yield delta[np.arange(k), list(state)]
        most -= 1
        for line in range(last, k):  # each state is reached by raising lines from left to right, once
            if state[line] + 1 < m:
                up = (*state[:line], state[line] + 1, *state[line + 1 :])
                heapq.heappush(heap, (score + float(cost[line, up[line]] - cost[line, state[line]]), up, line))


class Index:
    """Hash functions fitted to a sample: lines, offsets, width, and how many cells a query visits in each table."""

    def __init__(self, sample: np.ndarray, n: int, k_near: int, exact: bool = False):
        dim = sample.shape[1]
        self.width, self.most, self.recall = 1.0, 1, 1.0
        if exact:
            self.draw(dim, 0)
            return
        q = sample[:SAMPLE_QUERIES]
        d = ((q[:, None] - sample[None, : 2 * SAMPLE_QUERIES]) ** 2).sum(2) ** 0.5
        self.width = WIDTH * float(np.median(d[d > 0])) if (d > 0).any() else 1.0
        for lines in range(max(3, round(math.log(max(n, 1) / CELL) / math.log(3.3))), -1, -1):
            self.draw(dim, lines)
            self.most, self.recall = self.fitted(sample, q, k_near)
            if self.recall >= TARGET:
                break

    def draw(self, dim: int, lines: int) -> None:
        """Hash functions of ``lines`` lines a table; without lines one table, whose only cell holds all rows."""
        rng = np.random.default_rng(SEED)
        self.lines, self.tables = lines, TABLES if lines else 1
        self.a = rng.standard_normal((TABLES, dim, lines))
        self.b = rng.uniform(0, 1, (TABLES, lines))
        self.mix = rng.integers(1, 2**62, lines, np.int64) | 1

    def place(self, v: np.ndarray, t: int) -> np.ndarray:
        return v @ self.a[t] / self.width + self.b[t]

    def key(self, cells: np.ndarray, t: int) -> np.ndarray:
        return (cells.astype(np.int64) * self.mix).sum(-1) + (t + 1) * 0x5851F42D

    def visited(self, point: np.ndarray, most: int) -> np.ndarray:
        own = np.floor(point)
        return own + np.array(list(probes(point - own, most)))

    def fitted(self, sample: np.ndarray, q: np.ndarray, k_near: int) -> tuple[int, float]:
        """Least number of cells, up to ``PROBES``, at which ``TARGET`` of the sample's true neighbours are found, and the share found."""
        ranks = np.full((len(q), min(k_near, len(sample) - 1)), PROBES)
        if not ranks.size:
            return PROBES, 1.0
        keys = [self.key(np.floor(self.place(sample, t)), t) for t in range(self.tables)]
        for i, v in enumerate(q):
            d = ((sample - v) ** 2).sum(1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: ranks.shape[1]]
            for t in range(self.tables):
                place = {int(x): r for r, x in reversed(list(enumerate(self.key(self.visited(self.place(v[None], t)[0], PROBES), t))))}
                ranks[i] = np.minimum(ranks[i], [place.get(int(x), PROBES) for x in keys[t][near]])
        most = min(int(np.quantile(ranks, TARGET, method="higher")) + 1, PROBES)
        return most, float((ranks < most).mean())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its ``k`` nearest of ``vectors`` (vec_id, embedding), itself apart.

    A query's own row is the one with its id.  Vectors that are null, zero or hold null or non-finite components, and rows
    with null ids, take no part; vectors of another length are no candidates; repeated rows count as one, and of queries with
    one id the least vector asks; ties go to the smaller id.  Fewer candidates give fewer rows; empty tables give none; other
    columns are ignored.  ``exact`` compares every query with every row, block by block, as a measure of recall.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = pick(vectors).dropDuplicates()
    # of equal vectors only the first k + 1 ids can be among anyone's k nearest
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = written(rows.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r").withColumn("dim", F.size("v")), "ann-rows")
    asked = written(pick(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "ann-queries")
    parts = []
    for dim, n in rows.groupBy("dim").count().orderBy("dim").collect():  # lengths, one in a sound table
        own, ask = rows.where(F.col("dim") == dim), asked.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).select("v").toPandas()
        index = Index(np.stack(sample.v.to_numpy()), n, k, exact)
        found = written(_best(_search(own, ask, index, k), k), "ann-found")
        parts.append(found)
        if index.lines:
            full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
            short = written(ask.join(full, "vec_id", "left_anti"), "ann-short")
            if not short.isEmpty():
                index.draw(dim, 0)
                parts.append(_search(own, short, index, k))
    kind = dict(vectors.dtypes)["vec_id"]
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return _best(found, k).withColumn("rank", F.row_number().over(last)).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10) -> float:
    """Share of the true ``k`` nearest, by comparison with every row, that ``found`` holds; 1 where there are none."""
    true = nearest(vectors, queries, k, exact=True).select("query_id", "vec_id")
    both = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 1.0


def _best(found: DataFrame, k: int) -> DataFrame:
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("rank")


def _search(rows: DataFrame, asked: DataFrame, index: Index, k: int) -> DataFrame:
    kind = dict(rows.dtypes)["vec_id"]

    def placed(batches):
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf.v.to_numpy())
                for t in range(index.tables):
                    yield pdf[["vec_id", "v"]].assign(cell=index.key(np.floor(index.place(v, t)), t))

    def visiting(batches):
        for pdf in batches:
            for i, v in zip(pdf.vec_id, pdf.v):
                q = np.asarray(v)[None]
                cells = np.unique(np.concatenate([index.key(index.visited(index.place(q, t)[0], index.most), t) for t in range(index.tables)]))
                yield pd.DataFrame({"query_id": np.repeat(np.asarray([i]), len(cells)), "cell": cells})

    there = written(rows.mapInPandas(placed, f"vec_id {kind}, v array<double>, cell long"), "ann-index")
    asks = written(asked.mapInPandas(visiting, f"query_id {kind}, cell long"), "ann-asks")
    sizes = there.groupBy("cell").agg(F.count("*").alias("n"))
    sizes = sizes.join(asks.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    sizes = sizes.select("cell", "n", "m", F.ceil(F.col("n") / BLOCK).cast("int").alias("xs"), F.ceil(F.col("m") / BLOCK).cast("int").alias("ys"))
    sizes = written(sizes, "ann-cells")
    met = sizes.agg(F.sum(F.col("n") * F.col("ys"))).first()[0] or 0
    bins = max(1, -(-met // (2 * BLOCK)))
    # a crowded cell is met block by block: each index block with each block of queries; such a meeting is a spot
    spot, bin_ = F.xxhash64("cell", "x", "y").alias("spot"), unsigned_mod(F.xxhash64("cell", "x", "y"), bins).alias("bin")
    left = there.join(sizes, "cell").withColumn("x", unsigned_mod(F.xxhash64("vec_id"), F.col("xs")).cast("int"))
    left = left.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)))
    right = asks.join(sizes, "cell").withColumn("y", unsigned_mod(F.xxhash64("query_id"), F.col("ys")).cast("int"))
    right = right.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    # cells travel as ids; a query's vector joins them once for each bin, however many of its cells fall there
    right = right.groupBy("query_id", bin_).agg(F.collect_list(spot).alias("spots"))
    right = right.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def ranked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(a) or not len(b):
            return none
        a = a.sort_values("spot", ignore_index=True)
        v, ids, q, who = np.stack(a.v.to_numpy()), a.vec_id.to_numpy(), np.stack(b.q.to_numpy()), b.query_id.to_numpy()
        asks = np.repeat(np.arange(len(b)), b.spots.map(len))
        spots = np.concatenate(b.spots.to_numpy())
        order = np.argsort(spots, kind="stable")
        asks, spots = asks[order], spots[order]
        starts = runs_of(a.spot.to_numpy())
        begin, end = (np.searchsorted(spots, a.spot.to_numpy()[starts[:-1]], side) for side in ("left", "right"))
        nv, nq = (v * v).sum(1), (q * q).sum(1)
        out_q, out_v, out_d = [], [], []
        for s, e, f, t in zip(starts[:-1], starts[1:], begin, end):
            for at in range(f, t, max(1, PRODUCT // (e - s))):
                some = asks[at : min(t, at + max(1, PRODUCT // (e - s)))]
                i, j = _near(q[some], nq[some], who[some], v[s:e], nv[s:e], ids[s:e], k)
                d = np.sqrt(((v[s + j] - q[some[i]]) ** 2).sum(1))
                out_q.append(some[i])
                out_v.append(s + j)
                out_d.append(d)
        if not out_q:
            return none
        i, j, d = map(np.concatenate, (out_q, out_v, out_d))
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (ids[j[1:]] != ids[j[:-1]]) | (d[1:] != d[:-1])  # met in several tables
        i, j, d = i[new], j[new], d[new]
        first = runs_of(i)
        keep = np.arange(len(i)) - np.repeat(first[:-1], np.diff(first)) < k
        return pd.DataFrame({"query_id": who[i[keep]], "vec_id": ids[j[keep]], "score": d[keep]})

    form = T._parse_datatype_string(f"query_id {kind}, vec_id {kind}, score double")
    a, b = left.select(bin_, spot, "vec_id", "v"), right.select(F.col("bin"), "query_id", "q", "spots")
    return a.groupBy("bin").cogroup(b.groupBy("bin")).applyInPandas(ranked, form)


def _near(q: np.ndarray, nq: np.ndarray, who: np.ndarray, v: np.ndarray, nv: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that hold each query's k nearest rows, its own apart: one matrix product, and what rounding leaves open beside."""
    with np.errstate(all="ignore"):  # squares of huge components may overflow; such pairs stay
        d = nq[:, None] + nv[None] - 2 * (q @ v.T)
        slack = ROUNDING * (nq + nv.max())
    own = who[:, None] == ids[None]
    if len(v) > k + 1:
        d[own] = np.inf
        near = ~(d > np.partition(d, k - 1, axis=1)[:, k - 1 : k] + slack[:, None])
        return np.nonzero(near & ~own)
    return np.nonzero(~own)
