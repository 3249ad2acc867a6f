"""Graph features of packages: marked-node shares, density, centrality, communities.

What SQL expresses is relational and shares the key package_id.  PageRank, betweenness and communities need iteration
within one package: they run as one cogrouped function per package, only for packages that have a marked node, and give
measures of nodes, which are aggregated relationally; the sources of betweenness in a large package are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import CODES, GRAPH_FEATURES
from ..session import dropped, written
from . import kernels


def is_marked() -> Column:
    return F.size("hit_rules") > 0


def share_columns() -> list[Column]:
    """Aggregates: counts, ratio, category diversity and category ratios, zeros where nothing is marked."""
    m = F.count_if(is_marked())
    part = lambda x: F.when(m > 0, x / m).otherwise(F.lit(0.0))
    return [
        m.alias("malicious_node_count"),
        (m / F.count("*")).alias("malicious_ratio"),
        F.size(F.collect_set("category")).cast("long").alias("category_diversity"),  # five codes at most
        *(part(F.count_if(is_marked() & (F.col("category") == c))).alias(f"{c}_ratio") for c in CODES),
    ]


def shares(marked: DataFrame) -> DataFrame:
    """share_columns() of every package."""
    return marked.groupBy("package_id").agg(*share_columns())


def inner_edges(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are marked."""
    ids = marked.where(is_marked()).select("package_id", "node_id")
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), ["package_id", end], "left_semi")
    return edges


def density(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """package_id, malicious_internal_edges, malicious_density of packages with a marked node."""
    n = marked.where(is_marked()).groupBy("package_id").agg(F.count("*").alias("n"))
    e = inner_edges(marked, edges).groupBy("package_id").agg(F.count("*").alias("m"))
    m = F.coalesce("m", F.lit(0))
    return n.join(e, "package_id", "left").select("package_id", m.alias("malicious_internal_edges"), F.when(F.col("n") > 1, m / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("malicious_density"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """package_id, node_id, degree (both directions) and degree centrality of every node."""
    ends = edges.select("package_id", F.col("src").alias("node_id")).unionAll(edges.select("package_id", "dst"))
    count = ends.groupBy("package_id", "node_id").agg(F.count("*").alias("degree"))
    size = nodes.groupBy("package_id").agg(F.count("*").alias("n"))
    d = F.coalesce("degree", F.lit(0))
    return (
        nodes.select("package_id", "node_id").join(count, ["package_id", "node_id"], "left").join(size, "package_id")
        .select("package_id", "node_id", d.alias("degree"), F.when(F.col("n") > 1, d / (F.col("n") - 1)).otherwise(F.lit(1.0)).alias("centrality"))
    )


def degree_features(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean and largest degree centrality of the marked nodes in the whole graph."""
    of = degrees(marked, edges).join(marked.where(is_marked()).select("package_id", "node_id"), ["package_id", "node_id"], "left_semi")
    return of.groupBy("package_id").agg(F.avg("centrality").alias("mean_degree_centrality_full"), F.max("centrality").alias("max_degree_centrality_full"))


def community_features(marked: DataFrame, community: str = "community", mark: Column | None = None) -> DataFrame:
    """Communities with a marked node, largest marked share of one, and the entropy of marked nodes over them.

    ``marked`` carries a community column; nodes are marked by their hits or by ``mark``; packages without a marked node are
    left out.
    """
    per = marked.groupBy("package_id", community).agg(F.count_if(is_marked() if mark is None else mark).alias("k"), F.count("*").alias("n")).where("k > 0")
    whole = per.groupBy("package_id").agg(F.sum("k").alias("m"))
    p = F.col("k") / F.col("m")
    return per.join(whole, "package_id").groupBy("package_id").agg(
        F.count("*").alias("num_malicious_communities"), F.max(F.col("k") / F.col("n")).alias("max_community_maliciousness_ratio"), F.sum(-p * F.log2(p)).alias("malicious_community_entropy")
    )


def components_frame(nodes: DataFrame, edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """package_id, node_id, component: smallest node_id reachable, by least labels with pointer jumping.

    For graphs too large for one task.  Each round is written, so plans stay small; rounds grow with the logarithm of the
    longest path.  Edges without both ends are ignored.
    """
    both = written(edges.select("package_id", "src", "dst").unionAll(edges.select("package_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "component-edges")
    label = written(nodes.select("package_id", "node_id", F.col("node_id").alias("component")), "components")
    mark = None
    for _ in range(most_rounds):
        near = both.join(label.withColumnRenamed("node_id", "dst"), ["package_id", "dst"]).groupBy("package_id", F.col("src").alias("node_id")).agg(F.min("component").alias("low"))
        low = written(label.join(near, ["package_id", "node_id"], "left").select("package_id", "node_id", F.least("component", F.coalesce("low", "component")).alias("component")), "components")
        jump = low.select("package_id", F.col("node_id").alias("component"), F.col("component").alias("next"))
        new = written(low.join(jump, ["package_id", "component"]).select("package_id", "node_id", F.col("next").alias("component")), "components")
        for old in (label, low):
            dropped(old)
        label = new
        (now,) = label.agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()
        if now == mark:
            return label
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def pagerank_frame(nodes: DataFrame, edges: DataFrame, steps: int, alpha: float = kernels.ALPHA) -> DataFrame:
    """package_id, node_id, rank after a fixed number of steps, relational: every step joins and groups by package.

    For graphs too large for one task; for usual packages ``kernel_features`` stops when it has converged.  Each step is
    written, so plans stay small.
    """
    size = nodes.groupBy("package_id").agg(F.count("*").alias("n"))
    out = edges.groupBy("package_id", F.col("src").alias("node_id")).agg(F.count("*").alias("out"))
    links = written(edges.select("package_id", "src", "dst"), "pagerank-edges")
    base = nodes.select("package_id", "node_id").join(size, "package_id").join(out, ["package_id", "node_id"], "left")
    rank = written(base.withColumn("rank", 1 / F.col("n")), "pagerank")
    for _ in range(steps):
        flow = links.join(rank.select("package_id", F.col("node_id").alias("src"), (F.col("rank") / F.col("out")).alias("x")), ["package_id", "src"]).groupBy("package_id", F.col("dst").alias("node_id")).agg(F.sum("x").alias("x"))
        sinks = rank.groupBy("package_id").agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("d"))
        value = F.lit(alpha) * (F.coalesce("x", F.lit(0.0)) + F.col("d") / F.col("n")) + (1 - alpha) / F.col("n")
        new = written(rank.join(flow, ["package_id", "node_id"], "left").join(sinks, "package_id").select("package_id", "node_id", "n", "out", value.alias("rank")), "pagerank")
        dropped(rank)
        rank = new
    return rank.select("package_id", "node_id", "rank")


MEASURES = ("component", "pagerank", "betweenness", "inside", "community")
INSIDE = ("degree", "pagerank", "betweenness")
SOURCE_WORK = 1 << 26  # sources times edges that one task follows for betweenness


def measured(n: int, edges: np.ndarray, marks: np.ndarray, which: tuple[str, ...] = MEASURES, block: tuple[int, int] = (0, 1)) -> dict[str, np.ndarray]:
    """Iterative measures of one package's nodes; each on its own, a failing one is left out.

    component (of marked nodes among themselves, by their smallest place there), pagerank, betweenness (the share of one
    block of sources), community, and degree_in, pagerank_in, betweenness_in within the marked nodes' own graph.
    """
    at = np.flatnonzero(marks)
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    inner = place[edges[marks[edges[:, 0]] & marks[edges[:, 1]]]] if len(edges) else edges

    def spread(x):
        out = np.full(n, np.nan)
        out[at] = x
        return out

    def inside():
        if len(at) < 2:
            return {}
        found = (kernels.degree_centrality(len(at), inner), kernels.pagerank(len(at), inner), kernels.betweenness(len(at), inner))
        return {f"{name}_in": spread(x) for name, x in zip(INSIDE, found) if x is not None}

    make = {
        "component": lambda: {"component": spread(kernels.components(len(at), inner))},
        "pagerank": lambda: {} if (x := kernels.pagerank(n, edges)) is None else {"pagerank": x},
        "betweenness": lambda: {"betweenness": kernels.betweenness(n, edges, kernels.betweenness_sources(n), block=block)},
        "inside": inside,
        "community": lambda: {"community": kernels.louvain(n, edges).astype(float)},
    }
    out: dict[str, np.ndarray] = {}
    for name in MEASURES:
        if name in which and (block[0] == 0 or name == "betweenness"):
            try:
                out |= make[name]()
            except (ArithmeticError, ValueError, IndexError):
                continue
    return out


def node_measures(marked: DataFrame, edges: DataFrame, which: tuple[str, ...] = MEASURES) -> DataFrame:
    """package_id, node_id, place, mark and the columns of measured() for all nodes of packages with a marked node; null where not made.

    Needs columns order (of nodes) and edge_seq to be reproducible.  A package is one function call, except that the sources
    of betweenness in large ones are spread over several, each with its share of the sum.
    """
    live = marked.where(is_marked()).select("package_id").distinct()
    nodes = marked.select("package_id", "node_id", "order", is_marked().alias("mark")).join(live, "package_id", "left_semi")
    links = edges.select("package_id", "src", "dst", "edge_seq").join(live, "package_id", "left_semi")
    size = nodes.groupBy("package_id").agg(F.count("*").alias("n")).join(links.groupBy("package_id").agg(F.count("*").alias("m")), "package_id", "left")
    sources = F.least("n", F.greatest(F.lit(100), F.floor(F.col("n") * 0.01)))
    blocks = size.select("package_id", F.greatest(F.lit(1), F.ceil(sources * F.coalesce("m", F.lit(0)) / SOURCE_WORK)).cast("int").alias("blocks"))
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = [c for m in MEASURES for c in ([f"{x}_in" for x in INSIDE] if m == "inside" else [m])]
    form = ", ".join(["package_id string", "node_id string", "place long", "mark boolean", *(f"{c} double" for c in names)])

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({c: [] for c in ("package_id", "node_id", "place", "mark", *names)})
        block = (int(n.block.iloc[0]), int(n.blocks.iloc[0]))
        n = n.assign(order=n.order.map(lambda o: tuple(o.values()) if isinstance(o, dict) else tuple(o) if hasattr(o, "__iter__") and not isinstance(o, str) else (o,))).sort_values(["order", "node_id"], ignore_index=True)
        place = {x: i for i, x in enumerate(n.node_id)}
        e = e.sort_values("edge_seq")
        pairs = np.array([(place[a], place[b]) for a, b in dict.fromkeys(zip(e.src, e.dst)) if a in place and b in place], int).reshape(-1, 2)
        found = measured(len(n), pairs, n.mark.to_numpy(bool), which, block)
        return pd.DataFrame({"package_id": n.package_id, "node_id": n.node_id, "place": n.index, "mark": n.mark, **{c: found.get(c, np.full(len(n), np.nan)) for c in names}})

    left = nodes.join(blocks, "package_id")
    right = links.join(blocks.select("package_id", "block"), "package_id").withColumnsRenamed({"package_id": "of", "block": "part"})  # both sides may stem from one table
    made = left.groupBy("package_id", "block").cogroup(right.groupBy("of", "part")).applyInPandas(run, form)
    made = made.select("package_id", "node_id", "place", "mark", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in names))
    if "betweenness" not in which:
        return made
    first = [F.first(c, ignorenulls=True).alias(c) for c in names if c != "betweenness"]
    return made.groupBy("package_id", "node_id", "place", "mark").agg(*first, F.sum("betweenness").alias("betweenness"))


def kernel_features(marked: DataFrame, edges: DataFrame, which: tuple[str, ...] = MEASURES) -> DataFrame:
    """Iterative features of packages with a marked node, only those of the measures asked for; zero where a measure failed."""
    m = written(node_measures(marked, edges, which), "node-measures")
    on = lambda c: F.when(F.col("mark"), F.col(c))
    aggregates = {
        "component": [F.greatest(F.lit(1), F.count_if(F.col("mark") & (F.col("component") == F.col("inner")))).alias("malicious_components")],
        "pagerank": [f(on("pagerank")).alias(f"{n}_malicious_pagerank") for n, f in (("mean", F.avg), ("max", F.max), ("sum", F.sum))],
        "betweenness": [f(on("betweenness")).alias(f"{n}_malicious_betweenness") for n, f in (("mean", F.avg), ("max", F.max))],
        "inside": [f(on(f"{x}_in")).alias(f"{n}_{'degree_centrality' if x == 'degree' else x}_sub") for x in INSIDE for n, f in (("mean", F.avg), ("max", F.max))],
        "community": [],
    }
    if "component" in which:  # a component counts at its smallest marked node
        inner = F.sum(F.col("mark").cast("int")).over(Window.partitionBy("package_id").orderBy("place")) - 1
        m = m.withColumn("inner", inner)
    out = m.groupBy("package_id").agg(F.count("*").alias("nodes"), *(a for k in which for a in aggregates[k])).drop("nodes")
    if "community" in which:
        out = out.join(community_features(m.where("community is not null"), mark=F.col("mark")), "package_id", "left")
    kinds = dict(out.dtypes)
    return out.select("package_id", *(F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) for c in out.columns if c != "package_id"))


def graph_features(marked: DataFrame, edges: DataFrame, *more: Column) -> DataFrame:
    """package_id, ``more`` aggregates of the nodes, and all graph features in their fixed order, zeros where nothing is marked."""
    out = marked.groupBy("package_id").agg(*more, *share_columns())
    extra = [c for c in out.columns if c not in GRAPH_FEATURES]
    for part in (density(marked, edges), degree_features(marked, edges), kernel_features(marked, edges)):
        out = out.join(part, "package_id", "left")
    return out.select(*(F.col(f"`{c}`") for c in extra), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in GRAPH_FEATURES))
