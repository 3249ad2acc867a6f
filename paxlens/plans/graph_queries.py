"""Queries of graph, rule and feature operators on encoded graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reports
from ..operators import features, matching, merge
from ..schemas import CODES
from .encoded import DEMO, DEMO_SQL, EVENT_MARKS, EVENTS_SQL, ORDERS_SQL, WITH_ARGUMENTS, event_graph, order_graph, read, rules
from .registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
O, OM, E = f"with {ORDERS_SQL}", f"with {ORDERS_SQL}, {DEMO_SQL}", f"with recursive {EVENTS_SQL}"


def demo_marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = order_graph(spark, sf_dir)
    return matching.mark(nodes, None, rules(DEMO)), edges


def event_marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = event_graph(spark, sf_dir)
    return matching.mark(nodes, None, rules(EVENT_MARKS)), edges


@query(f"{O} select package_id, type, count(*)::bigint as n from nodes group by all")
def graph_nodes_by_type(spark, sf_dir):
    return merge.nodes_by_type(order_graph(spark, sf_dir)[0])


@query(f"{O} select package_id, node_id, type from nodes n where not exists (select 1 from edges e where e.package_id = n.package_id and e.dst = n.node_id)")
def orphan_roots(spark, sf_dir):
    return merge.orphan_roots(*order_graph(spark, sf_dir)).select("package_id", "node_id", "type")


@query(f"{O} select package_id, count(*)::bigint as total_calls, count(distinct src)::bigint as base_calls, count(*) > 0 as has_calls from edges where type = 'has_arg' group by all")
def chained_base_calls(spark, sf_dir):
    e = order_graph(spark, sf_dir)[1].where("type = 'has_arg'")
    return e.groupBy("package_id").agg(F.count("*").alias("total_calls"), F.countDistinct("src").alias("base_calls"), (F.count("*") > 0).alias("has_calls"))


@query(f"{O} select package_id, src, dst, type from edges group by all")
def edge_dedup(spark, sf_dir):
    return merge.distinct_edges(order_graph(spark, sf_dir)[1]).select("package_id", "src", "dst", "type")


@query(f"{OM} select package_id, node_id, callee_name, array_to_string(hit_rules, ',') as hit_rules from marked where type = 'CALL' and mark")
def rule_hits_call(spark, sf_dir):
    m, _ = demo_marked(spark, sf_dir)
    return m.where((F.col("type") == "CALL") & features.is_marked()).select("package_id", "node_id", "callee_name", F.concat_ws(",", "hit_rules").alias("hit_rules"))


@query(f"{OM} select package_id, node_id, content, array_to_string(hit_rules, ',') as hit_rules from marked where type = 'ARGUMENT' and mark")
def rule_hits_arg(spark, sf_dir):
    m, _ = demo_marked(spark, sf_dir)
    return m.where((F.col("type") == "ARGUMENT") & features.is_marked()).select("package_id", "node_id", "content", F.concat_ws(",", "hit_rules").alias("hit_rules"))


@query(f"""{O}, args as (
  select e.package_id, e.src as node_id, map(list(n.arg_index), list(n.content)) as a from edges e join nodes n on n.package_id = e.package_id and n.node_id = e.dst where e.type = 'has_arg' group by all
), h as (
  select n.package_id, n.node_id, list_filter([
    case when regexp_matches(callee_name, '\\.O$') and contains(a[0], 'N|O') then 'PE-201' end,
    case when callee_name = '3-MEDIUM.F' and regexp_matches(a[0], '^[AR]') and a[2] is not null then 'DE-201' end,
    case when a is not null then 'IG-201' end,
    case when regexp_matches(callee_name, '^5-') and a[1] = 'N|O|1' then 'SP-201' end], lambda x: x is not null) as hits
  from nodes n left join args on args.package_id = n.package_id and args.node_id = n.node_id where type = 'CALL'
)
select package_id, node_id, array_to_string(hits, ',') as hit_rules, left(hits[1], 2) as category from h where len(hits) > 0""")
def rule_hits_with_args(spark, sf_dir):
    m = matching.mark(*order_graph(spark, sf_dir), rules(WITH_ARGUMENTS))
    return m.where(features.is_marked()).select("package_id", "node_id", F.concat_ws(",", "hit_rules").alias("hit_rules"), "category")


@query(f"{OM} select package_id, node_id, category from marked where mark")
def node_first_category(spark, sf_dir):
    return demo_marked(spark, sf_dir)[0].where(features.is_marked()).select("package_id", "node_id", "category")


_vector = ", ".join(f"max((list_contains(hit_rules, '{r}'))::int)::int as \"rule_{r}\"" for r in ("IG-101", "DT-101", "SP-101"))


@query(f"{OM} select package_id, {_vector}, count(*)::bigint as n_nodes from marked group by package_id")
def package_vector(spark, sf_dir):
    m, _ = demo_marked(spark, sf_dir)
    return matching.rule_vector(m, rules(DEMO), F.count("*").alias("n_nodes"))


@query(f"{OM} select package_id, array_to_string(list_sort(list_distinct(flatten(list(hit_rules)))), ',') as hit_rules from marked group by package_id")
def package_hits(spark, sf_dir):
    return matching.package_hits(demo_marked(spark, sf_dir)[0]).select("package_id", F.concat_ws(",", "hits").alias("hit_rules"))


_ratios = ", ".join(f"round(case when count(*) filter (where mark) > 0 then count(*) filter (where category = '{c}') / count(*) filter (where mark) else 0 end, 6)::double as {c}_ratio" for c in CODES)


@query(f"{OM} select package_id, count(*) filter (where mark) as malicious_node_count, round(count(*) filter (where mark) / count(*), 6) as malicious_ratio, count(distinct category) as category_diversity, {_ratios} from marked group by package_id")
def package_category_ratios(spark, sf_dir):
    s = features.shares(demo_marked(spark, sf_dir)[0])
    return s.select("package_id", "malicious_node_count", F.round("malicious_ratio", 6).alias("malicious_ratio"), "category_diversity", *(F.round(f"{c}_ratio", 6).alias(f"{c}_ratio") for c in CODES))


@query(f"""{OM}, m as (select package_id, node_id from marked where mark), k as (select package_id, count(*) as n from m group by all),
i as (select e.package_id, count(*) as x from edges e join m a on a.package_id = e.package_id and a.node_id = e.src join m b on b.package_id = e.package_id and b.node_id = e.dst group by all)
select k.package_id, coalesce(x, 0)::bigint as malicious_internal_edges, round(case when n > 1 then coalesce(x, 0) / (n * (n - 1)) else 0 end, 9)::double as malicious_density from k left join i using (package_id)""")
def malicious_density(spark, sf_dir):
    d = features.density(*demo_marked(spark, sf_dir))
    return d.withColumn("malicious_density", F.round("malicious_density", 9))


@query(f"""{O}, d as (select package_id, v as node_id, count(*) as degree from (select package_id, src as v from edges union all select package_id, dst from edges) group by all),
s as (select package_id, count(*) as n from nodes group by all)
select n.package_id, n.node_id, coalesce(degree, 0)::bigint as degree, round(case when s.n > 1 then coalesce(degree, 0) / (s.n - 1) else 1 end, 9)::double as centrality from nodes n join s using (package_id) left join d on d.package_id = n.package_id and d.node_id = n.node_id""")
def degree_centrality(spark, sf_dir):
    return features.degrees(*order_graph(spark, sf_dir)).withColumn("centrality", F.round("centrality", 9))


_inner = "m as (select package_id, node_id from marked where mark), i as (select e.package_id, e.src, e.dst from edges e join m a on a.package_id = e.package_id and a.node_id = e.src join m b on b.package_id = e.package_id and b.node_id = e.dst)"


@query(f"""{E}, {_inner}, u as (select package_id, src, dst from i union select package_id, dst, src from i), r(package_id, a, b) as (
  select package_id, node_id, node_id from m union select r.package_id, r.a, u.dst from r join u on u.package_id = r.package_id and u.src = r.b
) select package_id, a as node_id, min(b) as component from r group by all""")
def components(spark, sf_dir):
    m, e = event_marked(spark, sf_dir)
    return features.components_frame(m.where(features.is_marked()), features.inner_edges(m, e))


def _steps(n: int) -> str:
    out = "s0 as (select nodes.package_id, node_id, 1.0::double / count(*) over (partition by nodes.package_id) as x, count(*) over (partition by nodes.package_id) as n, d.o from nodes left join (select package_id, src, count(*) as o from edges group by all) d on d.package_id = nodes.package_id and d.src = node_id)"
    for i in range(1, n + 1):
        p = f"s{i - 1}"
        out += f""", s{i} as (select p.package_id, p.node_id, 0.85 * (coalesce(f.y, 0) + coalesce(g.z, 0) / p.n) + 0.15 / p.n as x, p.n, p.o from {p} p
  left join (select e.package_id, e.dst, sum(q.x / q.o) as y from edges e join {p} q on q.package_id = e.package_id and q.node_id = e.src group by all) f on f.package_id = p.package_id and f.dst = p.node_id
  left join (select package_id, sum(x) as z from {p} where o is null group by all) g on g.package_id = p.package_id)"""
    return out


@query(f"{E}, {_steps(10)} select package_id, node_id, round(x, 6) as rank from s10")
def pagerank_fixed10(spark, sf_dir):
    return features.pagerank_frame(*event_graph(spark, sf_dir), steps=10).withColumn("rank", F.round("rank", 6))


@query(f"""{OM}, c as (select m.*, coalesce(cast(c_nationkey as varchar), '') as p from marked m join customer on c_custkey::varchar = package_id),
g as (select p, type as community, count(*) filter (where mark) as k, count(*) as n from c group by all having count(*) filter (where mark) > 0), w as (select p, sum(k) as m from g group by all)
select g.p as package_id, count(*)::bigint as num_malicious_communities, round(max(k / n), 6)::double as max_community_maliciousness_ratio, round(sum(-(k / m) * log2(k / m)), 6)::double as malicious_community_entropy from g join w using (p) group by all""")
def community_entropy(spark, sf_dir):
    """Nations as packages, node types as given communities."""
    m, _ = demo_marked(spark, sf_dir)
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("package_id"), F.col("c_nationkey").cast("string").alias("nation"))
    m = m.join(c, "package_id").drop("package_id").withColumnRenamed("nation", "package_id").withColumn("community", F.col("type"))
    f = features.community_features(m)
    return f.select("package_id", "num_malicious_communities", *(F.round(c, 6).alias(c) for c in ("max_community_maliciousness_ratio", "malicious_community_entropy")))


@query(f"""{OM}, h as (select package_id, len(list_distinct(flatten(list(hit_rules)))) as hits, c_mktsegment as data_type from marked join customer on c_custkey::varchar = package_id group by all)
select data_type, count(*)::bigint as packages, round(avg(hits), 6) as avg_hits, max(hits)::int as max_hits, min(hits)::int as min_hits from h group by grouping sets ((), (data_type))""")
def hit_summary_by_type(spark, sf_dir):
    h = matching.package_hits(demo_marked(spark, sf_dir)[0])
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("package_id"), F.col("c_mktsegment").alias("data_type"))
    return reports.hit_summary(h.join(c, "package_id"))


@query(f"""{OM}, h as (select package_id, unnest(list_distinct(flatten(list(hit_rules)))) as rule_id from marked group by package_id)
select rule_id, count(*)::bigint as packages, round(100.0 * count(*) / (select count(distinct package_id) from marked), 2)::double as percent from h group by all order by packages desc, rule_id limit 10""")
def top10_rules(spark, sf_dir):
    return reports.top_rules(matching.package_hits(demo_marked(spark, sf_dir)[0]), 10)


@query()
def betweenness(spark, sf_dir):
    m, e = event_marked(spark, sf_dir)
    return features.kernel_features(m, e, ("betweenness",)).select("package_id", F.round("mean_malicious_betweenness", 9).alias("mean_malicious_betweenness"), F.round("max_malicious_betweenness", 9).alias("max_malicious_betweenness"))


@query()
def louvain(spark, sf_dir):
    m, e = event_marked(spark, sf_dir)
    return features.kernel_features(m, e, ("community",)).select("package_id", "num_malicious_communities", "max_community_maliciousness_ratio", "malicious_community_entropy")


@query()
def features_wide(spark, sf_dir):
    """The whole feature row: base columns, rule vector, graph features."""
    m, e = event_marked(spark, sf_dir)
    return reports.feature_rows(m, e, rules(EVENT_MARKS))


@query(f"""{E} select package_id, count(*) filter (where mark) as malicious_node_count, round(count(*) filter (where mark) / count(*), 6) as malicious_ratio from marked group by package_id""")
def features_counts(spark, sf_dir):
    m, e = event_marked(spark, sf_dir)
    return reports.feature_rows(m, e, rules(EVENT_MARKS)).select("package_id", "malicious_node_count", F.round("malicious_ratio", 6).alias("malicious_ratio"))


@query(f"""{E}, {_inner}, d as (select package_id, v, count(*) as k from (select package_id, src as v from edges union all select package_id, dst from edges) group by all), s as (select package_id, count(*) as n from nodes group by all)
select m.package_id, round(avg(case when n > 1 then coalesce(k, 0) / (n - 1) else 1 end), 6) as mean_degree_centrality_full, round(max(case when n > 1 then coalesce(k, 0) / (n - 1) else 1 end), 6)::double as max_degree_centrality_full from m join s using (package_id) left join d on d.package_id = m.package_id and d.v = m.node_id group by all""")
def marked_degrees(spark, sf_dir):
    f = features.degree_features(*event_marked(spark, sf_dir))
    return f.select("package_id", *(F.round(c, 6).alias(c) for c in ("mean_degree_centrality_full", "max_degree_centrality_full")))


