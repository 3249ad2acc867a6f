"""Rule matching on graph tables: node hits, first-match categories, package hits and rule vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.dsl import Rule, match_order, needs_arguments, predicate


def with_arguments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``args`` to nodes: index -> content of the first has_arg target with that index; null without such an edge.

    A target may be of any type, as files that merge leave old indexes behind; targets without an index give an empty map.
    Both sides are narrow projections; the join and the grouping share the key (package_id, node_id), so AQE moves the
    edges once.
    """
    targets = nodes.where("arg_index is not null").select("package_id", F.col("node_id").alias("dst"), "arg_index", F.coalesce("content", F.lit("")).alias("arg"))
    linked = edges.where("type = 'has_arg'").select("package_id", "src", "dst", "edge_seq").join(targets, ["package_id", "dst"], "left")
    first = linked.groupBy("package_id", "src", "arg_index").agg(F.min_by("arg", "edge_seq").alias("arg"))
    entries = F.filter(F.collect_list(F.struct("arg_index", "arg")), lambda x: x["arg_index"].isNotNull())
    args = first.groupBy("package_id", F.col("src").alias("node_id")).agg(F.map_from_entries(entries).alias("args"))
    return nodes.join(args, ["package_id", "node_id"], "left")


def hit_columns(rules: list[Rule], type_: Column, callee: Column, content: Column, args: Column | None) -> tuple[Column, Column]:
    """(array of hit rule ids in match order, category code of the first one)."""
    want = {"CALL": "CALL", "ARGUMENT": "ARGUMENT", "COMBO": "CALL"}
    tests = [(r, predicate(r, callee, content, args)) for r in match_order(rules)]
    tests = [(r, p) for r, p in tests if p is not None]
    by_type = {t: [(r, p) for r, p in tests if want[r.kind] == t] for t in ("CALL", "ARGUMENT")}
    none = F.array().cast("array<string>")

    def hits(t: str) -> Column:
        return F.array_compact(F.array(*(F.when(p, F.lit(r.rule_id)) for r, p in by_type[t]))) if by_type[t] else none

    # only the patterns of a node's own type are tried
    ids = F.when(type_ == "CALL", hits("CALL")).when(type_ == "ARGUMENT", hits("ARGUMENT")).otherwise(none)
    codes = F.create_map(*(x for r, _ in tests for x in (F.lit(r.rule_id), F.lit(r.code)))) if tests else None
    return ids, codes


def mark(nodes: DataFrame, edges: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """Adds ``hit_rules`` (array, in match order) and ``category`` (null where nothing hit) to graph nodes."""
    if needs_arguments(rules):
        nodes = with_arguments(nodes, edges)
        args = F.col("args")
    else:
        args = None
    ids, codes = hit_columns(rules, F.col("type"), F.coalesce("callee_name", F.lit("")), F.coalesce("content", F.lit("")), args)
    out = nodes.withColumn("hit_rules", ids)
    first = F.when(F.size("hit_rules") > 0, F.element_at(codes, F.element_at("hit_rules", 1))) if codes is not None else F.lit(None).cast("string")
    return out.withColumn("category", first).drop("args")


def hits_column() -> Column:
    """Aggregate: sorted distinct ids of the rules that hit in a package."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_rules")))).alias("hits")


def vector_columns(rules: list[Rule]) -> list[Column]:
    """Aggregates: one 0/1 column ``rule_<id>`` for each rule in file order."""
    ordered = sorted(rules, key=lambda r: r.place)
    return [F.coalesce(F.max(F.array_contains("hit_rules", r.rule_id).cast("int")), F.lit(0)).alias(f"rule_{r.rule_id}") for r in ordered]


def package_hits(marked: DataFrame) -> DataFrame:
    """package_id, hits; also packages without any."""
    return marked.groupBy("package_id").agg(hits_column())


def rule_vector(marked: DataFrame, rules: list[Rule], *more: Column) -> DataFrame:
    """package_id, vector_columns() and ``more`` aggregates: one pass, pre-aggregated by task."""
    return marked.groupBy("package_id").agg(*vector_columns(rules), *more)
