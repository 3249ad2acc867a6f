"""Warehouse tables seen as call graphs, so every graph operator can run on them.

orders: package = customer (FILE), order = CALL named by priority and status, line item = ARGUMENT holding its flags.
events: package = user, node = event type and hour, edge = consecutive pair of different nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..rules.dsl import Rule, parse
from ..session import importable

DEMO = [
    {"rule_id": "IG-101", "category": "INFORMATION_GATHERING", "pattern": {"node_type": "CALL", "callee_name_regex": r"^1-URGENT\.F$"}},
    {"rule_id": "DT-101", "category": "DATA_TRANSMISSION", "pattern": {"node_type": "ARGUMENT", "content_regex": "^R[|]"}},
    {"rule_id": "SP-101", "category": "SPECIAL_PATTERNS", "pattern": {"node_type": "ARGUMENT", "content_contains": "|50"}},
]
WITH_ARGUMENTS = [
    {"rule_id": "PE-201", "category": "PAYLOAD_EXECUTION", "pattern": {"node_type": "CALL", "callee_name_regex": r"\.O$", "arguments": [{"index": 0, "content_contains": "N|O"}]}},
    {"rule_id": "DE-201", "category": "DATA_ENCODING", "pattern": {"node_type": "CALL", "callee_name": "3-MEDIUM.F", "arguments": [{"index": 0, "content_regex": "^[AR]"}, {"index": 2}]}},
    {"rule_id": "SP-201", "category": "OTHER", "pattern": {"primary_call": {"callee_name_regex": "^5-"}, "required_arguments": [{"index": 1, "content": "N|O|1"}]}},
    {"rule_id": "IG-201", "category": "INFORMATION_GATHERING", "pattern": {"node_type": "CALL", "arguments": []}},
]
EVENT_MARKS = [
    {"rule_id": "PE-301", "category": "PAYLOAD_EXECUTION", "pattern": {"node_type": "CALL", "callee_name_regex": "^error@"}},
    {"rule_id": "IG-301", "category": "INFORMATION_GATHERING", "pattern": {"node_type": "CALL", "callee_name_regex": "^click@1"}},
]


def rules(records: list[dict]) -> list[Rule]:
    return parse(records)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    null = lambda t: F.lit(None).cast(t)
    # the number of an item within its order; all columns, as (order, line) repeats
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    args = items.withColumn("arg_index", F.row_number().over(w) - 1).join(orders.select("o_orderkey", "o_custkey"), items.l_orderkey == F.col("o_orderkey"))
    content = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int"))
    arg = args.select(text("o_custkey").alias("package_id"), F.concat(F.lit("l"), text("l_orderkey"), F.lit("_"), text("arg_index")).alias("node_id"), F.concat(F.lit("o"), text("l_orderkey")).alias("src"), "arg_index", content.alias("content"))
    nodes = (
        orders.select(text("o_custkey").alias("package_id")).distinct()
        .select("package_id", F.lit("c").alias("node_id"), F.lit("FILE").alias("type"), null("string").alias("callee_name"), null("int").alias("arg_index"), null("string").alias("content"))
        .unionAll(orders.select(text("o_custkey"), F.concat(F.lit("o"), text("o_orderkey")), F.lit("CALL"), F.concat("o_orderpriority", F.lit("."), "o_orderstatus"), null("int"), null("string")))
        .unionAll(arg.select("package_id", "node_id", F.lit("ARGUMENT"), null("string"), "arg_index", "content"))
    )
    edges = orders.select(text("o_custkey").alias("package_id"), F.lit("c").alias("src"), F.concat(F.lit("o"), text("o_orderkey")).alias("dst"), F.lit("calls").alias("type"), F.lit(0).alias("edge_seq")).unionAll(
        arg.select("package_id", "src", F.col("node_id").alias("dst"), F.lit("has_arg"), "arg_index")
    )
    return nodes.withColumn("order", F.col("node_id")), edges


def event_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("package_id"), "ts", "event_id", F.concat("event_type", F.lit("@"), F.hour("ts").cast("string")).alias("node_id"))
    nodes = e.groupBy("package_id", "node_id").agg(F.min(F.struct("ts", "event_id")).alias("order"))
    nodes = nodes.select("package_id", "node_id", F.lit("CALL").alias("type"), F.col("node_id").alias("callee_name"), F.lit(None).cast("int").alias("arg_index"), F.lit(None).cast("string").alias("content"), "order")
    w = Window.partitionBy("package_id").orderBy("ts", "event_id")
    pairs = e.withColumn("src", F.lag("node_id").over(w)).where("src is not null and src <> node_id")
    edges = pairs.groupBy("package_id", "src", F.col("node_id").alias("dst")).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    seq = F.row_number().over(Window.partitionBy("package_id").orderBy("first")) - 1
    return nodes, edges.select("package_id", "src", "dst", F.lit("calls").alias("type"), seq.alias("edge_seq"))


# The same graphs in DuckDB.
ORDERS_SQL = """
li as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as i from lineitem
), nodes as (
  select distinct o_custkey::varchar as package_id, 'c' as node_id, 'FILE' as type, null::varchar as callee_name, null::int as arg_index, null::varchar as content from orders
  union all select o_custkey::varchar, 'o' || o_orderkey, 'CALL', o_orderpriority || '.' || o_orderstatus, null, null from orders
  union all select o_custkey::varchar, 'l' || l_orderkey || '_' || i, 'ARGUMENT', null, i::int, l_returnflag || '|' || l_linestatus || '|' || trunc(l_quantity)::int from li join orders on l_orderkey = o_orderkey
), edges as (
  select o_custkey::varchar as package_id, 'c' as src, 'o' || o_orderkey as dst, 'calls' as type from orders
  union all select o_custkey::varchar, 'o' || l_orderkey, 'l' || l_orderkey || '_' || i, 'has_arg' from li join orders on l_orderkey = o_orderkey
)"""
DEMO_SQL = """
hits as (
  select n.*, list_filter([
    case when type = 'CALL' and regexp_matches(callee_name, '^1-URGENT\\.F$') then 'IG-101' end,
    case when type = 'ARGUMENT' and regexp_matches(content, '^R[|]') then 'DT-101' end,
    case when type = 'ARGUMENT' and contains(content, '|50') then 'SP-101' end], lambda x: x is not null) as hit_rules
  from nodes n
), marked as (
  select *, len(hit_rules) > 0 as mark, left(hit_rules[1], 2) as category from hits
)"""
EVENTS_SQL = """
ev as (
  select user_id::varchar as package_id, ts, event_id, event_type || '@' || hour(ts) as node_id from events
), nodes as (
  select distinct package_id, node_id from ev
), edges as (
  select distinct package_id, src, node_id as dst from (select *, lag(node_id) over (partition by package_id order by ts, event_id) as src from ev) where src is not null and src <> node_id
), marked as (
  select *, node_id like 'error@%' or node_id like 'click@1%' as mark, case when node_id like 'error@%' then 'PE' when node_id like 'click@1%' then 'IG' end as category from nodes
)"""
