"""Syntax-tree and graph files: JSON documents of one file each, and the tables they become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.callgraph import graphs as graphs_of
from ..operators.merge import ATTRIBUTES
from .packages import _parts, importable

# Suffixes of existing files.
AST_SUFFIX, GRAPH_SUFFIX = ".ast.json", ".pdcg.json"


def _texts(spark: SparkSession, root: str, classified: bool, suffix: str) -> DataFrame:
    read = importable(spark).read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
    parts = _parts(root, classified)
    return read.withColumn("path", F.input_file_name()).select("value", *(c.alias(n) for n, c in parts.items()))


def ast_files(spark: SparkSession, root: str, classified: bool = True) -> DataFrame:
    """Envelopes of syntax trees; a file that can't be read is a failed one."""
    t = _texts(spark, root, classified, AST_SUFFIX)
    v = F.try_parse_json("value")
    ok = F.coalesce(F.try_variant_get(v, "$.success", "boolean"), F.lit(False))
    error = F.when(v.isNull(), "not JSON").otherwise(F.try_variant_get(v, "$.error", "string"))
    tree = F.try_variant_get(v, "$.ast", "variant")
    return t.select("package_id", "data_type", F.regexp_replace("rel_path", r"\.ast\.json$", "").alias("rel_path"), ok.alias("success"), F.try_variant_get(v, "$.parser", "string").alias("parser"), F.when(ok, F.to_json(tree)).alias("ast"), error.alias("error"))


def graphs_from_asts(asts: DataFrame) -> DataFrame:
    return graphs_of(asts)


_NODE = "struct<id:string,type:string,label:string,callee_name:string,is_chained:boolean,is_member_call:boolean,call_depth:int,chain_position:string,is_constructor:boolean,arg_index:int,content:string,function_name:string,is_async:boolean,is_generator:boolean,is_callback:boolean,class_name:string,parameter_name:string>"
_DOCUMENT = f"struct<nodes:array<{_NODE}>,edges:array<struct<source:string,target:string,type:string>>>"


def graph_files(spark: SparkSession, root: str, classified: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, failures) of graph files; unreadable ones are failures and the rest of their package goes on."""
    t = _texts(spark, root, classified, GRAPH_SUFFIX).withColumn("d", F.from_json("value", _DOCUMENT)).withColumn("rel_path", F.regexp_replace("rel_path", r"\.pdcg\.json$", ""))
    ok = F.col("d.nodes").isNotNull() & F.try_parse_json("value").isNotNull()
    base = t.where(ok).withColumn("file_key", F.element_at(F.split("rel_path", "/"), -1))
    nodes = base.select("package_id", "data_type", "file_key", "rel_path", F.posexplode("d.nodes").alias("node_seq", "n"))
    nodes = nodes.select("package_id", "data_type", "file_key", "rel_path", "node_seq", F.col("n.id").alias("node_id"), *(F.col(f"n.{c}").alias(c) for c in ATTRIBUTES))
    edges = base.select("package_id", "file_key", "rel_path", F.posexplode("d.edges").alias("edge_seq", "e"))
    edges = edges.select("package_id", "file_key", "rel_path", "edge_seq", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.type").alias("type"))
    failures = t.where(~ok | ok.isNull()).select("package_id", "rel_path", F.lit("graph").alias("stage"), F.lit("graph_load_error").alias("error_type"), F.lit("not a graph document").alias("error_message"))
    return nodes, edges, failures


def graph_documents(files: DataFrame) -> DataFrame:
    """Graph rows as JSON documents: package_id, data_type, rel_path, document."""
    node = F.transform("nodes", lambda n: F.struct(n["node_id"].alias("id"), *(n[c].alias(c) for c in ATTRIBUTES)))
    edge = F.transform("edges", lambda e: F.struct(e["src"].alias("source"), e["dst"].alias("target"), e["type"].alias("type")))
    return files.where("error is null").select("package_id", "data_type", "rel_path", F.to_json(F.struct(node.alias("nodes"), edge.alias("edges"))).alias("document"))
