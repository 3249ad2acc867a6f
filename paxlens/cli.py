"""Command line: python -m paxlens.cli STAGE ...; every stage reads and writes folders that any later stage can take up.

preprocess  package tree -> generated install-hook files and a summary
trees       package tree -> syntax trees (Parquet) and a failure report
graphs      trees of a run before, or tree documents -> graphs (Parquet)
features    graphs of a run before -> feature rows (Parquet and CSV) and a summary
analyse     all of these at once
report      feature rows of a run before -> the hits and headline features of --packages
mine        package tree -> a model's answers (JSON lines), kept every few answers; goes on where a run broke off
consolidate answers of a run before -> a rule file
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import miner, reports, scripts
from .operators import callgraph, jsparse, matching, merge
from .plans.packages import failures_of
from .rules.dsl import load_rules, rules_frame, shipped
from .session import written
from .sources import graphs as documents
from .sources import packages as scans

KEYS = ["package_id", "data_type", "rel_path"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paxlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("stage", choices=("preprocess", "trees", "graphs", "features", "analyse", "report", "mine", "consolidate"))
    p.add_argument("--input-dir", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--mode", choices=("classified", "direct"), default="classified", help="<root>/<type>/<package> or <root>/<package>")
    p.add_argument("--type", choices=("both", "malicious", "benign"), default="both")
    p.add_argument("--packages", nargs="*", help="only these packages")
    p.add_argument("--limit", type=int, default=-1, help="most files")
    p.add_argument("--sample", type=int, help="first so many packages")
    p.add_argument("--rules", help="rule file; the default rules without it")
    p.add_argument("--file-key", choices=("basename", "path"), default="basename")
    p.add_argument("--skip-existing", action="store_true", help="keep what the output folder already holds")
    p.add_argument("--preview", action="store_true", help="count packages and files, process nothing")
    p.add_argument("--no-report", action="store_true")
    p.add_argument("--documents", action="store_true", help="also write graphs as JSON documents")
    p.add_argument("--model", help="module:function that answers a prompt (mine) or consolidates (category, rules)")
    p.add_argument("--pilot", type=int, default=0, help="mine: ask about so many samples only")
    p.add_argument("--min-frequency", type=int, help="consolidate: samples that must show a rule")
    return p


def chosen(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(files, packages) that the options select."""
    classified = a.mode == "classified"
    found = scans.packages(spark, a.input_dir, classified)
    if a.type != "both":
        found = found.where(F.col("data_type") == a.type)
    if a.packages:
        found = found.where(F.col("package_id").isin(a.packages))
    if a.sample:
        found = scans.first(found, a.sample)
    files = scans.source_files(spark, a.input_dir, classified).join(found.select("package_id", "data_type"), ["package_id", "data_type"], "left_semi")
    return scans.targets(files, limit=a.limit), found


def there(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Writes a table and reads it back; those of single files are partitioned by data type."""
    write = df.write.mode(mode)
    (write.partitionBy("data_type") if "rel_path" in df.columns else write).parquet(path)
    return df.sparkSession.read.parquet(path)


def append(df: DataFrame, path: str, a: argparse.Namespace, keys: list[str]) -> DataFrame:
    """Writes a table; with --skip-existing only what is not there yet is made and added."""
    if a.skip_existing and there(df.sparkSession, path):
        return save(reports.not_done(df, df.sparkSession.read.parquet(path), keys), path, "append")
    return save(df, path)


def trees(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    files, found = chosen(spark, a)
    code = scans.scripts_only(files).select("package_id", "data_type", "rel_path", "size", "code").unionByName(scripts.virtual_files(files, found).drop("kind"))
    path = f"{a.output_dir}/trees"
    if a.skip_existing and there(spark, path):  # known trees are left out before they are parsed
        code = reports.not_done(code, jsparse.valid_asts(spark.read.parquet(path)), KEYS)
        return save(jsparse.parse_files(code), path, "append")
    return append(jsparse.parse_files(code), path, a, KEYS)


def graphs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.stage == "analyse" or there(spark, f"{a.output_dir}/trees"):
        asts = spark.read.parquet(f"{a.output_dir}/trees")
    else:
        asts = documents.ast_files(spark, a.input_dir, a.mode == "classified")
    path = f"{a.output_dir}/graphs"
    if a.skip_existing and there(spark, path):
        return save(callgraph.graphs(reports.not_done(asts, spark.read.parquet(path), KEYS)), path, "append")
    return append(callgraph.graphs(asts), path, a, KEYS)


def features(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rules = load_rules(spark, a.rules) if a.rules else shipped()
    if there(spark, f"{a.output_dir}/graphs"):
        table = spark.read.parquet(f"{a.output_dir}/graphs")
        nodes, edges = callgraph.graph_tables(table, a.file_key)
        packages = table.select("package_id", "data_type").distinct()
    else:
        nodes, edges, _ = documents.graph_files(spark, a.input_dir, a.mode == "classified")
        packages = nodes.select("package_id", "data_type").distinct()
    if a.mode == "classified" and a.stage == "analyse":
        packages = packages.union(chosen(spark, a)[1].select("package_id", "data_type")).distinct()  # those without a graph as zeros
    nodes, edges = merge.merged(nodes, edges)
    rows = reports.feature_rows(matching.mark(nodes, edges, rules), edges, rules, packages)
    rows = append(rows, f"{a.output_dir}/features", a, ["package_id"])
    reports.to_csv(rows, f"{a.output_dir}/features_csv")
    return rows


def callable_of(name: str | None):
    """module:function, imported; the function answers what it is asked."""
    if not name or ":" not in name:
        raise SystemExit("--model module:function is needed")
    module, function = name.split(":", 1)
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("paxlens").getOrCreate()
    if a.preview:
        scans.preview(chosen(spark, a)[0]).show(truncate=False)
        return 0
    if a.stage == "report":
        rows = spark.read.parquet(f"{a.output_dir}/features")
        for package in a.packages or []:
            reports.package_report(rows, rules_frame(spark, load_rules(spark, a.rules) if a.rules else shipped()), package).show(100, truncate=False)
        return 0
    if a.stage == "mine":
        code = miner.samples(spark, a.input_dir, a.pilot or a.sample or miner.SAMPLES)
        found = miner.records(miner.extract(code, callable_of(a.model), f"{a.output_dir}/answers"))
        found.agg(F.count("*").alias("samples"), F.count_if(F.col("valid_json")).alias("valid_json"), F.sum("valid_count").alias("rules")).show()
        return 0
    if a.stage == "consolidate":
        answers = spark.read.schema(miner.ANSWERS).json(f"{a.input_dir}/answers")
        least = a.min_frequency if a.min_frequency is not None else 1 if a.pilot else miner.mining.MIN_FREQUENCY
        rules = written(miner.consolidate(answers, callable_of(a.model), least), "mined-rules")
        miner.write_document(spark, rules, f"{a.output_dir}/rules")
        miner.mining.breakdown(rules).show()
        return 0
    if a.stage in ("preprocess", "analyse"):
        files, found = chosen(spark, a)
        scripts.virtual_files(files, found).write.mode("overwrite").parquet(f"{a.output_dir}/virtual")
        results = scripts.preprocessing_results(files, found)
        reports.write_preprocessing(results, f"{a.output_dir}/preprocessing")
        if not a.no_report:
            reports.preprocessing_summary(results, 1).show(truncate=False)
    if a.stage in ("trees", "analyse"):
        made = trees(spark, a)
        failed = made.where(~F.col("success")).select("package_id", "rel_path", F.col("error").alias("error_message"))
        if not a.no_report:
            made.agg(F.count("*").alias("files"), F.count_if(F.col("success")).alias("parsed")).show()
            reports.failures_by_reason(failed, reasons=5).orderBy("place", "example").show(15, truncate=False)
    if a.stage in ("graphs", "analyse"):
        made = graphs(spark, a)
        reports.write_failures(failures_of(made), f"{a.output_dir}/failures")
        if a.documents:
            documents.graph_documents(made).select("document", "data_type").write.mode("overwrite").partitionBy("data_type").text(f"{a.output_dir}/documents")
        if not a.no_report:
            for table in reports.batch_summary(made) if a.mode == "classified" else reports.direct_summary(made):
                table.show(truncate=False)
    if a.stage in ("features", "analyse"):
        rows = features(spark, a)
        if not a.no_report:
            hits = rows.select("package_id", "data_type", F.filter(F.split("hit_rules", ","), lambda x: x != "").alias("hits"))
            reports.hit_summary(hits).show(truncate=False)
            reports.top_rules(hits).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
