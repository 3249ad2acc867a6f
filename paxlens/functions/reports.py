"""Summaries and reports as tables; printing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import features, matching
from ..rules.dsl import Rule
from ..schemas import GRAPH_FEATURES
from ..session import written


def hit_summary(hits: DataFrame) -> DataFrame:
    """Per data_type and overall (null): packages, mean, largest and least number of hit rules."""
    return hits.withColumn("n", F.size("hits")).groupingSets([[], ["data_type"]], "data_type").agg(F.count("*").alias("packages"), F.round(F.avg("n"), 6).alias("avg_hits"), F.max("n").alias("max_hits"), F.min("n").alias("min_hits"))


def top_rules(hits: DataFrame, k: int = 10) -> DataFrame:
    """The rules that most packages hit, with their share of all packages in percent; ties by rule id."""
    whole = hits.agg(F.count("*").alias("whole"))  # one row
    per = hits.select(F.explode("hits").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("packages"))
    top = per.orderBy(F.desc("packages"), "rule_id").limit(k)
    return top.join(F.broadcast(whole)).select("rule_id", "packages", F.round(100.0 * F.col("packages") / F.col("whole"), 2).cast("double").alias("percent"))


def feature_rows(marked: DataFrame, edges: DataFrame, rules: list[Rule], packages: DataFrame | None = None, keep_empty: bool = True) -> DataFrame:
    """One row a package: name, data_type, label, hits, rule columns in file order, graph features in fixed order.

    ``packages`` (package_id, data_type) also brings packages without a graph, as zeros, unless ``keep_empty`` is off.  Nodes
    and edges are read by several aggregations, so they are written once; what is above them runs once.
    """
    marked, edges = written(marked, "marked"), written(edges, "edges")
    out = features.graph_features(marked, edges, matching.hits_column(), *matching.vector_columns(rules))
    if packages is None:
        out = out.withColumn("data_type", F.lit("unknown"))
    else:
        out = packages.select("package_id", "data_type").join(out, "package_id", "left" if keep_empty else "inner")
    label = F.when(F.col("data_type") == "malicious", 1).when(F.col("data_type") == "benign", 0).otherwise(-1)
    vector = [f"rule_{r.rule_id}" for r in sorted(rules, key=lambda r: r.place)]
    zero = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in (*vector, *GRAPH_FEATURES)]
    found = F.coalesce("hits", F.array().cast("array<string>"))
    return out.select("package_id", "data_type", label.alias("label"), F.size(found).alias("hit_rules_count"), F.concat_ws(",", found).alias("hit_rules"), *zero)


def to_csv(rows: DataFrame, path: str) -> None:
    """Feature rows as CSV with a header; an empty table is an error."""
    if rows.isEmpty():
        raise ValueError("there are no feature rows to write")
    rows.withColumnRenamed("package_id", "package_name").write.mode("overwrite").option("header", True).csv(path)


def preprocessing_summary(results: DataFrame, digits: int = 2) -> DataFrame:
    """Per package_type and overall (null): totals, successes, virtual files, and their rates in percent."""
    n = F.count("*")
    rate = lambda c: F.round(100.0 * F.count_if(c) / n, digits).cast("double")
    ok, behavior, placeholder = F.col("status") == "success", F.col("has_behavior_virtual"), F.col("has_placeholder_virtual")
    return results.groupingSets([[], ["package_type"]], "package_type").agg(
        n.alias("packages"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(behavior).alias("behavior_virtual"), F.count_if(placeholder).alias("placeholder_virtual"),
        rate(ok).alias("success_rate"), rate(behavior).alias("behavior_rate"), rate(placeholder).alias("placeholder_rate"),
    )


def preprocessing_document(results: DataFrame) -> DataFrame:
    """One row, ``document``: the summary as JSON, overall and by type; the detail rows are the results themselves."""
    rows = preprocessing_summary(results).withColumn("package_type", F.coalesce("package_type", F.lit("all")))
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("package_type", F.struct(*(c for c in rows.columns if c != "package_type"))))))).alias("document"))


def write_preprocessing(results: DataFrame, path: str) -> None:
    """``summary`` (one JSON document) and ``details`` (one JSON line a package) below a folder."""
    preprocessing_document(results).coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/details")


def reason(message: Column) -> Column:
    """A failure message without what differs from file to file: its place, and the text found there."""
    return F.regexp_replace(message, r"(?s)\s+at \d+\b.*$", "")


def failures_by_reason(failures: DataFrame, by: str = "error_message", reasons: int = 1000, examples: int = 3) -> DataFrame:
    """The most frequent reasons by falling count, each with its first examples by path."""
    own = failures.withColumn(by, reason(F.col(by)))
    top = own.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(reasons)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), by)))  # ``reasons`` rows at most
    first = own.withColumn("example", F.row_number().over(Window.partitionBy(by).orderBy("package_id", "rel_path"))).where(F.col("example") <= examples)
    return top.join(first.select(by, "example", "package_id", "rel_path"), by)


def failure_lines(failures: DataFrame) -> DataFrame:
    """section, a, b, line: the failure report line by line, to be read in the order of the first three columns.

    Sections: 1 counts by error type, 2 counts by package, 3 each failure, 4 files by error type and package.
    """
    name, whole = F.element_at(F.split("rel_path", "/"), -1), F.concat_ws("/", "package_id", "rel_path")
    count = lambda by: failures.groupBy(F.col(by).alias("a")).agg(F.count("*").alias("n"))
    detail = F.concat_ws("; ", F.concat(F.lit("error type: "), "error_type"), F.concat(F.lit("stage: "), "stage"), F.concat(F.lit("message: "), "error_message"))
    parts = [
        count("error_type").select(F.lit(1).alias("section"), "a", F.lit("").alias("b"), F.format_string("%s: %d files", "a", "n").alias("line")),
        count("package_id").select(F.lit(2), "a", F.lit(""), F.format_string("%s: %d files failed", "a", "n")),
        failures.select(F.lit(3), whole, F.lit(""), F.concat(whole, F.lit(": "), detail)),
        failures.groupBy("error_type").agg(F.count("*").alias("n")).select(F.lit(4), "error_type", F.lit(""), F.format_string("%s (%d files):", F.upper("error_type"), "n")),
        failures.select(F.lit(4), "error_type", whole, F.concat(F.lit("  "), "package_id", F.lit(" - "), name)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def write_failures(failures: DataFrame, path: str) -> None:
    """``report`` (text) and ``csv`` below a folder."""
    lines = failure_lines(failures)
    lines.orderBy("section", "a", "b").select("line").write.mode("overwrite").text(f"{path}/report")
    failure_csv(failures).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def failure_counts(failures: DataFrame) -> DataFrame:
    """Counts by error type, by package, by both, and overall (nulls)."""
    return failures.groupingSets([[], ["error_type"], ["package_id"], ["error_type", "package_id"]], "error_type", "package_id").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def failure_csv(failures: DataFrame, at: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Failure rows as the eight columns of the CSV report, their ``time`` formatted."""
    return failures.select(
        F.col("package_id").alias("package_name"), F.element_at(F.split("rel_path", "/"), -1).alias("file_name"), "error_type", F.col("stage").alias("failure_stage"), "error_message",
        F.date_format("time", at).alias("formatted_time"), F.concat("rel_path", F.lit(".ast.json")).alias("ast_file"), F.concat("rel_path", F.lit(".pdcg.json")).alias("pdcg_file"),
    )


def batch_summary(results: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(totals: files, succeeded, success rate, mean seconds a file; the packages with most failures and one example each)."""
    ok = F.col("error").isNull()
    totals = results.agg(F.count("*").alias("files"), F.count_if(ok).alias("succeeded"), F.round(100.0 * F.count_if(ok) / F.count("*"), 2).cast("double").alias("success_rate"), F.avg("seconds").alias("avg_seconds"))
    bad = results.where(~ok).groupBy("package_id").agg(F.count("*").alias("n"), F.min_by("rel_path", "rel_path").alias("example")).orderBy(F.desc("n"), "package_id").limit(top)
    return totals, bad


def direct_summary(results: DataFrame, first: int = 10) -> tuple[DataFrame, DataFrame]:
    """(files, succeeded, failed, success_rate, seconds, files_per_second; the first failures by path)."""
    ok, n, spent = F.col("error").isNull(), F.count("*"), F.sum("seconds")
    totals = results.agg(n.alias("files"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(100.0 * F.count_if(ok) / n, 1).cast("double").alias("success_rate"), F.round(spent, 2).alias("seconds"), F.when(spent > 0, F.round(n / spent, 2)).alias("files_per_second"))
    return totals, results.where(~ok).select("package_id", "rel_path", "error").orderBy("package_id", "rel_path").limit(first)


HEADLINE = ("malicious_node_count", "malicious_density", "category_diversity", "num_malicious_communities")


def package_report(rows: DataFrame, rules: DataFrame, package_id: str | None = None) -> DataFrame:
    """One package's (or every one's) number of hits and headline features, with a row for each hit rule's details, or one without."""
    one = rows if package_id is None else rows.where(F.col("package_id") == package_id)
    hits = one.select("package_id", "hit_rules_count", *HEADLINE, F.explode_outer(F.filter(F.split("hit_rules", ","), lambda x: x != "")).alias("rule_id"))
    return hits.join(rules.select("rule_id", "name", "category"), "rule_id", "left")


def not_done(todo: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What has no result yet: skip-existing and resume."""
    return todo.join(done.select(*on), on, "left_anti")
