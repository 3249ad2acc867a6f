"""Rule mining from package trees to a rule file: samples, a model's answers, consolidation.

The model is any callable; its answers are the only thing made one by one, on the driver, and are kept every ``KEPT``
answers, so a run that breaks off goes on where it was.  All else is relational.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.default_rules import CATEGORIES
from ..sources import packages as scans
from . import mining, reports

SAMPLES, KEPT = 1000, 10  # fixed values: packages of a full run, answers between two appends
ANSWERS = "sample string, sample_ord int, raw string"


def samples(spark: SparkSession, root: str, n: int = SAMPLES) -> DataFrame:
    """package_id, code of a random sample of package folders; packages without code are left out."""
    some = scans.sampled(scans.packages(spark, root, classified=False), n)
    files = scans.source_files(spark, root, classified=False).join(some, "package_id", "left_semi")
    return scans.sample_code(files).where(F.length(F.trim("code")) > 0)


def extract(code: DataFrame, ask: Callable[[str], str], path: str, every: int = KEPT) -> DataFrame:
    """Asks a model about every sample (package_id, code) not yet in the answers at ``path``; returns all answers there.

    The driver has the answers, so it writes them itself, a JSON file for each append: a Spark job for each took far longer.
    A file gets its name once it is whole; Spark doesn't read names that begin with ``_``.
    """
    spark = code.sparkSession
    at_path = spark._jvm.org.apache.hadoop.fs.Path
    store = at_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    held = spark.read.schema(ANSWERS).json(path) if store.exists(at_path(path)) else None
    todo = code if held is None else reports.not_done(code, held.select(F.col("sample").alias("package_id")), ["package_id"])
    at = 0 if held is None else held.count()
    new = []

    def keep():
        if new:
            name = f"{new[0]['sample_ord']:09d}-{uuid.uuid4().hex[:12]}.json"
            partial, whole = at_path(f"{path}/_{name}"), at_path(f"{path}/part-{name}")
            out = store.create(partial)
            out.write("".join(f"{json.dumps(x)}\n" for x in new).encode())
            out.close()
            if not store.rename(partial, whole):
                raise OSError(f"cannot rename {partial.toString()} to {whole.toString()}")
            new.clear()

    for row in todo.orderBy("package_id").toLocalIterator():
        new.append({"sample": row.package_id, "sample_ord": at, "raw": mining.asked(ask, row.code)})
        at += 1
        if len(new) == every:
            keep()
    keep()
    return spark.read.schema(ANSWERS).json(path) if at else spark.createDataFrame([], ANSWERS)


def records(answers: DataFrame) -> DataFrame:
    """sample, sample_ord, valid_json, rule_count, valid_count, rules (the valid ones): a row for each answer."""
    parsed = answers.select("sample", "sample_ord", mining.answer_rules(F.col("raw")).alias("rules"))
    fields = ("rule_id", "name", "category", "node_type", "callee_name_regex", "content_regex", "content")
    good = mining.valid(mining.flat(parsed)).groupBy("sample", "sample_ord").agg(F.array_sort(F.collect_list(F.struct("rule_ord", *fields))).alias("good"))  # one answer's rules
    out = parsed.join(good, ["sample", "sample_ord"], "left")
    none = F.lit(0)
    return out.select("sample", "sample_ord", F.col("rules").isNotNull().alias("valid_json"), F.coalesce(F.when(F.col("rules").isNotNull(), F.size("rules")), none).alias("rule_count"), F.coalesce(F.when(F.col("good").isNotNull(), F.size("good")), none).alias("valid_count"), F.col("good").alias("rules"))


def consolidate(answers: DataFrame, call: Callable[[str, list[dict]], list[dict]], min_frequency: int = mining.MIN_FREQUENCY, batch: int = mining.BATCH) -> DataFrame:
    """Final rules from all answers: frequent atomic rules by category, consolidated through ``call(category, rules)``, validated, cleaned up, numbered."""
    spark = answers.sparkSession
    parsed = answers.select("sample", "sample_ord", mining.answer_rules(F.col("raw")).alias("rules"))
    frequent = mining.by_category(mining.atomic(mining.valid(mining.flat(parsed))), min_frequency, batch)
    found: dict[str, list] = {c: [] for c in CATEGORIES}
    for r in sorted(frequent.collect(), key=lambda r: r.place):  # frequent patterns only; the answers are read once for all categories
        found[r.category].append(r)
    rows = []
    for category, code in CATEGORIES.items():
        rules = [{"rule_id": r.rule["rule_id"], "name": r.rule["name"], "category": category, "pdcg_pattern": {"node_type": r.node_type, **{c: r.rule[c] for c in ("callee_name_regex", "content_regex", "content") if r.rule[c]}}, "_freq": r.freq} for r in found[category]]
        if rules:
            rows += mining.kept_rules(mining.consolidated(rules, lambda x, c=category: call(c, x), batch, code))
    flat = [(i, r["rule_id"], r["name"], r["category"], *((r.get("pdcg_pattern") or {}).get(c) for c in ("node_type", "callee_name_regex", "content_regex", "content"))) for i, r in enumerate(rows)]
    return mining.cleaned(spark.createDataFrame(flat, "seen int, rule_id string, name string, category string, node_type string, callee_name_regex string, content_regex string, content string"))


def document(rules: DataFrame, source: str) -> dict:
    """A rule file: metadata with totals by category, and the rules in the order of their categories and numbers."""
    codes = {c: i for i, c in enumerate(CATEGORIES)}
    rows = sorted(rules.collect(), key=lambda r: (codes[r.category], r.rule_id))
    count = {CATEGORIES[r.category]: r.rules for r in mining.breakdown(rules).collect()}
    pattern = lambda r: {c: r[c] for c in ("node_type", "callee_name_regex", "content_regex", "content") if r[c]}
    return {"metadata": {"source": source, "total_rules": len(rows), "category_breakdown": count}, "rules": [{"rule_id": r.rule_id, "name": r.name, "category": r.category, "pdcg_pattern": pattern(r)} for r in rows]}


def write_document(spark: SparkSession, rules: DataFrame, path: str, source: str = "answers of a model") -> None:
    spark.createDataFrame([(json.dumps(document(rules, source), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
