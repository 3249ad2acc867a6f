"""Deterministic parts of rule mining: parsing model answers, validation, frequencies, clean-up, numbering.

The model itself is a callable the caller brings; nothing here goes to a network.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from ..rules.default_rules import CATEGORIES

# Limits of mining runs, and the order in which categories win duplicates.
BATCH, MIN_FREQUENCY = 80, 2
PRIORITY = ("PAYLOAD_EXECUTION", "DATA_TRANSMISSION", "DATA_ENCODING", "INFORMATION_GATHERING", "SPECIAL_PATTERNS")
BARE_FLAG = r"^\^?-{1,2}[a-zA-Z]{1,2}\$?$"
RECORD = "array<struct<rule_id:string,name:string,category:string,pdcg_pattern:struct<node_type:string,callee_name_regex:string,content_regex:string,content:string>>>"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def answer_rules(raw: Column) -> Column:
    """The rules of a model's answer, null if it holds no JSON list: fenced blocks go, the widest brackets stay."""
    text = F.regexp_replace(raw, r"(?s)```.*?```", "")
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    is_list = F.schema_of_variant(F.try_parse_json(found)).startswith("ARRAY")
    return F.when(F.coalesce(is_list, F.lit(False)), F.from_json(found, RECORD))


def flat(records: DataFrame) -> DataFrame:
    """One row a rule: sample, sample_ord, rule_ord and the rule's fields; ``rules`` is an array as RECORD."""
    each = records.select("sample", "sample_ord", F.posexplode("rules").alias("rule_ord", "r"))
    p = F.col("r.pdcg_pattern")
    return each.select("sample", "sample_ord", "rule_ord", "r.rule_id", "r.name", "r.category", *(p[c].alias(c) for c in ("node_type", "callee_name_regex", "content_regex", "content")))


def _filled(c: str) -> Column:
    return F.when(F.length(c) > 0, F.col(c))


def pattern(default: str = "") -> Column:
    """The first pattern that is not empty, trimmed."""
    return trimmed(F.coalesce(_filled("callee_name_regex"), _filled("content_regex"), F.col("content"), F.lit(default)))


def valid(rules: DataFrame) -> DataFrame:
    """Rules with an id, a known category and the pattern that their node type needs."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    kind = F.coalesce("node_type", F.lit(""))
    return rules.where(has("rule_id") & F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)) & ((kind != "CALL") | has("callee_name_regex")) & ((kind != "ARGUMENT") | has("content_regex") | has("content")))


@F.pandas_udf(BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    def ok(p: str | None) -> bool:
        try:
            re.compile(p or "")
            return True
        except re.error:
            return False

    return patterns.map(ok)


def validated(rules: DataFrame) -> DataFrame:
    """valid(), names filled from ids, and patterns that compile."""
    raw = F.coalesce(_filled("callee_name_regex"), _filled("content_regex"), F.col("content"), F.lit(""))
    return valid(rules).where(compiles(raw)).withColumn("name", F.coalesce(_filled("name"), F.col("rule_id")))


def atomic(rules: DataFrame) -> DataFrame:
    """One row for each (category, node_type, pattern): frequency in distinct samples, first_seen, and the last sample's first such rule."""
    keyed = rules.withColumns({"pattern": pattern(), "category": F.coalesce("category", F.lit("")), "node_type": F.coalesce("node_type", F.lit(""))})
    at = F.struct("sample_ord", "rule_ord")
    per = keyed.groupBy("category", "node_type", "pattern", "sample_ord").agg(F.min("rule_ord").alias("rule_ord"), F.min_by(F.struct("rule_id", "name", "callee_name_regex", "content_regex", "content"), "rule_ord").alias("rule"))
    return per.groupBy("category", "node_type", "pattern").agg(F.count("*").alias("freq"), F.min(at).alias("first_seen"), F.max_by("rule", "sample_ord").alias("rule"))


def by_category(found: DataFrame, min_frequency: int = MIN_FREQUENCY, batch: int = BATCH) -> DataFrame:
    """Frequent rules of known categories with their place in the category (by frequency, then first seen) and batch."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("freq"), "first_seen"))
    return found.where((F.col("freq") >= min_frequency) & F.col("category").isin(*CATEGORIES)).withColumn("place", place).withColumn("batch", F.floor((F.col("place") - 1) / batch).cast("int"))


def numbered(rules: DataFrame, order: list[Column | str]) -> DataFrame:
    """New ids ``PE-001``, ... within each category."""
    codes = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    n = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    return rules.withColumn("rule_id", F.format_string("%s-%03d", F.element_at(codes, F.col("category")), n))


def cleaned(rules: DataFrame, dedup_content: bool = False) -> DataFrame:
    """Drops bare command-line flags, keeps one of equal patterns by category priority, and numbers anew.

    Rows have ``seen`` (a total order).  Content-only rules have an empty pattern key and collapse into one, as existing rule
    bases were made; ``dedup_content`` keys them by their content instead.
    """
    key = trimmed(F.coalesce(_filled("callee_name_regex"), _filled("content_regex"), F.col("content") if dedup_content else F.lit(""), F.lit("")))
    rank = F.coalesce(*(F.when(F.col("category") == c, i) for i, c in enumerate(PRIORITY)), F.lit(9))
    keyed = rules.withColumns({"key": key, "kind": F.coalesce("node_type", F.lit(""))}).where(~F.col("key").rlike("(?d)" + BARE_FLAG))
    same = Window.partitionBy("kind", "key")
    best = keyed.withColumns({"n": F.row_number().over(same.orderBy(rank, "seen")), "place": F.min("seen").over(same)}).where("n = 1")
    return numbered(best.where(F.col("category").isin(*CATEGORIES)), ["place"]).drop("n", "key", "kind", "place")


def breakdown(rules: DataFrame) -> DataFrame:
    """Rules by category."""
    return rules.groupBy("category").agg(F.count("*").alias("rules"))


def is_valid(rule: dict) -> bool:
    """valid() and a pattern that compiles, for one record."""
    p = rule.get("pdcg_pattern") or {}
    if not rule.get("rule_id") or rule.get("category") not in CATEGORIES:
        return False
    callee, content = p.get("callee_name_regex"), p.get("content_regex")
    if p.get("node_type") == "CALL" and not callee or p.get("node_type") == "ARGUMENT" and not (content or p.get("content")):
        return False
    try:
        re.compile(callee or content or p.get("content") or "")
    except re.error:
        return False
    return True


def kept_rules(rules: list[dict]) -> list[dict]:
    """Valid records without private fields, names filled from ids."""
    plain = ({k: v for k, v in r.items() if not k.startswith("_")} for r in rules)
    return [r | {"name": r.get("name") or r["rule_id"]} for r in plain if is_valid(r)]


def consolidated(rules: list[dict], call: Callable[[list[dict]], list[dict]], batch: int = BATCH, code: str | None = None) -> list[dict]:
    """Consolidates one category's rules through ``call``: in batches merged at the end, halves after a failure, else the valid ones as they are.

    With its ``code`` ids are numbered anew.  A category's rule list is small by nature; this is the driver's dialogue with a model.
    """
    if len(rules) <= batch:
        if not (out := call(rules)):
            half = len(rules) // 2
            first = call(rules[:half]) if half else []
            second = call(rules[half:]) if first else []
            out = (call(first + second) or first + second) if first and second else kept_rules(rules)
    else:
        parts = [p for k in range(0, len(rules), batch) for p in (call(rules[k : k + batch]) or kept_rules(rules[k : k + batch]))]
        out = call(parts) or kept_rules(parts)
    return [r | {"rule_id": f"{code}-{i:03d}"} for i, r in enumerate(out, 1)] if code else out


def asked(call: Callable[[str], str], prompt: str, tries: int = 3, wait: Callable[[float], None] | None = None) -> str:
    """A model's answer, empty after ``tries`` failures; waits 1, 2, 4, ... between them."""
    import time

    for k in range(tries):
        try:
            return call(prompt)
        except Exception:  # noqa: BLE001 - whatever a model client raises
            if k + 1 < tries:
                (wait or time.sleep)(2.0**k)
    return ""
