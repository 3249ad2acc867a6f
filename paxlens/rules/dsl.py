"""Rule files, their validation, and the compiler from rules to literal column predicates.

A rule is {rule_id, name, category, pattern}; its pattern is

    call      {node_type: CALL, callee_name?, callee_name_regex?, arguments?: [spec]}        all must hold
    argument  {node_type: ARGUMENT, content?, content_regex?, content_contains?}             one must hold
    combo     {primary_call: {callee_name_regex?}, required_arguments: [spec]}               all must hold
    spec      {index, content?, content_contains?, content_regex?}                           all must hold

Every pattern becomes a literal in the plan, so it is compiled once and stays in generated code; nodes are never joined
with rules.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .default_rules import CATEGORIES, default_rules

PATTERN_KEYS = ("pdcg_pattern", "pattern")  # fixed value: the first is the key in existing rule files
SEARCH = "(?dU)"  # makes Java's $ \s \w \d \b behave as re.search does on str


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    category: str
    kind: str  # CALL, ARGUMENT, COMBO or OTHER
    pattern: dict = field(hash=False)
    place: int = 0

    @property
    def code(self) -> str:
        return CATEGORIES.get(self.category, "SP")


def parse(records: list[dict]) -> list[Rule]:
    """Rules in file order.  Missing rule_id, pattern, index or required_arguments raise; other node types never match."""
    out = []
    for place, r in enumerate(records):
        key = next((k for k in PATTERN_KEYS if k in r), None)
        if "rule_id" not in r or key is None:
            raise ValueError(f"rule {place} lacks rule_id or pattern")
        p = r[key]
        kind = "COMBO" if "primary_call" in p else p.get("node_type") if p.get("node_type") in ("CALL", "ARGUMENT") else "OTHER"
        specs = p["required_arguments"] if kind == "COMBO" else p.get("arguments", [])
        if any("index" not in s for s in specs):
            raise ValueError(f"rule {r['rule_id']}: an argument lacks its index")
        for value in (*_regexes(p), *(x for s in specs for x in _regexes(s)), *_regexes(p.get("primary_call", {}))):
            re.compile(value)
        out.append(Rule(r["rule_id"], r.get("name", r["rule_id"]), r.get("category", "UNKNOWN"), kind, p, place))
    return out


def _regexes(p: dict):
    return (p[k] for k in ("callee_name_regex", "content_regex") if k in p)


def shipped() -> list[Rule]:
    return parse(default_rules())


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """A rule file (JSON with a ``rules`` list) from any store Spark reads; rule files are small by nature."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    return parse(json.loads(row.value)["rules"])


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule_idx, rule_id, name, category, code, kind, pattern (JSON)."""
    return spark.createDataFrame([(r.place, r.rule_id, r.name, r.category, r.code, r.kind, json.dumps(r.pattern)) for r in rules], "rule_idx int, rule_id string, name string, category string, code string, kind string, pattern string")


def search(text: Column, pattern: str) -> Column:
    """re.search as a column."""
    return text.rlike(SEARCH + pattern)


def unquoted(text: Column) -> Column:
    """Without quote characters at either end, any number of them."""
    return F.btrim(text, F.lit("\"'"))


def _spec(args: Column, spec: dict) -> Column:
    content = F.element_at(args, F.lit(int(spec["index"])))
    tests = [content.isNotNull()]
    if "content" in spec:
        tests.append(unquoted(content) == spec["content"])
    if "content_contains" in spec:
        tests.append(content.contains(spec["content_contains"]))
    if "content_regex" in spec:
        tests.append(search(content, spec["content_regex"]))
    return reduce(and_, tests)


def _specs(args: Column, specs: list[dict]) -> Column:
    """All specs hold; a call without arguments (null) matches none, not even an empty list."""
    return reduce(and_, [args.isNotNull(), *(_spec(args, s) for s in specs)])


def predicate(rule: Rule, callee: Column, content: Column, args: Column | None) -> Column | None:
    """The rule as a condition on one node's columns; None if it can match no node."""
    p = rule.pattern
    if rule.kind == "ARGUMENT":
        tests = []
        if "content" in p:
            tests.append(unquoted(content) == p["content"])
        if "content_regex" in p:
            tests.append(search(content, p["content_regex"]))
        if "content_contains" in p:
            tests.append(content.contains(p["content_contains"]))
        return reduce(or_, tests) if tests else None
    if rule.kind == "OTHER":
        return None
    combo = rule.kind == "COMBO"
    call = p["primary_call"] if combo else p
    tests = [F.lit(True)]
    if not combo and "callee_name" in p:
        tests.append(callee == p["callee_name"])
    if "callee_name_regex" in call:
        tests.append(search(callee, call["callee_name_regex"]))
    specs = p.get("required_arguments" if combo else "arguments")
    if specs is not None:
        tests.append(_specs(args, specs))
    return reduce(and_, tests)


def needs_arguments(rules: list[Rule]) -> bool:
    return any(r.kind == "COMBO" or r.kind == "CALL" and "arguments" in r.pattern for r in rules)


def match_order(rules: list[Rule]) -> list[Rule]:
    """First match decides a node's category: call rules, argument rules, combos, each in file order."""
    return sorted(rules, key=lambda r: ({"CALL": 0, "ARGUMENT": 1, "COMBO": 2, "OTHER": 3}[r.kind], r.place))
