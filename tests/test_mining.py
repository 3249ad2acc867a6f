"""Rule mining: answers, validation, duplicates, consolidation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paxlens.functions import miner, mining

FORM = "sample string, sample_ord int, rule_ord int, rule_id string, name string, category string, node_type string, callee_name_regex string, content_regex string, content string"


def test_answers(spark):
    rule = '[{"rule_id": "A", "category": "PAYLOAD_EXECUTION", "pdcg_pattern": {"node_type": "CALL", "callee_name_regex": "x"}}]'
    raws = [f"so: {rule} end", f"```json\n{rule}\n```", "none", "[1, oops", '{"a": 1}']
    got = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", mining.answer_rules(F.col("raw")).alias("r")).orderBy("i").collect()
    assert got[0].r[0].rule_id == "A" and [x.r for x in got[1:]] == [None] * 4


def test_validation(spark):
    rows = [
        ("s", 0, 0, "A", "", "PAYLOAD_EXECUTION", "CALL", "x", None, None), ("s", 0, 1, "B", None, "PAYLOAD_EXECUTION", "CALL", None, "x", None), ("s", 0, 2, "C", "n", "DATA_ENCODING", "ARGUMENT", None, None, "c"),
        ("s", 0, 3, "", "n", "DATA_ENCODING", "ARGUMENT", None, None, "c"), ("s", 0, 4, "E", "n", "OTHER", "ARGUMENT", None, None, "c"), ("s", 0, 5, "F", "n", "DATA_ENCODING", "ARGUMENT", None, "(", None),
    ]
    df = spark.createDataFrame(rows, FORM)
    assert {r.rule_id for r in mining.valid(df).collect()} == {"A", "C", "F"}
    assert {(r.rule_id, r.name) for r in mining.validated(df).collect()} == {("A", "A"), ("C", "n")}


def test_cleaning(spark):
    rows = [
        ("s", 0, 0, "A", "", "SPECIAL_PATTERNS", "ARGUMENT", None, "x", None), ("s", 0, 1, "B", "", "PAYLOAD_EXECUTION", "ARGUMENT", None, "x ", None), ("s", 0, 2, "C", "", "DATA_ENCODING", "ARGUMENT", None, "^-c$", None),
        ("s", 0, 3, "D", "", "DATA_ENCODING", "ARGUMENT", None, None, "one"), ("s", 0, 4, "E", "", "DATA_ENCODING", "ARGUMENT", None, None, "two"),
    ]
    df = spark.createDataFrame(rows, FORM).withColumn("seen", F.struct("sample_ord", "rule_ord"))
    assert {(r.rule_id, r.content_regex, r.content) for r in mining.cleaned(df).collect()} == {("PE-001", "x ", None), ("DE-001", None, "one")}
    assert {r.rule_id for r in mining.cleaned(df, dedup_content=True).collect()} == {"PE-001", "DE-001", "DE-002"}


def test_consolidation():
    rules = [{"rule_id": str(i), "category": "DATA_ENCODING", "pdcg_pattern": {"node_type": "CALL", "callee_name_regex": f"c{i}"}, "_freq": 2} for i in range(5)]
    whole = [r | {"name": r["rule_id"]} for r in rules]
    for r in whole:
        del r["_freq"]
    sizes = []

    def call(x):
        sizes.append(len(x))
        return [{"rule_id": "m"}] if len(x) <= 2 else []

    assert mining.consolidated(rules, call, batch=2) == [] and sizes == [2, 2, 1, 3]  # what a failed merge leaves must be valid
    assert mining.consolidated(rules[:3], call, batch=9) == [{"rule_id": "m"}]
    assert mining.consolidated(rules, lambda x: [], batch=9) == mining.consolidated(rules, lambda x: [], batch=2) == whole
    bad = [{"rule_id": "x", "category": "DATA_ENCODING", "pdcg_pattern": {"node_type": "CALL", "callee_name_regex": "("}}, {"rule_id": "y", "category": "?"}]
    assert [r["rule_id"] for r in mining.consolidated(rules + bad, lambda x: [], batch=9, code="DE")] == [f"DE-00{i}" for i in range(1, 6)]


def test_retries():
    waits, turns = [], []

    def call(_):
        turns.append(1)
        raise OSError

    assert mining.asked(call, "p", wait=waits.append) == "" and len(turns) == 3 and waits == [1.0, 2.0]


def jobs_of(spark, group, run):
    """What run() returns, and the number of Spark jobs it started from this thread."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_answers_are_kept_without_a_job_for_each_append(spark, tmp_path):
    code = spark.createDataFrame([(f"p{i:03d}", f"code {i}") for i in range(205)], "package_id string, code string")
    path, asked = f"file://{tmp_path}/answers", []

    def ask(prompt):
        if len(asked) == 25:
            raise KeyboardInterrupt
        asked.append(prompt)
        return f"{prompt}\r\n\u2028 \"\u00e9\U0001f600"

    try:
        miner.extract(code, ask, path)
    except KeyboardInterrupt:
        pass
    held = spark.read.schema(miner.ANSWERS).json(path).collect()
    assert {r.sample: r.sample_ord for r in held} == {f"p{i:03d}": i for i in range(20)}  # two appends
    again = []
    got, jobs = jobs_of(spark, "answers", lambda: miner.extract(code, lambda x: again.append(x) or f"{x}\r\n\u2028 \"\u00e9\U0001f600", path))
    assert again == [f"code {i}" for i in range(20, 205)] and jobs < 12  # 19 appends
    assert sorted(tuple(r) for r in got.collect()) == [(f"p{i:03d}", i, f"code {i}\r\n\u2028 \"\u00e9\U0001f600") for i in range(205)]
    assert miner.extract(code, ask, path).count() == 205  # nothing left to ask


def test_consolidation_reads_answers_once(spark, tmp_path):
    record = lambda c, p: {"rule_id": "r", "category": c, "pdcg_pattern": {"node_type": "CALL", "callee_name_regex": p}}
    raw = lambda i: json.dumps([record("DATA_ENCODING", "common"), record("PAYLOAD_EXECUTION", f"half{i % 2}"), record("SPECIAL_PATTERNS", f"own{i}"), record("SPECIAL_PATTERNS", "z")])
    answers = spark.createDataFrame([(f"s{i}", i, raw(i)) for i in range(5)], miner.ANSWERS)
    answers.write.json(f"file://{tmp_path}/answers")
    calls = []
    answers = spark.read.schema(miner.ANSWERS).json(f"file://{tmp_path}/answers")
    rules, jobs = jobs_of(spark, "consolidate", lambda: miner.consolidate(answers, lambda c, x: calls.append((c, [r["pdcg_pattern"]["callee_name_regex"] for r in x])) or []))
    want = {("DATA_ENCODING", ("common",)), ("PAYLOAD_EXECUTION", ("half0", "half1")), ("SPECIAL_PATTERNS", ("z",))}
    assert {(c, tuple(p)) for c, p in calls if len(p) == len(dict(want)[c])} == want
    assert {(r.rule_id, r.callee_name_regex) for r in rules.collect()} == {("DE-001", "common"), ("PE-001", "half0"), ("PE-002", "half1"), ("SP-001", "z")}
    assert jobs <= 5
