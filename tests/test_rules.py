"""Rules: the language, each default rule against re.search, and the order of matches."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from paxlens.operators.matching import hit_columns, mark, rule_vector
from paxlens.rules.default_rules import RULES
from paxlens.rules.dsl import parse, shipped

TEXTS = [
    "os", "dns", "'dns'", "os.hostname", "x.os.arch", "dns.lookup", "fs.readFile", "fs.readFileSync", "ps  aux", "whoami", "ls -la", "/etc/a.conf", "process.env.X", "env", "https", "a.connect",
    "s.pipe", "http://a.b/c", "-X POST", "/home/u/x", "q.oast.fun", "ifconfig.me", "https.get", "http.request", "net.connect", "10.0.0.255", "localStorage.getItem", "dotenv", "4444", "65535", "65536",
    "ping", "axios.get", "169.254.169.254", "r.setHeader", "ngrok.io", "dgram", "zlib", "JSON.parse", "base64", "_0x12ab", "atob", "A" * 32, "A" * 100 + "==", "child_process", "spawn", "bash", "curl",
    "chmod", "nohup", "process.exit", "$(x)", "eval", "document.createElement", "powershell -e", "pm2  start", "http://a/b.js", "https://a/b.sh", "dig", "sudo", "/tmp/x", "-sS x", "-sL", "777", "2>&1", "",
    "os\n", "os\r\n", "env ", "ps aux", "é-s", "١٢٣",
]


def test_default_rules_equal_re_search(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rules = shipped()
    assert len(rules) == 60
    call, _ = hit_columns(rules, F.lit("CALL"), F.col("t"), F.lit(""), None)
    arg, _ = hit_columns(rules, F.lit("ARGUMENT"), F.lit(""), F.col("t"), None)
    hit = set()
    for r in df.select("t", call.alias("c"), arg.alias("a")).collect():
        for rule_id, kind, pattern in RULES:
            want = r.t.strip("\"'") == pattern if kind == "content" else re.search(pattern, r.t) is not None
            assert (rule_id in (r.c if kind == "callee" else r.a)) == want, (rule_id, r.t)
            hit |= {rule_id} if want else set()
    assert hit == {r[0] for r in RULES}


CALLS = [("p", "c", "FILE", None, None, None), ("p", "f", "CALL", "f", None, None), ("p", "g", "CALL", "g.f", None, None), ("p", "a0", "ARGUMENT", None, 0, "'zed'"), ("p", "a2", "ARGUMENT", None, 2, "xb"), ("p", "d", "FUNCTION_DEF", None, None, None)]
EDGES = [("p", "c", "f", "calls", 0), ("p", "f", "a0", "has_arg", 1), ("p", "f", "a2", "has_arg", 2), ("p", "c", "g", "calls", 3)]
CASES = [
    ({"node_type": "ARGUMENT", "content": "zed"}, {"a0"}),
    ({"node_type": "ARGUMENT", "content": "a", "content_regex": "b$"}, {"a2"}),
    ({"node_type": "ARGUMENT"}, set()),
    ({"node_type": "ARGUMENT", "content_contains": "e"}, {"a0"}),
    ({"node_type": "CALL"}, {"f", "g"}),
    ({"node_type": "CALL", "callee_name": "f", "callee_name_regex": "g"}, set()),
    ({"node_type": "CALL", "callee_name": "f"}, {"f"}),
    ({"node_type": "CALL", "callee_name_regex": "f$", "arguments": [{"index": 1, "content": "x"}]}, set()),
    ({"node_type": "CALL", "arguments": []}, {"f"}),
    ({"node_type": "CALL", "arguments": [{"index": 0, "content": "zed"}, {"index": 2, "content_regex": "^x", "content_contains": "b"}]}, {"f"}),
    ({"primary_call": {}, "required_arguments": [{"index": 0, "content_contains": "z"}]}, {"f"}),
    ({"primary_call": {"callee_name_regex": "^g"}, "required_arguments": [{"index": 0}]}, set()),
    ({"node_type": "FUNCTION_DEF"}, set()),
    ({"node_type": "ARGUMENT", "content_regex": "b", "ex_content_regex": "b"}, {"a2"}),
]


@pytest.mark.parametrize(("pattern", "want"), CASES)
def test_language(spark, pattern, want):
    nodes = spark.createDataFrame(CALLS, "package_id string, node_id string, type string, callee_name string, arg_index int, content string")
    edges = spark.createDataFrame(EDGES, "package_id string, src string, dst string, type string, edge_seq int")
    got = mark(nodes, edges, parse([{"rule_id": "R", "category": "X", "pattern": pattern}])).where(F.size("hit_rules") > 0).collect()
    assert {r.node_id for r in got} == want and all(r.category == "SP" for r in got)


def test_first_match_and_vector(spark):
    rules = parse([{"rule_id": "SP-1", "category": "SPECIAL_PATTERNS", "pattern": {"primary_call": {}, "required_arguments": [{"index": 0}]}}, {"rule_id": "DT-1", "category": "DATA_TRANSMISSION", "pattern": {"node_type": "CALL", "callee_name": "f"}}, {"rule_id": "IG-1", "category": "INFORMATION_GATHERING", "pattern": {"node_type": "CALL", "callee_name_regex": "f"}}])
    nodes = spark.createDataFrame(CALLS, "package_id string, node_id string, type string, callee_name string, arg_index int, content string")
    edges = spark.createDataFrame(EDGES, "package_id string, src string, dst string, type string, edge_seq int")
    m = mark(nodes, edges, rules)
    got = {r.node_id: (list(r.hit_rules), r.category) for r in m.where(F.size("hit_rules") > 0).collect()}
    assert got == {"f": (["DT-1", "IG-1", "SP-1"], "DT"), "g": (["IG-1"], "IG")}
    assert rule_vector(m, rules).columns == ["package_id", "rule_SP-1", "rule_DT-1", "rule_IG-1"]


@pytest.mark.parametrize("bad", [{"pattern": {"node_type": "CALL"}}, {"rule_id": "x"}, {"rule_id": "x", "pattern": {"primary_call": {}, "required_arguments": [{}]}}])
def test_missing_keys(bad):
    with pytest.raises(ValueError, match="lacks"):
        parse([bad])
