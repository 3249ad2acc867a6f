from __future__ import annotations

from paxlens.cli import main


def test_stages(spark, tmp_path, capsys):
    for path, text in {"malicious/a/i.js": "eval(atob('x'))", "malicious/a/package.json": '{"scripts": {"install": "sudo rm x"}}', "benign/b/i.js": "f(1)", "benign/c/bad.js": "a b"}.items():
        p = tmp_path / "in" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    how = ["--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out")]
    assert main(["trees", *how, "--preview"], spark) == 0 and not (tmp_path / "out").exists()
    assert main(["analyse", *how], spark) == 0
    rows = {r.package_id: r for r in spark.read.parquet(str(tmp_path / "out/features")).collect()}
    assert {k: r.hit_rules for k, r in rows.items()} == {"a": "DE-004,PE-001,PE-002,PE-009,PE-016", "b": "", "c": ""} and rows["a"].label == 1
    trees = spark.read.parquet(str(tmp_path / "out/trees")).count()
    (tmp_path / "in/benign/b/j.mjs").write_text("g(2)")
    assert main(["trees", *how, "--skip-existing", "--no-report"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out/trees")).count() == trees + 1
    assert main(["graphs", *how, "--skip-existing"], spark) == 0 and main(["features", *how, "--no-report"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out/graphs")).where("rel_path = 'j.mjs'").count() == 1
    assert "top" not in capsys.readouterr().err
