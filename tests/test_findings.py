"""The findings pipeline, sources, sinks, history and streams."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import explain, findings, history, sinks
from reviewlake.functions.schemas import RUN
from reviewlake.plans import review
from reviewlake.sources import config, corpus
from reviewlake.streaming import watch

SCHEMA = "prefix string, severity string, message string, file string, line int, affected_dependents int, suggestion string, fix struct<kind:string,find:string,replace:string>"


def found(spark, rows):
    return spark.createDataFrame([(p, s, m, f, n, 0, None, fix) for p, s, m, f, n, fix in rows], SCHEMA)


@pytest.fixture(scope="module")
def some(spark):
    rows = [("SEC", "error", "m1", "src/a.py", 2, None), ("SEC", "warning", "m2", "src/a.py", 3, None), ("SQL", "error", "m3", "tests/b.py", 1, None), ("SQL", "info", "m4", "src/c.py", 9, None)]
    return findings.number(found(spark, rows)).persist()


def test_numbers(some):
    assert sorted((r.id, r.message) for r in some.collect()) == [("SEC-001", "m1"), ("SEC-002", "m2"), ("SQL-001", "m4"), ("SQL-002", "m3")]
    assert findings.number(some.drop("id"), ["SEC-001"]).filter("id = 'SEC-002'").count() == 1


def test_inline(spark, some):
    lines = corpus.lines_of(spark.createDataFrame([("src/a.py", "# lint-ignore SEC\nx\ny\n"), ("tests/b.py", "q # lint-ignore *\n")], corpus.FILES))
    kept, gone = findings.suppress_inline(some, lines)
    assert {r.message for r in gone.collect()} == {"m1", "m3"} and {r.message for r in kept.collect()} == {"m2", "m4"}


def test_paths_baseline_diff(spark, some):
    kept, gone = findings.suppress_paths(some, {"**/tests/**": ["*"], "src/*.py": ["SEC"]})
    assert {(r.message, r.suppression_reason) for r in gone.collect()} == {("m1", "per-path rule: src/*.py"), ("m2", "per-path rule: src/*.py"), ("m3", "per-path rule: **/tests/**")}
    base = spark.createDataFrame([("src/c.py", "m4")], "file string, message string")
    assert {r.message for r in findings.suppress_baseline(some, base)[1].collect()} == {"m4"}
    changed = spark.createDataFrame([("src/a.py", False, 3), ("tests/b.py", True, None)], corpus.CHANGED)
    assert {r.message for r in findings.keep_changed(some, changed).collect()} == {"m2", "m3"}


def test_summary_and_gate(some):
    row = findings.gate(findings.summary(some), "error", {"warnings": 0}).first()
    assert (row.errors, row.warnings, row.info, row.debt_minutes, row.failed) == (2, 1, 1, 160, True)
    assert not findings.gate(findings.summary(some), "never").first().failed


def test_fixes(spark):
    lines = corpus.lines_of(spark.createDataFrame([("a.py", "pickle.load(pickle)\n  x = 1\nz\n"), ("b.py", "q\n")], corpus.FILES))
    rows = [("ML", "warning", "m", "a.py", 1, ("replace_pattern", r"pickle\.(\w+)", "joblib.$1")), ("X", "info", "note", "a.py", 2, ("comment_out", None, None)), ("X", "info", "n", "b.py", 1, ("suggestion", None, None))]
    assert [tuple(r) for r in findings.apply_fixes(lines, found(spark, rows)).collect()] == [("a.py", "joblib.load(pickle)\n  # note\n  # x = 1\nz\n")]


def test_sinks(some, tmp_path):
    path = tmp_path / "out.sarif"
    sinks.write_sarif(some, str(path))
    log = json.loads(path.read_text())["runs"][0]
    assert [r["id"] for r in log["tool"]["driver"]["rules"]] == ["SEC", "SQL"] and len(log["results"]) == 4
    assert {r["level"] for r in log["results"]} == {"error", "warning", "note"}
    assert "::notice file=src/c.py,line=9,title=SQL-001::m4" in {r.value for r in sinks.annotations(some).collect()}
    assert "<td>a&lt;b</td>" in sinks.html_report({"t": some.limit(1).select(F.lit("a<b").alias("x"))})
    assert len(list(sinks.terminal(some))) == 4
    sinks.write_json(some, findings.summary(some), str(tmp_path / "out.json"))
    told = json.loads((tmp_path / "out.json").read_text())
    assert told["summary"] == {"errors": 2, "warnings": 1, "info": 1} and len(told["findings"]) == 4
    assert explain.explain("sql-004").startswith("SQL: ") and explain.explain("nothing") is None


def test_history(spark, tmp_path):
    for k in range(3):
        run = {"id": f"r{k}", "timestamp": 1_700_000_000 + 86_400 * 6 * k, "summary": {"errors": k, "warnings": 0, "info": 1, "suppressed": 0}, "findings": [{"id": "SEC-001", "severity": "error", "message": "m", "file": "f", "line": 1, "suppressed": False}] * k}
        (tmp_path / f"{k}.json").write_text(json.dumps(run, indent=1))
    (tmp_path / "bad.json").write_text("{")
    runs = history.read_runs(spark, str(tmp_path))
    assert [r.id for r in history.listing(runs).collect()] == ["r2", "r1", "r0"]
    assert tuple(history.clean_rate(runs).first()) == (3, 1, 33.3)
    assert tuple(history.week_trend(runs, 1_700_000_000 + 86_400 * 12).first()) == (5, 1)
    assert [tuple(r) for r in history.noisiest(history.findings_of(runs)).collect()] == [("SEC", 3)]
    assert history.report_tables(spark.createDataFrame([], RUN))["trend"].count() == 0


def test_config(tmp_path):
    text = '[general]\nfail_on = "warning"\n[modules]\ninfra = true\nsecurity = false\n[ignore]\nfindings = ["SEC-001"]\n[ignore.per_path]\n"**/t/**" = ["SEC"]\n[gate]\nerror_max = 3\n[[rules]]\npattern = "a"\nmessage = "b"\npaths = ["*.py"]\n'
    own = config.parse(text)
    assert "infra" in own.modules and "security" not in own.modules and own.rules[0].paths == ("*.py",) and own.max_counts == {"error": 3}
    config.save(config.suppress(own, "SQL-002"), str(tmp_path / config.NAME))
    assert config.find(str(tmp_path)).ignore_findings == ["SEC-001", "SQL-002"]


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x\ny\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\x00")
    git("add", "-A")
    git("commit", "-qm", "1")
    (tmp_path / "a.py").write_text("x\nz\ny\n")
    (tmp_path / "c.py").write_text("n\n")
    git("add", "-A")
    assert {r.path for r in corpus.git_files(spark, str(tmp_path), "HEAD").collect()} == {"a.py"}
    assert sorted(tuple(r) for r in corpus.changed_files(spark, str(tmp_path), "HEAD").collect()) == [("a.py", "modified", None), ("c.py", "added", None)]
    assert {tuple(r) for r in corpus.changed_lines(spark, str(tmp_path), "HEAD").collect()} == {("a.py", False, 2), ("c.py", True, None)}
    assert corpus.git_file(spark, str(tmp_path), "HEAD", "a.py") == "x\ny\n" and corpus.git_file(spark, str(tmp_path), "HEAD", "no") is None


def test_review(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "import os\nos.system(x) # lint-ignore CMD\nos.popen(x)\n"), ("b.py", "import a\n")], corpus.FILES)
    out = review.review(files, config.Config(modules={"security", "cycles", "dead_imports"}))
    assert {(r.id, r.file, r.line) for r in out.findings.collect()} == {("IMP-001", "b.py", 1)}
    assert out.suppressed.count() == 2
    assert review.baseline(files, config.Config(modules={"security"})).count() == 2


def test_watch(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a.py", "os.system(x)"), ("2024-01-01 00:00:01", "a.py", "os.popen(x)"), ("2024-01-01 00:00:02", "b.py", None)]
    spark.createDataFrame(rows, "ts string, path string, content string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    seen = []
    query = watch.watch(watch.changes(spark, str(tmp_path / "in")), lambda df, k: seen.extend(df.orderBy("seq").collect()), config.Config(modules={"security"}), str(tmp_path / "state"), once=True)
    query.awaitTermination()
    assert [r.kind for r in seen] == ["progress", "finding", "done"] and "os.popen" in seen[1].payload
