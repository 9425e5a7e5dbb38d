"""The registry of analyzers and formats, the baseline's folder, and suppression by comments."""

import pytest

from reviewlake.operators import findings, rules
from reviewlake.plans import registry
from reviewlake.sources import baseline, corpus
from reviewlake.sources.config import Config

FILES = [("a.py", "x = eval(input())\nprint(x)\n"), ("b.py", "try:\n    pass\nexcept:\n    pass\n")]


def test_registry(spark):
    lines = corpus.lines_of(corpus.named(spark.createDataFrame(FILES, "path string, content string")))
    own = registry.standard()
    config = Config()
    found, times = own.run(spark, lines, config)
    plain = rules.run_all(lines, config.modules)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    told = {r.analyzer: r.findings for r in times.collect()}
    assert set(told) <= config.modules and sum(told.values()) == found.count()
    own.add_lines("mine", lambda lines, config: rules.magic_numbers(lines).limit(0))
    assert "mine" in {r.analyzer for r in own.run(spark, lines, Config(modules=set()))[1].collect()}
    own.add_format("files", lambda f: f.select("file").distinct())
    assert own.write("files", found).columns == ["file"]
    with pytest.raises(ValueError):
        own.add_lines("mine", None)
    with pytest.raises(ValueError):
        own.write("none", found)
    assert registry.Registry().run(spark, lines, config)[0].count() == 0


def test_baseline_folder(spark, tmp_path):
    path = f"file://{tmp_path}/base"
    assert baseline.load(spark, path) is None
    rows = [("a", "m"), ("a", "m"), ("b", None)]
    baseline.save(spark.createDataFrame(rows, baseline.ENTRIES), path)
    again = baseline.load(spark, path)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(rows, key=str)
    baseline.save(again.filter("file = 'a'"), path)  # over what it is read from
    assert baseline.load(spark, path).count() == 2
    assert baseline.clear(spark, path) and not baseline.clear(spark, path)
    assert baseline.load(spark, path) is None


def test_comment_for_all(spark):
    lines = spark.createDataFrame([("a", 1, "# lint-ignore *"), ("a", 2, "x"), ("a", 3, "# lint-ignore SEC SQL"), ("b", 1, "y")], "path string, line_no int, line string")
    rows = [(p, f, n) for f in ("a", "b") for n in (1, 2, 3, 4) for p in ("SEC", "ML")]
    kept, gone = findings.suppress_inline(spark.createDataFrame(rows, "prefix string, file string, line int"), lines)
    want = {(p, f, n) for p, f, n in rows if f == "a" and (n <= 2 or p == "SEC")}
    assert {(r.prefix, r.file, r.line) for r in gone.collect()} == want and gone.count() == len(want)
    assert {(r.prefix, r.file, r.line) for r in kept.collect()} == set(rows) - want
