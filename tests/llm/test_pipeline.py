"""The pipeline's stages, each against its own input."""

import math
import random

import corpus_pipeline as P
import duckdb
from pyspark.sql import functions as F

from reviewlake.llm import decontaminate, mixing, sharding
from tests.llm.test_operators import brute_components, plain_rules

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    counts = []
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, DIR).persist()
        counts.append((name, before.count(), docs.count()))
        assert docs.columns[: len(before.columns)] == before.columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert [n for n, _, _ in counts] == ["quality_rules", "near_duplicates", "without_benchmark", "mixed", "sharded"]
    assert counts[0][2] < counts[0][1] and counts[1][2] < counts[1][1] and counts[4][2] == counts[4][1]
    assert docs.filter(F.col("shard").isNull()).count() == 0


def test_rows_against_brute_force(spark, tmp_path):
    """run() over a small table, stage by stage with plain loops and SQL over text; null text, null source, copies, passages."""
    rnd = random.Random(21)
    say = lambda n: " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(300)}" for _ in range(n))
    base, item = say(90), say(30)
    rows = [(k, say(70), f"s{k % 3}" if k % 7 else None) for k in range(40)]
    rows += [(100 + k, base + " " + say(k % 4), "s1") for k in range(12)]
    rows += [(200 + k, say(60) + " " + item, "s2") for k in range(4)] + [(300, say(1000) + " " + item[:60], "s0")]
    rows += [(400 + k, "one plate of words here\n" + say(70), "s0") for k in range(30)]
    rows += [(500, None, "s0"), (501, "", None), (502, "short text", "s1")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, say(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path))

    left = [r for r, _, kept in plain_rules(rows) if kept]
    component = {d: c for d, _, c in brute_components([r[:2] for r in left], P.NEAR_WORDS, P.NEAR_PERCENT)}
    unlike = [r for r in left if component[r[0]] == r[0]]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", unlike)
    dirty = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontaminate.oracle()}) WHERE contaminated").fetchall()}
    clean = [r for r in unlike if r[0] not in dirty]
    con.execute("DELETE FROM documents")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", clean)
    times = {d: math.floor(taken / size + 0.5) for d, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.oracle()}) WHERE size > 0").fetchall()}
    shard = dict(con.execute(f"SELECT DISTINCT doc_id, shard FROM ({sharding.oracle()})").fetchall())
    want = sorted((d, t, s or "", shard[d]) for d, t, s in clean for _ in range(times[d]))
    assert sorted((r.doc_id, r.text, r.source or "", r.shard) for r in got.collect()) == want
    assert len(left) < len(rows) and len(unlike) < len(left) and dirty and len(want) != len(clean)


def test_stages_of_an_empty_table(spark):
    empty = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, DIR)
        assert empty.count() == 0
