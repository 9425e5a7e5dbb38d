"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. A document's size is its number of words. Sources, in code point order with null last, take the
   weights in turn. Their targets share all words by weight; a target stops at `cap` times its source's
   size, and the excess is shared again by weight until no target is above (solved in closed form).
2. The total is cut into blocks of `block_words` words. Blocks go to sources by the highest quotients
   target / (2 k + 1), and a source's blocks to its shards in the same way, which gives each shard an
   integer quota. A shard is a hash bucket of about `shard_words` words, so a source that holds a third
   of all rows has many.
3. In a shard, documents lie in seeded order on a tape. The quota is taken from the tape, once round
   for each full turn and then from a seeded block on. A document's `taken` is the words of it that lie
   in what was taken, repeats counted; it is at most `cap` times its size.

All of it is DataFrame operations. Windows run over sources, over one source's shards and over one shard's
documents; the first two are summaries of fixed width whose rows are sources and shards, not documents.

Edge cases: null text counts no words, as does a text of white space; a null source is a source of its
own, the last; repeated rows and ids count each; with no words at all, targets and taken are 0; an
empty input gives an empty result; texts may be of any length; columns of any name are kept. The seeded order uses MD5, so reruns and other engines agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm._shared import stored

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 4
SHARD_WORDS = 1 << 20
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text; 0 for null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed != "", F.length(F.regexp_replace(trimmed, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w"))).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row for each source: source, source_size, rank, weight, target."""
    every = Window.partitionBy()
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("most", F.col("source_size").cast("double") * cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    # Sources reach their caps in the order of ratio, so the level of the others is known in closed form.
    filled = Window.orderBy("ratio", "rank")
    level = (
        ranked.withColumn("place", F.row_number().over(filled))
        .withColumn("full", F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every).cast("double") - F.col("full")) / F.col("open"))
        .withColumn("best", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"])
        .withColumn("best", F.coalesce("best", F.max("ratio").over(every)))
    )
    return level.select("source", "source_size", "rank", "weight", F.least("most", F.col("best") * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """parties with the column `out`: seats won by the highest quotients votes / (2 k + 1), ties to the first party.

    `seats` holds the group's number of seats. A divisor at which no party gets more than it will have
    gives most seats at once; only the last ones, fewer than about three for each party, are ranked as
    rows, so the work does not depend on the number of seats.
    """
    whole = Window.partitionBy(*group)
    sized = (
        parties.withColumn("_votes", F.sum(votes).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_sure", F.greatest(F.col(seats) - F.col("_n") / 2.0, F.lit(0.0)))
        .withColumn("_share", F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(0.0))
        .withColumn("_base", F.greatest(F.floor(F.col("_share") * F.col("_sure") + 0.5) - 1, F.lit(0)))
        .withColumn("_extra", F.ceil(F.col("_share") * (F.col(seats) + F.col("_n") / 2.0 - F.col("_sure"))) + 2)
        .withColumn("_left", F.col(seats) - F.sum("_base").over(whole))
    )
    quotients = sized.select(*sized.columns, F.explode(F.sequence(F.col("_base"), F.col("_base") + F.col("_extra"))).alias("_k"))
    order = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *party, "_k")
    won = quotients.withColumn("_won", ((F.row_number().over(order) <= F.col("_left")) & (F.col(votes) > 0)).cast("long"))
    return (
        won.groupBy(*parties.columns, "_base").agg(F.sum("_won").alias("_won"))
        .select(*parties.columns, (F.col("_base") + F.col("_won")).alias(out))
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, text_key for each row of docs (doc_id, source, text)."""
    sizes = stored(measured(docs), "mix-sizes")
    sources = stored(targets(sizes, weights, cap), "mix-sources")
    blocks = (
        apportion(sources.withColumn("all", F.lit(0)).withColumn("seats", F.round(F.sum("source_size").over(Window.partitionBy()) / F.lit(float(block_words))).cast("long")), ["all"], ["rank"], "target", "seats", "blocks")
        .select("source", "rank", "source_size", "target", "blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(shard_words)))).alias("n_shards"))
    )
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = (
        sizes.withColumnRenamed("source", "_source").join(blocks, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
        .withColumn("_order", order)
        .withColumn("shard", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    )
    shards = placed.groupBy("rank", "shard", "blocks", "target", "source_size").agg(F.sum("size").alias("shard_size"))
    votes = shards.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * (F.col("shard_size") / F.col("source_size"))).otherwise(0.0))
    tape = F.greatest(F.col("shard_size"), F.lit(1))
    plan = (
        apportion(votes, ["rank"], ["shard"], "votes", "blocks", "quota")
        .withColumn("words", F.least(F.col("quota") * block_words, F.col("shard_size") * cap))
        .withColumn("turns", F.floor(F.col("words") / tape))
        .withColumn("rest", F.col("words") - F.col("turns") * F.col("shard_size"))
        .withColumn("first", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rank", "shard").cast("binary")), 1, 12), 16, 10).cast("long") % F.ceil(tape / F.lit(float(block_words))) * block_words)
        .select(F.col("rank").alias("_rank"), F.col("shard").alias("_shard"), "shard_size", "turns", "rest", "first")
    )
    before = Window.partitionBy("rank", "shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("_at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    end = F.col("_at") + F.col("size")

    def overlap(start: Column) -> Column:
        return F.greatest(F.least(end, start + F.col("rest")) - F.greatest(F.col("_at"), start), F.lit(0))

    taken = F.col("turns") * F.col("size") + overlap(F.col("first")) + overlap(F.col("first") - F.col("shard_size"))
    return (
        laid.join(plan, (F.col("rank") == F.col("_rank")) & (F.col("shard") == F.col("_shard")))
        .select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_key")
    )


def drawn(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its share of taken words, rounded, with all its columns.

    Rows that share id, source and text are drawn together, as copies of one of them.
    """
    key = ["_id", "_source", "_key"]
    plan = mix(docs, **options).filter("taken > 0").groupBy("doc_id", "source", "text_key").agg(F.round(F.sum(F.col("taken") / F.col("size"))).cast("int").alias("_times"))
    plan = plan.filter("_times > 0").toDF("_doc", "_from", "_text", "_times")
    own = docs.select(F.struct(F.col("*")).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.xxhash64("text").alias("_key")).dropDuplicates(key)
    both = own.join(plan, F.col("_id").eqNullSafe(F.col("_doc")) & F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_key") == F.col("_text")))
    return both.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")


def oracle(weights: Sequence[int] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> str:
    """DuckDB SQL for op1 that raises the level step by step and ranks every quotient."""
    steps = 40
    return f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT *, [{", ".join(map(str, weights))}][rank % {len(weights)} + 1]::DOUBLE AS weight, {cap} * source_size::DOUBLE AS most
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source)),
fill AS (
  SELECT 0 AS step, rank, most, weight, false AS capped FROM s
  UNION ALL
  SELECT step + 1, rank, most, weight, capped OR most < weight * (total - coalesce(sum(most) FILTER (capped) OVER (), 0)) / (sum(weight) FILTER (NOT capped) OVER ())
  FROM fill, (SELECT sum(source_size)::DOUBLE AS total FROM s) WHERE step < {steps}),
t AS (
  SELECT rank, CASE WHEN capped THEN most ELSE least(most, weight * ((total - coalesce(sum(most) FILTER (capped) OVER (), 0)) / (sum(weight) FILTER (NOT capped) OVER ()))) END AS target
  FROM fill, (SELECT sum(source_size)::DOUBLE AS total FROM s) WHERE step = {steps}),
src AS (SELECT s.*, target, greatest(1, ceil(source_size / {float(shard_words)})) AS n_shards FROM s JOIN t USING (rank)),
seats AS (SELECT CAST(round(sum(source_size) / {float(block_words)}) AS BIGINT) AS n FROM s),
won AS (
  SELECT rank, count(*) AS blocks FROM (
    SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS r
    FROM (SELECT rank, target, unnest(range(CAST(target / {block_words} AS BIGINT) + 50)) AS k FROM src WHERE target > 0)) q, seats
  WHERE r <= n GROUP BY rank),
p AS (
  SELECT d.doc_id, d.size, src.rank, src.source_size, src.target, md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS o, n_shards, coalesce(blocks, 0) AS blocks
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source LEFT JOIN won ON won.rank = src.rank),
p2 AS (SELECT *, CAST(('0x' || substr(o, 1, 8))::BIGINT % n_shards AS BIGINT) AS shard FROM p),
sh AS (SELECT rank, shard, blocks, CAST(sum(size) AS BIGINT) AS shard_size, CASE WHEN source_size > 0 THEN target * (sum(size) / source_size) ELSE 0 END AS votes
       FROM p2 GROUP BY rank, shard, blocks, target, source_size),
quota AS (
  SELECT rank, shard, count(*) AS quota FROM (
    SELECT rank, shard, blocks, row_number() OVER (PARTITION BY rank ORDER BY votes / (2 * k + 1) DESC, shard, k) AS r
    FROM (SELECT *, unnest(range(CAST(votes / {block_words} AS BIGINT) + 50)) AS k FROM sh WHERE votes > 0)) q
  WHERE r <= blocks GROUP BY rank, shard),
w AS (SELECT rank, shard, shard_size, least(coalesce(quota, 0) * {block_words}, shard_size * {cap}) AS words FROM sh LEFT JOIN quota USING (rank, shard)),
plan AS (
  SELECT *, words // greatest(shard_size, 1) AS turns, words % greatest(shard_size, 1) AS rest,
         ('0x' || substr(md5('{seed}:' || rank || ':' || shard), 1, 12))::BIGINT % CAST(ceil(greatest(shard_size, 1) / {float(block_words)}) AS BIGINT) * {block_words} AS first FROM w),
laid AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM p2)
SELECT doc_id, size, laid.source_size, target,
       CAST(turns * size + greatest(least(a + size, first + rest) - greatest(a, first), 0)
            + greatest(least(a + size, first - shard_size + rest) - greatest(a, first - shard_size), 0) AS BIGINT) AS taken
FROM laid JOIN plan USING (rank, shard)"""
