"""Benchmark decontamination by a prefix-filtered set join, verified exactly over item-sized windows.

Words are runs of letters, digits and non-ASCII characters, with A-Z in lower case. A window is 13
consecutive words of an item, or a shorter item whole. A window's set is its shingles (5 words, or the
window itself if shorter). A document contains a window only if it has all of the shingles, in place.

1. One pass over the documents hashes their shingles and keeps those that the benchmark has (a join with
   the benchmark's distinct shingles, broadcast only below a checked number of rows).
2. Shingles are ordered by rarity, the number of places in the documents. Full containment makes the needed
   prefix one shingle long: the rarest one. A window with a shingle that no document has drops out.
3. Postings of such prefix shingles give candidates, with length and positional bounds: the window must
   fit between the document's first and last word.
4. A candidate is verified over the whole window: the run of consecutive postings that holds it must have
   the window's shingles, all of them in order (64-bit hashes of five words each).
5. Hit words are the union of verified windows.

All of it is DataFrame operations; the text is read in one scan for shingles and one for word counts, and
is never shuffled.

Edge cases: null or empty text has no words and is not contaminated; items without words give no
windows; a null item id counts as the empty id; repeated documents and items count as one; with an empty
benchmark or no documents the result is whole and has no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm._shared import stored

WINDOW = 13
SHINGLE = 5
SHARE = 20
#: The most benchmark shingles that are broadcast (8 bytes each); above it Spark plans the join by size.
MOST_BROADCAST = 2_000_000
#: Stands for a null doc_id in keys, which joins would drop.
NO_ID = -(1 << 63)
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The same before lower-casing, when A-Z are letters.
RAW_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words_of(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, f"[{SEPARATORS}]++"), "")


def word_count(text: Column) -> Column:
    """As size(words_of(text)), without making the words; 0 for null."""
    led = F.regexp_replace(text, f"^[{RAW_SEPARATORS}]++", "")
    return F.coalesce(F.length(F.regexp_replace(led, f"[^{RAW_SEPARATORS}]++[{RAW_SEPARATORS}]*+", "w")), F.lit(0)).cast("long")


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of the consecutive shingles of so many words; an empty array if there are fewer words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item, win (its words, which names it), length, size (of its shingles), shingles."""
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = listed.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).alias("w")).distinct()
    hashed = F.coalesce(*(F.when(F.size("w") >= k if k == shingle else F.size("w") == k, shingle_hashes(F.col("w"), k)) for k in range(shingle, 0, -1)))
    return cut.select("item", F.array_join("w", " ").alias("win"), F.size("w").alias("length"), F.least(F.size("w"), F.lit(shingle)).alias("size"), hashed.alias("shingles"))


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Verified occurrences: doc_id (NO_ID for null), text_hash, start (word, from 0), length, win, once for each."""
    windows = stored(item_windows(items, window, shingle).dropDuplicates(["win"]).drop("item"), "decon-windows")
    wanted = windows.select("size", F.explode("shingles").alias("sh")).distinct()
    per_size = {r["size"]: r["n"] for r in wanted.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `shingle` rows
    split = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    found = None
    for size, n in sorted(per_size.items()):
        every = split.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.posexplode(shingle_hashes(F.col("w"), size)).alias("pos", "sh"))
        mine = wanted.filter(F.col("size") == size).select("sh")
        one = every.join(F.broadcast(mine) if n <= MOST_BROADCAST else mine, "sh").select("doc_id", "text_hash", "n_words", "pos", "sh", F.lit(size).alias("size"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return split.filter(F.lit(False)).select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("win"))
    postings = stored(found, "decon-postings")
    rarity = postings.groupBy("size", "sh").agg(F.count(F.lit(1)).alias("places"))
    ranked = windows.select("win", "size", F.posexplode("shingles").alias("at", "sh")).join(rarity, ["size", "sh"], "left")
    prefix = ranked.groupBy("win").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "sh", "at")).alias("p")).filter("p.places > 0")
    needed = windows.join(prefix.select("win", F.col("p.sh").alias("sh"), F.col("p.at").alias("at")), "win")
    # Consecutive postings of a document are a run; a window that occurs lies within one.
    doc = Window.partitionBy("doc_id", "text_hash", "size").orderBy("pos")
    runs = postings.withColumn("run", F.col("pos") - F.dense_rank().over(doc))
    key = ["doc_id", "text_hash", "size", "run"]
    candidates = (
        runs.join(needed, ["size", "sh"]).withColumn("start", F.col("pos") - F.col("at"))
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .groupBy(*key).agg(F.collect_set(F.struct("start", "length", "win", "shingles")).alias("maybe"))
    )
    held = runs.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("pos", "sh"))).alias("r"))
    first, hashes = F.col("r")[0]["pos"], F.transform("r", lambda x: x["sh"])
    verified = F.filter("maybe", lambda m: (m["start"] >= first) & (F.slice(hashes, m["start"] - first + 1, F.size(m["shingles"])) == m["shingles"]))
    return candidates.join(held, key).select("doc_id", "text_hash", F.explode(verified).alias("m")).select("doc_id", "text_hash", "m.start", "m.length", "m.win")


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words) for each row."""
    hits = stored(find(docs, items, window), "decon-hits")
    key = ["doc_id", "text_hash"]
    union = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
        lambda a: a["n"],
    )
    covered = hits.groupBy(*key).agg(union.cast("long").alias("n_hit"))
    named = hits.select(*key, "win").distinct().join(item_windows(items, window).select("win", "item"), "win").groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = covered.join(named, key).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "n_hit", "items")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("n_words"))
    joined = base.join(both, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_id")) & (F.col("text_hash") == F.col("_h")), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        *key, "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad = judge(docs, items).filter("contaminated").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own = docs.select(F.struct(F.col("*")).alias("_row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_hash"))
    return own.join(bad, ["_id", "_hash"], "left_anti").select("_row.*")


def oracle(window: int = WINDOW, share: int = SHARE) -> str:
    """DuckDB SQL for op3 that compares every window of every document as text."""
    split = f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^{SEPARATORS}]+')"
    return f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, array_to_string(w[k + 1 : k + least(len(w), {window})], ' ') AS win, least(len(w), {window}) AS length
       FROM (SELECT item, w, unnest(range(greatest(len(w) - {window}, 0) + 1)) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({split}, []) AS w FROM documents),
dw AS (SELECT r, k, length, array_to_string(w[k + 1 : k + length], ' ') AS win
       FROM (SELECT r, w, length, unnest(range(len(w) - length + 1)) AS k FROM d, (SELECT DISTINCT length FROM iw) WHERE len(w) >= length)),
hits AS (SELECT DISTINCT r, k, dw.length, item FROM dw JOIN iw ON dw.win = iw.win AND dw.length = iw.length),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + length)) AS p FROM hits) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)"""
