"""Quality rules: per-document base rules, then cross-document line frequency.

Base rules look at one text: too few words, or too many words in repeated 3-word windows. Line frequency
looks across a host (here the source): lines are normalised (lower case, white space as one space) and
hashed, and for each host and line the distinct documents are counted. A line found in more documents than
the limit is boilerplate and is removed, but from the first document (by id) of the host that has it, so that of a text in
many copies the first stays whole. A document with too little left is depleted and rejected. verdicts() decides
once: the query shows its figures, and the pipeline's stage takes the same lines out of the texts.

Skew: the count by host and line is pre-aggregated by task; lines above the limit are looked up by broadcast of a counted
table or by a salted join. Texts are shuffled only where the marks of rows to change are too many to send; only
texts that have lines to remove go through Python a second time.

Edge cases: null or empty text has no words, fails the base rules and is not kept; a null source is a host of
its own; rows of one id, host and text are one document and get equal results, other rows of one id are others; null
ids come last; an empty table gives an empty result; texts may be of any length; columns of any name are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reviewlake.llm._shared import MOST_BROADCAST, NULL_ID, looked_up, stored

MIN_WORDS = 50
MAX_REPEAT = 50
WINDOW = 3
#: A line is boilerplate in more documents of a host than this, whatever the size of the host.
LINE_DOCS = 20
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.25
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "lines array<struct<line:bigint,words:bigint>>"
KEY = ["doc", "tie"]
#: The most marked rows, and lines to remove in them, that are sent to all tasks.
MOST_LINES = 2_000_000


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    windows = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    upto = total = 0
    for at, seen in enumerate(windows):
        if counts[seen] > 1:
            total += at + window - max(at, upto)
            upto = at + window
    return total


def line_key(parts: list[bytes]) -> int:
    """The hash of a normalised line, from its words."""
    return int.from_bytes(blake2b(b" ".join(parts).decode().lower().encode(), digest_size=8).digest(), "big", signed=True)


def measure(text: str | None) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """The base figures, and (hash, words in all its occurrences) for each distinct normalised line."""
    if not text:
        return 0, 0, 0, 0, 0, []
    words = text.encode().split()  # of bytes, split() takes just the ASCII white space
    seen: set[str] = set()
    lines: dict[int, int] = {}
    duplicates = 0
    for line in text.split("\n"):
        parts = line.encode().split()
        if not parts:
            continue
        if line in seen:
            duplicates += 1
        seen.add(line)
        key = line_key(parts)
        lines[key] = lines.get(key, 0) + len(parts)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicates, repeated(words), list(lines.items())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "doc", "tie", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
    for batch in batches:
        found = [measure(t.as_py()) for t in batch.column("text")]
        columns = [batch.column(n) for n in names[:4]]
        columns += [pa.array([f[k] for f in found], pa.int64()) for k in range(5)]
        edges = np.cumsum([0, *(len(f[5]) for f in found)])
        flat = [pa.array([x[k] for f in found for x in f[5]], pa.int64()) for k in (0, 1)]
        columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(flat, ["line", "words"])))
        yield pa.RecordBatch.from_arrays(columns, names)


def host_of(source: Column) -> Column:
    """A key that is never null: the null source is the empty host."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def without(text: str, gone: set[int]) -> str:
    """text without the lines whose hashes are in gone; lines of white space stay."""
    return "\n".join(x for x in text.split("\n") if not (parts := x.encode().split()) or line_key(parts) not in gone)


@F.arrow_udf(StringType())
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    return pa.array([None if t.as_py() is None else without(t.as_py(), set(g.as_py())) for t, g in zip(text, gone, strict=True)], pa.string())


def _told(host: str) -> list[Column]:
    """doc, tie and host: what a document is told by. The tie is a hash of host and text."""
    own = host_of(F.col(host).cast("string"))
    return [F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.xxhash64(own, "text").alias("tie"), own.alias("host")]


def verdicts(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """doc_id, doc, tie, the base figures, removed_words, gone (hashes of the lines to remove), base_failed and kept for each row."""
    own = docs.select("doc_id", "text", *_told(host))
    stats = stored(own.mapInArrow(_measure, f"doc_id long, doc long, tie long, host string, {STATS}, {LINES}"), "quality")
    told = stats if stats.groupBy(*KEY).count().filter("count > 1").isEmpty() else stats.dropDuplicates(KEY)
    lines = told.select(*KEY, "host", F.explode("lines").alias("l")).select(*KEY, F.xxhash64("host", "l.line").alias("key"), "l.line", "l.words")
    seen = lines.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(*KEY)).alias("first"))
    frequent = stored(seen.filter(F.col("docs") > line_docs).select("key", "first"), "quality-lines")
    mine = looked_up(lines, frequent, "key", F.col("tie")).filter(F.col("first").isNotNull() & (F.col("first") != F.struct(*KEY)))
    removed = mine.groupBy(*KEY).agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("gone"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    found = stats.drop("lines", "host").join(removed, KEY, "left").fillna(0, ["removed_words"]).withColumn("base_failed", failed)
    return found.withColumn("kept", ~failed & (left > 0) & (left >= left_share * F.col("n_words")))


def judge(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """doc_id, the base figures, removed_words, base_failed and kept for each row of docs."""
    return verdicts(docs, host, line_docs, left_share).drop(*KEY, "gone")


def keep(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, the text without its boilerplate lines."""
    marks = verdicts(docs, host, line_docs, left_share).filter("NOT kept OR gone IS NOT NULL").select(*KEY, "kept", "gone")
    marks = stored(marks.dropDuplicates(KEY).select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "kept", "gone"), "quality-marks")
    rows, lines = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("gone"), F.lit(0))), F.lit(0))).first()
    few = rows <= MOST_BROADCAST and lines <= MOST_LINES
    own = docs.select(F.struct(F.col("*")).alias("_row"), *(c.alias(f"_{n}") for c, n in zip(_told(host)[:2], KEY, strict=True)))
    found = own.join(F.broadcast(marks) if few else marks, ["_doc", "_tie"], "left").filter("kept IS NULL OR kept")
    cut = found.withColumn("_cut", _without(F.when(F.col("gone").isNotNull(), F.col("_row.text")), "gone"))
    return cut.select(F.col("_row").withField("text", F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(F.col("_cut"))).alias("_row")).select("_row.*")


def oracle() -> str:
    """DuckDB SQL for op5 that compares lines and windows as text. Documents are told by their ids, which must differ."""
    words = "'[^\\x20\\x09-\\x0D]+'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {words}) AS w FROM d),
g AS (SELECT r, k, array_to_string(w[k : k + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM w WHERE len(w) >= {WINDOW})),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + {WINDOW})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, doc_id, source, line, regexp_extract_all(line, {words}) AS lw FROM (SELECT r, doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)),
lf AS (SELECT *, lower(array_to_string(lw, ' ')) AS norm FROM l WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lf GROUP BY r),
seen AS (SELECT source, norm, min(doc_id) AS first FROM lf GROUP BY source, norm HAVING count(DISTINCT r) > {LINE_DOCS}),
rem AS (SELECT r, sum(len(lw)) AS n FROM lf JOIN seen ON lf.norm = seen.norm AND lf.source IS NOT DISTINCT FROM seen.source WHERE doc_id <> first GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(rem.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN rem USING (r))
SELECT *, base_failed IS FALSE AND n_words > removed_words AND n_words - removed_words >= {LEFT_SHARE} * n_words AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM f)"""
