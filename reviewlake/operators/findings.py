"""The findings pipeline: numbering, suppression, baseline, diff filter, gates, summaries and fixes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.operators.tables import written

#: The comment that suppresses findings on its line and the next: lint-ignore PREFIX...
MARKER = "lint-ignore"
ORDER = ("file", "line", "severity", "message")


def number(findings: DataFrame, ignore: Iterable[str] = (), order: tuple[str, ...] = ORDER) -> DataFrame:
    """findings with ids PREFIX-001 in order within each prefix, then without ignored ids (gaps stay).

    The running number is made in two phases: rows are ranged by prefix and order, numbered within their
    partition, and moved by the totals of the partitions before, so a prefix may hold any share of all rows.
    """
    stored = written(findings, "found")  # ranging samples its input, which is not to be computed twice
    ranged = stored.repartitionByRange("prefix", *order).sortWithinPartitions("prefix", *order).withColumn("_place", F.monotonically_increasing_id())
    ranged = written(ranged, "numbered").withColumn("_part", F.shiftright("_place", 33))
    parts = ranged.groupBy("prefix", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("prefix").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = ranged.join(F.broadcast(parts.select("prefix", "_part", "_first", before.alias("_before"))), ["prefix", "_part"])
    told = F.concat_ws("-", "prefix", F.lpad((F.col("_place") - F.col("_first") + F.col("_before") + 1).cast("string"), 3, "0"))
    wide = F.col("_place") - F.col("_first") + F.col("_before") + 1
    told = F.when(wide < 1000, told).otherwise(F.concat_ws("-", "prefix", wide.cast("string")))
    out = moved.withColumn("id", told).select("id", *findings.columns)
    ignore = list(ignore)
    return out.filter(~F.col("id").isin(ignore)) if ignore else out


def fingerprint(findings: DataFrame) -> DataFrame:
    """findings with a key that does not change with their number or line."""
    return findings.withColumn("fingerprint", F.sha2(F.concat_ws("\x1f", "prefix", "file", "message"), 256))


def suppressions(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """path, line_no, prefixes of suppressing comments."""
    text = F.regexp_extract("line", rf"{marker}\s+([\w\-\*]+(?:\s+[\w\-\*]+)*)", 1)
    return lines.select("path", "line_no", text.alias("t")).filter("t <> ''").select("path", "line_no", F.split("t", r"\s+").alias("prefixes"))


def _split(findings: DataFrame, hit: DataFrame, keys: list[str], reason: Column) -> tuple[DataFrame, DataFrame]:
    return findings.join(hit, keys, "left_anti").select(*findings.columns), findings.join(hit, keys, "left_semi").select(*findings.columns).withColumn("suppression_reason", reason)


def suppress_inline(findings: DataFrame, lines: DataFrame, marker: str = MARKER) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): a comment covers its own line and the next, for the prefixes it names or all for *."""
    told = suppressions(lines, marker).select(F.col("path").alias("file"), "line_no", F.explode("prefixes").alias("p"))
    told = told.select("file", F.explode(F.array("line_no", F.col("line_no") + 1)).alias("line"), "p")
    told = told.distinct()
    told = told.groupBy("file", "line").agg(F.collect_set("p").alias("_told"))  # the words of at most two comments
    own = findings.join(told, ["file", "line"], "left")
    hit = F.coalesce(F.array_contains("_told", "*") | F.array_contains("_told", F.col("prefix")), F.lit(False))
    return own.filter(~hit).select(*findings.columns), own.filter(hit).select(*findings.columns).withColumn("suppression_reason", F.lit("inline"))


def suppress_paths(findings: DataFrame, rules: Mapping[str, Iterable[str]], root: str = "") -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) by globs on the relative path; of several the first in the order of their text."""
    path = T.relative(F.col("file"), root) if root else F.col("file")
    reason = F.lit(None).cast("string")
    for glob, prefixes in sorted(rules.items(), reverse=True):
        named = list(prefixes)
        hit = path.rlike(T.glob_regex(glob)) & (F.lit("*" in named) | F.col("prefix").isin(named))
        reason = F.when(hit, f"per-path rule: {glob}").otherwise(reason)
    told = findings.withColumn("suppression_reason", reason)
    return told.filter("suppression_reason IS NULL").drop("suppression_reason"), told.filter("suppression_reason IS NOT NULL")


def baseline_of(findings: DataFrame, root: str = "") -> DataFrame:
    """The baseline's entries; duplicates stay."""
    return findings.select((T.relative(F.col("file"), root) if root else F.col("file")).alias("file"), "message")


def suppress_baseline(findings: DataFrame, baseline: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): entries match on relative path and message, wherever the line is now."""
    own = findings.withColumn("_file", T.relative(F.col("file"), root) if root else F.col("file"))
    kept, gone = _split(own, baseline.select(F.col("file").alias("_file"), "message").distinct(), ["_file", "message"], F.lit("baseline"))
    return kept.drop("_file"), gone.drop("_file")


def keep_changed(findings: DataFrame, changed: DataFrame, root: str = "") -> DataFrame:
    """Findings on changed lines (path, all_new, line); files that are not in it lose theirs."""
    own = findings.withColumn("_path", T.relative(F.col("file"), root) if root else F.col("file"))
    whole = changed.filter("all_new").select(F.col("path").alias("_path")).distinct()
    some = changed.filter("NOT all_new").select(F.col("path").alias("_path"), "line").distinct()
    new = own.join(whole, "_path", "left_semi")
    old = own.join(whole, "_path", "left_anti").join(some, ["_path", "line"], "left_semi")
    return new.select(*findings.columns).unionByName(old.select(*findings.columns))


def summary(findings: DataFrame, files: DataFrame | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """errors, warnings, info, suppressed, debt_minutes and files_by_language: one row."""
    s = F.col("severity")
    total = findings.agg(F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "info").alias("info"))
    total = total.withColumn("debt_minutes", T.debt_minutes(F.col("errors"), F.col("warnings"), F.col("info")))
    if suppressed is not None:
        total = total.join(suppressed.agg(F.count(F.lit(1)).alias("suppressed")))
    if files is not None:
        by = files.groupBy(T.language(F.col("ext"), T.SUMMARY_LANGUAGES, "Other").alias("language")).agg(F.count(F.lit(1)).alias("files"))
        total = total.join(by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("files_by_language")))
    return total


def gate(total: DataFrame, fail_on: str = "error", most: Mapping[str, int] | None = None) -> DataFrame:
    """total with failed: a severity at or above fail_on is there (an unknown one counts as error), or a count is above its limit."""
    levels = {"error": ["errors"], "warning": ["errors", "warnings"], "info": ["errors", "warnings", "info"], "never": []}
    failed = F.lit(False)
    for name in levels.get(fail_on, ["errors"]):
        failed = failed | (F.col(name) > 0)
    for name, limit in (most or {}).items():
        failed = failed | (F.col(name) > limit)
    return total.withColumn("failed", failed)


def breakdown(suppressed: DataFrame) -> DataFrame:
    """Counts by reason; path rules count together."""
    reason = F.when(F.col("suppression_reason").startswith("per-path rule"), "per-path rule").otherwise(F.col("suppression_reason"))
    return suppressed.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: How a line is commented out, by extension; others use //.
COMMENTS = {"py": "# ", "rb": "# ", "sh": "# ", "yaml": "# ", "yml": "# ", "toml": "# ", "tf": "# ", "sql": "-- ", "lua": "-- "}


def apply_fixes(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """path, content: files with their fixes. A line's fixes apply in the order of ids or messages.

    comment_out turns a line to two, a note and the line as a comment; replace_pattern replaces the first match, with
    $1 for groups; suggestions change nothing. Only lines with fixes reach Python, whose patterns come from data.
    """
    order = "id" if "id" in findings.columns else "message"
    wanted = findings.filter(F.col("fix").isNotNull() & (F.col("fix.kind") != "suggestion") & (F.col("line") > 0))
    per_line = wanted.groupBy(F.col("file").alias("path"), F.col("line").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("fix.kind").alias("kind"), F.col("fix.find").alias("find"), F.col("fix.replace").alias("replace"), F.col("message").alias("message")))).alias("fixes"))

    @F.pandas_udf("string")
    def fixed(line: pd.Series, ext: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([fix_line(a, b, c) for a, b, c in zip(line, ext, fixes, strict=True)])

    touched = lines.join(per_line, ["path", "line_no"]).select("path", "line_no", fixed("line", "ext", "fixes").alias("line"))
    files = touched.select("path").distinct()
    rest = lines.join(files, "path", "left_semi").join(touched.select("path", "line_no"), ["path", "line_no"], "left_anti").select("path", "line_no", "line")
    return rest.unionByName(touched).groupBy("path").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


def fix_line(line: str, ext: str | None, fixes: Iterable) -> str:
    import re

    for fix in fixes:
        if fix["kind"] == "comment_out":
            mark, space = COMMENTS.get(ext or "", "// "), line[: len(line) - len(line.lstrip())]
            return f"{space}{mark}{fix['message']}\n{space}{mark}{line.lstrip()}"
        try:
            line = re.sub(fix["find"], lambda m, r=fix["replace"]: re.sub(r"\$(?:(\d+)|\{(\w+)\})", lambda g: m[int(g[1])] if g[1] else m[g[2]], r), line, count=1)
        except (re.error, IndexError):
            continue
    return line


def ai_candidates(findings: DataFrame) -> DataFrame:
    """Findings that a model may be asked about: errors and warnings without a suggestion."""
    return findings.filter(F.col("severity").isin("error", "warning") & F.col("suggestion").isNull())


def snippets(findings: DataFrame, lines: DataFrame, before: int = 4, after: int = 3) -> DataFrame:
    """findings with the text around their line."""
    near = findings.select("id", F.col("file").alias("path"), F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line_no"))
    text = near.join(lines.select("path", "line_no", "line"), ["path", "line_no"]).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("snippet"))
    return findings.join(text, "id", "left")


def ai_cost(chars: Column, in_price: float, out_price: float, out_tokens: int = 1000) -> Column:
    """Estimated dollars: four characters a token, prices a million tokens."""
    return F.ceil(chars / 4) * in_price / 1e6 + F.lit(out_tokens * out_price / 1e6)


def merge_notes(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """findings with ai_note and ai_false_positive from notes (id, note, false_positive)."""
    first = notes.groupBy("id").agg(F.first("note").alias("ai_note"), F.first("false_positive").alias("_fp"))
    return findings.drop("ai_note", "ai_false_positive").join(first, "id", "left").withColumn("ai_false_positive", F.coalesce("_fp", F.lit(False))).drop("_fp")
