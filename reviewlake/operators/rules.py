"""Line rules: each catalogue is one CASE over literal patterns, evaluated in one scan of the lines.

lines has the columns path, file_name, ext, line_no and line. A finding has the columns of FINDING.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.operators import rule_catalog as C

FINDING = ("prefix", "severity", "message", "file", "line", "affected_dependents", "suggestion", "fix")
FIX = "struct<kind:string,find:string,replace:string>"


def finding(prefix: Column | str, severity: Column, message: Column, file: Column, line: Column, suggestion: Column | None = None, fix: Column | None = None, affected: Column | None = None) -> list[Column]:
    return [
        (F.lit(prefix) if isinstance(prefix, str) else prefix).alias("prefix"), severity.alias("severity"), message.alias("message"), file.alias("file"), line.cast("int").alias("line"),
        (F.lit(0) if affected is None else affected).cast("int").alias("affected_dependents"),
        (F.lit(None) if suggestion is None else suggestion).cast("string").alias("suggestion"),
        (F.lit(None) if fix is None else fix).cast(FIX).alias("fix"),
    ]


def suggestion_fix() -> Column:
    return F.struct(F.lit("suggestion").alias("kind"), F.lit(None).cast("string").alias("find"), F.lit(None).cast("string").alias("replace"))


def applies(rule: C.Rule) -> Column:
    """Whether the rule reads the line's file at all; extension gates come first, so that others cost nothing."""
    if not rule.exts and not rule.files:
        return F.lit(True)
    gate = F.lit(False)
    if rule.exts:
        gate = gate | F.coalesce(F.lower("ext").isin(rule.exts.split()), F.lit(False))
    if rule.files:
        gate = gate | F.col("file_name").isin(rule.files.split())
    return gate


def matches(rule: C.Rule) -> Column:
    hit = applies(rule) & F.col("line").rlike(C.pattern_of(rule))
    if rule.reject is not None:
        hit = hit & ~F.col("line").contains(rule.reject)
    if rule.require is not None:
        hit = hit & F.col("line").contains(rule.require)
    if rule.product_only:
        hit = hit & ~T.is_test_file_error(F.col("path")) & ~F.col("in_test_scope")
    return hit


def first_match(rules: Iterable[C.Rule]) -> Column:
    """Index of the first rule that matches the line; -1 where a safe pattern ends the search; null for none."""
    chosen = None
    for k, rule in enumerate(rules):
        hit = matches(rule)
        if rule.safe is not None:
            safe = hit & F.col("line").rlike(rule.safe)
            chosen = F.when(safe, -1) if chosen is None else chosen.when(safe, -1)
        chosen = F.when(hit, k) if chosen is None else chosen.when(hit, k)
    return chosen


def scanned(catalogue: C.Catalogue) -> Column:
    """Whether the catalogue reads the line."""
    if catalogue.exts or catalogue.files:
        keep = F.coalesce(F.col("ext").isin(catalogue.exts.split()), F.lit(False))
        if catalogue.files:
            keep = keep | F.col("file_name").isin(catalogue.files.split())
    else:
        keep = ~F.coalesce(F.lower("ext").isin(C.BINARY.split()), F.lit(False))
        if catalogue.prefix == "SQL":
            keep = keep & ~F.col("file_name").rlike(r"\.min\.(?:js|css)$")
    if catalogue.comments:
        comment = T.starts_with_any(F.col("line"), catalogue.comments)
        if catalogue.prefix == "ERR":  # attributes of Rust are no comments
            comment = comment & ~T.starts_with_any(F.col("line"), ("#[",))
        keep = keep & ~comment
    return keep


def rule_frame(lines: DataFrame, catalogues: Iterable[C.Catalogue]) -> DataFrame:
    """The catalogues as rows (prefix, rule, severity, message, suggestion, fix); a fixed number of rows."""
    rows = [
        (c.prefix, k, r.severity, c.message + r.name, r.suggestion, ("replace_pattern", *r.fix) if r.fix else ("suggestion", None, None))
        for c in catalogues for k, r in enumerate(c.rules)
    ]
    return lines.sparkSession.createDataFrame(rows, f"prefix string, rule int, severity string, message string, suggestion string, fix {FIX}")


def run_catalogues(lines: DataFrame, catalogues: Iterable[C.Catalogue]) -> DataFrame:
    """Findings of catalogues in one scan: each line's first match by catalogue, exploded where there is any."""
    catalogues = list(catalogues)
    if any(r.product_only for c in catalogues for r in c.rules) and "in_test_scope" not in lines.columns:
        lines = with_test_scope(lines)
    each = [F.when(scanned(c), F.struct(F.lit(c.prefix).alias("prefix"), first_match(c.rules).alias("rule"))) for c in catalogues]
    hits = lines.select("path", "line_no", F.explode(F.filter(F.array(*each), lambda x: x["rule"] >= 0)).alias("x")).select("path", "line_no", "x.prefix", "x.rule")
    found = hits.join(F.broadcast(rule_frame(lines, catalogues)), ["prefix", "rule"])
    return found.select(*finding(F.col("prefix"), F.col("severity"), F.col("message"), F.col("path"), F.col("line_no"), F.col("suggestion"), F.col("fix")))


def run_catalogue(lines: DataFrame, catalogue: C.Catalogue) -> DataFrame:
    return run_catalogues(lines, [catalogue])


def magic_numbers(lines: DataFrame) -> DataFrame:
    """Numeric literals that should have names; equal neighbours are told once."""
    ok = F.col("ext").isNotNull() & ~F.lower("ext").isin(C.MAGIC_SKIPPED.split()) & ~F.col("line").rlike(C.NUMBER_SKIP)
    found = F.filter(F.regexp_extract_all("line", F.lit(C.NUMBER), 1), lambda n: ~n.isin(*C.ALLOWED_NUMBERS))
    numbers = lines.filter(ok).select("path", "line_no", found.alias("n")).filter(F.size("n") > 0)
    once = F.filter("n", lambda x, k: (k == 0) | (x != F.col("n")[k - 1]))
    told = F.concat(F.lit("Magic number(s): "), F.array_join(once, ", "), F.lit(" — consider extracting to a named constant"))
    return numbers.select(*finding("MAGIC", F.lit("info"), told, F.col("path"), F.col("line_no"), F.lit(C.NUMBER_HINT), suggestion_fix()))


@dataclass(frozen=True)
class CustomRule:
    """A rule from configuration. paths are globs on the file's name; fix replaces the first match."""

    pattern: str
    message: str
    id: str = ""
    severity: str = "warning"
    paths: tuple[str, ...] = ()
    suggestion: str | None = None
    reject_if_contains: str | None = None
    fix_find: str | None = None
    fix_replace: str | None = None


def custom_rules(lines: DataFrame, rules: Iterable[CustomRule]) -> DataFrame:
    """Findings of user rules, first match first. Rules whose pattern does not compile are left out."""
    import re

    good = []
    for rule in rules:
        try:
            re.compile(rule.pattern)
            good.append(rule)
        except re.error:
            continue
    chosen = None
    for k, rule in enumerate(good):
        hit = F.col("line").rlike(rule.pattern)
        if rule.paths:
            named = F.lit(False)
            for glob in rule.paths:
                named = named | F.col("file_name").rlike(T.glob_regex(glob))
            hit = named & hit
        if rule.reject_if_contains:
            hit = hit & ~F.col("line").contains(rule.reject_if_contains)
        chosen = F.when(hit, k) if chosen is None else chosen.when(hit, k)
    rows = [
        (k, r.severity if r.severity in T.SEVERITIES else "warning", r.message, r.suggestion, ("replace_pattern", r.fix_find, r.fix_replace) if r.fix_find else ("suggestion", None, None) if r.suggestion else None)
        for k, r in enumerate(good)
    ]
    table = lines.sparkSession.createDataFrame(rows, f"rule int, severity string, message string, suggestion string, fix {FIX}")
    hits = lines.select("path", "line_no", (F.lit(None).cast("int") if chosen is None else chosen).alias("rule")).filter("rule >= 0")
    return hits.join(F.broadcast(table), "rule").select(*finding("CUSTOM", F.col("severity"), F.col("message"), F.col("path"), F.col("line_no"), F.col("suggestion"), F.col("fix")))


def with_test_scope(lines: DataFrame) -> DataFrame:
    """lines with in_test_scope: inside the braces that follow a test attribute of Rust.

    Scopes are a fold over a file's lines in order; only files of Rust are gathered, each one by itself.
    """
    tested = F.trim("line").rlike(r"^(?:#\[test\]$|#\[cfg\(test\)\]|#\[tokio::test\]|#\[async_std::test\])")
    rust = lines.filter("ext = 'rs'").select(
        "path", "line_no", (T.starts_with_any(F.col("line"), ("//", "*", "/*", "#")) & ~T.starts_with_any(F.col("line"), ("#[",))).alias("comment"), tested.alias("mark"),
        F.regexp_count("line", F.lit(r"\{")).alias("o"), F.regexp_count("line", F.lit(r"\}")).alias("c"),
    )
    ordered = rust.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "comment", "mark", "o", "c"))).alias("rows"))

    def step(a: Column, x: Column) -> Column:
        pending, inside = a["pending"] | x["mark"], a["depth"] > 0
        enters = pending & ~inside & (x["o"] > 0)
        depth = F.when(enters, x["o"] - x["c"]).when(inside, F.greatest(a["depth"] + x["o"] - x["c"], F.lit(0))).otherwise(0)
        scoped = enters | (inside & (depth > 0))
        moved = F.struct((pending & ~enters).alias("pending"), depth.alias("depth"), F.concat(a["out"], F.array(F.struct(x["line_no"].alias("line_no"), scoped.alias("s")))).alias("out"))
        held = F.struct(a["pending"].alias("pending"), a["depth"].alias("depth"), a["out"].alias("out"))
        return F.when(x["comment"], held).otherwise(moved)

    start = F.struct(F.lit(False).alias("pending"), F.lit(0).alias("depth"), F.array().cast("array<struct<line_no:int,s:boolean>>").alias("out"))
    scopes = ordered.select("path", F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("x")).filter("x.s").select("path", F.col("x.line_no").alias("line_no"), F.lit(True).alias("_s"))
    return lines.join(scopes, ["path", "line_no"], "left").withColumn("in_test_scope", F.coalesce("_s", F.lit(False))).drop("_s")


def run_all(lines: DataFrame, modules: Iterable[str] | None = None, custom: Iterable[CustomRule] = ()) -> DataFrame:
    """Findings of all enabled catalogues, as one union over shared lines. modules: names; None for all."""
    wanted = None if modules is None else set(modules)
    chosen = [c for c in C.CATALOGUES if wanted is None or c.module in wanted]
    parts = [run_catalogues(lines, chosen)] if chosen else []
    if wanted is None or "magic_numbers" in wanted:
        parts.append(magic_numbers(lines))
    if custom := list(custom):
        parts.append(custom_rules(lines, custom))
    out = parts[0] if parts else magic_numbers(lines).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
