"""Sinks: findings as JSON, SARIF, annotations, terminal text, HTML and comments."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions import text as T

MARK = "lint-comment"


def json_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def write_json(findings: DataFrame, summary: DataFrame, path: str, blast_radius: DataFrame | None = None) -> None:
    """One document with blast_radius (if given), findings and summary, streamed row by row."""
    brief = findings.select(F.to_json(F.struct("id", "severity", "message", "file", "line")).alias("value"))
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        if blast_radius is not None:
            out.write('"blast_radius":' + json.dumps(blast_radius.first().asDict()) + ",")
        out.write('"findings":[')
        for k, row in enumerate(brief.toLocalIterator()):
            out.write("," * (k > 0) + row["value"])
        out.write('],"summary":' + json.dumps(summary.select("errors", "warnings", "info").first().asDict()) + "}")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """prefix, rule_index from 0: the distinct prefixes in order."""
    return findings.select("prefix").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("prefix")) - 1)


def sarif_results(findings: DataFrame, root: str = "") -> DataFrame:
    """One JSON result a finding with a file; lines start at 1."""
    rules = F.broadcast(sarif_rules(findings))
    uri = T.relative(F.col("file"), root) if root else F.col("file")
    place = F.struct(F.struct(F.struct(uri.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    row = F.struct(F.col("prefix").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), T.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.filter("file <> ''").join(rules, "prefix").select(F.to_json(row).alias("value"))


def write_sarif(findings: DataFrame, path: str, tool: str = "reviewlake", version: str = "0.1.0", root: str = "") -> None:
    """A SARIF 2.1.0 log, streamed row by row."""
    rules = [{"id": r["prefix"]} for r in sarif_rules(findings).orderBy("rule_index").collect()]  # one a rule family
    with open(path, "w", encoding="utf-8") as out:
        head = json.dumps({"name": tool, "version": version, "rules": rules})
        out.write('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":' + head + '},"results":[')
        for k, row in enumerate(sarif_results(findings, root).toLocalIterator()):
            out.write("," * (k > 0) + row["value"])
        out.write("]}]}")


def annotations(findings: DataFrame) -> DataFrame:
    level = F.when(F.col("severity") == "info", "notice").otherwise(F.col("severity"))
    return findings.select(F.format_string("::%s file=%s,line=%d,title=%s::%s", level, F.col("file"), F.col("line"), F.col("id"), F.col("message")).alias("value"))


def new_comments(findings: DataFrame, posted: DataFrame) -> DataFrame:
    """Findings with a place that have no comment yet (posted: id); sending them is the caller's."""
    body = F.concat(F.lit(f"<!-- {MARK}:"), "id", F.lit(" -->\n**"), "id", F.lit("** "), "message")
    return findings.filter("line > 0 AND file <> ''").join(posted.select("id"), "id", "left_anti").select("file", "line", "id", body.alias("body"))


def terminal(findings: DataFrame) -> Iterator[str]:
    for row in findings.toLocalIterator():
        yield f"{row['severity']:>7} {row['id']} {row['file']}:{row['line']} {row['message']}"


def html_report(tables: dict[str, DataFrame]) -> str:
    """A page of the report's tables, which are top-k lists."""
    parts = ["<!DOCTYPE html><meta charset='utf-8'><title>Review report</title>"]
    for name, df in tables.items():
        shown = df.select(*(T.html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns))
        rows = "".join("<tr>" + "".join(f"<td>{v}</td>" for v in row) + "</tr>" for row in shown.toLocalIterator())
        parts.append(f"<h2>{name}</h2><table><tr>{''.join(f'<th>{c}</th>' for c in df.columns)}</tr>{rows}</table>")
    return "\n".join(parts)
