"""What a finding prefix means: its rules, and what the operators without line rules look for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.operators.rule_catalog import CATALOGUES

ABOUT = {
    "SEC": "hardcoded credentials", "SQL": "SQL built from strings", "CMD": "shell commands built from strings", "DESER": "unsafe deserialization", "SSRF": "requests to URLs that callers choose", "PATH": "paths that callers choose",
    "LOG": "credentials in logs", "ENDPT": "addresses in code", "MAGIC": "numbers without a name", "ML": "mistakes in training code", "INFRA": "risky infrastructure settings", "HOOKS": "misuse of component hooks", "ASYNC": "asynchronous mistakes",
    "DEP": "dependency problems", "ERR": "errors that are dropped", "CUSTOM": "rules from configuration", "CYCLE": "files that import each other", "DEAD": "symbols that nothing uses", "CMPLX": "functions that are hard to read",
    "IMP": "imports that nothing uses", "COV": "symbols that no test names", "DUP": "blocks of equal lines", "TOOL": "tools without a declared version", "BREAKING": "changes that break callers", "IMPACT": "changes that may break callers", "PARSE": "files that do not parse",
}


def explain(prefix: str) -> str | None:
    """A text about a prefix or an id that has it; None if it is unknown."""
    prefix = prefix.upper().split("-")[0]
    if prefix not in ABOUT:
        return None
    rules = [f"{k:>3} {r.severity}: {r.name}. {r.suggestion}" for c in CATALOGUES if c.prefix == prefix for k, r in enumerate(c.rules, 1)]
    return "\n".join([f"{prefix}: {ABOUT[prefix]}", *rules])


def table(spark: SparkSession) -> DataFrame:
    """prefix, about, rules."""
    sizes = {c.prefix: len(c.rules) for c in CATALOGUES}
    return spark.createDataFrame([(p, a, sizes.get(p, 0)) for p, a in ABOUT.items()], "prefix string, about string, rules int")
