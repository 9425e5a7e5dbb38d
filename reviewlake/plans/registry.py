"""Where analyzers, graph analyzers and output formats are added, and a run that times each analyzer."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from reviewlake.operators import context, impact, rule_catalog, rules
from reviewlake.operators.tables import written
from reviewlake.plans import review
from reviewlake.sources.config import Config

#: Findings of lines; findings of (nodes, edges); rows of text from findings.
LineAnalyzer = Callable[[DataFrame, Config], DataFrame]
GraphAnalyzer = Callable[[DataFrame, DataFrame], DataFrame]
Formatter = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Analyzers by name, each with the module that turns it on (None: always), and formats by name."""

    lines: dict[str, tuple[str | None, LineAnalyzer]] = field(default_factory=dict)
    graphs: dict[str, tuple[str | None, GraphAnalyzer]] = field(default_factory=dict)
    formats: dict[str, Formatter] = field(default_factory=dict)

    def add_lines(self, name: str, run: LineAnalyzer, module: str | None = None) -> None:
        self._add(self.lines, name, (module, run))

    def add_graph(self, name: str, run: GraphAnalyzer, module: str | None = None) -> None:
        self._add(self.graphs, name, (module, run))

    def add_format(self, name: str, run: Formatter) -> None:
        self._add(self.formats, name, run)

    @staticmethod
    def _add(into: dict, name: str, value: object) -> None:
        if name in into:
            raise ValueError(f"{name} is registered already")
        into[name] = value

    def run(self, spark: SparkSession, lines: DataFrame, config: Config, graph: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """(findings, timings): analyzers whose module is on, each stored once; timings are analyzer, seconds, findings."""
        chosen = [(name, lambda f=f: f(lines, config)) for name, (module, f) in self.lines.items() if module is None or module in config.modules]
        if graph is not None:
            chosen += [(name, lambda f=f: f(*graph)) for name, (module, f) in self.graphs.items() if module is None or module in config.modules]
        found, told = None, []
        for name, make in chosen:
            start = time.monotonic()
            part = written(make(), "analyzer")
            told.append((name, time.monotonic() - start, part.count()))
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = rules.magic_numbers(lines).limit(0)
        return found, spark.createDataFrame(told, "analyzer string, seconds double, findings long")

    def write(self, name: str, findings: DataFrame) -> DataFrame:
        if name not in self.formats:
            raise ValueError(f"no format {name}; there are {', '.join(sorted(self.formats))}")
        return self.formats[name](findings)


def standard() -> Registry:
    """The engine's own analyzers, one for each module of the catalogues, to which others may be added."""
    out = Registry()
    for module in sorted({c.module for c in rule_catalog.CATALOGUES}):
        own = [c for c in rule_catalog.CATALOGUES if c.module == module]
        out.add_lines(module, lambda lines, config, own=own: rules.run_catalogues(lines, own), module)
    out.add_lines("magic_numbers", lambda lines, config: rules.magic_numbers(lines), "magic_numbers")
    out.add_lines("duplication", lambda lines, config: context.run_files(lines, {"duplication"}, config.duplication_min_lines), "duplication")
    out.add_graph("cycles", review.cycle_findings, "cycles")
    out.add_graph("dead_code", impact.unused_exports, "dead_code")
    out.add_format("rows", lambda findings: findings)
    return out
