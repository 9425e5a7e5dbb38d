"""Review plans: which operators run over a corpus, as one lazy plan for each sink."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators import context, findings, graph, impact, resolve, rules
from reviewlake.operators.tables import written
from reviewlake.sources import corpus, parsers
from reviewlake.sources.config import Config

#: CI files, beside the workflows folder and shell scripts at the root, and manifests.
CI_FILES = r"^(?:\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.ya?ml|Makefile|GNUmakefile|makefile|[^/]+\.sh)$"
MANIFESTS = ("rust-toolchain.toml", "rust-toolchain", "Cargo.toml", "package.json", "pyproject.toml", "requirements.txt", "requirements-dev.txt", "setup.cfg", "setup.py", "go.mod", "tools.go", "Pipfile")


@dataclass
class Review:
    findings: DataFrame
    suppressed: DataFrame
    summary: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


def line_findings(files: DataFrame, config: Config) -> DataFrame:
    """Findings of line and context rules over files (path, content)."""
    named = corpus.discover(corpus.named(files), ignore=config.ignore_paths)
    lines = corpus.lines_of(named)
    found = rules.run_all(lines, config.modules, config.rules).unionByName(context.run_files(lines, config.modules, config.duplication_min_lines))
    if "toolchain" in config.modules:
        callers = corpus.lines_of(corpus.named(files).filter(F.col("path").rlike(CI_FILES)))
        found = found.unionByName(context.toolchain(callers, corpus.named(files).filter(F.col("file_name").isin(*MANIFESTS))))
    return found


def build_graph(files: DataFrame, snapshot: str = "current", cross_file: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and parse findings of files (path, content)."""
    parsed = written(parsers.parse(parsers.numbered(files)), "parsed")
    nodes, edges, calls = parsers.graph_of(parsed, snapshot)
    if cross_file:
        found = resolve.resolve(nodes, edges, calls)
        meta = F.struct("call_line", F.when(F.col("kind") == "Calls", True).alias("is_direct"), F.lit(None).cast("string").alias("alias"), "is_wildcard", F.lit(None).cast("int").alias("param_index"))
        more = found.select(F.lit(snapshot).alias("snapshot"), "from_id", "to_id", F.lit(1 << 20).alias("edge_idx"), "kind", meta.cast(edges.schema["metadata"].dataType).alias("metadata"))
        edges = edges.unionByName(more)
    return nodes, edges, parsers.parse_findings(parsed)


def cycle_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    cycles = graph.import_cycles(nodes, edges).withColumn("first", F.col("cycle")[0])
    steps = cycles.select("cycle", "first", F.posexplode("cycle").alias("pos", "id")).join(nodes.select("id", "file_path"), "id")
    name = F.element_at(F.split("file_path", "/"), -1)
    told = steps.groupBy("cycle", "first").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("n"), "file_path"))).alias("s"))
    names = F.transform("s", lambda x: x["n"])
    message = F.concat(F.lit("Circular import detected: "), F.array_join(F.concat(names, F.array(names[0])), " → "))
    return told.select(*rules.finding("CYCLE", F.lit("warning"), message, F.col("s")[0]["file_path"], F.lit(0), F.lit("Break the cycle by extracting shared code to a separate module")))


def graph_findings(nodes: DataFrame, edges: DataFrame, files: DataFrame, config: Config) -> DataFrame | None:
    parts = []
    if "cycles" in config.modules:
        parts.append(cycle_findings(nodes, edges))
    if "dead_code" in config.modules:
        parts.append(impact.unused_exports(nodes, edges))
    if "complexity" in config.modules:
        parts.append(context.complexity(nodes, corpus.lines_of(files), config.complexity_threshold))
    if "dead_imports" in config.modules:
        parts.append(context.dead_imports(nodes, files))
    if "test_coverage" in config.modules:
        parts.append(context.coverage_gaps(nodes, edges, files))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def finish(found: DataFrame, files: DataFrame, config: Config, baseline: DataFrame | None = None, changed: DataFrame | None = None) -> Review:
    """Numbers findings, then drops those outside a diff and splits off suppressed ones: inline, by path, by baseline."""
    numbered = findings.number(found, config.ignore_findings)
    if changed is not None:
        numbered = findings.keep_changed(numbered, changed)
    kept, gone = findings.suppress_inline(numbered, corpus.lines_of(files))
    kept, more = findings.suppress_paths(kept, config.per_path)
    gone = gone.unionByName(more)
    if baseline is not None:
        kept, more = findings.suppress_baseline(kept, baseline)
        gone = gone.unionByName(more)
    total = findings.gate(findings.summary(kept, corpus.named(files), gone), config.fail_on, config.max_counts)
    return Review(kept, gone, total)


def review(files: DataFrame, config: Config | None = None, old: tuple[DataFrame, DataFrame] | None = None, baseline: DataFrame | None = None) -> Review:
    """The whole review of files (path, content), with the impact of changes against an old graph."""
    config = config or Config()
    nodes, edges, found = build_graph(files)
    if old is not None:
        report = impact.analyze(old[0], nodes, edges)
        found = found.unionByName(impact.impact_findings(report, nodes, edges).drop("callers"))
    found = found.unionByName(line_findings(files, config))
    if (more := graph_findings(nodes, edges, files, config)) is not None:
        found = found.unionByName(more)
    out = finish(found, files, config, baseline)
    out.nodes, out.edges = nodes, edges
    return out


def diff(files: DataFrame, changed: DataFrame, config: Config | None = None) -> Review:
    """Line findings on changed lines."""
    config = config or Config()
    return finish(line_findings(files, config), files, config, changed=changed)


def baseline(files: DataFrame, config: Config | None = None) -> DataFrame:
    """Entries for all line findings as they are now."""
    return findings.baseline_of(line_findings(files, config or Config()))


def analyze_repository(spark: SparkSession, root: str, config: Config | None = None) -> Review:
    """Line findings of a folder, without graph rules and suppression."""
    config = config or Config()
    files = corpus.read_tree(spark, root)
    found = findings.number(line_findings(files, config), config.ignore_findings)
    return Review(found, found.limit(0), findings.summary(found, corpus.named(files)))


def analyze_files(files: DataFrame, paths: list[str], config: Config | None = None) -> DataFrame:
    config = config or Config()
    return findings.number(line_findings(files.filter(F.col("path").isin(paths)), config), config.ignore_findings)


def analyze_graph(files: DataFrame) -> DataFrame:
    """nodes, files, edges, errors: one row."""
    nodes, edges, errors = build_graph(files)
    return graph.counts(nodes, edges).join(errors.agg(F.count(F.lit(1)).alias("errors")))


def incremental(files: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed files with the cache's fragments (path, content_hash and a parse row): (all, fresh to be cached)."""
    named = corpus.named(parsers.numbered(files))
    cached, todo = corpus.cached_fragments(named, fragments)
    fresh = parsers.parse(todo).join(todo.select("path", "content_hash"), "path")
    return cached.unionByName(fresh), fresh
