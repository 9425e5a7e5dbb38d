"""Operators that look beyond one line: windows of lines, whole files, duplicates, complexity, imports, coverage, tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.operators import graph
from reviewlake.operators.rules import finding, suggestion_fix

#: Patterns, messages and hints of the context rules.
LOOP, FIT = r"^\s*(?:for|while)\s+.+:", r"\.fit\s*\("
NO_GRAD, EVAL = r"torch\.no_grad\s*\(\s*\)", r"\.eval\s*\(\s*\)"
RANDOM, SEED = r"(?:np\.random\.\w+|torch\.rand(?:n|int)?)\s*\(", r"(?:np\.random\.seed|torch\.manual_seed|random\.seed)\s*\("
CONTAINERS = r"^\s*containers:\s*$"
PROBES = (
    (r"readinessProbe:", "Infrastructure issue: K8s Deployment missing readinessProbe (pod receives traffic before ready)", "Add a readinessProbe to each container so the pod is only sent traffic when healthy"),
    (r"livenessProbe:", "Infrastructure issue: K8s Deployment missing livenessProbe (stuck pods won't be restarted)", "Add a livenessProbe to each container so Kubernetes can restart unhealthy pods"),
    (r"^\s*resources:", "Infrastructure issue: K8s Deployment missing resource limits/requests (noisy-neighbour risk)", "Set resources.requests and resources.limits for CPU and memory on each container"),
)
FIT_IN_LOOP = ("ML pipeline issue: model.fit() called inside a loop (repeated fitting anti-pattern)", "Move .fit() outside the loop; use partial_fit() for incremental learning or cross_val_score() for cross-validation")
NO_EVAL = ("ML pipeline issue: torch.no_grad() used without model.eval() (model may behave differently in training vs inference mode)", "Call model.eval() before inference to disable dropout and batch normalisation training behaviour")
NO_SEED = ("ML pipeline issue: random operations without seed (non-reproducible results)", "Set a random seed for reproducibility: np.random.seed(42) or torch.manual_seed(42)")
AS_ROOT = ("Infrastructure issue: Dockerfile runs as root (no non-root USER instruction)", "Add a non-root user: RUN useradd -m appuser && USER appuser")
#: Limits of the complexity rule as (warning, error).
LENGTH, PARAMETERS, NESTING = (50, 100), (5, 8), (4, 6)


def lookahead(lines: DataFrame, opens: Column, inside: Column, reach: int = 5) -> DataFrame:
    """path, line_no of the first `inside` line within the next `reach` lines of each `opens` line."""
    ahead = Window.partitionBy("path").orderBy("line_no").rowsBetween(1, reach)
    marked = lines.select("path", "line_no", opens.alias("_open"), F.when(inside, F.col("line_no")).alias("_in"))
    return marked.withColumn("_hit", F.min("_in").over(ahead)).filter("_open AND _hit IS NOT NULL").select("path", F.col("_hit").alias("line_no"))


def fit_in_loop(lines: DataFrame) -> DataFrame:
    python = lines.filter(F.col("ext").isin("py", "ipynb"))
    code = ~T.starts_with_any(F.col("line"), ("#", "//", "*"))
    hits = lookahead(python, code & F.col("line").rlike(LOOP), code & F.col("line").rlike(FIT))
    return hits.select(*finding("ML", F.lit("warning"), F.lit(FIT_IN_LOOP[0]), F.col("path"), F.col("line_no"), F.lit(FIT_IN_LOOP[1]), suggestion_fix()))


def present_without(lines: DataFrame, present: str, absent: str) -> DataFrame:
    """path, line_no of the first line that matches, of files where no line matches the other pattern."""
    seen = lines.select("path", F.when(F.col("line").rlike(present), F.col("line_no")).alias("_at"), F.col("line").rlike(absent).alias("_no"))
    return seen.groupBy("path").agg(F.min("_at").alias("line_no"), F.max("_no").alias("_no")).filter("line_no IS NOT NULL AND NOT _no").select("path", "line_no")


def ml_files(lines: DataFrame) -> DataFrame:
    python = lines.filter(F.col("ext").isin("py", "ipynb"))
    grad = present_without(python, NO_GRAD, EVAL).select(*finding("ML", F.lit("warning"), F.lit(NO_EVAL[0]), F.col("path"), F.col("line_no"), F.lit(NO_EVAL[1]), suggestion_fix()))
    seed = present_without(python, RANDOM, SEED).select(*finding("ML", F.lit("info"), F.lit(NO_SEED[0]), F.col("path"), F.col("line_no"), F.lit(NO_SEED[1]), suggestion_fix()))
    return grad.unionByName(seed)


def kubernetes(lines: DataFrame) -> DataFrame:
    """Up to three findings at a file's first containers line."""
    yaml = lines.filter(F.col("ext").isin("yaml", "yml"))
    flags = [F.max(F.col("line").rlike(p)).alias(f"_p{k}") for k, (p, _, _) in enumerate(PROBES)]
    files = yaml.groupBy("path").agg(F.min(F.when(F.col("line").rlike(CONTAINERS), F.col("line_no"))).alias("line_no"), *flags).filter("line_no IS NOT NULL")
    missing = F.array_compact(F.array(*(F.when(~F.col(f"_p{k}"), F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"))) for k, (_, m, s) in enumerate(PROBES))))
    each = files.select("path", "line_no", F.explode(missing).alias("x"))
    return each.select(*finding("INFRA", F.lit("warning"), F.col("x.m"), F.col("path"), F.col("line_no"), F.col("x.s"), suggestion_fix()))


def docker_root(lines: DataFrame) -> DataFrame:
    docker = lines.filter("file_name = 'Dockerfile'")
    base = F.lower(F.ltrim("line")).startswith("from ")
    user = F.col("line").rlike(r"(?i)^USER\s+")
    files = docker.groupBy("path").agg(
        F.coalesce(F.max(F.when(base, F.col("line_no"))), F.lit(1)).alias("line_no"), F.min(F.when(base, F.lower("line").contains("scratch"))).alias("_scratch"),
        F.max(user).alias("_user"), F.max(F.col("line").rlike(r"(?i)^USER\s+(?:root|0)\s*$")).alias("_root"),
    )
    bad = files.filter("NOT coalesce(_scratch, true) AND (NOT _user OR _root)")
    return bad.select(*finding("INFRA", F.lit("warning"), F.lit(AS_ROOT[0]), F.col("path"), F.col("line_no"), F.lit(AS_ROOT[1]), suggestion_fix()))


def normalized(line: Column) -> Column:
    """A line for duplicate detection: '' for blank, comment and bracket lines; comments off, strings and numbers by name."""
    t = F.btrim(line, F.lit(" \t\r\f"))
    strings = r"""\"[^\"\\]*+(?:\\.[^\"\\]*+)*+(?:\"|$)|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|$)"""
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, strings, "__STR__"), r"\s*//.*$", ""), r"(?<![A-Za-z0-9_À-￿])\d[\d.]*", "__NUM__")
    return F.when(t.startswith("//") | t.startswith("#") | t.isin("", "{", "}", "(", ")", "{}", "[]", ",", ";"), "").otherwise(F.btrim(F.regexp_replace(named, r"\s+", " ")))


def duplicate_windows(lines: DataFrame, size: int = 6) -> DataFrame:
    """block (text of a window of normalised lines), path, line_no of its start, preview; starts nearer than size to a
    kept one of the same file are dropped."""
    size = max(3, size)
    kept = lines.select("path", "line_no", normalized(F.col("line")).alias("n")).filter("n <> ''")
    order = Window.partitionBy("path").orderBy("line_no")
    windows = kept.withColumn("w", F.collect_list("n").over(order.rowsBetween(0, size - 1))).filter(F.size("w") == size)
    keyed = windows.select("path", "line_no", F.col("n").alias("preview"), F.array_join("w", "\n").alias("block"))
    several = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("block")
    per_file = keyed.join(several, "block", "left_semi").groupBy("block", "path").agg(F.array_sort(F.collect_list("line_no")).alias("at"), F.first("preview").alias("preview"))
    far = F.aggregate("at", F.array().cast("array<int>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) >= size), F.concat(a, F.array(x))).otherwise(a))
    return per_file.withColumn("at", F.when(F.size("at") > 0, far)).select("block", "path", F.explode("at").alias("line_no"), "preview")


def duplicates(lines: DataFrame, size: int = 6, root: str = "") -> DataFrame:
    """DUP findings at a block's first place, with the other places."""
    size = max(3, size)
    places = duplicate_windows(lines, size)
    here = F.struct("path", "line_no")
    groups = places.groupBy("block").agg(F.array_sort(F.collect_list(here)).alias("p"), F.first("preview").alias("preview")).filter(F.size("p") > 1)
    others = F.transform(F.slice("p", 2, F.size("p")), lambda x: F.concat_ws(":", T.relative(x["path"], root) if root else x["path"], x["line_no"].cast("string")))
    message = F.concat(F.lit(f"Duplicate block ({size} lines) also found at: "), F.array_join(others, ", "))
    hint = F.concat(F.lit("Extract `"), F.substring("preview", 1, 40), F.lit("…` into a shared function or module"))
    first = F.col("p")[0]
    return groups.select(*finding("DUP", F.lit("info"), message, first["path"], first["line_no"], hint, affected=F.size("p") - 1))


#: What counts as a branch, by language: once a line for each text, and each time for each operator.
BRANCHES = {
    "python": (("if ", "elif ", "for ", "while ", " and ", " or ", "except"), ()),
    "rust": (("if ", "} else {", "else if ", "for ", "while ", "loop {", "match "), ("=>", "&&", "||", "?")),
    "go": (("if ", "} else {", "else if ", "for ", "switch ", "select {", "case "), ("&&", "||")),
    "": (("if (", "if(", "else if (", "else if(", "} else {", "for (", "for(", "while (", "while(", "switch (", "switch(", "case ", "catch (", "catch(", "catch {"), ("&&", "||", "??", " ? ")),
}


def branches(line: Column, language: Column) -> Column:
    """Branch points of a line; none in comments."""
    t = F.trim(F.translate(line, "\t", " "))

    def count(words: tuple[str, ...], marks: tuple[str, ...]) -> Column:
        n = F.lit(0)
        for word in words:
            n = n + t.contains(word).cast("int")
        for mark in marks:
            n = n + ((F.length(t) - F.length(F.replace(t, F.lit(mark)))) / len(mark)).cast("int")
        return n

    python = count(*BRANCHES["python"]) + t.startswith("else:").cast("int")
    n = F.when(language == "python", python).when(language == "rust", count(*BRANCHES["rust"])).when(language == "go", count(*BRANCHES["go"])).otherwise(count(*BRANCHES[""]))
    return F.when(T.starts_with_any(line, ("//", "#", "*", "/*")), 0).otherwise(n)


def brace_depth(rows: Column) -> Column:
    """Greatest depth of braces in an array of lines, without the outermost; comments are skipped."""
    code = F.array_join(F.filter(rows, lambda x: ~T.starts_with_any(x, ("//", "*", "/*"))), "")
    marks = F.split(F.regexp_replace(code, r"[^{}]+", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a: Column, x: Column) -> Column:
        d = F.when(x == "{", a["d"] + 1).when(x == "}", F.greatest(a["d"] - 1, F.lit(0))).otherwise(a["d"])
        return F.struct(d.alias("d"), F.greatest(a["m"], d).alias("m"))

    return F.greatest(F.aggregate(marks, start, step, lambda a: a["m"]) - 1, F.lit(0))


def indent_depth(rows: Column) -> Column:
    """Greatest indent in steps of four beyond the first line of the body."""
    body = F.transform(F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: F.trim(F.translate(x, "\t", " ")) != ""), lambda x: F.length(F.regexp_extract(x, r"^\s*", 0)))
    return F.coalesce(F.array_max(F.transform(body, lambda x: F.floor((x - body[0]) / 4))), F.lit(0)).cast("int")


def function_metrics(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """id, name, file_path, line, length, parameters, cyclomatic, nesting of each function; the last two are null
    where the file has no such lines."""
    f = nodes.filter("kind = 'Function'").select("id", "name", "file_path", "line", F.coalesce("end_line", "line").alias("end_line"), F.size(F.coalesce("data.parameters", F.array())).alias("parameters"))
    f = f.withColumn("length", T.saturating_sub(F.col("end_line"), F.col("line")))
    inside = f.filter("line > 0 AND end_line >= line").join(lines.select(F.col("path").alias("file_path"), "line_no", F.col("line").alias("text"), "ext"), "file_path").filter("line_no BETWEEN line AND end_line")
    kind = T.language(F.col("ext"), T.BRANCH_LANGUAGES, "generic")
    rows = inside.groupBy("id").agg(F.sum(branches(F.col("text"), kind)).alias("b"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("rows"), F.first(kind).alias("language"))
    depth = F.when(F.col("language") == "python", indent_depth(F.col("rows"))).otherwise(brace_depth(F.col("rows")))
    own = rows.select("id", (F.col("b") + 1).cast("int").alias("cyclomatic"), depth.alias("nesting"))
    return f.join(own, "id", "left").select("id", "name", "file_path", "line", "length", "parameters", "cyclomatic", "nesting")


def complexity(nodes: DataFrame, lines: DataFrame, threshold: int = 10) -> DataFrame:
    """CMPLX findings, up to four a function."""
    told = (
        ("length", LENGTH, "is {} lines long", "Break this function into smaller, focused functions", "Consider breaking this function into smaller, focused functions"),
        ("parameters", PARAMETERS, "has {} parameters", "Group related parameters into a struct or configuration object", "Consider grouping related parameters into a struct or object"),
        ("cyclomatic", (threshold, 2 * threshold), "has cyclomatic complexity of {}", "Reduce branching by extracting helper functions or simplifying logic", "Consider reducing branching by extracting helper functions"),
        ("nesting", NESTING, "has nesting depth of {}", "Reduce nesting using early returns or helper functions", "Consider reducing nesting using early returns or helper functions"),
    )
    options = []
    for column, (warn, error), text, hard, soft in told:
        value = F.col(column)
        said = F.concat(F.lit("Function `"), F.col("name"), F.lit("` "), F.replace(F.lit(text), F.lit("{}"), value.cast("string")))
        worst = F.struct(F.lit("error").alias("s"), F.concat(said, F.lit(f" (max recommended: {error})")).alias("m"), F.lit(hard).alias("h"))
        bad = F.struct(F.lit("warning").alias("s"), F.concat(said, F.lit(f" (recommended: <{warn})")).alias("m"), F.lit(soft).alias("h"))
        options.append(F.when(value >= error, worst).when(value >= warn, bad))
    each = function_metrics(nodes, lines).select("file_path", "line", F.explode(F.array_compact(F.array(*options))).alias("x"))
    return each.select(*finding("CMPLX", F.col("x.s"), F.col("x.m"), F.col("file_path"), F.col("line"), F.col("x.h")))


def dead_imports(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """IMP findings: imported names that stand in their file only once."""
    names = nodes.filter("kind = 'Import'").select("file_path", "line", F.explode("data.imported_names").alias("name")).filter(~F.col("name").isin("*", "", "self", "super", "crate", "_"))
    held = names.join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    own = F.coalesce(F.get(F.split("content", "\r?\n"), F.col("line") - 1), F.lit(""))
    after = F.when(F.contains(own, F.concat("name", F.lit(" as "))), F.regexp_extract(F.element_at(F.split(own, F.concat(F.lit("\\Q"), F.col("name"), F.lit(" as \\E")), 2), -1), r"^[\p{L}\p{N}_]+", 0))
    local = F.coalesce(F.when(after != "", after), F.col("name"))
    unused = held.withColumn("local", local).filter(T.word_count_of(F.col("content"), F.col("local")) <= 1)
    return unused.select(*finding("IMP", F.lit("warning"), F.format_string("`%s` is imported but never used", "local"), F.col("file_path"), F.col("line"), F.format_string("Remove the unused import of `%s`", "local")))


#: Names that the coverage rule leaves out.
UNCOVERED_OK = ("main", "new", "default", "init", "__init__", "__main__", "index", "handler", "setup", "teardown", "setUp", "tearDown")


def coverage_gaps(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """COV findings: top-level functions and classes whose name is in no test file. Without test files there are none."""
    tests = nodes.filter(F.col("kind") == "File").filter(T.is_test_file_coverage(F.col("file_path"))).select(F.col("file_path").alias("path")).distinct()
    words = files.join(tests, "path", "left_semi").select(F.explode(F.split("content", r"[^\p{L}\p{N}_]+")).alias("name")).filter(F.octet_length("name") >= 3).distinct()
    wanted = nodes.filter(F.col("kind").isin("Function", "Class") & ~F.col("name").startswith("_") & ~F.col("name").isin(*UNCOVERED_OK) & (F.octet_length("name") >= 3) & ~T.is_test_file_coverage(F.col("file_path")))
    gaps = graph.top_level(nodes, edges).join(wanted.select("id"), "id", "left_semi").join(words, "name", "left_anti")
    any_test = tests.limit(1).select(F.lit(True).alias("_any"))
    message = F.format_string("`%s` (%s) has no test coverage — name not found in any test file", "name", "kind")
    hint = F.format_string("Add a test that exercises `%s` to improve coverage", "name")
    return gaps.join(F.broadcast(any_test)).select(*finding("COV", F.lit("info"), message, F.col("file_path"), F.col("line"), hint))


#: Tools as (name, texts of a call, texts of a declaration, where to declare).
TOOLS = (
    ("rustfmt", ("cargo fmt", "rustfmt"), ("rustfmt",), "rust-toolchain.toml [toolchain] components"),
    ("clippy", ("cargo clippy",), ("clippy",), "rust-toolchain.toml [toolchain] components"),
    ("rust-analyzer", ("rust-analyzer",), ("rust-analyzer",), "rust-toolchain.toml [toolchain] components"),
    ("cargo-audit", ("cargo audit", "cargo-audit"), ("cargo-audit", "cargo audit"), "Cargo.toml [workspace.dependencies] or a cargo-install step"),
    ("cargo-tarpaulin", ("cargo tarpaulin", "cargo-tarpaulin"), ("cargo-tarpaulin", "cargo tarpaulin"), "a pinned cargo-install step in CI"),
    ("eslint", ("eslint", "npx eslint"), ('"eslint"', "'eslint'"), "package.json devDependencies"),
    ("prettier", ("prettier", "npx prettier"), ('"prettier"', "'prettier'"), "package.json devDependencies"),
    ("typescript (tsc)", (" tsc ", "npx tsc", "run tsc", '"tsc"'), ('"typescript"', "'typescript'"), "package.json devDependencies"),
    ("jest", (" jest", "npx jest", "run jest"), ('"jest"', "'jest'"), "package.json devDependencies"),
    ("vitest", ("vitest", "npx vitest"), ('"vitest"', "'vitest'"), "package.json devDependencies"),
    ("ruff", ("ruff check", "ruff format", "run ruff", " ruff "), ("ruff",), "requirements-dev.txt or pyproject.toml [tool.ruff]"),
    ("mypy", ("mypy ", "run mypy", "python -m mypy"), ("mypy",), "requirements-dev.txt or pyproject.toml"),
    ("black", ("black ", "run black", "python -m black"), ("black",), "requirements-dev.txt or pyproject.toml"),
    ("pytest", ("pytest", "python -m pytest"), ("pytest",), "requirements-dev.txt or pyproject.toml"),
    ("flake8", ("flake8", "python -m flake8"), ("flake8",), "requirements-dev.txt or pyproject.toml"),
    ("golangci-lint", ("golangci-lint",), ("golangci-lint",), "tools.go or a pinned install step in CI"),
    ("mockgen", ("mockgen",), ("mockgen",), "tools.go"),
)


def tool_calls(lines: DataFrame, tools=TOOLS) -> DataFrame:
    """path, tool, line_no: the first call of each tool in each file; comment lines do not count."""
    lower = F.lower("line")
    hits = []
    for name, calls, _, _ in tools:
        hit = F.lit(False)
        for call in calls:
            hit = hit | lower.contains(call)
        hits.append(F.when(hit, F.lit(name)))
    code = lines.filter(~T.starts_with_any(F.col("line"), ("#", "//")))
    each = code.select("path", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("tool"))
    return each.groupBy("path", "tool").agg(F.min("line_no").alias("line_no"))


def toolchain(callers: DataFrame, manifests: DataFrame, tools=TOOLS) -> DataFrame:
    """TOOL findings: tools that CI lines call and no manifest (path, content) declares."""
    lower = F.lower("content")
    declared = []
    for name, _, texts, _ in tools:
        hit = F.lit(False)
        for text in texts:
            hit = hit | lower.contains(text)
        declared.append(F.when(hit, F.lit(name)))
    known = manifests.select(F.explode(F.array_compact(F.array(*declared))).alias("tool")).distinct()
    where = callers.sparkSession.createDataFrame([(t[0], t[3]) for t in tools], "tool string, declare_in string")
    missing = tool_calls(callers, tools).join(known, "tool", "left_anti").join(F.broadcast(where), "tool")
    message = F.format_string("`%s` is invoked in CI/scripts but not declared in any manifest", "tool")
    return missing.select(*finding("TOOL", F.lit("warning"), message, F.col("path"), F.col("line_no"), F.format_string("Declare `%s` in %s so the tool version is reproducible", "tool", "declare_in")))


def run_files(lines: DataFrame, modules: set[str] | None = None, min_lines: int = 6) -> DataFrame:
    """Findings of all context rules that need lines only."""
    wanted = lambda m: modules is None or m in modules
    parts = [fit_in_loop(lines), ml_files(lines)] if wanted("ml") else []
    parts += [kubernetes(lines), docker_root(lines)] if wanted("infra") else []
    parts += [duplicates(lines, min_lines)] if wanted("duplication") else []
    out = parts[0] if parts else fit_in_loop(lines).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
