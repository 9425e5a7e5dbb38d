"""Cross-file resolution: imports to files, imported names to symbols, calls to symbols; all equi-joins."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes tried for a specifier, in order, and index files of a folder.
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ".java", ".kt", ".rb", ".php", ".swift", ".cs")
INDEXES = ("index.ts", "index.tsx", "index.js", "__init__.py")


def import_state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file_path, import_id, module, names (without *), is_wildcard of the imports that files hold."""
    files = nodes.filter("kind = 'File'").select(F.col("id").alias("from_id"))
    held = edges.filter("kind = 'Imports'").join(files, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    imports = nodes.filter("kind = 'Import'").join(held, "id", "left_semi")
    names = F.coalesce("data.imported_names", F.array().cast("array<string>"))
    return imports.select("file_path", F.col("id").alias("import_id"), F.col("data.module").alias("module"), F.filter(names, lambda x: x != "*").alias("names"), F.array_contains(names, "*").alias("is_wildcard"))


def imports_map(state: DataFrame) -> DataFrame:
    """file_path, name, module: what a name stands for; a bare or wildcard import is named by its last part, the last import wins."""
    bare = (F.size("names") == 0) | F.col("is_wildcard")
    last = F.element_at(F.split("module", r"\."), -1)
    each = state.select("file_path", "import_id", "module", F.explode(F.when(bare, F.array_union("names", F.array(last))).otherwise(F.col("names"))).alias("name"))
    return each.groupBy("file_path", "name").agg(F.max_by("module", "import_id").alias("module"))


def functions_map(nodes: DataFrame) -> DataFrame:
    """file_path, name, id: the last symbol of a name in its file."""
    return nodes.filter(~F.col("kind").isin("File", "Import")).groupBy("file_path", "name").agg(F.max("id").alias("id"))


def unresolved_calls(calls: DataFrame, imports: DataFrame, local: DataFrame) -> DataFrame:
    """calls (file_path, caller_id, callee, line) of imported names: with module and name in that module.

    A name that the file defines is no import; `prefix.method` with one dot goes to the module of the prefix.
    """
    foreign = calls.join(local.select("file_path", F.col("name").alias("callee")), ["file_path", "callee"], "left_anti")
    parts = F.split("callee", r"\.")
    keyed = foreign.filter(F.size(parts) <= 2).withColumn("name", parts[0]).withColumn("target", F.element_at(parts, -1))
    return keyed.join(imports, ["file_path", "name"]).select("file_path", "caller_id", "module", "target", "line")


def normalized_path(path: Column) -> Column:
    """path without . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    def step(a: Column, x: Column) -> Column:
        return F.when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == "..", a).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def candidates(base: Column) -> Column:
    """Paths to try for a specifier: itself, with each suffix in place of its own, and index files below it."""
    stem = F.regexp_replace(base, r"\.[^./]*$", "")
    tries = [base, *(F.concat(stem, F.lit(s)) for s in SUFFIXES), *(F.concat(base, F.lit("/" + s)) for s in INDEXES)]
    return F.array(*tries)


def first_candidate(wanted: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """key and path of the first of the column `tries` that index (path) has."""
    each = wanted.select(*key, F.posexplode("tries").alias("pos", "path"))
    return each.join(index.select("path"), "path").groupBy(*key).agg(F.min_by("path", "pos").alias("path"))


def resolve_modules(state: DataFrame, files: DataFrame) -> DataFrame:
    """import_id, file_path, path: the file of each module. files has path and id.

    ./ and ../ start at the importing file; other specifiers have . for /, from the root; failing that, any file in
    a folder named like the last part, the first by path.
    """
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise("")
    relative = F.col("module").startswith("./") | F.col("module").startswith("../") | F.col("module").isin(".", "..")
    base = F.when(relative, normalized_path(F.concat_ws("/", folder, "module"))).otherwise(normalized_path(F.replace("module", F.lit("."), F.lit("/"))))
    wanted = state.select("import_id", "file_path", "module", relative.alias("_rel"), candidates(base).alias("tries"))
    found = first_candidate(wanted, files, ["import_id", "file_path"])
    left = wanted.filter("NOT _rel").join(found.select("import_id"), "import_id", "left_anti").withColumn("parent", F.element_at(F.split("module", "/"), -1))
    parents = files.filter(F.col("path").contains("/")).groupBy(F.element_at(F.split("path", "/"), -2).alias("parent")).agg(F.min("path").alias("path"))
    return found.unionByName(left.join(parents, "parent").select("import_id", "file_path", "path"))


def resolve(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """New edges (from_id, to_id, kind, call_line, is_wildcard): File-Imports-File, References and Calls across files."""
    files = nodes.filter("kind = 'File'").select(F.col("file_path").alias("path"), "id")
    state = import_state(nodes, edges)
    found = resolve_modules(state, files)
    target = found.join(files.withColumnRenamed("id", "to_id"), "path")
    own = files.select(F.col("path").alias("file_path"), F.col("id").alias("from_id"))
    imports = target.join(own, "file_path").join(state.select("import_id", "is_wildcard"), "import_id").select("from_id", "to_id", F.lit("Imports").alias("kind"), F.lit(None).cast("int").alias("call_line"), "is_wildcard")
    symbols = functions_map(nodes).select(F.col("file_path").alias("path"), "name", F.col("id").alias("to_id"))
    named = found.join(state.filter("NOT is_wildcard").select("import_id", F.explode("names").alias("name")), "import_id")
    references = named.join(symbols, ["path", "name"]).select(F.col("import_id").alias("from_id"), "to_id", F.lit("References").alias("kind"), F.lit(None).cast("int").alias("call_line"), F.lit(None).cast("boolean").alias("is_wildcard"))
    modules = found.join(state.select("import_id", "module"), "import_id").groupBy("file_path", "module").agg(F.min("path").alias("path"))
    wanted = unresolved_calls(calls, imports_map(state), functions_map(nodes)).join(modules, ["file_path", "module"])
    called = wanted.join(symbols.withColumnRenamed("name", "target"), ["path", "target"]).select(F.col("caller_id").alias("from_id"), "to_id", F.lit("Calls").alias("kind"), F.col("line").alias("call_line"), F.lit(None).cast("boolean").alias("is_wildcard"))
    return imports.unionByName(references).unionByName(called)


def stamp_resolved(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes whose import data has resolved_path."""
    both = nodes.join(found.select(F.col("import_id").alias("id"), F.col("path").alias("_path")), "id", "left")
    return both.withColumn("data", F.when(F.col("_path").isNotNull(), F.col("data").withField("resolved_path", F.col("_path"))).otherwise(F.col("data"))).select(*nodes.columns)


def resolve_specifier(base_file: str, module: str, files: set[str]) -> Iterator[str]:
    """Pure-Python version of one lookup, for tests."""
    relative = module.startswith(("./", "../")) or module in (".", "..")
    base = posixpath.normpath(posixpath.join(posixpath.dirname(base_file), module)) if relative else posixpath.normpath(module.replace(".", "/"))
    stem = posixpath.splitext(base)[0] if "." in posixpath.basename(base) else base
    yield from (p for p in (base, *(stem + s for s in SUFFIXES), *(f"{base}/{s}" for s in INDEXES)) if p in files)
