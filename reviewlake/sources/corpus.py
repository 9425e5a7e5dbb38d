"""Corpus sources: files, lines, snapshots of git, changed lines, and the caches' checksums."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from reviewlake.functions import text as T

FILES = t.StructType([t.StructField(n, t.StringType()) for n in ("path", "content")])
CHANGED = "path string, all_new boolean, line int"


def named(files: DataFrame) -> DataFrame:
    """files (path, content) with file_name, ext and content_hash."""
    path = F.col("path")
    return files.withColumns({"file_name": T.file_name(path), "ext": T.extension(path), "content_hash": F.sha2(F.col("content").cast("binary"), 256)})


def ignored_regex(patterns: Iterable[str]) -> str | None:
    """One expression for ignore patterns: `dir/` means everything below it, at any depth."""
    parts = []
    for p in patterns:
        whole = T.glob_regex(p.rstrip("/") + "/**" if p.endswith("/") else p)[1:-1]
        parts.append(f"(?:^|.*/){whole}$")
    return "|".join(parts) or None


def discover(files: DataFrame, exts: Iterable[str] = (), names: Iterable[str] = (), ignore: Iterable[str] = ()) -> DataFrame:
    """Files with one of the extensions (with their dot) or names, without hidden and ignored ones."""
    exts, names = [e.lstrip(".") for e in exts], list(names)
    keep = ~F.col("path").rlike(r"(?:^|/)\.[^/.]")
    if exts or names:
        keep = keep & (F.coalesce(F.col("ext").isin(exts), F.lit(False)) | F.col("file_name").isin(names))
    if (pattern := ignored_regex(ignore)) is not None:
        keep = keep & ~F.col("path").rlike(pattern)
    return files.filter(keep)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root) and content of all readable text files below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.removeprefix("file://").rstrip("/")) + "/"
    text = F.try_validate_utf8(F.col("content").cast("string"))
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), f"^{base}", "")
    return raw.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), text.alias("content")).filter(F.col("content").isNotNull() & ~F.contains("content", F.lit("\0")))


def lines_of(files: DataFrame, *keep: str) -> DataFrame:
    """One row a line: path, file_name, ext, line_no from 1, line. \\r\\n ends a line too; a last empty one is none."""
    rows = F.split("content", "\r?\n")
    rows = F.when(F.element_at(rows, -1) == "", F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)
    named_files = files if "ext" in files.columns else named(files)
    return named_files.select(*keep, "path", "file_name", "ext", F.posexplode(rows).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def git_files(spark: SparkSession, repo: str, ref: str, exts: Iterable[str] = ()) -> DataFrame:
    """snapshot, path, content of the text files at a ref, in the order of the tree."""
    rows, exts = [], tuple(exts)
    for path in _git(repo, "ls-tree", "-r", "-z", "--name-only", ref).decode().split("\0"):
        if path and (not exts or path.endswith(exts)):
            try:
                content = _git(repo, "show", f"{ref}:{path}").decode()
            except UnicodeDecodeError:
                continue
            if "\0" not in content:
                rows.append((ref, path, content))
    return spark.createDataFrame(rows, "snapshot string, path string, content string")


def git_file(spark: SparkSession, repo: str, ref: str, path: str) -> str | None:
    """The text of one file at a ref; None if it is missing or no text."""
    try:
        text = _git(repo, "show", f"{ref}:{path}").decode()
    except (subprocess.CalledProcessError, UnicodeDecodeError):
        return None
    return None if "\0" in text else text


def changed_files(spark: SparkSession, repo: str, base: str, head: str | None = None) -> DataFrame:
    """path, change (added, deleted, modified, renamed), old_path between base and head or the working tree."""
    kinds = {"A": "added", "D": "deleted", "R": "renamed"}
    parts = _git(repo, "diff", "--name-status", "-M", "-z", base, *([head] if head else [])).decode().split("\0")
    rows, k = [], 0
    while k + 1 < len(parts):
        kind = kinds.get(parts[k][:1], "modified")
        two = parts[k][:1] in "RC"
        rows.append((parts[k + 1 + two], kind, parts[k + 1] if two else None))
        k += 2 + two
    return spark.createDataFrame(rows, "path string, change string, old_path string")


def parse_changed_lines(diff: str) -> list[tuple[str, bool, int | None]]:
    """(path, all_new, line) from a unified diff: an added file is all new; deleted files have no rows."""
    rows: list[tuple[str, bool, int | None]] = []
    path, new, line = None, False, 0
    for text in diff.split("\n"):
        if text.startswith("diff --git "):
            path, new = None, False
        elif text.startswith("new file mode"):
            new = True
        elif text.startswith("+++ ") and line <= 0 or text.startswith("+++ b/"):
            path = text[6:] if text.startswith("+++ b/") else None
            if path and new:
                rows.append((path, True, None))
        elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", text):
            line = int(m[1])
        elif path and not new and text.startswith("+"):
            rows.append((path, False, line))
            line += 1
        elif path and not new and text.startswith(" "):
            line += 1
    return rows


def changed_lines(spark: SparkSession, repo: str, base: str, head: str | None = None) -> DataFrame:
    diff = _git(repo, "diff", "-M", "--unified=0", base, *([head] if head else [])).decode(errors="replace")
    return spark.createDataFrame(parse_changed_lines(diff), CHANGED)


def changed_contents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose hashes differ between two (path, content_hash), or that only one has."""
    both = old.select("path", F.col("content_hash").alias("a")).join(new.select("path", F.col("content_hash").alias("b")), "path", "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").otherwise("modified").alias("change"))


def cache_is_valid(old: DataFrame, new: DataFrame, versions_equal: bool, commits_equal: bool) -> bool:
    return versions_equal and commits_equal and changed_contents(old, new).isEmpty()


def cached_fragments(files: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached fragments of unchanged files, and files to parse; a fragment is for one path and content."""
    keys = ["path", "content_hash"]
    return fragments.join(files.select(*keys), keys, "left_semi"), files.join(fragments.select(*keys).distinct(), keys, "left_anti")
