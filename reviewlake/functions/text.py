"""Column functions on paths, lines, ids and numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning", "info")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Without its dot; null if the name has none or only leads with one."""
    return F.when(file_name(path).rlike(r"^.+\.[^.]*$"), F.regexp_extract(path, r"\.([^./]*)$", 1))


def top_component(path: Column) -> Column:
    """The first part of a relative path."""
    return F.split(path, "/")[0]


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def short_path(path: Column, parts: int = 3) -> Column:
    """The last parts of a path."""
    split = F.split(path, "/")
    return F.array_join(F.slice(split, F.greatest(F.size(split) - parts + 1, F.lit(1)), parts), "/")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for a whole path: ** spans folders, * and ? any characters."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + ".*", k + 1
        elif glob[k] == "?":
            out, k = out + ".", k + 1
        elif glob[k] == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            out, k = out + "[" + glob[k + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return f"^(?s:{out})$"


def starts_with_any(line: Column, starts: tuple[str, ...]) -> Column:
    """Whether the trimmed line starts with one of the marks of a comment."""
    trimmed = F.ltrim(F.translate(line, "\t", " "))
    found = F.lit(False)
    for start in starts:
        found = found | trimmed.startswith(start)
    return found


def prefix_of(finding_id: Column) -> Column:
    return F.substring_index(finding_id, "-", 1)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "error", "error").when(severity == "warning", "warning").otherwise("note")


def debt_minutes(errors: Column, warnings: Column, info: Column) -> Column:
    return errors * 60 + warnings * 30 + info * 10


def format_debt(minutes: Column) -> Column:
    hours = F.floor(minutes / 60)
    rest = minutes % 60
    return (
        F.when(minutes < 60, F.format_string("%dm", minutes)).when(rest == 0, F.format_string("%dh", hours)).otherwise(F.format_string("%dh %dm", hours, rest))
    )


def html_escape(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def date_of(seconds: Column) -> Column:
    """UTC date of epoch seconds."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def word_count_of(content: Column, word: Column) -> Column:
    """Whole-word occurrences, where letters, digits and underscores make words."""
    words = F.split(content, "[^A-Za-z0-9_]+")
    return F.size(words) - F.size(F.array_remove(words, word))  # word is evaluated once, not for each of the words


def is_test_file_error(path: Column) -> Column:
    """The error rules' notion of a test file."""
    name = file_name(path)
    return name.startswith("test_") | name.rlike(r"(?:_test\.(?:rs|go)|_spec\.(?:rs|js|ts))$") | path.rlike(r"(?:^|/)(?:tests|__tests__)(?:/|$)")


def is_test_file_exports(path: Column) -> Column:
    """The dead-symbol rules' notion of a test file."""
    name = file_name(path)
    return path.rlike(r"(?:^|/)(?:tests|__tests__)(?:/|$)") | name.startswith("test_") | name.rlike(r"(?:_test\.(?:rs|py)|\.(?:test|spec)\.(?:ts|js))$")


def is_test_file_coverage(path: Column) -> Column:
    """The coverage rule's notion: its markers count anywhere in the (relative) path."""
    return path.rlike(r"/(?:test|tests|spec|specs|__tests__)/|_test\.|\.test\.|_spec\.|\.spec\.|test_") | file_name(path).startswith("spec_")


#: Language of an extension, for branch counting and for the summary.
BRANCH_LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "go": "go", "java": "java", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "php": "php", "swift": "swift"}
SUMMARY_LANGUAGES = {
    "py": "Python", "pyi": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "rs": "Rust", "go": "Go", "java": "Java", "cs": "C#", "kt": "Kotlin", "kts": "Kotlin",
    "rb": "Ruby", "rake": "Ruby", "gemspec": "Ruby", "php": "PHP", "swift": "Swift", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "hxx": "C++", "tf": "Terraform", "yaml": "YAML", "yml": "YAML", "json": "JSON",
}


def language(ext: Column, names: dict[str, str], other: str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, ext), F.lit(other))
