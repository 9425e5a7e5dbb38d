"""Configuration: a TOML file of the nearest folder above, or defaults."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from reviewlake.operators.rules import CustomRule

NAME = ".reviewlake.toml"
#: Modules that run by default, and those that are opted into.
ON = frozenset(("security", "ml", "cycles", "dependency", "error_handling"))
OPTIONAL = frozenset(("infra", "react", "async_patterns", "hardcoded_endpoints", "magic_numbers", "duplication", "complexity", "dead_imports", "dead_code", "test_coverage", "toolchain"))


@dataclass
class Config:
    modules: set[str] = field(default_factory=lambda: set(ON))
    complexity_threshold: int = 10
    duplication_min_lines: int = 6
    ignore_paths: list[str] = field(default_factory=list)
    ignore_findings: list[str] = field(default_factory=list)
    per_path: dict[str, list[str]] = field(default_factory=dict)
    fail_on: str = "error"
    max_counts: dict[str, int] = field(default_factory=dict)
    rules: list[CustomRule] = field(default_factory=list)
    base: str = "main"

    def problems(self) -> list[str]:
        """What is wrong with the values."""
        found = [f"unknown module {m}" for m in sorted(self.modules - ON - OPTIONAL)]
        if self.fail_on not in ("error", "warning", "info", "never"):
            found.append(f"fail_on is {self.fail_on}")
        if self.duplication_min_lines < 3:
            found.append("duplication_min_lines is less than 3")
        return found


def parse(text: str) -> Config:
    told = tomllib.loads(text)
    config = Config()
    for name, on in told.get("modules", {}).items():
        if isinstance(on, bool):
            (config.modules.add if on else config.modules.discard)(name)
    modules = told.get("modules", {})
    config.complexity_threshold = modules.get("complexity_threshold", 10)
    config.duplication_min_lines = modules.get("duplication_min_lines", 6)
    ignore = told.get("ignore", {})
    config.ignore_paths, config.ignore_findings, config.per_path = ignore.get("paths", []), ignore.get("findings", []), ignore.get("per_path", {})
    gate = told.get("gate", {})
    config.fail_on = told.get("general", {}).get("fail_on", "error")
    config.max_counts = {k.removesuffix("_max"): v for k, v in gate.items()}
    config.base = told.get("general", {}).get("diff_base", "main")
    names = CustomRule.__dataclass_fields__
    config.rules = [CustomRule(**{k: tuple(v) if k == "paths" else v for k, v in r.items() if k in names}) for r in told.get("rules", [])]
    return config


def find(start: str) -> Config:
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        if (folder / NAME).is_file():
            return parse((folder / NAME).read_text(encoding="utf-8"))
    return Config()


def save(config: Config, path: str) -> None:
    def show(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (list, tuple, set)):
            return "[" + ", ".join(show(v) for v in (sorted(value) if isinstance(value, set) else value)) + "]"
        return str(value) if isinstance(value, int) else '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'

    parts = ["[general]", f"fail_on = {show(config.fail_on)}", f"diff_base = {show(config.base)}", "[modules]"]
    parts += [f"{m} = {show(m in config.modules)}" for m in sorted(ON | OPTIONAL)]
    parts += [f"complexity_threshold = {config.complexity_threshold}", f"duplication_min_lines = {config.duplication_min_lines}", "[ignore]", f"paths = {show(config.ignore_paths)}", f"findings = {show(config.ignore_findings)}", "[ignore.per_path]"]
    parts += [f"{show(k)} = {show(v)}" for k, v in config.per_path.items()]
    parts += ["[gate]", *(f"{k}_max = {v}" for k, v in config.max_counts.items())]
    for rule in config.rules:
        parts += ["[[rules]]", *(f"{k} = {show(v)}" for k, v in asdict(rule).items() if v)]
    Path(path).write_text("\n".join(parts) + "\n", encoding="utf-8")


def suppress(config: Config, finding_id: str) -> Config:
    """Adds an id to the ignored ones, once."""
    if finding_id not in config.ignore_findings:
        config.ignore_findings.append(finding_id)
    return config
