"""Source text to property-graph rows, file by file, in executors.

Python is read with its own syntax tree. The other languages are read by a scanner: a table of line patterns for
declarations and imports, with comments and strings blanked and blocks found by braces (Ruby: by `end`). The
scanner covers declarations that start a line; it is no full grammar (see the README).

Ids are file_ord << 20 | place, so that they order as files and declarations do and need no global numbering.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.schemas import DATA, METADATA

SHIFT = 20
ROW = f"path string, nodes array<struct<id:bigint,kind:string,name:string,line:int,end_line:int,is_public:boolean,data:{DATA},decorators:array<string>,type_parameters:array<string>>>, edges array<struct<from_id:bigint,to_id:bigint,edge_idx:int,kind:string,metadata:{METADATA}>>, calls array<struct<caller_id:bigint,callee:string,line:int>>, error string"
#: Languages and their extensions.
LANGUAGES = {
    "python": "py pyi", "typescript": "ts tsx js jsx", "rust": "rs", "go": "go", "java": "java", "csharp": "cs", "kotlin": "kt kts", "ruby": "rb rake gemspec", "php": "php", "swift": "swift", "c": "c h cpp cc cxx hpp hxx",
}
BY_EXT = {e: n for n, exts in LANGUAGES.items() for e in exts.split()}
FIELDS = ("language", "exports", "parameters", "return_type", "base_classes", "methods", "fields", "definition", "var_type", "is_constant", "module", "imported_names", "resolved_path", "http_method", "path", "handler", "table_name", "model_fields", "key", "default_value")


@dataclass
class Graph:
    """What one file adds."""

    base: int
    nodes: list[dict[str, Any]] = field(default_factory=list)
    edges: list[dict[str, Any]] = field(default_factory=list)
    calls: list[dict[str, Any]] = field(default_factory=list)

    def node(self, kind: str, name: str, line: int, end: int | None = None, public: bool = True, decorators: list[str] | None = None, types: list[str] | None = None, **data: Any) -> int:
        row = dict.fromkeys(FIELDS) | data
        self.nodes.append({"id": self.base + len(self.nodes), "kind": kind, "name": name, "line": line, "end_line": end, "is_public": public, "data": row, "decorators": decorators or [], "type_parameters": types or []})
        return self.nodes[-1]["id"]

    def edge(self, a: int, b: int, kind: str, **metadata: Any) -> None:
        meta = dict.fromkeys(("call_line", "is_direct", "alias", "is_wildcard", "param_index")) | metadata if metadata else None
        self.edges.append({"from_id": a, "to_id": b, "edge_idx": sum(e["from_id"] == a for e in self.edges), "kind": kind, "metadata": meta})

    def call(self, caller: int, callee: str, line: int, local: dict[str, int]) -> None:
        name = callee if callee in local else callee.rsplit(".", 1)[-1] if callee.startswith(("self.", "this.", "Self::")) else callee
        if name in local:
            self.edge(caller, local[name], "Calls", call_line=line, is_direct=True)
        else:
            self.calls.append({"caller_id": caller, "callee": callee, "line": line})


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _parameters(args: ast.arguments) -> list[dict[str, str | None]]:
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    both = [*zip(plain, defaults, strict=True), *zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    return [{"name": a.arg, "param_type": _text(a.annotation), "default_value": _text(d)} for a, d in both]


def parse_python(text: str, path: str, graph: Graph) -> None:
    """Functions and methods by bare names; only functions directly in the file or a function are contained."""
    tree = ast.parse(text)
    file = graph.node("File", path.rsplit("/", 1)[-1], 0, language="python", exports=[])
    local: dict[str, int] = {}
    bodies: list[tuple[int, ast.AST]] = []

    def function(node: ast.FunctionDef | ast.AsyncFunctionDef, parent: int | None) -> None:
        own = graph.node("Function", node.name, node.lineno, node.end_lineno, not node.name.startswith("_"), parameters=_parameters(node.args), return_type=_text(node.returns))
        local[node.name] = own
        bodies.append((own, node))
        if parent is not None:
            graph.edge(parent, own, "Contains")
        for inner in node.body:
            if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                function(inner, own)

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, file)
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            fields = [t.attr for s in node.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Attribute) and _text(t.value) == "self"]
            own = graph.node("Class", node.name, node.lineno, node.end_lineno, not node.name.startswith("_"), base_classes=[_text(b) for b in node.bases], methods=[m.name for m in methods], fields=fields)
            graph.edge(file, own, "Contains")
            local[node.name] = own
            for m in methods:
                function(m, None)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                graph.edge(file, graph.node("Import", alias.name, node.lineno, module=alias.name, imported_names=[alias.name]), "Imports")
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            graph.edge(file, graph.node("Import", module, node.lineno, module=module, imported_names=[a.name for a in node.names if a.name != module]), "Imports")
    for own, body in bodies:
        for call in _own_calls(body):
            graph.call(own, _text(call.func) or "", call.lineno, local)


def _own_calls(function: ast.AST) -> Iterator[ast.Call]:
    """Calls of a function without those of functions inside it."""
    todo = list(ast.iter_child_nodes(function))
    while todo:
        node = todo.pop(0)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        if isinstance(node, ast.Call):
            yield node
        todo = list(ast.iter_child_nodes(node)) + todo


#: Declarations by language, as (kind, pattern); groups: name, args, ret, bases, recv, mod, names.
_I = r"[A-Za-z_$][\w$]*"
_JAVA_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|data|inner|inline|partial|readonly|synchronized|native|default|suspend|operator|fileprivate|mutating|class|lateinit|const|unsafe|extern|new)\s+)*"
SCANNERS: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("Import", rf"import\s+(?:type\s+)?(?P<names>[^'\"]*?)\s*(?:from\s*)?['\"](?P<mod>[^'\"]+)['\"]"),
        ("Class", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_I})(?P<types><[^{{]*?>)?(?:\s+extends\s+(?P<bases>[\w.$]+))?"),
        ("Class", rf"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>{_I})"),
        ("Interface", rf"(?:export\s+)?(?:default\s+)?interface\s+(?P<name>{_I})"),
        ("Type", rf"(?:export\s+)?type\s+(?P<name>{_I})(?:<[^=]*>)?\s*=\s*(?P<ret>.*)"),
        ("Function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_I})\s*(?:<[^(]*>)?\((?P<args>[^)]*)\)\s*(?::\s*(?P<ret>[^{{]+))?"),
        ("Function", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{_I})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\s*{_I}?\s*)?\((?P<args>[^)]*)\)\s*(?::\s*(?P<ret>[^={{]+))?(?:=>|\{{)"),
        ("Variable", rf"(?:export\s+)?(?P<const>const|let|var)\s+(?P<name>{_I})\s*(?::\s*(?P<ret>[^=]+))?="),
        ("Method", rf"(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b){_I})\s*(?:<[^(]*>)?\((?P<args>[^)]*)\)\s*(?::\s*(?P<ret>[^{{;]+))?\s*\{{"),
    ],
    "rust": [
        ("Import", r"(?:pub\s+)?use\s+(?P<mod>[^;]+);"),
        ("Class", r"(?P<pub>pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(?P<name>\w+)(?P<types><[^>{(]*>)?"),
        ("Interface", r"(?P<pub>pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"),
        ("Impl", r"(?:unsafe\s+)?impl(?:\s*<[^>]*>)?\s+(?:(?P<bases>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)"),
        ("Function", r"(?P<pub>pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)\s*(?:<[^(]*>)?\((?P<args>[^)]*)\)\s*(?:->\s*(?P<ret>[^{;]+))?"),
        ("Variable", r"(?P<pub>pub(?:\([^)]*\))?\s+)?(?P<const>const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:\s*(?P<ret>[^=]+)="),
        ("Type", r"(?P<pub>pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)(?:<[^=]*>)?\s*=\s*(?P<ret>[^;]*)"),
    ],
    "go": [
        ("Import", r"import\s+(?:(?P<names>[\w.]+)\s+)?\"(?P<mod>[^\"]+)\""),
        ("Import", r"(?:(?P<names>[\w.]+)\s+)?\"(?P<mod>[\w./-]+)\"\s*$"),
        ("Class", r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("Interface", r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("Type", r"type\s+(?P<name>\w+)\s*=?\s*(?P<ret>[^\s{(][^{]*)"),
        ("Function", r"func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<args>[^)]*)\)\s*(?P<ret>[^{]*)"),
        ("Variable", r"(?P<const>var|const)\s+(?P<name>\w+)\s*(?P<ret>[\w.\[\]*]*)\s*="),
    ],
    "java": [
        ("Import", r"import\s+(?:static\s+)?(?P<mod>[\w.]+(?:\.\*)?)\s*;"),
        ("Class", rf"(?P<pub>{_JAVA_MODS})(?:class|enum|record)\s+(?P<name>\w+)(?P<types><[^{{(]*>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.<>, ]+?))?(?:\s+implements\s+(?P<more>[\w.<>, ]+?))?\s*\{{"),
        ("Interface", rf"(?P<pub>{_JAVA_MODS})@?interface\s+(?P<name>\w+)"),
        ("Function", rf"(?P<pub>{_JAVA_MODS})(?:<[^>]+>\s+)?(?:(?P<ret>[\w.<>\[\], ?]+?)\s+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b|else\b)\w+)\s*\((?P<args>[^)]*)\)\s*(?:throws\s+[\w., ]+)?\s*\{{"),
        ("Variable", rf"(?P<pub>{_JAVA_MODS})(?P<ret>[\w.<>\[\], ?]+?)\s+(?P<name>(?!return\b)\w+)\s*(?:=[^=].*)?;"),
    ],
    "csharp": [
        ("Import", r"(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<mod>[\w.]+)\s*;"),
        ("Class", rf"(?P<pub>{_JAVA_MODS})(?:class|struct|enum|record(?:\s+(?:class|struct))?)\s+(?P<name>\w+)(?P<types><[^{{(:]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[\w.<>, ]+))?"),
        ("Interface", rf"(?P<pub>{_JAVA_MODS})interface\s+(?P<name>\w+)"),
        ("Function", rf"(?P<pub>{_JAVA_MODS})(?:(?P<ret>[\w.<>\[\], ?]+?)\s+)?(?P<name>(?!if\b|for\b|foreach\b|while\b|switch\b|catch\b|return\b|using\b|lock\b|new\b)\w+)\s*(?:<[^(]*>)?\((?P<args>[^)]*)\)\s*(?:\{{|=>|$)"),
        ("Function", rf"(?P<pub>{_JAVA_MODS})(?P<ret>[\w.<>\[\]?]+)\s+(?P<name>\w+)\s*\{{\s*(?:get|set|init)\b"),
        ("Variable", rf"(?P<pub>{_JAVA_MODS})(?P<ret>[\w.<>\[\], ?]+?)\s+(?P<name>(?!return\b)\w+)\s*(?:=[^=>].*)?;"),
    ],
    "kotlin": [
        ("Import", r"import\s+(?P<mod>[\w.]+(?:\.\*)?)"),
        ("Interface", rf"(?P<pub>{_JAVA_MODS})(?:fun\s+)?interface\s+(?P<name>\w+)"),
        ("Class", rf"(?P<pub>{_JAVA_MODS})(?:enum\s+class|annotation\s+class|value\s+class|class|object)\s+(?P<name>\w+)(?P<types><[^({{:]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[\w.<>, ()]+?))?\s*(?:\{{|$)"),
        ("Function", rf"(?P<pub>{_JAVA_MODS})fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(?P<name>\w+)\s*\((?P<args>[^)]*)\)\s*(?::\s*(?P<ret>[^{{=]+))?"),
        ("Variable", rf"(?P<pub>{_JAVA_MODS})(?P<const>val|var)\s+(?P<name>\w+)\s*(?::\s*(?P<ret>[^={{]+))?"),
    ],
    "ruby": [
        ("Import", r"(?:require|require_relative|load)\s*\(?\s*['\"](?P<mod>[^'\"]+)['\"]"),
        ("Class", r"class\s+(?P<name>[A-Z][\w:]*)(?:\s*<\s*(?P<bases>[\w:]+))?"),
        ("Module", r"module\s+(?P<name>[A-Z][\w:]*)"),
        ("Function", r"def\s+(?:self\.)?(?P<name>\w+[?!=]?)\s*\(?(?P<args>[^)]*)\)?"),
        ("Variable", r"(?P<name>[A-Z][A-Z0-9_]*)\s*="),
    ],
    "php": [
        ("Import", r"use\s+(?:function\s+|const\s+)?(?P<mod>[\w\\]+)(?:\s+as\s+(?P<names>\w+))?\s*;"),
        ("Class", rf"(?P<pub>{_JAVA_MODS})(?:class|trait|enum)\s+(?P<name>\w+)(?:\s*:\s*\w+)?(?:\s+extends\s+(?P<bases>[\w\\]+))?"),
        ("Interface", r"interface\s+(?P<name>\w+)"),
        ("Function", rf"(?P<pub>{_JAVA_MODS})function\s+&?(?P<name>\w+)\s*\((?P<args>[^)]*)\)\s*(?::\s*(?P<ret>[^{{;]+))?"),
        ("Variable", rf"(?P<pub>{_JAVA_MODS})const\s+(?P<name>\w+)\s*="),
        ("Variable", rf"(?:public|private|protected|static|readonly|var)\s+{_JAVA_MODS}(?:[\w\\?|]+\s+)?\$(?P<name>\w+)"),
    ],
    "swift": [
        ("Import", r"(?:@testable\s+)?import\s+(?:class\s+|struct\s+|func\s+)?(?P<mod>[\w.]+)"),
        ("Interface", rf"(?P<pub>{_JAVA_MODS})protocol\s+(?P<name>\w+)"),
        ("Impl", rf"(?P<pub>{_JAVA_MODS})extension\s+(?P<name>[\w.]+)"),
        ("Function", rf"(?P<pub>{_JAVA_MODS})func\s+(?P<name>\w+)\s*(?:<[^(]*>)?\((?P<args>[^)]*)\)\s*(?:(?:async|throws|rethrows)\s*)*(?:->\s*(?P<ret>[^{{]+))?"),
        ("Function", rf"(?P<pub>{_JAVA_MODS})(?:convenience\s+|required\s+)?(?P<name>init|deinit)[?!]?\s*(?:\((?P<args>[^)]*)\))?\s*(?:throws\s*)?\{{"),
        ("Class", rf"(?P<pub>{_JAVA_MODS.replace('|class', '')})(?:class|struct|enum|actor)\s+(?P<name>\w+)(?P<types><[^{{:]*>)?(?:\s*:\s*(?P<bases>[\w., ]+))?"),
        ("Type", rf"(?P<pub>{_JAVA_MODS})typealias\s+(?P<name>\w+)\s*=\s*(?P<ret>.*)"),
        ("Variable", rf"(?P<pub>{_JAVA_MODS})(?P<const>let|var)\s+(?P<name>\w+)\s*(?::\s*(?P<ret>[^={{]+))?"),
    ],
    "c": [
        ("Import", r"#\s*include\s*[<\"](?P<mod>[^>\"]+)[>\"]"),
        ("Function", r"#\s*define\s+(?P<name>\w+)\((?P<args>[^)]*)\)"),
        ("Variable", r"#\s*define\s+(?P<name>\w+)\s+\S"),
        ("Class", r"(?:typedef\s+)?(?:class|struct|union)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w:, ]+))?\s*\{"),
        ("Function", r"(?:(?:static|inline|extern|virtual|constexpr|explicit|friend)\s+)*(?P<ret>(?!return\b|else\b|typedef\b)[\w:<>*&,\s]+?[\s*&])(?P<name>(?!if\b|for\b|while\b|switch\b)~?\w+(?:::~?\w+)?)\s*\((?P<args>[^)]*)\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{"),
    ],
}
_COMPILED = {lang: [(kind, re.compile(p)) for kind, p in rules] for lang, rules in SCANNERS.items()}
_CALL = re.compile(r"(?<![\w$])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*[?!]?)\s*\(")
#: Words before a parenthesis that call nothing.
_NO_CALL = frozenset("if for while switch catch return function fn func def match sizeof elif foreach using lock when guard else do try new await typeof super".split())
OWNED = frozenset("rust go java csharp kotlin ruby php swift c".split())


def blank(text: str, language: str) -> str:
    """text with the insides of comments (and braces in strings) as spaces; lines stay."""
    hashes = language in ("ruby", "php")
    pattern = r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`" + (r"|(?<!\$)#[^\n{]*" if hashes else "")
    if language == "rust":
        pattern = pattern.replace(r"|'(?:[^'\\\n]|\\.)*'", r"|'(?:[^'\\\n]|\\.)'")

    def clean(m: re.Match[str]) -> str:
        found = m[0]
        if found[0] in "\"'`":
            return re.sub(r"[{}]", " ", found)
        return re.sub(r"[^\n]", " ", found)

    return re.sub(pattern, clean, text, flags=re.S)


def block_end(lines: list[str], at: int, language: str) -> int:
    """The last line (from 0) of the block that starts at a line."""
    if language == "ruby":
        indent = len(lines[at]) - len(lines[at].lstrip())
        for k in range(at + 1, len(lines)):
            if re.match(rf"\s{{{indent}}}end\b", lines[k]) and len(lines[k]) - len(lines[k].lstrip()) == indent:
                return k
        return at
    depth = opened = 0
    for k in range(at, len(lines)):
        for mark in re.findall(r"[{};]", lines[k]):
            if mark == ";" and not opened:
                return k
            opened |= mark == "{"
            depth += (mark == "{") - (mark == "}")
            if opened and depth <= 0 and mark == "}":
                return k
    return at if not opened else len(lines) - 1


def _split(args: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in args:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*out, part] if p.strip()]


def parameters(args: str, language: str) -> list[dict[str, str | None]]:
    """Names, types and defaults of a list of parameters."""
    found = []
    for part in _split(args):
        head, _, default = part.partition("=")
        head = head.strip()
        if language in ("typescript", "rust", "kotlin", "swift"):
            name, _, kind = head.partition(":")
            name = name.strip().removeprefix("mut ").rstrip("?").split()[-1:] or [""]
            if language == "rust" and name[0].lstrip("&") in ("self", "mut"):
                continue
            found.append((name[0], kind.strip()))
        elif language == "go":
            name, _, kind = head.partition(" ")
            found.append((name, kind.strip()))
        elif language == "ruby":
            name, _, kind = head.partition(":")
            found.append((name.lstrip("*&"), ""))
        else:
            words = head.replace("*", "* ").split()
            if words and words[-1] not in ("void", "*"):
                found.append((words[-1].lstrip("$&*."), " ".join(w for w in words[:-1] if not w.startswith("@"))))
        if found and default:
            found[-1] = (*found[-1][:2], default.strip())
    return [{"name": f[0], "param_type": f[1] or None, "default_value": f[2] if len(f) > 2 else None} for f in found]


def imported(language: str, module: str, names: str | None) -> tuple[str, list[str]]:
    """The module and the names that an import brings in."""
    if language == "typescript":
        inner = names or ""
        if "*" in inner:
            return module, ["*"]
        plain = [n.split(" as ")[0].removeprefix("type ").strip() for n in re.sub(r"[{}]", ",", inner).split(",")]
        return module, [n for n in plain if n]
    if language == "rust":
        module = module.strip()
        if m := re.match(r"(.*)::\{(.*)\}$", module, re.S):
            return m[1], [n.split(" as ")[0].strip() for n in m[2].split(",") if n.strip()]
        head, _, tail = module.rpartition("::")
        return (head or tail), [tail.split(" as ")[0].strip()]
    if language in ("java", "csharp"):
        tail = module.rsplit(".", 1)[-1]
        return (module[:-2], ["*"]) if tail == "*" else (module, [tail])
    if language == "kotlin":
        return module, ["*" if module.endswith(".*") else module.rsplit(".", 1)[-1]]
    tail = re.split(r"[/\\.]" if language == "swift" else r"[/\\]", module)[-1]
    return module, [names or tail]


def parse_scanned(text: str, path: str, language: str, graph: Graph) -> None:
    file = graph.node("File", path.rsplit("/", 1)[-1], 0, language=language, exports=[])
    code = blank(text, language)
    lines = code.split("\n")
    raw = text.split("\n")
    scopes: list[tuple[int, str, int | None, str]] = []  # last line, name, node, kind
    local: dict[str, int] = {}
    functions: list[tuple[int, int, int]] = []
    decorators: list[str] = []
    for at, line in enumerate(lines):
        while scopes and at > scopes[-1][0]:
            scopes.pop()
        stripped = line.strip()
        if re.match(r"@\w|#\[|\[\w", stripped):
            decorators.append(raw[at].strip())
            if not re.search(r"\b(?:class|fun|func|fn|interface|struct)\b", stripped):
                continue
        owner = next((s for s in reversed(scopes) if s[3] in ("Class", "Interface", "Impl", "Module")), None)
        in_function = any(s[3] == "Function" for s in scopes)
        for kind, pattern in _COMPILED[language]:
            source = raw[at].strip() if kind == "Import" else stripped
            m = pattern.match(source)
            if not m or (kind == "Method" and (owner is None or in_function)) or (kind == "Variable" and in_function) or (kind == "Function" and owner and in_function and language in ("java", "csharp", "c")):
                continue
            group = m.groupdict()
            if kind == "Import":
                module, names = imported(language, group["mod"], group.get("names"))
                graph.edge(file, graph.node("Import", module, at + 1, module=module, imported_names=names), "Imports", is_wildcard="*" in names)
                break
            end = block_end(lines, at, language) if kind not in ("Variable", "Type") else at
            name = group["name"]
            public = "pub" not in group or language != "rust" or bool(group["pub"])
            types = _split((group.get("types") or "")[1:-1])
            if kind == "Impl":
                scopes.append((end, name, local.get(name), "Impl"))
                if group.get("bases") and name in local and group["bases"].rsplit("::", 1)[-1] in local:
                    graph.edge(local[name], local[group["bases"].rsplit("::", 1)[-1]], "Implements")
                break
            if kind in ("Function", "Method"):
                receiver = (group.get("recv") or "").split()[-1:] if language == "go" else []
                full = f"{receiver[0].lstrip('*')}.{name}" if receiver else f"{owner[1]}.{name}" if owner and language in OWNED - {"go", "c"} else name
                args = ", ".join(x for x in (group.get("recv"), group.get("args")) if x)
                own = graph.node("Function", full, at + 1, end + 1, public, decorators, types, parameters=parameters(args, language), return_type=(group.get("ret") or "").strip() or None)
                for alias in {name, full, f"{owner[1]}::{name}" if owner else name}:
                    local[alias] = own
                functions.append((own, at, end))
                if owner and owner[2] is not None:
                    held = graph.nodes[owner[2] - graph.base]["data"]
                    held["methods"] = [*(held["methods"] or []), name]
                if not owner or language not in ("typescript",):
                    graph.edge(owner[2] if owner and owner[2] is not None else file, own, "Contains")
                scopes.append((end, full, own, "Function"))
            elif kind in ("Class", "Interface", "Module"):
                full = f"{owner[1]}.{name}" if owner and language == "java" else name
                bases = [b for key in ("bases", "more") for b in _split(group.get(key) or "")]
                data = {"base_classes": bases, "methods": [], "fields": []} if kind == "Class" else {"methods": []} if kind == "Interface" else {}
                own = local[name] = graph.node(kind, full, at + 1, end + 1, public, decorators, types, **data)
                graph.edge(file, own, "Contains")
                scopes.append((end, full, own, kind))
            else:
                constant = group.get("const") in ("const", "val", "let" if language == "swift" else "const", "static") or (language == "java" and "static" in (group.get("pub") or "") and "final" in (group.get("pub") or "")) or stripped.startswith("#")
                data = {"definition": (group.get("ret") or "").strip()} if kind == "Type" else {"var_type": "macro" if stripped.startswith("#") else (group.get("ret") or "").strip() or None, "is_constant": bool(constant)}
                own = graph.node(kind, name, at + 1, end + 1, public, decorators, types, **data)
                graph.edge(file if not owner or owner[2] is None else owner[2], own, "Contains")
                if owner and owner[2] is not None and owner[3] == "Class":
                    held = graph.nodes[owner[2] - graph.base]["data"]
                    held["fields"] = [*(held["fields"] or []), name]
            break
        if stripped and not re.match(r"@\w|#\[|\[\w", stripped):
            decorators = []
    for k, (own, at, end) in enumerate(functions):
        inner = [(a, z) for _, a, z in functions[k + 1 :] if at < a and z <= end]
        for number in range(at, end + 1):
            if any(a <= number <= z for a, z in inner):
                continue
            line = lines[number]
            if number == at:
                line = line[line.find("{") + 1 :] if "{" in line else ""
            for m in _CALL.finditer(line):
                callee = re.sub(r"::|->", ".", m[1])
                if callee.rsplit(".", 1)[-1] not in _NO_CALL and callee not in _NO_CALL:
                    graph.call(own, callee, number + 1, local)


def parse_source(path: str, text: str, file_ord: int) -> Graph:
    """The graph of one file; raises if Python text does not parse."""
    graph = Graph(file_ord << SHIFT)
    language = BY_EXT.get(path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else "")
    if language == "python":
        parse_python(text, path, graph)
    elif language:
        parse_scanned(text, path, language, graph)
    return graph


def numbered(files: DataFrame) -> DataFrame:
    """files with file_ord, by path. The table of paths is numbered by itself, without contents."""
    from reviewlake.operators.tables import sequenced

    return files.join(sequenced(files.select("path").distinct(), ["path"], "file_ord"), "path")


def parse(files: DataFrame) -> DataFrame:
    """path, nodes, edges, calls, error for each file (path, content, file_ord)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, text, number in zip(batch["path"], batch["content"], batch["file_ord"], strict=True):
                try:
                    g = parse_source(path, text or "", int(number))
                    rows.append((path, g.nodes, g.edges, g.calls, None))
                except (SyntaxError, ValueError, RecursionError) as error:
                    rows.append((path, [], [], [], str(error)))
            yield pd.DataFrame(rows, columns=["path", "nodes", "edges", "calls", "error"])

    known = files.filter(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*BY_EXT))
    return known.select("path", "content", "file_ord").mapInPandas(run, ROW)


def graph_of(parsed: DataFrame, snapshot: str = "current") -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and calls (file_path, caller_id, callee, line) of parsed files."""
    snap = F.lit(snapshot).alias("snapshot")
    nodes = parsed.select("path", F.explode("nodes").alias("n")).select(snap, "n.id", "n.kind", "n.name", F.col("path").alias("file_path"), "n.line", "n.end_line", "n.is_public", "n.data", "n.decorators", "n.type_parameters")
    edges = parsed.select(F.explode("edges").alias("e")).select(snap, "e.*")
    calls = parsed.select("path", F.explode("calls").alias("c")).select(F.col("path").alias("file_path"), "c.caller_id", "c.callee", "c.line")
    return nodes, edges, calls


def parse_findings(parsed: DataFrame) -> DataFrame:
    """PARSE warnings, without file and line."""
    from reviewlake.operators.rules import finding

    bad = parsed.filter("error IS NOT NULL")
    return bad.select(*finding("PARSE", F.lit("warning"), F.format_string("Failed to parse %s: %s", "path", "error"), F.lit(""), F.lit(0)))
