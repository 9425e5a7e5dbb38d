"""The line-rule catalogues: what each rule is called, matches and suggests.

Names, patterns, severities, file types and suggestions are fixed values that results must equal. They stand in order of
priority: the first rule that matches a line decides. {kw}, {exec}, {names} and {camel} stand for the shared parts.
"""

# ruff: noqa: E501
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One pattern. reject: substring that rules the line out, for the next rule; safe: pattern that ends the search."""

    name: str
    severity: str
    pattern: str
    suggestion: str
    exts: str = ""
    files: str = ""
    reject: str | None = None
    require: str | None = None
    safe: str | None = None
    product_only: bool = False
    fix: tuple[str, str] | None = None


#: Parts that several patterns share.
PARTS = {
    "{kw}": r"(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|REPLACE|MERGE|TRUNCATE|EXEC)\b",
    "{exec}": r"(?:execute|executemany|executescript|raw|rawquery|query|prepare)",
    "{names}": r"password|passwd|pwd|secret|token|api[_-]?key|credential|auth[_-]?key|private[_-]?key",
    "{camel}": r"password|passwd|pwd|secret|token|apiKey|api[_-]?key|credential|authKey|auth[_-]?key|privateKey|private[_-]?key",
}

#: SQL
SQL = (
    Rule("ORM raw query with interpolation", "error", r"""\.(?:objects\.raw|text)\s*\(\s*f["'].*{kw}""", "Use parameterized queries: .objects.raw('SELECT ... WHERE id = %s', [id])"),
    Rule("f-string SQL in database call", "error", r"""\.{exec}\s*\(\s*f["'].*{kw}""", "Use parameterized queries: .execute('SELECT ... WHERE id = ?', (id,))"),
    Rule("string concatenation SQL in database call", "error", r"""\.{exec}\s*\(\s*["'].*{kw}.*["']\s*\+""", "Use parameterized queries instead of string concatenation"),
    Rule(".format() SQL in database call", "error", r"""\.{exec}\s*\(\s*["'].*{kw}.*["']\s*\.format\s*\(""", "Use parameterized queries instead of .format()"),
    Rule("%-format SQL in database call", "error", r"""\.{exec}\s*\(\s*["'].*{kw}.*["']\s*%\s*\w""", "Use parameterized queries instead of %-formatting"),
    Rule("template literal SQL in database call", "error", r"\.{exec}\s*\(\s*`[^`]*{kw}[^`]*\$\{[^`]*`", "Use parameterized queries instead of template literals"),
    Rule("Rust format! macro building SQL string", "error", r'format!\s*\(\s*"[^"]*{kw}[^"]*\{', "Use a parameterized query library (e.g. sqlx query! macro or prepared statements)", exts="rs"),
    Rule("Go fmt.Sprintf building SQL string", "error", r'fmt\.Sprintf\s*\(\s*"[^"]*{kw}[^"]*%', "Use db.Query/db.Exec with ? placeholders: db.Query(\"SELECT ... WHERE id = ?\", id)", exts="go"),
    Rule("Java String.format building SQL string", "error", r'String\.format\s*\(\s*"[^"]*{kw}', "Use PreparedStatement with ? placeholders instead of String.format()", exts="java"),
    Rule("Java string concatenation building SQL string", "error", r'"[^"]*{kw}[^"]*"\s*\+\s*\w', "Use PreparedStatement with ? placeholders instead of string concatenation", exts="java"),
    Rule("f-string SQL assignment", "warning", r"""=\s*f["'].*{kw}.*\{""", "Use parameterized queries: pass variables as parameters, not in the query string"),
    Rule("string concatenation SQL", "warning", r"""["'].*{kw}.*["']\s*\+\s*\w""", "Use parameterized queries instead of string concatenation"),
    Rule(".format() SQL string", "warning", r"""["'].*{kw}.*["']\s*\.format\s*\(""", "Use parameterized queries instead of .format()"),
    Rule("%-format SQL string", "warning", r"""["'].*{kw}.*["']\s*%\s*\w""", "Use parameterized queries instead of %-formatting"),
    Rule("template literal SQL", "warning", r"`[^`]*{kw}[^`]*\$\{[^`]*`", "Use parameterized queries instead of template literals"),
)

#: CMD
CMD = (
    Rule("subprocess call with shell=True", "error", r"subprocess\.\w+\s*\([^)]*shell\s*=\s*True", "Pass a list of arguments to subprocess instead of shell=True; never interpolate user input into shell commands", exts="py"),
    Rule("os.system() call", "error", r"\bos\.system\s*\(", "Replace os.system() with subprocess.run() using an argument list", exts="py"),
    Rule("os.popen() call", "error", r"\bos\.popen\s*\(", "Replace os.popen() with subprocess.run() using an argument list", exts="py"),
    Rule("commands.getoutput() call (deprecated shell exec)", "error", r"\bcommands\.get(?:output|status(?:output)?)\s*\(", "Replace commands.getoutput() with subprocess.run() using an argument list", exts="py"),
    Rule("child_process exec with template literal", "error", r"\bexec(?:Sync)?\s*\(\s*`[^`]*\$\{", "Use execFile() or spawn() with an argument array instead of interpolating variables into a shell command string", exts="js ts jsx tsx mjs cjs"),
    Rule("child_process exec with string concatenation", "error", r"""\bexec(?:Sync)?\s*\(\s*["'][^"']*["']\s*\+""", "Use execFile() or spawn() with an argument array instead of concatenating user input into a shell command", exts="js ts jsx tsx mjs cjs"),
    Rule("spawn() with shell: true", "error", r"\bspawn\s*\([^)]*shell\s*:\s*true", "Remove shell: true from spawn() and pass arguments as an array", exts="js ts jsx tsx mjs cjs"),
    Rule("exec.Command with explicit shell invocation", "error", r'exec\.Command\s*\(\s*"(?:sh|bash|zsh|cmd|powershell)"\s*,', "Invoke the target binary directly with exec.Command instead of routing through a shell; validate all arguments", exts="go"),
    Rule("backtick shell execution with string interpolation", "error", r"`[^`]*#\{", "Use Open3.capture2e or IO.popen with an argument array instead of interpolating variables into a backtick shell command", exts="rb rake gemspec"),
    Rule("%x{} shell execution with string interpolation", "error", r"%x\{[^}]*#\{", "Use Open3.capture2e or IO.popen with an argument array instead of interpolating variables into a shell command", exts="rb rake gemspec"),
    Rule("Kernel#system() with interpolated string", "error", r'\bsystem\s*\(\s*"[^"]*#\{', "Pass arguments as separate strings to system() rather than interpolating into a single shell string", exts="rb rake gemspec"),
    Rule("eval with variable expansion", "error", r"\beval\s+\$\w+", "Avoid eval with variables; restructure logic to avoid dynamic command construction from untrusted input", exts="sh bash zsh"),
)

#: DESER
DESER = (
    Rule("yaml.load() without safe Loader", "error", r"yaml\.load\s*\(", "Use yaml.safe_load() or pass Loader=yaml.SafeLoader to yaml.load()", exts="py", safe="(?:Safe|Base)Loader"),
    Rule("pickle.load() — arbitrary code execution on untrusted data", "error", r"\bpickle\.loads?\s*\(", "Never deserialize pickle data from untrusted sources; use JSON or msgpack instead", exts="py"),
    Rule("cPickle.load() — arbitrary code execution on untrusted data", "error", r"\bcPickle\.loads?\s*\(", "Never deserialize cPickle data from untrusted sources; use JSON or msgpack instead", exts="py"),
    Rule("marshal.loads() — arbitrary code execution on untrusted data", "error", r"\bmarshal\.loads?\s*\(", "Never deserialize marshal data from untrusted sources; use JSON or msgpack instead", exts="py"),
    Rule("jsonpickle.decode() — arbitrary code execution on untrusted data", "error", r"\bjsonpickle\.decode\s*\(", "Never call jsonpickle.decode() on untrusted input; use json.loads() instead", exts="py"),
    Rule("PHP unserialize() — object injection on untrusted data", "error", r"\bunserialize\s*\(", "Use json_decode() instead of unserialize(); if you must unserialize, validate the data with a whitelist via the allowed_classes option", exts="php"),
    Rule("Java ObjectInputStream — deserialization gadget chain risk", "error", r"\bnew\s+ObjectInputStream\s*\(", "Avoid Java native deserialization with untrusted data; use JSON (Jackson) or a serialization filter (ObjectInputFilter) to allowlist safe types", exts="java"),
    Rule("Marshal.load() — arbitrary code execution on untrusted data", "error", r"\bMarshal\.load\s*\(", "Never call Marshal.load() on untrusted input; use JSON.parse() instead", exts="rb rake gemspec"),
    Rule("YAML.load() — may deserialize arbitrary Ruby objects", "warning", r"\bYAML\.load\s*\(", "Use YAML.safe_load() instead of YAML.load() to prevent arbitrary object deserialization; YAML.load() can instantiate arbitrary Ruby classes", exts="rb rake gemspec", safe=r"YAML\.safe_load"),
)

#: SSRF
SSRF = (
    Rule("requests call with f-string URL (interpolated)", "error", r"""\brequests\.\w+\s*\(\s*f["']""", "Validate and allowlist URLs before passing to requests; never interpolate user input directly into the URL", exts="py"),
    Rule("requests call with variable URL", "warning", r"\brequests\.\w+\s*\(\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*[,)\[]", "Validate and allowlist the URL before making this request; ensure it cannot be controlled by external input", exts="py"),
    Rule("urllib.urlopen with f-string URL", "error", r"""\burllib(?:2)?\.(?:request\.)?urlopen\s*\(\s*f["']""", "Validate and allowlist URLs before opening; never interpolate user input into the URL", exts="py"),
    Rule("urllib.urlopen with variable URL", "warning", r"\burllib(?:2)?\.(?:request\.)?urlopen\s*\(\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*[,)\[]", "Validate and allowlist the URL before opening", exts="py"),
    Rule("httpx call with f-string URL", "error", r"""\bhttpx\.\w+\s*\(\s*f["']""", "Validate and allowlist URLs before making httpx requests", exts="py"),
    Rule("httpx call with variable URL", "warning", r"\bhttpx\.\w+\s*\(\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*[,)\[]", "Validate and allowlist the URL before making this httpx request", exts="py"),
    Rule("fetch() with template literal URL (interpolated)", "error", r"\bfetch\s*\(\s*`[^`]*\$\{", "Validate and allowlist URLs before calling fetch(); never interpolate user input into the URL", exts="js ts jsx tsx mjs cjs"),
    Rule("fetch() with variable URL", "warning", r"\bfetch\s*\(\s*[a-zA-Z_$][a-zA-Z0-9_.$]*\s*[,)\[]", "Validate and allowlist the URL before calling fetch()", exts="js ts jsx tsx mjs cjs"),
    Rule("axios call with template literal URL", "error", r"\baxios\.(?:get|post|put|delete|patch|head|request)\s*\(\s*`[^`]*\$\{", "Validate and allowlist URLs before making axios requests", exts="js ts jsx tsx mjs cjs"),
    Rule("axios call with variable URL", "warning", r"\baxios\.(?:get|post|put|delete|patch|head|request)\s*\(\s*[a-zA-Z_$][a-zA-Z0-9_.$]*\s*[,)\[]", "Validate and allowlist the URL before making this axios request", exts="js ts jsx tsx mjs cjs"),
    Rule("http.Get/Post/Head with variable URL", "warning", r"\bhttp\.(?:Get|Post|Head)\s*\(\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*[,)\[]", "Validate and allowlist the URL before making this HTTP request; parse and inspect the URL with url.Parse() before use", exts="go"),
    Rule("http.Get/Post with fmt.Sprintf URL (interpolated)", "error", r"\bhttp\.(?:Get|Post|Head)\s*\(\s*fmt\.Sprintf\s*\(", "Validate and allowlist the URL; never construct URLs via fmt.Sprintf with user-controlled values", exts="go"),
    Rule("new URL() with variable (potential SSRF)", "warning", r"\bnew\s+URL\s*\(\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*[,)\[]", "Validate and allowlist the URL before opening a connection; use a strict allowlist of permitted hosts", exts="java", safe=r'new\s+URL\s*\(\s*"(?:file|classpath):'),
    Rule("new URL() with string concatenation", "error", r'\bnew\s+URL\s*\(\s*"[^"]*"\s*\+', "Never build URLs by concatenating user input; use a strict allowlist of permitted hosts", exts="java"),
)

#: PATH
PATH = (
    Rule("open() with f-string path (interpolated)", "error", r"""\bopen\s*\(\s*f["']""", "Validate and sanitize the path; use os.path.realpath() and verify the result starts with the expected base directory", exts="py"),
    Rule("open() with '../' traversal sequence", "error", r"""\bopen\s*\([^)]*(?:['"]|\+\s*['"])\s*\.\./""", "Never allow '../' in file paths from user input; use os.path.realpath() and allowlist the expected base directory", exts="py"),
    Rule("os.path.join() with variable first argument", "warning", r"\bos\.path\.join\s*\(\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*,", "After joining paths, call os.path.realpath() and verify the result starts with the intended base directory to prevent traversal", exts="py"),
    Rule("pathlib.Path() with f-string argument", "error", r"""\bPath\s*\(\s*f["']""", "Resolve and validate the path: use Path(base).resolve() and check that the result is relative to the expected root", exts="py"),
    Rule("fs.readFile/writeFile/appendFile with template literal path", "error", r"\bfs\.(?:read|write|append)(?:File|FileSync)\s*\(\s*`[^`]*\$\{", "Validate the path with path.resolve() and verify it starts with the expected base directory before passing to fs methods", exts="js ts jsx tsx mjs cjs"),
    Rule("fs.readFile/writeFile with variable path", "warning", r"\bfs\.(?:read|write|append)(?:File|FileSync)\s*\(\s*[a-zA-Z_$][a-zA-Z0-9_.$]*\s*[,)]", "Validate the path with path.resolve() and verify it stays within the expected directory before reading or writing", exts="js ts jsx tsx mjs cjs"),
    Rule("path.join() with template literal segment", "error", r"\bpath\.join\s*\([^)]*`[^`]*\$\{", "Validate that path.resolve(path.join(...)) stays within the expected base directory", exts="js ts jsx tsx mjs cjs"),
    Rule("path.join() with '../' sequence", "error", r"""\bpath\.join\s*\([^)]*['"]\.\.[/\\]['"]""", "Do not allow '../' in path segments from user input; use path.resolve() and verify the result is within the base dir", exts="js ts jsx tsx mjs cjs"),
    Rule("include/require with variable path (LFI risk)", "error", r"\b(?:include|require)(?:_once)?\s*\(\s*\$", "Never pass user-controlled values to include/require; use an allowlist of permitted file names", exts="php"),
    Rule("file_get_contents() with superglobal input", "error", r"\bfile_get_contents\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE|SERVER)", "Never pass raw user input to file_get_contents(); validate and sanitize the path, then use realpath() to prevent traversal", exts="php"),
    Rule("file_get_contents() with variable path", "warning", r"\bfile_get_contents\s*\(\s*\$[a-zA-Z_]\w*", "Validate and sanitize the path before passing to file_get_contents(); use realpath() and verify the result is within the expected directory", exts="php", safe=r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER)"),
    Rule("os.Open/ReadFile with fmt.Sprintf path (interpolated)", "error", r"\b(?:os\.Open|os\.ReadFile|ioutil\.ReadFile)\s*\(\s*fmt\.Sprintf\s*\(", "Use filepath.Clean() and verify the cleaned path starts with the expected base directory; never build paths with fmt.Sprintf from user input", exts="go"),
    Rule("os.Open/ReadFile with variable path", "warning", r"\b(?:os\.Open|os\.ReadFile|ioutil\.ReadFile)\s*\(\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*[,)]", "Use filepath.Clean() and verify the path stays within the expected base directory before opening", exts="go"),
    Rule("new File() with string concatenation", "error", r'\bnew\s+File\s*\(\s*"[^"]*"\s*\+', "Use File.getCanonicalPath() and verify the result starts with the expected base path; never build file paths by string concatenation", exts="java"),
    Rule("Paths.get() with variable argument", "warning", r"\bPaths\.get\s*\(\s*[a-zA-Z_][a-zA-Z0-9_.]*\s*[,)]", "Call .toRealPath() and verify the result starts with the expected base directory to prevent path traversal", exts="java"),
)

#: LOG
LOG = (
    Rule("sensitive variable passed to Python logging call", "warning", r"(?i)\b(?:logging|log|logger)\.(?:debug|info|warning|warn|error|critical|exception)\s*\(.*\b(?:{names})\b", "Never log raw credentials; redact or omit the sensitive field before logging", exts="py"),
    Rule("sensitive variable passed to Python print()", "warning", r"(?i)\bprint\s*\(.*\b(?:{names})\b", "Remove the sensitive value from the print() call", exts="py"),
    Rule("sensitive variable passed to console.*", "warning", r"(?i)\bconsole\.(?:log|info|warn|error|debug|trace)\s*\(.*\b(?:{names})\b", "Remove sensitive values from console calls; use a redaction helper", exts="js ts jsx tsx mjs cjs"),
    Rule("sensitive variable passed to logger.* (JS/TS)", "warning", r"(?i)\blogger\.(?:log|info|warn|error|debug|trace|fatal)\s*\(.*\b(?:{names})\b", "Redact or omit the sensitive field before passing it to the logger", exts="js ts jsx tsx mjs cjs"),
    Rule("sensitive variable passed to fmt.Print / log.Print (Go)", "warning", r"\b(?:fmt\.Print(?:f|ln)?|log\.Print(?:f|ln)?|log\.Fatal(?:f|ln)?|log\.Panic(?:f|ln)?)\s*\(.*\b(?:{camel})\b", "Redact the sensitive field before logging; use structured logging with redaction", exts="go"),
    Rule("sensitive variable passed to System.out.println or logger (Java)", "warning", r"(?i)(?:System\.out\.print(?:ln)?|(?:log|logger)\.(?:info|debug|warn|error|trace|fatal))\s*\(.*\b(?:{camel})\b", "Do not log raw credentials; mask or omit the sensitive field", exts="java"),
    Rule("sensitive variable passed to error_log / var_dump (PHP)", "warning", r"(?i)\b(?:error_log|var_dump|print_r)\s*\(.*\$(?:password|passwd|secret|token|api_key|credential|auth_key|private_key)\b", "Never dump raw credentials to error_log or var_dump", exts="php"),
    Rule("sensitive variable passed to puts / p (Ruby)", "warning", r"(?i)\b(?:puts|p|pp|print)\s+(?:\w+\.)?\b(?:{names})\b", "Remove the sensitive variable from the puts/p call", exts="rb"),
)

#: ENDPT
ENDPT = (
    Rule("hardcoded private IP (10.x.x.x)", "warning", r"\b10\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "Use an environment variable or config file for internal IP addresses"),
    Rule("hardcoded private IP (192.168.x.x)", "warning", r"\b192\.168\.\d{1,3}\.\d{1,3}\b", "Use an environment variable or config file for internal IP addresses"),
    Rule("hardcoded private IP (172.16-31.x.x)", "warning", r"\b172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}\b", "Use an environment variable or config file for internal IP addresses"),
    Rule("hardcoded IP address in URL", "warning", r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "Replace the hardcoded IP with a named host configured via environment variable"),
    Rule("hardcoded production URL", "warning", r"(?i)https?://(?:[a-zA-Z0-9-]+\.)*(?:prod|production)\b[a-zA-Z0-9.-]*/?", "Store production URLs in environment variables; use a config abstraction layer"),
    Rule("hardcoded staging URL", "warning", r"(?i)https?://(?:[a-zA-Z0-9-]+\.)*(?:staging|stage)\b[a-zA-Z0-9.-]*/?", "Store staging URLs in environment variables; do not couple code to environments"),
)

#: ML
ML = (
    Rule("fit on test data (data leakage)", "error", r"\.fit(?:_transform)?\s*\(.*(?:X_test|test_X|x_test|test_x|test_data|test_features)", "Fit only on training data, then use .transform() on test data"),
    Rule("fit on test labels (data leakage)", "error", r"\.fit(?:_transform)?\s*\(.*(?:y_test|test_y|test_labels|test_target)", "Fit only on training labels, then use .transform() on test labels"),
    Rule("train_test_split without random_state (non-reproducible)", "warning", r"train_test_split\s*\(", "Add random_state parameter for reproducible splits: train_test_split(..., random_state=42)", reject="random_state"),
    Rule("fit_transform on full dataset (possible data leakage)", "warning", r"\.fit_transform\s*\(\s*(?:X|data|df|features|dataset)\s*[\),]", "Split data first, then .fit_transform() on training set only", reject="_train"),
    Rule("pickle for model serialization (insecure, non-portable)", "warning", r"pickle\.(?:dump|loads?)\s*\(", "Use joblib instead: joblib.dump()/joblib.load()", fix=(r"pickle\.", "joblib.")),
    Rule("hardcoded absolute data path (non-reproducible)", "warning", r"""\.read_(?:csv|parquet|excel|json|feather)\s*\(\s*["']/""", "Use relative paths or environment variables for data file paths"),
    Rule("train_test_split without stratify (imbalanced data risk)", "info", r"train_test_split\s*\(", "Add stratify parameter for balanced splits: train_test_split(..., stratify=y)", reject="stratify", require="random_state"),
    Rule("deprecated sklearn import (use model_selection instead)", "info", r"from\s+sklearn\.(?:cross_validation|grid_search)", "Use sklearn.model_selection instead", fix=(r"sklearn\.(?:cross_validation|grid_search)", "sklearn.model_selection")),
    Rule("hardcoded absolute path in data write call (non-reproducible)", "warning", r"""\.to_(?:csv|parquet|excel|feather)\s*\(\s*["'](?:/|~)""", "Use relative paths or environment variables for output file paths"),
)

#: INFRA
INFRA = (
    Rule("public S3 bucket ACL (exposes bucket to internet)", "error", r"""acl\s*=\s*["']public-read(?:-write)?["']""", "Set ACL to \"private\" to restrict bucket access", exts="tf", fix=("public-read(?:-write)?", "private")),
    Rule("open security group 0.0.0.0/0 (exposes service to internet)", "error", r"""cidr_blocks\s*=\s*\[.*["']0\.0\.0\.0/0["']""", "Restrict CIDR block to specific IP ranges instead of 0.0.0.0/0", exts="tf"),
    Rule("hardcoded provider credentials in Terraform", "error", r"""(?:access_key|secret_key)\s*=\s*["'][A-Za-z0-9/+=]{16,}["']""", "Use Terraform variables or environment variables for credentials", exts="tf tfvars", reject="var."),
    Rule("wildcard IAM action (violates least-privilege)", "warning", r"""["']?(?:actions|Action)["']?\s*[:=]\s*\[?\s*["']\*["']""", "Specify explicit IAM actions instead of using wildcard \"*\"", exts="tf json", reject="NotAction"),
    Rule("Docker FROM :latest or untagged (non-reproducible build)", "warning", r"(?i)^FROM\s+[^\s:]+(?::latest\s*$|\s*$)", "Pin Docker image to a specific version tag for reproducible builds", files="Dockerfile", reject="scratch"),
    Rule("privileged container (root access to host)", "warning", r"privileged:\s*true", "Set privileged: false unless root access is strictly required", exts="yaml yml", fix=(r"privileged:\s*true", "privileged: false")),
    Rule("hostPath volume mount (container escape vector)", "warning", r"hostPath:\s*$", "Use emptyDir, configMap, or PVC instead of hostPath volumes", exts="yaml yml"),
    Rule("K8s container image pinned to :latest (non-reproducible deploy)", "warning", r"^\s*image:\s+\S+:latest\s*$", "Pin the image to a specific digest or version tag (e.g. nginx:1.25.3)", exts="yaml yml"),
    Rule("Docker ADD instruction (use COPY unless tar-extraction is needed)", "warning", r"(?i)^ADD\s+", "Use COPY instead of ADD; ADD silently extracts tarballs and can fetch remote URLs", files="Dockerfile"),
    Rule("Docker USER root (container runs as root)", "warning", r"(?i)^USER\s+(?:root|0)\s*$", "Create and switch to a non-root user: RUN useradd -m appuser && USER appuser", files="Dockerfile"),
    Rule("Docker COPY . . copies entire context (may include .env or secrets)", "warning", r"(?i)^COPY\s+\.\s+[./]", "Use a .dockerignore file to exclude .env, secrets, and other sensitive files", files="Dockerfile"),
    Rule("HTTP URL in Terraform config (use HTTPS)", "info", r"""(?:source|endpoint|url)\s*=\s*["']http://""", "Use HTTPS instead of HTTP for secure communication", exts="tf", reject="localhost", fix=("http://", "https://")),
)

#: HOOKS
HOOKS = (
    Rule("Hook inside condition", "error", r"if\s*\(.*\).*\buse[A-Z]\w+\s*\(", "Move hook call to top level of the component"),
    Rule("Hook inside loop", "error", r"(?:for\s*\(|while\s*\().*\buse[A-Z]\w+\s*\(", "Move hook call to top level of the component"),
    Rule("useEffect without dependency array", "warning", r"useEffect\s*\(", "Add dependency array: useEffect(() => { ... }, [deps])", reject=", ["),
    Rule("Direct DOM manipulation", "warning", r"document\.(?:getElementById|querySelector|querySelectorAll|getElementsBy)\s*\(", "Use useRef() hook instead of direct DOM manipulation"),
    Rule("Missing key prop in map", "warning", r"\.map\s*\(.*=>\s*<[A-Z]", "Add a unique key prop: <Component key={item.id} />", reject="key="),
    Rule("dangerouslySetInnerHTML usage", "warning", "dangerouslySetInnerHTML", "Avoid dangerouslySetInnerHTML; use a sanitization library like DOMPurify if needed"),
    Rule("Inline function in JSX event handler", "info", r"on[A-Z]\w+=\{.*=>", "Extract handler to useCallback() to prevent unnecessary re-renders"),
    Rule("useEffect with empty dependency array", "info", r"useEffect\s*\(.*,\s*\[\s*\]\s*\)", "Empty dependency array means this runs once on mount; ensure it does not reference props or state that may change"),
)

#: ASYNC
ASYNC = (
    Rule("Async Promise executor", "error", r"new\s+Promise\s*\(\s*async", "Remove async from Promise executor; use resolve/reject callbacks instead"),
    Rule("Await in forEach", "error", r"\.forEach\s*\(\s*async", "Use for...of loop or Promise.all(items.map(...)) instead of forEach with async"),
    Rule("Unhandled .then() chain", "warning", r"\.then\s*\(", "Add .catch() handler or use async/await with try/catch", reject=".catch"),
    Rule("Async map without Promise.all", "warning", r"\.map\s*\(\s*async", "Wrap with await Promise.all(...) to collect async map results", reject="Promise.all"),
    Rule("Async timer callback", "warning", r"(?:setTimeout|setInterval)\s*\(\s*async", "Extract async logic and add error handling inside the callback"),
    Rule("Floating Python coroutine", "warning", r"asyncio\.(?:sleep|gather|wait_for|create_task|ensure_future)\s*\(", "Add await before asyncio call", reject="await"),
    Rule("Swallowed error in catch", "info", r"\.catch\s*\([^{]*\{\s*\}\s*\)", "Handle or log the error instead of swallowing it"),
    Rule("Redundant return await", "info", r"return\s+await\s+", "Remove await from return statement (unless inside try/catch)"),
)

#: DEP
DEP = (
    Rule("wildcard import in Python (pollutes namespace)", "warning", r"^\s*from\s+\S+\s+import\s+\*", "Import specific names instead of using wildcard import", exts="py"),
    Rule("wildcard import in Java (pollutes namespace)", "warning", r"^\s*import\s+[\w.]+\.\*\s*;", "Import specific classes instead of using wildcard import", exts="java"),
    Rule("deprecated Python module import (removed in 3.12+)", "warning", r"^\s*(?:import\s+(?:imp|optparse|distutils|aifc|audioop|cgi|cgitb|smtpd|pipes|sndhdr|sunau|nntplib|xdrlib|msilib|imghdr|formatter)|from\s+(?:imp|optparse|distutils|aifc|audioop|cgi|cgitb|smtpd|pipes|sndhdr|sunau|nntplib|xdrlib|msilib|imghdr|formatter)\s+import)", "This module is deprecated/removed in Python 3.12+; use its modern replacement", exts="py"),
    Rule("circular import workaround annotation", "warning", r"(?:#\s*noqa:\s*circular|#\s*type:\s*ignore\[import|//\s*@ts-ignore|//\s*eslint-disable.*import)", "Resolve the circular dependency instead of suppressing the lint", exts="py ts js tsx jsx"),
    Rule("unpinned or wildcard dependency version", "warning", r"""["']\s*:\s*["'](?:\*|latest)["']""", "Pin dependency to a specific version or semver range", files="package.json"),
    Rule("require() instead of ES import", "info", r"(?:const|let|var)\s+\w+\s*=\s*require\s*\(", "Use ES module import syntax instead of require()", exts="ts js tsx jsx", reject="jest"),
    Rule("deeply nested relative import (3+ levels)", "info", r"""(?:from\s+\.{3,}\S*\s+import|(?:from|import|require)\s*\(?['"](?:\.\./){3,}|require\s*\(\s*['"](?:\.\./){3,})""", "Use absolute imports or path aliases instead of deep relative imports", exts="py ts js tsx jsx"),
    Rule("git dependency (non-reproducible, breaks offline installs)", "info", r"""(?:["']git\+https?://|["']github:|git\s*=\s*["']https?://|git\+https?://)""", "Use a published package version instead of a git dependency", exts="toml", files="package.json requirements.txt"),
)

#: ERR
ERR = (
    Rule("Empty catch/except block", "warning", r"(?:catch\s*(?:\([^)]*\))?\s*\{\s*\}|except[^:]*:\s*(?:pass\s*$))", "Handle the error or add a comment explaining why it is safe to ignore"),
    Rule("Bare except without exception type", "warning", r"^\s*except\s*:", "Specify an exception type: except ValueError: or except Exception as e:", exts="py"),
    Rule(".unwrap() call", "warning", r"\.unwrap\(\)", "Use ? operator, .unwrap_or(), .unwrap_or_else(), or .expect() with a descriptive message", exts="rs", product_only=True),
    Rule("panic!/todo!/unimplemented! in non-test code", "warning", r"\b(?:panic!|todo!|unimplemented!)\s*\(", "Return a Result with a descriptive error instead of panicking", exts="rs", product_only=True),
    Rule(".expect() with non-descriptive message", "warning", r"""\.expect\s*\(\s*["'](?:|error|err|failed|fail|failure|oops|todo|fixme|ok|bad|wrong|none|panic|crash|broken|invalid|unexpected|unreachable|missing|unknown|test|no|yes|x|temp|hack)\s*["']\s*\)""", "Use a descriptive message: .expect(\"Failed to open config file\")", exts="rs", product_only=True),
    Rule("Catch block only logs error", "info", r"catch\s*\([^)]*\)\s*\{\s*(?:console\.(?:log|warn|error|info)|System\.(?:out|err)\.print|log(?:ger)?\.(?:error|warn|info|debug))\s*\(", "Re-throw the error or handle it properly after logging", exts="js ts jsx tsx java", reject="throw"),
    Rule("Too-broad exception catch", "warning", r"^\s*except\s+(?:Exception|BaseException)\b", "Catch a more specific exception type (e.g. ValueError, KeyError)", exts="py"),
    Rule("Empty .catch() callback", "warning", r"\.catch\s*\(\s*(?:\(\s*[^)]*\)\s*=>\s*\{\s*\}|\w+\s*=>\s*\{\s*\}|\(\s*\)\s*\{\s*\}|function\s*\(\s*[^)]*\)\s*\{\s*\})\s*\)", "Handle or re-throw the error in the .catch() callback", exts="js ts jsx tsx"),
    Rule("Discarded error in Go", "warning", r"_\s*=\s*err\b", "Handle the error: if err != nil { return err }", exts="go"),
)

#: Patterns of our own for the documented secrets; their order is that of the documentation.
SEC = (
    Rule("AWS access key", "error", r"\bAKIA[0-9A-Z]{16}\b", "Remove the key and load it from the environment or a secret manager"),
    Rule("AWS secret access key", "error", r"(?i)aws.{0,30}secret.{0,30}[\"'][A-Za-z0-9/+=]{40}[\"']", "Remove the key and load it from the environment or a secret manager"),
    Rule("GitHub token", "error", r"\bgh[pousr]_[A-Za-z0-9]{36,}", "Revoke the token and load it from the environment"),
    Rule("private key", "error", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "Keep private keys out of the repository"),
    Rule("database connection string with credentials", "error", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|mssql)://[^\s:/\"'@]+:[^\s@\"']+@", "Load the connection string from the environment"),
    Rule("Stripe live secret key", "error", r"\b(?:sk|rk)_live_[A-Za-z0-9]{10,}", "Revoke the key and load it from the environment"),
    Rule("Slack token", "error", r"\bxox[bpas]-[A-Za-z0-9-]{10,}", "Revoke the token and load it from the environment"),
    Rule("SendGrid API key", "error", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "Revoke the key and load it from the environment"),
    Rule("Twilio auth token", "error", r"(?i)twilio.{0,40}[\"'][0-9a-f]{32}[\"']", "Revoke the token and load it from the environment"),
    Rule("Azure Storage connection string", "error", r"DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=[A-Za-z0-9+/=]+", "Load the connection string from the environment"),
    Rule("Stripe live publishable key", "warning", r"\bpk_live_[A-Za-z0-9]{10,}", "Load the key from the environment"),
    Rule("GCP service account", "warning", r"\b[a-z0-9-]+@[a-z0-9-]+\.iam\.gserviceaccount\.com\b", "Load the account from configuration"),
    Rule("base64 secret in a sensitive variable", "warning", r"(?i)(?:secret|token|key|credential)\w*\s*[:=]\s*[\"'][A-Za-z0-9+/]{40,}={0,2}[\"']", "Load the secret from the environment"),
    Rule("API key assignment", "warning", r"(?i)\bapi[_-]?key\s*[:=]\s*[\"'][^\"']{8,}[\"']", "Load the key from the environment"),
    Rule("secret key assignment", "warning", r"(?i)\bsecret[_-]?key\s*[:=]\s*[\"'][^\"']{8,}[\"']", "Load the key from the environment"),
    Rule("hardcoded password", "warning", r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*[\"'][^\"']{4,}[\"']", "Load the password from the environment"),
)

#: File types that no rule reads.
BINARY = "png jpg jpeg gif bmp ico svg webp woff woff2 ttf eot otf zip gz tar bz2 xz 7z rar pdf doc docx xls xlsx ppt pptx exe dll so dylib o a pyc pyo class lock mp3 mp4 avi mov wav flac sqlite db"
MAGIC_SKIPPED = "lock sum mod toml json yaml yml xml html md txt csv tsv sql png jpg jpeg gif svg ico woff woff2 ttf eot otf mp3 mp4 avi mov wav pdf zip gz tar exe dll so dylib o a pyc class db sqlite"

#: Magic numbers. Literals that need no name, the literal with its delimiters, and lines that are skipped.
ALLOWED_NUMBERS = ("0", "1", "-1", "2", "0.0", "1.0", "0.5", "100", "1000")
NUMBER = r"(?:^|[(\[,=<>!+\-*/%&|^~\s])(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?:[)\]},;:\s]|$)"
NUMBER_SKIP = r"(?i)^\s*(?://|#|/\*|\*|<!--|$)|const\s+\w+\s*[=:]|\bdefine\b|\benum\b|\bversion\b|\bstatus_code\b|\bport\s*[=:]\s*\d+|\bstride\b|\boffset\b|\bpadding\b|^\s*\[|\#\["
NUMBER_HINT = "Replace the literal with a named constant (e.g. `const MAX_RETRIES: u32 = 3`)"


@dataclass(frozen=True)
class Catalogue:
    """The rules of one prefix with what they share. files: names read besides exts; comments: line starts that are skipped."""

    prefix: str
    rules: tuple[Rule, ...]
    message: str = ""
    exts: str = ""
    files: str = ""
    comments: tuple[str, ...] = ()
    module: str = "security"


CATALOGUES = (
    Catalogue("SEC", SEC, "Possible secret exposure: "),
    Catalogue("SQL", SQL, "Possible SQL injection: ", comments=("#", "//", "*", "--")),
    Catalogue("ML", ML, "ML pipeline issue: ", "py ipynb", comments=("#", "//", "*"), module="ml"),
    Catalogue("INFRA", INFRA, "Infrastructure issue: ", "tf tfvars yaml yml json", "Dockerfile", ("#", "//", "*"), "infra"),
    Catalogue("HOOKS", HOOKS, "", "tsx jsx ts js", comments=("//", "*", "/*", "{/*"), module="react"),
    Catalogue("ASYNC", ASYNC, "", "js ts jsx tsx py", comments=("//", "*", "/*", "#"), module="async_patterns"),
    Catalogue("DEP", DEP, "Dependency issue: ", "py ts js tsx jsx java", "package.json requirements.txt Cargo.toml pyproject.toml", ("#", "//", "*", "/*"), "dependency"),
    Catalogue("ERR", ERR, "", "py js ts jsx tsx rs go java kt cs", comments=("//", "*", "/*", "#"), module="error_handling"),
    Catalogue("CMD", CMD, "Possible command injection: "),
    Catalogue("DESER", DESER, "Insecure deserialization: "),
    Catalogue("SSRF", SSRF, "Possible SSRF: "),
    Catalogue("PATH", PATH, "Possible path traversal: "),
    Catalogue("LOG", LOG, "Sensitive data in log: "),
    Catalogue("ENDPT", ENDPT, "Hardcoded endpoint: ", module="hardcoded_endpoints"),
)


def pattern_of(rule: Rule) -> str:
    text = rule.pattern
    for part, value in PARTS.items():
        text = text.replace(part, value)
    return text
