"""DuckDB SQL for the queries of reviewlake.queries, written apart from the operators it checks.

Line rules use the catalogue's pattern texts, which both engines' dialects accept.
"""

from __future__ import annotations

from reviewlake.operators import rule_catalog as C

EXT = "['py','js','tf','yaml','rs','java'][doc_id % 6 + 1]"
FILES = f"files AS (SELECT doc_id, 'src/' || coalesce(source, 'none') || '/d' || doc_id || '.' || {EXT} AS path, 'd' || doc_id || '.' || {EXT} AS file_name, {EXT} AS ext, text AS content FROM documents)"
LINES = f"""{FILES},
raw AS (SELECT path, file_name, ext, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n FROM (SELECT *, string_split_regex(content, '\\r?\\n') AS ls FROM files)),
lines AS (SELECT path, file_name, ext, line, line_no FROM raw WHERE NOT (line_no = n AND line = ''))"""
CUSTOM = f"""{LINES},
hit AS (SELECT *, CASE WHEN regexp_matches(line, '[Tt]oken') AND NOT contains(line, 'the') THEN 0
  WHEN ext IN ('py', 'js') AND regexp_matches(line, '^[A-Z][a-z]+ [a-z]+ [a-z]+\\.') THEN 1 WHEN regexp_matches(line, '[0-9]{{3}}') THEN 2 END AS rule FROM lines),
custom AS (SELECT 'CUSTOM' AS prefix, ['error','warning','info'][rule + 1] AS severity, ['token','short sentence','number'][rule + 1] AS message, path AS file,
  CAST(line_no AS INTEGER) AS line, CASE rule WHEN 0 THEN 'say so' END AS suggestion FROM hit WHERE rule IS NOT NULL),
ids AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY file, line, severity, message) AS n FROM custom),
numbered AS (SELECT *, prefix || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id FROM ids)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_sql() -> str:
    """All catalogues as CASE chains over lines of the six extensions."""
    parts = []
    for c in C.CATALOGUES:
        exts, files = set(c.exts.split()), set(c.files.split())
        keep = [f"ext IN ({', '.join(map(quoted, sorted(exts)))})"] if exts or files else ["true"]
        if c.comments:
            starts = " OR ".join(f"starts_with(ltrim(replace(line, chr(9), ' ')), {quoted(m)})" for m in c.comments)
            if c.prefix == "ERR":
                starts = f"({starts}) AND NOT starts_with(ltrim(replace(line, chr(9), ' ')), '#[')"
            keep.append(f"NOT ({starts})")
        cases = []
        for k, r in enumerate(c.rules):
            if r.files and not r.exts:
                continue  # no document is named so
            hit = [f"ext IN ({', '.join(map(quoted, r.exts.split()))})"] if r.exts else []
            hit.append(f"regexp_matches(line, {quoted(C.pattern_of(r))})")
            if r.reject:
                hit.append(f"NOT contains(line, {quoted(r.reject)})")
            if r.require:
                hit.append(f"contains(line, {quoted(r.require)})")
            if r.safe:
                cases.append(f"WHEN {' AND '.join([*hit, f'regexp_matches(line, {quoted(r.safe)})'])} THEN -1")
            cases.append(f"WHEN {' AND '.join(hit)} THEN {k}")
        names = "[" + ", ".join(quoted(c.message + r.name) for r in c.rules) + "]"
        severities = "[" + ", ".join(quoted(r.severity) for r in c.rules) + "]"
        parts.append(f"SELECT {quoted(c.prefix)} AS prefix, {severities}[rule + 1] AS severity, {names}[rule + 1] AS message, path AS file, CAST(line_no AS INTEGER) AS line FROM (SELECT *, CASE {' '.join(cases)} END AS rule FROM lines WHERE {' AND '.join(keep)}) WHERE rule >= 0")
    return f"WITH {LINES}\n" + "\nUNION ALL ".join(parts)


PYTHON = " + ".join(f"CAST(contains(t, {quoted(w)}) AS INT)" for w in ("if ", "elif ", "for ", "while ", " and ", " or ", "except", )) + " + CAST(starts_with(t, 'else:') AS INT)"
RUST = " + ".join(f"CAST(contains(t, {quoted(w)}) AS INT)" for w in ("if ", "} else {", "else if ", "for ", "while ", "loop {", "match ")) + " + " + " + ".join(f"(length(t) - length(replace(t, {quoted(m)}, ''))) // {len(m)}" for m in ("=>", "&&", "||", "?"))
OTHER = " + ".join(f"CAST(contains(t, {quoted(w)}) AS INT)" for w in ("if (", "if(", "else if (", "else if(", "} else {", "for (", "for(", "while (", "while(", "switch (", "switch(", "case ", "catch (", "catch(", "catch {")) + " + " + " + ".join(f"(length(t) - length(replace(t, {quoted(m)}, ''))) // {len(m)}" for m in ("&&", "||", "??", " ? "))

EDGES = """e AS (SELECT k AS from_id, CAST((k * 17 + 3) % ceil(n / 2) * 2 + 1 AS BIGINT) AS to_id, 'Calls' AS kind FROM (SELECT p_partkey AS k, count(*) OVER () AS n FROM part)
  UNION ALL SELECT k, CAST((k * 31 + 5) % ceil(n / 2) + 1 AS BIGINT), 'Calls' FROM (SELECT p_partkey AS k, count(*) OVER () AS n FROM part)
  UNION ALL SELECT k, CAST((k * 7 + 1) % ceil(n / 3) + 1 AS BIGINT), 'References' FROM (SELECT p_partkey AS k, count(*) OVER () AS n FROM part)
  UNION ALL SELECT k, (k * 3 + 2) % n + 1, 'Contains' FROM (SELECT p_partkey AS k, count(*) OVER () AS n FROM part))"""
NODES = """new AS (SELECT p_partkey AS id, ['Function','Class','Variable','Type','File'][p_partkey % 5 + 1] AS kind, p_name || '-' || p_partkey AS name,
  'mod' || (p_partkey % 7) || '/' || CASE WHEN p_partkey % 13 = 0 THEN 'test_' ELSE '' END || replace(p_brand, '#', '') || '.py' AS file_path, CAST(p_size AS INTEGER) AS line,
  p_partkey % 3 > 0 AS is_public, p_type AS t, CASE WHEN p_size % 2 = 0 THEN '0' END AS dflt, p_size > 25 AS constant, p_partkey % 17 = 0 AS typed FROM part)"""
#: Old nodes: keys of those there; what differs is told by the key of the new one.
OLD = "old AS (SELECT id, kind, name, file_path, line FROM new WHERE id % 19 <> 0 UNION ALL SELECT id + 10000000, kind, name || '-old', file_path, line FROM new WHERE id % 10 = 0)"
SIGNATURE = "kind = 'Function' AND ((id % 14 = 0 AND t <> 'other') OR (id % 6 = 0 AND coalesce(dflt, '') <> '1'))"
CHANGES = f"""{NODES}, {OLD}, changes AS (SELECT *, id % 19 <> 0 AS had, id % 4 = 0 AS moved, {SIGNATURE} AS signature, kind = 'Class' AND id % 21 = 1 AS lost FROM new),
changed AS (SELECT * FROM changes WHERE NOT had OR moved OR signature OR lost),
classified AS (SELECT id AS new_id, CASE WHEN had THEN id END AS old_id, CASE WHEN NOT had THEN 'Safe' WHEN typed THEN 'Breaking'
  WHEN kind = 'Function' THEN CASE WHEN id % 14 = 0 AND t <> 'other' THEN 'Breaking' WHEN id % 6 = 0 AND dflt IS NULL THEN 'PotentiallyBreaking' ELSE 'Safe' END
  WHEN kind = 'Class' THEN CASE WHEN lost THEN 'Breaking' ELSE 'Safe' END WHEN kind = 'Type' THEN 'Breaking' WHEN kind = 'Variable' AND constant THEN 'Breaking' ELSE 'Safe' END AS classification
  FROM changes WHERE NOT had OR moved OR signature OR lost OR typed)"""
REPORT = f"""RECURSIVE {EDGES}, {CHANGES},
calls AS (SELECT from_id, to_id FROM e WHERE kind = 'Calls'),
walk AS (SELECT new_id AS seed, new_id AS id, 0 AS d FROM classified UNION SELECT seed, from_id, d + 1 FROM walk JOIN calls ON to_id = id WHERE d < 3),
far AS (SELECT DISTINCT seed, id FROM walk WHERE id <> seed),
near AS (SELECT to_id AS seed, from_id AS id FROM calls JOIN classified ON new_id = to_id),
report AS (SELECT new_id, classification, (SELECT count(*) FROM near WHERE seed = new_id) AS n_direct, (SELECT count(*) FROM far WHERE seed = new_id) AS n_transitive FROM classified)"""
RUNS = """ev AS (SELECT floor(epoch(ts))::BIGINT // 3600 AS h, upper(substr(event_type, 1, 3)) AS prefix, CASE WHEN value > 80 THEN 'error' WHEN value > 40 THEN 'warning' ELSE 'info' END AS severity, event_id % 9 = 0 AS gone FROM events),
runs AS (SELECT 'run-' || h AS id, h * 3600 AS timestamp, count(*) FILTER (NOT gone AND severity = 'error') AS errors, count(*) FILTER (NOT gone AND severity = 'warning') AS warnings,
  count(*) FILTER (NOT gone AND severity = 'info') AS info, count(*) FILTER (gone) AS suppressed, count(*) FILTER (NOT gone) AS kept FROM ev GROUP BY h)"""
TRADE = "SELECT l_suppkey AS from_id, l_partkey AS to_id, CASE l_returnflag WHEN 'A' THEN 'Calls' WHEN 'N' THEN 'References' ELSE 'Imports' END AS kind FROM lineitem"
SIZES = """s AS (SELECT DISTINCT * FROM (SELECT CAST(p_size AS BIGINT) AS from_id, CAST(p_size // 5 * 5 + p_partkey % 5 AS BIGINT) AS to_id FROM part
  UNION ALL SELECT CAST(p_size AS BIGINT), CAST(p_size // 5 * 5 + 7 AS BIGINT) FROM part) WHERE from_id % 5 < 4)"""
#: What each line of queries.SAMPLES is told, by its number; the others nothing.
SAMPLE_FINDINGS = """(0, 'py', 'SQL', 'error', 'Possible SQL injection: f-string SQL in database call'), (1, 'py', 'CMD', 'error', 'Possible command injection: os.system() call'),
(2, 'py', 'DESER', 'error', 'Insecure deserialization: pickle.load() — arbitrary code execution on untrusted data'), (3, 'py', 'SSRF', 'error', 'Possible SSRF: requests call with f-string URL (interpolated)'),
(4, 'py', 'PATH', 'error', 'Possible path traversal: open() with f-string path (interpolated)'), (5, 'py', 'LOG', 'warning', 'Sensitive data in log: sensitive variable passed to Python logging call'),
(6, 'yaml', 'ENDPT', 'warning', 'Hardcoded endpoint: hardcoded private IP (10.x.x.x)'), (7, 'py', 'ML', 'error', 'ML pipeline issue: fit on test data (data leakage)'),
(8, 'tf', 'INFRA', 'error', 'Infrastructure issue: public S3 bucket ACL (exposes bucket to internet)'), (9, 'js', 'HOOKS', 'error', 'Hook inside condition'), (10, 'js', 'ASYNC', 'error', 'Async Promise executor'),
(11, 'py', 'DEP', 'warning', 'Dependency issue: wildcard import in Python (pollutes namespace)'), (12, 'py', 'ERR', 'warning', 'Bare except without exception type'), (13, 'yaml', 'SEC', 'error', 'Possible secret exposure: AWS access key'),
(2, 'py', 'ML', 'warning', 'ML pipeline issue: pickle for model serialization (insecure, non-portable)'), (16, 'py', 'ML', 'info', 'ML pipeline issue: train_test_split without stratify (imbalanced data risk)')"""
BRIEF = "prefix, severity, message, file, line"


def closure(start: int, kinds: str, forward: bool, depth: int | None) -> str:
    a, b = ("from_id", "to_id") if forward else ("to_id", "from_id")
    if depth is None:
        return f"WITH RECURSIVE {EDGES}, w AS (SELECT {start}::BIGINT AS id UNION SELECT {b} FROM w JOIN e ON {a} = id WHERE {kinds}) SELECT id FROM w WHERE id <> {start}"
    return f"WITH RECURSIVE {EDGES}, w AS (SELECT {start}::BIGINT AS id, 0 AS d UNION SELECT {b}, d + 1 FROM w JOIN e ON {a} = id WHERE {kinds} AND d < {depth}) SELECT id, CAST(min(d) AS INTEGER) AS depth FROM w WHERE id <> {start} GROUP BY id"


ORACLES: dict[str, str] = {
    "rules_first_match": rule_sql(),
    "rules_by_catalogue": f"""SELECT prefix, severity, message, 'lib/f' || doc_id || '.' || ext AS file, CAST(1 AS INTEGER) AS line FROM documents JOIN (VALUES {SAMPLE_FINDINGS}) v(k, ext, prefix, severity, message) ON doc_id % 19 = k""",
    "worse_changes": f"WITH {CHANGES} SELECT new_id, classification FROM classified WHERE classification IN ('Breaking', 'PotentiallyBreaking')",
    "store_reads": f"""WITH {EDGES}, {NODES} SELECT 'node_count' AS method, count(*) AS id FROM new UNION ALL SELECT 'node', id FROM new WHERE id = 5 UNION ALL SELECT 'find_nodes', id FROM new WHERE file_path = 'mod1/Brand11.py'
UNION ALL SELECT 'find_nodes_by_kind', id FROM new WHERE kind = 'Class' UNION ALL SELECT 'edges_from', to_id FROM e WHERE from_id = 3 UNION ALL SELECT 'edges_to', from_id FROM e WHERE to_id = 3 UNION ALL SELECT DISTINCT 'direct_dependents', from_id FROM e WHERE to_id = 5""",
    "dead_names": f"""WITH {FILES}, n AS (SELECT path, content, regexp_extract(content, '[a-z]{{3,}}') AS name FROM files WHERE content IS NOT NULL)
SELECT 'IMP' AS prefix, 'warning' AS severity, '`' || name || '` is imported but never used' AS message, path AS file, CAST(0 AS INTEGER) AS line, 'Remove the unused import of `' || name || '`' AS suggestion
FROM n WHERE name <> '' AND len(list_filter(string_split_regex(content, '[^A-Za-z0-9_]+'), lambda x: x = name)) <= 1""",
    "nesting_depth": f"""WITH {LINES}, c AS (SELECT path, line_no, translate(line, 'aeiou', '{{}}{{}}{{') AS line FROM lines), k AS (SELECT path, line_no, line FROM (SELECT *, ltrim(replace(line, chr(9), ' ')) AS t FROM c) WHERE NOT (starts_with(t, '//') OR starts_with(t, '*') OR starts_with(t, '/*')) AND len(line) > 0),
b AS (SELECT path, line_no, unnest(string_split(regexp_replace(line, '[^{{}}]+', '', 'g'), '')) AS ch, generate_subscripts(string_split(regexp_replace(line, '[^{{}}]+', '', 'g'), ''), 1) AS i FROM k),
s AS (SELECT path, line_no, i, sum(CASE ch WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no, i) AS s FROM b),
d AS (SELECT path, s - least(0, min(s) OVER (PARTITION BY path ORDER BY line_no, i)) AS d FROM s)
SELECT p.path, CAST(greatest(coalesce(max(d.d), 0) - 1, 0) AS INTEGER) AS depth FROM (SELECT DISTINCT path FROM lines) p LEFT JOIN d ON d.path = p.path GROUP BY p.path""",
    "scan_lines": f"WITH {LINES} SELECT path, line_no, length(line) AS n_chars FROM lines",
    "line_stats": f"WITH {LINES} SELECT ext, count(*) AS n_lines, count(*) FILTER (line <> '') AS n_filled, count(DISTINCT path) AS n_files FROM lines GROUP BY ext",
    "discovered_files": f"WITH {FILES} SELECT path, file_name, ext FROM files WHERE ext IN ('py', 'rs') AND NOT contains(path, '/src1/') AND NOT (ext = 'rs' AND starts_with(file_name, 'd1'))",
    "changed_contents": f"""WITH {FILES}, o AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE content END AS c, true AS there FROM files WHERE doc_id % 7 <> 0), n AS (SELECT path, content AS c, true AS there FROM files WHERE doc_id % 11 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.there IS NULL THEN 'deleted' WHEN o.there IS NULL THEN 'added' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE n.there IS NULL OR o.there IS NULL OR o.c <> n.c""",
    "magic_numbers": f"""WITH {LINES}, f AS (SELECT path, line_no, list_filter(regexp_extract_all(line, {quoted(C.NUMBER)}, 1), lambda x: x NOT IN ('0','1','-1','2','0.0','1.0','0.5','100','1000')) AS n FROM lines WHERE ext NOT IN ('yaml') AND NOT regexp_matches(line, {quoted(C.NUMBER_SKIP)}))
SELECT 'MAGIC' AS prefix, 'info' AS severity, 'Magic number(s): ' || array_to_string(list_filter(n, lambda x, i: i = 1 OR x <> n[i - 1]), ', ') || ' — consider extracting to a named constant' AS message, path AS file, CAST(line_no AS INTEGER) AS line FROM f WHERE len(n) > 0""",
    "custom_rules": f"WITH {CUSTOM} SELECT {BRIEF}, suggestion FROM custom",
    "finding_numbering": f"WITH {CUSTOM} SELECT id, file, line, message FROM numbered WHERE id <> 'CUSTOM-002'",
    "severity_summary": f"""WITH {CUSTOM}, s AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info FROM custom)
SELECT *, errors * 60 + warnings * 30 + info * 10 AS debt_minutes, errors > 0 OR warnings > 0 OR info > 3 AS failed FROM s""",
    "files_by_language": f"WITH {FILES} SELECT CASE ext WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'tf' THEN 'Terraform' WHEN 'yaml' THEN 'YAML' WHEN 'rs' THEN 'Rust' ELSE 'Java' END AS language, count(*) AS files FROM files GROUP BY ALL",
    "suppress_inline": f"WITH {CUSTOM} SELECT {BRIEF}, CASE WHEN line % 5 = 0 OR (line % 5 = 1 AND line > 1) THEN 'inline' ELSE '' END AS suppression_reason FROM custom",
    "suppress_path": f"WITH {CUSTOM} SELECT {BRIEF}, CASE WHEN regexp_matches(file, '^(.*/)?src1[^/]*/.*') THEN 'per-path rule: **/src1*/**' WHEN starts_with(file, 'src/src0/') THEN 'per-path rule: src/src0/*' ELSE '' END AS suppression_reason FROM custom",
    "suppress_baseline": f"WITH {CUSTOM}, b AS (SELECT DISTINCT file, message FROM custom WHERE line = 1) SELECT {BRIEF}, CASE WHEN (file, message) IN (SELECT (file, message) FROM b) THEN 'baseline' ELSE '' END AS suppression_reason FROM custom",
    "suppression_breakdown": f"""WITH {CUSTOM} SELECT reason, count(*) AS n FROM (SELECT 'inline' AS reason FROM custom WHERE line % 5 = 0 OR (line % 5 = 1 AND line > 1)
  UNION ALL SELECT 'per-path rule' FROM custom WHERE regexp_matches(file, '^(.*/)?src1[^/]*/.*') OR starts_with(file, 'src/src0/')) GROUP BY reason""",
    "diff_line_filter": f"WITH {CUSTOM} SELECT {BRIEF} FROM custom WHERE NOT contains(file, 'd1') AND (file LIKE '%.py' OR line <= 2)",
    "lookahead_pairs": f"""WITH {LINES}, m AS (SELECT path, line_no, contains(line, 'the') AS o, CASE WHEN regexp_matches(line, '[0-9]') THEN line_no END AS i FROM lines),
w AS (SELECT *, min(i) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS hit FROM m) SELECT path, hit AS line_no FROM w WHERE o AND hit IS NOT NULL""",
    "file_level_missing": f"WITH {LINES} SELECT path, min(line_no) FILTER (regexp_matches(line, '[0-9]{{2}}')) AS line_no FROM lines GROUP BY path HAVING count(*) FILTER (regexp_matches(line, '[0-9]{{2}}')) > 0 AND count(*) FILTER (contains(line, 'token')) = 0",
    "cyclomatic_counts": f"""WITH {LINES}, t AS (SELECT path, ext, trim(replace(replace(line, ' for ', ' for ( && '), chr(9), ' ')) AS t FROM lines)
SELECT path, CAST(1 + sum(CASE WHEN starts_with(t, '//') OR starts_with(t, '#') OR starts_with(t, '*') OR starts_with(t, '/*') THEN 0 WHEN ext = 'py' THEN {PYTHON} WHEN ext = 'rs' THEN {RUST} ELSE {OTHER} END) AS BIGINT) AS cyclomatic FROM t GROUP BY path""",
    "test_scope": f"""WITH {LINES}, t AS (SELECT path, line_no, max(line_no) OVER (PARTITION BY path) AS n, line FROM lines)
SELECT a.path, a.line_no FROM t a WHERE a.path LIKE '%.rs' AND (a.line_no % 4 = 2 OR a.line_no % 4 = 3 AND NOT regexp_matches(trim(replace(a.line, chr(9), ' ')), '^(//|\\*|/\\*|#)'))""",
    "toolchain_undeclared": f"""WITH {LINES}, c AS (SELECT path, line_no FROM lines WHERE contains(lower(line), 'the ') AND NOT starts_with(ltrim(replace(line, chr(9), ' ')), '#') AND NOT starts_with(ltrim(replace(line, chr(9), ' ')), '//'))
SELECT 'TOOL' AS prefix, 'warning' AS severity, '`the-tool` is invoked in CI/scripts but not declared in any manifest' AS message, path AS file, CAST(min(line_no) AS INTEGER) AS line FROM c GROUP BY path""",
    "ai_candidates": f"WITH {CUSTOM} SELECT {BRIEF} FROM custom WHERE severity IN ('error', 'warning') AND suggestion IS NULL",
    "direct_dependents": f"SELECT DISTINCT from_id AS id FROM ({TRADE}) WHERE to_id = 7",
    "dependencies": f"SELECT DISTINCT to_id AS id FROM ({TRADE}) WHERE from_id = 3",
    "by_edge_kind": f"SELECT DISTINCT to_id AS id FROM ({TRADE}) WHERE from_id = 3 AND kind = 'Imports'",
    "by_edge_kind_reverse": f"SELECT DISTINCT from_id AS id FROM ({TRADE}) WHERE to_id = 7 AND kind = 'Calls'",
    "transitive_dependents_d3": closure(5, "true", False, 3),
    "transitive_dependents_full": closure(5, "true", False, None),
    "transitive_callers_d3": closure(5, "kind = 'Calls'", False, 3),
    "transitive_dependencies_full": closure(5, "true", True, None),
    "simple_paths": f"""WITH RECURSIVE {SIZES}, w AS (SELECT [1::BIGINT] AS p UNION ALL SELECT list_append(p, to_id) FROM w JOIN s ON from_id = p[-1] WHERE NOT list_contains(p, to_id) AND len(p) < 7 AND p[-1] <> 12)
SELECT array_to_string(p, '>') AS path FROM w WHERE p[-1] = 12""",
    "import_cycles_scc": f"""WITH RECURSIVE {SIZES}, r AS (SELECT from_id AS a, to_id AS b FROM s WHERE from_id <> to_id UNION SELECT a, to_id FROM r JOIN s ON from_id = b WHERE from_id <> to_id)
SELECT x.a AS id, least(x.a, min(x.b)) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""",
    "weak_components": f"""WITH RECURSIVE {EDGES}, u AS (SELECT from_id AS a, to_id AS b FROM e WHERE kind = 'References' AND from_id <> to_id UNION SELECT to_id, from_id FROM e WHERE kind = 'References' AND from_id <> to_id),
w(a, m) USING KEY (a) AS (SELECT DISTINCT a, a AS m FROM u UNION SELECT u.b, min(w.m) FROM w JOIN u ON u.a = w.a JOIN recurring.w AS o ON o.a = u.b WHERE w.m < o.m GROUP BY u.b)
SELECT a AS id, m AS component FROM w""",
    "unused_exports": f"""WITH {EDGES}, {NODES} SELECT 'DEAD' AS prefix, CASE WHEN is_public THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN is_public THEN 'Exported `' || name || '` (' || kind || ') has no callers or references' ELSE 'Private `' || name || '` (' || kind || ') is unreachable — no callers in this codebase' END AS message, file_path AS file, line
FROM new WHERE kind IN ('Function','Class','Variable') AND NOT contains(file_path, '/test_') AND id IN (SELECT to_id FROM e JOIN new f ON f.id = from_id WHERE e.kind = 'Contains' AND f.kind = 'File') AND id NOT IN (SELECT to_id FROM e WHERE kind IN ('Calls','References'))""",
    "changed_nodes": f"WITH {CHANGES} SELECT id AS new_id, CASE WHEN had THEN id END AS old_id FROM changed",
    "classify_changes": f"WITH {CHANGES} SELECT * FROM classified",
    "impact_report": f"WITH {REPORT} SELECT * FROM report",
    "impact_summary": f"""WITH {REPORT} SELECT count(*) AS total_changes, count(*) FILTER (classification = 'Breaking') AS breaking, count(*) FILTER (classification = 'PotentiallyBreaking') AS potentially_breaking,
count(*) FILTER (classification = 'Safe') AS safe, CAST(sum(n_direct + n_transitive) AS BIGINT) AS total_affected, (SELECT count(DISTINCT id) FROM (SELECT id FROM near UNION ALL SELECT id FROM far)) AS distinct_affected FROM report""",
    "blast_radius": f"""WITH {REPORT}, reach AS (SELECT seed, id FROM near UNION SELECT seed, id FROM far),
x AS (SELECT c.new_id, coalesce(max(CASE WHEN split_part(a.file_path, '/', 1) <> split_part(b.file_path, '/', 1) THEN 1 ELSE 0 END), 0) AS crosses FROM classified c JOIN new a ON a.id = c.new_id LEFT JOIN reach r ON r.seed = c.new_id LEFT JOIN new b ON b.id = r.id GROUP BY c.new_id),
s AS (SELECT count(*) AS directly_modified, CAST(sum(crosses) AS BIGINT) AS module_crossings, (SELECT count(DISTINCT id) FROM reach) AS affected_dependents FROM x)
SELECT *, CASE WHEN affected_dependents > 50 OR (affected_dependents > 20 AND module_crossings > 0) THEN 'HIGH' WHEN affected_dependents > 5 OR module_crossings > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM s""",
    "diff_dead_code": f"WITH {EDGES}, {NODES} SELECT id, name, kind, file_path FROM new WHERE id % 19 = 0 AND kind IN ('Function','Class','Variable') AND NOT contains(file_path, '/test_') AND id NOT IN (SELECT to_id FROM e WHERE kind IN ('Calls','References'))",
    "deletion_orphans": f"""WITH {EDGES}, {NODES} SELECT id, name, kind FROM new WHERE kind IN ('Function','Class','Variable') AND id % 19 <> 0
AND id IN (SELECT to_id FROM e JOIN new d ON d.id = from_id WHERE from_id % 10 = 0 AND d.kind IN ('Function','Class','Variable') AND e.kind IN ('Calls','References')) AND id NOT IN (SELECT to_id FROM e WHERE from_id % 10 <> 0 AND kind IN ('Calls','References'))""",
    "snapshot_counts": f"WITH {EDGES}, {NODES}, {OLD} SELECT 'new' AS name, (SELECT count(*) FROM new) AS node_count, (SELECT count(*) FROM e) AS edge_count UNION ALL SELECT 'old', (SELECT count(*) FROM old), 0",
    "snapshot_roundtrip": f"WITH {NODES} SELECT id, kind, name, file_path, line, is_public FROM new",
    "resolve_imports": f"""WITH {FILES}, w AS (SELECT doc_id AS import_id, path AS file_path, CASE WHEN doc_id % 2 = 0 THEN 'src/' || coalesce((SELECT source FROM documents d WHERE d.doc_id = f.doc_id), 'none') || '/d' || (doc_id + 20) ELSE 'src/src1/d' || (doc_id - doc_id % 20 + 21) END AS base FROM files f)
SELECT import_id, file_path, files.path FROM w JOIN files ON files.path = base || '.' || files.ext AND files.ext IN ('js', 'py', 'rs', 'java')""",
    "ordered_candidates": f"""WITH {FILES} SELECT a.doc_id, b.path FROM files a JOIN files b ON b.doc_id = a.doc_id + 20 AND b.ext IN ('rs','py','java','js') AND regexp_replace(a.path, '/[^/]*$', '') = regexp_replace(b.path, '/[^/]*$', '')""",
    "run_listing": f"WITH {RUNS} SELECT id, timestamp, kept FROM runs",
    "clean_rate": f"WITH {RUNS} SELECT count(*) AS runs, count(*) FILTER (errors = 0 AND warnings = 0) AS clean_runs, round(100.0 * count(*) FILTER (errors = 0 AND warnings = 0) / count(*), 1) AS clean_percent FROM runs",
    "severity_avgs": f"WITH {RUNS} SELECT round(avg(errors), 2) AS avg_errors, round(avg(warnings), 2) AS avg_warnings, round(avg(info), 2) AS avg_info, round(avg(suppressed), 2) AS avg_suppressed FROM runs",
    "week_trend": f"WITH {RUNS}, a AS (SELECT greatest(1705104000 - timestamp, 0) AS age, errors + warnings + info AS n FROM runs) SELECT CAST(coalesce(sum(n) FILTER (age < 604800), 0) AS BIGINT) AS this_week, CAST(coalesce(sum(n) FILTER (age >= 604800 AND age < 1209600), 0) AS BIGINT) AS last_week FROM a",
    "noisiest_rules": f"WITH {RUNS} SELECT prefix, count(*) AS n FROM ev WHERE NOT gone GROUP BY prefix ORDER BY n DESC, prefix LIMIT 5",
    "report_trend": f"WITH {RUNS} SELECT id, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, timestamp, CAST(errors AS INTEGER) AS errors, CAST(warnings AS INTEGER) AS warnings, CAST(info AS INTEGER) AS info FROM runs ORDER BY timestamp DESC, id DESC LIMIT 14",
    "sarif_rules": f"WITH {RUNS} SELECT prefix, dense_rank() OVER (ORDER BY prefix) - 1 AS rule_index FROM ev GROUP BY prefix",
    "annotations": f"WITH {CUSTOM} SELECT '::' || CASE severity WHEN 'info' THEN 'notice' ELSE severity END || ' file=' || file || ',line=' || line || ',title=' || id || '::' || message AS value FROM numbered",
    "comment_dedup": f"WITH {CUSTOM} SELECT id, file, line FROM numbered WHERE line <> 1",
}
