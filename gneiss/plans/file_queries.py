"""Queries over source files and their lines, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import files as O
from gneiss.operators import lines as L
from gneiss.session import table


def _files(spark, d, *columns):
    """The last deliveries; only the columns named go through the shuffle."""
    files = table(spark, d, "codefile")
    return L.latest(files.select("file_id", "ingested_at", "raw_content", *columns) if columns else files)


def _rows(spark, d):
    return L.lines(_files(spark, d, "file_path"))


def _texts(spark, d):
    return L.arrays(_files(spark, d, "file_path"))


def _fs(spark, d):
    return O.functions(_files(spark, d, "file_path", "functions"))


def lines_security(spark, d):
    return L.hits(_rows(spark, d), L.SECURITY).groupBy("file_id", "rule", "severity").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def lines_quality(spark, d):
    return L.hits(_rows(spark, d), L.QUALITY).groupBy("rule", "language").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


def lines_governance(spark, d):
    return L.hits(_rows(spark, d), L.GOVERNANCE).groupBy("rule", "severity", "language").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


def lines_agent(spark, d):
    return L.hits(_rows(spark, d), L.AGENT, skip_comments=True).groupBy("file_id", "rule", "severity").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def lines_resilience(spark, d):
    return L.absent_signals(_rows(spark, d), L.RESILIENCE)


def lines_first_hits(spark, d):
    return L.first_per_file(L.hits(_rows(spark, d), L.SECURITY, skip_comments=True)).select("file_id", "rule", "line_no")


def lines_confirmed(spark, d):
    rows = _rows(spark, d)
    return L.confirmed(L.hits(rows, L.SECURITY).where("rule = 'sql_text'"), rows, r"\bload\w*\(").select("file_id", "line_no")


def lines_todo(spark, d):
    return L.todo_tags(_rows(spark, d))


def lines_commented_code(spark, d):
    return L.commented_code(_texts(spark, d))


def lines_deep_nesting(spark, d):
    return L.deep_nesting(_texts(spark, d))


def lines_magic_numbers(spark, d):
    return L.magic_numbers(_rows(spark, d))


def lines_io_in_loops(spark, d):
    return L.io_in_loops(_texts(spark, d))


def lines_docstrings(spark, d):
    return L.docstring_lines(_texts(spark, d)).groupBy("file_id").agg(F.count("*").alias("n"), F.sum("line_no").alias("line_sum"))


def lines_silent_except(spark, d):
    return L.silent_except(_texts(spark, d))


SIGNALS = {"timeout": r"\btimeout\b", "retry": r"\bretr(y|ies)\b", "cache": r"\bcache", "json_loads": r"json\.loads", "goroutine": r"\bgo func\b", "final_window": r"final_?[wW]indow"}


def lines_absent_signals(spark, d):
    return L.absent_signals(_rows(spark, d), SIGNALS)


def files_latest(spark, d):
    return _files(spark, d).select("file_id", "file_path", "ingested_at", F.md5(F.coalesce("raw_content", F.lit(""))).alias("digest"))


def files_long_functions(spark, d):
    return O.long_functions(_fs(spark, d))


def files_complexity(spark, d):
    return O.complexity(_fs(spark, d))


def files_cognitive(spark, d):
    return O.cognitive(_fs(spark, d))


def files_parameters(spark, d):
    return O.parameters(_fs(spark, d))


def files_naming(spark, d):
    return O.naming(_fs(spark, d))


def files_duplicates(spark, d):
    return O.duplicates(table(spark, d, "codefile"))


def files_same_heads(spark, d):
    return O.same_heads(_files(spark, d))


def files_same_names(spark, d):
    return O.same_name_groups(_files(spark, d))


def files_unwanted(spark, d):
    return O.unwanted(_files(spark, d))


def files_blank(spark, d):
    return O.blank(_files(spark, d, "file_path"))


def files_no_final_newline(spark, d):
    return O.no_final_newline(_files(spark, d, "file_path"))


def files_documentation(spark, d):
    return O.documentation(table(spark, d, "nodes"), table(spark, d, "chunks"))


def files_missing_modules(spark, d):
    return O.missing_modules(_files(spark, d))


def files_dead_imports(spark, d):
    return O.dead_imports(_files(spark, d, "file_path", "imports"))


def files_dead_functions(spark, d):
    return O.dead_functions(table(spark, d, "chunks"), table(spark, d, "edges"), table(spark, d, "nodes"))


def files_env_unreferenced(spark, d):
    return O.env_unreferenced(_files(spark, d, "file_path", "repo"))


def files_maturity(spark, d):
    return O.maturity(_files(spark, d, "file_path", "repo"))


def files_capabilities(spark, d):
    return O.capabilities(_files(spark, d, "repo"))


def files_capability_gaps(spark, d):
    return O.capability_gaps(O.capabilities(_files(spark, d, "repo")))


def files_capability_clusters(spark, d):
    """Clusters of signatures that share capabilities, with the files of each."""
    from gneiss.operators.graph import components
    from gneiss.session import cut

    found = cut(O.capabilities(_files(spark, d, "repo")))
    ids = components(O.signature_pairs(found)).where("id >= 0")  # without the sets, which have numbers below 0
    least = ids.groupBy("component").agg(F.min("id").alias("cluster"))
    clusters = ids.join(least, "component").select("id", "cluster")
    return found.join(clusters, found.signature == clusters.id, "left").select(F.coalesce("cluster", "signature").alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n_files"))


def files_architectures(spark, d):
    return O.architectures(table(spark, d, "codefile"))


def files_similar_heads(spark, d):
    """The other half of files_same_heads: files of one size whose heads are not the same but similar."""
    return O.similar_heads(_files(spark, d))


def files_languages(spark, d):
    """Files and lines by extension's language."""
    return _files(spark, d).groupBy(T.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"))


QUERIES = {
    f.__name__: f
    for f in (
        lines_security, lines_quality, lines_governance, lines_agent, lines_resilience, lines_first_hits, lines_confirmed, lines_todo, lines_commented_code, lines_deep_nesting, lines_magic_numbers, lines_io_in_loops, lines_docstrings, lines_silent_except,
        lines_absent_signals, files_latest, files_long_functions, files_complexity, files_cognitive, files_parameters, files_naming, files_duplicates, files_same_heads, files_similar_heads, files_same_names, files_unwanted, files_blank, files_no_final_newline, files_documentation,
        files_missing_modules, files_dead_imports, files_dead_functions, files_env_unreferenced, files_maturity, files_capabilities, files_capability_gaps, files_capability_clusters, files_architectures, files_languages,
    )
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_EXT = "lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))"
_LANG = "coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + f"}}, {_EXT})[1], '')"
_FILES = f"f AS (SELECT *, {_LANG} AS lang FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, raw_content DESC NULLS LAST) AS rn FROM codefile) WHERE rn = 1)"
_LINES = "a AS (SELECT file_id, file_path, lang AS language, string_split(replace(raw_content, chr(13), ''), chr(10)) AS s FROM f WHERE raw_content IS NOT NULL), l AS (SELECT file_id, file_path, language, unnest(s) AS line, generate_subscripts(s, 1) AS line_no FROM a)"
_W = f"WITH {_FILES}, {_LINES} "
_COMMENT = "(CASE WHEN language = 'python' THEN starts_with(ltrim(line), '#') ELSE starts_with(ltrim(line), '//') OR starts_with(ltrim(line), '*') OR starts_with(ltrim(line), '/*') END)"
_FUNCS = f"WITH {_FILES}, g AS (SELECT file_id, file_path, lang, string_split(replace(raw_content, chr(13), ''), chr(10)) AS s, unnest(functions) AS fn FROM f WHERE raw_content IS NOT NULL), fs AS (SELECT file_id, file_path, lang, fn.name AS name, fn.start_line AS start_line, fn.end_line - fn.start_line + 1 AS n_lines, array_to_string(s[greatest(1, fn.start_line):greatest(1, fn.start_line) + greatest(1, fn.end_line - fn.start_line + 1) - 1], chr(10)) AS code FROM g) "


def _hits(rules, where: str = "") -> str:
    parts = []
    for r in rules:
        test = f"regexp_matches(line, {_q(r.pattern)})"
        if r.but:
            test += f" AND NOT regexp_matches(line, {_q(r.but)})"
        if r.languages:
            test += " AND language IN (" + ", ".join(_q(x) for x in r.languages) + ")"
        parts.append(f"SELECT file_id, language, line_no, {_q(r.name)} AS rule, {_q(r.severity)} AS severity FROM l WHERE {test}{where}")
    return "h AS (" + " UNION ALL ".join(parts) + ")"


_FINE = "(value % 100 = 0 OR value IN (128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 201, 204, 301, 302, 304, 401, 403, 404, 409, 422, 429, 502, 503))"
_BITS = " + ".join(f"CASE WHEN regexp_matches(raw_content, {_q('(?m)' + p)}) THEN {1 << i} ELSE 0 END" for i, p in enumerate(O.CAPABILITIES.values()))
_CAPS = f"WITH RECURSIVE {_FILES}, c AS (SELECT file_id, repo, {_BITS} AS signature FROM f WHERE raw_content IS NOT NULL)"
_MATURE = ", ".join(f"max(regexp_matches(concat_ws(chr(10), file_path, raw_content), {_q('(?m)' + p)})::INT)" for p in O.MATURITY.values())

_D3, _S3 = "repeat(chr(34), 3)", "repeat(chr(39), 3)"
_MARK = "CASE WHEN a.q <> '' THEN a.q ELSE b.f END"
#: A fold over the lines of a file: which mark is open, how many lines are inside, and the sum of their numbers.
_DOCSTRINGS = f"""p AS (SELECT file_id, line_no, CASE WHEN instr(line, {_D3}) = 0 AND instr(line, {_S3}) = 0 THEN '' WHEN instr(line, {_S3}) = 0 OR instr(line, {_D3}) BETWEEN 1 AND instr(line, {_S3}) THEN 'd' ELSE 's' END AS f,
 (length(line) - length(replace(line, {_D3}, ''))) // 3 % 2 AS od, (length(line) - length(replace(line, {_S3}, ''))) // 3 % 2 AS os FROM l WHERE language = 'python'),
 g AS (SELECT file_id, list_prepend({{'q': '', 'f': '', 'od': 0, 'os': 0, 'i': 0, 'n': 0, 's': 0}}, list({{'q': '', 'f': f, 'od': od::INT, 'os': os::INT, 'i': line_no::INT, 'n': 0, 's': 0}} ORDER BY line_no)) AS s FROM p GROUP BY file_id),
 r AS (SELECT file_id, list_reduce(s, lambda a, b: {{'q': CASE WHEN ({_MARK}) = '' OR (CASE WHEN ({_MARK}) = 'd' THEN b.od ELSE b.os END) = 0 THEN a.q WHEN a.q = '' THEN b.f ELSE '' END, 'f': '', 'od': 0, 'os': 0, 'i': 0, 'n': a.n + CASE WHEN ({_MARK}) <> '' THEN 1 ELSE 0 END, 's': a.s + CASE WHEN ({_MARK}) <> '' THEN b.i ELSE 0 END}}) AS z FROM g)
 SELECT file_id, z.n::BIGINT AS n, z.s::BIGINT AS line_sum FROM r WHERE z.n > 0"""

SQL = {
    "lines_security": _W + "," + _hits(L.SECURITY) + " SELECT file_id, rule, severity, count(*) AS n, min(line_no) AS first_line FROM h GROUP BY ALL",
    "lines_quality": _W + "," + _hits(L.QUALITY) + " SELECT rule, language, count(*) AS n, count(DISTINCT file_id) AS n_files FROM h GROUP BY ALL",
    "lines_governance": _W + "," + _hits(L.GOVERNANCE) + " SELECT rule, severity, language, count(*) AS n, count(DISTINCT file_id) AS n_files FROM h GROUP BY ALL",
    "lines_agent": _W + "," + _hits(L.AGENT, f" AND NOT {_COMMENT}") + " SELECT file_id, rule, severity, count(*) AS n, min(line_no) AS first_line FROM h GROUP BY ALL",
    "lines_resilience": _W + ", s AS (" + " UNION ALL ".join(f"SELECT split_part(file_path, '/', 1) AS repo, {_q(n)} AS signal, max(regexp_matches(line, {_q(p)})::INT) AS seen FROM l GROUP BY 1" for n, p in L.RESILIENCE.items()) + ") SELECT repo, signal FROM s WHERE seen = 0",
    "lines_first_hits": _W + "," + _hits(L.SECURITY, f" AND NOT {_COMMENT}") + " SELECT file_id, rule, min(line_no) AS line_no FROM h GROUP BY ALL",
    "lines_confirmed": _W + "," + _hits(L.SECURITY) + r" SELECT file_id, line_no FROM h WHERE rule = 'sql_text' AND file_id IN (SELECT file_id FROM l WHERE regexp_matches(line, '\bload\w*\('))",
    "lines_todo": _W + r", t AS (SELECT file_id, line_no, regexp_extract(line, '^\s*(?:#+|//+|/?\*+)\s*(BUG|FIXME|HACK|TODO|XXX)\b', 1) AS tag FROM l) SELECT file_id, line_no, tag, CASE WHEN tag IN ('BUG','FIXME') THEN 'high' WHEN tag IN ('HACK','TODO') THEN 'medium' ELSE 'low' END AS severity FROM t WHERE tag <> ''",
    "lines_commented_code": _W + r", t AS (SELECT file_id, line_no, line_no - row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS g FROM l WHERE regexp_matches(line, '^\s*(#|//)\s*[\w.]+\s*(=|:=|\()|^\s*(#|//)\s*(return|if|for|while)\b.*')) SELECT file_id, min(line_no) AS first_line, count(*) AS n FROM t GROUP BY file_id, g HAVING count(*) >= 3",
    "lines_deep_nesting": _W + r", t AS (SELECT file_id, line_no, floor(length(replace(regexp_extract(line, '^([ \t]*)', 1), chr(9), '    ')) / (CASE WHEN language IN ('javascript','typescript') THEN 2 ELSE 4 END))::INT AS depth FROM l WHERE length(trim(line)) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k FROM t WHERE depth > 4) SELECT file_id, line_no, depth FROM k WHERE k <= 5",
    "lines_magic_numbers": _W + rf", t AS (SELECT file_id, unnest(regexp_extract_all(line, '(?:^|[^\w.])(\d{{3,9}})(?:$|[^\w.])', 1))::BIGINT AS value FROM l WHERE NOT {_COMMENT} AND NOT regexp_matches(line, '[\"''`]')) SELECT file_id, value, count(*) AS n FROM t WHERE NOT {_FINE} GROUP BY ALL",
    "lines_io_in_loops": _W + r", t AS (SELECT file_id, line_no, line, max(regexp_matches(line, '\b(open|fetch|publish|load)\w*\(')::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS io FROM l) SELECT file_id, line_no FROM t WHERE io = 1 AND regexp_matches(line, '^\s*(for|while)\b')",
    "lines_docstrings": f"WITH {_FILES}, {_LINES}, " + _DOCSTRINGS,
    "lines_silent_except": _W + r", t AS (SELECT file_id, line_no, line, lead(line) OVER (PARTITION BY file_id ORDER BY line_no) AS nx FROM l) SELECT file_id, line_no FROM t WHERE regexp_matches(line, '^\s*except\b.*:\s*$|catch\s*(\([^)]*\))?\s*\{\s*$') AND nx IS NOT NULL AND NOT regexp_matches(nx, '(?i)log|warn|error|raise|throw')",
    "lines_absent_signals": _W + ", s AS (" + " UNION ALL ".join(f"SELECT split_part(file_path, '/', 1) AS repo, {_q(n)} AS signal, max(regexp_matches(line, {_q(p)})::INT) AS seen FROM l GROUP BY 1" for n, p in SIGNALS.items()) + ") SELECT repo, signal FROM s WHERE seen = 0",
    "files_latest": f"WITH {_FILES} SELECT file_id, file_path, ingested_at, md5(coalesce(raw_content, '')) AS digest FROM f",
    "files_long_functions": _FUNCS + "SELECT file_id, name, start_line, n_lines, CASE WHEN n_lines > 300 THEN 'critical' WHEN n_lines > 200 THEN 'high' WHEN n_lines > 150 THEN 'medium' ELSE 'low' END AS severity FROM fs WHERE n_lines > 100",
    "files_complexity": _FUNCS + r", b AS (SELECT *, len(regexp_extract_all(code, '\b(?:if|elif|for|while|except|case|catch)\b')) + 1 AS branches FROM fs) SELECT file_id, name, start_line, branches, CASE WHEN branches > 30 THEN 'critical' WHEN branches > 20 THEN 'high' WHEN branches > 15 THEN 'medium' ELSE 'low' END AS severity FROM b WHERE branches > 10",
    "files_cognitive": _FUNCS
    + r""", w AS (SELECT file_id, name, start_line, list_prepend({'w': '', 'n': 0, 'd': 0}, list_transform(regexp_extract_all(code, '\b(?:if|for|while|except|catch|else|and|or|return)\b|&&|\|\|'), lambda x: {'w': x, 'n': 0, 'd': 0})) AS s FROM fs),
 r AS (SELECT file_id, name, start_line, -(len(list_filter(s, lambda x: x.w = 'return')) > 0)::INT + list_reduce(s, lambda a, b: {'w': '', 'n': a.n + CASE WHEN b.w IN ('if','for','while','except','catch') THEN 1 + a.d ELSE 1 END, 'd': a.d + CASE WHEN b.w IN ('if','for','while','except','catch') THEN 1 ELSE 0 END}).n AS load FROM w) SELECT file_id, name, start_line, load FROM r WHERE load >= 15""",
    "files_parameters": _FUNCS + r", b AS (SELECT *, regexp_extract(code, '\(([^()]*)\)', 1) AS p FROM fs), c AS (SELECT *, CASE WHEN trim(p) = '' THEN 0 ELSE len(regexp_extract_all(p, ',')) + 1 END AS n FROM b) SELECT file_id, name, start_line, n FROM c WHERE n > 8",
    "files_naming": _FUNCS + "SELECT DISTINCT file_id, name, lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')) AS suggestion FROM fs WHERE lang = 'python' AND regexp_matches(name, '[A-Z]')",
    "files_duplicates": "SELECT digest, count(*) AS n, min(file_id) AS first_id FROM (SELECT DISTINCT file_id, md5(raw_content) AS digest FROM codefile WHERE trim(raw_content) <> '') GROUP BY digest HAVING count(*) > 1",
    "files_same_heads": f"WITH {_FILES} SELECT length(raw_content) AS size, md5(array_to_string(string_split(replace(raw_content, chr(13), ''), chr(10))[1:100], chr(10))) AS digest, count(*) AS n, min(file_path) AS first_path FROM f WHERE trim(raw_content) <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "files_same_names": f"WITH {_FILES} SELECT regexp_extract(file_path, '([^/]*)$', 1) AS name, count(DISTINCT file_path) AS n FROM f GROUP BY 1 HAVING count(DISTINCT file_path) > 1",
    "files_unwanted": f"WITH {_FILES}, k AS (SELECT repo, raw_content, CASE " + " ".join(f"WHEN regexp_matches(file_path, {_q(p)}) THEN {_q(n)}" for n, p in O.UNWANTED.items()) + " END AS kind FROM f) SELECT repo, kind, count(*) AS n_files, sum(coalesce(length(raw_content), 0)) AS size FROM k WHERE kind IS NOT NULL GROUP BY 1, 2",
    "files_blank": _W + r", m AS (SELECT file_id, max((trim(line) <> '' AND NOT regexp_matches(line, '^\s*(#|//|\*|/\*|import\b|from\b|package\b)'))::INT) AS meaning FROM l GROUP BY 1), k AS (SELECT f.file_id, CASE WHEN raw_content = '' THEN 'empty' WHEN regexp_replace(raw_content, '\s', '', 'g') = '' THEN 'blank' WHEN meaning = 0 THEN 'shell' END AS kind FROM f JOIN m USING (file_id)) SELECT * FROM k WHERE kind IS NOT NULL",
    "files_no_final_newline": f"WITH {_FILES} SELECT file_id FROM f WHERE raw_content <> '' AND NOT ends_with(raw_content, chr(10))",
    "files_documentation": "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS rn FROM chunks) WHERE rn = 1 AND lower(chunk_type) IN ('function','method')) SELECT regexp_replace(file_path, '/?[^/]*$', '') AS folder, count(*) AS n_functions, sum((trim(coalesce(docstring, '')) <> '')::INT) AS n_documented, round(avg((trim(coalesce(docstring, '')) <> '')::INT), 4) AS share FROM c GROUP BY 1",
    "files_missing_modules": f"WITH {_FILES}, i AS (SELECT file_id, file_path, unnest(imports) AS i FROM f), r AS (SELECT DISTINCT file_id, file_path, regexp_extract(i, '^(?:\\./|\\.\\./)*([A-Za-z_@][\\w-]*)', 1) AS root FROM i), p AS (SELECT unnest(string_split(file_path, '/')) AS root FROM codefile UNION SELECT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[A-Za-z0-9]+$', '') FROM codefile) SELECT root, count(*) AS n_files, min(file_path) AS first_file FROM r WHERE root <> '' AND root NOT IN ("
    + ", ".join(_q(x) for x in O.STANDARD)
    + ") AND root NOT IN (SELECT root FROM p) GROUP BY root",
    "files_dead_imports": f"WITH {_FILES}, i AS (SELECT file_id, raw_content, regexp_extract(unnest(imports), '(\\w+)$', 1) AS binding FROM f WHERE raw_content IS NOT NULL AND lang = 'python') SELECT DISTINCT file_id, binding FROM i WHERE binding <> '' AND NOT list_contains(regexp_extract_all(regexp_replace(raw_content, '(?m)^\\s*(?:import|from)\\b.*$', '', 'g'), '\\w+'), binding)",
    "files_dead_functions": r"""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS rn FROM chunks) WHERE rn = 1), o AS (SELECT chunk_id, code, regexp_extract(name, '([^.]*)$', 1) AS own FROM c WHERE lower(trim(chunk_type)) IN ('function','method')), t AS (SELECT own, unnest(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS name FROM o)
 SELECT DISTINCT name FROM chunks WHERE lower(chunk_type) = 'function' AND name NOT IN (SELECT name FROM t WHERE name <> own) AND name NOT IN (SELECT n.name FROM edges e JOIN nodes n ON e.target = n.id WHERE e.type IN ('CALLS','REFERENCES') AND e.source <> e.target)""",
    "files_env_unreferenced": _W + r""", v AS (SELECT DISTINCT split_part(file_path, '/', 1) AS repo, regexp_extract(line, '^\s*(?:export\s+)?([A-Z][A-Z0-9_]*)\s*=', 1) AS variable FROM l WHERE file_path LIKE '%.env'),
 u AS (SELECT DISTINCT repo, unnest(regexp_extract_all(raw_content, '[A-Z][A-Z0-9_]+')) AS variable FROM f WHERE raw_content IS NOT NULL AND NOT file_path LIKE '%.env') SELECT v.repo, v.variable FROM v LEFT JOIN u USING (repo, variable) WHERE v.variable <> '' AND u.variable IS NULL""",
    "files_maturity": f"WITH {_FILES}, m AS (SELECT repo, list_sum([{_MATURE}])::INT AS n_passed FROM f GROUP BY repo) SELECT repo, n_passed, round(n_passed / {len(O.MATURITY)} * 100, 1) AS score, CASE WHEN n_passed / {len(O.MATURITY)} >= 0.9 THEN 'A' WHEN n_passed / {len(O.MATURITY)} >= 0.75 THEN 'B' WHEN n_passed / {len(O.MATURITY)} >= 0.6 THEN 'C' WHEN n_passed / {len(O.MATURITY)} >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM m",
    "files_capabilities": _CAPS + " SELECT * FROM c",
    "files_capability_gaps": _CAPS + ", e AS (SELECT repo, unnest([" + ", ".join(_q(n) for n in O.CAPABILITIES) + f"]) AS capability, unnest(range(0, {len(O.CAPABILITIES)})) AS i, signature FROM c), g AS (SELECT repo, capability, round(avg((signature >> i) & 1), 4) AS adoption FROM e GROUP BY 1, 2) SELECT * FROM g WHERE adoption > 0 AND adoption < 0.6",
    "files_capability_clusters": _CAPS + ", s AS (SELECT DISTINCT signature FROM c), p AS (SELECT x.signature AS a, y.signature AS b FROM s x, s y WHERE x.signature <> y.signature AND bit_count((x.signature & y.signature)::INT) >= 5 AND x.signature & y.signature & 9265 <> 0), r AS (SELECT signature AS a, signature AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a), k AS (SELECT a, min(b) AS cluster FROM r GROUP BY a) SELECT cluster, count(*) AS n_files FROM c JOIN k ON c.signature = k.a GROUP BY 1",
    "files_architectures": "WITH f AS (SELECT DISTINCT repo, file_path FROM codefile), h AS (" + " UNION ALL ".join(f"SELECT repo, {_q(n)} AS architecture FROM f WHERE regexp_matches(file_path, {_q(p)})" for n, p in O.ARCHITECTURES.items()) + "), g AS (SELECT repo, architecture, count(*) AS n FROM h GROUP BY ALL) SELECT repo, max_by(architecture, (n, architecture)) AS architecture, max(n) AS n_hits, round(max(n) / sum(n), 4) AS confidence FROM g GROUP BY repo",
    "files_languages": f"WITH {_FILES} SELECT lang AS language, count(*) AS n_files, sum(n_lines) AS n_lines FROM f GROUP BY 1",
}
