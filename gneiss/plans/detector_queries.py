"""Queries of the checks that join files, chunks, packages and documents, with SQL written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import agentscan as A
from gneiss.operators import dependencies as D
from gneiss.operators import detectors as X
from gneiss.operators import files as O
from gneiss.operators import findings as N
from gneiss.operators import graph as G
from gneiss.operators import lines as L
from gneiss.operators import maturity as M
from gneiss.plans.change_queries import _AFFECTED, ADVISORIES
from gneiss.plans.file_queries import _COMMENT, _FILES, _FUNCS, _LINES, _files, _fs, _hits, _rows, _texts
from gneiss.plans.graph_queries import _BASE
from gneiss.session import table


def simplify_large_functions(spark, d):
    return X.large_functions(_fs(spark, d))


def simplify_large_classes(spark, d):
    return X.large_classes(table(spark, d, "chunks"))


def simplify_dead_classes(spark, d):
    return X.dead_classes(_files(spark, d, "file_path"), table(spark, d, "chunks"))


def simplify_replaceable(spark, d):
    return X.replaceable_imports(_narrow(spark, d), {**X.REPLACEABLE, "fmt": "log", "pathlib": "os.path", "./": "a package"})


def simplify_thin_abstractions(spark, d):
    return X.thin_abstractions(table(spark, d, "chunks"))


def simplify_thin_wrappers(spark, d):
    return X.thin_wrappers(table(spark, d, "chunks"))


def simplify_savings(spark, d):
    return X.by_savings(_fs(spark, d), table(spark, d, "chunks"))


def _narrow(spark, d):
    """The last deliveries without their texts."""
    return L.latest(table(spark, d, "codefile").drop("raw_content"))


def sca_unpinned_imports(spark, d):
    return X.unpinned_imports(_narrow(spark, d))


def _packages(spark, d):
    return D.lock_packages(_files(spark, d, "repo", "file_path"))


def sca_deprecated(spark, d):
    names = {"tinyglyph-token0": "glyphs", "oakframe-whitelist1": "frames", **X.DEPRECATED}
    return X.deprecated(_packages(spark, d).select("repo", "package").distinct(), names)


def sca_runtime_installs(spark, d):
    return X.runtime_installs(_rows(spark, d))


def sca_gated(spark, d):
    files = _files(spark, d, "repo", "file_path")
    found = D.affected(D.lock_packages(files), ADVISORIES).select("repo", "package", "advisory", "severity").distinct()
    return X.gated(found, files, {"ADV-2": r"(?i)velumparse\.load", "ADV-1": "def "})


OSV = '{"vulns":[{"id":"G-1","aliases":["X-1","CVE-2024-1"],"summary":"a","database_specific":{"severity":"MODERATE"},"affected":[{"ranges":[{"events":[{"introduced":"0"},{"fixed":"1.2"}]}]}]},{"id":"G-2","aliases":[],"summary":"b"}]}'


def sca_osv(spark, d):
    """Advisories from a service's answer, for every package of a lock file."""
    return X.osv_advisories(_packages(spark, d).select("package").distinct().withColumn("answer", F.lit(OSV))).groupBy("advisory", "severity", "summary", "fixed").agg(F.count("*").alias("n_packages"))


def sca_drift(spark, d):
    files = _files(spark, d, "repo", "file_path", "imports")
    return X.dependency_drift(files, D.lock_packages(files))


def gov_settings_secrets(spark, d):
    return X.settings_secrets(_files(spark, d, "file_path"))


def gov_document_secrets(spark, d):
    return X.document_secrets(table(spark, d, "documents"))


def gov_secrets_written(spark, d):
    return X.secrets_written(_texts(spark, d))


_AREAS = {"interface": ("web", "app", "api", "handlers"), "logic": ("service", "pipeline", "jobs", "domain", "core"), "data": ("storage", "adapters"), "support": ("lib", "pkg", "internal", "tools")}


def _area(module):
    folder = F.split(module, "/").getItem(1)
    names = F.create_map(*[F.lit(x) for area, folders in _AREAS.items() for f in folders for x in (f, area)])
    return F.coalesce(names[folder], F.lit("other"))


def gov_architecture(spark, d):
    return X.disallowed(G.module_arcs(table(spark, d, "nodes"), table(spark, d, "edges")), _area)


def gov_mutual(spark, d):
    return X.mutual(G.module_arcs(table(spark, d, "nodes"), table(spark, d, "edges")))


def gov_credential_lines(spark, d):
    return X.credential_lines(_rows(spark, d))


def gov_undated_statistics(spark, d):
    return X.undated_statistics(table(spark, d, "documents"))


def blind_undocumented_folders(spark, d):
    return X.undocumented_folders(_narrow(spark, d), table(spark, d, "documents"))


def blind_unindexed(spark, d):
    return X.unindexed(_narrow(spark, d), table(spark, d, "nodes"))


def junk_orphans(spark, d):
    return X.orphans(L.latest(table(spark, d, "codefile")))


def resources_missing_paths(spark, d):
    return X.missing_paths(_rows(spark, d), _narrow(spark, d))


def findings_reverified(spark, d):
    return X.reverified(table(spark, d, "findings"), _files(spark, d, "file_path"))


def flow_broken_contracts(spark, d):
    return X.broken_contracts(_rows(spark, d))


def code_go_functions(spark, d):
    return X.go_functions(_rows(spark, d))


def code_projects(spark, d):
    return X.projects(_narrow(spark, d))


def findings_typed_whitelist(spark, d):
    entries = [("prefix", "amber-"), ("suffix", ".json"), ("contains", "/vendor/"), ("exact", "none")]
    return X.typed_whitelist(N.distinct_findings(table(spark, d, "findings")), "file_path", entries).select("id", "file_path")


def search_by_file(spark, d):
    return X.chunks_of_file(table(spark, d, "chunks"), "/rules/")


def prompts_governance(spark, d):
    return X.prompt_governance(table(spark, d, "documents"))


def maturity_checks(spark, d):
    return M.checks(_files(spark, d, "repo", "file_path"))


def maturity_scores(spark, d):
    return M.scores(M.checks(_files(spark, d, "repo", "file_path")))


def agent_findings(spark, d):
    """The agent rules in context: what is left after suppression, with the severity that the context gives."""
    return A.findings(_texts(spark, d)).select("file_id", "line_no", "rule", "severity", "why")


def agent_fates(spark, d):
    return A.fates(_texts(spark, d))


def risks_with_models(spark, d):
    return X.model_risks(_rows(spark, d), L.AGENT)


QUERIES = {
    f.__name__: f
    for f in (
        simplify_large_functions, simplify_large_classes, simplify_dead_classes, simplify_replaceable, simplify_thin_abstractions, simplify_thin_wrappers, simplify_savings, sca_unpinned_imports, sca_deprecated, sca_runtime_installs, sca_gated, sca_osv, sca_drift,
        gov_settings_secrets, gov_document_secrets, gov_secrets_written, gov_architecture, gov_mutual, gov_credential_lines, gov_undated_statistics, blind_undocumented_folders, blind_unindexed, junk_orphans, resources_missing_paths, findings_reverified, flow_broken_contracts,
        code_go_functions, code_projects, findings_typed_whitelist, search_by_file, prompts_governance, maturity_checks, maturity_scores, agent_findings, agent_fates, risks_with_models,
    )
}

_W = f"WITH {_FILES}, {_LINES} "
_F = f"WITH {_FILES}"
_LOCKS = "k AS (SELECT repo, file_path, unnest(json_keys(raw_content, '$.packages')) AS package, raw_content FROM f WHERE raw_content IS NOT NULL AND regexp_matches(file_path, '\\.json$') AND contains(raw_content, '\"packages\"') AND json_valid(raw_content)), p AS (SELECT repo, file_path, package, json_extract_string(raw_content, '$.packages.\"' || package || '\".version') AS version FROM k)"
_CLASSES = "c AS (SELECT DISTINCT chunk_id, name, code, end_line - start_line + 1 AS n_lines FROM chunks WHERE lower(trim(chunk_type)) = 'class')"
_STD = "('os', 're', 'sys', 'json', 'typing', 'logging', 'pathlib', 'log', 'fmt', 'strings', 'time', 'java', 'base64', 'errors', 'context')"
_ROOTS = "i AS (SELECT file_id, repo, file_path, lang, unnest(imports) AS i FROM f), r AS (SELECT DISTINCT file_id, repo, file_path, lang, regexp_extract(i, '^(?:\\./|\\.\\./)*([A-Za-z_@][\\w-]*)', 1) AS root FROM i)"
_SETS = r"regexp_matches(line, '(?i)(password|passwd|secret|token|api_?key)\w*[\"'']?\s*[:=]\s*[\"'']?([^\s\"''#,{}$<]{8,})') AND NOT regexp_matches(line, '(?i)changeme|your[_-]|example|placeholder|dummy|\*{3,}|<[a-z_ ]+>|token_?budget')"
_AREA = "coalesce(map_extract(MAP {'web': 'interface', 'app': 'interface', 'api': 'interface', 'handlers': 'interface', 'service': 'logic', 'pipeline': 'logic', 'jobs': 'logic', 'domain': 'logic', 'core': 'logic', 'storage': 'data', 'adapters': 'data', 'lib': 'support', 'pkg': 'support', 'internal': 'support', 'tools': 'support'}, split_part(%s, '/', 2))[1], 'other')"
_KEYS = "password|passwd|pwd|secret|token|api_?key|access_key|private_key"

_P, _T = "coalesce(file_path, '')", "coalesce(raw_content, '')"
#: name, category, what its absence counts as, and the test of a file
_CHECKS = (
    ("MAT-TEST-01", "testing", "fail", rf"regexp_matches({_T}, '(?m)\bimport (unittest|pytest)\b|\bfrom unittest\b|\"testing\"|org\.junit|\bdescribe\(')"),
    ("MAT-TEST-02", "testing", "fail", rf"regexp_matches({_P}, '(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.(py|go)$|\.(test|spec)\.[jt]s$')"),
    ("MAT-TEST-03", "testing", "warn", rf"regexp_matches({_T}, 'pytest-cov|\bcoverage\b|\bnyc\b|jacoco')"),
    ("MAT-CI-01", "cicd", "fail", rf"regexp_matches({_P}, '(^|/)\.github/workflows/[^/]*\.ya?ml$|(^|/)\.gitlab-ci\.yml$|(^|/)Jenkinsfile$')"),
    ("MAT-CI-02", "cicd", "warn", f"regexp_matches({_P}, '(^|/)(Dockerfile|Containerfile)$')"),
    ("MAT-CI-03", "cicd", "warn", rf"regexp_matches({_P}, '(^|/)(Makefile|justfile|Taskfile\.ya?ml)$')"),
    ("MAT-MON-01", "monitoring", "fail", rf"(regexp_matches({_P}, '(^|/)(logging\.conf|log_config\.ya?ml)$') OR regexp_matches({_T}, '\blogging\.(basicConfig|getLogger|config)|\bloguru\b|\bstructlog\b|\blogger\.\w+\('))"),
    ("MAT-MON-02", "monitoring", "warn", rf"regexp_matches({_T}, '(?i)\bsentry')"),
    ("MAT-MON-03", "monitoring", "fail", rf"regexp_matches({_T}, '[\"'']/(health|healthz|ready|ping)[\"'']|\bdef (health|healthz|health_check|ready|liveness)\b')"),
    ("MAT-CFG-01", "config", "fail", rf"(regexp_matches({_P}, '(^|/)[^/]*\.env(\.\w+)?$') OR regexp_matches({_T}, '\bload_dotenv\b|\bdotenv\b'))"),
    ("MAT-CFG-02", "config", "warn", rf"regexp_matches({_P}, '\.env\.(example|template|sample)$')"),
    ("MAT-ERR-01", "error_handling", "fail", rf"regexp_matches({_T}, '(?m)exception_handler|errorhandler|register_error_handler|process_exception|@ControllerAdvice|\bcatch\s*\(|^\s*except\b')"),
    ("MAT-DEP-01", "deps", "fail", rf"regexp_matches({_P}, '(^|/)(requirements[\w.-]*\.txt|pyproject\.toml|package\.json|Pipfile|go\.mod)$')"),
    ("MAT-DEP-02", "deps", "warn", rf"regexp_matches({_P}, '(^|/)(Pipfile\.lock|poetry\.lock|package-lock\.json|yarn\.lock|go\.sum)$|lock\.json$')"),
    ("MAT-QLY-01", "quality", "warn", rf"(regexp_matches({_P}, '(^|/)(mypy\.ini|tsconfig\.json)$') OR regexp_matches({_T}, '\bmypy\b'))"),
    ("MAT-QLY-02", "quality", "warn", rf"(regexp_matches({_P}, '(^|/)(\.prettierrc\w*|ruff\.toml)$') OR regexp_matches({_T}, '\b(ruff|black|gofmt|prettier)\b'))"),
    ("MAT-QLY-03", "quality", "warn", rf"regexp_matches({_P}, '(^|/)\.pre-commit-config\.yaml$')"),
    ("MAT-DOC-02", "docs", "warn", rf"(regexp_matches({_P}, '(?i)(^|/)(openapi|swagger)\.(json|ya?ml)$') OR regexp_matches({_T}, 'docs_url|FastAPI\('))"),
)
_MATURE = f"{_F}, m AS (" + " UNION ALL ".join(f"SELECT repo, '{n}' AS name, '{c}' AS category, CASE WHEN bool_or({t}) THEN 'pass' ELSE '{s}' END AS status FROM f GROUP BY repo" for n, c, s, t in _CHECKS) + rf""" UNION ALL
 SELECT repo, 'MAT-CFG-03', 'config', CASE WHEN bool_or(regexp_matches({_T}, '(?i)(api_key|api_secret|password|secret|token)\s*[:=]\s*[\"'']\w{{10,}}')) THEN 'fail' ELSE 'pass' END FROM f GROUP BY repo UNION ALL
 SELECT repo, 'MAT-CFG-04', 'config', CASE WHEN bool_or(regexp_matches({_P}, '(^|/)\.gitignore$') AND contains({_T}, '.env') AND contains({_T}, '__pycache__')) THEN 'pass' WHEN bool_or(regexp_matches({_P}, '(^|/)\.gitignore$')) THEN 'warn' ELSE 'fail' END FROM f GROUP BY repo UNION ALL
 SELECT repo, 'MAT-DOC-01', 'docs', CASE WHEN max(CASE WHEN regexp_matches({_P}, '(?i)(^|/)readme\.(md|txt|rst)$') THEN length({_T}) ELSE 0 END) > 500 THEN 'pass' WHEN bool_or(regexp_matches({_P}, '(?i)(^|/)readme\.(md|txt|rst)$')) THEN 'warn' ELSE 'fail' END FROM f GROUP BY repo)"""

SQL = {
    "simplify_large_functions": _FUNCS + "SELECT file_id, name, start_line, n_lines, CASE WHEN n_lines > 200 THEN 'critical' WHEN n_lines > 120 THEN 'high' ELSE 'medium' END AS severity, n_lines - 40 AS savings FROM fs WHERE n_lines > 80",
    "simplify_large_classes": f"WITH {_CLASSES} SELECT chunk_id, name, n_lines, CASE WHEN n_lines > 1000 THEN 'critical' WHEN n_lines > 800 THEN 'high' ELSE 'medium' END AS severity, n_lines - 200 AS savings FROM c WHERE n_lines > 500",
    "simplify_dead_classes": f"{_F}, {_CLASSES}, w AS (SELECT unnest(regexp_extract_all(raw_content, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM f WHERE raw_content IS NOT NULL), g AS (SELECT name, count(*) AS n FROM w GROUP BY name) SELECT DISTINCT c.name, coalesce(n, 0) AS n_references FROM c LEFT JOIN g USING (name) WHERE coalesce(n, 0) <= 1",
    "simplify_replaceable": f"{_F}, t AS (SELECT unnest(['dateutil','arrow','pendulum','orjson','ujson','toolz','typing_extensions','loguru','requests','regex','pytest','click','typer','celery','SQLAlchemy','pandas','lxml','fmt','pathlib','./']) AS library, unnest(['datetime','datetime','datetime','json','json','functools','typing','logging','urllib.request','re','unittest','argparse','argparse','concurrent.futures','sqlite3','csv','xml.etree','log','os.path','a package']) AS standard), i AS (SELECT file_id, repo, unnest(imports) AS i FROM f) SELECT repo, library, standard, count(DISTINCT file_id) AS n_files FROM i JOIN t ON contains(i, library) GROUP BY ALL",
    "simplify_thin_abstractions": rf"WITH {_CLASSES} SELECT DISTINCT chunk_id, name, n_lines FROM c WHERE n_lines < 30 AND regexp_matches(lower(name), 'base|abstract|interface|protocol') AND regexp_matches(code, '(?m)^\s*(?:export\s+|public\s+|abstract\s+)*class\s+\w+\s*(?:\(\s*\w|extends\b|implements\b)')",
    "simplify_thin_wrappers": "WITH c AS (SELECT DISTINCT chunk_id, name, list_filter(list_transform(string_split(replace(code, chr(13), ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT starts_with(x, '#')) AS s FROM chunks WHERE lower(trim(chunk_type)) IN ('function','method')) SELECT DISTINCT chunk_id, name FROM c WHERE len(s) BETWEEN 1 AND 3 AND starts_with(s[-1], 'return ') AND contains(s[-1], '(') AND len(list_filter(s, lambda x: NOT (starts_with(x, 'return') OR starts_with(x, 'def ') OR starts_with(x, repeat(chr(34), 3))))) = 0",
    "simplify_savings": _FUNCS + f", {_CLASSES}, u AS (SELECT 'function' AS kind, name, n_lines - 40 AS savings FROM fs WHERE n_lines > 80 UNION ALL SELECT 'class', name, n_lines - 200 FROM c WHERE n_lines > 500) SELECT * FROM u ORDER BY savings DESC, kind, name LIMIT 50",
    "sca_unpinned_imports": rf"{_F}, {_ROOTS}, p AS (SELECT repo, unnest(string_split(file_path, '/')) AS root FROM f UNION SELECT repo, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', '') FROM f), h AS (SELECT DISTINCT repo FROM f WHERE regexp_matches(file_path, '(^|/)(requirements[\w.-]*\.txt|pyproject\.toml|package\.json|go\.mod|setup\.py)$')) SELECT repo, root AS package, min(file_path) AS first_file FROM r WHERE lang = 'python' AND root <> '' AND root NOT IN {_STD} AND NOT starts_with(root, '_') AND repo NOT IN (SELECT repo FROM h) AND (repo, root) NOT IN (SELECT (repo, root) FROM p) GROUP BY 1, 2",
    "sca_deprecated": f"{_F}, {_LOCKS}, t AS (SELECT unnest(['tinyglyph-token0', 'oakframe-whitelist1', 'dgrijalva/jwt-go']) AS k, unnest(['glyphs', 'frames', 'github.com/golang-jwt/jwt']) AS migration) SELECT DISTINCT repo, package, migration FROM p JOIN t ON regexp_replace(package, '/v[0-9]+$', '') = k OR ends_with(regexp_replace(package, '/v[0-9]+$', ''), '/' || k)",
    "sca_runtime_installs": _W + r"SELECT file_id, min(line_no) AS line_no FROM l WHERE regexp_matches(line, '(?:os\.system|subprocess\.\w+|Popen|check_call)\(.*\bpip[3]?\b.*\binstall\b|pip\.main\(|exec\w*\(.*\bnpm (?:install|i)\b') GROUP BY file_id",
    "sca_gated": _AFFECTED + f", f0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) AS rn FROM codefile) WHERE rn = 1), s AS (SELECT repo, max(regexp_matches(raw_content, '(?i)velumparse\\.load')::INT) AS g2, max(contains(raw_content, 'def ')::INT) AS g1 FROM f0 WHERE raw_content IS NOT NULL GROUP BY repo) SELECT DISTINCT a.repo, package, advisory, CASE WHEN advisory = 'ADV-1' AND coalesce(g1, 0) = 0 OR advisory = 'ADV-2' AND coalesce(g2, 0) = 0 THEN 'low' ELSE severity END AS severity FROM a LEFT JOIN s ON a.repo = s.repo",
    "sca_osv": f"{_F}, {_LOCKS}, n AS (SELECT count(DISTINCT package) AS n FROM p) SELECT 'CVE-2024-1' AS advisory, 'medium' AS severity, 'a' AS summary, '1.2' AS fixed, n AS n_packages FROM n WHERE n > 0 UNION ALL SELECT 'G-2', 'medium', 'b', NULL, n FROM n WHERE n > 0",
    "sca_drift": rf"{_F}, {_LOCKS}, {_ROOTS}, e AS (SELECT DISTINCT repo, lower(regexp_extract(package, '([A-Za-z][\w-]*?)(?:-[a-z_]+\d*)?$', 1)) AS package FROM p), u AS (SELECT DISTINCT repo, lower(root) AS package FROM r WHERE root <> '' AND root NOT IN {_STD} AND repo IN (SELECT repo FROM e)) SELECT *, 'declared' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM u) UNION ALL SELECT *, 'imported' FROM (SELECT * FROM u EXCEPT SELECT * FROM e)",
    "gov_settings_secrets": _W + rf"SELECT file_id, line_no FROM l WHERE regexp_matches(lower(file_path), '\.(env|ya?ml|json|toml|cfg|ini|conf)$') AND {_SETS}",
    "gov_document_secrets": rf"WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT * FROM (SELECT doc_id, sum(({_SETS})::INT) AS n_secrets, sum(regexp_matches(line, '(?i)\b(skip|disable|bypass|ignore)\b.{{0,40}}\b(check|review|scan|gate|whitelist|verification)')::INT) AS n_bypass FROM l GROUP BY doc_id) WHERE n_secrets + n_bypass > 0",
    "gov_secrets_written": _W + r", t AS (SELECT *, max(regexp_matches(line, '\b(api_key|API_KEY|secret|SECRET_KEY|token|password)\b')::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS s FROM l) SELECT file_id, line_no FROM t WHERE regexp_matches(line, 'f[\"''].*\{[^}]*(key|secret|token|password)[^}]*\}') AND regexp_matches(line, 'write|\.env|dump') OR regexp_matches(line, '^\s*(async )?def\s+\w*(save|write)\w*(env|key|secret|credential)') AND s = 1",
    "gov_architecture": _BASE + f", x AS (SELECT DISTINCT a, b, {_AREA % 'a'} AS from_layer, {_AREA % 'b'} AS to_layer FROM arcs WHERE a <> b) SELECT * FROM x WHERE from_layer <> 'other' AND to_layer <> 'other' AND from_layer <> to_layer AND NOT (from_layer = 'interface' OR from_layer = 'logic' AND to_layer IN ('data', 'support') OR from_layer = 'data' AND to_layer = 'support')",
    "gov_mutual": _BASE + "SELECT DISTINCT x.a, x.b FROM arcs x JOIN arcs y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b",
    "gov_credential_lines": _W
    + rf""", n AS (SELECT *, regexp_extract(line, '(?i)(?:{_KEYS})\w*[\"'']?\s*[:=]+\s*[\"''`]([^\"''`]*)[\"''`]', 1) AS v FROM l WHERE regexp_matches(line, '(?i)(password|passwd|pwd|secret|token|api_?key|access_key|private_key)\w*[\"'']?\s*[:=]')) SELECT reason, count(*) AS n FROM (SELECT CASE
 WHEN regexp_matches(line, '(?i)\br[\"''].*({_KEYS})') THEN 'pattern' WHEN regexp_matches(line, '\bdef\s+\w+\s*\(|\blambda\s') THEN 'parameter' WHEN regexp_matches(line, 'environ|getenv|process\.env') THEN 'environment' WHEN regexp_matches(line, '\b(cfg|config|settings)\.\w+') THEN 'settings'
 WHEN regexp_matches(line, '\b(api_key|token|secret|password|pwd)\s*=\s*(api_key|token|secret|password|pwd)\b') THEN 'passed on' WHEN starts_with(ltrim(line), '#') OR starts_with(ltrim(line), '//') THEN 'comment' WHEN regexp_matches(line, '^\s*\w+\s*:\s*(Optional|str|Dict|List|Tuple|Any|Union)\b[^\"''`]*$') THEN 'annotation'
 WHEN starts_with(ltrim(line), repeat(chr(34), 3)) THEN 'docstring' WHEN regexp_matches(line, '(?i)\b({_KEYS})\s*=\s*[A-Za-z_]\w*\s*[,)]?\s*$') THEN 'variable' WHEN regexp_matches(line, '(?i)\b({_KEYS})\s*=\s*\w+\.\w+') THEN 'attribute'
 WHEN regexp_matches(v, '(?i)your[_-]|xxx+|changeme|replace|example|placeholder|dummy|sample|todo|fixme|demo|fake|mock') THEN 'placeholder' WHEN regexp_matches(v, '^([a-z]+|[A-Z]+|\d+)$') THEN 'plain value' ELSE '' END AS reason FROM n) GROUP BY reason""",
    "gov_undated_statistics": r"WITH h AS (SELECT source, regexp_extract(text, '(?s)(\d%.{0,40}?\b(?:19|20)\d\d\b)', 1) AS claim FROM documents WHERE contains(text, '%')), y AS (SELECT *, regexp_extract(claim, '\b((?:19|20)\d\d)\b', 1) AS year FROM h) SELECT source, count(DISTINCT year) AS n_years, count(*) AS n_claims FROM y WHERE year <> '' AND NOT regexp_matches(claim, '(?i)as of|retrieved|source') GROUP BY source HAVING count(DISTINCT year) >= 2",
    "blind_undocumented_folders": rf"{_F}, g AS (SELECT regexp_replace(file_path, '/?[^/]*$', '') AS folder, count(DISTINCT file_path) AS n_files FROM f GROUP BY 1), w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(regexp_replace(file_path, '\.[A-Za-z0-9]+$', '')), '[/_. -]+')) AS word FROM documents WHERE file_path IS NOT NULL) SELECT folder, n_files, CASE WHEN n_files >= 5 THEN 'high' ELSE 'medium' END AS severity FROM g WHERE n_files >= 2 AND lower(regexp_extract(folder, '([^/]*)$', 1)) NOT IN (SELECT word FROM w)",
    "blind_unindexed": f"{_F} SELECT file_path, len(functions) AS n_functions FROM f WHERE len(functions) > 0 AND file_path NOT IN (SELECT regexp_replace(regexp_replace(file_path, '\\\\+', '/', 'g'), '^(?:\\./|/)+', '') FROM nodes WHERE file_path IS NOT NULL)",
    "junk_orphans": rf"{_F}, n AS (SELECT max(scanned_at) AS m FROM f), s AS (SELECT DISTINCT repo, regexp_extract(i, '([\w-]+)$', 1) AS stem FROM (SELECT repo, unnest(imports) AS i FROM f)), k AS (SELECT repo, file_path, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', '') AS stem, date_diff('day', scanned_at::DATE, m::DATE)::INT AS age_days FROM f, n WHERE lang <> '' AND NOT regexp_matches(coalesce(raw_content, ''), '__main__|func main\(|static void main')) SELECT file_path, age_days FROM k WHERE age_days > 30 AND stem NOT IN ('__init__','main','index','setup') AND (repo, stem) NOT IN (SELECT (repo, stem) FROM s)",
    "resources_missing_paths": _W + r", t AS (SELECT file_id, line_no, regexp_extract(line, 'sys\.path\.(?:insert|append)\(\s*(?:\d+\s*,\s*)?[\"'']([^\"'']+)[\"'']', 1) AS path FROM l), d AS (SELECT DISTINCT regexp_replace(file_path, '/?[^/]*$', '') AS d FROM f), e AS (SELECT unnest(string_split(d, '/')) AS folder FROM d UNION SELECT d FROM d) SELECT file_id, line_no, path FROM t WHERE path <> '' AND regexp_replace(path, '^(?:\.{1,2}/)+|/+$', '', 'g') NOT IN (SELECT folder FROM e)",
    "findings_reverified": f"{_F}, g AS (SELECT DISTINCT id, file_path, line FROM findings), j AS (SELECT g.line, f.file_path AS p, string_split(replace(coalesce(raw_content, ''), chr(13), ''), chr(10)) AS s FROM g LEFT JOIN f ON g.file_path = f.file_path) SELECT CASE WHEN p IS NULL THEN 'missing' WHEN line IS NULL OR line < 1 OR line > len(s) THEN 'beyond' WHEN trim(s[line]) = '' THEN 'blank' ELSE 'present' END AS status, count(*) AS n FROM j GROUP BY 1",
    "flow_broken_contracts": _W + r", t AS (SELECT file_id, language IN ('javascript','typescript') AS front, regexp_extract(line, '[\"''`](?:https?://[\w.-]+)?(/[a-z][\w/-]*)[\"''`]', 1) AS path FROM l) SELECT path, count(DISTINCT file_id) AS n_files FROM t WHERE path <> '' AND front AND path NOT IN (SELECT path FROM t WHERE NOT front) GROUP BY path",
    "code_go_functions": _W + r"SELECT file_id, line_no, regexp_extract(line, '^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(', 2) AS name, regexp_extract(line, '^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(', 1) AS receiver FROM l WHERE language = 'go' AND regexp_matches(line, '^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(')",
    "code_projects": f"{_F} SELECT repo, count(*) AS n_files, sum(n_lines) AS n_lines, sum(coalesce(len(functions), 0)) AS n_functions, count(DISTINCT CASE WHEN lang <> '' THEN lang END) AS n_languages, sum(coalesce(len(imports), 0)) AS n_imports FROM f GROUP BY repo",
    "findings_typed_whitelist": "SELECT DISTINCT id, file_path FROM findings WHERE NOT (starts_with(lower(coalesce(file_path, '')), 'amber-') OR ends_with(lower(coalesce(file_path, '')), '.json') OR contains(lower(coalesce(file_path, '')), '/vendor/') OR lower(coalesce(file_path, '')) = 'none')",
    "search_by_file": "SELECT DISTINCT chunk_id, file_path, chunk_type, name, start_line, end_line FROM chunks WHERE contains(lower(file_path), '/rules/') ORDER BY file_path, start_line, chunk_id LIMIT 100",
    "prompts_governance": r"""SELECT doc_id, 'plain credentials' AS label, 'critical' AS severity FROM documents WHERE regexp_matches(text, '(?i)(api[_ ]?key|password|token)\s*(is|=|:)\s*\S{8,}') UNION ALL SELECT doc_id, 'bypassing review', 'high' FROM documents WHERE regexp_matches(text, '(?i)(skip|bypass|without) (the )?(review|approval|gate)')
 UNION ALL SELECT doc_id, 'hiding risks', 'high' FROM documents WHERE regexp_matches(text, '(?i)(do not|don''t|never) (mention|report|flag)|hide the') UNION ALL SELECT doc_id, 'foreign content', 'medium' FROM documents WHERE regexp_matches(text, '(?i)ignore (all |the )?(previous|above)|as an ai')""",
    "maturity_checks": _MATURE + " SELECT * FROM m",
    "maturity_scores": _MATURE + ", g AS (SELECT repo, sum((status = 'pass')::INT) AS n_passed, sum((status = 'warn')::INT) AS n_half, sum((status = 'fail')::INT) AS n_failed, count(*) AS n FROM m GROUP BY repo), h AS (SELECT *, floor((n_passed * 2 + n_half) * 50 / n)::INT AS score FROM g) SELECT repo, n_passed, n_half, n_failed, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM h",
    "risks_with_models": _W
    + ", "
    + _hits(L.AGENT, f" AND NOT {_COMMENT}")
    + rf""", c AS (SELECT file_id, CASE WHEN rule IN ('AGENT-SEC-01','AGENT-SEC-02','AGENT-SEC-03') THEN 'LLM01' WHEN rule IN ('AGENT-SEC-36','AGENT-SEC-37','AGENT-SEC-LMEXEC','AGENT-SEC-66') THEN 'LLM02' WHEN rule IN ('AGENT-SEC-04','AGENT-SEC-54','AGENT-SEC-58','AGENT-SEC-59') THEN 'LLM03' WHEN rule IN ('AGENT-SEC-10','AGENT-SEC-11','AGENT-SEC-12','AGENT-SEC-26','AGENT-SEC-70') THEN 'LLM04' WHEN rule IN ('AGENT-SEC-62','AGENT-SEC-DESER') THEN 'LLM05' WHEN rule IN ('AGENT-SEC-06','AGENT-SEC-07','AGENT-SEC-AUTH','AGENT-SEC-PT','AGENT-SEC-SSRF') THEN 'LLM07' WHEN rule IN ('AGENT-SEC-08','AGENT-SEC-16','AGENT-SEC-17') THEN 'LLM08' ELSE 'LLM06' END AS risk FROM h
 UNION ALL SELECT file_id, 'LLM09' FROM l WHERE NOT {_COMMENT} AND regexp_matches(line, '(?i)\b(eval|exec)\(\s*(response|answer|completion|llm\w*)|return\s+(response|answer|completion)\s*$') UNION ALL SELECT file_id, 'LLM10' FROM l WHERE NOT {_COMMENT} AND regexp_matches(line, '(?i)(model|weights)\w*\.(save|upload|push_to_hub|export)\w*\(|send_file\(.*\.(pt|onnx|safetensors)'))
 SELECT r.risk, count(c.file_id) AS n, count(DISTINCT c.file_id) AS n_files FROM (SELECT 'LLM' || lpad(unnest(range(1, 11))::VARCHAR, 2, '0') AS risk) r LEFT JOIN c ON c.risk = r.risk GROUP BY r.risk""",
}
