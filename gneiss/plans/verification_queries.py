"""Queries that join texts, folders, flows and parsed facts with the graph, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import facts as A
from gneiss.operators import findings as O
from gneiss.operators import graph as G
from gneiss.operators import lines as L
from gneiss.operators import verification as V
from gneiss.plans.file_queries import _LINES, _FILES, _COMMENT, _q
from gneiss.plans.finding_queries import _F, _RANK
from gneiss.plans.graph_queries import _ARCS, _BASE, _CLEAN, _LAYER, _UNIQUE
from gneiss.session import cut, table


def _facts(spark, d):
    return A.python_facts(table(spark, d, "codefile"))


def facts_counts(spark, d):
    return _facts(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


def facts_unknown_keywords(spark, d):
    return A.unknown_keywords(cut(_facts(spark, d)))


def facts_unused_helpers(spark, d):
    return A.unused_helpers(cut(_facts(spark, d)))


def facts_undocumented_classes(spark, d):
    return A.undocumented_classes(_facts(spark, d))


def facts_silent_handlers(spark, d):
    return A.silent_handlers(_facts(spark, d))


def facts_undocumented_functions(spark, d):
    return A.undocumented_functions(_facts(spark, d))


def facts_single_letters(spark, d):
    return A.single_letters(_facts(spark, d))


def facts_class_names(spark, d):
    return A.class_names(_facts(spark, d))


def facts_blocking_calls(spark, d):
    return A.blocking_calls(_facts(spark, d))


def facts_shadowed_parameters(spark, d):
    return A.shadowed_parameters(_facts(spark, d))


def facts_missing_arguments(spark, d):
    return A.missing_arguments(cut(_facts(spark, d)))


def verify_flow(spark, d):
    steps = [V.Step(s) for s in ("load_", "trim", "publish", "no such step")]
    return V.verify_flow(table(spark, d, "nodes"), table(spark, d, "edges"), "trim_raw", steps)


def verify_modules(spark, d):
    nodes, edges = table(spark, d, "nodes"), table(spark, d, "edges")
    return V.verify_modules(nodes, G.closure(edges, nodes.where("type = 'function' and name like 'trim%'").select("id"), 8, types=("CALLS",)))


def verify_citations(spark, d):
    return V.citations(table(spark, d, "documents"), table(spark, d, "codefile"))


def verify_orphan_tests(spark, d):
    return V.orphan_tests(table(spark, d, "codefile"))


def verify_scopes(spark, d):
    return V.scopes(table(spark, d, "codefile"))


def verify_confidence(spark, d):
    return V.confidence(table(spark, d, "codefile"), table(spark, d, "chunks"))


def verify_in_try(spark, d):
    return V.in_try(L.arrays(L.latest(table(spark, d, "codefile").select("file_id", "file_path", "raw_content", "ingested_at"))), r"\bload\w*\(")


def verify_line_kinds(spark, d):
    return V.line_kinds(L.lines(L.latest(table(spark, d, "codefile").select("file_id", "file_path", "raw_content", "ingested_at"))))


def verify_representation(spark, d):
    return V.representation(table(spark, d, "nodes"), table(spark, d, "edges"))


def verify_topology(spark, d):
    arcs = G.module_arcs(table(spark, d, "nodes"), table(spark, d, "edges"), types=("IMPORTS",))
    return V.topological_layers(cut(arcs.select("a", "b")))


def verify_ledger(spark, d):
    return V.ledger(O.distinct_findings(table(spark, d, "findings")), "deps", "parcel")


QUERIES = {
    f.__name__: f
    for f in (
        facts_counts, facts_unknown_keywords, facts_unused_helpers, facts_undocumented_classes, facts_silent_handlers, facts_undocumented_functions, facts_single_letters, facts_class_names, facts_blocking_calls, facts_shadowed_parameters, facts_missing_arguments, verify_flow, verify_modules, verify_citations, verify_orphan_tests, verify_scopes,
        verify_confidence, verify_in_try, verify_line_kinds, verify_representation, verify_topology, verify_ledger,
    )
}

_W = f"WITH {_FILES}, {_LINES} "
_TAIL = lambda c: f"array_to_string(string_split({c}, '/')[-2:], '/')"

SQL = {
    "verify_flow": f"""WITH RECURSIVE {_UNIQUE}, fn AS (SELECT id, name FROM u WHERE type IN ('function','method')), e0 AS (SELECT min_by(id, (CASE WHEN name = 'trim_raw' THEN 0 ELSE 1 END, id)) AS id FROM fn WHERE contains(lower(name), 'trim_raw') HAVING count(*) > 0),
 r AS (SELECT id, 0 AS depth FROM e0 UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.source = r.id AND e.type = 'CALLS' WHERE r.depth < 8), k AS (SELECT id, min(depth) AS depth FROM r GROUP BY id),
 st AS (SELECT unnest([1, 2, 3, 4]) AS step_no, unnest(['load_', 'trim', 'publish', 'no such step']) AS step), h AS (SELECT step_no, step, name, depth, row_number() OVER (PARTITION BY step_no ORDER BY depth IS NULL, depth NULLS FIRST, name) AS rn FROM st JOIN fn ON contains(lower(name), step) LEFT JOIN k USING (id)),
 b AS (SELECT st.step_no, st.step, h.name AS symbol, h.depth FROM st LEFT JOIN h ON st.step_no = h.step_no AND rn = 1) SELECT step_no, step, symbol, depth, CASE WHEN symbol IS NULL THEN 'missing' WHEN depth IS NULL THEN 'outside' WHEN coalesce(max(depth) OVER (ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) <= depth THEN 'ordered' ELSE 'in_pipeline' END AS status FROM b""",
    "verify_modules": f"""WITH RECURSIVE {_UNIQUE}, r AS (SELECT id, 0 AS depth FROM nodes WHERE type = 'function' AND name LIKE 'trim%' UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.source = r.id AND e.type = 'CALLS' WHERE r.depth < 8),
 g AS (SELECT regexp_replace({_CLEAN}, '/?[^/]*$', '') AS folder, count(*) AS n, sum((id IN (SELECT id FROM r))::INT) AS n_reached FROM u WHERE type IN ('function','method') GROUP BY 1) SELECT *, CASE WHEN n_reached = 0 THEN 'unverified' WHEN n_reached = n THEN 'confirmed' ELSE 'partial' END AS status FROM g""",
    "verify_citations": f"WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`([\\w./-]+\\.[a-z]+)`', 1)) AS cited FROM documents) SELECT doc_id, cited, {_TAIL('cited')} IN (SELECT {_TAIL('file_path')} FROM codefile) AS known FROM c",
    "verify_orphan_tests": r"WITH f AS (SELECT DISTINCT repo, file_path, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', '') AS stem FROM codefile), t AS (SELECT *, regexp_replace(stem, '^test_|_test$|\.(test|spec)$', '') AS subject FROM f WHERE regexp_matches(stem, '^(test_(\w+)|(\w+)_test|(\w+)\.(test|spec))$')) SELECT file_path, subject FROM t WHERE (repo, subject) NOT IN (SELECT (repo, stem) FROM f)",
    "verify_scopes": "WITH g AS (SELECT regexp_replace(file_path, '/?[^/]*$', '') AS folder, count(DISTINCT file_path) AS n_files FROM codefile GROUP BY 1) SELECT folder, CASE " + " ".join(f"WHEN regexp_matches(folder, {_q(p)}) THEN {_q(n)}" for n, p in V.SCOPES) + " ELSE 'source' END AS scope, n_files FROM g",
    "verify_confidence": """WITH f AS (SELECT DISTINCT file_path FROM codefile), p AS (SELECT array_to_string(string_split(file_path, '/')[1:2], '/') AS module, avg((file_path IN (SELECT file_path FROM chunks))::INT) AS parsed FROM f GROUP BY 1),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS rn FROM chunks) WHERE rn = 1 AND lower(chunk_type) IN ('function','method','class')), d AS (SELECT array_to_string(string_split(file_path, '/')[1:2], '/') AS module, avg((trim(coalesce(docstring, '')) <> '')::INT) AS documented FROM c GROUP BY 1),
 b AS (SELECT module, round(coalesce(documented, 0.0::DOUBLE), 4) AS documented, round(parsed, 4) AS parsed, round(0.5::DOUBLE * coalesce(documented, 0.0::DOUBLE) + 0.5::DOUBLE * parsed, 4) AS confidence FROM p LEFT JOIN d USING (module)) SELECT *, CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM b""",
    "verify_in_try": _W + r", x AS (SELECT file_id, line_no, line, length(regexp_extract(line, '^(\s*)', 1)) AS lead FROM l), y AS (SELECT *, min(CASE WHEN regexp_matches(line, '^\s*try\b') THEN lead END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS t, max(regexp_matches(line, '^\s*\}?\s*(except|catch|finally)\b')::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS h FROM x) SELECT file_id, line_no, t IS NOT NULL AND t < lead AND coalesce(h, 0) = 1 AS guarded FROM y WHERE regexp_matches(line, '\bload\w*\(')",
    "verify_line_kinds": _W + f"SELECT language, CASE WHEN trim(line) = '' THEN 'blank' WHEN {_COMMENT} THEN 'comment' ELSE 'code' END AS kind, count(*) AS n FROM l GROUP BY ALL",
    "verify_representation": _BASE + f", s AS (SELECT module, count(*) AS n_symbols FROM u JOIN m USING (id) WHERE type <> 'module' GROUP BY 1) SELECT module, {_LAYER % 'module'} AS layer, coalesce(n_symbols, 0) AS n_symbols, coalesce(fan_out, 0) AS n_out, coalesce(fan_in, 0) = 0 AS is_entry FROM s FULL JOIN fan USING (module)",
    "verify_ledger": _F + f"SELECT id, category, severity, file_path, line FROM f WHERE lower(category) = 'dependency' AND contains(lower(concat_ws(' ', title, detail, file_path)), 'parcel') ORDER BY {_RANK}, file_path, line, id LIMIT 50",
}
