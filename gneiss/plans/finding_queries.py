"""Queries over findings and search, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import findings as O
from gneiss.operators import search as S
from gneiss.session import table


def _f(spark, d):
    return O.distinct_findings(table(spark, d, "findings"))


_SEV = "CASE WHEN lower(severity) IN ('critical','high','medium','low','info') THEN lower(severity) ELSE 'info' END"
_F = f"WITH f AS (SELECT * EXCLUDE (severity, rn), {_SEV} AS severity FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM findings) WHERE rn = 1) "
_RANK = "(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END)"

WHITELIST = [("/export/", "todo", None), (None, "secret", "manifest"), ("quarry-hub/", None, "parcel")]
NOISE = [
    ("layering in tools", ("td", "gov"), ("layering",), ("/tools/", "/jobs/"), (), "suppress"),
    ("todo", (), ("todo",), (), ("cache expires",), "downgrade"),
    ("junk", ("junk",), (), ("/web/", "/static/"), (), "suppress"),
]
WEIGHTS = {"critical": 5.0, "high": 3.0, "medium": 1.0, "low": 0.2}


def findings_cross_validated(spark, d):
    return O.cross_validate(_f(spark, d)).select("id", "tier", F.array_join("xval_by", ",").alias("xval_by"))


def findings_whitelisted(spark, d):
    f = _f(spark, d)
    return f.where(~O.whitelisted(f, WHITELIST)).select("id", "tool", "category")


def findings_denoised(spark, d):
    return O.denoise(_f(spark, d), NOISE)


def findings_merged_adjacent(spark, d):
    return O.merge_adjacent(_f(spark, d))


def findings_merged_bursts(spark, d):
    return O.merge_bursts(_f(spark, d))


def findings_health(spark, d):
    return O.health_scores(_f(spark, d))


def findings_governance_score(spark, d):
    return O.penalty_scores(_f(spark, d), table(spark, d, "codefile"), WEIGHTS)


def findings_worst(spark, d):
    return O.worst(_f(spark, d))


def findings_top(spark, d):
    return O.top(_f(spark, d)).select("id", "severity", "file_path", "line")


def findings_risks(spark, d):
    return O.risk_rollup(_f(spark, d))


def findings_verified(spark, d):
    claims = _f(spark, d).select("id", F.concat_ws(" ", "title", "detail").alias("text"))
    return O.verify(claims, table(spark, d, "nodes").select("name"))


def search_vector(spark, d):
    e = table(spark, d, "embeddings")
    query = e.where("vec_id = 7").first()["embedding"]
    return S.by_vector(e, "vec_id", "embedding", query)


def search_similar(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return S.similar(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"))


def search_words(spark, d):
    return S.by_words(table(spark, d, "chunks"), "retry queue snapshot parcel voucher")


def search_textual_calls(spark, d):
    return S.textual_calls(table(spark, d, "chunks"))


def search_kb_stats(spark, d):
    return S.kb_stats(table(spark, d, "chunks"))


QUERIES = {
    f.__name__: f
    for f in (
        findings_cross_validated, findings_whitelisted, findings_denoised, findings_merged_adjacent, findings_merged_bursts, findings_health, findings_governance_score, findings_worst,
        findings_top, findings_risks, findings_verified, search_vector, search_similar, search_words, search_textual_calls, search_kb_stats,
    )
}

_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-8), 6)"
_C = "WITH c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS rn FROM chunks) WHERE rn = 1) "

SQL = {
    "findings_cross_validated": _F
    + "SELECT id, CASE WHEN n > 1 THEN 'high' ELSE tier END AS tier, CASE WHEN n > 1 THEN array_to_string(list_sort(list_filter(tools, lambda x: x <> tool)), ',') ELSE '' END AS xval_by FROM (SELECT f.*, g.tools, len(g.tools) AS n FROM f JOIN (SELECT file_path, line, category, list(DISTINCT tool) AS tools FROM f GROUP BY ALL) g USING (file_path, line, category))",
    "findings_whitelisted": _F + "SELECT id, tool, category FROM f WHERE NOT ((contains(lower(file_path), '/export/') AND contains(lower(category), 'todo')) OR (contains(lower(category), 'secret') AND contains(lower(title), 'manifest')) OR (contains(lower(file_path), 'quarry-hub/') AND contains(lower(title), 'parcel')))",
    "findings_denoised": _F
    + """, r AS (SELECT *, CASE WHEN tool IN ('td','gov') AND contains(lower(title), 'layering') AND (contains(lower(file_path), '/tools/') OR contains(lower(file_path), '/jobs/')) THEN 'layering in tools'
 WHEN contains(lower(title), 'todo') AND NOT contains(lower(coalesce(detail, '')), 'cache expires') THEN 'todo' WHEN tool = 'junk' AND (contains(lower(file_path), '/web/') OR contains(lower(file_path), '/static/')) THEN 'junk' END AS rule FROM f)
 SELECT id, rule, CASE rule WHEN 'todo' THEN 'downgrade' WHEN 'junk' THEN 'suppress' WHEN 'layering in tools' THEN 'suppress' ELSE 'keep' END AS action, CASE WHEN rule = 'todo' THEN 'low' ELSE severity END AS severity FROM r""",
    "findings_merged_adjacent": """WITH RECURSIVE f AS (SELECT file_path, category, tool, line, greatest(line, coalesce(line_end, line)) AS line_end, coalesce(count, 1) AS n, id, row_number() OVER (PARTITION BY file_path, category, tool ORDER BY line, id) AS k
 FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM findings) WHERE rn = 1), r AS (SELECT file_path, category, tool, line AS a, id AS first_id, line_end, n, k FROM f WHERE k = 1
 UNION ALL SELECT f.file_path, f.category, f.tool, CASE WHEN f.line - r.a <= 5 THEN r.a ELSE f.line END, CASE WHEN f.line - r.a <= 5 THEN r.first_id ELSE f.id END, f.line_end, f.n, f.k FROM r JOIN f USING (file_path, category, tool) WHERE f.k = r.k + 1)
 SELECT file_path, category, tool, a AS line_start, max(line_end) AS line_end, sum(n) AS n, first_id FROM r GROUP BY file_path, category, tool, a, first_id""",
    "findings_merged_bursts": _F
    + """, g AS (SELECT tool, category, severity, count(*) AS n_rows, sum(coalesce(count, 1)) AS n, count(DISTINCT file_path) AS n_files, max(CASE tier WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS t, min_by(id, (file_path, line, id)) AS first_id FROM f GROUP BY ALL)
 SELECT tool, category, severity, n_rows, n, n_files, CASE t WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS tier, first_id FROM g WHERE n_rows > 8
 UNION ALL SELECT f.tool, f.category, f.severity, 1, coalesce(f.count, 1), 1, CASE WHEN tier IN ('high','medium') THEN tier ELSE 'low' END, f.id FROM f JOIN g USING (tool, category, severity) WHERE g.n_rows <= 8""",
    "findings_health": _F + "SELECT split_part(file_path, '/', 1) AS repo, sum((tier = 'high')::INT) AS n_high, sum((tier = 'medium')::INT) AS n_medium, sum((tier = 'low')::INT) AS n_low, greatest(0, floor((500 - 25 * sum((tier = 'high')::INT) - 5 * sum((tier = 'medium')::INT) - sum((tier = 'low')::INT)) / 5))::INT AS score FROM f GROUP BY 1",
    "findings_governance_score": _F
    + "SELECT repo, round(greatest(0.0, least(100.0, 100 - coalesce(lost, 0) / n_files * 10)), 2)::DOUBLE AS score FROM (SELECT repo, count(DISTINCT file_id) AS n_files FROM codefile GROUP BY 1) LEFT JOIN (SELECT split_part(file_path, '/', 1) AS repo, sum(CASE severity WHEN 'critical' THEN 5.0 WHEN 'high' THEN 3.0 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.2 ELSE 0 END::DOUBLE) AS lost FROM f GROUP BY 1) USING (repo)",
    "findings_worst": _F + f"SELECT file_path, ['critical','high','medium','low','info'][min({_RANK}) + 1] AS severity, count(*) AS n FROM f GROUP BY 1",
    "findings_top": _F + f"SELECT id, severity, file_path, line FROM f ORDER BY {_RANK}, file_path, line, id LIMIT 10",
    "findings_risks": _F
    + f"SELECT risk, coalesce(n, 0) AS n, worst FROM (SELECT unnest(['A01','A02','A03','A04','A05','A06','A07','A08','A09','A10']) AS risk) LEFT JOIN (SELECT CASE category WHEN 'injection' THEN 'A03' WHEN 'secret' THEN 'A07' WHEN 'dependency' THEN 'A06' WHEN 'layering' THEN 'A04' WHEN 'complexity' THEN 'A04' ELSE 'A05' END AS risk, count(*) AS n, ['critical','high','medium','low','info'][min({_RANK}) + 1] AS worst FROM f GROUP BY 1) USING (risk)",
    "findings_verified": _F
    + """, w AS (SELECT DISTINCT id, unnest(regexp_extract_all(concat_ws(' ', title, detail), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM f), k AS (SELECT DISTINCT name FROM nodes),
 c AS (SELECT id, name, name IN (SELECT name FROM k) AS known FROM w WHERE length(name) > 3 AND (regexp_matches(name, '[a-z][A-Z]|_') OR name IN (SELECT name FROM k))), t AS (SELECT id, count(*) AS n_symbols, sum(known::INT) AS n_known FROM c GROUP BY id)
 SELECT id, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_known, 0) AS n_known, CASE WHEN coalesce(n_symbols, 0) = 0 THEN 'unverifiable' WHEN n_known = n_symbols THEN 'confirmed' WHEN n_known = 0 THEN 'refuted' ELSE 'partial' END AS verdict FROM (SELECT DISTINCT id FROM f) LEFT JOIN t USING (id)""",
    "search_vector": f"SELECT a.vec_id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, a.vec_id) AS rank FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b ORDER BY score DESC, a.vec_id LIMIT 10",
    "search_similar": f"SELECT * FROM (SELECT a.vec_id, b.vec_id AS near, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5",
    "search_words": _C
    + ", s AS (SELECT chunk_id, round((" + " + ".join(f"contains(lower(concat_ws(' ', name, substring(code, 1, 500), docstring)), '{w}')::INT" for w in ("retry", "queue", "snapshot", "parcel", "voucher")) + ") / 5.0, 6)::DOUBLE AS score FROM c) SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 20",
    "search_textual_calls": _C
    + r", o AS (SELECT chunk_id, code, regexp_extract(name, '([^.]*)$', 1) AS own FROM c WHERE lower(trim(chunk_type)) IN ('function','method')), t AS (SELECT chunk_id, own, unnest(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS name FROM o) SELECT name, count(*) AS n_calls, count(DISTINCT chunk_id) AS n_chunks FROM t WHERE name <> own AND name IN (SELECT own FROM o WHERE own <> '') GROUP BY name",
    "search_kb_stats": "SELECT lower(chunk_type) AS chunk_type, count(*) AS n, count(DISTINCT file_path) AS n_files, round(avg((embedding IS NOT NULL)::INT), 6) AS with_embedding, sum((trim(coalesce(docstring, '')) <> '')::INT) AS with_docs FROM chunks GROUP BY 1",
}
