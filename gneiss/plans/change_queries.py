"""Queries over changes, dependencies, prompts and streams, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import dependencies as D
from gneiss.operators import lines as L
from gneiss.operators import prompts as P
from gneiss.operators import snapshots as S
from gneiss.session import shared_dir, table
from gneiss.sources import code
from gneiss.streaming import sync

#: Files: what came before DAY, and what was scanned since SINCE; graph: what was scanned up to UNTIL, and since SINCE.
DAY, UNTIL, SINCE = "2025-07-01", "2025-08-01", "2025-06-01"


def _shot(files):
    g = files.groupBy(F.col("file_path").alias("path")).agg(F.max_by(F.struct("scanned_at", "n_lines"), "ingested_at").alias("m"))
    return g.select("path", F.unix_timestamp(F.col("m.scanned_at").cast("timestamp")).cast("double").alias("mtime"), F.col("m.n_lines").cast("bigint").alias("size"))


def changes_files(spark, d):
    f = table(spark, d, "codefile").where("file_path is not null")
    return S.classify(_shot(f.where(F.col("ingested_at") < F.lit(DAY).cast("timestamp_ntz"))), _shot(f.where(F.col("scanned_at") >= F.lit(SINCE).cast("timestamp_ntz"))))


def changes_strategy(spark, d):
    return S.strategy(changes_files(spark, d), baseline_exists=True, fresh=True, closure_size=40)


def _scanned(spark, d):
    """(id, scanned_at): when the file of every node was last scanned."""
    from gneiss.functions.text import clean_path
    from gneiss.operators.graph import unique_nodes

    at = table(spark, d, "codefile").groupBy(F.col("file_path").alias("p_")).agg(F.max("scanned_at").alias("scanned_at"))
    return unique_nodes(table(spark, d, "nodes")).withColumn("p_", clean_path(F.col("file_path"))).join(at, "p_").drop("p_")


def _snapshots(rows):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return rows.where(F.col("scanned_at") < day(UNTIL)), rows.where(F.col("scanned_at") >= day(SINCE))


def changes_nodes(spark, d):
    return S.graph_diff(*_snapshots(_scanned(spark, d)))


def changes_edges(spark, d):
    at = _scanned(spark, d).select(F.col("id").alias("source"), "scanned_at")
    return S.edge_diff(*_snapshots(table(spark, d, "edges").join(at, "source")))


def changes_signatures(spark, d):
    f = L.latest(table(spark, d, "codefile").where("file_path is not null").select("file_id", "file_path", "functions", "raw_content", "scanned_at", "ingested_at"))
    before, after = _snapshots(f)
    return S.signature_changes(S.signatures(before), S.signatures(after)).groupBy("change", "breaking").agg(F.count("*").alias("n"))


def changes_ends(spark, d):
    f = L.latest(table(spark, d, "codefile")).select("file_id", F.explode("functions").alias("f"))
    return S.corrected_ends(f.select("file_id", F.col("f.name").alias("name"), F.col("f.start_line").alias("start_line"), (F.col("f.end_line") + 3).alias("end_line")))


ADVISORIES = [("nimbusgrid", "<5", "ADV-1", "high"), ("velumparse", ">=2,<8", "ADV-2", "critical"), ("oakframe", ">3", "ADV-3", "low"), ("quillmark", ">=1.2,<9.1", "ADV-4", "medium")]


def deps_packages(spark, d):
    return D.lock_packages(L.latest(table(spark, d, "codefile").select("file_id", "repo", "file_path", "raw_content", "ingested_at")))


def deps_affected(spark, d):
    return D.affected(D.lock_packages(L.latest(table(spark, d, "codefile").select("file_id", "repo", "file_path", "raw_content", "ingested_at"))), ADVISORIES).select("repo", "package", "version", "advisory", "severity")


def deps_scores(spark, d):
    return D.scores(D.affected(D.lock_packages(L.latest(table(spark, d, "codefile").select("file_id", "repo", "file_path", "raw_content", "ingested_at"))), ADVISORIES))


def deps_env(spark, d):
    return code.read_env(L.latest(table(spark, d, "codefile")).where("raw_content is not null"))


def deps_built_graph(spark, d):
    nodes, edges = code.build_graph(L.latest(table(spark, d, "codefile")))
    return nodes.groupBy("type").agg(F.count("*").alias("n")).unionByName(edges.groupBy("type").agg(F.count("*").alias("n")))


def prompts_mined(spark, d):
    return P.mined(table(spark, d, "documents"))


def prompts_injections(spark, d):
    return P.injections(table(spark, d, "documents"))


def prompts_formats(spark, d):
    return P.formats(table(spark, d, "documents"))


def prompts_scored(spark, d):
    return P.scored(table(spark, d, "documents"))


def prompts_contradictions(spark, d):
    return P.contradictions(table(spark, d, "documents"))


def stream_sync(spark, d):
    """The deliveries of code files as a stream, merged into a table of snapshots; the table after the last batch."""
    import uuid

    source = f"{d}/codefile.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source if spark.read.parquet(source).inputFiles()[0].rstrip("/") != _uri(source) else f"{d}/codefile.parq[u]et")
    rows = stream.where("file_path is not null").select(F.col("file_path").alias("path"), F.md5(F.coalesce("raw_content", F.lit(""))).alias("digest"), F.col("ingested_at").cast("timestamp").alias("seen_at"))
    folder = f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}"
    sync.run(spark, rows, folder).awaitTermination()
    return sync.current(spark, folder).select("path", "digest")


def _uri(path):
    return "file://" + path


QUERIES = {
    f.__name__: f
    for f in (
        changes_files, changes_strategy, changes_nodes, changes_edges, changes_signatures, changes_ends, deps_packages, deps_affected, deps_scores, deps_env, deps_built_graph, prompts_mined, prompts_injections, prompts_formats,
        prompts_scored, prompts_contradictions, stream_sync,
    )
}

from gneiss.plans.file_queries import _FILES, _q  # noqa: E402
from gneiss.plans.graph_queries import _CLEAN, _UNIQUE  # noqa: E402

_SCANNED = _UNIQUE + f", s AS (SELECT u.*, c.scanned_at FROM u JOIN (SELECT file_path AS p, max(scanned_at) AS scanned_at FROM codefile GROUP BY 1) c ON {_CLEAN} = c.p)"
_SHOT = "(SELECT file_path AS path, epoch(max_by(scanned_at, ingested_at)) ::DOUBLE AS mtime, max_by(n_lines, ingested_at) AS size FROM codefile WHERE file_path IS NOT NULL AND %s GROUP BY 1)"
_CLASSIFY = f"c AS (SELECT path, CASE WHEN b.mtime IS NULL THEN 'added' WHEN a.mtime IS NULL THEN 'deleted' WHEN abs(floor(a.mtime) - floor(b.mtime)) <= 0.1 AND a.size IS NOT DISTINCT FROM b.size THEN 'unchanged' ELSE 'changed' END AS change FROM {_SHOT % f'ingested_at < TIMESTAMP {_q(DAY)}'} b FULL JOIN {_SHOT % f'scanned_at >= TIMESTAMP {_q(SINCE)}'} a USING (path))"
_PACKAGES = "p AS (SELECT repo, file_path, unnest(json_keys(json_extract(raw_content, '$.packages'))) AS package, raw_content FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id) AS rn FROM codefile) WHERE rn = 1) WHERE file_path LIKE '%.json' AND contains(raw_content, '\"packages\"') AND json_valid(raw_content)), k AS (SELECT repo, file_path, package, json_extract_string(raw_content, '$.packages.\"' || package || '\".version') AS version FROM p)"
_V = "list_transform(string_split(version, '.'), lambda x: x::INT)"


def _range(text: str) -> str:
    parts = []
    for b in text.split(","):
        op = b[:2] if b[1] == "=" else b[0]
        v = [int(x) for x in b[len(op) :].split(".")]
        padded = f"array_to_string(list_transform(list_resize({_V}, 6, 0), lambda x: lpad(x::VARCHAR, 9, '0')), '.')"  # texts compare by BETWEEN, lists don't
        parts.append(f"{padded} {op} '" + ".".join(f"{x:09d}" for x in (v + [0] * 6)[:6]) + "'")
    return " AND ".join(parts)


_AFFECTED = f"WITH {_PACKAGES}, a AS (" + " UNION ALL ".join(f"SELECT repo, package, version, {_q(a)} AS advisory, {_q(s)} AS severity FROM k WHERE starts_with(package, {_q(p)}) AND {_range(r)}" for p, r, a, s in ADVISORIES) + ")"
_T = "lower(coalesce(text, ''))"
_NWORDS = " + ".join(f"contains({_T}, {_q(w)})::INT" for w in P.WORDS)

SQL = {
    "changes_signatures": """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) AS rn FROM codefile WHERE file_path IS NOT NULL) WHERE rn = 1 AND raw_content IS NOT NULL), u AS (SELECT file_path AS path, scanned_at, string_split(replace(raw_content, chr(13), ''), chr(10)) AS s, unnest(functions) AS fn FROM f),
 a AS (SELECT path, fn.name AS name, min(trim(s[fn.start_line])) AS h0 FROM u WHERE scanned_at < TIMESTAMP '2025-08-01' GROUP BY 1, 2), b AS (SELECT path, fn.name AS name, min(trim(s[fn.start_line])) AS h1 FROM u WHERE scanned_at >= TIMESTAMP '2025-06-01' GROUP BY 1, 2),
 c AS (SELECT CASE WHEN h0 IS NULL THEN 'added' WHEN h1 IS NULL THEN 'removed' WHEN h0 <> h1 THEN 'changed' END AS change, starts_with(regexp_replace(regexp_extract(h1, '\\((.*)\\)', 1), '\\s', '', 'g'), regexp_replace(regexp_extract(h0, '\\((.*)\\)', 1), '\\s', '', 'g')) AS longer FROM a FULL JOIN b USING (path, name)) SELECT change, change = 'removed' OR change = 'changed' AND NOT longer AS breaking, count(*) AS n FROM c WHERE change IS NOT NULL GROUP BY 1, 2""",
    "changes_files": f"WITH {_CLASSIFY} SELECT * FROM c",
    "changes_strategy": f"WITH {_CLASSIFY}, n AS (SELECT sum((change = 'added')::INT) AS n_added, sum((change = 'changed')::INT) AS n_changed, sum((change = 'deleted')::INT) AS n_deleted FROM c) SELECT *, CASE WHEN n_added + n_changed + n_deleted = 0 THEN 'no_change' WHEN n_added + n_changed + n_deleted > 30 THEN 'full' WHEN n_added + n_changed + n_deleted <= 10 THEN 'incremental' ELSE 'full' END AS strategy FROM n",
    "changes_nodes": f"WITH {_SCANNED}, b AS (SELECT * FROM s WHERE scanned_at < TIMESTAMP {_q(UNTIL)}), a AS (SELECT * FROM s WHERE scanned_at >= TIMESTAMP {_q(SINCE)}) SELECT id, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'same' END AS change FROM b FULL JOIN a USING (id)",
    "changes_edges": f"""WITH {_SCANNED}, x AS (SELECT source, target, e.type, scanned_at FROM edges e JOIN s ON e.source = s.id), b AS (SELECT DISTINCT source, target, type FROM x WHERE scanned_at < TIMESTAMP {_q(UNTIL)}), a AS (SELECT DISTINCT source, target, type FROM x WHERE scanned_at >= TIMESTAMP {_q(SINCE)}), g AS (SELECT * FROM b EXCEPT SELECT * FROM a), n AS (SELECT * FROM a EXCEPT SELECT * FROM b),
 r AS (SELECT g.source, min(g.target) AS target, g.type, 'rerouted' AS change, min(n.target) AS other FROM g JOIN n USING (source, type) GROUP BY g.source, g.type HAVING count(*) = 1)
 SELECT * FROM r UNION ALL SELECT source, target, type, 'removed', NULL FROM g WHERE (source, type) NOT IN (SELECT (source, type) FROM r) UNION ALL SELECT source, target, type, 'added', NULL FROM n WHERE (source, type) NOT IN (SELECT (source, type) FROM r)""",
    "changes_ends": f"WITH {_FILES}, g AS (SELECT file_id, unnest(functions) AS fn FROM f), h AS (SELECT file_id, fn.name AS name, fn.start_line AS start_line, fn.end_line + 3 AS e, lead(fn.start_line) OVER (PARTITION BY file_id ORDER BY fn.start_line) AS nx FROM g) SELECT file_id, name, start_line, CASE WHEN nx IS NOT NULL AND e >= nx AND nx > start_line THEN nx - 1 ELSE e END AS end_line FROM h",
    "deps_packages": f"WITH {_PACKAGES} SELECT * FROM k",
    "deps_affected": _AFFECTED + " SELECT * FROM a",
    "deps_scores": _AFFECTED + " SELECT repo, count(*) AS n, greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 ELSE 2 END))::INT AS score FROM (SELECT DISTINCT repo, package, advisory, severity FROM a) GROUP BY repo",
    "deps_env": rf"""WITH {_FILES}, l AS (SELECT file_path, unnest(string_split(replace(raw_content, chr(13), ''), chr(10))) AS line FROM f WHERE raw_content IS NOT NULL AND regexp_matches(file_path, '\.env(\.\w+)?$')), p AS (SELECT file_path, regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$', 1) AS key, regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$', 2) AS v FROM l) SELECT file_path, key, regexp_replace(regexp_replace(v, '^"(.*)"$', '\1'), '^''(.*)''$', '\1') AS value FROM p WHERE key <> ''""",
    "deps_built_graph": rf"""WITH {_FILES}, w AS (SELECT DISTINCT file_path, regexp_extract(i, '([\w-]+)$', 1) AS name FROM (SELECT file_path, unnest(imports) AS i FROM f)), k AS (SELECT DISTINCT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', '') AS name FROM f)
 SELECT 'module' AS type, count(*) AS n FROM f UNION ALL SELECT 'function', sum(len(functions)) FROM f UNION ALL SELECT 'CONTAINS', sum(len(functions)) FROM f UNION ALL (SELECT 'IMPORTS', count(*) FROM w JOIN k USING (name) WHERE name <> '' HAVING count(*) > 0)""",
    "prompts_mined": f"WITH n AS (SELECT doc_id, text, kind, {_NWORDS} AS n_words FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN {_q(t)}" for t, p in P.TYPES) + " ELSE 'other' END AS prompt_type, n_words, left(sha256(text), 16) AS hash FROM n WHERE (length(text) >= 100 AND n_words >= 2) OR (kind = 'prompt' AND text IS NOT NULL)",
    "prompts_injections": " UNION ALL ".join(f"SELECT doc_id, {_q(n)} AS \"group\" FROM documents WHERE regexp_matches(substring(text, 1, {P.SCANNED}), {_q(p)})" for n, p in P.INJECTION.items()),
    "prompts_formats": "WITH r AS (" + " UNION ".join(f"SELECT source, {_q(n)} AS f FROM documents WHERE regexp_matches(text, {_q(p)})" for n, p in P.FORMATS.items()) + ") SELECT source, count(*) AS n_formats, string_agg(f, ',' ORDER BY f) AS formats, count(*) > 1 AS conflict FROM r GROUP BY source",
    "prompts_scored": rf"""WITH s AS (SELECT doc_id, round(least(1.0::DOUBLE, length(text) / 400.0::DOUBLE), 4) AS clarity, round(least(1.0::DOUBLE, (len(regexp_extract_all(text, '(?m)^\s*(?:[-*]|\d+\.) ')) + 2 * len(regexp_extract_all(text, '(?m)^```'))) / 6.0::DOUBLE), 4) AS structure, CASE WHEN regexp_matches(text, {_q('|'.join(p.replace('(?i)', '') for p in P.INJECTION.values()))}) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS safety FROM documents WHERE text IS NOT NULL AND kind = 'prompt')
 SELECT *, floor(35 * clarity + 35 * structure + 30 * safety + 0.5::DOUBLE)::INT AS score FROM s""",
    "prompts_contradictions": r"""WITH m AS (SELECT source, unnest(regexp_extract_all(text, '\b(?:must|always|keeps|confirms) the (\w+)', 1)) AS word FROM documents), b AS (SELECT source, unnest(regexp_extract_all(text, '\b(?:never|rejects|drops|blocks) the (\w+)', 1)) AS word FROM documents)
 SELECT source, word, n_must, n_ban FROM (SELECT source, word, count(*) AS n_must FROM m GROUP BY ALL) JOIN (SELECT source, word, count(*) AS n_ban FROM b GROUP BY ALL) USING (source, word)""",
    "stream_sync": "SELECT file_path AS path, max_by(md5(coalesce(raw_content, '')), (ingested_at, md5(coalesce(raw_content, '')))) AS digest FROM codefile WHERE file_path IS NOT NULL GROUP BY 1",
}
