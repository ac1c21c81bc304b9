"""Queries over the code graph, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import graph as G
from gneiss.session import cut, table


def _ne(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "nodes"), table(spark, d, "edges")


#: One row per id in SQL, as unique_nodes picks it.
_UNIQUE = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_path DESC, start_line DESC, end_line DESC, type DESC, name DESC, props DESC) AS rn FROM nodes) WHERE rn = 1)"
_CLEAN = r"regexp_replace(regexp_replace(file_path, '\\+', '/', 'g'), '^(\./|/)+', '')"
_MODULE = rf"m AS (SELECT id, regexp_replace({_CLEAN}, '\.[A-Za-z0-9]+$', '') AS module FROM u)"
_ARCS = "arcs AS (SELECT x.module AS a, y.module AS b, count(*) AS n FROM edges e JOIN m x ON e.source = x.id JOIN m y ON e.target = y.id WHERE e.type IN ('CALLS','IMPORTS','REFERENCES') GROUP BY 1, 2)"
_LAYER = "coalesce(map_extract(MAP {" + ", ".join(f"'{k}': {v}" for k, v in G.LAYERS.items()) + "}, split_part(%s, '/', 2))[1], 3)"
_FAN = f"""fan AS (SELECT module, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, {_LAYER % 'module'} AS layer, (coalesce(fan_out, 0) > 15 OR coalesce(fan_in, 0) > 15) AS is_god
  FROM (SELECT a AS module, count(*) AS fan_out FROM arcs WHERE a <> b GROUP BY 1) FULL JOIN (SELECT b AS module, count(*) AS fan_in FROM arcs WHERE a <> b GROUP BY 1) USING (module))"""
_BASE = f"WITH RECURSIVE {_UNIQUE}, {_MODULE}, {_ARCS}, {_FAN} "


def graph_stats(spark, d):
    return G.stats(*_ne(spark, d))


def graph_entity_lookup(spark, d):
    return G.lookup(_ne(spark, d)[0], "parcel", "function").select("id", "name", "file_path", "start_line")


def graph_file_entities(spark, d):
    return G.file_entities(_ne(spark, d)[0], "/export/").select("id", "name", "file_path", "start_line")


def graph_search(spark, d):
    return G.search(_ne(spark, d)[0], "voucher").select("id", "type", "name", "file_path")


def graph_resolve(spark, d):
    return G.resolve(_ne(spark, d)[0], ["load_policy", "trim", "Reader", "no such name"])


def graph_callers(spark, d):
    return G.callers(*_ne(spark, d))


def graph_callees(spark, d):
    return G.callees(*_ne(spark, d))


def graph_impact(spark, d):
    return G.impact(*_ne(spark, d))


def graph_relations(spark, d):
    return G.relations(table(spark, d, "edges"))


def graph_containing_node(spark, d):
    found = table(spark, d, "findings").select("id", "file_path", "line").distinct()
    return G.containing(table(spark, d, "nodes"), found, ["id"])


def graph_import_targets(spark, d):
    files = table(spark, d, "codefile")
    imports = files.select("file_id", F.explode("imports").alias("target")).distinct()
    modules = G.unique_nodes(table(spark, d, "nodes")).where("type = 'module'").select("name")
    words = modules.select(F.explode(F.split("name", "_")).alias("name")).distinct()
    return G.import_targets(imports, words)


def graph_without_callers(spark, d):
    return G.without_callers(*_ne(spark, d)).select("id", "name", "file_path")


def graph_isolated(spark, d):
    return G.isolated(*_ne(spark, d)).select("id", "type", "name")


def graph_orphan_edges(spark, d):
    nodes, edges = _ne(spark, d)
    return G.orphan_edges(nodes, edges, table(spark, d, "ext_symbols")).groupBy("type", "target").agg(F.count("*").alias("n"))


def _start(nodes):
    return nodes.where("type = 'function' and name like 'trim%'").select("id")


def graph_downstream(spark, d):
    nodes, edges = _ne(spark, d)
    return G.closure(edges, _start(nodes), hops=8, types=("CALLS",))


def graph_impact_closure(spark, d):
    nodes, edges = _ne(spark, d)
    start = nodes.where("type = 'function' and name like 'trim_raw%'").select("id")
    return G.closure(edges, start, hops=3, backward=True, types=("CALLS", "IMPORTS", "REFERENCES", "INHERITS"), stop_above=200)


def graph_neighbourhood(spark, d):
    nodes, edges = _ne(spark, d)
    return G.neighbourhood(edges, nodes.where("name like 'export_open%'").select("id"), depth=2)


def _arcs(spark, d):
    return cut(G.module_arcs(*_ne(spark, d)))


def graph_module_arcs(spark, d):
    return G.module_arcs(*_ne(spark, d))


def graph_import_cycles(spark, d):
    """Strongly connected components of the modules' imports with more than one module."""
    arcs = G.module_arcs(*_ne(spark, d), types=("IMPORTS",)).select("a", "b")
    scc = G.strong_components(cut(arcs))
    big = scc.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1")
    return scc.join(big, "scc").select(F.col("id").alias("module"), "scc", "n")


def _parts(spark, d, type_):
    arcs = table(spark, d, "edges").where(F.col("type") == type_).select(F.col("source").alias("a"), F.col("target").alias("b"))
    return G.components(arcs).groupBy("component").agg(F.count("*").alias("n"))


def graph_import_components(spark, d):
    """Connected components of the import graph: size by component."""
    return _parts(spark, d, "IMPORTS")


def graph_call_components(spark, d):
    """Connected components of the call graph; SQL would have to build all pairs that reach each other."""
    return _parts(spark, d, "CALLS")


def graph_entry_chain(spark, d):
    """What an entry, given by name, leads to by calls: functions and methods by file and line."""
    nodes, edges = _ne(spark, d)
    return G.entry_chain(nodes, edges, "trim_raw", hops=8)


def graph_fan_stats(spark, d):
    return G.fan_stats(G.module_arcs(*_ne(spark, d)))


def graph_layer_violations(spark, d):
    return G.layer_violations(G.module_arcs(*_ne(spark, d)))


def graph_large_modules(spark, d):
    return G.large_modules(table(spark, d, "nodes"))


def graph_health(spark, d):
    arcs = _arcs(spark, d)
    imports = cut(G.module_arcs(*_ne(spark, d), types=("IMPORTS",)).select("a", "b"))
    return G.health(arcs, G.strong_components(imports), table(spark, d, "nodes"))


def graph_tiers(spark, d):
    return G.tiers(G.module_arcs(*_ne(spark, d)))


def graph_cross_flows(spark, d):
    return G.cross_flows(*_ne(spark, d))


def graph_entry_points(spark, d):
    return G.entry_points(*_ne(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        graph_stats, graph_entity_lookup, graph_file_entities, graph_search, graph_resolve, graph_callers, graph_callees, graph_impact, graph_relations, graph_containing_node,
        graph_import_targets, graph_without_callers, graph_isolated, graph_orphan_edges, graph_downstream, graph_impact_closure, graph_neighbourhood, graph_module_arcs, graph_import_cycles,
        graph_import_components, graph_call_components, graph_entry_chain, graph_fan_stats, graph_layer_violations, graph_large_modules, graph_health, graph_tiers, graph_cross_flows, graph_entry_points,
    )
}

SQL = {
    "graph_stats": "SELECT 'node' AS side, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type",
    "graph_entity_lookup": "SELECT id, name, file_path, start_line FROM nodes WHERE contains(lower(name), 'parcel') AND type = 'function' ORDER BY id, file_path, start_line LIMIT 50",
    "graph_file_entities": "SELECT id, name, file_path, start_line FROM nodes WHERE contains(lower(file_path), '/export/') ORDER BY start_line, id, file_path LIMIT 100",
    "graph_search": "SELECT id, type, name, file_path FROM nodes WHERE contains(lower(name), 'voucher') OR contains(lower(file_path), 'voucher') OR contains(lower(props), 'voucher') ORDER BY id, file_path, start_line LIMIT 30",
    "graph_resolve": "SELECT q AS name, min_by(id, (CASE WHEN name = q THEN 0 ELSE 1 END, id)) AS id FROM nodes, (SELECT unnest(['load_policy', 'trim', 'Reader', 'no such name']) AS q) WHERE contains(lower(name), lower(q)) GROUP BY q",
    "graph_callers": f"WITH {_UNIQUE} SELECT e.target, u.id AS caller_id, u.name AS caller_name, count(*) AS n_calls FROM edges e JOIN u ON e.source = u.id WHERE e.type = 'CALLS' GROUP BY 1, 2, 3",
    "graph_callees": f"WITH {_UNIQUE} SELECT e.source, u.id AS callee_id, u.name AS callee_name, count(*) AS n_calls FROM edges e JOIN u ON e.target = u.id WHERE e.type = 'CALLS' GROUP BY 1, 2, 3",
    "graph_impact": f"WITH {_UNIQUE} SELECT DISTINCT {_CLEAN} AS file_path, e.source FROM edges e JOIN u ON e.target = u.id WHERE e.type IN ('CALLS','IMPORTS','REFERENCES')",
    "graph_relations": "SELECT id, sum(o) AS n_out, sum(i) AS n_in, count(DISTINCT type) AS n_types FROM (SELECT source AS id, type, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, type, 0, 1 FROM edges) GROUP BY id",
    "graph_containing_node": f"WITH {_UNIQUE}, s AS (SELECT id AS node_id, {_CLEAN} AS p, start_line, end_line FROM u), f AS (SELECT DISTINCT id, {_CLEAN} AS p, line FROM findings) SELECT f.id, min_by(node_id, (end_line - start_line, node_id)) AS node_id FROM f JOIN s ON f.p = s.p AND f.line BETWEEN s.start_line AND s.end_line GROUP BY f.id",
    "graph_import_targets": rf"""WITH {_UNIQUE}, w AS (SELECT DISTINCT unnest(string_split(name, '_')) AS segment FROM u WHERE type = 'module'),
 i AS (SELECT DISTINCT file_id, unnest(imports) AS target FROM codefile), p AS (SELECT file_id, target, list_reverse(regexp_split_to_array(regexp_replace(target, '^[./]+', ''), '[./]')) AS s FROM i),
 x AS (SELECT file_id, target, unnest(s) AS segment, generate_subscripts(s, 1) AS pos FROM p) SELECT file_id, target, min_by(segment, pos) AS module FROM x JOIN w USING (segment) GROUP BY file_id, target""",
    "graph_without_callers": f"WITH {_UNIQUE} SELECT id, name, file_path FROM u WHERE type IN ('function','method') AND id NOT IN (SELECT target FROM edges WHERE type = 'CALLS' AND source <> target)",
    "graph_isolated": f"WITH {_UNIQUE} SELECT id, type, name FROM u WHERE id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)",
    "graph_orphan_edges": "WITH k AS (SELECT id FROM nodes UNION SELECT id FROM ext_symbols) SELECT type, target, count(*) AS n FROM edges WHERE source NOT IN (SELECT id FROM k) OR target NOT IN (SELECT id FROM k) GROUP BY type, target",
    "graph_downstream": "WITH RECURSIVE r AS (SELECT id, 0 AS depth FROM nodes WHERE type = 'function' AND name LIKE 'trim%' UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.source = r.id AND e.type = 'CALLS' WHERE r.depth < 8) SELECT id, min(depth) AS depth FROM r GROUP BY id",
    "graph_impact_closure": """WITH a AS (SELECT DISTINCT target AS id, source AS t FROM edges WHERE type IN ('CALLS','IMPORTS','REFERENCES','INHERITS')), k0 AS (SELECT DISTINCT id, 0 AS depth FROM nodes WHERE type = 'function' AND name LIKE 'trim_raw%'),
 f1 AS (SELECT DISTINCT t AS id, 1 AS depth FROM a JOIN k0 USING (id) WHERE t NOT IN (SELECT id FROM k0) AND (SELECT count(*) FROM k0) <= 200), k1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM f1),
 f2 AS (SELECT DISTINCT t AS id, 2 AS depth FROM a JOIN f1 USING (id) WHERE t NOT IN (SELECT id FROM k1) AND (SELECT count(*) FROM k1) <= 200), k2 AS (SELECT * FROM k1 UNION ALL SELECT * FROM f2),
 f3 AS (SELECT DISTINCT t AS id, 3 AS depth FROM a JOIN f2 USING (id) WHERE t NOT IN (SELECT id FROM k2) AND (SELECT count(*) FROM k2) <= 200) SELECT * FROM k2 UNION ALL SELECT * FROM f3""",
    "graph_neighbourhood": """WITH a AS (SELECT DISTINCT source, target FROM edges WHERE type = 'CALLS'), s AS (SELECT DISTINCT id FROM nodes WHERE name LIKE 'export_open%'),
 h1 AS (SELECT * FROM a WHERE source IN (SELECT id FROM s) OR target IN (SELECT id FROM s)), r1 AS (SELECT id FROM s UNION SELECT source FROM h1 UNION SELECT target FROM h1)
 SELECT source, target FROM a WHERE source IN (SELECT id FROM r1) OR target IN (SELECT id FROM r1)""",
    "graph_module_arcs": _BASE + "SELECT a, b, n FROM arcs",
    "graph_import_cycles": f"""WITH RECURSIVE {_UNIQUE}, {_MODULE}, arcs AS (SELECT DISTINCT x.module AS a, y.module AS b FROM edges e JOIN m x ON e.source = x.id JOIN m y ON e.target = y.id WHERE e.type = 'IMPORTS' AND x.module <> y.module),
 r AS (SELECT a, b FROM arcs UNION SELECT r.a, arcs.b FROM r JOIN arcs ON r.b = arcs.a), s AS (SELECT x.a AS module, least(x.a, min(x.b)) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
 SELECT module, scc, count(*) OVER (PARTITION BY scc) AS n FROM s""",
    "graph_entry_chain": f"""WITH RECURSIVE {_UNIQUE}, fn AS (SELECT * FROM u WHERE type IN ('function','method')), e0 AS (SELECT min_by(id, (CASE WHEN name = 'trim_raw' THEN 0 ELSE 1 END, id)) AS id FROM fn WHERE contains(lower(name), 'trim_raw') HAVING count(*) > 0),
 r AS (SELECT id, 0 AS depth FROM e0 UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.source = r.id AND e.type = 'CALLS' WHERE r.depth < 8) SELECT name, {_CLEAN} AS file_path, start_line, min(depth) AS depth FROM fn JOIN r USING (id) GROUP BY id, name, file_path, start_line""",
    "graph_import_components": """WITH RECURSIVE e2 AS (SELECT source AS a, target AS b FROM edges WHERE type = 'IMPORTS' UNION SELECT target, source FROM edges WHERE type = 'IMPORTS'), r AS (SELECT a, a AS b FROM e2 UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a)
 SELECT component, count(*) AS n FROM (SELECT a, min(b) AS component FROM r GROUP BY a) GROUP BY component""",
    "graph_fan_stats": _BASE + "SELECT * FROM fan",
    "graph_layer_violations": _BASE + f"SELECT * FROM (SELECT a, b, {_LAYER % 'a'} AS layer_a, {_LAYER % 'b'} AS layer_b FROM arcs WHERE a <> b) WHERE layer_a < layer_b",
    "graph_large_modules": _BASE + "SELECT module, count(*) AS n_symbols FROM u JOIN m USING (id) WHERE type <> 'module' GROUP BY module HAVING count(*) > 20",
    "graph_health": _BASE + f""", ia AS (SELECT DISTINCT x.module AS a, y.module AS b FROM edges e JOIN m x ON e.source = x.id JOIN m y ON e.target = y.id WHERE e.type = 'IMPORTS'),
 r AS (SELECT a, b FROM ia WHERE a <> b UNION SELECT r.a, ia.b FROM r JOIN ia ON r.b = ia.a WHERE ia.a <> ia.b), s AS (SELECT DISTINCT least(x.a, min(x.b)) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
 c AS (SELECT count(*) AS n_cycles FROM (SELECT scc FROM s UNION SELECT a FROM arcs WHERE a = b)), v AS (SELECT count(*) AS n_violations FROM arcs WHERE a <> b AND {_LAYER % 'a'} < {_LAYER % 'b'}), g AS (SELECT count(*) AS n_gods FROM fan WHERE is_god),
 l AS (SELECT count(*) AS n_large FROM (SELECT module FROM u JOIN m USING (id) WHERE type <> 'module' GROUP BY module HAVING count(*) > 20))
 SELECT *, round(greatest(0.0, 10 - least(6.0, n_cycles * 1.5) - least(2.0, n_violations * 0.1) - least(2.0, n_gods * 0.5) - least(2.0, n_large * 0.2))::DOUBLE, 1) AS score FROM c, v, g, l""",
    "graph_tiers": _BASE + r"""SELECT module, CASE WHEN fan_out > 2 * fan_in OR regexp_matches(regexp_extract(module, '([^/]*)$', 1), '(^|_)(main|cli|app|server)(_|$)') THEN 'entry'
 WHEN fan_in > 2 * fan_out AND fan_in >= 2 OR regexp_matches(regexp_extract(module, '([^/]*)$', 1), '(^|_)(util|utils|common|base|config)(_|$)') THEN 'infra' ELSE 'business' END AS tier FROM fan""",
    "graph_cross_flows": _BASE + """, fl AS (SELECT DISTINCT regexp_replace(x.module, '/[^/]*$', '') AS a, regexp_replace(y.module, '/[^/]*$', '') AS b, ux.file_path AS fa, uy.file_path AS fb, uy.name FROM edges e JOIN m x ON e.source = x.id JOIN m y ON e.target = y.id JOIN u ux ON ux.id = x.id JOIN u uy ON uy.id = y.id WHERE e.type = 'CALLS')
 SELECT a, b, count(*) AS n_flows, array_to_string(list_sort(list_distinct(list(name)))[1:20], ',') AS symbols FROM fl WHERE a <> b GROUP BY a, b""",
    "graph_entry_points": f"WITH {_UNIQUE}, n AS (SELECT target AS id, count(*) AS n_refs FROM edges WHERE type IN ('CALLS','REFERENCES') GROUP BY 1 HAVING count(*) >= 2) SELECT id, name, n_refs FROM u JOIN n USING (id) WHERE type = 'function' ORDER BY n_refs DESC, id LIMIT 10",
}
