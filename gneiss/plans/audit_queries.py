"""Queries of a whole audit, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import audit as A
from gneiss.operators import lines as L
from gneiss.plans.change_queries import _CLASSIFY, changes_files
from gneiss.plans.file_queries import _FILES, _LINES, _q
from gneiss.session import table


def _found(spark, d):
    return A.rule_findings(L.latest(table(spark, d, "codefile").select("file_id", "file_path", "raw_content", "ingested_at")))


def audit_findings(spark, d):
    return _found(spark, d)


def audit_corroborated(spark, d):
    return A.corroborated(_found(spark, d))


def audit_health(spark, d):
    return A.health(_found(spark, d))


def audit_incremental(spark, d):
    return A.changed_only(_found(spark, d), changes_files(spark, d)).groupBy("tool", "tier").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (audit_findings, audit_corroborated, audit_health, audit_incremental)}


def _tests() -> str:
    parts = []
    for pack, rules in L.PACKS.items():
        for r in rules:
            test = f"regexp_matches(line, {_q(r.pattern)})" + (f" AND NOT regexp_matches(line, {_q(r.but)})" if r.but else "") + (" AND language IN (" + ", ".join(map(_q, r.languages)) + ")" if r.languages else "")
            parts.append(f"SELECT {_q(pack)} AS tool, {_q(r.name)} AS category, {_q(r.severity)} AS severity, file_path, line_no FROM l WHERE {test}")
    return " UNION ALL ".join(parts)


_FOUND = f"{_FILES}, {_LINES}, h AS ({_tests()}), fd AS (SELECT tool, category, severity, file_path, min(line_no) AS line, count(*) AS count, CASE WHEN severity IN ('blocker','critical','high') THEN 'high' WHEN severity = 'medium' THEN 'medium' ELSE 'low' END AS tier FROM h GROUP BY 1, 2, 3, 4)"
_N = {t: f"sum((tier = '{t}')::INT)" for t in ("high", "medium", "low")}

SQL = {
    "audit_findings": f"WITH {_FOUND} SELECT * FROM fd",
    "audit_corroborated": f"WITH {_FOUND} SELECT file_path, line, count(DISTINCT tool) AS n_tools, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools FROM fd GROUP BY 1, 2 HAVING count(DISTINCT tool) > 1",
    "audit_health": f"WITH {_FOUND} SELECT split_part(file_path, '/', 1) AS repo, {_N['high']} AS n_high, {_N['medium']} AS n_medium, {_N['low']} AS n_low, greatest(0, floor((500 - 25 * {_N['high']} - 5 * {_N['medium']} - {_N['low']}) / 5))::INT AS score FROM fd GROUP BY 1",
    "audit_incremental": f"WITH {_FOUND}, {_CLASSIFY} SELECT tool, tier, count(*) AS n FROM fd WHERE file_path IN (SELECT path FROM c WHERE change IN ('added','changed')) GROUP BY 1, 2",
}
