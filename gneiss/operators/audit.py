"""A whole audit: rule packs over the lines of files become findings, findings are validated, denoised and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import findings as O
from gneiss.operators import lines as L


def rule_findings(files: DataFrame, packs: tuple[str, ...] = tuple(L.PACKS)) -> DataFrame:
    """(tool, category, severity, tier, file_path, line, count): one finding per pack, rule, severity and file, at its first line.

    All packs are tested in one pass over the lines; the hits of a file are counted before anything is shuffled further.
    """
    rows = L.lines(files)
    out = None
    for pack in packs:
        hits = L.hits(rows, L.PACKS[pack]).groupBy("file_path", "rule", "severity").agg(F.min("line_no").alias("line"), F.count("*").cast("int").alias("count"))
        own = hits.select(F.lit(pack).alias("tool"), F.col("rule").alias("category"), "severity", "file_path", "line", "count")
        out = own if out is None else out.unionByName(own)
    tier = F.when(F.col("severity").isin("blocker", "critical", "high"), "high").when(F.col("severity") == "medium", "medium").otherwise("low")
    return out.withColumn("tier", tier)


def corroborated(found: DataFrame) -> DataFrame:
    """(file_path, line, n_tools, tools): places that several packs report."""
    g = found.groupBy("file_path", "line").agg(F.countDistinct("tool").alias("n_tools"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))
    return g.where("n_tools > 1")


def health(found: DataFrame) -> DataFrame:
    """(repo, n_high, n_medium, n_low, score)."""
    return O.health_scores(found)


def changed_only(found: DataFrame, changes: DataFrame) -> DataFrame:
    """The findings of files that were added or changed (path, change): what an incremental audit reports."""
    touched = changes.where("change in ('added', 'changed')").select(F.col("path").alias("file_path"))
    return found.join(touched, "file_path", "left_semi")
