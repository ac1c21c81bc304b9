"""Dependencies and the advisories that apply to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.functions.versions import in_range

#: (package prefix, version range, advisory, severity)
Advisory = tuple[str, str, str, str]


def lock_packages(files: DataFrame) -> DataFrame:
    """(repo, file_path, package, version) of JSON lock files."""
    locks = files.where("raw_content is not null").where(F.col("file_path").rlike(r"\.json$") & F.col("raw_content").contains('"packages"'))
    parsed = F.from_json("raw_content", "struct<packages:map<string,struct<version:string>>>")
    return locks.select("repo", "file_path", F.explode(parsed["packages"]).alias("package", "v")).select("repo", "file_path", "package", F.col("v.version").alias("version"))


_REQUIREMENT = r"^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*((?:[<>=!~]=?=?\s*[\w.*+!-]+\s*,?\s*)*)"


def requirements(files: DataFrame) -> DataFrame:
    """(file_path, line_no, package, constraint) of requirement lists; comments, options and blank lines are skipped."""
    rows = files.where(F.col("file_path").rlike(r"requirements[\w.-]*\.txt$")).select("file_path", F.posexplode(T.lines(F.col("raw_content"))).alias("line_no", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"\s*#.*$", "")).where(~F.col("line").rlike(r"^\s*(-|$)"))
    return rows.select("file_path", F.col("line_no") + 1, F.lower(F.regexp_extract("line", _REQUIREMENT, 1)).alias("package"), F.regexp_replace(F.regexp_extract("line", _REQUIREMENT, 2), r"\s", "").alias("constraint")).toDF("file_path", "line_no", "package", "constraint").where("package <> ''")


def go_modules(files: DataFrame) -> DataFrame:
    """(file_path, package, version) of go.mod files."""
    rows = files.where(F.col("file_path").rlike(r"(^|/)go\.mod$")).select("file_path", F.explode(T.lines(F.col("raw_content"))).alias("line"))
    p = r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v([\w.+-]+)"
    return rows.select("file_path", F.regexp_extract("line", p, 1).alias("package"), F.regexp_extract("line", p, 2).alias("version")).where("package <> ''")


def affected(packages: DataFrame, advisories: list[Advisory]) -> DataFrame:
    """packages + (advisory, severity): one row per package and advisory whose range holds its version."""
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(r).alias("range"), F.lit(a).alias("advisory"), F.lit(s).alias("severity")) for p, r, a, s in advisories]))
    found = packages.withColumn("a", rows).where(F.startswith("package", F.col("a.prefix"))).where(in_range(F.col("version"), F.col("a.range")))
    return found.select(*packages.columns, "a.advisory", "a.severity")


def unpinned(required: DataFrame, lock_folders: DataFrame) -> DataFrame:
    """(package, file_path): requirements without a fixed version in folders without a lock file; the first file of each."""
    loose = required.where(~F.col("constraint").rlike(r"^==[^*]+$")).withColumn("folder", T.directory(F.col("file_path")))
    loose = loose.join(lock_folders.select("folder").distinct(), "folder", "left_anti")
    order = W.partitionBy("package").orderBy("file_path", "line_no")
    return loose.withColumn("k", F.row_number().over(order)).where("k = 1").select("package", "file_path")


WEIGHTS = {"critical": 25, "high": 15, "medium": 5, "low": 2}


def scores(found: DataFrame) -> DataFrame:
    """(repo, n, score): 100 less a weight per distinct advisory and package, at least 0."""
    w = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    each = found.select("repo", "package", "advisory", "severity").distinct()
    return each.groupBy("repo").agg(F.count("*").alias("n"), F.greatest(F.lit(0), 100 - F.sum(w[F.col("severity")])).cast("int").alias("score"))
