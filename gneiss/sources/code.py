"""Reading code, graphs and settings from files, and writing findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import text as T

#: Folders that hold no source, fixed names of tools.
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".idea", ".tox", "target")


def scan_directory(spark: SparkSession, root: str, extensions: tuple[str, ...] = tuple(T.LANGUAGES), most_bytes: int = 5_000_000) -> DataFrame:
    """(file_path, language, size, mtime, raw_content): source files below a folder; larger ones keep a null content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    ignored = path.rlike("/(?:" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/")
    rows = files.where(~ignored & T.extension(path).isin(*extensions))
    return rows.select(path.alias("file_path"), T.language(path).alias("language"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), F.when(F.col("length") <= most_bytes, F.decode("content", "UTF-8")).alias("raw_content"))


def snapshot(files: DataFrame) -> DataFrame:
    """(path, mtime, size) of scanned files."""
    return files.select(F.col("file_path").alias("path"), "mtime", "size")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Edges (source, target, type, props) of a CSV file with a header; missing types are RELATES."""
    df = spark.read.option("header", True).csv(path)
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)
    return df.select(F.col("source"), F.col("target"), has("type", "RELATES").alias("type"), has("props", "{}").alias("props")).where("source is not null and target is not null")


def read_env(files: DataFrame) -> DataFrame:
    """(file_path, key, value) of .env files: export prefixes, quotes and comments are understood."""
    rows = files.where(F.col("file_path").rlike(r"\.env(\.\w+)?$")).select("file_path", F.explode(T.lines(F.col("raw_content"))).alias("line"))
    p = r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$"
    value = F.regexp_replace(F.regexp_extract("line", p, 2), r"^(['\"])(.*)\1$", "$2")
    return rows.select("file_path", F.regexp_extract("line", p, 1).alias("key"), value.alias("value")).where("key <> ''")


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files with their functions and imports: modules contain functions and import modules by last segment."""
    f = files.dropDuplicates(["file_path"]).select("file_path", "functions", "imports", "n_lines")
    mid = F.concat(F.lit("module:"), F.substring(F.md5("file_path"), 1, 16))
    modules = f.select(mid.alias("id"), F.lit("module").alias("type"), T.stem(F.col("file_path")).alias("name"), "file_path", F.lit(1).alias("start_line"), F.col("n_lines").alias("end_line"))
    fn = f.select(mid.alias("module"), "file_path", F.explode("functions").alias("f"))
    fid = F.concat(F.lit("function:"), F.substring(F.md5(F.concat_ws(":", "file_path", "f.name")), 1, 16))
    functions = fn.select(fid.alias("id"), F.lit("function").alias("type"), F.col("f.name").alias("name"), "file_path", F.col("f.start_line").alias("start_line"), F.col("f.end_line").alias("end_line"))
    contains = fn.select(F.col("module").alias("source"), fid.alias("target"), F.lit("CONTAINS").alias("type"))
    wanted = f.select(mid.alias("source"), F.explode("imports").alias("i")).select("source", F.regexp_extract("i", r"([\w-]+)$", 1).alias("name")).where("name <> ''").distinct()
    imports = wanted.join(modules.groupBy("name").agg(F.min("id").alias("target")), "name").select("source", "target", F.lit("IMPORTS").alias("type"))
    return modules.unionByName(functions), contains.unionByName(imports)


def write_findings(findings: DataFrame, path: str) -> None:
    """All fields of findings as JSON lines; Spark's commit makes the folder complete or absent."""
    findings.write.mode("overwrite").json(path)


def read_findings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def markdown_report(findings: DataFrame, limit: int = 50) -> str:
    """A report of counts by tool and severity and of the first findings; only those aggregates come to the driver."""
    from gneiss.operators.findings import distinct_findings, top

    f = distinct_findings(findings)
    counts = f.groupBy("tool", "severity").agg(F.count("*").alias("n")).orderBy("tool", "severity").collect()
    first = top(f, limit).collect()
    out = ["# Findings", "", "| tool | severity | n |", "|-|-|-|", *(f"| {r['tool']} | {r['severity']} | {r['n']} |" for r in counts), "", "## First findings", ""]
    return "\n".join([*out, *(f"- {r['severity']} {r['file_path']}:{r['line']} {r['title']}" for r in first), ""])


def mermaid(arcs: DataFrame, limit: int = 60) -> str:
    """A diagram of the heaviest arcs (a, b, n)."""
    rows = arcs.where("a <> b").orderBy(F.desc("n"), "a", "b").limit(limit).collect()
    ids: dict[str, str] = {}
    name = lambda m: ids.setdefault(m, f"n{len(ids)}")
    lines = [f"  {name(r['a'])} -->|{r['n']}| {name(r['b'])}" for r in rows]
    return "\n".join(["graph LR", *(f'  {i}["{m}"]' for m, i in ids.items()), *lines])
